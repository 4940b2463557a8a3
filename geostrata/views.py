"""Geospatial inputs derived from the relational tables, as DataFrames and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import GRID, Frame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One laser return for each line item."""
    y = (F.col("l_orderkey") * 37 + F.col("l_partkey") * 11 + F.col("l_suppkey") * 3) % 1000
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("site"),
        (F.col("l_extendedprice") / F.lit(1000.0)).alias("x"),
        (y / F.lit(10.0)).alias("y"),
        F.col("l_quantity").alias("z"),
        (F.col("l_discount") * 1000).alias("intensity"),
        F.col("l_linenumber").alias("return_number"),
        F.col("l_linestatus").alias("classification"),
    )


POINTS = """pts AS (
  SELECT l_returnflag AS site, l_extendedprice / 1000::DOUBLE AS x,
         ((l_orderkey * 37 + l_partkey * 11 + l_suppkey * 3) % 1000) / 10::DOUBLE AS y, l_quantity AS z,
         l_discount * 1000 AS intensity, l_linenumber AS return_number, l_linestatus AS classification
  FROM lineitem
)"""
INSIDE = "x >= 0 AND x < 105 AND y >= 0 AND y < 100"


def full_grid(spark: SparkSession, grid: Frame = GRID) -> DataFrame:
    """Every (row, col) of a grid, with its site where there are several."""
    return grid.cells(spark)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares with a class and a score from parts."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.alias("id"),
        ((key * 37 % 1000) / F.lit(10.0)).alias("cx"),
        ((key * 91 % 1000) / F.lit(10.0)).alias("cy"),
        (F.lit(0.5) + F.col("p_size") / F.lit(20.0)).alias("half"),
        (key % 4).alias("cls"),
        ((key * 7919 % 1000) / F.lit(1000.0)).alias("score"),
    )


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground-truth squares from suppliers."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("id"),
        ((key * 37 % 1000) / F.lit(10.0) + 0.3).alias("cx"),
        ((key * 91 % 1000) / F.lit(10.0) - 0.2).alias("cy"),
        (F.lit(0.5) + (key * 13 % 50) / F.lit(20.0)).alias("half"),
        (key % 4).alias("cls"),
    )


OBJECTS = """det AS (
  SELECT p_partkey AS id, (p_partkey * 37 % 1000) / 10::DOUBLE AS cx, (p_partkey * 91 % 1000) / 10::DOUBLE AS cy,
         0.5::DOUBLE + p_size / 20::DOUBLE AS half, p_partkey % 4 AS cls, (p_partkey * 7919 % 1000) / 1000::DOUBLE AS score
  FROM part
), gt AS (
  SELECT s_suppkey AS id, (s_suppkey * 37 % 1000) / 10::DOUBLE + 0.3::DOUBLE AS cx,
         (s_suppkey * 91 % 1000) / 10::DOUBLE - 0.2::DOUBLE AS cy,
         0.5::DOUBLE + (s_suppkey * 13 % 50) / 20::DOUBLE AS half, s_suppkey % 4 AS cls
  FROM supplier
)"""

#: A dense elevation model: mean z of the cell, else that of the nearest cell (by squared distance, row, column).
DENSE = f"""{POINTS}, cells AS (
  SELECT floor(y)::INT AS row, floor(x)::INT AS col, avg(z) AS v, min(z) AS low, count(*) AS n FROM pts WHERE {INSIDE} GROUP BY ALL
), g AS (
  SELECT r.range::INT AS row, c.range::INT AS col FROM range(100) r, range(105) c
), raw AS (
  SELECT g.row, g.col, v, low, n FROM g LEFT JOIN cells ON g.row = cells.row AND g.col = cells.col
), near AS (
  SELECT h.row, h.col, min_by({{'v': d.v, 'low': d.low}}, ((d.row - h.row) * (d.row - h.row) + (d.col - h.col) * (d.col - h.col))::BIGINT * 1000000 + d.row * 1000 + d.col) AS d
  FROM (SELECT row, col FROM raw WHERE v IS NULL) h, (SELECT * FROM raw WHERE v IS NOT NULL) d GROUP BY h.row, h.col
), dense AS (
  SELECT raw.row, raw.col, coalesce(raw.v, near.d.v) AS z, coalesce(raw.low, near.d.low) AS low, raw.v IS NOT NULL AS observed
  FROM raw LEFT JOIN near ON raw.row = near.row AND raw.col = near.col
)"""
