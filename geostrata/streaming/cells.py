"""Incremental cell aggregation: new point files update counts and sums of their cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import GRID, Grid
from ..operators.cells import with_cells

POINTS = "x double, y double, z double"


def point_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Points from Parquet files as they appear; files still being written end in another suffix."""
    return spark.readStream.schema(POINTS).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(folder)


def cell_totals(points: DataFrame, grid: Grid = GRID) -> DataFrame:
    """row, col, n, mean_z, min_z, max_z of cells; all mergeable, so the state is one row for each cell."""
    return with_cells(points, grid).where("valid").groupBy("row", "col").agg(F.count("*").alias("n"), F.avg("z").alias("mean_z"), F.min("z").alias("min_z"), F.max("z").alias("max_z"))


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by window and type, closed once the watermark has passed."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("window.start", "event_type", "n", "total")
