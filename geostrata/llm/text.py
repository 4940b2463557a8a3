"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor can reach.

    Where a local session names no such folder one under /tmp is taken; on a cluster that is an error,
    as each executor would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = held.get() if held.isDefined() else "/tmp/geostrata-checkpoints"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def through_files(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key is heavy from this share of all rows on, one in so many, and from HEAVY_LEAST rows. There are fewer heavy keys than HEAVY_SHARE.
HEAVY_SHARE, HEAVY_LEAST = 1000, 500


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``many`` joined with ``one``, a written table that has one row for each key and in ``count`` how many rows of many have it.

    Heavy keys, fewer than ``HEAVY_SHARE``, are broadcast, so their rows stay where they are; the rest is shuffled.
    """
    facts = one.agg(F.sum(count).alias("total"), F.max(count).alias("most")).first()
    if (facts["most"] or 0) < HEAVY_LEAST or facts["most"] * HEAVY_SHARE <= facts["total"]:
        return many.join(one, keys)
    large = (F.col(count) * HEAVY_SHARE > facts["total"]) & (F.col(count) >= HEAVY_LEAST)
    heavy = one.where(large)
    rest = many.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(one.where(~large), keys)
    return many.join(F.broadcast(heavy), keys).unionByName(rest)


#: Rows of a range in which running sums add up, about.
RANGE_ROWS = 50_000


def running_sums(df: DataFrame, by: list[str], order: list, sums: dict[str, str], label: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with, for each ``name: column`` of sums, the sum of the column over the rows of the same ``by`` that come earlier in ``order``.

    Rows are dealt to ranges of the order and written; sums run within a range and over the totals of the ranges, so
    neither a large group nor the whole table is ordered in one task. ``order`` is total within ``by``.
    """
    ranges = max(1, -(-df.count() // range_rows))
    dealt = through_files(df.repartitionByRange(ranges, *by, *order).withColumn("__part", F.spark_partition_id()), label)
    ahead = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(*by, "__part").agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    totals = totals.select(*(F.col(k).alias(f"__by_{k}") for k in by), F.col("__part").alias("__own"), *(F.coalesce(F.sum(f"__{n}").over(ahead), F.lit(0)).alias(f"__{n}") for n in sums))
    same = F.col("__part") == F.col("__own")
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"__by_{k}"))
    within = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(totals, same)
    placed = placed.select(*df.columns, *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"__in_{n}") for n, c in sums.items()), *(f"__{n}" for n in sums))
    return placed.select(*df.columns, *((F.col(f"__{n}") + F.col(f"__in_{n}")).alias(n) for n in sums))


LOWER_AZ = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def ragged(lengths: np.ndarray) -> np.ndarray:
    """Start offsets of consecutive runs, one more than there are runs."""
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))


def column_or_null(df: DataFrame, name: str, kind: str):
    """The column cast to a kind, or nulls where the table lacks it."""
    return (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)


def slices(texts: list[str], chars: int = 1_000_000):
    """Ranges of consecutive texts with a bounded number of characters together (one text at least)."""
    start = held = 0
    for k, t in enumerate(texts):
        if held and held + len(t) > chars:
            yield start, k
            start, held = k, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


#: Bytes of one Arrow batch between the JVM and a Python worker; long texts then can't gather in memory.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches bounded by BATCH_BYTES (a smaller bound stays)."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    held = str(conf.get(name)).lower().removesuffix("b")
    if not held.isdigit() or int(held) > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df


def joined_sha256(parts: DataFrame, key: str, order: str, piece: str, n: str) -> DataFrame:
    """``key, sha256``: lowercase hex of SHA-256 over the pieces of a key in order, joined, without their first character.

    ``parts`` has one row for each piece and in ``n`` how many its key has. A key with one piece is hashed in the JVM;
    of others a task hashes one piece after the other and holds no more than one, as SHA-256 can't be split.
    """
    one = parts.where(F.col(n) == 1).select(key, F.sha2(F.substring(piece, 2, (1 << 31) - 1).cast("binary"), 256).alias("sha256"))

    def run(batches):
        held = digest = None
        begun = False
        for batch in batches:
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is None or k != held:
                    if digest is not None:
                        yield pa.record_batch([pa.array([held], pa.string()), pa.array([digest.hexdigest()])], [key, "sha256"])
                    held, digest, begun = k, hashlib.sha256(), False
                digest.update((value if begun else value[1:]).encode("utf-8", "surrogatepass"))
                begun = begun or bool(value)
        if digest is not None:
            yield pa.record_batch([pa.array([held], pa.string()), pa.array([digest.hexdigest()])], [key, "sha256"])

    many = parts.where(F.col(n) > 1).select(key, piece, order).repartition(F.col(key)).sortWithinPartitions(key, order).select(key, piece)
    return one.unionByName(small_batches(many).mapInArrow(run, f"{key} string, sha256 string"))


def crc32_of(text: Column) -> Column:
    """Unsigned CRC-32 of a string column's UTF-8 bytes."""
    return F.crc32(text.cast("binary"))


def crc32_sql(text: str) -> str:
    """The same in DuckDB's SQL, for strings of ASCII."""
    step = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda q: ascii(q)::BIGINT)), lambda c, b: {step}), 4294967295)"
