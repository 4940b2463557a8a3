"""Sharding along a Hilbert curve (operator 9), by the law ``rows``.

Source, language and size are quantised to ``2 ** BITS`` steps each, by cut points at
equal shares of the rows (strings by their whole values), and a document's cell gets its
index on the Hilbert curve. Cells are dealt into ranges by their bytes: several small
cells share a range, and a cell larger than ``RANGE_BYTES`` is cut into as many ranges as
it needs by a hash of doc_id, so neither a cell that holds a third of all rows nor one of
very long texts gathers in a task. The ranges' counts, known before texts move, give
each row its place; shards are runs of places cut at equal counts, and the corpus is
written once, by shard and range. A file thus lies in one shard, covers a small box of
the metadata, and its minima and maxima prune scans (``boxes``).

Defined results: null text has size 1 and checksum 0; null metadata counts as empty and
comes first; a null doc_id is dealt by its text; repeated rows get places of
their own; with fewer rows than shards some shards stay empty; an empty table gives no
rows. Of further columns only those named are written.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import column_or_null, running_sums, scratch, table, through_files

SHARDS = 8
BITS = 4
#: Text bytes of one written range, about.
RANGE_BYTES = 24 << 20
#: One row for each range is broadcast up to this many (3 MB); beyond it the join shuffles.
BROADCAST_RANGES = 100_000
_WRITTEN = "doc_id long, text string, lang string, source string, size long, crc long, hilbert int, slot long, shard int"


def hilbert_index(axes: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of integer points, ``axes`` of shape (dimensions, points) with values below 2 ** bits.

    Skilling's transform: undo the excess work of each level from the top, Gray-encode, interleave.
    """
    x = [a.astype(np.int64).copy() for a in axes]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(len(x)):
            hit = (x[i] & q) > 0
            t = np.where(hit, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(hit, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = x[i] ^ t
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) > 0, t ^ (q - 1), t)
        q >>= 1
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for a in x:
            index = index << 1 | ((a ^ t) >> b & 1)
    return index


def string_cuts(values: DataFrame, steps: int) -> list[str]:
    """Up to ``steps - 1`` values that cut ``values(v, n)``, one row for each distinct value, at equal shares of n."""
    placed = running_sums(values, [], ["v"], {"before": "n"}, "shard-values")
    total = F.broadcast(values.agg(F.sum("n").alias("total")))
    step = F.floor((F.col("before") + F.col("n") / 2) * steps / F.col("total"))
    first = placed.join(total).groupBy(step.alias("k")).agg(F.min("v").alias("v"))
    return [r["v"] for r in first.where("k > 0").orderBy("v").collect()]  # steps - 1 rows


def write(docs: DataFrame, path: str, shards: int = SHARDS, bits: int = BITS, range_bytes: int = RANGE_BYTES) -> None:
    """Write ``docs(doc_id, text, lang, source)`` below path in curve order, with ``size, crc, hilbert, slot`` and, as folders, ``shard``."""
    rows = docs.select(column_or_null(docs, "doc_id", "long"), column_or_null(docs, "text", "string"), column_or_null(docs, "lang", "string"), column_or_null(docs, "source", "string"))
    name = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = rows.withColumn("size", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"))
    steps = 1 << bits
    counted = through_files(rows.groupBy(name("source").alias("source"), name("lang").alias("lang")).agg(F.count("*").alias("n")), "shard-names")
    cuts = [np.array(string_cuts(counted.groupBy(F.col(c).alias("v")).agg(F.sum("n").alias("n")), steps), object) for c in ("source", "lang")]
    cuts.append(np.array(rows.agg(F.percentile_approx("size", [k / steps for k in range(1, steps)], 10_000)).first()[0] or [], object))

    @F.pandas_udf("int")
    def curve(source: pd.Series, lang: pd.Series, size: pd.Series) -> pd.Series:
        axes = np.array([np.searchsorted(cut, s.to_numpy(object), side="right") for cut, s in zip(cuts, (source, lang, size), strict=True)])
        return pd.Series(hilbert_index(axes, bits).astype(np.int32))

    dealt = F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(1 << 20))
    placed = rows.withColumns({"hilbert": curve(name("source"), name("lang"), "size"), "deal": dealt})

    # slim passes: bytes of the cells (2 ** (3 * bits) at most), then rows of the ranges
    cells = placed.groupBy("hilbert").agg(F.sum("size").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.orderBy("hilbert").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = through_files(cells.select("hilbert", before.alias("before"), "held", F.ceil(F.col("held") / range_bytes).alias("cuts")), "shard-cells")
    share = F.floor(F.col("deal") * F.col("cuts") / (1 << 20))
    part = F.floor((F.col("before") + share * F.col("held") / F.col("cuts")) / range_bytes).cast("int")
    placed = placed.join(F.broadcast(cells), "hilbert").withColumn("part", part).drop("before", "held", "cuts", "deal")
    ranges = running_sums(placed.groupBy("part").agg(F.count("*").alias("n")), [], ["part"], {"before": "n"}, "shard-ranges")
    ranges = through_files(ranges, "shard-ranges")
    found = ranges.agg(F.sum("n").alias("total"), F.count("*").alias("many"), F.max("part").alias("last")).first()
    if found["many"] <= BROADCAST_RANGES:
        ranges = F.broadcast(ranges)
    total = found["total"] or 0

    # a range is a task: it knows its first place, so a row's place is its number there
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    ordered = placed.join(ranges.select("part", "before"), "part").withColumn("crc", crc).repartitionById((found["last"] or 0) + 1, F.col("part"))
    own = Window.partitionBy("part").orderBy("hilbert", "doc_id", "crc")
    place = F.col("before") + F.row_number().over(own) - 1
    shard = F.expr(f"place * {shards} div {max(1, total)}")
    slot = F.expr(f"place - (shard * {total} + {shards - 1}) div {shards}")
    numbered = ordered.withColumn("place", place).withColumn("shard", shard.cast("int")).withColumn("slot", slot)
    numbered.select("doc_id", "text", "lang", "source", "size", "crc", "hilbert", "slot", "shard").write.partitionBy("shard").parquet(path)


def read(spark, path: str) -> DataFrame:
    """The written rows with ``shard`` and ``slot``."""
    return spark.read.schema(_WRITTEN).parquet(path)


def boxes(spark, path: str) -> DataFrame:
    """``file, shard, n`` and the least and largest source, lang and size of each file: what a scan can skip."""
    ends = (f(c).alias(f"{n}_{c}") for c in ("source", "lang", "size") for n, f in (("min", F.min), ("max", F.max)))
    return read(spark, path).groupBy(F.col("_metadata.file_path").alias("file"), "shard").agg(F.count("*").alias("n"), *ends)


def query(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "shards")
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path).select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
