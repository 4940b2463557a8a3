"""Exact dedup with an extendible-hash index on shared files (operator 2).

Only DataFrame functions, in four steps:

1. every row's key (64-bit hash of the normalised text), digest and length go to files;
2. the directory doubles until no bucket of key prefixes holds more than ``capacity``
   keys. A bucket is a range of keys; those that stay small keep a shorter prefix, and
   the slots of a directory of ``MAX_SLOT_BITS`` that are still overfull double on their
   own, up to all 64 bits. Consecutive slots of about ``OWNER_KEYS`` keys have one owner;
3. texts are compared byte for byte by grouping on bucket, key and text (map tasks
   combine copies first, so a large group sends one row for each task). The entries go to
   their owner, one task for each range of keys, which chains those of a key and writes
   them into its own folder of the index;
4. rows find owner and bucket in the directory and look up their entry there. Keys of
   more than a thousandth of all rows, fewer than a thousand, are looked up by broadcast.

``Index`` keeps directory and folders for later tables: ``lookup`` routes other texts by
the directory and reads the folders of the owners it names, and no others.

Defined results: null text is empty, and empty texts form a group; null doc_id counts as
larger than any other; of repeated rows (same doc_id and text) one is kept; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import HEAVY_SHARE, scratch, table, through_files

BLANK = r"[\x20\x09-\x0D]+"
#: Keys of a bucket, and of the range of buckets that one owner task writes, about.
CAPACITY = 65_536
OWNER_KEYS = 4 * CAPACITY
#: Slots of the directory are 2 ** MAX_SLOT_BITS at most (a table of 2 MB, which is broadcast); buckets split below a slot too.
MAX_SLOT_BITS = 16
_LAST_ID = (1 << 63) - 1


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
        .select("doc_id", F.length("text").cast("long").alias("n_chars"), F.regexp_replace("text", BLANK, "").alias("norm"))
        .withColumn("key", F.xxhash64("norm"))
    )


def _prefix(key, bits):
    """The key with all but its first bits cleared; bits is a column from 0 to 64."""
    return F.when(bits <= 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(shiftright(key, 64 - local_depth), 64 - local_depth)"))


def directory(keys: DataFrame, slot_bits: int, capacity: int = CAPACITY, owner_keys: int = OWNER_KEYS) -> DataFrame:
    """``slot, local_depth, owner`` for every used slot of ``slot_bits`` bits: the least depth at which no bucket of the slot is overfull, and its owner.

    ``keys(key)`` has distinct keys. The counts have one row for each used slot, at most 2 ** slot_bits.
    """
    slot = F.shiftrightunsigned("key", 64 - slot_bits)
    slots = through_files(keys.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")), "dedup-slots")
    levels = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(slot_bits))).alias("d")).withColumn("prefix", F.expr(f"shiftright(slot, {slot_bits} - d)"))
    sizes = levels.groupBy("d", "prefix").agg(F.sum("n").alias("held"))
    fit = levels.join(sizes, ["d", "prefix"]).where((F.col("held") <= capacity) | (F.col("d") == slot_bits))
    depths = fit.groupBy("slot").agg(F.min("d").alias("local_depth"))

    depth, found = slot_bits, depths
    full = slots.where(F.col("n") > capacity).select("slot")
    while depth < 64 and not full.isEmpty():  # the overfull slots double on their own
        depth += 1
        deeper = keys.withColumn("slot", slot).join(F.broadcast(full), "slot").groupBy("slot", F.shiftrightunsigned("key", 64 - depth).alias("prefix")).agg(F.count("*").alias("n"))
        full = through_files(deeper.where(F.col("n") > capacity).select("slot").distinct(), "dedup-slots")
        found = through_files(found.join(F.broadcast(deeper.select("slot").distinct().withColumn("deeper", F.lit(depth))), "slot", "left").select("slot", F.coalesce("deeper", "local_depth").alias("local_depth")), "dedup-slots")

    # buckets of several slots stay with one owner, as all their slots count from the first one
    ahead = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # 2 ** slot_bits rows at most
    start = slots.join(found, "slot").withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    wide = F.greatest(F.lit(slot_bits) - F.col("local_depth"), F.lit(0))
    start = start.withColumn("wide", wide).withColumn("home", F.expr("shiftleft(shiftright(slot, wide), wide)"))
    first = Window.partitionBy("home")
    return start.select("slot", "local_depth", F.floor(F.min("before").over(first) / owner_keys).cast("int").alias("owner"))


def route(keyed: DataFrame, slots: DataFrame, slot_bits: int) -> DataFrame:
    """keyed(key, ...) with owner and bucket (the first key of its range), by the directory; keys of unused slots are left out."""
    placed = keyed.withColumn("slot", F.shiftrightunsigned("key", 64 - slot_bits)).join(F.broadcast(slots), "slot")
    return placed.withColumn("bucket", _prefix(F.col("key"), F.col("local_depth"))).drop("slot", "local_depth")


def _rank_of(n_chars, doc_id):
    """One number that is larger for more code points, then for a smaller doc_id; it decodes by _id_of."""
    wide = "decimal(38,0)"
    return n_chars.cast(wide) * F.lit(str(1 << 64)).cast("decimal(20,0)") + (F.lit(_LAST_ID).cast(wide) - F.coalesce(doc_id, F.lit(_LAST_ID)).cast(wide))


def _chars_of(rank):
    base = F.lit(str(1 << 64)).cast("decimal(20,0)")
    return ((rank - rank % base) / base).cast("long")


def _id_of(rank):
    got = (F.lit(_LAST_ID).cast("decimal(38,0)") - rank % F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("long")
    return F.when(got != _LAST_ID, got)


@dataclass(frozen=True)
class Index:
    """A directory (slots of ``slot_bits`` bits) and the folder whose ``owner=`` parts hold the entries."""

    slots: DataFrame
    slot_bits: int
    path: str

    def entries(self) -> DataFrame:
        return self.slots.sparkSession.read.schema("bucket long, key long, link int, digest binary, group_size long, keep_id long, keep_n long, owner int").parquet(self.path)

    def lookup(self, docs: DataFrame) -> DataFrame:
        """``doc_id, keep_id, group_size`` for the rows of docs whose text is in the index. Only the folders of owners that the directory names are read; their list is bounded by its slots."""
        wanted = through_files(route(_keyed(docs), self.slots, self.slot_bits).select("doc_id", "owner", "bucket", "key", F.unhex(F.sha2("norm", 256)).alias("digest")), "dedup-lookup")
        owners = [r["owner"] for r in wanted.select("owner").distinct().collect()]
        held = self.entries().where(F.col("owner").isin(owners))
        return wanted.join(held, ["owner", "bucket", "key", "digest"]).select("doc_id", "keep_id", "group_size")


def build_index(docs: DataFrame, capacity: int = CAPACITY) -> tuple[Index, DataFrame]:
    """The index of ``docs(doc_id, text)`` and its rows ``doc_id, n_chars, key, digest, row``, both in files."""
    keyed = _keyed(docs)
    rows = keyed.select("doc_id", "n_chars", "key", F.unhex(F.sha2("norm", 256)).alias("digest"))
    rows = through_files(rows.withColumn("row", F.monotonically_increasing_id()), "dedup-rows")
    slot_bits = min(MAX_SLOT_BITS, max(1, (rows.count() // capacity).bit_length() + 3))
    slots = through_files(directory(rows.select("key").distinct(), slot_bits, capacity, 4 * capacity), "dedup-directory")

    placed = route(keyed, slots, slot_bits)
    texts = placed.groupBy("owner", "bucket", "key", "norm").agg(F.count("*").alias("group_size"), F.max(_rank_of(F.col("n_chars"), F.col("doc_id"))).alias("best"))
    entries = texts.select("owner", "bucket", "key", F.unhex(F.sha2("norm", 256)).alias("digest"), "group_size", _id_of(F.col("best")).alias("keep_id"), _chars_of(F.col("best")).alias("keep_n"))
    owners = (slots.agg(F.max("owner")).first()[0] or 0) + 1
    chain = Window.partitionBy("owner", "bucket", "key").orderBy("digest")
    owned = entries.repartitionById(owners, F.col("owner")).withColumn("link", F.row_number().over(chain))
    path = scratch(docs.sparkSession, "dedup-index")
    owned.select("bucket", "key", "link", "digest", "group_size", "keep_id", "keep_n", "owner").sortWithinPartitions("owner", "bucket", "key", "link").write.partitionBy("owner").parquet(path)
    return Index(slots, slot_bits, path), rows


def find_duplicates(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, n_chars`` for every row of ``docs(doc_id, text)``."""
    index, rows = build_index(docs, capacity)
    total, fields = rows.count(), ["owner", "bucket", "key", "digest"]
    asked = route(rows, index.slots, index.slot_bits)
    entries = index.entries().select(*fields, "keep_id", "keep_n", "group_size")
    large = F.col("group_size") * HEAVY_SHARE > total
    heavy = entries.where(large)
    found = asked.join(F.broadcast(heavy), fields).unionByName(asked.join(F.broadcast(heavy.select(*fields)), fields, "left_anti").join(entries.where(~large), fields))
    found = through_files(found.select("row", "doc_id", "keep_id", "keep_n", "group_size", "digest", "n_chars"), "dedup-found")
    # of rows that repeat the one that stays, the first written stays: one row for each group after the map tasks
    same = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_n"))
    stays = found.where(same).groupBy("digest").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("kept"))
    return found.join(stays, "row", "left").select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.coalesce("kept", F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "n_chars")


def deduplicate(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows that repeat doc_id and text, one."""
    held = find_duplicates(docs, capacity).where("kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"), F.col("n_chars").alias("__n"))
    held = through_files(held, "dedup-kept")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.withColumns({"__own_n": F.length(text).cast("long"), "__own_sha": F.sha2(F.regexp_replace(text, BLANK, ""), 256)})
    match = own["doc_id"].cast("long").eqNullSafe(held["__id"]) & (own["__own_sha"] == held["__sha"]) & (own["__own_n"] == held["__n"])
    return own.join(held, match, "left_semi").dropDuplicates(["doc_id", "__own_sha", "__own_n"]).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return find_duplicates(table(spark, sf_dir, "documents")).drop("n_chars")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), n AS (
  SELECT doc_id, length(t) AS n, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS s FROM d
), g AS (
  SELECT doc_id, s, first_value(doc_id) OVER (PARTITION BY s ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY s) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, s AS text_sha256 FROM g
"""
