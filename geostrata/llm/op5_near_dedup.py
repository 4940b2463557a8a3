"""MinHash near-dedup with tensored banding (operator 5).

A document's set is its distinct shingles. Two collections of ``ENTRIES`` entries of
``WIDTH`` minima each are computed; a table key combines entry i of the first with entry
j of the second, so ``2 * ENTRIES * WIDTH`` minima give ``ENTRIES ** 2`` tables over
``2 * WIDTH`` minima. At the linking similarity 0.8 a pair misses all tables with
probability 2 * (1 - 0.8 ** WIDTH) ** ENTRIES: 2e-5 with the numbers below.

1. One pass over the texts gives each document's sketch and a 128-bit fingerprint of its
   set. Equal sets form a class of which the smallest doc_id goes on.
2. Entries that no other document has can't combine, so they are left out before tables
   are formed. Tables and their leaders are found by partial aggregates.
3. (Steps 3 and 4 serve operator 11 too.) Every document is compared with leaders of its tables, on full sets: with all those of
   tables of two, and with ``LEADERS`` others. Links join documents to components.
4. Tables of three or more that still hold several components are compared exactly:
   their documents form groups, groups are cut into blocks of bounded size, and each pair
   of blocks with a table in common that can link and isn't inside one component is one task
   over packed sets. It returns
   links that span what it connects, never pairs. Hence no link between candidates is
   lost, and a large group is neither gathered in one task nor expanded into its pairs.

Defined results: null or blank text has an empty set, component_id is its own doc_id;
fewer words than a shingle give one shingle of all; equal sets are linked; repeated rows
each get a row; a row with null doc_id is linked with nothing and is kept; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .text import column_or_null, ragged, running_sums, slices, small_batches, spread_join, table, through_files

WORDS = 5
SIMILARITY = 80
ENTRIES = 16
WIDTH = 3
LEADERS = 4
SEED = 5
#: Shingles of a block in step 4, about; each document counts some more.
BLOCK_SHINGLES = 120_000
#: Documents of a range in which step 4 adds up sizes, about.
RANGE_DOCS = 50_000
#: Pairs that meet one copy of a leader's set, about.
PAIRS_OF_COPY = 2_000
#: Candidate ids are broadcast up to this many (8 MB of numbers); beyond it the join shuffles the texts.
BROADCAST_IDS = 1_000_000

_FOLD = bytes(32 if c in (9, 10, 11, 12, 13) else c + 32 if 65 <= c <= 90 else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all texts in one array, and the offsets of the texts."""
    found, sizes = [], []
    for text in texts:
        own = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
        size = max(min(1, len(own)), len(own) - words + 1)
        shingles = np.full(size, len(own) if len(own) < words else words, np.uint64)
        for k in range(min(words, len(own))):
            shingles = (shingles ^ hashes[k : k + size]) * _MIX
            shingles ^= shingles >> np.uint64(29)
        shingles = np.unique(shingles)
        found.append(shingles)
        sizes.append(len(shingles))
    return np.concatenate(found) if found else np.zeros(0, np.uint64), ragged(np.array(sizes, np.int64))


def sketch_entries(shingles: np.ndarray, offsets: np.ndarray, entries: int, width: int, seed: int) -> np.ndarray:
    """``2 * entries`` signed 64-bit entries of every non-empty set, each over ``width`` minima; the place is mixed in."""
    rng = np.random.default_rng(seed)
    count = 2 * entries * width
    factor = rng.integers(0, 1 << 63, count, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    shift = rng.integers(0, 1 << 63, count, dtype=np.uint64)
    starts = offsets[:-1][np.diff(offsets) > 0]
    out = np.zeros((len(starts), 2 * entries), np.uint64)
    folded = shingles ^ shingles >> np.uint64(32)
    for e in range(2 * entries):
        value = np.full(len(starts), e + 1, np.uint64)
        for k in range(e * width, (e + 1) * width):
            hashed = folded * factor[k] + shift[k]
            lowest = np.minimum.reduceat(hashed, starts)
            value = (value ^ lowest) * _MIX
            value ^= value >> np.uint64(31)
        out[:, e] = value
    return out.view(np.int64)


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select(column_or_null(docs, "doc_id", "long"), column_or_null(docs, "text", "string"))


def sketches(docs: DataFrame, words: int, entries: int, width: int, seed: int) -> DataFrame:
    """``doc_id, n_shingles, print1, print2, entries array<long>``; the last three are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, z in slices([t or "" for t in texts], 1_000_000):
                shingles, offsets = shingle_sets(texts[a:z], words)
                some = np.diff(offsets) > 0
                values = sketch_entries(shingles, offsets, entries, width, seed) if some.any() else np.zeros((0, 2 * entries), np.int64)
                prints = [xxhash.xxh3_128_digest(shingles[offsets[k] : offsets[k + 1]].tobytes()) for k in np.flatnonzero(some)]
                halves = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2)
                place = np.cumsum(some) - 1
                gone = pa.array(~some)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(some * 2 * entries))).astype(np.int32)), pa.array(values.ravel()), mask=gone)
                columns = [pa.array(np.where(some, halves[place % max(1, len(halves)), h] if len(halves) else 0, 0), mask=~some) for h in (0, 1)]
                yield pa.record_batch([batch.column("doc_id").slice(a, z - a), pa.array(np.diff(offsets)), *columns, lists], ["doc_id", "n_shingles", "print1", "print2", "entries"])

    return small_batches(_docs(docs)).mapInArrow(run, "doc_id long, n_shingles long, print1 long, print2 long, entries array<long>")


def texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc_id, text`` of the documents in ``wanted(doc)``."""
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = _docs(docs)
    return texts.join(wanted, texts["doc_id"] == wanted["doc"], "left_semi")


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``doc, shingles array<long>`` of the documents in ``wanted(doc)``, one row for each id."""
    texts = texts_of(docs, wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, z in slices([t or "" for t in texts], 1_000_000):
                shingles, offsets = shingle_sets(texts[a:z], words)
                yield pa.record_batch([batch.column("doc_id").slice(a, z - a), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(shingles.view(np.int64)))], ["doc", "shingles"])

    return small_batches(texts).mapInArrow(run, "doc long, shingles array<long>")


def _linked(similarity: int):
    both = F.col("n_u") + F.col("n_v") - F.col("shared")
    return 100 * F.col("shared") >= similarity * both


def verify(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The ``pairs(u, v)`` that are linked on full sets. The set of a v with many pairs is copied, so they meet it in several tasks."""
    counts = through_files(pairs.groupBy("v").agg(F.count("*").alias("n")).withColumn("copies", F.ceil(F.col("n") / PAIRS_OF_COPY)), "near-counts")
    dealt = spread_join(pairs, counts, ["v"], "n").select("u", "v", F.pmod(F.xxhash64("u"), "copies").alias("copy"))
    left = sets.select(F.col("doc").alias("u"), F.col("shingles").alias("su"))
    right = sets.join(counts, sets["doc"] == counts["v"]).select("v", F.col("shingles").alias("sv"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    joined = dealt.join(left, "u").join(right, ["v", "copy"])
    sized = joined.select("u", "v", F.size("su").alias("n_u"), F.size("sv").alias("n_v"), F.size(F.array_intersect("su", "sv")).alias("shared"))
    return sized.where(_linked(similarity)).select("u", "v")


def block_links(docs: np.ndarray, blocks: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], similarity: int, chunk: int = 4096) -> list[tuple[int, int]]:
    """Links that span what two blocks (or one) connect beyond the components they have."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, held = np.unique(flat, return_inverse=True, return_counts=True)
    common = held > 1
    column, row = (np.cumsum(common) - 1)[column[common[column]]], row[common[column]]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    one, two = np.flatnonzero(blocks == blocks.min()), np.flatnonzero(blocks == blocks.max())
    shared = np.zeros((len(one), len(two)), np.int64)
    cut = np.searchsorted(column, np.arange(0, int(common.sum()) + chunk, chunk))
    for k, (a, z) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        dense = np.zeros((len(sets), chunk), np.float32)
        dense[row[a:z], column[a:z] - k * chunk] = 1
        shared += (dense[one] @ dense[two].T).astype(np.int64)  # a chunk's counts are exact in float32
    linked = 100 * shared >= similarity * (sizes[one][:, None] + sizes[two][None, :] - shared)
    group = {c: c for c in comps.tolist()}

    def root(c: int) -> int:
        while group[c] != c:
            group[c] = group[group[c]]
            c = group[c]
        return c

    out = []
    for i, j in zip(*np.nonzero(linked & (comps[one][:, None] != comps[two][None, :])), strict=True):
        a, b = root(int(comps[one[i]])), root(int(comps[two[j]]))
        if a != b:
            group[max(a, b)] = min(a, b)
            out.append((int(docs[one[i]]), int(docs[two[j]])))
    return out


def _blocked(docs: DataFrame, range_docs: int = RANGE_DOCS) -> DataFrame:
    """``docs(doc, comp, grp, weight)`` with ``block``: runs of about ``BLOCK_SHINGLES`` of a group's weights in the order of comp and doc."""
    placed = running_sums(docs, ["grp"], ["comp", "doc"], {"before": "weight"}, "near-ranges", range_docs)
    return placed.select(*(c for c in docs.columns if c != "weight"), F.floor((F.col("before") + F.col("weight")) / BLOCK_SHINGLES).cast("int").alias("block"))


def _exact_rest(members: DataFrame, comps: DataFrame, sets: DataFrame, sizes: DataFrame, similarity: int) -> DataFrame | None:
    """Step 4: links between components that share a table of three or more; tables are given by their first document."""
    own = members.where("n > 2").join(comps, F.col("doc") == F.col("node"), "left").select("key", "doc", F.coalesce("component", "doc").alias("comp"))
    own = through_files(own, "near-members")
    mixed = own.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.min("doc").alias("first"), F.count("*").alias("n")).where("a <> b")
    mixed = through_files(mixed.select("key", "first", "n"), "near-mixed")
    open_ = through_files(spread_join(own, mixed, ["key"], "n").select("doc", "comp", "first").distinct(), "near-open")
    if open_.isEmpty():
        return None
    groups = connected_components(open_.select(F.col("doc").alias("u"), F.col("first").alias("v")), "near-groups")
    docs = open_.select("doc", "comp").distinct().join(groups, F.col("doc") == F.col("node"), "left").select("doc", "comp", F.coalesce("component", "doc").alias("grp"))
    docs = through_files(docs.join(sizes, "doc").withColumn("weight", F.col("n_shingles") + 400), "near-rest")
    docs = through_files(_blocked(docs), "near-blocks")
    # two blocks are compared where a table's documents in them can link and aren't one component
    ends = [F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most")]
    spans = through_files(open_.select("doc", "first").join(docs, "doc").groupBy("first", "grp", "block").agg(*ends), "near-spans")
    other = spans.select("first", F.col("block").alias("b2"), *(F.col(c).alias(f"{c}2") for c in ("lo", "hi", "least", "most")))
    close = 100 * F.least("most", "most2") >= similarity * F.greatest("least", "least2")
    tasks = spans.join(other, "first").where((F.col("block") <= F.col("b2")) & close).where("least(lo, lo2) <> greatest(hi, hi2)")
    tasks = through_files(tasks.select("grp", F.col("block").alias("b1"), "b2").distinct(), "near-tasks")
    ends = F.explode(F.array_distinct(F.array("b1", "b2"))).alias("block")
    tasks = tasks.select("grp", "b1", "b2", ends)
    rows = docs.join(tasks, ["grp", "block"]).join(sets, "doc")

    def kernel(part: pd.DataFrame) -> pd.DataFrame:
        found = block_links(part["doc"].to_numpy(), part["block"].to_numpy(), part["comp"].to_numpy(), list(part["shingles"]), similarity)
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return rows.groupBy("grp", "b1", "b2").applyInPandas(kernel, "u long, v long")


def linked_components(docs: DataFrame, keys: DataFrame, sizes: DataFrame, words: int, similarity: int, known: DataFrame | None = None) -> DataFrame:
    """Steps 3 and 4: ``node, component`` of the documents of ``sizes(doc, n_shingles)`` from tables ``keys(key, doc)`` that hold all pairs which may link, and ``known(u, v)`` links."""
    leaders = keys.groupBy("key").agg(F.min("doc").alias("leader"), F.count("*").alias("n")).where("n > 1")
    leaders = through_files(leaders.join(sizes.select(F.col("doc").alias("leader"), F.col("n_shingles").alias("n_v")), "leader"), "near-leaders")
    members = through_files(spread_join(keys, leaders, ["key"], "n"), "near-tables")

    stars = members.where("doc <> leader").groupBy("doc", "leader").agg(F.min("n").alias("n"), F.min("n_v").alias("n_v"))
    turn = F.row_number().over(Window.partitionBy("doc").orderBy("leader"))
    stars = stars.withColumn("turn", turn).where((F.col("n") == 2) | (F.col("turn") <= LEADERS)).select(F.col("doc").alias("u"), F.col("leader").alias("v"), "n_v")
    near_size = 100 * F.least("n_u", "n_v") >= similarity * F.greatest("n_u", "n_v")
    stars = stars.join(sizes.select(F.col("doc").alias("u"), F.col("n_shingles").alias("n_u")), "u")
    stars = through_files(stars.where(near_size).select("u", "v"), "near-stars")
    wanted = through_files(stars.select(F.col("u").alias("doc")).union(stars.select("v")).union(members.where("n > 2").select("doc")).distinct(), "near-wanted")
    sets = through_files(full_sets(docs, wanted, words).dropDuplicates(["doc"]), "near-sets")
    links = through_files(verify(stars, sets, similarity), "near-links")
    if known is not None:
        links = links.unionByName(known)
    comps = connected_components(links)
    more = _exact_rest(members, comps, sets, sizes, similarity)
    if more is not None:
        joined = comps.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)
        comps = connected_components(joined)
    return comps


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY, entries: int = ENTRIES, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``."""
    rows = through_files(sketches(docs, words, entries, width, seed), "near-sketch")
    some = rows.where("n_shingles > 0 and doc_id is not null")
    prints = ["n_shingles", "print1", "print2"]
    classes = through_files(some.groupBy(*prints).agg(F.min("doc_id").alias("rep")), "near-classes")
    first = some.join(classes.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    reps = first.join(classes, prints).where("doc_id = rep").select(F.col("doc_id").alias("doc"), "n_shingles", "entries")

    each = through_files(reps.select("doc", F.posexplode("entries").alias("at", "entry")), "near-entries")
    shared = each.groupBy("entry").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a <> b").select("entry")
    live = each.join(shared, "entry", "left_semi").withColumn("second", F.col("at") >= entries)
    sides = live.groupBy("doc").agg(F.collect_set(F.when(~F.col("second"), F.col("entry"))).alias("one"), F.collect_set(F.when(F.col("second"), F.col("entry"))).alias("two"))
    keys = sides.select("doc", F.explode("one").alias("one"), "two").select("doc", "one", F.explode("two").alias("two")).select("doc", F.xxhash64("one", "two").alias("key"))
    keys = through_files(keys, "near-keys")
    comps = linked_components(docs, keys, reps.select("doc", "n_shingles"), words, similarity)
    whole = classes.join(comps, F.col("rep") == F.col("node"), "left").select(*prints, F.coalesce("component", "rep").alias("component"))
    linked = some.join(whole, prints).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """The rows of docs that stay (one document of each component), with all their columns."""
    gone = through_files(near_duplicates(docs, words, similarity).where("not kept").select(F.col("doc_id").alias("__gone")).distinct(), "near-gone")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)
