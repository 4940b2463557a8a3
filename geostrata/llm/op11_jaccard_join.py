"""Exact n-gram Jaccard join by a size-aware heavy-light plan (operator 11).

Sets below a boundary are small: their subsets of the size that a link needs are enumerated,
and sets that share one are linked without a comparison. Other sets are large: inverted
lists of the shingles in their prefixes are scanned. The boundary has the least cost by the
histogram of sizes.

1. One pass over the texts gives each document's set size and a 128-bit fingerprint; equal
   sets form a class of which the smallest doc_id goes on. The pass also notes shingles that
   many documents of a slice have: they end every prefix and no list is made of them until
   a document has nothing else.
2. Small sets: for each pair of sizes (s, t), s <= t < boundary, the subsets of the least
   overlap of a link are keys; what shares a key is linked, so a key gives a star.
3. Large sets, and small ones that reach them: shingles are dealt by ranges, packed by range
   and slice. A range counts documents for each shingle, drops what only one has, and
   deals the rest by document. A document whose own shingles fill its prefix is done;
   the rarest others of its prefix are its lists. Two linked sets share a list.
4. Lists are compared as in operator 5, steps 3 and 4: with leaders, then exactly in blocks
   where several components are left. Links span components; pairs aren't expanded.

The result is exact; no list, candidate or link is cut. Shingles are told apart by 64-bit
hashes, lists by their range and 32 bits more, which only adds candidates.

Defined results: null or blank text has an empty set, component_id is its own doc_id; fewer
words than a shingle give one shingle of all; repeated rows each get a row; a row with null
doc_id is linked with nothing; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .op5_near_dedup import SIMILARITY, WORDS, _docs, linked_components, shingle_sets, texts_of
from .text import ragged, slices, small_batches, spread_join, table, through_files

#: Sets of more shingles are never enumerated.
ENUM_MOST = 16
#: What scanning a shingle costs beside a subset's key.
SCAN_COST = 2
#: Shingles of a range, about.
RANGE_SHINGLES = 1_000_000
#: A shingle is common where one in so many documents of a slice has it, and COMMON_LEAST at least, in one of COMMON_SLICES slices.
COMMON_SHARE, COMMON_LEAST, COMMON_SLICES = 16, 8, 8


def needed(s: int, t: int, similarity: int) -> int:
    """Least overlap of linked sets of s and t shingles."""
    return -(-similarity * (s + t) // (100 + similarity))


def size_pairs(t: int, below: int, similarity: int) -> list[tuple[int, int, int]]:
    """(smaller, larger, overlap) of all pairs of sizes below a boundary that may link and have t in them."""
    sizes = ((min(t, o), max(t, o)) for o in range(1, below) if 100 * min(t, o) >= similarity * max(t, o))
    return [(s, r, needed(s, r, similarity)) for s, r in sizes if needed(s, r, similarity) <= s]


def boundary(counts: dict[int, int], similarity: int = SIMILARITY) -> int:
    """The size from which sets are large, between 1 and ``ENUM_MOST + 1``, of least cost for ``counts`` of sets by size up to ``ENUM_MOST``."""

    def cost(x: int) -> int:
        keys = sum(n * sum(comb(t, c) for _, _, c in size_pairs(t, x, similarity)) for t, n in counts.items() if t < x)
        return keys + sum(n * t * SCAN_COST for t, n in counts.items() if 100 * t >= similarity * x)

    return min(range(1, ENUM_MOST + 2), key=cost)


def measured(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n_shingles, print1, print2, small array<long>`` (the set, up to ``ENUM_MOST``), ``common array<long>`` (of a slice, in its first row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, z in slices([t or "" for t in texts]):
                shingles, offsets = shingle_sets(texts[a:z], words)
                sizes = np.diff(offsets)
                prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(shingles[i:j].tobytes()) for i, j in itertools.pairwise(offsets)), np.int64).reshape(-1, 2)
                values, held = np.unique(shingles, return_counts=True)
                common = values[held >= max(COMMON_LEAST, -(-(z - a) // COMMON_SHARE))].view(np.int64)
                small = [shingles[i:j].view(np.int64) if j - i <= ENUM_MOST else None for i, j in itertools.pairwise(offsets)]
                lists = [pa.array(small, pa.list_(pa.int64())), pa.array([common] + [None] * (z - a - 1), pa.list_(pa.int64()))]
                yield pa.record_batch([batch.column("doc_id").slice(a, z - a), pa.array(sizes), pa.array(prints[:, 0]), pa.array(prints[:, 1]), *lists], ["doc_id", "n_shingles", "print1", "print2", "small", "common"])

    return small_batches(_docs(docs)).mapInArrow(run, "doc_id long, n_shingles long, print1 long, print2 long, small array<long>, common array<long>")


def common_shingles(rows: DataFrame) -> np.ndarray:
    """Shingles that are common in one of ``COMMON_SLICES`` slices at least, sorted. A slice has a million characters, so there are fewer than 500,000 of them."""
    slices_ = rows.where("common is not null").count()
    often = rows.select(F.explode("common").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")).where(F.col("n") * COMMON_SLICES >= slices_).where("n > 1")
    return np.sort(np.array([r["shingle"] for r in often.select("shingle").collect()], np.int64).view(np.uint64))


def small_links(sets: DataFrame, below: int, similarity: int) -> DataFrame:
    """``u, v`` links that span what the sets(doc, small) of fewer than ``below`` shingles connect."""
    plan = {t: [(s, r, c) for s, r, c in size_pairs(t, below, similarity)] for t in range(1, below)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, docs, sides = [], [], []
            for doc, own in zip(batch.column("doc").to_pylist(), batch.column("small").to_pylist(), strict=True):
                items = [v.to_bytes(8, "little", signed=True) for v in own]
                for s, r, c in plan[len(own)]:
                    head = bytes((s, r))
                    found = [xxhash.xxh3_128_digest(head + b"".join(x)) for x in itertools.combinations(items, c)]
                    keys += found
                    docs += [doc] * len(found)
                    sides += [0 if s == r else 1 if len(own) == s else 2] * len(found)
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(docs, pa.int64()), pa.array(sides, pa.int32())], ["key", "doc", "side"])

    keys = through_files(small_batches(sets).mapInArrow(run, "key binary, doc long, side int"), "join-subsets")
    stars = keys.groupBy("key").agg(F.min("doc").alias("v"), F.count("*").alias("n"), F.min("side").alias("low"), F.max("side").alias("high"))
    stars = through_files(stars.where("n > 1 and (low = 0 or low < high)").select("key", "v", "n"), "join-stars")
    return spread_join(keys, stars, ["key"], "n").where("doc <> v").select(F.col("doc").alias("u"), "v").distinct()


def prefix_length(n: np.ndarray, similarity: int) -> np.ndarray:
    """How many shingles of a set of n one has to look at to meet every set that it links with."""
    return n + 1 - -(-similarity * n // 100)


def _packed(group: np.ndarray, columns: list[tuple[np.ndarray, str]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """One row for each value of group, with the entries of every column as bytes."""
    if not len(group):
        return
    order = np.argsort(group, kind="stable")
    group = group[order]
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    ends = np.append(starts[1:], len(group))
    packed = [pa.array([values[i:j].tobytes() for i, j in zip(starts, ends, strict=True)], pa.binary()) for values in (v[order].astype(kind) for v, kind in columns)]
    yield pa.record_batch([pa.array(group[starts], pa.int64()), *packed], names)


def _flat(part: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(part.column(name).to_pylist()), kind)


def prefix_lists(texts: DataFrame, words: int, similarity: int, common: np.ndarray, ranges: int) -> DataFrame:
    """``key, doc``: the lists in which the prefixes of texts(doc_id, text) stand."""
    bits = max(0, (ranges - 1).bit_length())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, ids = batch.column("text").to_pylist(), batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, z in slices([t or "" for t in held]):
                shingles, offsets = shingle_sets(held[a:z], words)
                sizes = np.diff(offsets)
                owner = np.repeat(np.arange(z - a), sizes)
                at = np.searchsorted(common, shingles)
                often = common[np.minimum(at, len(common) - 1)] == shingles if len(common) else np.zeros(len(shingles), bool)
                light = np.bincount(owner[~often], minlength=z - a)
                own = owner[~often]
                place = shingles[~often] >> np.uint64(64 - bits) if bits else np.zeros(len(own), np.uint64)
                columns = [(ids[a:z][own], "i8"), (prefix_length(sizes, similarity)[own], "i4"), (light[own], "i4"), (shingles[~often].astype(np.uint32), "u4")]
                yield from _packed(place.astype(np.int64), columns, ["range", "docs", "prefix", "light", "tokens"])
                # shingles of a text are sorted, so its first common ones fill what is left of its prefix
                rest, number = owner[often], shingles[often]
                first = ragged(np.bincount(rest, minlength=z - a))[:-1]
                taken = np.arange(len(rest)) - first[rest] < (prefix_length(sizes, similarity) - light)[rest]
                columns = [(ids[a:z][rest[taken]], "i8"), (np.zeros(0), "i4"), (np.zeros(0), "i4"), (number[taken], "u8")]
                if taken.any():
                    yield pa.record_batch([pa.array([-1], pa.int64()), *(pa.array([v.astype(k).tobytes()], pa.binary()) for v, k in columns)], ["range", "docs", "prefix", "light", "tokens"])

    def shared(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        docs, prefix, light, tokens = (_flat(part, n, k) for n, k in (("docs", "i8"), ("prefix", "i4"), ("light", "i4"), ("tokens", "u4")))
        _, inverse, counts = np.unique(tokens, return_inverse=True, return_counts=True)
        keep = np.flatnonzero(counts[inverse] > 1)
        df = counts[inverse[keep]]
        number = tokens[keep].astype(np.uint64) | np.uint64(key[0].as_py()) << np.uint64(32)
        mixed = docs[keep].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        group = (mixed >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keep), np.int64)
        names = ["part", "docs", "prefix", "light", "tokens", "df"]
        rows = list(_packed(group, [(docs[keep], "i8"), (prefix[keep], "i4"), (light[keep], "i4"), (number, "u8"), (df, "u4")], names))
        return pa.Table.from_batches(rows) if rows else pa.table({"part": pa.array([], pa.int64())} | {n: pa.array([], pa.binary()) for n in names[1:]})

    def chosen(part: pa.Table) -> pa.Table:
        docs, prefix, light, tokens, df = (_flat(part, n, k) for n, k in (("docs", "i8"), ("prefix", "i4"), ("light", "i4"), ("tokens", "u8"), ("df", "u4")))
        order = np.lexsort((tokens, df, docs))
        docs, prefix, light, tokens = docs[order], prefix[order], light[order], tokens[order]
        starts = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1]))) if len(docs) else np.zeros(0, np.int64)
        held = np.diff(np.append(starts, len(docs)))
        rank = np.arange(len(docs)) - np.repeat(starts, held)
        own = light - np.repeat(held, held)  # shingles that no other document has come first
        take = rank < prefix - own
        return pa.table({"key": pa.array(tokens[take].view(np.int64)), "doc": pa.array(docs[take])})

    dealt = through_files(small_batches(texts).mapInArrow(deal, "range long, docs binary, prefix binary, light binary, tokens binary"), "join-ranges")
    counted = dealt.where("range >= 0").groupBy("range").applyInArrow(shared, "part long, docs binary, prefix binary, light binary, tokens binary, df binary")
    lists = counted.groupBy("part").applyInArrow(chosen, "key long, doc long")

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, tokens = (np.frombuffer(b"".join(batch.column(n).to_pylist()), k) for n, k in (("docs", "i8"), ("tokens", "u8")))
            yield pa.record_batch([pa.array((tokens ^ np.uint64(1 << 63)).view(np.int64)), pa.array(docs)], ["key", "doc"])

    often = small_batches(dealt.where("range < 0").select("docs", "tokens")).mapInArrow(unpacked, "key long, doc long")
    return lists.unionByName(often).distinct()


def jaccard_join(docs: DataFrame, words: int = WORDS, similarity: int = SIMILARITY) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``."""
    rows = through_files(measured(docs, words), "join-sets")
    some = rows.where("n_shingles > 0 and doc_id is not null")
    prints = ["n_shingles", "print1", "print2"]
    classes = through_files(some.groupBy(*prints).agg(F.min("doc_id").alias("rep"), F.min("small").alias("small")), "join-classes")
    reps = classes.select(F.col("rep").alias("doc"), "n_shingles", "small")
    counts = {r["n_shingles"]: r["count"] for r in reps.where(F.col("n_shingles") <= ENUM_MOST).groupBy("n_shingles").count().collect()}
    below = boundary(counts, similarity)
    known = small_links(reps.where(F.col("n_shingles") < below).select("doc", "small"), below, similarity)
    large = through_files(reps.where(100 * F.col("n_shingles") >= similarity * below).select("doc", "n_shingles"), "join-large")
    shingles = large.agg(F.sum("n_shingles")).first()[0] or 0
    keys = prefix_lists(texts_of(docs, large.select("doc")), words, similarity, common_shingles(rows), -(-shingles // RANGE_SHINGLES) or 1)
    keys = through_files(keys, "join-lists")
    comps = linked_components(docs, keys, reps.select("doc", "n_shingles"), words, similarity, known)
    whole = classes.join(comps, F.col("rep") == F.col("node"), "left").select(*prints, F.coalesce("component", "rep").alias("component_id"))
    linked = some.join(whole, prints).select("doc_id", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def query(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
