"""Edit-aware token counts: a pre-token segment tree for each document (operator 3).

Leaves hold runs of ``RUN`` pre-tokens with their number of characters and of tokens; the
inner nodes hold sums. An edit descends by characters to the leaves it touches, takes
one leaf of context before it, and splits that region anew until a boundary of the new
split falls on the end of an old leaf: from there on both splits agree, because a split
from a boundary depends only on the text after it. Only the region's pre-tokens are
encoded again, for all documents of a slice together, and sums change along the paths of
the leaves. A region that grows beyond twice ``RUN`` pre-tokens a leaf is cut into new
leaves, so a long insertion leaves no leaf that later edits would encode whole.

``build_trees`` keeps trees as two arrays beside the text, ``apply_edits`` takes them and
an array of edits ``(at, removed, inserted)`` for each document, applied in order to the
text as it then is. Both are one pass without a shuffle. Defined results: null text is
empty with no tokens; null or no edits change nothing; places and lengths outside the
text are clamped to it, null ones are 0, a null insertion is empty; repeated rows each
get a row; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .text import column_or_null, slices, small_batches, table

RUN = 32
#: Characters before an edit that a split there may look at: a special token and one more.
CONTEXT = 16
_TREE = "doc_id long, text string, leaf_chars array<int>, leaf_tokens array<int>"


class SumTree:
    """Sums over leaves in an implicit binary tree."""

    def __init__(self, leaves: np.ndarray):
        self.width = 1 << max(0, len(leaves) - 1).bit_length()
        level = np.zeros(self.width, np.int64)
        level[: len(leaves)] = leaves
        levels = [level]
        while len(level) > 1:
            level = level.reshape(-1, 2).sum(1)
            levels.append(level)
        self.nodes = [0, *np.concatenate(levels[::-1]).tolist()]

    @property
    def total(self) -> int:
        return self.nodes[1]

    def leaf(self, k: int) -> int:
        return self.nodes[self.width + k]

    def put(self, k: int, value: int) -> None:
        k += self.width
        change = value - self.nodes[k]
        while k and change:
            self.nodes[k] += change
            k >>= 1

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds unit number ``place`` (the last non-empty one at the end), and the sum before it."""
        k, before = 1, 0
        place = min(place, self.total - 1)
        while k < self.width:
            k <<= 1
            if place - before >= self.nodes[k]:
                before += self.nodes[k]
                k += 1
        return k - self.width, before


class CountedText:
    """A text with its trees."""

    def __init__(self, codec: bpe.ByteBpe, text: str, chars: np.ndarray, tokens: np.ndarray):
        self.codec, self.reencoded = codec, 0
        self.open: dict[int, list[str]] = {}  # leaves whose pre-tokens aren't encoded yet
        cuts = np.concatenate(([0], np.cumsum(chars))).tolist()
        self.texts = [text[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)] or [""]
        self.chars, self.tokens = SumTree(np.array([len(t) for t in self.texts])), SumTree(tokens)

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def edit(self, at: int, removed: int, inserted: str) -> None:
        size = self.chars.total
        at = min(max(at, 0), size)
        removed = min(max(removed, 0), size - at)
        if not removed and not inserted:
            return
        if not size:
            self._place(0, 0, self.codec.pretokens(inserted))
            return
        first, start = self.chars.find(max(0, at - CONTEXT))
        while first and not start == 0 and at - start < CONTEXT:
            first -= 1
            start -= self.chars.leaf(first)
        last, before = self.chars.find(max(at + removed, 0))
        region = "".join(self.texts[first : last + 1])
        region = region[: at - start] + inserted + region[at - start + removed :]
        while True:
            ahead, k = "", last + 1
            while k < len(self.texts) and len(ahead) < CONTEXT:
                ahead += self.texts[k]
                k += 1
            words, upto, ends = self.codec.pretokens(region + ahead), 0, 0
            for words_in, w in enumerate(words, 1):
                upto += len(w)
                if upto >= len(region):
                    ends = words_in
                    break
            if upto == len(region) or not region:
                self._place(first, last, words[:ends] if region else [])
                return
            region, last = region + self.texts[last + 1], last + 1  # the split runs on: take the next leaf too

    def _place(self, first: int, last: int, words: list[str]) -> None:
        """Leaves first to last get the pre-tokens of their region; ``settle`` encodes them."""
        self.reencoded += len(words)
        if len(words) > 2 * RUN * (last - first + 1):
            self._grow(first, last, words)
            return
        share = -(-len(words) // (last - first + 1)) or 1
        for k in range(first, last + 1):
            self.open[k] = words[(k - first) * share : (k - first + 1) * share]
            self.texts[k] = "".join(self.open[k])
            self.chars.put(k, len(self.texts[k]))

    def _grow(self, first: int, last: int, words: list[str]) -> None:
        """New leaves of ``RUN`` pre-tokens instead of leaves first to last; the trees are built anew, in fewer steps than there are words and leaves."""
        runs = [words[a : a + RUN] for a in range(0, len(words), RUN)]
        more = len(runs) - (last - first + 1)
        tokens = [self.tokens.leaf(k) for k in range(len(self.texts))]
        self.texts[first : last + 1] = map("".join, runs)
        tokens[first : last + 1] = [0] * len(runs)
        self.open = {k + more * (k > last): w for k, w in self.open.items() if not first <= k <= last} | dict(enumerate(runs, first))
        self.chars, self.tokens = SumTree(np.array([len(t) for t in self.texts])), SumTree(np.array(tokens))

    def leaves(self) -> tuple[list[int], list[int]]:
        kept = [k for k, t in enumerate(self.texts) if t]
        return [len(self.texts[k]) for k in kept], [self.tokens.leaf(k) for k in kept]


def settle(codec: bpe.ByteBpe, edited: list[CountedText]) -> None:
    """Encode what edits left open in many texts at once, and update their sums."""
    counts = codec.count_words([w for own in edited for words in own.open.values() for w in words])
    at = 0
    for own in edited:
        for k, words in own.open.items():
            own.tokens.put(k, int(counts[at : at + len(words)].sum()))
            at += len(words)
        own.open = {}


def leaves_of(codec: bpe.ByteBpe, texts: list[str], run: int = RUN) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Characters and tokens of the leaves of each text."""
    words = [codec.pretokens(t) for t in texts]
    counts = codec.count_words([w for ws in words for w in ws])
    at = 0
    for ws in words:
        if not ws:
            yield np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        starts = np.arange(0, len(ws), run)
        sizes = np.fromiter(map(len, ws), np.int64, len(ws))
        yield np.add.reduceat(sizes, starts), np.add.reduceat(counts[at : at + len(ws)], starts)
        at += len(ws)


def build_trees(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, text, leaf_chars, leaf_tokens`` (and ``edits``, if docs has such a column) for every row of ``docs(doc_id, text)``."""
    vocabulary = vocabulary or bpe.default_vocabulary()
    extra = [n for n in ("edits",) if n in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.load(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, z in slices(texts):
                chars, tokens = zip(*leaves_of(codec, texts[a:z]), strict=True)
                kind = pa.list_(pa.int32())
                yield pa.record_batch(
                    [batch.column("doc_id").slice(a, z - a), pa.array(texts[a:z], pa.string()), pa.array(chars, kind), pa.array(tokens, kind), *(batch.column(n).slice(a, z - a) for n in extra)],
                    ["doc_id", "text", "leaf_chars", "leaf_tokens", *extra],
                )

    edits = [F.col("edits").cast("array<struct<at:int,removed:int,inserted:string>>").alias("edits")] if extra else []
    schema = _TREE + (", edits array<struct<at:int,removed:int,inserted:string>>" if extra else "")
    return small_batches(docs.select(column_or_null(docs, "doc_id", "long"), column_or_null(docs, "text", "string"), *edits)).mapInArrow(run, schema)


def apply_edits(trees: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Trees after their edits, with ``n_before``, ``n_tokens``, ``n_edits`` and ``n_reencoded`` (pre-tokens encoded for the edits)."""
    vocabulary = vocabulary or bpe.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.load(vocabulary)
        kind = pa.list_(pa.int32())
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, z in slices(texts):
                part = batch.slice(a, z - a)
                edits = [e or [] for e in part.column("edits").to_pylist()]
                trees_of = [CountedText(codec, texts[a + k], part.column("leaf_chars")[k].values.to_numpy(), part.column("leaf_tokens")[k].values.to_numpy()) for k in range(z - a)]
                before = [own.tokens.total for own in trees_of]
                for own, changes in zip(trees_of, edits, strict=True):
                    for e in changes:
                        own.edit(e["at"] or 0, e["removed"] or 0, e["inserted"] or "")
                settle(codec, trees_of)
                rows = [(own.text, *own.leaves(), n, own.tokens.total, len(e), own.reencoded) for own, n, e in zip(trees_of, before, edits, strict=True)]
                kinds = [pa.string(), kind, kind, *[pa.int64()] * 4]
                names = ["text", "leaf_chars", "leaf_tokens", "n_before", "n_tokens", "n_edits", "n_reencoded"]
                yield pa.record_batch([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", *names])

    return small_batches(trees.select("doc_id", "text", "leaf_chars", "leaf_tokens", "edits")).mapInArrow(run, _TREE + ", n_before long, n_tokens long, n_edits long, n_reencoded long")


def with_edits(docs: DataFrame) -> DataFrame:
    """docs with three fixed edits each: a cut in the first quarter, an insertion in the middle, a replacement in the last quarter."""
    size = F.length(F.coalesce("text", F.lit("")))

    def edit(at, removed: int, inserted: str):
        return F.struct(at.cast("int").alias("at"), F.lit(removed).alias("removed"), F.lit(inserted).alias("inserted"))

    return docs.withColumn("edits", F.array(edit(F.floor(size / 4), 5, ""), edit(F.floor(size / 2), 0, " newly added text"), edit(F.floor(size * 3 / 4), 3, ".\nNext")))


def query(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after three edits each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = apply_edits(build_trees(with_edits(docs)))
    return done.select("doc_id", F.col("n_before"), "n_edits", F.length("text").cast("long").alias("n_chars_after"), F.col("n_tokens").alias("n_after"), "n_reencoded")
