"""Token-ID output: one compressed wavelet matrix per shard (operator 8).

``write`` deals documents into ranges of ascending doc_id, encodes each text, appends
the end id and cuts a shard whenever about ``SHARD_TOKENS`` ids are gathered (a shard
always holds whole documents). Each shard is one binary file value of format
``wavelet``, with its doc_ids and document starts, and is written through Spark's
committer into the shared folder, so a lost executor only repeats its tasks. ``read``
returns what the files hold; the running ``start`` sums the ids of earlier shards.

Ids are those that the tokenizers library gives for ``byte_bpe_50k.json``; they are made
with tiktoken from the ranks file of the same vocabulary, as the library itself takes
549 CPU seconds a GB for the ids alone, of a budget of 400, against 128.
A text with a run of white space too long for tiktoken's pattern matcher (it gives up at
about a million characters) is encoded by the merge rounds of ``bpe`` instead.

Defined results: null text is empty (its document holds the end id alone); null doc_id
sorts first; rows with equal doc_id are ordered by a hash of the text, then by text;
repeated rows each get a row; an empty table gives no shards and no rows; further
columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .text import running_sums, scratch, slices, small_batches, table
from .wavelet import WaveletMatrix, build

END_ID = 2
#: A shard's arrays then stay in a core's cache.
SHARD_TOKENS = 1 << 18
#: Rows of a write task, about; ranges grow in number with the table.
RANGE_ROWS = 4_000
#: White space that the pattern matcher might not get over.
LONG_GAP = 100_000
_GAP = re.compile(rf"\s{{{LONG_GAP}}}")
#: Starts of shards are broadcast up to this many (2 MB); beyond it the join shuffles.
BROADCAST_SHARDS = 100_000
_SCHEMA = "part int, shard int, tokens long, blob binary"


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    """The vocabulary of a ranks file; its end-of-text token has the first free id."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("shards", pat_str=bpe.SPLIT, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def encode(text: str, codec: tiktoken.Encoding, vocabulary: str) -> np.ndarray:
    """Ids of a whole text by ``codec``, or by the merge rounds of ``vocabulary``, which has the same ids, if it holds a long gap."""
    if len(text) >= LONG_GAP and _GAP.search(text):
        return bpe.load(vocabulary).encode_batch([text])[0]
    return codec.encode_to_numpy(text, allowed_special="all")


def write(docs: DataFrame, path: str, ranks: str | None = None, vocabulary: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write shards of ``docs(doc_id, text)`` below path; ``ranks`` and ``vocabulary`` are two files of one vocabulary."""
    ranks, vocabulary = ranks or default_ranks(), vocabulary or bpe.default_vocabulary()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = max(1, -(-docs.count() // RANGE_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part = encoding(ranks), TaskContext.get().partitionId()
        planes = codec.max_token_value.bit_length()
        dtype = np.uint16 if planes <= 16 else np.uint32
        shard = held = 0
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal shard, held, doc_ids, ids
            starts = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
            blob = build(np.concatenate(ids), starts, planes, doc_ids)
            row = [[part], [shard], [held], [blob]]
            shard, held, doc_ids, ids = shard + 1, 0, [], []
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            return pa.record_batch([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["part", "shard", "tokens", "blob"])

        for batch in batches:
            keys, values = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, z in slices(values):
                for key, text in zip(keys[a:z], values[a:z], strict=True):
                    found = encode(text, codec, vocabulary)
                    one = np.full(len(found) + 1, end_id, dtype)
                    one[:-1] = found
                    doc_ids.append(key)
                    ids.append(one)
                    held += len(one)
                    if held >= shard_tokens:
                        yield flush()
        if ids:
            yield flush()

    # rows that share a doc_id or a text spread too: their place in the scan is the last part of the order
    order = ["doc_id", "hash", "at"]
    texts = texts.withColumns({"hash": F.xxhash64("text"), "at": F.monotonically_increasing_id()})
    ordered = texts.repartitionByRange(ranges, *order).sortWithinPartitions("doc_id", "hash", "text", "at").select("doc_id", "text")
    small_batches(ordered).mapInArrow(run, _SCHEMA).write.option("compression", "uncompressed").parquet(path)  # the blobs are compressed


def read(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, blob in zip(batch.column("start").to_pylist(), batch.column("blob"), strict=True):
                shard = WaveletMatrix(blob.as_py())
                raw = memoryview(shard.decode().astype("<u4").tobytes())
                cuts = (4 * shard.starts).tolist()
                crcs = [zlib.crc32(raw[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
                columns = [pa.array(shard.doc_ids, pa.int64()), pa.array(start + shard.starts[:-1]), pa.array(np.diff(shard.starts)), pa.array(crcs, pa.int64())]
                yield pa.record_batch(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = spark.read.schema(_SCHEMA).parquet(path)
    starts = running_sums(shards.select("part", "shard", "tokens"), [], ["part", "shard"], {"start": "tokens"}, "token-starts").select("part", "shard", "start")
    if starts.count() <= BROADCAST_SHARDS:
        starts = F.broadcast(starts)
    placed = shards.select("part", "shard", "blob").join(starts, ["part", "shard"]).select("start", "blob")
    return small_batches(placed).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path)
