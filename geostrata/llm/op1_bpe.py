"""BPE encoding and decoding of whole texts (operator 1).

Documents are independent, so this is one pass over the scan without a shuffle. A
Python worker merges all pre-tokens that its bounded cache lacks in batched numpy
rounds (``bpe.ByteBpe.merge_words``); memory is bounded by slices of a few million
characters. Defined results: a null text counts as empty, an empty text has no ids,
repeated rows each get a row, a null doc_id stays null, further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .text import slices, small_batches, table


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids array<int>`` for every row of ``docs(doc_id, text)``."""
    vocabulary = vocabulary or bpe.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.load(vocabulary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, z in slices(texts):
                ids = codec.encode_batch(texts[a:z])
                values = np.concatenate(ids).astype(np.int32)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                yield pa.record_batch([batch.column("doc_id").slice(a, z - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["doc_id", "ids"])

    return small_batches(_texts(docs)).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, text`` from ``tokens(doc_id, ids)``; bytes that are no UTF-8 become U+FFFD, null ids give an empty text."""
    vocabulary = vocabulary or bpe.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.load(vocabulary)
        for batch in batches:
            texts = [codec.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return small_batches(tokens.select("doc_id", "ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Encode, decode what was encoded, and digest both in the same task, so that neither ids nor texts move.

    Returns ``doc_id, n_tokens, ids_sha256, decoded_sha256``.
    """
    vocabulary = vocabulary or bpe.default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = bpe.load(vocabulary)
        decimal = codec.decimal.__getitem__
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, z in slices(texts):
                counts, shas, backs = [], [], []
                for ids in codec.encode_batch(texts[a:z]):
                    counts.append(len(ids))
                    shas.append(hashlib.sha256(b",".join(map(decimal, ids.tolist()))).hexdigest())
                    backs.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
                yield pa.record_batch([batch.column("doc_id").slice(a, z - a), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(backs, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return small_batches(_texts(docs)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
