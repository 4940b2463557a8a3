"""From raw documents to token counts: five stages, each over all that its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet to the shared folder and read again as the next one's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geostrata.llm import op1_bpe, op2_exact_dedup, op5_near_dedup, op6_mixing, op10_language
from geostrata.llm.text import scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, which fills a null lang; without letters, or with forty of them and still ambiguous, they go. Without any label to learn from documents with letters stay."""
    return op10_language.keep_known(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal up to blanks: the longest, then the smallest doc_id; of repeated rows one; empty texts are a group."""
    return op2_exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (five words, 0.8); rows without doc_id or words stay, rows that share a doc_id share its fate."""
    return op5_near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, repeated until each source's words come near its target; null source is a source, documents without words go."""
    return op6_mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, one row for each row; null text counts as empty."""
    return op1_bpe.round_trip(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

ORACLE_SQL = None  # language ID, near dedup and BPE have no form in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: one for each row of the mixed corpus."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
