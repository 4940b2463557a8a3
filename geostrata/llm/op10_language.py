"""Language identification by error-correcting output codes (operator 10).

Every language has a codeword of +1 and -1; for each of its places a linear classifier
over hashed letter n-grams (1 to 3) is trained to predict it, and the codeword of least
weighted loss wins. Documents are counted whole, in slices of bounded size, in one pass
over the scan without a shuffle.

Training is bounded: of the labelled rows whose crc32 of doc_id is not 2 modulo 4, about
``PER_LANGUAGE`` for each language (``MAX_SAMPLE`` together) are drawn by a hash of
doc_id and text, copies once, in the order of that hash; only their n-gram counts reach
the driver. With more than ``MAX_SAMPLE`` languages the most frequent are learned.
Predictions never see lang, source or doc_id.

Defined results: a null text, or one without a letter, is ``und`` with score 0; a null
doc_id counts as held out; with one learned language all texts get it with score 1, with
none all are ``und``; an empty table gives no rows; further columns are ignored. As a
filter (``keep_known``) what has no letter, another language than those asked for, or letters
enough and yet no clear language is rejected; without any label to learn from, documents
with letters stay.
"""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import column_or_null, slices, small_batches, table

PER_LANGUAGE = 400
MAX_SAMPLE = 4_000
FEATURES = 4_096
ORDERS = (1, 2, 3)
#: A lead of the best language over the next below this is marked ambiguous.
LEAD = 0.1
#: A text with so many letters that is still ambiguous has no known language.
SURE_LETTERS = 40
SEED = 11
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    for c in range(0x110000):
        table[c] = unicodedata.category(chr(c))[0] == "L"
    return table


def ngram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of hashed n-gram counts, each row of length 1, and whether a text has letters."""
    raw = [t.lower().encode("utf-32-le", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(r) // 4 for r in raw), np.int64, len(raw))
    points = np.frombuffer(b"".join(raw), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    letter = _letters()[points]
    code = np.where(letter, points, 0)
    counts = np.zeros(len(texts) * FEATURES)
    for n in ORDERS:
        size = len(code) - n + 1
        if size <= 0:
            continue
        hashed, some = np.zeros(size, np.uint64), np.zeros(size, bool)
        for k in range(n):
            hashed = hashed * np.uint64(0x9E3779B97F4A7C15) + code[k : k + size].astype(np.uint64) + np.uint64(n)
            some |= letter[k : k + size]
        slot = ((hashed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.int64) % FEATURES
        fits = some & (owner[:size] == owner[n - 1 :])
        counts += np.bincount(owner[:size][fits] * FEATURES + slot[fits], minlength=len(counts))
    rows = np.sqrt(counts.reshape(len(texts), FEATURES))
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.maximum(norm, 1e-12), norm[:, 0] > 0


def codewords(classes: int, seed: int = SEED) -> np.ndarray:
    """One row of +1 and -1 for each class: all distinct splits up to five classes, else the best of seeded draws by least distance."""
    if classes <= 1:
        return np.zeros((classes, 0))
    if classes <= 5:
        rest = itertools.product((-1, 1), repeat=classes - 1)
        return np.array([(1, *r) for r in rest if -1 in r], float).T
    rng, length, best, apart = np.random.default_rng(seed), 10 * int(np.ceil(np.log2(classes))), None, -1.0
    for _ in range(100):
        code = rng.choice((-1.0, 1.0), (classes, length))
        distance = (length - code @ code.T) / 2 + length * np.eye(classes)
        if distance.min() > apart and (np.abs(code.sum(0)) < classes).all():
            best, apart = code, distance.min()
    return best if best is not None else rng.choice((-1.0, 1.0), (classes, length))


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best language, its score, and its lead over the next."""
        if len(self.languages) == 1:
            return np.zeros(len(rows), int), np.ones(len(rows)), np.ones(len(rows))
        margins = rows @ self.weights + self.bias
        loss = np.zeros((len(rows), len(self.languages)))
        for k, word in enumerate(self.code):
            loss[:, k] = np.logaddexp(0, -margins * word) @ self.trust
        odds = np.exp(loss.min(1, keepdims=True) - loss)
        share = odds / odds.sum(1, keepdims=True)
        order = np.sort(share, axis=1)
        return share.argmax(1), order[:, -1], order[:, -1] - order[:, -2]


def fit(rows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = 150, rate: float = 40.0, decay: float = 1e-5) -> Model:
    """Logistic classifiers for all code places together, by gradient steps with momentum."""
    code = codewords(len(languages))
    sign = code[labels]
    share = np.bincount(labels, minlength=len(languages))[labels]
    weight = (1 / share / len(languages))[:, None]
    w, b = np.zeros((rows.shape[1], code.shape[1])), np.zeros(code.shape[1])
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        pull = -sign * weight / (1 + np.exp(np.clip(sign * (rows @ w + b), -50, 50)))
        vw, vb = 0.9 * vw - 0.1 * rate * (rows.T @ pull + decay * w), 0.9 * vb - 0.1 * rate * pull.sum(0) / 10
        w, b = w + vw, b + vb
    right = ((rows @ w + b) * sign > 0).astype(float)
    trust = (weight * right).sum(0)
    return Model(languages, code, w, b, trust)


def _prepared(docs: DataFrame) -> DataFrame:
    doc_id = column_or_null(docs, "doc_id", "long")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    return docs.select(doc_id, column_or_null(docs, "text", "string"), column_or_null(docs, "lang", "string")).withColumn("held_out", F.coalesce(rest == 2, F.lit(True)))


def train(docs: DataFrame) -> Model | None:
    """A model from the sample that the module names, or None without labelled rows."""
    known = _prepared(docs).where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_SAMPLE).collect()}
    if not counts:
        return None
    wanted = min(PER_LANGUAGE, max(1, MAX_SAMPLE // len(counts)))
    rates = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, wanted / n))))
    draw = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(SEED)), 1)
    drawn = known.withColumn("draw", draw).where(F.col("draw") / float(1 << 63) < rates[F.col("lang")]).dropDuplicates(["lang", "draw"]).select("text", "lang", "draw")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, z in _parts(texts):
                rows, has = ngram_counts(texts[a:z])
                packed = [r.astype(np.float16).tobytes() if ok else None for r, ok in zip(rows, has, strict=True)]
                yield pa.record_batch([batch.column("lang").slice(a, z - a), batch.column("draw").slice(a, z - a), pa.array(packed, pa.binary())], ["lang", "draw", "row"])

    got = small_batches(drawn).mapInArrow(features, "lang string, draw long, row binary").where("row is not null").orderBy("draw", "lang").limit(2 * MAX_SAMPLE).toPandas()
    if got.empty:
        return None
    languages = sorted(set(got["lang"]))
    rows = np.frombuffer(b"".join(got["row"]), np.float16).reshape(len(got), FEATURES).astype(np.float64)
    return fit(rows, np.array([languages.index(x) for x in got["lang"]]), languages)


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    for a, z in slices(texts, 400_000):
        for k in range(a, z, 200):
            yield k, min(z, k + 200)


def classify(texts: list[str | None], model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and lead of whole texts; ``und``, 0 and 0 where there is no letter or no model."""
    names, score, lead = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    texts = [t or "" for t in texts]
    for a, z in _parts(texts) if model else ():
        rows, has = ngram_counts(texts[a:z])
        best, odds, first = model.predict(rows)
        names[a:z] = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, has, strict=True)]
        score[a:z], lead[a:z] = np.where(has, np.clip(odds, 0, 1), 0), np.where(has, first, 0)
    return names, score, lead


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` for every row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, lead = classify(batch.column("text").to_pylist(), model)
            held = [batch.column("doc_id"), batch.column("held_out")]
            yield pa.record_batch([*held, pa.array(names, pa.string()), pa.array(score), pa.array(lead < LEAD)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = _prepared(docs).select("doc_id", "held_out", "text")
    return small_batches(rows).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def keep_known(docs: DataFrame, languages: tuple[str, ...] | None = None, sure_letters: int = SURE_LETTERS) -> DataFrame:
    """The rows of docs whose language is known, with all their columns; where lang is null it becomes the prediction.

    A text without a letter goes, one whose prediction isn't in ``languages`` (None: all that are learned), and one of at
    least ``sure_letters`` letters that is still ambiguous: shorter texts can't be told apart so well and stay. What a
    language is called doesn't matter. Without any label to learn from all texts with letters stay.
    """
    model = train(docs)
    if model is None:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))

    @F.pandas_udf("kept boolean, lang string")
    def decided(texts: pd.Series) -> pd.DataFrame:
        held = [t if isinstance(t, str) else "" for t in texts]
        names, score, lead = classify(held, model)
        letters = score > 0
        if languages is not None:
            letters &= np.isin(np.array(names, object), languages)
        for k in np.flatnonzero(letters & (lead < LEAD)):
            letters[k] = sum(map(str.isalpha, held[k])) < sure_letters
        return pd.DataFrame({"kept": letters, "lang": names}, index=texts.index)

    # not deterministic for the planner: else the filter and the column would each classify
    found = small_batches(docs).withColumn("__language", decided.asNondeterministic()(F.col("text").cast("string"))).where("__language.kept")
    if "lang" in docs.columns:
        found = found.withColumn("lang", F.coalesce("lang", F.col("__language.lang").cast(dict(docs.dtypes)["lang"])))
    return found.drop("__language")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs))
