"""Approximate nearest neighbours by inner product: adaptive dimension scan (operator 7).

Index: the number of lists grows with the square root of the rows, so the pairs that all
queries together scan grow with its cube, not with the fourth power. Centres are fitted
on a sample of ``PER_CENTRE`` vectors for each (``SAMPLE`` at least); beyond
``FLAT_CENTRES`` they are fitted in two levels. Every vector goes to its nearest centre's
list, is rotated by one random orthogonal matrix and cut into column blocks. Lists are
dealt into chunks of about ``CHUNK`` vectors by a hash of vec_id, so that a list (or a
vector that a third of all rows share) spreads over many tasks.

Search: a query probes the lists whose centres promise most; how many is measured: a few
trial queries are answered by brute force in one pass over the vectors, and the fewest
lists are taken that give them ``RECALL`` of their true neighbours. The ``FIRST`` lists of
each query are scanned first; from the others only what beats the k-th best there comes
back, so the answers gathered don't grow with the lists probed. A query that has fewer
than k answers then (its lists may be tiny) scans all its other lists. Within a chunk
all its queries are scanned together, block by block. To beat a query's k-th best so far
a candidate's squared distance has to stay below a bound; after d of D rotated dimensions
about d / D of that distance is seen, so a candidate that has more than
(1 + ``SIGMAS`` / sqrt(d)) squared times the bound's share (or more than all of it) is
abandoned. Survivors are scored on the original vectors in double precision.

Defined results: vectors that are null, zero, of other than the usual length, or hold
null or non-finite components take no part; rows with a null vec_id neither; equal
scores go to the smaller vec_id; a repeated vec_id counts once for each row, but never
answers itself; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import table, through_files

K = 20
QUERY_STEP = 20
#: Vectors that the centres are fitted on: so many at least, and for each centre.
SAMPLE = 20_000
PER_CENTRE = 32
#: Centres fitted in one level, at most.
FLAT_CENTRES = 1_024
#: Lists scanned first; the k-th best score there is where the scan of a query's other lists starts.
FIRST = 4
#: Lists for each square root of the number of vectors.
LISTS_PER_ROOT = 0.55
#: Lists probed are the fewest with which ``TRIALS`` trial queries find this share of their true neighbours.
RECALL = 0.97
TRIALS = 64
CHUNK = 1_024
#: Queries that meet a chunk in one task; they are scanned ``QUERY_CHUNK`` at a time.
QUERY_TURN = 2_048
QUERY_CHUNK = 256
#: Tasks whose best rows for trial queries are merged at once.
MERGE = 64
BLOCK = 16
SIGMAS = 2.5
SEED = 3


def valid(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding array<double>`` of the vectors that take part."""
    cast = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = cast.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad & F.exists("embedding", lambda x: x != 0))
    usual = some.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return some.where(F.size("embedding") == (usual["n"] if usual else 0))


def fit_centres(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    """k-means by Lloyd's rounds; empty lists take random vectors of the sample."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(sample, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        lost = counts == 0
        centres = np.where(lost[:, None], sample[rng.integers(0, len(sample), len(centres))], sums / np.maximum(counts, 1)[:, None])
    return centres


def fit_levels(sample: np.ndarray, lists: int, seed: int = SEED) -> np.ndarray:
    """Centres of all lists: at most ``FLAT_CENTRES`` at once, else groups first and then each group's share of centres."""
    if lists <= FLAT_CENTRES:
        return fit_centres(sample, lists, seed=seed)
    groups = fit_centres(sample, int(np.ceil(np.sqrt(lists))), seed=seed)
    home = nearest(sample, groups)
    parts = [sample[home == g] for g in range(len(groups))]
    return np.concatenate([fit_centres(part, max(1, round(lists * len(part) / len(sample))), seed=seed) for part in parts if len(part)])


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([(rows[a : a + 4096] @ centres.T - half).argmax(1) for a in range(0, len(rows), 4096)]) if len(rows) else np.zeros(0, int)


def rotation(dimensions: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def scan_chunk(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, turn: np.ndarray, k: int, bars: np.ndarray | None = None, block: int = BLOCK, sigmas: float = SIGMAS):
    """Up to k best rows of the chunk for each query, none below its bar: ``query position, row position, score``."""
    turned_q, turned = queries @ turn, rows @ turn
    dims = rows.shape[1]
    # the first rows scanned give each query its k-th best so far
    part_q, part_x = np.cumsum(turned_q**2, 1), np.cumsum(turned**2, 1)  # squared lengths of the first dimensions
    first = min(len(rows), max(4 * k, 64))
    seed_scores = queries @ rows[:first].T
    seed_scores[query_ids[:, None] == ids[None, :first]] = -np.inf
    bar = np.partition(seed_scores, first - k, axis=1)[:, first - k] if first > k else np.full(len(queries), -np.inf)
    if bars is not None:
        bar = np.maximum(bar, bars)
    q_at, x_at = np.divmod(np.arange(len(queries) * len(rows)), len(rows))
    partial = (turned_q[:, :block] @ turned[:, :block].T).ravel()
    done = min(block, dims)
    while True:
        # to reach the bar, the squared distance may be this at most; a share of the dimensions holds about that share of it
        most = part_q[q_at, -1] + part_x[x_at, -1] - 2 * bar[q_at]
        most = most + 1e-9 * (1 + np.abs(bar[q_at]))
        so_far = part_q[q_at, done - 1] + part_x[x_at, done - 1] - 2 * partial
        share = min(1.0, done / dims * (1 + sigmas / np.sqrt(done)) ** 2) if done < dims else 1.0
        live = (most >= 0) & (so_far <= most * share + 1e-9)
        q_at, x_at, partial = q_at[live], x_at[live], partial[live]
        if done >= dims:
            break
        upto = min(done + block, dims)
        partial = partial + np.einsum("ij,ij->i", turned_q[q_at, done:upto], turned[x_at, done:upto])
        done = upto
    other = query_ids[q_at] != ids[x_at]
    q_at, x_at = q_at[other], x_at[other]
    score = (queries[q_at] * rows[x_at]).sum(1)
    order = np.lexsort((ids[x_at], -score, q_at))
    q_at, x_at, score = q_at[order], x_at[order], score[order]
    starts = np.searchsorted(q_at, q_at, side="left")
    top = np.arange(len(q_at)) - starts < k
    return q_at[top], x_at[top], score[top]


def choose_probes(indexed: DataFrame, trials: np.ndarray, trial_ids: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """Lists to probe so that the trial queries find ``recall`` of their true k nearest in ``indexed(vec_id, embedding, list)``."""

    def best(parts):
        held = None  # the best of all batches of a task, so that a task returns k rows for each trial
        for part in parts:
            scores = trials @ np.array(part["embedding"].tolist(), float).reshape(len(part), -1).T
            scores[trial_ids[:, None] == part["vec_id"].to_numpy()[None, :]] = -np.inf
            top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            at = np.repeat(np.arange(len(trials)), top.shape[1])
            rows = pd.DataFrame({"trial": at.astype(np.int32), "score": scores[at, top.ravel()], "vec_id": part["vec_id"].to_numpy()[top.ravel()], "list": part["list"].to_numpy()[top.ravel()]})
            held = pd.concat((held, rows)).sort_values(["trial", "score", "vec_id"], ascending=[True, False, True]).groupby("trial").head(k)
        if held is not None:
            yield held

    def merged(rows: DataFrame, *keys) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("trial", *keys).orderBy(F.desc("score"), "vec_id"))
        return rows.withColumn("place", place).where(F.col("place") <= k).drop("place")

    rows = indexed.select("vec_id", "embedding", "list").mapInPandas(best, "trial int, score double, vec_id long, list int").withColumn("task", F.spark_partition_id())
    some = merged(rows.withColumn("task", F.floor(F.col("task") / MERGE)), "task")
    true = merged(some).where(F.col("score") > float("-inf")).select("trial", "list").toPandas()
    if true.empty:
        return len(centres)
    order = np.argsort(-(trials @ centres.T), axis=1, kind="stable")
    turn = np.argsort(order, axis=1)[true["trial"], true["list"]]
    return int(np.sort(turn)[min(len(turn) - 1, int(np.ceil(recall * len(turn))))]) + 1


def search(vectors: DataFrame, queries: DataFrame, k: int = K, recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest rows of vectors found for each row of queries(vec_id, embedding)."""
    spark = vectors.sparkSession
    rows = through_files(valid(vectors), "ann-vectors")
    asked = valid(queries)
    total = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    # hash order, so the bounded sample is spread over all rows
    lists = max(1, round(LISTS_PER_ROOT * total**0.5))
    wanted_sample = max(SAMPLE, PER_CENTRE * lists)
    draw = F.xxhash64("vec_id", F.lit(SEED))
    share = min(1.0, 1.2 * wanted_sample / total)
    sample = rows.where(F.pmod(draw, F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(draw, "vec_id").limit(wanted_sample).toPandas()
    if sample.empty:
        sample = rows.orderBy("vec_id").limit(wanted_sample).toPandas()
    matrix = np.unique(np.array(sample["embedding"].tolist(), float), axis=0)  # copies must not draw several centres
    centres, turn = fit_levels(matrix, lists), rotation(matrix.shape[1])

    @F.pandas_udf("int")
    def home(embedding: pd.Series) -> pd.Series:
        return pd.Series(nearest(np.array(embedding.tolist(), float).reshape(len(embedding), -1), centres).astype(np.int32))

    indexed = through_files(rows.withColumn("list", home("embedding")), "ann-lists")
    asked = through_files(asked, "ann-queries")
    trials = asked.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(TRIALS).toPandas()
    if trials.empty:
        return spark.createDataFrame([], schema)
    probes = choose_probes(indexed, np.array(trials["embedding"].tolist(), float), trials["vec_id"].to_numpy(), centres, k, recall)

    @F.pandas_udf("array<int>")
    def probed(embedding: pd.Series) -> pd.Series:
        promise = np.array(embedding.tolist(), float).reshape(len(embedding), -1) @ centres.T
        return pd.Series(list(np.argsort(-promise, axis=1, kind="stable")[:, :probes].astype(np.int32)))

    wanted = through_files(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.posexplode(probed("embedding")).alias("pos", "list")), "ann-probes")
    # one row for each list: the centres in every task are larger
    sizes = F.broadcast(indexed.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")))

    def scan(chunk: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        if chunk.empty or questions.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        chunk = chunk.sort_values("vec_id")
        q, x = np.array(questions["query"].tolist(), float), np.array(chunk["embedding"].tolist(), float)
        q_ids, ids = questions["query_id"].to_numpy(), chunk["vec_id"].to_numpy()
        bars, out = questions["bar"].to_numpy(), []
        for a in range(0, len(q), QUERY_CHUNK):
            z = a + QUERY_CHUNK
            q_at, x_at, score = scan_chunk(q[a:z], q_ids[a:z], x, ids, turn, k, bars[a:z])
            out.append(pd.DataFrame({"query_id": q_ids[a:z][q_at], "vec_id": ids[x_at], "score": score}))
        return pd.concat(out)

    def scanned(asking: DataFrame) -> DataFrame:
        """Best rows by chunk for asking(query_id, query, list, bar); chunks meet blocks of their list's queries."""
        turns = F.broadcast(asking.groupBy("list").agg(F.ceil(F.count("*") / QUERY_TURN).cast("int").alias("turns")))
        parts = sizes.join(turns, "list")
        spread = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c).cast("long") - 1))
        dealt = indexed.join(F.broadcast(parts), "list").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks"))).withColumn("turn", spread("turns"))
        dealt_q = asking.join(F.broadcast(parts), "list").withColumn("turn", F.pmod(F.xxhash64("query_id"), F.col("turns"))).withColumn("chunk", spread("chunks"))
        key = ["list", "chunk", "turn"]
        left = dealt.select(*key, "vec_id", "embedding").groupBy(*key)
        return left.cogroup(dealt_q.select(*key, "query_id", "query", "bar").groupBy(*key)).applyInPandas(scan, "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", place).where(F.col("rank") <= k)

    early = through_files(best(scanned(wanted.where(F.col("pos") < FIRST).withColumn("bar", F.lit(float("-inf"))))), "ann-first")
    bars = early.where(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
    rest = wanted.where(F.col("pos") >= FIRST).join(bars, "query_id", "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf"))))
    late = scanned(through_files(rest, "ann-rest"))
    found = through_files(best(early.drop("rank").unionByName(late)).select("query_id", "rank", "vec_id", "score"), "ann-found")
    full = found.where(F.col("rank") == k).select("query_id")
    short = asked.join(full, asked["vec_id"] == full["query_id"], "left_anti")
    if probes >= len(centres) or short.isEmpty():
        return found
    # every list of the few queries whose lists hold too little; from k answers on nothing is missing
    every = F.sequence(F.lit(0), F.lit(len(centres) - 1))
    again = short.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.explode(every).alias("list"), F.lit(float("-inf")).alias("bar"))
    again = best(scanned(through_files(again, "ann-again"))).select("query_id", "rank", "vec_id", "score")
    return found.join(full, "query_id", "left_semi").unionByName(again)


def query(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))
