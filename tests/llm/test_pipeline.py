import hashlib
import random
import re
import unicodedata
from collections import defaultdict

import duckdb
import pytest
from test_dedup import brute, family
from test_others import fill
from tokenizers import Tokenizer

import corpus_pipeline
from geostrata.llm import bpe, op1_bpe, op5_near_dedup, registry


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "source_mix", "bpe"]
    docs = first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == first.columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    assert corpus_pipeline.run(spark, sf_dir).count() == counts[4]
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert ids <= {r["doc_id"] for r in first.collect()}
    assert op1_bpe.round_trip(docs).count() == counts[4]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = registry.QUERIES[name](spark, sf_dir)
    want = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


def run_on(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return corpus_pipeline.run(spark, str(tmp_path))


def brute_pipeline(rows):
    """Sorted (doc_id, ids digest) of what the stages leave, one after the other in plain loops; doc_ids are distinct."""
    rows = [r for r in rows if any(unicodedata.category(c)[0] == "L" for c in r[1] or "")]
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1])].append(r)
    rows = [min(g, key=lambda r: (-len(r[1]), r[0])) for g in groups.values()]
    component = brute(rows, 5)
    rows = [r for r in rows if component[r[0]][1] == r[0]]
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append((hashlib.md5(f"7:{r[0]}".encode()).hexdigest(), len(re.findall(r"[^\x20\x09-\x0D]+", r[1])), r))
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    sizes = [sum(n for _, n, _ in by_source[s]) for s in order]
    out, tk = [], Tokenizer.from_file(bpe.default_vocabulary())
    for source, size, target in zip(order, sizes, fill(sizes, [(5, 2, 1)[k % 3] for k in range(len(order))]), strict=True):
        whole, rest = divmod(int(target + 0.5), size)
        for _, n, r in sorted(by_source[source]):
            taken, rest = whole * n + min(n, rest), rest - min(n, rest)
            ids = tk.encode(r[1], add_special_tokens=False).ids
            out += [(r[0], hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())] * int(taken / n + 0.5)
    return sorted(out)


def test_run_equals_brute_force(spark, docs_of, tmp_path):
    r = random.Random(8)
    rows = [(1, None, "en", "a"), (2, "12 34", "en", "b"), (3, "", None, None), (4, "Ein Satz auf Deutsch.", "de", None), (5, "Ein  Satz auf\nDeutsch. ", "de", "a"), (6, "naïve café <|endoftext|> 漢字", None, "b")]
    for f in range(5):
        base = [f"v{r.randrange(5000)}" for _ in range(60)]
        rows += [(i, t, ["en", "de"][f % 2], ["a", "b", "c", None][i % 4]) for i, t in family(r, base, 8, 0.05, 100 + 20 * f)]
    rows += [(300 + k, " ".join(f"u{r.randrange(10**6)}" for _ in range(r.randrange(1, 40))), "en", ["a", "b", "c", "d"][k % 4]) for k in range(60)]
    got = run_on(spark, docs_of(rows), tmp_path).select("doc_id", "ids_sha256").collect()
    assert sorted(map(tuple, got)) == brute_pipeline(rows)


def test_run_on_odd_tables(spark, docs_of, odd_rows, tmp_path):
    got = run_on(spark, docs_of([*odd_rows, *odd_rows]), tmp_path / "odd").collect()
    assert {r["doc_id"] for r in got} <= {3, 5, None, 11, 12, 13} and len(got) >= 4
    assert run_on(spark, docs_of([]), tmp_path / "empty").count() == 0
    assert run_on(spark, docs_of([(7, None), (8, " ")]), tmp_path / "blank").count() == 0


def test_near_stage_on_odd_tables(spark, docs_of, odd_rows):
    docs = docs_of([*odd_rows, (None, "lonely text of nobody"), (40, "word " * 30_000)])
    kept = op5_near_dedup.keep_one(docs)
    want = sorted(str((r[0], r[1])) for r in [*odd_rows, (None, "lonely text of nobody")] if r[0] != 5)  # 5 equals 3 up to blanks, 40 equals 11
    assert sorted(str((r["doc_id"], r["text"])) for r in kept.collect()) == want and kept.columns == docs.columns
    assert op5_near_dedup.keep_one(docs_of([])).count() == 0
