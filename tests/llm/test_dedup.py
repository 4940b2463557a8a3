import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from geostrata.llm import op2_exact_dedup, op5_near_dedup, op11_jaccard_join
from geostrata.llm.components import connected_components


def test_exact(spark, docs_of, odd_rows):
    rows = [*odd_rows, (20, "al pha beta gammadelta"), (21, "lonelytextofnobody")]
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc_id, len(text or "")))
    got = op2_exact_dedup.find_duplicates(docs_of(rows), capacity=2).collect()
    assert len(got) == len(rows)
    by_sha = defaultdict(list)
    for r in got:
        by_sha[r["text_sha256"]].append(r)
    assert len(by_sha) == len(groups)
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))[0]
        own = by_sha[hashlib.sha256(norm.encode()).hexdigest()]
        assert {r["keep_id"] for r in own} == {keep} and {r["group_size"] for r in own} == {len(members)} and sum(r["kept"] for r in own) == 1
    kept = op2_exact_dedup.deduplicate(docs_of(rows))
    assert kept.count() == len(groups) and kept.columns == docs_of(rows).columns
    assert op2_exact_dedup.find_duplicates(docs_of([])).count() == 0


def test_directory_splits_overfull_buckets(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) AS key")
    for bits, capacity in ((8, 300), (3, 40), (1, 2000)):
        slots = op2_exact_dedup.directory(keys, bits, capacity, 4 * capacity)
        got = op2_exact_dedup.route(keys, slots, bits).collect()
        assert len(got) == 5000
        buckets, owners = defaultdict(list), defaultdict(set)
        for r in got:
            buckets[r["bucket"]].append(r["key"] % (1 << 64))
            owners[r["owner"]].add(r["bucket"])
        assert max(map(len, buckets.values())) <= capacity
        assert sum(map(len, owners.values())) == len(buckets)  # a bucket has one owner
        spans = sorted((min(k), max(k)) for k in buckets.values())  # buckets and owners are ranges of keys
        assert all(a[1] < b[0] for a, b in itertools.pairwise(spans))
        spans = sorted((min(min(buckets[b]) for b in own), max(max(buckets[b]) for b in own)) for own in owners.values())
        assert all(a[1] < b[0] for a, b in itertools.pairwise(spans))
        depths = {r["local_depth"] for r in slots.collect()}
        assert max(depths) > bits if bits == 3 else max(depths) <= bits + 12


def test_directory_decides_which_files_are_read(spark, docs_of):
    rows = [(k, f"text number {k % 700}") for k in range(1500)]
    index, _ = op2_exact_dedup.build_index(docs_of(rows), capacity=8)
    owners = {r["owner"] for r in index.slots.collect()}
    assert len(owners) > 4
    asked = docs_of([(9000, "text  number 5"), (9001, "textnumber699"), (9002, "absent")])
    found = index.lookup(asked)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in found.collect()} == {9000: (5, 3), 9001: (699, 2)}
    routed = {r["owner"] for r in op2_exact_dedup.route(op2_exact_dedup._keyed(asked), index.slots, index.slot_bits).collect()}
    read = {int(re.search(r"owner=(\d+)", f)[1]) for f in index.entries().where(op2_exact_dedup.F.col("owner").isin(sorted(routed))).inputFiles()}
    assert "PartitionFilters: [owner" in found._jdf.queryExecution().toString()
    per_owner = {r["owner"]: r["n"] for r in index.entries().groupBy("owner").count().withColumnRenamed("count", "n").collect()}
    assert set(per_owner) == owners and len(routed) <= 3 < len(read | owners)


def test_deduplicate_odd_tables(spark, docs_of):
    assert op2_exact_dedup.deduplicate(docs_of([])).count() == 0
    rows = [(None, "same")] * 30 + [(1, None), (2, ""), (2, "")] + [(7, "x y")] * 5
    kept = [(r["doc_id"], r["text"]) for r in op2_exact_dedup.deduplicate(docs_of(rows)).collect()]
    assert sorted(kept, key=str) == sorted([(None, "same"), (1, None), (7, "x y")], key=str)
    assert sum(r["kept"] for r in op2_exact_dedup.find_duplicates(docs_of(rows)).collect()) == 3


def brute(rows, words, similarity=80):
    fold = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for doc_id, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(fold))
        sets[doc_id] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(i for i in sets if i is not None), 2):
        shared = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * shared >= similarity * (len(sets[a]) + len(sets[b]) - shared):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def family(r, base, n, share, start):
    out = []
    for k in range(n):
        words = base[:]
        for _ in range(int(len(words) * share * r.random())):
            words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
        out.append((start + k, " ".join(words)))
    return out


def test_near_equals_brute_force(spark, docs_of, odd_rows, monkeypatch):
    r = random.Random(2)
    monkeypatch.setattr(op5_near_dedup, "BLOCK_SHINGLES", 4_000)  # several blocks of one group
    rows = list(odd_rows)
    for f in range(6):
        base = [f"v{r.randrange(5000)}" for _ in range(r.choice([3, 12, 60, 150]))]
        rows += family(r, base, 12, 0.15, 100 + 50 * f)
    rows += family(r, [f"h{k}" for k in range(120)], 60, 0.16, 1000)  # one large group with links in and out of reach
    rows += [(2000 + k, " ".join(f"u{r.randrange(10**6)}" for _ in range(40))) for k in range(30)]
    want = brute(rows, 2)
    got = op5_near_dedup.near_duplicates(docs_of(rows), words=2).collect()
    assert len(got) == len(rows)
    for g in got:
        assert (g["n_shingles"], g["component_id"]) == want[g["doc_id"]], g
        assert g["kept"] == (g["doc_id"] == g["component_id"])
    assert op5_near_dedup.near_duplicates(docs_of([])).count() == 0


def test_keep_one_takes_five_words(spark, docs_of):
    base = [f"t{k}" for k in range(200)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-2])), (3, " ".join(base[:100])), (4, None)]
    kept = op5_near_dedup.keep_one(docs_of(rows))
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4] and kept.columns == docs_of(rows).columns


def test_block_links_span():
    sets = [np.arange(0, 100), np.arange(5, 105), np.arange(50, 160), np.arange(4, 104)]
    ids = np.array([10, 11, 12, 13])
    found = op5_near_dedup.block_links(ids, np.array([0, 0, 1, 1]), ids, [s.astype(np.int64) for s in sets], 80)
    assert sorted(found) == [(10, 13), (11, 13)]


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 480)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {i: got.get(i, i) for i in root} == {i: find(i) for i in root}


def test_blocks_are_runs_of_their_group(spark):
    rows = [(d, d % 7, 0 if d < 2_000 else d % 3 + 1, 1_000 + d % 50) for d in range(3_000)]
    got = op5_near_dedup._blocked(spark.createDataFrame(rows, "doc long, comp long, grp long, weight long"), 500).collect()
    assert len(got) == len(rows)
    block, held = {(r["doc"], r["comp"], r["grp"]): r["block"] for r in got}, {}
    for doc, comp, grp, weight in sorted(rows, key=lambda r: (r[2], r[1], r[0])):
        held[grp] = held.get(grp, 0) + weight
        assert block[doc, comp, grp] == held[grp] // op5_near_dedup.BLOCK_SHINGLES


def test_hot_leaders_meet_copies_of_their_sets(spark, docs_of, monkeypatch):
    monkeypatch.setattr(op5_near_dedup, "PAIRS_OF_COPY", 3)
    r = random.Random(9)
    rows = family(r, [f"z{k}" for k in range(80)], 40, 0.12, 1) + [(500, None)]
    want = brute(rows, 2)
    for g in op5_near_dedup.near_duplicates(docs_of(rows), words=2).collect():
        assert (g["n_shingles"], g["component_id"]) == want[g["doc_id"]]


@pytest.mark.parametrize("words, limit", [(1, 16), (5, 16), (2, 0)])
def test_join_equals_brute_force(spark, docs_of, odd_rows, monkeypatch, words, limit):
    r = random.Random(words)
    monkeypatch.setattr(op5_near_dedup, "BLOCK_SHINGLES", 4_000)
    monkeypatch.setattr(op11_jaccard_join, "RANGE_SHINGLES", 500)  # several ranges
    monkeypatch.setattr(op11_jaccard_join, "ENUM_MOST", limit)
    rows = list(odd_rows)
    for size in (*range(1, 24), 40, 90, 150):
        base = [f"v{r.randrange(5000)}" for _ in range(size)]
        rows += family(r, base, 10, 0.25, 10_000 * size)
        rows += [(10_000 * size + 500 + k, " ".join(base[: len(base) - k])) for k in range(1, 6)]
    passage = [f"p{k}" for k in range(60)]  # many documents share it, some hold little else
    rows += [(800_000 + k, " ".join(passage + [f"o{r.randrange(10**6)}" for _ in range(r.choice([2, 10, 14, 17, 60, 300]))])) for k in range(90)]
    want = brute(rows, words)
    got = op11_jaccard_join.jaccard_join(docs_of(rows), words=words).collect()
    assert len(got) == len(rows)
    wrong = [(g, want[g["doc_id"]]) for g in got if (g["n_shingles"], g["component_id"]) != want[g["doc_id"]]]
    assert not wrong, wrong[:5]
    assert op11_jaccard_join.jaccard_join(docs_of([])).count() == 0


def test_boundary_follows_cost():
    assert op11_jaccard_join.boundary({}) == 1 and op11_jaccard_join.boundary({4: 10}) > 4
    many = op11_jaccard_join.boundary({t: 100 for t in range(1, 17)})
    assert 4 < many < 17 and op11_jaccard_join.boundary({16: 1000}) <= 16
    assert op11_jaccard_join.needed(9, 9, 80) == 8 and op11_jaccard_join.needed(4, 5, 80) == 4
