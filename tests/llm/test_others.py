import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from geostrata.llm import op4_licenses, op6_mixing, op7_neighbours, op9_sharding, op10_language
from geostrata.llm.text import scratch


# -- licences ---------------------------------------------------------------


def brute_statistics(words, sequences):
    runs = {tuple(s[a:z]) for s in sequences for a in range(len(s)) for z in range(a + 1, len(s) + 1)}
    out = []
    for i in range(len(words)):
        n = 0
        while n <= i and tuple(words[i - n : i + 1]) in runs:
            n += 1
        out.append(n)
    return out


def test_automaton_gives_matching_statistics():
    rng = np.random.default_rng(0)
    for _ in range(200):
        sequences = [rng.integers(1, 5, rng.integers(1, 12)).tolist() for _ in range(rng.integers(1, 5))]
        words = rng.integers(1, 6, 40).tolist()
        found = list(op4_licenses.SuffixAutomaton(sequences).statistics(words))
        assert [n for _, n in found] == brute_statistics(words, sequences)
        tree = op4_licenses.SuffixAutomaton(sequences)
        for i, (state, n) in enumerate(tree.statistics(words)):
            if n:
                run = words[i - n + 1 : i + 1]
                assert tree.places(state) == [(t, e) for t, s in enumerate(sequences) for e in range(n, len(s) + 1) if s[e - n : e] == run]


def brute_cover(words, sequence, min_run):
    """Most words of the sequence that a chain of maximal runs covers, by trying all chains."""
    n, m = len(words), len(sequence)
    ends = defaultdict(int)  # longest run that ends at a word and has a place in the sequence
    for i in range(1, n + 1):
        for a in range(i):
            if any(sequence[e : e + i - a] == words[a:i] for e in range(m - (i - a) + 1)):
                ends[i] = max(ends[i], i - a)
    maximal = [(i - ends[i], ends[i]) for i in ends if ends[i] >= min_run and ends.get(i + 1, 0) <= ends[i]]
    runs = sorted((start, at, k) for start, k in maximal for at in range(m - k + 1) if sequence[at : at + k] == words[start : start + k])
    best = 0
    stack = [(0, 0, 0, None)]
    while stack:
        covered, doc, end, first = stack.pop()
        best = max(best, covered)
        for start, at, k in runs:
            if start >= doc and at >= end and (first is None or start - first <= 2 * m):
                stack.append((covered + k, start + k, at + k, start if first is None else first))
    return best


def test_chains_equal_brute_force():
    rng, names = np.random.default_rng(7), "abcdefgh"
    for _ in range(150):
        sequence = [names[k] for k in rng.integers(0, 4, rng.integers(4, 14))]
        words = [names[k] for k in rng.integers(0, 5, 30)]
        scanner = op4_licenses.Scanner((("x", " ".join(sequence)),), (), min_run=3, covered=0.5)
        ids = np.array([scanner.ids.get(w.encode(), 0) for w in words])
        found = scanner.spans(ids)
        assert (found[0][3] if found else 0) == brute_cover(words, sequence, 3)
        for t, first, last, covered, share in found:
            assert 0 <= first <= last < len(words) and covered <= last - first + 1 and share == covered / len(sequence)


def test_templates_are_a_parameter(spark, docs_of, tmp_path):
    (tmp_path / "house.txt").write_text("you may look at it and you may not touch it and you may go")
    templates = op4_licenses.read_templates(spark, str(tmp_path))
    text = "He said: you may look at it, and you may not touch it, and you may go. MIT license"
    got = op4_licenses.scan(docs_of([(1, text), (2, "you may"), (3, None)]), templates=templates).collect()
    by = {r["doc_id"]: r for r in got}
    assert (by[1]["labels"], by[1]["base_labels"], by[1]["score"]) == ("house,mit", "mit", 1.0) and by[1]["spans"][0]["first_word"] == 2
    assert by[2]["labels"] == by[3]["labels"] == "" and by[3]["n_words"] == 0
    assert [r["labels"] for r in op4_licenses.scan(docs_of([(1, text)]), templates=()).collect()] == ["mit"]


def test_scan(docs_of, odd_rows):
    texts = ["Released under the MIT License.", "mit-LICENSE mit license apache license", "GNU General Public License, version 3 general public license", "the MIT License", "é mit license é"]
    texts.append("Intro. Permission is hereby granted, free of charge, to any person obtaining a copy of this thing and associated documentation files, to deal in the Software without restriction")
    rows = [*odd_rows, *((100 + k, t) for k, t in enumerate(texts))]
    got = op4_licenses.scan(docs_of(rows)).collect()
    assert len(got) == len(rows)
    fold = {c: c + 32 for c in range(65, 91)}
    want = defaultdict(list)
    for doc_id, text, *_ in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(fold))
        at, labels = [], set()
        for phrase, label in op4_licenses.BASE:
            p = phrase.split()
            here = [k for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
            at += here
            labels |= {label} if here else set()
        want[doc_id].append((len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) in want[r["doc_id"]]
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    by = {r["doc_id"]: r for r in got}
    assert by[100]["score"] == 1 and by[100]["labels"] == "mit"
    assert by[105]["base_labels"] == "" and by[105]["labels"] == "mit" and 0.75 < by[105]["score"] < 1
    assert op4_licenses.scan(docs_of([])).count() == 0


# -- mixing -----------------------------------------------------------------


def fill(sizes, weights, cap=3):
    level, clamped = sum(sizes), set()
    while True:
        free = [k for k in range(len(sizes)) if k not in clamped]
        left = level - sum(cap * sizes[k] for k in clamped)
        share = {k: left * weights[k] / sum(weights[j] for j in free) for k in free}
        over = {k for k in free if share[k] > cap * sizes[k]}
        if not over:
            return [float(cap * sizes[k]) if k in clamped else share[k] for k in range(len(sizes))]
        clamped |= over


def test_mix(docs_of, odd_rows):
    rows = [*odd_rows, *((100 + k, "w " * (k % 37), "en", f"s{k % 7}") for k in range(400)), *((900 + k, "v w", "en", "tiny") for k in range(3))]
    first = op6_mixing.mix(docs_of(rows)).collect()
    assert sorted(map(str, first)) == sorted(map(str, op6_mixing.mix(docs_of(rows).repartition(7)).collect()))
    assert len(first) == len(rows)
    size = defaultdict(int)
    for _, text, *rest in rows:
        size[rest[1]] += len((text or "").split())
    order = sorted((s for s in size if s is not None)) + [None]
    want = dict(zip([size[s] for s in order], fill([size[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))]), strict=True))
    taken = defaultdict(int)
    for r in first:
        assert r["target"] == pytest.approx(want[r["source_size"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source_size"]] += r["taken"]
    for s, t in taken.items():
        assert abs(t - want[s]) <= 3
    out = op6_mixing.sample(docs_of(rows))
    assert out.columns == docs_of(rows).columns
    words = defaultdict(int)
    for r in out.collect():
        words[size[r["source"]]] += len((r["text"] or "").split())
    longest, whole = defaultdict(int), {t or "" for _, t, *_ in rows}
    for _, text, *rest in rows:
        longest[size[rest[1]]] = max(longest[size[rest[1]]], len((text or "").split()))
    for k, v in taken.items():  # whole documents only, so the sum is off by half of the one at the cut at most
        assert abs(words[k] - v) <= longest[k] / 2 + 3
    assert {r["text"] for r in out.collect()} <= whole
    assert op6_mixing.sample(docs_of([])).count() == 0 and op6_mixing.sample(docs_of([(1, None), (2, "")])).count() == 0
    assert op6_mixing.mix(docs_of([])).count() == 0 and op6_mixing.mix(docs_of([(1, None), (2, "")])).count() == 2


# -- neighbours -------------------------------------------------------------


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[40:80] = x[40]  # ties
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0]), (5004, [None] * 16), (None, [1.0] * 16), (5020, [float("inf")] * 16)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = op7_neighbours.search(vectors, vectors.where("vec_id % 20 = 0")).collect()
    answers = defaultdict(list)
    for r in got:
        answers[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert len(answers) == 75
    hit = 0
    for q, found in answers.items():
        found.sort()
        score = x.astype(float) @ x[q].astype(float)
        want = sorted((k for k in range(1500) if k != q), key=lambda k: (-round(score[k], 9), k))[:20]
        assert [r for r, *_ in found] == list(range(1, 21)) and q not in [k for _, k, _ in found]
        assert all(s == pytest.approx(score[k]) for _, k, s in found)
        assert [(-s, k) for _, k, s in found] == sorted((-s, k) for _, k, s in found)
        hit += len({k for _, k, _ in found} & set(want))
    assert hit / (20 * 75) >= 0.9
    assert op7_neighbours.search(vectors.limit(0), vectors.limit(0)).count() == 0
    assert op7_neighbours.search(vectors.where("vec_id < 3"), vectors.where("vec_id = 0")).count() == 2


def test_neighbours_of_outliers_and_repeats(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate((rng.standard_normal((700, 8)) * 0.05 + 5, -50 * np.eye(8)))  # eight vectors far from all others
    rows = [(k, v.tolist(), "v", 1) for k, v in enumerate(x)] + [(3, x[3].tolist(), "again", 2)] * 4
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, rank int")
    got = op7_neighbours.search(vectors, vectors.where("vec_id >= 700 or vec_id = 20")).collect()
    answers = defaultdict(list)
    for r in got:
        answers[r["query_id"]].append(r)
    assert set(answers) == {20, *range(700, 708)} and all(sorted(r["rank"] for r in a) == list(range(1, 21)) for a in answers.values())
    for q in range(700, 708):
        score = x @ x[q]
        assert all(r["score"] == pytest.approx(score[r["vec_id"]]) for r in answers[q])
    own = op7_neighbours.search(vectors, vectors.where("vec_id = 3")).collect()
    assert all(r["vec_id"] != 3 for r in own)


def test_two_levels_of_centres():
    sample = np.random.default_rng(5).standard_normal((40_000, 4))
    centres = op7_neighbours.fit_levels(sample, 1_200)
    assert 1_100 < len(centres) < 1_300 and np.bincount(op7_neighbours.nearest(sample, centres), minlength=len(centres)).max() < 1_000


def test_scan_without_tests_is_exact():
    rng = np.random.default_rng(2)
    q, x = rng.standard_normal((5, 24)), rng.standard_normal((300, 24))
    q_at, x_at, score = op7_neighbours.scan_chunk(q, np.arange(1000, 1005), x, np.arange(300), op7_neighbours.rotation(24), 10, sigmas=1e9)
    for k in range(5):
        assert x_at[q_at == k].tolist() == np.argsort(-(x @ q[k]))[:10].tolist()


# -- sharding ---------------------------------------------------------------


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 3), (3, 4)])
def test_hilbert_curve_steps_to_neighbours(dims, bits):
    axes = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1)
    index = op9_sharding.hilbert_index(axes, bits)
    assert sorted(index.tolist()) == list(range(1 << (bits * dims)))
    path = axes[:, np.argsort(index)]
    assert (np.abs(np.diff(path, axis=1)).sum(0) == 1).all()


def brute_step(values, value, steps=16):
    """The cell of a value: cuts at equal shares of the rows, between whole values."""
    total, cuts, before = len(values), set(), 0
    first = {}
    for v in sorted(set(values)):
        n = values.count(v)
        first.setdefault(int((before + n / 2) * steps / total), v)
        before += n
    cuts = [v for k, v in first.items() if k > 0]
    return sum(v <= value for v in cuts)


def test_shards(spark, docs_of, odd_rows, tmp_path):
    rows = [*odd_rows, *((200 + k, "t " * (k % 50), ["en", "fr"][k % 2], f"https://host.example/path/{k % 5}") for k in range(300))]
    path = scratch(spark, "shards")
    op9_sharding.write(docs_of(rows), path, range_bytes=4_000)
    got = op9_sharding.read(spark, path).collect()
    assert sorted(str((r["doc_id"], r["text"], r["lang"], r["source"])) for r in got) == sorted(str((r[0], r[1], r[2] if len(r) > 2 else "en", r[3])) for r in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == len((r["text"] or "").encode()) + 1 and r["crc"] == zlib.crc32((r["text"] or "").encode())
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    in_order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["hilbert"] for r in in_order] == sorted(r["hilbert"] for r in got)
    # strings count by their whole values, so sources with a common beginning lie apart
    names = [r[3] or "" for r in rows]
    sizes = np.array([r["size"] for r in got])
    cuts = spark.createDataFrame([(int(x),) for x in sizes], "s long").agg(op9_sharding.F.percentile_approx("s", [k / 16 for k in range(1, 16)], 10_000)).first()[0]
    axes = np.array([[brute_step(names, r["source"] or "") for r in got], [brute_step([r[2] or "" for r in rows], r["lang"] or "") for r in got], np.searchsorted(cuts, sizes, side="right")])
    assert op9_sharding.hilbert_index(axes, 4).tolist() == [r["hilbert"] for r in got] and len(set(axes[0])) > 4
    for odd, want in (([], []), ([(1, "a"), (2, "b")], [0, 0]), ([(None, None)] * 3 + [(1, "x")], [0] * 4)):
        path = scratch(spark, "shards")
        op9_sharding.write(docs_of(odd), path)
        assert sorted(r["slot"] for r in op9_sharding.read(spark, path).collect()) == want
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = op9_sharding.query(spark, str(tmp_path)).collect()
    assert {(r["law"], r["grown_shard"]) for r in found} == {("rows", None)} and sorted((r["size"], r["text_crc32"]) for r in found) == sorted((r["size"], r["crc"]) for r in got)


def test_files_prune_in_several_dimensions(spark, docs_of):
    rng = np.random.default_rng(3)
    rows = [(k, "t" * int(rng.integers(1, 400)), ["de", "en", "es", "fr"][int(rng.integers(4))], f"s{rng.integers(8)}") for k in range(4000)]
    rows += [(9000 + k, "t" * 150, "en", "hot") for k in range(2000)]  # a cell with a third of all rows
    path = scratch(spark, "shards")
    op9_sharding.write(docs_of(rows), path, range_bytes=20_000)
    files = op9_sharding.boxes(spark, path).collect()
    assert len(files) > 40 and sum(f["n"] for f in files) == 6000 and max(f["n"] for f in files) < 500
    for source, low, high in (("s2", 0, 100), ("s5", 300, 401), ("hot", 0, 50)):
        met = [f for f in files if f["min_source"] <= source <= f["max_source"] and f["min_size"] <= high and f["max_size"] >= low]
        assert len(met) < 0.5 * len(files)


# -- language ---------------------------------------------------------------


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 7, 20):
        code = op10_language.codewords(n)
        assert len(code) == n and len({tuple(c) for c in code}) == n and (np.abs(code) == 1).all()
        least = min((a != b).sum() for i, a in enumerate(code) for b in code[:i])
        assert least >= (1 if n == 2 else 2)


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = op10_language.predict(docs, op10_language.train(docs)).join(docs, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert len(found) > 150 and sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.97


def test_predictions_equal_a_slow_reference(docs_of):
    import unicodedata

    docs = docs_of([*((200 + k, "le chat est la " * 5, "fr") for k in range(20)), *((300 + k, "the cat is there " * 5, "en") for k in range(20)), *((400 + k, "die katze ist da " * 5, "de") for k in range(20))])
    model = op10_language.train(docs)
    mask = (1 << 64) - 1
    for text in ("Le chat!", "the KATZE 42 da", "été là", "x"):
        low = text.lower()
        letter = [unicodedata.category(c)[0] == "L" for c in low]
        code = [ord(c) if ok else 0 for c, ok in zip(low, letter, strict=True)]
        counts = np.zeros(op10_language.FEATURES)
        for n in op10_language.ORDERS:
            for a in range(len(code) - n + 1):
                if any(letter[a : a + n]):
                    h = 0
                    for c in code[a : a + n]:
                        h = (h * 0x9E3779B97F4A7C15 + c + n) & mask
                    counts[((h * 0xD6E8FEB86659FD93 & mask) >> 40) % op10_language.FEATURES] += 1
        row = np.sqrt(counts) / np.sqrt(counts.sum())
        margins = row @ model.weights + model.bias
        loss = [sum(t * np.log1p(np.exp(-m * w)) for t, m, w in zip(model.trust, margins, word, strict=True)) for word in model.code]
        share = np.exp(-np.array(loss)) / np.exp(-np.array(loss)).sum()
        names, score, lead = op10_language.classify([text], model)
        assert names == [model.languages[int(share.argmax())]] and score[0] == pytest.approx(share.max(), rel=1e-6) and lead[0] == pytest.approx(np.sort(share)[-1] - np.sort(share)[-2], rel=1e-6)


def test_language_odd_cases(docs_of, odd_rows):
    rows = [*odd_rows, (100, "12 + 34 = 46"), *((200 + k, "le chat est la " * 5, "fr") for k in range(20)), *((300 + k, "the cat is there " * 5, "en") for k in range(20))]
    docs = docs_of(rows)
    got = op10_language.predict(docs, op10_language.train(docs)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert {by[k]["lang_pred"] for k in (7, 8, 9, 100)} == {"und"} and by[200]["lang_pred"] == "fr" and by[300]["lang_pred"] == "en"
    kept = op10_language.keep_known(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 4
    assert op10_language.train(docs_of([])) is None
    unlabelled = docs_of([(1, "some words", None), (2, "12 34", None), (3, None, None), (4, "слово", None)])
    assert sorted(r["doc_id"] for r in op10_language.keep_known(unlabelled).collect()) == [1, 4]
    assert op10_language.keep_known(docs_of([])).count() == 0
    same_id = docs_of([(1, f"the cat number {k} is there", "en") for k in range(300)] + [(3, f"le chat numéro {k} est la", "fr") for k in range(300)])
    models = [op10_language.train(same_id.repartition(n)) for n in (1, 5)]
    assert all(np.allclose(models[0].weights, m.weights) and m.languages == ["en", "fr"] for m in models)
    assert [r["lang_pred"] for r in op10_language.predict(docs_of([(1, "abc")]), None).collect()] == ["und"]
    one = docs_of([(k, "some words", "en") for k in range(40)])
    assert {(r["lang_pred"], r["score"]) for r in op10_language.predict(one, op10_language.train(one)).collect()} == {("en", 1.0)}


def test_language_stage_decides_by_prediction(spark, docs_of):
    r = random.Random(1)
    english, french = "the cat and the dog were there with which they would think that".split(), "le chat et les chiens qui sont ici avec des gens pour une maison".split()
    say = lambda words, n: " ".join(r.choice(words) for _ in range(n))
    rows = [(k, say(english, 30), "und") for k in range(200)] + [(1000 + k, say(french, 30), "fr") for k in range(200)]
    rows += [(5000, say(french, 40), None), (5001, "1234 --", "fr"), (5002, None, "fr"), (5003, "a", "fr")]
    docs = docs_of(rows)
    kept = op10_language.keep_known(docs)
    got = {x["doc_id"]: x["lang"] for x in kept.collect()}
    assert kept.columns == docs.columns and set(got) >= {*range(200), *range(1000, 1200), 5000, 5003} and not set(got) & {5001, 5002}
    assert got[5000] == "fr" and got[7] == "und"
    asked = {x["doc_id"] for x in op10_language.keep_known(docs, languages=("fr",)).collect()}
    assert {*range(1000, 1200), 5000} <= asked and not asked & set(range(200))
    # texts of both languages in equal parts: what the classifier can't decide goes where it has letters enough
    mixed = [" ".join(x for pair in zip(r.choices(english, k=n), r.choices(french, k=n), strict=True) for x in pair) for n in (2, 30) * 100]
    rows = rows[:400] + [(9000 + k, t, None) for k, t in enumerate(mixed)]
    both = docs_of(rows)
    names, _, lead = op10_language.classify([t for _, t, _ in rows], op10_language.train(both))
    want = {i for (i, t, _), x in zip(rows, lead, strict=True) if x >= op10_language.LEAD or sum(map(str.isalpha, t)) < op10_language.SURE_LETTERS}
    assert {x["doc_id"] for x in op10_language.keep_known(both).collect()} == want and len(rows) - 150 < len(want) < len(rows) and set(names) == {"und", "fr"}
