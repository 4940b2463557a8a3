import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from geostrata.llm import bpe, op1_bpe, op3_token_counts, op8_tokens, wavelet
from geostrata.llm.text import scratch
from geostrata.llm.wavelet import WaveletMatrix, build

TK = Tokenizer.from_file(bpe.default_vocabulary())
PIECES = ["foo", " bar", "\n", "  ", "   ", "'s", "don't", "<|endoftext|>", "<|endof", "text|>", ".", ",", "1234", "é", "漢", " ", "\t", "ThE", "aaaa", "\x00", "🙂"]


def expected(text):
    return TK.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60), st.text(max_size=20))
def test_encoder_equals_library(parts, tail):
    text = "".join(parts) + tail
    codec = bpe.load(bpe.default_vocabulary())
    ids = codec.encode_batch([text])[0]
    assert ids.tolist() == expected(text)
    assert codec.decode(ids) == TK.decode(expected(text), skip_special_tokens=False)
    assert op8_tokens.encoding(op8_tokens.default_ranks()).encode(text, allowed_special="all") == expected(text)


def test_full_cache_changes_nothing():
    codec = bpe.ByteBpe(bpe.default_vocabulary(), cache_entries=3)
    texts = ["one two three four", "five six, seven\neight", "one two", "a  b   c"]
    for _ in range(3):
        assert [x.tolist() for x in codec.encode_batch(texts)] == [expected(t) for t in texts]


def test_round_trip(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows)
    got = sorted(map(tuple, op1_bpe.round_trip(docs).collect()), key=str)
    want = []
    for doc_id, text, *_ in odd_rows:
        ids = expected(text)
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(TK.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = {r["doc_id"]: r["text"] for r in op1_bpe.decode(op1_bpe.encode(docs)).collect()}
    assert all(back[i] == (t or "") for i, t, *_ in odd_rows)
    assert op1_bpe.round_trip(docs_of([])).count() == 0


def test_shards(spark, docs_of, odd_rows):
    path = scratch(spark, "tokens")
    op8_tokens.write(docs_of(odd_rows), path, shard_tokens=16)
    got = [tuple(r) for r in op8_tokens.read(spark, path).orderBy("start").collect()]
    start, want = 0, []
    for doc_id, text, *_ in sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*expected(text), 2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    path = scratch(spark, "tokens")
    op8_tokens.write(docs_of([]), path)
    assert op8_tokens.read(spark, path).count() == 0


@pytest.mark.parametrize("gap", [" ", "\n", "\u3000", "\r\n"])
def test_shards_get_over_long_gaps(spark, docs_of, gap):
    text = "a <|endoftext|>" + gap * 1_200_000 + " b"
    path = scratch(spark, "tokens")
    op8_tokens.write(docs_of([(1, text), (2, "c")]), path)
    got = {r["doc_id"]: r for r in op8_tokens.read(spark, path).collect()}
    ids = [*bpe.load(bpe.default_vocabulary()).encode_batch([text])[0].tolist(), 2]
    assert bpe.load(bpe.default_vocabulary()).decode(np.array(ids[:-1])) == text
    assert (got[1]["n_tokens"], got[1]["ids_crc32"], got[2]["start"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids))
    short = "a" + gap * 3_000 + " b"
    codec = bpe.load(bpe.default_vocabulary())
    assert codec.encode_batch([short])[0].tolist() == expected(short) == op8_tokens.encode(short, op8_tokens.encoding(op8_tokens.default_ranks()), bpe.default_vocabulary()).tolist()


@pytest.mark.parametrize("n", [0, 1, 7, 511, 512, 513, 3000])
def test_wavelet_matrix(n, monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK", 512)
    ids = np.random.default_rng(n).integers(0, 300, n).astype(np.uint16)
    tree = WaveletMatrix(build(ids, np.array([0, n // 2, n]), 9, [None, -7]))
    assert tree.doc_ids == [None, -7] and tree.starts.tolist() == [0, n // 2, n]
    assert (tree.decode() == ids).all()
    for i in range(0, n, 97):
        assert tree.access(i) == ids[i]
        at = np.flatnonzero(ids == ids[i])
        assert tree.count(int(ids[i])) == len(at)
        assert tree.count(int(ids[i]), i, n) == (ids[i:] == ids[i]).sum()
        assert [tree.occurrence(int(ids[i]), k) for k in range(len(at))] == at.tolist()
    assert tree.count(511) == 0 and tree.occurrence(511, 0) == -1 and tree.count(5000) == 0


def test_planes_are_compressed():
    ids = np.random.default_rng(1).zipf(1.3, 300_000).clip(0, 40_000).astype(np.uint16)
    blob = build(ids, np.array([0, len(ids)]), 16, [5])
    tree = WaveletMatrix(blob)
    assert len(blob) < 0.7 * ids.nbytes and (tree.decode() == ids).all()
    for token in (1, 2, 77, 39_999):
        at = np.flatnonzero(ids == token)
        assert tree.count(token) == len(at) and all(tree.occurrence(token, k) == at[k] for k in range(0, len(at), max(1, len(at) // 7)))


def test_edits_equal_recount():
    codec, r = bpe.load(bpe.default_vocabulary()), random.Random(4)
    for _ in range(400):
        text = "".join(r.choice(PIECES) for _ in range(r.randint(0, 120)))
        chars, tokens = next(op3_token_counts.leaves_of(codec, [text], r.choice([1, 2, 4, 32])))
        own = op3_token_counts.CountedText(codec, text, chars, tokens)
        assert own.tokens.total == len(expected(text))
        for _ in range(4):
            at, gone, new = r.randint(0, len(text) + 3), r.choice([0, 1, 3, 20]), "".join(r.choice(PIECES) for _ in range(r.randint(0, 4)))
            own.edit(at, gone, new)
            if r.random() < 0.7:
                op3_token_counts.settle(codec, [own])
            at = min(at, len(text))
            text = text[:at] + new + text[at + gone :]
            assert own.text == text and (own.open or own.tokens.total == len(expected(text)))
        op3_token_counts.settle(codec, [own])
        assert own.tokens.total == len(expected(text))


def test_edits_touch_little():
    codec = bpe.load(bpe.default_vocabulary())
    text = "The quick brown fox. " * 2000
    chars, tokens = next(op3_token_counts.leaves_of(codec, [text]))
    own = op3_token_counts.CountedText(codec, text, chars, tokens)
    own.edit(len(text) // 2, 3, "cat")
    op3_token_counts.settle(codec, [own])
    assert own.tokens.total == len(expected(own.text)) and own.reencoded < 200


def test_long_insertions_make_small_leaves():
    codec = bpe.load(bpe.default_vocabulary())
    chars, tokens = next(op3_token_counts.leaves_of(codec, ["a short text of few words"]))
    own = op3_token_counts.CountedText(codec, "a short text of few words", chars, tokens)
    own.edit(7, 0, " many more words" * 3000)
    op3_token_counts.settle(codec, [own])
    before = own.reencoded
    own.edit(20_000, 2, "new")
    own.edit(40_000, 0, "\n" * 50)
    op3_token_counts.settle(codec, [own])
    assert own.tokens.total == len(expected(own.text)) and own.reencoded - before < 400
    assert max(len(codec.pretokens(t)) for t in own.texts) <= 2 * op3_token_counts.RUN + 60


def test_trees_over_tables(spark, docs_of, odd_rows):
    docs = op3_token_counts.with_edits(docs_of(odd_rows))
    done = op3_token_counts.apply_edits(op3_token_counts.build_trees(docs)).collect()
    assert len(done) == len(odd_rows)
    for r in done:
        assert r["n_tokens"] == len(expected(r["text"])) == sum(r["leaf_tokens"]) and sum(r["leaf_chars"]) == len(r["text"])
    assert sorted(r["n_before"] for r in done) == sorted(len(expected(t)) for _, t, *_ in odd_rows)
    assert op3_token_counts.apply_edits(op3_token_counts.build_trees(op3_token_counts.with_edits(docs_of([])))).count() == 0
