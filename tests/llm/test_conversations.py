import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from geostrata.llm import op12_prefix_trie, op13_repair

SCHEMA = "conv_id long, turn long, role string, text string, node string, seg long, pos string"


@pytest.fixture(scope="module")
def talks(spark):
    """A conversations table (with further columns whose names the operators also use) from (conv_id, turn, role, text) rows."""
    return lambda rows: spark.createDataFrame([(*r, "x", 7, "y") for r in rows], SCHEMA)


def odd_conversations(r):
    rows = [(None, 0, "user", "Nobody's."), (None, None, None, None), (3, None, "user", "a b"), (3, 5, None, None), (3, 5, "user", "tie"), (3, 5, "assistant", "tie"), (-25, 1, "user", "Hm?"), (-20, 1, "system", "Be."), (-20, 2, "user", "b")]
    rows += [(20, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(150)]  # longer than two segments
    rows += [(41, t, r.choice(["user", "assistant", "system", "tool", ""]), r.choice(["Yes.", "No", " ", "Why?  ", "word " * 4000, "é漢\n."])) for t in range(200)]
    for c in range(60, 130):
        for t in range(r.randrange(1, 9)):
            rows.append((c, t * r.choice([1, 1, 1, 2]), r.choice(["user", "assistant", "user", "assistant", "system"]), r.choice(["Hello.", "Go on", "Thanks!", "", "What? \t", f"Note {r.randrange(5)}."])))
    return rows + [(60, 0, "user", "Hello.")] * 3


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [(role, text) for *_, role, text in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c / 20) * 20
        built[c] = turns.get(c - base, [])[:h] + v[h:]
    members = defaultdict(set)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].add(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        saved[k] = (len(members[k]) - 1) * words + sum(saved[x] for x in kids[k])
    out = []
    for k, own_ in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in own_ if len(built[c]) == len(k)))
        out.append((min(own_), len(k), min(members[k[:-1]]) if k else None, len(own_), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_trie_equals_brute_force(spark, talks, monkeypatch):
    monkeypatch.setattr(op12_prefix_trie, "RANGE_IDS", 7)  # lists of ends in several pieces
    rows = odd_conversations(random.Random(4)) + [(c, t, "user", "same") for c in range(1000, 1060) for t in range(5)]
    got = op12_prefix_trie.prefix_trie(talks(rows)).drop("node", "parent").collect()
    assert sorted(map(tuple, got), key=str) == brute_trie(rows)
    assert op12_prefix_trie.prefix_trie(talks([])).count() == 0


def test_roll_up_takes_logarithmic_rounds(spark):
    nodes = [(f"n{k}", f"n{k - 1}" if k else None, k, 1) for k in range(70)] + [(f"m{k}", "n3", 4, 5) for k in range(40)]
    sums = {r["node"]: r["v"] for r in op12_prefix_trie.roll_up(spark.createDataFrame(nodes, "node string, parent string, depth long, v long"), 69, ("v",)).collect()}
    assert all(sums[f"n{k}"] == 70 - k + (200 if k < 4 else 0) for k in range(70)) and sums["m7"] == 5


def cheapest(rows):
    """Cost and audit by Dijkstra over (row, state), audits compared as a whole."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, st, out = heapq.heappop(heap)
        if k == len(rows) and st in ("", "a"):
            return cost, audit, "\n".join(out)
        if (k, st) in seen:
            continue
        seen.add((k, st))
        turn = "a" if st == "u" else "u"
        name = "assistant" if turn == "a" else "user"
        heapq.heappush(heap, (cost + 2, audit + "I", k, turn, (*out, f"{name}:")))
        if k < len(rows):
            role, text, fault = rows[k]
            heapq.heappush(heap, (cost + 3, audit + "D", k + 1, st, out))
            if fault not in ("blank", "duplicate"):
                more = int(fault == "truncated")
                heapq.heappush(heap, (cost + 2 + more, audit + "R", k + 1, turn, (*out, f"{name}:{text}")))
                if role[:1] == turn or (st == "" and role[:1] == "s"):
                    heapq.heappush(heap, (cost + more, audit + "K", k + 1, role[:1], (*out, f"{role}:{text}")))


def brute_repair(rows, harm=True):
    every, held = {r[0] for r in rows}, defaultdict(list)
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 if harm else 9
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            held[c] += [(t is not None, t or 0, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = []
    for c in every:
        own, seen, marked = sorted(held[c]), set(), []
        for _, _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {t for known, t, *_ in own if known}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, text = cheapest(marked)
        out.append((c, gaps, *(sum(m[2] == f for m in marked) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("segment", [64, 3])
def test_repair_equals_brute_force(spark, talks, monkeypatch, segment):
    monkeypatch.setattr(op13_repair, "SEGMENT", segment)
    rows = odd_conversations(random.Random(segment))
    got = op13_repair.repair_damaged(talks(rows), batch_rows=100).collect()
    assert sorted(map(tuple, got), key=str) == brute_repair(rows)


def test_repair_without_damage(spark, talks):
    rows = odd_conversations(random.Random(8))
    assert sorted(map(tuple, op13_repair.repair(talks(rows)).collect()), key=str) == brute_repair(rows, harm=False)
    assert op13_repair.repair(talks([])).count() == 0
