"""Conversation prefix trie against a trie built word by word, list ranking in many rounds, edge cases."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from tests.compare import connect, difference
from tidewatch.llm import op12_prefix_trie as op12

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string, depth string"  # the last clashes with a name of the result


def plain(rows):
    by_conv = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            by_conv.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    for own in by_conv.values():
        own.sort(key=lambda t: (t[0], t[1], hashlib.md5(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest()))
    members, ends = {}, {}
    for c, own in by_conv.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        path = [t[2:] for t in by_conv.get(base, [])[:h] + own[h:]]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
        ends.setdefault(tuple(path), []).append(c)
    children = {}
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)
    out, below = {}, {}
    for key in sorted(members, key=len, reverse=True):
        own = children.get(key, [])
        leaves = sum(below[k][0] for k in own) if own else 1
        saved = (len(members[key]) - 1) * (len(key[-1][1]) if key else 0) + sum(below[k][1] for k in own)
        below[key] = leaves, saved
        parent = min(members[key[:-1]]) if key else None
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(key, [])))).encode()).hexdigest()
        out[(min(members[key]), len(key))] = (parent, len(members[key]), len(own), leaves, saved, digest)
    return out


def built(spark, rows):
    frame = op12.prefix_trie(op12.rebuilt(op12.turns(spark.createDataFrame(rows, TURNS))))
    return {(r.conv_id, r.depth): tuple(r)[2:] for r in frame.collect()}


def test_list_rank(spark):
    rng = random.Random(1)
    ids = [(rng.randrange(1000), i) for i in range(700)]
    rng.shuffle(ids)
    rows = [(*x, *(y or (None, None))) for x, y in zip(ids, [*ids[1:], None])]
    rng.shuffle(rows)
    arcs = spark.createDataFrame(rows, "a long, b long, sa long, sb long")
    found = {(r.a, r.b): r["at"] for r in op12.list_rank(arcs, last=60).collect()}
    assert found == {x: i for i, x in enumerate(ids)}
    assert op12.list_rank(arcs.limit(0)).count() == 0


def conversations():
    rng = random.Random(2)
    rows = []
    for c in [*range(0, 140), *range(300, 330), -5, -100, -130, 7_000_000_000]:
        for turn in range(rng.randrange(1, 8)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["yes", "no", "ärger", ""]), "x"))
    rows += [(5, None, "user", "null turn", "x"), (5, None, None, None, "x"), (6, 2, "user", "same turn", "x"), (6, 2, "user", "same turn", "x"), (None, 0, "user", "lost", "x")]
    rows += [(900 + i, 0, "user", "hello", "x") for i in range(60)] + [(900, t, "system", "s", "x") for t in (1, 2)]  # one frequent conversation
    rows += [(2000, t, "user", f"turn {t % 3}", "x") for t in range(2500)]  # longer than one block of places
    return rows


def test_against_plain_trie(spark, monkeypatch):
    monkeypatch.setattr(op12, "SPAN", 6)
    rows = conversations()
    random.Random(4).shuffle(rows)
    assert built(spark, rows) == plain(rows)


def test_small_cases(spark):
    assert built(spark, []) == {}
    for rows in ([(3, 0, "user", "a", "x")], [(c, 0, None, None, "x") for c in range(100, 112)], [(1, 0, "a", "b:", "x"), (2, 0, "a:b", "", "x"), (1, 0, "a", "b:", "x")], [(None, 1, "user", "a", "x")]):
        assert built(spark, rows) == plain(rows)


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.01"])
def test_against_sql(spark, folder):
    assert difference(op12.query(spark, folder), connect(folder), op12.ORACLE) is None
