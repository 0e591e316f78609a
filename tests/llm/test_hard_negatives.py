"""Hard negatives against an exhaustive search, soundness of the bounds, edge cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import connect, difference
from tidewatch.llm import op13_hard_negatives as op13

ROWS = "vec_id long, embedding array<double>, label int, rank string"  # the last clashes with a name of the result


def plain(rows, every=100):
    kept = [(v, [math.floor(256 * x) for x in e], label) for v, e, label, *_ in rows
            if v is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in e)]
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    out = []
    for i, (anchor, x, label) in enumerate(kept):
        if anchor % every:
            continue
        scored = [(clip(sum(p * q for p, q in zip(x, y))), v, other == label) for j, (v, y, other) in enumerate(kept) if j != i and len(x) == len(y)]
        for score, positive, _ in sorted([s for s in scored if s[2]], key=lambda s: (-s[0], s[1]))[:5]:
            hard = sorted([s for s in scored if not s[2] and 30 * score <= 100 * s[0] <= 90 * score], key=lambda s: (-s[0], s[1]))[:10]
            out += [(anchor, positive, k, v, score, s) for k, (s, v, _) in enumerate(hard, 1)]
    return sorted(out)


def found(spark, rows):
    frame = spark.createDataFrame(rows, ROWS)
    return sorted(tuple(r) for r in op13.hard_negatives(frame, F.col("vec_id") % 100 == 0).collect())


def made(n, d, seed, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((labels, d))
    rows = []
    for i in range(n):
        label = int(rng.integers(labels))
        x = 0.7 * centres[label] + rng.standard_normal(d)
        rows.append((i, [float(v) for v in x / np.linalg.norm(x)], label, "x"))
    return rows


def test_against_exhaustive_search(spark, monkeypatch):
    monkeypatch.setattr(op13, "BLOCK", 150)  # many blocks
    monkeypatch.setattr(op13, "CHUNK", 2)
    rows = made(900, 24, 1)
    rows += [(i, rows[i][1], rows[i + 1][2], "x") for i in (0, 100, 5)]  # repeated ids, equal vectors, other labels
    rows += [(2000, rows[7][1], 0, "x")] * 40  # one frequent vector, an anchor
    assert found(spark, rows) == plain(rows) != []


def test_edge_cases(spark):
    nan, big = float("nan"), 1e5
    rows = made(60, 7, 3, 2) + [(None, [1.0] * 7, 0, "x"), (100, None, 0, "x"), (200, [1.0] * 7, None, "x"), (300, [nan] + [0.0] * 6, 0, "x"), (400, [None] + [0.0] * 6, 0, "x"),
                                (500, [float("inf")] + [0.0] * 6, 0, "x"), (600, [0.0] * 7, 0, "x"), (700, [0.5] * 3, 1, "x"), (701, [0.5] * 3, 1, "x"), (702, [0.2] * 3, 0, "x"), (800, [], 1, "x"), (801, [], 0, "x"), (803, [], 1, "x")]
    assert found(spark, rows) == plain(rows)
    # products beyond 2**53, beyond a long, beyond a double
    huge = [(i, [big * x for x in e], label, "x") for i, e, label, _ in made(60, 5, 4, 2)]
    huge += [(100, [1e6 + 0.25, 3e6, 1.0, 0.0, 0.0], 0, "x"), (200, [1e12, 1e12, 0.0, 0.0, 0.0], 0, "x"), (201, [1e13, 1.0, 1.0, 0.0, 0.0], 1, "x"), (300, [1e200] * 5, 0, "x"), (301, [1e200] * 5, 0, "x"), (302, [3e199] * 5, 1, "x"),
             (303, [1e308] * 5, 1, "x")]
    assert found(spark, huge) == plain(huge)
    assert found(spark, []) == [] and found(spark, rows[:1]) == []


@pytest.mark.parametrize("seed", range(3))
def test_bounds_hold(seed):
    rng = np.random.default_rng(seed)
    x = np.floor(rng.normal(0, 10.0 ** rng.integers(0, 6), (40, 37)))
    s = op13.summaries(x)
    at = 0
    for length in op13.LENGTHS:
        sizes = np.diff(np.r_[np.arange(0, 37, length), 37])
        mean, dev = s[:, at: at + len(sizes)], s[:, at + len(sizes): at + 2 * len(sizes)]
        at += 2 * len(sizes)
        norm = np.linalg.norm(x, axis=1)
        spare = op13.SLACK * norm[:, None] * norm
        low, high = (mean * sizes) @ mean.T - (dev * sizes) @ dev.T, (mean * sizes) @ mean.T + (dev * sizes) @ dev.T
        assert (x @ x.T >= low - spare).all() and (x @ x.T <= high + spare).all()


def test_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert difference(op13.query(spark, folder), connect(folder), op13.ORACLE) is None
