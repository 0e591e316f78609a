"""The exact tree on small and odd inputs by both ways of growing and scoring; forests of an expanding past against one fit per fold."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import forest, rolling, splits, tree
from tidewatch.operators.ordering import prefix_quantiles
from tidewatch.roles import Roles

ROLES = Roles(("a", "b"), ("k",), target="label")
SCHEMA = "flow_row_id bigint, a double, b double, k string, label int"


def shape(model):
    """The nodes by their path, without their names."""
    rows = {r["node"]: r for r in model.nodes.collect()}
    out, todo = [], [("1", "")]
    while todo:
        name, path = todo.pop()
        r = rows[name]
        out.append((path, r["depth"], r["feature"], r["cut"] if r["feature"] >= 0 else None, r["category"], r["n0"], r["n1"]))
        if r["feature"] >= 0:
            todo += [(r["below"], path + "0"), (r["above"], path + "1")]
    assert len(out) == len(rows)
    return sorted(out, key=repr)


def plain_tree(rows, depth=None):
    """The same tree grown one node at a time: rows of (a, b, k, label)."""
    out = []

    def above(row, f, cut, word):
        return row[2] == word if f == 2 else row[f] > cut or row[f] != row[f]

    def grow(own, path):
        n1 = sum(r[3] for r in own)
        n0, best = len(own) - n1, None
        if n0 and n1 and (depth is None or len(path) < depth):
            for f in (0, 1, 2):
                if f < 2:
                    values = sorted({r[f] for r in own if r[f] == r[f]}) + ([float("nan")] if any(r[f] != r[f] for r in own) else [])
                    cuts = []
                    for v, w in zip(values, values[1:]):
                        middle = v + (w - v) / 2
                        cuts.append((middle if v <= middle and (middle < w or w != w) and middle == middle else v, None))
                else:
                    cuts = [(0.0, w) for w in sorted({r[2] for r in own})] if len({r[2] for r in own}) > 1 else []
                for cut, word in cuts:
                    low = [r for r in own if not above(r, f, cut, word)]
                    b1 = sum(r[3] for r in low)
                    b0, h0, h1 = len(low) - b1, n0 - len(low) + b1, n1 - b1
                    cost = b0 * b1 / (b0 + b1) + h0 * h1 / (h0 + h1)
                    if best is None or cost < best[0]:
                        best = (cost, f, cut, word)
        out.append((path, len(path), best[1] if best else -1, best[2] if best else None, best[3] if best else None, n0, n1))
        if best:
            for side in (False, True):
                grow([r for r in own if above(r, *best[1:]) == side], path + "01"[side])
    grow(rows, "")
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def noisy(n, seed, values=9):
    rng = random.Random(seed)
    return [(float(rng.randrange(values)), rng.choice([0.1, 0.2, -3.5, 1e9]), rng.choice("xyz"), int(rng.random() < 0.4)) for _ in range(n)]


@pytest.mark.parametrize("local", [5, tree.LOCAL])
def test_tree_is_the_greedy_one(spark, local):
    rows = noisy(70, 1)
    model = tree.fit_tree(frame(spark, rows), ROLES, local=local)
    assert shape(model) == plain_tree(rows)
    assert shape(tree.fit_tree(frame(spark, rows), ROLES, max_depth=2, local=local)) == plain_tree(rows, 2)


def test_one_task_finishes_a_deep_tree(spark, monkeypatch):
    """20,000 points of random classes: the largest node shrinks slowly, so levels made of jobs would be many."""
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), "xyz"[i % 3], int(y)) for i, (a, b, y) in enumerate(zip(rng.normal(size=20_000), rng.normal(size=20_000), rng.random(20_000) < 0.3))]
    data, levels = frame(spark, rows), []
    best = tree._best_cuts
    monkeypatch.setattr(tree, "_best_cuts", lambda *a: levels.append(1) or best(*a))
    model = tree.fit_tree(data, ROLES)
    assert not levels
    roots = model.nodes.where("subtree")
    assert roots.count() > 1 and roots.where(F.expr(f"n0 + n1 > {tree.PART}")).isEmpty()  # rows still meet small subtrees
    model.broadcast_nodes = 0
    assert model.predict(data).where("actual <> predicted").isEmpty()


@pytest.mark.parametrize("buckets", [3, 4096])
def test_large_nodes_are_cut_by_counts_of_buckets(spark, monkeypatch, buckets):
    """The same tree whether buckets hold many values or one, and a level of large nodes writes no points."""
    monkeypatch.setattr(tree, "BUCKETS", buckets)
    rng = random.Random(8)
    odd = [float("inf"), float("-inf"), float("nan"), -0.0]
    rows = [(rng.choice([*odd, *map(float, range(25))]), rng.gauss(0, 1), rng.choice("abcdefgh"), int(rng.random() < 0.4)) for _ in range(90)]
    written = []
    for name in ("stored", "write_table"):
        monkeypatch.setattr(tree, name, lambda *a, _old=getattr(tree, name), **k: written.append(1) or _old(*a, **k))
    model = tree.fit_tree(frame(spark, rows), ROLES, local=20)
    assert shape(model) == plain_tree(rows)
    levels = model.nodes.where("root is null and feature >= 0").agg(F.max("depth")).first()[0] + 1
    assert levels >= 3 and len(written) <= 4 + levels


@pytest.mark.parametrize("lot", [4, 1 << 20])
def test_a_level_shuffles_its_counts_and_its_listed_values_once(spark, monkeypatch, lot):
    """The same tree for any size of lots; each of the two jobs of a level has one exchange."""
    monkeypatch.setattr(tree, "BUCKETS", 3)
    monkeypatch.setattr(tree, "LOT", lot)
    rng = random.Random(5)
    rows = [(rng.choice([float("inf"), float("nan"), -0.0, *map(float, range(9))]), rng.gauss(0, 1), rng.choice("abcdefgh"), int(rng.random() < 0.4)) for _ in range(70)]
    model, plans = tree.fit_tree(frame(spark, rows), ROLES, local=tree.LOCAL), []
    assert shape(model) == plain_tree(rows)
    kind, collect = type(model.nodes), type(model.nodes).collect
    best = tree._best_cuts

    def watched(*a):
        with monkeypatch.context() as m:
            m.setattr(kind, "collect", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange")) or collect(df))
            return best(*a)

    monkeypatch.setattr(tree, "_best_cuts", watched)
    assert shape(tree.fit_tree(frame(spark, rows), ROLES, max_depth=2, local=20)) == plain_tree(rows, 2)
    assert len(plans) >= 2 and set(plans) == {1}


def test_model_rows_come_from_one_scan(spark, monkeypatch):
    """Rows that share an id meet each other as in a join on the id, and those without an id are left out."""
    from types import SimpleNamespace

    from tidewatch.plans import model_queries as mq

    ids = [1, 2, 2, 3, 3, 3, None, None, 4]
    rows = [(i, f"2024-01-{n + 1:02d} 00:00:00", ("Benign", "Malicious", "Unknown")[n % 3 if n < 6 else 0], f"d{n}", "tcp", "-" if n % 2 else "svc", "SF", None, float(n), 1.0, None, 0.0)
            for n, i in enumerate(ids)]
    view = spark.createDataFrame(rows, "flow_row_id long, time string, label string, detailedlabel string, proto string, service string, conn_state string, history string, "
                                       "duration double, orig_bytes double, resp_bytes double, missed_bytes double")
    view = view.withColumns({"ts": F.col("time").cast("timestamp"), "capture_date": F.to_date("time")}).drop("time")
    scans = []
    monkeypatch.setattr(mq.rolling, "keep", lambda f, n, keep=mq.rolling.keep: scans.append(f._jdf.queryExecution().executedPlan().toString().count("Scan")) or keep(f, n))
    for own in (view, view.where("flow_row_id is null or flow_row_id in (1, 4)")):
        got = mq.flows(SimpleNamespace(flow_v=own))
        keyed = mq.cleaning.metadata_table(own, mq.FLOW).select("flow_row_id", "ts", "capture_date", "detailedlabel")
        joined = mq.cleaning.modelling_table(mq.clean_flows(SimpleNamespace(flow_v=own)), mq.FLOW).join(keyed, "flow_row_id")
        assert got.dtypes == joined.dtypes
        assert sorted(map(repr, got.collect())) == sorted(map(repr, joined.collect()))
    assert scans == [1, 1]


@pytest.mark.parametrize("local", [2, tree.LOCAL])
def test_tree_fits_distinct_rows(spark, local):
    inf, nan = float("inf"), float("nan")
    checkers = [(float(i), float(j), "x", (i + j) % 2) for i in range(3) for j in range(3)]  # no first cut gains anything
    odd = [(1.0, 0.0, "x", 0), (1.0000000000000002, 0.0, "x", 1), (inf, 0.0, "x", 0), (-inf, 0.0, "x", 1), (nan, 0.0, "x", 1), (1e308, 0.0, "x", 1), (-1e308, 0.0, "x", 0)]
    for rows in (checkers, odd):
        data = frame(spark, rows)
        model = tree.fit_tree(data, ROLES, local=local)
        assert shape(model) == plain_tree(rows)
        model.broadcast_nodes = 0 if local == 2 else tree.BROADCAST_NODES
        assert model.predict(data).where("actual <> predicted").count() == 0


def test_scoring_by_broadcast_and_by_subtree(spark, monkeypatch):
    monkeypatch.setattr(tree, "SHARE_ROWS", 7)  # several shares of a subtree
    model = tree.fit_tree(frame(spark, noisy(150, 2, 40)), ROLES, local=12)
    new = frame(spark, noisy(200, 3, 50) + [(None, None, None, 1), (float("nan"), 0.15, "unseen", 0)]).withColumn("n_rows", F.lit(1))
    whole = sorted(map(tuple, model.predict(new).collect()))
    assert len(whole) == 202 and model.nodes.where("root is null").count() > 3
    model.broadcast_nodes = 0
    assert sorted(map(tuple, model.predict(new).collect())) == whole


def test_tree_without_split(spark):
    same = frame(spark, [(1.0, 1.0, "x", 0), (1.0, 1.0, "x", 1), (1.0, 1.0, "x", 1)])
    model = tree.fit_tree(same, ROLES)
    assert model.shape() == {"depth": 0, "nodes": 1}
    assert {r["score"] for r in model.predict(same).collect()} == {2 / 3}
    assert {r["importance"] for r in model.importances().collect()} == {0.0}


@pytest.fixture(scope="module")
def sixty_days(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(3000):
        day = i // 50
        rows.append((i, 1_700_006_400 + day * 86_400 + int(rng.integers(86_400)), None if i % 9 == 0 else float(np.round(rng.normal(day / 30), 1)), float(rng.integers(5)), f"k{i % 4}", int(i % 15 == 7)))
    flows = spark.createDataFrame(rows, "flow_row_id bigint, ts bigint, a double, b double, k string, label int").withColumn("ts", F.col("ts").cast("timestamp"))
    return rolling.keep(flows.withColumn("capture_date", F.to_date("ts")), "days")


def test_prefix_quantiles(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(12), None if rng.random() < 0.1 else round(rng.gauss(0, 3), 1), float(rng.randrange(3))) for _ in range(900)] + [(0, None, None)]
    data = spark.createDataFrame(rows, "s int, x double, y double")
    for share in (0.5, 0.9):
        got = {(r["feature"], r["fold"]): r["value"] for r in prefix_quantiles(data, ["x", "y"], share, "s", [0, 1, 5, 11]).collect()}
        for column, place in (("x", 1), ("y", 2)):
            for fold in (0, 1, 5, 11):
                values = [r[place] for r in rows if r[0] <= fold and r[place] is not None]
                assert got[(column, fold)] == pytest.approx(np.quantile(values, share))


def test_forests_of_an_expanding_past(spark, sixty_days):
    benign = sixty_days.where("label = 0")
    cutoffs = splits.fold_cutoffs(benign, splits.fold_dates(sixty_days), "ts", "flow_row_id")
    rows, folds = splits.fit_segments(benign, cutoffs, "ts", "flow_row_id")
    assert len(folds) == 59
    past = splits.fold_membership(benign, cutoffs, "ts", "flow_row_id").where("part = 'fit'").withColumn("test_date", F.col("test_date").cast("string"))
    merged = forest.fit_forest_prefixes(rows, ROLES, "_segment", folds, trees=6, sample=64)
    single = forest.fit_forest(past, ROLES, trees=6, sample=64, group="test_date")
    assert merged.fills == single.fills and merged.models == single.models
    assert sorted(map(repr, merged.nodes.collect())) == sorted(map(repr, single.nodes.collect()))
    # candidates grow with the logarithm of the past, not with rows times folds
    sizes = {r["_segment"]: r["n"] for r in rows.groupBy("_segment").agg(F.count("*").alias("n")).where("_segment is not null").collect()}
    total, limits = 0, []
    for k in sorted(sizes):
        total += sizes[k]
        limits.append((k, forest._limit(forest.SPARE, 64, total)))
    drawn = forest.candidates(rows.where("_segment is not null"), "_segment", "flow_row_id", spark.createDataFrame(limits, "_segment int, _limit double"), 6, 42).count()
    assert drawn < 6 * 64 * 1.5 * (2 + np.log(total / 64)) < past.count()


def test_a_forest_walk_is_one_range_test_a_level():
    """Against a plain walk of every row and tree, with odd numbers, unseen categories and a column that is never cut."""
    rng = np.random.default_rng(4)
    values = np.column_stack([rng.normal(size=700), rng.integers(0, 4, 700).astype(float), np.zeros(700)])
    words = np.array([[f"k{a}", f"w{b}"] for a, b in zip(rng.integers(0, 3, 700), rng.integers(0, 40, 700))], dtype=object)
    nodes = [n for t in range(7) for rows in [rng.choice(700, 64, replace=False)] for n in forest._grow(values[rows], words[rows], "m", t, 42)]
    table = pd.DataFrame(nodes, columns=[c.split()[0] for c in forest.NODES.split(", ")])
    code = {w: (-1) ** i * (i + 5) for i, w in enumerate(sorted(set(words.ravel())))}
    table["code"] = [code.get(c, 0) for c in table["category"]]
    values[:9, 0], words[9:20, 1] = [np.nan, np.inf, -np.inf] * 3, "unseen"
    kinds = np.array([[code.get(w, 10**15) for w in row] for row in words], dtype="int64")
    tree_nodes = {(n[1], n[2]): n for n in nodes}
    paths = []
    for i in range(700):
        total = 0
        for t in range(7):
            at = tree_nodes[t, 1]
            while at[3] >= 0:
                above = values[i, at[3]] > at[4] if at[3] < 3 else words[i, at[3] - 3] == at[5]
                at = tree_nodes[t, 2 * at[2] + int(above)]
            total += at[6]
        paths.append(total)
    model = forest._arrays(table, 3, 2)["m"]
    assert np.array_equal(forest._walk_all(values, kinds, model), np.exp2(-np.array(paths) / (7 * forest.UNIT) / forest.expected_path(64)) - 0.5)


def test_segments_are_the_first_folds_that_fit(spark, monkeypatch):
    """Rows at a cut's own time go by the id's hash and NULL times come first, as in the whole key; a forest asks for segments once."""
    days = [(i, None if i % 25 == 0 else (i // 10) * 21_600 * 1_000_000, i // 40) for i in range(400)]  # ten rows share one time
    benign = spark.createDataFrame(days, "flow_row_id bigint, m bigint, d int").select("flow_row_id", F.timestamp_micros("m").alias("ts"), F.date_add(F.lit("1970-01-01").cast("date"), "d").alias("capture_date"))
    benign = benign.withColumns({"a": F.col("flow_row_id").cast("double"), "b": F.lit(1.0), "k": F.lit("x")})
    cutoffs = rolling.keep(splits.fold_cutoffs(benign, splits.fold_dates(benign), "ts", "flow_row_id"), "cuts")
    rows, folds = splits.fit_segments(benign, cutoffs, "ts", "flow_row_id")
    past = splits.fold_membership(benign, cutoffs, "ts", "flow_row_id").where("part = 'fit'")
    first = {r["flow_row_id"]: folds.index(str(r["day"])) for r in past.groupBy("flow_row_id").agg(F.min("test_date").alias("day")).collect()}
    assert {r["flow_row_id"]: r["_segment"] for r in rows.collect() if r["_segment"] is not None} == first and len(folds) == 9
    kept = []
    monkeypatch.setattr(forest, "stored", lambda table, name, real=forest.stored: kept.append(name) or real(table, name))
    forest.fit_forest_prefixes(rows, ROLES, "_segment", folds, trees=3, sample=16)
    assert kept[0] == "segments"


def test_rolling_evaluation_both_ways(spark, sixty_days):
    few = sixty_days.where("capture_date < '2023-11-25'")
    fit = lambda rows, roles, group: forest.fit_forest(rows, roles, trees=8, sample=32, group=group)
    prefix = lambda rows, roles, segment, folds: forest.fit_forest_prefixes(rows, roles, segment, folds, trees=8, sample=32)
    results = [rolling.rolling_evaluation(few, ROLES, "ts", fit, prefix_fit=p)["daily"].collect() for p in (None, prefix)]
    assert sorted(map(repr, results[0])) == sorted(map(repr, results[1])) and len(results[0]) == 9


def test_times_that_run_against_dates_are_not_nested(spark, sixty_days):
    turned = sixty_days.withColumn("ts", F.timestamp_seconds(F.lit(3_400_000_000) - F.unix_timestamp("ts"))).where("label = 0")
    cutoffs = splits.fold_cutoffs(turned, splits.fold_dates(turned), "ts", "flow_row_id")
    assert splits.fit_segments(turned, cutoffs, "ts", "flow_row_id") is None


def test_dictionary_is_numbered_without_the_driver(spark):
    from tidewatch.operators import prep

    rng = random.Random(8)
    words = [f"w{rng.randrange(5000)}" for _ in range(9000)] + ["é", "Z", "", "~"]
    train = spark.createDataFrame([(i, float(i), w, None if i % 3 else "x") for i, w in enumerate(words)], "id long, n double, k string, few string")
    dictionary = prep.fit_dictionary(train, ["k", "few"])
    got = {(r["feature"], r["word"]): r["place"] for r in dictionary.collect()}
    assert got == {("k", w): i for i, w in enumerate(sorted(set(words)))} | {("few", "x"): 0}
    roles = Roles(("n",), ("k", "few"))
    new = spark.createDataFrame([(1, 2.5, "é", "x"), (2, None, "never seen", None)], "id long, n double, k string, few string")
    rows = {r["id"]: r for r in prep.encode(new, roles, dictionary).withColumn("whole", prep.dense("features")).collect()}
    size = 1 + len(set(words)) + 1
    assert rows[1]["features"]["size"] == size == len(rows[1]["whole"])
    assert rows[1]["features"]["indices"] == [0, 1 + got[("k", "é")], size - 1] and rows[1]["features"]["values"] == [2.5, 1.0, 1.0]
    assert rows[2]["features"]["indices"] == [0] and sum(rows[1]["whole"]) == 4.5 and sum(rows[2]["whole"]) == 0.0
