from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import features, forest, oneclass, rolling, tree
from tidewatch.roles import Roles

ROLES = Roles(("a", "b"), ("k",), target="label")
SCHEMA = "flow_row_id bigint, ts bigint, a double, b double, k string, label int"


@pytest.fixture(scope="module")
def flows(spark):
    """Six days; malicious rows are far away from the benign cloud."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(2400):
        bad = i % 12 == 0
        a, b = (8 + rng.normal(), -8 + rng.normal()) if bad else (rng.normal(), rng.normal())
        rows.append((i, 1_700_006_400 + i * 216, None if i % 40 == 3 else float(a), float(b), "odd" if bad else f"k{i % 3}", int(bad)))
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.col("ts").cast("timestamp"))
    return frame.withColumn("capture_date", F.to_date("ts")).cache()


def test_verdict_rules(spark):
    rows = [(i, float(i), 1.0, None if i % 10 < 7 else float(i % 10), 1.0 if i else 2.0, float(i % 2), i % 2) for i in range(1000)]
    frame = spark.createDataFrame(rows, "id int, spread double, constant double, sparse double, nearly double, splits double, y int")
    got = {r["feature"]: r for r in features.numeric_summary(frame, ["spread", "constant", "sparse", "nearly", "splits"], "y").collect()}
    assert {k: v["recommendation"] for k, v in got.items()} == {
        "spread": "KEEP", "constant": "DROP", "sparse": "REVIEW" if got["sparse"]["standardized_mean_gap"] < 0.2 else "KEEP", "nearly": "REVIEW", "splits": "KEEP"}
    assert got["spread"]["relevance_evidence"].endswith("low standalone separation, but retain for multivariate modelling")
    assert got["sparse"]["missing_percentage"] == 70.0 and got["nearly"]["dominant_value_ratio"] == 0.999
    assert got["splits"]["standardized_mean_gap"] == 0.0  # both deviations are 0


def test_categorical_rules(spark):
    rows = [("x" if i % 10 else "rare", None if i % 10 < 7 else "s", "c", i % 10 == 0) for i in range(100)]
    frame = spark.createDataFrame(rows, "k string, sparse string, one string, y boolean").withColumn("y", F.col("y").cast("int"))
    counts = features.category_counts(frame, ["k", "sparse", "one"], "y")
    got = {r["feature"]: r for r in features.categorical_summary(counts).collect()}
    assert {k: v["recommendation"] for k, v in got.items()} == {"k": "KEEP", "sparse": "REVIEW", "one": "DROP"}
    assert "top association: rare -> Malicious (100.0% malicious)" in got["k"]["relevance_evidence"]
    assert got["sparse"]["top_categories"] == "<MISSING>, s"
    kept = features.approved_roles(features.recommendations(features.numeric_summary(frame.withColumn("n", F.rand(1)), ["n"], "y"), features.categorical_summary(counts)),
                                   Roles(("n",), ("k", "sparse", "one")))
    assert kept.features == ("n", "k", "sparse")


def test_forest_properties(spark, flows):
    benign = flows.where("label = 0")
    model = forest.fit_forest(benign, ROLES, trees=50)
    scores = {r["flow_row_id"]: r for r in model.score(flows).select("flow_row_id", "label", "score").collect()}
    values = np.array([r["score"] for r in scores.values()])
    assert (values > -0.5).all() and (values <= 0.5).all()
    bad = np.mean([r["score"] for r in scores.values() if r["label"]])
    good = np.quantile([r["score"] for r in scores.values() if not r["label"]], 0.95)
    assert bad > good
    again = forest.fit_forest(benign.repartition(7), ROLES, trees=50)
    moved = {r["flow_row_id"]: r["score"] for r in again.score(flows.repartition(3)).select("flow_row_id", "score").collect()}
    assert all(moved[i] == r["score"] for i, r in scores.items())
    sizes = model.nodes.groupBy("tree").agg(F.max("sample").alias("s"), F.countDistinct("node").alias("n")).collect()
    assert len(sizes) == 50 and {r["s"] for r in sizes} == {256} and all(r["n"] % 2 == 1 and r["n"] <= 511 for r in sizes)


def test_forest_sampling_modes(spark):
    big = spark.range(30000).select(F.col("id").alias("flow_row_id"), F.lit("m").alias(forest.GROUP))
    drawn = forest.tree_samples(big, "flow_row_id", {"m": 30000}, 20, 256, 1).dropDuplicates(["tree", "flow_row_id"])
    assert {r["count"] for r in drawn.groupBy("tree").count().collect()} == {256}
    small = spark.range(100).select(F.col("id").alias("flow_row_id"), F.lit("m").alias(forest.GROUP))
    assert {r["count"] for r in forest.tree_samples(small, "flow_row_id", {"m": 100}, 20, 256, 1).groupBy("tree").count().collect()} == {100}


@pytest.mark.parametrize("n", [255, 257, 2047, 2048, 2049, 200_000])
def test_forest_sampling_is_one_rule(spark, n):
    rows = spark.range(n).select(F.col("id").alias("flow_row_id"), F.lit("m").alias(forest.GROUP))
    counts = forest.tree_samples(rows, "flow_row_id", {"m": n}, 200, 256, 1).groupBy("tree").agg(F.count("*").alias("n"), F.countDistinct("flow_row_id").alias("d")).collect()
    assert len(counts) == 200 and {(r["n"], r["d"]) for r in counts} == {(min(n, 256), min(n, 256))}


def test_rows_without_a_model_stay(spark, flows):
    keyed = flows.withColumn("day", F.col("capture_date").cast("string"))
    days = sorted(r[0] for r in keyed.select("day").distinct().collect())[:3]
    model = forest.fit_forest(keyed.where(F.col("day").isin(days)), ROLES, trees=20, group="day")
    tried = []
    for size in (1, 8):  # by a shuffle and by a broadcast
        model.broadcast_models = size
        tried.append(sorted((r["flow_row_id"], r["score"]) for r in model.score(keyed, "day").select("flow_row_id", "score").collect()))
    assert tried[0] == tried[1] and len(tried[0]) == flows.count()
    assert sum(score is None for _, score in tried[0]) == keyed.where(~F.col("day").isin(days)).count()


def test_nan_and_null_scores_are_ranked(spark):
    from tidewatch.operators import evaluation

    rows = [(i % 2, float(i)) for i in range(50)] + [(1, float("nan")), (0, float("nan")), (1, None)]
    scored = spark.createDataFrame(rows, "actual int, score double")
    assert 0.4 < evaluation.ranking_metrics(scored).first()["roc_auc"] < 0.6


def test_unseen_category_is_scored(spark, flows):
    model = forest.fit_forest(flows.where("label = 0"), ROLES, trees=20)
    new = spark.createDataFrame([(1, None, None, 0.0, "never seen", 0)], SCHEMA.replace("ts bigint", "ts string"))
    assert -0.5 < model.score(new).first()["score"] <= 0.5


def test_one_class_ranks_outliers(spark, flows):
    model = oneclass.fit_one_class(flows.where("label = 0"), ROLES, tolerance=0.05)
    rows = model.score(flows).select("label", "score").collect()
    bad, good = [r["score"] for r in rows if r["label"]], [r["score"] for r in rows if not r["label"]]
    assert np.mean(bad) > np.quantile(good, 0.9)
    assert np.mean(np.array(good) > 0) < 0.1  # about nu of the fit rows lie outside


def test_one_class_is_near_the_minimum(spark, flows):
    benign = flows.where("label = 0 and flow_row_id < 700")
    nu, model = 0.05, oneclass.fit_one_class(benign, ROLES, nu=0.05, dimensions=32, tolerance=0.02)
    m = model.state["models"]["all"]
    assert m["done"] and m["gap"] <= 0.02
    frame = benign.select(*ROLES.features).toPandas()
    from tidewatch.operators.prep import category_codes

    codes = np.array([r[0] for r in benign.select(*category_codes(ROLES.categorical)).collect()])[:, None]
    values = frame[["a", "b"]].to_numpy()
    values = np.where(np.isnan(values), [model.fills["a"]["all"], model.fills["b"]["all"]], values)
    phi = oneclass._features()(model.state, "all", values, np.c_[codes, np.ones(len(codes), "int64")])
    # the same dual, row by row and without bins, until its own bound is a millionth
    count, atoms = nu * len(phi), [phi.mean(axis=0)]
    for _ in range(400):
        w = oneclass.shortest(np.stack(atoms))
        order = np.argsort(phi @ w)
        full = int(count)
        s = (phi[order[:full]].sum(axis=0) + (count - full) * phi[order[min(full, len(phi) - 1)]]) / count
        if w @ (w - s) <= 1e-6 * (w @ w):
            break
        atoms.append(s)
    exact = -0.5 * w @ w  # the minimum of the objective

    def objective(v, rho):
        return 0.5 * v @ v - rho + np.maximum(0, rho - phi @ v).sum() / count

    assert objective(m["w"], m["rho"]) - exact <= 0.02 * (m["w"] @ m["w"]) + 1e-9
    assert abs(m["w"] @ m["w"] - w @ w) <= 0.04 * (w @ w)


def test_calibrated_detector(spark, flows):
    benign = flows.where("label = 0")
    result = rolling.calibrated_detector(
        benign.where("flow_row_id % 5 <> 1"), benign.where("flow_row_id % 5 = 1"), flows.where("capture_date >= '2023-11-18'"), ROLES,
        lambda rows, roles, group: forest.fit_forest(rows, roles, trees=50, group=group))
    quiet = result["calibration"].agg(F.avg("predicted")).first()[0]
    assert 0.005 <= quiet <= 0.03
    caught = result["test"].where("actual = 1").agg(F.avg("predicted")).first()[0]
    assert caught > 0.9
    table = rolling.prediction_table(result["test"], ROLES, result["threshold"])
    assert table.columns == ["flow_row_id", "capture_date", "true_label", "predicted_label", "anomaly_score", "calibrated_threshold"]


def test_rolling_evaluation(spark, flows):
    result = rolling.rolling_evaluation(flows, ROLES, "ts", lambda rows, roles, group: forest.fit_forest(rows, roles, trees=25, group=group))
    daily = {str(r["test_date"]): r for r in result["daily"].collect()}
    days = sorted(str(r[0]) for r in flows.select("capture_date").distinct().collect())
    assert sorted(daily) == days[1:]
    prior = flows.where("label = 0").where(F.col("capture_date") < days[2]).count()
    assert daily[days[2]]["fit_records"] == int(prior * 0.8) and daily[days[2]]["calibration_records"] == prior - int(prior * 0.8)
    assert result["overall"].first()["recall"] > 0.9


def test_rolling_keeps_days_that_cannot_be_calibrated(spark, flows):
    days = sorted(str(r[0]) for r in flows.select("capture_date").distinct().collect())[:3]
    first = flows.where((F.col("capture_date") == days[0]) & (F.col("label") == 0)).limit(1)
    few = first.unionByName(flows.where(F.col("capture_date").isin(days[1:])))
    result = rolling.rolling_evaluation(few, ROLES, "ts", lambda rows, roles, group: forest.fit_forest(rows, roles, trees=10, group=group))
    daily = {str(r["test_date"]): r for r in result["daily"].collect()}
    assert sorted(daily) == days[1:] and daily[days[1]]["threshold"] is None
    assert daily[days[1]]["benign_test_records"] + daily[days[1]]["malicious_test_records"] == few.where(F.col("capture_date") == days[1]).count()
    assert daily[days[2]]["threshold"] is not None


def test_tree_and_importances(spark, flows):
    model = tree.fit_tree(flows.where("flow_row_id < 1600"), ROLES)
    scored = model.predict(flows.where("flow_row_id >= 1600"))
    assert scored.where("actual <> predicted").count() == 0
    weights = tree.importance_by_column(model.importances())
    assert weights.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    assert {r["feature"] for r in weights.collect()} == {"a", "b", "k"}
    assert {r['name'] for r in model.encoded_names().collect()} == {'a', 'b', 'k_odd', 'k_k0', 'k_k1', 'k_k2'}
    assert {r["features"] for r in tree.ablation(flows, flows, {"all": ROLES, "numbers": ROLES.without("k")}).collect()} == {3, 2}
    daily = rolling.frozen_model_daily(model, flows.where("flow_row_id >= 1600"))
    assert daily["overall"].first()["roc_auc"] == 1.0


@pytest.mark.parametrize("ordered", [False, True])
def test_one_class_sums_only_low_bins(spark, ordered):
    from tidewatch.operators.oneclass import BINS, _features, _lowest, _pass

    rng = np.random.default_rng(11)
    state = {"numeric": rng.standard_normal((1, 16)), "phase": rng.uniform(0, 6, 16), "seed": 1, "categories": 0,
             "models": {"m": {"mean": np.zeros(1), "deviation": np.ones(1), "gamma": 0.5, "w": rng.standard_normal(16) / 4, "reach": 2.0, "done": False}}}
    x = rng.normal(size=20_000)
    mapped = _features()(state, "m", x[:, None], np.zeros((len(x), 0), "int64"))
    scores = mapped @ state["models"]["m"]["w"]
    if ordered:  # all low rows lie in one task, so that the tasks' own counts tell nothing
        x = x[np.argsort(scores)]
    rows = spark.createDataFrame([("m", float(v)) for v in x], "_model string, num_0 double")
    binned = _pass(rows, state, 1, {"m": 0.01}).toPandas()
    assert binned["n"].sum() == len(x)
    assert binned["sums"].notna().sum() < len(binned) / 2
    (total, last, part), = _lowest(rows, state, 1, {"m": 200.0}, {"m": len(x)}).values()
    place = np.clip(((scores + 2.0) / 4.0 * BINS).astype(int), 0, BINS - 1)
    assert (place < last).sum() <= 200 <= (place <= last).sum() and 0 <= part <= 1
    assert total == pytest.approx(mapped[place < last].sum(axis=0) + part * mapped[place == last].sum(axis=0))


def test_one_class_quick_scores_are_near():
    from tidewatch.operators.oneclass import BINS, _added, _categories, _mapped, _quick_places, _added_turns

    rng = np.random.default_rng(5)
    state = {"numeric": rng.standard_normal((3, 128)), "phase": rng.uniform(0, 2 * np.pi, 128), "seed": 1, "categories": 2}
    m = {"mean": np.array([1.0, -5.0, 0.0]), "deviation": np.array([2.0, 0.1, 1.0]), "gamma": 0.3, "w": rng.standard_normal(128) / 50}
    m["reach"] = float(np.linalg.norm(m["w"])) * np.sqrt(2.0)
    values, kinds = rng.normal(size=(3000, 3)) * [6.0, 0.2, 3.0] + m["mean"], rng.integers(-9, 9, (3000, 2))
    values[:4, 0] = 1e9, np.nan, np.inf, -1e300  # no quick score for these
    parts = list(_categories()(state, kinds))
    turns, largest = _added_turns(state, parts, len(kinds))
    with np.errstate(all="ignore"):
        quick = _quick_places(state, m, values, turns, largest)
        mapped = _mapped(state, m, values, _added(state, parts, kinds))
    plain = np.cos(np.sqrt(2 * m["gamma"]) * ((values[4:] - m["mean"]) / m["deviation"] @ state["numeric"] + _added(state, parts, kinds)[4:]) + state["phase"]) * np.sqrt(2 / 128)
    assert np.abs(mapped[4:] - plain).max() < 1e-12
    assert np.isnan(quick[:4]).all() and np.isnan(quick[4:]).mean() < 0.01
    exact = (mapped[4:] @ m["w"] + m["reach"]) / (2 * m["reach"]) * BINS
    assert np.nanmax(np.abs(quick[4:] - exact)) < 1


def test_one_class_of_an_expanding_past(spark, flows, monkeypatch):
    """The models of all folds are those fitted on each fold's own rows, and a row is stored once for all of them."""
    from tidewatch.operators import splits

    kept = {}
    monkeypatch.setattr(oneclass, "stored", lambda table, name, real=oneclass.stored: kept.setdefault(name, real(table, name)) if name == "one-class" else real(table, name))
    days = sorted(str(r[0]) for r in flows.select("capture_date").distinct().collect())[:4]
    benign = rolling.keep(flows.where(F.col("capture_date").cast("string").isin(days)).where("label = 0"), "benign")
    benign = rolling.keep(benign.withColumn("a", F.when(F.col("flow_row_id") % 7 != 0, F.col("a"))), "gaps")
    cutoffs = rolling.keep(splits.fold_cutoffs(benign, splits.fold_dates(benign), "ts", "flow_row_id"), "cuts")
    rows, folds = splits.fit_segments(benign, cutoffs, "ts", "flow_row_id")
    undated = rows.limit(3).withColumns({"capture_date": F.lit(None).cast("date"), "_segment": F.lit(0)})
    merged = oneclass.fit_one_class_prefixes(rows.unionByName(undated), ROLES, "_segment", folds, dimensions=16, tolerance=0.1)
    fitted = rows.where("_segment is not null").count()
    assert kept.pop("one-class").count() == fitted
    past = splits.fold_membership(benign, cutoffs, "ts", "flow_row_id").where("part = 'fit'").withColumn("test_date", F.col("test_date").cast("string"))
    single = oneclass.fit_one_class(past, ROLES, dimensions=16, tolerance=0.1, group="test_date")
    assert merged.fills == single.fills and sorted(merged.state["models"]) == sorted(single.state["models"]) == folds
    for name, m in single.state["models"].items():
        other = merged.state["models"][name]
        assert other["gamma"] == pytest.approx(m["gamma"]) and other["mean"] == pytest.approx(m["mean"]) and other["deviation"] == pytest.approx(m["deviation"])
        assert other["rho"] == pytest.approx(m["rho"]) and other["w"] == pytest.approx(m["w"])
    odd = spark.createDataFrame([(1, None, 0.0, "never seen", folds[0]), (2, 1.0, None, "k1", folds[-1]), (3, 1.0, 2.0, "k1", "no model")], "id int, a double, b double, k string, fold string")
    scores = [{r["id"]: r["score"] for r in model.score(odd, "fold").collect()} for model in (merged, single)]
    assert scores[0][3] is None and scores[1][3] is None
    assert [scores[0][i] for i in (1, 2)] == pytest.approx([scores[1][i] for i in (1, 2)])


def test_merged_moments_of_parts():
    rng = np.random.default_rng(2)
    parts = [rng.normal(1e6, 1, n) for n in (5, 1, 700)]
    described = [(len(x), x.mean(), x.var(), x.min(), x.max()) for x in parts]
    mean, deviation = oneclass._merged(described)
    whole = np.concatenate(parts)
    assert mean == pytest.approx(whole.mean()) and deviation == pytest.approx(whole.std())
    assert oneclass._merged([(3, 0.1 + 1e-17, 1e-34, 0.1, 0.1), (4, 0.1, 0.0, 0.1, 0.1)]) == (0.1, 0.0)
