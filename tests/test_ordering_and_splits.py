from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import evaluation as ev
from tidewatch.operators import splits
from tidewatch.operators import ordering
from tidewatch.operators.ordering import dense_index, quantiles, quantiles_of, value_counts
from tidewatch.operators.prep import fit_imputation, most_frequent, standardize
from tidewatch.roles import Roles

N = 3000


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows share one value, one time and one label."""
    rng = np.random.default_rng(3)
    rows = [(i, 5.0 if i % 3 == 0 else (None if i % 50 == 1 else float(rng.normal())), "hot" if i % 3 == 0 else f"g{i % 4}",
             1_700_000_000 + (0 if i % 3 == 0 else int(rng.integers(0, 900_000))), int(rng.random() < 0.3)) for i in range(N)]
    return rows


def frame_of(spark, rows, partitions):
    frame = spark.createDataFrame(rows, "id bigint, v double, g string, s bigint, y int").withColumn("ts", F.col("s").cast("timestamp"))
    return frame.withColumn("capture_date", F.to_date("ts")).repartition(partitions)


@pytest.mark.parametrize("partitions", [1, 7])
def test_quantiles_match_numpy(spark, skewed, partitions):
    got = quantiles(frame_of(spark, skewed, partitions), ["v"], [0.0, 0.25, 0.5, 0.99, 1.0]).first()
    values = [r[1] for r in skewed if r[1] is not None]
    assert [got[f"all_q{i}"] for i in range(5)] == pytest.approx(list(np.quantile(values, [0.0, 0.25, 0.5, 0.99, 1.0])))
    counted = quantiles_of(value_counts(frame_of(spark, skewed, partitions), ["v"]), ["all"], [0.0, 0.25, 0.5, 0.99, 1.0]).first()
    assert [counted[f"all_q{i}"] for i in range(5)] == [got[f"all_q{i}"] for i in range(5)]
    assert (counted["distinct_values"], counted["largest_count"]) == (len(set(values)), N // 3)


def test_quantiles_of_odd_columns(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = [(g, None if i % 7 == 0 else float(i % 50) - 20, nan if i % 3 == 0 else (inf if i % 11 == 0 else -inf if i % 13 == 0 else float(i)), None) for g in ("a", None) for i in range(400)]
    frame = spark.createDataFrame(rows + [("empty", None, None, None)], "g string, x double, odd double, nothing double")
    shares = [0.0, 0.1, 0.5, 0.75, 1.0]
    for width in (ordering.SKETCH, 20):  # with a coarse sketch as well
        monkeypatch.setattr(ordering, "SKETCH", width)
        got = {(r["g"], r["feature"]): r for r in quantiles(frame, ["x", "odd", "nothing"], shares, ["g"]).collect()}
        assert len(got) == 9 and got[("empty", "x")]["all_n"] == 0 and got[("a", "nothing")]["all_q2"] is None
        for g in ("a", None):
            values = sorted(r[1] for r in rows if r[0] == g and r[1] is not None)
            assert [got[(g, "x")][f"all_q{i}"] for i in range(5)] == pytest.approx(list(np.quantile(values, shares)))
            ordered = sorted((r[2] for r in rows if r[0] == g), key=lambda v: (v != v, v if v == v else 0))
            assert got[(g, "odd")]["all_q0"] == -inf and got[(g, "odd")]["all_q1"] == pytest.approx(ordered[40] - 0.1 * (ordered[40] - ordered[39]))
            assert math.isnan(got[(g, "odd")]["all_q4"]) and got[(g, "odd")]["all_n"] == 400


def test_a_missed_bracket_is_noticed(spark, monkeypatch):
    rows = [(float(i),) for i in range(3000)]
    right, real = list(np.quantile([r[0] for r in rows], [0.3, 0.5])), F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda column, ends, accuracy: real(column, [min(1.0, e + 0.2) for e in ends], accuracy))
    got = quantiles(spark.createDataFrame(rows, "v double"), ["v"], [0.3, 0.5]).first()
    assert [got["all_q0"], got["all_q1"]] == pytest.approx(right)


@pytest.mark.parametrize("partitions", [1, 7])
def test_dense_index(spark, skewed, partitions):
    rows = frame_of(spark, skewed, partitions).where("id % 4 <> 1")
    got = dense_index(rows, "id", "n").select("id", "n").collect()
    assert sorted((r["n"], r["id"]) for r in got) == list(enumerate(i for i in range(N) if i % 4 != 1))


@pytest.mark.parametrize("partitions", [1, 7])
def test_random_split_is_exact_and_repeatable(spark, skewed, partitions):
    got = splits.random_split(frame_of(spark, skewed, partitions), "id", 0.2, strata=["g"]).select("id", "g", "split").collect()
    for g in {r[2] for r in skewed}:
        ids = sorted((hashlib.md5(f"42:{r[0]}".encode()).hexdigest(), r[0]) for r in skewed if r[2] == g)
        expected = {i for _, i in ids[: math.ceil(round(len(ids) * 0.2, 6))]}
        assert {r["id"] for r in got if r["g"] == g and r["split"] == "testing"} == expected


@pytest.mark.parametrize("partitions", [1, 7])
def test_time_split_with_a_hot_time(spark, skewed, partitions):
    order = sorted((r[3], hashlib.md5(str(r[0]).encode()).hexdigest(), r[0]) for r in skewed)
    for share in (0.2, 0.8):  # the first cut lies inside the rows that share one time
        got = splits.time_split(frame_of(spark, skewed, partitions), "ts", "id", share).where("part = 'fit'").select("id").collect()
        assert {r["id"] for r in got} == {i for *_, i in order[: int(N * share)]}


def test_stratum_sample_is_the_global_top(spark, skewed):
    got = splits.stratum_sample(frame_of(spark, skewed, 7), ["g"], "id", 50, lanes=4).select("id", "g").collect()
    for g in {r[2] for r in skewed}:
        ids = sorted((hashlib.md5(f"42:{r[0]}".encode()).hexdigest(), r[0]) for r in skewed if r[2] == g)
        assert {r["id"] for r in got if r["g"] == g} == {i for _, i in ids[:50]}


def test_split_checks(spark, skewed):
    frame, roles = frame_of(spark, skewed, 2), Roles((), (), target="y")
    days = sorted(str(r[0]) for r in frame.select(F.col("capture_date").cast("string")).distinct().collect())
    splits.check_chronological_split(frame, days[:1], days[1:2], roles)
    for train, test in ((days[:1], []), (days[:1], days[:1]), (days[:1], ["1999-01-01"])):
        with pytest.raises(ValueError):
            splits.check_chronological_split(frame, train, test, roles)


def brute_auc(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("partitions", [1, 7])
def test_ranking_metrics_with_ties(spark, skewed, partitions):
    rows = [(r[4], round(r[1] or 0.0, 1)) for r in skewed][:800]
    frame = spark.createDataFrame(rows, "actual int, score double").repartition(partitions)
    got = ev.ranking_metrics(frame).first()
    assert got["roc_auc"] == pytest.approx(brute_auc(rows))
    total, tp, fp, ap = sum(y for y, _ in rows), 0, 0, 0.0
    for s in sorted({s for _, s in rows}, reverse=True):
        here = [y for y, x in rows if x == s]
        tp, fp = tp + sum(here), fp + len(here) - sum(here)
        ap += sum(here) / total * tp / (tp + fp)
    assert got["average_precision"] == pytest.approx(ap)


def test_one_class_has_no_auc(spark):
    frame = spark.createDataFrame([(1, 0.1), (1, 0.2)], "actual int, score double")
    assert ev.ranking_metrics(frame).first()["roc_auc"] is None
    counts = ev.add_rates(ev.confusion(frame.withColumn("predicted", F.lit(0)))).first()
    assert (counts["precision"], counts["recall"], counts["false_positive_rate"]) == (0.0, 0.0, 0.0)


# Published confusion counts and the ratios published with them.
@pytest.mark.parametrize("counts,ratios", [
    ((44183, 6, 21, 34215), (0.999656, 0.999825, 0.999387, 0.999606, 0.000136)),
    ((43847, 342, 34221, 15), (0.559286, 0.042017, 0.000438, 0.000867, 0.007739)),
])
def test_published_counts_give_published_ratios(spark, counts, ratios):
    row = ev.add_rates(spark.createDataFrame([counts], ", ".join(f"{c} bigint" for c in ev.COUNTS)), 6).first()
    assert tuple(row[c] for c in ev.RATES) == ratios


def test_imputation_and_scaling(spark):
    frame = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (3.0, "a"), (10.0, "b"), (None, None)], "x double, c string")
    fitted = fit_imputation(frame, Roles(("x",), ("c",)))
    assert (fitted.numeric["x"], fitted.categorical["c"]) == (2.5, "a")  # ties go to the smallest word
    assert most_frequent(frame, ["c"]).first()["records"] == 2
    scaled = [r["x"] for r in standardize(frame.na.drop(), ["x"]).collect()]
    assert np.mean(scaled) == pytest.approx(0) and np.std(scaled) == pytest.approx(1)
