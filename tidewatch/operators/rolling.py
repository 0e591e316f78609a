"""Calibrated, rolling and comparative evaluation of the detectors.

Scores are expensive, so each evaluation writes them once to the shared folder and reads metrics from there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.cleaning import ratio
from tidewatch.operators import evaluation as ev
from tidewatch.operators import splits
from tidewatch.operators.forest import automatic_flag
from tidewatch.operators.ordering import quantiles
from tidewatch.operators.profile import union_all
from tidewatch.operators.tree import TreeModel
from tidewatch.roles import Roles
from tidewatch.sources.tables import stored

# a fit function takes (rows, roles, group column or None) and returns a model with .score(frame, group)
Fit = Callable[[DataFrame, Roles, str | None], object]
# a prefix fit takes (rows, roles, segment column, folds): a row belongs to its segment's fold and all later ones
PrefixFit = Callable[[DataFrame, Roles, str, Sequence[str]], object]


keep = stored


def prediction_table(scored: DataFrame, roles: Roles, threshold: float | None = None, probability: bool = False) -> DataFrame:
    """(row id[, date], true, predicted, probability or score[, threshold]) sorted by id; a range sort, not one file."""
    columns = [F.col(roles.row_id)]
    if not probability:
        columns.append(F.col(roles.date))
    columns += [F.col("actual").alias("true_label"), F.col("predicted").alias("predicted_label")]
    columns.append(F.col("score").alias("predicted_probability" if probability else "anomaly_score"))
    if threshold is not None:
        columns.append(F.lit(threshold).alias("calibrated_threshold"))
    return scored.select(*columns).orderBy(roles.row_id)


def calibrated_detector(benign_fit: DataFrame, calibration: DataFrame, test: DataFrame, roles: Roles, fit: Fit, share: float = 0.99) -> dict:
    """Fit on benign rows, take the threshold from other benign rows, flag the test rows.

    Returns the threshold and the kept tables ``calibration`` and ``test`` (with actual, score, predicted and the
    automatic flag).
    """
    model = fit(benign_fit, roles, None)
    kept = [roles.row_id, roles.date, F.col(roles.target).cast("int").alias("actual"), "score", "part"]
    parts = calibration.withColumn("part", F.lit("calibrate")).unionByName(test.withColumn("part", F.lit("test")))
    scored = keep(model.score(parts, None).select(*kept), "scores")
    quiet = scored.where(F.col("part") == "calibrate")
    threshold = ev.quantile_threshold(quiet, "score", share)
    flagged = ev.flag_at(scored, "score", threshold).withColumn("automatic", automatic_flag(F.col("score")))
    return {
        "model": model, "threshold": threshold, "share": share, "scores": flagged,
        "calibration": flagged.where(F.col("part") == "calibrate"), "test": flagged.where(F.col("part") == "test"),
    }


def rolling_evaluation(flows: DataFrame, roles: Roles, ts: str, fit: Fit, share: float = 0.99, prefix_fit: PrefixFit | None = None) -> dict[str, DataFrame]:
    """Daily re-fit on the expanding benign past, calibrate on its last fifth, test on the next day.

    All folds are fitted and scored in the same jobs; a fold is a key, not a loop over rows. Fit rows of a fold are fit rows of the next
    one; ``prefix_fit`` makes use of that and reads every row once, where ``fit`` needs a copy of it for every later fold.
    """
    fold = "test_date"
    # Kept once at its own size; the (larger) fold rows are derived from it in every pass and never stored.
    # Spread by id first, because each row becomes one row per later fold: uneven input would multiply.
    width = int(flows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = flows.select(roles.row_id, ts, roles.date, roles.target, *roles.features)
    flows = keep(slim.repartition(width, roles.row_id), "flows")
    folds = keep(splits.fold_dates(flows, roles.date), "folds")
    benign = flows.where(F.col(roles.target) == 0)
    cutoffs = keep(splits.fold_cutoffs(benign, folds, ts, roles.row_id, roles.date), "cutoffs")
    past = splits.fold_membership(benign, cutoffs, ts, roles.row_id, roles.date)
    today = flows.join(F.broadcast(folds), F.col(roles.date) == F.col(fold)).withColumn("part", F.lit("test"))  # one row per day
    rows = past.unionByName(today).withColumn(fold, F.col(fold).cast("string"))
    nested = splits.fit_segments(benign, cutoffs, ts, roles.row_id, roles.date) if prefix_fit else None
    if nested:
        model = prefix_fit(nested[0], roles, "_segment", nested[1])
    else:
        model = fit(rows.where(F.col("part") == "fit"), roles, fold)
    to_score = rows.where(F.col("part") != "fit")
    kept = [fold, "part", roles.row_id, roles.date, F.col(roles.target).cast("int").alias("actual"), "score"]
    scored = keep(model.score(to_score, fold).select(*kept), "rolling")
    limits = quantiles(scored.where(F.col("part") == "calibrate"), ["score"], [share], [fold]).select(
        fold, F.col("all_q0").alias("threshold"), F.col("all_n").alias("calibration_records")
    )
    # one row per fold; a fold without calibration rows keeps its test rows, with neither threshold nor prediction
    tested = scored.where(F.col("part") == "test").join(F.broadcast(limits), fold, "left")
    flagged = tested.withColumn("predicted", (F.col("score") >= F.col("threshold")).cast("int"))
    counts = ev.confusion(flagged, groups=[fold])
    fitted = rows.where(F.col("part") == "fit").groupBy(fold).agg(F.count("*").alias("fit_records"))
    ranked = ev.ranking_metrics(flagged, groups=[fold]).select(fold, "roc_auc")
    daily = ev.add_rates(counts)
    sizes = flagged.groupBy(fold).agg(F.count_if(F.col("actual") == 0).alias("benign_test_records"), F.count_if(F.col("actual") == 1).alias("malicious_test_records"))
    for small in (limits, fitted, ranked, sizes):  # one row per fold
        daily = daily.join(F.broadcast(small), fold, "left")
    return {"daily": daily, "overall": ev.pooled(counts), "predictions": flagged}


def frozen_model_daily(model: TreeModel, later: DataFrame) -> dict[str, DataFrame]:
    """One model on every later day and on all of them: one scoring pass, then metrics per day."""
    scored = keep(model.predict(later), "frozen")
    date = model.roles.date
    daily = ev.add_rates(ev.confusion(scored, groups=[date]))
    daily = daily.join(F.broadcast(ev.ranking_metrics(scored, groups=[date]).select(date, "roc_auc")), date, "left")  # one row per day
    whole = scored.withColumn("model", F.lit("all later days"))
    return {"daily": daily, "overall": ev.model_comparison(whole), "predictions": scored}


def as_model(scored: DataFrame, name: str, predicted: str = "predicted") -> DataFrame:
    return scored.select(F.lit(name).alias("model"), "actual", F.col(predicted).alias("predicted"), "score")


def common_test_comparison(predictions: Sequence[DataFrame]) -> DataFrame:
    """Eleven metrics per model on the same test rows, in one pass over the stacked predictions."""
    return ev.model_comparison(union_all(predictions))


def detector_report(result: dict, fit_records: int, train: DataFrame, target: str) -> DataFrame:
    """The calibrated detector's long metric table: split sizes, threshold, rates, counts and flags."""
    sizes = splits.fit_frame_counts(train, target)
    counted = ev.add_rates(ev.confusion(result["test"]))
    flags = ev.flag_summary(ev.confusion(result["test"]))
    ranked = ev.ranking_metrics(result["test"])
    quiet = result["calibration"].agg(
        F.count("*").alias("calibration_records"), ratio(F.count_if(F.col("predicted") == 1), F.count("*")).alias("calibration_rate")
    )
    wide = sizes.join(F.broadcast(counted)).join(F.broadcast(flags)).join(F.broadcast(ranked)).join(F.broadcast(quiet))  # one row each
    wide = wide.withColumns({
        "fit_records": F.lit(fit_records), "threshold": F.lit(result["threshold"]), "quantile": F.lit(result["share"]),
        "test_benign": F.col("true_negatives") + F.col("false_positives"), "test_malicious": F.col("false_negatives") + F.col("true_positives"),
    })
    return ev.long_metrics(wide, REPORT)


# Metric names of the detector report and the columns they come from.
REPORT = {
    "total_chronological_train_records": "train_records", "benign_train_records_total": "benign_records",
    "benign_fit_records_used_for_if_training": "fit_records", "benign_calibration_records": "calibration_records",
    "malicious_train_records_excluded": "malicious_excluded", "calibrated_threshold": "threshold",
    "calibration_quantile": "quantile", "calibration_anomaly_rate": "calibration_rate", "test_benign_count": "test_benign",
    "test_malicious_count": "test_malicious", "test_accuracy": "accuracy", "test_precision": "precision",
    "test_recall": "recall", "test_f1_score": "f1_score", "test_false_positive_rate": "false_positive_rate",
    "test_roc_auc": "roc_auc", "true_negatives": "true_negatives", "false_positives": "false_positives",
    "false_negatives": "false_negatives", "true_positives": "true_positives", "predicted_anomalies": "predicted_anomalies",
    "predicted_anomaly_rate": "predicted_anomaly_rate", "benign_test_flagged_as_anomaly": "benign_flagged",
    "malicious_test_detected": "malicious_detected",
}
