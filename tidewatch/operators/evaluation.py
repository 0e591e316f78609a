"""Metrics of binary detectors as aggregations; nothing is collected and no global window is used.

Conventions: ``actual`` and ``predicted`` are 0/1, a higher ``score`` is more anomalous. A zero denominator gives
0 in the ratios, and NULL in daily rows without positives and in ROC-AUC with one class.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.cleaning import ratio
from tidewatch.operators.ordering import BUCKET, add_ranges, quantiles, running_totals, split_points

COUNTS = ["true_negatives", "false_positives", "false_negatives", "true_positives"]
RATES = ["accuracy", "precision", "recall", "f1_score", "false_positive_rate"]


def confusion(frame: DataFrame, actual: str = "actual", predicted: str = "predicted", groups: Sequence[str] = ()) -> DataFrame:
    """The four counts per group; both classes always exist."""
    a, p = F.col(actual), F.col(predicted)
    return frame.groupBy(*groups).agg(
        F.count_if((a == 0) & (p == 0)).alias("true_negatives"), F.count_if((a == 0) & (p == 1)).alias("false_positives"),
        F.count_if((a == 1) & (p == 0)).alias("false_negatives"), F.count_if((a == 1) & (p == 1)).alias("true_positives"),
    )


def confusion_table(counts: DataFrame) -> DataFrame:
    """The counts as a labelled 2 x 2 table."""
    def row(name: str, left: str, right: str) -> Column:
        return F.struct(F.lit(name).alias("actual"), F.col(left).alias("predicted_benign"), F.col(right).alias("predicted_malicious"))

    return counts.select(F.inline(F.array(
        row("actual_benign", "true_negatives", "false_positives"), row("actual_malicious", "false_negatives", "true_positives"),
    )))


def add_rates(counts: DataFrame, digits: int | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1 and false-positive rate next to the counts."""
    tn, fp, fn, tp = (F.col(c) for c in COUNTS)
    values = {
        "accuracy": ratio(tp + tn, tn + fp + fn + tp), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn),
        "f1_score": ratio(2 * tp, 2 * tp + fp + fn), "false_positive_rate": ratio(fp, fp + tn),
    }
    return counts.withColumns({n: v if digits is None else F.round(v, digits) for n, v in values.items()})


def score_curve(frame: DataFrame, actual: str = "actual", score: str = "score", groups: Sequence[str] = ()) -> DataFrame:
    """Per distinct score (and group): positives, negatives, and both totals for scores at or above it."""
    scored = frame.select(*groups, (-F.col(score).cast("double")).alias("_down"), F.col(actual).alias("_y"))
    points = split_points(scored, ["_down"])
    merged = scored.groupBy(*groups, "_down").agg(
        F.count_if(F.col("_y") == 1).alias("positives"), F.count_if(F.col("_y") == 0).alias("negatives")
    )
    cut = add_ranges(merged, points, [BUCKET])
    totals = running_totals(cut, [F.col("_down")], {"tp": "positives", "fp": "negatives"}, groups)
    return totals.withColumn("score", -F.col("_down")).drop("_down", BUCKET)


def _ranking(groups: Sequence[str], curve: DataFrame) -> DataFrame:
    tp, fp, pos, neg = (F.col(c).cast("double") for c in ("tp", "fp", "positives", "negatives"))
    sums = curve.groupBy(*groups).agg(
        F.sum(neg * (tp - pos / 2)).alias("_area"), F.sum(pos * F.try_divide(tp, tp + fp)).alias("_steps"),
        F.sum(pos).alias("_p"), F.sum(neg).alias("_n"),
    )
    return sums.select(
        *groups,
        F.try_divide(F.col("_area"), F.nullif(F.col("_p") * F.col("_n"), F.lit(0.0))).alias("roc_auc"),
        F.try_divide(F.col("_steps"), F.nullif(F.col("_p"), F.lit(0.0))).alias("average_precision"),
    )


def ranking_metrics(frame: DataFrame, actual: str = "actual", score: str = "score", groups: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC (ties count half; NULL with one class) and average precision (step sum)."""
    return _ranking(groups, score_curve(frame, actual, score, groups))


def roc_points(frame: DataFrame, actual: str = "actual", score: str = "score") -> DataFrame:
    """False and true positive rate per distinct score, and the origin (threshold NULL)."""
    curve = score_curve(frame, actual, score)
    sizes = frame.agg(F.count_if(F.col(actual) == 1).alias("_p"), F.count_if(F.col(actual) == 0).alias("_n"))
    points = curve.join(F.broadcast(sizes)).select(  # one row on the right
        F.col("score").alias("threshold"), ratio(F.col("fp"), F.col("_n")).alias("fpr"), ratio(F.col("tp"), F.col("_p")).alias("tpr")
    )
    origin = sizes.select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def class_report(counts: DataFrame, names: Sequence[str] = ("0", "1")) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted average."""
    tn, fp, fn, tp = (F.col(c) for c in COUNTS)
    real = [tn + fp, fn + tp]
    per_class = [
        (ratio(tn, tn + fn), ratio(tn, tn + fp), ratio(2 * tn, 2 * tn + fn + fp)),
        (ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn)),
    ]
    everything = tn + fp + fn + tp
    accuracy = ratio(tn + tp, everything)
    rows = [(F.lit(n), *m, s) for n, m, s in zip(names, per_class, real)]
    rows.append((F.lit("accuracy"), accuracy, accuracy, accuracy, everything))
    macro = [(a + b) / 2 for a, b in zip(*per_class)]
    weighted = [ratio(a * real[0] + b * real[1], everything) for a, b in zip(*per_class)]
    rows += [(F.lit("macro avg"), *macro, everything), (F.lit("weighted avg"), *weighted, everything)]
    fields = ("class", "precision", "recall", "f1_score", "support")
    return counts.select(F.inline(F.array(*[F.struct(*[v.alias(f) for v, f in zip(row, fields)]) for row in rows])))


def daily_metrics(frame: DataFrame, days: DataFrame, date: str = "capture_date", actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """One row per listed day: NULLs for a day without rows; only accuracy for a day without positives."""
    counted = add_rates(confusion(frame, actual, predicted, [date]))
    has_positives = (F.col("true_positives") + F.col("false_negatives")) > 0
    shown = counted.select(date, "accuracy", *[
        F.when(has_positives, F.col(c)).alias(c) for c in ("precision", "recall", "f1_score")
    ])
    return days.select(date).join(F.broadcast(shown), date, "left")  # one row per day on both sides


def flag_summary(counts: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in COUNTS)
    return counts.select(
        (fp + tp).alias("predicted_anomalies"), ratio(fp + tp, tn + fp + fn + tp).alias("predicted_anomaly_rate"),
        fp.alias("benign_flagged"), tp.alias("malicious_detected"),
    )


def score_diagnostics(frame: DataFrame, group: str, score: str, threshold: float) -> DataFrame:
    """Per group: rows, exact median, mean, and share of scores at or above the threshold (0 for no rows)."""
    middle = quantiles(frame, [score], [0.5], groups=[group]).select(group, F.col("all_q0").alias("median_score"))
    plain = frame.groupBy(group).agg(
        F.count("*").alias("records"), F.avg(score).alias("mean_score"),
        ratio(F.count_if(F.col(score) >= threshold), F.count("*")).alias("share_at_threshold"),
    )
    return plain.join(F.broadcast(middle), group, "left")  # one row per group


def quantile_threshold(frame: DataFrame, score: str, share: float = 0.99) -> float:
    """The calibrated threshold as a number; exact, linear interpolation."""
    return quantiles(frame, [score], [share]).first()["all_q0"]


def flag_at(frame: DataFrame, score: str, threshold: float, output: str = "predicted") -> DataFrame:
    return frame.withColumn(output, (F.col(score) >= F.lit(threshold)).cast("int"))


def calibration_summary(calibration: DataFrame, score: str, share: float = 0.99) -> DataFrame:
    """Threshold, the share of calibration rows it flags, and how many rows it was taken from; one row."""
    limit = quantiles(calibration, [score], [share]).select(F.col("all_q0").alias("threshold"))
    flagged = calibration.join(F.broadcast(limit)).groupBy("threshold").agg(  # one row on the right
        F.count("*").alias("calibration_records"), F.count_if(F.col(score) >= F.col("threshold")).alias("flagged")
    )
    return flagged.withColumn("flag_rate", ratio(F.col("flagged"), F.col("calibration_records")))


def score_histogram(frame: DataFrame, group: str, score: str, bins: int = 50) -> DataFrame:
    """Per group: ``bins`` equal bins over its own range, with count and density; empty bins included."""
    span = frame.groupBy(group).agg(F.min(score).alias("_a"), F.max(score).alias("_b"), F.count(score).alias("_n"))
    flat = F.col("_a") == F.col("_b")
    span = span.select(
        group, "_n", F.when(flat, F.col("_a") - 0.5).otherwise(F.col("_a")).alias("_low"),
        F.when(flat, F.col("_b") + 0.5).otherwise(F.col("_b")).alias("_high"),
    ).withColumn("_width", (F.col("_high") - F.col("_low")) / bins)
    placed = frame.where(F.col(score).isNotNull()).join(F.broadcast(span), group).select(
        group,
        F.least(F.floor((F.col(score) - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins), F.lit(bins - 1)).cast("int").alias("bin"),
    ).groupBy(group, "bin").agg(F.count("*").alias("_c"))
    frame_of_bins = span.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return frame_of_bins.join(F.broadcast(placed), [group, "bin"], "left").select(  # groups x bins rows
        group, "bin", (F.col("_low") + F.col("bin") * F.col("_width")).alias("low"),
        F.coalesce("_c", F.lit(0)).alias("count"),
        F.try_divide(F.coalesce("_c", F.lit(0)).cast("double"), F.col("_n") * F.col("_width")).alias("density"),
    )


def model_comparison(frame: DataFrame, model: str = "model", actual: str = "actual", predicted: str = "predicted", score: str = "score") -> DataFrame:
    """Eleven metrics per model from one long table of predictions."""
    counted = add_rates(confusion(frame, actual, predicted, [model]))
    ranked = ranking_metrics(frame, actual, score, [model])
    return counted.join(F.broadcast(ranked), model).select(model, *RATES, "roc_auc", "average_precision", *COUNTS)


def long_metrics(wide: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """A one-row table as (metric, value); ``names`` maps metric name to column."""
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for m, c in names.items()
    ])))


def compare_long_metrics(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """Two long metric tables side by side (a handful of rows each)."""
    return left.withColumnRenamed("value", left_name).join(
        F.broadcast(right.withColumnRenamed("value", right_name)), "metric", "inner"
    )


def metric_value(metrics: DataFrame, name: str) -> DataFrame:
    return metrics.where(F.col("metric") == name)


def family_performance(frame: DataFrame, family: str, date: str = "capture_date", predicted: str = "predicted") -> DataFrame:
    """Malicious rows per day and family: records, detected, missed, recall. ``frame`` holds malicious rows only."""
    counts = frame.groupBy(date, F.coalesce(F.col(family), F.lit("unspecified")).alias("attack_family")).agg(
        F.count("*").alias("malicious_records"), F.count_if(F.col(predicted) == 1).alias("detected")
    )
    return _with_recall(counts)


def _with_recall(counts: DataFrame) -> DataFrame:
    return counts.withColumns({
        "missed": F.col("malicious_records") - F.col("detected"),
        "recall": ratio(F.col("detected"), F.col("malicious_records")),
    })


def family_overall(per_day: DataFrame) -> DataFrame:
    counts = per_day.groupBy("attack_family").agg(
        F.sum("malicious_records").alias("malicious_records"), F.sum("detected").alias("detected")
    )
    return _with_recall(counts)


def family_recall(overall: DataFrame) -> DataFrame:
    """Macro recall over families and record-weighted recall."""
    return overall.agg(
        F.avg("recall").alias("macro_recall"), ratio(F.sum("detected"), F.sum("malicious_records")).alias("weighted_recall")
    )


def pooled(per_fold: DataFrame) -> DataFrame:
    """Metrics over the rows of all folds together, from their summed counts."""
    return add_rates(per_fold.agg(*[F.sum(c).alias(c) for c in COUNTS]))
