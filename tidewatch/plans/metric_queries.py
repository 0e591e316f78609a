"""Metric queries: a plain flow column plays the score, so every number can be checked by SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.cleaning import label_code
from tidewatch.operators import evaluation as ev
from tidewatch.plans.bindings import TEST_DATES
from tidewatch.plans.catalog import query
from tidewatch.roles import CLASS_CODES

PRED = """pred AS (SELECT flow_row_id, capture_date, detailedlabel, CASE label WHEN 'Malicious' THEN 1 ELSE 0 END AS actual,
  resp_bytes AS score, CASE WHEN resp_bytes >= 90 THEN 1 ELSE 0 END AS predicted, duration
  FROM flow_v WHERE label IN ('Benign', 'Malicious'))"""


def conf(groups: str = "", source: str = "pred") -> str:
    head = f"{groups}, " if groups else ""
    tail = f" GROUP BY {groups}" if groups else ""
    return f"""SELECT {head}count(*) FILTER (actual = 0 AND predicted = 0) AS true_negatives,
  count(*) FILTER (actual = 0 AND predicted = 1) AS false_positives, count(*) FILTER (actual = 1 AND predicted = 0) AS false_negatives,
  count(*) FILTER (actual = 1 AND predicted = 1) AS true_positives FROM {source}{tail}"""


def div(a: str, b: str) -> str:
    return f"round(coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0), 6)"


TN, FP, FN, TP = ev.COUNTS
RATE_SQL = {
    "accuracy": div(f"({TP} + {TN})", f"({TN} + {FP} + {FN} + {TP})"), "precision": div(TP, f"({TP} + {FP})"),
    "recall": div(TP, f"({TP} + {FN})"), "f1_score": div(f"(2 * {TP})", f"(2 * {TP} + {FP} + {FN})"),
    "false_positive_rate": div(FP, f"({FP} + {TN})"),
}
RATES_LIST = ", ".join(f"{v} AS {k}" for k, v in RATE_SQL.items())
CURVE = """hist AS (SELECT score, count(*) FILTER (actual = 1) AS positives, count(*) FILTER (actual = 0) AS negatives FROM pred GROUP BY score),
curve AS (SELECT *, sum(positives) OVER (ORDER BY score DESC) AS tp, sum(negatives) OVER (ORDER BY score DESC) AS fp FROM hist)"""
AUC = "round(CAST(sum(negatives * (tp - positives / 2e0)) AS DOUBLE) / (sum(positives) * sum(negatives)), 6)"
AP = "round(CAST(sum(positives * (CAST(tp AS DOUBLE) / (tp + fp))) AS DOUBLE) / sum(positives), 6)"
COMPARED = """pred3 AS (SELECT 'by_resp_bytes' AS model, actual, predicted, score FROM pred
UNION ALL SELECT 'by_duration', actual, CASE WHEN coalesce(duration, 0) >= 20 THEN 1 ELSE 0 END, coalesce(duration, 0) FROM pred
UNION ALL SELECT 'by_orig', actual, CASE WHEN flow_row_id % 1000 >= 500 THEN 1 ELSE 0 END, flow_row_id % 1000 FROM pred),
hist3 AS (SELECT model, score, count(*) FILTER (actual = 1) AS positives, count(*) FILTER (actual = 0) AS negatives FROM pred3 GROUP BY ALL),
curve3 AS (SELECT *, sum(positives) OVER (PARTITION BY model ORDER BY score DESC) AS tp, sum(negatives) OVER (PARTITION BY model ORDER BY score DESC) AS fp FROM hist3)"""


def predictions(t) -> DataFrame:
    binary = t.flow_v.where(F.col("label").isin(*CLASS_CODES))
    return binary.select(
        "flow_row_id", "capture_date", "detailedlabel", label_code(F.col("label"), CLASS_CODES).alias("actual"),
        F.col("resp_bytes").alias("score"), (F.col("resp_bytes") >= 90).cast("int").alias("predicted"), "duration",
    )


def rounded(frame: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    names = columns or [n for n, kind in frame.dtypes if kind == "double"]
    return frame.withColumns({c: F.round(F.col(c), digits) for c in names})


@query("met1_confusion", f"WITH {PRED} {conf()}")
def _(t):
    return ev.confusion(predictions(t))


@query("met1_confusion_table", f"""WITH {PRED}, c AS ({conf()})
SELECT 'actual_benign' AS actual, {TN} AS predicted_benign, {FP} AS predicted_malicious FROM c
UNION ALL SELECT 'actual_malicious', {FN}, {TP} FROM c""")
def _(t):
    return ev.confusion_table(ev.confusion(predictions(t)))


@query("met2_rates", f"WITH {PRED}, c AS ({conf()}) SELECT *, {RATES_LIST} FROM c")
def _(t):
    return ev.add_rates(ev.confusion(predictions(t)), 6)


@query("met3_roc_auc", f"WITH {PRED}, {CURVE} SELECT {AUC} AS roc_auc FROM curve")
def _(t):
    return rounded(ev.ranking_metrics(predictions(t)).select("roc_auc"))


@query("met3_roc_auc_continuous", f"""WITH {PRED.replace('resp_bytes AS score', 'coalesce(duration, 0) AS score')}, {CURVE}
SELECT {AUC} AS roc_auc, {AP} AS average_precision FROM curve""")
def _(t):
    scored = predictions(t).withColumn("score", F.coalesce("duration", F.lit(0.0)))
    return rounded(ev.ranking_metrics(scored))


@query("met3_daily_roc_auc", f"""WITH {PRED},
hist AS (SELECT capture_date, score, count(*) FILTER (actual = 1) AS positives, count(*) FILTER (actual = 0) AS negatives FROM pred GROUP BY ALL),
curve AS (SELECT *, sum(positives) OVER w AS tp, sum(negatives) OVER w AS fp FROM hist WINDOW w AS (PARTITION BY capture_date ORDER BY score DESC))
SELECT capture_date, {AUC.replace('(sum(positives) * sum(negatives))', 'nullif(sum(positives) * sum(negatives), 0)')} AS roc_auc
FROM curve GROUP BY capture_date""")
def _(t):
    return rounded(ev.ranking_metrics(predictions(t), groups=["capture_date"]).select("capture_date", "roc_auc"))


@query("met4_average_precision", f"WITH {PRED}, {CURVE} SELECT {AP} AS average_precision FROM curve")
def _(t):
    return rounded(ev.ranking_metrics(predictions(t)).select("average_precision"))


REPORT_ROWS = [
    ("'0'", div(TN, f"({TN} + {FN})"), div(TN, f"({TN} + {FP})"), div(f"(2 * {TN})", f"(2 * {TN} + {FN} + {FP})"), f"{TN} + {FP}"),
    ("'1'", RATE_SQL["precision"], RATE_SQL["recall"], RATE_SQL["f1_score"], f"{FN} + {TP}"),
    ("'accuracy'", RATE_SQL["accuracy"], RATE_SQL["accuracy"], RATE_SQL["accuracy"], f"{TN} + {FP} + {FN} + {TP}"),
]


@query("met5_class_report", f"""WITH {PRED}, c AS ({conf()}),
x AS (SELECT *, CAST({TN} AS DOUBLE) / ({TN} + {FN}) AS p0, CAST({TN} AS DOUBLE) / ({TN} + {FP}) AS r0, 2e0 * {TN} / (2 * {TN} + {FN} + {FP}) AS f0,
  CAST({TP} AS DOUBLE) / ({TP} + {FP}) AS p1, CAST({TP} AS DOUBLE) / ({TP} + {FN}) AS r1, 2e0 * {TP} / (2 * {TP} + {FP} + {FN}) AS f1,
  {TN} + {FP} AS n0, {FN} + {TP} AS n1 FROM c)
""" + " UNION ALL ".join(
    f"SELECT {n} AS class, {p} AS precision, {r} AS recall, {f} AS f1_score, {s} AS support FROM x" for n, p, r, f, s in REPORT_ROWS
) + """ UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), n0 + n1 FROM x
UNION ALL SELECT 'weighted avg', round((p0 * n0 + p1 * n1) / (n0 + n1), 6), round((r0 * n0 + r1 * n1) / (n0 + n1), 6),
  round((f0 * n0 + f1 * n1) / (n0 + n1), 6), n0 + n1 FROM x""")
def _(t):
    return rounded(ev.class_report(ev.confusion(predictions(t))))


@query("met6_roc_points", f"""WITH {PRED}, {CURVE}
SELECT score AS threshold, round(CAST(fp AS DOUBLE) / (SELECT sum(negatives) FROM hist), 6) AS fpr,
  round(CAST(tp AS DOUBLE) / (SELECT sum(positives) FROM hist), 6) AS tpr FROM curve
UNION ALL SELECT NULL, 0e0, 0e0""")
def _(t):
    return rounded(ev.roc_points(predictions(t)), "fpr", "tpr")


def days_of(t, days) -> DataFrame:
    return t.spark.createDataFrame([(d,) for d in days], "capture_date string").select(F.col("capture_date").cast("date"))


@query("met7_daily_metrics", f"""WITH {PRED}, c AS ({conf('capture_date')}),
d AS (SELECT * FROM (VALUES {', '.join(f"(DATE '{d}')" for d in [*TEST_DATES, '2024-02-15'])}) AS v(capture_date))
SELECT d.capture_date, {RATE_SQL['accuracy'].replace('coalesce(', '(CASE WHEN c.capture_date IS NOT NULL THEN 1 END) * coalesce(')} AS accuracy,
""" + ", ".join(
    f"CASE WHEN {TP} + {FN} > 0 THEN {RATE_SQL[c]} END AS {c}" for c in ("precision", "recall", "f1_score")
) + " FROM d LEFT JOIN c ON c.capture_date = d.capture_date")
def _(t):
    # the last listed day has no rows
    return rounded(ev.daily_metrics(predictions(t), days_of(t, [*TEST_DATES, "2024-02-15"])))


@query("met8_flag_summary", f"""WITH {PRED}, c AS ({conf()}) SELECT {FP} + {TP} AS predicted_anomalies,
  {div(f'({FP} + {TP})', f'({TN} + {FP} + {FN} + {TP})')} AS predicted_anomaly_rate, {FP} AS benign_flagged, {TP} AS malicious_detected FROM c""")
def _(t):
    return rounded(ev.flag_summary(ev.confusion(predictions(t))))


@query("met9_score_diagnostics", f"""WITH {PRED} SELECT actual, count(*) AS records, round(quantile_cont(s, 0.5), 6) AS median_score,
  round(avg(s), 6) AS mean_score, round(count(*) FILTER (s >= 30) / CAST(count(*) AS DOUBLE), 6) AS share_at_threshold
FROM (SELECT actual, coalesce(duration, 0) AS s FROM pred) p GROUP BY actual""")
def _(t):
    scored = predictions(t).withColumn("s", F.coalesce("duration", F.lit(0.0)))
    return rounded(ev.score_diagnostics(scored, "actual", "s", 30.0))


@query("met10_score_histogram", f"""WITH {PRED},
span AS (SELECT actual, min(score) AS a, max(score) AS b, count(score) AS n FROM pred GROUP BY actual),
placed AS (SELECT p.actual, CAST(least(floor((score - a) / (b - a) * 50), 49) AS INTEGER) AS bin, count(*) AS c
  FROM pred p JOIN span s ON s.actual = p.actual GROUP BY 1, 2)
SELECT s.actual, CAST(bins.bin AS INTEGER) AS bin, round(a + bins.bin * ((b - a) / 50), 6) AS low, coalesce(c, 0) AS count,
  round(coalesce(c, 0) / (n * ((b - a) / 50)), 6) AS density
FROM span s CROSS JOIN (SELECT unnest(range(50)) AS bin) bins LEFT JOIN placed p ON p.actual = s.actual AND p.bin = bins.bin""")
def _(t):
    return rounded(ev.score_histogram(predictions(t), "actual", "score"))


def compared(t) -> DataFrame:
    base = predictions(t)
    long = F.inline(F.array(
        F.struct(F.lit("by_resp_bytes").alias("model"), F.col("score").alias("s"), (F.col("score") >= 90).alias("p")),
        F.struct(F.lit("by_duration").alias("model"), F.coalesce("duration", F.lit(0.0)).alias("s"), (F.coalesce("duration", F.lit(0.0)) >= 20).alias("p")),
        F.struct(F.lit("by_orig").alias("model"), (F.col("flow_row_id") % 1000).cast("double").alias("s"), (F.col("flow_row_id") % 1000 >= 500).alias("p")),
    ))
    return base.select("actual", long).select("model", "actual", F.col("p").cast("int").alias("predicted"), F.col("s").alias("score"))


@query("met11_model_comparison", f"""WITH {PRED}, {COMPARED}, c AS ({conf('model', 'pred3')}),
r AS (SELECT model, {AUC} AS roc_auc, {AP} AS average_precision FROM curve3 GROUP BY model)
SELECT c.*, {RATES_LIST}, roc_auc, average_precision FROM c JOIN r ON r.model = c.model""")
def _(t):
    return rounded(ev.model_comparison(compared(t)))


FAMILY = """fam AS (SELECT capture_date, coalesce(detailedlabel, 'unspecified') AS attack_family, count(*) AS malicious_records,
  count(*) FILTER (predicted = 1) AS detected FROM pred WHERE actual = 1 GROUP BY 1, 2),
total AS (SELECT attack_family, CAST(sum(malicious_records) AS BIGINT) AS malicious_records, CAST(sum(detected) AS BIGINT) AS detected FROM fam GROUP BY 1)"""


def malicious(t) -> DataFrame:
    return predictions(t).where("actual = 1")


@query("met12_family_performance", f"""WITH {PRED}, {FAMILY} SELECT *, malicious_records - detected AS missed,
  round(CAST(detected AS DOUBLE) / malicious_records, 6) AS recall FROM fam""")
def _(t):
    return rounded(ev.family_performance(malicious(t), "detailedlabel"))


@query("met13_family_overall", f"""WITH {PRED}, {FAMILY} SELECT *, malicious_records - detected AS missed,
  round(CAST(detected AS DOUBLE) / malicious_records, 6) AS recall FROM total""")
def _(t):
    return rounded(ev.family_overall(ev.family_performance(malicious(t), "detailedlabel")))


@query("met13_family_recall", f"""WITH {PRED}, {FAMILY} SELECT round(avg(CAST(detected AS DOUBLE) / malicious_records), 6) AS macro_recall,
  round(CAST(sum(detected) AS DOUBLE) / sum(malicious_records), 6) AS weighted_recall FROM total""")
def _(t):
    return rounded(ev.family_recall(ev.family_overall(ev.family_performance(malicious(t), "detailedlabel"))))


LONG = {"test_accuracy": "accuracy", "test_precision": "precision", "test_recall": "recall", "test_f1_score": "f1_score",
        "test_false_positive_rate": "false_positive_rate", TN: TN, FP: FP, FN: FN, TP: TP}


def long_table(t, limit: int) -> DataFrame:
    flagged = predictions(t).withColumn("predicted", (F.col("score") >= limit).cast("int"))
    return rounded(ev.long_metrics(ev.add_rates(ev.confusion(flagged)), LONG))


def long_sql(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {RATE_SQL.get(c, f'CAST({c} AS DOUBLE)')} AS value FROM {source}" for m, c in LONG.items())


@query("met14_long_metrics", f"WITH {PRED}, c AS ({conf()}) {long_sql('c')}")
def _(t):
    return long_table(t, 90)


@query("met14_metric_lookup", f"WITH {PRED}, c AS ({conf()}) SELECT * FROM ({long_sql('c')}) m WHERE metric = 'test_recall'")
def _(t):
    return ev.metric_value(long_table(t, 90), "test_recall")


@query("met14_default_and_calibrated", f"""WITH {PRED}, half AS (SELECT * REPLACE (CASE WHEN score >= 50 THEN 1 ELSE 0 END AS predicted) FROM pred),
c AS ({conf()}), d AS ({conf(source='half')})
SELECT a.metric, a.value AS default_value, b.value AS calibrated_value FROM ({long_sql('d')}) a JOIN ({long_sql('c')}) b ON b.metric = a.metric""")
def _(t):
    return ev.compare_long_metrics(long_table(t, 50), long_table(t, 90), "default_value", "calibrated_value")


@query("met15_pooled_folds", f"""WITH {PRED}, f AS ({conf('capture_date', "pred WHERE capture_date > DATE '2024-01-01'")}),
c AS (SELECT {', '.join(f'CAST(sum({k}) AS BIGINT) AS {k}' for k in ev.COUNTS)} FROM f) SELECT *, {RATES_LIST} FROM c""")
def _(t):
    later = predictions(t).where(F.col("capture_date") > F.lit("2024-01-01").cast("date"))
    return rounded(ev.pooled(ev.confusion(later, groups=["capture_date"])))


@query("ml12_calibrated_threshold", """WITH c AS (SELECT coalesce(duration, 0) AS s FROM flow_v WHERE label = 'Benign' AND capture_date <= DATE '2024-01-10'),
q AS (SELECT quantile_cont(s, 0.99) AS t FROM c)
SELECT round(t, 6) AS threshold, count(*) AS calibration_records, count(*) FILTER (s >= t) AS flagged,
  round(CAST(count(*) FILTER (s >= t) AS DOUBLE) / count(*), 6) AS flag_rate FROM c, q GROUP BY t""")
def _(t):
    quiet = t.flow_v.where((F.col("label") == "Benign") & (F.col("capture_date") <= F.lit("2024-01-10").cast("date")))
    return rounded(ev.calibration_summary(quiet.select(F.coalesce("duration", F.lit(0.0)).alias("s")), "s"))
