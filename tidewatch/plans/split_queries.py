"""Split and sampling queries: seeded hashes make every one of them checkable row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import cleaning, splits
from tidewatch.plans.bindings import TEST_DATES, TRAIN_DATES
from tidewatch.plans.catalog import query
from tidewatch.plans.cleaning_queries import BINARY
from tidewatch.plans.metric_queries import days_of
from tidewatch.roles import CLASS_CODES


def in_dates(days) -> str:
    return "capture_date IN (" + ", ".join(f"DATE '{d}'" for d in days) + ")"


def binary(t) -> DataFrame:
    return cleaning.binary_rows(t.flow_v, "label")


def quiet(t) -> DataFrame:
    return splits.benign_only(t.flow_v, "label", "Benign")


@query("spl1_chronological", f"""SELECT flow_row_id, capture_date, CASE WHEN {in_dates(TRAIN_DATES)} THEN 'train' ELSE 'test' END AS split
FROM flow_v WHERE {BINARY} AND ({in_dates(TRAIN_DATES)} OR {in_dates(TEST_DATES)})""")
def _(t):
    return splits.chronological_split(binary(t), TRAIN_DATES, TEST_DATES).select("flow_row_id", "capture_date", "split")


@query("spl2_date_presence", f"""WITH d AS (SELECT capture_date, max(a) AS in_train, max(b) AS in_test FROM (VALUES
{', '.join(f"(DATE '{d}', 1, 0)" for d in TRAIN_DATES)}, {', '.join(f"(DATE '{d}', 0, 1)" for d in [*TEST_DATES, '2024-02-15', '2024-01-10'])}) AS v(capture_date, a, b) GROUP BY 1),
n AS (SELECT capture_date AS day, count(*) AS c FROM flow_v WHERE {BINARY} GROUP BY 1)
SELECT capture_date, in_train, in_test, coalesce(c, 0) AS records, c IS NULL AS absent, in_train = 1 AND in_test = 1 AS overlap
FROM d LEFT JOIN n ON n.day = d.capture_date""")
def _(t):
    # one listed day is absent and one is in both lists
    return splits.date_presence(binary(t), days_of(t, TRAIN_DATES), days_of(t, [*TEST_DATES, "2024-02-15", "2024-01-10"]))


@query("spl3_random_split", f"""WITH b AS (SELECT flow_row_id, row_number() OVER (ORDER BY md5(concat('42:', CAST(flow_row_id AS VARCHAR))), flow_row_id) AS r,
  count(*) OVER () AS n FROM flow_v WHERE label = 'Benign' AND {in_dates(TRAIN_DATES)})
SELECT flow_row_id, CASE WHEN r <= ceil(round(n * 0.2e0, 6)) THEN 'testing' ELSE 'training' END AS split FROM b""")
def _(t):
    rows = splits.dates_in(quiet(t), "capture_date", TRAIN_DATES)
    return splits.random_split(rows, "flow_row_id", 0.2).select("flow_row_id", "split")


STRATIFIED = f"""b AS (SELECT flow_row_id, uid, capture_date, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', CAST(flow_row_id AS VARCHAR))), flow_row_id) AS r,
  count(*) OVER (PARTITION BY label) AS n FROM flow_v WHERE {BINARY}),
s AS (SELECT *, CASE WHEN r <= ceil(round(n * 0.2e0, 6)) THEN 'testing' ELSE 'training' END AS split FROM b)"""


def stratified(t) -> DataFrame:
    return splits.random_split(binary(t), "flow_row_id", 0.2, strata=["label"])


@query("spl4_stratified_split", f"WITH {STRATIFIED} SELECT flow_row_id AS row_index, uid, capture_date, lower(label) AS label_clean, split FROM s")
def _(t):
    return stratified(t).select(F.col("flow_row_id").alias("row_index"), "uid", "capture_date", F.lower("label").alias("label_clean"), "split")


@query("spl4_split_summary", f"""WITH {STRATIFIED} SELECT lower(label) AS class, count(*) FILTER (split = 'training') AS training,
  count(*) FILTER (split = 'testing') AS testing FROM s GROUP BY 1""")
def _(t):
    return stratified(t).groupBy(F.lower("label").alias("class")).agg(
        F.count_if(F.col("split") == "training").alias("training"), F.count_if(F.col("split") == "testing").alias("testing")
    )


@query("spl5_time_split", """WITH b AS (SELECT flow_row_id, row_number() OVER (ORDER BY ts, md5(CAST(flow_row_id AS VARCHAR)), flow_row_id) AS r, count(*) OVER () AS n
  FROM flow_v WHERE label = 'Benign' AND capture_date < DATE '2024-01-22')
SELECT flow_row_id, CASE WHEN r <= floor(round(n * 0.8e0, 6)) THEN 'fit' ELSE 'calibrate' END AS part FROM b""")
def _(t):
    earlier = quiet(t).where(F.col("capture_date") < F.lit("2024-01-22").cast("date"))
    return splits.time_split(earlier, "ts", "flow_row_id").select("flow_row_id", "part")


FOLDS = """f AS (SELECT DISTINCT capture_date AS test_date FROM flow_v WHERE capture_date > (SELECT min(capture_date) FROM flow_v)),
p AS (SELECT test_date, flow_row_id, ts, row_number() OVER (PARTITION BY test_date ORDER BY ts, md5(CAST(flow_row_id AS VARCHAR)), flow_row_id) AS r,
  count(*) OVER (PARTITION BY test_date) AS n FROM f JOIN flow_v ON capture_date < test_date WHERE label = 'Benign'),
parts AS (SELECT *, CASE WHEN r <= floor(round(n * 0.8e0, 6)) THEN 'fit' ELSE 'calibrate' END AS part FROM p)"""


@query("spl6_expanding_folds", f"""WITH {FOLDS},
today AS (SELECT capture_date, count(*) FILTER (label = 'Benign') AS b, count(*) FILTER (label = 'Malicious') AS m FROM flow_v WHERE {BINARY} GROUP BY 1)
SELECT test_date, count(*) FILTER (part = 'fit') AS fit_records, count(*) FILTER (part = 'calibrate') AS calibration_records,
  max(ts) FILTER (part = 'fit') AS fit_until, any_value(b) AS benign_test_records, any_value(m) AS malicious_test_records
FROM parts JOIN today ON today.capture_date = test_date GROUP BY test_date""")
def _(t):
    folds = splits.fold_statistics(binary(t), "ts", "flow_row_id", "label")
    return folds.withColumn("fit_until", F.col("fit_until").cast("timestamp_ntz"))


@query("spl6_fold_membership", f"WITH {FOLDS} SELECT test_date, flow_row_id, part FROM parts")
def _(t):
    folds = splits.fold_dates(binary(t))
    cut = splits.fold_cutoffs(quiet(t), folds, "ts", "flow_row_id")
    return splits.fold_membership(quiet(t), cut, "ts", "flow_row_id").select("test_date", "flow_row_id", "part")


@query("spl7_benign_fit", f"""SELECT count(*) AS train_records, count(*) FILTER (label = 'Benign') AS benign_records,
  count(*) FILTER (label = 'Malicious') AS malicious_excluded FROM flow_v WHERE {BINARY} AND {in_dates(TRAIN_DATES)}""")
def _(t):
    return splits.fit_frame_counts(splits.dates_in(binary(t), "capture_date", TRAIN_DATES), "label", "Benign", "Malicious")


@query("spl8_representative_sample", """WITH c AS (SELECT *, lower(label) AS label_clean, CASE WHEN label = 'Malicious' THEN detailedlabel ELSE '' END AS s FROM flow_v),
k AS (SELECT *, row_number() OVER (PARTITION BY capture_date, label_clean, s ORDER BY md5(concat('42:', CAST(flow_row_id AS VARCHAR))), flow_row_id) AS r FROM c)
SELECT flow_row_id, capture_date, label_clean, detailedlabel FROM k WHERE r <= 200""")
def _(t):
    flows = cleaning.with_clean_label(t.flow_v, "label")
    sample = splits.representative_sample(flows, "capture_date", "label_clean", "detailedlabel", "flow_row_id")
    return sample.select("flow_row_id", "capture_date", "label_clean", "detailedlabel")


@query("spl8_small_sample", """WITH k AS (SELECT flow_row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('7:', CAST(flow_row_id AS VARCHAR))), flow_row_id) AS r FROM flow_v)
SELECT flow_row_id, label FROM k WHERE r <= 150""")
def _(t):
    # three strata only: one of them holds most rows
    return splits.stratum_sample(t.flow_v, ["label"], "flow_row_id", 150, seed=7).select("flow_row_id", "label")
