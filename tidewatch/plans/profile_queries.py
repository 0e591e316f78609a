"""Profiling and data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import profile
from tidewatch.plans.catalog import query
from tidewatch.roles import CLASS_CODES

LABELS = ["Benign", "Malicious", "Unknown"]
FAMILIES = ["RemcosRAT", "PyExfil-DNS"]
AUDITED = ["proto", "service", "conn_state", "history", "duration", "orig_bytes", "resp_bytes", "missed_bytes",
           "label", "detailedlabel", "uid"]
# The log's own types for the audited columns.
LOG_TYPES = {"proto": "enum", "service": "string", "conn_state": "string", "history": "string", "duration": "interval",
             "orig_bytes": "count", "resp_bytes": "count", "missed_bytes": "count", "label": "string",
             "detailedlabel": "string", "uid": "string"}
FLOW_COLUMNS = ["flow_row_id", "uid", "ts", "capture_date", "label", "detailedlabel", "proto", "service", "conn_state",
                "history", "duration", "orig_bytes", "resp_bytes", "missed_bytes"]
FLOW_TYPES = ["bigint", "string", "timestamp_ntz", "date", "string", "string", "string", "string", "string", "string",
              "double", "double", "double", "double"]
LINEITEM_COLUMNS = ("l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
                    "l_returnflag l_linestatus l_shipdate").split()
MISSING_CHECKED = ["service", "duration", "orig_bytes", "resp_bytes", "history"]


def each(columns, template: str) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


DETAILS = """details AS (SELECT capture_date AS date, lower(trim(label)) AS label,
  CASE WHEN trim(detailedlabel) IN ('', '-', '(empty)') THEN 'Not specified' ELSE trim(detailedlabel) END AS detailedlabel,
  count(*) AS records FROM flow_v GROUP BY 1, 2, 3)"""
BLANK = "(CASE WHEN {c} IS NULL OR trim(CAST({c} AS VARCHAR)) IN ('', '-', '(empty)') THEN 1 ELSE 0 END)"


@query("prf1_shape", "SELECT count(*) AS total_rows, CAST(11 AS BIGINT) AS total_columns FROM lineitem")
def _(t):
    return profile.shape(t.lineitem)


@query("prf3_missing_counts", each(FLOW_COLUMNS, "SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing FROM flow_v"))
def _(t):
    return profile.missing_counts(t.flow_v)


@query("prf4_duplicate_rows", f"""SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS n FROM lineitem GROUP BY {', '.join(LINEITEM_COLUMNS)}) g""")
def _(t):
    return profile.duplicate_rows(t.lineitem)


@query("prf4_duplicate_line_numbers", """SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber) g""")
def _(t):
    return profile.duplicate_rows(t.lineitem.select("l_orderkey", "l_linenumber"))


@query("prf4_duplicate_flows", f"""SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS n FROM flow_v GROUP BY {', '.join(FLOW_COLUMNS)}) g""")
def _(t):
    return profile.duplicate_rows(t.flow_v)


@query("prf5_time_range", "SELECT min(ts) AS timestamp_min, max(ts) AS timestamp_max FROM flow_v")
def _(t):
    return profile.time_range(t.flow_v, "ts")


@query("prf6_distribution", """SELECT 'duration' AS metric,
  coalesce(CAST(d AS VARCHAR), '<MISSING>') AS value, count(*) AS count
FROM (SELECT CAST(floor(duration) AS BIGINT) AS d FROM flow_v) f GROUP BY 1, 2""")
def _(t):
    whole = t.flow_v.select(F.floor("duration").alias("duration"))
    return profile.distribution(whole, "duration")


@query("prf6_returnflag_distribution", """SELECT 'l_returnflag' AS metric, l_returnflag AS value, count(*) AS count
FROM lineitem GROUP BY 1, 2""")
def _(t):
    return profile.distribution(t.lineitem, "l_returnflag")


@query("prf7_profile_report", f"""
SELECT 'dataset' AS section, 'total_rows' AS item, CAST(count(*) AS VARCHAR) AS value FROM flow_v
UNION ALL SELECT 'dataset', 'total_columns', '{len(FLOW_COLUMNS)}'
UNION ALL SELECT 'dataset', 'timestamp_min_utc', strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%f') FROM flow_v
UNION ALL SELECT 'dataset', 'timestamp_max_utc', strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') FROM flow_v
UNION ALL SELECT 'dataset', 'duplicate_rows', CAST(CAST(sum(n - 1) AS BIGINT) AS VARCHAR)
  FROM (SELECT count(*) AS n FROM flow_v GROUP BY {', '.join(FLOW_COLUMNS)}) g
UNION ALL {" UNION ALL ".join(f"SELECT 'column_dtype', '{c}', '{k}'" for c, k in zip(FLOW_COLUMNS, FLOW_TYPES))}
UNION ALL {each(FLOW_COLUMNS, "SELECT 'missing_values', '{c}', CAST(count(*) - count({c}) AS VARCHAR) FROM flow_v")}
UNION ALL SELECT 'label_distribution', label, CAST(count(*) AS VARCHAR) FROM flow_v GROUP BY label
UNION ALL SELECT 'detailed_label_distribution', detailedlabel, CAST(count(*) AS VARCHAR) FROM flow_v GROUP BY detailedlabel""")
def _(t):
    return profile.profile_report(t.flow_v, "ts", "label", "detailedlabel")


@query("prf8_missing_by_label_state", " UNION ALL ".join(f"""SELECT '{c}' AS feature, label, conn_state, {c} IS NULL AS is_missing,
  count(*) AS count FROM flow_v GROUP BY 1, 2, 3, 4""" for c in ("duration", "orig_bytes", "resp_bytes")))
def _(t):
    return profile.missing_by_label_and_state(t.flow_v, ["duration", "orig_bytes", "resp_bytes"], "label", "conn_state")


@query("prf9_samples_per_date", "SELECT capture_date, label, count(*) AS count FROM flow_v GROUP BY capture_date, label")
def _(t):
    return profile.samples_per_date(t.flow_v, "capture_date", "label")


@query("prf10_daily_labels", """
SELECT CASE WHEN GROUPING(capture_date) = 1 THEN 'TOTAL' ELSE CAST(capture_date AS VARCHAR) END AS date, count(*) AS total,
  count(*) FILTER (l = 'benign') AS benign, count(*) FILTER (l = 'malicious') AS malicious,
  count(*) FILTER (l = 'unknown') AS unknown, count(*) FILTER (l NOT IN ('benign', 'malicious', 'unknown')) AS other
FROM (SELECT capture_date, lower(trim(label)) AS l FROM flow_v) f GROUP BY ROLLUP (capture_date)""")
def _(t):
    return profile.daily_label_summary(t.flow_v, "capture_date", "label")


@query("prf11_daily_details", f"WITH {DETAILS} SELECT * FROM details")
def _(t):
    return profile.daily_detail_counts(t.flow_v, "capture_date", "label", "detailedlabel")


@query("prf12_attack_summary", f"WITH {DETAILS} SELECT * FROM details WHERE label = 'malicious'")
def _(t):
    return profile.attack_summary(profile.daily_detail_counts(t.flow_v, "capture_date", "label", "detailedlabel"))


@query("prf13_attack_families", f"""WITH {DETAILS},
named AS (SELECT date, records, CASE WHEN contains(detailedlabel, 'RemcosRAT') THEN 'RemcosRAT'
  WHEN contains(detailedlabel, 'PyExfil-DNS') THEN 'PyExfil-DNS' ELSE 'Other' END AS f FROM details WHERE label = 'malicious')
SELECT date, CAST(coalesce(sum(records) FILTER (f = 'RemcosRAT'), 0) AS BIGINT) AS "RemcosRAT",
  CAST(coalesce(sum(records) FILTER (f = 'PyExfil-DNS'), 0) AS BIGINT) AS "PyExfil-DNS",
  CAST(coalesce(sum(records) FILTER (f = 'Other'), 0) AS BIGINT) AS "Other", CAST(sum(records) AS BIGINT) AS total_malicious
FROM named GROUP BY date""")
def _(t):
    details = profile.daily_detail_counts(t.flow_v, "capture_date", "label", "detailedlabel")
    return profile.attack_families(profile.attack_summary(details), FAMILIES)


def audit_sql(source: str) -> str:
    parts = []
    for c in AUDITED:
        blank = BLANK.format(c=c)
        parts.append(f"""SELECT '{c}' AS "column", '{LOG_TYPES[c]}' AS type, CAST(sum({blank}) AS BIGINT) AS missing,
  round(coalesce(sum({blank}) * 100e0 / nullif(count(*), 0), 0), 2) AS missing_percent,
  count(DISTINCT CASE WHEN {blank} = 0 THEN trim(CAST({c} AS VARCHAR)) END) AS unique_non_missing FROM {source}""")
    return " UNION ALL ".join(parts)


@query("prf14_column_audit", audit_sql("flow_v"))
def _(t):
    return profile.column_audit(t.flow_v, LOG_TYPES, AUDITED)


@query("prf15_missing_by_label", "SELECT lower(trim(label)) AS label, count(*) AS records, " + ", ".join(
    f"round(sum({BLANK.format(c=c)}) * 100e0 / count(*), 2) AS {c}_missing_percent" for c in MISSING_CHECKED
) + " FROM flow_v GROUP BY 1")
def _(t):
    return profile.missing_percent_by_label(t.flow_v, MISSING_CHECKED, "label")


@query("prf15_missing_by_feature", each(MISSING_CHECKED, "SELECT '{c}' AS feature, " + ", ".join(
    f"round(sum({BLANK}) FILTER (l = '{v}') * 100e0 / count(*) FILTER (l = '{v}'), 2) AS {v}"
    for v in ("benign", "malicious", "unknown")
) + " FROM (SELECT *, lower(trim(label)) AS l FROM flow_v) f"))
def _(t):
    table = profile.missing_percent_by_label(t.flow_v, MISSING_CHECKED, "label")
    return profile.missing_percent_by_feature(table, MISSING_CHECKED, ["benign", "malicious", "unknown"])


@query("prf16_date_label_crosstab", "SELECT capture_date, " + ", ".join(
    f"count(*) FILTER (label = '{v}') AS \"{v}\"" for v in LABELS) + " FROM flow_v GROUP BY capture_date")
def _(t):
    return profile.date_label_crosstab(t.flow_v, "capture_date", "label", LABELS)


@query("prf17_class_by_date", """SELECT capture_date, count(*) FILTER (label = 'Benign') AS "Benign",
  count(*) FILTER (label = 'Malicious') AS "Malicious", count(*) AS "Total"
FROM flow_v WHERE label IN ('Benign', 'Malicious') GROUP BY capture_date""")
def _(t):
    binary = t.flow_v.where(F.col("label").isin(*CLASS_CODES))
    return profile.class_distribution_by_date(binary, "capture_date", "label", {c: c for c in CLASS_CODES})


@query("prf18_class_of_split", """SELECT c AS label, count(f.label) AS count
FROM (VALUES ('Benign'), ('Malicious')) AS v(c) LEFT JOIN (SELECT label FROM flow_v WHERE capture_date <= DATE '2024-01-10') f
ON f.label = c GROUP BY c""")
def _(t):
    train = t.flow_v.where(F.col("capture_date") <= F.lit("2024-01-10").cast("date"))
    return profile.class_distribution(train, "label", {c: c for c in CLASS_CODES})


CROSSTAB = """SELECT history, count(*) FILTER (label = 'Benign') AS "Benign", count(*) FILTER (label = 'Malicious') AS "Malicious",
  count(*) AS total, round(count(*) FILTER (label = 'Malicious') * 100e0 / count(*), 2) AS "Malicious_percent"
FROM (SELECT coalesce(history, 'missing') AS history, label FROM flow_v WHERE label IN ('Benign', 'Malicious')) f GROUP BY history"""


def _history_crosstab(t):
    binary = t.flow_v.where(F.col("label").isin(*CLASS_CODES))
    return profile.category_crosstab(binary, "history", "label", list(CLASS_CODES), "Malicious")


@query("prf19_history_crosstab", CROSSTAB)
def _(t):
    return _history_crosstab(t)


@query("prf19_history_top15", f"SELECT * FROM ({CROSSTAB}) c ORDER BY total DESC, history LIMIT 15")
def _(t):
    return profile.top_categories(_history_crosstab(t), "history")


@query("prf19_history_lookup", f"SELECT * FROM ({CROSSTAB}) c WHERE history = 'h7'")
def _(t):
    return _history_crosstab(t).where(F.col("history") == "h7")
