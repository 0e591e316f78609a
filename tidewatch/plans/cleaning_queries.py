"""Cleaning, filtering and row-identity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import cleaning as fn
from tidewatch.operators import cleaning, identity
from tidewatch.plans.bindings import FLOW
from tidewatch.plans.catalog import query
from tidewatch.roles import CLASS_CODES

BINARY = "label IN ('Benign', 'Malicious')"
MODELLING = f"""SELECT flow_row_id, duration, orig_bytes, resp_bytes, missed_bytes, coalesce(proto, 'missing') AS proto,
  coalesce(service, 'missing') AS service, coalesce(conn_state, 'missing') AS conn_state, coalesce(history, 'missing') AS history,
  CASE label WHEN 'Benign' THEN 0 WHEN 'Malicious' THEN 1 END AS label
FROM (SELECT * REPLACE (CASE WHEN service NOT IN ('-', '(empty)') THEN service END AS service) FROM flow_v) f WHERE {BINARY}"""
METADATA = f"SELECT flow_row_id, ts, uid, capture_date, label, detailedlabel FROM flow_v WHERE {BINARY}"


def clean_flows(t):
    return cleaning.with_text_nulls(t.flow_v, ["service"])


def modelling(t):
    """Modelling rows of the flow view, with the date kept beside them for splits."""
    return cleaning.modelling_table(clean_flows(t), FLOW)


@query("src5_null_markers", """SELECT flow_row_id, CASE WHEN service NOT IN ('-', '(empty)') THEN service END AS service,
  CASE WHEN detailedlabel NOT IN ('-', '(empty)') THEN detailedlabel END AS detailedlabel FROM flow_v""")
def _(t):
    return cleaning.with_text_nulls(t.flow_v, ["service", "detailedlabel"]).select("flow_row_id", "service", "detailedlabel")


@query("src7_projection", "SELECT label, detailedlabel FROM flow_v")
def _(t):
    return t.flow_v.select("label", "detailedlabel")


@query("prj1_metadata_columns", "SELECT ts, uid, capture_date, label, detailedlabel FROM flow_v")
def _(t):
    return cleaning.keep_available(t.flow_v, FLOW.metadata)


@query("prj2_without_leaks", """SELECT flow_row_id, ts, label, proto, service, conn_state, history, duration, orig_bytes,
  resp_bytes, missed_bytes FROM flow_v""")
def _(t):
    return cleaning.drop_excluded(t.flow_v, FLOW.excluded)


PRESENT = ("detailedlabel", "uid", "capture_date")


@query("prj2_excluded_report", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", true AS present, count({c}) AS \"values\" FROM flow_v" if c in PRESENT
    else f"SELECT '{c}', false, CAST(0 AS BIGINT)" for c in FLOW.excluded))
def _(t):
    return cleaning.excluded_report(t.flow_v, FLOW.excluded)


@query("prj3_rename", "SELECT indicator AS domain, source AS observed_as FROM host_v")
def _(t):
    renamed = cleaning.rename_columns(t.host_v, {"indicator": "domain", "source": "observed_as"})
    return renamed.select("domain", "observed_as")


@query("prj4_derived_columns", """SELECT flow_row_id, 1 AS cti_match, duration IS NULL AS duration_is_missing,
  orig_bytes + resp_bytes AS total_bytes FROM flow_v""")
def _(t):
    return t.flow_v.select(
        "flow_row_id", F.lit(1).alias("cti_match"), F.col("duration").isNull().alias("duration_is_missing"),
        (F.col("orig_bytes") + F.col("resp_bytes")).alias("total_bytes"),
    )


@query("flt1_binary_rows", f"SELECT flow_row_id, label FROM flow_v WHERE {BINARY}")
def _(t):
    return cleaning.binary_rows(t.flow_v, "label").select("flow_row_id", "label")


@query("flt2_held_out", """SELECT count(*) AS records, count(*) FILTER (lower(trim(label)) = 'unknown') AS unknown_records,
  count(*) FILTER (label NOT IN ('Benign', 'Malicious')) AS held_out_records FROM flow_v""")
def _(t):
    return cleaning.held_out_count(t.flow_v, "label")


@query("flt3_date_filters", """SELECT 'in_list' AS test, count(*) AS records FROM flow_v WHERE capture_date IN (DATE '2024-01-02', DATE '2024-01-05')
UNION ALL SELECT 'up_to', count(*) FROM flow_v WHERE capture_date <= DATE '2024-01-10'
UNION ALL SELECT 'on', count(*) FROM flow_v WHERE capture_date = DATE '2024-01-03'
UNION ALL SELECT 'before', count(*) FROM flow_v WHERE capture_date < DATE '2024-01-11'
UNION ALL SELECT 'from', count(*) FROM flow_v WHERE capture_date >= DATE '2024-01-22'""")
def _(t):
    day = F.col("capture_date")

    def on(text):
        return F.lit(text).cast("date")

    tests = {"in_list": day.isin(on("2024-01-02"), on("2024-01-05")), "up_to": day <= on("2024-01-10"),
             "on": day == on("2024-01-03"), "before": day < on("2024-01-11"), "from": day >= on("2024-01-22")}
    counts = t.flow_v.agg(*[F.count_if(c).alias(n) for n, c in tests.items()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("test"), F.col(n).alias("records")) for n in tests])))


@query("flt3_rows_from", "SELECT flow_row_id, capture_date FROM flow_v WHERE capture_date >= DATE '2024-01-22'")
def _(t):
    return t.flow_v.where(F.col("capture_date") >= F.lit("2024-01-22").cast("date")).select("flow_row_id", "capture_date")


@query("flt4_populated", "SELECT uid, source, indicator FROM host_v WHERE indicator IS NOT NULL AND indicator <> ''")
def _(t):
    return cleaning.populated(t.host_v, "indicator")


@query("flt5_any_hash", "SELECT doc_id FROM file_v WHERE md5 IS NOT NULL OR sha1 IS NOT NULL")
def _(t):
    return t.file_v.where(cleaning.any_present(["md5", "sha1"])).select("doc_id")


@query("cln1_numbers", """SELECT flow_row_id, TRY_CAST(service AS DOUBLE) AS service, TRY_CAST(substr(history, 2) AS DOUBLE) AS history,
  duration FROM flow_v""")
def _(t):
    text = t.flow_v.select("flow_row_id", "service", F.expr("substr(history, 2)").alias("history"), "duration")
    return cleaning.coerce_numbers(text, ["service", "history", "duration"])


@query("cln3_fill_category", """SELECT flow_row_id, coalesce(CASE WHEN service NOT IN ('-', '(empty)') THEN service END, 'missing') AS service
FROM flow_v""")
def _(t):
    return cleaning.fill_categories(clean_flows(t), ["service"]).select("flow_row_id", "service")


@query("cln4_clean_label", "SELECT flow_row_id, lower(trim(label)) AS label_clean FROM flow_v")
def _(t):
    return cleaning.with_clean_label(t.flow_v, "label").select("flow_row_id", "label_clean")


@query("cln5_label_codes", """SELECT flow_row_id, CASE label WHEN 'Benign' THEN 0 WHEN 'Malicious' THEN 1 END AS code,
  CASE label WHEN 'Benign' THEN 'Benign' WHEN 'Malicious' THEN 'Malicious' ELSE 'Unknown' END AS decoded FROM flow_v""")
def _(t):
    coded = t.flow_v.select("flow_row_id", fn.label_code(F.col("label"), CLASS_CODES).alias("code"))
    return coded.withColumn("decoded", fn.label_name(F.col("code"), CLASS_CODES))


@query("cln6_unexpected_labels", f"SELECT count(*) FILTER (NOT ({BINARY})) AS unexpected_labels FROM flow_v")
def _(t):
    return cleaning.unexpected_labels(t.flow_v, "label", list(CLASS_CODES))


@query("cln7_detail_fillers", """SELECT flow_row_id, CASE WHEN trim(detailedlabel) IN ('', '-', '(empty)') THEN 'Not specified'
  ELSE trim(detailedlabel) END AS detail,
  coalesce(CASE WHEN detailedlabel NOT IN ('-', '(empty)') THEN detailedlabel END, 'unspecified') AS family FROM flow_v""")
def _(t):
    known = fn.null_markers(F.col("detailedlabel"), fn.UNSET_OR_EMPTY)
    return t.flow_v.select(
        "flow_row_id", fn.tidy_detail(F.col("detailedlabel")).alias("detail"), fn.fill_category(known, "unspecified").alias("family")
    )


@query("cln8_epoch_time", """SELECT flow_row_id, ts FROM flow_v""")
def _(t):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    text = F.concat(
        F.floor(micros / 1_000_000).cast("bigint").cast("string"), F.lit("."), F.lpad(F.pmod(micros, F.lit(1_000_000)).cast("string"), 6, "0")
    )
    as_text = t.flow_v.select("flow_row_id", text.alias("ts"))  # the form the logs carry
    return as_text.select("flow_row_id", fn.epoch_to_timestamp(F.col("ts")).cast("timestamp_ntz").alias("ts"))


@query("cln9_domains", """SELECT uid, source, rtrim(lower(trim(indicator)), '.') AS indicator_clean,
  regexp_replace(rtrim(lower(trim(indicator)), '.'), '^\\*\\.', '') AS domain FROM host_v""")
def _(t):
    cleaned = cleaning.with_clean_domain(t.host_v, "indicator")
    return cleaned.select("uid", "source", "indicator_clean", fn.drop_wildcard(F.col("indicator_clean")).alias("domain"))


@query("id1_row_ids", f"""SELECT flow_row_id AS event_id, row_number() OVER (ORDER BY flow_row_id) - 1 AS flow_row_id
FROM flow_v WHERE {BINARY}""")
def _(t):
    rows = cleaning.binary_rows(t.flow_v, "label").select(F.col("flow_row_id").alias("event_id"))
    return identity.row_ids_by_number(rows, "event_id")


@query("id2_unique_ids", """SELECT count(*) AS records, count(DISTINCT flow_row_id) AS distinct_ids,
  count(*) - count(DISTINCT flow_row_id) AS duplicated_ids FROM flow_v""")
def _(t):
    return identity.id_uniqueness(t.flow_v, "flow_row_id")


@query("id3_alignment", f"""WITH a AS (SELECT flow_row_id FROM flow_v WHERE {BINARY}), b AS (SELECT flow_row_id FROM flow_v)
SELECT (SELECT count(*) FROM a) AS left_records, (SELECT count(*) FROM b) AS right_records,
  (SELECT count(*) FROM a WHERE flow_row_id NOT IN (SELECT flow_row_id FROM b)) AS only_left,
  (SELECT count(*) FROM b WHERE flow_row_id NOT IN (SELECT flow_row_id FROM a)) AS only_right, CAST(0 AS BIGINT) AS repeated_ids""")
def _(t):
    return identity.alignment(cleaning.binary_rows(t.flow_v, "label"), t.flow_v, "flow_row_id")


@query("id4_modelling_table", MODELLING)
def _(t):
    return modelling(t)


@query("id4_metadata_table", METADATA)
def _(t):
    return cleaning.metadata_table(t.flow_v, FLOW)


@query("id4_join_back", f"""SELECT m.*, d.capture_date FROM ({MODELLING}) m
JOIN (SELECT flow_row_id AS r, capture_date FROM flow_v) d ON d.r = m.flow_row_id""")
def _(t):
    return cleaning.join_on_row_id(modelling(t), cleaning.metadata_table(t.flow_v, FLOW), FLOW)
