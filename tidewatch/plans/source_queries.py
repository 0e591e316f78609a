"""Reader and writer queries: the flow view is written as day folders of log files and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions.cleaning import to_number
from tidewatch.operators import identity
from tidewatch.operators.intel import enrich_hashes, hash_candidates, pending_lookups
from tidewatch.plans.bindings import FLOW
from tidewatch.plans.catalog import query
from tidewatch.plans.cleaning_queries import BINARY, METADATA, MODELLING, modelling
from tidewatch.plans.day_folders import FIELDS, LOG, TYPES, write_day_folders
from tidewatch.plans.split_queries import STRATIFIED, stratified
from tidewatch.operators.cleaning import binary_rows, metadata_table
from tidewatch.session import scratch_path
from tidewatch.sources import zeek
from tidewatch.sources.tables import append_lookups, read_lookups, read_table, write_table

# Logs that may hold intelligence candidates.
CANDIDATE_LOGS = ["dns.log.labeled", "http.log.labeled", "ssl.log.labeled", "x509.log.labeled", "files.log.labeled",
                  "dce_rpc.log.labeled", "smb_mapping.log.labeled", "ntlm.log.labeled"]
TEXT = """CAST(epoch_us(ts) // 1000000 AS VARCHAR) || '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') AS ts"""


@query("src1_discovered_days", "SELECT DISTINCT CAST(capture_date AS VARCHAR) AS capture_date FROM flow_v")
def _(t):
    root = write_day_folders(t)
    paths = t.spark.createDataFrame([(p,) for p in zeek.discover(t.spark, root, LOG)], "path string")
    return paths.select(zeek.capture_date(F.col("path"), LOG).alias("capture_date")).distinct()


# every third day has a header without the last two columns
NARROW = "dayofmonth(capture_date) % 3 = 0"


@query("src2_schema_from_header", " UNION ALL ".join(
    f"SELECT {i} AS position, '{f}' AS field, '{k}' AS type, {f'count(DISTINCT capture_date) FILTER (NOT ({NARROW}))' if i >= len(FIELDS) - 2 else 'count(DISTINCT capture_date)'} AS days, "
    f"count(CASE WHEN CAST({f} AS VARCHAR) <> '-' {f'AND NOT ({NARROW})' if i >= len(FIELDS) - 2 else ''} THEN 1 END) AS values FROM flow_v"
    for i, (f, k) in enumerate(zip(FIELDS, TYPES))))
def _(t):
    root = write_day_folders(t, narrow=NARROW)
    # what stands in each column that the headers name: a wrong name, order, version or marker changes the counts
    rows = zeek.scan(t.spark, root, LOG, markers=("-",))
    counts = rows.agg(*[F.count(f).alias(f) for f in FIELDS])
    long = counts.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("values")) for f in FIELDS])))
    headers = zeek.read_headers(t.spark, zeek.discover(t.spark, root, LOG))
    seen = t.spark.createDataFrame([(h.path, i, f, k) for h in headers for i, (f, k) in enumerate(zip(h.fields, h.types))], "path string, position int, field string, type string")
    days = seen.groupBy("position", "field", "type").agg(F.countDistinct(zeek.capture_date(F.col("path"), LOG)).alias("days"))
    return days.join(F.broadcast(long), "field")  # one row per field


# lines with an id divisible by 13 lose their end, by 17 gain a field, by 19 have a word for a number
SPOILT = "CASE WHEN flow_row_id % 13 = 0 THEN 'short' WHEN flow_row_id % 17 = 0 THEN 'long' WHEN flow_row_id % 19 = 0 THEN 'word' END"


def spoilt(value):
    number = F.regexp_extract(value, "\tC([0-9]+)\t", 1).cast("bigint")
    return F.when(number % 13 == 0, F.regexp_replace(value, "\t[^\t]*$", "")).when(number % 17 == 0, F.concat(value, F.lit("\tmore"))).when(
        number % 19 == 0, F.regexp_replace(value, "^((?:[^\t]*\t){6})[^\t]*", "$1many")).otherwise(value)


@query("src4_bad_lines", f"""SELECT CAST(capture_date AS VARCHAR) AS capture_date, count(*) FILTER (kind IS NULL) AS readable, count(kind) AS bad, count(*) FILTER (kind = 'long') AS longer,
  CAST(sum(CASE WHEN kind IS NULL THEN resp_bytes END) AS BIGINT) AS resp_bytes FROM (SELECT *, {SPOILT} AS kind FROM flow_v) v GROUP BY capture_date""")
def _(t):
    root = write_day_folders(t, spoil=spoilt)
    good, bad = zeek.set_aside(zeek.scan(t.spark, root, LOG, markers=("-",), typed=True, columns=["uid", "resp_bytes"], bad="_bad"), "_bad")
    counts = bad.groupBy("capture_date").agg(F.count("*").alias("bad"), F.count_if(F.col("line").endswith("\tmore")).alias("longer"))
    return good.groupBy("capture_date").agg(F.count("*").alias("readable"), F.sum("resp_bytes").alias("resp_bytes")).join(F.broadcast(counts), "capture_date")  # one row per day


@query("src4_typed_scan", f"""SELECT ts, uid, proto, CASE WHEN service <> '-' THEN service END AS service, duration, CAST(orig_bytes AS BIGINT) AS orig_bytes,
  CAST(resp_bytes AS BIGINT) AS resp_bytes, CAST(missed_bytes AS BIGINT) AS missed_bytes, conn_state, history, label, detailedlabel FROM flow_v""")
def _(t):
    typed = zeek.scan(t.spark, write_day_folders(t), LOG, markers=("-",), typed=True)
    return typed.drop("source_file", "capture_date").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("src5_text_scan", f"""SELECT {TEXT}, uid, CASE WHEN service NOT IN ('-', '(empty)') THEN service END AS service, CAST(CAST(orig_bytes AS BIGINT) AS VARCHAR) AS orig_bytes,
  CASE WHEN detailedlabel <> '(empty)' THEN detailedlabel END AS detailedlabel, CAST(capture_date AS VARCHAR) AS capture_date FROM flow_v""")
def _(t):
    columns = ["ts", "uid", "service", "orig_bytes", "detailedlabel"]
    return zeek.scan(t.spark, write_day_folders(t), LOG, columns=columns).drop("source_file")


@query("src6_raw_scan", f"SELECT {TEXT}, uid, service, detailedlabel, CAST(capture_date AS VARCHAR) AS capture_date FROM flow_v")
def _(t):
    raw = zeek.scan(t.spark, write_day_folders(t), LOG, markers=(), columns=["ts", "uid", "service", "detailedlabel"])
    return raw.drop("source_file")


@query("src8_provenance", "SELECT CAST(capture_date AS VARCHAR) AS capture_date, count(*) AS records, true AS in_path FROM flow_v GROUP BY 1")
def _(t):
    rows = zeek.scan(t.spark, write_day_folders(t), LOG, columns=["uid"])
    return rows.groupBy("capture_date").agg(
        F.count("*").alias("records"), F.bool_and(F.col("source_file").contains(F.col("capture_date"))).alias("in_path")
    )


@query("src9_stacked_days", "SELECT count(*) AS records, count(DISTINCT capture_date) AS days, count(DISTINCT uid) AS uids FROM flow_v")
def _(t):
    rows = zeek.scan(t.spark, write_day_folders(t), LOG, columns=["uid"])
    return rows.agg(F.count("*").alias("records"), F.count_distinct("capture_date").alias("days"), F.count_distinct("uid").alias("uids"))


@query("src11_log_catalogue", " UNION ALL ".join(
    [f"SELECT 'dns.log.labeled' AS log, 'found' AS status, {i} AS position, '{f}' AS field, '{k}' AS type, {version} AS fields, count(DISTINCT capture_date) AS days FROM flow_v WHERE {days}"
     for version, days in ((len(FIELDS), f"NOT ({NARROW})"), (len(FIELDS) - 2, NARROW)) for i, (f, k) in enumerate(zip(FIELDS[:version], TYPES))]
    + [f"SELECT '{log}', 'not found', NULL, NULL, NULL, 0, count(*) * 0 FROM flow_v" for log in CANDIDATE_LOGS[1:]]))
def _(t):
    # only one of the requested logs exists below this root, with two versions of its header
    root = write_day_folders(t, "dns.log.labeled", narrow=NARROW)
    listed = zeek.header_catalogue(t.spark, root, CANDIDATE_LOGS)
    versions = listed.groupBy("log", "files").agg(F.count("position").cast("int").alias("fields"))
    headers = zeek.read_headers(t.spark, zeek.discover(t.spark, root, "dns.log.labeled"))
    files = t.spark.createDataFrame([("dns.log.labeled", len(h.fields), h.path) for h in headers], "log string, fields int, path string")
    days = files.groupBy("log", "fields").agg(F.countDistinct(zeek.capture_date(F.col("path"), "dns.log.labeled")).alias("days"))
    wide = listed.join(F.broadcast(versions), (listed["log"] == versions["log"]) & listed["files"].eqNullSafe(versions["files"])).drop(versions["log"]).drop(versions["files"])
    return wide.join(F.broadcast(days), ["log", "fields"], "left").select("log", "status", "position", "field", "type", "fields", F.coalesce("days", F.lit(0)).alias("days"))


@query("src12_csv_round_trip", MODELLING)
def _(t):
    frame = modelling(t)
    path = write_table(frame, scratch_path(t.spark, "modelling"), "csv")
    return read_table(t.spark, path, "csv", frame.schema)


@query("snk1_partitioned_metadata", METADATA)
def _(t):
    frame = metadata_table(t.flow_v, FLOW)
    path = write_table(frame, scratch_path(t.spark, "metadata"), partition_by=["capture_date"])
    return read_table(t.spark, path, schema=frame.schema).select(*frame.columns)


@query("snk2_split_assignment", f"WITH {STRATIFIED} SELECT flow_row_id AS row_index, uid, capture_date, lower(label) AS label_clean, split FROM s")
def _(t):
    table = stratified(t).select(F.col("flow_row_id").alias("row_index"), "uid", "capture_date", F.lower("label").alias("label_clean"), "split")
    return read_table(t.spark, write_table(table, scratch_path(t.spark, "split")), schema=table.schema)


@query("snk3_lookup_batches", """WITH c AS (SELECT DISTINCT sha1 FROM file_v WHERE sha1 IS NOT NULL)
SELECT CASE WHEN query_status = 'HTTP_502' THEN 'retry' ELSE 'first' END AS batch, count(*) AS hashes
FROM c JOIN feed_hash_v f ON f.sha1 = c.sha1 GROUP BY 1""")
def _(t):
    # a first batch with failed requests, then only the pending ones again
    path = scratch_path(t.spark, "lookups")
    candidates = hash_candidates(t.file_v)
    results = enrich_hashes(candidates, t.feed_hash_v)
    append_lookups(results, path, "first")
    again = pending_lookups(candidates, read_lookups(t.spark, path), "sha1")
    retried = again.join(results, "sha1").withColumn("query_status", F.lit("ok"))
    append_lookups(retried, path, "retry")
    final = read_lookups(t.spark, path).where(~F.col("query_status").startswith("HTTP_"))
    return final.groupBy("batch").agg(F.count("*").alias("hashes"))


@query("id1_file_order_ids", f"""SELECT capture_date, count(*) AS records, CAST(sum(count(*)) OVER (ORDER BY capture_date) - count(*) AS BIGINT) AS first_id, CAST(0 AS BIGINT) AS out_of_order FROM (
SELECT CAST(capture_date AS VARCHAR) AS capture_date FROM flow_v WHERE {BINARY}) d GROUP BY capture_date"""
)
def _(t):
    rows = zeek.scan(t.spark, write_day_folders(t), LOG, columns=["uid", "label"], keep_order=True)
    numbered = identity.row_ids_by_file_order(binary_rows(rows, "label"))
    # inside a file the uid's number rises line by line, and files stand in the order of their paths
    place = to_number(F.substring("uid", 2, 20))
    line = F.row_number().over(Window.partitionBy("source_file").orderBy(place))
    first = F.min("flow_row_id").over(Window.partitionBy("source_file"))
    checked = numbered.withColumn("wrong", (F.col("flow_row_id") != first + line - 1).cast("bigint"))
    per_file = checked.groupBy("capture_date", "source_file").agg(F.count("*").alias("n"), F.min("flow_row_id").alias("low"), F.sum("wrong").alias("wrong"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("source_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per file
    per_file = per_file.withColumn("wrong", F.col("wrong") + (F.col("low") != before).cast("bigint"))
    return per_file.groupBy("capture_date").agg(F.sum("n").alias("records"), F.min("low").alias("first_id"), F.sum("wrong").alias("out_of_order"))
