"""Threat-intelligence queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.ip import OCTET
from tidewatch.operators import intel
from tidewatch.plans.bindings import WINDOW_END, WINDOW_START
from tidewatch.plans.catalog import query

CLEAN = "rtrim(lower(trim(indicator)), '.')"
HOSTS = f"""h AS (SELECT uid, source, indicator, {CLEAN} AS name, regexp_replace({CLEAN}, '^\\*\\.', '') AS domain FROM host_v)"""
L = "[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?"
CANDIDATES = f"""cand AS (SELECT name AS domain, string_agg(DISTINCT source, '|' ORDER BY source) AS observed_in FROM h
  WHERE name IS NOT NULL AND name <> '' GROUP BY name),
stripped AS (SELECT *, regexp_replace(domain, '^\\*\\.', '') AS n FROM cand),
typed AS (SELECT domain, observed_in, CASE
  WHEN regexp_matches(n, '^{OCTET}(\\.{OCTET}){{3}}$') OR regexp_matches(n, '^[0-9a-f:]*:[0-9a-f:]*:[0-9a-f:.]*$') THEN 'IP address'
  WHEN n LIKE '%.in-addr.arpa' OR n LIKE '%.ip6.arpa' THEN 'Reverse DNS'
  WHEN n NOT LIKE '%.%' OR n LIKE '%.local' OR n LIKE '%.lan' OR n LIKE '%.home' OR n LIKE '%.internal' THEN 'Local or single name'
  WHEN regexp_matches(n, '^{L}([.]{L})+$') THEN 'Public domain candidate' ELSE 'Non-hostname DNS value' END AS candidate_type FROM stripped)"""
MATCHED = f"""m AS (SELECT *, try_strptime(replace(firstseen, ' UTC', ''), '%Y-%m-%d %H:%M:%S') AS firstseen_utc FROM feed_domain_v WHERE query_status = 'ok'),
timed AS (SELECT *, CASE WHEN firstseen_utc IS NULL THEN 'Date unavailable' WHEN firstseen_utc < TIMESTAMP '{WINDOW_START} 00:00:00' THEN 'Known before dataset'
  WHEN firstseen_utc < TIMESTAMP '{WINDOW_END} 00:00:00' THEN 'First listed during dataset' ELSE 'Listed after dataset' END AS timing FROM m),
hist AS (SELECT rtrim(lower(domain), '.') AS hd, max(firstseen_utc) AS fs FROM timed WHERE timing = 'Known before dataset' GROUP BY 1),
obs AS (SELECT h.*, fs FROM h JOIN hist ON hd = h.domain)"""
UIDS = """u AS (SELECT uid, count(DISTINCT domain) AS cti_domain_count, count(DISTINCT source) AS cti_source_count, max(fs) AS latest
  FROM obs WHERE uid IS NOT NULL GROUP BY uid),
enriched AS (SELECT f.*, CASE WHEN u.uid IS NULL THEN 0 ELSE 1 END AS cti_match, coalesce(cti_domain_count, 0) AS dc, coalesce(cti_source_count, 0) AS sc, latest
  FROM flow_v f LEFT JOIN u ON u.uid = f.uid)"""
PUBLIC = """(regexp_matches({c}, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') AND NOT ({c} LIKE '10.%' OR {c} LIKE '127.%' OR {c} LIKE '0.%'
  OR {c} LIKE '169.254.%' OR {c} LIKE '100.64.%' OR {c} LIKE '300.%'))"""
IP_TYPE = """CASE WHEN ip LIKE '300.%' THEN 'Invalid' WHEN """ + PUBLIC.format(c="ip") + """ THEN 'Public'
  WHEN ip LIKE '127.%' THEN 'Loopback' WHEN ip LIKE '169.254.%' THEN 'Link-local' WHEN ip = '0.0.0.0' THEN 'Unspecified'
  WHEN ip LIKE '10.%' THEN 'Private' ELSE 'Other non-public' END"""
IPS = f"""o AS (SELECT uid, capture_date, orig_h AS ip, 'origin' AS observed_as FROM ip_v UNION ALL SELECT uid, capture_date, resp_h, 'response' FROM ip_v),
ot AS (SELECT *, {IP_TYPE} AS ip_type FROM o)"""


def measures(source: str, where: str, items: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS measure, {e} AS value FROM {source}{where}" for n, e in items.items())


@query("cti1_hash_availability", """SELECT capture_date AS date, count(*) AS file_records, count(filename) AS filenames_present,
  count(md5) AS md5_present, count(sha1) AS sha1_present, count(sha256) AS sha256_present FROM file_v GROUP BY 1""")
def _(t):
    return intel.hash_availability(t.file_v)


@query("cti2_hash_linkage", measures("file_v", "", {
    "All file records": "count(*)", "Records containing a hash": "count(*) FILTER (md5 IS NOT NULL OR sha1 IS NOT NULL)",
    "Valid MD5 values": "count(*) FILTER (regexp_full_match(md5, '[0-9A-Fa-f]{32}'))", "Unique MD5 hashes": "count(DISTINCT md5)",
    "Valid SHA1 values": "count(*) FILTER (regexp_full_match(sha1, '[0-9A-Fa-f]{40}'))", "Unique SHA1 hashes": "count(DISTINCT sha1)",
    "Records with connection UID": "count(conn_uids)"}))
def _(t):
    return intel.hash_linkage(t.file_v)


@query("cti3_hash_candidates", "SELECT DISTINCT sha1, md5 FROM file_v WHERE sha1 IS NOT NULL")
def _(t):
    return intel.hash_candidates(t.file_v)


TIMED_OUT = "coalesce(upper(timedout) = 'T', false)"


@query("cti4_hash_quality", measures("file_v", " WHERE sha1 IS NOT NULL", {
    "Hash records examined": "count(*)", "Records with missing bytes": "count(*) FILTER (missing_bytes > 0)",
    "Records with overflow bytes": "count(*) FILTER (overflow_bytes > 0)", "Records that timed out": f"count(*) FILTER ({TIMED_OUT})",
    "Records with no reported capture problem": f"count(*) FILTER (missing_bytes = 0 AND overflow_bytes = 0 AND NOT {TIMED_OUT})",
    "Records with known total size": "count(total_bytes)",
    "Known totals where seen bytes equal total bytes": "count(*) FILTER (seen_bytes = total_bytes)"}))
def _(t):
    return intel.hash_quality(t.file_v)


HASHED = """res AS (SELECT c.sha1, query_status, signature, 'hash_feed' AS cti_source,
  CASE query_status WHEN 'ok' THEN 1 WHEN 'hash_not_found' THEN 0 END AS cti_match
  FROM (SELECT DISTINCT sha1 FROM file_v WHERE sha1 IS NOT NULL) c LEFT JOIN feed_hash_v f ON f.sha1 = c.sha1)"""


def hash_results(t) -> DataFrame:
    return intel.enrich_hashes(intel.hash_candidates(t.file_v), t.feed_hash_v)


@query("cti5_hash_verdicts", f"WITH {HASHED} SELECT * FROM res")
def _(t):
    return hash_results(t)


@query("cti5_hash_verdicts_json", """SELECT md5(text) AS sha1, CASE WHEN doc_id % 3 = 0 THEN 'ok' ELSE 'hash_not_found' END AS query_status,
  CASE WHEN doc_id % 3 = 0 THEN source END AS signature, CASE WHEN doc_id % 3 = 0 THEN concat(lang, '|', source) END AS tags FROM documents""")
def _(t):
    # feed bodies as JSON text, derived from the documents
    record = F.struct(F.col("source").alias("signature"), F.array("lang", "source").alias("tags"))
    body = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.lit("ok").alias("query_status"), F.array(record).alias("data")))).otherwise(
        F.to_json(F.struct(F.lit("hash_not_found").alias("query_status"))))
    raw = t.documents.select(F.md5("text").alias("sha1"), body.alias("body"))
    return intel.parse_hash_feed(raw).select("sha1", "query_status", "signature", "tags")


@query("cti6_status_counts", f"WITH {HASHED} SELECT query_status, count(*) AS count FROM res GROUP BY 1")
def _(t):
    return intel.status_distribution(hash_results(t))


@query("cti7_pending_lookups", f"WITH {HASHED} SELECT sha1 FROM res WHERE query_status IS NULL OR regexp_matches(query_status, '^(HTTP_|request_error_)')")
def _(t):
    return intel.pending_lookups(intel.hash_candidates(t.file_v), hash_results(t), "sha1")


@query("cti8_indicator_availability", f"""WITH {HOSTS} SELECT source, count(*) AS total_records, count(*) FILTER (name <> '') AS populated_records,
  count(DISTINCT CASE WHEN name <> '' THEN name END) AS unique_values, count(uid) AS records_with_uid FROM h GROUP BY source""")
def _(t):
    return intel.indicator_availability(t.host_v)


@query("cti9_domain_candidates", f"WITH {HOSTS}, {CANDIDATES} SELECT * FROM cand")
def _(t):
    return intel.domain_candidates(t.host_v)


def typed_domains(t) -> DataFrame:
    return intel.classify_domains(intel.domain_candidates(t.host_v))


@query("cti10_domain_types", f"WITH {HOSTS}, {CANDIDATES} SELECT * FROM typed")
def _(t):
    return typed_domains(t)


@query("cti10_domain_type_counts", f"WITH {HOSTS}, {CANDIDATES} SELECT candidate_type, count(*) AS unique_values FROM typed GROUP BY 1")
def _(t):
    return intel.domain_type_counts(typed_domains(t))


@query("cti11_public_domains", f"""WITH {HOSTS}, {CANDIDATES} SELECT DISTINCT regexp_replace(domain, '^\\*\\.', '') AS domain FROM typed
WHERE candidate_type = 'Public domain candidate'""")
def _(t):
    return intel.public_domains(typed_domains(t))


@query("cti12_domain_verdicts", f"""WITH {HOSTS}, {CANDIDATES}, pub AS (SELECT DISTINCT regexp_replace(domain, '^\\*\\.', '') AS d FROM typed
  WHERE candidate_type = 'Public domain candidate')
SELECT d AS domain, query_status, firstseen, url_count, 'domain_feed' AS cti_source,
  CASE query_status WHEN 'ok' THEN 1 WHEN 'no_results' THEN 0 END AS cti_match FROM pub LEFT JOIN feed_domain_v f ON f.domain = d""")
def _(t):
    feed = t.feed_domain_v.withColumn("url_count", F.col("url_count").cast("bigint"))
    return intel.enrich_domains(intel.public_domains(typed_domains(t)), feed)


@query("cti12_domain_verdicts_json", """SELECT concat('d', CAST(page_id AS VARCHAR)) AS domain, CASE page_id % 4 WHEN 1 THEN 'no_results' ELSE 'ok' END AS query_status,
  CASE page_id % 4 WHEN 0 THEN 'listed' END AS surbl,
  CASE page_id % 4 WHEN 0 THEN concat('a|b|', CASE WHEN page_id % 8 = 0 THEN 'c' ELSE 'd' END) WHEN 1 THEN NULL ELSE '' END AS tags FROM pages""")
def _(t):
    # one body per feed case: hit with nested tags, misspelt status key, hit without records
    case = F.col("page_id") % 4
    extra = F.when(F.col("page_id") % 8 == 0, "c").otherwise("d")
    body = (
        F.when(case == 0, F.concat(F.lit('{"query_status":"ok","urls":[{"tags":["b","'), extra, F.lit('"]},{"tags":null},{"tags":["a","b"]}],"blacklists":{"surbl":"listed"}}')))
        .when(case == 1, '{"query_staus":"no_results"}').otherwise('{"query_status":"ok","urls":null,"blacklists":null}')
    )
    raw = t.pages.select(F.concat(F.lit("d"), F.col("page_id").cast("string")).alias("domain"), body.alias("body"))
    return intel.parse_domain_feed(raw).select("domain", "query_status", "surbl", "tags")


def matches(t) -> DataFrame:
    return intel.matched_domains(t.feed_domain_v, WINDOW_START, WINDOW_END)


@query("cti13_timing", f"WITH {HOSTS}, {MATCHED} SELECT domain, firstseen_utc, timing FROM timed")
def _(t):
    return matches(t).select("domain", F.col("firstseen_utc").cast("timestamp_ntz").alias("firstseen_utc"), "timing")


@query("cti13_timing_counts", f"WITH {HOSTS}, {MATCHED} SELECT timing, count(*) AS matched_domains FROM timed GROUP BY timing")
def _(t):
    return intel.timing_counts(matches(t))


def observations(t) -> DataFrame:
    return intel.historical_observations(t.host_v, intel.historical_domains(matches(t)))


@query("cti14_historical_observations", f"WITH {HOSTS}, {MATCHED} SELECT uid, source, domain FROM obs")
def _(t):
    return observations(t).select("uid", "source", "domain")


@query("cti14_historical_coverage", f"""WITH {HOSTS}, {MATCHED}
SELECT s.source, count(obs.domain) AS matching_log_records, count(DISTINCT obs.uid) AS unique_uids, count(DISTINCT obs.domain) AS unique_domains,
  count(DISTINCT CASE WHEN obs.uid IN (SELECT uid FROM flow_v) THEN obs.uid END) AS uids_found_in_conn_log
FROM (SELECT DISTINCT source FROM h) s LEFT JOIN obs ON obs.source = s.source GROUP BY s.source""")
def _(t):
    return intel.historical_coverage(observations(t), t.flow_v, t.host_v)


@query("cti15_uid_features", f"""WITH {HOSTS}, {MATCHED}, {UIDS} SELECT uid, cti_domain_count, cti_source_count, latest AS cti_firstseen_latest, 1 AS cti_match FROM u""")
def _(t):
    return intel.uid_features(observations(t)).withColumn("cti_firstseen_latest", F.col("cti_firstseen_latest").cast("timestamp_ntz"))


def enriched(t) -> DataFrame:
    return intel.enrich_flows(t.flow_v, intel.uid_features(observations(t)))


@query("cti16_enriched_flows", f"WITH {HOSTS}, {MATCHED}, {UIDS} SELECT flow_row_id, uid, cti_match, dc AS cti_domain_count, sc AS cti_source_count FROM enriched")
def _(t):
    return enriched(t).select("flow_row_id", "uid", "cti_match", "cti_domain_count", "cti_source_count")


@query("cti17_intel_age", f"""WITH {HOSTS}, {MATCHED}, {UIDS} SELECT flow_row_id,
  round((epoch_us(ts) - epoch_us(latest)) / 86400e6, 6) AS cti_age_days FROM enriched""")
def _(t):
    return enriched(t).select("flow_row_id", F.round("cti_age_days", 6).alias("cti_age_days"))


@query("cti17_known_by_flow_time", f"""WITH {HOSTS}, {MATCHED}, late AS (SELECT h.*, hx.fs FROM h JOIN (SELECT rtrim(lower(domain), '.') AS hd, max(firstseen_utc) AS fs
  FROM timed WHERE firstseen_utc IS NOT NULL GROUP BY 1) hx ON hx.hd = h.domain)
SELECT f.flow_row_id, CASE WHEN count(l.domain) > 0 THEN 1 ELSE 0 END AS cti_match, count(DISTINCT l.domain) AS cti_domain_count
FROM flow_v f LEFT JOIN late l ON l.uid = f.uid AND l.fs < f.ts GROUP BY f.flow_row_id""")
def _(t):
    dated = matches(t).where(F.col("firstseen_utc").isNotNull())
    listed = dated.groupBy(F.rtrim(F.lower("domain"), F.lit(".")).alias("domain")).agg(F.max("firstseen_utc").alias("firstseen_utc"))
    strict = intel.enrich_flows_known_by_flow_time(t.flow_v, intel.historical_observations(t.host_v, listed))
    return strict.select("flow_row_id", "cti_match", "cti_domain_count")


@query("cti18_coverage_by_label", f"""WITH {HOSTS}, {MATCHED}, {UIDS} SELECT label, count(*) AS total_records, CAST(sum(cti_match) AS BIGINT) AS cti_matched_records,
  round(sum(cti_match) * 100e0 / count(*), 4) AS cti_matched_percent FROM enriched GROUP BY label""")
def _(t):
    return intel.coverage_by_label(enriched(t), "label")


@query("cti19_ip_observations", f"WITH {IPS} SELECT uid, capture_date, ip, observed_as FROM ot")
def _(t):
    return intel.ip_observations(t.ip_v, "orig_h", "resp_h").select("uid", "capture_date", "ip", "observed_as")


@query("cti20_ip_classes", f"WITH {IPS} SELECT uid, ip, observed_as, ip_type FROM ot")
def _(t):
    return intel.ip_observations(t.ip_v, "orig_h", "resp_h").select("uid", "ip", "observed_as", "ip_type")


def roles(t) -> DataFrame:
    return intel.ip_roles(t.ip_v, "orig_h", "resp_h")


@query("cti21_ip_class_counts", f"WITH {IPS} SELECT ip_type, count(*) AS observations, count(DISTINCT ip) AS unique_ips FROM ot GROUP BY ip_type")
def _(t):
    return intel.ip_type_counts(roles(t))


@query("cti22_public_ip_candidates", f"""WITH {IPS} SELECT ip, string_agg(DISTINCT observed_as, '|' ORDER BY observed_as) AS observed_as
FROM ot WHERE ip_type = 'Public' GROUP BY ip""")
def _(t):
    return intel.public_ip_candidates(roles(t))


@query("cti23_public_ip_coverage", f"""SELECT label, count(*) AS total_connections, count(*) FILTER (o OR r) AS connections_with_public_ip,
  count(*) FILTER (o) AS public_originator, count(*) FILTER (r) AS public_responder, round(count(*) FILTER (o OR r) * 100e0 / count(*), 2) AS public_ip_percent
FROM (SELECT label, {PUBLIC.format(c='orig_h')} AS o, {PUBLIC.format(c='resp_h')} AS r FROM ip_v) e GROUP BY label""")
def _(t):
    return intel.public_ip_coverage(t.ip_v, "label", "orig_h", "resp_h")


@query("cti24_public_responders", f"""SELECT label, count(*) AS connection_records, count(DISTINCT resp_h) AS unique_public_responder_ips
FROM ip_v WHERE {PUBLIC.format(c='resp_h')} GROUP BY label""")
def _(t):
    return intel.public_responder_summary(t.ip_v, "label", "resp_h")


@query("cti25_shared_public_ips", f"""WITH d AS (SELECT DISTINCT label, resp_h FROM ip_v WHERE {PUBLIC.format(c='resp_h')}), l AS (SELECT DISTINCT label FROM d)
SELECT a.label AS label_a, b.label AS label_b, (SELECT count(*) FROM d x JOIN d y ON x.resp_h = y.resp_h WHERE x.label = a.label AND y.label = b.label) AS shared_unique_ips
FROM l a JOIN l b ON a.label < b.label""")
def _(t):
    return intel.shared_public_ips(t.ip_v, "label", "resp_h")
