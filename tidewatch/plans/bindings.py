"""Binds the operators to tables: the flow, address, file, host and feed views over the given parquet tables.

The view text runs unchanged in Spark and in the SQL oracle, so both sides see the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewatch.roles import CONNECTION_LOG, Roles
from tidewatch.session import prepare_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()

VIEWS = {
    "flow_v": """
SELECT event_id AS flow_row_id, concat('C', CAST(event_id AS STRING)) AS uid, ts, CAST(ts AS DATE) AS capture_date,
 CASE event_type WHEN 'error' THEN 'Malicious' WHEN 'signup' THEN 'Unknown' ELSE 'Benign' END AS label,
 CASE WHEN event_type = 'error' AND k % 3 = 0 THEN 'From_malicious-RemcosRAT'
      WHEN event_type = 'error' AND k % 3 = 1 THEN 'From_malicious-PyExfil-DNS'
      WHEN event_type = 'error' THEN 'From_malicious-Scan'
      WHEN event_type = 'signup' THEN '(empty)' ELSE concat('From_benign-', event_type) END AS detailedlabel,
 CASE k % 3 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' ELSE 'icmp' END AS proto,
 CASE WHEN k % 5 = 0 THEN '-' WHEN k % 7 = 0 THEN '(empty)' ELSE concat('svc', CAST(k % 4 AS STRING)) END AS service,
 CASE k % 4 WHEN 0 THEN 'REJ' WHEN 1 THEN 'S0' ELSE 'SF' END AS conn_state,
 concat('h', CAST(k AS STRING)) AS history,
 CASE WHEN k % 10 = 0 THEN NULL ELSE value END AS duration,
 CAST(user_id AS DOUBLE) AS orig_bytes, CAST(k AS DOUBLE) AS resp_bytes, CAST(0 AS DOUBLE) AS missed_bytes
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e""",
    "ip_v": """
SELECT uid, label, capture_date,
 concat('10.0.', CAST(CAST(resp_bytes AS INT) % 4 AS STRING), '.', CAST(CAST(orig_bytes AS INT) % 256 AS STRING)) AS orig_h,
 CASE CAST(resp_bytes AS INT) % 8 WHEN 0 THEN '224.0.0.251' WHEN 1 THEN '127.0.0.1' WHEN 2 THEN '169.254.1.1'
  WHEN 3 THEN '100.64.0.1' WHEN 4 THEN '0.0.0.0' WHEN 5 THEN '300.1.1.1'
  ELSE concat(CAST(20 + CAST(orig_bytes AS INT) % 80 AS STRING), '.', CAST(CAST(resp_bytes AS INT) AS STRING), '.1.', CAST(flow_row_id % 250 AS STRING)) END AS resp_h
FROM flow_v""",
    "file_v": """
SELECT doc_id, DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS capture_date,
 CASE WHEN doc_id % 3 = 0 THEN source END AS filename,
 CASE WHEN doc_id % 10 <> 0 THEN md5(text) END AS md5,
 CASE WHEN doc_id % 10 = 1 THEN 'not-a-hash' WHEN doc_id % 10 <> 0 THEN sha1(text) END AS sha1,
 CAST(NULL AS STRING) AS sha256, concat('C', CAST(doc_id AS STRING)) AS conn_uids,
 n_chars AS seen_bytes,
 CASE WHEN doc_id % 4 <> 0 THEN n_chars + (CASE WHEN doc_id % 5 = 0 THEN 10 ELSE 0 END) END AS total_bytes,
 CASE WHEN doc_id % 6 = 0 THEN 7 ELSE 0 END AS missing_bytes,
 CASE WHEN doc_id % 9 = 0 THEN 3 ELSE 0 END AS overflow_bytes,
 CASE WHEN doc_id % 8 = 0 THEN 'T' WHEN doc_id % 8 = 1 THEN NULL ELSE 'F' END AS timedout
FROM documents""",
    "host_v": """
SELECT concat('C', CAST(page_id AS STRING)) AS uid,
 CASE page_id % 3 WHEN 0 THEN 'dns' WHEN 1 THEN 'http' ELSE 'ssl' END AS source,
 CASE WHEN page_id % 4 = 0 THEN concat(' ', upper(h), '. ') WHEN page_id % 11 = 0 THEN concat('*.', h) ELSE h END AS indicator
FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS h FROM pages) p
UNION ALL
SELECT * FROM (VALUES (CAST(NULL AS STRING), 'dns', '1.2.3.4'), ('C1', 'dns', '4.3.2.1.in-addr.arpa.'), ('C2', 'dns', 'localhost'),
 ('C3', 'dns', 'printer.local'), ('C4', 'dns', '_ldap._tcp.example.com'), ('C5', 'http', '-x.example.com'), ('C6', 'ssl', '*.Example.com'),
 ('C7', 'ssl', '2001:db8::1'), ('C8', 'http', ''), ('C9', 'http', CAST(NULL AS STRING))) AS v(uid, source, indicator)""",
    "feed_hash_v": """
SELECT sha1, CASE WHEN substr(sha1, 1, 1) IN ('0', '1') THEN 'ok' WHEN substr(sha1, 1, 1) = '2' THEN 'HTTP_502' ELSE 'hash_not_found' END AS query_status,
 CASE WHEN substr(sha1, 1, 1) IN ('0', '1') THEN concat('Family', substr(sha1, 2, 1)) END AS signature
FROM (SELECT DISTINCT sha1 FROM file_v WHERE sha1 IS NOT NULL) s""",
    "feed_domain_v": """
SELECT h AS domain, CASE WHEN length(h) % 5 = 4 THEN 'no_results' ELSE 'ok' END AS query_status,
 CASE length(h) % 4 WHEN 0 THEN '2023-12-15 10:00:00 UTC' WHEN 1 THEN '2024-01-10 08:30:00 UTC'
  WHEN 2 THEN '2024-03-01 00:00:00 UTC' ELSE 'bad date' END AS firstseen, length(h) AS url_count
FROM (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1) AS h FROM pages) p""",
}
NEEDS = {"ip_v": ["flow_v"], "feed_hash_v": ["file_v"]}

FLOW = Roles(
    numeric=("duration", "orig_bytes", "resp_bytes", "missed_bytes"),
    categorical=("proto", "service", "conn_state", "history"),
    metadata=("ts", "uid", "id_orig_h", "id_resp_h", "source_file", "capture_date", "label", "detailedlabel"),
    excluded=CONNECTION_LOG.excluded,
)
TRAIN_DATES = [f"2024-01-{d:02d}" for d in range(1, 11)]
TEST_DATES = [f"2024-01-{d:02d}" for d in range(11, 31)]
WINDOW_START, WINDOW_END = "2024-01-01", "2024-01-31"


class Tables:
    """Attribute access to the parquet tables and to the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare_session(spark)
        self.sf_dir = sf_dir.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__"):
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = self._view(name) if name in VIEWS else self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._frames[name]

    def _view(self, name: str) -> DataFrame:
        inputs = NEEDS.get(name) or [t for t in TABLES if f"FROM {t}" in VIEWS[name]]
        text = VIEWS[name]
        for source in inputs:
            getattr(self, source).createOrReplaceTempView(source)
        return self.spark.sql(text)


def with_views(*names: str) -> str:
    """The CTE prefix that binds the same views on the oracle's side."""
    wanted: list[str] = []
    for name in names:
        for needed in [*NEEDS.get(name, []), name]:
            if needed not in wanted:
                wanted.append(needed)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
