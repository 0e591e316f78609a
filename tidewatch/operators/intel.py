"""Threat-intelligence operators: file hashes, domains and addresses against verdict feeds.

Lookups are joins with feed tables. A feed may grow, so its broadcast is never forced: it is left to Spark's own size
limit and to adaptive execution; beyond that it is a shuffle join (adaptive skew handling included). Tables with one row
per label, source or day are broadcast explicitly.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.cleaning import drop_wildcard, percent, tidy_domain
from tidewatch.functions.domain import PUBLIC_DOMAIN, domain_class
from tidewatch.functions.ip import ip_class, is_public_ip

# Measure names, hash forms and lookup states.
HEX = "[0-9A-Fa-f]"
MD5_FORM, SHA1_FORM = f"^{HEX}{{32}}$", f"^{HEX}{{40}}$"
FAILED_LOOKUP = "^(HTTP_|request_error_)"
TIMING = {"none": "Date unavailable", "before": "Known before dataset", "during": "First listed during dataset",
          "after": "Listed after dataset"}
DOMAIN_FEED = T.StructType([
    T.StructField("query_status", T.StringType()), T.StructField("query_staus", T.StringType()),
    T.StructField("firstseen", T.StringType()), T.StructField("url_count", T.StringType()),
    T.StructField("blacklists", T.StructType([T.StructField("spamhaus_dbl", T.StringType()), T.StructField("surbl", T.StringType())])),
    T.StructField("urls", T.ArrayType(T.StructType([T.StructField("tags", T.ArrayType(T.StringType()))]))),
])
HASH_FEED = T.StructType([
    T.StructField("query_status", T.StringType()),
    T.StructField("data", T.ArrayType(T.StructType([
        T.StructField(n, T.StringType()) for n in ("first_seen", "last_seen", "signature", "file_type", "file_format", "sha256_hash")
    ] + [T.StructField("tags", T.ArrayType(T.StringType()))]))),
])


def _measures(frame: DataFrame, measures: Mapping[str, Column]) -> DataFrame:
    """One aggregation, shown as (measure, value) rows."""
    wide = frame.agg(*[c.alias(f"m{i}") for i, c in enumerate(measures.values())])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("measure"), F.col(f"m{i}").alias("value")) for i, n in enumerate(measures)
    ])))


# ---- file hashes

def hash_availability(files: DataFrame, date: str = "capture_date") -> DataFrame:
    return files.groupBy(F.col(date).alias("date")).agg(
        F.count("*").alias("file_records"), F.count("filename").alias("filenames_present"),
        *[F.count(c).alias(f"{c}_present") for c in ("md5", "sha1", "sha256")],
    )


def hash_linkage(files: DataFrame) -> DataFrame:
    """Seven measures of how usable the hashes are; distinct counts are taken in one expand-free step each."""
    # The names of the measures, here and below.
    plain = _measures(files, {
        "All file records": F.count("*"),
        "Records containing a hash": F.count_if(F.col("md5").isNotNull() | F.col("sha1").isNotNull()),
        "Valid MD5 values": F.count_if(F.col("md5").rlike(MD5_FORM)),
        "Valid SHA1 values": F.count_if(F.col("sha1").rlike(SHA1_FORM)),
        "Records with connection UID": F.count("conn_uids"),
    })
    names = {"md5": "Unique MD5 hashes", "sha1": "Unique SHA1 hashes"}
    pairs = files.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("measure"), F.col(c).alias("hash")) for c, n in names.items()
    ])))
    distinct = pairs.groupBy("measure").agg(F.count_distinct("hash").alias("value"))
    return plain.unionByName(distinct)


def hash_candidates(files: DataFrame) -> DataFrame:
    return files.where(F.col("sha1").isNotNull()).select("sha1", "md5").distinct().orderBy("sha1", "md5")


def hash_quality(files: DataFrame) -> DataFrame:
    """Seven capture-quality measures of the hashed files; an unknown number never counts as a hit."""
    missing, overflow = F.col("missing_bytes").try_cast("double"), F.col("overflow_bytes").try_cast("double")
    seen, total = F.col("seen_bytes").try_cast("double"), F.col("total_bytes").try_cast("double")
    timed_out = F.coalesce(F.upper("timedout") == "T", F.lit(False))
    return _measures(files.where(F.col("sha1").isNotNull()), {
        "Hash records examined": F.count("*"),
        "Records with missing bytes": F.count_if(missing > 0),
        "Records with overflow bytes": F.count_if(overflow > 0),
        "Records that timed out": F.count_if(timed_out),
        "Records with no reported capture problem": F.count_if((missing == 0) & (overflow == 0) & ~timed_out),
        "Records with known total size": F.count_if(total.isNotNull()),
        "Known totals where seen bytes equal total bytes": F.count_if(seen == total),
    })


def match_flag(status: Column, miss: str) -> Column:
    """1 for a hit, 0 for a known miss, NULL when the lookup failed or never happened."""
    return F.when(status == "ok", 1).when(status == miss, 0)


def parse_hash_feed(raw: DataFrame, body: str = "body") -> DataFrame:
    """Feed rows (sha1, JSON text) as verdict columns; details come from the first record of a hit."""
    parsed = raw.select("sha1", F.from_json(body, HASH_FEED).alias("j"))
    first = F.when(F.col("j.query_status") == "ok", F.get("j.data", F.lit(0)))
    fields = parsed.select("sha1", F.col("j.query_status").alias("query_status"), first.alias("d"))
    return fields.select(
        "sha1", "query_status",
        *[F.col(f"d.{n}").alias(n) for n in ("first_seen", "last_seen", "signature", "file_type", "file_format")],
        F.array_join("d.tags", "|").alias("tags"), F.col("d.sha256_hash").alias("sha256"),
    )


def one_verdict(feed: DataFrame, key: str, tidy: Callable[[Column], Column], none: str) -> DataFrame:
    """A feed with tidied keys and one row per key: hits before misses before failed requests, then the latest and largest row."""
    rest = [c for c in feed.columns if c != key]
    status = F.col("query_status")
    rank = F.when(status.isNull(), 0).when(status.rlike(FAILED_LOOKUP), 1).when(status == none, 2).otherwise(3)
    seen = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("last_seen", "first_seen", "firstseen") if c in rest]
    best = F.max(F.struct(rank.alias("_rank"), *[s.alias(f"_seen_{i}") for i, s in enumerate(seen)], *rest))
    tidied = feed.withColumn(key, tidy(F.col(key))).where(F.col(key).isNotNull()).groupBy(key).agg(best.alias("_best"))
    return tidied.select(key, *[F.col(f"_best.{c}").alias(c) for c in rest])


def enrich_hashes(candidates: DataFrame, feed: DataFrame, source: str = "hash_feed") -> DataFrame:
    """Every candidate hash with its verdict; ``feed`` has sha1, query_status and any verdict columns."""
    hashes = candidates.select("sha1").distinct()
    verdicts = one_verdict(feed, "sha1", lambda c: F.lower(F.trim(c)), "hash_not_found").withColumnRenamed("sha1", "_key")
    joined = hashes.join(verdicts, F.lower(F.trim("sha1")) == F.col("_key"), "left").drop("_key")
    return joined.withColumns({
        "cti_source": F.lit(source), "cti_match": match_flag(F.col("query_status"), "hash_not_found"),
    })


def status_distribution(results: DataFrame) -> DataFrame:
    return results.groupBy("query_status").agg(F.count("*").alias("count"))


def pending_lookups(candidates: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Candidates without a final answer: never looked up, or the request failed."""
    final = results.where(F.col("query_status").isNotNull() & ~F.col("query_status").rlike(FAILED_LOOKUP)).select(key)
    return candidates.select(key).distinct().join(final, key, "left_anti")


# ---- domains

def host_observations(logs: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """(uid, source, indicator[, capture_date]) rows of several logs; ``logs``: source -> (table, indicator column)."""
    parts = []
    for source, (frame, column) in logs.items():
        day = [F.col("capture_date")] if "capture_date" in frame.columns else []
        parts.append(frame.select("uid", F.lit(source).alias("source"), F.col(column).alias("indicator"), *day))
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part, allowMissingColumns=True)
    return first


def indicator_availability(hosts: DataFrame) -> DataFrame:
    """Per log: rows, populated rows, distinct values, rows with uid. Values are merged before they are counted."""
    name = F.nullif(tidy_domain(F.col("indicator")), F.lit(""))
    merged = hosts.groupBy("source", name.alias("name")).agg(F.count("*").alias("n"), F.count("uid").alias("with_uid"))
    return merged.groupBy("source").agg(
        F.sum("n").alias("total_records"),
        F.sum(F.when(F.col("name").isNotNull(), F.col("n")).otherwise(0)).alias("populated_records"),
        F.count("name").alias("unique_values"), F.sum("with_uid").alias("records_with_uid"),
    )


def domain_candidates(hosts: DataFrame) -> DataFrame:
    """Distinct names with the sources that saw them, joined by ``|`` in order (at most one entry per source)."""
    name = tidy_domain(F.col("indicator"))
    seen = hosts.select(name.alias("domain"), "source").where((F.col("domain") != "") & F.col("domain").isNotNull())
    return seen.groupBy("domain").agg(F.array_join(F.array_sort(F.collect_set("source")), "|").alias("observed_in"))


def classify_domains(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("candidate_type", domain_class(F.col("domain")))


def domain_type_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("candidate_type").agg(F.count("*").alias("unique_values"))


def public_domains(classified: DataFrame) -> DataFrame:
    names = classified.where(F.col("candidate_type") == PUBLIC_DOMAIN)
    return names.select(drop_wildcard(F.col("domain")).alias("domain")).distinct().orderBy("domain")


def parse_domain_feed(raw: DataFrame, body: str = "body") -> DataFrame:
    """Feed rows (domain, JSON text) as verdict columns. The status key is also accepted in its misspelt form."""
    parsed = raw.select("domain", F.from_json(body, DOMAIN_FEED).alias("j"))
    status = F.coalesce(F.nullif("j.query_status", F.lit("")), F.col("j.query_staus"))
    hit = status == "ok"
    urls = F.coalesce("j.urls", F.array().cast("array<struct<tags:array<string>>>"))
    tags = F.array_sort(F.array_distinct(F.flatten(F.transform(urls, lambda u: F.coalesce(u["tags"], F.array().cast("array<string>"))))))
    return parsed.select(
        "domain", status.alias("query_status"), F.when(hit, F.col("j.firstseen")).alias("firstseen"),
        F.when(hit, F.col("j.url_count").try_cast("bigint")).alias("url_count"),
        F.when(hit, F.col("j.blacklists.spamhaus_dbl")).alias("spamhaus_dbl"), F.when(hit, F.col("j.blacklists.surbl")).alias("surbl"),
        F.when(hit, F.array_join(tags, "|")).alias("tags"),
    )


def enrich_domains(domains: DataFrame, feed: DataFrame, source: str = "domain_feed") -> DataFrame:
    def bare(column: Column) -> Column:
        return F.rtrim(F.lower(F.trim(column)), F.lit("."))

    verdicts = one_verdict(feed, "domain", bare, "no_results").withColumnRenamed("domain", "_key")
    joined = domains.select("domain").distinct().join(verdicts, bare(F.col("domain")) == F.col("_key"), "left").drop("_key")
    return joined.withColumns({"cti_source": F.lit(source), "cti_match": match_flag(F.col("query_status"), "no_results")})


def first_seen_time(column: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(column, " UTC", ""), F.lit("yyyy-MM-dd HH:mm:ss"))


def timing_class(first_seen: Column, start: Column, end: Column) -> Column:
    return (
        F.when(first_seen.isNull(), TIMING["none"]).when(first_seen < start, TIMING["before"])
        .when(first_seen < end, TIMING["during"]).otherwise(TIMING["after"])
    )


def _instant(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def matched_domains(verdicts: DataFrame, start: str, end: str) -> DataFrame:
    """Hits with their parsed first-seen time and timing class against the capture window [start, end)."""
    hits = verdicts.where(F.col("query_status") == "ok").withColumn("firstseen_utc", first_seen_time(F.col("firstseen")))
    return hits.withColumn("timing", timing_class(F.col("firstseen_utc"), _instant(start), _instant(end)))


def timing_counts(matches: DataFrame) -> DataFrame:
    return matches.groupBy("timing").agg(F.count("*").alias("matched_domains"))


def historical_domains(matches: DataFrame) -> DataFrame:
    """Domains already listed before the capture: only knowledge of that time may be used."""
    known = matches.where(F.col("timing") == TIMING["before"])
    return known.groupBy(F.rtrim(F.lower("domain"), F.lit(".")).alias("domain")).agg(F.max("firstseen_utc").alias("firstseen_utc"))


def historical_observations(hosts: DataFrame, historical: DataFrame) -> DataFrame:
    """Log rows whose name (without wildcard) was known before the capture, with its first-seen time."""
    named = hosts.withColumn("domain", drop_wildcard(tidy_domain(F.col("indicator"))))
    return named.join(historical, "domain")


def historical_coverage(observations: DataFrame, flows: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source: matching rows, distinct uids, distinct domains, uids that occur in the flow log.

    (source, uid) pairs and (source, domain) pairs are merged first, so one hot domain costs one row each.
    """
    per_uid = observations.groupBy("source", "uid").agg(F.count("*").alias("n"))
    known = per_uid.where(F.col("uid").isNotNull()).select("uid").distinct().join(flows.select("uid"), "uid", "left_semi")
    marked = per_uid.join(known.withColumn("in_flows", F.lit(1)), "uid", "left")
    by_uid = marked.groupBy("source").agg(
        F.sum("n").alias("matching_log_records"), F.count("uid").alias("unique_uids"), F.count("in_flows").alias("uids_found_in_conn_log")
    )
    by_domain = observations.groupBy("source").agg(F.count_distinct("domain").alias("unique_domains"))
    zero = F.lit(0).cast("bigint")
    # one row per source on every side
    table = sources.select("source").distinct().join(F.broadcast(by_uid), "source", "left").join(F.broadcast(by_domain), "source", "left")
    return table.select("source", *[
        F.coalesce(c, zero).alias(c) for c in ("matching_log_records", "unique_uids", "unique_domains", "uids_found_in_conn_log")
    ])


def uid_features(observations: DataFrame) -> DataFrame:
    """Per connection: distinct domains and sources, latest first-seen, flag. Pairs are merged before counting."""
    merged = observations.where(F.col("uid").isNotNull()).groupBy("uid", "domain").agg(
        F.collect_set("source").alias("sources"), F.max("firstseen_utc").alias("seen")  # at most one entry per log kind
    )
    return merged.groupBy("uid").agg(
        F.count("*").alias("cti_domain_count"),
        F.size(F.array_distinct(F.flatten(F.collect_set("sources")))).cast("bigint").alias("cti_source_count"),
        F.max("seen").alias("cti_firstseen_latest"), F.lit(1).alias("cti_match"),
    )


def enrich_flows(flows: DataFrame, features: DataFrame, ts: str = "ts") -> DataFrame:
    """Flows with their connection's features (0 without a match) and the age of the intelligence in days."""
    joined = flows.join(features, "uid", "left")
    filled = joined.withColumns({
        "cti_match": F.coalesce("cti_match", F.lit(0)),
        **{c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("cti_domain_count", "cti_source_count")},
    })
    micros = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros("cti_firstseen_latest")
    return filled.withColumn("cti_age_days", micros.cast("double") / F.lit(86400e6))


def enrich_flows_known_by_flow_time(flows: DataFrame, observations: DataFrame, ts: str = "ts") -> DataFrame:
    """The stricter variant: an observation counts only when its domain was listed before the flow itself."""
    timed = observations.where(F.col("uid").isNotNull()).join(flows.select("uid", F.col(ts).cast("timestamp").alias("_at")), "uid")
    return enrich_flows(flows, uid_features(timed.where(F.col("firstseen_utc") < F.col("_at"))), ts)


def coverage_by_label(enriched: DataFrame, label: str) -> DataFrame:
    return enriched.groupBy(label).agg(
        F.count("*").alias("total_records"), F.sum("cti_match").cast("bigint").alias("cti_matched_records")
    ).withColumn("cti_matched_percent", percent(F.col("cti_matched_records"), F.col("total_records"), 4))


# ---- addresses

def ip_observations(flows: DataFrame, origin: str, response: str) -> DataFrame:
    """Both ends of a flow as rows, from one scan, with their class (a native expression: no join back needed)."""
    rows = flows.select("uid", "capture_date", F.inline(F.array(
        F.struct(F.trim(F.col(origin)).alias("ip"), F.lit("origin").alias("observed_as")),
        F.struct(F.trim(F.col(response)).alias("ip"), F.lit("response").alias("observed_as")),
    )))
    return rows.withColumn("ip_type", ip_class(F.col("ip")))


def ip_roles(flows: DataFrame, origin: str, response: str) -> DataFrame:
    """Distinct (address, role) with its row count: the shared first step of the two reports below.

    Counting comes before classifying, so an address is parsed once however many flows it has.
    """
    rows = flows.select(F.inline(F.array(
        F.struct(F.trim(F.col(origin)).alias("ip"), F.lit("origin").alias("observed_as")),
        F.struct(F.trim(F.col(response)).alias("ip"), F.lit("response").alias("observed_as")),
    )))
    counted = rows.groupBy("ip", "observed_as").agg(F.count("*").alias("observations"))
    return counted.withColumn("ip_type", ip_class(F.col("ip")))


def ip_type_counts(roles: DataFrame) -> DataFrame:
    per_ip = roles.groupBy("ip_type", "ip").agg(F.sum("observations").alias("n"))
    return per_ip.groupBy("ip_type").agg(
        F.sum("n").alias("observations"), F.count("ip").alias("unique_ips")
    ).orderBy(F.desc("unique_ips"), "ip_type")


def public_ip_candidates(roles: DataFrame) -> DataFrame:
    public = roles.where(F.col("ip_type") == "Public")
    return public.groupBy("ip").agg(F.array_join(F.array_sort(F.collect_set("observed_as")), "|").alias("observed_as"))


def public_ip_coverage(flows: DataFrame, label: str, origin: str, response: str) -> DataFrame:
    ends = flows.select(label, is_public_ip(F.col(origin)).alias("o"), is_public_ip(F.col(response)).alias("r"))
    return ends.groupBy(label).agg(
        F.count("*").alias("total_connections"), F.count_if(F.col("o") | F.col("r")).alias("connections_with_public_ip"),
        F.count_if("o").alias("public_originator"), F.count_if("r").alias("public_responder"),
    ).withColumn("public_ip_percent", percent(F.col("connections_with_public_ip"), F.col("total_connections"), 2))


def _public_responders(flows: DataFrame, label: str, response: str) -> DataFrame:
    """(label, address) pairs with their row count."""
    counted = flows.groupBy(label, response).agg(F.count("*").alias("n"))
    return counted.where(is_public_ip(F.col(response)))


def public_responder_summary(flows: DataFrame, label: str, response: str) -> DataFrame:
    return _public_responders(flows, label, response).groupBy(label).agg(
        F.sum("n").alias("connection_records"), F.count("*").alias("unique_public_responder_ips")
    )


def shared_public_ips(flows: DataFrame, label: str, response: str) -> DataFrame:
    """Per label pair the number of public responders both have; pairs without any are kept as 0.

    Labels of one address are collected (a handful per address), then paired: no join of the address table.
    """
    pairs = _public_responders(flows, label, response)
    labels = pairs.select(label).distinct()
    left, right = labels.select(F.col(label).alias("label_a")), labels.select(F.col(label).alias("label_b"))
    all_pairs = left.join(F.broadcast(right), F.col("label_a") < F.col("label_b"))  # one row per label
    per_ip = pairs.groupBy(response).agg(F.collect_set(label).alias("ls")).where(F.size("ls") > 1)
    a = per_ip.select(F.explode("ls").alias("label_a"), "ls").select("label_a", F.explode("ls").alias("label_b"))
    shared = a.where(F.col("label_a") < F.col("label_b")).groupBy("label_a", "label_b").agg(F.count("*").alias("shared"))
    return all_pairs.join(F.broadcast(shared), ["label_a", "label_b"], "left").select(
        "label_a", "label_b", F.coalesce("shared", F.lit(0)).alias("shared_unique_ips")
    )
