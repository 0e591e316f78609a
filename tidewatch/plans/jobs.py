"""Whole workflows over a folder of daily logs: read, compute, write tables. Stages meet at Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.cleaning import UNSET, UNSET_OR_EMPTY, tidy_label
from tidewatch.operators import cleaning, evaluation, features, forest, identity, intel, oneclass, profile, rolling, splits, tree
from tidewatch.roles import CLASS_CODES, CONNECTION_LOG, Roles
from tidewatch.session import prepare_session
from tidewatch.sources import zeek
from tidewatch.sources.tables import append_lookups, read_lookups, write_table

CONNECTIONS = "conn.log.labeled"
# Logs with host names and the column that holds them.
HOST_LOGS = {"dns": ("dns.log.labeled", "query"), "http": ("http.log.labeled", "host"), "ssl": ("ssl.log.labeled", "server_name")}
MISSING_CHECKED = ("duration", "orig_bytes", "resp_bytes")


def profile_connections(spark: SparkSession, root: str) -> DataFrame:
    """The long profile report of all days, on typed columns; only ``-`` is missing."""
    prepare_session(spark)
    rows = rolling.keep(zeek.scan(spark, root, CONNECTIONS, markers=UNSET, typed=True), "typed")  # the text is parsed once
    profile.check_time_range(rows, "ts")
    return profile.profile_report(rows, "ts", "label", "detailedlabel")


def profile_days(spark: SparkSession, root: str, out: str) -> str:
    return write_table(profile_connections(spark, root), out)


def prepare(spark: SparkSession, root: str, out: str, roles: Roles = CONNECTION_LOG) -> dict[str, str]:
    """Diagnostics, then modelling and metadata tables that share ``flow_row_id`` (file and line order). Malformed lines go to a table of their own."""
    prepare_session(spark)
    text, bad = zeek.set_aside(zeek.scan(spark, root, CONNECTIONS, markers=UNSET_OR_EMPTY, keep_order=True, bad="_bad"), "_bad")
    checked = cleaning.coerce_numbers(text, [c for c in MISSING_CHECKED if c in text.columns])
    base = identity.row_ids_by_file_order(cleaning.binary_rows(text, roles.target), roles.row_id)
    paths = {
        "bad_lines": write_table(bad, f"{out}/bad_lines"),
        "missing": write_table(profile.missing_by_label_and_state(checked, MISSING_CHECKED, roles.target, "conn_state"), f"{out}/missing_by_label_and_state"),
        "per_date": write_table(profile.samples_per_date(text, roles.date, roles.target), f"{out}/samples_per_date"),
        "held_out": write_table(cleaning.held_out_count(text, roles.target), f"{out}/held_out"),
        "excluded_columns": write_table(cleaning.excluded_report(text, roles.excluded), f"{out}/excluded_columns"),
        "modelling": write_table(cleaning.modelling_table(base, roles), f"{out}/modelling"),
        "metadata": write_table(cleaning.metadata_table(base, roles), f"{out}/metadata"),
    }
    modelling, metadata = spark.read.parquet(paths["modelling"]), spark.read.parquet(paths["metadata"])
    cleaning.check_labels(modelling, roles.target, list(CLASS_CODES.values()))
    identity.check_unique_ids(modelling, roles.row_id, "modelling")
    identity.check_alignment(modelling, metadata, roles.row_id)
    return paths


def judge_features(spark: SparkSession, prepared: str, out: str, roles: Roles = CONNECTION_LOG) -> dict[str, str]:
    rows = spark.read.parquet(f"{prepared}/modelling")
    cleaning.check_labels(rows, roles.target, list(CLASS_CODES.values()))
    counts = features.category_counts(rows, roles.categorical, roles.target)
    numeric, categorical = features.numeric_summary(rows, roles.numeric, roles.target), features.categorical_summary(counts)
    detailed = features.summary_with_detail(categorical, features.top_category_table(counts))
    tables = {"numeric": numeric, "categorical": detailed, "recommendations": features.recommendations(numeric, categorical)}
    return {name: write_table(table, f"{out}/{name}") for name, table in tables.items()}


def dated_rows(spark: SparkSession, prepared: str, roles: Roles = CONNECTION_LOG) -> DataFrame:
    """Modelling rows with their capture date as a date."""
    modelling, metadata = spark.read.parquet(f"{prepared}/modelling"), spark.read.parquet(f"{prepared}/metadata")
    identity.check_alignment(modelling, metadata, roles.row_id)
    return cleaning.join_on_row_id(modelling, metadata, roles).withColumn(roles.date, F.expr(f"try_cast({roles.date} AS date)"))


def _split(spark, prepared, train_days, test_days, judged, roles) -> tuple[DataFrame, DataFrame, Roles]:
    approved = features.approved_roles(spark.read.parquet(f"{judged}/recommendations") if judged else None, roles)
    rows = rolling.keep(dated_rows(spark, prepared, roles), "dated")
    splits.check_chronological_split(rows, train_days, test_days, roles)
    return splits.dates_in(rows, roles.date, train_days), splits.dates_in(rows, roles.date, test_days), approved


def train_tree(spark: SparkSession, prepared: str, out: str, train_days: Sequence[str], test_days: Sequence[str],
               judged: str | None = None, roles: Roles = CONNECTION_LOG) -> dict[str, str]:
    train, test, approved = _split(spark, prepared, train_days, test_days, judged, roles)
    model = tree.fit_tree(train, approved)
    scored = rolling.keep(model.predict(test), "tree")
    days = spark.createDataFrame([(d,) for d in test_days], "d string").select(F.col("d").cast("date").alias(roles.date))
    importances = model.importances()
    names = {f"test_{r}": r for r in evaluation.RATES} | {"test_roc_auc": "roc_auc"} | {c: c for c in evaluation.COUNTS}
    wide = evaluation.model_comparison(scored.withColumn("model", F.lit("tree")))
    on_train = evaluation.long_metrics(evaluation.add_rates(evaluation.confusion(model.predict(train))), {"train_accuracy": "accuracy", "train_f1_score": "f1_score"})
    sizes = evaluation.long_metrics(train.agg(F.count("*").alias("n")), {"train_samples": "n"}).unionByName(
        evaluation.long_metrics(test.agg(F.count("*").alias("n")), {"test_samples": "n"}))
    tables = {
        "metrics": profile.union_all([on_train, evaluation.long_metrics(wide, names), sizes]),
        "predictions": rolling.prediction_table(scored, roles, probability=True),
        "confusion": evaluation.confusion_table(evaluation.confusion(scored)), "roc": evaluation.roc_points(scored),
        "report": evaluation.class_report(evaluation.confusion(scored)), "daily": evaluation.daily_metrics(scored, days, roles.date),
        "importances": importances, "top_importances": tree.top_importances(importances), "importance_by_column": tree.importance_by_column(importances),
    }
    return {name: write_table(table, f"{out}/{name}") for name, table in tables.items()}


def train_forest(spark: SparkSession, prepared: str, out: str, train_days: Sequence[str], test_days: Sequence[str],
                 judged: str | None = None, roles: Roles = CONNECTION_LOG) -> dict[str, str]:
    """Benign rows of the train days, 80/20 into fit and calibration; 0.99 quantile threshold; metrics on the test days."""
    train, test, approved = _split(spark, prepared, train_days, test_days, judged, roles)
    parted = rolling.keep(splits.random_split(splits.benign_only(train, roles.target), roles.row_id, 0.2), "parted")
    fit_rows, calibration = parted.where("split = 'training'").drop("split"), parted.where("split = 'testing'").drop("split")
    result = rolling.calibrated_detector(
        fit_rows, calibration, test, approved, lambda rows, r, group: forest.fit_forest(rows, r, group=group))
    scored = result["scores"].withColumn("part", F.concat_ws(" ", "part", F.col("actual").cast("string")))
    # the automatic threshold next to the calibrated one
    baseline = profile.union_all([rolling.as_model(result["test"], "automatic threshold", "automatic"), rolling.as_model(result["test"], "calibrated threshold")])
    tables = {
        "metrics": rolling.detector_report(result, fit_rows.count(), train, roles.target), "baseline_and_calibrated": evaluation.model_comparison(baseline),
        "predictions": rolling.prediction_table(result["test"], roles, result["threshold"]),
        "report": evaluation.class_report(evaluation.confusion(result["test"])),
        "diagnostics": evaluation.score_diagnostics(scored, "part", "score", result["threshold"]),
        "histogram": evaluation.score_histogram(result["test"], "actual", "score"), "nodes": result["model"].nodes,
    }
    return {name: write_table(table, f"{out}/{name}") for name, table in tables.items()}


def enrich(spark: SparkSession, root: str, domain_feed: DataFrame, out: str, start: str, end: str) -> dict[str, str]:
    """Domain intelligence over all days: candidates, verdicts, timing, coverage, enriched flows.

    ``domain_feed``: domain, query_status, firstseen and any other verdict columns.
    """
    prepare_session(spark)
    raw = zeek.scan(spark, root, CONNECTIONS, markers=())
    flows = raw.withColumns({"label_clean": tidy_label(F.col("label")), "ts": F.expr("timestamp_micros(cast(try_cast(ts AS decimal(20,6)) * 1000000 AS bigint))")})
    logs = {}
    for source, (log, column) in HOST_LOGS.items():
        try:
            logs[source] = (zeek.scan(spark, root, log, columns=["uid", column]), column)
        except FileNotFoundError:
            continue
    flows = rolling.keep(flows, "flows")
    hosts = rolling.keep(intel.host_observations(logs), "hosts") if logs else spark.createDataFrame([], "uid string, source string, indicator string")
    classified = intel.classify_domains(intel.domain_candidates(hosts))
    verdicts = rolling.keep(intel.enrich_domains(intel.public_domains(classified), domain_feed), "verdicts")
    matches = intel.matched_domains(verdicts, start, end)
    seen = rolling.keep(intel.historical_observations(hosts, intel.historical_domains(matches)), "seen")  # read for uids, domains and flows
    enriched = rolling.keep(intel.enrich_flows(flows, intel.uid_features(seen)), "enriched")
    roles = intel.ip_roles(flows, "id_orig_h", "id_resp_h")
    tables = {
        "indicators": intel.indicator_availability(hosts), "candidates": classified, "candidate_types": intel.domain_type_counts(classified),
        "verdicts": verdicts, "timing": intel.timing_counts(matches), "historical_coverage": intel.historical_coverage(seen, flows, hosts),
        "flows": enriched, "coverage_by_label": intel.coverage_by_label(enriched, "label_clean"), "ip_types": intel.ip_type_counts(roles),
        "ip_candidates": intel.public_ip_candidates(roles), "public_ip_coverage": intel.public_ip_coverage(flows, "label_clean", "id_orig_h", "id_resp_h"),
        "public_responders": intel.public_responder_summary(flows, "label_clean", "id_resp_h"), "shared_public_ips": intel.shared_public_ips(flows, "label_clean", "id_resp_h"),
        "host_logs": spark.createDataFrame([(s, log, s in logs) for s, (log, _) in HOST_LOGS.items()], "source string, log string, found boolean"),
    }
    return {name: write_table(table, f"{out}/{name}") for name, table in tables.items()}


# Columns of the file log that the hash tables need, and the file families of the attack table.
FILE_LOG = "files.log.labeled"
FILE_COLUMNS = {"conn_uids": "string", "filename": "string", "md5": "string", "sha1": "string", "sha256": "string", "seen_bytes": "long", "total_bytes": "long",
                "missing_bytes": "long", "overflow_bytes": "long", "timedout": "string"}
FAMILIES = ("RemcosRAT", "PyExfil")
AUDITED = ("service", "duration", "orig_bytes", "resp_bytes", "history")


def explore(spark: SparkSession, root: str, out: str, roles: Roles = CONNECTION_LOG) -> dict[str, str]:
    """Exploration tables over all days: labels and details per day, attack families, column audit, missing shares, representative rows."""
    prepare_session(spark)
    scanned = zeek.scan(spark, root, CONNECTIONS, markers=UNSET_OR_EMPTY, keep_order=True)
    rows = identity.row_ids_by_file_order(cleaning.with_clean_label(scanned, roles.target), roles.row_id)
    labels = ["benign", "malicious", "unknown"]
    details = rolling.keep(profile.daily_detail_counts(rows, roles.date, "label_clean", "detailedlabel"), "details")
    audited = [c for c in AUDITED if c in rows.columns]
    by_label = rolling.keep(profile.missing_percent_by_label(rows, audited, "label_clean"), "missing")
    tables = {
        "daily_labels": profile.daily_label_summary(rows, roles.date, roles.target), "daily_details": details, "attacks": profile.attack_summary(details),
        "families": profile.attack_families(profile.attack_summary(details), FAMILIES),
        "column_audit": profile.column_audit(rows, dict(rows.dtypes)), "missing_by_label": by_label, "missing_by_feature": profile.missing_percent_by_feature(by_label, audited, labels),
        "date_by_label": profile.date_label_crosstab(rows, roles.date, "label_clean", labels),
        "representative": splits.representative_sample(rows, roles.date, "label_clean", "detailedlabel", roles.row_id),
    }
    return {name: write_table(table, f"{out}/{name}") for name, table in tables.items()}


def hash_intelligence(spark: SparkSession, root: str, hash_feed: DataFrame, out: str, batch: str = "first") -> dict[str, str]:
    """File-hash tables, and verdicts for the candidates that have no final answer yet in ``out``/lookups.

    A stopped or partly failed lookup is resumed by calling again with another ``batch``: only pending hashes are asked for.
    """
    prepare_session(spark)
    scanned = zeek.scan(spark, root, FILE_LOG, markers=UNSET_OR_EMPTY)
    text = [F.col(c).try_cast(kind).alias(c) if c in scanned.columns else F.lit(None).cast(kind).alias(c) for c, kind in FILE_COLUMNS.items()]
    files = rolling.keep(scanned.select("capture_date", *text), "files")
    candidates = rolling.keep(intel.hash_candidates(files), "hashes")
    lookups = f"{out}/lookups"
    known = read_lookups(spark, lookups)  # without an earlier batch everything is pending
    pending = intel.pending_lookups(candidates, known, "sha1") if known else candidates
    append_lookups(rolling.keep(intel.enrich_hashes(pending, hash_feed), "verdicts"), lookups, batch)
    verdicts = read_lookups(spark, lookups)
    tables = {
        "availability": intel.hash_availability(files), "linkage": intel.hash_linkage(files), "candidates": candidates, "quality": intel.hash_quality(files),
        "status": intel.status_distribution(verdicts.drop("batch")), "pending": intel.pending_lookups(candidates, verdicts, "sha1"),
    }
    return {"lookups": lookups} | {name: write_table(table, f"{out}/{batch}/{name}") for name, table in tables.items()}


def detector_study(spark: SparkSession, prepared: str, out: str, train_days: Sequence[str], test_days: Sequence[str], judged: str | None = None,
                   roles: Roles = CONNECTION_LOG, trees: int = 200) -> dict[str, str]:
    """All detectors side by side: history crosstab, ablation, frozen tree per day, rolling refit, common test days, recall per family."""
    approved = features.approved_roles(spark.read.parquet(f"{judged}/recommendations") if judged else None, roles)
    time = F.expr("timestamp_micros(cast(try_cast(ts AS decimal(20,6)) * 1000000 AS bigint))").alias("ts")
    extra = spark.read.parquet(f"{prepared}/metadata").select(roles.row_id, time, "detailedlabel")
    every = rolling.keep(dated_rows(spark, prepared, roles).join(extra, roles.row_id), "dated")
    splits.check_chronological_split(every, train_days, test_days, roles)
    train, test = splits.dates_in(every, roles.date, train_days), splits.dates_in(every, roles.date, test_days)

    def grown(rows: DataFrame, chosen: Roles, group: str | None):
        return forest.fit_forest(rows, chosen, trees=trees, group=group)

    def one_class(rows: DataFrame, chosen: Roles, group: str | None):
        return oneclass.fit_one_class(rows, chosen, group=group)

    model = tree.fit_tree(train, approved)
    frozen = rolling.frozen_model_daily(model, test)
    benign = rolling.keep(splits.random_split(splits.benign_only(train, roles.target), roles.row_id, 0.2), "benign")
    fit_rows, calibration = benign.where("split = 'training'").drop("split"), benign.where("split = 'testing'").drop("split")
    compared = [rolling.as_model(frozen["predictions"], "Decision Tree")]
    tables = {"frozen_daily": frozen["daily"], "frozen_overall": frozen["overall"]}
    for name, short, fit in (("Isolation Forest - 1% calibrated", "forest", grown), ("One-Class SVM - 1% calibrated", "one_class", one_class)):
        compared.append(rolling.as_model(rolling.calibrated_detector(fit_rows, calibration, test, approved, fit)["test"], name))
        rolled = rolling.rolling_evaluation(every, approved, "ts", fit)
        tables |= {f"rolling_{short}_daily": rolled["daily"], f"rolling_{short}_overall": rolled["overall"]}
    variants = {"all features": approved} | ({"without history": approved.without("history")} if "history" in approved.categorical else {})
    tables |= {"common_test": rolling.common_test_comparison(compared), "ablation": tree.ablation(train, test, variants)}
    per_day = rolling.keep(evaluation.family_performance(frozen["predictions"].where("actual = 1"), "detailedlabel"), "families")
    overall = evaluation.family_overall(per_day)
    tables |= {"family_daily": per_day, "family_overall": overall, "family_recall": evaluation.family_recall(overall)}
    return {name: write_table(table, f"{out}/{name}") for name, table in tables.items()}
