"""The whole workflow over generated day folders."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_sources import write_log
from tidewatch.plans import jobs
from tidewatch.sources.tables import read_lookups

FIELDS = ("ts uid id.orig_h id.orig_p id.resp_h id.resp_p proto service duration orig_bytes resp_bytes missed_bytes orig_pkts orig_ip_bytes "
          "resp_pkts resp_ip_bytes conn_state history label detailedlabel").split()
TYPES = "time string addr port addr port enum string interval count count count count count count count string string string string".split()
DAYS = ["2023-02-20", "2023-02-21", "2023-02-22"]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder, rng, n = tmp_path_factory.mktemp("logs"), np.random.default_rng(1), 0
    for d, day in enumerate(DAYS):
        rows, names = [], []
        for i in range(200):
            bad = i % 4 == 0
            label = "Unknown" if i % 50 == 7 else "Malicious" if bad else "Benign"
            size = rng.integers(5000, 9000) if bad else rng.integers(10, 900)
            rows.append([f"{1676851200 + d * 86400 + i * 400}.000001", f"C{n}", "10.0.0.5", str(50000 + i), "8.8.8.8" if bad else "10.0.0.9", "53", "tcp", "-" if i % 3 else "dns",
                         "-" if i % 10 == 1 else f"{rng.random():.6f}", str(size), "5", "0", "1", str(size + 40), "1", "45", "REJ" if bad else "SF", "Sr" if bad else "Dd",
                         label, "From_malicious-RemcosRAT" if bad else "(empty)"])
            names.append([f"C{n}", "Bad.Example.com." if bad else "localhost"])
            n += 1
        write_log(folder, day, rows, FIELDS, TYPES)
        write_log(folder, day, names, ["uid", "query"], ["string", "string"], "dns.log.labeled")
    return str(folder)


def test_workflow(spark, root, tmp_path):
    out = str(tmp_path)
    report = {(r["section"], r["item"]): r["value"] for r in spark.read.parquet(jobs.profile_days(spark, root, f"{out}/profile")).collect()}
    assert report["dataset", "total_rows"] == "600" and report["dataset", "duplicate_rows"] == "0"
    assert report["dataset", "timestamp_min_utc"] == "2023-02-20T00:00:00.000001"

    jobs.prepare(spark, root, f"{out}/prepared")
    modelling = spark.read.parquet(f"{out}/prepared/modelling")
    assert sorted(r[0] for r in modelling.select("flow_row_id").collect()) == list(range(600 - 12))
    first = spark.read.parquet(f"{out}/prepared/metadata").where("flow_row_id = 7").first()
    assert first["uid"] == "C8"  # the eighth row of the first day is Unknown

    jobs.judge_features(spark, f"{out}/prepared", f"{out}/features")
    verdicts = {r["feature"]: r["recommendation"] for r in spark.read.parquet(f"{out}/features/recommendations").collect()}
    assert len(verdicts) == 14 and verdicts["missed_bytes"] == "DROP" and verdicts["orig_bytes"] == "KEEP"

    jobs.train_tree(spark, f"{out}/prepared", f"{out}/tree", DAYS[:2], DAYS[2:], f"{out}/features")
    metrics = {r["metric"]: r["value"] for r in spark.read.parquet(f"{out}/tree/metrics").collect()}
    assert metrics["test_accuracy"] == 1.0 and metrics["train_samples"] == 392 and metrics["test_samples"] == 196

    jobs.train_forest(spark, f"{out}/prepared", f"{out}/forest", DAYS[:2], DAYS[2:], f"{out}/features")
    metrics = {r["metric"]: r["value"] for r in spark.read.parquet(f"{out}/forest/metrics").collect()}
    assert metrics["benign_fit_records_used_for_if_training"] + metrics["benign_calibration_records"] == metrics["benign_train_records_total"]
    assert metrics["test_roc_auc"] > 0.9


def test_enrichment(spark, root, tmp_path):
    feed = spark.createDataFrame([("bad.example.com", "ok", "2023-01-01 00:00:00 UTC")], "domain string, query_status string, firstseen string")
    jobs.enrich(spark, root, feed, str(tmp_path), "2023-02-20", "2023-02-27")
    coverage = {r["label_clean"]: r["cti_matched_records"] for r in spark.read.parquet(f"{tmp_path}/coverage_by_label").collect()}
    flows = spark.read.parquet(f"{tmp_path}/flows")
    assert coverage == {"malicious": flows.where("label_clean = 'malicious'").count(), "benign": 0, "unknown": 0}
    assert flows.where("cti_match = 1").agg(F.min("cti_age_days")).first()[0] == pytest.approx(50.0, abs=0.01)
    assert {r["ip_type"] for r in spark.read.parquet(f"{tmp_path}/ip_types").collect()} == {"Public", "Private"}
    assert {r["source"]: r["found"] for r in spark.read.parquet(f"{tmp_path}/host_logs").collect()} == {"dns": True, "http": False, "ssl": False}
    assert spark.read.parquet(f"{tmp_path}/public_responders").count() > 0


def test_exploration(spark, root, tmp_path):
    jobs.explore(spark, root, str(tmp_path))
    daily = {r["date"]: r["total"] for r in spark.read.parquet(f"{tmp_path}/daily_labels").collect()}
    assert daily == {**{d: 200 for d in DAYS}, "TOTAL": 600}
    families = spark.read.parquet(f"{tmp_path}/families").collect()
    assert {r["RemcosRAT"] for r in families} == {r["total_malicious"] for r in families} and len(families) == 3
    assert spark.read.parquet(f"{tmp_path}/representative").groupBy("capture_date", "label_clean").count().where("count > 200").isEmpty()


def test_hash_lookups_resume(spark, tmp_path):
    hashes = ["a" * 40, "b" * 40, "c" * 40]
    write_log(tmp_path / "logs", DAYS[0], [[h, "m" * 32, "C1", "T"] for h in hashes] + [["-", "-", "C2", "F"]], ["sha1", "md5", "conn_uids", "timedout"], ["string", "string", "string", "bool"], "files.log.labeled")
    feed = spark.createDataFrame([(hashes[0].upper(), "ok", "Fam"), (hashes[1], "HTTP_502", None)], "sha1 string, query_status string, signature string")
    out = str(tmp_path / "out")
    first = jobs.hash_intelligence(spark, str(tmp_path / "logs"), feed, out)
    assert {r["sha1"] for r in spark.read.parquet(first["pending"]).collect()} == set(hashes[1:])
    feed = spark.createDataFrame([(h, "hash_not_found", None) for h in hashes], "sha1 string, query_status string, signature string")
    again = jobs.hash_intelligence(spark, str(tmp_path / "logs"), feed, out, "retry")
    assert spark.read.parquet(again["pending"]).isEmpty()
    # the hash with a final answer was not asked for again
    assert {(r["sha1"], r["query_status"]) for r in read_lookups(spark, again["lookups"]).where("batch = 'retry'").collect()} == {(h, "hash_not_found") for h in hashes[1:]}


def test_detector_study(spark, root, tmp_path):
    jobs.prepare(spark, root, f"{tmp_path}/prepared")
    jobs.detector_study(spark, f"{tmp_path}/prepared", f"{tmp_path}/study", DAYS[:2], DAYS[2:], trees=20)
    compared = {r["model"]: r for r in spark.read.parquet(f"{tmp_path}/study/common_test").collect()}
    assert len(compared) == 3 and compared["Decision Tree"]["f1_score"] == 1.0
    assert {r["variant"] for r in spark.read.parquet(f"{tmp_path}/study/ablation").collect()} == {"all features", "without history"}
    assert {str(r["test_date"]) for r in spark.read.parquet(f"{tmp_path}/study/rolling_forest_daily").collect()} == set(DAYS[1:])
    assert spark.read.parquet(f"{tmp_path}/study/family_recall").first()["macro_recall"] == 1.0
