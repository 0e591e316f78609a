from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import cleaning, identity
from tidewatch.roles import CONNECTION_LOG
from tidewatch.sources import zeek
from tidewatch.sources.tables import read_table, write_table

LOG = "conn.log.labeled"
FIELDS = "ts uid id.orig_h id.orig_p id.resp_h id.resp_p proto service duration orig_bytes resp_bytes conn_state history label detailedlabel".split()
TYPES = "time string addr port addr port enum string interval count count string string string string".split()
ROWS = [
    "1676851369.210646 C1 192.168.1.5 50000 8.8.8.8 53 udp dns 0.020000 40 120 SF Dd Benign From_benign-To_benign".split(),
    "1676851370.000001 C2 192.168.1.5 50001 5.6.7.8 5888 tcp - - - - REJ Sr".split() + [" malicious ", "From_malicious-RemcosRAT"],
    "1676851371.500000 C#3 fe80::1 135 224.0.0.251 5353 udp".split() + ['"x'] + "1.0 oops 0 S0 - Unknown (empty)".split(),
    "1676851372.500000 C4 fe80::1 135 224.0.0.251 5353 udp null 1.0 5 0 S0 - Malicious -".split(),
]


def write_log(root, day, rows, fields=FIELDS, types=TYPES, log=LOG):
    folder = root / day / "zeek"
    folder.mkdir(parents=True, exist_ok=True)
    lines = ["#separator \\x09", "\t".join(["#fields", *fields]), "\t".join(["#types", *types]), *["\t".join(r) for r in rows], "#close\t2023"]
    (folder / log).write_text("\n".join(lines) + "\n")


@pytest.fixture
def root(tmp_path):
    write_log(tmp_path, "2023-02-20", ROWS[:3])
    write_log(tmp_path, "2023-02-21", ROWS[3:])
    return tmp_path


def test_missing_log_is_an_error(spark, root):
    with pytest.raises(FileNotFoundError):
        zeek.discover(spark, str(root), "dns.log.labeled")


@pytest.mark.parametrize("lines", [[], ["#fields\ta"], ["#types\tstring"], ["#fields\ta\tb", "#types\tstring"]])
def test_bad_headers(lines):
    with pytest.raises(ValueError):
        zeek.parse_header("x", lines)


def test_text_scan(spark, root):
    rows = {r["uid"]: r for r in zeek.scan(spark, str(root), LOG).collect()}
    assert set(rows) == {"C1", "C2", "C#3", "C4"}  # a '#' inside a field is data
    assert rows["C#3"]["service"] == '"x' and rows["C#3"]["detailedlabel"] is None
    assert rows["C2"]["service"] is None and rows["C2"]["label"] == " malicious "
    assert rows["C4"]["service"] == "null"  # only the log's own markers are missing
    assert rows["C4"]["capture_date"] == "2023-02-21" and rows["C4"]["source_file"].endswith(f"2023-02-21/zeek/{LOG}")
    assert rows["C1"]["id_orig_h"] == "192.168.1.5"


def test_typed_scan(spark, root):
    rows = {r["uid"]: r for r in zeek.scan(spark, str(root), LOG, markers=("-",), typed=True).collect()}
    assert rows["C1"]["id_orig_p"] == 50000 and rows["C1"]["duration"] == 0.02
    assert str(rows["C1"]["ts"]) == "2023-02-20 00:02:49.210646"
    assert rows["C#3"]["orig_bytes"] is None and rows["C#3"]["detailedlabel"] == "(empty)"


def test_raw_scan_keeps_markers(spark, root):
    rows = {r["uid"]: r for r in zeek.scan(spark, str(root), LOG, markers=()).collect()}
    assert rows["C2"]["service"] == "-" and rows["C#3"]["detailedlabel"] == "(empty)"


def test_days_with_different_headers_are_stacked_by_name(spark, root):
    write_log(root, "2023-02-22", [["C9", "extra"]], ["uid", "new"], ["string", "string"])
    rows = {r["uid"]: r for r in zeek.scan(spark, str(root), LOG).collect()}
    assert rows["C9"]["new"] == "extra" and rows["C9"]["label"] is None and rows["C1"]["new"] is None


def test_catalogue_reports_absent_logs(spark, root):
    found = zeek.header_catalogue(spark, str(root), [LOG, "x509.log.labeled"]).groupBy("log", "status").count().collect()
    assert {(r["log"], r["status"], r["count"]) for r in found} == {(LOG, "found", 15), ("x509.log.labeled", "not found", 1)}


def test_file_order_ids_are_dense_after_filtering(spark, tmp_path):
    for d in range(3):
        write_log(tmp_path, f"2023-02-2{d}", [[f"{d}-{i:05d}", "Unknown" if i % 7 == 0 else "Benign"] for i in range(500)], ["uid", "label"], ["string", "string"])
    rows = zeek.scan(spark, str(tmp_path), LOG, keep_order=True)
    numbered = identity.row_ids_by_file_order(cleaning.binary_rows(rows, "label"))
    got = [(r["flow_row_id"], r["uid"]) for r in numbered.orderBy("flow_row_id").collect()]
    assert got == list(enumerate(f"{d}-{i:05d}" for d in range(3) for i in range(500) if i % 7))


def test_file_order_ids_move_no_rows(spark, tmp_path):
    for d in range(2):
        write_log(tmp_path, f"2023-02-2{d}", [[f"{d}-{i:05d}", "Benign"] for i in range(50)], ["uid", "label"], ["string", "string"])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = zeek.scan(spark, str(tmp_path), LOG, keep_order=True)
        plan = identity.row_ids_by_file_order(rows)._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=broadcast" in plan
        many = identity.row_ids_by_file_order(rows, broadcast_blocks=1)  # counted as too many: a shuffle join
        assert "strategy=broadcast" not in many._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(r["flow_row_id"] for r in many.collect()) == list(range(100))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_feeds_are_tidied_and_one_row_a_key(spark):
    from tidewatch.operators import intel

    feed = spark.createDataFrame([(" AB12", "hash_not_found", None), ("ab12 ", "ok", "x"), ("ab12", "HTTP_502", None), (None, "ok", "y")], "sha1 string, query_status string, signature string")
    got = intel.enrich_hashes(spark.createDataFrame([("ab12",), ("AB12",), ("cd",)], "sha1 string"), feed).collect()
    assert sorted((r["sha1"], r["query_status"], r["signature"]) for r in got) == [("AB12", "ok", "x"), ("ab12", "ok", "x"), ("cd", None, None)]
    feed = spark.createDataFrame([("Example.COM.", "ok", "2023-01-01"), ("example.com", "ok", "2023-02-01"), ("example.com", "no_results", None)], "domain string, query_status string, firstseen string")
    got = intel.enrich_domains(spark.createDataFrame([("example.com",), ("other.org",)], "domain string"), feed).collect()
    assert sorted((r["domain"], r["query_status"], r["firstseen"]) for r in got) == [("example.com", "ok", "2023-02-01"), ("other.org", None, None)]


def test_modelling_and_metadata_align(spark, root):
    rows = cleaning.with_clean_label(zeek.scan(spark, str(root), LOG, keep_order=True), "label", "label")
    rows = rows.withColumn("label", F.initcap("label"))
    for name in ("missed_bytes", "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes"):
        rows = rows.withColumn(name, F.lit("0"))
    numbered = identity.row_ids_by_file_order(cleaning.binary_rows(rows, "label"))
    modelling, metadata = cleaning.modelling_table(numbered, CONNECTION_LOG), cleaning.metadata_table(numbered, CONNECTION_LOG)
    identity.check_alignment(modelling, metadata, "flow_row_id")
    identity.check_unique_ids(modelling, "flow_row_id", "modelling")
    assert modelling.columns == ["flow_row_id", *CONNECTION_LOG.features, "label"]
    assert sorted(r["label"] for r in modelling.collect()) == [0, 1, 1]
    with pytest.raises(ValueError):
        identity.check_alignment(modelling, metadata.limit(1), "flow_row_id")
    with pytest.raises(ValueError):
        identity.check_unique_ids(modelling.unionByName(modelling), "flow_row_id", "twice")
    with pytest.raises(ValueError):
        cleaning.check_labels(rows, "label", ["Benign", "Malicious"])


def test_csv_table_round_trip_with_dotted_names(spark, tmp_path):
    frame = spark.createDataFrame([("1.2.3.4", 5)], "id_orig_h string, n int")
    path = write_table(frame, str(tmp_path / "t"), "csv", dotted=True)
    assert spark.read.option("header", True).csv(path).columns == ["id.orig_h", "n"]
    assert read_table(spark, path, "csv", frame.schema).collect() == frame.collect()
    with pytest.raises(ValueError):
        read_table(spark, path, "csv")


def test_bad_lines_are_set_aside(spark, root):
    write_log(root, "2023-02-22", [ROWS[0], ROWS[0][:9], [*ROWS[0], "one more"], ["1676851369.210646", *ROWS[1][1:10], "many", *ROWS[1][11:]]])
    kept, bad = zeek.set_aside(zeek.scan(spark, str(root), LOG, bad="_bad"), "_bad")
    lines = {r["line"] for r in bad.where("capture_date = '2023-02-22'").collect()}
    assert lines == {"\t".join(ROWS[0][:9]), "\t".join([*ROWS[0], "one more"])} and bad.count() == 2 and kept.count() == 6  # words are text
    kept, bad = zeek.set_aside(zeek.scan(spark, str(root), LOG, markers=("-",), typed=True, bad="_bad", columns=["uid", "orig_bytes"]), "_bad")
    assert bad.groupBy("capture_date").count().where("capture_date = '2023-02-22'").first()["count"] == 3
    assert {r["uid"] for r in kept.collect()} == {"C1", "C2", "C4"}  # C#3 has a word for a number
    assert zeek.scan(spark, str(root), LOG).count() == 8  # without a column for them they stay


def test_headers_are_read_by_one_job(spark, tmp_path):
    for day in range(40):
        fields = FIELDS if day % 3 else FIELDS[:-1]
        write_log(tmp_path, f"2023-03-{day:02d} x%20y", [ROWS[0][: len(fields)]] * (3000 if day == 1 else 1), fields, TYPES[: len(fields)])
    paths = zeek.discover(spark, str(tmp_path), LOG)
    tracker, group = spark.sparkContext.statusTracker(), "headers"
    spark.sparkContext.setJobGroup(group, group)
    before = {n: spark.conf.get(n) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    headers = zeek.read_headers(spark, paths)
    jobs = len(tracker.getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 2 and [h.path for h in headers] == paths
    assert [len(h.fields) for h in headers] == [len(FIELDS) - (day % 3 == 0) for day in range(40)]
    assert {n: spark.conf.get(n) for n in before} == before
    assert zeek.scan(spark, str(tmp_path), LOG).count() == 3039


def test_file_order_ids_do_not_depend_on_how_files_are_cut(spark, tmp_path):
    for d in range(2):
        write_log(tmp_path, f"2023-02-2{d}", [[f"{d}-{i:05d}", "Unknown" if i % 7 == 0 else "Benign"] for i in range(6000)], ["uid", "label"], ["string", "string"])
    size, got = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    try:
        for first, second in (("134217728b", "134217728b"), ("20000b", "134217728b"), ("134217728b", "7000b")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", first)
            rows = cleaning.binary_rows(zeek.scan(spark, str(tmp_path), LOG, keep_order=True), "label")
            numbered = identity.row_ids_by_file_order(rows)
            spark.conf.set("spark.sql.files.maxPartitionBytes", second)  # the cluster changes before the ids are read
            got.append(sorted((r["flow_row_id"], r["uid"]) for r in numbered.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got[0] == got[1] == got[2] == list(enumerate(f"{d}-{i:05d}" for d in range(2) for i in range(6000) if i % 7))


def test_a_stopped_batch_is_never_read(spark, tmp_path, monkeypatch):
    from tidewatch.sources import tables

    path = str(tmp_path / "lookups")
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "sha1 string, query_status string")
    assert tables.read_lookups(spark, path) is None
    tables.append_lookups(rows(("a", "ok"), ("b", "HTTP_502")), path, "first batch/1")
    read = lambda: sorted((r["batch"], r["sha1"], r["query_status"]) for r in tables.read_lookups(spark, path).collect())
    first = [("first batch/1", "a", "ok"), ("first batch/1", "b", "HTTP_502")]
    assert read() == first
    # stopped while rows are written: one row fails in its task
    broken = rows(("c", "ok"), ("d", "ok")).repartition(2).withColumn("query_status", F.expr("if(sha1 = 'd', raise_error('stopped'), query_status)"))
    for batch in ("second", "first batch/1"):
        with pytest.raises(Exception, match="stopped"):
            tables.append_lookups(broken, path, batch)
        assert read() == first
    # stopped between the rows and the marker
    with monkeypatch.context() as m:
        m.setattr(tables, "quote", lambda *a, **k: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            tables.append_lookups(rows(("c", "ok")), path, "second")
    assert read() == first
    tables.append_lookups(rows(("c", "ok")), path, "second")
    tables.append_lookups(rows(("b", "ok")), path, "first batch/1")  # a repeated batch replaces itself
    assert read() == [("first batch/1", "b", "ok"), ("second", "c", "ok")]
    tables.append_lookups(rows(), path, "second")
    assert read() == [("first batch/1", "b", "ok")]
