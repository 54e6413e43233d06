import json

from pyspark.sql import functions as F

from tracewell import ext
from tracewell.functions.text import explode_once
from tracewell.operators import alerts, intel, normalize, risk
from tracewell.plans import pipeline, q_pipeline
from tracewell.schema import complete_events
from tracewell.sources import logs, sinks
from tracewell.streaming import ingest

# An invented case: a remote-help program drops a script host's payload, which plants a service and calls home.
PAYLOAD = "0f" * 32
ALERT = {
    "id": "q-88", "title": "Remote help misused", "severity": "High", "timestamp": "2026-07-02T03:14:09Z", "host": "BOOTH-2", "user": "kiosk",
    "description": f"quickhelp.exe on BOOTH-2 wrote blinker.dll ({PAYLOAD}), later traffic to 203.0.113.9 and drop.example.net",
    "rule_name": "Unattended support session", "tags": ["initial-access", "night"],
}
SYSMON = [
    {"EventID": 11, "UtcTime": "2026-07-02T03:02:51Z", "Computer": "BOOTH-2", "Image": "C:\\Tools\\quickhelp.exe",
     "TargetFilename": "C:\\Users\\kiosk\\blinker.dll", "Hashes": f"MD5=00,SHA256={PAYLOAD}"},
    {"EventID": 1, "UtcTime": "2026-07-02T03:05:20Z", "Computer": "BOOTH-2", "User": "kiosk", "Image": "C:\\Windows\\System32\\rundll32.exe",
     "ProcessId": 77, "ParentImage": "C:\\Tools\\quickhelp.exe", "ParentProcessId": 12},
    {"EventID": 13, "UtcTime": "2026-07-02T03:05:44Z", "Computer": "BOOTH-2", "Image": "rundll32.exe",
     "TargetObject": "HKLM\\System\\CurrentControlSet\\Services\\Blinker"},
    {"EventID": 3, "UtcTime": "2026-07-02T03:09:02Z", "Computer": "BOOTH-2", "Image": "rundll32.exe", "ProcessId": 77,
     "DestinationIp": "203.0.113.9", "DestinationPort": 4444},
    {"EventID": 22, "UtcTime": "2026-07-02T03:09:40Z", "Computer": "BOOTH-2", "Image": "rundll32.exe", "QueryName": "drop.example.net"},
    {"EventID": 1, "UtcTime": "2026-07-02T03:31:00Z", "Computer": "BOOTH-2", "User": "kiosk", "Image": "C:\\Windows\\System32\\whoami.exe",
     "ProcessId": 81, "ParentImage": "C:\\Windows\\System32\\rundll32.exe", "ParentProcessId": 77},
]


def _folder(tmp_path):
    (tmp_path / "logs" / "deep").mkdir(parents=True)
    (tmp_path / "logs" / "a.jsonl").write_text("\n\n".join(json.dumps(r) for r in SYSMON) + "\nplain text\n")
    (tmp_path / "logs" / "deep" / "b.json").write_text(json.dumps([{"message": "one", "host": "x"}, {"message": "two"}], indent=1))
    (tmp_path / "logs" / "deep" / "c.json").write_text(json.dumps({"message": "three"}))
    (tmp_path / "logs" / "skip.csv").write_text("no,log\n")
    (tmp_path / "alert.json").write_text(json.dumps([ALERT, ALERT]))
    return tmp_path


def test_folder_of_logs(spark, tmp_path):
    folder = _folder(tmp_path)
    events = normalize.normalize(logs.read_logs(spark, str(folder / "logs")), ingest_ts="2026-01-01 00:00:00")
    rows = events.orderBy("timestamp").collect()
    assert len(rows) == 10 and len({r.event_id for r in rows}) == 10
    assert sorted(r.activity_name for r in rows if r.class_uid == 2004) == ["one", "plain text", "three", "two"]
    assert [r.source_type for r in rows if r.activity_name == "plain text"] == ["a.jsonl"]
    sysmon = [r for r in rows if r.source_type == "sysmon"]
    assert [r.class_uid for r in sysmon] == [1001, 1007, 201002, 4001, 1007, 1007]
    assert sysmon[0].file_hash == PAYLOAD and (sysmon[3].dst_ip, sysmon[3].dst_port) == ("203.0.113.9", 4444)


def test_whole_story(spark, tmp_path):
    folder = _folder(tmp_path)
    found = alerts.normalize_alerts(logs.read_alerts(spark, str(folder / "alert.json")))
    assert found.count() == 2
    one = alerts.dedupe_alerts(found).withColumn("incident_id", F.lit("inc"))
    events = normalize.normalize(logs.read_lines(spark, str(folder / "logs")), parser="sysmon").filter("timestamp IS NOT NULL")
    events.withColumn("incident_id", F.lit("inc")).write.parquet(str(tmp_path / "events"))
    events = spark.read.parquet(str(tmp_path / "events"))
    done = pipeline.investigate(one, events)
    report = done.report.first()
    assert report.patient_zero == "BOOTH-2" and report.event_count == 6
    assert report.timeline_count >= 5 and report.blast_radius > 0 and report.total_score >= 20
    assert report.techniques
    assert report.ioc_count >= 3 and "[evidence: " in report.narrative
    assert {"nonstandard_port_c2", "discovery_activity"} & {f.rule_id for f in report.factors}
    done.write(str(tmp_path / "out"))
    assert json.loads(next((tmp_path / "out" / "report").glob("*.json")).read_text().splitlines()[0])["incident_id"] == "inc"
    sinks.write_graph(done.nodes, done.edges, str(tmp_path / "graph"), "json")
    assert spark.read.json(str(tmp_path / "graph" / "nodes")).count() == done.nodes.count()


def test_alert_fields(spark):
    docs = [{"alert_id": 7, "name": "n", "level": "LOW", "@timestamp": 1700000000, "device": "d", "rule": "r"}, {"x": 1}, ALERT]
    df = spark.createDataFrame([(json.dumps(d), i) for i, d in enumerate(docs)], "raw string, seq int")
    rows = {r.seq: r for r in alerts.normalize_alerts(df, "2026-01-01 00:00:00").collect()}
    assert (rows[0].id, rows[0].title, rows[0].severity, rows[0].host, rows[0].rule_name) == ("7", "n", "low", "d", "r")
    assert rows[0].timestamp.year == 2023 and rows[1].title == "Untitled Alert" and rows[1].severity == "medium"
    assert len(rows[1].id) == 64 and rows[2].tags == ["initial-access", "night"] and rows[2].severity == "high"


def test_zero_is_nothing_but_the_text_zero_is_something(spark):
    docs = ['{"Computer": 0, "host": "h"}', '{"Computer": "0", "host": "h"}', '{"Computer": false, "host": "h"}', '{"Computer": "", "host": "h"}']
    df = spark.createDataFrame([(d, i) for i, d in enumerate(docs)], "raw_data string, seq int")
    got = {r.seq: r.host for r in normalize.normalize(df, parser="sysmon").collect()}
    assert got == {0: "h", 1: "0", 2: "h", 3: "h"}


def test_event_xml(spark):
    good = ('<Event><System><Provider Name="P"/><EventID Qualifiers="1">4624</EventID><Channel>Security</Channel><Computer>DC01</Computer></System>'
            '<EventData><Data Name="TargetUserName">admin</Data><Data Name="TargetUserName">last</Data><Data>unnamed</Data></EventData></Event>')
    df = spark.createDataFrame([(good,), ("<broken",), ("<Event><System><EventID>1</EventID></System></Event>",)], "value string")
    raw = [json.loads(r.raw_data) for r in logs.windows_event_xml(df).collect()]
    assert {"EventID": "4624", "Computer": "DC01", "Channel": "Security", "source": "P", "TargetUserName": "last"} in raw
    assert len(raw) == 2


def test_extensions(spark):
    ext.register_source("door", lambda r: F.try_variant_get(r, "$.badge", "string").isNotNull(),
                        {"class_uid": lambda r: F.lit(3002), "activity_name": lambda r: F.lit("open"), "user": ("badge",)})
    ext.register_provider("house_list", ["ipv4"], lambda r: {
        "is_malicious": F.try_variant_get(r, "$.bad", "boolean"), "threat_score": F.lit(77.0), "confidence": F.lit(0.5)})
    seen = []
    ext.register_sink("keep", lambda df: seen.append(df.count()))
    try:
        df = spark.createDataFrame([('{"badge": "b1"}', 1)], "raw_data string, seq int")
        row = normalize.normalize(df).first()
        assert (row.source_type, row.class_uid, row.user) == ("door", 3002, "b1")
        feed = spark.createDataFrame([("house_list", "ipv4", "1.1.1.1", 200, '{"bad": true}'), ("house_list", "md5", "x", 200, "{}"),
                                      ("nobody", "ipv4", "1.1.1.1", 200, "{}")],
                                     "provider string, ioc_type string, ioc_value string, http_status int, response string")
        merged = intel.aggregate_verdicts(intel.verdicts(feed)).collect()
        assert [(m.ioc_value, m.is_malicious, m.threat_score) for m in merged] == [("1.1.1.1", True, 77.0)]
        ext.export(df, "keep")
        assert seen == [1]
    finally:
        for name in ("door", "house_list", "keep"):
            ext.unregister(name)


def test_rule_overrides(spark):
    rules = risk.rule_table(spark, spark.createDataFrame(
        [("persistence", 1, "first", 1), ("persistence", 2, "second", 2), ("own", 5, None, 3), ("dc_target", 0, "x", 4)],
        "id string, score int, description string, ord int"))
    got = {r.rule_id: (r.score, r.description) for r in rules.collect()}
    assert got["persistence"] == (2, "second") and got["own"] == (5, "own") and got["dc_target"][0] == 15


def test_names_of_events_do_not_depend_on_splits(spark, tmp_path):
    lines = [f'{{"EventID": {i % 7}, "host": "h{i}"}}' for i in range(200)] + ["same line"] * 5
    (tmp_path / "a.log").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    names = []
    for size in ("1k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        events = normalize.normalize(logs.read_logs(spark, str(tmp_path)), ingest_ts="2026-01-01 00:00:00")
        names.append({r.event_id for r in events.select("event_id").collect()})
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert names[0] == names[1] and len(names[0]) == 205


def test_lines_are_numbered_without_a_shuffle_of_their_text(spark, tmp_path):
    """A line repeated in nearly the whole file, blank lines between, files without any line, cut in splits of two sizes."""
    texts = {"hot.log": ["same"] * 3000 + ["", "  ", "other"] + ["same"] * 3000, "b.jsonl": ["x", "", "y"], "none.log": [], "blank.log": ["", " "]}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if name == "b.jsonl" else ""))
    want = {(name, i, t) for name, lines in texts.items() for i, t in enumerate(x for x in lines if x.strip())}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("700", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        rows = logs.read_lines(spark, str(tmp_path))
        got = rows.select("file_name", "line", "raw_data").collect()
        plan = rows._jdf.queryExecution().executedPlan().toString()
        beyond = logs.numbered(logs.keep_lines(logs.with_file(spark.read.text(str(tmp_path)))), logs.BROADCAST_SPLITS + 1)
        same = {tuple(r) for r in beyond.select("file_name", "line", "raw_data").collect()}
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert len(got) == len(want) and {tuple(r) for r in got} == same == want
        exchanged = [line for line in plan.split("\n") if "Exchange hash" in line]
        assert "BroadcastHashJoin" in plan and exchanged and not [line for line in exchanged if "raw_data" in line]


def _stream_of(spark, df, folder):
    df.write.parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


def _small_events(spark, ids, host, day="2026-01-01"):
    docs = [(json.dumps({"EventID": 1, "UtcTime": f"{day} 10:00:0{i % 10}", "Computer": host, "Image": f"p{i}.exe"}), i) for i in ids]
    raw = spark.createDataFrame(docs, "raw_data string, seq int")
    return normalize.normalize(raw, parser="sysmon").withColumn("event_id", F.concat(F.lit("e"), "seq"))


def test_event_store_keeps_the_latest_commit(spark, tmp_path):
    store = str(tmp_path / "store")
    sinks.write_events(_small_events(spark, range(6), "one"), store, 0)
    sinks.write_events(_small_events(spark, [2, 3, 9], "two", "2026-02-02"), store, "again")
    seen = lambda: {r.event_id: r.host for r in sinks.read_events(spark, store).collect()}
    want = {"e0": "one", "e1": "one", "e2": "two", "e3": "two", "e4": "one", "e5": "one", "e9": "two"}
    assert seen() == want
    sinks.write_events(_small_events(spark, range(6), "one"), store, 0)  # repeated after a later one: the later one stays
    assert seen() == want
    sinks.write_events(_small_events(spark, range(5), "half"), store, 7)
    lost = spark.createDataFrame([("e0", "x", "processes", "2026-01-01")], "event_id string, host string, table_name string, event_date string")
    lost.write.partitionBy("table_name", "event_date").parquet(f"{store}/events/batch=bbroken")  # never committed
    assert seen() == want | {f"e{i}": "half" for i in range(5)}
    plan = sinks.read_events(spark, store).filter("table_name = 'processes' AND event_date = DATE '2026-02-02'")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in text and "event_date" in text and "hashpartitioning" not in text
    assert [r.event_id for r in plan.collect()] == ["e9"]
    sinks.compact_events(spark, store, str(tmp_path / "compact"))
    assert {r.event_id: r.host for r in sinks.read_events(spark, str(tmp_path / "compact")).collect()} == seen()


def test_streams_go_on_in_a_store(spark, tmp_path):
    """Three runs: two with the first checkpoint, one with a new one; late, future and known alerts."""
    def documents(ids, year):
        return spark.createDataFrame([(json.dumps({"id": f"x{i}", "title": str(year), "timestamp": f"{year}-01-01T00:00:00Z"}), i) for i in ids], "raw string, seq int")

    def run(df, source, log):
        df.write.mode("append").parquet(str(tmp_path / source))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / source))
        ingest.dedupe_alerts_stream(stream, str(tmp_path / "alerts"), str(tmp_path / log)).awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "alerts")).select("id", "title").collect()
        assert len(rows) == len({r.id for r in rows})
        return {r.id: r.title for r in rows}

    assert run(documents([1, 2, 2], 2020), "in", "log") == {"x1": "2020", "x2": "2020"}
    assert run(documents([2, 3], 1999), "in", "log") == {"x1": "2020", "x2": "2020", "x3": "1999"}
    assert run(documents([1, 4], 2031), "other", "new-log") == {"x1": "2020", "x2": "2020", "x3": "1999", "x4": "2031"}

    store = str(tmp_path / "events")
    sinks.write_events(_small_events(spark, [1, 2], "batch"), store, 0)
    for number, host in enumerate(["first", "second"]):
        events = _stream_of(spark, _small_events(spark, [2, 3 + number], host), str(tmp_path / f"e{number}"))
        ingest.upsert_events_stream(events, store, str(tmp_path / f"elog{number}")).awaitTermination()
    got = {r.event_id: r.host for r in sinks.read_events(spark, store).collect()}
    assert got == {"e1": "batch", "e2": "second", "e3": "first", "e4": "second"}


def test_work_below_a_filter_is_done_once(spark):
    xml = spark.createDataFrame([("<Event><System><EventID>1</EventID></System></Event>",), ("<x/>",), ("no xml",), (None,)], "value string")
    found = logs.windows_event_xml(xml)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") == 1
    assert [json.loads(r.raw_data)["EventID"] for r in found.collect()] == ["1"]
    rows = spark.createDataFrame([(1, ["a", None, "b"]), (2, []), (3, None), (4, [None])], "id int, l array<string>")
    out = explode_once(rows, ["id"], F.transform("l", lambda x: F.upper(x)), "x")
    assert sorted(tuple(r) for r in out.collect()) == [(1, "A"), (1, "B")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("upper(") == 1


def test_array_documents_are_many_in_a_large_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(q_pipeline, "_IN_DOCUMENT", 10)
    records = spark.range(0, 1200).select(F.col("id").alias("seq"), F.concat(F.lit('{"n":'), F.col("id"), F.lit("}")).alias("raw"))
    q_pipeline._write_documents(records.filter("seq % 2 = 1"), "raw", str(tmp_path / "docs"))
    assert len(list((tmp_path / "docs").rglob("*.json"))) == 60
    assert logs.read_documents(spark, str(tmp_path / "docs")).select("raw_data").distinct().count() == 600


def test_investigation_does_not_shuffle_events_by_incident(spark):
    rows = spark.range(0, 1000).selectExpr(
        "'e' || id AS event_id", "CAST(1007 AS INT) AS class_uid", "timestamp_seconds(id) AS timestamp", "'h' AS host", "id AS seq",
        "'i' || id % 2 AS incident_id")
    found = spark.sql("SELECT 'a' || id AS id, 'i' || id AS incident_id, 't' AS title, '' AS description, '' AS raw, 'high' AS severity, "
                      "timestamp_seconds(0) AS timestamp, 'h' AS host, 'u' AS user FROM range(2)")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = pipeline.investigate(found, complete_events(rows)).edges._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_records_written_twice_are_computed_once(spark, sf_dir):
    from tracewell.plans import q_normalize, q_pipeline

    records = q_normalize.records_of(spark, sf_dir, "sysmon").select("raw_data")
    both = q_pipeline._twice(records)
    assert both.columns == ["raw_data"]
    assert sorted(both.collect()) == sorted(records.unionAll(records).collect())
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1 and "Union" not in plan, plan


def test_the_last_row_of_an_id_is_kept_and_ids_that_come_once_are_not_shuffled(spark):
    from tracewell.sources.sinks import _latest

    rows = [("a", 1, "x"), ("b", 2, "x"), ("c", 3, "x")]
    schema = "event_id string, seq int, host string"
    once = _latest(spark.createDataFrame(rows, schema), ["seq"])
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in once.collect()) == rows
    more = [*rows, ("b", 5, "y"), ("b", 4, "z"), (None, 1, "n"), (None, 2, "m"), ("c", 3, "x")]
    found = _latest(spark.createDataFrame(more, schema), ["seq"]).collect()
    assert sorted(((r.event_id or "", r.seq, r.host) for r in found)) == [("", 2, "m"), ("a", 1, "x"), ("b", 5, "y"), ("c", 3, "x")]
