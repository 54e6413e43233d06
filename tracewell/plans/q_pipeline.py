"""Queries: anchored groups, streams, stored events, whole investigations."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from tracewell import ext
from tracewell.functions.text import canonical_json
from tracewell.operators import alerts, correlate, normalize
from tracewell.plans import pipeline, q_analysis, q_intel, q_normalize
from tracewell.plans.views import BASE_CTE, alert_records, oracle, sec_events, sql_ts, table, ts_text
from tracewell.sources import logs, sinks
from tracewell.streaming import ingest

QUERIES = {}
ORACLES = {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def scratch(s) -> str:
    """A new folder: beside the session's checkpoints, or a temporary one in a local session without them."""
    base = s.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not s.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        return tempfile.mkdtemp(prefix="tracewell-run-")
    return f"{base.rstrip('/')}/tracewell-{uuid.uuid4().hex}"


_KEYS, _WINDOW = ["user", "process_guid", "session_id"], 7200
_add("correlate_anchored", lambda s, d: correlate.correlate_anchored(sec_events(s, d), _WINDOW, _KEYS))

# ------------------------------------------------------------------ streams


class _Streamed:
    """Stands in for a session so that the derived views read the events table as a stream."""

    def __init__(self, spark, schema) -> None:
        self.spark, self.schema, self.conf = spark, schema, spark.conf

    @property
    def read(self):
        return self

    def parquet(self, path: str):
        folder, name = path.rsplit("/", 1)
        return self.spark.readStream.schema(self.schema).option("pathGlobFilter", name).parquet(folder)


def streamed(s, d):
    return _Streamed(s, table(s, d, "events").schema)


def drained(s, stream):
    """Run a stream over what is there and return what it wrote."""
    folder = scratch(s)
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return s.read.parquet(f"{folder}/out")


def normalize_stream(s, d):
    events = ingest.normalize_stream(q_normalize.raw_records(streamed(s, d), d), ingest_ts=q_normalize.INGEST)
    return ts_text(drained(s, events), "timestamp").select("seq", "source_type", "timestamp", *q_normalize._COLUMNS)


def syslog_stream(s, d):
    events = ingest.syslog_stream(q_normalize.syslog_lines(streamed(s, d), d), ingest_ts=q_normalize.INGEST)
    return ts_text(drained(s, events), "timestamp").select("seq", "source_type", "timestamp", "host", "activity_name")


def dedupe_alerts_stream(s, d):
    folder = scratch(s)
    documents = alert_records(streamed(s, d), d)
    ingest.dedupe_alerts_stream(documents, f"{folder}/out", f"{folder}/log", q_normalize.INGEST).awaitTermination()
    # late ones, future ones and known ones in a second run: those that are new are stored, none twice
    late = alert_records(s, d).filter("seq % 7 = 0").withColumn("raw", F.concat(F.lit('{"id": "b'), F.col("seq"), F.lit('", "timestamp": "'), F.expr("1990 + seq % 60"), F.lit('-01-01T00:00:00Z"}')))
    late.unionByName(alert_records(s, d)).write.parquet(f"{folder}/in2")
    again = s.readStream.schema(late.schema).parquet(f"{folder}/in2")
    ingest.dedupe_alerts_stream(again, f"{folder}/out", f"{folder}/log2", q_normalize.INGEST).awaitTermination()
    return s.read.parquet(f"{folder}/out").select("id")


def _twice(df):
    """Every row two times, its columns computed once."""
    return df.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")


def watch_directory(s, d):
    """Raw records written twice as log files, picked up by the folder stream, normalized, stored: equal lines stay apart."""
    folder = scratch(s)
    _twice(q_normalize.records_of(s, d, "sysmon").select("raw_data")).repartition(4).write.text(f"{folder}/in")
    lines = ingest.watch_directory(s, f"{folder}/in", glob="*.txt", max_files=2)
    ingest.store_lines_stream(lines, f"{folder}/store", f"{folder}/log").awaitTermination()
    events = sinks.read_events(s, f"{folder}/store")
    return events.groupBy("source_type", "class_uid", "host").agg(F.count(F.lit(1)).alias("n"))


_add("normalize_stream", normalize_stream, q_normalize.ORACLES["normalize_records"])
_add("syslog_stream", syslog_stream, q_normalize.ORACLES["syslog_lines"])
_add("dedupe_alerts_stream", dedupe_alerts_stream,
     f"WITH {BASE_CTE} SELECT DISTINCT 'a' || CAST(i % 500 AS VARCHAR) AS id FROM base WHERE event_type = 'error' "
     "UNION ALL SELECT 'b' || CAST(i AS VARCHAR) FROM base WHERE event_type = 'error' AND i % 7 = 0")
_SYSMON = q_normalize.SHAPES["sysmon"][1]
_add("watch_directory", watch_directory,
     f"WITH {BASE_CTE} SELECT 'sysmon' AS source_type, {_SYSMON['class_uid']} AS class_uid, {_SYSMON['host']} AS host, 2 * count(*) AS n "
     "FROM base GROUP BY 1, 2, 3")

# ------------------------------------------------------------------ stored events

_CHANGED = ("SELECT event_id, CASE WHEN k % 4 = 0 THEN 'changed' ELSE activity_name END AS activity_name, table_name, "
            + sql_ts("timestamp", "timestamp") + " FROM (SELECT s.*, b.k FROM sec_events s JOIN base b ON s.seq = b.i)")


def upsert_events(s, d):
    """Two batches, the second replacing events of the first; read back."""
    folder = scratch(s)
    events = sec_events(s, d)
    sinks.write_events(events, folder, 0)
    again = events.join(
        table(s, d, "events").selectExpr("event_id AS seq", "CAST(get_json_object(props, '$.k') AS INT) AS k").filter("k % 4 = 0"),
        "seq", "left_semi").withColumn("activity_name", F.lit("changed"))
    sinks.write_events(again, folder, 1)
    return ts_text(sinks.read_events(s, folder), "timestamp").select("event_id", "activity_name", "table_name", "timestamp")


def upsert_events_stream(s, d):
    folder = scratch(s)
    ingest.upsert_events_stream(sec_events(streamed(s, d), d), f"{folder}/store", f"{folder}/log").awaitTermination()
    return ts_text(sinks.read_events(s, f"{folder}/store"), "timestamp").select("event_id", "activity_name", "table_name", "timestamp")


_add("upsert_events", upsert_events, oracle(_CHANGED))
_add("upsert_events_stream", upsert_events_stream,
     oracle("SELECT event_id, activity_name, table_name, " + sql_ts("timestamp", "timestamp") + " FROM sec_events"))


def read_log_directory(s, d):
    """Records written as a folder of line files, read back and normalized."""
    folder = scratch(s)
    q_normalize.records_of(s, d, "crowdstrike").select("raw_data").write.option("compression", "none").format("text").save(f"{folder}/lines")
    lines = logs.read_lines(s, folder, "*.txt")
    return normalize.normalize(lines).groupBy("source_type", "host", "user").agg(F.count(F.lit(1)).alias("n"))


_add("read_log_directory", read_log_directory,
     f"WITH {BASE_CTE} SELECT 'crowdstrike' AS source_type, {q_normalize.H} AS host, {q_normalize.U} AS \"user\", count(*) AS n FROM base GROUP BY 1, 2, 3")


def _write_texts(df, column, folder, extension, *partition_by):
    """Text files with an extension of choice: a value a line, nothing quoted."""
    df.select(column, *partition_by).write.partitionBy(*partition_by).options(
        quote="", escapeQuotes="false", extension=extension, emptyValue="", sep="\x01").csv(folder)


#: Records of one array document, about: a document is read as one value, so it must not grow with the table.
_IN_DOCUMENT = 100_000 // 40


def _write_documents(records, column, folder):
    """The records as files of one JSON array each: 20 files of every second record, or more once they would grow large."""
    files = max(20, -(-records.count() // _IN_DOCUMENT))
    arrays = records.groupBy(F.expr(f"seq % {2 * files}").alias("doc")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(column), ","), F.lit("]")).alias(column))
    _write_texts(arrays, column, folder, "json", "doc")


def read_logs(s, d):
    """A folder of line files and of array documents, read in splits of two sizes: the same records under the same ids."""
    folder = scratch(s)
    records = q_normalize.records_of(s, d, "crowdstrike")
    lines = records.filter("seq % 2 = 0")
    _write_texts(lines, "raw_data", f"{folder}/in/lines", "jsonl")
    _write_texts(lines.filter("seq % 4 = 0"), "raw_data", f"{folder}/in/again", "log")
    _write_documents(records.filter("seq % 2 = 1"), "raw_data", f"{folder}/in/documents")
    before = s.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    for n, size in enumerate(("128m", "64k")):
        s.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            lines = logs.read_logs(s, f"{folder}/in")
            if n:
                # numbered by then; small splits make as many tasks, and each would set up the projection of all sources
                lines = lines.repartition(8 * s.sparkContext.defaultParallelism)
            normalize.normalize(lines, ingest_ts=q_normalize.INGEST).select(
                "event_id", "source_type", "host", "user").write.parquet(f"{folder}/read{n}")
        finally:
            s.conf.set("spark.sql.files.maxPartitionBytes", before)
        found.append(s.read.parquet(f"{folder}/read{n}"))
    both = found[0].join(found[1], ["event_id", "source_type", "host", "user"])
    return both.groupBy("source_type", "host", "user").agg(F.count_distinct("event_id").alias("n"))


def read_alerts(s, d):
    """Alert records as a line file and as array documents, read and normalized."""
    folder = scratch(s)
    records = alert_records(s, d)
    _write_texts(records.filter("seq % 2 = 0"), "raw", f"{folder}/lines", "jsonl")
    _write_documents(records.filter("seq % 2 = 1"), "raw", f"{folder}/documents")
    found = alerts.normalize_alerts(logs.read_alerts(s, folder), q_normalize.INGEST)
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


_add("read_logs", read_logs,
     f"WITH {BASE_CTE} SELECT 'crowdstrike' AS source_type, {q_normalize.H} AS host, {q_normalize.U} AS \"user\", "
     "count(*) + count(*) FILTER (i % 4 = 0) AS n FROM base GROUP BY 1, 2, 3")
_add("read_alerts", read_alerts,
     f"WITH {BASE_CTE} SELECT 'a' || CAST(i % 500 AS VARCHAR) AS id, count(*) AS n FROM base WHERE event_type = 'error' GROUP BY 1")


def serialize_raw(s, d):
    """Nested records with unsorted keys and quotes inside values, in their stored form."""
    records = q_normalize.base_events(s, d).selectExpr("i AS seq", f"""to_json(named_struct('z', k, 'a', named_struct('y', {q_normalize.U},
        'b', array(named_struct('d', i, 'c', concat('x, "q": \\\\', {q_normalize.H})))))) AS raw""")
    return records.select("seq", canonical_json(F.col("raw")).alias("raw_data"))


_add("serialize_raw", serialize_raw,
     f"""WITH {BASE_CTE} SELECT i AS seq, '{{"a": {{"b": [{{"c": "x, \\"q\\": \\\\' || {q_normalize.H} || '", "d": ' || i || '}}], "y": "' || {q_normalize.U} || '"}}'
     || CASE WHEN k IS NULL THEN '' ELSE ', "z": ' || k END || '}}' AS raw_data FROM base""")

# ------------------------------------------------------------------ extensions


def custom_source(s, d):
    """A registered source among the built-in ones."""
    own = ext.Source(
        detect=lambda r: F.try_variant_get(r, "$.badge", "string").isNotNull(),
        mapping={"class_uid": lambda r: F.lit(3002), "activity_name": lambda r: F.lit("Door opened"), "host": ("door",),
                 "user": ("badge",)})
    q = q_normalize
    records = q.base_events(s, d).selectExpr(
        f"CASE WHEN k % 2 = 0 THEN to_json(named_struct('badge', {q.U}, 'door', {q.H})) ELSE to_json(named_struct('message', 'x')) END AS raw_data",
        "i AS seq")
    return normalize.normalize(records, sources={"badge_reader": own}).select("seq", "source_type", "class_uid", "activity_name", "host", "user")


_add("custom_source", custom_source,
     f"WITH {BASE_CTE} SELECT i AS seq, CASE WHEN k % 2 = 0 THEN 'badge_reader' ELSE 'generic' END AS source_type, CASE WHEN k % 2 = 0 THEN 3002 ELSE 2004 END "
     f"AS class_uid, CASE WHEN k % 2 = 0 THEN 'Door opened' ELSE 'x' END AS activity_name, CASE WHEN k % 2 = 0 THEN {q_normalize.H} END AS host, "
     f"CASE WHEN k % 2 = 0 THEN {q_normalize.U} END AS \"user\" FROM base")


def registered_source(s, d):
    """The same source by registration, as a plug-in brings it."""
    q = q_normalize
    ext.register_source(
        "badge_reader", lambda r: F.try_variant_get(r, "$.badge", "string").isNotNull(),
        {"class_uid": lambda r: F.lit(3002), "activity_name": lambda r: F.lit("Door opened"), "host": ("door",), "user": ("badge",)})
    try:
        records = q.base_events(s, d).selectExpr(
            f"CASE WHEN k % 2 = 0 THEN to_json(named_struct('badge', {q.U}, 'door', {q.H})) ELSE to_json(named_struct('message', 'x')) END AS raw_data",
            "i AS seq")
        return normalize.normalize(records).select("seq", "source_type", "class_uid", "activity_name", "host", "user")
    finally:
        ext.unregister("badge_reader")


def registered_sink(s, d):
    """Events handed to a registered sink, read back from where it wrote."""
    folder = scratch(s)
    ext.register_sink("by_table", lambda df: df.write.partitionBy("table_name").parquet(folder))
    try:
        ext.export(sec_events(s, d).select("event_id", "host", "table_name"), "by_table")
    finally:
        ext.unregister("by_table")
    return s.read.parquet(folder).groupBy("table_name", "host").agg(F.count_distinct("event_id").alias("n"))


_add("registered_source", registered_source, ORACLES["custom_source"])
_add("registered_sink", registered_sink, oracle("SELECT table_name, host, count(DISTINCT event_id) AS n FROM sec_events GROUP BY 1, 2"))

# ------------------------------------------------------------------ whole investigations

_CLUSTER = {"cluster_seconds": q_analysis._DENSE_SECONDS, "cluster_events": q_analysis._DENSE_EVENTS}


def investigation(s, d):
    return pipeline.investigate(q_analysis.incident_alerts(s, d), sec_events(s, d), **_CLUSTER)


def report(s, d):
    return ts_text(investigation(s, d).report, "created_at").select(
        "incident_id", "alert_id", "title", "alert_severity", "created_at", "summary", "narrative", "executive", "patient_zero", "root_cause",
        "blast_radius", "total_score", "severity", "n_factors", F.array_join("techniques", ",").alias("techniques"),
        F.array_join("tactic_chain", ",").alias("tactic_chain"), F.round("chain_score", 6).alias("chain_score"), "event_count", "ioc_count",
        "timeline_count", "asset_count", "node_count", "edge_count",
    )


def _report_sql() -> str:
    from tracewell import fixed_values as V
    from tracewell.plans.q_graph import _graph_ctes

    # the alert of every incident holds a CVE and a hash, and its CVE counts as a risk factor
    summary = q_analysis.ORACLES["incident_summary"]
    summary = summary[summary.index("SELECT a.incident_id, 'Investigation"):]
    risk = q_analysis.ORACLES["assess"]
    risk = risk[risk.rindex(" SELECT incident_id, total_score, CASE"):]
    chain = q_analysis._CHAIN_CTE
    factors = [c for c in q_analysis.RISK_CTES if c.startswith("factors AS")][0]
    others = [c for c in q_analysis.RISK_CTES if not c.startswith("factors AS")]
    cve = [t for r, _, t in V.RISK_RULES if r == "cve_exploitation"][0]
    with_cve = factors[:-1] + (
        f" UNION ALL SELECT incident_id, 'cve_exploitation', '{cve}: CVE indicator observed: CVE-2024-1111', 20, 0.85, '' FROM incident_alerts)")
    return oracle(
        "SELECT a.incident_id, 'al-' || a.incident_id AS alert_id, a.title, 'high' AS alert_severity, " + sql_ts("a.timestamp", "created_at")
        + ", t.summary, t.narrative, t.executive, c.patient_zero, c.root_cause, n.n - 1 AS blast_radius, r.total_score, r.severity, r.n_factors, m.techniques, "
        "array_to_string(ch.chain, ',') AS tactic_chain, CASE WHEN len(ch.chain) <= 1 THEN 0.0 ELSE round(least(1.0, len(ch.chain) / 12.0), 6) END AS chain_score, "
        "f.n AS event_count, 2 AS ioc_count, e.m AS timeline_count, 1 AS asset_count, n.n AS node_count, g.n AS edge_count "
        f"FROM incident_alerts a JOIN ({summary}) t ON a.incident_id = t.incident_id JOIN causes c ON a.incident_id = c.incident_id "
        f"JOIN ({risk}) r ON a.incident_id = r.incident_id JOIN chains ch ON a.incident_id = ch.incident_id JOIN facts f ON a.incident_id = f.incident_id "
        "JOIN counted e ON a.incident_id = e.incident_id JOIN (SELECT incident_id, count(*) AS n FROM nodes GROUP BY 1) n ON a.incident_id = n.incident_id "
        "JOIN (SELECT incident_id, count(*) AS n FROM edges GROUP BY 1) g ON a.incident_id = g.incident_id "
        "JOIN (SELECT incident_id, string_agg(DISTINCT technique_id, ',' ORDER BY technique_id) AS techniques FROM mappings GROUP BY 1) m ON a.incident_id = m.incident_id",
        q_analysis._CAUSES_CTE, q_analysis.INCIDENT_ALERTS_CTE, q_analysis._LINES, *others, with_cve, chain, *_graph_ctes("incident_id"),
    )


_add("investigate", report, _report_sql())


def report_with_feed(s, d):
    """Investigations with a provider feed: risk moves with the verdicts of alert indicators."""
    events = sec_events(s, d)
    found = q_analysis.incident_alerts(s, d).join(
        events.filter("file_hash IS NOT NULL").groupBy("incident_id").agg(F.min("file_hash").alias("h")), "incident_id", "left"
    ).withColumn("raw", F.concat(F.lit('{"hash": "'), F.coalesce("h", F.lit("")), F.lit('"}'))).drop("h")
    done = pipeline.investigate(found, events, q_intel.feed(s, d), **_CLUSTER)
    return done.report.select("incident_id", "total_score", "severity", "n_factors", "ioc_count")


_add("investigate_with_feed", report_with_feed)
