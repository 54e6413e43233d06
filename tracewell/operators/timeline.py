"""Timeline, evidence, root cause and incident text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell import fixed_values as V
from tracewell.functions.text import basename, non_empty

_STORY_ENTRIES = 8


def phase(class_uid: Column) -> Column:
    case = F
    for number, name in V.PHASE_BY_CLASS.items():
        case = case.when(class_uid == number, name)
    return case.otherwise(V.DEFAULT_PHASE)


def summarize() -> Column:
    """One line of text per event, by class (L2)."""
    cls = F.col("class_uid")
    text = lambda name: non_empty(F.col(name))
    return (
        F.when(
            (cls == V.PROCESS_ACTIVITY) & text("parent_process_name").isNotNull(),
            F.concat("parent_process_name", F.lit(" → "), F.coalesce(text("process_name"), F.lit("process"))),
        )
        .when(
            cls == V.NETWORK_ACTIVITY,
            F.concat(
                F.coalesce(text("process_name"), text("host"), F.lit("host")), F.lit(" connected to "),
                F.coalesce(text("domain"), text("dst_ip"), F.lit("remote host")),
            ),
        )
        .when((cls == V.FILE_ACTIVITY) & text("file_path").isNotNull(), F.concat(F.lit("File activity: "), "file_path"))
        .when(
            (cls == V.REGISTRY_KEY_ACTIVITY) & text("registry_key").isNotNull(),
            F.concat(F.lit("Registry modified: "), "registry_key"),
        )
        .when((cls == V.AUTHENTICATION) & text("user").isNotNull(), F.concat(F.lit("Authentication by "), "user"))
        .otherwise(F.concat_ws(" ", "activity_name", F.concat(F.lit("on "), text("host"))))
    )


def build_evidence(events: DataFrame) -> DataFrame:
    """One evidence row per event; the id repeats over runs (L4)."""
    return events.select(
        "incident_id",
        F.sha2(F.concat_ws("|", F.lit("evidence"), "incident_id", "event_id"), 256).alias("evidence_id"),
        F.concat("activity_name", F.lit(" on "), F.coalesce(non_empty(F.col("host")), F.lit("unknown"))).alias("summary"),
        F.col("source_type").alias("source"), "timestamp", "event_id", F.lit(0).alias("evidence_ord"),
    )


def timeline(events: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """Entries per incident, one per (time, text), the first event's (L3).

    The kept event is a minimum over a struct, and its evidence is found by
    event id.  Rows carry (timestamp, seq) to sort by; nothing is sorted here.
    """
    rows = events.select(
        "incident_id", "timestamp", summarize().alias("summary"), "seq", phase(F.col("class_uid")).alias("phase"),
        F.col("activity_name").alias("detail"), "event_id",
    )
    first = F.min(F.struct("seq", "event_id", "phase", "detail")).alias("f")
    entries = rows.groupBy("incident_id", "timestamp", "summary").agg(first).select(
        "incident_id", "timestamp", "f.seq", "f.phase", "summary", "f.detail", "f.event_id"
    )
    if evidence is None:
        return entries
    # of several evidence rows of an event the last added one is cited
    by_event = evidence.filter(F.col("event_id").isNotNull()).groupBy("incident_id", "event_id").agg(
        F.max_by("evidence_id", "evidence_ord").alias("evidence_id")
    )
    return entries.join(by_event, ["incident_id", "event_id"], "left")


def root_cause(events: DataFrame) -> DataFrame:
    """Patient zero and root cause per incident, from three conditional minima in one pass."""
    cls = F.col("class_uid")
    parent, child = basename(F.col("parent_process_name")), basename(F.col("process_name"))
    spawn = parent.isin(V.ROOT_CAUSE_PARENTS) & child.isin(V.ROOT_CAUSE_CHILDREN)
    reach = (cls == V.NETWORK_ACTIVITY) & non_empty(F.col("dst_ip")).isNotNull()
    fact = F.struct(
        "timestamp", "seq", "event_id", "host", "activity_name", "dst_ip", parent.alias("parent"), child.alias("child")
    )
    slim = events.select("incident_id", fact.alias("e"), spawn.alias("spawn"), reach.alias("reach"))
    firsts = slim.groupBy("incident_id").agg(
        F.min("e").alias("first"), F.min(F.when(F.col("spawn"), F.col("e"))).alias("spawned"),
        F.min(F.when(F.col("reach"), F.col("e"))).alias("reached"),
    )
    spawned_text = F.concat(
        F.lit("User opened a document ("), "spawned.parent", F.lit(") that spawned "), "spawned.child",
        F.lit(", indicating likely malicious macro or exploit."),
    )
    reached_text = F.concat(F.lit("Earliest suspicious network activity to "), "reached.dst_ip")
    first_text = F.concat(
        F.lit("Initial activity: "), "first.activity_name", F.lit(" on "),
        F.coalesce(non_empty(F.col("first.host")), F.lit("unknown host")),
    )
    chosen = F.coalesce("spawned", "reached", "first")
    return firsts.select(
        "incident_id",
        F.coalesce(non_empty(F.col("spawned.host")), F.col("first.host")).alias("patient_zero"),
        F.when(F.col("spawned").isNotNull(), spawned_text)
        .when(F.col("reached").isNotNull(), reached_text).otherwise(first_text).alias("root_cause"),
        F.when(F.col("spawned").isNotNull(), F.concat("spawned.parent", F.lit(" spawned "), "spawned.child"))
        .when(F.col("reached").isNotNull(), reached_text).otherwise(first_text).alias("summary"),
        chosen["event_id"].alias("event_id"), chosen["timestamp"].alias("timestamp"),
        F.col("first.event_id").alias("first_event_id"), F.col("first.timestamp").alias("first_timestamp"),
    )


def root_cause_evidence(causes: DataFrame) -> DataFrame:
    """The evidence rows a root cause adds: the cause itself and the patient zero."""
    own = lambda *parts: F.sha2(F.concat_ws("|", *parts), 256)
    cause = causes.select(
        "incident_id", own(F.lit("cause"), "incident_id", "event_id").alias("evidence_id"), "summary",
        F.lit("root_cause_analyzer").alias("source"), "timestamp", "event_id", F.lit(1).alias("evidence_ord"),
    )
    zero = causes.filter(F.col("patient_zero") != "").select(
        "incident_id", own(F.lit("patient zero"), "incident_id", "first_event_id").alias("evidence_id"),
        F.concat(F.lit("Patient zero identified as "), "patient_zero").alias("summary"),
        F.lit("root_cause_analyzer").alias("source"), F.col("first_timestamp").alias("timestamp"),
        F.col("first_event_id").alias("event_id"), F.lit(2).alias("evidence_ord"),
    )
    return cause.unionByName(zero)


def affected_assets(events: DataFrame, alerts: DataFrame | None = None) -> DataFrame:
    """Distinct hosts per incident, of its events and its alerts (L7); one row per host."""
    hosts = events.select("incident_id", "host")
    if alerts is not None:
        hosts = hosts.unionByName(alerts.select("incident_id", "host"))
    return hosts.filter(F.col("host") != "").distinct()


def first_entries(entries: DataFrame, n: int = _STORY_ENTRIES) -> DataFrame:
    """The first ``n`` timeline entries of each incident; tasks cut to ``n`` before the shuffle."""
    order = Window.partitionBy("incident_id").orderBy("timestamp", "seq")
    return entries.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n)


def incident_summary(alerts: DataFrame, entries: DataFrame, events: DataFrame, causes: DataFrame) -> DataFrame:
    """Summary, executive and narrative text per incident.

    ``alerts`` holds one alert per incident.  Only the first eight timeline
    entries of an incident are brought together; the rest is counted.
    """
    with_evidence = "evidence_id" in entries.columns
    cite = (
        F.when(F.col("evidence_id").isNotNull(),
               F.concat(F.lit(" [evidence: "), F.substring("evidence_id", 1, 8), F.lit("]")))
        if with_evidence else F.lit(None).cast("string")
    )
    line = F.concat(
        F.lit("At "), F.date_format("timestamp", "HH:mm"), F.lit(", "), "summary", F.lit("."), F.coalesce(cite, F.lit(""))
    )
    told = first_entries(entries).groupBy("incident_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", line.alias("line")))), lambda e: e["line"]),
                     " ").alias("lines"),
        F.min("timestamp").alias("first_ts"),
    )
    counted = entries.groupBy("incident_id").agg(F.count(F.lit(1)).alias("n_entries"))
    facts = events.groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.min(F.when(F.col("user") != "", F.struct("timestamp", "seq", "user")))["user"].alias("first_user"),
        F.min(F.when(F.col("host") != "", F.struct("timestamp", "seq", "host")))["host"].alias("first_host"),
    )
    joined = (
        alerts.select(
            "incident_id", F.col("title").alias("_title"), F.col("severity").alias("_severity"),
            F.col("timestamp").alias("_alert_ts"), F.col("host").alias("_host"), F.col("user").alias("_user"),
        )
        .join(facts, "incident_id", "left").join(counted, "incident_id", "left").join(told, "incident_id", "left")
        .join(causes.select("incident_id", "patient_zero", "root_cause"), "incident_id", "left")
    )
    user = F.coalesce(non_empty(F.col("_user")), F.col("first_user"), F.lit("a user"))
    host = F.coalesce(
        non_empty(F.col("patient_zero")), non_empty(F.col("_host")), F.col("first_host"), F.lit("the affected host")
    )
    n_events = F.coalesce("n_events", F.lit(0))
    # one evidence row per event, one for the cause, one for the patient zero
    n_evidence = n_events + F.col("root_cause").isNotNull().cast("int") + F.coalesce(
        (F.col("patient_zero") != "").cast("int"), F.lit(0))
    started = F.date_format(F.coalesce("first_ts", "_alert_ts"), "yyyy-MM-dd HH:mm 'UTC'")
    more = F.coalesce("n_entries", F.lit(0)) - _STORY_ENTRIES
    return joined.select(
        "incident_id",
        F.concat(
            F.lit("Investigation of '"), "_title", F.lit("' on "), host, F.lit(" ("), n_events.cast("string"),
            F.lit(" correlated events, "), n_evidence.cast("string"), F.lit(" evidence items)."),
        ).alias("summary"),
        F.concat_ws(
            " ",
            F.concat(F.lit("On "), started, F.lit(", "), user, F.lit(" triggered alert '"), "_title",
                     F.lit("' on workstation "), host, F.lit(".")),
            "root_cause", "lines",
            F.when(more > 0, F.concat(F.lit("... and "), more.cast("string"), F.lit(" additional timeline events."))),
        ).alias("narrative"),
        F.concat(
            F.lit("A "), "_severity", F.lit("-severity security incident was detected on "), host, F.lit(". "),
            F.coalesce("root_cause", F.lit("Analysis indicates suspicious activity requiring investigation.")),
            F.lit(" Immediate containment and forensic review are recommended."),
        ).alias("executive"),
    )
