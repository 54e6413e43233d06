"""Case tables: rows from reports, an append-only log and its current state, notes and artifacts (K1-K6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import fixed_values as V
from tracewell.operators.search import contains_pattern

_CHANGES = ["title", "status", "priority", "assigned_to", "severity", "tlp", "resolution_notes", "closed_at"]


def make_id(prefix: str, *parts: str | Column) -> Column:
    """An id that a second run repeats; 64 bits, so that large tables do not collide at once."""
    return F.concat(F.lit(prefix + "-"), F.upper(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)))


def case_priority(score: Column) -> Column:
    return (
        F.when(score >= 80, "P1_CRITICAL").when(score >= 60, "P2_HIGH").when(score < 30, "P4_LOW").otherwise("P3_MEDIUM")
    )


def cases_from_reports(reports: DataFrame) -> DataFrame:
    """One case per report row (report_id, alert_id, title, total_score, severity, created_at) (K1).

    Indicators and assets of a case stay in tables of their own, keyed by the
    report; see :func:`case_items`.
    """
    return reports.select(
        make_id("CASE", "report_id").alias("case_id"), F.concat(F.lit("Investigation: "), "title").alias("title"),
        F.lit("open").alias("status"), case_priority(F.col("total_score")).alias("priority"), "alert_id", "report_id",
        F.col("created_at"), F.lit(None).cast("string").alias("assigned_to"), F.lower("severity").alias("severity"),
        F.lit("GREEN").alias("tlp"), F.lit(None).cast("string").alias("resolution_notes"),
        F.lit(None).cast("timestamp").alias("closed_at"),
    )


def report_notes(reports: DataFrame) -> DataFrame:
    """The note that a case created from a report begins with."""
    text = F.concat(
        F.lit("Case automatically created from report "), "report_id", F.lit(".\n\nExecutive Summary:\n"), "executive")
    return reports.select(
        make_id("CASE", "report_id").alias("case_id"), F.col("created_at").alias("at"), F.lit("System").alias("author"),
        text.alias("content"), F.array().cast("array<string>").alias("evidence_refs"))


def case_items(reports: DataFrame, items: DataFrame, kind: str) -> DataFrame:
    """Rows (case_id, kind, value) for per-incident values such as indicators or hosts."""
    keyed = reports.select("incident_id", make_id("CASE", "report_id").alias("case_id"))
    return keyed.join(items.select("incident_id", "value"), "incident_id").select(
        "case_id", F.lit(kind).alias("kind"), "value").distinct()


def case_state(cases: DataFrame, log: DataFrame) -> DataFrame:
    """Current row per case: every field from its last change, updated_at from the last entry (K2).

    ``log`` has case_id, at, ord and any of the changeable columns, NULL where
    an entry leaves a field alone.  Fields are maxima by (at, ord); a case with
    a long history is reduced in each task before the shuffle.
    """
    order = F.struct("at", "ord")
    changed = [c for c in _CHANGES if c in log.columns]
    last = [
        F.max(F.when(F.col(c).isNotNull(), F.struct(order.alias("o"), F.col(c).alias("v"))))["v"].alias(f"_{c}") for c in changed
    ]
    latest = log.groupBy("case_id").agg(F.max("at").alias("_at"), *last)
    joined = cases.join(latest, "case_id", "left")
    return joined.select(*[
        F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in changed else F.col(c) for c in cases.columns
    ], F.coalesce("_at", "created_at").alias("updated_at"))


def status_entries(changes: DataFrame) -> DataFrame:
    """Log entries from (case_id, at, ord, status)."""
    return changes.filter(F.col("status").isin(V.CASE_STATUSES)).select("case_id", "at", "ord", "status")


def close_entries(closures: DataFrame) -> DataFrame:
    """Log entries from (case_id, at, ord, resolution_notes, false_positive)."""
    return closures.select(
        "case_id", "at", "ord", F.when(F.col("false_positive"), "false_positive").otherwise("closed").alias("status"),
        "resolution_notes", F.col("at").alias("closed_at"))


def close_notes(closures: DataFrame) -> DataFrame:
    return closures.select(
        "case_id", "at", F.lit("Analyst").alias("author"),
        F.concat(F.lit("Case closed. Resolution:\n"), "resolution_notes").alias("content"),
        F.array().cast("array<string>").alias("evidence_refs"))


def list_cases(state: DataFrame, status: str | None = None, priority: str | None = None) -> DataFrame:
    """Cases with this status and priority, as far as given (K3)."""
    if status is not None:
        state = state.filter(F.col("status") == status)
    if priority is not None:
        state = state.filter(F.col("priority") == priority)
    return state


def search_cases(state: DataFrame, query: str) -> DataFrame:
    """Cases with the query in title, id, alert id or report id (K4)."""
    hit = F.lit(False)
    for column in ("title", "case_id", "alert_id", "report_id"):
        hit = hit | F.coalesce(contains_pattern(F.col(column), query), F.lit(False))
    return state.filter(hit)


def append_notes(cases: DataFrame, notes: DataFrame) -> DataFrame:
    """Note rows (case_id, at, author, content, evidence_refs) of known cases, with ids, to append (K6)."""
    return notes.join(cases.select("case_id"), "case_id", "left_semi").select(
        make_id("NOTE", "case_id", F.col("at").cast("string"), "author", "content").alias("note_id"), *notes.columns)


def append_artifacts(cases: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Artifact rows (case_id, at, name, artifact_type, path, hash_value) of known cases, with ids, to append (K6)."""
    return artifacts.join(cases.select("case_id"), "case_id", "left_semi").select(
        make_id("ART", "case_id", F.col("at").cast("string"), "name").alias("artifact_id"), *artifacts.columns)


def touch_entries(appended: DataFrame) -> DataFrame:
    """Log entries that only move updated_at, for cases that got a note or artifact."""
    return appended.groupBy("case_id").agg(F.max("at").alias("at")).withColumn("ord", F.lit(0))


def case_detail(state: DataFrame, notes: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Notes and artifacts of the cases as rows, to be read in (case_id, at, item_id) order (K5).

    Rows and not nested lists: no case is gathered in one place.
    """
    none = F.lit(None).cast("string")
    items = notes.select(
        "case_id", F.lit("note").alias("kind"), "at", F.col("note_id").alias("item_id"), F.col("author").alias("name"),
        F.col("content"), none.alias("path"), none.alias("hash_value"),
    ).unionByName(artifacts.select(
        "case_id", F.lit("artifact").alias("kind"), "at", F.col("artifact_id").alias("item_id"), "name",
        F.col("artifact_type").alias("content"), "path", "hash_value",
    ))
    return state.select("case_id", "title", "status").join(items, "case_id", "left")
