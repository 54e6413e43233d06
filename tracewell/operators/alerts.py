"""Alert intake: documents to alert rows, first alert per id (A1, A2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions.coerce import parse_iso
from tracewell.sources.mappings import either, get, pick



def _time_kind(key: str) -> str:
    return f"schema_of_variant(try_variant_get(record, '$[\"{key}\"]', 'variant'))"


def normalize_alerts(df: DataFrame, ingest_ts: Column | str | None = None, source: str = "json") -> DataFrame:
    """Alert rows from (raw[, seq, incident_id]) JSON documents (A1).

    Without an id the hash of the document serves, so that a second run agrees
    with the first.  A time that cannot be read becomes ``ingest_ts``.
    """
    ingest = F.lit(None) if ingest_ts is None else ingest_ts if isinstance(ingest_ts, Column) else F.lit(ingest_ts)
    step = df.withColumn("record", F.try_parse_json("raw"))
    chosen = step.select(
        "raw", *[c for c in ("seq", "incident_id") if c in df.columns],
        F.expr(get("id", "alert_id", "_id")).alias("_id"),
        F.expr(either("Untitled Alert", "title", "name", "rule_name")).alias("title"),
        F.expr(get("description", "message")).alias("description"),
        F.lower(F.expr(either("medium", "severity", "level"))).alias("severity"),
        F.expr(get("timestamp", "@timestamp")).alias("_t"),
        F.expr(
            f"CASE WHEN {get('timestamp')} IS NOT NULL THEN {_time_kind('timestamp')} ELSE {_time_kind('@timestamp')} END"
        ).alias("_kind"),
        F.expr(get("host", "hostname", "device")).alias("host"), F.expr(get("user", "username")).alias("user"),
        F.expr(pick("rule_id")).alias("rule_id"), F.expr(get("rule_name", "rule")).alias("rule_name"),
        F.expr("try_variant_get(record, '$.tags', 'array<string>')").alias("tags"),
    )
    number = (F.col("_kind") != "STRING") & F.col("_t").try_cast("double").isNotNull()
    seconds = F.when(number, F.col("_t")).try_cast("double")
    time = F.when(number, F.timestamp_micros(F.round(seconds * 1000000).cast("bigint"))).otherwise(
        parse_iso(F.when(~number, F.col("_t"))))
    return chosen.select(
        F.coalesce("_id", F.sha2("raw", 256)).alias("id"), "title", "description", "severity",
        F.lit(source).alias("source"), F.coalesce(time, ingest.cast("timestamp")).alias("timestamp"), "host", "user",
        "rule_id", "rule_name", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "raw",
        *[c for c in ("seq", "incident_id") if c in df.columns],
    )


def dedupe_alerts(alerts: DataFrame, order: str = "seq") -> DataFrame:
    """The first alert of every id in arrival order (A2).

    A minimum by order: copies of one id are reduced in each task before the
    shuffle, however many there are.
    """
    rest = [c for c in alerts.columns if c != "id"]
    first = F.min_by(F.struct(*rest), order).alias("f")
    return alerts.groupBy("id").agg(first).select(*[F.col("id") if c == "id" else F.col(f"f.{c}") for c in alerts.columns])
