"""Hunts: look for observed indicators in the event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import basename, explode_once

_MICROS = 1_000_000


def observed_indicators(events: DataFrame, iocs: DataFrame | None = None) -> DataFrame:
    """Distinct (incident_id, kind, value): processes, hosts, users and indicators by type (H1)."""
    pairs = F.filter(F.array(
        F.struct(F.lit("process").alias("kind"), F.nullif(basename(F.col("process_name"), both=False), F.lit("")).alias("value")),
        F.struct(F.lit("host").alias("kind"), F.nullif("host", F.lit("")).alias("value")),
        F.struct(F.lit("user").alias("kind"), F.nullif("user", F.lit("")).alias("value")),
    ), lambda p: p["value"].isNotNull())
    seen = explode_once(events, ["incident_id"], pairs, "p").select("incident_id", "p.kind", "p.value")
    if iocs is not None:
        seen = seen.unionByName(
            iocs.filter(F.col("type").isin("sha256", "md5", "domain", "ipv4", "cve")).select(
                "incident_id", F.col("type").alias("kind"), "value")
        )
    return seen.distinct()


def _matching(values: DataFrame, indicators: DataFrame) -> DataFrame:
    """Pairs (value, indicator) where the value ends with the indicator.

    Both sides are dictionaries.  A value is cut at each of its letters, cuts of
    lengths that no indicator has go, and the others are joined by equality.
    """
    lengths = indicators.select(F.length("indicator").alias("n")).distinct()
    cuts = values.filter(F.length("value") > 0).select("value", F.explode(F.sequence(F.lit(1), F.length("value"))).alias("n"))
    suffixes = cuts.join(lengths, "n", "left_semi").select(
        "value", F.substring(F.col("value"), F.length("value") - F.col("n") + 1, F.col("n")).alias("indicator"))
    return suffixes.join(indicators, "indicator").select("value", "indicator")


def _since(events: DataFrame, since: Column | str | None) -> DataFrame:
    if since is None:
        return events
    return events.filter(F.col("timestamp") >= (since if isinstance(since, Column) else F.lit(since).cast("timestamp")))


def _indicators(indicators: DataFrame, kind: str, lower: bool = True) -> DataFrame:
    value = F.lower("value") if lower else F.col("value")
    return indicators.filter(F.col("kind") == kind).select(value.alias("indicator")).distinct()




def _counted(events: DataFrame, *by: str) -> DataFrame:
    return events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))


def hunt_process(events: DataFrame, indicators: DataFrame, since: Column | str | None = None) -> DataFrame:
    """Events whose process ends with an observed name, counted by host, user, process and parent (H2)."""
    events = _since(events, since).filter(F.col("process_name") != "").withColumn("value", basename(F.col("process_name"), both=False))
    hits = _matching(events.select("value").distinct(), _indicators(indicators, "process")).select("value").distinct()
    return _counted(events.join(hits, "value", "left_semi"), "host", "user", "process_name", "parent_process_name")


def hunt_hash(events: DataFrame, indicators: DataFrame, since: Column | str | None = None, kind: str = "sha256") -> DataFrame:
    """Events with an observed hash, by host, user, hash and path (H3)."""
    wanted = _indicators(indicators, kind)
    hits = _since(events, since).withColumn("indicator", F.lower("file_hash")).join(wanted, "indicator", "left_semi")
    return _counted(hits, "host", "user", "file_hash", "file_path")


def hunt_network(events: DataFrame, indicators: DataFrame, since: Column | str | None = None) -> DataFrame:
    """Connections to an observed address, by address, port, host and source, with the processes behind them (H4)."""
    wanted = _indicators(indicators, "ipv4", lower=False).withColumnRenamed("indicator", "dst_ip")
    hits = _since(events, since).join(wanted, "dst_ip", "left_semi")
    return hits.groupBy("dst_ip", "dst_port", "host", "src_ip").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("process_name")).alias("processes"))


def hunt_domain(events: DataFrame, indicators: DataFrame, since: Column | str | None = None) -> DataFrame:
    """Queries for names that end with an observed domain, by source and name (H5)."""
    events = _since(events, since).filter(F.col("domain") != "").withColumn("value", F.lower("domain"))
    hits = _matching(events.select("value").distinct(), _indicators(indicators, "domain")).select("value").distinct()
    return events.join(hits, "value", "left_semi").groupBy("src_ip", "domain").agg(F.count(F.lit(1)).alias("n"))


def ioc_sweep(events: DataFrame, indicators: DataFrame) -> DataFrame:
    """Every (event, indicator) hit over processes, hashes, addresses and domains.

    Indicators are joined with the distinct values that events hold; only then
    the events are touched, by equality.
    """
    fields = F.filter(F.array(
        F.struct(F.lit("process").alias("kind"), F.nullif(basename(F.col("process_name"), both=False), F.lit("")).alias("value")),
        F.struct(F.lit("sha256").alias("kind"), F.lower("file_hash").alias("value")),
        F.struct(F.lit("ipv4").alias("kind"), F.col("src_ip").alias("value")),
        F.struct(F.lit("ipv4").alias("kind"), F.col("dst_ip").alias("value")),
        F.struct(F.lit("domain").alias("kind"), F.lower("domain").alias("value")),
    ), lambda f: f["value"].isNotNull())
    rows = explode_once(events, ["event_id"], F.array_distinct(fields), "f").select("event_id", "f.kind", "f.value")
    known = rows.select("kind", "value").distinct()
    wanted = indicators.select("kind", F.lower("value").alias("indicator")).distinct()
    exact = known.join(wanted, (known["kind"] == wanted["kind"]) & (known["value"] == wanted["indicator"])
                       & known["kind"].isin("sha256", "ipv4")).select(known["kind"], "value", "indicator")
    ending = None
    for kind in ("process", "domain"):
        pairs = _matching(
            known.filter(F.col("kind") == kind).select("value"), wanted.filter(F.col("kind") == kind).select("indicator")
        ).select(F.lit(kind).alias("kind"), "value", "indicator")
        ending = pairs if ending is None else ending.unionByName(pairs)
    return rows.join(exact.unionByName(ending), ["kind", "value"]).select("event_id", "kind", "indicator").distinct()


def hunt_sequence(events: DataFrame, first: str, second: str, within_seconds: float = 60) -> DataFrame:
    """A run of ``first`` directly followed, on the same host, by a run of ``second`` within the span (H6).

    Only the events of the two processes matter.  They are cut into buckets one
    span wide and also stand in the following bucket, so the event before each
    one, if it is close enough to count, is in the same bucket.
    """
    span = int(within_seconds * _MICROS)
    name = basename(F.col("process_name"), both=False)
    runs = events.filter((F.col("class_uid") == 1007) & name.isin(first, second) & F.col("host").isNotNull()).select(
        "host", "event_id", "timestamp", "seq", name.alias("name"), F.unix_micros("timestamp").alias("us"))
    runs = runs.withColumn("own", F.floor(F.col("us") / F.lit(span))).withColumn(
        "bucket", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    order = Window.partitionBy("host", "bucket").orderBy("us", "seq")
    linked = runs.withColumns({
        "before_name": F.lag("name").over(order), "before_us": F.lag("us").over(order), "before_id": F.lag("event_id").over(order),
    })
    return linked.filter(
        (F.col("own") == F.col("bucket")) & (F.col("name") == second) & (F.col("before_name") == first)
        & (F.col("us") - F.col("before_us") <= span)
    ).select("host", F.col("before_id").alias("first_event_id"), F.col("event_id").alias("second_event_id"), "timestamp")


def recent(events: DataFrame, as_of: Column | str, days: int = 7, limit: int | None = None) -> DataFrame:
    """Events of the last days, newest first, all or the first ``limit`` (H7)."""
    now = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    rows = events.filter((F.col("timestamp") >= now - F.expr(f"INTERVAL {int(days)} DAYS")) & (F.col("timestamp") <= now))
    rows = rows.orderBy(F.desc("timestamp"), F.desc("seq"))
    return rows if limit is None else rows.limit(limit)


def hunt_pack(events: DataFrame, iocs: DataFrame, since: Column | str | None = None) -> dict[str, DataFrame]:
    """All hunts for what the events and indicators show."""
    found = observed_indicators(events, iocs)
    return {
        "observed": found,
        "process": hunt_process(events, found, since), "hash": hunt_hash(events, found, since),
        "network": hunt_network(events, found, since), "domain": hunt_domain(events, found, since),
    }
