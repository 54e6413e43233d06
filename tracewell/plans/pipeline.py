"""One investigation row per incident, and the tables behind it."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators import attack, correlate, graph, hunt, intel, ioc, risk, timeline
from tracewell.session import counted, durable


@dataclass
class Investigation:
    """``report`` has one row per incident.  What can grow with an incident stays in tables of its own."""

    report: DataFrame
    iocs: DataFrame
    timeline: DataFrame
    evidence: DataFrame
    nodes: DataFrame
    edges: DataFrame
    mappings: DataFrame
    factors: DataFrame
    assets: DataFrame
    observed: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def write(self, path: str) -> None:
        """Every table below ``path``; the report as JSON documents."""
        for name, df in self.tables().items():
            writer = df.write.mode("overwrite")
            writer.json(f"{path}/{name}") if name == "report" else writer.parquet(f"{path}/{name}")


def assign_incidents(events: DataFrame, window_seconds: float = 3600, keys: list[str] | None = None) -> DataFrame:
    """Events with the correlation group as incident, for events that come without one."""
    groups = correlate.correlate_groups(events, window_seconds, keys).withColumnRenamed("group_id", "incident_id")
    return events.drop("incident_id").join(groups, "event_id")


def first_alerts(alerts: DataFrame) -> DataFrame:
    """The alert that opens each incident: its earliest."""
    rest = [c for c in alerts.columns if c not in ("incident_id", "timestamp", "id")]
    first = F.min(F.struct("timestamp", "id", *rest)).alias("f")
    return alerts.groupBy("incident_id").agg(first).select(
        "incident_id", *[F.col(f"f.{c}").alias(c) for c in alerts.columns if c != "incident_id"])


def investigate(
    alerts: DataFrame,
    events: DataFrame,
    feed: DataFrame | None = None,
    rules: DataFrame | None = None,
    cluster_seconds: float = 300,
    cluster_events: int = 10,
) -> Investigation:
    """Everything known about each incident of ``alerts``.

    ``alerts`` and ``events`` carry ``incident_id``; alerts without events are
    reported too.  Each analysis aggregates on its own and only rows per
    incident meet in the joins at the end.  The events are read by each of them:
    give a stored table, of which every analysis reads the columns it needs.
    """
    opening = durable(first_alerts(alerts))
    found = ioc.extract_from_alerts(alerts, dedupe=["incident_id"], group="incident_id")
    results = verdicts = None
    if feed is not None:
        results = intel.verdicts(feed)
        verdicts = intel.aggregate_verdicts(results)
    wanted = events.join(counted(opening.select("incident_id")), "incident_id", "left_semi")
    causes = timeline.root_cause(wanted)
    evidence = timeline.build_evidence(wanted).unionByName(timeline.root_cause_evidence(causes))
    entries = timeline.timeline(wanted, evidence)
    nodes, edges = graph.build_graph(wanted, ["incident_id"])
    mappings = attack.map_techniques(wanted)
    factors = risk.risk_factors(wanted, found, verdicts, mappings, rules, results, cluster_seconds, cluster_events)
    assessed = risk.assess(factors, wanted)
    assets = timeline.affected_assets(wanted, alerts)
    texts = timeline.incident_summary(opening, entries, wanted, causes)
    chains = attack.tactic_chain(mappings)

    radius = graph.blast_radius(nodes, edges, ["incident_id"])
    origin = causes.select("incident_id", F.concat(F.lit("device:"), F.lower("patient_zero")).alias("id"))
    blast = radius.join(origin, ["incident_id", "id"]).select("incident_id", "blast_radius")

    count = lambda df, name: df.groupBy("incident_id").agg(F.count(F.lit(1)).alias(name))
    # at most one technique per table row and one factor per rule: these lists have a fixed bound
    techniques = mappings.groupBy("incident_id").agg(F.array_sort(F.collect_set("technique_id")).alias("techniques"))
    fired = factors.groupBy("incident_id").agg(
        F.array_sort(F.collect_list(F.struct("rule_id", "label", "score", "confidence", "evidence"))).alias("factors"))
    report = opening.select(
        "incident_id", F.col("id").alias("alert_id"), "title", F.col("severity").alias("alert_severity"),
        F.col("timestamp").alias("created_at"))
    for part in [
        texts, causes.select("incident_id", "patient_zero", "root_cause"), blast, assessed, fired, techniques, chains,
        count(wanted, "event_count"), count(found, "ioc_count"), count(entries, "timeline_count"), count(assets, "asset_count"),
        count(nodes, "node_count"), count(edges, "edge_count"),
    ]:
        report = report.join(part, "incident_id", "left")
    zero = {c: 0 for c in report.columns if c.endswith("_count")} | {"blast_radius": 0, "total_score": 0, "n_factors": 0}
    report = report.fillna(zero).fillna({"severity": "INFORMATIONAL", "chain_score": 0.0}).withColumn(
        "report_id", F.sha2(F.concat_ws("|", F.lit("report"), "incident_id", "alert_id"), 256))
    return Investigation(
        report, found, entries, evidence, nodes, edges, mappings, factors, assets, hunt.observed_indicators(wanted, found))
