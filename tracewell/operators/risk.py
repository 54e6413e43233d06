"""Risk factors and scores per incident."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell import fixed_values as V
from tracewell.functions.text import basename, contains_any, explode_once, non_empty, starts_with_any
from tracewell.operators.attack import raw_field, with_raw_fields
from tracewell.schema import dim_table
from tracewell.session import counted

_EVIDENCE = 3
_MICROS = 1_000_000


def rule_table(spark, overrides: DataFrame | None = None) -> DataFrame:
    """Rule id, score and description.

    ``overrides`` has the columns id, score, description and, if an id may
    repeat, ord: the last valid one counts.  Valid means a score other than 0
    and a text that is not empty.
    """
    defaults = dim_table(spark, ["rule_id", "score", "description"], V.RISK_RULES)
    if overrides is None:
        return defaults
    valid = overrides.select(
        F.col("id").alias("rule_id"), F.coalesce(F.col("score").cast("int"), F.lit(10)).alias("o_score"),
        F.coalesce("description", "id").alias("o_description"),
        (F.col("ord") if "ord" in overrides.columns else F.lit(0)).alias("ord"),
    ).filter("o_score <> 0 AND o_description <> ''").groupBy("rule_id").agg(
        F.max(F.struct("ord", "o_score", "o_description")).alias("o")
    ).select("rule_id", "o.o_score", "o.o_description")
    return defaults.join(valid, "rule_id", "full").select(
        "rule_id", F.coalesce("o_score", "score").alias("score"),
        F.coalesce("o_description", "description").alias("description"),
    )


def _rule(rule_id: str, condition: Column, detail: Column) -> Column:
    return F.when(condition, F.struct(F.lit(rule_id).alias("rule_id"), detail.alias("detail")))


def event_rules(events: DataFrame, dc_words: list[str] | None = None) -> DataFrame:
    """Hits of the rules that look at one event: (incident_id, rule_id, timestamp, seq, event_id, detail)."""
    dc_words = dc_words or V.DC_HOST_WORDS
    name, cls = F.col("process_name"), F.col("class_uid")
    base = with_raw_fields(events).withColumns({
        "_proc": basename(name, both=False), "_proc2": basename(name),
        "_parent": basename(F.col("parent_process_name"), both=False),
        "_cmd": F.lower(F.coalesce(raw_field("CommandLine", "command_line"), F.lit(""))),
        "_dst": F.coalesce(non_empty(F.col("dst_ip")), non_empty(F.col("domain")), F.lit("")),
        "_host": F.lower(F.coalesce("host", F.lit(""))),
    })
    proc, proc2, cmd, dst = F.col("_proc"), F.col("_proc2"), F.col("_cmd"), F.col("_dst")
    domain = F.coalesce("domain", F.lit(""))
    registry = cls.isin(V.REGISTRY_KEY_ACTIVITY, V.REGISTRY_VALUE_ACTIVITY)
    text = lambda t, c: F.concat(F.lit(t), c)
    target = F.coalesce(non_empty(F.col("dst_ip")), F.col("domain"), F.lit("None"))
    rules = [
        _rule("credential_dumping", contains_any(proc, V.CREDENTIAL_DUMP_NAMES), text("Suspicious process: ", name)),
        _rule("office_to_powershell",
              F.col("_parent").isin(V.OFFICE_PARENTS) & contains_any(proc, V.OFFICE_CHILD_WORDS),
              F.concat("_parent", F.lit(" → "), proc)),
        _rule("external_c2",
              (cls == V.NETWORK_ACTIVITY) & (dst != "") & ~starts_with_any(dst, V.INTERNAL_PREFIXES),
              text("Connection to external address: ", dst)),
        _rule("nonstandard_port_c2",
              cls.isin(V.NETWORK_ACTIVITY, V.HTTP_ACTIVITY) & F.col("dst_port").isin(V.C2_PORTS),
              F.concat(F.lit("C2 on non-standard port "), F.col("dst_port").cast("string"), F.lit(" to "), target)),
        _rule("persistence",
              registry & contains_any(F.lower(F.coalesce("registry_key", F.lit(""))), V.PERSISTENCE_WORDS),
              text("Registry persistence key: ", F.col("registry_key"))),
        _rule("scheduled_task_creation", proc.isin(V.SCHEDULED_TASK_PROCESSES),
              text("Scheduled task created by ", name)),
        _rule("privilege_escalation", proc.isin(V.PRIVESC_PROCESSES) | contains_any(cmd, V.PRIVESC_COMMANDS),
              text("Privilege escalation indicator: ", F.coalesce(non_empty(name), F.substring(cmd, 1, 40)))),
        _rule("living_off_the_land", proc.isin(V.LOLBIN_PROCESSES), text("LOLBin abuse: ", name)),
        _rule("discovery_activity", proc.isin(V.DISCOVERY_PROCESSES), name),
        _rule("lateral_movement", cls == V.AUTHENTICATION, F.coalesce("host", F.lit(""))),
        _rule("multiple_failed_logins",
              (cls == V.AUTHENTICATION) & F.contains(F.lower("activity_name"), F.lit("fail")), F.lit("")),
        _rule("dns_tunneling_indicator",
              (cls == V.DNS_ACTIVITY)
              & ((F.length(domain) > 50) | (F.length(domain) - F.length(F.replace(domain, F.lit("."), F.lit(""))) > 4)),
              F.concat(F.lit("Suspicious long DNS query: "), F.substring(domain, 1, 50), F.lit("..."))),
        _rule("dc_target", contains_any(F.col("_host"), dc_words), text("Domain controller targeted: ", F.col("host"))),
        _rule("cloud_exfiltration", proc2.isin(V.CLOUD_EXFIL_PROCESSES),
              text("Cloud exfiltration tool observed: ", proc2)),
        _rule("impact_activity", proc2.isin(V.IMPACT_PROCESSES), text("Impact-phase process: ", proc2)),
    ]
    return explode_once(
        base, ["incident_id", "timestamp", "seq", "event_id"], F.array_compact(F.array(*rules)), "r"
    ).select("incident_id", "r.rule_id", "timestamp", "seq", "event_id", "r.detail")


# letters of the list of tools that a text shows
_TEXT = 60
# rules whose evidence is the first three events; the others show one
_THREE = ["discovery_activity", "lateral_movement", "multiple_failed_logins"]


def _event_factors(hits: DataFrame) -> DataFrame:
    """Event rules that fire, with detail text and the ids of the first events."""
    order = Window.partitionBy("incident_id", "rule_id").orderBy("timestamp", "seq")
    # row_number with a constant bound is cut per task before the shuffle
    top = hits.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= _EVIDENCE)
    top = top.groupBy("incident_id", "rule_id").agg(
        F.min(F.when(F.col("rn") == 1, F.col("detail"))).alias("first_detail"),
        F.array_sort(F.collect_list(F.struct("rn", "event_id"))).alias("firsts"),
    )
    # distinct names are counted as rows; only as many as the text can show are put in a list
    key = ["incident_id", "rule_id"]
    three = hits.filter(F.col("rule_id").isin(_THREE))
    names = three.select(*key, non_empty(F.col("detail")).alias("name")).filter("name IS NOT NULL").distinct()
    shown = names.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("name"))).filter(F.col("k") <= _TEXT)
    shown = shown.groupBy(*key).agg(F.array_sort(F.collect_list("name")).alias("names"))
    wide = three.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).join(
        names.groupBy(*key).agg(F.count(F.lit(1)).alias("hosts")), key, "left").join(shown, key, "left")
    joined = top.join(wide, key, "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    hosts = F.coalesce("hosts", F.lit(0))
    detail = (
        F.when(F.col("rule_id") == "discovery_activity",
               F.concat(F.lit("Discovery tools: "), F.substring(F.array_join("names", ", "), 1, _TEXT)))
        .when(F.col("rule_id") == "lateral_movement",
              F.concat(F.lit("Authentication events across "), hosts.cast("string"), F.lit(" hosts: "),
                       F.array_join(F.slice("names", 1, 3), ", ")))
        .when(F.col("rule_id") == "multiple_failed_logins",
              F.concat(F.col("n").cast("string"), F.lit(" authentication failures observed")))
        .otherwise(F.col("first_detail"))
    )
    fires = (
        F.when(F.col("rule_id") == "lateral_movement", hosts > 1)
        .when(F.col("rule_id") == "multiple_failed_logins", F.col("n") >= 3).otherwise(F.lit(True))
    )
    keep = F.when(F.col("rule_id").isin(_THREE), _EVIDENCE).otherwise(1)
    return joined.filter(fires).select(
        "incident_id", "rule_id", detail.alias("detail"),
        F.transform(F.slice("firsts", F.lit(1), keep), lambda f: f["event_id"]).alias("evidence"),
    )


def temporal_clusters(events: DataFrame, window_seconds: float = 300, threshold: int = 10) -> DataFrame:
    """Per incident with a dense stretch: its earliest start and how many events follow within the window.

    Events of one microsecond are one point with a count.  A point's window is the rest of its own bucket, one window
    wide, and the part of the next bucket up to its end, which stands there as a probe without weight.  Running sums are
    taken over the seconds of a bucket and over the points of a second: no window grows with an incident.
    """
    w = int(window_seconds * _MICROS)
    points = events.groupBy("incident_id", F.unix_micros("timestamp").alias("us")).agg(
        F.count(F.lit(1)).alias("events"), F.min("seq").alias("seq"))
    shift = F.explode(F.array(F.lit(0), F.lit(1))).alias("shift")
    rows = points.select("*", F.floor(F.col("us") / F.lit(w)).alias("own"), shift).select(
        "*", (F.col("own") + F.col("shift")).alias("bucket"), F.floor((F.col("us") - F.col("own") * w) / F.lit(_MICROS)).alias("second"),
        (F.col("us") + F.col("shift") * w).alias("at"), F.when(F.col("shift") == 0, F.col("events")).otherwise(0).alias("weight"))
    key = ["incident_id", "bucket", "second"]
    whole = Window.partitionBy("incident_id", "bucket")
    seconds = rows.groupBy(*key).agg(F.sum("weight").alias("in_second")).select(
        *key, F.sum("in_second").over(whole).alias("in_bucket"),
        (F.sum("in_second").over(whole.orderBy("second")) - F.col("in_second")).alias("before"))
    upto = F.col("before") + F.sum("weight").over(
        Window.partitionBy(*key).orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    # of its own bucket a point has what is not before it, of the next one what is not after its end
    parts = rows.join(seconds, key).withColumn("upto", upto)
    part = F.when(F.col("shift") == 0, F.col("in_bucket") - F.col("upto") + F.col("weight")).otherwise(F.col("upto"))
    dense = parts.groupBy("incident_id", "us", "seq", "events").agg(F.sum(part).alias("n")).filter(F.col("n") >= threshold)
    return dense.groupBy("incident_id").agg(
        F.min(F.struct("us", "seq", "n")).alias("f"), F.sum("events").alias("dense_starts")
    ).select(
        "incident_id", F.col("f.us").alias("start_us"), F.col("f.seq").alias("start_seq"),
        F.col("f.n").alias("n"), "dense_starts",
    )


def _first_events(events: DataFrame, n: int) -> DataFrame:
    """Ids of the first ``n`` events of each incident, in order."""
    order = Window.partitionBy("incident_id").orderBy("timestamp", "seq")
    slim = events.select("incident_id", "timestamp", "seq", "event_id")
    return slim.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= n).groupBy("incident_id").agg(
        F.array_sort(F.collect_list(F.struct("rn", "event_id"))).alias("firsts")
    ).select("incident_id", F.transform("firsts", lambda f: f["event_id"]).alias("evidence"))


def _cluster_factors(events: DataFrame, window_seconds: float, threshold: int) -> DataFrame:
    clusters = temporal_clusters(events, window_seconds, threshold)
    sized = events.groupBy("incident_id").agg(F.count(F.lit(1)).alias("total")).filter(F.col("total") > 10)
    clusters = counted(clusters.join(sized, "incident_id", "left_semi"))
    # the events from the start on, cut to three per incident
    slim = events.select("incident_id", "timestamp", "seq", "event_id").join(clusters, "incident_id")
    later = (F.unix_micros("timestamp") > F.col("start_us")) | (
        (F.unix_micros("timestamp") == F.col("start_us")) & (F.col("seq") >= F.col("start_seq")))
    starts = _first_events(slim.filter(later), _EVIDENCE)
    minutes = f"{window_seconds / 60:g}"
    return clusters.join(starts, "incident_id").select(
        "incident_id", F.lit("temporal_clustering").alias("rule_id"),
        F.concat(F.col("n").cast("string"), F.lit(f" events in {minutes}-minute window (compressed attack)")).alias("detail"),
        "evidence",
    )


def _ioc_factors(events: DataFrame, iocs: DataFrame, verdicts: DataFrame | None, results: DataFrame | None) -> DataFrame:
    """Rules about indicators; their evidence is the first events of the incident.

    ``verdicts`` are merged verdicts per indicator (X11), ``results`` single
    provider verdicts (X2-X10).  Both joins are on (type, value).
    """
    none = F.lit(None).cast("string")
    known = iocs.select(
        "incident_id", F.col("type").alias("ioc_type"), F.col("value").alias("ioc_value"), F.lower("value").alias("ioc_key"))
    parts = [
        known.filter(F.col("ioc_type") == "cve").groupBy("incident_id").agg(F.min("ioc_value").alias("v")).select(
            "incident_id", F.lit("cve_exploitation").alias("rule_id"),
            F.concat(F.lit("CVE indicator observed: "), "v").alias("detail"), F.lit(1).alias("keep"),
        )
    ]
    if verdicts is not None:
        matched = known.join(
            verdicts.select("ioc_type", "ioc_key", "is_malicious", "malware_families"), ["ioc_type", "ioc_key"]
        )
        parts.append(
            matched.filter(F.col("is_malicious") & F.col("ioc_type").isin("sha256", "sha1", "md5"))
            .groupBy("incident_id").agg(F.min("ioc_value").alias("v")).select(
                "incident_id", F.lit("known_malicious_hash").alias("rule_id"),
                F.concat(F.lit("Hash matched threat intel: "), F.substring("v", 1, 16), F.lit("...")).alias("detail"),
                F.lit(_EVIDENCE).alias("keep"),
            )
        )
        families = matched.select("incident_id", F.explode("malware_families").alias("family"))
        low = F.lower("family")
        rule = F.when(contains_any(low, V.RANSOMWARE_FAMILIES), "ransomware_family").when(
            contains_any(low, V.RAT_FAMILIES), "rat_family")
        parts.append(
            families.withColumn("rule_id", rule).filter(F.col("rule_id").isNotNull())
            .groupBy("incident_id", "rule_id").agg(F.min("family").alias("v")).select(
                "incident_id", "rule_id",
                F.concat(F.when(F.col("rule_id") == "rat_family", "RAT family: ").otherwise("Ransomware family: "), "v")
                .alias("detail"), F.lit(1).alias("keep"),
            )
        )
    if results is not None:
        engines = results.filter((F.col("provider") == "virustotal") & (F.col("engines_malicious") > 5)).select(
            "ioc_type", F.lower("ioc_value").alias("ioc_key"), "engines_malicious")
        parts.append(
            known.join(engines, ["ioc_type", "ioc_key"]).groupBy("incident_id")
            .agg(F.min(F.struct("ioc_value", "engines_malicious")).alias("v")).select(
                "incident_id", F.lit("high_vt_detections").alias("rule_id"),
                F.concat(F.lit("VT: "), F.col("v.engines_malicious").cast("string"), F.lit(" engines detected "),
                         "v.ioc_value").alias("detail"), F.lit(_EVIDENCE).alias("keep"),
            )
        )
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    empty = F.array().cast("array<string>")
    return hits.join(_first_events(events, _EVIDENCE), "incident_id", "left").select(
        "incident_id", "rule_id", "detail",
        F.slice(F.coalesce("evidence", empty), F.lit(1), F.col("keep")).alias("evidence"),
    )


def risk_factors(
    events: DataFrame,
    iocs: DataFrame | None = None,
    verdicts: DataFrame | None = None,
    mappings: DataFrame | None = None,
    rules: DataFrame | None = None,
    results: DataFrame | None = None,
    cluster_seconds: float = 300,
    cluster_events: int = 10,
) -> DataFrame:
    """Every rule that fires, at most once per incident: label, score, confidence and evidence ids."""
    factors = _event_factors(event_rules(events)).unionByName(_cluster_factors(events, cluster_seconds, cluster_events))
    if iocs is not None:
        factors = factors.unionByName(_ioc_factors(events, iocs, verdicts, results))
    scored = factors.join(rule_table(events.sparkSession, rules), "rule_id", "left").select(
        "incident_id", "rule_id",
        F.concat(F.coalesce("description", "rule_id"), F.lit(": "), "detail").alias("label"),
        F.coalesce("score", F.lit(10)).cast("int").alias("score"), F.lit(V.FACTOR_CONFIDENCE).alias("confidence"),
        "evidence",
    )
    if mappings is None:
        return scored
    tactics = mappings.filter(F.col("tactic") != "").groupBy("incident_id").agg(F.size(F.collect_set("tactic")).alias("n"))
    chain = tactics.filter(F.col("n") > 2).select(
        "incident_id", F.lit("tactic_chain_bonus").alias("rule_id"),
        F.concat(F.lit("Multi-tactic attack chain detected ("), F.col("n").cast("string"), F.lit(" tactics)")).alias("label"),
        ((F.col("n") - 2) * 10).cast("int").alias("score"), F.lit(V.CHAIN_FACTOR_CONFIDENCE).alias("confidence"),
        F.array().cast("array<string>").alias("evidence"),
    )
    return scored.unionByName(chain)


def criticality(events: DataFrame) -> DataFrame:
    """Multiplier per incident: 1.5 with a domain controller, else 1.2 with a server, else 1."""
    host = F.lower(F.coalesce("host", F.lit("")))
    level = (
        F.when(contains_any(host, V.DC_HOST_WORDS), V.DC_MULTIPLIER)
        .when(contains_any(host, V.SERVER_HOST_WORDS), V.SERVER_MULTIPLIER).otherwise(1.0)
    )
    return events.groupBy("incident_id").agg(F.max(level).alias("multiplier"))


def severity_band(score: Column) -> Column:
    case = F
    for bound, name in V.SEVERITY_BANDS[:-1]:
        case = case.when(score >= bound, name)
    return case.otherwise(V.SEVERITY_BANDS[-1][1])


def assess(factors: DataFrame, events: DataFrame) -> DataFrame:
    """Total score, severity and its justification for every incident that has events."""
    totals = factors.groupBy("incident_id").agg(
        F.least(F.sum("score"), F.lit(100)).alias("total"), F.count(F.lit(1)).alias("n_factors")
    )
    out = criticality(events).join(totals, "incident_id", "left").withColumn(
        "total_score",
        F.least(F.lit(100), F.floor(F.coalesce("total", F.lit(0)) * F.col("multiplier"))).cast("int"),
    ).withColumn("severity", severity_band(F.col("total_score")))
    raised = F.when(
        F.col("multiplier") > 1,
        F.concat(F.lit("Score multiplied by "), F.col("multiplier").cast("string"),
                 F.lit("x due to critical asset involvement.")),
    )
    return out.select(
        "incident_id", "total_score", "severity", F.coalesce("n_factors", F.lit(0)).cast("int").alias("n_factors"),
        F.concat_ws(" ", raised, F.concat(
            F.lit("Final score "), F.col("total_score").cast("string"), F.lit(" mapped to "), "severity",
            F.lit(" severity band."))).alias("severity_justification"),
    )
