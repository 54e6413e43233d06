"""Technique mapping: rules over events, first evidence per incident, technique and tactic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell import fixed_values as V
from tracewell.functions.text import basename, contains_any, ends_with_any, explode_once, non_empty
from tracewell.schema import dim_table

_RAW_FIELDS = ["CommandLine", "cmdline", "command_line", "url", "uri", "http.request.url"]
_RAW_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in _RAW_FIELDS])


def with_raw_fields(events: DataFrame) -> DataFrame:
    """Adds ``raw`` with the few raw-record fields that rules look at, parsed once."""
    return events.withColumn("raw", F.from_json("raw_data", _RAW_SCHEMA))


def raw_field(*names: str) -> Column:
    return F.coalesce(*[non_empty(F.col("raw")[n]) for n in names])


def _candidate(
    order: int, condition: Column, technique: Column, name: Column, tactic: Column, confidence: Column, text: Column
) -> Column:
    return F.when(condition, F.struct(
        F.lit(order).alias("ord"), technique.alias("technique_id"), name.alias("technique_name"),
        tactic.alias("tactic"), confidence.cast("double").alias("confidence"), text.alias("description"),
    ))


def _fixed(order: int, condition: Column, technique: tuple, confidence: float, text: Column | str) -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    return _candidate(order, condition, *[F.lit(t) for t in technique[:3]], F.lit(confidence), text)


def _first_of(rules: list[tuple[Column, tuple]], fallback: Column, order: int, make) -> Column:
    """A CASE over rules in order: the first that holds gives the candidate."""
    case = F
    for condition, technique in rules:
        case = case.when(condition, make(technique))
    return case.otherwise(fallback)


def technique_candidates(events: DataFrame) -> DataFrame:
    """Every rule hit of every event: one row per hit, in rule order (``rule_ord``)."""
    spark = events.sparkSession
    process_dim = F.broadcast(dim_table(
        spark, ["p_base", "p_tid", "p_name", "p_tactic"], V.PROCESS_TECHNIQUES))  # 111 fixed rows
    port_dim = F.broadcast(dim_table(
        spark, ["t_port", "t_tid", "t_name", "t_tactic"], V.PORT_TECHNIQUES))  # 20 fixed rows
    class_dim = F.broadcast(dim_table(
        spark, ["c_class", "c_tid", "c_name", "c_tactic"], [(c, *t) for c, t in V.CLASS_TECHNIQUES.items()]))

    cls, activity = F.col("class_uid"), F.coalesce("activity_name", F.lit(""))
    base = with_raw_fields(events).withColumns({
        "p_base": basename(F.col("process_name")),
        "_parent": basename(F.col("parent_process_name")),
        "_cmd": raw_field("CommandLine", "cmdline"),
        "_url": raw_field("url", "uri", "http.request.url"),
    })
    base = base.join(process_dim, "p_base", "left").join(
        port_dim, F.col("dst_port") == F.col("t_port"), "left"
    ).join(class_dim, F.col("class_uid") == F.col("c_class"), "left")

    rules = []
    rules.append(_fixed(
        0, F.col("_parent").isin(V.OFFICE_PROCESSES) & (F.col("process_name") != ""), V.OFFICE_TECHNIQUE, 0.90,
        F.concat("_parent", F.lit(" spawned "), F.lower("process_name")),
    ))
    rules.append(_candidate(
        1, F.col("p_tid").isNotNull(), F.col("p_tid"), F.col("p_name"), F.col("p_tactic"), F.lit(0.95),
        F.concat(F.lit("Process '"), "p_base", F.lit("' observed")),
    ))
    for n, (pattern, tid, name, tactic, score, text) in enumerate(V.COMMAND_LINE_TECHNIQUES):
        rules.append(_fixed(10 + n, F.col("_cmd").rlike("(?iU)" + pattern), (tid, name, tactic), score, text))

    registry = cls.isin(V.REGISTRY_KEY_ACTIVITY, V.REGISTRY_VALUE_ACTIVITY)
    key = F.lower(F.coalesce("registry_key", F.lit("")))
    fallback = lambda score, order: _candidate(
        order, F.col("c_tid").isNotNull(), F.col("c_tid"), F.col("c_name"), F.col("c_tactic"), F.lit(score), activity
    )
    persistence = _first_of(
        [(contains_any(key, words), (tid, name, tactic)) for words, tid, name, tactic in V.REGISTRY_TECHNIQUES],
        fallback(V.REGISTRY_FALLBACK_CONFIDENCE, 30), 30,
        lambda t: _fixed(30, F.lit(True), t, V.REGISTRY_CONFIDENCE,
                         F.concat(F.lit("Registry modification: "), "registry_key")),
    )
    rules.append(F.when(registry, persistence))

    network = cls.isin(V.NETWORK_ACTIVITY, V.DNS_ACTIVITY, V.HTTP_ACTIVITY)
    target = F.coalesce(non_empty(F.col("dst_ip")), non_empty(F.col("domain")), F.lit("None"))
    by_port = _candidate(
        31, F.col("t_tid").isNotNull(), F.col("t_tid"), F.col("t_name"), F.col("t_tactic"),
        F.when(F.col("dst_port").isin(V.COMMON_WEB_PORTS), V.COMMON_WEB_PORT_CONFIDENCE).otherwise(V.PORT_CONFIDENCE),
        F.concat(F.lit("Port "), F.col("dst_port").cast("string"), F.lit(" connection to "), target),
    )
    rules.append(F.when(network, F.coalesce(by_port, fallback(V.NETWORK_FALLBACK_CONFIDENCE, 31))))
    rules.append(_fixed(
        32, network & F.col("_url").rlike("(?iU)" + V.C2_URI_PATTERN), V.C2_URI_TECHNIQUE, V.C2_URI_TECHNIQUE[3],
        F.concat(F.lit("Potential Cobalt Strike C2 URI: "), "_url"),
    ))

    auth = cls == V.AUTHENTICATION
    cloud = auth & F.col("source_type").isin(V.CLOUD_SOURCES)
    for n, (actions, technique) in enumerate([
        (V.CLOUD_ACCOUNT_ACTIONS, V.CLOUD_ACCOUNT_TECHNIQUE),
        (V.CLOUD_STORAGE_ACTIONS, V.CLOUD_STORAGE_TECHNIQUE),
        (V.CLOUD_SECRET_ACTIONS, V.CLOUD_SECRET_TECHNIQUE),
        (None, V.CLOUD_ANY_TECHNIQUE),
    ]):
        hit = cloud if actions is None else cloud & activity.isin(actions)
        rules.append(_fixed(40 + n, hit, technique, technique[3], F.concat(F.lit(technique[4]), activity)))

    other_auth = auth & ~F.coalesce(F.col("source_type").isin(V.CLOUD_SOURCES), F.lit(False))
    failed = contains_any(F.lower(activity), ["fail", "invalid"])
    rules.append(_fixed(
        50, other_auth & failed, V.AUTH_FAILED_TECHNIQUE, V.AUTH_FAILED_TECHNIQUE[3],
        F.concat(F.lit(V.AUTH_FAILED_TECHNIQUE[4]), F.coalesce("src_ip", F.lit(""))),
    ))
    rules.append(_fixed(50, other_auth & ~failed, V.AUTH_OK_TECHNIQUE, V.AUTH_OK_TECHNIQUE[3], V.AUTH_OK_TECHNIQUE[4]))

    file = cls == V.FILE_ACTIVITY
    path = F.lower(F.coalesce("file_path", F.lit("")))
    for n, (hit, technique) in enumerate([
        (contains_any(path, V.VOLATILE_PATHS), V.VOLATILE_PATH_TECHNIQUE),
        (ends_with_any(path, V.SCRIPT_EXTENSIONS), V.SCRIPT_TECHNIQUE),
        (F.endswith(path, F.lit(V.SHORTCUT_EXTENSION)), V.SHORTCUT_TECHNIQUE),
    ]):
        rules.append(_fixed(60 + n, file & hit, technique, technique[3], F.concat(F.lit(technique[4]), "file_path")))

    return explode_once(
        base, ["incident_id", "event_id", "timestamp", "seq"], F.array_compact(F.array(*rules)), "c"
    ).select(
        "incident_id", "event_id", "timestamp", "seq", F.col("c.ord").alias("rule_ord"), "c.technique_id",
        "c.technique_name", "c.tactic", "c.confidence", "c.description",
    )


def map_techniques(events: DataFrame) -> DataFrame:
    """One row per incident, technique and tactic, with the first event that shows it.

    A minimum over (time, input order, rule order): tasks reduce their own hits
    first, so an incident with a third of all events shuffles a handful of rows
    per task.
    """
    first = F.min(F.struct(
        "timestamp", "seq", "rule_ord", "technique_name", "confidence", "description", "event_id"
    )).alias("f")
    return technique_candidates(events).groupBy("incident_id", "technique_id", "tactic").agg(first).select(
        "incident_id", "technique_id", "f.technique_name", "tactic", "f.confidence", "f.description", "f.event_id",
        "f.timestamp", "f.seq", "f.rule_ord",
    )


def tactic_chain(mappings: DataFrame) -> DataFrame:
    """Observed tactics in stage order and the breadth score per incident."""
    order = F.array(*[F.lit(t) for t in V.TACTIC_ORDER])
    chain = F.array_intersect(order, F.collect_set("tactic"))  # at most twelve names
    out = mappings.groupBy("incident_id").agg(chain.alias("tactic_chain"))
    n = F.size("tactic_chain")
    return out.withColumn(
        "chain_score", F.when(n <= 1, F.lit(0.0)).otherwise(F.least(F.lit(1.0), n / F.lit(float(len(V.TACTIC_ORDER)))))
    )


def technique_layer(mappings: DataFrame) -> DataFrame:
    """Techniques with a colour band by confidence and a tactic slug."""
    return mappings.select(
        "incident_id", "technique_id", F.replace(F.lower("tactic"), F.lit(" "), F.lit("-")).alias("tactic"),
        F.when(F.col("confidence") >= 0.9, "#ff0000").when(F.col("confidence") >= 0.7, "#ff8800")
        .otherwise("#ffcc00").alias("color"),
        F.coalesce("description", F.lit("")).alias("comment"),
        F.format_string("%.0f%%", F.col("confidence") * 100).alias("confidence"),
    )
