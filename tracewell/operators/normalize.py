"""Raw records to events: detection, one dispatching projection, coercions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import fixed_values as V
from tracewell.ext import custom_sources
from tracewell.functions import coerce
from tracewell.functions.text import non_empty
from tracewell.schema import EVENT_COLUMNS, complete_events
from tracewell.sources.mappings import DETECTION, HASH_LISTS, MAPPINGS, case_of, get, key_values

_SPACE = " \t\n\r\x0b\x0c"
_VALIDATE = {
    "process_pid": coerce.coerce_pid, "parent_process_pid": coerce.coerce_pid,
    "src_port": coerce.coerce_port, "dst_port": coerce.coerce_port,
    "src_ip": coerce.coerce_ip, "dst_ip": coerce.coerce_ip, "file_hash": coerce.coerce_sha256,
}
_MAPPED = [
    "class_uid", "activity_name", "host", "user", "process_name", "process_pid", "process_guid",
    "parent_process_name", "parent_process_pid", "parent_process_guid", "file_path", "file_hash", "src_ip",
    "src_port", "dst_ip", "dst_port", "protocol", "domain", "registry_key", "session_id", "auth_id",
]


def _names(sources: dict | None) -> list[str]:
    return V.SOURCES + [n for n in (sources or {}) if n not in V.SOURCES]


def detect_source(record: Column, sources: dict | None = None) -> Column:
    """Name of the source of the variant column ``record``: the first rule that holds, else generic.

    Rules of registered sources come before the built-in ones.
    """
    rules = " ".join(f"WHEN {rule} THEN '{name}'" for name, rule in DETECTION)
    case = F.expr(f"CASE {rules} ELSE 'generic' END")
    for name, source in reversed(list({**custom_sources(), **(sources or {})}.items())):
        case = F.when(F.coalesce(source.detect(record), F.lit(False)), name).otherwise(case)
    return case


def parse_records(df: DataFrame) -> DataFrame:
    """Adds the variant ``record``; a line that is no JSON object becomes one with the line as message."""
    parsed = F.try_parse_json(F.col("raw_data"))
    is_object = F.startswith(F.ltrim("raw_data"), F.lit("{"))
    source = F.col("file_name") if "file_name" in df.columns else F.lit("generic")
    fallback = F.to_json(F.struct(F.col("raw_data").alias("message"), source.alias("raw_source")))
    record = F.coalesce(F.when(is_object, parsed), F.parse_json(fallback))
    # the raw line is kept as it came; only a line without structure is stored as its record
    kept = F.when(is_object & parsed.isNotNull(), F.col("raw_data")).otherwise(fallback)
    return df.withColumns({"record": record, "raw_data": kept})


def normalize(
    df: DataFrame,
    parser: str | None = None,
    ingest_ts: Column | str | None = None,
    time_keys: list[str] | None = None,
    sources: dict | None = None,
) -> DataFrame:
    """Events from raw lines: (raw_data[, file, file_name, seq, incident_id]) to the event schema.

    One scan and one projection.  Each target column is a CASE over the source
    number whose branches hold only the sources that fill that column, so a
    query that reads three columns computes three.  Every branch yields a value
    or NULL; no record stops the job.  Records without a time get ``ingest_ts``.
    """
    known = {**custom_sources(), **(sources or {})}
    names = _names(known)
    if parser is not None and parser not in names:
        parser = "generic"
    ingest = F.lit(None) if ingest_ts is None else ingest_ts if isinstance(ingest_ts, Column) else F.lit(ingest_ts)
    ingest = ingest.cast("timestamp")
    step = parse_records(df)
    record = F.col("record")
    mappings = {n: MAPPINGS[n] for n in V.SOURCES} | {n: s.mapping for n, s in known.items()}
    if parser is None:
        number = F.expr("CASE _name " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(names)) + " END")
        step = step.withColumn("_name", detect_source(record, sources)).withColumn("_n", number)
    else:
        # one source: no detection, and no branches of other sources
        names = [parser]
        step = step.withColumns({"_name": F.lit(parser), "_n": F.lit(0)})

    number_of = lambda n: names.index(n) if n in names else None
    step = step.withColumn("_kv", F.expr(key_values(number_of("cef"), number_of("leef"))))

    # First projection: only choose texts.  Second: check them.  The checks look at their
    # input several times, so it has to be a column by then, not an expression.
    def chosen(target: str) -> Column:
        branches = [(i, mappings[n][target]) for i, n in enumerate(names) if target in mappings[n]]
        return case_of(branches, record, "int" if target == "class_uid" else "string")

    carried = [c for c in ("seq", "incident_id", "file", "line") if c in df.columns]
    keys = time_keys or V.TIME_KEYS
    own_type = [(i, mappings[n]["source_type"]) for i, n in enumerate(names) if "source_type" in mappings[n]]
    mapped = step.select(
        "raw_data", *carried, "_n", case_of(own_type, record, "string", "_name").alias("source_type"),
        *[F.expr(get(k)).alias(f"_t{i}") for i, k in enumerate(keys)],
        *[chosen(t).alias(f"_{t}") for t in _MAPPED],
    )
    listed = F.col("_n").isin([i for i, n in enumerate(names) if n in HASH_LISTS])
    mapped = mapped.withColumn("_file_hash", F.when(listed, coerce.extract_hash(F.col("_file_hash"))).otherwise(F.col("_file_hash")))

    def finished(target: str) -> Column:
        col = F.col(f"_{target}")
        if target in _VALIDATE:
            return _VALIDATE[target](col).alias(target)
        if target == "class_uid":
            return col.alias(target)
        return F.nullif(F.btrim(col, F.lit(_SPACE)), F.lit("")).alias(target)

    time = F.coalesce(*[coerce.parse_iso(F.col(f"_t{i}")) for i in range(len(keys))], ingest).alias("timestamp")
    identity = [F.col(c).cast("string") for c in ("file", "line" if "line" in df.columns else "seq") if c in df.columns]
    out = mapped.select(
        F.sha2(F.concat_ws("|", *identity, "raw_data"), 256).alias("event_id"), "source_type", "raw_data",
        time, *[c for c in carried if c not in ("file", "line")], *[finished(t) for t in _MAPPED],
    )
    return complete_events(out)


# ---------------------------------------------------------------- after normalization


def apply_skew(events: DataFrame, offsets: DataFrame, default: float = 0.0) -> DataFrame:
    """Move times by the clock offset of their host, or by ``default`` seconds.

    ``offsets`` has host and offset_seconds, one row per host; Spark chooses the join.
    """
    table = offsets.select("host", F.col("offset_seconds").cast("double").alias("_skew"))
    moved = F.timestamp_micros(
        F.unix_micros("timestamp") + F.round(F.coalesce("_skew", F.lit(float(default))) * 1000000).cast("bigint")
    )
    return events.join(table, "host", "left").withColumn("timestamp", moved).select(*events.columns)


def enforce(events: DataFrame, strict: bool = False, ingest_ts: Column | str | None = None) -> DataFrame:
    """Drop rows without class, activity or time if ``strict``, else fill them in.

    Unknown classes become detection findings, unknown activity, severity and
    status ids become 0.
    """
    if strict:
        events = events.filter(
            F.col("class_uid").isNotNull() & (F.coalesce("activity_name", F.lit("")) != "") & F.col("timestamp").isNotNull()
        )
    ingest = F.lit(None) if ingest_ts is None else ingest_ts if isinstance(ingest_ts, Column) else F.lit(ingest_ts)
    keep = lambda name, allowed, default: F.when(F.col(name).isin(allowed), F.col(name)).otherwise(default)
    return events.withColumns({
        "class_uid": keep("class_uid", V.KNOWN_CLASSES, V.DETECTION_FINDING),
        "activity_name": F.coalesce(non_empty(F.col("activity_name")), F.lit("Unknown")),
        "timestamp": F.coalesce("timestamp", ingest.cast("timestamp")),
        "activity_id": keep("activity_id", list(range(len(V.ACTIVITY_NAMES))), 0),
        "severity_id": keep("severity_id", V.SEVERITY_IDS, 0),
        "status_id": keep("status_id", V.STATUS_IDS, 0),
    })


def validate_fields(df: DataFrame) -> DataFrame:
    """Event columns with bad scalars set to NULL, from a table that already has event columns."""
    if "id" in df.columns and "event_id" not in df.columns:
        df = df.withColumnRenamed("id", "event_id")
    if "raw_source" in df.columns and "source_type" not in df.columns:
        df = df.withColumnRenamed("raw_source", "source_type")
    kinds = dict(df.dtypes)
    out = {c: _VALIDATE[c](F.col(c)) for c in _VALIDATE if c in df.columns}
    if kinds.get("timestamp") not in (None, "timestamp"):
        numeric = kinds["timestamp"] != "string"
        out["timestamp"] = coerce.coerce_utc_datetime(F.col("timestamp"), numeric=numeric)
    for name, kind in kinds.items():
        if kind == "string" and name in EVENT_COLUMNS and name not in out and name != "raw_data":
            out[name] = F.btrim(F.col(name), F.lit(_SPACE))
    return complete_events(df.withColumns(out))


def type_uid(class_uid: Column, activity_id: Column) -> Column:
    return class_uid * 100 + activity_id


def category_uid(class_uid: Column) -> Column:
    case = F
    for category in sorted(set(V.CATEGORY_BY_CLASS.values())):
        case = case.when(class_uid.isin([c for c, k in V.CATEGORY_BY_CLASS.items() if k == category]), category)
    return case.otherwise(F.lit(None).cast("int"))


def activity_label(name: Column, activity_id: Column) -> Column:
    """The name, or one made of the activity id if the name is "Unknown" (E7)."""
    labels = F.array(*[F.lit(n.replace("_", " ").title()) for n in V.ACTIVITY_NAMES])
    return F.when((name == "Unknown") & (activity_id > 0), F.coalesce(F.get(labels, activity_id), name)).otherwise(name)


def with_ocsf_ids(events: DataFrame) -> DataFrame:
    return events.withColumns({
        "type_uid": type_uid(F.col("class_uid"), F.col("activity_id")),
        "category_uid": category_uid(F.col("class_uid")),
        "activity_name": activity_label(F.col("activity_name"), F.col("activity_id")),
    })


# ---------------------------------------------------------------- nested form


def _some(condition: Column, value: Column) -> Column:
    return F.when(condition, value)


def _any_set(*names: str) -> Column:
    cond = F.lit(False)
    for n in names:
        cond = cond | (F.coalesce(F.col(n).cast("string"), F.lit("")) != "")
    return cond


def nested_from_flat(events: DataFrame) -> DataFrame:
    """Adds actor, device, process, file, connection_info, session and metadata structs."""
    pid_set = lambda n: F.coalesce(F.col(n), F.lit(0)) != 0
    parent_set = _any_set("parent_process_name", "parent_process_guid") | pid_set("parent_process_pid")
    process_set = _any_set("process_name", "process_guid") | pid_set("process_pid") | parent_set
    src_set = _any_set("src_ip") | pid_set("src_port")
    dst_set = _any_set("dst_ip", "domain") | pid_set("dst_port")
    parent = F.struct(
        F.col("parent_process_name").alias("name"), F.col("parent_process_pid").alias("pid"),
        F.col("parent_process_guid").alias("uid"),
    )
    return events.withColumns({
        "device": _some(_any_set("host"), F.struct(F.col("host").alias("hostname"), F.col("host").alias("name"))),
        "actor": _some(_any_set("user"), F.struct(F.struct(F.col("user").alias("name")).alias("user"))),
        "process": _some(process_set, F.struct(
            F.col("process_name").alias("name"), F.col("process_pid").alias("pid"), F.col("process_guid").alias("uid"),
            _some(parent_set, parent).alias("parent_process"),
        )),
        "file": _some(_any_set("file_path", "file_hash"), F.struct(
            F.col("file_path").alias("path"),
            _some(_any_set("file_hash"), F.array(F.struct(F.col("file_hash").alias("value")))).alias("hashes"),
        )),
        "connection_info": _some(src_set | dst_set | _any_set("protocol"), F.struct(
            F.col("protocol").alias("protocol_name"),
            _some(src_set, F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port"))).alias("src_endpoint"),
            _some(dst_set, F.struct(
                F.col("dst_ip").alias("ip"), F.col("dst_port").alias("port"), F.col("domain").alias("domain"),
            )).alias("dst_endpoint"),
        )),
        "session": _some(_any_set("session_id"), F.struct(F.col("session_id").alias("uid"))),
        "metadata": F.struct(
            F.struct(F.col("source_type").alias("name")).alias("product"),
            F.col("class_uid").cast("string").alias("event_code"),
        ),
    })


def flat_from_nested(df: DataFrame) -> DataFrame:
    """Fill missing flat columns from the nested structs."""
    text = lambda flat, *inner: F.coalesce(non_empty(F.col(flat)), *[F.col(i) for i in inner])
    number = lambda flat, inner: F.coalesce(F.col(flat), F.col(inner))
    first_hash = F.get(F.filter(F.transform("file.hashes", lambda h: h["value"]), lambda v: v != ""), F.lit(0))
    return df.withColumns({
        "host": F.coalesce(non_empty(F.col("host")), non_empty(F.col("device.hostname")), F.col("device.name")),
        "user": text("user", "actor.user.name"),
        "process_name": text("process_name", "process.name"), "process_pid": number("process_pid", "process.pid"),
        "process_guid": text("process_guid", "process.uid"),
        "parent_process_name": text("parent_process_name", "process.parent_process.name"),
        "parent_process_pid": number("parent_process_pid", "process.parent_process.pid"),
        "parent_process_guid": text("parent_process_guid", "process.parent_process.uid"),
        "file_path": text("file_path", "file.path"), "file_hash": F.coalesce(non_empty(F.col("file_hash")), first_hash),
        "src_ip": text("src_ip", "connection_info.src_endpoint.ip"),
        "src_port": number("src_port", "connection_info.src_endpoint.port"),
        "dst_ip": text("dst_ip", "connection_info.dst_endpoint.ip"),
        "dst_port": number("dst_port", "connection_info.dst_endpoint.port"),
        "domain": text("domain", "connection_info.dst_endpoint.domain"),
        "protocol": text("protocol", "connection_info.protocol_name"),
        "session_id": text("session_id", "session.uid"),
    })


_TYPED = {
    V.PROCESS_ACTIVITY: ["process"], V.FILE_ACTIVITY: ["file", "process"],
    V.NETWORK_ACTIVITY: ["connection_info", "process"], V.AUTHENTICATION: ["session", "src_endpoint"],
    V.REGISTRY_KEY_ACTIVITY: ["reg_key", "process"], V.REGISTRY_VALUE_ACTIVITY: ["reg_key", "process"],
    V.DNS_ACTIVITY: ["query", "connection_info"], V.HTTP_ACTIVITY: ["connection_info"],
    V.DETECTION_FINDING: [], V.SCHEDULED_JOB_ACTIVITY: [],
}


def to_ocsf(events: DataFrame, class_uid: int) -> DataFrame:
    """Typed projection of the events of one class."""
    typed = nested_from_flat(with_ocsf_ids(events.filter(F.col("class_uid") == class_uid)))
    typed = typed.withColumns({
        "src_endpoint": F.col("connection_info.src_endpoint"), "reg_key": F.col("registry_key"), "query": F.col("domain"),
    })
    return typed.select(
        "event_id", "source_type", "raw_data", "timestamp", "class_uid", "category_uid", "type_uid", "activity_id",
        "activity_name", "severity_id", "status_id", "actor", "device", "metadata", *_TYPED.get(class_uid, []),
    )
