"""Queries: timeline, root cause, techniques, risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import fixed_values as V
from tracewell.operators import attack, risk, timeline
from tracewell.plans.views import oracle, sec_events, sql_ts, ts_text
from tracewell.schema import dim_table

QUERIES = {}
ORACLES = {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _q(text: str) -> str:
    return "'" + str(text).replace("'", "''") + "'"


def _in(column: str, values: list) -> str:
    return f"{column} IN ({', '.join(_q(v) if isinstance(v, str) else str(v) for v in values)})"


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {_q(w)})" for w in words) + ")"


def _base(column: str) -> str:
    return f"list_extract(string_split(replace(lower(coalesce({column}, '')), '/', '\\'), '\\'), -1)"


def _base1(column: str) -> str:
    return f"list_extract(string_split(lower(coalesce({column}, '')), '\\'), -1)"


# ------------------------------------------------------------------ timeline

_SUMMARY = (
    "CASE WHEN class_uid = 1007 AND parent_process_name IS NOT NULL THEN parent_process_name || ' → ' || "
    "coalesce(process_name, 'process') "
    "WHEN class_uid = 4001 THEN coalesce(process_name, host, 'host') || ' connected to ' || "
    "coalesce(domain, dst_ip, 'remote host') "
    "WHEN class_uid = 1001 AND file_path IS NOT NULL THEN 'File activity: ' || file_path "
    "WHEN class_uid = 201001 AND registry_key IS NOT NULL THEN 'Registry modified: ' || registry_key "
    "WHEN class_uid = 3002 AND \"user\" IS NOT NULL THEN 'Authentication by ' || \"user\" "
    "ELSE activity_name || coalesce(' on ' || host, '') END"
)
_PHASE = "CASE class_uid " + " ".join(
    f"WHEN {c} THEN {_q(p)}" for c, p in V.PHASE_BY_CLASS.items()) + f" ELSE {_q(V.DEFAULT_PHASE)} END"
# time is cut to the minute in this query, so that repeated (time, text) pairs exist
_ENTRIES = (
    f"SELECT incident_id, timestamp, summary, seq, phase, detail, event_id FROM (SELECT *, {_SUMMARY} AS summary, "
    f"{_PHASE} AS phase, activity_name AS detail, row_number() OVER (PARTITION BY incident_id, timestamp, {_SUMMARY} "
    "ORDER BY seq) AS rn FROM hourly) WHERE rn = 1"
)
_HOURLY = "hourly AS (SELECT * REPLACE (date_trunc('hour', timestamp) AS timestamp) FROM sec_events)"


def _hourly(s, d):
    return sec_events(s, d).withColumn("timestamp", F.date_trunc("hour", "timestamp"))


_add(
    "build_timeline",
    lambda s, d: ts_text(timeline.timeline(_hourly(s, d)), "timestamp"),
    oracle(
        "SELECT incident_id, " + sql_ts("timestamp", "timestamp") + f", summary, seq, phase, detail, event_id FROM ({_ENTRIES})",
        _HOURLY,
    ),
)
_add(
    "timeline_phases",
    lambda s, d: timeline.timeline(_hourly(s, d)).groupBy("incident_id", "phase").agg(F.count(F.lit(1)).alias("n")),
    oracle(f"SELECT incident_id, phase, count(*) AS n FROM ({_ENTRIES}) GROUP BY 1, 2", _HOURLY),
)
_EVIDENCE_ID = "sha256('evidence|' || incident_id || '|' || event_id)"
_add(
    "build_evidence",
    lambda s, d: ts_text(timeline.build_evidence(sec_events(s, d)).drop("evidence_ord"), "timestamp"),
    oracle(
        f"SELECT incident_id, {_EVIDENCE_ID} AS evidence_id, activity_name || ' on ' || coalesce(host, 'unknown') AS summary, "
        "source_type AS source, " + sql_ts("timestamp", "timestamp") + ", event_id FROM sec_events"
    ),
)

# ------------------------------------------------------------------ root cause

_CAUSES_CTE = f"""causes AS (SELECT incident_id, coalesce(sp.host, fi.host) AS patient_zero,
  CASE WHEN sp IS NOT NULL THEN 'User opened a document (' || sp.p || ') that spawned ' || sp.c ||
    ', indicating likely malicious macro or exploit.'
  WHEN re IS NOT NULL THEN 'Earliest suspicious network activity to ' || re.dst_ip
  ELSE 'Initial activity: ' || fi.activity_name || ' on ' || coalesce(fi.host, 'unknown host') END AS root_cause,
  CASE WHEN sp IS NOT NULL THEN sp.p || ' spawned ' || sp.c
  WHEN re IS NOT NULL THEN 'Earliest suspicious network activity to ' || re.dst_ip
  ELSE 'Initial activity: ' || fi.activity_name || ' on ' || coalesce(fi.host, 'unknown host') END AS summary,
  coalesce(sp.event_id, re.event_id, fi.event_id) AS event_id,
  coalesce(sp.timestamp, re.timestamp, fi.timestamp) AS timestamp,
  fi.event_id AS first_event_id, fi.timestamp AS first_timestamp
  FROM (SELECT incident_id,
    arg_min(e, (timestamp, seq)) AS fi,
    arg_min(e, (timestamp, seq)) FILTER ({_in('e.p', V.ROOT_CAUSE_PARENTS)} AND {_in('e.c', V.ROOT_CAUSE_CHILDREN)}) AS sp,
    arg_min(e, (timestamp, seq)) FILTER (class_uid = 4001 AND dst_ip <> '') AS re
    FROM (SELECT *, {{'event_id': event_id, 'timestamp': timestamp, 'host': host, 'activity_name': activity_name,
      'dst_ip': dst_ip, 'p': {_base('parent_process_name')}, 'c': {_base('process_name')}}} AS e FROM sec_events)
    GROUP BY incident_id))"""
_add(
    "root_cause",
    lambda s, d: ts_text(timeline.root_cause(sec_events(s, d)), "timestamp", "first_timestamp"),
    oracle(
        "SELECT * EXCLUDE (timestamp, first_timestamp), " + sql_ts("timestamp", "timestamp") + ", "
        + sql_ts("first_timestamp", "first_timestamp") + " FROM causes",
        _CAUSES_CTE,
    ),
)


def _by_user(s, d):
    """The same events with one incident per user: smaller groups, more cases."""
    return sec_events(s, d).withColumn("incident_id", F.col("user"))


_add(
    "root_cause_by_user",
    lambda s, d: ts_text(timeline.root_cause(_by_user(s, d)), "timestamp", "first_timestamp"),
    oracle(
        "SELECT * EXCLUDE (timestamp, first_timestamp), " + sql_ts("timestamp", "timestamp") + ", "
        + sql_ts("first_timestamp", "first_timestamp") + " FROM causes",
        "by_user AS (SELECT * REPLACE (\"user\" AS incident_id) FROM sec_events)",
        _CAUSES_CTE.replace("FROM sec_events", "FROM by_user"),
    ),
)
_add(
    "root_cause_evidence",
    lambda s, d: ts_text(
        timeline.root_cause_evidence(timeline.root_cause(sec_events(s, d))).drop("evidence_id", "evidence_ord"),
        "timestamp",
    ),
    oracle(
        "SELECT incident_id, summary, 'root_cause_analyzer' AS source, " + sql_ts("timestamp", "timestamp")
        + ", event_id FROM causes UNION ALL SELECT incident_id, 'Patient zero identified as ' || patient_zero, "
        "'root_cause_analyzer', " + sql_ts("first_timestamp", "timestamp")
        + ", first_event_id FROM causes WHERE patient_zero <> ''",
        _CAUSES_CTE,
    ),
)
_add(
    "affected_assets",
    lambda s, d: timeline.affected_assets(_by_user(s, d)),
    oracle("SELECT DISTINCT \"user\" AS incident_id, host FROM sec_events WHERE host <> ''"),
)


def incident_alerts(s, d):
    """One alert per incident, from the first error event of it."""
    errors = sec_events(s, d).filter("class_uid = 1007")
    return errors.groupBy("incident_id").agg(F.min(F.struct("seq", "timestamp", "user")).alias("f")).select(
        "incident_id", F.concat(F.lit("Alert on "), "incident_id").alias("title"), F.lit("high").alias("severity"),
        F.col("f.timestamp").alias("timestamp"), F.col("incident_id").alias("host"),
        F.when(F.col("f.seq") % 2 == 0, F.col("f.user")).alias("user"),
        F.concat(F.lit("al-"), "incident_id").alias("id"), F.lit(None).cast("string").alias("description"),
        F.concat(F.lit('{"note": "see CVE-2024-1111 and '), F.sha2("incident_id", 256), F.lit('"}')).alias("raw"),
    )


INCIDENT_ALERTS_CTE = (
    "incident_alerts AS (SELECT incident_id, 'Alert on ' || incident_id AS title, min(seq) AS seq, "
    "arg_min(timestamp, seq) AS timestamp, arg_min(\"user\", seq) AS u FROM sec_events WHERE class_uid = 1007 GROUP BY 1)"
)


def incident_summary(s, d):
    events = sec_events(s, d)
    causes = timeline.root_cause(events)
    evidence = timeline.build_evidence(events).unionByName(timeline.root_cause_evidence(causes))
    return timeline.incident_summary(incident_alerts(s, d), timeline.timeline(events, evidence), events, causes)


_LINES = f"""entries AS ({_ENTRIES.replace('FROM hourly', 'FROM sec_events')}),
cited AS (SELECT t.*, CASE WHEN t.event_id = c.first_event_id THEN sha256('patient zero|' || t.incident_id || '|' || t.event_id)
  WHEN t.event_id = c.event_id THEN sha256('cause|' || t.incident_id || '|' || t.event_id)
  ELSE sha256('evidence|' || t.incident_id || '|' || t.event_id) END AS evidence_id,
  row_number() OVER (PARTITION BY t.incident_id ORDER BY t.timestamp, t.seq) AS rn
  FROM entries t JOIN causes c ON t.incident_id = c.incident_id),
lines AS (SELECT incident_id, min(timestamp) AS first_ts, string_agg('At ' || strftime(timestamp, '%H:%M') || ', ' || summary ||
  '. [evidence: ' || substr(evidence_id, 1, 8) || ']', ' ' ORDER BY rn) AS lines FROM cited WHERE rn <= 8 GROUP BY 1),
facts AS (SELECT incident_id, count(*) AS n, arg_min("user", (timestamp, seq)) AS first_user FROM sec_events GROUP BY 1),
counted AS (SELECT incident_id, count(*) AS m FROM entries GROUP BY 1)"""
_add(
    "incident_summary",
    incident_summary,
    oracle(
        "SELECT a.incident_id, 'Investigation of ''' || a.title || ''' on ' || c.patient_zero || ' (' || f.n || "
        "' correlated events, ' || (f.n + 2) || ' evidence items).' AS summary, "
        "'On ' || strftime(l.first_ts, '%Y-%m-%d %H:%M UTC') || ', ' || CASE WHEN a.seq % 2 = 0 THEN a.u ELSE f.first_user END || "
        "' triggered alert ''' || a.title || ''' on workstation ' || c.patient_zero || '. ' || c.root_cause || ' ' || l.lines || "
        "CASE WHEN m > 8 THEN ' ... and ' || (m - 8) || ' additional timeline events.' ELSE '' END AS narrative, "
        "'A high-severity security incident was detected on ' || c.patient_zero || '. ' || c.root_cause || "
        "' Immediate containment and forensic review are recommended.' AS executive "
        "FROM incident_alerts a JOIN causes c ON a.incident_id = c.incident_id JOIN facts f ON a.incident_id = f.incident_id "
        "JOIN lines l ON a.incident_id = l.incident_id JOIN counted m ON a.incident_id = m.incident_id",
        _CAUSES_CTE, INCIDENT_ALERTS_CTE, _LINES,
    ),
)

# ------------------------------------------------------------------ techniques

_CMD = "json_extract_string(raw_data, '$.CommandLine')"
_URL = "json_extract_string(raw_data, '$.url')"


def _rule(order, where, tid, name, tactic, score, text):
    return (
        f"SELECT incident_id, event_id, timestamp, seq, {order} AS rule_ord, {_q(tid)} AS technique_id, "
        f"{_q(name)} AS technique_name, {_q(tactic)} AS tactic, {score} AS confidence, {text} AS description "
        f"FROM ev WHERE {where}"
    )


def _technique_ctes(source: str = "sec_events") -> list[str]:
    values = lambda rows: ", ".join("(" + ", ".join(_q(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    branches = [
        _rule(0, f"{_in('parent_base', V.OFFICE_PROCESSES)} AND process_name <> ''", *V.OFFICE_TECHNIQUE, 0.90,
              "parent_base || ' spawned ' || lower(process_name)"),
        "SELECT incident_id, event_id, timestamp, seq, 1, tid, tname, ttactic, 0.95, 'Process ''' || proc_base || ''' observed' "
        f"FROM ev JOIN (VALUES {values(V.PROCESS_TECHNIQUES)}) AS p(pbase, tid, tname, ttactic) ON proc_base = pbase",
    ]
    for n, (pattern, tid, name, tactic, score, text) in enumerate(V.COMMAND_LINE_TECHNIQUES):
        branches.append(_rule(10 + n, f"regexp_matches(cmd, {_q('(?i)' + pattern)})", tid, name, tactic, score, _q(text)))
    seen = []
    for words, tid, name, tactic in V.REGISTRY_TECHNIQUES:
        hit = _any("lower(registry_key)", words)
        where = "class_uid IN (201001, 201002) AND " + " AND ".join([hit] + [f"NOT {s}" for s in seen])
        branches.append(_rule(30, where, tid, name, tactic, 0.88, "'Registry modification: ' || registry_key"))
        seen.append(hit)
    for cls in (201001, 201002):
        where = f"class_uid = {cls} AND " + " AND ".join(f"NOT {s}" for s in seen)
        branches.append(_rule(30, where, *V.CLASS_TECHNIQUES[cls], 0.70, "activity_name"))
    ports = ", ".join(str(p[0]) for p in V.PORT_TECHNIQUES)
    for port, tid, name, tactic in V.PORT_TECHNIQUES:
        branches.append(_rule(
            31, f"class_uid IN (4001, 4002, 4003) AND dst_port = {port}", tid, name, tactic,
            0.65 if port in (80, 443) else 0.80, f"'Port {port} connection to ' || coalesce(dst_ip, domain)"))
    for cls in (4001, 4002, 4003):
        branches.append(_rule(31, f"class_uid = {cls} AND (dst_port IS NULL OR dst_port NOT IN ({ports}))",
                              *V.CLASS_TECHNIQUES[cls], 0.65, "activity_name"))
    branches.append(_rule(32, f"class_uid IN (4001, 4002, 4003) AND regexp_matches(url, {_q('(?i)' + V.C2_URI_PATTERN)})",
                          *V.C2_URI_TECHNIQUE, "'Potential Cobalt Strike C2 URI: ' || url"))
    cloud = f"class_uid = 3002 AND {_in('source_type', V.CLOUD_SOURCES)}"
    for n, (actions, t) in enumerate([(V.CLOUD_ACCOUNT_ACTIONS, V.CLOUD_ACCOUNT_TECHNIQUE),
                                      (V.CLOUD_STORAGE_ACTIONS, V.CLOUD_STORAGE_TECHNIQUE),
                                      (V.CLOUD_SECRET_ACTIONS, V.CLOUD_SECRET_TECHNIQUE), (None, V.CLOUD_ANY_TECHNIQUE)]):
        where = cloud if actions is None else f"{cloud} AND {_in('activity_name', actions)}"
        branches.append(_rule(40 + n, where, *t[:4], f"{_q(t[4])} || activity_name"))
    other = f"class_uid = 3002 AND NOT {_in('source_type', V.CLOUD_SOURCES)}"
    failed = _any("lower(activity_name)", ["fail", "invalid"])
    branches.append(_rule(50, f"{other} AND {failed}", *V.AUTH_FAILED_TECHNIQUE[:4], f"{_q(V.AUTH_FAILED_TECHNIQUE[4])} || src_ip"))
    branches.append(_rule(50, f"{other} AND NOT {failed}", *V.AUTH_OK_TECHNIQUE[:4], _q(V.AUTH_OK_TECHNIQUE[4])))
    path = "lower(file_path)"
    for n, (hit, t) in enumerate([
        (_any(path, V.VOLATILE_PATHS), V.VOLATILE_PATH_TECHNIQUE),
        ("(" + " OR ".join(f"suffix({path}, {_q(x)})" for x in V.SCRIPT_EXTENSIONS) + ")", V.SCRIPT_TECHNIQUE),
        (f"suffix({path}, '.lnk')", V.SHORTCUT_TECHNIQUE),
    ]):
        branches.append(_rule(60 + n, f"class_uid = 1001 AND {hit}", *t[:4], f"{_q(t[4])} || file_path"))
    return [
        f"ev AS (SELECT *, {_base('process_name')} AS proc_base, {_base('parent_process_name')} AS parent_base, "
        f"{_CMD} AS cmd, {_URL} AS url FROM {source})",
        "candidates AS (" + " UNION ALL ".join(branches) + ")",
        "mappings AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY incident_id, technique_id, tactic "
        "ORDER BY timestamp, seq, rule_ord) AS rn FROM candidates) WHERE rn = 1)",
    ]


TECHNIQUE_CTES = _technique_ctes()
_add(
    "technique_candidates",
    lambda s, d: attack.technique_candidates(sec_events(s, d)).groupBy("rule_ord", "technique_id", "tactic").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("confidence"), 2).alias("confidence")),
    oracle("SELECT rule_ord, technique_id, tactic, count(*) AS n, round(CAST(max(confidence) AS DOUBLE), 2) AS confidence "
           "FROM candidates GROUP BY 1, 2, 3", *TECHNIQUE_CTES),
)
_add(
    "map_techniques",
    lambda s, d: ts_text(attack.map_techniques(sec_events(s, d)).withColumn("confidence", F.round("confidence", 2)), "timestamp"),
    oracle(
        "SELECT incident_id, technique_id, technique_name, tactic, round(CAST(confidence AS DOUBLE), 2) AS confidence, "
        "description, event_id, " + sql_ts("timestamp", "timestamp") + ", seq, rule_ord FROM mappings",
        *TECHNIQUE_CTES,
    ),
)
_add(
    "map_techniques_by_user",
    lambda s, d: attack.map_techniques(_by_user(s, d)).select(
        "incident_id", "technique_id", "tactic", "description", "event_id"),
    oracle(
        "SELECT incident_id, technique_id, tactic, description, event_id FROM mappings",
        "by_user AS (SELECT * REPLACE (\"user\" AS incident_id) FROM sec_events)", *_technique_ctes("by_user"),
    ),
)
_ORDER = "list_value(" + ", ".join(_q(t) for t in V.TACTIC_ORDER) + ")"
_CHAIN_CTE = (
    f"chains AS (SELECT incident_id, list_filter({_ORDER}, lambda t: list_contains(ts, t)) AS chain FROM "
    "(SELECT incident_id, list(DISTINCT tactic) AS ts FROM mappings GROUP BY 1))"
)
_add(
    "tactic_chain",
    lambda s, d: attack.tactic_chain(attack.map_techniques(_by_user(s, d))).select(
        "incident_id", F.array_join("tactic_chain", ",").alias("tactic_chain"),
        F.round("chain_score", 6).alias("chain_score")),
    oracle(
        "SELECT incident_id, array_to_string(chain, ',') AS tactic_chain, "
        "CASE WHEN len(chain) <= 1 THEN 0.0 ELSE round(least(1.0, len(chain) / 12.0), 6) END AS chain_score FROM chains",
        "by_user AS (SELECT * REPLACE (\"user\" AS incident_id) FROM sec_events)", *_technique_ctes("by_user"), _CHAIN_CTE,
    ),
)
_add(
    "technique_layer",
    lambda s, d: attack.technique_layer(attack.map_techniques(sec_events(s, d))),
    oracle(
        "SELECT incident_id, technique_id, replace(lower(tactic), ' ', '-') AS tactic, CASE WHEN confidence >= 0.9 THEN '#ff0000' "
        "WHEN confidence >= 0.7 THEN '#ff8800' ELSE '#ffcc00' END AS color, description AS comment, "
        "CAST(CAST(round(confidence * 100) AS INT) AS VARCHAR) || '%' AS confidence FROM mappings",
        *TECHNIQUE_CTES,
    ),
)

# ------------------------------------------------------------------ risk

_PROC = _base1("process_name")
_PROC2 = _base("process_name")
_RULES_SQL = [
    ("credential_dumping", _any(_PROC, V.CREDENTIAL_DUMP_NAMES), "'Suspicious process: ' || process_name"),
    ("office_to_powershell", f"{_in(_base1('parent_process_name'), V.OFFICE_PARENTS)} AND {_any(_PROC, V.OFFICE_CHILD_WORDS)}",
     f"{_base1('parent_process_name')} || ' → ' || {_PROC}"),
    ("external_c2", "class_uid = 4001 AND dst_ip <> '' AND NOT (" + " OR ".join(
        f"starts_with(dst_ip, {_q(p)})" for p in V.INTERNAL_PREFIXES) + ")", "'Connection to external address: ' || dst_ip"),
    ("nonstandard_port_c2", f"class_uid IN (4001, 4002) AND {_in('dst_port', V.C2_PORTS)}",
     "'C2 on non-standard port ' || dst_port || ' to ' || dst_ip"),
    ("persistence", f"class_uid IN (201001, 201002) AND {_any('lower(registry_key)', V.PERSISTENCE_WORDS)}",
     "'Registry persistence key: ' || registry_key"),
    ("scheduled_task_creation", _in(_PROC, V.SCHEDULED_TASK_PROCESSES), "'Scheduled task created by ' || process_name"),
    ("privilege_escalation", f"({_in(_PROC, V.PRIVESC_PROCESSES)} OR {_any('lower(coalesce(' + _CMD + chr(44) + chr(39) * 2 + '))', V.PRIVESC_COMMANDS)})",
     "'Privilege escalation indicator: ' || process_name"),
    ("living_off_the_land", _in(_PROC, V.LOLBIN_PROCESSES), "'LOLBin abuse: ' || process_name"),
    ("discovery_activity", _in(_PROC, V.DISCOVERY_PROCESSES), "process_name"),
    ("lateral_movement", "class_uid = 3002", "host"),
    ("multiple_failed_logins", "class_uid = 3002 AND contains(lower(activity_name), 'fail')", "''"),
    ("dns_tunneling_indicator", "class_uid = 4003 AND (length(domain) > 50 OR length(domain) - length(replace(domain, '.', '')) > 4)",
     "'Suspicious long DNS query: ' || substr(domain, 1, 50) || '...'"),
    ("dc_target", _any("lower(host)", V.DC_HOST_WORDS), "'Domain controller targeted: ' || host"),
    ("cloud_exfiltration", _in(_PROC2, V.CLOUD_EXFIL_PROCESSES), f"'Cloud exfiltration tool observed: ' || {_PROC2}"),
    ("impact_activity", _in(_PROC2, V.IMPACT_PROCESSES), f"'Impact-phase process: ' || {_PROC2}"),
]


def _risk_ctes(source: str, seconds: int, dense: int) -> list[str]:
    hits = " UNION ALL ".join(
        f"SELECT incident_id, '{r}' AS rule_id, timestamp, seq, event_id, {t} AS detail FROM {source} WHERE {w}"
        for r, w, t in _RULES_SQL
    )
    labels = ", ".join(f"({_q(r)}, {n}, {_q(t)})" for r, n, t in V.RISK_RULES)
    return [
        f"hits AS ({hits})",
        f"rules AS (SELECT * FROM (VALUES {labels}) AS r(rule_id, score, description))",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY incident_id, rule_id ORDER BY timestamp, seq) AS rn FROM hits)",
        "fired AS (SELECT incident_id, rule_id, CASE rule_id WHEN 'discovery_activity' THEN 'Discovery tools: ' || "
        "substr(string_agg(DISTINCT detail, ', ' ORDER BY detail), 1, 60) WHEN 'lateral_movement' THEN "
        "'Authentication events across ' || count(DISTINCT detail) || ' hosts: ' || "
        "array_to_string(list_slice(list_sort(list(DISTINCT detail)), 1, 3), ', ') "
        "WHEN 'multiple_failed_logins' THEN count(*) || ' authentication failures observed' "
        "ELSE min(detail) FILTER (rn = 1) END AS detail, CASE WHEN rule_id IN ('discovery_activity', 'lateral_movement', "
        "'multiple_failed_logins') THEN string_agg(event_id, ',' ORDER BY rn) FILTER (rn <= 3) "
        "ELSE min(event_id) FILTER (rn = 1) END AS evidence FROM ranked GROUP BY incident_id, rule_id "
        "HAVING CASE rule_id WHEN 'lateral_movement' THEN count(DISTINCT detail) > 1 WHEN 'multiple_failed_logins' "
        "THEN count(*) >= 3 ELSE TRUE END)",
        f"density AS (SELECT incident_id, timestamp, seq, event_id, count(*) OVER (PARTITION BY incident_id ORDER BY timestamp "
        f"RANGE BETWEEN CURRENT ROW AND INTERVAL {seconds} SECONDS FOLLOWING) AS n, "
        f"count(*) OVER (PARTITION BY incident_id) AS total FROM {source})",
        f"starts AS (SELECT incident_id, arg_min(timestamp, (timestamp, seq)) AS st, arg_min(seq, (timestamp, seq)) AS ss, "
        f"arg_min(n, (timestamp, seq)) AS n, count(*) AS dense_starts FROM density WHERE n >= {dense} AND total > 10 GROUP BY 1)",
        "cluster_rows AS (SELECT d.incident_id, s.n, d.event_id, row_number() OVER (PARTITION BY d.incident_id ORDER BY d.timestamp, d.seq) AS rn "
        "FROM density d JOIN starts s ON d.incident_id = s.incident_id AND (d.timestamp, d.seq) >= (s.st, s.ss))",
        "all_fired AS (SELECT * FROM fired UNION ALL SELECT incident_id, 'temporal_clustering', max(n) || "
        f"' events in {seconds // 60}-minute window (compressed attack)', string_agg(event_id, ',' ORDER BY rn) "
        "FROM cluster_rows WHERE rn <= 3 GROUP BY 1)",
        "factors AS (SELECT f.incident_id, f.rule_id, r.description || ': ' || f.detail AS label, r.score, 0.85 AS confidence, "
        "f.evidence FROM all_fired f JOIN rules r ON f.rule_id = r.rule_id UNION ALL SELECT incident_id, 'tactic_chain_bonus', "
        "'Multi-tactic attack chain detected (' || count(DISTINCT tactic) || ' tactics)', (count(DISTINCT tactic) - 2) * 10, 0.9, '' "
        "FROM mappings GROUP BY 1 HAVING count(DISTINCT tactic) > 2)",
    ]


_DENSE_SECONDS, _DENSE_EVENTS = 18000, 10
RISK_CTES = [*TECHNIQUE_CTES, *_risk_ctes("sec_events", _DENSE_SECONDS, _DENSE_EVENTS)]


def factors_of(s, d, events=None):
    events = sec_events(s, d) if events is None else events
    return risk.risk_factors(
        events, mappings=attack.map_techniques(events), cluster_seconds=_DENSE_SECONDS, cluster_events=_DENSE_EVENTS
    )


def _flat_factors(df):
    return df.withColumn("evidence", F.array_join("evidence", ",")).withColumn("confidence", F.round("confidence", 2))


_FACTORS_OUT = "SELECT incident_id, rule_id, label, score, round(CAST(confidence AS DOUBLE), 2) AS confidence, evidence FROM factors"
_add("risk_factors", lambda s, d: _flat_factors(factors_of(s, d)), oracle(_FACTORS_OUT, *RISK_CTES))
_USER_CTES = [
    "by_user AS (SELECT * REPLACE (\"user\" AS incident_id) FROM sec_events)", *_technique_ctes("by_user"),
    *_risk_ctes("by_user", _DENSE_SECONDS, _DENSE_EVENTS),
]
_add("risk_factors_by_user", lambda s, d: _flat_factors(factors_of(s, d, _by_user(s, d))), oracle(_FACTORS_OUT, *_USER_CTES))
_add(
    "temporal_clusters",
    lambda s, d: risk.temporal_clusters(
        sec_events(s, d).withColumn("incident_id", F.lit("all")), _DENSE_SECONDS, 60
    ).select("incident_id", "start_seq", "n", "dense_starts"),
    oracle(
        "SELECT 'all' AS incident_id, arg_min(seq, (timestamp, seq)) AS start_seq, arg_min(n, (timestamp, seq)) AS n, "
        "count(*) AS dense_starts FROM (SELECT seq, timestamp, count(*) OVER (ORDER BY timestamp RANGE BETWEEN CURRENT ROW "
        f"AND INTERVAL {_DENSE_SECONDS} SECONDS FOLLOWING) AS n FROM sec_events) WHERE n >= 60 HAVING count(*) > 0"
    ),
)


def _assess_sql(source: str) -> str:
    return (
        "SELECT incident_id, total_score, CASE WHEN total_score >= 80 THEN 'CRITICAL' WHEN total_score >= 60 THEN 'HIGH' "
        "WHEN total_score >= 40 THEN 'MEDIUM' WHEN total_score >= 20 THEN 'LOW' ELSE 'INFORMATIONAL' END AS severity, "
        "coalesce(n_factors, 0) AS n_factors, CASE WHEN mult > 1 THEN 'Score multiplied by ' || mult || "
        "'x due to critical asset involvement. ' ELSE '' END || 'Final score ' || total_score || ' mapped to ' || severity || "
        "' severity band.' AS severity_justification FROM (SELECT e.incident_id, mult, n_factors, "
        "CAST(least(100, floor(least(coalesce(total, 0), 100) * CAST(mult AS DOUBLE))) AS INT) AS total_score FROM "
        f"(SELECT incident_id, max(CASE WHEN {_any('lower(host)', V.DC_HOST_WORDS)} THEN 1.5 WHEN "
        f"{_any('lower(host)', V.SERVER_HOST_WORDS)} THEN 1.2 ELSE 1.0 END) AS mult FROM {source} GROUP BY 1) e LEFT JOIN "
        "(SELECT incident_id, sum(score) AS total, count(*) AS n_factors FROM factors GROUP BY 1) f ON e.incident_id = f.incident_id)"
    )


_add("assess", lambda s, d: risk.assess(factors_of(s, d), sec_events(s, d)),
     oracle(_assess_sql("sec_events"), *RISK_CTES))
_add("assess_by_user", lambda s, d: risk.assess(factors_of(s, d, _by_user(s, d)), _by_user(s, d)),
     oracle(_assess_sql("by_user"), *_USER_CTES))


def rule_overrides(s, d):
    """Factor scores under overrides: one changed, one new, two invalid."""
    overrides = dim_table(s, ["id", "score", "description", "ord"], [
        ("persistence", 33, "Autostart", 1), ("custom_rule", 7, "Custom", 2), ("external_c2", 0, "ignored", 3),
        ("dc_target", 5, "", 4),
    ])
    hits = risk.event_rules(sec_events(s, d)).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))
    return risk.rule_table(s, overrides).join(hits, "rule_id", "left")


_add(
    "rule_overrides", rule_overrides,
    oracle(
        "SELECT rule_id, CASE rule_id WHEN 'persistence' THEN 33 ELSE score END AS score, CASE rule_id WHEN 'persistence' "
        "THEN 'Autostart' ELSE description END AS description, n FROM (SELECT * FROM rules UNION ALL SELECT 'custom_rule', 7, 'Custom') "
        "LEFT JOIN (SELECT rule_id, count(*) AS n FROM hits GROUP BY 1) USING (rule_id)",
        *RISK_CTES,
    ),
)
