"""Queries: routing, keys, links, groups, search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import fixed_values as V
from tracewell.operators import correlate, search
from tracewell.plans.views import SEC_EVENTS_CTE, TS_FORMAT, oracle, sec_events, sql_ts, ts_text
from tracewell.schema import project_table

DAY = 86400
QUERIES = {}
ORACLES = {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _band(a: str, b: str, seconds: int) -> str:
    return f"abs(epoch_us({a}) - epoch_us({b})) <= {seconds * 1000000}"


# ------------------------------------------------------------------ events and tables

_add(
    "sec_events_all",
    lambda s, d: ts_text(sec_events(s, d), "timestamp"),
    oracle("SELECT * EXCLUDE (timestamp), " + sql_ts("timestamp", "timestamp") + " FROM sec_events"),
)
_add(
    "route_table",
    lambda s, d: search.event_count(sec_events(s, d).drop("table_name")),
    oracle("SELECT table_name, count(*) AS n FROM sec_events GROUP BY 1"),
)
for _table in V.TABLES:
    _cols = V.TABLE_COLUMNS["base"] + V.TABLE_COLUMNS[_table]
    _add(
        f"project_table_{_table}",
        lambda s, d, t=_table: ts_text(project_table(sec_events(s, d), t), "timestamp"),
        oracle(
            "SELECT " + ", ".join(sql_ts(c, c) if c == "timestamp" else f'"{c}"' for c in _cols)
            + f" FROM sec_events WHERE table_name = '{_table}'"
        ),
    )
_add(
    "fetch_all_events",
    lambda s, d: ts_text(search.fetch_all_events(sec_events(s, d)), "timestamp"),
    oracle(
        "SELECT event_id, " + sql_ts("timestamp", "timestamp")
        + ', host, "user", class_uid, activity_name, source_type, table_name FROM sec_events'
    ),
)
_add(
    "event_count",
    lambda s, d: search.event_total(sec_events(s, d)),
    oracle("SELECT count(*) AS n FROM sec_events"),
)

# ------------------------------------------------------------------ keys and links

_KEYS_CTE = (
    "correlation_index AS MATERIALIZED (SELECT event_id, table_name, p.k AS correlation_key, p.v AS correlation_value, timestamp FROM ("
    "SELECT event_id, table_name, timestamp, unnest(["
    + ", ".join(f"{{'k': '{k}', 'v': CAST(\"{k}\" AS VARCHAR)}}" for k in V.CORRELATION_KEYS)
    + "]) AS p FROM sec_events) WHERE p.v IS NOT NULL)"
)
_add(
    "correlation_keys",
    lambda s, d: ts_text(correlate.correlation_keys(sec_events(s, d)), "timestamp"),
    oracle(
        "SELECT event_id, table_name, correlation_key, correlation_value, " + sql_ts("timestamp", "timestamp")
        + " FROM correlation_index",
        _KEYS_CTE,
    ),
)
_PROCESSES = "procs AS MATERIALIZED (SELECT *, epoch_us(timestamp) AS us FROM sec_events WHERE table_name = 'processes')"
_add(
    "process_lineage",
    lambda s, d: correlate.process_lineage(sec_events(s, d), DAY, TS_FORMAT),
    oracle(
        # a child names its parent by guid if it has one, else by pid
        "SELECT child.event_id AS child_event_id, born.event_id AS parent_event_id, child.host, child.process_name AS child_process, "
        "born.process_name AS parent_process, child.process_guid AS child_guid, born.process_guid AS parent_guid, "
        + sql_ts("child.timestamp", "child_timestamp") + ", " + sql_ts("born.timestamp", "parent_timestamp")
        + " FROM (SELECT child_id, parent_id FROM by_guid UNION SELECT child_id, parent_id FROM by_pid) link "
        "JOIN procs child ON link.child_id = child.event_id JOIN procs born ON link.parent_id = born.event_id "
        f"WHERE child_id <> parent_id AND child.us - born.us BETWEEN -{DAY * 1000000} AND {DAY * 1000000}",
        _PROCESSES,
        "by_guid AS (SELECT k.event_id AS child_id, q.event_id AS parent_id FROM procs k JOIN procs q USING (host) "
        "WHERE k.parent_process_guid = q.process_guid)",
        "by_pid AS (SELECT k.event_id AS child_id, q.event_id AS parent_id FROM (SELECT * FROM procs WHERE parent_process_guid IS NULL) k "
        "JOIN procs q ON (k.host, k.parent_process_pid) = (q.host, q.process_pid))",
    ),
)
_add(
    "network_to_process",
    lambda s, d: correlate.network_to_process(sec_events(s, d), DAY, TS_FORMAT),
    oracle(
        # same host, and the same pid or the same name; what the process says of the connection must not contradict it
        "SELECT flow.event_id AS network_event_id, owner.event_id AS process_event_id, flow.host, flow.src_ip, flow.src_port, flow.dst_ip, "
        "flow.dst_port, " + sql_ts("flow.timestamp", "network_timestamp") + ", " + sql_ts("owner.timestamp", "process_timestamp")
        + ", owner.process_name, owner.process_pid FROM flows flow JOIN candidates USING (flow_id) JOIN procs owner ON owner.event_id = owner_id "
        "WHERE (owner.src_ip IS NULL OR owner.src_ip IS NOT DISTINCT FROM flow.src_ip) AND (owner.dst_ip IS NULL OR owner.dst_ip IS NOT DISTINCT FROM flow.dst_ip) "
        f"AND (owner.dst_port IS NULL OR owner.dst_port IS NOT DISTINCT FROM flow.dst_port) AND flow.us - owner.us BETWEEN -{DAY * 1000000} AND {DAY * 1000000}",
        _PROCESSES,
        "flows AS MATERIALIZED (SELECT *, event_id AS flow_id, epoch_us(timestamp) AS us FROM sec_events WHERE table_name = 'network')",
        "candidates AS (SELECT f.flow_id, q.event_id AS owner_id FROM flows f JOIN procs q ON (f.host, f.process_pid) = (q.host, q.process_pid) "
        "UNION SELECT f.flow_id, q.event_id FROM flows f JOIN procs q ON (f.host, f.process_name) = (q.host, q.process_name))",
    ),
)
_add(
    "identity_correlation",
    lambda s, d: correlate.identity_correlation(sec_events(s, d), DAY, TS_FORMAT),
    oracle(
        # the address of a login is an end of the connection
        "SELECT login.event_id AS auth_event_id, e.flow_id AS network_event_id, login.host, login.\"user\", login.src_ip, e.network_src_ip, e.dst_ip, "
        + sql_ts("login.timestamp", "auth_timestamp") + ", " + sql_ts("e.at", "network_timestamp") + ", login.session_id "
        "FROM sec_events login JOIN ends e ON login.host = e.host AND login.src_ip = e.address WHERE login.table_name = 'auth' "
        f"AND epoch_us(login.timestamp) - epoch_us(e.at) BETWEEN -{DAY * 1000000} AND {DAY * 1000000}",
        "ends AS (SELECT event_id AS flow_id, host, timestamp AS at, src_ip AS network_src_ip, dst_ip, src_ip AS address FROM sec_events WHERE table_name = 'network' "
        "UNION SELECT event_id, host, timestamp, src_ip, dst_ip, dst_ip FROM sec_events WHERE table_name = 'network')",
    ),
)
# Pairs in the oracle, without an inequality join: each event is listed in its bucket and the next one, and lists are
# paired with themselves; a pair counts in the later bucket of its two events.
_PAIRS_CTES = [
    "bucketed AS MATERIALIZED (SELECT *, epoch_us(timestamp) AS us, epoch_us(timestamp) // 300000000 AS bucket FROM correlation_index)",
    "listed AS MATERIALIZED (SELECT correlation_key, correlation_value, near, "
    "list({'id': event_id, 't': table_name, 'us': us, 'bucket': bucket}) AS l FROM (SELECT *, unnest([bucket, bucket + 1]) AS near FROM bucketed) "
    "GROUP BY 1, 2, 3 HAVING count(*) > 1)",
    "pairs AS (SELECT correlation_key, correlation_value, a, b FROM (SELECT correlation_key, correlation_value, near, a, unnest(l) AS b FROM ("
    "SELECT correlation_key, correlation_value, near, l, unnest(l) AS a FROM listed)) "
    "WHERE a.id < b.id AND greatest(a.bucket, b.bucket) = near AND abs(a.us - b.us) <= 300000000)",
]
_add(
    "entity_correlation",
    lambda s, d: correlate.entity_correlation(sec_events(s, d), 300).withColumn(
        "delta_seconds", F.round("delta_seconds", 6)
    ),
    oracle(
        "SELECT a.id AS event_a_id, b.id AS event_b_id, a.t AS table_a, b.t AS table_b, correlation_key, correlation_value, "
        "round(abs(a.us - b.us) / 1000000.0, 6) AS delta_seconds FROM pairs",
        _KEYS_CTE, *_PAIRS_CTES,
    ),
)
_add(
    "entity_pair_counts",
    lambda s, d: correlate.entity_pair_counts(sec_events(s, d), 300),
    oracle(
        "SELECT i.correlation_key, i.correlation_value, i.n AS n_events, coalesce(p.n, 0) AS n_pairs FROM ("
        "SELECT correlation_key, correlation_value, count(*) AS n FROM correlation_index GROUP BY 1, 2) i LEFT JOIN ("
        "SELECT correlation_key, correlation_value, count(*) AS n FROM pairs GROUP BY 1, 2) p "
        "ON i.correlation_key = p.correlation_key AND i.correlation_value = p.correlation_value",
        _KEYS_CTE, *_PAIRS_CTES,
    ),
)
_add(
    "entity_links",
    lambda s, d: correlate.entity_links(sec_events(s, d), DAY).withColumn("delta_seconds", F.round("delta_seconds", 6)),
    oracle(
        "SELECT event_id, next_event_id, table_name, next_table, correlation_key, correlation_value, round((next_us - us) / 1000000.0, 6) AS delta_seconds "
        "FROM (SELECT *, epoch_us(timestamp) AS us, lead(event_id) OVER w AS next_event_id, lead(table_name) OVER w AS next_table, "
        "lead(epoch_us(timestamp)) OVER w AS next_us FROM correlation_index WINDOW w AS (PARTITION BY correlation_key, correlation_value "
        f"ORDER BY timestamp, event_id)) WHERE next_us - us <= {DAY * 1000000}",
        _KEYS_CTE,
    ),
)


def _pairs_of_values(s, d):
    """The pairs of two hosts and a user, as a case asks for them."""
    values = s.createDataFrame([("host", "DC01"), ("host", "H3"), ("user", "u8")], "correlation_key string, correlation_value string")
    return correlate.entity_correlation(sec_events(s, d), DAY, values=values).select("event_a_id", "event_b_id", "correlation_key", "correlation_value")


_add(
    "entity_correlation_of_values", _pairs_of_values,
    oracle(
        "SELECT a.event_id AS event_a_id, b.event_id AS event_b_id, a.correlation_key, a.correlation_value FROM chosen a JOIN chosen b "
        "ON a.correlation_key = b.correlation_key AND a.correlation_value = b.correlation_value AND a.event_id < b.event_id "
        f"AND abs(a.us - b.us) <= {DAY * 1000000}",
        _KEYS_CTE,
        "chosen AS MATERIALIZED (SELECT *, epoch_us(timestamp) AS us FROM correlation_index WHERE (correlation_key = 'host' AND "
        "correlation_value IN ('DC01', 'H3')) OR (correlation_key = 'user' AND correlation_value = 'u8'))",
    ),
)

# Components in the oracle: consecutive events of one key value within the window are
# linked (the same components as all pairs), then labels travel along the links.
_GROUP_KEYS = ["user", "process_guid", "session_id"]
_GROUP_WINDOW = 7200


def _component_ctes(links: str, nodes: str) -> list[str]:
    return [
        f"links AS ({links})",
        f"nodes AS ({nodes})",
        "both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links)",
        "reach AS (SELECT id, id AS label FROM nodes UNION SELECT b.v AS id, r.label FROM reach r "
        "JOIN both_ways b ON r.id = b.u)",
        "components AS (SELECT id, min(label) AS component FROM reach GROUP BY id)",
    ]


_add(
    "correlate_groups",
    lambda s, d: correlate.correlate_groups(sec_events(s, d), _GROUP_WINDOW, _GROUP_KEYS),
    oracle(
        "SELECT id AS event_id, component AS group_id FROM components",
        _KEYS_CTE,
        *_component_ctes(
            "SELECT u, v FROM (SELECT event_id AS v, lag(event_id) OVER w AS u, timestamp AS vt, "
            "lag(timestamp) OVER w AS ut FROM correlation_index WHERE correlation_key IN ('"
            + "', '".join(_GROUP_KEYS) + "') WINDOW w AS (PARTITION BY correlation_key, correlation_value "
            "ORDER BY timestamp, event_id)) WHERE u IS NOT NULL AND epoch_us(vt) - epoch_us(ut) <= "
            f"{_GROUP_WINDOW * 1000000}",
            "SELECT event_id AS id FROM sec_events",
        ),
        recursive=True,
    ),
)
_add(
    "lineage_by_name",
    lambda s, d: ts_text(correlate.lineage_by_name(sec_events(s, d)), "first_seen"),
    oracle(
        "SELECT lower(parent_process_name) AS parent, lower(process_name) AS child, count(*) AS n, "
        + sql_ts("min(timestamp)", "first_seen") + ", min(seq) AS first_seq FROM sec_events "
        "WHERE parent_process_name <> '' AND process_name <> '' "
        "AND lower(parent_process_name) <> lower(process_name) GROUP BY 1, 2"
    ),
)
_add(
    "identity_chain",
    lambda s, d: ts_text(correlate.identity_chain(sec_events(s, d)), "first_seen"),
    oracle(
        "SELECT incident_id, \"user\", " + sql_ts("timestamp", "first_seen") + ", seq AS first_seq FROM ("
        "SELECT *, row_number() OVER (PARTITION BY incident_id, lower(\"user\") ORDER BY timestamp, seq) AS rn "
        "FROM sec_events WHERE \"user\" <> '') WHERE rn = 1"
    ),
)

# ------------------------------------------------------------------ search and pivot

_HIT = ["event_id", "timestamp", "class_uid", "activity_name", "host", "user", "process_name", "process_pid",
        "parent_process_name", "file_hash", "src_ip", "dst_ip", "domain", "registry_key", "raw_data"]
_HIT_SQL = ", ".join(
    "strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS timestamp" if c == "timestamp" else f'"{c}"' for c in _HIT
)


def _top(where: str) -> str:
    return oracle(
        f"SELECT {_HIT_SQL} FROM (SELECT * FROM sec_events WHERE {where} ORDER BY timestamp DESC, event_id LIMIT 1000)"
    )


_add("search_text", lambda s, d: search.search(sec_events(s, d), "203.0.113.1", limit=V.SEARCH_LIMIT),
     _top(" OR ".join(f"\"{f}\" LIKE '%203.0.113.1%'" for f in V.SEARCH_FIELDS)))
_add("search_wildcard", lambda s, d: search.search(sec_events(s, d), "C:\\Win%shell", ["process_name"], V.SEARCH_LIMIT),
     _top("process_name LIKE '%C:\\Win%shell%'"))
_add("search_all", lambda s, d: search.search(sec_events(s, d), "10.0.0.5"),
     oracle(f"SELECT {_HIT_SQL} FROM sec_events WHERE " + " OR ".join(f"\"{f}\" LIKE '%10.0.0.5%'" for f in V.SEARCH_FIELDS)))
for _by, _value, _where in [
    ("host", "DC01", "host = 'DC01'"),
    ("user", "u8", "\"user\" = 'u8'"),
    ("domain", "d4.example.net", "domain = 'd4.example.net'"),
    ("ip", "10.0.0.5", "src_ip = '10.0.0.5' OR dst_ip = '10.0.0.5'"),
    ("hash", "4b227777d4dd1fc61c6f884f48641d02b4d121d3fd328cb08b5531fcacdabf8a", None),
]:
    _where = _where or f"file_hash = '{_value}'"
    _add(
        f"pivot_by_{_by}",
        lambda s, d, b=_by, v=_value: search.pivot(sec_events(s, d), b, v),
        oracle(f"SELECT {_HIT_SQL} FROM sec_events WHERE {_where}"),
    )
_add("pivot_by_technique_text", lambda s, d: search.pivot(sec_events(s, d), "technique", "mimikatz"),
     oracle(f"SELECT {_HIT_SQL} FROM sec_events WHERE raw_data LIKE '%mimikatz%'"))
