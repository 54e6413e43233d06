"""Queries: attack graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import graph
from tracewell.plans.views import oracle, sec_events, sql_ts, ts_text

QUERIES = {}
ORACLES = {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def _graph_ctes(group: str = "") -> list[str]:
    g = f"{group}, " if group else ""
    node = lambda n, where, kind, label, pid="NULL", digest="NULL": (
        f"SELECT {g}timestamp, seq, {n} AS ord, {kind} || ':' || lower({label}) AS id, {kind} AS type, {label} AS label, "
        f"CAST({pid} AS INT) AS pid, {digest} AS hash FROM sec_events WHERE {where}"
    )
    edge = lambda n, where, a, b, kind: (
        f"SELECT {g}timestamp, seq, {n} AS ord, {a} AS source, {b} AS target, {kind} AS type FROM sec_events WHERE {where}"
    )
    proc, actor = "'process:' || lower(process_name)", "'process:' || lower(coalesce(process_name, 'unknown-process'))"
    device = "'device:' || lower(host)"
    far_kind = "CASE WHEN domain IS NOT NULL THEN 'domain' ELSE 'ip' END"
    near_kind = "CASE WHEN process_name IS NOT NULL THEN 'process' ELSE 'device' END"
    far, near = "coalesce(domain, dst_ip)", "coalesce(process_name, host)"
    nodes = [
        node(0, "TRUE", "'device'", "host"), node(1, "TRUE", "'user'", "\"user\""),
        node(2, "process_name IS NOT NULL", "'process'", "process_name", "process_pid"),
        node(3, "process_name IS NOT NULL AND parent_process_name IS NOT NULL", "'process'", "parent_process_name"),
        node(4, "file_path IS NOT NULL", "'file'", "file_path", "NULL", "file_hash"),
        node(5, "file_path IS NOT NULL", "'process'", "coalesce(process_name, 'unknown-process')"),
        node(6, "registry_key IS NOT NULL", "'registry'", "registry_key"),
        node(7, "registry_key IS NOT NULL", "'process'", "coalesce(process_name, 'unknown-process')"),
        node(8, f"{far} IS NOT NULL", far_kind, far), node(9, f"{far} IS NOT NULL", near_kind, near),
    ]
    edges = [
        edge(0, "TRUE", "'user:' || lower(\"user\")", device, "'authenticated'"),
        edge(1, "process_name IS NOT NULL", proc, device, "'executed'"),
        edge(2, "process_name IS NOT NULL AND parent_process_name IS NOT NULL",
             "'process:' || lower(parent_process_name)", proc, "'spawned'"),
        edge(3, "file_path IS NOT NULL", actor, "'file:' || lower(file_path)",
             "CASE WHEN class_uid = 1001 THEN 'created' ELSE 'modified' END"),
        edge(4, "registry_key IS NOT NULL", actor, "'registry:' || lower(registry_key)", "'modified'"),
        edge(5, f"{far} IS NOT NULL", f"{near_kind} || ':' || lower({near})", f"{far_kind} || ':' || lower({far})",
             "'connected'"),
    ]
    return [
        "raw_nodes AS (" + " UNION ALL ".join(nodes) + ")",
        f"nodes AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {g}id ORDER BY timestamp, seq, ord) AS rn "
        "FROM raw_nodes) WHERE rn = 1)",
        "raw_edges AS (" + " UNION ALL ".join(edges) + ")",
        f"edges AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {g}source, target ORDER BY timestamp DESC, "
        "seq DESC, ord DESC) AS rn FROM raw_edges) WHERE rn = 1)",
    ]


_CTES = _graph_ctes()
_GROUPED = _graph_ctes("incident_id")


def _graph(s, d, group=None):
    return graph.build_graph(sec_events(s, d), group)


_add("graph_nodes", lambda s, d: _graph(s, d)[0], oracle("SELECT id, type, label, pid, hash FROM nodes", *_CTES))
_add(
    "graph_edges", lambda s, d: ts_text(_graph(s, d)[1], "timestamp"),
    oracle("SELECT source, target, type, " + sql_ts("timestamp", "timestamp") + " FROM edges", *_CTES),
)
_add(
    "graph_counts", lambda s, d: graph.graph_counts(*_graph(s, d, ["incident_id"]), ["incident_id"]),
    oracle(
        "SELECT n.incident_id, node_count, edge_count FROM (SELECT incident_id, count(*) AS node_count FROM nodes GROUP BY 1) n "
        "JOIN (SELECT incident_id, count(*) AS edge_count FROM edges GROUP BY 1) e ON n.incident_id = e.incident_id",
        *_GROUPED,
    ),
)
# Components need an edge set with more than one component: here only who reached which
# address, by spawned processes left out.
_REACH = "SELECT source AS u, target AS v FROM edges WHERE type = 'created'"
_REACH_CTES = [
    *_CTES,
    f"both_ways AS (SELECT u, v FROM ({_REACH}) UNION SELECT v, u FROM ({_REACH}))",
    "reach AS (SELECT id, id AS label FROM nodes UNION SELECT b.v AS id, r.label FROM reach r JOIN both_ways b ON r.id = b.u)",
    "components AS (SELECT id, min(label) AS component FROM reach GROUP BY id)",
]


def _created(s, d):
    nodes, edges = _graph(s, d)
    return nodes, edges.filter(F.col("type") == "created")


_add("connected_components", lambda s, d: graph.components(*_created(s, d)),
     oracle("SELECT id, component FROM components", *_REACH_CTES, recursive=True))
_add(
    "blast_radius", lambda s, d: graph.blast_radius(*_created(s, d)),
    oracle("SELECT id, count(*) OVER (PARTITION BY component) - 1 AS blast_radius FROM components", *_REACH_CTES,
           recursive=True),
)
_add(
    "blast_radius_per_incident",
    lambda s, d: graph.blast_radius(*_graph(s, d, ["incident_id"]), ["incident_id"]).filter(
        F.col("id") == F.concat(F.lit("device:"), F.lower("incident_id"))),
    # every node of an incident hangs on its device, so the radius is the node count less one
    oracle("SELECT incident_id, 'device:' || lower(incident_id) AS id, count(*) - 1 AS blast_radius FROM nodes GROUP BY 1",
           *_GROUPED),
)
_SOURCE, _TARGET = "user:u8", "ip:203.0.113.7"
_START, _END = "process:c:\\windows\\explorer.exe", "ip:203.0.113.7"
_add(
    "shortest_path",
    lambda s, d: graph.shortest_path(_graph(s, d)[1].filter(F.col("type") != "executed"), _START, _END).select(
        F.array_join("path", " > ").alias("path"), "length"),
    oracle(
        "SELECT array_to_string(path, ' > ') AS path, length FROM (SELECT path, depth AS length, row_number() OVER "
        f"(ORDER BY depth, path) AS rn FROM walk WHERE node = '{_END}') WHERE rn = 1",
        *_CTES,
        "arcs AS (SELECT source AS a, target AS b FROM edges WHERE type <> 'executed' AND source <> target)",
        f"walk AS (SELECT '{_START}' AS node, ['{_START}'] AS path, 0 AS depth UNION ALL SELECT a.b, list_append(w.path, a.b), "
        "w.depth + 1 FROM walk w JOIN arcs a ON w.node = a.a WHERE w.depth < 3 AND NOT list_contains(w.path, a.b))",
        recursive=True,
    ),
)

# The same over edges of every type.  Shortest: distances from the start by levels that add new nodes only, then the walks
# that come one step nearer each time.  Components: the smallest name that reaches a node, improved until nothing changes.
_ALL_CTES = [
    *_CTES,
    "arcs AS (SELECT source AS a, target AS b FROM edges WHERE source <> target)",
    f"far (node, depth) USING KEY (node) AS (SELECT '{_END}', 0 UNION SELECT a.a, min(f.depth) + 1 FROM far f JOIN arcs a ON f.node = a.b "
    "LEFT JOIN recurring.far o ON o.node = a.a WHERE o.node IS NULL GROUP BY 1)",
]
_add(
    "shortest_path_all_edges",
    lambda s, d: graph.shortest_path(_graph(s, d)[1], _START, _END).select(F.array_join("path", " > ").alias("path"), "length"),
    oracle(
        "SELECT path, length FROM (SELECT array_to_string(path, ' > ') AS path, len(path) - 1 AS length, row_number() OVER (ORDER BY path) AS rn "
        f"FROM walk WHERE node = '{_END}') WHERE rn = 1",
        *_ALL_CTES,
        f"walk AS (SELECT '{_START}' AS node, ['{_START}'] AS path UNION ALL SELECT a.b, list_append(w.path, a.b) FROM walk w "
        "JOIN arcs a ON w.node = a.a JOIN far f ON f.node = w.node JOIN far g ON g.node = a.b WHERE g.depth = f.depth - 1)",
        recursive=True,
    ),
)
_WHOLE_CTES = [
    *_CTES,
    "ways AS (SELECT source AS u, target AS v FROM edges UNION SELECT target, source FROM edges)",
    "named (id, component) USING KEY (id) AS (SELECT id, id FROM nodes UNION SELECT w.v, min(n.component) FROM named n JOIN ways w ON w.u = n.id "
    "JOIN recurring.named o ON o.id = w.v WHERE n.component < o.component GROUP BY 1)",
]
_add("connected_components_all_edges", lambda s, d: graph.components(*_graph(s, d)),
     oracle("SELECT id, component FROM named", *_WHOLE_CTES, recursive=True))
_add("blast_radius_all_edges", lambda s, d: graph.blast_radius(*_graph(s, d)),
     oracle("SELECT id, count(*) OVER (PARTITION BY component) - 1 AS blast_radius FROM named", *_WHOLE_CTES, recursive=True))


def lateral_movement(s, d):
    """Edges between the hosts that share a user, as connected devices."""
    events = sec_events(s, d)
    hosts = events.select(F.concat(F.lit("device:"), F.lower("host")).alias("id"), F.lit("device").alias("type")).distinct()
    edges = events.select(
        F.concat(F.lit("device:"), F.lower("host")).alias("source"),
        F.when(F.col("seq") % 2 == 0, F.concat(F.lit("device:h"), (F.col("seq") % 12).cast("string")))
        .otherwise(F.concat(F.lit("ip:"), F.coalesce("dst_ip", F.lit("none")))).alias("target"),
        F.when(F.col("seq") % 3 == 0, "spawned").otherwise("connected").alias("type"),
    ).distinct()
    return graph.detect_lateral_movement(hosts, edges)


_add(
    "detect_lateral_movement", lateral_movement,
    oracle(
        "SELECT DISTINCT source, target, type FROM (SELECT 'device:' || lower(host) AS source, CASE WHEN seq % 2 = 0 THEN "
        "'device:h' || (seq % 12) ELSE 'ip:' || coalesce(dst_ip, 'none') END AS target, CASE WHEN seq % 3 = 0 THEN 'spawned' "
        "ELSE 'connected' END AS type FROM sec_events) WHERE type = 'connected' AND source <> target AND target IN "
        "(SELECT 'device:' || lower(host) FROM sec_events)"
    ),
)
