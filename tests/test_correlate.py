import random
from collections import defaultdict
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewell.operators import correlate, graph, risk
from tracewell.operators.components import connected_components
from tracewell.schema import complete_events

T0 = datetime(2026, 7, 22, 9, 0, tzinfo=UTC)


def _events(spark, rows):
    names = sorted({k for r in rows for k in r})
    kinds = {"class_uid": "int", "process_pid": "int", "parent_process_pid": "int", "dst_port": "int", "seq": "bigint", "timestamp": "timestamp"}
    schema = ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names)
    return complete_events(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema))


def _find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def _groups(df, key="group_id", item="event_id"):
    out = defaultdict(set)
    for r in df.collect():
        out[r[key]].add(r[item])
    assert all(k == min(v) for k, v in out.items())
    return {frozenset(v) for v in out.values()}


def test_lineage_by_guid_and_by_pid(spark):
    events = _events(spark, [
        dict(event_id="p", class_uid=1007, host="h", process_name="a", process_guid="g", process_pid=5, timestamp=T0),
        dict(event_id="c", class_uid=1007, host="h", process_name="b", parent_process_guid="g", parent_process_pid=5, timestamp=T0 + timedelta(minutes=1)),
        dict(event_id="d", class_uid=1007, host="h", process_name="b", parent_process_pid=5, timestamp=T0 - timedelta(minutes=1)),
        dict(event_id="e", class_uid=1007, host="other", process_name="b", parent_process_pid=5, timestamp=T0),
        dict(event_id="f", class_uid=1007, host="h", process_name="b", parent_process_pid=5, timestamp=T0 + timedelta(hours=2)),
    ])
    assert {(r.child_event_id, r.parent_event_id) for r in correlate.process_lineage(events, 3600).collect()} == {("c", "p"), ("d", "p")}


def test_network_wildcards_and_identity(spark):
    events = _events(spark, [
        dict(event_id="p", class_uid=1007, host="h", process_name="x", process_pid=5, dst_ip="9.9.9.9", dst_port=443, timestamp=T0),
        dict(event_id="n", class_uid=4001, host="h", process_name="x", process_pid=5, src_ip="1.1.1.1", dst_ip="9.9.9.9", dst_port=443, timestamp=T0),
        dict(event_id="m", class_uid=4001, host="h", process_pid=5, src_ip="1.1.1.1", dst_ip="8.8.8.8", dst_port=443, timestamp=T0),
        dict(event_id="a", class_uid=3002, host="h", user="Alice", src_ip="1.1.1.1", timestamp=T0 - timedelta(seconds=300)),
    ])
    assert [r.network_event_id for r in correlate.network_to_process(events, 60).collect()] == ["n"]
    assert {r.network_event_id for r in correlate.identity_correlation(events, 300).collect()} == {"n", "m"}
    assert correlate.identity_correlation(events, 299).count() == 0


def _random_rows(seed, n=120, span=4000):
    rng = random.Random(seed)
    return [
        dict(event_id=f"e{i:03d}", class_uid=1007, seq=i, timestamp=T0 + timedelta(seconds=rng.randint(0, span)),
             host=rng.choice(["h1", "h2", "h3", None]), user=rng.choice([None, None, f"u{rng.randint(0, 8)}"]),
             process_guid=rng.choice([None, f"g{rng.randint(0, 12)}"]))
        for i in range(n)
    ]


_KEYS = ["host", "user", "process_guid"]


def _pairwise(rows, window):
    parent = {r["event_id"]: r["event_id"] for r in rows}
    pairs = set()
    for a in rows:
        for b in rows:
            if a["event_id"] < b["event_id"] and abs((a["timestamp"] - b["timestamp"]).total_seconds()) <= window:
                for k in _KEYS:
                    if a[k] is not None and a[k] == b[k]:
                        pairs.add((a["event_id"], b["event_id"], k))
                        ra, rb = _find(parent, a["event_id"]), _find(parent, b["event_id"])
                        parent[max(ra, rb)] = min(ra, rb)
    groups = defaultdict(set)
    for x in parent:
        groups[_find(parent, x)].add(x)
    return pairs, {frozenset(g) for g in groups.values()}


def _anchored(rows, window):
    """The definition, step by step: join every group that shares a value and began at most a window ago."""
    groups = []
    for e in sorted(rows, key=lambda r: (r["timestamp"], r["seq"])):
        hits = [g for g in groups if (e["timestamp"] - g[0]["timestamp"]).total_seconds() <= window
                and any(e[k] is not None and e[k] == o[k] for o in g for k in _KEYS)]
        merged = sorted([e, *[o for g in hits for o in g]], key=lambda r: (r["timestamp"], r["seq"]))
        groups = [g for g in groups if g not in hits] + [merged]
    return {frozenset(o["event_id"] for o in g) for g in groups}


@pytest.mark.parametrize("seed,window", [(1, 30), (2, 120), (3, 600), (4, 0)])
def test_pairs_and_groups(spark, seed, window):
    rows = _random_rows(seed)
    events = _events(spark, rows)
    pairs, groups = _pairwise(rows, window)
    got = correlate.entity_correlation(events, window, _KEYS).collect()
    assert {(r.event_a_id, r.event_b_id, r.correlation_key) for r in got} == pairs and len(got) == len(pairs)
    assert _groups(correlate.correlate_groups(events, window, _KEYS)) == groups
    n = defaultdict(int)
    for a, _, k in pairs:
        n[k, next(r[k] for r in rows if r["event_id"] == a)] += 1
    counted = {(r.correlation_key, r.correlation_value): r.n_pairs for r in correlate.entity_pair_counts(events, window, _KEYS).collect()}
    assert {k: v for k, v in counted.items() if v} == dict(n)
    links = correlate.entity_links(events, window, _KEYS).collect()
    assert len({(r.event_id, r.correlation_key) for r in links}) == len(links) and {
        (min(r.event_id, r.next_event_id), max(r.event_id, r.next_event_id), r.correlation_key) for r in links} <= pairs
    parent = {r["event_id"]: r["event_id"] for r in rows}
    for r in links:
        ra, rb = _find(parent, r.event_id), _find(parent, r.next_event_id)
        parent[max(ra, rb)] = min(ra, rb)
    linked = defaultdict(set)
    for x in parent:
        linked[_find(parent, x)].add(x)
    assert {frozenset(g) for g in linked.values()} == groups


@pytest.mark.parametrize("seed,window", [(5, 30), (6, 300), (7, 900), (8, 2000)])
def test_anchored_groups(spark, seed, window):
    rows = _random_rows(seed, n=70)
    assert _groups(correlate.correlate_anchored(_events(spark, rows), window, _KEYS)) == _anchored(rows, window)


def test_anchored_groups_of_a_long_component_take_one_pass(spark, monkeypatch):
    # one value all the way: a component of some 40 groups, each of which ends a window behind its first event
    rng = random.Random(9)
    rows = [dict(event_id=f"e{i:03d}", class_uid=1007, seq=i, timestamp=T0 + timedelta(seconds=13 * i + rng.randint(0, 12)), host="h",
                 user=f"u{rng.randint(0, 3)}" if i % 5 == 0 else None) for i in range(120)]
    calls, durable = [], correlate.durable
    monkeypatch.setattr(correlate, "durable", lambda df: calls.append(1) or durable(df))
    found = correlate.correlate_anchored(_events(spark, rows + rows[50:53]), 30, _KEYS)
    assert len(calls) <= 2
    assert found.count() == len(rows) + 3 and _groups(found) == _anchored(rows, 30)
    assert len(_anchored(rows, 30)) > 30
    # events without values or without a time
    rows = [dict(event_id="a", class_uid=1007, timestamp=T0), dict(event_id="b", class_uid=1007, host="h", timestamp=None),
            dict(event_id="c", class_uid=1007, host="h", timestamp=T0), dict(event_id="d", class_uid=1007, host="h", timestamp=T0 + timedelta(seconds=31))]
    assert _groups(correlate.correlate_anchored(_events(spark, [dict(r, user=None, process_guid=None) for r in rows]), 30, _KEYS)) == {
        frozenset("a"), frozenset("c"), frozenset("d")}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i:03d}" for i in range(90)]
    chain = [(nodes[i], nodes[i + 1]) for i in range(30)]
    edges = chain + [(rng.choice(nodes[31:]), rng.choice(nodes[31:])) for _ in range(35)]
    parent = {n: n for n in nodes}
    for a, b in edges:
        ra, rb = _find(parent, a), _find(parent, b)
        parent[max(ra, rb)] = min(ra, rb)
    got = connected_components(spark.createDataFrame(edges, "u string, v string"), spark.createDataFrame([(n,) for n in nodes], "id string"))
    assert {r.id: r.component for r in got.collect()} == {n: _find(parent, n) for n in nodes}


def test_paths(spark):
    edges = spark.createDataFrame(
        [("a", "b", "x"), ("a", "c", "x"), ("b", "d", "x"), ("c", "d", "x"), ("d", "e", "x"), ("f", "a", "x")],
        "source string, target string, type string")
    assert graph.shortest_path(edges, "a", "e").first().path == ["a", "b", "d", "e"]
    assert graph.shortest_path(edges, "a", "a").first().length == 0
    assert graph.shortest_path(edges, "e", "a").count() == 0 and graph.shortest_path(edges, "zz", "a").count() == 0


def test_plans_have_no_nested_loops(spark, sf_dir):
    from tracewell.plans.views import sec_events

    events = sec_events(spark, sf_dir)
    for df in [
        correlate.process_lineage(events), correlate.network_to_process(events), correlate.identity_correlation(events),
        correlate.entity_correlation(events), correlate._group_edges(events, 60, None),
    ]:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    count = lambda df: df.agg(F.count(F.lit(1))).first()[0]
    assert count(events) > 0


def test_shortest_path_against_all_paths(spark):
    rng = random.Random(5)
    for n, m in ((8, 14), (12, 16), (10, 40)):
        arcs = {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)}
        edges = spark.createDataFrame(sorted(arcs), "source string, target string")
        front, expected = [["n0"]], None
        while front and expected is None:
            expected = min((p for p in front if p[-1] == "n1"), default=None)
            front = [[*p, b] for p in front for a, b in sorted(arcs) if a == p[-1] and b not in p]
        found = graph.shortest_path(edges, "n0", "n1").collect()
        assert [r.path for r in found] == ([expected] if expected else [])


def test_event_density_counts_ties_and_both_ends_of_the_window(spark):
    rng = random.Random(6)
    base = 1_700_000_000_000_000
    times = [base + rng.choice([0, 999_999, 1_000_000, 299_999_999, 300_000_000, 300_000_001]) + 1_000_000 * rng.randrange(0, 700, 7)
             for _ in range(120)]
    rows = [("a" if i % 3 else "b", f"e{i}", i, t) for i, t in enumerate(times)]
    events = spark.createDataFrame(rows, "incident_id string, event_id string, seq int, us long").withColumn(
        "timestamp", F.timestamp_micros("us"))
    for seconds, threshold in ((300, 20), (1.5, 3), (0.25, 2)):
        found = {r.incident_id: tuple(r)[1:] for r in risk.temporal_clusters(events, seconds, threshold).collect()}
        expected = {}
        for incident in "ab":
            own = sorted((t, i) for inc, _, i, t in rows if inc == incident)
            dense = [(t, i, n) for t, i in own if (n := sum(t <= u <= t + seconds * 1e6 for u, _ in own)) >= threshold]
            if dense:
                expected[incident] = (*dense[0], len(dense))
        assert found == expected and found


def test_hot_groups_are_paired_in_blocks_over_tasks_that_follow_the_pairs(spark, monkeypatch):
    rng = random.Random(7)
    # one address of one host has nearly all rows, many at one instant; ids and rows repeat
    at = lambda: T0 + timedelta(seconds=rng.choice([0, 0, 0, 59, 60, 61, 119, 120, 121, -60, -61]))
    rows = [dict(event_id=f"a{i % 40}", class_uid=3002, host="h", user="x", src_ip="1.1.1.1", timestamp=at()) for i in range(50)]
    rows += [dict(event_id=f"n{i}", class_uid=4001, host="h", process_pid=5, process_name="p", src_ip=f"1.1.1.{1 + i % 9 // 8}",
                  dst_ip="1.1.1.1", timestamp=at()) for i in range(60)]
    rows += [dict(event_id=f"p{i}", class_uid=1007, host="h", process_name="p", process_pid=5 + i % 9 // 8, parent_process_pid=5,
                  timestamp=at()) for i in range(45)]
    events, near = _events(spark, rows), lambda x, y: abs(x["timestamp"] - y["timestamp"]) <= timedelta(seconds=60)
    of = lambda kind: [r for r in rows if r["class_uid"] == kind]
    expected = [
        sorted((a["event_id"], n["event_id"], f"{a['timestamp']:%H:%M:%S}") for a in of(3002) for n in of(4001) if near(a, n)),
        sorted((n["event_id"], p["event_id"], f"{n['timestamp']:%H:%M:%S}") for n in of(4001) for p in of(1007) if near(n, p)),
        sorted((c["event_id"], p["event_id"], f"{c['timestamp']:%H:%M:%S}") for c in of(1007) for p in of(1007)
               if c["event_id"] != p["event_id"] and p["process_pid"] == 5 and near(c, p)),
    ]
    found = lambda: [
        correlate.identity_correlation(events, 60, "HH:mm:ss").select("auth_event_id", "network_event_id", "auth_timestamp"),
        correlate.network_to_process(events, 60, "HH:mm:ss").select("network_event_id", "process_event_id", "network_timestamp"),
        correlate.process_lineage(events, 60, "HH:mm:ss").select("child_event_id", "parent_event_id", "child_timestamp"),
    ]
    pairs = sorted(tuple(r) for r in correlate.entity_correlation(events, 60).select("event_a_id", "event_b_id", "correlation_key", "delta_seconds").collect())
    for block, task in ((2_000, 10_000_000), (7, 150)):
        monkeypatch.setattr(correlate, "BLOCK_ROWS", block)
        monkeypatch.setattr(correlate, "TASK_PAIRS", task)
        for df, rows_expected in zip(found(), expected):
            assert sorted(tuple(r) for r in df.collect()) == rows_expected
            if task == 150:
                assert df.rdd.getNumPartitions() > 4
    assert pairs == sorted(tuple(r) for r in correlate.entity_correlation(events, 60).select("event_a_id", "event_b_id", "correlation_key", "delta_seconds").collect())


def test_sparse_groups_are_joined_without_a_stored_row_for_each(spark, monkeypatch):
    rows = _random_rows(11)
    events, stored, durable = _events(spark, rows), [], correlate.durable
    pairs, _ = _pairwise(rows, 120)
    monkeypatch.setattr(correlate, "durable", lambda df: stored.append(durable(df)) or stored[-1])
    for dense, block, hot in (((50, 500), 2_000, False), ((0, 500), 2_000, False), ((0, 500), 2, True), ((0, 0), 2, True)):
        monkeypatch.setattr(correlate, "DENSE_PAIRS", dense)
        monkeypatch.setattr(correlate, "BLOCK_ROWS", block)
        stored.clear()
        found = correlate.entity_correlation(events, 120, _KEYS)
        assert bool(stored) == hot
        got = [(r.event_a_id, r.event_b_id, r.correlation_key) for r in found.collect()]
        assert sorted(got) == sorted(pairs)
    assert correlate.entity_correlation(events.filter("false"), 120, _KEYS).count() == 0


def test_chosen_values_are_looked_up_without_shuffling_the_events(spark, monkeypatch):
    rows = _random_rows(12)
    chosen = spark.createDataFrame([("host", "h1"), ("user", "u2"), ("host", "h1")], "correlation_key string, correlation_value string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = correlate.entity_correlation(_events(spark, rows), 120, _KEYS, chosen)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin [correlation_key#" in plan
        got = sorted((r.event_a_id, r.event_b_id, r.correlation_key) for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    value = {r["event_id"]: r for r in rows}
    assert got == sorted(p for p in _pairwise(rows, 120)[0] if (p[2], value[p[0]][p[2]]) in {("host", "h1"), ("user", "u2")}) and got
