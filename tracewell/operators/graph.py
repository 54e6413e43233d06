"""Attack graph as node and edge tables, and questions about it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import fixed_values as V
from tracewell.functions.text import explode_once, non_empty
from tracewell.operators.components import connected_components
from tracewell.session import durable


def _id(kind: Column | str, label: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(kind, F.lit(":"), F.lower(label))


def _elements() -> tuple[list[Column], list[Column]]:
    """Node and edge structs of one event, each with its place in the event's order."""
    text = lambda name: non_empty(F.col(name))
    host, user, proc = F.coalesce(text("host"), F.lit("unknown-host")), text("user"), text("process_name")
    parent, path, key = text("parent_process_name"), text("file_path"), text("registry_key")
    actor = F.coalesce(proc, F.lit("unknown-process"))
    remote = F.coalesce(text("domain"), text("dst_ip"))
    remote_kind = F.when(text("domain").isNotNull(), "domain").otherwise("ip")
    source_kind = F.when(proc.isNotNull(), "process").otherwise("device")
    source = F.coalesce(proc, text("host"), F.lit("unknown"))

    nodes, edges = [], []

    def node(condition: Column, kind: Column | str, label: Column, pid: Column | None = None, digest: Column | None = None):
        kind = F.lit(kind) if isinstance(kind, str) else kind
        nodes.append(F.when(condition, F.struct(
            F.lit(len(nodes)).alias("ord"), _id(kind, label).alias("id"), kind.alias("type"), label.alias("label"),
            (F.lit(None) if pid is None else pid).cast("int").alias("pid"),
            (F.lit(None) if digest is None else digest).cast("string").alias("hash"),
        )))

    def edge(condition: Column, start: Column, end: Column, kind: Column | str):
        kind = F.lit(kind) if isinstance(kind, str) else kind
        edges.append(F.when(condition, F.struct(
            F.lit(len(edges)).alias("ord"), start.alias("source"), end.alias("target"), kind.alias("type"),
        )))

    always = F.lit(True)
    node(always, "device", host)
    node(user.isNotNull(), "user", user)
    edge(user.isNotNull(), _id("user", user), _id("device", host), "authenticated")
    node(proc.isNotNull(), "process", proc, pid=F.col("process_pid"))
    edge(proc.isNotNull(), _id("process", proc), _id("device", host), "executed")
    spawned = proc.isNotNull() & parent.isNotNull()
    node(spawned, "process", parent)
    edge(spawned, _id("process", parent), _id("process", proc), "spawned")
    node(path.isNotNull(), "file", path, digest=F.col("file_hash"))
    node(path.isNotNull(), "process", actor)
    edge(path.isNotNull(), _id("process", actor), _id("file", path),
         F.when(F.col("class_uid") == V.FILE_ACTIVITY, "created").otherwise("modified"))
    node(key.isNotNull(), "registry", key)
    node(key.isNotNull(), "process", actor)
    edge(key.isNotNull(), _id("process", actor), _id("registry", key), "modified")
    node(remote.isNotNull(), remote_kind, remote)
    node(remote.isNotNull(), source_kind, source)
    edge(remote.isNotNull(), _id(source_kind, source), _id(remote_kind, remote), "connected")
    return nodes, edges


def build_graph(events: DataFrame, group: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the events, per ``group`` columns if given.

    A node keeps the label and properties of its first sighting, an edge the
    type and time of its last.  First and last follow (timestamp, seq, place in
    the event); both are struct minima or maxima, combined before the shuffle.
    """
    group = group or []
    node_structs, edge_structs = _elements()
    order = ["timestamp", "seq"]
    nodes = explode_once(events, [*group, *order], F.array_compact(F.array(*node_structs)), "n")
    nodes = nodes.groupBy(*group, F.col("n.id").alias("id")).agg(
        F.min(F.struct(*order, "n.ord", "n.type", "n.label", "n.pid", "n.hash")).alias("f")
    ).select(*group, "id", "f.type", "f.label", "f.pid", "f.hash")
    edges = explode_once(events, [*group, *order], F.array_compact(F.array(*edge_structs)), "e")
    edges = edges.groupBy(*group, F.col("e.source").alias("source"), F.col("e.target").alias("target")).agg(
        F.max(F.struct(*order, "e.ord", "e.type")).alias("l")
    ).select(*group, "source", "target", "l.type", F.col("l.timestamp").alias("timestamp"))
    return nodes, edges


def graph_counts(nodes: DataFrame, edges: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Number of nodes and edges."""
    group = group or []
    n = nodes.groupBy(*group).agg(F.count(F.lit(1)).alias("node_count"))
    e = edges.groupBy(*group).agg(F.count(F.lit(1)).alias("edge_count"))
    if not group:
        return n.withColumn("k", F.lit(1)).join(e.withColumn("k", F.lit(1)), "k").drop("k")
    return n.join(e, group, "left").withColumn("edge_count", F.coalesce("edge_count", F.lit(0)))


def components(nodes: DataFrame, edges: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Undirected components of all nodes: (group, id, component)."""
    group = group or []
    if not group:
        return connected_components(edges.select(F.col("source").alias("u"), F.col("target").alias("v")), nodes)
    # ids of different groups are different nodes: (group, id) pairs as structs order like their parts
    pair = lambda c: F.struct(*group, F.col(c).alias("id"))
    out = connected_components(
        edges.select(pair("source").alias("u"), pair("target").alias("v")), nodes.select(pair("id").alias("id"))
    )
    return out.select(*[F.col(f"id.{g}").alias(g) for g in group], F.col("id.id").alias("id"),
                      F.col("component.id").alias("component"))


def blast_radius(nodes: DataFrame, edges: DataFrame, group: list[str] | None = None) -> DataFrame:
    """For every node the number of other nodes it can reach, ignoring direction."""
    group = group or []
    labelled = components(nodes, edges, group)
    sizes = labelled.groupBy(*group, "component").agg((F.count(F.lit(1)) - 1).alias("blast_radius"))
    return labelled.join(sizes, [*group, "component"]).select(*group, "id", "blast_radius")


def _level(level: DataFrame, arcs: DataFrame, start: str, end: str, seen: list[DataFrame]) -> DataFrame:
    """The nodes one arc beyond ``level`` that no level of ``seen`` holds."""
    found = level.join(arcs, level["node"] == arcs[start]).select(F.col(end).alias("node")).distinct()
    return durable(found.join(reduce(DataFrame.unionAll, seen), "node", "left_anti"))


def shortest_path(edges: DataFrame, source: str, target: str, nodes: DataFrame | None = None) -> DataFrame:
    """The shortest directed path as one row (path, length), or no row if there is none.

    Both ends are searched at once, the smaller front first.  A level holds node ids only and is appended, never written
    again; where the fronts meet, the levels are cut to the nodes on shortest paths and the path is walked through them,
    one id at a time.  Of equally short paths the smallest is given, so the answer does not depend on partitioning.
    """
    spark = edges.sparkSession
    arcs = durable(edges.select(F.col("source").alias("at"), F.col("target").alias("next")).filter("at <> next").distinct())
    known = edges.select(F.col("source").alias("node")).union(edges.select("target"))
    if nodes is not None:
        known = known.union(nodes.select("id"))
    schema = "path array<string>, length int"
    if known.filter(F.col("node").isin(source, target)).distinct().count() < len({source, target}):
        return spark.createDataFrame([], schema)
    ahead, behind = ([spark.createDataFrame([(end,)], "node string")] for end in (source, target))
    sizes = {"ahead": 1, "behind": 1}
    while not (meet := durable(ahead[-1].join(behind[-1], "node"))).limit(1).count():
        if sizes["ahead"] <= sizes["behind"]:
            ahead.append(_level(ahead[-1], arcs, "at", "next", ahead))
            sizes["ahead"] = smallest = ahead[-1].count()
        else:
            behind.append(_level(behind[-1], arcs, "next", "at", behind))
            sizes["behind"] = smallest = behind[-1].count()
        if not smallest:
            return spark.createDataFrame([], schema)
    length = len(ahead) + len(behind) - 2
    steps = [*ahead[:-1], meet, *reversed(behind[:-1])]
    for k in range(len(ahead) - 2, 0, -1):
        leading = arcs.join(steps[k + 1], F.col("next") == F.col("node"), "left_semi").select(F.col("at").alias("node"))
        steps[k] = durable(steps[k].join(leading, "node", "left_semi"))
    path = [source]
    for step in steps[1:]:
        onward = arcs.filter(F.col("at") == path[-1]).join(step, F.col("next") == F.col("node"), "left_semi")
        path.append(onward.agg(F.min("next")).first()[0])
    return spark.createDataFrame([(path, length)], schema)


def detect_lateral_movement(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``connected`` edges between two different devices."""
    devices = nodes.filter(F.col("type") == "device").select("id")
    return (
        edges.filter((F.col("type") == "connected") & (F.col("source") != F.col("target")))
        .join(devices.withColumnRenamed("id", "source"), "source", "left_semi")
        .join(devices.withColumnRenamed("id", "target"), "target", "left_semi")
    )
