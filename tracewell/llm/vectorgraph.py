"""Near-duplicate embeddings by robust-pruned flat graphs over overlapping cluster shards.

1. Vectors of equal direction are one class; from here on only classes are compared, with their weights.
2. Centroids are fitted on a bounded sample (``SAMPLE`` classes), those that are near duplicates become one; every class goes to the ``OVERLAP`` shards of its nearest
   centroids.  There are as many centroids as keep shards at about ``SHARD`` members, up to one for each 8 sampled classes.
3. Each shard builds a flat graph: the nearest members of each one and some random ones, pruned robustly (a candidate goes if
   a chosen one is ``ALPHA`` times closer to it), and the reverse edges.  A class's lists of all its shards are united.
4. In each shard every member searches the united graph from the best of the shard's medoids, and from itself: greedily along
   the ``BEAM`` best nodes, and on through every node that is within ``WIDE`` of it.  What it finds with cosine ``LEAST`` and
   more, in double precision, is a link.  A pair that shares several shards counts in the smallest one.
5. Links stay in their tasks: what leaves are each member's number of links and one edge to its component there.
6. An audit compares a bounded number of classes (``AUDIT``) with all others by brute force; below ``TARGET`` everything is
   done again with twice the overlap.

Crowds: members within half the angle of ``LEAST`` of their shard's centroid are linked with each other for certain.  Where more
than ``LIMIT`` of them meet (the core of a hot group) they go to that shard only, are counted as one, and are compared
only with members that may reach one of them.  Other shards of more than ``LIMIT`` members are cut into parts, of which
every two meet in a task; no task holds more than two parts.  Beyond some 16 million classes the sample bounds the
number of shards, and their parts grow in number.

Defined results: vectors that are null, empty or zero, hold null or non-finite entries, or whose length isn't the most frequent
one (ties: the larger), link with nothing; labels and other columns are ignored; rows that repeat are vectors of their own; a
component is named by its smallest id (null only if all its ids are null); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.tables import stored, table
from tracewell.llm.wordbatch import binaries, mix
from tracewell.operators.components import star_edges

LEAST = 0.95
SHARD, OVERLAP, LIMIT = 2048, 4, 4096
SAMPLE, SAMPLE_VALUES = 65_536, 1 << 23
CANDIDATES, RANDOM, DEGREE, ALPHA = 48, 8, 24, 1.2
BEAM, WIDE, STARTS = 16, 0.05, 4
AUDIT, TARGET = 1000, 0.99
_KEY = "S16"


class Shards(NamedTuple):
    centroids: np.ndarray
    overlap: int
    #: Shards whose core is counted as one.
    hot: np.ndarray


def unit_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, node (128 bits of the direction), unit (doubles) for every row; node and unit are null where it can't be compared."""
    vec = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), vec.alias("vec"))
    bad = F.exists("vec", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) | ~F.exists("vec", lambda c: c != 0)
    usable = F.col("vec").isNotNull() & ~bad
    usual = rows.filter(usable).groupBy(F.size("vec").alias("size")).count().agg(F.max(F.struct("count", "size")).alias("most")).first()["most"]
    size = usual["size"] if usual else 0

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column("vec")
            there = vec.is_valid().to_numpy(zero_copy_only=False)
            x = vec.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(there.sum(), size)
            if len(x):
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True)) + 0.0
            node, unit = np.full(len(there), None), np.full(len(there), None)
            node[there], unit[there] = [r.tobytes() for r in _direction_keys(x)], [r.tobytes() for r in x]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(node, pa.binary()), pa.array(unit, pa.binary())], names=["vec_id", "node", "unit"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    kept = rows.select("vec_id", F.when(usable & (F.size("vec") == size), F.col("vec")).alias("vec"))
    return kept.mapInArrow(scale, f"vec_id {kind}, node binary, unit binary")


def _direction_keys(units: np.ndarray) -> np.ndarray:
    bits = np.ascontiguousarray(units).view(np.uint64)
    place = np.arange(1, bits.shape[1] + 1, dtype=np.uint64)
    sums = [mix(bits ^ mix(place + np.uint64(seed << 32))).sum(axis=1, dtype=np.uint64) for seed in (1, 2)]
    return np.column_stack([mix(s) for s in sums]) if len(bits) else np.zeros((0, 2), np.uint64)


def classes_of(units: DataFrame) -> DataFrame:
    """node, weight (rows), vec_id (the smallest), unit."""
    return units.filter("node IS NOT NULL").groupBy("node").agg(
        F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("vec_id"), F.first("unit").alias("unit"))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows)).reshape(len(rows), -1) if rows else np.zeros((0, 0))


def sampled(classes: DataFrame, n: int, most: int) -> pa.Table:
    """About ``most`` classes, chosen by their hash."""
    return classes.filter(F.pmod(F.xxhash64("node"), F.lit(max(1, math.ceil(n / most)))) == 0).select("node", "unit").limit(2 * most).toArrow()


def fitted(classes: DataFrame, n: int, overlap: int) -> Shards:
    """Centroids of unit length by a few rounds of k-means on the sample."""
    if n <= LIMIT:
        return Shards(np.zeros((1, 1)), 1, np.zeros(0, np.int64))
    width = len(classes.select("unit").first()["unit"]) // 8
    x = _matrix(sampled(classes, n, max(1024, min(SAMPLE, SAMPLE_VALUES // width))).column("unit"))
    k = max(1, min(math.ceil(n * overlap / SHARD), len(x) // 8))
    if k <= overlap:
        return Shards(np.zeros((1, 1)), 1, np.zeros(0, np.int64))
    c = x[:: len(x) // k][:k].copy()
    for _ in range(5):
        near = np.concatenate([(x[i:i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = _directions(sums, c)
    top = np.zeros_like(c)  # one centroid for centroids that are near duplicates: a crowd isn't torn apart
    merged, kept = np.zeros_like(c), 0
    for i in np.argsort(-np.bincount(near, minlength=k), kind="stable"):
        cosine = top[:kept] @ c[i]
        at = int(cosine.argmax()) if kept else 0
        if not kept or cosine[at] < LEAST:
            at, kept = kept, kept + 1
            top[at] = c[i]
        merged[at] += sums[i]
    return Shards(_directions(merged[:kept], top[:kept]), min(overlap, kept), np.zeros(0, np.int64))


def _directions(sums: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    return np.where(length > 1e-9, sums / np.maximum(length, 1e-9), otherwise)


#: Cosines of half and of one and a half times the angle of a link, moved by more than rounding errors.
_CORE = math.cos(math.acos(LEAST) / 2) + 1e-9
_REACH = math.cos(math.acos(LEAST) * 1.5) - 1e-9


def with_hot_cores(classes: DataFrame, shards: Shards) -> Shards:
    """The same shards, with those named whose core has more than ``LIMIT`` classes."""
    if len(shards.centroids) < 2:
        return shards

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = _matrix(batch.column("unit")) @ shards.centroids.T
                found, times = np.unique(near.argmax(axis=1)[near.max(axis=1) >= _CORE], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(times)], names=["shard", "n"])

    cores = classes.select("unit").mapInArrow(home, "shard bigint, n bigint").groupBy("shard").agg(F.sum("n").alias("n")).filter(F.col("n") > LIMIT)
    return shards._replace(hot=np.array(sorted(r["shard"] for r in cores.collect()), dtype=np.int64))


def memberships(classes: DataFrame, shards: Shards) -> DataFrame:
    """shard, label (0: hot core, 1: within reach of it, 2: others), node, weight, unit, shards (all of the class, as int32).

    A class of a hot core is in that shard only; any other is also in every hot shard whose core it may reach.
    """

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if len(shards.centroids) < 2:
                row, shard, label = np.arange(n), np.zeros(n, np.int64), np.full(n, 2)
            else:
                near = _matrix(batch.column("unit")) @ shards.centroids.T
                member = np.zeros(near.shape, dtype=bool)
                np.put_along_axis(member, np.argpartition(-near, shards.overlap - 1, axis=1)[:, :shards.overlap], True, axis=1)
                reach = np.zeros(near.shape, dtype=bool)
                reach[:, shards.hot] = near[:, shards.hot] >= _REACH
                home = near.argmax(axis=1)
                core = (near.max(axis=1) >= _CORE) & np.isin(home, shards.hot)
                member |= reach
                member[core] = False
                member[np.flatnonzero(core), home[core]] = True
                row, shard = np.nonzero(member)
                label = np.where(core[row], 0, np.where(reach[row, shard], 1, 2))
            ends = np.searchsorted(row, np.arange(n + 1))
            lists = binaries(ends, shard.astype(np.int32))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.astype(np.int32)), pa.array(label.astype(np.int32)), *(batch.column(c).take(at) for c in ("node", "weight", "unit")), lists.take(at)],
                names=["shard", "label", "node", "weight", "unit", "shards"])

    return classes.select("node", "weight", "unit").mapInArrow(
        assign, "shard int, label int, node binary, weight bigint, unit binary, shards binary")


def parted(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members with their ``part``, and the tasks (shard, label, part, i, j): which parts meet in task (i, j) of a shard."""
    sizes = members.groupBy("shard", "label").count().collect()
    whole: dict[int, int] = {}
    for r in sizes:
        whole[r["shard"]] = whole.get(r["shard"], 0) + r["count"]
    parts = {(r["shard"], r["label"]): 1 if whole[r["shard"]] <= LIMIT else math.ceil(2 * r["count"] / LIMIT) for r in sizes}
    tasks = []
    for shard, n in whole.items():
        if n <= LIMIT:
            tasks += [(shard, label, 0, 0, 0) for s, label in parts if s == shard]
            continue
        own = [(label, p) for s, label in sorted(parts) if s == shard for p in range(parts[s, label])]
        for i, a in enumerate(own):
            for j, b in enumerate(own[i:], i):
                if a[0] == 0 and b[0] != 1:
                    continue  # links inside a core are known, others than label 1 can't reach it
                tasks += {(shard, *a, i, j), (shard, *b, i, j)}
    spark = members.sparkSession
    counts = spark.createDataFrame([(*k, v) for k, v in parts.items()], "shard int, label int, parts int")
    cut = members.join(F.broadcast(counts), ["shard", "label"]).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).drop("parts")
    return cut, spark.createDataFrame(tasks, "shard int, label int, part int, i int, j int")


def pruned_graph(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to) of the robust-pruned graph of the rows, both ways."""
    n = len(units)
    width = min(CANDIDATES, n - 1)
    if width < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    random, out = np.random.default_rng(n), []
    for at in range(0, n, 256):
        block = units[at:at + 256]
        own = np.arange(at, at + len(block))
        near = block @ units.T
        near[np.arange(len(block)), own] = -2.0
        chosen = np.argpartition(-near, width - 1, axis=1)[:, :width]
        chosen = np.concatenate([chosen, random.integers(0, n, (len(block), RANDOM))], axis=1)
        cosine = np.take_along_axis(near, chosen, axis=1)
        order = np.argsort(-cosine, axis=1, kind="stable")
        chosen, cosine = np.take_along_axis(chosen, order, axis=1), np.take_along_axis(cosine, order, axis=1)
        away = np.sqrt(np.maximum(2 - 2 * cosine, 0))
        rows = units[chosen]
        between = np.sqrt(np.maximum(2 - 2 * (rows @ rows.transpose(0, 2, 1)), 0))
        alive = chosen != own[:, None]
        kept = np.zeros(chosen.shape, dtype=bool)
        for k in range(chosen.shape[1]):
            take = alive[:, k] & (kept.sum(axis=1) < DEGREE)
            kept[:, k] = take
            alive &= ~(take[:, None] & (ALPHA * between[:, k] <= away))
        out.append((np.broadcast_to(own[:, None], chosen.shape)[kept], chosen[kept]))
    a, b = (np.concatenate(x) for x in zip(*out))
    both = np.unique(np.concatenate([a * n + b, b * n + a]))
    return both // n, both % n


def built(parts: DataFrame) -> DataFrame:
    """node, neighbours: the adjacency lists of every part's graph, united over the shards of a class."""

    def build(part: pa.Table) -> pa.Table:
        nodes = np.array(part.column("node").to_pylist(), dtype=_KEY)
        a, b = pruned_graph(_matrix(part.column("unit")))
        lists = binaries(np.searchsorted(a, np.arange(len(nodes) + 1)), nodes[b])
        return pa.table({"node": part.column("node"), "neighbours": lists})

    lists = parts.select("shard", "label", "part", "node", "unit").groupBy("shard", "label", "part").applyInArrow(build, "node binary, neighbours binary")
    return lists.groupBy("node").agg(F.collect_list("neighbours").alias("neighbours"))


def medoids(units: np.ndarray) -> np.ndarray:
    """About the square root of the rows: the members closest to the means of random cells."""
    n = len(units)
    seeds = np.unique(np.linspace(0, n - 1, math.ceil(math.sqrt(n))).astype(int))
    cell = (units @ units[seeds].T).argmax(axis=1)
    sums = np.zeros((len(seeds), units.shape[1]))
    np.add.at(sums, cell, units)
    close = np.einsum("ij,ij->i", units, sums[cell])
    order = np.lexsort((-close, cell))
    return order[np.unique(cell[order], return_index=True)[1]]


def _neighbours(row: np.ndarray, node: np.ndarray, first: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, neighbour) of each pair (row, node)."""
    degree = first[node + 1] - first[node]
    at = np.arange(degree.sum()) - np.repeat(np.cumsum(degree) - degree, degree)
    return np.repeat(row, degree), to[np.repeat(first[node], degree) + at]


def range_search(units: np.ndarray, first: np.ndarray, to: np.ndarray, queries: np.ndarray, starts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) with a cosine of ``LEAST`` and more; the neighbours of node i are to[first[i]:first[i + 1]].

    ``starts`` are sets of medoids; each query begins at the best of each set, and at itself.
    """
    n, found = len(units), []
    beam = min(BEAM, n)
    for at in range(0, len(queries), 128):
        query = queries[at:at + 128]
        x, rows = units[query], np.arange(len(query))
        seen = np.full((len(query), n), -np.inf)
        done = np.zeros(seen.shape, dtype=bool)
        seen[rows, query] = 1.0
        for entry in starts:
            near = x @ units[entry].T
            best = np.argpartition(-near, min(STARTS, len(entry)) - 1, axis=1)[:, :STARTS]
            seen[rows[:, None], entry[best]] = np.take_along_axis(near, best, axis=1)
        while True:
            line = np.partition(seen, n - beam, axis=1)[:, n - beam, None]
            go = ~done & (seen > -np.inf) & ((seen >= line) | (seen >= LEAST - WIDE))
            row, node = np.nonzero(go)
            if not len(row):
                break
            done |= go
            new = np.zeros(seen.shape, dtype=bool)
            for k in range(0, len(row), 1 << 16):
                new[_neighbours(row[k:k + (1 << 16)], node[k:k + (1 << 16)], first, to)] = True
            row, node = np.nonzero(new & (seen == -np.inf))
            for k in range(0, len(row), 1 << 14):
                r, m = row[k:k + (1 << 14)], node[k:k + (1 << 14)]
                seen[r, m] = np.einsum("ij,ij->i", x[r], units[m])
        row, node = np.nonzero(seen >= LEAST - 1e-6)
        exact = np.einsum("ij,ij->i", x[row], units[node])
        keep = (exact >= LEAST) & (query[row] != node)
        found.append((query[row[keep]], node[keep]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of n nodes reaches along the links a - b."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            return root


def searched(parts: DataFrame, tasks: DataFrame, lists: DataFrame) -> DataFrame:
    """node, n_links (weights of the classes found), root (of the links found in this task) for each member that has links."""

    def search(task: pa.Table) -> pa.Table:
        task = task.take(pa.compute.sort_indices(task, [("node", "ascending")]))
        nodes = np.array(task.column("node").to_pylist(), dtype=_KEY)
        units, weight = _matrix(task.column("unit")), task.column("weight").to_numpy()
        n, this = len(nodes), task.column("shard")[0].as_py()
        alone = task.column("i")[0].as_py() == task.column("j")[0].as_py()
        side = np.zeros(n, np.int64) if alone else task.column("label").to_numpy().astype(np.int64) * (1 << 32) + task.column("part").to_numpy()
        label = task.column("label").to_numpy()
        joined = [b"".join(x) for x in task.column("neighbours").to_pylist()]
        owner = np.repeat(np.arange(n), [len(x) // 16 for x in joined])
        wanted = np.frombuffer(b"".join(joined), dtype=_KEY)
        place = np.minimum(np.searchsorted(nodes, wanted), n - 1)
        here = nodes[place] == wanted
        edges = np.unique(owner[here] * n + place[here])
        first, to = np.searchsorted(edges // n, np.arange(n + 1)), edges % n
        starts = [np.flatnonzero(side == s)[medoids(units[side == s])] for s in np.unique(side)]
        a, b = range_search(units, first, to, np.arange(n), starts)
        both = np.unique(np.concatenate([a * n + b, b * n + a]))
        a, b = both // n, both % n
        if not alone:
            a, b = a[side[a] != side[b]], b[side[a] != side[b]]
        root = local_roots(n, a, b)
        count = ~((label[a] == 0) & (label[b] == 0)) & (_first_common(task.column("shards").to_pylist(), a, b) == this)
        links = np.bincount(a[count], weights=weight[b[count]], minlength=n).astype(np.int64)
        some = pa.array((links > 0) | (root != np.arange(n)))
        out = pa.table({"node": task.column("node"), "n_links": pa.array(links), "root": pa.array(nodes[root].tolist(), pa.binary())})
        return out.filter(some)

    dealt = parts.join(lists, "node", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<binary>")))
    met = dealt.join(F.broadcast(tasks), ["shard", "label", "part"])
    return met.groupBy("shard", "i", "j").applyInArrow(_padded(search), "node binary, n_links bigint, root binary")


def _padded(search):
    """numpy's fixed strings lose zero bytes at their end; the keys get them back."""

    def run(task: pa.Table) -> pa.Table:
        out = search(task)
        roots = [r.ljust(16, b"\0") for r in out.column("root").to_pylist()]
        return pa.table({"node": out.column("node"), "n_links": out.column("n_links"), "root": pa.array(roots, pa.binary())})

    return run


def _first_common(shards: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest shard that rows a and b share."""
    width = max(map(len, shards)) // 4
    lists = np.full((len(shards), width), -1, dtype=np.int32)
    for i, x in enumerate(shards):
        lists[i, :len(x) // 4] = np.frombuffer(x, np.int32)
    out = np.full(len(a), np.iinfo(np.int32).max, dtype=np.int32)
    for p in range(width):
        for q in range(width):
            one, other = lists[a, p], lists[b, q]
            out = np.where((one == other) & (one >= 0), np.minimum(out, one), out)
    return out


def linked_classes(classes: DataFrame, n: int, overlap: int) -> tuple[DataFrame, int]:
    """node, n_links, root of every class, and the number of shards."""
    shards = with_hot_cores(classes, fitted(classes, n, overlap))
    members = stored(memberships(classes, shards), "vector-members")
    parts, tasks = parted(members)
    lists = stored(built(parts), "vector-graph")
    found = stored(searched(parts, tasks, lists), "vector-links")
    cores = members.filter("label = 0").groupBy("shard").agg(F.min("node").alias("top"), F.sum("weight").alias("all"))
    inside = members.filter("label = 0").join(F.broadcast(cores), "shard").select("node", (F.col("all") - F.col("weight")).alias("n_links"), F.col("top").alias("root"))
    every = found.unionByName(inside)
    roots = star_edges(every.select(F.col("node").alias("u"), F.col("root").alias("v"))).select(F.col("a").alias("node"), F.col("b").alias("root"))
    links = every.groupBy("node").agg(F.sum("n_links").alias("n_links"))
    full = classes.select("node", "weight", "vec_id").join(links, "node", "left").join(roots, "node", "left")
    return stored(full.select(
        "node", "vec_id", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "vector-classes"), len(shards.centroids)


def audited(classes: DataFrame, links: DataFrame, n: int) -> float | None:
    """The share of the links of a bounded number of classes that were found; None if they have none."""
    chosen = sampled(classes, n, AUDIT)
    keys, queries = chosen.column("node").to_pylist(), _matrix(chosen.column("unit"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(keys), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                total += part.column("weight").to_numpy() @ (_matrix(part.column("unit")) @ queries.T >= LEAST)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(keys))), pa.array(total)], names=["at", "n"])

    real = classes.select("weight", "unit").mapInArrow(compare, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n"))
    truth = {keys[r["at"]]: r["n"] - 1 for r in real.collect()}
    wanted = links.sparkSession.createDataFrame([(k,) for k in keys], "node binary")
    found = {bytes(r["node"]): r["n_links"] for r in links.join(F.broadcast(wanted), "node").select("node", "n_links").collect()}
    total = sum(truth.values())
    return sum(min(found[k], t) for k, t in truth.items()) / total if total else None


def linked_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept, audit_recall for every row."""
    units = stored(unit_vectors(vectors, vec_id, embedding), "vector-units")
    classes = stored(classes_of(units), "vector-classes")
    n, overlap = classes.count(), OVERLAP
    while True:
        links, shards = linked_classes(classes, n, overlap)
        recall = audited(classes, links, n) if n else None
        if recall is None or recall >= TARGET or overlap >= shards:
            break
        overlap *= 2
    smallest = links.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    named = links.join(smallest, "root").select("node", "n_links", "component_id")
    placed = units.select("vec_id", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return placed.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"), F.lit(recall).cast("double").alias("audit_recall"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_embedding_near_duplicates": query}
ORACLES: dict[str, str] = {}
