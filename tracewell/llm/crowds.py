"""Links across components inside the buckets of a banded similarity join, without listing all pairs of a bucket.

After a first round has linked every set with one set of each of its buckets, a bucket may still hold several components.
Whoever wants every link must compare the members of different components:

* buckets of up to ``SMALL`` members give their pairs, at most SMALL / 2 for each member;
* larger ones are cut into blocks of about ``SIDE`` members; a task compares two blocks at once by one matrix product over
  the elements that they share, and returns links that join the components that it finds linked, fewer than it has components.

Both ways are exact and cover every pair; no task holds more than two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL, SIDE = 32, 256
#: Columns of the matrix that are multiplied at once.
_COLUMNS = 4096


def mixed_members(bands: DataFrame) -> DataFrame:
    """(bucket, node, root, n) of the buckets with several roots; ``bands`` has (bucket, node, root)."""
    mixed = bands.groupBy("bucket").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high").select("bucket", "n")
    return bands.join(mixed, "bucket")


def small_pairs(members: DataFrame) -> DataFrame:
    """(a, b) of different roots in the small buckets."""
    left = members.filter(F.col("n") <= SMALL).select("bucket", "node", "root")
    right = left.select("bucket", F.col("node").alias("b"), F.col("root").alias("root_b"))
    return left.join(right, "bucket").filter("root < root_b").select(
        F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    n = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    several = times > 1
    number = np.cumsum(several) - 1
    keep = several[column]
    owner, column = owner[keep], number[column[keep]]
    out = np.zeros((n, n), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    edges = np.searchsorted(column, np.arange(0, int(several.sum()) + _COLUMNS, _COLUMNS))
    for a, b in zip(edges[:-1], edges[1:]):
        part = np.zeros((n, _COLUMNS), dtype=np.float32)
        part[owner[a:b], column[a:b] % _COLUMNS] = 1.0
        out += part @ part.T
    return out


def _joined(group: list[dict], percent: int) -> Iterator[tuple]:
    """Links that join the roots of a pair of blocks as all links of their members do: a spanning forest."""
    sets = [np.frombuffer(r["elements"], np.uint64) for r in group]
    size = np.array([len(s) for s in sets], dtype=np.float32)
    roots = {r: i for i, r in enumerate(dict.fromkeys(r["root"] for r in group))}
    root = np.array([roots[r["root"]] for r in group])
    if len(roots) < 2:
        return
    both = common(sets)
    near = (100 * both >= percent * (size[:, None] + size[None, :] - both)) & (root[:, None] < root[None, :])
    top = np.arange(len(roots))
    for x, y in zip(*np.nonzero(near)):
        a, b = top[root[x]], top[root[y]]
        if a != b:
            top[top == b] = a
            yield group[x]["node"], group[y]["node"]


def crowded_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): links between different roots in the large buckets; ``sets`` has (node, elements: sorted 64-bit values)."""
    large = members.filter(F.col("n") > SMALL)
    parts = F.ceil(F.col("n") / SIDE).cast("int")
    block = F.pmod(F.xxhash64("node"), parts).cast("int")
    spread = large.select("bucket", "node", "root", block.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    spread = spread.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "root")
    filled = spread.join(sets.select("node", "elements"), "node")
    key = ["bucket", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []

        def result(rows: list[dict]) -> pa.RecordBatch:
            links = list(_joined(rows, percent))
            u, v = zip(*links) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, kind), pa.array(v, kind)], names=["u", "v"])

        for batch in batches:
            kind = batch.schema.field("node").type
            for row in batch.to_pylist():
                this = tuple(row[k] for k in key)
                if this != now and group:
                    yield result(group)
                    group = []
                now = this
                group.append(row)
        if group:
            yield result(group)

    dealt = filled.select(*key, "node", "root", "elements").repartition(*key).sortWithinPartitions(*key)
    node = members.schema["node"].dataType.simpleString()
    return dealt.mapInArrow(compare, f"u {node}, v {node}")
