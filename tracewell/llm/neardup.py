"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct shingles of ``WIDTH`` words.  Every shingle draws points of a Poisson process from
its hash, each in one of ``M`` registers; a register keeps the smallest point, rounded down to a power of ``B``.  Such
registers are mergeable (by their maximum), and two documents agree in a register with a probability close to their
Jaccard similarity.  Steps:

1. One pass over the texts gives each document its set size, a 128-bit fingerprint of the set, and its registers.
2. Documents with equal sets are one class; from here on only classes are compared.
3. ``BANDS`` bands of ``ROWS`` registers are hashed.  Each class is paired with the smallest class of each of its buckets: a
   bucket of thousands gives thousands of pairs, not millions.
4. The likelihood of the joint registers estimates each pair's similarity (the set sizes are known); pairs well below
   the threshold go.  The others are verified on the full sets, which a second pass makes for the classes concerned.
5. Components of the verified links.  In buckets that still hold several components, all members of different
   components are compared (see ``crowds``), so no candidate pair that could join two components is left out.

At a similarity of exactly 0.8, with equal set sizes, a pair shares no bucket with a probability of 1.4e-5 and is dropped by
step 4 with one of 6.7e-6: bands and filter together find it with a probability of at least 0.99997.

Defined results: null, empty and blank texts have no shingle and are linked with nothing; equal sets are linked; rows
that repeat are documents of their own with the same component; a component is named by its smallest id (null only if
all its ids are null); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.crowds import SMALL, crowded_links, mixed_members, small_pairs
from tracewell.llm.tables import stored, table
from tracewell.llm.wordbatch import Words, binaries, mix, shingle_sets, slices
from tracewell.operators.components import star_edges

WIDTH = 4
#: Similarity in hundredths from which documents are linked.
PERCENT = 80
BANDS, ROWS = 25, 5
M = BANDS * ROWS
#: Base of the registers, and the scale at which register values of a single shingle lie around 17.
B, A = 1.2, 20.0
#: Pairs whose estimate lies this much below the threshold are not verified: five standard deviations at M registers.
SLACK = 5 * (0.8 * 0.2 / M) ** 0.5
_STEP = np.uint64(0x9E3779B97F4A7C15)


def registers(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """One row of M register values (uint8) for each set; sets without elements have zeros."""
    n = len(offsets) - 1
    least = np.full(n * M, np.inf)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    seed, at = values.astype(np.uint64), np.zeros(len(values))
    for k in count(1):
        if not len(seed):
            break
        draw = mix(seed + np.uint64(k * int(_STEP) % (1 << 64)))
        at = at - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / M
        cell = owner * M + (mix(draw ^ _STEP) % np.uint64(M)).astype(np.int64)
        np.minimum.at(least, cell, at)
        sets = np.unique(owner) if k > 1 else np.arange(n)
        most = np.zeros(n)
        most[sets] = least.reshape(n, M)[sets].max(axis=1)
        more = at < most[owner]
        owner, seed, at = owner[more], seed[more], at[more]
    with np.errstate(divide="ignore"):
        value = np.floor(1.0 - np.log(least / A) / np.log(B))
    return np.where(np.isfinite(least), np.clip(value, 0, 255), 0).astype(np.uint8).reshape(n, M)


def fingerprints(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """128 bits of each set that do not depend on the order of its elements."""
    both = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values + np.uint64(s)))]) for s in (1, 2)]
    sums = [mix((c[offsets[1:]] - c[offsets[:-1]]) ^ np.diff(offsets).astype(np.uint64)) for c in both]
    return np.column_stack(sums)


def _share(x: np.ndarray) -> np.ndarray:
    """Probability that a register exceeds another one, for a share x of elements on one side only."""
    return -np.log1p(-x * (B - 1.0) / B) / np.log(B)


def estimated(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarities from two arrays of registers and the set sizes, by golden sections."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)

    def likelihood(j: np.ndarray) -> np.ndarray:
        p, q = _share(np.maximum(u - v * j, 1e-12)), _share(np.maximum(v - u * j, 1e-12))
        return more * np.log(p) + less * np.log(q) + same * np.log(np.maximum(1.0 - p - q, 1e-12))

    low, high, g = np.zeros(len(u)), np.minimum(u / v, v / u), (5**0.5 - 1) / 2
    for _ in range(30):
        x, y = high - g * (high - low), low + g * (high - low)
        left = likelihood(x) > likelihood(y)
        low, high = np.where(left, low, x), np.where(left, y, high)
    return (low + high) / 2


def sketched(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, node (fingerprint of the set, null if empty), registers."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            offsets, values = shingle_sets(Words(part.column("text")), width)
            n = np.diff(offsets)
            node = fingerprints(offsets, values)
            nodes = binaries(np.arange(len(n) + 1) * 2, node.ravel())
            nodes = pa.compute.if_else(pa.array(n > 0), nodes, pa.nulls(len(n), pa.binary()))
            rows = registers(offsets, values)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), nodes, binaries(np.arange(len(n) + 1) * M, rows.ravel())],
                names=["doc_id", "n_shingles", "node", "registers"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(sketch, f"doc_id {kind}, n_shingles bigint, node binary, registers binary")


def sets_of(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """node, elements: the sorted shingles of each document."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            offsets, values = shingle_sets(Words(part.column("text")), width)
            node = fingerprints(offsets, values)
            yield pa.RecordBatch.from_arrays(
                [binaries(np.arange(len(offsets)) * 2, node.ravel()), binaries(offsets, values)], names=["node", "elements"])

    return documents.select("text").mapInArrow(make, "node binary, elements binary").dropDuplicates(["node"])


def classes_of(sketches: DataFrame) -> DataFrame:
    """node, n_shingles, registers, doc_id (the smallest) of each distinct set."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "registers")).alias("first")
    return sketches.filter("node IS NOT NULL").groupBy("node", "n_shingles").agg(first).select(
        "node", "n_shingles", "first.registers", "first.doc_id")


def banded(classes: DataFrame, *more: str) -> DataFrame:
    """(bucket, node, more): a row for each band of a class."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("registers", i * ROWS + 1, F.lit(ROWS))))
    return classes.select(F.explode(keys).alias("bucket"), "node", *more)


def star_pairs(bands: DataFrame) -> DataFrame:
    """(a, b): each class with the smallest one of each of its buckets."""
    least = bands.groupBy("bucket").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return bands.join(least, "bucket").filter("node > a").select("a", F.col("node").alias("b")).distinct()


def likely(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose registers do not exclude the similarity."""
    line = percent / 100 - SLACK

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, M) for c in ("regs_a", "regs_b"))
                size_a, size_b = (batch.column(c).to_numpy().astype(float) for c in ("size_a", "size_b"))
                yield batch.select(["a", "b"]).filter(pa.array(estimated(a, b, size_a, size_b) >= line))

    side = {x: classes.select(F.col("node").alias(x), F.col("registers").alias(f"regs_{x}"), F.col("n_shingles").alias(f"size_{x}")) for x in "ab"}
    sized = pairs.join(side["a"], "a").join(side["b"], "b")
    possible = 100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")
    return sized.filter(possible).select("a", "b", "regs_a", "regs_b", "size_a", "size_b").mapInArrow(judge, "a binary, b binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) with 100 * |A & B| >= percent * |A | B| on the full sets."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = {x: sets.select(F.col("node").alias(x), F.col("elements").alias(f"set_{x}")) for x in "ab"}
    full = pairs.join(side["a"], "a").join(side["b"], "b")
    return full.select("a", "b", "set_a", "set_b").mapInArrow(judge, "a binary, b binary")


def _sets_for(nodes: DataFrame, classes: DataFrame, documents: DataFrame, width: int) -> DataFrame:
    """node, elements of the given nodes, from the documents that stand for them."""
    ids = classes.join(nodes.distinct(), "node", "left_semi").select(F.col("doc_id").alias("_id")).distinct()
    texts = documents.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return sets_of(texts, width)


def linked_documents(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``documents``."""
    sketches = stored(sketched(documents, width), "near-sketches")
    classes = stored(classes_of(sketches), "near-classes")
    pairs = stored(likely(star_pairs(banded(classes)), classes, percent), "near-pairs")
    sets = _sets_for(pairs.select(F.explode(F.array("a", "b")).alias("node")), classes, documents, width)
    edges = stored(verified(pairs, sets, percent), "near-links").toDF("u", "v")
    roots = star_edges(edges).select(F.col("a").alias("node"), F.col("b").alias("root"))
    rooted = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = stored(mixed_members(banded(rooted, "root")), "near-members")
    few = stored(likely(small_pairs(members), classes, percent), "near-few")
    wanted = members.filter(F.col("n") > SMALL).select("node").unionByName(few.select(F.explode(F.array("a", "b")).alias("node")))
    sets = stored(_sets_for(wanted, classes, documents, width), "near-sets")
    more = verified(few, sets, percent).toDF("u", "v").unionByName(crowded_links(members, sets, percent))
    edges = roots.toDF("u", "v").unionByName(more)
    roots = star_edges(edges).select(F.col("a").alias("node"), F.col("b").alias("root"))
    named = classes.select("node", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    membership = named.join(smallest, "root").select("node", "component_id")
    placed = sketches.select("doc_id", "n_shingles", "node").join(membership, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def kept_documents(documents: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """One document of each group, with the columns it came with."""
    kept = linked_documents(documents, width, percent).filter("kept").select(F.col("doc_id").alias("_id")).distinct()
    return documents.join(kept, documents["doc_id"].eqNullSafe(kept["_id"]), "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op9_near_duplicates": query}
ORACLES: dict[str, str] = {}
