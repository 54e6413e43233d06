"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the mixture.  Its rate is share * budget / size: how often each of its documents is
wanted on average.  A document's number of copies is the Poisson quantile of a number that a hash of its id draws, so a
rerun gives the same copies and no source needs a count of what other tasks chose.  Copies are exploded and dealt out by
a hash of (id, copy), which is the global shuffle: every file holds a random part of the mixture in random order.

A source of a third of all rows is no special case: sizes are summed before the shuffle, the rates are a row for each
source, and copies are spread by their own hash.

Defined results: a null source is a source of its own; null and empty texts have size 0 and follow the rate of their
source; a source of size 0 in all has rate 1 (its rows are neither lost nor multiplied); repeated rows draw alike; a
null id draws as the text ''.  An empty table gives an empty table.  Columns of the input that have the names of the
operator's own are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.tables import DOCUMENT, stored, table, unused

#: Target shares in production; the sources not named share the rest in proportion to their size.
TARGETS = {"src0": 0.20, "src1": 0.10, "src2": 0.08, "src3": 0.02}
#: Size of the mixture as a multiple of the size of the corpus.
PASSES = 1.0
SEED = "mix-1"
#: A mean above this is drawn as a sum of independent draws with means up to this.
PIECE = 4.0
#: Quantiles are looked up among so many steps: beyond, a mean of PIECE has less than 2**-52 left.
STEPS = 40
#: Up to so many sources their rates are broadcast (some 400 bytes each); beyond, the join is a shuffled one.
BROADCAST_SOURCES = 50_000


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a hash."""
    digest = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(documents: DataFrame, targets: dict[str, float], passes: float) -> DataFrame:
    """(source, rate, pieces, steps): the mean of each source's documents, and the distribution function of a piece."""
    named = sum(targets.values())
    if not 0 <= named <= 1 or min(targets.values(), default=0) < 0:
        raise ValueError("target shares must not be negative, nor exceed 1 in sum")
    size = F.coalesce(F.length("text"), F.lit(0)).cast("bigint")
    sizes = documents.groupBy("source").agg(F.sum(size).alias("size"))
    share = F.lit(None).cast("double")
    for name, weight in targets.items():
        share = F.when(F.col("source") == name, F.lit(float(weight))).otherwise(share)
    sizes = sizes.withColumn("share", share)
    every = sizes.agg(F.sum("size"))
    unnamed = sizes.filter("share IS NULL").agg(F.sum("size"))
    means = sizes.withColumns({"every": every.scalar(), "unnamed": unnamed.scalar()}).withColumn(
        "share", F.coalesce("share", (1.0 - named) * F.col("size") / F.nullif(F.col("unnamed"), F.lit(0)))
    ).withColumn("rate", F.coalesce(
        F.col("share") * passes * F.col("every") / F.nullif(F.col("size"), F.lit(0)), F.lit(1.0)))
    means = means.withColumn("pieces", F.greatest(F.ceil(F.col("rate") / PIECE), F.lit(1)).cast("int"))
    mean = F.col("rate") / F.col("pieces")
    first = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    steps = F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)), first,
        lambda a, k: F.struct(
            (a["p"] * mean / k).alias("p"), F.array_append(a["c"], F.element_at(a["c"], -1) + a["p"] * mean / k).alias("c")),
        lambda a: a["c"])
    return means.select(F.col("source").alias("_source"), "rate", "pieces", steps.alias("_steps"))


def mixed(documents: DataFrame, targets: dict[str, float] | None = None, passes: float = PASSES, seed: str = SEED) -> DataFrame:
    """One row for each copy of each document, dealt out at random: the columns of ``documents``, rate, n_copies, copy, shuffle_key."""
    documents = documents.drop("rate", "pieces", "n_copies", "copy", "shuffle_key")
    means = stored(rates(documents, TARGETS if targets is None else targets, passes), "mix-rates")
    own, steps = unused("source", documents.columns), unused("steps", documents.columns)
    few, means = means.count() <= BROADCAST_SOURCES, means.withColumnsRenamed({"_source": own, "_steps": steps})
    drawn = documents.join(F.broadcast(means) if few else means, F.col("source").eqNullSafe(F.col(own)))
    copies = F.aggregate(
        F.sequence(F.lit(1), F.col("pieces")), F.lit(0),
        lambda n, j: n + F.size(F.filter(steps, lambda c: c <= _uniform(F.lit(seed), F.col("doc_id"), j))))
    drawn = drawn.withColumn("n_copies", copies).filter("n_copies > 0").drop(own, steps, "pieces")
    each = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    key = F.md5(F.concat_ws("|", F.lit(seed + "-order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy").cast("string")))
    return each.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents").select(*DOCUMENT))


def mixed_sql(source: str, columns: list[str]) -> str:
    named = sum(TARGETS.values())
    share = " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in TARGETS.items())
    out = ", ".join(f"d.{c}" for c in columns)
    uniform = f"CAST(CAST('0x' || substr(md5('{SEED}|' || coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || j), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0"
    return f"""
WITH sizes AS (SELECT source, sum(length(coalesce(text, ''))) AS size,
                 CASE source {share} END AS named FROM {source} GROUP BY source),
shares AS (SELECT *, coalesce(named, {1.0 - named} * size / nullif((SELECT sum(size) FROM sizes WHERE named IS NULL), 0)) AS share FROM sizes),
means AS (SELECT source, coalesce(share * {PASSES} * (SELECT sum(size) FROM sizes) / nullif(size, 0), 1.0) AS rate FROM shares),
pieces AS (SELECT *, greatest(CAST(ceil(rate / {PIECE}) AS INTEGER), 1) AS pieces FROM means),
terms AS (SELECT source, k, exp(-rate / pieces) * pow(rate / pieces, k) / gamma(k + 1.0) AS p FROM pieces, range({STEPS + 1}) AS r(k)),
steps AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
lists AS (SELECT source, list(c ORDER BY k) AS c FROM steps GROUP BY source),
u AS (SELECT d.doc_id, d.source, p.rate, l.c, {uniform} AS u
      FROM {source} d JOIN pieces p ON d.source IS NOT DISTINCT FROM p.source JOIN lists l ON d.source IS NOT DISTINCT FROM l.source,
      unnest(range(1, p.pieces + 1)) AS t(j)),
n AS (SELECT doc_id, rate, sum(len(list_filter(c, lambda x: x <= u))) AS n_copies FROM u GROUP BY doc_id, rate)
SELECT {out}, n.rate, n.n_copies, t.copy, md5('{SEED}-order|' || coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || t.copy) AS shuffle_key
FROM {source} d JOIN n ON d.doc_id IS NOT DISTINCT FROM n.doc_id, unnest(range(1, CAST(n.n_copies AS BIGINT) + 1)) AS t(copy)"""


QUERIES = {"op10_mixing": query}
ORACLES = {"op10_mixing": mixed_sql("documents", DOCUMENT).strip()}
