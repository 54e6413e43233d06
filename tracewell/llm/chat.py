"""Chat formatting: logged conversations that are snapshots of longer ones go, the others are rendered.

A log often holds the same conversation after every turn.  Each turn has a hash of (position, role, text); the hash of a
prefix is the xor of its turns' hashes, taken twice with different seeds.  A conversation whose whole hash is a proper
prefix of another one goes by an anti-join; of equal conversations the one with the smallest id stays.

Nothing gathers a conversation in one task: turns are brought into their order by ranges, equal ones spread by a tie-breaker,
and written once with their number in it.  A conversation's place in each range comes from counts by range; hashes run
inside blocks of ``BLOCK`` positions, and the totals of earlier blocks come by a join.  A conversation with a third of the
log, whatever its turn numbers, is many ranges and many blocks.  A first turn, or a conversation, that a third of the log
shares is one key in a ``distinct`` that combines before its shuffle.  The rendered text has a row for each block of a
conversation ("part"): one for nearly all of them.

Defined results: null role and text count as ''; turns come in the order of (turn, role, text), null turns first;
repeated rows are turns of their own; rows without conv_id form one conversation whose id is null.  An empty table gives
an empty table.  Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.tables import stored, table

#: Turns in a block.
BLOCK = 1024
# The marks around a turn.
START, END = "<|im_start|>", "<|im_end|>"
_SEEDS = ("a", "b")


def _before(column: str, fold) -> F.Column:
    """``fold`` of a column over the earlier blocks of the conversation."""
    return fold(column).over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))


def _join_blocks(turns: DataFrame, blocks: DataFrame) -> DataFrame:
    right = blocks.withColumnsRenamed({"conv_id": "_c", "block": "_b"})
    return turns.join(right, turns["conv_id"].eqNullSafe(right["_c"]) & (turns["block"] == right["_b"])).drop("_c", "_b")


def placed_turns(conversations: DataFrame) -> DataFrame:
    """One row for each turn: conv_id, role, text, position (from 1), block, total (turns in all)."""
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("tie"))
    order = ["conv_id", "turn", "role", "text", "tie"]
    # ranges are drawn by a sample, so that they are fixed by writing them: what is read below is one and the same order
    ordered = stored(
        turns.repartitionByRange(*order).sortWithinPartitions(*order)
        .select("conv_id", "role", "text", F.monotonically_increasing_id().alias("seq"), F.spark_partition_id().alias("range")),
        "chat-turns")
    runs = ordered.groupBy("conv_id", "range").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("conv_id").alias("_c"), F.col("range").alias("_r"), "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"),
        F.sum("n").over(Window.partitionBy("conv_id")).alias("total"))
    joined = ordered.join(runs, ordered["conv_id"].eqNullSafe(runs["_c"]) & (ordered["range"] == runs["_r"]))
    return joined.select("conv_id", "role", "text", "total", (F.expr("offset + seq - first") + 1).alias("position")).withColumn(
        "block", F.floor((F.col("position") - 1) / BLOCK))


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """One row for each turn: conv_id, block, part, position (from 1), role, text, prefix hashes pa and pb, total (turns in all)."""
    order = Window.partitionBy("conv_id", "block").orderBy("position")
    placed = placed_turns(conversations).withColumn("part", F.col("block").cast("int"))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = placed
    for s in _SEEDS:
        hashed = hashed.withColumn(f"h{s}", F.xxhash64(F.lit(s), "position", "role", "text"))
    sums = hashed.groupBy("conv_id", "block").agg(*(F.bit_xor(f"h{s}").alias(f"x{s}") for s in _SEEDS))
    sums = sums.select("conv_id", "block", *(F.coalesce(_before(f"x{s}", F.bit_xor), F.lit(0)).alias(f"x{s}") for s in _SEEDS))
    local = hashed.withColumns({f"h{s}": F.bit_xor(f"h{s}").over(upto) for s in _SEEDS})
    whole = _join_blocks(local, sums)
    return whole.select(
        "conv_id", "block", "part", "position", "role", "text", "total",
        *(F.col(f"h{s}").bitwiseXOR(F.col(f"x{s}")).alias(f"p{s}") for s in _SEEDS))


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_copies): the conversations that no other one continues, and how many equal ones each stands for."""
    key = ["position", "pa", "pb"]
    longer = prefixes.filter("position < total").select(*key).distinct()
    ends = prefixes.filter("position = total").groupBy(*key).agg(
        F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id")).alias("first"), F.count(F.lit(1)).alias("n_copies"))
    return ends.join(longer, key, "left_anti").select(F.col("first.conv_id").alias("conv_id"), "n_copies")


def collapsed(conversations: DataFrame) -> DataFrame:
    """Rendered maximal conversations: conv_id, part, n_turns (of the part), n_copies, rendered."""
    prefixes = prefix_hashes(conversations)
    kept = maximal(prefixes).withColumnRenamed("conv_id", "_c")
    turns = prefixes.join(kept, prefixes["conv_id"].eqNullSafe(kept["_c"])).drop("_c")
    segment = F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(END + "\n"))
    parts = turns.groupBy("conv_id", "block", "part", "n_copies").agg(
        F.sort_array(F.collect_list(F.struct("position", segment.alias("s")))).alias("turns"))
    return parts.select(
        "conv_id", "part", F.size("turns").alias("n_turns"), "n_copies", F.array_join("turns.s", "").alias("rendered"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapsed(table(spark, sf_dir, "conversations"))


SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, row_number() OVER w AS position, count(*) OVER (PARTITION BY conv_id) AS total FROM t
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, string_agg(role || chr(1) || text, chr(2)) OVER (PARTITION BY conv_id ORDER BY position) AS prefix FROM n),
ends AS (SELECT prefix, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE position = total GROUP BY prefix),
kept AS (SELECT * FROM ends WHERE prefix NOT IN (SELECT prefix FROM p WHERE position < total)),
b AS (SELECT p.*, kept.n_copies, (position - 1) // {BLOCK} AS part FROM p JOIN kept ON p.conv_id = kept.conv_id)
SELECT conv_id, part, count(*) AS n_turns, n_copies,
       string_agg('{START}' || role || chr(10) || text || '{END}' || chr(10), '' ORDER BY position) AS rendered
FROM b GROUP BY conv_id, part, n_copies"""

QUERIES = {"op3_chat_collapse": query}
ORACLES = {"op3_chat_collapse": SQL.strip()}
