"""Writing results: event store, graph, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.schema import EVENT_COLUMNS, with_table
from tracewell.session import shuffles_removed


def _latest(events: DataFrame, order: list[str]) -> DataFrame:
    """The last row of every event id.

    Ids alone are counted first: rows whose id comes once, all of them as a rule, are not shuffled; the others are reduced
    in each task before the shuffle.  ``events`` is read once more for that.
    """
    ids = events.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("event_id").alias("_id"))
    with shuffles_removed(events.sparkSession):
        n = ids.count()
    if not n:
        return events
    ids = F.broadcast(ids) if n <= BROADCAST_REPLACED else ids
    repeated = F.col("event_id").eqNullSafe(F.col("_id"))
    rest = [c for c in events.columns if c != "event_id"]
    last = events.join(ids, repeated, "left_semi").groupBy("event_id").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("l")).select(
        *[F.col(c) if c == "event_id" else F.col(f"l.{c}") for c in events.columns])
    return events.join(ids, repeated, "left_anti").unionByName(last)


#: The id index is cut into so many parts by hash; a batch reads the parts of its own ids only.
ID_PARTS = 64
#: Replaced rows that are broadcast to readers (an id and a batch name each); more are joined by shuffling.
BROADCAST_REPLACED = 1_000_000


def id_part(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(ID_PARTS)).cast("int")


def in_parts_of(index: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of an index (partitioned by ``id_part``) that may hold one of ``ids``; other parts are not read."""
    parts = [r["p"] for r in ids.select(id_part(column).alias("p")).distinct().collect()]
    return index.filter(F.col("id_part").isin(parts))


def there(spark: SparkSession, path: str) -> bool:
    location = spark._jvm.org.apache.hadoop.fs.Path(path)
    return location.getFileSystem(spark._jsc.hadoopConfiguration()).exists(location)


def _commits(spark: SparkSession, path: str) -> dict[str, tuple[int, int]]:
    """Committed batches: name to (position, rows of other batches that it replaces)."""
    if not there(spark, f"{path}/commits"):
        return {}
    return {r["name"]: (r["position"], r["replaced"]) for r in spark.read.schema("name string, position bigint, replaced bigint").parquet(f"{path}/commits").collect()}


def write_events(events: DataFrame, path: str, batch: int | str = 0) -> None:
    """Store one batch of events.

    ``events`` holds the rows by batch, table and date, ``ids`` their ids by batch and hash part, ``replaced`` what a batch
    makes void: (event_id, old_batch).  A batch counts once its row in ``commits`` is there, and later commits win, whatever
    the names are.  Repeating a batch after a failure writes the same folders again and keeps its place; other batches
    are never touched.  One writer at a time.
    """
    spark, name = events.sparkSession, f"b{batch}"
    before = _commits(spark, path)
    position = before[name][0] if name in before else 1 + max((p for p, _ in before.values()), default=0)
    rows = with_table(events).withColumn("event_date", F.to_date("timestamp"))
    kept = _latest(rows.select(*EVENT_COLUMNS, "table_name", "event_date"), ["seq", "timestamp"])
    with shuffles_removed(spark):
        kept.hint("rebalance", "table_name", "event_date").write.mode("overwrite").partitionBy("table_name", "event_date").parquet(f"{path}/events/batch={name}")
        own = spark.read.schema("event_id string").parquet(f"{path}/events/batch={name}").withColumn("id_part", id_part("event_id"))
        own.repartition("id_part").write.mode("overwrite").partitionBy("id_part").parquet(f"{path}/ids/batch={name}")
    own = spark.read.schema("event_id string, id_part int").parquet(f"{path}/ids/batch={name}")
    replaced = 0
    others = {n: p for n, (p, _) in before.items() if n != name}
    if others:
        index = spark.read.schema("event_id string, batch string, id_part int").parquet(f"{path}/ids").filter(F.col("batch").isin(list(others)))
        newer = [n for n, p in others.items() if p > position]
        both = in_parts_of(index, own, "event_id").join(own.select("event_id"), "event_id")
        void = both.select("event_id", F.when(F.col("batch").isin(newer), F.lit(name)).otherwise(F.col("batch")).alias("old_batch"))
        void.distinct().write.mode("overwrite").parquet(f"{path}/replaced/batch={name}")
        replaced = spark.read.schema("event_id string, old_batch string").parquet(f"{path}/replaced/batch={name}").count()
    row = spark.range(1).select(F.lit(name).alias("name"), F.lit(position).cast("bigint").alias("position"), F.lit(replaced).cast("bigint").alias("replaced"))
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch={name}")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The stored events, one row per id: that of the latest batch.

    Only ids that came in several batches are looked up; filters on table_name and event_date prune folders, and the rows
    themselves are not shuffled while the replaced ones are few enough to be broadcast.
    """
    commits = _commits(spark, path)
    rows = spark.read.parquet(f"{path}/events").filter(F.col("batch").isin(list(commits)))
    n = sum(replaced for _, replaced in commits.values())
    if n:
        void = spark.read.schema("event_id string, old_batch string, batch string").parquet(f"{path}/replaced").filter(F.col("batch").isin(list(commits)))
        void = void.select("event_id", F.col("old_batch").alias("batch"))
        rows = rows.join(F.broadcast(void) if n <= BROADCAST_REPLACED else void, ["event_id", "batch"], "left_anti")
    return rows.drop("batch")


def compact_events(spark: SparkSession, path: str, target: str) -> None:
    """The stored events as a single batch in a new folder."""
    write_events(read_events(spark, path), target, 0)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, format: str = "parquet") -> None:
    """Node and edge tables, with the keys that a node-link viewer expects."""
    nodes.write.mode("overwrite").format(format).save(f"{path}/nodes")
    edges.write.mode("overwrite").format(format).save(f"{path}/links")


def write_report_json(reports: DataFrame, path: str) -> None:
    """One JSON document per incident and line."""
    reports.write.mode("overwrite").json(path)
