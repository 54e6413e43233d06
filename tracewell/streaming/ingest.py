"""Streams: folders, syslog, normalization, alert deduplication, event store.

The transformations are those of the batch operators; only sources and sinks differ.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewell.operators.alerts import dedupe_alerts, normalize_alerts
from tracewell.operators.normalize import normalize
from tracewell.sources.logs import keep_lines, numbered, parse_syslog, with_file
from tracewell.sources.sinks import id_part, in_parts_of, there, write_events


def watch_directory(spark: SparkSession, path: str, glob: str = "*.{log,json,txt}", max_files: int | None = None) -> DataFrame:
    """Lines of files that appear below a folder (T1): (raw_data, file, file_name, block, block_length).

    The file source looks at whole files: writers should move finished files in,
    lines appended to a file already read are not seen.  Equal lines get one event id from
    the bare stream; :func:`store_lines_stream` numbers them.
    """
    reader = spark.readStream.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return keep_lines(with_file(reader.text(path)).withColumn("file_name", F.lit("filewatch")))


def normalize_stream(lines: DataFrame, parser: str | None = None, ingest_ts: Column | str | None = None) -> DataFrame:
    """Events from a stream of raw lines, without state (T2); records without a time get the batch's time."""
    return normalize(lines, parser=parser, ingest_ts=F.current_timestamp() if ingest_ts is None else ingest_ts)


def syslog_stream(lines: DataFrame, column: str = "value", ingest_ts: Column | str | None = None) -> DataFrame:
    """Events from a stream of syslog lines."""
    return normalize_stream(parse_syslog(lines, column), ingest_ts=ingest_ts)


def _into_store(
    stream: DataFrame, store: Callable[[DataFrame, str], None], checkpoint: str, available_now: bool, interval: str
) -> StreamingQuery:
    """Run ``store`` on every micro-batch with a name of its own: the query's id, which its checkpoint keeps, and the number.

    A repeated micro-batch has the same name, one of another stream or of a new checkpoint never has.
    """
    started: Future = Future()
    writer = stream.writeStream.foreachBatch(lambda batch, number: store(batch, f"{started.result()}-{number}"))
    writer = writer.option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()
    started.set_result(query.id)
    return query


def dedupe_alerts_stream(
    documents: DataFrame, path: str, checkpoint: str, ingest_ts: Column | str | None = None, available_now: bool = True,
    interval: str = "10 seconds",
) -> StreamingQuery:
    """Store the alerts of a stream of (raw) documents, the first of every id for good (T4).

    Every micro-batch is compared with the ids stored by others, whatever times the alerts carry, so none is lost for
    being late and no id comes twice.  The store is cut by id hash, and a micro-batch reads the ids of its own parts only.
    It may be continued by a stream with another checkpoint: folders are named after the query, never overwritten by
    another one.  One stream writes at a time.
    """

    def store(batch: DataFrame, name: str) -> None:
        spark = batch.sparkSession
        alerts = normalize_alerts(batch, F.current_timestamp() if ingest_ts is None else ingest_ts)
        alerts = dedupe_alerts(alerts, "seq" if "seq" in alerts.columns else "timestamp").withColumn("id_part", id_part("id"))
        if there(spark, path):
            known = spark.read.schema("id string, batch string, id_part int").parquet(path).filter(F.col("batch") != name)
            alerts = alerts.join(in_parts_of(known, alerts, "id").select("id"), "id", "left_anti")
        alerts.repartition("id_part").write.mode("overwrite").partitionBy("id_part").parquet(f"{path}/batch={name}")

    return _into_store(documents, store, checkpoint, available_now, interval)


def store_lines_stream(
    lines: DataFrame, path: str, checkpoint: str, parser: str | None = None, ingest_ts: Column | str | None = None,
    available_now: bool = True, interval: str = "10 seconds",
) -> StreamingQuery:
    """Normalize and store a stream of whole files' lines.

    A file arrives in one micro-batch, where its lines are numbered: each is an event of its own.
    """

    def store(batch: DataFrame, name: str) -> None:
        rows = numbered(batch)
        ingest = F.current_timestamp() if ingest_ts is None else ingest_ts
        write_events(normalize(rows, parser=parser, ingest_ts=ingest), path, name)

    return _into_store(lines, store, checkpoint, available_now, interval)


def upsert_events_stream(
    events: DataFrame, path: str, checkpoint: str, available_now: bool = True, interval: str = "10 seconds"
) -> StreamingQuery:
    """Store a stream of events by id (T5); a repeated micro-batch rewrites its own folders, and no others."""
    return _into_store(events, lambda batch, name: write_events(batch, path, name), checkpoint, available_now, interval)
