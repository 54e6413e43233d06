"""Reading logs and alerts: lines, documents, folders, syslog, Windows event XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell import fixed_values as V
from tracewell.functions.text import canonical_json
from tracewell.session import durable

_LINE_FILES = "*.{jsonl,log,ndjson}"
_DOCUMENT_FILES = "*.json"


#: Up to so many splits of files go to every task: about 150 bytes each.
BROADCAST_SPLITS = 500_000


def with_file(df: DataFrame) -> DataFrame:
    """value, file, file_name, and the place (block, block_length) of the split of the file that a line begins in."""
    return df.select("value", *(F.col(f"_metadata.{name}").alias(alias) for name, alias in (
        ("file_path", "file"), ("file_name", "file_name"), ("file_block_start", "block"), ("file_block_length", "block_length"))))


def keep_lines(df: DataFrame) -> DataFrame:
    """(value, ...) text rows to (raw_data, ...), trimmed, blank ones dropped."""
    rest = [c for c in df.columns if c != "value"]
    trimmed = F.btrim(F.col("value"), F.lit(" \t\n\r\x0b\x0c"))
    return df.select(trimmed.alias("raw_data"), *rest).filter("raw_data <> ''")


def read_lines(spark: SparkSession, path: str, glob: str = _LINE_FILES) -> DataFrame:
    """One row per non-blank line (S1); large files are split, so one file is many tasks."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path)
    # a file has a split more than it fills, at most
    splits = len(files.inputFiles()) + files.rdd.getNumPartitions()
    return numbered(keep_lines(with_file(files)), splits)


def numbered(lines: DataFrame, splits: int | None = None) -> DataFrame:
    """Lines as read by a scan, with ``seq``, their order inside a task, and ``line``, their number in the file (from 0, without blank ones).

    A task reads the lines of a split in order.  So a line's number is its place in the split plus the lines of the
    file's splits before it: one row a split is counted and sent back, no line is shuffled, and a line repeated by
    millions is no group.  (file, line) names a record whatever splits the file was read in.

    ``splits`` bounds the number of splits; without it they are counted first.  The files are read twice, and must be cut
    alike both times: where executors come and go, set ``spark.sql.files.minPartitionNum``.  A read that was cut
    otherwise fails, it gives no other numbers.
    """
    placed = lines.withColumn("seq", F.monotonically_increasing_id())
    found = placed.groupBy("file", "block", "block_length").agg(F.min("seq").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if splits is None:
        found = durable(found)
        splits = found.count()
    if splits <= BROADCAST_SPLITS:
        found = F.broadcast(found)
    place = F.col("seq") - F.col("_first")
    number = F.when((place >= 0) & (place < F.col("_n")), F.col("_before") + place).otherwise(
        F.raise_error(F.lit("files were cut into other splits while they were read; set spark.sql.files.minPartitionNum")))
    both = placed.join(found, ["file", "block", "block_length"], "left")
    return both.select(*[c for c in placed.columns if c not in ("block", "block_length")], number.alias("line"))


def explode_documents(df: DataFrame) -> DataFrame:
    """Whole-file JSON (value, ...) to one row per element of an array, or one for an object.

    A record is kept as JSON with sorted keys: the place of a key in a document names no other record.  ``line`` is its
    place in the document.
    """
    rest = [c for c in df.columns if c not in ("value", "block", "block_length")]
    doc = df.withColumn("_doc", F.try_parse_json("value"))
    items = F.try_variant_get(F.col("_doc"), "$", "array<variant>")
    listed = F.when(F.startswith(F.ltrim("value"), F.lit("[")), items).otherwise(F.array("_doc"))
    items = doc.select(*rest, F.posexplode(listed).alias("_at", "_item")).filter(F.col("_item").isNotNull())
    return items.select(
        canonical_json(F.to_json("_item")).alias("raw_data"), *rest, F.monotonically_increasing_id().alias("seq"), F.col("_at").cast("bigint").alias("line"))


def read_documents(spark: SparkSession, path: str, glob: str = _DOCUMENT_FILES) -> DataFrame:
    """Records of ``.json`` files, each of which is one document."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
    return explode_documents(with_file(reader.text(path, wholetext=True)))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """All logs below a folder, or one file (S3): (raw_data, file, file_name, seq, line).

    Order by (file, seq) to walk through the files as they stand.
    """
    return read_lines(spark, path).unionByName(read_documents(spark, path))


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alert documents of a file or folder: (raw, seq), for normalize_alerts (S4); ``seq`` orders by file, then position."""
    lines = read_lines(spark, path, "*.{jsonl,ndjson}")
    docs = read_documents(spark, path)
    return lines.unionByName(docs).select(F.col("raw_data").alias("raw"), F.struct("file", "seq").alias("seq"))


def parse_syslog(df: DataFrame, column: str = "value") -> DataFrame:
    """Syslog lines to raw records (S6); works on batch and streaming frames alike.

    A line of the form ``<pri>[1 ]time host app pid id - message`` becomes its
    parts; other lines are taken as JSON, or as a bare message.
    """
    line, rest = F.col(column), [c for c in df.columns if c != column]
    part = lambda i: F.regexp_extract(line, V.SYSLOG_PATTERN, i)
    names = ["priority", "timestamp", "host", "app", "pid", "message"]
    record = F.to_json(F.struct(*[part(i + 1).alias(n) for i, n in enumerate(names)], F.lit("syslog").alias("raw_source")))
    bare = F.to_json(F.struct(line.alias("message"), F.lit("syslog").alias("raw_source")))
    is_json = F.startswith(F.ltrim(line), F.lit("{")) & F.try_parse_json(line).isNotNull()
    raw = F.when(line.rlike(V.SYSLOG_PATTERN), record).when(is_json, line).otherwise(bare)
    return df.select(raw.alias("raw_data"), *rest)


_EVENT_XML = T.StructType([
    T.StructField("System", T.StructType([
        T.StructField("Provider", T.StructType([T.StructField("_Name", T.StringType())])),
        T.StructField("EventID", T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_Qualifiers", T.StringType())])),
        T.StructField("TimeCreated", T.StructType([T.StructField("_SystemTime", T.StringType())])),
        T.StructField("Channel", T.StringType()),
        T.StructField("Computer", T.StringType()),
    ])),
    T.StructField("EventData", T.StructType([
        T.StructField("Data", T.ArrayType(T.StructType([
            T.StructField("_Name", T.StringType()), T.StructField("_VALUE", T.StringType()),
        ]))),
    ])),
])


def windows_event_xml(df: DataFrame, column: str = "value") -> DataFrame:
    """Windows events exported as XML to flat raw records (S5); malformed ones are skipped."""
    rest = [c for c in df.columns if c != column]
    # as the item of an array, since a filter on a plain column would go below it and parse the text again
    parsed = F.array(F.from_xml(F.col(column), _EVENT_XML, {"mode": "PERMISSIVE"}))
    event = df.select("*", F.explode_outer(parsed).alias("_e")).filter(F.col("_e.System").isNotNull())
    system = F.struct(
        F.col("_e.System.EventID._VALUE").alias("EventID"), F.col("_e.System.Computer").alias("Computer"),
        F.col("_e.System.Channel").alias("Channel"), F.col("_e.System.TimeCreated._SystemTime").alias("TimeCreated"),
        F.coalesce("_e.System.Provider._Name", F.lit("Windows")).alias("source"),
    )
    named = F.filter("_e.EventData.Data", lambda d: d["_Name"].isNotNull() & d["_VALUE"].isNotNull())
    # of several values under one name the last one counts, and a value overrides a header of its name
    last = F.filter(named, lambda d, i: ~F.exists(
        F.slice(named, i + 2, F.greatest(F.size(named), F.lit(1))), lambda other: other["_Name"] == d["_Name"]))
    data = F.to_json(F.map_from_entries(F.transform(last, lambda d: F.struct(d["_Name"], d["_VALUE"]))))
    headers = ["EventID", "Computer", "Channel", "TimeCreated", "source"]
    names = F.coalesce(F.transform(named, lambda d: d["_Name"]), F.array().cast("array<string>"))
    kept = F.struct(*[F.when(~F.array_contains(names, h), system[h]).alias(h) for h in headers])
    head = F.to_json(kept)
    merged = F.when(
        F.coalesce(F.size(last), F.lit(0)) > 0,
        F.concat(
            F.substring(head, 1, F.length(head) - 1), F.when(F.length(head) > 2, F.lit(",")).otherwise(F.lit("")),
            F.substring(data, 2, F.length(data)),
        ),
    ).otherwise(head)
    return event.select(merged.alias("raw_data"), *rest)
