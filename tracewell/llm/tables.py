"""Reading the corpus tables, and where intermediate tables may be written."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.session import ensure_checkpoint_dir

#: Columns of the documents table, in order.
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]
#: Spark's setting by which a finished execution removes its shuffle files; on while an intermediate table is written.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What separates words, everywhere: space and the control characters tab to carriage return.
BLANK = r"[ \t-\r]"
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared folder that the cluster names in spark.checkpoint.dir."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` written to a table in the shared folder and read again: later work doesn't hang on executors that may be lost."""
    spark, folder = df.sparkSession, shared_folder(df.sparkSession, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(folder)
    out.stored_in = folder
    return out


def forget(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` made, once what was made of them is stored itself."""
    for df in tables:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_in)
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def unused(name: str, columns: list[str]) -> str:
    """``name`` with as many underscores before it as make it none of ``columns``."""
    taken = {c.lower() for c in columns}
    name = f"_{name}"
    while name in taken:
        name = f"_{name}"
    return name


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % F.lit(folds)


def trimmed(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit("")), F.lit(BLANKS))


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null, empty and blank texts."""
    body = trimmed(text)
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, BLANK + "+"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
