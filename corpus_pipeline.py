"""From raw documents to a training mixture: five stages, each a function (spark, docs, sf_dir) -> DataFrame.

Every stage works on all that its predecessor kept; its result is written as Parquet and read again as the next one's
documents, so a lost executor costs at most one stage.  All but the last return the columns of ``documents``:

1. quality rules: documents that break one go;
2. near-duplicates (SetSketch, shingles of five words, similarity 0.8): one document of each group stays;
3. substring dedup: passages that repeat text kept elsewhere are cut out; a document of which nothing remains stays, empty;
4. decontamination: documents that hold a benchmark item go, with the item's values or others;
5. mixing: documents are replicated to the sources' target weights and shuffled.

Null, empty, very long and repeated rows are treated as the operators say; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import decontaminate, mixing, neardup, passages, quality
from tracewell.llm.tables import DOCUMENT, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.kept_documents(docs, width=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passages.without_spans(docs, passages.repeated_spans(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]
#: Near-duplicates and passages can't be said in SQL over whole tables; the tests look at the stages' columns and ids only, and do not call run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*DOCUMENT)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
