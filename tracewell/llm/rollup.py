"""Token counts: totals by source, language and tokenizer version, maintained by signed deltas.

A ``TokenRollup`` is a folder of three tables, all partitioned by batch:

* ``ledger``: what each (doc_id, tokenizer) contributes after the batch that changed it -- source, lang, tokens, live;
* ``deltas``: signed sums of docs and tokens for each (source, lang, tokenizer) that the batch touched;
* ``commits``: one row for each committed batch, with a fingerprint of its changes.

A batch of changes (doc_id, tokenizer, source, lang, n_tokens, op) is compared with the ledger: an insert or a revised
count adds its new contribution and takes back the one that the ledger holds, a delete only takes back.  So an insert
of a document that is there already revises it, a revision of an unknown one inserts it, and a delete of an unknown one
changes nothing.  The commit row comes last: readers see committed batches only, a batch that died half way is written
again over its remains, and a repeated batch is recognised by its number and left out.  Batches apply in the order in which
they are committed, whatever their numbers: what a late one finds is the ledger as it then is.  The same number with other
changes is an error.  Totals are sums of deltas, so they are additive and never need the documents again.

Only keys and counts are shuffled, never texts; a source of a third of all rows is summed before the shuffle.  Nulls are
values of their own in source, lang, tokenizer and doc_id; a null count or text counts 0; of several changes of one
key in one batch the one with the largest ``seq`` (then op, tokens, source, lang) holds.  Totals of 0 documents are left
out.  Other columns of the changes are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.tables import BLANK, shared_folder, table, trimmed

KEY = ["doc_id", "tokenizer"]
GROUP = ["source", "lang", "tokenizer"]
LEDGER = "doc_id bigint, tokenizer string, source string, lang string, n_tokens bigint, live boolean, batch bigint"
DELTAS = "source string, lang string, tokenizer string, d_docs bigint, d_tokens bigint, batch bigint"
COMMITS = "fingerprint string, n_changes bigint, position bigint, batch bigint"
#: Commits that are broadcast with what they bring; longer lists are joined by shuffling.
BROADCAST_COMMITS = 100_000

#: Tokenizer versions that need no vocabulary: words, and runs of letters, runs of digits and single other characters.
PIECES = r"\p{L}+|\p{N}+|[^\p{L}\p{N} \t-\r]"
TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "words-1": lambda text: F.when(trimmed(text) == "", F.lit(0)).otherwise(F.size(F.split(trimmed(text), BLANK + "+"))),
    "pieces-2": lambda text: F.coalesce(F.regexp_count(text, F.lit(PIECES)), F.lit(0)),
}


def counted(documents: DataFrame, tokenizer: str, counter: Callable[[Column], Column], op: str = "insert") -> DataFrame:
    """Changes that insert (or revise) the documents' counts under one tokenizer version."""
    return documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.lit(tokenizer).alias("tokenizer"), "source", "lang",
        counter(F.col("text")).cast("bigint").alias("n_tokens"), F.lit(op).alias("op"), F.lit(0).alias("seq"))


def bpe_counter(vocabulary: str, pattern: str) -> Callable[[Column], Column]:
    """Counts tokens by a byte-pair vocabulary (a tiktoken file that every executor can read), in Arrow batches."""
    import pandas as pd

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        import tiktoken
        from tiktoken.load import load_tiktoken_bpe

        encoding = tiktoken.Encoding(name="given", pat_str=pattern, mergeable_ranks=load_tiktoken_bpe(vocabulary), special_tokens={})
        return texts.map(lambda t: 0 if t is None else len(encoding.encode_ordinary(t)))

    return lambda text: count(F.coalesce(text, F.lit("")))


class TokenRollup:
    """The three tables of a rollup below one shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(f"{self.folder}/{name}")

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def commits(self) -> DataFrame:
        return self._read("commits", COMMITS)

    def _committed(self, name: str, schema: str) -> DataFrame:
        """Rows of committed batches with the ``position`` of their commit; the batch numbers become a partition filter of the scan."""
        commits = self.commits().select("batch", "position")
        return self._read(name, schema).join(F.broadcast(commits) if commits.count() <= BROADCAST_COMMITS else commits, "batch")

    def contributions(self) -> DataFrame:
        """What each (doc_id, tokenizer) contributes now, deleted ones included."""
        latest = self._committed("ledger", LEDGER).groupBy(*KEY).agg(
            F.max_by(F.struct("source", "lang", "n_tokens", "live"), "position").alias("now"))
        return latest.select(*KEY, "now.*")

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Apply a batch; False if it was committed before."""
        one = Window.partitionBy(*KEY).orderBy(*(F.col(c).desc_nulls_last() for c in ("seq", "op", "n_tokens", "source", "lang")))
        given = changes.select(
            *KEY, "source", "lang", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"), "op", "seq")
        given = given.withColumn("_k", F.row_number().over(one)).filter("_k = 1").select(
            *KEY, "source", "lang", "n_tokens", (F.coalesce("op", F.lit("insert")) != "delete").alias("live"))
        before = {r["batch"]: r for r in self.commits().filter(F.col("batch") == batch).collect()}
        old = self.contributions()
        joined = given.alias("g").join(
            old.alias("o"), F.col("g.doc_id").eqNullSafe(F.col("o.doc_id")) & F.col("g.tokenizer").eqNullSafe(F.col("o.tokenizer")), "left")
        if batch not in before:
            # the ledger of a batch says what it changed, so the deltas and the fingerprint are read from there
            self._write(joined.select(
                "g.*", F.coalesce("o.live", F.lit(False)).alias("was_live"), F.col("o.source").alias("was_source"),
                F.col("o.lang").alias("was_lang"), F.coalesce("o.n_tokens", F.lit(0)).alias("was_tokens")), "ledger", batch)
            applied = self.spark.read.parquet(f"{self.folder}/ledger/batch={batch}")
            print_of = self._fingerprint(applied)
            plus = applied.filter("live").select(*GROUP, F.lit(1).alias("d"), F.col("n_tokens").alias("t"))
            minus = applied.filter("was_live").select(
                F.col("was_source").alias("source"), F.col("was_lang").alias("lang"), "tokenizer", F.lit(-1).alias("d"), (-F.col("was_tokens")).alias("t"))
            deltas = plus.unionByName(minus).groupBy(*GROUP).agg(F.sum("d").alias("d_docs"), F.sum("t").alias("d_tokens"))
            self._write(deltas, "deltas", batch)
            position = 1 + (self.commits().agg(F.max("position")).first()[0] or 0)
            self._write(self.spark.createDataFrame([(*print_of, position)], "fingerprint string, n_changes bigint, position bigint"), "commits", batch)
            return True
        if tuple(self._fingerprint(given)) != (before[batch]["fingerprint"], before[batch]["n_changes"]):
            raise ValueError(f"batch {batch} was committed with other changes")
        return False

    @staticmethod
    def _fingerprint(changes: DataFrame) -> tuple:
        columns = [*KEY, "source", "lang", "n_tokens", "live"]
        row = changes.agg(F.bit_xor(F.xxhash64(*columns)).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), *columns)).alias("b"),
                          F.count(F.lit(1)).alias("n")).first()
        return f"{row['a']}:{row['b']}", row["n"]

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens, n_batches (batches that touched the group)."""
        summed = self._committed("deltas", DELTAS).groupBy(*GROUP).agg(
            F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_batches"))
        return summed.filter("n_docs <> 0")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents under the first tokenizer; texts judged bad leave; the rest moves to the second; one batch comes twice."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rollup = TokenRollup(spark, shared_folder(spark, "token-rollup"))
    first, second = TOKENIZERS
    rollup.commit(0, counted(documents, first, TOKENIZERS[first]))
    bad = documents.join(labels.filter("quality = 0").select("doc_id"), "doc_id", "left_semi")
    rollup.commit(1, counted(bad, first, lambda text: F.lit(0), "delete"))
    moved = documents.filter("lang <> 'en'")
    rollup.commit(2, counted(moved, second, TOKENIZERS[second]).unionByName(counted(moved, first, lambda text: F.lit(0), "delete")))
    revised = counted(documents.filter("lang = 'en'").withColumn("text", F.translate("text", "|", " ")), first, TOKENIZERS[first], "revise")
    # joined after counting, and not as an anti-join, which Spark would move below the counting: texts aren't shuffled
    gone = labels.filter("quality = 0").select("doc_id", F.lit(True).alias("gone")).distinct()
    changes = revised.join(gone, "doc_id", "left").filter("gone IS NULL").drop("gone")
    rollup.commit(3, changes)
    rollup.commit(3, changes)
    return rollup.totals()


SQL = """
WITH d AS (SELECT doc_id, source, lang, text, doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) AS bad FROM documents),
w AS (SELECT *, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words,
             len(regexp_extract_all(translate(text, '|', ' '), '[^\\x20\\x09-\\x0D]+')) AS revised,
             len(regexp_extract_all(text, '\\p{L}+|\\p{N}+|[^\\p{L}\\p{N} \\t-\\r]')) AS pieces FROM d),
deltas AS (
  SELECT source, lang, 'words-1' AS tokenizer, 0 AS batch, count(*) AS d, sum(words) AS t FROM w GROUP BY 1, 2
  UNION ALL SELECT source, lang, 'words-1', 1, -count(*), -sum(words) FROM w WHERE bad GROUP BY 1, 2
  UNION ALL SELECT source, lang, 'words-1', 2, -count(*), -sum(words) FROM w WHERE lang <> 'en' AND NOT bad GROUP BY 1, 2
  UNION ALL SELECT source, lang, 'pieces-2', 2, count(*), sum(pieces) FROM w WHERE lang <> 'en' GROUP BY 1, 2
  UNION ALL SELECT source, lang, 'words-1', 3, 0, sum(revised - words) FROM w WHERE lang = 'en' AND NOT bad GROUP BY 1, 2)
SELECT source, lang, tokenizer, CAST(sum(d) AS BIGINT) AS n_docs, CAST(sum(t) AS BIGINT) AS n_tokens, count(*) AS n_batches
FROM deltas GROUP BY 1, 2, 3 HAVING sum(d) <> 0"""

QUERIES = {"op1_token_rollup": query}
ORACLES = {"op1_token_rollup": SQL.strip()}
