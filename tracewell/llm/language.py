"""Language identification by compression.

Each language has a raw-content zstandard dictionary, cut from a bounded sample of labelled texts.  A text is encoded
with every dictionary and gets the language whose encoding is smallest; if the second one is nearly as small, the answer
is not accepted.  Long texts are encoded in blocks of ``BLOCK`` bytes, each by itself, because the inside of a long text
would otherwise serve as its own dictionary; the sizes of the blocks add up, so the whole text counts and memory is
bounded by one Arrow batch.

The sample has up to ``SAMPLE_TEXTS`` texts of ``SAMPLE_LENGTH`` characters for each language, those with the smallest hash of
their id: the dictionaries are a few hundred KB each and go to the executors with the function.  A language with fewer such
texts is filled up with pieces of longer texts and with shorter ones.  Of more than ``USUAL_LANGUAGES`` languages each has
fewer texts, so that the whole sample has the same bound.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text if nothing was learned;
ties go to the language with more training texts, then by name; repeated rows are judged alike; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.tables import crc_fold, table

SAMPLE_TEXTS = 96
SAMPLE_LENGTH = (120, 4000)
#: Up to so many languages have SAMPLE_TEXTS texts each; of more, each has fewer, so that the sample stays bounded.
USUAL_LANGUAGES = 250
#: Times as many longer or shorter texts fill up a language that has too few of usual length.
FILL = 8
#: Bytes of text that are encoded at once, and zstandard's level.
BLOCK = 4096
LEVEL = 3
#: An answer is accepted if the second language takes so many bytes and such a share of its size more.
MARGIN_BYTES, MARGIN_SHARE = 2, 0.01
#: Bytes that make a language e times less likely in the score.
TEMPERATURE = 4.0
_FOLDS = 5
UNDETERMINED = "und"
_NO_LETTER = re.compile(r"[\W\d_]+")


def plain(text: str | None) -> str:
    """Lower case, every run of other characters than letters a space."""
    return _NO_LETTER.sub(" ", text.lower()).strip() if text else ""


def _texts(rows: DataFrame, most: int) -> dict[str, list[str]]:
    """Up to ``most`` texts of each language, chosen by a hash of the id."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id")
    chosen = rows.select("lang", "doc_id", "text").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= most)
    texts: dict[str, list[str]] = {}
    for row in chosen.orderBy("lang", "k").collect():
        texts.setdefault(row["lang"], []).append(plain(row["text"]))
    return texts


def dictionaries(labelled: DataFrame) -> list[tuple[str, bytes]]:
    """(language, dictionary) from a bounded sample, the language with most texts first.

    Languages with too few texts of usual length are filled up with pieces of longer ones and with shorter ones.
    """
    low, high = SAMPLE_LENGTH
    known = labelled.filter("lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = min(SAMPLE_TEXTS, max(1, SAMPLE_TEXTS * USUAL_LANGUAGES // max(1, len(counts))))
    texts = _texts(known.filter(F.length("text").between(low, high)), most)
    few = [lang for lang in counts if len(texts.get(lang, [])) < most]
    if few:
        at = F.pmod(F.xxhash64("doc_id", F.lit("piece")), F.greatest(F.lit(1), F.length("text") - high + 1)).cast("int") + 1
        others = known.filter(F.col("lang").isin(few) & ~F.length("text").between(low, high)).withColumn("text", F.substring("text", at, F.lit(high)))
        for lang, more in _texts(others, most * FILL).items():
            size = sum(map(len, texts.setdefault(lang, [])))
            for text in more:
                if size < most * high // 4:
                    texts[lang].append(text)
                    size += len(text)
    found = [(lang, " ".join(t).encode()) for lang, t in texts.items()]
    return sorted(((lang, d) for lang, d in found if len(d) >= 8), key=lambda x: (-counts[x[0]], x[0]))


class Judge:
    """Encodes texts with every dictionary."""

    def __init__(self, learned: list[tuple[str, bytes]]):
        import zstandard

        self.names = [lang for lang, _ in learned]
        self.encoders = []
        for _, content in learned:
            given = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            given.precompute_compress(level=LEVEL)
            self.encoders.append(zstandard.ZstdCompressor(
                dict_data=given, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        body = text.encode()
        blocks = [body[i:i + BLOCK] for i in range(0, len(body), BLOCK)]
        return [sum(len(e.compress(b)) for b in blocks) for e in self.encoders]

    def __call__(self, text: str | None) -> tuple[str, float, bool, int, int]:
        """Language, score, accepted, bytes with the best dictionary, bytes that the second takes more."""
        body = plain(text)
        if not any(map(str.isalpha, body)) or not self.names:
            return UNDETERMINED, 0.0, False, 0, 0
        sizes = self.sizes(body)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        margin = min((s - sizes[best] for i, s in enumerate(sizes) if i != best), default=sizes[best])
        score = 1.0 / sum(2.718281828459045 ** (-min(s - sizes[best], 2000) / TEMPERATURE) for s in sizes)
        wide = margin >= MARGIN_BYTES and margin >= MARGIN_SHARE * sizes[best]
        return self.names[best], score, wide, sizes[best], margin


def identified(documents: DataFrame, learned: list[tuple[str, bytes]]) -> DataFrame:
    """doc_id, lang_pred, score, accepted, best_bytes, margin_bytes for every row."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = Judge(learned)
        for batch in batches:
            answers = [ask(t) for t in batch["text"]]
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), pd.DataFrame(
                answers, columns=["lang_pred", "score", "accepted", "best_bytes", "margin_bytes"])], axis=1)

    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, accepted boolean, best_bytes bigint, margin_bytes bigint"
    return documents.select("doc_id", "text").mapInPandas(judge, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    learned = dictionaries(documents.filter(crc_fold(F.col("doc_id"), _FOLDS) != 0))
    return identified(documents, learned).select(
        "doc_id", (crc_fold(F.col("doc_id"), _FOLDS) == 0).alias("held_out"), "lang_pred", "score", "accepted", "margin_bytes")


QUERIES = {"op4_language_id": query}
ORACLES: dict[str, str] = {}
