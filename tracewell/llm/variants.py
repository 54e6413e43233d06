"""Spelling variants of words: one-edit neighbours found by generation over a reduced alphabet.

1. One pass over the texts counts words: runs of letters, A-Z lowered.  A run whose checksum with its document's id is a
   multiple of ``DROP_EVERY`` loses one letter (planted typing errors).  Each task adds its counts up before the shuffle.
2. The vocabulary are the words of ``LEAST_LENGTH`` letters and ``LEAST_COUNT`` occurrences and more.
3. Letters are hashed to ``SYMBOLS`` symbols.  Each word generates the full one-edit neighbourhood of its reduced form (itself,
   deletions, replacements, insertions), as 64-bit hashes from prefix and suffix sums, so a neighbour costs the same for
   a word of any length.
   Hashes of which a bit map of the reduced vocabulary shows that no word has them go at once.  The map has ``BITS`` bits
   whatever the vocabulary, and is broadcast; it never loses a hash, and a fuller one only lets more pass.
4. The neighbourhoods are joined with the reduced vocabulary: two words one edit apart have reduced forms at most one edit
   apart, so no pair is missed.  Candidates are verified on the original strings.
5. A word's form is its most frequent near word, if that is ``RATIO`` times as frequent.  Roots come by pointer jumping: counts
   grow fivefold with each step, so a chain has fewer than 27 steps and at most five jumps are made.

Defined results: null and empty texts have no words; rows that repeat count again; a null id counts as the text ''; words
without near words have n_near 0, no form, and themselves as root; ties go to the smaller word by code point; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.tables import stored, table
from tracewell.llm.wordbatch import mix, slices

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
DROP_EVERY = 199
#: Symbols of the reduced alphabet: the neighbourhood of a word of length L has up to (2 L + 1) * SYMBOLS members.
SYMBOLS = 8
#: Size of the bit map of reduced forms (16 MB), a power of two; each form sets two bits.
BITS = 1 << 27
#: Distinct words that a task holds before it hands their counts on.
HELD = 400_000
#: Hashes that a task generates at once.
GENERATED = 1 << 20
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def typed(doc_id: str, run: str) -> str:
    """The run as the document has it: every ``DROP_EVERY``-th one by checksum lacks a letter."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % DROP_EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def counted(documents: DataFrame) -> DataFrame:
    """word, n: the words of enough letters and their occurrences in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def batch() -> pa.RecordBatch:
            words = [w for w in held if len(w) >= LEAST_LENGTH]
            out = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for part in slices(batches):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text")):
                if text.is_valid:
                    body = text.as_buffer().to_pybytes().translate(_LOWER).decode()
                    for run, n in Counter(_RUN.findall(body)).items():
                        held[typed(doc_id, run)] += n
            if len(held) > HELD:
                yield batch()
        if held:
            yield batch()

    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id")
    return documents.select(ids, "text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _symbols(letters: np.ndarray) -> np.ndarray:
    """1 to SYMBOLS for each code point."""
    return mix(letters.astype(np.uint64) * np.uint64(_BASE)) % np.uint64(SYMBOLS) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _ended(sums: np.ndarray, length: int) -> np.ndarray:
    return mix(sums + np.uint64(length * 0xC2B2AE3D27D4EB4F % (1 << 64))).astype(np.int64)


def reduced_forms(letters: np.ndarray) -> np.ndarray:
    """The hash of the reduced form of each row of ``letters`` (words of equal length)."""
    return _ended((_symbols(letters) * _powers(letters.shape[1])).sum(axis=1, dtype=np.uint64), letters.shape[1])


def neighbourhoods(letters: np.ndarray) -> np.ndarray:
    """Hashes of all reduced words at most one edit from each row's reduced form; a row may hold one several times."""
    n, length = letters.shape
    symbols, power = _symbols(letters), _powers(length + 1)
    terms = symbols * power[:length]
    before = np.zeros((n, length + 1), dtype=np.uint64)
    np.cumsum(terms, axis=1, out=before[:, 1:])
    whole = before[:, -1:]
    after = whole - before
    choice = np.arange(1, SYMBOLS + 1, dtype=np.uint64)
    deleted = before[:, :-1] + after[:, 1:] * np.uint64(_INVERSE)
    replaced = (whole - terms)[:, :, None] + power[:length][None, :, None] * choice
    inserted = (before + after * np.uint64(_BASE))[:, :, None] + power[None, :, None] * choice
    return np.concatenate([
        _ended(deleted, length - 1), _ended(replaced.reshape(n, -1), length), _ended(inserted.reshape(n, -1), length + 1)], axis=1)


def _by_length(words: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
    """Words of equal length with their code points as rows, some at a time."""
    groups: dict[int, list[str]] = {}
    for word in words:
        groups.setdefault(len(word), []).append(word)
    for length, group in groups.items():
        step = max(1, GENERATED // ((2 * length + 2) * SYMBOLS))
        for at in range(0, len(group), step):
            part = group[at:at + step]
            yield part, np.frombuffer("".join(part).encode("utf-32-le"), np.uint32).reshape(-1, length)


def reduced_vocabulary(vocabulary: DataFrame) -> DataFrame:
    """reduced, near, near_n: each word under the hash of its reduced form."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            times = dict(zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()))
            for words, letters in _by_length(list(times)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reduced_forms(letters)), pa.array(words, pa.string()), pa.array([times[w] for w in words], pa.int64())],
                    names=["reduced", "near", "near_n"])

    return vocabulary.select("word", "n").mapInArrow(reduce, "reduced bigint, near string, near_n bigint")


def bit_map(reduced: DataFrame) -> np.ndarray:
    """The bits of all reduced forms, as BITS / 64 numbers: two for each, from either half of the hash."""
    bits = reduced.select(F.explode(F.array(F.col("reduced").bitwiseAND(BITS - 1), F.shiftrightunsigned("reduced", 32).bitwiseAND(BITS - 1))).alias("bit"))
    slots = bits.groupBy(F.shiftright("bit", 6).alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit").bitwiseAND(63).cast("int"))).alias("bits"))
    rows = slots.toArrow()
    out = np.zeros(BITS // 64, dtype=np.uint64)
    out[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _possible(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which hashes may belong to a reduced form of the vocabulary."""
    out = np.ones(hashes.shape, dtype=bool)
    for at in (hashes & np.int64(BITS - 1), (hashes.view(np.uint64) >> np.uint64(32)).astype(np.int64) & np.int64(BITS - 1)):
        out &= (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0
    return out


def generated(vocabulary: DataFrame, reduced: DataFrame) -> DataFrame:
    """reduced, word: each word under the hashes of its reduced form's neighbourhood that ``reduced`` may have, each once."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(bit_map(reduced))

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, letters in _by_length(batch.column("word").to_pylist()):
                hashes = neighbourhoods(letters)
                owner, place = np.nonzero(_possible(hashes, shared.value))
                pairs = np.unique(np.rec.fromarrays([owner.astype(np.int32), hashes[owner, place]], names="owner,hash"))
                yield pa.RecordBatch.from_arrays([pa.array(pairs.hash), pa.array(words, pa.string()).take(pa.array(pairs.owner))], names=["reduced", "word"])

    return vocabulary.select("word").mapInArrow(generate, "reduced bigint, word string")


def near_words(vocabulary: DataFrame) -> DataFrame:
    """word, near, near_n: every ordered pair of words exactly one edit apart."""
    reduced = reduced_vocabulary(vocabulary)
    candidates = generated(vocabulary, reduced).join(reduced, "reduced")
    return candidates.filter(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n")


def rooted(forms: DataFrame) -> DataFrame:
    """word, root of the words that have a form; ``forms`` has (word, form) of them, without circles."""
    now = stored(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = stored(now.join(up, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "variant-roots")
        now = further.select("word", "root")
        if further.filter("_moved").isEmpty():
            return now


def variants(documents: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary."""
    vocabulary = stored(counted(documents).filter(F.col("n") >= LEAST_COUNT), "variant-vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    near = near_words(vocabulary).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    joined = vocabulary.join(near, "word", "left")
    frequent = -F.col("best.minus") >= RATIO * F.col("n")
    found = stored(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(frequent, F.col("best.near")).alias("form"), F.when(frequent, -F.col("best.minus")).alias("form_n")), "variant-forms")
    roots = rooted(found.filter("form IS NOT NULL"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


QUERIES = {"op12_spelling_variants": query}
ORACLES: dict[str, str] = {}
