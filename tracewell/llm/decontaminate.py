"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of tokens: words in lower case (A-Z and the accented letters of Latin-1) without the punctuation
around them, and the typed placeholders NUM (numbers and number words), NAME (capitalised words inside a sentence) and UNIT (units of measure).  Neighbours of one
placeholder type are one token.  So a question keeps its sequence when it is asked again with other numbers, names or
units.  A capitalised word that begins a sentence may be a name or not, so a text with such words has a second
reading, in which those that are no known function words are NAMEs too ("Anna has 3 apples." asks what "Ben has 5 apples." asks); each
reading of an item is compared with the same reading of the documents.  Windows of ``WINDOW`` tokens of documents and
benchmark items are joined by their hash.  Matches of one item at
nearly one offset (a few words may be left out or put in) are a cell, those at one offset without a gap are a run.  The slots
of either must be consistent, that is, a value that comes twice in the item stands for one value in the document.  A document
holds an item if it has

* a cell with the share ``COVERAGE`` of the item's windows, or with that share of its tokens and ``LONG_RUN`` of them at least;
* cells that have that share of the windows together, wherever they stand;
* or a run of ``LONG_RUN`` tokens, whatever share of the item it is.

Benchmark items that have the same sequence and the same pattern of equal slots are one template, compared once, however many
there are.  The windows of the templates, if at most ``FILTER_WINDOWS`` (counted first), go to the scan as a filter and
only windows that pass are shuffled; with more of them all windows are shuffled.  A window that a third of the documents
holds meets the rows of the templates that hold it, nothing else.

Defined results: null, empty and short texts (fewer than ``LEAST_WINDOW`` tokens) match nothing, as do such items; items of
fewer tokens than a window are one window; windows with more than half of placeholders do not count, but of an item that
has no others they count with their very values, so that it is found word for word; repeated rows match alike; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.tables import stored, table
from tracewell.llm.wordbatch import Words, mix, shingles, slices, within

WINDOW, LEAST_WINDOW = 8, 4
#: Share of an item that must be found, how many tokens in a row do whatever their share, and how far offsets of one place may lie apart.
COVERAGE = 0.5
LONG_RUN = 13
DRIFT = 16
#: Up to so many benchmark windows are sent to the scan: 8 bytes each.
FILTER_WINDOWS = 2_000_000

LITERAL, NUM, NAME, UNIT = range(4)
# Words that count as numbers, and units of measure.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half twice"
).split()
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound "
    "pounds ton tons ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week "
    "weeks month months year years dollar dollars euro euros cent cents percent % degree degrees meter meters metre metres "
    "kilometer kilometers centimeter centimeters km/h mph"
).split()
# English function words, and words that open questions, which name nobody at the head of a sentence.
OPENERS = (
    "a an the this that these those it its he she they we you i his her their our your my there here if when while where "
    "what which who whom whose why how after before since until because although though as at by for from in into of on to "
    "with without about under over between during each every all both some any many much more most few several no not and "
    "or but so then thus also is are was were be been has have had do does did can could will would shall should may might "
    "must let given suppose find calculate compute i'm i've i'll it's he's she's that's there's what's let's don't"
).split()
_OPEN, _CLOSE, _STOP = (np.isin(np.arange(256), list(x)) for x in (b"(\"'[{<*", b".,;:!?)\"'*]}>", b".!?:"))


def _hashes(words: list[str]) -> np.ndarray:
    return np.sort(Words(pa.array([" ".join(words)])).hashes)


def _is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


class Lexicon:
    """Sorted hashes of the word lists."""

    def __init__(self) -> None:
        self.numbers, self.units, self.openers = _hashes(NUMBER_WORDS), _hashes(UNITS), _hashes(OPENERS)


class Templates:
    """Canonical sequences of texts: ``tokens`` and ``slots`` (hash of the value, 0 for words); ``first`` as in Words.

    ``reading`` 0 takes words that begin a sentence as words, 1 takes them as names if they are capitalised and no openers.
    """

    def __init__(self, reading: int, n: int, tokens: np.ndarray, slots: np.ndarray, kinds: np.ndarray, first: np.ndarray):
        self.reading, self.n, self.tokens, self.slots, self.kinds, self.first = reading, n, tokens, slots, kinds, first

    @classmethod
    def readings(cls, texts: pa.Array, lexicon: Lexicon) -> list[Templates]:
        """Both readings of the texts."""
        words = Words(texts)
        raw = np.frombuffer(words.bytes + bytes(8), dtype=np.uint8)
        starts, ends = words.starts.copy(), words.ends.copy()
        last = raw[np.maximum(ends - 1, 0)]
        for table_, step in ((_CLOSE, -1), (_OPEN, 1)):
            todo = np.arange(len(starts))
            while len(todo):
                at = ends[todo] - 1 if step < 0 else starts[todo]
                todo = todo[(ends[todo] > starts[todo]) & table_[raw[at]]]
                (ends if step < 0 else starts)[todo] += step
        words.starts, words.ends = starts, ends
        lowered = np.frombuffer(words.lowered + bytes(8), dtype=np.uint8).copy()
        accented = np.flatnonzero((lowered[:-1] == 0xC3) & (lowered[1:] >= 0x80) & (lowered[1:] <= 0x9E)) + 1
        lowered[accented] += 32
        value = words._hash(lowered)
        one, two = raw[starts], raw[np.minimum(starts + 1, len(raw) - 1)]
        digit = (one >= 48) & (one <= 57) | np.isin(one, list(b"$+-")) & (two >= 48) & (two <= 57)
        # a name begins with a capital and has a small letter: a text all in capitals has no names
        small = (raw[1:] >= 97) & (raw[1:] <= 122) | (raw[:-1] == 0xC3) & (raw[1:] >= 0xA0) & (raw[1:] <= 0xBE)
        smalls = np.concatenate([[0, 0], np.cumsum(small, dtype=np.int32)])
        capital = (one >= 65) & (one <= 90) | (one == 0xC3) & (two >= 0x80) & (two <= 0x9E)
        capital &= smalls[ends] > smalls[starts]
        lines = np.searchsorted(np.flatnonzero(raw == 10), starts)
        begins = np.ones(len(starts), dtype=bool)
        begins[1:] = _STOP[last[:-1]] | (lines[1:] != lines[:-1])
        begins[words.first[:-1][words.first[:-1] < len(starts)]] = True
        heads = capital & begins & ~_is_in(value, lexicon.openers)
        unit, number = _is_in(value, lexicon.units), digit | _is_in(value, lexicon.numbers)
        out = []
        for reading, names in enumerate((capital & ~begins, capital & ~begins | heads)):
            kind = np.zeros(len(starts), dtype=np.int8)
            kind[names] = NAME
            kind[unit] = UNIT
            kind[number] = NUM
            kind[ends == starts] = LITERAL
            out.append(cls._joined(reading, words, kind, value))
        return out

    @classmethod
    def _joined(cls, reading: int, words: Words, kind: np.ndarray, value: np.ndarray) -> Templates:
        """Neighbours of one placeholder type become one token."""
        joined = np.zeros(len(kind), dtype=bool)
        joined[1:] = (kind[1:] > 0) & (kind[1:] == kind[:-1])
        joined[words.first[:-1][words.first[:-1] < len(kind)]] = False
        keep = np.flatnonzero(~joined)
        group = np.cumsum(~joined) - 1
        slots = np.zeros(len(keep), dtype=np.uint64)
        np.add.at(slots, group, np.where(kind > 0, mix(value ^ np.uint64(7)), np.uint64(0)))
        kinds = kind[keep]
        tokens = np.where(kinds > 0, mix(kinds.astype(np.uint64)), value[keep])
        return cls(reading, words.n, tokens, slots, kinds, np.searchsorted(keep, words.first))

    def text(self, i: int) -> Templates:
        """The i-th text alone."""
        a, b = self.first[i], self.first[i + 1]
        return Templates(self.reading, 1, self.tokens[a:b], self.slots[a:b], self.kinds[a:b], np.array([0, b - a]))

    def windows(self, width: int, crowded: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the windows that lie in one text and have words enough, or of the others with the values of their slots."""
        if len(self.tokens) < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        inside, _ = within(self.first, width, len(self.tokens))
        placeholders = np.concatenate([[0], np.cumsum(self.kinds > 0)])
        many = 2 * (placeholders[width:] - placeholders[:-width]) > width
        inside &= many if crowded else ~many
        tokens = np.where(self.kinds > 0, self.slots, self.tokens) if crowded else self.tokens
        return np.flatnonzero(inside), shingles(tokens, width)[inside] ^ np.uint64(width + 1000 * self.reading + 2000 * crowded)

    def owner(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, starts, side="right") - 1


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _rows(found: Templates, starts: np.ndarray, hashes: np.ndarray, width: int, ids: pa.Array, names: list[str]) -> pa.RecordBatch:
    owner = found.owner(starts)
    index = starts[:, None] + np.arange(width)
    values = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1) * width, pa.int32()), _signed(found.slots[index].ravel()))
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(owner)), _signed(hashes), pa.array(starts - found.first[owner]), values], names=names)


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id, template, n_windows, n_tokens, width, hash, at, slots: the windows of every item's readings; ``template`` names sequence and pattern of slots."""
    lexicon = Lexicon()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            plain, named = Templates.readings(part.column("text"), lexicon)
            for i in range(plain.n):
                both = [plain.text(i), named.text(i)]
                if np.array_equal(both[0].kinds, both[1].kinds):
                    del both[1]
                for one in both:
                    width = min(WINDOW, len(one.tokens))
                    if width < LEAST_WINDOW:
                        continue
                    starts, hashes = one.windows(width)
                    if not len(starts) and one.reading == 0:
                        starts, hashes = one.windows(width, crowded=True)
                    _, pattern = np.unique(one.slots, return_inverse=True)
                    order = {}
                    pattern = [order.setdefault(p, len(order)) for p in pattern.tolist()]
                    # the hashes tell readings and values apart
                    name = f"{one.tokens.tobytes().hex()}:{pattern}:{hashes[:1].tobytes().hex()}"
                    rows = _rows(one, starts, hashes, width, part.column("item_id").slice(i, 1), ["item_id", "hash", "at", "slots"])
                    n = len(starts)
                    yield rows.append_column("name", pa.array([name] * n, pa.string())).append_column(
                        "n_windows", pa.array([n] * n, pa.int64())).append_column("width", pa.array([width] * n, pa.int32())).append_column(
                        "n_tokens", pa.array([len(one.tokens)] * n, pa.int64()))

    kind = benchmark.schema["item_id"].dataType.simpleString()
    made = benchmark.select("item_id", "text").mapInArrow(
        make, f"item_id {kind}, hash bigint, at bigint, slots array<bigint>, name string, n_windows bigint, width int, n_tokens bigint")
    return made.withColumn("template", F.sha2("name", 256)).drop("name")


def document_windows(documents: DataFrame, widths: list[int], wanted: np.ndarray | None) -> DataFrame:
    """doc_id, hash, pos, found: windows of the documents, only those in ``wanted`` if it is given (sorted hashes)."""
    lexicon = Lexicon()
    bits = None
    if wanted is not None:
        bits = max(10, int(len(wanted) * 16).bit_length())
    context = documents.sparkSession.sparkContext
    shared = context.broadcast(wanted)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        if known is not None:
            few = np.zeros(1 << bits, dtype=bool)
            few[known & np.uint64((1 << bits) - 1)] = True
        for part in slices(batches):
            plain, named = Templates.readings(part.column("text"), lexicon)
            for width, found, crowded in [(w, *x) for w in widths for x in ((plain, False), (named, False), (plain, True))]:
                starts, hashes = found.windows(width, crowded)
                if known is not None:
                    maybe = np.flatnonzero(few[hashes & np.uint64((1 << bits) - 1)])
                    maybe = maybe[_is_in(hashes[maybe], known)]
                    starts, hashes = starts[maybe], hashes[maybe]
                if len(starts):
                    yield _rows(found, starts, hashes, width, part.column("doc_id"), ["doc_id", "hash", "pos", "found"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, hash bigint, pos bigint, found array<bigint>")


def _judged(hits: DataFrame, key: list[str]) -> DataFrame:
    """key, at (distinct, sorted), n_windows, n_tokens, width, same_values of the groups of hits whose slots are consistent."""
    places = hits.groupBy(*key).agg(
        F.array_sort(F.collect_set("at")).alias("at"), *(F.first(c).alias(c) for c in ("n_windows", "n_tokens", "width")))
    values = hits.select(*key, F.explode("pairs").alias("p")).select(*key, "p.slots", "p.found").distinct()
    consistent = values.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("slots").alias("n_values"),
        F.min((F.col("slots") == F.col("found"))).alias("same"))
    right = consistent.withColumnsRenamed({c: f"_{c}" for c in key})
    match = F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    for c in key[1:]:
        match &= F.col(c) == F.col(f"_{c}")
    both = places.join(right, match, "left").filter(F.coalesce("n_pairs", F.lit(0)) == F.coalesce("n_values", F.lit(0)))
    return both.select(*key, "at", "n_windows", "n_tokens", "width", F.coalesce("same", F.lit(True)).alias("same_values"))


#: Tokens below the windows at the sorted places ``at``.
_COVERED = """aggregate(at, named_struct('n', 0L, 'end', 0L), (a, x) -> named_struct(
    'n', a.n + x + width - greatest(a.end, x), 'end', x + width), a -> a.n)"""


def contaminated(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, n_found, n_windows, same_values for every document that holds an item or much of it, be it with other values."""
    windows = stored(item_windows(benchmark), "benchmark-windows")
    items = windows.select("template", "item_id").distinct()
    speaker = items.groupBy("template").agg(F.min("item_id").alias("item_id"))
    templates = windows.join(speaker, ["template", "item_id"], "left_semi").drop("item_id").dropDuplicates(["template", "at"])
    widths = [r["width"] for r in windows.select("width").distinct().orderBy("width").collect()]
    hashes = windows.select("hash").distinct()
    wanted = None
    if hashes.count() <= FILTER_WINDOWS:
        wanted = np.sort(np.array([r["hash"] for r in hashes.collect()], dtype=np.int64).view(np.uint64))
    hits = document_windows(documents, widths, wanted).join(templates, "hash")
    slots = F.filter(F.arrays_zip("slots", "found"), lambda s: s["slots"] != 0)
    slim = stored(hits.select(
        "doc_id", "template", "at", (F.col("pos") - F.col("at")).alias("apart"), "n_windows", "n_tokens", "width", slots.alias("pairs")), "benchmark-hits")
    # two grids, half a cell apart: offsets that are close share a cell of one of them
    grids = F.array(2 * F.floor(F.col("apart") / DRIFT), 2 * F.floor((F.col("apart") + DRIFT // 2) / DRIFT) + 1)
    cells = stored(_judged(slim.withColumn("offset", F.explode(grids)), ["doc_id", "template", "offset"]), "benchmark-cells")
    row = ["doc_id", "template", "n_windows", "n_found", "same_values"]
    sized = cells.withColumns({"n_found": F.size("at").cast("bigint"), "covered": F.expr(_COVERED)})
    at_one_place = sized.filter((F.col("n_found") >= coverage * F.col("n_windows")) | (
        F.col("covered") >= F.greatest(F.lit(LONG_RUN), coverage * F.col("n_tokens")))).select(F.lit(True).alias("one"), *row)
    together = cells.select("doc_id", "template", "n_windows", "same_values", F.explode("at").alias("at")).groupBy(
        "doc_id", "template").agg(F.first("n_windows").alias("n_windows"), F.count_distinct("at").alias("n_found"), F.min("same_values").alias("same_values"))
    together = together.filter(F.col("n_found") >= coverage * F.col("n_windows")).select(F.lit(False).alias("one"), *row)
    along = Window.partitionBy("doc_id", "template", "apart").orderBy("at")
    gap = F.coalesce(F.col("at") - F.lag("at").over(along) > F.col("width"), F.lit(False))
    runs = slim.withColumn("gap", gap.cast("int")).withColumn("run", F.sum("gap").over(along))
    runs = _judged(runs, ["doc_id", "template", "apart", "run"]).filter(
        F.element_at("at", -1) + F.col("width") - F.element_at("at", 1) >= LONG_RUN).select(
        F.lit(False).alias("one"), "doc_id", "template", "n_windows", F.size("at").cast("bigint").alias("n_found"), "same_values")
    best = at_one_place.unionByName(together).unionByName(runs).groupBy("doc_id", "template").agg(
        F.max(F.struct("one", "n_found", "same_values")).alias("best"), F.first("n_windows").alias("n_windows"))
    # of the readings of an item that a document holds, the one found best counts
    return best.join(items, "template").groupBy("doc_id", "item_id").agg(
        F.max(F.struct("best.one", "best.n_found", "n_windows", "best.same_values")).alias("best")).select(
        "doc_id", "item_id", "best.n_found", "best.n_windows", "best.same_values")


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with the columns they came with."""
    found = contaminated(documents, benchmark).select(F.col("doc_id").alias("_id")).distinct()
    return documents.join(found, documents["doc_id"].eqNullSafe(found["_id"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_decontamination": query}
ORACLES: dict[str, str] = {}
