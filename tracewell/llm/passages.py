"""Substring deduplication: paragraphs by MinHash banding, and the passages that hide inside other text.

Units of text are compared across all documents:

* paragraphs, that is lines and runs of lines between blank lines ("wrapped"), of ``LEAST_LINE`` words and more: MinHash over
  shingles of five words, in bands tuned so that
  a pair at the threshold is found with a probability of 0.999; colliding paragraphs are joined through the smallest one
  of their bucket, verified by their exact Jaccard similarity, and clustered by components; buckets that still hold
  several clusters are compared across clusters in full;
* blocks of ``BLOCK`` words that begin at anchors.  An anchor is the smallest shingle hash among ``REACH`` neighbours, so
  every passage of BLOCK + REACH - 1 = 51 words holds one wherever it stands, and equal passages have equal blocks.
  Equal blocks are clustered by their hash, and a run of them is extended word by word as far as it equals the
  occurrence that stays.

The first occurrence (smallest doc_id, then position) of a cluster stays.  Wrapped paragraphs are settled first: of a cluster
that has some, the first of these stays.  Lines inside those that go, and then blocks that touch any paragraph that goes,
can't be the occurrence that stays.  Paragraphs go whole; other spans that touch are merged, and those of fewer than
``LEAST_REMOVED`` words stay in the text, so short common phrases do no harm.  A passage that comes again in its
own document goes there too; of text that repeats itself with a period of less than ``LEAST_KEPT`` words so many words stay.

Everything keyed by a unit's hash is aggregated before it is shuffled and then joined, so a passage in a third of all
documents is spread like any other; what is gathered by document is bounded by the document's own length.

Defined results: null, empty and blank texts have no spans; repeated rows count as one document, and each loses
the same spans; rows whose id also names another text are left alone, neither cut nor kept as a first occurrence, so that
no text is cut by another one's spans; documents whose id is null are left alone; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.crowds import crowded_links, mixed_members, small_pairs
from tracewell.llm.neardup import star_pairs
from tracewell.llm.tables import forget, stored, table, unused
from tracewell.llm.wordbatch import Words, binaries, distinct_sorted, mix, shingles, slices, within
from tracewell.operators.components import star_edges

WIDTH, PERCENT = 5, 80
LEAST_LINE, LEAST_REMOVED = 20, 50
BLOCK, REACH = 24, 28
LEAST_KEPT = BLOCK + REACH - 1
RECALL = 0.999
_NEVER = np.uint64(0)


def tuned(percent: int = PERCENT, rows: int = 3, recall: float = RECALL) -> int:
    """The smallest number of bands of ``rows`` hashes that finds a pair at the threshold with probability ``recall``."""
    miss, bands = 1.0 - (percent / 100) ** rows, 1
    while 1.0 - miss**bands < recall:
        bands += 1
    return bands


ROWS = 3
BANDS = tuned()
_MULTIPLIERS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def _sliding(values: np.ndarray, width: int, fold) -> np.ndarray:
    """``fold`` over every run of ``width`` values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = fold(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return fold(out[:-rest], out[rest:]) if rest else out


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the blocks of all texts, but for those that equal and overlap their neighbours and add no word to them."""
    n = len(words.hashes)
    if n < BLOCK + REACH - 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rank = shingles(words.hashes, WIDTH)[:n - BLOCK + 1] | np.uint64(1)
    inside, _ = within(words.first, BLOCK + REACH - 1, n)
    least = np.where(inside, _sliding(rank, REACH, np.minimum), _NEVER)
    ends = np.full(REACH - 1, _NEVER)
    most = _sliding(np.concatenate([ends, least, ends]), REACH, np.maximum)
    starts = np.flatnonzero(most == rank)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    h = words.hashes.copy()
    code = np.zeros(len(starts), dtype=np.uint64)
    for k in range(BLOCK):
        code = mix(code + h[starts + k])
    # inside a chain of equal overlapping blocks, out of reach of its ends, one in BLOCK / 2 words covers all
    owner = np.searchsorted(words.first, starts, side="right") - 1
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1]) | (np.diff(starts) >= BLOCK)
    chain = np.cumsum(new) - 1
    begin, end = starts[new][chain], starts[np.append(new[1:], True)][chain]
    cell = (starts - begin) // (BLOCK // 2)
    keep = new | (starts - begin < 2 * LEAST_KEPT) | (end - starts < 2 * LEAST_KEPT)
    keep[1:] |= cell[1:] != cell[:-1]
    return starts[keep], code[keep]


def paragraphs(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end) in words of the lines and the runs of lines between blank lines that have words enough, and which are runs of several lines."""
    breaks = np.flatnonzero(np.frombuffer(words.bytes, dtype=np.uint8) == 10)
    before = np.bincount(np.searchsorted(words.starts, breaks), minlength=len(words.hashes) + 1)
    before[words.first] = 2
    line, run = np.flatnonzero(before), np.flatnonzero(before > 1)
    several = np.diff(np.searchsorted(line, run)) > 1
    begin, end = np.concatenate([line[:-1], run[:-1][several]]), np.concatenate([line[1:], run[1:][several]])
    wrapped = np.arange(len(begin)) >= len(line) - 1
    long = end - begin >= LEAST_LINE
    return begin[long], end[long], wrapped[long]


def _line_shingles(words: Words, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of the lines' shingles."""
    every = shingles(words.hashes, WIDTH)
    count = end - begin - WIDTH + 1
    offsets = np.concatenate([[0], np.cumsum(count)])
    index = np.arange(offsets[-1]) - np.repeat(offsets[:-1], count) + np.repeat(begin, count)
    return offsets, every[index]


def signatures(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A hash for each band of each line."""
    out = np.zeros((len(offsets) - 1, BANDS), dtype=np.uint64)
    for k in range(BANDS * ROWS if len(offsets) > 1 else 0):
        least = np.minimum.reduceat(values * _MULTIPLIERS[k], offsets[:-1])
        out[:, k // ROWS] = mix(out[:, k // ROWS] + least + np.uint64(k))
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def units(documents: DataFrame) -> DataFrame:
    """line (paragraph, or block), wrapped, key, doc_id, pos, n (position and length in words), bands (null for blocks)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part.column("text"))
            begin, end, wrapped = paragraphs(words)
            offsets, values = _line_shingles(words, begin, end)
            # the key of a line is that of its sequence of shingles
            position = np.arange(len(values), dtype=np.uint64) - np.repeat(offsets[:-1], np.diff(offsets)).astype(np.uint64)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values + position * np.uint64(0x9E3779B97F4A7C15)))])
            key = mix(sums[offsets[1:]] - sums[offsets[:-1]])
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(begin) + 1) * BANDS, pa.int32()), _signed(signatures(offsets, values).ravel()))
            starts, codes = anchors(words)
            for line, several, at, length, keys, more in ((True, wrapped, begin, end - begin, key, bands),
                                                 (False, np.zeros(len(starts), bool), starts, np.full(len(starts), BLOCK), codes, pa.nulls(len(starts), pa.list_(pa.int64())))):
                owner = np.searchsorted(words.first, at, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), line)), pa.array(several), _signed(keys), part.column("doc_id").take(pa.array(owner)),
                     pa.array((at - words.first[owner]).astype(np.int32)), pa.array(length.astype(np.int32)), more],
                    names=["line", "wrapped", "key", "doc_id", "pos", "n", "bands"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").filter("doc_id IS NOT NULL").mapInArrow(
        scan, f"line boolean, wrapped boolean, key bigint, doc_id {kind}, pos int, n int, bands array<bigint>")


_KEPT, _LEFT, _RIGHT, _SET = range(4)


def details(documents: DataFrame, requests: DataFrame) -> DataFrame:
    """What the comparison needs of the texts asked for: contexts of blocks that stay, contexts of runs to remove, shingle sets of lines.

    ``requests``: doc_id, asked (array of line, pos, n, key, keep_doc, keep_pos), gone (array of begin, end: what goes anyway,
    contexts of blocks that stay end there; may be null).
    Result: kind, key, doc_id, begin, end, words (binary: hashes of the words beside a block, nearest first, or of shingles),
    skip (words at the begin of a run that belong to the occurrence that stays, because both overlap).
    """

    def beside(hashes: np.ndarray, a: int, b: int, at: int, step: int) -> bytes:
        run = hashes[max(a, at - REACH):at][::-1] if step < 0 else hashes[at:min(b, at + REACH)]
        return run.astype(np.uint32).tobytes()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part.column("text"))
            short = mix(words.hashes ^ np.uint64(11))
            out: list[tuple] = []
            for i, (doc, asked, gone) in enumerate(zip(*(part.column(c).to_pylist() for c in ("doc_id", "asked", "gone")))):
                a, b = int(words.first[i]), int(words.first[i + 1])
                runs: list[list] = []
                ends, begins = sorted(g["end"] for g in gone or ()), sorted(g["begin"] for g in gone or ())
                for r in sorted(asked, key=lambda r: r["pos"]):
                    p = a + r["pos"]
                    if p + r["n"] > b:
                        continue
                    if r["line"]:
                        _, values = distinct_sorted(shingles(words.hashes[p:p + r["n"]], WIDTH), np.array([0, r["n"] - WIDTH + 1]))
                        out.append((_SET, r["key"], doc, r["pos"], r["pos"] + r["n"], values.tobytes(), 0))
                    elif (doc, r["pos"]) == (r["keep_doc"], r["keep_pos"]):
                        low, high = bisect_right(ends, r["pos"]), bisect_left(begins, r["pos"] + BLOCK)
                        low, high = a + ends[low - 1] if low else a, a + begins[high] if high < len(begins) else b
                        ctx = [beside(short, low, high, p, -1), beside(short, low, high, p + BLOCK, 1)]
                        out.append((_KEPT, r["key"], doc, r["pos"], len(ctx[0]), b"".join(ctx), 0))
                    else:
                        way = (r["keep_doc"], r["keep_pos"] - r["pos"])
                        if runs and runs[-1][0] == way and r["pos"] <= runs[-1][2]:
                            runs[-1][2:] = [r["pos"] + BLOCK, r["key"], runs[-1][4]]
                        else:
                            runs.append([way, r["pos"], r["pos"] + BLOCK, r["key"], r["key"]])
                for (keep_doc, back), begin, end, last, first in runs:
                    skip = max(LEAST_KEPT + back, 0) if keep_doc == doc else 0
                    out.append((_LEFT, first, doc, begin, end, beside(short, a, b, a + begin, -1), skip))
                    out.append((_RIGHT, last, doc, begin, end, beside(short, a, b, a + end, 1), skip))
            columns = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), part.schema.field("doc_id").type, pa.int32(), pa.int32(), pa.binary(), pa.int32()))],
                names=["kind", "key", "doc_id", "begin", "end", "words", "skip"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    one = documents.select("doc_id", "text").join(requests, "doc_id").dropDuplicates(["doc_id"])
    return one.mapInArrow(look, f"kind int, key bigint, doc_id {kind}, begin int, end int, words binary, skip int")


def similar_lines(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of lines whose exact Jaccard similarity reaches the threshold."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = {x: sets.select(F.col("key").alias(x), F.col("words").alias(f"set_{x}")) for x in "ab"}
    return pairs.join(side["a"], "a").join(side["b"], "b").select("a", "b", "set_a", "set_b").mapInArrow(judge, "a bigint, b bigint")


def _extended(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """doc_id, begin, end of each run, moved outward as far as the words equal those beside the occurrence that stays."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, end = (batch.column(c).to_numpy().copy() for c in ("begin", "end"))
            for i, (kind, own, cut, both) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("kind", "words", "cut", "both")))):
                other = both[:cut] if kind == _LEFT else both[cut:]
                n = min(len(own), len(other)) // 4
                same = np.frombuffer(own, np.uint32, n) == np.frombuffer(other, np.uint32, n)
                length = n if same.all() else int(same.argmin())
                if kind == _LEFT:
                    begin[i] -= length
                else:
                    end[i] += length
            begin = np.minimum(begin + batch.column("skip").to_numpy(), end)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(begin), pa.array(end)], names=["doc_id", "begin", "end"])

    right = kept.select("key", F.col("end").alias("cut"), F.col("words").alias("both"))
    kind = edges.schema["doc_id"].dataType.simpleString()
    return edges.join(right, "key").select("kind", "doc_id", "begin", "end", "words", "skip", "cut", "both").mapInArrow(
        extend, f"doc_id {kind}, begin int, end int").filter("begin < end")


def merged(spans: DataFrame, least: int) -> DataFrame:
    """Spans of a document that touch or overlap as one; those that hold a ``whole`` one or have ``least`` words and more.  The spans of a document are bounded by its length."""
    step = """aggregate(sort_array(collect_list(struct(begin, end, whole))), cast(array() as array<struct<begin: int, end: int, whole: boolean>>), (a, s) ->
        CASE WHEN size(a) > 0 AND element_at(a, -1).end >= s.begin
             THEN array_append(slice(a, 1, size(a) - 1), named_struct('begin', element_at(a, -1).begin, 'end', greatest(element_at(a, -1).end, s.end),
                                                                      'whole', element_at(a, -1).whole OR s.whole))
             ELSE array_append(a, s) END)"""
    return spans.distinct().groupBy("doc_id").agg(F.expr(step).alias("m")).select("doc_id", F.explode("m").alias("m")).filter(
        F.col("m.whole") | (F.col("m.end") - F.col("m.begin") >= least)).select("doc_id", "m.begin", "m.end")


_ASKED = ("line", "pos", "n", "key", "keep_doc", "keep_pos")


def paragraph_spans(documents: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, begin, end of the paragraphs that are copies or near copies of one that stays."""
    classes = stored(found.groupBy("key").agg(
        F.min(F.struct("doc_id", "pos", "n", "bands")).alias("f"), F.count(F.lit(1)).alias("times"),
        F.min(F.when(F.col("wrapped"), F.struct("doc_id", "pos", "n"))).alias("first_wrapped")).select("key", "f.*", "times", "first_wrapped"), "passage-lines")
    bands = classes.select(F.explode("bands").alias("bucket"), F.col("key").alias("node"))
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("bucket")
    bands = stored(bands.join(shared, "bucket", "left_semi"), "passage-bands")
    wanted = classes.join(bands.select(F.col("node").alias("key")).distinct(), "key", "left_semi").select(
        "doc_id", F.lit(True).alias("line"), "pos", "n", "key", F.lit(None).cast(classes.schema["doc_id"].dataType).alias("keep_doc"),
        F.lit(None).cast("int").alias("keep_pos"))
    requests = wanted.groupBy("doc_id").agg(F.collect_list(F.struct(*_ASKED)).alias("asked")).withColumn(
        "gone", F.lit(None).cast("array<struct<begin: int, end: int>>"))
    sets = stored(details(documents, requests).select("key", "words"), "passage-sets")

    links = stored(similar_lines(star_pairs(bands), sets), "passage-links").toDF("u", "v")
    roots = star_edges(links).select(F.col("a").alias("node"), F.col("b").alias("root"))
    rooted_bands = bands.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    members = stored(mixed_members(rooted_bands), "passage-members")
    elements = sets.select(F.col("key").alias("node"), F.col("words").alias("elements"))
    more = similar_lines(small_pairs(members), sets).toDF("u", "v").unionByName(crowded_links(members, elements, PERCENT))
    edges = roots.toDF("u", "v").unionByName(more)
    roots = star_edges(edges).select(F.col("a").alias("key"), F.col("b").alias("root"))
    rooted = classes.select("key", "times", "first_wrapped").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    forget(bands, sets, members)  # the roots are stored
    groups = rooted.groupBy("root").agg(F.min("first_wrapped").alias("keep"), F.sum("times").alias("n_units")).filter("n_units > 1").drop("n_units")
    kept = rooted.join(groups, "root").select("key", "root", "keep")
    copies = stored(found.select("key", "doc_id", "pos", "n", "wrapped").join(kept, "key").drop("key"), "passage-copies")

    forget(classes)
    place = F.struct("doc_id", "pos", "n")
    span = ("doc_id", F.col("pos").alias("begin"), (F.col("pos") + F.col("n")).alias("end"))
    whole = stored(copies.filter(F.col("wrapped") & (place != F.col("keep"))).select(*span).distinct(), "passage-wrapped")
    around = whole.toDF("_id", "begin", "end")
    lines = stored(copies.filter("NOT wrapped").drop("wrapped").join(
        around, (F.col("doc_id") == F.col("_id")) & (F.col("begin") <= F.col("pos")) & (F.col("pos") + F.col("n") <= F.col("end")), "left_anti"), "passage-single")
    alone = lines.filter("keep IS NULL").drop("keep")
    firsts = alone.groupBy("root").agg(F.min(place).alias("keep"))
    settled = lines.filter("keep IS NOT NULL").unionByName(alone.join(firsts, "root"))
    # a line of the paragraph that stays may be like the whole of it
    apart = (F.col("doc_id") != F.col("keep.doc_id")) | (F.col("pos") >= F.col("keep.pos") + F.col("keep.n")) | (F.col("pos") + F.col("n") <= F.col("keep.pos"))
    return whole.unionByName(settled.filter(apart).select(*span))


def _of_one_text(documents: DataFrame) -> DataFrame:
    """The documents without the rows whose id names several texts."""
    hashes = documents.select("doc_id", F.xxhash64("text").alias("h"), F.hash("text").alias("g"))
    several = stored(hashes.groupBy("doc_id").agg(F.min("h").alias("h"), F.max("h").alias("i"), F.min("g").alias("g"), F.max("g").alias("k")).filter(
        "h <> i OR g <> k").select("doc_id"), "passage-clashes")
    return documents if several.isEmpty() else documents.join(several, "doc_id", "left_anti")


def repeated_spans(documents: DataFrame) -> DataFrame:
    """doc_id, begin, end (in words) of what repeats text that stays elsewhere."""
    documents = _of_one_text(documents.select("doc_id", "text"))
    found = stored(units(documents), "passage-units", "line")
    gone = stored(paragraph_spans(documents, found.filter("line")), "passage-gone")

    blocks = found.filter("NOT line").select("key", "doc_id", "pos")
    several = blocks.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("key")
    cut = gone.toDF("_id", "begin", "end")
    touches = (F.col("doc_id") == F.col("_id")) & (F.col("pos") < F.col("end")) & (F.col("pos") + BLOCK > F.col("begin"))
    left = stored(blocks.join(several, "key", "left_semi").join(cut, touches, "left_anti"), "passage-blocks")
    forget(found)
    firsts = left.groupBy("key").agg(F.min(F.struct("doc_id", "pos")).alias("keep"), F.count(F.lit(1)).alias("times")).filter("times > 1").select("key", "keep")
    twice = left.join(firsts, "key").select("doc_id", F.lit(False).alias("line"), "pos", F.lit(BLOCK).alias("n"), "key", "keep.*")
    twice = twice.toDF("doc_id", "line", "pos", "n", "key", "keep_doc", "keep_pos")
    limits = gone.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.struct("begin", "end")).alias("gone"))
    requests = twice.groupBy("doc_id").agg(F.collect_list(F.struct(*_ASKED)).alias("asked"))
    requests = requests.join(limits, F.col("doc_id") == F.col("_id"), "left").drop("_id")
    known = stored(details(documents, requests), "passage-details", "kind")
    forget(left)
    runs = _extended(known.filter(F.col("kind").isin(_LEFT, _RIGHT)), known.filter(F.col("kind") == _KEPT))
    return merged(gone.withColumn("whole", F.lit(True)).unionByName(runs.withColumn("whole", F.lit(False))), LEAST_REMOVED)


def without_spans(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """``documents`` with the spans cut out of their texts; ``n_chars`` follows the text if there is such a column.

    A text loses the bytes from the first to the last word of a span, nothing else.  A document of which nothing
    remains keeps an empty text.
    """
    columns = documents.columns
    own, listed_as = unused("id", columns), unused("spans", columns)
    lists = spans.groupBy(F.col("doc_id").alias(own)).agg(F.collect_list(F.struct("begin", "end")).alias(listed_as))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(part.column("text"))
            texts = part.column("text").to_pylist()
            for i, listed in enumerate(part.column(listed_as).to_pylist()):
                if listed:
                    first, at = words.first[i], words.offsets[i]
                    pieces = []
                    for s in sorted(listed, key=lambda s: s["begin"]):
                        pieces.append(words.bytes[at:words.starts[first + s["begin"]]])
                        at = words.ends[first + s["end"] - 1]
                    pieces.append(words.bytes[at:words.offsets[i + 1]])
                    texts[i] = b"".join(pieces).decode()
            out = [pa.array(texts, pa.string()) if c == "text" else part.column(c) for c in columns]
            if "n_chars" in columns:
                lengths = [None if t is None else len(t) for t in texts]
                old = part.column("n_chars")
                new = pa.compute.if_else(pa.compute.is_valid(part.column(listed_as)), pa.array(lengths, pa.int64()).cast(old.type), old)
                out[columns.index("n_chars")] = new
            yield pa.RecordBatch.from_arrays(out, names=columns)

    joined = documents.join(lists, documents["doc_id"] == lists[own], "left").drop(own)
    return joined.mapInArrow(cut, documents.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = repeated_spans(table(spark, sf_dir, "documents"))
    return spans.select("doc_id", "begin", "end", (F.col("end") - F.col("begin")).alias("n_words"))


QUERIES = {"op7_substring_dedup": query}
ORACLES: dict[str, str] = {}
