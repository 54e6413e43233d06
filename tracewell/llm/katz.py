"""Language-model scoring by Katz back-off.

n-gram counts of the training texts, discounted by Good-Turing up to ``K``, make the probabilities of what was seen; what is
taken off goes to the lower order through a back-off weight for each history that makes its distribution sum to one
exactly.  A token is scored recursively: by the longest n-gram that was seen, plus the weights of the histories
passed on the way down.

Words are lower-cased (A-Z) and stand for themselves as 64-bit hashes, n-grams as a 64-bit hash of history and word; each text
ends with an end token and begins with a start history.  The lowest order gives the mass left over to one class of all unknown
words.  A history that discounts nothing reserves 1 / (c + 1), so no token has probability zero.

Texts are read once, into ``blocks`` of some MB: a dictionary of word hashes and a code for each token.  A block asks for each of
its distinct n-grams once, as sorted keys with its own training counts, cut by ranges of keys into buckets.  A bucket adds up, answers
each block with the whole counts in the order asked, and names one block the owner of each n-gram.  Owners then tell each
history's sums in the same way and all blocks get its scale and weight back.  So a block can score its own texts; the
number of buckets follows the tokens, and neither a hot word or pair nor a common history puts more than a key a block into one.
The answers lie in the shared folder and are the model; ``grams`` (hist, lower, w, c, logp) and ``backoff`` (hist, logalpha) are tables
read off the owners, with which ``log_probabilities`` scores texts that came later.  Nothing but counts of counts is collected or broadcast.

Defined results: a null or empty text is its end token alone; without training texts every score and base score is null;
rows that repeat are scored alike, each in a row of its own; a null doc_id is trained on or held out as the text ''.  Other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.tables import crc_fold, stored, table
from tracewell.llm.wordbatch import Words, mix, slices

#: Order in production, and the largest count that is discounted.
ORDER, K = 2, 5
_FOLDS = 10
END, START = np.uint64(0x5E5E5E5E5E5E5E5E), np.uint64(0x7171717171717171)
_P = np.uint64(0x9E3779B97F4A7C15)
#: History of the lowest order.
EMPTY = 0
#: Bytes of text in a block, and tokens for which there is a bucket.
_BLOCK, _BUCKET = 8 << 20, 1 << 20
_ASKED = "bucket int, block bigint, keys binary, counts binary, sums binary"
_ANSWER = "block bigint, step string, bucket int, found binary, owned binary, stats array<bigint>"


def histories(number: np.ndarray, w: np.ndarray, order: int) -> list[np.ndarray]:
    """Histories of orders 1 to ``order`` of every token of texts with ``number`` tokens each."""
    position = np.arange(len(w)) - np.repeat(np.cumsum(number) - number, number)
    hist, out = np.zeros(len(w), np.uint64), []
    for n in range(1, order + 1):
        if n > 1:
            before = np.concatenate([np.full(n - 1, START), w[:-(n - 1)]])[:len(w)]
            before[position < n - 1] = START
            hist = mix(hist * _P + before + np.uint64(n))
        out.append(hist)
    return out


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of tokens of every text, and all tokens, end tokens included."""
    words = Words(texts)
    number = words.counts() + 1
    w = np.full(int(number.sum()), END)
    inside = np.ones(len(w), dtype=bool)
    inside[np.cumsum(number) - 1] = False
    w[inside] = words.hashes
    return number, w


def _thin(values: np.ndarray) -> bytes:
    """Unsigned numbers as planes of their low, second, ... bytes, without planes of zeros; the first byte is the number of planes."""
    values = np.ascontiguousarray(values, dtype="<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _wide(data: bytes) -> np.ndarray:
    out = np.zeros(((len(data) - 1) // data[0], 8), dtype=np.uint8)
    out[:, :data[0]] = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(data[0], -1).T
    return out.view("<u8").reshape(-1)


def _ranges(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Bucket, begin, end and steps from key to key of each range of the sorted ``keys``."""
    shift = np.uint64(64 - bits)
    buckets = keys >> shift
    begins = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(keys) else []
    for a, b in zip(begins, [*begins[1:], len(keys)]):
        yield int(buckets[a]), a, b, _thin(np.diff(keys[a:b], prepend=buckets[a] << shift))


def _keys(bucket: int, bits: int, data: bytes) -> np.ndarray:
    return np.cumsum(_wide(data)) + (np.uint64(bucket) << np.uint64(64 - bits))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_ASKED_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("sums", pa.binary())])
_ANSWER_ARROW = pa.schema([
    ("block", pa.int64()), ("step", pa.string()), ("bucket", pa.int32()), ("found", pa.binary()), ("owned", pa.binary()), ("stats", pa.list_(pa.int64()))])


def packed(texts: DataFrame) -> DataFrame:
    """block, size, doc_ids, training, number, words, codes: the tokens of ``texts`` (doc_id, text, training), a row for some MB."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, limit=_BLOCK):
            number, w = tokens(part.column("text"))
            words, codes, times = np.unique(w, return_inverse=True, return_counts=True)
            often = np.argsort(-times, kind="stable")  # small codes for frequent words
            place = np.empty_like(often)
            place[often] = np.arange(len(often))
            offsets = pa.array([0, part.num_rows], pa.int32())
            ids, training = part.column("doc_id"), part.column("training")
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(w)], pa.int64()), pa.ListArray.from_arrays(offsets, ids), pa.ListArray.from_arrays(offsets, training),
                 *(pa.array([x], pa.binary()) for x in (_thin(number), _thin(words[often]), _thin(place[codes])))],
                names=["size", "doc_ids", "training", "number", "words", "codes"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = texts.select("doc_id", "text", "training").mapInArrow(
        pack, f"size bigint, doc_ids array<{kind}>, training array<boolean>, number binary, words binary, codes binary")
    # numbered while they are written; what reads them afterwards finds the numbers stored
    return rows.select(F.monotonically_increasing_id().alias("block"), "*")


class _Block:
    """The tokens of one block and, once there are answers, what is known of its n-grams and histories."""

    def __init__(self, block: pa.Table | pa.RecordBatch, order: int, answers: pa.Table | None = None):
        self.id, training, number, words, codes = (block.column(c)[0].as_py() for c in ("block", "training", "number", "words", "codes"))
        self.number = _wide(number).astype(np.int64)
        self.trained = np.repeat(np.array([x is True for x in training], dtype=bool), self.number)
        self.w = _wide(words)[_wide(codes)]
        self.hists = histories(self.number, self.w, order)
        self.answers = sorted(answers.select(["step", "bucket", "found", "owned"]).to_pylist(), key=lambda r: r["bucket"]) if answers is not None else []

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys of the n-grams, the first token of each, the key of each token."""
        return np.unique(self.w if n == 1 else mix(self.hists[n - 1] * _P + self.w), return_index=True, return_inverse=True)

    def _found(self, step: str, read: Callable[[bytes], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        found, owned = [], []
        for r in self.answers:
            if r["step"] == step:
                found.append(read(r["found"]))
                owned.append(np.unpackbits(np.frombuffer(r["owned"], np.uint8), count=found[-1].shape[-1]).astype(bool))
        return np.concatenate(found, axis=-1), np.concatenate(owned)

    def counts(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Training count and ownership of each distinct n-gram."""
        c, owned = self._found(f"grams-{n}", _wide)
        return c.astype(np.int64), owned

    def of_histories(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct histories, the history of each token; log10 of scale / all, logalpha and ownership of each history."""
        hists, inverse = np.unique(self.hists[n - 1], return_inverse=True)
        (norm, alpha), owned = self._found(f"hists-{n}", lambda data: np.frombuffer(data, "<f8").reshape(2, -1))
        return hists, inverse, norm, alpha, owned


def _owner(group: np.ndarray, seen: np.ndarray, number: int) -> np.ndarray:
    """Marks the first entry of each group that was seen in training texts."""
    at = np.flatnonzero(seen)[::-1]
    first = np.full(number, -1)
    first[group[at]] = at
    out = np.zeros(len(group), dtype=bool)
    out[first[first >= 0]] = True
    return out


def _collected(packets: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Number of distinct keys, the key of each entry, counts of the entries, rows with the bounds of their entries."""
    rows = packets.to_pylist()
    keys = [_keys(r["bucket"], bits, r["keys"]) for r in rows]
    ends = np.cumsum([0, *map(len, keys)])
    distinct, group = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.concatenate([_wide(r["counts"]) for r in rows]).astype(np.int64)
    return len(distinct), group, counts, list(zip(rows, ends[:-1], ends[1:]))


def discounts(counts_of_counts: list[int]) -> list[float]:
    """Good-Turing factors of the counts 1 to K from the number of n-grams that come 1 to K + 1 times; 1 where these allow none."""
    n = [0, *counts_of_counts]
    if not n[1]:
        return [1.0] * K
    tail = (K + 1) * n[K + 1] / n[1]
    out = []
    for r in range(1, K + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else 1.0
        out.append(d if 0 < d <= 1 else 1.0)
    return out


class Katz:
    """A trained model: its blocks and the answers to them in the shared folder, and for each order the discounts."""

    def __init__(self, blocks: DataFrame, order: int):
        self.blocks, self.order, self.spark = blocks, order, blocks.sparkSession
        self.answers: list[DataFrame] = []
        self.factors: list[list[float]] = []
        self.total = self.types = 0
        #: log10 of scale / all of the one history of the lowest order, and what an unknown word gets.
        self.norm = self.unknown = 0.0

    @staticmethod
    def train(texts: DataFrame, order: int = ORDER, training: Column | None = None) -> Katz:
        """The model of the ``texts`` for which ``training`` holds (all if not given); the others are only there to be scored."""
        doc_id = F.col("doc_id") if "doc_id" in texts.columns else F.lit(None).cast("int").alias("doc_id")
        rows = texts.select(doc_id, "text", (F.lit(True) if training is None else training).cast("boolean").alias("training"))
        model = Katz(stored(packed(rows), "katz-blocks"), order)
        size = model.blocks.agg(F.sum("size")).first()[0] or 0
        bits = max(1, math.ceil(math.log2(max(1, size / _BUCKET))))
        for n in range(1, order + 1):
            model._count(n, bits)
            if n > 1:
                model._weigh(n, bits)
        return model

    def _count(self, n: int, bits: int) -> None:
        """Every block learns the training counts of its n-grams; the discounts of the order follow from the counts of counts."""
        order, step = self.order, f"grams-{n}"

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    b = _Block(batch.slice(i, 1), order)
                    keys, _, inverse = b.grams(n)
                    counts = np.bincount(inverse[b.trained], minlength=len(keys))
                    yield _batch([(k, b.id, steps, _thin(counts[x:y]), None) for k, x, y, steps in _ranges(keys, bits)], _ASKED_ARROW)

        def answer(packets: pa.Table) -> pa.Table:
            number, group, counts, rows = _collected(packets, bits)
            whole = np.bincount(group, counts, minlength=number).astype(np.int64)
            found, owned = whole[group], _owner(group, counts > 0, number)
            times = np.bincount(np.minimum(whole, K + 2), minlength=K + 3)
            stats = [int(whole.sum()), int((whole > 0).sum()), *map(int, times[1:K + 2])]
            return pa.Table.from_batches([_batch(
                [(r["block"], step, r["bucket"], _thin(found[a:b]), np.packbits(owned[a:b]).tobytes(), None if i else stats)
                 for i, (r, a, b) in enumerate(rows)], _ANSWER_ARROW)])

        answers = stored(self.blocks.drop("doc_ids").mapInArrow(ask, _ASKED).groupBy("bucket").applyInArrow(answer, _ANSWER), f"katz-{step}")
        self.answers.append(answers)
        total, types, *times = [x or 0 for x in answers.agg(*(F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(K + 3))).first()]
        self.factors.append(discounts(times))
        if n == 1 and total:
            self.total, self.types = total, types
            kept = total - sum(r * t * (1 - f) for r, t, f in zip(range(1, K + 1), times, self.factors[0]))
            scale = min(1.0, (1 - 1 / (total + 1)) * total / kept)
            self.norm, self.unknown = math.log10(scale / total), math.log10(1 - scale * kept / total)

    def _weigh(self, n: int, bits: int) -> None:
        """Every block learns scale and back-off weight of its histories, from the sums that the owners of the n-grams tell."""
        order, step, logps = self.order, f"hists-{n}", self._log_probabilities()
        factors = self.factors[n - 1]

        def tell(block: pa.Table, answers: pa.Table) -> pa.Table:
            b = _Block(block, order, answers)
            _, first, _ = b.grams(n)
            c, owned = b.counts(n)
            lower, found = logps(b, n - 1)
            hists, inverse = np.unique(b.hists[n - 1], return_inverse=True)
            at, c = first[owned], c[owned]
            of = inverse[at]
            seen = np.bincount(of, c, minlength=len(hists)).astype(np.int64)
            sums = np.stack([np.bincount(of, x, minlength=len(hists)) for x in (_discounted(c, factors), 10.0 ** lower[found[at]])])
            return pa.Table.from_batches([_batch(
                [(k, b.id, steps, _thin(seen[x:y]), sums[:, x:y].tobytes()) for k, x, y, steps in _ranges(hists, bits)], _ASKED_ARROW)])

        def answer(packets: pa.Table) -> pa.Table:
            number, group, counts, rows = _collected(packets, bits)
            every = np.bincount(group, counts, minlength=number)
            sums = np.concatenate([np.frombuffer(r["sums"], "<f8").reshape(2, -1) for r, _, _ in rows], axis=1)
            kept, low = (np.bincount(group, x, minlength=number) for x in sums)
            norm, alpha = np.zeros((2, number))
            seen = every > 0
            every, kept, low = every[seen], kept[seen], low[seen]
            # what seen words get of a history: all that is not discounted, but never everything
            scale = np.minimum(1.0, (1 - 1 / (every + 1)) * every / kept)
            norm[seen] = np.log10(scale / every)
            alpha[seen] = np.log10((1 - scale * kept / every) / np.maximum(1 - low, 1e-300))
            owned = _owner(group, counts > 0, number)
            return pa.Table.from_batches([_batch(
                [(r["block"], step, r["bucket"], np.stack([norm[group[a:b]], alpha[group[a:b]]]).tobytes(), np.packbits(owned[a:b]).tobytes(), None)
                 for r, a, b in rows], _ANSWER_ARROW)])

        told = self._met(tell, _ASKED)
        self.answers.append(stored(told.groupBy("bucket").applyInArrow(answer, _ANSWER), f"katz-{step}"))

    def _met(self, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """``work`` on each block with all answers to it."""
        answers = self.answers[0]
        for more in self.answers[1:]:
            answers = answers.unionByName(more)
        return self.blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(work, schema)

    def _log_probabilities(self) -> Callable[[_Block, int], tuple[np.ndarray, np.ndarray]]:
        """A function of a block and an order: log10 of the probability of each distinct n-gram seen, 0 for the others; the n-gram of each token."""
        factors, lowest = list(self.factors), self.norm

        def of(b: _Block, n: int) -> tuple[np.ndarray, np.ndarray]:
            _, first, found = b.grams(n)
            c, _ = b.counts(n)
            if n == 1:
                norm = np.full(len(c), lowest)
            else:
                _, inverse, norms, _, _ = b.of_histories(n)
                norm = norms[inverse[first]]
            return np.where(c > 0, np.log10(_discounted(np.maximum(c, 1), factors[n - 1])) + norm, 0.0), found

        return of

    def grams(self, n: int) -> DataFrame:
        """hist, lower, w, c, logp of the n-grams seen; ``lower`` is the history without its first word."""
        order, logps = self.order, self._log_probabilities()

        def owned_by(block: pa.Table, answers: pa.Table) -> pa.Table:
            b = _Block(block, order, answers)
            _, first, _ = b.grams(n)
            c, owned = b.counts(n)
            logp, _ = logps(b, n)
            at = first[owned]
            return pa.table([_signed(b.hists[n - 1][at]), _signed(b.hists[max(0, n - 2)][at]), _signed(b.w[at]), pa.array(c[owned]), pa.array(logp[owned])],
                            names=["hist", "lower", "w", "c", "logp"])

        return self._met(owned_by, "hist bigint, lower bigint, w bigint, c bigint, logp double")

    def backoff(self, n: int) -> DataFrame:
        """hist, logalpha: what a word unseen after the history adds; for order 1 the unknown class gets the mass itself."""
        if n == 1:
            return self.spark.createDataFrame([(EMPTY, self.unknown)] if self.total else [], "hist bigint, logalpha double")
        order = self.order

        def owned_by(block: pa.Table, answers: pa.Table) -> pa.Table:
            hists, _, _, alpha, owned = _Block(block, order, answers).of_histories(n)
            return pa.table([_signed(hists[owned]), pa.array(alpha[owned])], names=["hist", "logalpha"])

        return self._met(owned_by, "hist bigint, logalpha double")

    def log_probabilities(self, rows: DataFrame) -> DataFrame:
        """(row, score) for other texts: sums over each row's tokens; ``rows`` has row, w, h2 to h<order>, n (times that the token comes)."""
        parts, rest = [], rows
        for n in range(self.order, 0, -1):
            found = self.grams(n).select(*([F.col("hist").alias(f"h{n}")] if n > 1 else []), "w", "logp")
            met = rest.join(found, [f"h{n}", "w"] if n > 1 else ["w"], "left")
            parts.append(met.filter("logp IS NOT NULL").groupBy("row").agg(F.sum(F.col("n") * F.col("logp")).alias("part")))
            missed = met.filter("logp IS NULL").drop("logp")
            if n > 1:
                weighed = missed.join(self.backoff(n).select(F.col("hist").alias(f"h{n}"), "logalpha"), f"h{n}", "left")
            else:  # one history only: its weight is a constant
                weighed = missed.withColumn("logalpha", F.lit(self.unknown if self.total else None).cast("double"))
            parts.append(weighed.groupBy("row").agg(F.sum(F.col("n") * F.coalesce("logalpha", F.lit(0.0))).alias("part")))
            rest = missed
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.groupBy("row").agg(F.sum("part").alias("score"))

    def scores(self) -> DataFrame:
        """doc_id, training, n_tokens, n_known, base_score, score of every text, those that were not trained on too.

        Tokens found at an order leave with its probability, the others carry the weight of their history down.
        """
        order, logps, unknown, types = self.order, self._log_probabilities(), self.unknown, self.types
        room = self.total + 0.1 * (types + 1)

        def score(block: pa.Table, answers: pa.Table) -> pa.Table:
            b = _Block(block, order, answers)
            sums, left = np.zeros(len(b.w)), np.ones(len(b.w), dtype=bool)
            for n in range(order, 0, -1):
                logp, found = logps(b, n)
                met = b.counts(n)[0][found] > 0
                sums[left & met] += logp[found[left & met]]
                left &= ~met
                if n > 1:
                    _, inverse, _, alpha, _ = b.of_histories(n)
                    sums[left] += alpha[inverse[left]]
                else:
                    sums[left] += unknown
            known = b.counts(1)[0][found]  # of order 1, the last in the loop
            begin = np.cumsum(b.number) - b.number
            columns = [b.number, np.add.reduceat((known > 0).astype(np.int64), begin), np.add.reduceat(np.log10((known + 0.1) / room), begin), np.add.reduceat(sums, begin)]
            docs = block.column("doc_ids").combine_chunks().flatten(), block.column("training").combine_chunks().flatten()
            return pa.table([*docs, *map(pa.array, columns)], names=["doc_id", "training", "n_tokens", "n_known", "base_score", "score"])

        kind = self.blocks.schema["doc_ids"].dataType.elementType.simpleString()
        return self._met(score, f"doc_id {kind}, training boolean, n_tokens bigint, n_known bigint, base_score double, score double")


def _discounted(c: np.ndarray, factors: list[float]) -> np.ndarray:
    return c * np.array([1.0, *factors, 1.0])[np.minimum(c, K + 1)]


def occurrences(texts: DataFrame, order: int) -> DataFrame:
    """row, w, h2 to h<order>, n: the distinct tokens with history of each text."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            number, w = tokens(part.column("text"))
            owner, hists = np.repeat(np.arange(len(number)), number), histories(number, w, order)
            by = np.lexsort((w, hists[-1], owner))
            new = np.ones(len(by), dtype=bool)
            new[1:] = np.any([x[by][1:] != x[by][:-1] for x in (owner, hists[-1], w)], axis=0)
            first = by[new]
            size = np.diff(np.append(np.flatnonzero(new), len(by)))
            yield pa.RecordBatch.from_arrays(
                [part.column("row").take(pa.array(owner[first])), _signed(w[first]), *(_signed(h[first]) for h in hists[1:]), pa.array(size, pa.int64())],
                names=["row", "w", *(f"h{n}" for n in range(2, order + 1)), "n"])

    columns = "".join(f"h{n} bigint, " for n in range(2, order + 1))
    return texts.select("row", "text").mapInArrow(split, f"row bigint, w bigint, {columns}n bigint")


def scored(documents: DataFrame, training: Column, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    model = Katz.train(documents, order, training)
    trained = F.lit(model.total > 0)
    return model.scores().select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("bigint").alias("train_tokens"),
        F.when(trained, F.col("base_score")).alias("base_score"), F.when(trained, F.col("score")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), crc_fold(F.col("doc_id"), _FOLDS) != 0)


QUERIES = {"op2_katz_scoring": query}
ORACLES: dict[str, str] = {}
