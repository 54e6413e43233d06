"""Toxicity by a weighted finite-state grammar over clauses.

Five small transducers read the symbols of a clause: insults, threats (an intention followed by harm), targets (whom it
is said to), negation (reaches a few words) and reported speech (reaches to the end of the clause).  Their composition
is one machine, built once; its output at an insult or a threat is a factor for the weight of that word.  The score of a
clause is the sum of its weighted matches; a logistic function of the sum over all clauses, and of that sum for each
word of the text, gives the score of the text.  So "you are not an idiot" and 'he said "idiot"' weigh less than "you
idiot", and a chance match in a long text says little.

Insults are learned from labelled texts: words, and beginnings of words, that occur in toxic texts far more often than in
others, each weighted by its smoothed precision.  Counting runs in Spark over a hash sample of about ``SAMPLE`` labelled texts;
at most ``ENTRIES`` entries are kept, so the lexicon has a fixed bound and goes to the
executors with the function.  The logistic function is fitted on ``CALIBRATION`` other texts of the sample.  Threat
verbs, intentions, targets, negations and verbs of saying are fixed lists.

Defined results: null, empty and matchless texts score the same low base value; repeated rows score alike; without
labels only threats match, and ``UNTRAINED`` is the logistic function.  Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.tables import crc_fold, table

SAMPLE, CALIBRATION = 40_000, 10_000
ENTRIES = 5_000
#: Lengths of the beginnings of words that may become entries; a beginning stands for several words.
PREFIXES = (4, 5, 6, 7, 8)
#: An entry needs this smoothed precision, and a log-likelihood ratio against the rate of toxic texts: among a million
#: candidates some are precise by chance.
LEAST_PRECISION, LEAST_EVIDENCE = 0.75, 14.0
#: Constant, factor of log(1 + evidence), factor of log(evidence per word) if there is nothing to fit them on.
UNTRAINED = (-1.0, 2.0, 0.5)
#: Evidence per word below which the logarithm is cut, and the score from which ``predicted`` is 1.
LEAST_RATE, LINE = 1e-4, 0.3
_FOLDS, _HELD = 4, 2

# Word lists in English, French, German and Spanish.
INTENTIONS = "will shall gonna going vais va vas werde wird werden voy vamos".split()
HARM = "kill hurt beat destroy murder stab shoot tuer frapper détruire töten schlagen zerstören matar golpear destruir".split()
TARGETS = "you your yours he she they them tu te toi vous votre du dich dir ihr sie tú usted ustedes vosotros".split()
NEGATIONS = "not no never without isn't aren't don't ne pas jamais sans nicht kein keine nie ohne nunca sin".split()
SAYING = "said says say called calls wrote quoted dit disait écrit sagte sagt schrieb nannte dijo dice escribió llamó".split()

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;:\n]+")
OTHER, INSULT, INTENT, HURT, TARGET, NEGATION, SAID = range(7)
FIXED = {w: s for words, s in ((INTENTIONS, INTENT), (HARM, HURT), (TARGETS, TARGET), (NEGATIONS, NEGATION), (SAYING, SAID)) for w in words}


class Transducer:
    """Reads symbols; arcs map (state, symbol) to (next state, factor).  Symbols without an arc lead to ``rest`` of the state."""

    def __init__(self, arcs: dict, rest: dict):
        self.arcs, self.rest = arcs, rest

    def step(self, state, symbol: int):
        return self.arcs.get((state, symbol)) or (self.rest[state], 1.0)

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same symbols; factors multiply.  Only pairs of states that can be reached are built."""
        arcs, todo, seen = {}, [(0, 0)], {(0, 0): 0}
        rest = {}
        while todo:
            pair = todo.pop()
            for symbol in range(7):
                (a, x), (b, y) = self.step(pair[0], symbol), other.step(pair[1], symbol)
                if (a, b) not in seen:
                    seen[a, b] = len(seen)
                    todo.append((a, b))
                arcs[seen[pair], symbol] = (seen[a, b], x * y)
            rest[seen[pair]] = seen[pair]
        return Transducer(arcs, rest)


def _within(opener: int, reach: int, factor: float, on: tuple[int, ...] = (INSULT, HURT)) -> Transducer:
    """For ``reach`` words after ``opener`` the words in ``on`` get ``factor``."""
    arcs = {(s, opener): (reach, 1.0) for s in range(reach + 1)}
    arcs |= {(s, x): (s - 1, factor) for s in range(1, reach + 1) for x in on}
    return Transducer(arcs, {s: max(0, s - 1) for s in range(reach + 1)})


def _rest_of_clause(opener: int, factor: float) -> Transducer:
    arcs = {(s, opener): (1, 1.0) for s in (0, 1)} | {(1, x): (1, factor) for x in (INSULT, HURT)}
    return Transducer(arcs, {0: 0, 1: 1})


def grammar() -> Transducer:
    """insult o threat o target o negation o reported speech."""
    insult = Transducer({(0, INSULT): (0, 1.0)}, {0: 0})
    # harm counts only after an intention
    threat = Transducer({(0, HURT): (0, 0.0)} | {(s, INTENT): (4, 1.0) for s in range(5)}, {s: max(0, s - 1) for s in range(5)})
    target = _within(TARGET, 6, 1.15)
    negation = _within(NEGATION, 3, 0.5)
    return reduce(Transducer.compose, [insult, threat, target, negation, _rest_of_clause(SAID, 0.6)])


def _sample(documents: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """text and toxic of about ``size`` labelled documents, chosen by a hash of the id; all if there are fewer.

    The sample is drawn from the labels, so its ids have a fixed bound and are broadcast: no text is shuffled.
    """
    share = min(1.0, size / max(1, labels.count()))
    chosen = labels.filter(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000)
    return documents.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id").filter("text IS NOT NULL")


def lexicon(sample: DataFrame) -> list[tuple[str, bool, float]]:
    """(entry, is_prefix, weight) from texts with a column ``toxic``."""
    words = sample.select("toxic", F.monotonically_increasing_id().alias("i"), F.explode(
        F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))).alias("word"))
    whole = words.select("toxic", "i", F.col("word").alias("entry"), F.lit(False).alias("prefix"))
    starts = words.select("toxic", "i", F.explode(F.array(*(
        F.when(F.length("word") > n, F.substring("word", 1, n)) for n in PREFIXES))).alias("entry"), F.lit(True).alias("prefix"))
    each = whole.unionByName(starts.filter("entry IS NOT NULL").distinct())
    counted = each.groupBy("entry", "prefix").agg(
        F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("a"), F.count(F.lit(1)).alias("n"))
    rate = sample.agg((F.count_if(F.col("toxic") == 1) + 0.5) / (F.count(F.lit(1)) + 1.0)).first()[0]
    w = F.col("w")
    evidence = F.col("a") * F.log(w / rate) + (F.col("n") - F.col("a")) * F.log((1.0 - w) / (1.0 - rate))
    precise = counted.filter("a > 1").withColumn("w", (F.col("a") + 0.2) / (F.col("n") + 1.0)).filter(
        (w >= LEAST_PRECISION) & (w > rate) & (evidence >= LEAST_EVIDENCE))
    return [(r["entry"], r["prefix"], r["w"]) for r in precise.orderBy(F.desc("a"), F.desc("w"), "entry", "prefix").limit(ENTRIES).collect()]


class Scorer:
    """Finds the entries in a text by one automaton, then runs the grammar over the clauses that hold one."""

    def __init__(self, entries: list[tuple[str, bool, float]]):
        import ahocorasick

        self.machine, self.words, self.starts = grammar(), {}, {}
        for entry, prefix, weight in entries:
            (self.starts if prefix else self.words)[entry] = weight
        self.finder = ahocorasick.Automaton()
        for entry in {*self.words, *self.starts, *HARM}:
            self.finder.add_word(entry, entry)
        self.finder.make_automaton()

    def weight(self, word: str) -> float:
        """Of a word as an insult; of several entries the largest."""
        found = [self.words.get(word, 0.0)]
        found += [self.starts.get(word[:n], 0.0) for n in PREFIXES if len(word) > n]
        return max(found)

    def clause(self, text: str) -> float:
        state, total = 0, 0.0
        for word in _WORD.findall(text):
            weight = self.weight(word)
            symbol = INSULT if weight else FIXED.get(word, OTHER)
            state, factor = self.machine.step(state, symbol)
            total += factor * (weight or 0.8 * (symbol == HURT)) if symbol in (INSULT, HURT) else 0.0
        return total

    def __call__(self, text: str | None) -> tuple[float, int, int]:
        """Sum of the clauses' scores, number of clauses that matched, number of words."""
        total, n, done = 0.0, 0, 0
        body = text.lower() if text else ""
        for end, entry in self.finder.iter(body) if len(self.finder) else ():
            first = end - len(entry) + 1
            if first < done or first and body[first - 1].isalpha():
                continue
            begin = 0
            for stop in ".!?;:\n":
                begin = max(begin, body.rfind(stop, done, first) + 1, done)
            close = _CLAUSE.search(body, end)
            done = close.end() if close else len(body)
            p = self.clause(body[begin:done])
            n += p > 0
            total += p
        return total, n, len(body.split())


def features(evidence: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    rate = evidence / np.maximum(n_words, 1)
    return np.column_stack([np.ones(len(evidence)), np.log1p(evidence), np.log(np.maximum(rate, LEAST_RATE))])


def logistic(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x @ weights, -30, 30)))


def fitted(evidence: np.ndarray, n_words: np.ndarray, toxic: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps."""
    if len(toxic) == 0 or toxic.min() == toxic.max():
        return UNTRAINED
    x, w = features(evidence, n_words), np.zeros(3)
    for _ in range(50):
        p = logistic(x, w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (toxic - p) - 0.1 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def matched(documents: DataFrame, entries: list[tuple[str, bool, float]], weights: tuple[float, ...] = UNTRAINED, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, score, predicted, n_clauses, evidence, n_words for every row."""
    out = ["score", "predicted", "n_clauses", "evidence", "n_words"]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = Scorer(entries)
        for batch in batches:
            found = pd.DataFrame([ask(t) for t in batch["text"]], columns=["evidence", "n_clauses", "n_words"])
            found[list(keep)] = batch[list(keep)].reset_index(drop=True)
            found["score"] = logistic(features(found["evidence"].to_numpy(float), found["n_words"].to_numpy(float)), np.array(weights))
            found["predicted"] = (found["score"] >= LINE).astype("int32")
            yield found[[*keep, *out]]

    kept = ", ".join(f"{k} {documents.schema[k].dataType.simpleString()}" for k in keep)
    return documents.select(*keep, "text").mapInPandas(
        score, f"{kept}, score double, predicted int, n_clauses bigint, evidence double, n_words bigint")


def learned(documents: DataFrame, labels: DataFrame) -> tuple[list[tuple[str, bool, float]], tuple[float, ...]]:
    """Lexicon and logistic weights; a text serves one of the two."""
    third = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(3)) == 0
    known = labels.filter("toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    entries = lexicon(_sample(documents, known.filter(~third), SAMPLE))
    seen = matched(_sample(documents, known.filter(third), CALIBRATION), entries, keep=("toxic",)).toPandas()
    return entries, fitted(seen["evidence"].to_numpy(float), seen["n_words"].to_numpy(float), seen["toxic"].to_numpy(float))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    training = table(spark, sf_dir, "labels").filter(crc_fold(F.col("doc_id"), _FOLDS) != _HELD).select("doc_id", "toxic")
    entries, weights = learned(documents, training)
    return matched(documents, entries, weights).select(
        "doc_id", (crc_fold(F.col("doc_id"), _FOLDS) == _HELD).alias("held_out"), "score", "predicted", "n_clauses")


QUERIES = {"op6_toxicity": query}
ORACLES: dict[str, str] = {}
