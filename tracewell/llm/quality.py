"""Quality rules: a table of thresholds compiled into one projection.

A rule bounds one ratio of a text and says from how many words it applies: ratios of very short texts say little.
The ratios come from built-in functions over the whole text, so the verdict of any number of rules is one scan with no
shuffle.  Texts in which no window of five words comes twice -- nearly all -- end with a hash set of window hashes; only
the others sort their windows.

Null, empty and blank texts have no word: every count is 0 and ``base_failed`` is true.  The operator keeps repeated
rows and all columns of its input, whatever their names; ``judged`` gives its own columns in place of those of the same
names, ``kept_documents`` the rows as they came.  The stop-word rule is for texts written mainly in the letters of its
lists: Greek, Russian or Arabic ones aren't judged by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.tables import BLANKS, all_of, table, words

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "au aux ce dans de des du elle en est et il la le les ne par pas pour que qui sur un une "
    "als auf das dem den der des die ein eine im ist mit nicht sich und von zu "
    "con del el es las los no para por se su una y"
).split()
# Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``ratio`` must lie in [low, high] in texts of ``from_words`` words and more."""

    name: str
    ratio: str
    low: float | None = None
    high: float | None = None
    from_words: int = 0
    #: applies only to texts at least half of whose characters in words are of this class
    letters: str | None = None


#: The thresholds in production.
RULES = (
    Rule("word_length", "mean_word_length", 2.0, 12.0, 20),
    Rule("symbols", "symbol_ratio", None, 0.1, 10),
    Rule("letters", "letter_ratio", 0.7, None, 20),
    Rule("stop_words", "stop_word_ratio", 0.005, None, 200, "A-Za-z"),
    Rule("repeated_lines", "dup_line_ratio", None, 0.4, 20),
    Rule("capitals", "capital_ratio", None, 0.4, 20),
    Rule("length", "n_words", 10, None, 0),
)


#: Words of a window whose repetition counts.
WINDOW = 5


def _window_hashes() -> str:
    inside = ", ".join(f"get(_w, i + {k})" for k in range(WINDOW))
    return f"CASE WHEN n_words < {WINDOW} THEN array() ELSE transform(sequence(0, n_words - {WINDOW}), i -> xxhash64({inside})) END"


def _positions_of_repeats(sorted_windows: str) -> str:
    """Starts of the windows whose hash stands next to an equal one in the sorted array."""
    same = " OR ".join(f"x.h = get({sorted_windows}, k {side} 1).h" for side in "-+")
    return f"sort_array(filter(transform({sorted_windows}, (x, k) -> CASE WHEN {same} THEN x.i END), i -> i IS NOT NULL))"


def _covered(starts: str) -> str:
    """Number of words inside windows that begin at the sorted ``starts``."""
    step = f"named_struct('stop', i + {WINDOW}, 'n', a.n + {WINDOW} - greatest(0, a.stop - i))"
    return f"aggregate({starts}, named_struct('stop', 0, 'n', 0), (a, i) -> {step}, a -> CAST(a.n AS BIGINT))"


def measured(documents: DataFrame) -> DataFrame:
    """``_row`` (the row of ``documents``), ``_text`` and the counts and ratios of each text.

    Every step that is used more than once is a column of its own, so that nothing is computed twice.
    """
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("_row"), F.coalesce("text", F.lit("")).alias("_text"))
    stops = [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]
    steps = rows.withColumn("_w", words(F.col("_text")))
    steps = steps.withColumn("n_words", F.size("_w").cast("bigint"))
    steps = steps.withColumns({
        "_g": F.expr(_window_hashes()),
        "_lines": F.filter(F.split("_text", "\n"), lambda line: F.translate(line, BLANKS, "") != ""),
        "word_chars": F.length(F.translate("_text", BLANKS, "")).cast("bigint"),
        "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("bigint"),
        "_stops": F.size(F.filter("_w", lambda w: w.isin(stops))),
        "_letters": F.size(F.filter("_w", lambda w: w.rlike(r"\p{L}"))),
        "_capitals": F.length("_text") - F.length(F.regexp_replace("_text", r"\p{Lu}+", "")),
    })
    steps = steps.withColumn("_o", F.expr(
        "CASE WHEN size(array_distinct(_g)) < size(_g) THEN "
        "sort_array(transform(_g, (h, i) -> named_struct('h', h, 'i', i))) END"))
    steps = steps.withColumn("_p", F.expr(f"CASE WHEN _o IS NOT NULL THEN {_positions_of_repeats('_o')} END"))
    n, lines = F.greatest("n_words", F.lit(1)), F.size("_lines")
    steps = steps.withColumns({
        "n_dup_lines": (lines - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_repeat_words": F.expr(f"CASE WHEN _p IS NULL THEN 0L ELSE {_covered('_p')} END"),
    })
    return steps.withColumns({
        "mean_word_length": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / n,
        "letter_ratio": F.col("_letters") / n,
        "stop_word_ratio": F.col("_stops") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(lines, F.lit(1)),
        "capital_ratio": F.col("_capitals") / F.greatest("word_chars", F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / n,
    }).drop("_w", "_g", "_lines", "_stops", "_letters", "_capitals", "_o", "_p")


def passes(rule: Rule) -> Column:
    """Whether a measured row obeys the rule."""
    bounds = [F.col(rule.ratio) >= rule.low] if rule.low is not None else []
    bounds += [F.col(rule.ratio) <= rule.high] if rule.high is not None else []
    met = (F.col("n_words") < rule.from_words) | all_of(bounds)
    if rule.letters is None:
        return met
    # last, so that only texts that would fail are searched for other letters
    return met | (2 * F.length(F.regexp_replace("_text", f"[^{rule.letters}]+", "")) < F.col("word_chars"))


def base_failed() -> Column:
    """Too short, or more than a fifth of the words lie in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _judged(documents: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    failed = F.filter(F.array(*(F.when(~passes(r), F.lit(r.name)) for r in rules)), lambda name: name.isNotNull())
    return measured(documents).withColumns({
        "failed_rules": F.array_join(failed, ",") if rules else F.lit(""), "base_failed": base_failed(),
    }).withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def judged(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``documents`` with counts, ratios, the names of the rules that failed, ``base_failed`` and ``kept``."""
    out = _judged(documents, rules)
    own = [c for c in out.columns if c not in ("_row", "_text")]
    return out.select(*(F.col("_row")[c].alias(c) for c in documents.columns if c.lower() not in own), *own)


def kept_documents(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``documents`` that pass, with the columns and values they came with."""
    # as the output of a generator the verdict is computed once: a filter on the column itself would be moved below the
    # projections, and every step of the verdict written out in it again and again
    verdicts = _judged(documents, rules).select("_row", F.explode(F.array("kept")).alias("kept"))
    return verdicts.filter("kept").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "failed_rules")


def _sql_list(items: list[str]) -> str:
    return ", ".join("'" + x + "'" for x in items)


def _sql_passes(rule: Rule) -> str:
    bounds = [f"{rule.ratio} >= {rule.low}"] * (rule.low is not None) + [f"{rule.ratio} <= {rule.high}"] * (rule.high is not None)
    others = f" OR 2 * length(regexp_replace(text, '[^{rule.letters}]+', '', 'g')) < word_chars" if rule.letters else ""
    return f"(n_words < {rule.from_words} OR ({' AND '.join(bounds)}){others})"


_STOPS = [*STOP_WORDS, *(w.capitalize() for w in STOP_WORDS)]
_FAILED = " || ".join(f"CASE WHEN {_sql_passes(r)} THEN '' ELSE ',{r.name}' END" for r in RULES)


def judged_sql(source: str) -> str:
    """The same in SQL over a relation with doc_id and text: windows as rows instead of arrays."""
    return f"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS text FROM {source}),
wl AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM base),
win AS (SELECT doc_id, i, array_to_string(w[i:i+{WINDOW - 1}], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM wl WHERE len(w) >= {WINDOW})),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range({WINDOW}) AS r(k) GROUP BY doc_id),
m AS (SELECT doc_id, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
        greatest(len(lines), 1) AS n_lines, len(list_filter(w, lambda x: x IN ({_sql_list(_STOPS)}))) AS stops,
        len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS letters,
        length(text) - length(regexp_replace(text, '\\p{{Lu}}+', '', 'g')) AS capitals
      FROM wl LEFT JOIN rep USING (doc_id)),
r AS (SELECT *, word_chars / greatest(n_words, 1) AS mean_word_length, n_symbols / greatest(n_words, 1) AS symbol_ratio,
        letters / greatest(n_words, 1) AS letter_ratio, stops / greatest(n_words, 1) AS stop_word_ratio,
        n_dup_lines / n_lines AS dup_line_ratio, capitals / greatest(word_chars, 1) AS capital_ratio,
        n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
f AS (SELECT *, substr({_FAILED}, 2) AS failed_rules FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM f"""


QUERIES = {"op8_quality_rules": query}
ORACLES = {"op8_quality_rules": judged_sql("documents").strip()}
