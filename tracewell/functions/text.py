"""Text helpers on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def explode_once(df: DataFrame, keep: list[str], items: Column, name: str) -> DataFrame:
    """``keep`` and a row for every item of the array ``items`` that is not null.

    Spark looks below a plain explode whether the array is empty, and computes the array, and the columns it is made of,
    once more for that.
    """
    return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def non_empty(col: Column) -> Column:
    return F.when(col != "", col)


def basename(col: Column, both: bool = True) -> Column:
    """Last path segment in lower case; ``both`` splits at ``/`` too, otherwise only at a backslash."""
    text = F.lower(F.coalesce(col, F.lit("")))
    if both:
        text = F.replace(text, F.lit("/"), F.lit("\\"))
    return F.substring_index(text, "\\", -1)


def contains_any(col: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(w)) for w in words])


def starts_with_any(col: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(col, F.lit(w)) for w in words])


def ends_with_any(col: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.endswith(col, F.lit(w)) for w in words])


def python_regex(pattern: str, ignore_case: bool = False) -> str:
    """Java form of a pattern whose classes and boundaries are Unicode-aware."""
    return ("(?iU)" if ignore_case else "(?U)") + pattern


def canonical_json(col: Column) -> Column:
    """A JSON text with the keys of every object sorted, at every depth, and a space behind ``,`` and ``:``.

    Variants keep the keys of an object in order, so parsing sorts them.  What is no JSON, or names a key twice, is null.
    """
    # escaped backslashes and quotes stand aside as control characters, which JSON never holds as they are
    marks = [("\\\\", "\x01"), ('\\"', "\x02")]
    text = reduce(lambda t, m: F.replace(t, F.lit(m[0]), F.lit(m[1])), marks, F.to_json(F.try_parse_json(col)))
    spaced = lambda part: F.replace(F.replace(part, F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": "))
    parts = F.transform(F.split(text, '"'), lambda part, i: F.when(i % 2 == 0, spaced(part)).otherwise(part))
    return reduce(lambda t, m: F.replace(t, F.lit(m[1]), F.lit(m[0])), marks, F.array_join(parts, '"'))
