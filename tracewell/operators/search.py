"""Search, pivots and listings over the event table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import fixed_values as V
from tracewell.schema import EVENT_COLUMNS, with_table

_HIT_COLUMNS = [
    "event_id", "timestamp", "class_uid", "activity_name", "host", "user", "process_name", "process_pid",
    "parent_process_name", "file_hash", "src_ip", "dst_ip", "domain", "registry_key", "raw_data",
]
_PIVOTS = {"hash": ["file_hash"], "ip": ["src_ip", "dst_ip"], "user": ["user"], "host": ["host"], "domain": ["domain"]}


def contains_pattern(col: Column, query: str) -> Column:
    """``LIKE %query%``: the caller's ``%`` and ``_`` are wildcards, a backslash is just a backslash."""
    return F.like(col.cast("string"), F.lit(f"%{query}%"), F.lit("\u0001"))


def shape_hits(events: DataFrame) -> DataFrame:
    """The columns of a search hit with an ISO timestamp in UTC (P5)."""
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    return events.select(*[iso.alias(c) if c == "timestamp" else F.col(c) for c in _HIT_COLUMNS])


def parsed_raw(hits: DataFrame) -> DataFrame:
    """Hits with ``raw_data`` as a value one can reach into; text that is not JSON becomes NULL there."""
    return hits.withColumn("raw", F.try_parse_json("raw_data"))


def search(
    events: DataFrame, query: str, fields: list[str] | None = None, limit: int | None = None
) -> DataFrame:
    """Newest events with ``query`` in any of ``fields`` (P1), all of them or the ``limit`` newest."""
    fields = fields or V.SEARCH_FIELDS
    unknown = set(fields) - set(EVENT_COLUMNS)
    if unknown:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    hit = reduce(lambda a, b: a | b, [contains_pattern(F.col(f), query) for f in fields])
    hits = events.filter(hit).orderBy(F.desc("timestamp"), "event_id")
    return shape_hits(hits if limit is None else hits.limit(limit))


def pivot(events: DataFrame, by: str, value: str, ordered: bool = True) -> DataFrame:
    """All events of one hash, address, user, host or domain, newest first.

    ``by="technique"`` looks for the id in the raw record (P4); see
    :func:`pivot_by_mapping` for the join with mapped techniques.
    """
    if by == "technique":
        hit = contains_pattern(F.col("raw_data"), value)
    elif by in _PIVOTS:
        hit = reduce(lambda a, b: a | b, [F.col(c) == value for c in _PIVOTS[by]])
    else:
        raise ValueError(f"cannot pivot by {by!r}, expected technique or one of {sorted(_PIVOTS)}")
    hits = events.filter(hit)
    return shape_hits(hits.orderBy(F.desc("timestamp")) if ordered else hits)


def pivot_by_mapping(events: DataFrame, mappings: DataFrame, technique_id: str) -> DataFrame:
    """Events that are the evidence of a mapped technique."""
    wanted = mappings.filter(F.col("technique_id") == technique_id).select(F.col("event_id"))
    return shape_hits(events.join(wanted, "event_id", "left_semi"))


def fetch_all_events(events: DataFrame, ordered: bool = True) -> DataFrame:
    """Every event with its table name, in time order."""
    out = with_table(events).select(
        "event_id", "timestamp", "host", "user", "class_uid", "activity_name", "source_type", "table_name"
    )
    return out.orderBy("timestamp") if ordered else out


def event_count(events: DataFrame) -> DataFrame:
    return with_table(events).groupBy("table_name").agg(F.count(F.lit(1)).alias("n"))


def event_total(events: DataFrame) -> DataFrame:
    """Number of events over all tables."""
    return events.agg(F.count(F.lit(1)).alias("n"))
