"""Correlation: links between events that share an entity within a time window.

All joins here are equi-joins on (entity, time bucket) with the exact band as a
residual.  One side is copied into every bucket its band touches: two copies with
buckets two windows wide, or, where rows have many pairs, at most six with buckets
half as wide as the window and a quarter more pairs compared than lie in the band.  A hot entity is thereby spread over its buckets, and a hot
bucket over blocks of bounded size.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tracewell import fixed_values as V
from tracewell.functions.text import explode_once
from tracewell.operators.components import connected_components
from tracewell.schema import with_table
from tracewell.session import BROADCAST_ROWS, counted, durable, shuffles_removed

MICROS = 1_000_000
#: Rows of a side that are paired at once: larger groups of one entity and bucket are cut into blocks.
BLOCK_ROWS = 2_000
#: Pairs that a task compares, about, and the most tasks asked for.
TASK_PAIRS, MOST_TASKS = 10_000_000, 20_000
#: From so many pairs a row on, buckets are one window wide, and half a window wide: comparing costs more than copies.
DENSE_PAIRS = (50, 500)
#: Rows of anchored groups that are handed back at once.
WALK_ROWS = 10_000


def micros(col: str = "timestamp") -> Column:
    return F.unix_micros(F.col(col))


def _bucket_width(window_seconds: float) -> int:
    return max(int(2 * window_seconds * MICROS), 1)


def _band_join(
    left: DataFrame, right: DataFrame, left_us: str, right_us: str, on: list[str], window_seconds: float, back: bool = True
) -> DataFrame:
    """Pairs of rows equal in ``on`` whose times may lie within the window (with ``back=False``: left not before right).

    Rows are counted first, by cells of time and a hash of the entity.  The counts choose the buckets: two windows wide while
    rows have few pairs, so that a row has two copies at most, down to half a window where comparing is the work.  A group with many rows
    is cut into blocks by a hash of the row, each block of one side meets each of the other, and the number of tasks follows the
    pairs to compare: what a task holds and does is bounded however hot an entity or an instant is, and only the number of tasks grows.
    """
    spark, w = left.sparkSession, int(window_seconds * MICROS)
    total, warm = _counted_cells(left, right, left_us, right_us, on, w)
    pairs = total["pairs"] or 0
    dense = sum(pairs > bound * (total["rows"] or 0) for bound in DENSE_PAIRS)
    width = max((2 * w, w, w // 2)[dense], 1)
    group = [*on, "bucket"]
    left = left.withColumn("bucket", F.floor(F.col(left_us) / F.lit(width)))
    start = F.col(right_us) - w if back else F.col(right_us)
    right = right.withColumn("bucket", F.explode(F.sequence(F.floor(start / width), F.floor((F.col(right_us) + w) / width))))
    hot = None if warm is None else _hot_groups(left, right, on, group, warm)
    if hot is not None:

        def in_blocks(df: DataFrame, own: str, other: str) -> DataFrame:
            place = F.pmod(F.xxhash64(*df.columns), F.coalesce(own, F.lit(1))).cast("int")
            copies = F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)
            return df.join(hot, group, "left").withColumn(f"{own}_at", place).withColumn(f"{other}_at", F.explode(copies)).drop(own, other)

        left, right = in_blocks(left, "_left", "_right"), in_blocks(right, "_right", "_left")
        group = [*group, "_left_at", "_right_at"]
    tasks = min(int(pairs / TASK_PAIRS), MOST_TASKS)
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        left, right = left.repartition(tasks, *group), right.repartition(tasks, *group)
    return left.join(right, group)


def _counted_cells(left: DataFrame, right: DataFrame, left_us: str, right_us: str, on: list[str], w: int) -> tuple[Row, DataFrame | None]:
    """How many rows there are and how many pairs, about; and hashes of the entities that may have a group of more than BLOCK_ROWS.

    Rows are counted in cells two and a half windows wide: evenly spread rows have as many pairs in their cell as in buckets
    half a window wide.  A bucket and its copies lie within three cells.
    """
    cell = lambda us: F.floor(F.col(us) / F.lit(max(w * 5 // 2, 1))).alias("cell")
    of = F.xxhash64(*on).alias("of")
    rows = left.select(of, cell(left_us), F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(
        right.select(of, cell(right_us), F.lit(0).alias("l"), F.lit(1).alias("r")))
    cells = rows.groupBy("of", "cell").agg(F.sum("l").alias("l"), F.sum("r").alias("r")).persist(StorageLevel.DISK_ONLY)
    many = (3 * F.col("l") > BLOCK_ROWS) | (3 * F.col("r") > BLOCK_ROWS)
    try:
        with shuffles_removed(left.sparkSession):
            total = cells.agg(
                F.sum(F.col("l").cast("double") * F.col("r")).alias("pairs"), F.sum(F.col("l") + F.col("r")).alias("rows"),
                F.count_if(many).alias("many")).first()
            return total, durable(cells.filter(many).select("of").distinct()) if total["many"] else None
    finally:
        cells.unpersist()


def _hot_groups(left: DataFrame, right: DataFrame, on: list[str], group: list[str], warm: DataFrame) -> DataFrame | None:
    """The groups of which a side has more than BLOCK_ROWS rows, with the blocks of both sides."""
    warm = F.broadcast(warm) if warm.count() <= BROADCAST_ROWS else warm
    size = lambda df, name: df.withColumn("of", F.xxhash64(*on)).join(warm, "of", "left_semi").groupBy(*group).agg(F.count(F.lit(1)).alias(name))
    blocks = lambda name: F.ceil(F.col(name) / F.lit(BLOCK_ROWS)).cast("int").alias(name)
    sizes = size(left, "_left").join(size(right, "_right"), group).filter((F.col("_left") > BLOCK_ROWS) | (F.col("_right") > BLOCK_ROWS))
    with shuffles_removed(left.sparkSession):
        hot = durable(sizes.select(*group, blocks("_left"), blocks("_right")))
    n = hot.count()
    return None if n == 0 else F.broadcast(hot) if n <= BROADCAST_ROWS else hot


def _shown(time_format: str | None) -> Column:
    """The time of an event as it is returned: as text it is made once an event, not once a pair."""
    return F.col("timestamp") if time_format is None else F.date_format("timestamp", time_format)


def _link_keys(guid: Column, pid: Column) -> Column:
    return F.array_compact(F.array(F.concat(F.lit("g:"), guid), F.concat(F.lit("p:"), pid.cast("string"))))


def process_lineage(events: DataFrame, window_seconds: float = 3600, time_format: str | None = None) -> DataFrame:
    """Child and parent process events on one host: by GUID, or by PID where the child has no parent GUID."""
    procs = with_table(events).filter((F.col("table_name") == "processes") & F.col("host").isNotNull())
    child = procs.select(
        "host",
        F.col("event_id").alias("child_event_id"),
        F.col("process_name").alias("child_process"),
        F.col("process_guid").alias("child_guid"),
        _shown(time_format).alias("child_timestamp"),
        micros().alias("child_us"),
        # a child looks for exactly one thing, so the two kinds of link cannot overlap
        F.coalesce(
            F.concat(F.lit("g:"), "parent_process_guid"),
            F.concat(F.lit("p:"), F.col("parent_process_pid").cast("string")),
        ).alias("link"),
    ).filter(F.col("link").isNotNull())
    parent = procs.select(
        "host",
        F.col("event_id").alias("parent_event_id"),
        F.col("process_name").alias("parent_process"),
        F.col("process_guid").alias("parent_guid"),
        _shown(time_format).alias("parent_timestamp"),
        micros().alias("parent_us"),
        F.explode(_link_keys(F.col("process_guid"), F.col("process_pid"))).alias("link"),
    )
    joined = _band_join(child, parent, "child_us", "parent_us", ["host", "link"], window_seconds)
    return joined.filter(
        (F.col("child_event_id") != F.col("parent_event_id"))
        & (F.abs(F.col("child_us") - F.col("parent_us")) <= int(window_seconds * MICROS))
    ).select(
        "child_event_id", "parent_event_id", "host", "child_process", "parent_process",
        "child_guid", "parent_guid", "child_timestamp", "parent_timestamp",
    )


def network_to_process(events: DataFrame, window_seconds: float = 3600, time_format: str | None = None) -> DataFrame:
    """Network events and process events of one host with the same PID or name and agreeing endpoints."""
    events = with_table(events).filter(F.col("host").isNotNull())
    keys = F.explode(F.array_compact(F.array(
        F.concat(F.lit("p:"), F.col("process_pid").cast("string")), F.concat(F.lit("n:"), "process_name"),
    ))).alias("link")
    net = events.filter(F.col("table_name") == "network").select(
        "host", F.col("event_id").alias("network_event_id"), "src_ip", "src_port", "dst_ip", "dst_port",
        _shown(time_format).alias("network_timestamp"), micros().alias("net_us"),
        F.col("process_pid").alias("net_pid"), keys,
    )
    proc = events.filter(F.col("table_name") == "processes").select(
        "host", F.col("event_id").alias("process_event_id"), _shown(time_format).alias("process_timestamp"),
        "process_name", "process_pid", F.col("src_ip").alias("p_src_ip"), F.col("dst_ip").alias("p_dst_ip"),
        F.col("dst_port").alias("p_dst_port"), micros().alias("proc_us"), keys,
    )
    joined = _band_join(net, proc, "net_us", "proc_us", ["host", "link"], window_seconds)
    same_pid = F.coalesce(F.col("net_pid") == F.col("process_pid"), F.lit(False))
    return joined.filter(
        # a pair that agrees on both would come twice: keep it under its PID
        (F.startswith(F.col("link"), F.lit("p:")) | ~same_pid)
        & (F.col("p_src_ip").isNull() | (F.coalesce("src_ip", F.lit("")) == F.col("p_src_ip")))
        & (F.col("p_dst_ip").isNull() | (F.coalesce("dst_ip", F.lit("")) == F.col("p_dst_ip")))
        & (F.col("p_dst_port").isNull() | (F.coalesce("dst_port", F.lit(-1)) == F.col("p_dst_port")))
        & (F.abs(F.col("net_us") - F.col("proc_us")) <= int(window_seconds * MICROS))
    ).select(
        "network_event_id", "process_event_id", "host", "src_ip", "src_port", "dst_ip", "dst_port",
        "network_timestamp", "process_timestamp", "process_name", "process_pid",
    )


def identity_correlation(events: DataFrame, window_seconds: float = 3600, time_format: str | None = None) -> DataFrame:
    """Authentication and network events of one host that share the authenticating address."""
    events = with_table(events).filter(F.col("host").isNotNull())
    auth = events.filter((F.col("table_name") == "auth") & F.col("src_ip").isNotNull()).select(
        "host", F.col("event_id").alias("auth_event_id"), "user", "src_ip", F.col("src_ip").alias("ip"),
        _shown(time_format).alias("auth_timestamp"), "session_id", micros().alias("auth_us"),
    )
    net = events.filter(F.col("table_name") == "network").select(
        "host", F.col("event_id").alias("network_event_id"), F.col("src_ip").alias("network_src_ip"), "dst_ip",
        _shown(time_format).alias("network_timestamp"), micros().alias("net_us"),
        F.explode(F.array_distinct(F.array_compact(F.array("src_ip", "dst_ip")))).alias("ip"),
    )
    joined = _band_join(net, auth, "net_us", "auth_us", ["host", "ip"], window_seconds)
    return joined.filter(F.abs(F.col("auth_us") - F.col("net_us")) <= int(window_seconds * MICROS)).select(
        "auth_event_id", "network_event_id", "host", "user", "src_ip", "network_src_ip", "dst_ip",
        "auth_timestamp", "network_timestamp", "session_id",
    )


def correlation_keys(events: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per event and non-null key (N8): event_id, table_name, correlation_key, correlation_value, timestamp."""
    keys = keys or V.CORRELATION_KEYS
    unknown = set(keys) - set(V.CORRELATION_KEYS)
    if unknown:
        raise ValueError(f"not correlation keys: {sorted(unknown)}")
    pairs = F.filter(
        F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("v")) for k in keys]),
        lambda p: p["v"].isNotNull(),
    )
    return explode_once(with_table(events), ["event_id", "table_name", "timestamp"], pairs, "p").select(
        "event_id", "table_name", F.col("p.k").alias("correlation_key"), F.col("p.v").alias("correlation_value"),
        "timestamp",
    )


def entity_correlation(
    events: DataFrame, window_seconds: float = 3600, keys: list[str] | None = None, values: DataFrame | None = None
) -> DataFrame:
    """Pairs of events that share a key value within the window (C4).

    The earlier event of a pair looks forward only, so two copies suffice, or
    three where there are many pairs.  The number of rows is that of the answer: for a value that
    is everywhere (a protocol, port 443) it grows with the square of its rate.
    :func:`entity_pair_counts` says beforehand how many rows each value gives, and
    ``values`` (correlation_key, correlation_value) names those whose pairs are wanted.
    :func:`entity_links` and :func:`correlate_groups` do without pairs.
    """
    index = correlation_keys(events, keys).withColumn("us", micros())
    if values is not None:
        # counted, since a table made of rows has no size that Spark knows: all events would be shuffled
        index = index.join(counted(values.select("correlation_key", "correlation_value").distinct()), ["correlation_key", "correlation_value"], "left_semi")
    early = index.select(
        "correlation_key", "correlation_value", F.col("event_id").alias("x_id"),
        F.col("table_name").alias("x_table"), F.col("us").alias("x_us"),
    )
    late = index.select(
        "correlation_key", "correlation_value", F.col("event_id").alias("y_id"),
        F.col("table_name").alias("y_table"), F.col("us").alias("y_us"),
    )
    delta = F.col("y_us") - F.col("x_us")
    x_first = F.col("x_id") < F.col("y_id")
    joined = _band_join(late, early, "y_us", "x_us", ["correlation_key", "correlation_value"], window_seconds, back=False)
    return joined.filter(
        (delta <= int(window_seconds * MICROS)) & ((delta > 0) & (F.col("x_id") != F.col("y_id")) | (delta == 0) & x_first)
    ).select(
        F.when(x_first, F.col("x_id")).otherwise(F.col("y_id")).alias("event_a_id"),
        F.when(x_first, F.col("y_id")).otherwise(F.col("x_id")).alias("event_b_id"),
        F.when(x_first, F.col("x_table")).otherwise(F.col("y_table")).alias("table_a"),
        F.when(x_first, F.col("y_table")).otherwise(F.col("x_table")).alias("table_b"),
        "correlation_key", "correlation_value", (delta / MICROS).alias("delta_seconds"),
    )


def entity_pair_counts(events: DataFrame, window_seconds: float = 3600, keys: list[str] | None = None) -> DataFrame:
    """correlation_key, correlation_value, n_events, n_pairs: how many pairs within the window each value has (C4), exact, without forming one.

    Events are counted by (value, time) first.  Let C(t) be the number of a value's events up to t: its pairs are the sum
    over times t of n(t) * (C(t + window) - C(t)), and n * (n - 1) / 2 at one time.  C comes from the running sum inside a
    bucket and the sum of the buckets before, so a value with a third of all events is spread over its buckets.
    """
    width, window_us = _bucket_width(window_seconds), int(window_seconds * MICROS)
    value = ["correlation_key", "correlation_value"]
    times = correlation_keys(events, keys).withColumn("us", micros()).groupBy(*value, "us").agg(F.count(F.lit(1)).alias("n"))
    # a time counts where it is; a question about its end of the window is put there too, behind the times that are equal
    marks = times.select(*value, F.explode(F.array(
        F.struct(F.col("us").alias("at"), F.lit(0).alias("ask"), F.col("n").alias("n"), F.lit(0).cast("bigint").alias("weight")),
        F.struct((F.col("us") + window_us).alias("at"), F.lit(1).alias("ask"), F.lit(0).cast("bigint").alias("n"), F.col("n").alias("weight")),
    )).alias("m")).select(*value, "m.*").withColumn("bucket", F.floor(F.col("at") / F.lit(width)))
    buckets = marks.groupBy(*value, "bucket").agg(F.sum("n").alias("in_bucket"))
    ahead = Window.partitionBy(*value).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(*value, "bucket", F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy(*value, "bucket").orderBy("at", "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = marks.withColumn("inside", F.sum("n").over(inside))
    # summed inside the bucket with the bucket's offset as a factor, so that only one row of a bucket is joined
    sums = running.groupBy(*value, "bucket").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("weight") * F.col("inside") - F.col("n") * F.col("inside")).alias("own"), F.sum(F.col("weight") - F.col("n")).alias("times_ahead"),
        F.sum(F.expr("n * (n - 1) div 2")).alias("ties"))
    return sums.join(buckets, [*value, "bucket"]).groupBy(*value).agg(
        F.sum("n").alias("n_events"), F.sum(F.col("own") + F.col("times_ahead") * F.col("ahead") + F.col("ties")).alias("n_pairs"))


def entity_links(events: DataFrame, window_seconds: float = 3600, keys: list[str] | None = None) -> DataFrame:
    """Each event with the next one of the same key value, if that is within the window (C4, linear form).

    One row at most for each event and key; the links of a value connect exactly the events that its pairs connect.
    Order is time, then event id; the last event of a time bucket meets the first of the next one by a join.
    """
    width, window_us = _bucket_width(window_seconds), int(window_seconds * MICROS)
    on = ["correlation_key", "correlation_value", "bucket"]
    index = correlation_keys(events, keys).withColumn("us", micros()).withColumn("bucket", F.floor(F.col("us") / F.lit(width)))
    event = F.struct("us", "event_id", "table_name")
    following = F.lead(event).over(Window.partitionBy(*on).orderBy("us", "event_id"))
    own = index.select(*on, "event_id", "table_name", "us", following.alias("next"))
    first = index.groupBy(*on).agg(F.min(event).alias("first")).withColumn("bucket", F.col("bucket") - 1)
    ends = own.filter("next IS NULL").join(first, on).withColumn("next", F.col("first")).drop("first")
    delta = F.col("next.us") - F.col("us")
    return own.filter("next IS NOT NULL").unionByName(ends).filter(delta <= window_us).select(
        "event_id", F.col("next.event_id").alias("next_event_id"), "table_name", F.col("next.table_name").alias("next_table"),
        "correlation_key", "correlation_value", (delta / MICROS).alias("delta_seconds"))


def _group_edges(events: DataFrame, window_seconds: float, keys: list[str] | None) -> DataFrame:
    """A linear number of edges with the components of all pairs within the window.

    Time is cut into cells no wider than the window, so the events of one cell
    are all linked to each other: each is tied to the cell's smallest id.  Events
    of different cells can only link if the cells are neighbours, and neighbours
    are connected exactly if the end of one and the start of the next are close
    enough.  Both steps are aggregations and equi-joins; nothing sorts a group.
    """
    width = max(int(window_seconds * MICROS), 1)
    cell = ["correlation_key", "correlation_value", "cell"]
    index = correlation_keys(events, keys).withColumn("us", micros()).withColumn(
        "cell", F.floor(F.col("us") / F.lit(width))
    )
    cells = index.groupBy(*cell).agg(
        F.min("event_id").alias("rep"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        F.count(F.lit(1)).alias("n"),
    )
    star = index.select(*cell, "event_id").join(
        cells.filter("n > 1").select(*cell, "rep"), cell
    ).select(F.col("event_id").alias("u"), F.col("rep").alias("v"))
    following = cells.select(
        "correlation_key", "correlation_value", (F.col("cell") - 1).alias("cell"),
        F.col("rep").alias("next_rep"), F.col("first_us").alias("next_us"),
    )
    chain = cells.join(following, cell).filter(
        F.col("next_us") - F.col("last_us") <= int(window_seconds * MICROS)
    ).select(F.col("rep").alias("u"), F.col("next_rep").alias("v"))
    return star.unionByName(chain).filter("u <> v").distinct()


def correlate_groups(
    events: DataFrame, window_seconds: float = 3600, keys: list[str] | None = None
) -> DataFrame:
    """Events with their group: the component of all pairs within the window, named by its smallest id."""
    return connected_components(
        _group_edges(events, window_seconds, keys), events.select(F.col("event_id").alias("id"))
    ).select(F.col("id").alias("event_id"), F.col("component").alias("group_id"))


def lineage_by_name(events: DataFrame) -> DataFrame:
    """Parent and child names seen together, with how often and when first.

    One row per pair: a parent that started half of everything is a count here, not a list.
    """
    parent, child = F.lower("parent_process_name"), F.lower("process_name")
    return events.select(parent.alias("parent"), child.alias("child"), "timestamp", "seq").filter(
        "parent <> '' AND child <> '' AND parent <> child"
    ).groupBy("parent", "child").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_seen"), F.min("seq").alias("first_seq")
    )


def identity_chain(events: DataFrame, group: str = "incident_id") -> DataFrame:
    """Users of each incident in the order they first appear, spelled as first seen."""
    first = events.filter(F.col("user") != "").groupBy(group, F.lower("user").alias("user_key")).agg(
        F.min(F.struct("timestamp", "seq", "user")).alias("first")
    )
    return first.select(
        group, F.col("first.user").alias("user"), F.col("first.timestamp").alias("first_seen"),
        F.col("first.seq").alias("first_seq"),
    )


# --------------------------------------------------------------------------- anchored groups


class _Open:
    """A group that events may still join: the time it began at, its smallest id, its events, its values, and what it was merged into."""

    __slots__ = ("began", "name", "events", "values", "into")

    def __init__(self, began: int, name: str) -> None:
        self.began, self.name, self.events, self.values, self.into = began, name, [], [], None


def _close(group: _Open, of_value: dict[str, _Open]) -> Iterator[tuple[str, str]]:
    for value in group.values:
        if value in of_value and _root(of_value[value]) is group:
            del of_value[value]
    return ((event, group.name) for event in group.events)


def _root(group: _Open) -> _Open:
    while group.into is not None:
        if group.into.into is not None:
            group.into = group.into.into
        group = group.into
    return group


def _merge(groups: list[_Open]) -> _Open:
    """The groups as one, which began with the earliest; the longest lists are kept, the others appended."""
    oldest = min(groups, key=lambda g: g.began)
    for group in groups:
        if group is not oldest:
            for name in ("events", "values"):
                long, short = sorted((getattr(oldest, name), getattr(group, name)), key=len, reverse=True)
                long.extend(short)
                setattr(oldest, name, long)
                setattr(group, name, None)
            oldest.name, group.into = min(oldest.name, group.name), oldest
    return oldest


def _walk(rows: Iterable[tuple[str, int, str, list[str], int]], window_us: int) -> Iterator[tuple[str, str]]:
    """(event, group) of rows (component, us, event, values, how often) ordered by component and time.

    Only groups that began at most a window ago are held.  A value belongs to one of them at most, since an event
    merges all that share a value with it; so events of one time may come in any order.
    """
    before, of_value, begun = None, {}, deque()
    for component, us, event, values, n in rows:
        while begun and (component != before or us - begun[0].began > window_us):
            group = begun.popleft()
            if group.into is None:
                yield from _close(group, of_value)
        before = component
        found = {id(g): g for g in (_root(of_value[v]) for v in values if v in of_value)}
        if found:
            group = _merge([*found.values()]) if len(found) > 1 else next(iter(found.values()))
            group.name = min(group.name, event)
        else:
            group = _Open(us, event)
            begun.append(group)
        group.events.extend([event] * n)
        for value in values:
            if value not in of_value:
                group.values.append(value)
                of_value[value] = group
    for group in begun:
        if group.into is None:
            yield from _close(group, of_value)


def correlate_anchored(events: DataFrame, window_seconds: float = 3600, keys: list[str] | None = None) -> DataFrame:
    """Events with their anchored group, named by its smallest id.

    In time order an event joins every group that shares a key value and began
    at most one window ago, merging them.  Such groups lie inside the components
    of :func:`correlate_groups`, so components are independent; one no longer than
    the window is a single group.  The events of the others are sorted by component and time
    and walked through once: a task holds the groups begun within one window, never a component,
    and components are dealt over the tasks.  An id that comes several times counts at its first time
    and is returned as often.
    """
    keys = keys or V.CORRELATION_KEYS
    window_us = int(window_seconds * MICROS)
    component = correlate_groups(events, window_seconds, keys).withColumnRenamed("group_id", "component")
    values = F.array_compact(F.array(*[F.concat(F.lit(f"{k}="), F.col(k).cast("string")) for k in keys]))
    placed = durable(events.select("event_id", micros().alias("us"), values.alias("values")).filter("us IS NOT NULL").join(component, "event_id"))
    extent = placed.groupBy("component").agg((F.max("us") - F.min("us")).alias("extent"))
    long = counted(extent.filter(F.col("extent") > window_us).select("component"))
    single = placed.join(long, "component", "left_anti").select("event_id", F.col("component").alias("group_id"))
    first = placed.join(long, "component", "left_semi").groupBy("event_id").agg(
        F.min(F.struct("us", "component", "values")).alias("e"), F.count(F.lit(1)).alias("n"))
    rows = first.select("e.component", "e.us", "event_id", "e.values", "n").repartition("component").sortWithinPartitions("component", "us")
    out = single.schema

    def walk(batches):
        import pyarrow as pa

        found = _walk((row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))), window_us)
        while part := [*islice(found, WALK_ROWS)]:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*part)], out.names)

    return single.unionByName(rows.mapInArrow(walk, out))
