"""Schemas of the tables that operators exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell import fixed_values as V

_TYPES = {
    "STRING": T.StringType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(), "TIMESTAMP": T.TimestampType(), "ARRAY<STRING>": T.ArrayType(T.StringType()),
}


def _struct(columns: str) -> T.StructType:
    """A schema from "name TYPE, ..." that needs no running session."""
    return T.StructType([T.StructField(*(lambda n, t: (n, _TYPES[t]))(*c.split())) for c in columns.split(", ")])


EVENT_SCHEMA = _struct(
    "event_id STRING, source_type STRING, raw_data STRING, timestamp TIMESTAMP, class_uid INT, "
    "activity_id INT, activity_name STRING, severity_id INT, status_id INT, host STRING, user STRING, "
    "process_name STRING, process_pid INT, process_guid STRING, parent_process_name STRING, "
    "parent_process_pid INT, parent_process_guid STRING, file_path STRING, file_hash STRING, "
    "src_ip STRING, src_port INT, dst_ip STRING, dst_port INT, protocol STRING, domain STRING, "
    "registry_key STRING, session_id STRING, auth_id STRING, seq BIGINT, incident_id STRING"
)
EVENT_COLUMNS = EVENT_SCHEMA.fieldNames()

IOC_SCHEMA = _struct(
    "type STRING, value STRING, original_value STRING, confidence DOUBLE, source STRING, "
    "defanged BOOLEAN, tags ARRAY<STRING>, kill_chain_phase STRING"
)

ALERT_SCHEMA = _struct(
    "id STRING, title STRING, description STRING, severity STRING, source STRING, timestamp TIMESTAMP, "
    "host STRING, user STRING, rule_id STRING, rule_name STRING, tags ARRAY<STRING>, raw STRING, seq BIGINT"
)

FEED_SCHEMA = _struct(
    "provider STRING, ioc_type STRING, ioc_value STRING, http_status INT, response STRING, fetched_at TIMESTAMP"
)


def complete_events(df: DataFrame) -> DataFrame:
    """Bring a partial event table to ``EVENT_SCHEMA``: absent columns become NULL, ids default to 0."""
    have = set(df.columns)
    out = []
    for field in EVENT_SCHEMA:
        if field.name in have:
            col = F.col(field.name).cast(field.dataType)
        else:
            col = F.lit(None).cast(field.dataType)
        if field.name in ("activity_id", "severity_id", "status_id"):
            col = F.coalesce(col, F.lit(0))
        if field.name == "seq" and "seq" not in have:
            col = F.lit(0).cast("bigint")
        out.append(col.alias(field.name))
    return df.select(*out)


def route_table(class_uid: Column) -> Column:
    """Class number to correlation table."""
    expr = None
    for table in V.TABLES[:-1]:
        classes = [c for c, t in V.TABLE_BY_CLASS.items() if t == table]
        expr = F.when(class_uid.isin(classes), table) if expr is None else expr.when(class_uid.isin(classes), table)
    return expr.otherwise(V.TABLES[-1])


def with_table(events: DataFrame) -> DataFrame:
    if "table_name" in events.columns:
        return events
    return events.withColumn("table_name", route_table(F.col("class_uid")))


def project_table(events: DataFrame, table: str) -> DataFrame:
    """The rows and columns of one correlation table."""
    if table not in V.TABLES:
        raise ValueError(f"unknown table {table!r}, expected one of {V.TABLES}")
    keep = V.TABLE_COLUMNS["base"] + V.TABLE_COLUMNS[table]
    return with_table(events).filter(F.col("table_name") == table).select(*keep)


def sql_literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (int, float)):
        return repr(value)
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def dim_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A small fixed table as an inline VALUES relation (no Python job, known size)."""
    body = ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")
