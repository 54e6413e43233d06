"""Queries: raw records to events, alerts, coercions.

Raw records are derived from the events table: event i becomes a record in the
shape of source number i modulo the number of shapes.  The oracle never sees the
records; it states what each shape must normalize to.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell import fixed_values as V
from tracewell.functions import coerce
from tracewell.operators import alerts, normalize
from tracewell.plans.views import (
    ALERTS_CTE, BASE_CTE, alert_records, base_events, oracle, sec_events, sql_ts, ts_text,
)
from tracewell.sources import logs

QUERIES = {}
ORACLES = {}
INGEST = "2024-03-01 00:00:00"


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


# pieces of values, readable by both engines
H, U = "('H' || CAST(u % 10 AS STRING))", "('u' || CAST(u AS STRING))"
IP, DIP = "('10.0.' || CAST(u % 200 AS STRING) || '.' || CAST(k AS STRING))", "('203.0.113.' || CAST(k AS STRING))"
PORT, PID, TXT = "(1000 + k)", "(1 + k)", "('note ' || CAST(k AS STRING))"
DOM, GUID = "('d' || CAST(k AS STRING) || '.example.net')", "('G-' || CAST(k AS STRING))"
PROC, PARENT = "('p' || CAST(k % 7 AS STRING) || '.exe')", "('q' || CAST(k % 5 AS STRING) || '.exe')"
HASH = "(repeat('ab', 31) || lpad(CAST(k AS STRING), 2, '0'))"
NUM = lambda e: f"CAST({e} AS STRING)"

# source -> (record, expected columns); class_uid and activity_name first
SHAPES = {
    "okta": (
        {"actor": {"displayName": U}, "eventType": "'user.session.start'", "uuid": GUID,
         "client": {"ipAddress": IP, "geographicalContext": {"city": "'Oslo'", "country": "'NO'"}}},
        {"class_uid": "3002", "activity_name": "'user.session.start'", "user": U, "src_ip": IP, "host": "'Oslo,NO'",
         "session_id": GUID}),
    "sentinel": (
        {"TimeGenerated": "'x'", "Computer": H, "Type": "CASE k % 4 WHEN 0 THEN 'DeviceNetworkEvents' WHEN 1 THEN "
         "'DeviceLogonEvents' WHEN 2 THEN 'DeviceFileEvents' ELSE 'DeviceProcessEvents' END", "AccountName": U,
         "InitiatingProcessFileName": PROC, "InitiatingProcessId": PID, "RemoteIP": DIP, "RemotePort": PORT,
         "SHA256": f"'MD5=00,SHA256=' || upper({HASH})", "RegistryKey": TXT},
        {"class_uid": "CASE k % 4 WHEN 0 THEN 4001 WHEN 1 THEN 3002 WHEN 2 THEN 1001 ELSE 1007 END",
         "activity_name": "CASE k % 4 WHEN 0 THEN 'DeviceNetworkEvents' WHEN 1 THEN 'DeviceLogonEvents' WHEN 2 THEN "
         "'DeviceFileEvents' ELSE 'DeviceProcessEvents' END", "host": H, "user": U, "process_name": PROC,
         "process_pid": PID, "src_ip": DIP, "dst_port": PORT, "file_hash": HASH, "registry_key": TXT}),
    "paloalto": (
        {"type": "CASE WHEN k % 2 = 0 THEN 'TRAFFIC' ELSE 'THREAT' END", "serial": "'1'", "src": IP, "sport": PORT,
         "dst": DIP, "dport": "0", "dst_port": NUM(PORT), "proto": "'tcp'", "srcuser": U, "device_name": H, "url": DOM},
        {"class_uid": "CASE WHEN k % 2 = 0 THEN 4001 ELSE 2004 END",
         "activity_name": "'PAN-OS ' || CASE WHEN k % 2 = 0 THEN 'Traffic' ELSE 'Threat' END || ' Log'", "src_ip": IP,
         "src_port": PORT, "dst_ip": DIP, "dst_port": PORT, "protocol": "'tcp'", "user": U, "host": H, "domain": DOM}),
    "cef": (
        {"DeviceVendor": "'v'", "name": TXT, "deviceHostName": H, "extension":
         f"'src=' || {IP} || ' spt=' || {NUM(PORT)} || ' dst=' || {DIP} || ' noise suser=' || {U} || ' proto=udp fname=/a/b'"},
        {"class_uid": "2004", "activity_name": TXT, "src_ip": IP, "src_port": PORT, "dst_ip": DIP, "user": U, "host": H,
         "protocol": "'udp'", "file_path": "'/a/b'"}),
    "windows_security": (
        {"EventID": "CASE k % 4 WHEN 0 THEN 4624 WHEN 1 THEN 4625 WHEN 2 THEN 4688 ELSE 4700 END", "Channel": "'Security'",
         "Computer": H, "TargetUserName": U, "NewProcessName": PROC, "NewProcessId": "'0x1fc'", "ParentProcessName": PARENT,
         "IpAddress": IP, "IpPort": NUM(PORT), "TargetLogonId": GUID},
        {"class_uid": "CASE k % 4 WHEN 0 THEN 3002 WHEN 1 THEN 3002 WHEN 2 THEN 1007 ELSE 2004 END",
         "activity_name": "CASE k % 4 WHEN 0 THEN 'Logon Success' WHEN 1 THEN 'Logon Failed' WHEN 2 THEN 'Process Creation' "
         "ELSE 'Windows Security Event 4700' END", "host": H, "user": U, "process_name": PROC, "parent_process_name": PARENT,
         "src_ip": IP, "src_port": PORT, "auth_id": GUID}),
    "sysmon": (
        {"EventID": "CASE k % 6 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 11 WHEN 3 THEN 12 WHEN 4 THEN 13 ELSE 23 END",
         "Computer": H, "User": U, "Image": PROC, "ProcessId": PID, "ProcessGuid": GUID, "ParentImage": PARENT,
         "ParentProcessId": PID, "TargetFilename": TXT, "Hashes": f"'SHA256=' || {HASH}", "SourceIp": IP,
         "DestinationIp": DIP, "DestinationPort": PORT, "Protocol": "'tcp'", "TargetObject": TXT},
        {"class_uid": "CASE k % 6 WHEN 0 THEN 1007 WHEN 1 THEN 4001 WHEN 2 THEN 1001 WHEN 3 THEN 201001 WHEN 4 THEN 201002 "
         "ELSE 1001 END", "activity_name": "CASE k % 6 WHEN 0 THEN 'Process Activity' WHEN 1 THEN 'Network Connection' "
         "WHEN 2 THEN 'File Created' WHEN 5 THEN 'File Created' ELSE 'Registry Activity' END", "host": H, "user": U,
         "process_name": PROC, "process_pid": PID, "process_guid": GUID, "parent_process_name": PARENT,
         "parent_process_pid": PID, "file_path": TXT, "file_hash": HASH, "src_ip": IP, "dst_ip": DIP, "dst_port": PORT,
         "protocol": "'tcp'", "registry_key": TXT}),
    "auditd": (
        {"type": "'SYSCALL'", "node": H, "uid": "u", "exe": PROC, "pid": NUM(PID), "ppid": PID, "path": TXT},
        {"class_uid": "1007", "activity_name": "'Linux Auditd Event'", "host": H,
         "user": "CASE WHEN u <> 0 THEN CAST(u AS STRING) END", "process_name": PROC, "process_pid": PID,
         "parent_process_pid": PID, "file_path": TXT}),
    "macos_unified": (
        {"logType": "'macOS'", "eventMessage": TXT, "hostname": H, "processImagePath": PROC, "pid": PID},
        {"class_uid": "2004", "activity_name": TXT, "host": H, "process_name": PROC, "process_pid": PID}),
    "android_log": (
        {"tag": PROC, "pid": PID, "message": TXT},
        {"class_uid": "2004", "activity_name": TXT, "host": "'android_device'", "process_name": PROC, "process_pid": PID}),
    "zeek": (
        {"_path": "CASE k % 3 WHEN 0 THEN 'conn' WHEN 1 THEN 'http' ELSE 'dns' END", "ts": "1600000000.5", "id.orig_h": IP,
         "id.orig_p": PORT, "id.resp_h": DIP, "id.resp_p": "443", "proto": "'udp'", "uid": GUID, "host": DOM, "query": DOM},
        {"class_uid": "CASE k % 3 WHEN 0 THEN 4001 WHEN 1 THEN 4002 ELSE 4003 END",
         "activity_name": "CASE k % 3 WHEN 0 THEN 'Zeek Network Connection' WHEN 1 THEN 'Zeek HTTP Request' ELSE "
         "'Zeek DNS Query' END", "src_ip": IP, "src_port": PORT, "dst_ip": DIP, "dst_port": "443", "protocol": "'udp'",
         "domain": f"CASE WHEN k % 3 > 0 THEN {DOM} END", "session_id": GUID}),
    "web_server": (
        {"status": "200", "clientip": "''", "remote_addr": IP, "remote_user": U, "server_name": DOM},
        {"class_uid": "4002", "activity_name": "'Web Server Access'", "src_ip": IP, "user": U, "domain": DOM}),
    "wazuh": (
        {"rule": {"id": "'5710'", "description": TXT}, "agent": {"name": H},
         "data": {"dstuser": U, "srcip": IP, "dstip": DIP, "program": PROC}},
        {"class_uid": "2004", "activity_name": TXT, "host": H, "user": U, "src_ip": IP, "dst_ip": DIP, "process_name": PROC}),
    "splunk": (
        {"sourcetype": "'st'", "message": TXT, "dest": H, "src_user": U, "app": PROC, "src": IP, "dest_ip": DIP},
        {"class_uid": "2004", "activity_name": TXT, "host": H, "user": U, "process_name": PROC, "src_ip": IP, "dst_ip": DIP}),
    "azure_activity": (
        {"tenantId": "'t'", "operationName": TXT, "identity": {"claims": {"upn": U}}, "clientIpAddress": IP},
        {"class_uid": "3002", "activity_name": TXT, "user": U, "src_ip": IP}),
    "crowdstrike": (
        {"event_simpleName": TXT, "aid": "'a'", "ComputerName": H, "UserName": U, "FileName": PROC, "ProcessId": NUM(PID),
         "ParentProcessName": PARENT, "SHA256HashData": f"upper({HASH})"},
        {"class_uid": "1007", "activity_name": TXT, "host": H, "user": U, "process_name": PROC, "process_pid": PID,
         "parent_process_name": PARENT, "file_hash": HASH}),
    "elastic_ecs": (
        {"ecs": {"version": "'8.0'"}, "event": {"action": TXT}, "host": {"name": H}, "user": {"name": U},
         "process": {"name": PROC, "pid": PID, "parent": {"name": PARENT}}, "file": {"path": TXT, "hash": {"sha256": HASH}},
         "source": {"ip": IP}, "destination": {"ip": DIP, "port": PORT}, "network": {"protocol": "'dns'"},
         "dns": {"question": {"name": DOM}}},
        {"class_uid": "1007", "activity_name": TXT, "host": H, "user": U, "process_name": PROC, "process_pid": PID,
         "parent_process_name": PARENT, "file_path": TXT, "file_hash": HASH, "src_ip": IP, "dst_ip": DIP, "dst_port": PORT,
         "domain": DOM}),
    "cloudtrail": (
        {"eventSource": "'cloudtrail.amazonaws.com'", "eventName": "'AssumeRole'", "userIdentity": {"userName": U},
         "sourceIPAddress": IP},
        {"class_uid": "3002", "activity_name": "'AssumeRole'", "user": U, "src_ip": IP}),
    "suricata": (
        {"event_type": "'alert'", "src_ip": IP, "dest_ip": DIP, "dest_port": PORT},
        {"class_uid": "4001", "activity_name": "'alert'", "src_ip": IP, "dst_ip": DIP, "dst_port": PORT}),
    "firewall": (
        {"action": "'deny'", "src_ip": IP, "dst_ip": DIP, "source_port": PORT, "dst_port": "70000", "proto": "'tcp'"},
        {"class_uid": "4001", "activity_name": "'Firewall Action: deny'", "src_ip": IP, "dst_ip": DIP, "src_port": PORT,
         "protocol": "'tcp'"}),
    "aws_vpc_flow": (
        {"version": "'1'", "srcaddr": IP, "dstaddr": DIP, "srcport": PORT, "dstport": NUM(PORT), "action": "'reject'",
         "protocol": "CASE k % 4 WHEN 0 THEN 6 WHEN 1 THEN 17 WHEN 2 THEN 1 ELSE 50 END", "instance-id": H},
        {"class_uid": "4001", "activity_name": "'VPC Flow REJECT'", "src_ip": IP, "dst_ip": DIP, "src_port": PORT,
         "dst_port": PORT, "protocol": "CASE k % 4 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' WHEN 2 THEN 'icmp' ELSE '50' END",
         "host": H}),
    "gcp_cloud_logging": (
        {"logName": "CASE WHEN k % 2 = 0 THEN 'projects/x/data_access' ELSE 'projects/x/activity' END",
         "protoPayload": {"methodName": TXT, "authenticationInfo": {"principalEmail": U}, "requestMetadata": {"callerIp": IP}},
         "resource": {"labels": {"project_id": H}}},
        {"class_uid": "CASE WHEN k % 2 = 0 THEN 1001 ELSE 3002 END", "activity_name": TXT, "user": U, "src_ip": IP, "host": H}),
    "github_audit": (
        {"action": "'repo.create'", "actor": U, "org": H, "ip": IP},
        {"class_uid": "3002", "activity_name": "'repo.create'", "user": U, "host": H, "src_ip": IP}),
    "k8s_audit": (
        {"apiVersion": "'audit.k8s.io/v1'", "verb": "CASE WHEN k % 2 = 0 THEN 'list' ELSE 'create' END",
         "objectRef": {"resource": "'pods'"}, "user": {"username": U}, "sourceIPs": f"array({IP}, {DIP})", "requestURI": TXT},
        {"class_uid": "CASE WHEN k % 2 = 0 THEN 1001 ELSE 1007 END",
         "activity_name": "'k8s.' || CASE WHEN k % 2 = 0 THEN 'list' ELSE 'create' END || '.pods'", "user": U, "src_ip": IP,
         "host": TXT}),
    "mde": (
        {"DeviceId": "'d'", "DeviceName": H, "ActionType": "CASE k % 5 WHEN 0 THEN 'NetworkScan' WHEN 1 THEN 'FileCreated' "
         "WHEN 2 THEN 'RegistrySet' WHEN 3 THEN 'LogonFailed' ELSE 'Other' END", "AccountName": U, "ProcessCommandLine": PROC,
         "InitiatingProcessId": PID, "InitiatingProcessSHA256": HASH, "LocalIP": IP, "RemotePort": PORT, "RegistryKey": TXT},
        {"class_uid": "CASE k % 5 WHEN 0 THEN 4001 WHEN 1 THEN 1001 WHEN 2 THEN 201001 WHEN 3 THEN 3002 ELSE 1007 END",
         "activity_name": "CASE k % 5 WHEN 0 THEN 'NetworkScan' WHEN 1 THEN 'FileCreated' WHEN 2 THEN 'RegistrySet' WHEN 3 THEN "
         "'LogonFailed' ELSE 'Other' END", "host": H, "user": U, "process_name": PROC, "process_pid": PID, "file_hash": HASH,
         "src_ip": IP, "dst_port": PORT, "registry_key": TXT}),
    "fortigate": (
        {"devname": H, "logid": "'1'", "type": "CASE k % 3 WHEN 0 THEN 'utm' WHEN 1 THEN 'event' ELSE 'forward' END",
         "subtype": TXT, "srcip": IP, "srcport": PORT, "dstip": DIP, "dstport": PORT, "proto": "6", "srcuser": U, "url": DOM},
        {"class_uid": "CASE k % 3 WHEN 0 THEN 2004 WHEN 1 THEN 1007 ELSE 4001 END", "activity_name": TXT, "src_ip": IP,
         "src_port": PORT, "dst_ip": DIP, "dst_port": PORT, "protocol": "'6'", "user": U, "host": H, "domain": DOM}),
    "leef": (
        {"raw": f"'LEEF:2.0|Ven|Prod|1|42|src=' || {IP} || chr(9) || 'dstPort=' || {NUM(PORT)} || chr(9) || 'usrName=' || {U}",
         "dst": DIP, "usrName": "'other'", "cat": TXT},
        {"class_uid": "2004", "activity_name": TXT, "src_ip": IP, "dst_ip": DIP, "dst_port": PORT, "user": U}),
    "windows_dhcp": (
        {"QResult": "0", "Probationtime": "0", "ID": "10 + k % 7", "IPAddress": IP, "HostName": H},
        {"class_uid": "4001", "activity_name": "CASE k % 7 WHEN 0 THEN 'DHCP Assigned' WHEN 1 THEN 'DHCP Renew' WHEN 2 THEN "
         "'DHCP Released' WHEN 3 THEN 'DHCP Not Found' WHEN 4 THEN 'DHCP Declined' WHEN 5 THEN 'DHCP Lease Expired' ELSE "
         "'DHCP Event 16' END", "src_ip": IP, "host": H}),
    "cisco_ios": (
        {"mnemonic": "'ADJ'", "facility": "'OSPF'", "message": f"'%ASA-6 Built src interface: ' || {IP} || ' dst ' || {DIP}",
         "hostname": H},
        {"class_uid": "4001", "activity_name": "'ADJ'", "src_ip": IP, "dst_ip": DIP, "host": H}),
    "generic": (
        {"activity": "0", "message": TXT, "hostname": H, "username": U, "process": PROC, "file": TXT, "source_ip":
         "CASE WHEN k % 2 = 0 THEN '2001:DB8:0:0:0:0:0:' || CAST(10 + k % 80 AS STRING) ELSE '300.1.1.1' END", "raw_source": "'feed'"},
        {"class_uid": "2004", "activity_name": TXT, "host": H, "user": U, "process_name": PROC, "file_path": TXT,
         "src_ip": "CASE WHEN k % 2 = 0 THEN '2001:db8::' || CAST(10 + k % 80 AS STRING) END", "source_type": "'feed'"}),
}
_NAMES = list(SHAPES)
_N = len(_NAMES)
_COLUMNS = [
    "class_uid", "activity_name", "host", "user", "process_name", "process_pid", "process_guid", "parent_process_name",
    "parent_process_pid", "parent_process_guid", "file_path", "file_hash", "src_ip", "src_port", "dst_ip", "dst_port",
    "protocol", "domain", "registry_key", "session_id", "auth_id",
]
_INT = {"class_uid", "process_pid", "parent_process_pid", "src_port", "dst_port"}
_TIME = {"timestamp": "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")"}


def _struct(fields: dict) -> str:
    parts = ", ".join(f"'{k}', {_struct(v) if isinstance(v, dict) else v}" for k, v in fields.items())
    return f"named_struct({parts})"


def records_of(s, d, name):
    """(raw_data, seq): every event as a record of one source."""
    fields = SHAPES[name][0] if name == "zeek" else {**SHAPES[name][0], **_TIME}
    return base_events(s, d).selectExpr(f"to_json({_struct(fields)}) AS raw_data", "i AS seq")


def raw_records(s, d):
    """(raw_data, seq): one JSON record per event, shapes in turn; zeek records carry no known time key."""
    arms = " ".join(
        f"WHEN {n} THEN to_json({_struct(SHAPES[name][0] if name == 'zeek' else {**SHAPES[name][0], **_TIME})})"
        for n, name in enumerate(_NAMES)
    )
    return base_events(s, d).selectExpr(f"CASE i % {_N} {arms} END AS raw_data", "i AS seq")


def _expected(column: str, shapes: list[str] | None = None) -> str:
    arms = " ".join(
        f"WHEN {n} THEN {SHAPES[name][1][column]}" for n, name in enumerate(_NAMES) if column in SHAPES[name][1]
    )
    return f"CAST(CASE i % {_N} {arms} END AS {'INT' if column in _INT else 'VARCHAR'}) AS \"{column}\"" if arms else (
        f"CAST(NULL AS VARCHAR) AS \"{column}\"")


_SOURCE = f"CASE i % {_N} " + " ".join(f"WHEN {n} THEN '{'feed' if s == 'generic' else s}'" for n, s in enumerate(_NAMES)) + " END"
_ZEEK = _NAMES.index("zeek")
_WHEN = f"CASE WHEN i % {_N} = {_ZEEK} THEN TIMESTAMP '{INGEST}' ELSE ts END"


def normalized(s, d, parser=None):
    return normalize.normalize(raw_records(s, d), parser=parser, ingest_ts=INGEST)


_add(
    "normalize_records",
    lambda s, d: ts_text(normalized(s, d), "timestamp").select("seq", "source_type", "timestamp", *_COLUMNS),
    f"WITH {BASE_CTE} SELECT i AS seq, {_SOURCE} AS source_type, {sql_ts(_WHEN, 'timestamp')}, "
    + ", ".join(_expected(c) for c in _COLUMNS) + " FROM base",
)
_add(
    "detect_source",
    lambda s, d: normalize.parse_records(raw_records(s, d)).select(
        normalize.detect_source(F.col("record")).alias("source_type")
    ).groupBy("source_type").agg(F.count(F.lit(1)).alias("n")),
    f"WITH {BASE_CTE} SELECT {_SOURCE.replace('feed', 'generic')} AS source_type, count(*) AS n FROM base GROUP BY 1",
)
for _name in _NAMES:
    # every event as a record of one source, through that source's own parser
    _cols = [c for c in _COLUMNS if c in SHAPES[_name][1]]
    _add(
        f"normalize_{_name}",
        lambda s, d, n=_name, c=_cols: normalize.normalize(
            records_of(s, d, n), parser=n, ingest_ts=INGEST).select("seq", *c),
        f"WITH {BASE_CTE} SELECT i AS seq, " + ", ".join(
            f"CAST({SHAPES[_name][1][c]} AS {'INT' if c in _INT else 'VARCHAR'}) AS \"{c}\"" for c in _cols) + " FROM base",
    )


def clf_records(s, d):
    return base_events(s, d).selectExpr(
        f"to_json(named_struct('remote_addr', {IP}, 'request', 'GET /p' || CAST(k AS STRING) || ' HTTP/1.1', 'status', 200, "
        f"'ident', {U}, 'host', {DOM}, 'time', date_format(ts, 'yyyy-MM-dd HH:mm:ss'))) AS raw_data", "i AS seq",
    )


_add(
    "normalize_clf",
    lambda s, d: ts_text(normalize.normalize(clf_records(s, d), parser="clf"), "timestamp").select(
        "seq", "timestamp", "class_uid", "activity_name", "src_ip", "user", "domain"),
    f"WITH {BASE_CTE} SELECT i AS seq, {sql_ts(chr(100) + 'ate_trunc(' + chr(39) + 'second' + chr(39) + ', ts)', 'timestamp')}, "
    f"4002 AS class_uid, 'HTTP GET /p' || CAST(k AS VARCHAR) AS activity_name, {IP} AS src_ip, {U} AS \"user\", {DOM} AS domain FROM base",
)


def plain_lines(s, d):
    """Text lines that are no JSON, JSON without keys, and blank lines, as they stand in a log file."""
    lines = base_events(s, d).selectExpr(
        "CASE k % 4 WHEN 0 THEN 'plain ' || CAST(k AS STRING) WHEN 1 THEN '[' || CAST(k AS STRING) || ']' WHEN 2 THEN '   ' "
        f"ELSE to_json(named_struct('message', {TXT}, 'host', {H})) END AS value", "'app.log' AS file_name", "i AS seq")
    return logs.keep_lines(lines)


_add(
    "normalize_plain_lines",
    lambda s, d: normalize.normalize(plain_lines(s, d), ingest_ts=INGEST).select("seq", "source_type", "activity_name", "host"),
    f"WITH {BASE_CTE} SELECT i AS seq, CASE WHEN k % 4 < 2 THEN 'app.log' ELSE 'generic' END AS source_type, CASE k % 4 WHEN 0 THEN "
    f"'plain ' || CAST(k AS VARCHAR) WHEN 1 THEN '[' || CAST(k AS VARCHAR) || ']' ELSE {TXT} END AS activity_name, "
    f"CASE WHEN k % 4 = 3 THEN {H} END AS host FROM base WHERE k % 4 <> 2",
)


def syslog_lines(s, d):
    return base_events(s, d).selectExpr(
        "CASE WHEN k % 3 < 2 THEN '<' || CAST(k AS STRING) || '>' || CASE WHEN k % 3 = 1 THEN '1 ' ELSE '' END || "
        f"date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") || ' ' || {H} || ' app' || CAST(k % 5 AS STRING) || ' ' || {NUM(PID)} || "
        f"' ID47 - ' || {TXT} ELSE 'odd line ' || CAST(k AS STRING) END AS value", "i AS seq")


_add(
    "syslog_lines",
    lambda s, d: ts_text(normalize.normalize(logs.parse_syslog(syslog_lines(s, d)), ingest_ts=INGEST), "timestamp").select(
        "seq", "source_type", "timestamp", "host", "activity_name"),
    f"WITH {BASE_CTE} SELECT i AS seq, 'syslog' AS source_type, " + sql_ts(
        f"CASE WHEN k % 3 < 2 THEN date_trunc('second', ts) ELSE TIMESTAMP '{INGEST}' END", "timestamp")
    + f", CASE WHEN k % 3 < 2 THEN {H} END AS host, CASE WHEN k % 3 < 2 THEN {TXT} ELSE 'odd line ' || CAST(k AS VARCHAR) END "
    "AS activity_name FROM base",
)


def xml_records(s, d):
    return base_events(s, d).selectExpr(
        "'<Event><System><Provider Name=\"Microsoft-Windows-Sysmon\"/><EventID>' || CAST(CASE WHEN k % 2 = 0 THEN 1 ELSE 3 END AS STRING) || "
        f"'</EventID><TimeCreated SystemTime=\"2024-01-01T00:00:00Z\"/><Channel>Sysmon</Channel><Computer>' || {H} || '</Computer></System>' || "
        f"'<EventData><Data Name=\"Image\">' || {PROC} || '</Data><Data Name=\"DestinationIp\">' || {DIP} || '</Data>' || "
        f"'<Data Name=\"ProcessId\">' || {NUM(PID)} || '</Data><Data Name=\"Empty\"/></EventData></Event>' AS value", "i AS seq")


_add(
    "windows_event_xml",
    lambda s, d: normalize.normalize(logs.windows_event_xml(xml_records(s, d)), ingest_ts=INGEST).select(
        "seq", "source_type", "class_uid", "host", "process_name", "process_pid", "dst_ip"),
    f"WITH {BASE_CTE} SELECT i AS seq, 'sysmon' AS source_type, CASE WHEN k % 2 = 0 THEN 1007 ELSE 4001 END AS class_uid, {H} AS host, "
    f"{PROC} AS process_name, {PID} AS process_pid, {DIP} AS dst_ip FROM base",
)

# ------------------------------------------------------------------ after normalization


def skew(s, d):
    events = sec_events(s, d)
    offsets = events.select("host").distinct().filter("host <> 'H3'").withColumn("offset_seconds", F.length("host") * 1.5)
    return ts_text(normalize.apply_skew(events, offsets, default=-2.0), "timestamp").select("event_id", "timestamp")


_add(
    "clock_skew", skew,
    oracle("SELECT event_id, " + sql_ts(
        "timestamp + to_microseconds(CAST(CASE WHEN host = 'H3' THEN -2.0 ELSE length(host) * 1.5 END * 1000000 AS BIGINT))",
        "timestamp") + " FROM sec_events"),
)


def _damaged(s, d):
    return sec_events(s, d).withColumns({
        "class_uid": F.when(F.col("seq") % 7 == 0, F.lit(None)).when(F.col("seq") % 7 == 1, 9999).otherwise(F.col("class_uid")).cast("int"),
        "activity_name": F.when(F.col("seq") % 5 == 0, "").otherwise(F.col("activity_name")),
        "timestamp": F.when(F.col("seq") % 11 == 0, F.lit(None)).otherwise(F.col("timestamp")).cast("timestamp"),
        "severity_id": (F.col("seq") % 9).cast("int"),
    })


_ENFORCED = (
    "SELECT event_id, CASE WHEN seq % 7 < 2 THEN 2004 ELSE class_uid END AS class_uid, CASE WHEN seq % 5 = 0 THEN 'Unknown' ELSE "
    "activity_name END AS activity_name, " + sql_ts(f"CASE WHEN seq % 11 = 0 THEN TIMESTAMP '{INGEST}' ELSE timestamp END", "timestamp")
    + ", CAST(CASE WHEN seq % 9 <= 6 THEN seq % 9 ELSE 0 END AS INT) AS severity_id FROM sec_events"
)
for _strict, _name, _where in [(False, "enforce_defaults", ""), (True, "enforce_strict", " WHERE seq % 7 <> 0 AND seq % 5 <> 0 AND seq % 11 <> 0")]:
    _add(
        _name,
        lambda s, d, st=_strict: ts_text(normalize.enforce(_damaged(s, d), strict=st, ingest_ts=INGEST), "timestamp").select(
            "event_id", "class_uid", "activity_name", "timestamp", "severity_id"),
        oracle(_ENFORCED + _where),
    )


def ocsf_ids(s, d):
    events = sec_events(s, d).withColumns({
        "activity_id": (F.col("seq") % 23).cast("int"),
        "activity_name": F.when(F.col("seq") % 2 == 0, "Unknown").otherwise(F.col("activity_name")),
    })
    return normalize.with_ocsf_ids(events).select("event_id", "type_uid", "category_uid", "activity_name")


_LABELS = "list_value(" + ", ".join(f"'{n.replace('_', ' ').title()}'" for n in V.ACTIVITY_NAMES) + ")"
_add(
    "ocsf_ids", ocsf_ids,
    oracle("SELECT event_id, CAST(class_uid * 100 + seq % 23 AS INT) AS type_uid, CASE class_uid WHEN 2004 THEN 2 WHEN 3002 THEN 3 "
           "WHEN 4001 THEN 4 WHEN 4002 THEN 4 WHEN 4003 THEN 4 ELSE 1 END AS category_uid, CASE WHEN seq % 2 = 1 THEN activity_name "
           f"ELSE {_LABELS}[CAST(seq % 23 AS INT) + 1] END AS activity_name FROM sec_events"),
)
_FLAT = ["host", "user", "process_name", "process_pid", "process_guid", "parent_process_name", "parent_process_pid",
         "parent_process_guid", "file_path", "file_hash", "src_ip", "src_port", "dst_ip", "dst_port", "domain", "protocol", "session_id"]


def nested_roundtrip(s, d):
    """Flat columns to nested structs, flat columns emptied, and back."""
    nested = normalize.nested_from_flat(sec_events(s, d))
    emptied = nested.withColumns({c: F.lit(None).cast(nested.schema[c].dataType) for c in _FLAT})
    return normalize.flat_from_nested(emptied).select("event_id", *_FLAT)


_add("nested_roundtrip", nested_roundtrip,
     oracle("SELECT event_id, " + ", ".join(f'"{c}"' for c in _FLAT) + " FROM sec_events"))
_add(
    "to_ocsf_network",
    lambda s, d: normalize.to_ocsf(sec_events(s, d), V.NETWORK_ACTIVITY).select(
        "event_id", "type_uid", F.col("connection_info.dst_endpoint.ip").alias("dst_ip"),
        F.col("connection_info.protocol_name").alias("protocol"), F.col("process.name").alias("process"),
        F.col("device.hostname").alias("device"), F.col("actor.user.name").alias("actor"),
        F.col("metadata.event_code").alias("event_code")),
    oracle("SELECT event_id, class_uid * 100 AS type_uid, dst_ip, protocol, process_name AS process, host AS device, \"user\" AS actor, "
           "'4001' AS event_code FROM sec_events WHERE class_uid = 4001"),
)
_add(
    "to_ocsf_auth",
    lambda s, d: normalize.to_ocsf(sec_events(s, d), V.AUTHENTICATION).select(
        "event_id", F.col("session.uid").alias("session_id"), F.col("src_endpoint.ip").alias("src_ip")),
    oracle("SELECT event_id, session_id, src_ip FROM sec_events WHERE class_uid = 3002"),
)


def coercions(s, d):
    """Scalars in good and bad spellings, made of the event columns."""
    raw = base_events(s, d).selectExpr(
        "i", "CASE k % 4 WHEN 0 THEN CAST(k * 900 AS STRING) WHEN 1 THEN ' ' || CAST(k AS STRING) || ' ' WHEN 2 THEN 'x' ELSE '0' END AS port",
        "CASE k % 3 WHEN 0 THEN CAST(unix_seconds(ts) AS STRING) WHEN 1 THEN CAST(unix_millis(ts) AS STRING) ELSE "
        "CAST((unix_micros(ts) + 11644473600000000) * 10 AS STRING) END AS t",
        "CASE k % 3 WHEN 0 THEN 'SHA256=' || upper(repeat('ab', 32)) WHEN 1 THEN repeat('0f', 32) ELSE 'zz' END AS h",
        "CASE k % 4 WHEN 0 THEN 'Web-' || CAST(k AS STRING) || '.Example.COM' WHEN 1 THEN '10.0.0.1' WHEN 2 THEN '-bad' ELSE 'a' END AS dom",
        "CASE k % 4 WHEN 0 THEN ' 10.0.0.' || CAST(k AS STRING) WHEN 1 THEN '010.0.0.1' WHEN 2 THEN '10.0.0.256' ELSE 'FE80::' || CAST(10 + k % 80 AS STRING) END AS ip",
    )
    out = raw.select(
        "i", coerce.coerce_port(F.col("port")).alias("port"), coerce.coerce_utc_datetime(F.col("t")).alias("t"),
        coerce.coerce_sha256(F.col("h")).alias("h"), coerce.coerce_domain(F.col("dom")).alias("dom"), coerce.coerce_ip(F.col("ip")).alias("ip"),
    )
    return out.withColumn("t", F.date_format(F.date_trunc("second", "t"), "yyyy-MM-dd HH:mm:ss"))


_add(
    "coercions", coercions,
    f"WITH {BASE_CTE} SELECT i, CAST(CASE k % 4 WHEN 0 THEN CASE WHEN k * 900 BETWEEN 1 AND 65535 THEN k * 900 END WHEN 1 THEN k END AS INT) AS port, "
    "strftime(ts, '%Y-%m-%d %H:%M:%S') AS t, CASE k % 3 WHEN 0 THEN repeat('ab', 32) WHEN 1 THEN repeat('0f', 32) END AS h, "
    "CASE k % 4 WHEN 0 THEN 'web-' || CAST(k AS VARCHAR) || '.example.com' WHEN 3 THEN 'a' END AS dom, "
    "CASE k % 4 WHEN 0 THEN '10.0.0.' || CAST(k AS VARCHAR) WHEN 3 THEN 'fe80::' || CAST(10 + k % 80 AS VARCHAR) END AS ip FROM base",
)

# ------------------------------------------------------------------ alerts


def _alerts(s, d):
    return alerts.normalize_alerts(alert_records(s, d), ingest_ts=INGEST)


def _flat_alerts(df):
    return ts_text(df, "timestamp").withColumn("tags", F.array_join("tags", ",")).select(
        "id", "title", "description", "severity", "timestamp", "host", "user", "rule_id", "rule_name", "tags", "seq")


_ALERT_OUT = "SELECT id, title, description, severity, " + sql_ts("timestamp", "timestamp") + ", host, \"user\", rule_id, rule_name, tags, seq FROM "
_add("normalize_alerts", lambda s, d: _flat_alerts(_alerts(s, d)), oracle(_ALERT_OUT + "alerts", ALERTS_CTE))
_add("dedupe_alerts", lambda s, d: _flat_alerts(alerts.dedupe_alerts(_alerts(s, d))),
     oracle(_ALERT_OUT + "(SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM alerts) WHERE rn = 1", ALERTS_CTE))
