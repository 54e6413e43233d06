"""How records of each log source become events: detection rules and column mappings.

Rules are Spark SQL over the variant column ``record``: text is parsed once by
Spark, where the same rules as nested Column calls would cross to the JVM tens of
thousands of times.  A mapping entry is a tuple of paths -- the first value that
is there wins -- or SQL text; entries of registered sources may also be
functions from the record column to a column.  A path is one literal key
(``id.orig_h`` is a key) or keys joined by ``/``.  Nothing here reads data; the
projection that uses these tables is in :mod:`tracewell.operators.normalize`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell import fixed_values as V

# ---------------------------------------------------------------- record access

# text of scalars and containers that count as "nothing there" unless they are strings
_FALSY = "('', '0', '-0', '0.0', '-0.0', '0E0', 'false', '[]', '{}')"


def _q(text: object) -> str:
    return str(text) if isinstance(text, int) else "'" + str(text).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _path(path: str) -> str:
    return "'$" + "".join(f"[{k}]" if k.isdigit() else f'["{k}"]' for k in path.split("/")) + "'"


def pick(path: str) -> str:
    """The value at a path as text, whatever it is."""
    return f"try_variant_get(record, {_path(path)}, 'string')"


def _kind(path: str) -> str:
    return f"schema_of_variant(try_variant_get(record, {_path(path)}, 'variant'))"


def _truthy(path: str) -> str:
    """The text at a path, or NULL if it is missing, null, empty, zero, false or an empty container.

    The number 0 is nothing while the string "0" is something, so the type is
    looked at -- but only for the few texts where it decides.
    """
    text = pick(path)
    return f"CASE WHEN {text} IN {_FALSY} THEN CASE {_kind(path)} WHEN 'STRING' THEN nullif({text}, '') END ELSE {text} END"


def get(*paths: str) -> str:
    """First value that is there among ``paths``."""
    return _truthy(paths[0]) if len(paths) == 1 else "coalesce(" + ", ".join(_truthy(p) for p in paths) + ")"


def either(default: object, *paths: str) -> str:
    return f"coalesce({', '.join(_truthy(p) for p in paths)}, {_q(default)})"


def whole(*paths: str) -> str:
    return f"try_cast(trim({get(*paths)}) AS INT)"


def constant(value: object) -> str:
    return _q(value)


def _has(*keys: str) -> str:
    return "(" + " AND ".join(f"try_variant_get(record, {_path(k)}, 'variant') IS NOT NULL" for k in keys) + ")"


def _any(*keys: str) -> str:
    return "(" + " OR ".join(_has(k) for k in keys) + ")"


def _is(path: str, *values: str) -> str:
    return f"coalesce({pick(path)} IN ({', '.join(_q(v) for v in values)}), false)"


def _words(text: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({text}, {_q(w)})" for w in words) + ")"


# ---------------------------------------------------------------- detection, in order

_PROVIDER = _is("source", "Microsoft-Windows-Sysmon")

DETECTION = [
    ("okta", _has("actor", "eventType")),
    ("sentinel", _has("TimeGenerated") + " AND " + _any("InitiatingProcessFileName", "Computer")),
    ("paloalto", f"upper({either('', 'type')}) IN ('TRAFFIC', 'THREAT', 'SYSTEM', 'CONFIG') AND "
     + _any("serial", "device_name", "src")),
    ("cef", _has("DeviceVendor") + f" OR startswith({either('', 'raw')}, 'CEF:')"),
    ("windows_security", f"({_any('EventID', 'event_id')} OR {_PROVIDER}) AND lower({either('', 'Channel', 'channel')}) = 'security'"),
    ("sysmon", _has("EventID") + f" OR {_PROVIDER}"),
    ("auditd", f"lower({pick('type')}) IN ('auditd', 'syscall', 'execve')"),
    ("macos_unified", _is("logType", "macOS")),
    ("android_log", _has("logcat") + f" OR ({get('tag')} IS NOT NULL AND {_has('pid', 'message')})"),
    ("zeek", _has("_path", "ts")),
    ("web_server", _has("status") + " AND " + _any("clientip", "remote_addr", "request")),
    ("wazuh", _has("agent", "rule/id")),
    ("splunk", _has("sourcetype")),
    ("azure_activity", _has("tenantId", "operationName")),
    ("crowdstrike", _any("event_simpleName", "aid")),
    ("elastic_ecs", _has("event.action") + f" OR {get('ecs/version')} IS NOT NULL"),
    ("cloudtrail", _is("eventSource", "cloudtrail.amazonaws.com")),
    ("suricata", _has("event_type", "src_ip")),
    ("firewall", _is("action", "allow", "deny", "block", "drop") + " AND " + _has("src_ip", "dst_ip")),
    ("aws_vpc_flow", _has("srcaddr", "dstaddr") + " AND (" + _has("interface-id")
     + f" OR ({_is('version', '1')} AND {_kind('version')} = 'STRING'))"),
    ("gcp_cloud_logging", _has("logName") + " AND " + _any("protoPayload", "jsonPayload", "httpRequest")),
    ("github_audit", _has("action", "actor") + " AND " + _any("org", "repo")),
    ("k8s_audit", f"startswith({pick('apiVersion')}, 'audit.k8s.io') OR " + _has("requestURI", "user", "verb")),
    ("mde", _has("DeviceId") + " AND (" + _any("MachineGroup", "TenantId") + " OR " + _has("DeviceName", "ActionType") + ")"),
    ("fortigate", _has("devname", "logid", "type")),
    ("leef", f"startswith({either('', 'raw')}, 'LEEF:') OR " + _has("leef_version")),
    ("windows_dhcp", _has("QResult", "Probationtime")),
    ("cisco_ios", _has("mnemonic", "facility") + f" OR contains({pick('message')}, '%ASA-')"),
]

# ---------------------------------------------------------------- pieces of single sources


def _by(value: str, cases: list[tuple], default: object) -> str:
    arms = " ".join(
        f"WHEN {value} IN ({', '.join(_q(w) for w in wanted)}) THEN {_q(result)}" for wanted, result in cases
    )
    return f"CASE {arms} ELSE {_q(default) if not isinstance(default, Sql) else default} END"


def _by_words(text: str, cases: list[tuple[list[str], int]], default: int) -> str:
    arms = " ".join(f"WHEN {_words(text, *words)} THEN {result}" for words, result in cases)
    return f"CASE {arms} ELSE {default} END"


class Sql(str):
    """SQL text where a plain string would be a literal."""


_EVENT_NUMBER = f"coalesce({whole('EventID', 'event_id')}, 0)"
_DHCP_NUMBER = whole("ID", "EventID")


def _zeek(http: object, dns: object, other: object) -> str:
    return _by(pick("_path"), [(["http"], http), (["dns"], dns)], other)


def _tokens(text: str, separator: str) -> str:
    """``k=v`` tokens of a text as structs."""
    return (
        f"transform(filter(split({text}, {separator}, -1), t -> contains(t, '=')), t -> "
        "struct(trim(substring_index(t, '=', 1)) AS k, trim(regexp_replace(t, '^[^=]*=', '')) AS v))"
    )


def _token(key: str) -> str:
    """Value of the last token of that name; '' if the value is empty, NULL if the name is absent."""
    return f"try_element_at(filter(_kv, t -> t.k = {_q(key)}), -1).v"


_LEEF_TEXT = either("", "raw", "message")
_LEEF_BODY = f"CASE WHEN startswith({_LEEF_TEXT}, 'LEEF:') THEN get(split({_LEEF_TEXT}, '[|]', 6), 5) END"


def key_values(cef: int | None, leef: int | None) -> str:
    """The token list ``_kv`` of CEF and LEEF records, split once per record; NULL for all others."""
    arms = []
    if cef is not None:
        arms.append(f"WHEN _n = {cef} AND {_kind('extension')} = 'STRING' THEN {_tokens(pick('extension'), _q(' '))}")
    if leef is not None:
        # names are tab-separated if there is a tab at all
        arms.append(
            f"WHEN _n = {leef} THEN get(transform(array({_LEEF_BODY}), b -> "
            + _tokens("b", "CASE WHEN contains(b, '\\t') THEN '\\t' ELSE ' ' END") + "), 0)"
        )
    return "CASE " + " ".join(arms) + " END" if arms else "CAST(NULL AS ARRAY<STRUCT<k: STRING, v: STRING>>)"


def _cef(*keys: str) -> str:
    """Extension fields, from an object or from ``k=v k=v`` text."""
    from_text = ", ".join(f"nullif({_token(k)}, '')" for k in keys)
    return f"CASE WHEN _kv IS NOT NULL THEN coalesce({from_text}, NULL) ELSE {get(*[f'extension/{k}' for k in keys])} END"


def _leef(*keys: str) -> str:
    """Attributes of the sixth header part, laid over the fields of the record."""
    one = lambda key: f"CASE WHEN {_token(key)} IS NOT NULL THEN nullif({_token(key)}, '') ELSE {get(key)} END"
    return f"coalesce({', '.join(one(k) for k in keys)}, NULL)"


def _asa(word: str, fallback: str) -> str:
    pattern = "r'(?i)" + word + r"\s+(?:interface)?:?\s*([\d.]+)'"
    return f"coalesce(nullif(regexp_extract({either('', 'message', 'msg')}, {pattern}, 1), ''), {get(fallback)})"


_CLF_PARTS = f"split({either('', 'request')}, ' ', 3)"
_PLACE = "coalesce(" + pick("client/geographicalContext/city") + ", ''), ',', coalesce(" + pick(
    "client/geographicalContext/country") + ", '')"
_GCP_NAME = f"lower(coalesce({pick('logName')}, ''))"

# ---------------------------------------------------------------- mappings

# sources whose hash field is a list such as "MD5=...,SHA256=..."
HASH_LISTS = ["sysmon", "sentinel", "cef", "mde"]

MAPPINGS = {
    "sysmon": {
        "class_uid": _by(_EVENT_NUMBER, [
            ([3], V.NETWORK_ACTIVITY), ([11, 23], V.FILE_ACTIVITY), ([12], V.REGISTRY_KEY_ACTIVITY),
            ([13, 14], V.REGISTRY_VALUE_ACTIVITY)], V.PROCESS_ACTIVITY),
         "activity_name": _by(_EVENT_NUMBER, [
            ([3], "Network Connection"), ([11, 23], "File Created"), ([12, 13, 14], "Registry Activity"),
        ], "Process Activity"),
        "host": ("Computer", "host"), "user": ("User", "user"),
        "process_name": ("Image", "process_name"), "process_pid": ("ProcessId", "pid"),
        "process_guid": ("ProcessGuid", "process_guid"),
        "parent_process_name": ("ParentImage", "parent_process"), "parent_process_pid": ("ParentProcessId",),
        "parent_process_guid": ("ParentProcessGuid", "parent_process_guid"),
        "file_path": ("TargetFilename", "file_path"), "file_hash": ("Hashes", "sha256"),
        "src_ip": ("SourceIp", "src_ip"), "src_port": ("SourcePort", "src_port"),
        "dst_ip": ("DestinationIp", "dst_ip"), "dst_port": ("DestinationPort", "dst_port"),
        "protocol": ("Protocol", "protocol"), "registry_key": ("TargetObject", "registry_key"),
    },
    "windows_security": {
        "class_uid": _by(_EVENT_NUMBER, [
            ([4624, 4625], V.AUTHENTICATION), ([4688], V.PROCESS_ACTIVITY)], V.DETECTION_FINDING),
        "activity_name": _by(_EVENT_NUMBER, [
            ([4624], "Logon Success"), ([4625], "Logon Failed"), ([4688], "Process Creation"),
        ], Sql(f"concat('Windows Security Event ', {_EVENT_NUMBER})")),
        "host": ("Computer", "host"), "user": ("TargetUserName", "SubjectUserName", "user"),
        "process_name": ("NewProcessName", "process_name"), "process_pid": ("NewProcessId", "pid"),
        "parent_process_name": ("ParentProcessName",), "parent_process_pid": ("CreatorProcessId",),
        "src_ip": ("IpAddress", "src_ip"), "src_port": ("IpPort", "src_port"),
        "auth_id": ("TargetLogonId", "LogonId"),
    },
    "auditd": {
        "class_uid": constant(V.PROCESS_ACTIVITY), "activity_name": constant("Linux Auditd Event"),
        "host": ("host", "node"), "user": ("auid", "uid"), "process_name": ("exe", "comm"),
        "process_pid": ("pid",), "parent_process_pid": ("ppid",), "file_path": ("path", "name"),
    },
    "macos_unified": {
        "class_uid": constant(V.DETECTION_FINDING), "activity_name": either("macOS Unified Log", "eventMessage"),
        "host": ("hostname",), "process_name": ("processImagePath", "processImageUUID"), "process_pid": ("pid",),
    },
    "android_log": {
        "class_uid": constant(V.DETECTION_FINDING), "activity_name": either("Android System Log", "message"),
        "host": either("android_device", "device"), "process_name": ("tag",), "process_pid": ("pid",),
    },
    "zeek": {
        "class_uid": _zeek(V.HTTP_ACTIVITY, V.DNS_ACTIVITY, V.NETWORK_ACTIVITY),
        "activity_name": _zeek("Zeek HTTP Request", "Zeek DNS Query", "Zeek Network Connection"),
        "src_ip": ("id.orig_h", "src_ip"), "src_port": ("id.orig_p", "src_port"),
        "dst_ip": ("id.resp_h", "dst_ip"), "dst_port": ("id.resp_p", "dst_port"),
        "protocol": ("proto", "protocol"), "domain": f"CASE {pick('_path')} WHEN 'http' THEN {get('host')} WHEN 'dns' THEN {get('query')} END", "session_id": ("uid",),
    },
    "web_server": {
        "class_uid": constant(V.HTTP_ACTIVITY), "activity_name": constant("Web Server Access"),
        "src_ip": ("clientip", "remote_addr", "src_ip"), "user": ("remote_user", "user"),
        "domain": ("host", "server_name"),
    },
    "firewall": {
        "class_uid": constant(V.NETWORK_ACTIVITY),
        "activity_name": f"concat('Firewall Action: ', coalesce({pick('action')}, 'unknown'))",
        "src_ip": ("src_ip", "source_ip"), "src_port": ("src_port", "source_port"),
        "dst_ip": ("dst_ip", "destination_ip"), "dst_port": ("dst_port", "destination_port"),
        "protocol": ("protocol", "proto"),
    },
    "wazuh": {
        "class_uid": constant(V.DETECTION_FINDING), "activity_name": either("Wazuh Alert", "rule/description"),
        "host": ("agent/name", "location"), "user": ("data/srcuser", "data/dstuser", "data/user"),
        "src_ip": ("data/srcip", "srcip"), "dst_ip": ("data/dstip",), "process_name": ("data/process", "data/program"),
    },
    "splunk": {
        "class_uid": constant(V.DETECTION_FINDING), "activity_name": either("Splunk Event", "action", "message"),
        "host": ("host", "dest"), "user": ("user", "src_user"), "process_name": ("process", "app"),
        "src_ip": ("src_ip", "src"), "dst_ip": ("dst_ip", "dest_ip"),
    },
    "azure_activity": {
        "class_uid": constant(V.AUTHENTICATION), "activity_name": either("Azure Activity", "operationName"),
        "user": ("caller", "identity/claims/upn"), "src_ip": ("callerIpAddress", "clientIpAddress"),
    },
    "crowdstrike": {
        "class_uid": constant(V.PROCESS_ACTIVITY), "activity_name": either("Process Activity", "event_simpleName"),
        "host": ("ComputerName", "hostname"), "user": ("UserName", "user"),
        "process_name": ("FileName", "ImageFileName"), "process_pid": ("ProcessId",),
        "parent_process_name": ("ParentProcessName",), "file_hash": ("SHA256HashData",),
    },
    "elastic_ecs": {
        "class_uid": constant(V.PROCESS_ACTIVITY), "activity_name": either("Activity", "event/action"),
        "host": ("host/name",), "user": ("user/name",), "process_name": ("process/name",),
        "process_pid": ("process/pid",), "parent_process_name": ("process/parent/name",),
        "file_path": ("file/path",), "file_hash": ("file/hash/sha256",), "src_ip": ("source/ip",),
        "dst_ip": ("destination/ip",), "dst_port": ("destination/port",),
        "domain": f"CASE WHEN {get('network/protocol')} IS NOT NULL THEN {get('dns/question/name')} END",
    },
    "cloudtrail": {
        "class_uid": constant(V.AUTHENTICATION), "activity_name": either("API Call", "eventName"),
        "user": ("userIdentity/userName",), "src_ip": ("sourceIPAddress",),
    },
    "suricata": {
        "class_uid": constant(V.NETWORK_ACTIVITY), "activity_name": either("Network Activity", "event_type"),
        "src_ip": ("src_ip",), "dst_ip": ("dest_ip", "dst_ip"), "dst_port": ("dest_port", "dst_port"),
    },
    "okta": {
        "class_uid": constant(V.AUTHENTICATION), "activity_name": either("Okta Event", "eventType"),
        "user": ("actor/displayName", "actor/alternateId"), "src_ip": ("client/ipAddress",),
        "host": f"nullif(trim(BOTH ',' FROM concat({_PLACE})), '')", "session_id": ("uuid",),
    },
    "sentinel": {
        "class_uid": _by_words(f"lower({either('', 'Type', 'TableName')})", [
            (["network"], V.NETWORK_ACTIVITY), (["auth", "logon"], V.AUTHENTICATION), (["file"], V.FILE_ACTIVITY),
        ], V.PROCESS_ACTIVITY),
        "activity_name": either("Sentinel Event", "ActionType", "Type"),
        "host": ("DeviceName", "Computer", "ComputerName"), "user": ("AccountName", "Account", "TargetUserName"),
        "process_name": ("InitiatingProcessFileName", "ProcessName"),
        "process_pid": ("InitiatingProcessId", "ProcessId"),
        "parent_process_name": ("InitiatingProcessParentFileName",), "src_ip": ("RemoteIP", "IPAddress"),
        "dst_port": ("RemotePort",), "file_hash": ("SHA256", "InitiatingProcessSHA256"),
        "registry_key": ("RegistryKey",),
    },
    "cef": {
        "class_uid": constant(V.DETECTION_FINDING), "activity_name": either("CEF Event", "name", "Name"),
        "src_ip": _cef("src", "sourceAddress"), "src_port": _cef("spt", "sourcePort"),
        "dst_ip": _cef("dst", "destinationAddress"), "dst_port": _cef("dpt", "destinationPort"),
        "host": f"coalesce({_cef('dhost', 'deviceHostName')}, {get('deviceHostName')})",
        "user": _cef("suser", "sourceUserName"), "process_name": _cef("sproc", "sourceProcessName"),
        "file_path": _cef("filePath", "fname"), "file_hash": _cef("fileHash"), "protocol": _cef("proto"),
    },
    "paloalto": {
        "class_uid": _by_words(
            f"lower({either('', 'type', 'LogType')})", [(["threat"], V.DETECTION_FINDING)], V.NETWORK_ACTIVITY),
        "activity_name": f"concat('PAN-OS ', initcap({either('Traffic', 'type', 'LogType')}), ' Log')",
        "src_ip": ("src", "srcip", "src_ip"), "src_port": ("sport", "src_port"),
        "dst_ip": ("dst", "dstip", "dst_ip"), "dst_port": ("dport", "dst_port"),
        "protocol": ("proto", "protocol"), "user": ("srcuser", "src_user", "dstuser"),
        "host": ("device_name", "hostname", "devicename"), "domain": ("url", "threat_name"),
    },
    "aws_vpc_flow": {
        "class_uid": constant(V.NETWORK_ACTIVITY),
        "activity_name": f"concat('VPC Flow ', upper({either('ACCEPT', 'action', 'action-status')}))",
        "src_ip": ("srcaddr", "src-addr"), "src_port": ("srcport", "src-port"),
        "dst_ip": ("dstaddr", "dst-addr"), "dst_port": ("dstport", "dst-port"),
        "protocol": _by(get("protocol"), [(["6"], "tcp"), (["17"], "udp"), (["1"], "icmp")], Sql(get("protocol"))), "host": ("instance-id", "interface-id"),
    },
    "gcp_cloud_logging": {
        "class_uid": (
            f"CASE WHEN contains({_GCP_NAME}, 'http_request') OR {get('httpRequest')} IS NOT NULL THEN {V.HTTP_ACTIVITY} "
            f"WHEN contains({_GCP_NAME}, 'data_access') THEN {V.FILE_ACTIVITY} ELSE {V.AUTHENTICATION} END"), "activity_name": either("GCP Event", "protoPayload/methodName", "logName"),
        "user": ("protoPayload/authenticationInfo/principalEmail", "jsonPayload/actor/user"),
        "src_ip": ("protoPayload/requestMetadata/callerIp", "httpRequest/remoteIp"),
        "host": ("resource/labels/instance_id", "resource/labels/project_id"),
    },
    "github_audit": {
        "class_uid": constant(V.AUTHENTICATION), "activity_name": either("github_event", "action"),
        "user": ("actor", "user"), "src_ip": ("_source_ip", "ip"), "host": ("org", "business"),
    },
    "k8s_audit": {
        "class_uid": _by(either("", "verb"), [(["get", "list", "watch"], V.FILE_ACTIVITY)], V.PROCESS_ACTIVITY),
        "activity_name": (
            f"concat('k8s.', {either('', 'verb')}, coalesce(concat('.', {get('objectRef/resource')}), ''))"),
         "user": ("user/username",), "src_ip": ("sourceIPs/0",), "host": ("requestURI",),
    },
    "mde": {
        "class_uid": _by_words(either("ProcessActivity", "ActionType"), [
            (["Network"], V.NETWORK_ACTIVITY), (["File"], V.FILE_ACTIVITY), (["Registry"], V.REGISTRY_KEY_ACTIVITY),
            (["Logon", "Auth"], V.AUTHENTICATION),
        ], V.PROCESS_ACTIVITY),
        "activity_name": either("ProcessActivity", "ActionType"),
        "host": ("DeviceName", "ComputerName"), "user": ("AccountName", "InitiatingProcessAccountName"),
        "process_name": ("InitiatingProcessFileName", "ProcessCommandLine"), "process_pid": ("InitiatingProcessId",),
        "parent_process_name": ("InitiatingProcessParentFileName",),
        "file_hash": ("SHA256", "InitiatingProcessSHA256"), "src_ip": ("RemoteIP", "LocalIP"),
        "dst_port": ("RemotePort",), "registry_key": ("RegistryKey",),
    },
    "cisco_ios": {
        "class_uid": constant(V.NETWORK_ACTIVITY), "activity_name": either("Cisco IOS Event", "mnemonic", "facility"),
        "src_ip": _asa("src", "src_ip"), "dst_ip": _asa("dst", "dst_ip"), "host": ("hostname", "host"),
    },
    "fortigate": {
        "class_uid": _by_words(f"lower({either('', 'type', 'subtype')})", [
            (["utm", "ips", "av"], V.DETECTION_FINDING), (["event"], V.PROCESS_ACTIVITY)], V.NETWORK_ACTIVITY),
        "activity_name": either("FortiGate Event", "action", "subtype"),
        "src_ip": ("srcip", "src_ip"), "src_port": ("srcport", "src_port"),
        "dst_ip": ("dstip", "dst_ip"), "dst_port": ("dstport", "dst_port"),
        "protocol": ("proto", "protocol"), "user": ("srcuser", "user"), "host": ("devname",), "domain": ("hostname", "url"),
    },
    "leef": {
        "class_uid": constant(V.DETECTION_FINDING),
        "activity_name": f"coalesce({_leef('devEventId', 'cat')}, 'LEEF Event')",
        "src_ip": _leef("src", "sourceAddress"), "src_port": _leef("srcPort", "spt"),
        "dst_ip": _leef("dst", "destinationAddress"), "dst_port": _leef("dstPort", "dpt"),
        "user": _leef("usrName", "userName"), "host": _leef("dvchost", "deviceHostName"),
        "process_name": _leef("procName", "sourceProcessName"),
    },
    "clf": {
        "class_uid": constant(V.HTTP_ACTIVITY), "activity_name": (
            f"CASE WHEN get({_CLF_PARTS}, 0) <> '' THEN concat('HTTP ', get({_CLF_PARTS}, 0), ' ', "
            f"coalesce(get({_CLF_PARTS}, 1), '')) ELSE 'Web Request' END"),
        "src_ip": ("remote_addr", "clientip", "client_ip"), "user": ("remote_user", "ident"),
        "domain": ("host", "server_name"),
    },
    "windows_dhcp": {
        "class_uid": constant(V.NETWORK_ACTIVITY), "activity_name": _by(_DHCP_NUMBER, [
            ([10], "DHCP Assigned"), ([11], "DHCP Renew"), ([12], "DHCP Released"), ([13], "DHCP Not Found"),
            ([14], "DHCP Declined"), ([15], "DHCP Lease Expired"),
        ], Sql(f"concat('DHCP Event ', coalesce(CAST({_DHCP_NUMBER} AS STRING), 'None'))")),
        "src_ip": ("IPAddress", "ip_address"), "host": ("HostName", "hostname"),
    },
    "generic": {
        "class_uid": constant(V.DETECTION_FINDING), "activity_name": either("Event", "activity", "message"),
        "host": ("host", "hostname"), "user": ("user", "username"), "process_name": ("process", "process_name"),
        "file_path": ("file", "file_path"), "src_ip": ("src_ip", "source_ip"), "dst_ip": ("dst_ip", "destination_ip"),
        "source_type": f"coalesce({pick('raw_source')}, 'generic')",
    },
}
assert set(MAPPINGS) == set(V.SOURCES)


def build(entry: object, record: Column) -> Column | str:
    """SQL text for built-in entries and tuples of paths, a column for functions."""
    if isinstance(entry, tuple):
        return get(*entry)
    return entry if isinstance(entry, str) else entry(record)


def case_of(branches: list[tuple[int, object]], record: Column, kind: str, otherwise: str = "NULL") -> Column:
    """CASE over the source number ``_n``; SQL branches first, then those given as columns."""
    built = [(i, build(entry, record)) for i, entry in branches]
    arms = " ".join(f"WHEN {i} THEN CAST({text} AS {kind})" for i, text in built if isinstance(text, str))
    last = f"CAST({otherwise} AS {kind})"
    case = F.expr(f"CASE _n {arms} ELSE {last} END" if arms else last)
    for i, column in built:
        if not isinstance(column, str):
            case = F.when(F.col("_n") == i, column.cast(kind)).otherwise(case)
    return case
