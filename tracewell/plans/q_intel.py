"""Queries: threat intelligence, hunts, cases.

The provider feed is derived from the events: every provider answers for every
destination address, file hash and queried domain, with an answer made of a
number n taken from the value.  The oracle computes the verdicts from n.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.operators import cases, hunt, intel, ioc, risk
from tracewell.operators.alerts import dedupe_alerts, normalize_alerts
from tracewell.plans.views import ALERTS_CTE, alert_records, oracle, sec_events, sql_ts, ts_text

QUERIES = {}
ORACLES = {}


def _add(name, query, sql=None):
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


# ------------------------------------------------------------------ the feed

_PROVIDERS = ["virustotal", "abuseipdb", "malwarebazaar", "urlhaus", "threatfox", "shodan_internetdb", "ip_api", "otx", "greynoise"]
_T = lambda e: f"CAST({e} AS STRING)"
_RESPONSES = {
    "virustotal": "named_struct('data', named_struct('attributes', named_struct('last_analysis_stats', named_struct('malicious', n % 9, "
    "'harmless', 30, 'suspicious', n % 4), 'tags', array('vt', 'n' || " + _T("n % 3") + "), 'popular_threat_names', "
    "array(named_struct('value', CASE WHEN n % 2 = 0 THEN 'LockBit' ELSE 'Remcos' END), named_struct('value', '')))))",
    "abuseipdb": "named_struct('data', named_struct('abuseConfidenceScore', (n * 7) % 101, 'countryCode', CASE WHEN n % 3 > 0 THEN 'C' || "
    + _T("n % 5") + " END))",
    "malwarebazaar": "named_struct('query_status', CASE WHEN n % 4 = 0 THEN 'hash_not_found' ELSE 'ok' END, 'data', array(named_struct("
    "'signature', 'Fam' || " + _T("n % 3") + ", 'tags', array('mb'), 'first_seen', '2024-01-' || lpad(" + _T("1 + n % 28") + ", 2, '0') || ' 10:00:00')))",
    "urlhaus": "named_struct('query_status', CASE WHEN n % 5 = 0 THEN 'no_results' ELSE 'ok' END, 'urls', array(named_struct('url_status', "
    "CASE WHEN n % 2 = 0 THEN 'online' ELSE 'offline' END)), 'blacklists', named_struct('surbl', CASE WHEN n % 7 = 0 THEN 'listed' ELSE 'not listed' END), "
    "'tags', array('uh'))",
    "threatfox": "named_struct('query_status', CASE WHEN n % 6 < 3 THEN 'no_result' ELSE 'ok' END, 'data', array(named_struct('malware', 'tf' || "
    + _T("n % 4") + ", 'threat_actor', 'TA' || " + _T("n % 3") + ", 'confidence_level', 40 + n % 50)))",
    "shodan_internetdb": "named_struct('vulns', CASE WHEN n % 3 = 0 THEN array('CVE-2024-' || " + _T("1000 + n") + ", 'cve-2023-7', 'other') ELSE array() END, "
    "'ports', array(80, 8000 + n), 'cpes', array('cpe:' || " + _T("n % 2") + "), 'tags', array('sh'))",
    "ip_api": "named_struct('status', CASE WHEN n % 10 = 0 THEN 'fail' ELSE 'success' END, 'country', 'Land' || " + _T("n % 6")
    + ", 'city', 'City', 'as', 'AS' || " + _T("n") + ", 'org', 'Org')",
    "otx": "named_struct('pulse_info', named_struct('count', n % 12, 'pulses', array(named_struct('tags', array('p1', 'p2'), 'malware_families', "
    "array(named_struct('display_name', 'Otx' || " + _T("n % 2") + "))), named_struct('tags', array('p2'), "
    "'malware_families', filter(array(named_struct('display_name', 'x')), f -> false)))))",
    "greynoise": "named_struct('classification', CASE n % 3 WHEN 0 THEN 'malicious' WHEN 1 THEN 'benign' ELSE 'unknown' END, 'noise', n % 2 = 0, 'riot', n % 3 = 1)",
}


def indicators(s, d):
    """Distinct (ioc_type, ioc_value, n) that the events hold."""
    events = sec_events(s, d)
    return events.selectExpr(
        "explode(filter(array(named_struct('t', 'ipv4', 'v', dst_ip), named_struct('t', 'sha256', 'v', file_hash), "
        "named_struct('t', 'domain', 'v', domain)), x -> x.v IS NOT NULL)) AS x"
    ).selectExpr("x.t AS ioc_type", "x.v AS ioc_value").distinct().selectExpr(
        "ioc_type", "ioc_value",
        "CASE ioc_type WHEN 'ipv4' THEN CAST(substring_index(ioc_value, '.', -1) AS INT) ELSE length(ioc_value) + ascii(substring(ioc_value, 2, 1)) END AS n",
    )


def feed(s, d):
    arms = " ".join(f"WHEN '{p}' THEN to_json({r})" for p, r in _RESPONSES.items())
    listed = ", ".join(f"'{p}'" for p in _PROVIDERS)
    return indicators(s, d).selectExpr("*", f"explode(array({listed})) AS provider").selectExpr(
        "provider", "ioc_type", "ioc_value",
        "CASE WHEN n % 17 = 0 THEN 404 WHEN n % 19 = 0 THEN 500 ELSE 200 END AS http_status", f"CASE provider {arms} END AS response",
        "timestamp_seconds(1709251200 + n * 300) AS fetched_at",
    )


def _known(events: str) -> str:
    return (
        "known AS (SELECT DISTINCT ioc_type, ioc_value, CASE ioc_type WHEN 'ipv4' THEN CAST(split_part(ioc_value, '.', 4) AS INT) "
        "ELSE length(ioc_value) + ascii(substr(ioc_value, 2, 1)) END AS n FROM (SELECT 'ipv4' AS ioc_type, dst_ip AS ioc_value "
        f"FROM {events} UNION ALL SELECT 'sha256', file_hash FROM {events} UNION ALL SELECT 'domain', domain FROM {events}) WHERE ioc_value IS NOT NULL)"
    )


def _row(provider, types, status, mal, conf, score, tags="''", fams="''", actors="''", ports="''", cpes="''", vulns="''",
         geo="NULL", first="NULL", engines="NULL", codes=(404,)):
    kinds = ", ".join(f"'{t}'" for t in types)
    missing = " ".join(f"WHEN code = {c} THEN 'not_found'" for c in codes)
    return (
        f"SELECT *, '{provider}' AS provider, CASE {missing} WHEN code >= 400 THEN 'error' ELSE {status} END AS status, {mal} AS mal, "
        f"CAST({conf} AS DOUBLE) AS conf, CAST({score} AS DOUBLE) AS score, {tags} AS tags, {fams} AS fams, {actors} AS actors, {ports} AS ports, "
        f"{cpes} AS cpes, {vulns} AS vulns, {geo} AS geo, {first} AS first_seen, {engines} AS engines FROM coded WHERE ioc_type IN ({kinds})"
    )


_TOTAL = "(n % 9 + 30 + n % 4)"
_VERDICT_CTES = [
    _known("sec_events"),
    "coded AS (SELECT *, CASE WHEN n % 17 = 0 THEN 404 WHEN n % 19 = 0 THEN 500 ELSE 200 END AS code FROM known)",
    "answers AS (" + " UNION ALL ".join([
        _row("virustotal", ["sha256", "domain", "ipv4"], "'ok'", "n % 9 > 3", f"(n % 9) / CAST({_TOTAL} AS DOUBLE)",
             f"(n % 9) * 100 / CAST({_TOTAL} AS DOUBLE)", "'n' || (n % 3) || ',vt'",
             "CASE WHEN n % 2 = 0 THEN 'LockBit' ELSE 'Remcos' END", engines="n % 9"),
        _row("abuseipdb", ["ipv4"], "'ok'", "(n * 7) % 101 >= 50", "((n * 7) % 101) / 100.0", "(n * 7) % 101",
             geo="CASE WHEN n % 3 > 0 THEN 'C' || (n % 5) END", codes=()),
        _row("malwarebazaar", ["sha256"], "CASE WHEN n % 4 = 0 THEN 'not_found' ELSE 'ok' END", "TRUE", "0.95", "90", "'mb'",
             "'Fam' || (n % 3)", first="'2024-01-' || lpad(CAST(1 + n % 28 AS VARCHAR), 2, '0') || ' 10:00:00.000000'", codes=()),
        _row("urlhaus", ["domain", "ipv4"], "CASE WHEN n % 5 = 0 THEN 'not_found' ELSE 'ok' END", "n % 2 = 0 OR n % 7 = 0",
             "CASE WHEN n % 2 = 0 THEN 0.9 ELSE 0.6 END", "CASE WHEN n % 2 = 0 THEN 85 ELSE 40 END", "'uh'", codes=()),
        _row("threatfox", ["ipv4", "domain", "sha256"], "CASE WHEN n % 6 < 3 THEN 'not_found' ELSE 'ok' END", "TRUE",
             "(40 + n % 50) / 100.0", "40 + n % 50", fams="'tf' || (n % 4)", actors="'TA' || (n % 3)", codes=()),
        _row("shodan_internetdb", ["ipv4"], "'ok'", "n % 3 = 0", "CASE WHEN n % 3 = 0 THEN 0.85 ELSE 0.4 END",
             "CASE WHEN n % 3 = 0 THEN 30 ELSE 0 END", "'sh'", ports="'80,' || (8000 + n)", cpes="'cpe:' || (n % 2)",
             vulns="CASE WHEN n % 3 = 0 THEN 'CVE-2024-' || (1000 + n) || ',cve-2023-7,other' ELSE '' END"),
        _row("ip_api", ["ipv4"], "CASE WHEN n % 10 = 0 THEN 'not_found' ELSE 'ok' END", "FALSE", "0", "0", geo="'Land' || (n % 6)", codes=()),
        _row("otx", ["ipv4", "domain", "sha256"], "'ok'", "n % 12 > 0", "least(1.0, (n % 12) * 0.1)", "least(100, (n % 12) * 5)",
             "'p1,p2'", "'Otx' || (n % 2)"),
        _row("greynoise", ["ipv4"], "'ok'", "n % 3 = 0", "CASE n % 3 WHEN 0 THEN 0.85 WHEN 1 THEN 0.1 ELSE 0.4 END",
             "CASE n % 3 WHEN 0 THEN 85 WHEN 1 THEN 0 ELSE 30 END", "CASE WHEN n % 2 = 0 THEN 'internet-scanner' ELSE '' END", codes=(404,)),
    ]) + ")",
    "verdicts AS (SELECT provider, ioc_type, ioc_value, n, status, status = 'ok' AND mal AS mal, CASE WHEN status = 'ok' THEN conf ELSE 0 END AS conf, "
    "CASE WHEN status = 'ok' THEN score ELSE 0 END AS score, "
    + ", ".join(f"CASE WHEN status = 'ok' THEN {c} ELSE '' END AS {c}" for c in ("tags", "fams", "actors", "ports", "cpes", "vulns"))
    + ", CASE WHEN status = 'ok' THEN geo END AS geo, CASE WHEN status = 'ok' THEN first_seen END AS first_seen, "
    "CASE WHEN status = 'ok' THEN engines END AS engines FROM answers)",
]


def _join_lists(df, *names):
    for n in names:
        df = df.withColumn(n, F.array_join(F.array_sort(n), ","))
    return df


def _verdicts(s, d):
    return intel.verdicts(feed(s, d))


def verdict_rows(s, d):
    rows = _join_lists(_verdicts(s, d), "tags", "malware_families", "threat_actors", "open_ports", "cpes", "vulns")
    return ts_text(rows, "first_seen").select(
        "provider", "ioc_type", "ioc_value", "status", "is_malicious", F.round("confidence", 6).alias("confidence"),
        F.round("threat_score", 6).alias("threat_score"), "tags", "malware_families", "threat_actors", "open_ports", "cpes", "vulns",
        "geo_country", "first_seen", F.col("engines_malicious").alias("engines"),
    )


_add(
    "provider_verdicts", verdict_rows,
    oracle(
        "SELECT provider, ioc_type, ioc_value, status, mal AS is_malicious, round(conf, 6) AS confidence, round(score, 6) AS threat_score, tags, "
        "fams AS malware_families, actors AS threat_actors, ports AS open_ports, cpes, vulns, geo AS geo_country, first_seen, engines FROM verdicts",
        *_VERDICT_CTES,
    ),
)


def _merged_sql(source: str = "verdicts") -> str:
    split = lambda c: f"array_to_string(list_sort(list_distinct(list_filter(string_split(string_agg({c}, ','), ','), lambda v: v <> ''))), ',')"
    cve = ("array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split(string_agg(vulns, ','), ','), "
           "lambda v: starts_with(upper(v), 'CVE-')), lambda v: upper(v)))), ',')")
    return (
        "SELECT ioc_type, ioc_value, bool_or(mal) AS is_malicious, round(coalesce(max(score) FILTER (mal), 0), 6) AS threat_score, "
        f"round(coalesce(max(conf) FILTER (mal), 0), 6) AS confidence, {split('tags')} AS tags, {split('fams')} AS malware_families, "
        f"{split('actors')} AS threat_actors, {split('cpes')} AS cpes, {split('vulns')} AS vulns, {cve} AS related_cves, "
        "coalesce(string_agg(DISTINCT CASE WHEN ports <> '' THEN ports END, ','), '') AS open_ports, min(first_seen) AS first_seen, "
        "coalesce(min(geo) FILTER (provider = 'abuseipdb'), min(geo) FILTER (provider = 'ip_api')) AS geo_country "
        f"FROM {source} GROUP BY ioc_type, ioc_value"
    )


def _flat_merged(df):
    lists = ["tags", "malware_families", "threat_actors", "cpes", "vulns", "related_cves", "open_ports"]
    return ts_text(_join_lists(df, *lists), "first_seen").select(
        "ioc_type", "ioc_value", "is_malicious", F.round("threat_score", 6).alias("threat_score"),
        F.round("confidence", 6).alias("confidence"), *lists, "first_seen", "geo_country")


_add("aggregate_verdicts", lambda s, d: _flat_merged(intel.aggregate_verdicts(_verdicts(s, d))), oracle(_merged_sql(), *_VERDICT_CTES))
_AS_OF, _AS_OF_EPOCH, _TTL = "2024-03-01 05:00:00", 1709269200, 14400
_add(
    "fresh_verdicts",
    lambda s, d: _flat_merged(intel.aggregate_verdicts(intel.verdicts(intel.fresh_only(feed(s, d), _AS_OF, _TTL)))),
    oracle(_merged_sql(f"(SELECT * FROM verdicts WHERE {_AS_OF_EPOCH} - (1709251200 + n * 300) < {_TTL})"), *_VERDICT_CTES),
)
_add("malicious_hashes", lambda s, d: intel.malicious_hashes(intel.aggregate_verdicts(_verdicts(s, d))),
     oracle("SELECT DISTINCT ioc_value FROM verdicts WHERE mal AND ioc_type IN ('sha256', 'md5', 'sha1')", *_VERDICT_CTES))


def alert_iocs(s, d):
    """Indicators of the deduplicated alerts, with their verdicts."""
    alerts = dedupe_alerts(normalize_alerts(alert_records(s, d)))
    found = ioc.extract_iocs(alerts, ["title", "description"], ["id"], F.concat(F.lit("alert:"), "id"))
    return intel.enrich_iocs(found, feed(s, d))


_add(
    "enrich_alert_iocs",
    lambda s, d: alert_iocs(s, d).select(
        "id", "type", "value", "source", "defanged", "is_malicious", F.round("threat_score", 6).alias("threat_score"),
        F.round("verdict_confidence", 6).alias("verdict_confidence")),
    oracle(
        "SELECT id, type, value, 'alert:' || id AS source, type = 'domain' AS defanged, coalesce(is_malicious, FALSE) AS is_malicious, "
        "coalesce(threat_score, 0) AS threat_score, coalesce(confidence, 0) AS verdict_confidence FROM (SELECT id, type, "
        "CASE type WHEN 'domain' THEN 'c2-' || substr(title, 7) || '.evil.net' WHEN 'ipv4' THEN regexp_extract(description, '203[.]0[.]113[.][0-9]+') "
        "ELSE substr(description, 5) END AS value FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS rn FROM alerts) a "
        "JOIN (VALUES ('domain', 'beacon'), ('ipv4', 'beacon'), ('cve', 'see')) k(type, word) ON starts_with(description, word) WHERE rn = 1) i "
        "LEFT JOIN merged m ON i.type = m.ioc_type AND lower(i.value) = m.ioc_value",
        ALERTS_CTE, *_VERDICT_CTES, f"merged AS ({_merged_sql()})",
    ),
)


def intel_risk(s, d):
    """Risk factors that need indicators: hashes, families, engines and CVEs per incident."""
    events = sec_events(s, d).withColumn("incident_id", F.col("user"))
    rows = _verdicts(s, d)
    iocs = events.filter("file_hash IS NOT NULL").select("incident_id", F.lit("sha256").alias("type"), F.col("file_hash").alias("value")).distinct()
    cves = events.filter("class_uid = 2004").select(
        "incident_id", F.lit("cve").alias("type"), F.concat(F.lit("CVE-2024-"), (F.col("seq") % 9000 + 1000).cast("string")).alias("value")).distinct()
    factors = risk.risk_factors(events, iocs.unionByName(cves), intel.aggregate_verdicts(rows), results=rows)
    wanted = ["known_malicious_hash", "high_vt_detections", "ransomware_family", "rat_family", "cve_exploitation"]
    return factors.filter(F.col("rule_id").isin(wanted)).withColumn("evidence", F.array_join("evidence", ",")).select(
        "incident_id", "rule_id", "label", "score", "evidence")


def _intel_risk_sql() -> str:
    from tracewell import fixed_values as V

    any_of = lambda words: "(" + " OR ".join(f"contains(lower(fam), '{w}')" for w in words) + ")"
    labels = ", ".join(f"('{r}', {n}, '{t}')" for r, n, t in V.RISK_RULES)
    return oracle(
        "SELECT f.incident_id, f.rule_id, r.description || ': ' || f.detail AS label, r.score, "
        "CASE WHEN keep = 3 THEN e3 ELSE e1 END AS evidence FROM fired f JOIN rules r ON f.rule_id = r.rule_id JOIN firsts e ON f.incident_id = e.incident_id",
        *_VERDICT_CTES,
        "firsts AS (SELECT \"user\" AS incident_id, string_agg(event_id, ',' ORDER BY rn) AS e3, min(event_id) FILTER (rn = 1) AS e1 FROM "
        "(SELECT *, row_number() OVER (PARTITION BY \"user\" ORDER BY timestamp, seq) AS rn FROM sec_events) WHERE rn <= 3 GROUP BY 1)",
        "hashes AS (SELECT DISTINCT \"user\" AS incident_id, file_hash AS v FROM sec_events WHERE file_hash IS NOT NULL)",
        f"rules AS (SELECT * FROM (VALUES {labels}) AS r(rule_id, score, description))",
        "fams AS (SELECT DISTINCT h.incident_id, unnest(string_split(m.malware_families, ',')) AS fam FROM hashes h JOIN "
        f"({_merged_sql()}) m ON m.ioc_type = 'sha256' AND m.ioc_value = h.v WHERE m.malware_families <> '')",
        "fired AS (SELECT incident_id, 'known_malicious_hash' AS rule_id, 'Hash matched threat intel: ' || substr(min(v), 1, 16) || '...' AS detail, 3 AS keep "
        "FROM hashes WHERE v IN (SELECT ioc_value FROM verdicts WHERE mal AND ioc_type = 'sha256') GROUP BY 1 "
        "UNION ALL SELECT incident_id, 'high_vt_detections', 'VT: ' || arg_min(engines, v) || ' engines detected ' || min(v), 3 FROM hashes "
        "JOIN verdicts ON ioc_type = 'sha256' AND ioc_value = v AND provider = 'virustotal' AND engines > 5 GROUP BY 1 "
        f"UNION ALL SELECT incident_id, 'ransomware_family', 'Ransomware family: ' || min(fam), 1 FROM fams WHERE {any_of(V.RANSOMWARE_FAMILIES)} GROUP BY 1 "
        f"UNION ALL SELECT incident_id, 'rat_family', 'RAT family: ' || min(fam), 1 FROM fams WHERE {any_of(V.RAT_FAMILIES)} AND NOT {any_of(V.RANSOMWARE_FAMILIES)} GROUP BY 1 "
        "UNION ALL SELECT \"user\", 'cve_exploitation', 'CVE indicator observed: ' || min('CVE-2024-' || (seq % 9000 + 1000)), 1 FROM sec_events WHERE class_uid = 2004 GROUP BY 1)",
    )


_add("risk_from_intel", intel_risk, _intel_risk_sql())

# ------------------------------------------------------------------ hunts


def _bad_indicators(s, d):
    """Indicators to hunt: what malicious verdicts name, and the tools of the first technique table rows."""
    merged = intel.aggregate_verdicts(_verdicts(s, d)).filter("is_malicious AND threat_score >= 50")
    named = merged.select(F.col("ioc_type").alias("kind"), F.col("ioc_value").alias("value"))
    tools = s.createDataFrame([("process", "shell.exe"), ("process", "katz.exe"), ("domain", "4.example.net")], "kind string, value string")
    return named.unionByName(tools)


_BAD_CTES = [
    *_VERDICT_CTES,
    "bad AS (SELECT ioc_type AS kind, ioc_value AS value FROM verdicts WHERE mal GROUP BY 1, 2 HAVING max(score) >= 50 UNION ALL "
    "SELECT * FROM (VALUES ('process', 'shell.exe'), ('process', 'katz.exe'), ('domain', '4.example.net')) t(kind, value))",
]
_LAST = "list_extract(string_split(lower(process_name), '\\'), -1)"
_add(
    "observed_indicators",
    lambda s, d: hunt.observed_indicators(
        sec_events(s, d), sec_events(s, d).filter("dst_ip IS NOT NULL").select("incident_id", F.lit("ipv4").alias("type"), F.col("dst_ip").alias("value"))),
    oracle(
        f"SELECT DISTINCT incident_id, 'process' AS kind, {_LAST} AS value FROM sec_events WHERE process_name IS NOT NULL UNION SELECT incident_id, 'host', host "
        "FROM sec_events UNION SELECT incident_id, 'user', \"user\" FROM sec_events UNION SELECT incident_id, 'ipv4', dst_ip FROM sec_events WHERE dst_ip IS NOT NULL"
    ),
)
_add(
    "hunt_process", lambda s, d: ts_text(hunt.hunt_process(sec_events(s, d), _bad_indicators(s, d)), "first_seen", "last_seen"),
    oracle(
        "SELECT host, \"user\", process_name, parent_process_name, count(*) AS n, " + sql_ts("min(timestamp)", "first_seen") + ", "
        + sql_ts("max(timestamp)", "last_seen") + f" FROM sec_events WHERE suffix({_LAST}, 'shell.exe') OR suffix({_LAST}, 'katz.exe') GROUP BY 1, 2, 3, 4"),
)
_add(
    "hunt_hash", lambda s, d: ts_text(hunt.hunt_hash(sec_events(s, d), _bad_indicators(s, d)), "first_seen", "last_seen"),
    oracle(
        "SELECT host, \"user\", file_hash, file_path, count(*) AS n, " + sql_ts("min(timestamp)", "first_seen") + ", " + sql_ts("max(timestamp)", "last_seen")
        + " FROM sec_events WHERE file_hash IN (SELECT value FROM bad WHERE kind = 'sha256') GROUP BY 1, 2, 3, 4", *_BAD_CTES),
)
_add(
    "hunt_network",
    lambda s, d: hunt.hunt_network(sec_events(s, d), _bad_indicators(s, d)).withColumn("processes", F.array_join("processes", ",")),
    oracle(
        "SELECT dst_ip, dst_port, host, src_ip, count(*) AS n, coalesce(string_agg(DISTINCT process_name, ',' ORDER BY process_name), '') AS processes "
        "FROM sec_events WHERE dst_ip IN (SELECT value FROM bad WHERE kind = 'ipv4') GROUP BY 1, 2, 3, 4", *_BAD_CTES),
)
_add(
    "hunt_domain", lambda s, d: hunt.hunt_domain(sec_events(s, d), _bad_indicators(s, d)),
    oracle(
        "SELECT src_ip, domain, count(*) AS n FROM sec_events WHERE domain IN (SELECT DISTINCT domain FROM sec_events e JOIN bad b ON b.kind = 'domain' "
        "AND suffix(e.domain, b.value)) GROUP BY 1, 2", *_BAD_CTES),
)
_add(
    "ioc_sweep", lambda s, d: hunt.ioc_sweep(sec_events(s, d), _bad_indicators(s, d)),
    oracle(
        f"SELECT DISTINCT event_id, b.kind, b.value AS indicator FROM sec_events e JOIN bad b ON (b.kind = 'process' AND suffix({_LAST}, b.value)) OR "
        "(b.kind = 'sha256' AND e.file_hash = b.value) OR (b.kind = 'ipv4' AND (e.src_ip = b.value OR e.dst_ip = b.value)) OR "
        "(b.kind = 'domain' AND suffix(e.domain, b.value))", *_BAD_CTES),
)
_add(
    "hunt_sequence", lambda s, d: ts_text(hunt.hunt_sequence(sec_events(s, d), "whoami.exe", "vssadmin.exe", 86400), "timestamp"),
    oracle(
        "SELECT host, bid AS first_event_id, event_id AS second_event_id, " + sql_ts("timestamp", "timestamp") + " FROM (SELECT *, lag(pname) OVER w AS bname, "
        "lag(event_id) OVER w AS bid, lag(timestamp) OVER w AS bts FROM (SELECT *, " + _LAST + " AS pname FROM sec_events WHERE class_uid = 1007) WHERE "
        "pname IN ('whoami.exe', 'vssadmin.exe') WINDOW w AS (PARTITION BY host ORDER BY timestamp, seq)) WHERE pname = 'vssadmin.exe' AND bname = 'whoami.exe' "
        "AND epoch_us(timestamp) - epoch_us(bts) <= 86400000000"),
)
_add(
    "recent_events", lambda s, d: ts_text(hunt.recent(sec_events(s, d), "2024-01-20 00:00:00", 7, 500).select("event_id", "timestamp", "host"), "timestamp"),
    oracle(
        "SELECT event_id, " + sql_ts("timestamp", "timestamp") + ", host FROM (SELECT * FROM sec_events WHERE timestamp BETWEEN "
        "TIMESTAMP '2024-01-13 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' ORDER BY timestamp DESC, seq DESC LIMIT 500)"),
)

# ------------------------------------------------------------------ cases


def reports(s, d):
    """One report per user, with a score made of what the user's events are."""
    events = sec_events(s, d)
    return events.groupBy(F.col("user").alias("incident_id")).agg(
        F.concat(F.lit("R-"), "user").alias("report_id"), F.concat(F.lit("A-"), "user").alias("alert_id"),
        F.concat(F.lit("Hit on "), "user").alias("title"), F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("created_at"),
    ).selectExpr("*", "CAST(n % 101 AS INT) AS total_score").withColumn("severity", risk.severity_band(F.col("total_score"))).withColumn(
        "executive", F.concat(F.lit("Score "), F.col("total_score").cast("string")))


def case_log(s, d):
    """Changes of cases, one per failed or successful logon: statuses, priorities, closings."""
    logons = sec_events(s, d).filter("class_uid = 3002")
    base = logons.select(
        cases.make_id("CASE", F.concat(F.lit("R-"), "user")).alias("case_id"), F.col("timestamp").alias("at"), F.col("seq").alias("ord"))
    changes = cases.status_entries(base.withColumn("status", F.when(F.col("ord") % 3 == 0, "in_progress").when(
        F.col("ord") % 3 == 1, "pending_closure").otherwise("nonsense")))
    closed = cases.close_entries(base.filter("ord % 13 = 0").withColumns({
        "resolution_notes": F.concat(F.lit("done "), F.col("ord").cast("string")), "false_positive": F.col("ord") % 2 == 0}))
    return changes.unionByName(closed, allowMissingColumns=True)


_CASE_ID = "'CASE-' || upper(substr(sha256('R-' || \"user\"), 1, 16))"
_CASE_CTES = [
    "reports AS (SELECT \"user\", 'R-' || \"user\" AS report_id, 'A-' || \"user\" AS alert_id, 'Hit on ' || \"user\" AS t, CAST(count(*) % 101 AS INT) AS score, "
    "min(timestamp) AS created_at FROM sec_events GROUP BY 1)",
    f"cases AS (SELECT {_CASE_ID} AS case_id, 'Investigation: ' || t AS title, CASE WHEN score >= 80 THEN 'P1_CRITICAL' WHEN score >= 60 THEN 'P2_HIGH' "
    "WHEN score < 30 THEN 'P4_LOW' ELSE 'P3_MEDIUM' END AS priority, alert_id, report_id, created_at, CASE WHEN score >= 80 THEN 'critical' "
    "WHEN score >= 60 THEN 'high' WHEN score >= 40 THEN 'medium' WHEN score >= 20 THEN 'low' ELSE 'informational' END AS severity FROM reports)",
    f"log AS (SELECT {_CASE_ID} AS case_id, timestamp AS w, seq AS ord, CASE seq % 3 WHEN 0 THEN 'in_progress' ELSE 'pending_closure' END AS status, "
    f"NULL AS notes, NULL AS closed_at FROM sec_events WHERE class_uid = 3002 AND seq % 3 < 2 UNION ALL SELECT {_CASE_ID}, timestamp, seq, "
    "CASE WHEN seq % 2 = 0 THEN 'false_positive' ELSE 'closed' END, 'done ' || seq, timestamp FROM sec_events WHERE class_uid = 3002 AND seq % 13 = 0)",
    "state AS (SELECT c.case_id, c.title, coalesce(l.status, 'open') AS status, c.priority, c.alert_id, c.report_id, c.severity, l.notes AS resolution_notes, "
    "l.closed_at, coalesce(l.w, c.created_at) AS updated_at FROM cases c LEFT JOIN (SELECT case_id, "
    "arg_max(status, (w, ord, status)) AS status, arg_max(notes, (w, ord)) FILTER (notes IS NOT NULL) AS notes, "
    "arg_max(closed_at, (w, ord)) FILTER (closed_at IS NOT NULL) AS closed_at, max(w) AS w FROM log GROUP BY 1) l ON c.case_id = l.case_id)",
]
_STATE_OUT = ("SELECT case_id, title, status, priority, alert_id, report_id, severity, resolution_notes, " + sql_ts("closed_at", "closed_at") + ", "
              + sql_ts("updated_at", "updated_at") + " FROM state")


def _state(s, d):
    return cases.case_state(cases.cases_from_reports(reports(s, d)), case_log(s, d))


def _flat_state(df):
    return ts_text(df, "closed_at", "updated_at").select(
        "case_id", "title", "status", "priority", "alert_id", "report_id", "severity", "resolution_notes", "closed_at", "updated_at")


_add(
    "cases_from_reports",
    lambda s, d: ts_text(cases.cases_from_reports(reports(s, d)), "created_at").select(
        "case_id", "title", "status", "priority", "alert_id", "report_id", "severity", "tlp", "created_at"),
    oracle("SELECT case_id, title, 'open' AS status, priority, alert_id, report_id, severity, 'GREEN' AS tlp, " + sql_ts("created_at", "created_at")
           + " FROM cases", *_CASE_CTES[:2]),
)
_add("case_state", lambda s, d: _flat_state(_state(s, d)), oracle(_STATE_OUT, *_CASE_CTES))
_add("list_cases", lambda s, d: _flat_state(cases.list_cases(_state(s, d), status="pending_closure", priority="P2_HIGH")),
     oracle(_STATE_OUT + " WHERE status = 'pending_closure' AND priority = 'P2_HIGH'", *_CASE_CTES))
_add("search_cases", lambda s, d: _flat_state(cases.search_cases(_state(s, d), "R-u1_")),
     oracle(_STATE_OUT + " WHERE title LIKE '%R-u1_%' OR case_id LIKE '%R-u1_%' OR alert_id LIKE '%R-u1_%' OR report_id LIKE '%R-u1_%'", *_CASE_CTES))


def case_detail(s, d):
    """Notes of closed cases and artifacts of file events, appended to known cases and listed."""
    known = cases.cases_from_reports(reports(s, d))
    events = sec_events(s, d)
    who = cases.make_id("CASE", F.concat(F.lit("R-"), F.when(F.col("seq") % 5 > 0, F.col("user")).otherwise("nobody")))
    notes = cases.append_notes(known, events.filter("class_uid = 3002").select(
        who.alias("case_id"), F.col("timestamp").alias("at"), F.lit("Analyst").alias("author"), F.concat(F.lit("saw "), "event_id").alias("content"),
        F.array("event_id").alias("evidence_refs")))
    files = cases.append_artifacts(known, events.filter("class_uid = 1001").select(
        who.alias("case_id"), F.col("timestamp").alias("at"), F.col("file_path").alias("name"), F.lit("file").alias("artifact_type"),
        F.col("file_path").alias("path"), F.col("file_hash").alias("hash_value")))
    return ts_text(cases.case_detail(known, notes, files), "at").drop("item_id")


_add(
    "case_detail", case_detail,
    oracle(
        "SELECT c.case_id, c.title, 'open' AS status, i.kind, " + sql_ts("i.at", "at") + ", i.name, i.content, i.path, i.hash_value FROM cases c LEFT JOIN "
        f"(SELECT {_CASE_ID} AS case_id, 'note' AS kind, timestamp AS at, 'Analyst' AS name, 'saw ' || event_id AS content, NULL AS path, NULL AS hash_value "
        f"FROM sec_events WHERE class_uid = 3002 AND seq % 5 > 0 UNION ALL SELECT {_CASE_ID}, 'artifact', timestamp, file_path, 'file', file_path, file_hash "
        "FROM sec_events WHERE class_uid = 1001 AND seq % 5 > 0) i ON c.case_id = i.case_id",
        *_CASE_CTES[:2],
    ),
)
