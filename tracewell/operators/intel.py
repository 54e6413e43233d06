"""Threat intelligence: provider responses to verdicts, merging, enrichment.

Responses are a table (provider, ioc_type, ioc_value, http_status, response,
fetched_at).  What each provider's answer means is a small set of SQL rules over
the parsed response; merging is one aggregation per indicator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import fixed_values as V
from tracewell.ext import custom_providers
from tracewell.functions.coerce import parse_iso
from tracewell.sources.mappings import get, pick


def _array(path: str, kind: str = "string") -> str:
    return f"coalesce(try_variant_get(record, '$.{path}', 'array<{kind}>'), array())"


def _double(path: str, default: float = 0) -> str:
    return f"coalesce(try_variant_get(record, '$.{path}', 'double'), {float(default)}D)"


def _one(path: str) -> str:
    """An array with the text at a path, or none."""
    return f"filter(array({get(path)}), v -> v IS NOT NULL)"


_STATS = "try_variant_get(record, '$.data.attributes.last_analysis_stats', 'map<string,double>')"
_ENGINES = _double("data.attributes.last_analysis_stats.malicious")
_TOTAL = f"coalesce(nullif(aggregate(map_values({_STATS}), 0D, (a, v) -> a + coalesce(v, 0D)), 0D), 1D)"
_URLS = _array("urls", "variant")
_ONLINE = f"exists({_URLS}, u -> coalesce(try_variant_get(u, '$.url_status', 'string') = 'online', false))"
_ITEM = "data/0"
_LEVEL = _double("data[0].confidence_level", 50)
_VULNS = _array("vulns")
_PULSES = _array("pulse_info.pulses", "variant")
_PULSE_COUNT = _double("pulse_info.count")
_CLASS = f"coalesce({pick('classification')}, 'unknown')"
_RIOT = "coalesce(try_variant_get(record, '$.riot', 'boolean'), false)"
_NOT_FOUND, _OK = "'not_found'", "'ok'"

# HTTP codes by which a provider says that it does not know the indicator
_MISSING_CODES = {"virustotal": [404], "shodan_internetdb": [404], "otx": [404], "greynoise": [404, 400]}

# provider -> field -> SQL; fields left out take the defaults below
RULES = {
    "virustotal": {
        "status": f"CASE WHEN ioc_type = 'url' THEN 'unsupported' ELSE {_OK} END",
        "engines_malicious": f"CAST({_ENGINES} AS INT)",
        "is_malicious": f"{_ENGINES} > 3", "confidence": f"least(1D, {_ENGINES} / {_TOTAL})",
        "threat_score": f"least(100D, {_ENGINES} * 100 / {_TOTAL})", "tags": _array("data.attributes.tags"),
        "malware_families": "filter(transform(" + _array("data.attributes.popular_threat_names", "variant")
        + ", n -> try_variant_get(n, '$.value', 'string')), v -> v <> '')",
    },
    "abuseipdb": {
        "is_malicious": _double("data.abuseConfidenceScore") + " >= 50",
        "confidence": _double("data.abuseConfidenceScore") + " / 100", "threat_score": _double("data.abuseConfidenceScore"),
        "geo_country": get("data/countryCode", "data/country"),
    },
    "malwarebazaar": {
        "status": f"CASE WHEN {pick('query_status')} = 'hash_not_found' OR size({_array('data', 'variant')}) = 0 "
        f"THEN {_NOT_FOUND} ELSE {_OK} END",
        "is_malicious": "true", "confidence": "0.95D", "threat_score": "90D",
        "malware_families": _one(f"{_ITEM}/signature"), "tags": _array("data[0].tags"),
        "first_seen_text": f"replace({get(_ITEM + '/first_seen')}, ' ', 'T')",
    },
    "urlhaus": {
        "status": f"CASE WHEN {pick('query_status')} IN ('no_results', 'invalid_url') THEN {_NOT_FOUND} ELSE {_OK} END",
        "is_malicious": f"{_ONLINE} OR coalesce({pick('blacklists/surbl')} = 'listed', false)",
        "confidence": f"CASE WHEN {_ONLINE} THEN 0.90D ELSE 0.60D END",
        "threat_score": f"CASE WHEN {_ONLINE} THEN 85D ELSE 40D END", "tags": _array("tags"),
    },
    "threatfox": {
        "status": f"CASE WHEN {pick('query_status')} = 'no_result' OR size({_array('data', 'variant')}) = 0 "
        f"THEN {_NOT_FOUND} ELSE {_OK} END",
        "is_malicious": "true", "confidence": f"{_LEVEL} / 100", "threat_score": _LEVEL,
        "malware_families": _one(f"{_ITEM}/malware"), "threat_actors": _one(f"{_ITEM}/threat_actor"),
        "tags": _array("data[0].tags"),
    },
    "shodan_internetdb": {
        "is_malicious": f"size({_VULNS}) > 0", "confidence": f"CASE WHEN size({_VULNS}) > 0 THEN 0.85D ELSE 0.40D END",
        "threat_score": f"least(100D, size({_VULNS}) * 10D)", "open_ports": _array("ports", "int"), "cpes": _array("cpes"),
        "vulns": _VULNS, "tags": _array("tags"),
    },
    "ip_api": {
        "status": f"CASE WHEN coalesce({pick('status')}, '') <> 'success' THEN {_NOT_FOUND} ELSE {_OK} END",
        "geo_country": pick("country"), "geo_city": pick("city"), "geo_asn": pick("as"), "geo_org": pick("org"),
    },
    "otx": {
        "is_malicious": f"{_PULSE_COUNT} > 0", "confidence": f"least(1D, {_PULSE_COUNT} * 0.1D)",
        "threat_score": f"least(100D, {_PULSE_COUNT} * 5)",
        "tags": f"array_distinct(flatten(transform({_PULSES}, p -> coalesce(try_variant_get(p, '$.tags', 'array<string>'), array()))))",
        "malware_families": f"array_distinct(transform(flatten(transform({_PULSES}, p -> coalesce(try_variant_get(p, "
        "'$.malware_families', 'array<variant>'), array()))), f -> coalesce(try_variant_get(f, '$.display_name', 'string'), '')))",
    },
    "greynoise": {
        "is_malicious": f"{_CLASS} = 'malicious'",
        "confidence": f"CASE WHEN {_CLASS} = 'malicious' THEN 0.85D WHEN {_RIOT} THEN 0.10D ELSE 0.40D END",
        "threat_score": f"CASE WHEN {_CLASS} = 'malicious' THEN 85D WHEN {_RIOT} THEN 0D ELSE 30D END",
        "tags": "CASE WHEN coalesce(try_variant_get(record, '$.noise', 'boolean'), false) THEN array('internet-scanner') ELSE array() END",
    },
}
_DEFAULTS = {
    "status": ("string", "'ok'"), "engines_malicious": ("int", "NULL"), "is_malicious": ("boolean", "false"),
    "confidence": ("double", "0D"), "threat_score": ("double", "0D"),
    **{c: ("array<string>", "array()") for c in
       ("tags", "malware_families", "threat_actors", "campaigns", "cpes", "vulns")},
    "open_ports": ("array<int>", "array()"), "first_seen_text": ("string", "NULL"), "last_seen_text": ("string", "NULL"),
    **{c: ("string", "NULL") for c in ("geo_country", "geo_city", "geo_asn", "geo_org")},
}


def eligible() -> Column:
    """The provider answers for this type of indicator."""
    case = F
    for provider, types in {**V.PROVIDER_TYPES, **{n: t for n, (t, _) in custom_providers().items()}}.items():
        case = case.when(F.col("provider") == provider, F.col("ioc_type").isin(types))
    return case.otherwise(F.lit(False))


def verdicts(feed: DataFrame) -> DataFrame:
    """One verdict per eligible feed row (X2-X10); a failed call keeps its row with status error."""
    custom = custom_providers()
    base = feed.filter(eligible()).withColumn("record", F.try_parse_json("response"))
    failed = (F.coalesce("http_status", F.lit(200)) >= 400) | F.col("record").isNull()

    def field(name: str) -> Column:
        kind, default = _DEFAULTS[name]
        arms = " ".join(f"WHEN '{p}' THEN CAST({rules[name]} AS {kind})" for p, rules in RULES.items() if name in rules)
        col = F.expr(f"CASE provider {arms} ELSE CAST({default} AS {kind}) END" if arms else f"CAST({default} AS {kind})")
        for provider, (_, verdict) in custom.items():
            own = verdict(F.col("record"))
            if name in own:
                col = F.when(F.col("provider") == provider, own[name].cast(kind)).otherwise(col)
        return col

    status, missing = field("status"), F.lit(False)
    for provider, codes in _MISSING_CODES.items():
        missing = missing | ((F.col("provider") == provider) & F.coalesce(F.col("http_status").isin(codes), F.lit(False)))
    status = (
        F.when(status == "unsupported", status).when(missing, "not_found").when(failed, "error").otherwise(status)
    )
    step = base.select(
        "provider", "ioc_type", "ioc_value", *[c for c in ("fetched_at",) if c in feed.columns], status.alias("status"),
        *[field(n).alias(n) for n in _DEFAULTS if n != "status"],
    )
    ok = F.col("status") == "ok"
    out = {}
    for name, (kind, default) in _DEFAULTS.items():
        if name not in ("status", "first_seen_text", "last_seen_text"):
            out[name] = F.when(ok, F.col(name)).otherwise(F.expr(f"CAST({default} AS {kind})"))
    order = F.array_position(F.array(*[F.lit(p) for p in V.PROVIDER_ORDER]), F.col("provider"))
    return step.withColumns({
        **out,
        "first_seen": F.when(ok, parse_iso(F.col("first_seen_text"))), "last_seen": F.when(ok, parse_iso(F.col("last_seen_text"))),
        # registered providers come after the built-in ones
        "provider_ord": F.when(order > 0, order).otherwise(F.lit(1 << 30)).cast("int"),
    }).drop("first_seen_text", "last_seen_text")


_SETS = ["tags", "malware_families", "threat_actors", "campaigns", "cpes", "vulns"]
_GEO = ["geo_country", "geo_city", "geo_asn", "geo_org"]


def aggregate_verdicts(rows: DataFrame) -> DataFrame:
    """One merged verdict per indicator (X11), keyed by type and lower-case value (``ioc_key``).

    List values are exploded first, so the sets that travel are sets of values
    and merge in each task; the other aggregates do not mind the repetition.
    """
    listed = F.concat(*[F.transform(F.col(c), _tagged(c)) for c in [*_SETS, "open_ports"]])
    flat = rows.withColumn("ioc_key", F.lower("ioc_value")).withColumn("item", F.explode_outer(listed))
    bad = (F.col("status") == "ok") & F.col("is_malicious")
    of = lambda kind: F.collect_set(F.when(F.col("item.k") == kind, F.col("item.v")))
    cve = F.upper("item.v")
    merged = flat.groupBy("ioc_type", "ioc_key").agg(
        F.min("ioc_value").alias("ioc_value"), F.bool_or(bad).alias("is_malicious"),
        F.coalesce(F.max(F.when(bad, F.col("threat_score"))), F.lit(0.0)).alias("threat_score"),
        F.coalesce(F.max(F.when(bad, F.col("confidence"))), F.lit(0.0)).alias("confidence"),
        *[F.array_sort(of(c)).alias(c) for c in _SETS],
        F.array_sort(F.collect_set(F.when(F.col("item.k") == "open_ports", F.col("item.v").cast("int")))).alias("open_ports"),
        F.array_sort(F.collect_set(F.when((F.col("item.k") == "vulns") & F.startswith(cve, F.lit("CVE-")), cve))).alias("related_cves"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.min(F.when(F.col("geo_country") != "", F.struct("provider_ord", *_GEO))).alias("geo"),
    )
    nonblank = lambda c: F.filter(F.col(c), lambda v: v != "")
    return merged.withColumns({
        "malware_families": nonblank("malware_families"), "threat_actors": nonblank("threat_actors"),
        **{g: F.col(f"geo.{g}") for g in _GEO},
    }).drop("geo")


def _tagged(kind: str):
    return lambda v: F.struct(F.lit(kind).alias("k"), v.cast("string").alias("v"))


def fresh_only(feed: DataFrame, as_of: Column | str, ttl_seconds: float = V.FEED_TTL_SECONDS) -> DataFrame:
    """The newest answer per provider and indicator, if it is younger than the time to live."""
    now = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")
    age = F.unix_micros(now) - F.unix_micros("fetched_at")
    recent = feed.filter(age < F.lit(int(ttl_seconds * 1000000)))
    rest = [c for c in feed.columns if c not in ("provider", "ioc_type")]
    newest = F.max_by(F.struct(*rest), F.struct("fetched_at", "ioc_value")).alias("n")
    picked = recent.groupBy("provider", "ioc_type", F.lower("ioc_value").alias("_key")).agg(newest)
    return picked.select(*[F.col(c) if c in ("provider", "ioc_type") else F.col(f"n.{c}") for c in feed.columns])


def enrich_iocs(
    iocs: DataFrame, feed: DataFrame, ttl_seconds: float | None = None, as_of: Column | str | None = None
) -> DataFrame:
    """Every indicator with its merged verdict; without one it is not malicious, with scores 0."""
    if ttl_seconds is not None:
        feed = fresh_only(feed, as_of, ttl_seconds)
    merged = aggregate_verdicts(verdicts(feed)).withColumnsRenamed({
        "confidence": "verdict_confidence", "tags": "verdict_tags", "ioc_value": "feed_value"})
    keyed = iocs.withColumns({"ioc_type": F.col("type"), "ioc_key": F.lower("value")})
    joined = keyed.join(merged, ["ioc_type", "ioc_key"], "left")
    return joined.withColumns({
        "is_malicious": F.coalesce("is_malicious", F.lit(False)),
        "threat_score": F.coalesce("threat_score", F.lit(0.0)),
        "verdict_confidence": F.coalesce("verdict_confidence", F.lit(0.0)),
        **{c: F.coalesce(c, F.array().cast("array<string>")) for c in
           ("verdict_tags", "malware_families", "threat_actors", "campaigns", "cpes", "vulns", "related_cves")},
        "open_ports": F.coalesce("open_ports", F.array().cast("array<int>")),
    }).drop("ioc_type", "ioc_key", "feed_value")


def malicious_hashes(merged: DataFrame) -> DataFrame:
    """Distinct hash values with a malicious verdict."""
    return merged.filter(F.col("is_malicious") & F.col("ioc_type").isin("sha256", "md5", "sha1")).select("ioc_value").distinct()
