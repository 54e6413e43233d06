"""Indicator extraction from text columns.

One scan: the text of a row is un-defanged, encoded commands in it are decoded
into further texts, every pattern yields an array of matches, and one explode
turns them into rows.  Normalization, validation and scoring are plain columns
on those rows.  Removing duplicates shuffles indicators, never texts.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell import fixed_values as V
from tracewell.functions.text import let, python_regex

_HASHES = ["sha1", "sha256", "sha512", "md5", "jarm"]
_HASH_LENGTH = {"md5": 32, "sha1": 40, "sha256": 64, "jarm": 62}
_CONTEXT_ORDER = {"ja3": 100, "imphash": 110, "ssdeep": 120, "tlsh": 130, "process": 140, "user": 150}
_DECODED_ORDER, _CRADLE_ORDER, _AMSI_ORDER = 200, 300, 310
# the pattern with letters that ignore case spelled out, which is a faster class: three other letters are an i, s or k to it
_ENCODED_COMMAND = "(?i:" + V.ENCODED_COMMAND_PATTERN.replace("([A-Za-z0-9+/=]{20,})", ")([A-Za-z0-9+/=\u0130\u0131\u017f\u212a]{20,})")
# how a match of these patterns begins: at the head of a word
_AS_WORDS = ["asn", "btcwallet", "xmrwallet", *_HASHES]
_WORD_HEADS = r"\b(?:(?i:AS)\d|(?:bc1|[13])[a-zA-HJ-NP-Z0-9]{25}|4[0-9AB][1-9A-HJ-NP-Za-km-z]{93}|(?:[tT]1)?[a-fA-F0-9]{32})"
# base64 of UTF-16: a decoded text has at most 3/8 of the letters of its argument
_SHRINK = 8 / 3


def refang(text: Column) -> Column:
    """Undo defanging by ordered literal replacement."""
    refanged = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), V.REFANG, text)
    # what holds no form holds no longer one that begins with it
    forms = [a for a, _ in V.REFANG if not any(a != b and a.startswith(b) for b, _ in V.REFANG)]
    return F.when(reduce(lambda a, b: a | b, [F.contains(text, F.lit(form)) for form in forms]), refanged).otherwise(text)


def _all(text: Column, pattern: str, group: int = 0, ignore_case: bool = False) -> Column:
    return F.regexp_extract_all(text, F.lit(python_regex(pattern, ignore_case)), F.lit(group))


def decoded_commands(text: Column) -> Column:
    """Texts hidden in ``-enc <base64>`` arguments, as UTF-16LE with broken units left out."""

    def decode(argument: Column) -> Column:
        return let(F.replace(argument, F.lit("="), F.lit("")), letters)

    def letters(data: Column) -> Column:
        over = F.length(data) % 4
        padded = F.concat(data, F.when(over == 2, "==").when(over == 3, "=").otherwise(""))
        # of letters of the alphabet only, which need no second look
        plain = F.octet_length(data) == F.length(data)
        bits = F.when(over != 1, F.when(plain, F.unbase64(padded)).otherwise(F.try_to_binary(padded, F.lit("base64"))))
        return let(bits, whole_units)

    def whole_units(bits: Column) -> Column:
        # four hex digits per unit; a surrogate without its partner is dropped
        units = F.regexp_replace(F.hex(bits), "([0-9A-F]{4})", "$1 ")
        units = F.regexp_replace(units, r"\b[0-9A-F]{2}$", "")
        paired = F.regexp_replace(
            units, r"(\b[0-9A-F]{2}D[89AB] [0-9A-F]{2}D[C-F] )|\b[0-9A-F]{2}D[89A-F] ", "$1"
        )
        # without these digits there is no surrogate, and only half a unit at the end can be left out
        even = F.substring(bits, F.lit(1), F.length(bits) - F.length(bits) % 2)
        ascii_only = F.octet_length(F.decode(bits, "ISO-8859-1")) == F.length(bits)
        kept = F.when(ascii_only, even).when(F.hex(bits).rlike("D[89A-F]"), F.unhex(F.replace(paired, F.lit(" "), F.lit("")))).otherwise(even)
        return F.decode(kept, "UTF-16LE")

    arguments = _all(text, _ENCODED_COMMAND, 1)
    found = F.filter(F.transform(arguments, decode), lambda t: t.isNotNull())
    return F.when(F.contains(F.lower(text), F.lit("-en")), found).otherwise(F.array().cast("array<string>"))


def _with_texts(df: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """Rows (keep, text, refanged, depth, path): the row's own text and those decoded from it, however deep.

    Every level is shorter by the factor ``_SHRINK`` at least, so the length of a text bounds the levels it can hold; a
    text without an argument has none.
    """
    entry = lambda t, path, depth: F.struct(t.alias("text"), path.alias("path"), depth.alias("depth"))

    def decoded(front: Column, depth: Column) -> Column:
        return F.flatten(F.transform(front, lambda e: F.transform(
            let(refang(e["text"]), decoded_commands),
            lambda t, i: entry(t, F.concat(e["path"], F.array(F.lit(_DECODED_ORDER), i)), depth))))

    def deeper(found: Column, depth: Column) -> Column:
        return F.struct(F.concat(found["every"], found["front"]).alias("every"), decoded(found["front"], depth).alias("front"))

    own = F.array(entry(F.col("_own"), F.array().cast("array<int>"), F.lit(0)))
    start = F.struct(F.filter(own, lambda e: F.lit(False)).alias("every"), own.alias("front"))
    levels = F.floor(F.log(F.length("_own")) / math.log(_SHRINK)).cast("int")
    steps = F.when(F.contains(F.lower("_own"), F.lit("-en")) & (levels > 0), F.sequence(F.lit(1), levels)).otherwise(
        F.array().cast("array<int>"))
    texts = F.aggregate(steps, start, deeper, lambda found: F.concat(found["every"], found["front"]))
    level = df.select(*keep, text.alias("_own")).select(*keep, texts.alias("texts"))
    # every row has its own text at least; a plain explode would decode again to look whether the array is empty
    return level.select(*keep, F.explode_outer("texts").alias("t")).select(
        *keep, F.col("t.text").alias("text"), refang(F.col("t.text")).alias("clean"),
        F.col("t.path").alias("path"), F.col("t.depth").alias("depth"),
    )


def _matches(clean: Column, has: dict[str, Column]) -> Column:
    """All matches of a text as structs (ord, type, match, value, fixed confidence)."""
    empty = F.array().cast("array<struct<ord:int,type:string,match:string,value:string,confidence:double>>")

    def hit(order: int, kind: Column, match: Column, value: Column, confidence: float | None) -> Column:
        return F.struct(
            F.lit(order).alias("ord"), kind.alias("type"), match.alias("match"), value.alias("value"),
            F.lit(confidence).cast("double").alias("confidence"),
        )

    guards = {
        "ipv4": has["dot"], "domain": has["dot"], "email": has["at"], "cidr": has["dot"] & has["slash"], "ipv6": has["colon"],
        "url": has["colon"], "file_path": has["dot"], "registry_key": has["backslash"], "mutex": has["backslash"],
        "cve": has["cve"], **{t: has["word"] for t in _AS_WORDS},
    }

    def by_pattern(order: int, kind: str):
        return lambda m: hit(order, F.lit(kind), m, F.lit(None).cast("string"), None)

    parts = []
    for order, (kind, pattern, ignore_case) in enumerate(V.IOC_PATTERNS):
        found = F.transform(_all(clean, pattern, 0, ignore_case), by_pattern(order, kind))
        parts.append(F.when(guards[kind], found).otherwise(empty) if kind in guards else found)

    def grouped(order, pattern, make, guard):
        pairs = F.arrays_zip(_all(clean, pattern, 0, True).alias("m"), _all(clean, pattern, 1, True).alias("g"))
        return F.when(guard, F.transform(pairs, make)).otherwise(empty)

    parts.append(grouped(
        _CONTEXT_ORDER["ja3"], V.JA3_PATTERN,
        lambda p: hit(
            _CONTEXT_ORDER["ja3"],
            F.when(F.contains(F.lower(p["m"]), F.lit("ja3s")), "ja3s").otherwise("ja3"),
            F.lit(None).cast("string"), F.lower(p["g"]), 0.90,
        ), has["word"],
    ))
    parts.append(F.when(has["word"], F.transform(
        _all(clean, V.IMPHASH_PATTERN, 1, True),
        lambda g: hit(_CONTEXT_ORDER["imphash"], F.lit("imphash"), F.lit(None).cast("string"), F.lower(g), 0.90),
    )).otherwise(empty))
    parts.append(F.when(has["colon"], F.transform(
        F.filter(_all(clean, V.SSDEEP_PATTERN), lambda m: F.length(m) > 10),
        lambda m: hit(_CONTEXT_ORDER["ssdeep"], F.lit("ssdeep"), F.lit(None).cast("string"), m, 0.80),
    )).otherwise(empty))
    parts.append(F.when(has["word"], F.transform(
        _all(clean, V.TLSH_PATTERN, 0, True),
        lambda m: hit(_CONTEXT_ORDER["tlsh"], F.lit("tlsh"), F.lit(None).cast("string"), F.upper(m), 0.80),
    )).otherwise(empty))
    parts.append(grouped(
        _CONTEXT_ORDER["process"], V.PROCESS_PATTERN,
        lambda p: hit(_CONTEXT_ORDER["process"], F.lit("process"), p["m"], F.lower(p["g"]), 0.70), has["binary"],
    ))
    parts.append(F.when(has["assign"] & has["user"], F.transform(
        _all(clean, V.USER_PATTERN, 1, True),
        lambda g: hit(_CONTEXT_ORDER["user"], F.lit("user"), F.lit(None).cast("string"), F.lower(g), 0.85),
    )).otherwise(empty))
    parts.append(F.when(has["colon"], F.transform(
        _all(clean, V.DOWNLOAD_CRADLE_PATTERN, 1, True),
        lambda g: hit(_CRADLE_ORDER, F.lit("url"), F.lit(None).cast("string"), F.btrim(g, F.lit("\"'")), 0.95),
    )).otherwise(empty))
    parts.append(F.when(
        has["amsi"] & clean.rlike(python_regex(V.AMSI_BYPASS_PATTERN, True)),
        F.array(hit(_AMSI_ORDER, F.lit("yara_rule"), F.lit(None).cast("string"), F.lit("amsi_bypass_pattern"), 0.90)),
    ).otherwise(empty))
    return F.concat(*parts)


def normalize_ioc(kind: Column, match: Column) -> Column:
    """Canonical spelling of a pattern match."""
    value = F.rtrim(F.regexp_replace(match, r"(?U)^\s+|\s+$", ""), F.lit(".,;)"))
    return (
        F.when(kind.isin(_HASHES), F.lower(value))
        .when(kind == "domain", F.ltrim(F.lower(value), F.lit("*.")))
        .when(kind == "url", F.rtrim(value, F.lit("/")))
        .when(kind.isin("cve", "asn"), F.upper(value))
        .otherwise(value)
    )


def ipv4_number(text: Column) -> Column:
    """Dotted address as a number; NULL for leading zeros or octets out of range."""
    octet = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    pattern = "^" + r"\.".join([octet] * 4) + "$"
    numbers = [F.regexp_extract(text, pattern, i).cast("bigint") for i in range(1, 5)]
    total = reduce(lambda acc, n: acc * 256 + n, numbers)
    return F.when(text.rlike(pattern), total)


def network_range(network: str) -> tuple[int, int]:
    address, length = network.split("/")
    start = reduce(lambda acc, n: acc * 256 + int(n), address.split("."), 0)
    return start, start + 2 ** (32 - int(length)) - 1


def _in_networks(number: Column, networks: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [number.between(*network_range(n)) for n in networks])


def is_private_ip(value: Column) -> Column:
    """True for a well-formed address in a private or reserved range; malformed text is not private."""
    return F.coalesce(let(ipv4_number(value), lambda n: _in_networks(n, V.PRIVATE_NETWORKS)), F.lit(False))


def is_private_cidr(value: Column) -> Column:
    """True if the whole network lies in one special-purpose range."""
    size = F.pow(F.lit(2), 32 - F.regexp_extract(value, r"/(\d{1,2})$", 1).try_cast("int")).cast("bigint")
    bounds = F.struct(ipv4_number(F.substring_index(value, "/", 1)).alias("n"), size.alias("size"))

    def check(b: Column) -> Column:
        first = b["n"] - b["n"] % b["size"]
        last = first + b["size"] - 1
        inside = [
            (first >= network_range(n)[0]) & (last <= network_range(n)[1]) for n in V.SPECIAL_NETWORKS
        ]
        excepted = [
            first.between(*network_range(n)) | last.between(*network_range(n)) for n in V.SPECIAL_NETWORK_EXCEPTIONS
        ]
        return reduce(lambda a, c: a | c, inside) & ~reduce(lambda a, c: a | c, excepted)

    return F.coalesce(let(bounds, check), F.lit(False))


def validate_ioc(kind: Column, value: Column) -> Column:
    """Keep an indicator or not."""
    labels = F.split(value, r"\.", -1)
    exact = reduce(lambda c, item: c.when(kind == item[0], F.length(value) == item[1]), _HASH_LENGTH.items(), F)
    by_type = (
        exact.when(
            kind == "domain",
            ~F.lower(value).isin(V.BENIGN_DOMAINS) & (F.size(labels) >= 2)
            & (F.length(F.element_at(labels, -1)) >= 2),
        )
        .when(kind == "ipv4", ~is_private_ip(value))
        .when(kind == "cidr", ~is_private_cidr(value))
        .when(kind == "cve", F.startswith(F.upper(value), F.lit("CVE-")))
        .otherwise(F.lit(True))
    )
    return (F.length(value) >= 3) & by_type


def confidence(kind: Column, value: Column) -> Column:
    """Score by type."""
    case = F.when((kind == "domain") & (F.length(value) > 8), V.LONG_DOMAIN_CONFIDENCE)
    for score in sorted(set(V.CONFIDENCE_BY_IOC_TYPE.values()), reverse=True):
        case = case.when(kind.isin([t for t, s in V.CONFIDENCE_BY_IOC_TYPE.items() if s == score]), score)
    return case.otherwise(V.DEFAULT_IOC_CONFIDENCE)


def _array_literal(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def context_tags(kind: Column) -> Column:
    """Tags of pattern matches by type."""
    case = F
    for tags in sorted({tuple(t) for t in V.TAGS_BY_IOC_TYPE.values()}):
        case = case.when(kind.isin([t for t, v in V.TAGS_BY_IOC_TYPE.items() if tuple(v) == tags]), _array_literal(list(tags)))
    return case.otherwise(F.array().cast("array<string>"))


# tags of the contextual extractors, by their place in the order
_CONTEXT_TAGS = {
    100: ["tls-fingerprint", "network"], 110: ["pe-fingerprint", "file"], 120: ["fuzzy-hash", "file"],
    130: ["fuzzy-hash", "file"], 140: ["endpoint"], 150: ["identity"],
    _CRADLE_ORDER: ["download-cradle", "living-off-the-land"], _AMSI_ORDER: ["amsi-bypass", "defense-evasion"],
}


def is_network_indicator(kind: Column) -> Column:
    return kind.isin(V.NETWORK_IOC_TYPES)


def is_file_indicator(kind: Column) -> Column:
    return kind.isin(V.FILE_IOC_TYPES)


def is_high_fidelity(kind: Column) -> Column:
    return kind.isin(V.HIGH_FIDELITY_IOC_TYPES)


def extract_iocs(
    df: DataFrame,
    text_cols: list[str],
    id_cols: list[str],
    source: Column | str = "text",
    dedupe: str | list[str] | None = "row",
) -> DataFrame:
    """Indicators found in the joined text columns of each row.

    ``id_cols`` are carried through.  ``dedupe="row"`` keeps one indicator per
    row, type and lower-case value: the most confident, then the first.  A list
    of columns (a subset of ``id_cols``, e.g. the incident) removes duplicates
    within that scope instead; ``None`` keeps every match.
    """
    src = source if isinstance(source, Column) else F.lit(source)
    rows = df.select(*id_cols, F.concat_ws("\n", *text_cols).alias("_text"), src.alias("_source"))
    texts = _with_texts(rows, F.col("_text"), [*id_cols, "_source"])
    c = F.col("clean")
    has = {
        "dot": F.contains(c, F.lit(".")), "at": F.contains(c, F.lit("@")), "slash": F.contains(c, F.lit("/")),
        "colon": F.contains(c, F.lit(":")), "backslash": F.contains(c, F.lit("\\")),
        "assign": F.contains(c, F.lit("=")) | F.contains(c, F.lit(":")),
        # three further letters are an s or an i to a pattern that ignores case
        "amsi": reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for t, w in [(F.lower(c), "amsi"), (c, "\u017f"), (c, "\u0130"), (c, "\u0131")]]),
        "cve": F.contains(F.lower(c), F.lit("cve-")),
        "user": reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for t, w in [(F.lower(c), "user"), (F.lower(c), "account"), (c, "\u017f")]]),
        "word": c.rlike(python_regex(_WORD_HEADS)), "binary": c.rlike(r"(?i)\.(?:exe|dll|sys)"),
    }
    guarded = texts.withColumns({f"_has_{k}": v for k, v in has.items()}).withColumn(
        "_lower", F.when(F.col("clean") != F.col("text"), F.lower("text"))
    )
    found = guarded.withColumn(
        "hits", _matches(F.col("clean"), {k: F.col(f"_has_{k}") for k in has})
    ).select(
        *id_cols, "_source", "path", "depth",
        # only a text that was changed can hold defanged indicators
        F.explode(F.transform(
            F.col("hits"),
            lambda h, i: F.struct(
                h.alias("h"), i.alias("pos"),
                F.coalesce(~F.contains(F.col("_lower"), F.lower(h["match"])), F.lit(False)).alias("defanged"),
            ),
        )).alias("x"),
    )
    hit = F.col("x.h")
    by_pattern = hit["value"].isNull()
    rows = found.select(
        *id_cols, "_source", "depth", F.concat("path", F.array(hit["ord"], F.col("x.pos"))).alias("path"),
        hit["ord"].alias("ord"), hit["type"].alias("type"),
        F.coalesce(hit["value"], normalize_ioc(hit["type"], hit["match"])).alias("value"),
        hit["match"].alias("original_value"), hit["confidence"].alias("fixed"), by_pattern.alias("by_pattern"),
        (F.col("x.defanged") & by_pattern).alias("defanged"),
    ).filter(~F.col("by_pattern") | validate_ioc(F.col("type"), F.col("value")))
    extra = reduce(
        lambda case, item: case.when(F.col("ord") == item[0], _array_literal(item[1])), _CONTEXT_TAGS.items(), F
    )
    rows = rows.select(
        *id_cols, "type", "value", "original_value",
        F.coalesce("fixed", confidence(F.col("type"), F.col("value"))).alias("confidence"),
        F.concat("_source", F.repeat(F.lit(":decoded_ps"), F.col("depth"))).alias("source"),
        "defanged",
        F.concat(
            extra.otherwise(context_tags(F.col("type"))), F.array_repeat(F.lit("encoded-command"), F.col("depth"))
        ).alias("tags"),
        F.when(F.col("depth") > 0, "installation")
        .when(F.col("ord") == _CRADLE_ORDER, "delivery")
        .when(F.col("ord") == _AMSI_ORDER, "exploitation").alias("kill_chain_phase"),
        "path",
    )
    if dedupe is None:
        return rows.drop("path")
    return dedupe_iocs(rows, list(id_cols) if dedupe == "row" else list(dedupe), [c for c in id_cols], ["path"])


_IOC_COLUMNS = ["type", "value", "original_value", "confidence", "source", "defanged", "tags", "kill_chain_phase"]


def dedupe_iocs(iocs: DataFrame, scope: list[str], order: list[str], path: list[str] | None = None) -> DataFrame:
    """One row per scope, type and lower-case value: highest confidence, then first in ``order``.

    A minimum over a struct, so each task reduces its own rows before the shuffle.
    """
    path = path or []
    best = F.min(F.struct(
        (-F.col("confidence")).alias("_c"), *[F.col(o).alias(f"_o{n}") for n, o in enumerate([*order, *path])],
        *[F.col(c) for c in _IOC_COLUMNS],
    )).alias("best")
    return iocs.groupBy(*scope, F.col("type").alias("_t"), F.lower("value").alias("_v")).agg(best).select(
        *scope, *[F.col(f"best.{c}").alias(c) for c in _IOC_COLUMNS]
    )


def extract_from_alerts(alerts: DataFrame, dedupe: str | list[str] | None = "row", group: str | None = None) -> DataFrame:
    """Indicators in title, description and raw document of alerts (I19); ``group`` is carried along."""
    ids = ["id"] if group is None else [group, "id"]
    return extract_iocs(alerts, ["title", "description", "raw"], ids, F.concat(F.lit("alert:"), "id"), dedupe)
