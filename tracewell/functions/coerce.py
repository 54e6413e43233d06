"""Scalar coercions: a valid value or NULL, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell.functions.text import let

_GROUPED_INT = r"^\s*[+-]?\d+(?:_\d+)*\s*$"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = r"^" + _OCTET + r"(?:\." + _OCTET + r"){3}$"
_H = r"[0-9A-Fa-f]{1,4}"
# date [separator time [fraction] [offset]], in extended or compact form
_ISO = (
    r"^(\d{4})-?(\d{2})-?(\d{2})"
    r"(?:[^\d](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6})\d*)?)?)?"
    r"(?:\+00:00|([+-])(\d{2})(?::?(\d{2})(?::?(\d{2})(?:\.\d+)?)?)?)?)?$"
)
_ISO_DATE = r"^(?:\d{4}-\d{2}-\d{2}|\d{8})(?:\D|$)"
# what almost every record has: Spark reads it as it is
_PLAIN_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?Z?$"
_FILETIME_EPOCH_MICROS = 11644473600000000


def coerce_int(col: Column, minimum: int | None = None, maximum: int | None = None) -> Column:
    """Integer text or number within bounds, else NULL."""
    text = col.cast("string")
    # digits may be grouped by underscores, which a cast does not read
    grouped = F.when(text.rlike(_GROUPED_INT), F.replace(text, F.lit("_"), F.lit("")))
    value = F.when(F.contains(text, F.lit("_")), grouped).otherwise(text).try_cast("int")
    if minimum is None and maximum is None:
        return value
    low = F.lit(True) if minimum is None else value >= minimum
    high = F.lit(True) if maximum is None else value <= maximum
    return F.when(low & high, value)


def coerce_port(col: Column) -> Column:
    return coerce_int(col, 1, 65535)


def coerce_pid(col: Column) -> Column:
    return coerce_int(col, 0)


def _slow_iso(text: Column) -> Column:
    def part(i: int, default: str) -> Column:
        got = F.regexp_extract(text, _ISO, i)
        return F.when(got == "", F.lit(default)).otherwise(got)

    canonical = F.concat(
        part(1, ""), F.lit("-"), part(2, ""), F.lit("-"), part(3, ""), F.lit(" "),
        part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"),
        F.lit("."), F.rpad(part(7, "0"), 6, "0"), F.lit(" UTC"),
    )
    shift = part(9, "0").cast("int") * 3600 + part(10, "0").cast("int") * 60 + part(11, "0").cast("int")
    signed = F.when(part(8, "+") == "-", -shift).otherwise(shift)
    parsed = canonical.try_cast("timestamp")
    moved = F.timestamp_micros(F.unix_micros(parsed) - signed.cast("bigint") * 1000000)
    return F.when(text.rlike(_ISO_DATE) & text.rlike(_ISO), moved)


def parse_iso(col: Column) -> Column:
    """ISO-8601 text to a UTC timestamp; naive text is UTC, anything else NULL."""
    return F.when(
        col.rlike(_PLAIN_ISO), F.concat(F.replace(col, F.lit("Z"), F.lit("")), F.lit(" UTC")).try_cast("timestamp")
    ).when(col.rlike(_ISO_DATE), let(F.replace(col, F.lit("Z"), F.lit("+00:00")), _slow_iso))


def numeric_time(value: Column) -> Column:
    """Epoch seconds, epoch milliseconds or 100-ns ticks since 1601, by magnitude."""
    micros = (
        F.when(value > 1e17, value / 10 - F.lit(float(_FILETIME_EPOCH_MICROS)))
        .when(value > 1e12, value * 1000)
        .otherwise(value * 1000000)
    )
    # beyond year 9999 there is no such time
    return F.when((value > 0) & (micros < 2.534023008e17), F.timestamp_micros(F.round(micros).cast("bigint")))


def coerce_utc_datetime(col: Column, skew_seconds: Column | float = 0.0, numeric: bool = False) -> Column:
    """Text, number or tick count to a UTC timestamp, moved by ``skew_seconds``.

    ``numeric`` says that the column holds numbers, so decimals are times too;
    in text only plain digits are.
    """
    if numeric:
        parsed = numeric_time(col.cast("double"))
    else:
        text = F.trim(col.cast("string"))
        digits = text.rlike(r"^\d+$")
        parsed = F.when(digits, numeric_time(F.when(digits, text).try_cast("double"))).otherwise(parse_iso(text))
    if isinstance(skew_seconds, (int, float)) and not skew_seconds:
        return parsed
    skew = skew_seconds if isinstance(skew_seconds, Column) else F.lit(float(skew_seconds))
    return F.timestamp_micros(F.unix_micros(parsed) + F.round(skew * 1000000).cast("bigint"))


def coerce_ipv4(col: Column) -> Column:
    text = F.trim(col.cast("string"))
    return F.when(text.rlike(_IPV4), text)


def _ipv6_groups(body: Column) -> Column:
    """The eight groups of a v6 text without scope, without leading zeros; NULL if it is not one."""

    def from_halves(halves: Column) -> Column:
        left = F.filter(F.split(F.get(halves, F.lit(0)), ":", -1), lambda g: g != "")
        right = F.filter(F.split(F.get(halves, F.lit(1)), ":", -1), lambda g: g != "")
        missing = 8 - F.size(left) - F.size(right)
        return (
            F.when((F.size(halves) == 1) & (F.size(left) == 8), left)
            .when(
                (F.size(halves) == 2) & (missing >= 1),
                F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right),
            )
        )

    shape = (
        body.rlike(rf"^(?:{_H})?(?::{_H}|::{_H})*(?:::)?$|^::(?:{_H}(?::{_H})*)?$")
        & body.rlike(":") & ~body.rlike(r":::|::.*::")
    )
    groups = let(F.split(body, "::", -1), from_halves)
    return F.when(shape, F.transform(groups, lambda g: F.regexp_replace(g, r"^0+(?=.)", "")))


def _dotted(high: Column, low: Column) -> Column:
    number = F.conv(F.concat(F.lpad(high, 4, "0"), F.lpad(low, 4, "0")), 16, 10).cast("bigint")
    return F.concat_ws(".", *[(F.shiftright(number, s) % 256).cast("string") for s in (24, 16, 8, 0)])


def _fold_zeros(plain: Column) -> Column:
    """Replace the first longest run of two or more zero groups by ``::``."""
    mapped = r"^0:0:0:0:0:ffff:([0-9a-f]+):([0-9a-f]+)$"
    cases = F.when(
        plain.rlike(mapped),
        F.concat(F.lit("::ffff:"), _dotted(F.regexp_extract(plain, mapped, 1), F.regexp_extract(plain, mapped, 2))),
    )
    for run in range(8, 1, -1):
        pattern = r"^((?:[0-9a-f]+:)*?)0(?::0){%d}((?::[0-9a-f]+)*)$" % (run - 1)
        head, rest = F.regexp_extract(plain, pattern, 1), F.regexp_extract(plain, pattern, 2)
        folded = F.concat(F.when(head == "", ":").otherwise(head), F.when(rest == "", ":").otherwise(rest))
        cases = cases.when(plain.rlike(pattern), folded)
    return cases.otherwise(plain)


def coerce_ipv6(col: Column) -> Column:
    """Canonical IPv6 text: lower case, no leading zeros, the longest zero run folded."""

    def canonical(text: Column) -> Column:
        scope = F.regexp_extract(text, r"^[^%]*(%[^%/]+)$", 1)
        bare = F.lower(F.substring_index(text, "%", 1))
        tail = F.regexp_extract(bare, r"^.*:(\d{1,3}(?:\.\d{1,3}){3})$", 1)
        # a dotted tail becomes two hexadecimal groups
        hexed = let(
            F.split(F.when(tail.rlike(_IPV4), tail), r"\."),
            lambda octets: F.concat(
                F.regexp_extract(bare, r"^(.*:)[\d.]+$", 1),
                *[
                    F.concat(F.lower(F.lpad(F.hex(F.get(octets, F.lit(i)).cast("int")), 2, "0")),
                             F.lit(":" if i == 1 else ""))
                    for i in range(4)
                ],
            ),
        )
        body = F.when(tail == "", bare).otherwise(hexed)
        folded = let(F.array_join(let(body, _ipv6_groups), ":"), _fold_zeros)
        scoped_ok = (F.locate("%", text) == 0) | (scope != "")
        return F.when(scoped_ok, F.concat(folded, scope))

    return let(F.trim(col.cast("string")), canonical)


def coerce_ip(col: Column) -> Column:
    """Canonical v4 or v6 address, else NULL."""
    text = col.cast("string")
    return F.when(F.contains(text, F.lit(":")), coerce_ipv6(col)).otherwise(coerce_ipv4(col))


def coerce_domain(col: Column) -> Column:
    """Lower-case host or domain name that is not an address (E5)."""
    text = F.lower(F.trim(col.cast("string")))
    ok = (F.length(text) <= 253) & text.rlike(r"^[a-z0-9]([a-z0-9\-._]*[a-z0-9])?$") & coerce_ipv4(text).isNull()
    return F.when(ok, text)


def _coerce_hash(col: Column, name: str, digits: int) -> Column:
    text = F.trim(col.cast("string"))
    body = F.when(F.startswith(F.upper(text), F.lit(name + "=")), F.trim(F.substr(text, F.lit(len(name) + 2))))
    body = F.coalesce(body, text)
    return F.when(body.rlike(rf"^[0-9A-Fa-f]{{{digits}}}$"), F.lower(body))


def coerce_sha256(col: Column) -> Column:
    return _coerce_hash(col, "SHA256", 64)


def coerce_sha1(col: Column) -> Column:
    return _coerce_hash(col, "SHA1", 40)


def coerce_md5(col: Column) -> Column:
    return _coerce_hash(col, "MD5", 32)


def extract_hash(col: Column) -> Column:
    """A bare SHA-256, else the one after ``SHA256=``, else the MD5 after ``MD5=``."""
    sha = F.regexp_extract(col, r"(?i)SHA256=([0-9a-f]{64})", 1)
    md5 = F.regexp_extract(col, r"(?i)MD5=([0-9a-f]{32})", 1)
    return (
        F.when(col.rlike(r"^[0-9A-Fa-f]{64}$"), F.lower(col))
        .when(sha != "", F.lower(sha))
        .when(md5 != "", F.lower(md5))
    )
