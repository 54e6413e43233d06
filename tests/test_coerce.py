import datetime as dt
import ipaddress
import random

from pyspark.sql import functions as F

from tracewell.functions import coerce


def _apply(spark, values, make):
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", make(F.col("v")).alias("o"))
    return {r.v: r.o for r in df.collect()}


def test_addresses_agree_with_the_standard_library(spark):
    rng = random.Random(7)
    values = ["::", "::1", "fe80::1%eth0", "1.2.3.4", "01.2.3.4", "256.1.1.1", " 10.0.0.1 ", "", "x", "::ffff:1.2.3.4",
              "64:ff9b::1.2.3.4", ":::", "1::2::3", "1:2:3:4:5:6:7::", "12345::", "1:2:3:4:5:6:1.2.3.4", "1:", "::1.2.3.400"]
    for _ in range(300):
        groups = [rng.choice(["0", "0", "1", "ab", "0FfF"]) for _ in range(rng.randint(1, 9))]
        cut = rng.randint(0, len(groups))
        values.append(":".join(groups) if rng.random() < 0.4 else ":".join(groups[:cut]) + "::" + ":".join(groups[cut:]))

    def expected(text):
        try:
            address = ipaddress.ip_address(text.strip())
        except ValueError:
            return None
        mapped = getattr(address, "ipv4_mapped", None)
        return f"::ffff:{mapped}" if mapped else str(address)

    got = _apply(spark, values, coerce.coerce_ip)
    assert {v: got[v] for v in values} == {v: expected(v) for v in values}


def test_times(spark):
    values = ["2026-07-22T09:00:00Z", "2026-07-22", "20260722", "2026-07-22T09", "2026-07-22 09:01", "2026-07-22T090102",
              "2026-07-22T09:00:00.123456789+02:30", "2026-07-22T09:00:00.5-05:00", "1600", "1600000000", "2026-13-01", "not-a-date",
              "2026-07-22T25:00:00", "2026-07-22T09:00:00+0200"]

    def expected(text):
        try:
            t = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
        except ValueError:
            return None
        t = t.replace(tzinfo=dt.UTC) if t.tzinfo is None else t.astimezone(dt.UTC)
        return t.strftime("%Y-%m-%d %H:%M:%S.%f")

    got = _apply(spark, values, lambda c: F.date_format(coerce.parse_iso(c), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    assert got == {v: expected(v) for v in values}


def test_numeric_times(spark):
    show = lambda c: F.date_format(coerce.coerce_utc_datetime(c, 3600.0), "yyyy-MM-dd HH:mm:ss")
    got = _apply(spark, ["133000000000000000", "1700000000000", "1700000000", "0", "x", ""], show)
    assert got == {"133000000000000000": "2022-06-18 05:26:40", "1700000000000": "2023-11-14 23:13:20",
                   "1700000000": "2023-11-14 23:13:20", "0": None, "x": None, "": None}


def test_ports_and_integers(spark):
    got = _apply(spark, ["443", "0", "70000", "abc", " 42 ", "0x1fc", "-1", "1_0"], coerce.coerce_port)
    assert got == {"443": 443, "0": None, "70000": None, "abc": None, " 42 ": 42, "0x1fc": None, "-1": None, "1_0": 10}


def test_hashes_and_domains(spark):
    a = "A" * 64
    assert _apply(spark, [f"SHA256={a}", a, "zz"], coerce.coerce_sha256) == {f"SHA256={a}": a.lower(), a: a.lower(), "zz": None}
    assert _apply(spark, [f"MD5={'1' * 32},SHA256={a}", f"MD5={'1' * 32}"], coerce.extract_hash) == {
        f"MD5={'1' * 32},SHA256={a}": a.lower(), f"MD5={'1' * 32}": "1" * 32}
    assert _apply(spark, ["Host.Example", "10.0.0.1", "-x", "a b"], coerce.coerce_domain) == {
        "Host.Example": "host.example", "10.0.0.1": None, "-x": None, "a b": None}
