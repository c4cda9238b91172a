"""Indicator tokens and scalar functions on hand-made texts."""

import hashlib
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelake.functions import binary, hashing, paths, text, times, tokens
from tracelake.operators import matching

MD5, SHA1, SHA256 = (getattr(hashlib, n)(b"fixed").hexdigest() for n in ("md5", "sha1", "sha256"))


def bundle(spark, value, **kw):
    df = spark.createDataFrame([(value,)], "text string")
    return tokens.with_bundle(df, "text", **kw).first().asDict()


def one(spark, column, *row, schema="a string"):
    return spark.createDataFrame([row], schema).select(column).first()[0]


def test_addresses(spark):
    b = bundle(spark, "198.51.100.7 10.1.1.1 172.16.0.1 172.32.0.1 192.168.1.1 127.0.0.1 0.1.2.3 999.1.1.1 é1.2.3.4é 169.254.1.1")
    assert b["ips"] == ["169.254.1.1", "172.32.0.1", "198.51.100.7"]
    assert "10.1.1.1" in bundle(spark, "10.1.1.1", exclude_private=False)["ips"]


def test_domains_inside_urls(spark):
    b = bundle(spark, "see https://Files.Example.org/a.exe, and Other.Example.org a.exe user@mail.example.com")
    assert b["urls"] == ["https://Files.Example.org/a.exe,"]  # trailing punctuation stays
    assert b["domains"] == ["mail.example.com", "other.example.org"]
    assert b["emails"] == ["user@mail.example.com"]
    # The same domain alone, but in other letters than in the URL, is kept.
    assert bundle(spark, "https://a.example.org/ A.example.org")["domains"] == ["a.example.org"]
    assert bundle(spark, "https://a.example.org/ a.example.org")["domains"] == []


def test_digests_by_length(spark):
    b = bundle(spark, f"{MD5.upper()} {SHA1} {SHA256} {SHA256}0 x{MD5}")
    assert (b["md5s"], b["sha1s"], b["sha256s"]) == ([MD5], [SHA1], [SHA256])


def test_cve_and_registry(spark):
    b = bundle(spark, "cve-2021-44228 CVE-2021-1 HKLM\\Software\\Run hkcu\\A\\B 'HKU\\x'")
    assert b["cves"] == ["CVE-2021-44228"]
    assert b["registry_keys"] == ["HKLM\\Software\\Run", "HKU\\x", "hkcu\\A\\B"]


def test_null_and_empty(spark):
    assert bundle(spark, "")["total"] == 0
    df = spark.createDataFrame([(1, None), (2, "")], "id int, text string")
    assert tokens.token_rows(df, "text", ["id"]).count() == 0


def test_long_form_distinct_and_repeats(spark):
    df = spark.createDataFrame([(1, "198.51.100.7 198.51.100.7")], "id int, text string")
    assert tokens.token_rows(df, "text", ["id"]).count() == 1
    assert tokens.token_rows(df, "text", ["id"], distinct=False).count() == 2


def test_extraction_is_idempotent(spark):
    source = f"198.51.100.7 a.example.org {SHA1} x@b.example.org"
    first = bundle(spark, source)
    again = bundle(spark, " ".join(first["ips"] + first["domains"] + first["sha1s"] + first["emails"]))
    assert {k: first[k] for k in ("ips", "domains", "sha1s", "emails")} == {
        k: again[k] for k in ("ips", "domains", "sha1s", "emails")}


@pytest.mark.parametrize("value", ["", "aaaa", "abcdefghijkl", "AaBb", "q1w2e3r4t5y6u7i8"])
def test_text_entropy(spark, value):
    low = value.lower()
    want = -sum((low.count(c) / len(low)) * math.log2(low.count(c) / len(low)) for c in set(low)) if low else 0.0
    assert one(spark, text.text_entropy("a"), value) == pytest.approx(want, abs=1e-9)


@settings(max_examples=10, deadline=None)
@given(st.binary(max_size=300))
def test_byte_entropy_bounds(spark, raw):
    got = one(spark, binary.byte_entropy("a"), bytearray(raw), schema="a binary")
    assert 0.0 <= got <= math.log2(max(len(raw), 1)) + 1e-9


def test_byte_entropy_known(spark):
    assert one(spark, binary.byte_entropy("a"), bytearray(64), schema="a binary") == 0.0
    assert one(spark, binary.byte_entropy("a"), bytearray(range(256)), schema="a binary") == pytest.approx(8.0)


def test_hash_helpers(spark):
    assert one(spark, hashing.digest("a", "sha512"), "fixed") == hashlib.sha512(b"fixed").hexdigest()
    assert one(spark, hashing.digest_kind("a"), MD5) == "md5"
    assert one(spark, hashing.digest_kind("a"), "zz") == "unknown"
    assert one(spark, hashing.sha256_field("a"), f"MD5=1,SHA256={SHA256},IMPHASH=2") == SHA256
    assert one(spark, hashing.sha256_field("a"), MD5) == MD5
    assert one(spark, hashing.sha256_field("a"), "SHA256=short") == ""
    assert one(spark, hashing.url_key("a"), "http://a.example.org/?>") == "aHR0cDovL2EuZXhhbXBsZS5vcmcvPz4"
    assert one(spark, hashing.same_digest("a", F.upper("a")), MD5)


@pytest.mark.parametrize("value,want", [
    ("2024-01-02T03:04:05Z", "2024-01-02 03:04:05"),
    ("2024-01-02T03:04:05.123Z", "2024-01-02 03:04:05.123000"),
    ("2024-01-02T03:04:05.123456Z", "2024-01-02 03:04:05.123456"),
    ("2024-01-02T03:04:05.123+0200", "2024-01-02 01:04:05.123000"),
    ("2024-01-02T03:04:05+02:00", "2024-01-02 01:04:05"),
    ("2024-01-02 03:04:05", "2024-01-02 03:04:05"),
    ("01/02/2024 03:04:05 PM", "2024-01-02 15:04:05"),
    ("garbage", None), ("", None), ("2024-13-45 99:99:99", None),
])
def test_timeline_time(spark, value, want):
    got = one(spark, times.timeline_time("a").cast("timestamp_ntz"), value)
    assert (None if got is None else str(got)) == want


@pytest.mark.parametrize("value,want", [
    ("Jan  5 10:11:12", "2023-01-05 10:11:12"), ("Jan 15 10:11:12", "2023-01-15 10:11:12"), ("Foo 15 10:11:12", None),
])
def test_log_time(spark, value, want):
    got = one(spark, times.log_time("a", 2023).cast("timestamp_ntz"), value)
    assert (None if got is None else str(got)) == want
    assert one(spark, times.log_time("a"), value) is None  # without a year there is no time


def test_path_helpers(spark):
    assert one(spark, paths.address_host("a"), "fe80::1:443") == "fe80::1"
    assert one(spark, paths.address_port("a"), "fe80::1:443") == 443
    assert one(spark, paths.address_port("a"), "1.2.3.4:*") == 0
    assert one(spark, paths.number_or_hex("a"), "0xff") == 255
    assert one(spark, paths.suffix("a"), "A.tar.GZ") == ".gz"
    assert one(spark, paths.suffix("a"), ".hidden") == ""
    assert one(spark, paths.octal_mode("a"), 0o104755, schema="a int") == "0o4755"


def test_reasons_first_match_wins(spark):
    value = ["cmd.exe http://x.example.org", "see 198.51.100.7 now", "plain text", "x \\\\srv\\share", "KEYLOGger", "cmdXexe"]
    rows = spark.createDataFrame([(value,)], "a array<string>").select(F.explode(text.suspicious_strings("a")).alias("t"))
    got = {r.t.value: r.t.reason for r in rows.collect()}
    assert got == {value[0]: "Shell execution", value[1]: "IP Address", value[3]: "UNC path (lateral movement)",
                   value[4]: "Keylogger indicator"}


def test_strings_and_packer(spark):
    raw = b"\x00short\x00longer text\x00\x01" + "wide text".encode("utf-16-le") + b"\x01"
    df = spark.createDataFrame([(bytearray(raw),)], "a binary")
    assert df.select(binary.ascii_strings("a")).first()[0] == ["longer text"]
    assert df.select(binary.wide_strings("a")).first()[0] == ["wide text"]
    edge = bytearray(b"x" * 2044 + b"UPX!")
    assert one(spark, binary.packer("a"), edge, schema="a binary") == "UPX Packer"
    late = bytearray(b"x" * 2045 + b"UPX!")
    assert one(spark, binary.packer("a", 2048), late, schema="a binary") is None
    assert one(spark, binary.packer("a"), late, schema="a binary") == "UPX Packer"


def test_header_fields(spark):
    raw = bytearray(128)
    raw[0:2] = b"MZ"
    raw[0x3C:0x40] = (64).to_bytes(4, "little")
    raw[68:70] = (0x8664).to_bytes(2, "little")
    raw[70:72] = (5).to_bytes(2, "little")
    raw[72:76] = (1_700_000_000).to_bytes(4, "little")
    got = one(spark, binary.header_fields("a"), raw, schema="a binary")
    assert (got.machine, got.num_sections) == ("0x8664", 5)
    assert one(spark, binary.header_fields("a"), bytearray(b"MZ"), schema="a binary") is None


def test_keyword_routes(spark):
    """Long, short and word-less keywords give the same rows as a pairwise test."""
    texts = [(1, "The quick brown fox jumps over the lazy dog"), (2, "a.b-c QUICK, brown fox"), (3, "xx-ab-yy"),
             (4, ""), (5, "überquick brownish fox jumps over")]
    words = [(1, "quick brown fox jumps over"), (2, "ick brown fox ju"), (3, "ab"), (4, "-AB-"), (5, "zzz"), (6, "ü"),
             (7, "The quick brown fox jumps over the lazy dog"), (8, "brown"), (9, "quick brown fox jumps over"),
             (10, "the quick brown fox"), (11, "quick brownish fox jumps over"), (12, "over the lazy dog")]
    t = spark.createDataFrame(texts, "id int, text string")
    f = spark.createDataFrame(words, "kid int, word string")
    got = {tuple(r) for r in matching.match_keywords(t, "text", ["id"], f, "word", ["kid"]).collect()}
    want = {(i, k) for i, x in texts for k, w in words if w.lower() in x.lower()}
    assert got == want


LONG = "abcdefghij." * 30 + "example"


def test_case_scope_suppresses_across_rows(spark):
    rows = [("c1", "https://a.example.org/x"), ("c1", "ask a.example.org and b.example.org, A.example.org"), ("c2", "a.example.org"),
            ("c1", "198.51.100.7"), ("c3", "ample.or"), ("c3", "see http://example.org/q?x=" + LONG), ("c3", LONG)]
    df = spark.createDataFrame(rows, "case_id string, text string")
    got = {tuple(r) for r in matching.case_tokens(df, "text", "case_id").collect()}
    assert got == {("c1", "url", "https://a.example.org/x"), ("c1", "domain", "b.example.org"), ("c1", "ip", "198.51.100.7"),
                   ("c1", "domain", "a.example.org"), ("c2", "domain", "a.example.org"),
                   ("c3", "url", "http://example.org/q?x=" + LONG)}
    # a.example.org stays in c1 only through its other spelling, which no URL holds.


def test_event_text(spark):
    df = spark.createDataFrame([("X", 1)], "Host string, n int")
    assert df.select(text.event_text(F.struct("Host", "n"))).first()[0] == '{"host":"x","n":1}'
