"""Indicator tokens in text: addresses, domains, URLs, digests, mail, CVE and registry keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.binding import let
from tracelake.functions.text import event_leaf_rows

# ---------------------------------------------------------------------------
# Token patterns and private ranges.
# ---------------------------------------------------------------------------
IPV4 = r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"
DOMAIN = r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}\b"
URL = r"(?i)https?://[^\s\"'<>]+"
MD5 = r"\b[0-9a-fA-F]{32}\b"
SHA1 = r"\b[0-9a-fA-F]{40}\b"
SHA256 = r"\b[0-9a-fA-F]{64}\b"
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
CVE = r"(?i)\bCVE-\d{4}-\d{4,7}\b"
REGISTRY = (
    r"(?i)\b(?:HKEY_LOCAL_MACHINE|HKEY_CURRENT_USER|HKLM|HKCU|HKU|HKCR|HKCC)\\[^\s\"']+"
)
PRIVATE_IPV4 = r"^(10\.|172\.(1[6-9]|2\d|3[01])\.|192\.168\.|127\.|0\.)"

# Start of any digest.
HEX_RUN = r"\b[0-9a-fA-F]{32}"

# Patterns of the event matcher, applied to lowered text.
EVENT_IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
EVENT_DOMAIN = r"\b(?:[a-z0-9][-a-z0-9]{0,61}[a-z0-9]?\.)+[a-z]{2,}\b"
EVENT_SHA256 = r"\b[0-9a-f]{64}\b"
# The same for Java alone, which asks a named class once per character and each range of a list in turn. On lowered text they find the same.
# Domains without trying shorter labels: a label has no dot, so only its whole run can end before one.
EVENT_DOMAIN_RUN = r"\b(?:\p{Alnum}[-\p{Alnum}]{0,61}+\p{Alnum}?\.)+\p{Lower}{2,}+\b"
# Digests of all three lengths in one pass.
EVENT_DIGEST = r"\b\p{XDigit}{32}(?:\p{XDigit}{8}(?:\p{XDigit}{24})?)?\b"
EVENT_DIGEST_64 = r"\b\p{XDigit}{64}\b"
EVENT_URL = r"https?://[^\s\"'<>]+"
EVENT_EMAIL = r"\b[\p{Alnum}._%+\-]+@[\p{Alnum}.\-]+\.\p{Lower}{2,}\b"
EVENT_CVE = r"\bcve-\d{4}-\d{4,7}\b"

# Bundle list -> indicator type.
BUNDLE_TYPES = {
    "ips": "ip", "domains": "domain", "urls": "url", "md5s": "hash_md5",
    "sha1s": "hash_sha1", "sha256s": "hash_sha256", "emails": "email",
    "cves": "cve", "registry_keys": "registry_key",
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def find_all(text, pattern: str) -> Column:
    """Every match of the pattern, in text order, with repeats."""
    return F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(0))


def _gated(gate: Column, found: Column) -> Column:
    """Run the regex only where a cheap substring test allows a match."""
    return F.when(gate, found).otherwise(F.array().cast("array<string>"))


def is_private(ip) -> Column:
    return _col(ip).rlike(PRIVATE_IPV4)


def ipv4(text, exclude_private: bool = True) -> Column:
    text = _col(text)
    found = _gated(text.rlike(r"\d\.\d"), find_all(text, IPV4))
    return F.filter(found, lambda v: ~is_private(v)) if exclude_private else found


def urls(text) -> Column:
    text = _col(text)
    return _gated(text.contains("://"), find_all(text, URL))


def domains(text) -> Column:
    """Domains, lowered. A domain that is part of a URL of the same text is left out."""
    text = _col(text)
    # Every domain ends in a dot between a letter or digit and two letters.
    found = _gated(text.rlike(r"[a-zA-Z0-9]\.[a-zA-Z]{2}"), find_all(text, DOMAIN))
    alone = let(F.struct(found.alias("found"), urls(text).alias("urls")), lambda v: F.filter(
        v["found"], lambda d: ~F.exists(v["urls"], lambda u: F.contains(u, d))))
    return F.transform(alone, F.lower)


def digests(text, pattern: str) -> Column:
    """Hex digests, lowered. Word boundaries on both ends keep the lengths apart."""
    text = _col(text)
    return F.transform(_gated(text.rlike(HEX_RUN), find_all(text, pattern)), F.lower)


def emails(text) -> Column:
    text = _col(text)
    return F.transform(_gated(text.contains("@"), find_all(text, EMAIL)), F.lower)


def cves(text) -> Column:
    text = _col(text)
    return F.transform(_gated(text.contains("-"), find_all(text, CVE)), F.upper)


def registry_keys(text) -> Column:
    text = _col(text)
    return _gated(text.contains("\\"), find_all(text, REGISTRY))


def token_lists(text, exclude_private: bool = True) -> dict[str, Column]:
    """All nine token lists of one text, with repeats."""
    text = _col(text)
    return {
        "ips": ipv4(text, exclude_private),
        "domains": domains(text),
        "urls": urls(text),
        "md5s": digests(text, MD5),
        "sha1s": digests(text, SHA1),
        "sha256s": digests(text, SHA256),
        "emails": emails(text),
        "cves": cves(text),
        "registry_keys": registry_keys(text),
    }


def with_bundle(df: DataFrame, text: str, exclude_private: bool = True) -> DataFrame:
    """Nine sorted distinct lists per row, and their total."""
    lists = token_lists(text, exclude_private)
    out = df.withColumns({k: F.array_sort(F.array_distinct(v)) for k, v in lists.items()})
    total = sum((F.coalesce(F.size(k), F.lit(0)) for k in lists), F.lit(0))
    return out.withColumn("total", total)


def _tagged(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("ioc_type"), v.alias("value")))


def token_rows(
    df: DataFrame, text: str, ids: list[str], kinds: list[str] | None = None,
    exclude_private: bool = True, distinct: bool = True,
) -> DataFrame:
    """Long form (ids, ioc_type, value). Distinct per row unless distinct is off.

    The work stays inside the row, so a source that holds most of the rows is
    spread like any other and nothing is shuffled.
    """
    lists = token_lists(text, exclude_private)
    chosen = kinds or list(lists)
    tagged = []
    for name in chosen:
        values = F.array_distinct(lists[name]) if distinct else lists[name]
        tagged.append(_tagged(BUNDLE_TYPES[name], values))
    pairs = F.explode(F.flatten(F.array(*tagged)) if len(tagged) > 1 else tagged[0])
    return df.select(*ids, pairs.alias("t")).select(*ids, "t.ioc_type", "t.value")


def event_token_rows(df: DataFrame, text: str, ids: list[str], distinct: bool = True,
                     extended: bool = False) -> DataFrame:
    """Tokens the event matcher compares: ip, domain and sha256 of lowered event text.

    extended also yields url, email, cve, md5 and sha1 tokens.
    """
    # Lists are made without functions on their elements, such as transform, so that Spark compiles the whole step.
    df = df.select(*ids, F.lower(_col(text)).alias("_low"))
    low, none = F.col("_low"), F.array().cast("array<string>")
    search = lambda gate, pattern: F.when(gate, find_all(low, pattern)).otherwise(none)
    bytes_ = F.octet_length(low)  # known without reading the text
    # Addresses, domains and mail have a dot; most texts of events have none.
    dotted = [("ip", search(low.rlike(r"\d\.\d"), EVENT_IP)), ("domain", search(low.rlike(r"\.\p{Lower}{2}"), EVENT_DOMAIN_RUN))]
    if extended:
        # The text is lowered, and so are its tokens.
        dotted += [("email", search(low.contains("@"), EVENT_EMAIL))]
        plain = [("url", search(low.contains("://"), EVENT_URL)), ("cve", search(low.contains("cve-"), EVENT_CVE)), ("hash", search(bytes_ >= 32, EVENT_DIGEST))]
    else:
        plain = [("hash_sha256", search(bytes_ >= 64, EVENT_DIGEST_64))]
    tagged = lambda plan: F.array(*[F.struct(F.lit(kind).alias("kind"), (F.array_distinct(found) if distinct else found).alias("found")) for kind, found in plan])
    found = F.when(low.contains("."), tagged(dotted + plain)).otherwise(tagged(plain))
    lists = df.select(*ids, F.explode(found).alias("_list")).select(*ids, F.col("_list.kind").alias("_kind"), F.col("_list.found").alias("_found"))
    size = F.octet_length("value")
    kind = F.when(F.col("_kind") != "hash", F.col("_kind")).when(size == 32, "hash_md5").when(size == 40, "hash_sha1").otherwise("hash_sha256")
    return lists.select(*ids, "_kind", F.explode("_found").alias("value")).select(*ids, kind.alias("ioc_type"), "value")


def event_path_tokens(df: DataFrame, event: str, ids: list[str], extended: bool = True, levels: int = 8) -> DataFrame:
    """(ids, path, ioc_type, value): tokens of all values of VARIANT events, and where in the event each stands.

    Values are searched one by one, so a token never runs into the JSON around it. All work stays inside the row.
    """
    return event_token_rows(event_leaf_rows(df, event, ids, levels), "text", [*ids, "path"], extended=extended)
