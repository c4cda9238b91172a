"""Queries on text: indicators, matching, digests, strings, signatures, samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.content.lookups import FILE_MAGIC, PACKER_SEARCH_BYTES, SAMPLE_MAGIC, SUSPICIOUS_STRINGS
from tracelake.functions import binary, hashing, text, times, tokens
from tracelake.operators import matching, reputation, samples
from tracelake.operators.hunts import generated_name_findings, generated_names, query_counts
from tracelake.operators.normalize import bundle_observables, lookup_actions
from tracelake.operators.ordered import first_per_group
from tracelake.plans.registry import query
from tracelake.plans.views import FILES_SQL, TAILS, _at, files, load, pick, pick_sql, sql_text, with_sql
from tracelake.rules.signatures import scan_content, scan_summary
from tracelake.sources import feeds

# ---- oracle pieces --------------------------------------------------------

IP_RE = tokens.IPV4
PRIVATE = tokens.PRIVATE_IPV4


def found(pattern: str, column: str) -> str:
    return f"regexp_extract_all({column}, {sql_text(pattern)}, 0)"


def distinct_tokens(table: str, ids: str, column: str) -> str:
    """All tokens of a text column, as rows (ids, ioc_type, value)."""
    url = found(tokens.URL, column)
    kinds = [
        ("ip", f"list_filter({found(tokens.IPV4, column)}, lambda x: NOT regexp_matches(x, '{PRIVATE}'))"),
        ("domain", f"list_transform(list_filter({found(tokens.DOMAIN, column)}, "
                   f"lambda d: len(list_filter({url}, lambda u: contains(u, d))) = 0), lambda d: lower(d))"),
        ("url", url),
        ("hash_md5", f"list_transform({found(tokens.MD5, column)}, lambda x: lower(x))"),
        ("hash_sha1", f"list_transform({found(tokens.SHA1, column)}, lambda x: lower(x))"),
        ("hash_sha256", f"list_transform({found(tokens.SHA256, column)}, lambda x: lower(x))"),
        ("email", f"list_transform({found(tokens.EMAIL, column)}, lambda x: lower(x))"),
        ("cve", f"list_transform({found(tokens.CVE, column)}, lambda x: upper(x))"),
        ("registry_key", found(tokens.REGISTRY, column)),
    ]
    return " UNION ALL ".join(
        f"SELECT {ids}, '{k}' AS ioc_type, unnest(list_distinct({e})) AS value FROM {table}" for k, e in kinds)


DOC_TOKENS = f"doc_tokens AS ({distinct_tokens('documents', 'doc_id', 'text')})"
PAGE_TOKENS = f"page_tokens AS ({distinct_tokens('pages', 'page_id', 'html')})"


# ---- extraction -----------------------------------------------------------

@query("ioc_extract_documents", with_sql(DOC_TOKENS, body="SELECT * FROM doc_tokens"))
def _(spark, d):
    return tokens.token_rows(load(spark, d, "documents"), "text", ["doc_id"])


@query("ioc_extract_pages", with_sql(PAGE_TOKENS, body="SELECT * FROM page_tokens"))
def _(spark, d):
    return tokens.token_rows(load(spark, d, "pages"), "html", ["page_id"])


@query("ioc_extract_samples", with_sql(
    FILES_SQL, f"t AS ({distinct_tokens('files', 'doc_id', 'body')})", body="SELECT * FROM t"))
def _(spark, d):
    return tokens.token_rows(files(spark, d), "body", ["doc_id"])


@query("ioc_bundle_totals", with_sql(
    FILES_SQL, f"t AS ({distinct_tokens('files', 'doc_id', 'body')})", body="""
SELECT f.doc_id, coalesce(string_agg(t.value, '|' ORDER BY t.value) FILTER (t.ioc_type = 'ip'), '') AS ips,
  coalesce(string_agg(t.value, '|' ORDER BY t.value) FILTER (t.ioc_type = 'url'), '') AS urls,
  CAST(count(t.value) AS INTEGER) AS total
FROM files f LEFT JOIN t USING (doc_id) GROUP BY f.doc_id"""))
def _(spark, d):
    b = tokens.with_bundle(files(spark, d).select("doc_id", "body"), "body")
    return b.select("doc_id", F.array_join("ips", "|").alias("ips"), F.array_join("urls", "|").alias("urls"),
                    F.col("total").cast("int").alias("total"))


@query("ioc_counts_by_source", with_sql(DOC_TOKENS, body="""
SELECT source, ioc_type, count(*) AS mentions, count(DISTINCT value) AS indicators
FROM doc_tokens JOIN documents USING (doc_id) GROUP BY ALL"""))
def _(spark, d):
    t = tokens.token_rows(load(spark, d, "documents"), "text", ["source"])
    return t.groupBy("source", "ioc_type").agg(
        F.count("*").alias("mentions"), F.count_distinct("value").alias("indicators"))


@query("private_ip_filter", f"""
SELECT doc_id, value, regexp_matches(value, '{PRIVATE}') AS private
FROM (SELECT doc_id, unnest({found(tokens.IPV4, 'text')}) AS value FROM documents)""")
def _(spark, d):
    rows = load(spark, d, "documents").select(
        "doc_id", F.explode(tokens.ipv4("text", exclude_private=False)).alias("value"))
    return rows.withColumn("private", tokens.is_private("value"))


@query("case_observables", with_sql(DOC_TOKENS, body="""
SELECT source, ioc_type, CASE WHEN ioc_type LIKE 'hash%' THEN 'hash' WHEN ioc_type = 'email' THEN 'mail'
  ELSE ioc_type END AS data_type, value AS data, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY source, ioc_type ORDER BY value) AS rank
      FROM (SELECT DISTINCT source, ioc_type, value FROM doc_tokens JOIN documents USING (doc_id)
            WHERE ioc_type NOT IN ('cve', 'registry_key')))
WHERE rank <= 50"""))
def _(spark, d):
    return bundle_observables(tokens.token_rows(load(spark, d, "documents"), "text", ["source"]), "source", per_type=50)


# A case is a language: the page texts and the page addresses are its captures.
CAPTURES = """
cap AS (SELECT regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) AS lang, html AS text FROM pages
  UNION ALL SELECT regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1), url FROM pages)"""
CASE_TOKENS = f"""
raw AS (SELECT DISTINCT lang, unnest({found(tokens.DOMAIN, 'text')}) AS d FROM cap),
u AS (SELECT DISTINCT lang, unnest({found(tokens.URL, 'text')}) AS u FROM cap),
plain AS (SELECT DISTINCT lang, ioc_type, value FROM ({distinct_tokens('cap', 'lang', 'text')}) WHERE ioc_type <> 'domain')"""


@query("ioc_case_tokens", with_sql(CAPTURES, CASE_TOKENS, body="""
SELECT * FROM plain UNION ALL SELECT DISTINCT lang, 'domain', lower(d) FROM raw
WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.lang = raw.lang AND contains(u.u, raw.d))"""))
def _(spark, d):
    p = load(spark, d, "pages")
    lang = F.regexp_extract("url", "^https?://[^/]+/([a-z]{2})/", 1).alias("lang")
    captures = p.select(lang, F.col("html").alias("text")).unionByName(p.select(lang, F.col("url").alias("text")))
    return matching.case_tokens(captures, "text", "lang")


# ---- matching -------------------------------------------------------------

@query("ioc_match_documents_pages", with_sql(DOC_TOKENS, PAGE_TOKENS, body="""
SELECT doc_id, ioc_type, value, pages FROM doc_tokens
JOIN (SELECT ioc_type, value, count(*) AS pages FROM page_tokens GROUP BY ALL) USING (ioc_type, value)"""))
def _(spark, d):
    feed = tokens.token_rows(load(spark, d, "pages"), "html", ["page_id"])
    feed = feed.groupBy("ioc_type", "value").agg(F.count("*").alias("pages"))
    docs = tokens.token_rows(load(spark, d, "documents"), "text", ["doc_id"])
    return matching.match_tokens(docs, feed).select("doc_id", "ioc_type", "value", "pages")


EVENT_KINDS = [("ip", tokens.EVENT_IP), ("domain", tokens.EVENT_DOMAIN), ("hash_sha256", tokens.EVENT_SHA256)]
PAGE_HOST_FEED = """
feed AS (SELECT regexp_extract(lower(url), '^https?://([^/?#]+)', 1) AS value, 'domain' AS ioc_type,
  count(*) AS weight FROM pages GROUP BY ALL)"""


def event_tokens_sql(table: str, ids: str, column: str, distinct: bool) -> str:
    wrap = "list_distinct({})" if distinct else "{}"
    return " UNION ALL ".join(
        f"SELECT {ids}, '{k}' AS ioc_type, unnest({wrap.format(found(p, f'lower({column})'))}) AS value FROM {table}"
        for k, p in EVENT_KINDS)


def page_hosts(spark, d):
    host = F.regexp_extract(F.lower("url"), r"^https?://([^/?#]+)", 1)
    return load(spark, d, "pages").groupBy(host.alias("value"), F.lit("domain").alias("ioc_type")) \
        .agg(F.count("*").alias("weight"))


@query("ioc_match_events", with_sql(
    PAGE_HOST_FEED, f"t AS ({event_tokens_sql('pages', 'page_id', 'url', True)})", body="""
SELECT page_id, ioc_type, value, weight FROM t JOIN feed USING (ioc_type, value)"""))
def _(spark, d):
    hits = matching.match_events(load(spark, d, "pages"), "url", ["page_id"], page_hosts(spark, d))
    return hits.select("page_id", "ioc_type", "value", "weight")


@query("ioc_match_per_occurrence", with_sql(
    PAGE_HOST_FEED, f"t AS ({event_tokens_sql('pages', 'page_id', 'html', False)})", body="""
SELECT page_id, ioc_type, value, count(*) AS occurrences FROM t JOIN feed USING (ioc_type, value) GROUP BY ALL"""))
def _(spark, d):
    hits = matching.match_events(load(spark, d, "pages"), "html", ["page_id"], page_hosts(spark, d),
                                 per_occurrence=True, salts=4)
    return hits.groupBy("page_id", "ioc_type", "value").agg(F.count("*").alias("occurrences"))


@query("ioc_match_extended", with_sql(FILES_SQL, f"""
t AS (SELECT doc_id, 'url' AS ioc_type, unnest(list_distinct({found(tokens.URL, 'lower(body)')})) AS value FROM files
  UNION ALL SELECT doc_id, 'email', unnest(list_distinct({found(tokens.EMAIL, 'lower(body)')})) FROM files
  UNION ALL SELECT doc_id, 'cve', unnest(list_distinct(list_transform({found(tokens.CVE, 'lower(body)')},
    lambda x: lower(x)))) FROM files
  UNION ALL SELECT doc_id, 'hash_md5', unnest(list_distinct({found(tokens.MD5, 'lower(body)')})) FROM files
  UNION ALL SELECT doc_id, 'hash_sha1', unnest(list_distinct({found(tokens.SHA1, 'lower(body)')})) FROM files
  UNION ALL {event_tokens_sql('files', 'doc_id', 'body', True)})""", body="""
SELECT ioc_type, value, count(*) AS documents FROM t GROUP BY ALL HAVING count(*) > 1"""))
def _(spark, d):
    t = tokens.event_token_rows(files(spark, d), "body", ["doc_id"], extended=True)
    return t.groupBy("ioc_type", "value").agg(F.count("*").alias("documents")).where(F.col("documents") > 1)


# ---- whole events: tokens with their paths, and a feed whose entries expire ----

EVENT_PARTS = [
    '{"id":', "event_id", ',"user":{"mail":"User', "user_id", '@mail.example.org","ip":"203.0.113.', "user_id % 250",
    '"},"files":[{"md5":"', "md5(concat('m', user_id))", '"},{"sha1":"', "sha1(concat('s', user_id))", '","deep":{"sha256":"', "{sha256}",
    '"}}],"note":"see CVE-2024-', "1000 + user_id", ' at http://h', "user_id", ".example.net/p/", "event_id % 5",
    ' \\nand x.","props":', "props", ',"h', "user_id", '.example.com":{"seen":[', "user_id", ',"x', "event_id % 7", '.example.com",null]}}',
]


def _event_json(sha256: str) -> str:
    """The JSON text of an event, as an expression that both engines read."""
    parts = [p.format(sha256=sha256) if p == "{sha256}" else p for p in EVENT_PARTS]
    return "concat(" + ", ".join(sql_text(p) if i % 2 == 0 else p for i, p in enumerate(parts)) + ")"


EVENT_FEED = [
    ("email", "concat('user', u, '@mail.example.org')"), ("ip", "concat('203.0.113.', u % 250)"), ("domain", "concat('h', u, '.example.com')"),
    ("url", "concat('http://h', u, '.example.net/p/3')"), ("hash_md5", "md5(concat('m', u))"), ("hash_sha1", "sha1(concat('s', u))"),
    ("hash_sha256", "{sha256}"), ("cve", "concat('cve-2024-', 1000 + u)"),
]
EVENT_TOKENS = f"""
ev AS (SELECT event_id, ts, {_event_json("sha256(concat('t', user_id))")} AS j FROM events),
tree AS (SELECT e.event_id, e.ts, t.fullkey, t.key, t.type, t.atom FROM ev e, json_tree(e.j) t),
leaf AS (SELECT event_id, ts, fullkey AS path, lower(json_extract_string(atom, '$')) AS text FROM tree WHERE atom IS NOT NULL
  UNION ALL SELECT event_id, ts, fullkey || '~', lower(key) FROM tree WHERE contains(key, '.')),
tok AS (SELECT event_id, ts, path, ioc_type, unnest(list_distinct(found)) AS value FROM (
  SELECT *, unnest(['ip', 'domain', 'hash_sha256', 'url', 'email', 'cve', 'hash_md5', 'hash_sha1']) AS ioc_type,
    unnest([{", ".join(found(p, "text") for p in (tokens.EVENT_IP, tokens.EVENT_DOMAIN, tokens.EVENT_SHA256, tokens.URL, tokens.EMAIL, tokens.CVE, tokens.MD5, tokens.SHA1))}]) AS found FROM leaf))"""
EVENT_FEED_SQL = """
feed AS (SELECT DISTINCT ioc_type, value, u AS weight, first_seen, expires FROM (
  SELECT u, TIMESTAMP '2024-01-05' + to_days(CAST(u % 10 AS INT)) AS first_seen,
    CASE WHEN u % 2 = 0 THEN TIMESTAMP '2024-01-08' + to_days(CAST(u % 10 AS INT)) END AS expires,
    unnest([""" + ", ".join(sql_text(k) for k, _ in EVENT_FEED) + """]) AS ioc_type,
    unnest([""" + ", ".join(e.format(sha256="sha256(concat('t', u))") for _, e in EVENT_FEED) + """]) AS value
  FROM (SELECT DISTINCT user_id AS u FROM events WHERE user_id % 3 <> 1)))"""


def json_events(spark, d):
    """events rows as nested JSON events."""
    text = F.expr(_event_json("sha2(concat('t', user_id), 256)").replace("\\", "\\\\"))  # Spark reads a backslash in a literal as an escape
    return load(spark, d, "events").select("event_id", "ts", F.parse_json(text).alias("event"))


def event_feed(spark, d):
    """Entries of all eight types for most users; those of even users expire three days after they were first seen."""
    users = load(spark, d, "events").where("user_id % 3 <> 1").select(F.col("user_id").alias("u")).distinct()
    entry = lambda k, e: F.struct(F.lit(k).alias("ioc_type"), F.expr(e.format(sha256="sha2(concat('t', u), 256)")).alias("value"))
    day = lambda start: F.lit(start).cast("timestamp_ntz") + F.expr("make_dt_interval(cast(u % 10 as int))")
    rows = users.select("u", F.explode(F.array(*[entry(k, e) for k, e in EVENT_FEED])).alias("e"))
    return rows.select("e.ioc_type", "e.value", F.col("u").alias("weight"), day("2024-01-05 00:00:00").alias("first_seen"),
                       F.when(F.col("u") % 2 == 0, day("2024-01-08 00:00:00")).alias("expires"))


@query("event_path_tokens", with_sql(EVENT_TOKENS, body="SELECT event_id, path, ioc_type, value FROM tok"))
def _(spark, d):
    return tokens.event_path_tokens(json_events(spark, d), "event", ["event_id"])


@query("ioc_match_event_paths", with_sql(EVENT_TOKENS, EVENT_FEED_SQL, body="""
SELECT event_id, path, ioc_type, value, weight FROM tok JOIN feed USING (ioc_type, value)"""))
def _(spark, d):
    hits = matching.match_event_paths(json_events(spark, d), "event", ["event_id"], event_feed(spark, d))
    return hits.select("event_id", "path", "ioc_type", "value", "weight")


@query("ioc_match_valid", with_sql(EVENT_TOKENS, EVENT_FEED_SQL, body="""
SELECT event_id, path, ioc_type, value, weight FROM tok JOIN feed USING (ioc_type, value)
WHERE ts >= first_seen AND (expires IS NULL OR ts < expires)"""))
def _(spark, d):
    hits = matching.match_event_paths(json_events(spark, d), "event", ["event_id"], event_feed(spark, d), ts="ts")
    return hits.select("event_id", "path", "ioc_type", "value", "weight")


@query("ioc_match_heavy", """
SELECT event_id, value, weight FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'hot.example.com' ELSE 'h' || user_id || '.example.com' END AS value FROM events)
JOIN (SELECT 'hot.example.com' AS value, 0::BIGINT AS weight UNION ALL SELECT DISTINCT 'h' || user_id || '.example.com', user_id FROM events WHERE user_id % 3 = 0) USING (value)""")
def _(spark, d):
    """One indicator in half of all events: it is found by a sketch and spread, the others are not."""
    e = load(spark, d, "events")
    host = F.concat(F.lit("h"), F.col("user_id"), F.lit(".example.com"))
    mention = F.when(F.col("event_id") % 2 == 0, "hot.example.com").otherwise(host)
    seen = tokens.event_token_rows(e.withColumn("note", F.concat(F.lit("to "), mention)), "note", ["event_id"])
    users = e.where("user_id % 3 = 0").select(host.alias("value"), F.col("user_id").alias("weight")).distinct()
    hot = spark.range(1).select(F.lit("hot.example.com").alias("value"), F.lit(0).cast("long").alias("weight"))
    feed = users.union(hot).withColumn("ioc_type", F.lit("domain"))
    return matching.match_tokens(seen, feed, salts=None).select("event_id", "value", "weight")


@query("event_text_search", with_sql(EVENT_TOKENS, body="""
SELECT event_id FROM ev WHERE contains(lower(j), 'user7') AND contains(lower(j), 'x3.example.com')"""))
def _(spark, d):
    whole = text.event_text("event")
    return json_events(spark, d).where(whole.contains("user7") & whole.contains("x3.example.com")).select("event_id")


@query("ioc_stats_by_type", with_sql(DOC_TOKENS, body="""
SELECT ioc_type, coalesce(n, 0) AS n FROM
 (SELECT unnest(['ip','domain','hash_md5','hash_sha1','hash_sha256','url','email','cve']) AS ioc_type)
 LEFT JOIN (SELECT ioc_type, count(*) AS n FROM doc_tokens GROUP BY ALL) USING (ioc_type)"""))
def _(spark, d):
    return matching.feed_counts(tokens.token_rows(load(spark, d, "documents"), "text", ["doc_id"]))


@query("hash_watchlist", """
SELECT d.doc_id, d.value, d.ioc_type, f.page_id FROM (
  SELECT doc_id, unnest([md5(text), sha1(text), sha256(text)]) AS value,
    unnest(['hash_md5','hash_sha1','hash_sha256']) AS ioc_type FROM documents) d
JOIN (SELECT doc_id AS page_id, md5(text) AS value, 'hash_md5' AS ioc_type FROM documents) f USING (ioc_type, value)""")
def _(spark, d):
    docs = load(spark, d, "documents")
    hashes = docs.select("doc_id", F.explode(F.array(*hashing.digests("text").values())).alias("digest"))
    feed = docs.select(
        F.col("doc_id").alias("page_id"), F.md5("text").alias("value"), F.lit("hash_md5").alias("ioc_type"))
    return matching.match_digests(hashes, "digest", feed).select("doc_id", "value", "ioc_type", "page_id")


@query("keyword_match_documents", """
SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text))""")
def _(spark, d):
    feed = load(spark, d, "benchmark").withColumnRenamed("text", "passage")
    return matching.match_keywords(load(spark, d, "documents"), "text", ["doc_id"], feed, "passage", ["item_id"])


WORDS = ["license", "token", "the", "und", "que"]


@query("keyword_flags", f"""
SELECT doc_id, word FROM documents, (SELECT unnest({WORDS}) AS word) w WHERE contains(lower(text), word)""")
def _(spark, d):
    docs = load(spark, d, "documents")
    return docs.select("doc_id", F.explode(matching.keyword_flags("text", WORDS)).alias("word"))


# ---- digests and ids ------------------------------------------------------

@query("document_hashes", """
SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents""")
def _(spark, d):
    docs = load(spark, d, "documents")
    return docs.select("doc_id", *[c.alias(n) for n, c in hashing.digests("text").items()])


@query("document_hash_sha512")
def _(spark, d):
    docs = load(spark, d, "documents")
    return docs.select("doc_id", hashing.digest("text", "sha512").alias("sha512"))


@query("hash_kind_lookup", """
SELECT 'virustotal_lookup' AS action, value AS hash, CASE length(value) WHEN 32 THEN 'md5' WHEN 40 THEN 'sha1'
  WHEN 64 THEN 'sha256' ELSE 'unknown' END AS hash_type
FROM (SELECT unnest([md5(html), sha1(html), sha256(html), url]) AS value FROM pages)""")
def _(spark, d):
    p = load(spark, d, "pages")
    values = F.explode(F.array(*hashing.digests("html").values(), F.col("url")))
    return lookup_actions(p.select(values.alias("value")), "value").select("action", "hash", "hash_type")


@query("url_keys", """
SELECT page_id, rtrim(replace(replace(to_base64(encode(url)), '+', '-'), '/', '_'), '=') AS url_key FROM pages""")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", hashing.url_key("url").alias("url_key"))


@query("duplicate_evidence", """
SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents
GROUP BY ALL HAVING count(*) > 1""")
def _(spark, d):
    docs = load(spark, d, "documents").select("doc_id", hashing.digest("text").alias("sha256"))
    return docs.groupBy("sha256").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")) \
               .where(F.col("copies") > 1)


# ---- names and entropy ----------------------------------------------------

HOST_SQL = "regexp_extract(url, '^https?://([^/?#]+)', 1)"


def dns_queries(spark, d):
    return load(spark, d, "pages").select(
        "page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("query_name"))


@query("url_host_profile", f"""
SELECT page_id, {HOST_SQL} AS query_name, split_part({HOST_SQL}, '.', 1) AS label,
  CAST(length(split_part({HOST_SQL}, '.', 1)) AS INTEGER) AS label_length FROM pages""")
def _(spark, d):
    q = dns_queries(spark, d)
    return q.withColumn("label", text.first_label("query_name")).withColumn("label_length", F.length("label"))


@query("text_entropy", """
SELECT page_id, round(entropy, 6) AS entropy FROM (
  SELECT page_id, entropy(letter) AS entropy FROM
    (SELECT page_id, unnest(string_split(lower(url), '')) AS letter FROM pages) GROUP BY page_id)""")
def _(spark, d):
    return load(spark, d, "pages").select("page_id", F.round(text.text_entropy("url"), 6).alias("entropy"))


DGA_SQL = f"""
SELECT query_name, queries, label, round(entropy, 6) AS entropy FROM (
  SELECT query_name, queries, label, (SELECT entropy(c) FROM unnest(string_split(lower(label), '')) t(c)) AS entropy
  FROM (SELECT {HOST_SQL} AS query_name, count(*) AS queries, split_part({HOST_SQL}, '.', 1) AS label
        FROM pages GROUP BY ALL HAVING count(*) >= 2) WHERE length(label) >= 5)
WHERE entropy > 2.0"""


@query("dga_candidates", DGA_SQL)
def _(spark, d):
    found_names = generated_names(dns_queries(spark, d), min_label=5, min_entropy=2.0, min_queries=2)
    return found_names.select("query_name", "queries", "label", F.round("entropy", 6).alias("entropy"))


@query("dga_findings", f"""
SELECT 'HYP-006' AS rule_id, 'network' AS host, 'Potential DGA domain: ' || query_name || ' (entropy=' ||
  format('{{:.2f}}', entropy) || ', queries=' || queries || ')' AS description, 'high' AS severity FROM ({DGA_SQL})""")
def _(spark, d):
    found_names = generated_names(dns_queries(spark, d), min_label=5, min_entropy=2.0, min_queries=2)
    rows = generated_name_findings(found_names, "query_name", F.lit("2024-01-31").cast("timestamp_ntz"))
    return rows.select("rule_id", "host", "description", "severity")


@query("dns_query_counts", f"""
SELECT {HOST_SQL} AS query_name, count(*) AS queries FROM pages
WHERE NOT ends_with({HOST_SQL}, '.example.org') GROUP BY ALL""")
def _(spark, d):
    return query_counts(dns_queries(spark, d), trusted=[".example.org"])


# ---- content --------------------------------------------------------------

def magic_sql(table, default):
    cases = " ".join(f"WHEN starts_with(h, '{p}') THEN {sql_text(v)}" for p, v in table)
    return f"CASE {cases} ELSE {default} END"


@query("content_kinds", with_sql(FILES_SQL, "h AS (SELECT *, hex(content[1:8]) AS h FROM files)", body=f"""
SELECT doc_id, {magic_sql(FILE_MAGIC, 'NULL')} AS file_kind, {magic_sql(SAMPLE_MAGIC, "'Unknown'")} AS sample_kind,
  lower(h[1:8]) AS magic FROM h"""))
def _(spark, d):
    return files(spark, d).select(
        "doc_id", binary.file_kind("content").alias("file_kind"), binary.sample_kind("content").alias("sample_kind"),
        F.lower(binary.head_hex("content", 4)).alias("magic"))


@query("content_packers", with_sql(FILES_SQL, body="""
SELECT doc_id, CASE WHEN contains(h, hex('UPX!'::BLOB)) THEN 'UPX Packer' WHEN contains(h, hex('MPRESS'::BLOB))
  THEN 'MPRESS Packer' WHEN contains(h, hex('NSP0'::BLOB)) THEN 'NSIS Packer' WHEN contains(h, hex('PEC2'::BLOB))
  THEN 'PECompact' END AS packer FROM (SELECT doc_id, hex(content[1:2048]) AS h FROM files)"""))
def _(spark, d):
    return files(spark, d).select("doc_id", binary.packer("content", PACKER_SEARCH_BYTES).alias("packer"))


@query("byte_entropy", """
SELECT doc_id, round(entropy(b), 6) AS entropy FROM (
  SELECT doc_id, unnest(string_split(regexp_replace(hex(encode(text)), '(..)', '\\1,', 'g'), ',')[:-2]) AS b
  FROM documents) GROUP BY doc_id""")
def _(spark, d):
    rows = load(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return rows.select("doc_id", F.round(binary.byte_entropy("content"), 6).alias("entropy"))


@query("printable_strings", """
SELECT page_id, CAST(len(s) AS INTEGER) AS strings, CAST(coalesce(list_sum(list_transform(s, lambda x: length(trim(x)))), 0)
  AS BIGINT) AS letters FROM (SELECT page_id, regexp_extract_all(html, '[\\x20-\\x7e]{6,}', 0) AS s FROM pages)""")
def _(spark, d):
    s = load(spark, d, "pages").select("page_id", binary.ascii_strings(F.encode("html", "UTF-8")).alias("s"))
    letters = F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))
    return s.select("page_id", F.size("s").alias("strings"), letters.alias("letters"))


REASON_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(s, {sql_text(p)}) THEN {sql_text(r)}" for p, r in SUSPICIOUS_STRINGS) + " END"


@query("suspicious_strings", with_sql(FILES_SQL, f"""
s AS (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(body, '[\\x20-\\x7e]{{6,}}', 0),
  lambda x: trim(x)))) AS s FROM files)""", body=f"""
SELECT doc_id, left(s, 200) AS value, {REASON_SQL} AS reason FROM s WHERE {REASON_SQL} IS NOT NULL"""))
def _(spark, d):
    body = files(spark, d).select("doc_id", binary.ascii_strings(F.encode("body", "UTF-8")).alias("s"))
    return body.select("doc_id", F.explode(text.suspicious_strings("s", 200)).alias("t")).select("doc_id", "t.*")


@query("signature_offsets", with_sql(FILES_SQL, "p AS (SELECT doc_id, string_split(text, 'th') AS g FROM documents)",
                                     body="""
SELECT doc_id, sum(octet_length(encode(g[i])))::BIGINT + 2 * (n - 1) AS "offset"
FROM p, unnest(range(1, len(g))) t(n), unnest(range(1, n + 1)) u(i) GROUP BY doc_id, n"""))
def _(spark, d):
    from tracelake.operators.files import carve

    rows = load(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    found_at = carve(rows, [("7468", "marker")], chunk=4096)
    return found_at.select(F.col("path").cast("bigint").alias("doc_id"), "offset")


# ---- signatures -----------------------------------------------------------

def any_sql(names, low="lower(body)"):
    return "(" + " OR ".join(f"contains({low}, {sql_text(n)})" for n in names) + ")"


DL = ["downloadstring", "downloadfile", "invoke-webrequest", "iwr ", "webclient"]
NOTES = ["your files have been encrypted", "all your files are encrypted", "your personal files are encrypted",
         "restore_files", "how_to_decrypt", "readme_for_decrypt", "pay the ransom"]
SIGNATURE_SQL = {
    "Mimikatz_Strings": any_sql(["sekurlsa::logonpasswords", "sekurlsa::wdigest", "lsadump::sam", "lsadump::dcsync",
                                 "privilege::debug", "kerberos::golden", "crypto::capi", "mimikatz", "mimidrv"]),
    "PowerShell_Encoded_Download": any_sql(["-encodedcommand", "-enc ", "-e "]) + " OR (" + any_sql(DL) + " AND "
    + any_sql(["invoke-expression", "iex("]) + ") OR (" + any_sql(["-executionpolicy bypass", "-ep bypass"])
    + " AND " + any_sql(DL) + ")",
    "Cobalt_Strike_Beacon_Artifacts": any_sql(["\\\\.\\pipe\\msagent_", "\\\\.\\pipe\\status_",
                                               "\\\\.\\pipe\\postex_"], "body")
    + " OR " + any_sql(["beacon.dll", "beacon.x64.dll", "malleable c2"]) + " OR contains(hex(content), 'FC4883E4F0E8')",
    "Ransomware_Common_Strings": any_sql(NOTES) + " OR (" + any_sql(["bitcoin", "monero"]) + " AND "
    + any_sql([".onion"]) + ")",
    "WMI_Persistence": "(CAST(contains(body, '__EventFilter') AS INT) + CAST(contains(body, '__EventConsumer') AS INT)"
    " + CAST(contains(body, '__FilterToConsumerBinding') AS INT)) >= 2",
    "Suspicious_PE_Characteristics": "starts_with(head, '4D5A') AND ("
    + any_sql(["UPX!", "UPX0", "MPRESS1", ".vmp0", "ASPack"], "body") + " OR (CAST(contains(body, 'VirtualAllocEx') AS "
    "INT) + CAST(contains(body, 'WriteProcessMemory') AS INT) + CAST(contains(body, 'CreateRemoteThread') AS INT) >= 2))",
    "Office_Macro_Dropper": "starts_with(head, 'D0CF11E0A1B11AE1') AND "
    + any_sql(["auto_open", "autoopen", "document_open", "workbook_open"]) + " AND ("
    + any_sql(["powershell"]) + " OR (" + any_sql(["shell(", "wscript.shell"]) + " AND "
    + any_sql(["http://", "https://"], "body") + "))",
}
HITS_SQL = "sig AS (" + " UNION ALL ".join(
    f"SELECT doc_id, '{n}' AS rule_id FROM files WHERE {p}" for n, p in SIGNATURE_SQL.items()) + ")"


@query("signature_scan", with_sql(FILES_SQL, HITS_SQL, body="SELECT * FROM sig"))
def _(spark, d):
    return scan_content(files(spark, d), ["doc_id"], content="content").select("doc_id", "rule_id")


@query("signature_summary", with_sql(FILES_SQL, HITS_SQL, body="""
SELECT (SELECT count(*) FROM files) AS files_scanned, count(DISTINCT doc_id) AS files_matched,
  count(*) AS detections FROM sig"""))
def _(spark, d):
    f = files(spark, d)
    return scan_summary(f, scan_content(f, ["doc_id"], content="content"), "doc_id")


# ---- signatures, every branch ---------------------------------------------

# What the derived content holds, as (leading bytes, further bytes, strings); each once plain, once wide.
BRANCHES = [
    ("", "", ["sekurlsa::LogonPasswords"]), ("", "", ["privilege::debug"]), ("", "", ["-ENC "]), ("", "", ["IWR ", "iex("]),
    ("", "", ["-EP bypass", "WebClient"]), ("", "", ["-ep bypass"]), ("", "", ["\\\\.\\pipe\\postex_"]), ("", "", ["\\\\.\\PIPE\\postex_"]),
    ("", "", ["Mozilla/5.0 (compatible; MSIE 9.0; Windows NT 6.1; WOW64; Trident/5.0; BOIE9;ENWB)"]),
    ("", "FC4883E4F0E8", []), ("", "0FC4883E4F0E80", []), ("", "", ["malleable c2"]), ("", "", ["MONERO", ".onion"]),
    ("", "", ["CryptGenRandom", "CryptEncrypt"]), ("", "", ["pay the RANSOM"]), ("", "", ["__EventFilter", "__FilterToConsumerBinding"]),
    ("", "", ["CommandLineEventConsumer", "select * FROM __InstanceModificationEvent"]), ("", "", ["CommandLineEventConsumer"]),
    ("", "", ["set-wmiinstance", "__EventConsumer"]), ("", "", ["Set-WmiInstance"]),
    ("4D5A", "", ["NtUnmapViewOfSection", "VirtualAllocEx"]), ("4D5A", "", [".vmp0"]), ("", "", [".vmp0"]), ("4D5A", "", ["CreateRemoteThread"]),
    ("", "D0CF11E0A1B11AE1", ["Workbook_Open", "PowerShell"]), ("", "D0CF11E0A1B11AE1", ["auto_open", "Shell(", "https://"]),
    ("", "D0CF11E0A1B11AE1", ["AutoOpen", "wscript.shell"]), ("", "D0CF11E0A1B11AE1", ["Document_Open", "Shell(", "HTTP://"]),
    ("", "", ["Workbook_Open", "PowerShell"]),
]


def _branch_bytes(encoding: str) -> list[str]:
    return [("01" + more + "01".join(["", *[v.encode(encoding).hex() for v in strings]])).upper() for _, more, strings in BRANCHES]


BRANCH_HEADS = [head for head, _, _ in BRANCHES] * 2
BRANCH_BYTES = _branch_bytes("latin-1") + _branch_bytes("utf-16-le")


def held(*values: str, nocase: bool = True, wide: bool = True) -> str:
    """SQL: whether h, hexadecimal bytes with a dot after each, holds one of the strings."""

    def byte(letter: str) -> str:
        digits = f"{ord(letter):02X}"
        if not nocase or not letter.isalpha():
            return digits
        return {"4": "[46]", "6": "[46]", "5": "[57]", "7": "[57]"}[digits[0]] + digits[1]

    forms = [["", r"00\."][: 1 + wide], values]
    return "regexp_matches(h, '" + "|".join("".join(byte(c) + r"\." + gap for c in v) for gap in forms[0] for v in forms[1]) + "')"


def _case(*values: str) -> str:
    return held(*values, nocase=False)


def _number(*tests: str) -> str:
    return " + ".join(f"CAST({t} AS INT)" for t in tests)


_plain = lambda *values: held(*values, nocase=False, wide=False)
_loads = held("DownloadString", "DownloadFile", "Invoke-WebRequest", "IWR ", "WebClient")
_note = held("Your files have been encrypted", "All your files are encrypted", "Your personal files are encrypted", "RESTORE_FILES", "HOW_TO_DECRYPT",
             "README_FOR_DECRYPT", "pay the ransom")
_wmi = [_case(v) for v in ("__EventFilter", "__EventConsumer", "__FilterToConsumerBinding")]
_consumers, _instance = _case("ActiveScriptEventConsumer", "CommandLineEventConsumer"), held("Select * from __InstanceModificationEvent")
_injects = [_plain(v) for v in ("VirtualAllocEx", "WriteProcessMemory", "CreateRemoteThread", "NtUnmapViewOfSection")]
_address = _case("http://", "https://")
# Every branch of every shipped signature, in full.
BRANCH_SQL = {
    "Mimikatz_Strings": held("sekurlsa::logonpasswords", "sekurlsa::wdigest", "lsadump::sam", "lsadump::dcsync", "privilege::debug", "kerberos::golden",
                             "crypto::capi", "mimikatz", "mimidrv"),
    "PowerShell_Encoded_Download": f"""{held("-EncodedCommand", "-enc ", "-e ")} OR ({_loads} AND {held("Invoke-Expression", "IEX(")})
      OR ({held("-ExecutionPolicy Bypass", "-ep bypass")} AND {_loads})""",
    "Cobalt_Strike_Beacon_Artifacts": f"""{_case("\\\\.\\pipe\\msagent_", "\\\\.\\pipe\\status_", "\\\\.\\pipe\\postex_")} OR {held("beacon.dll", "beacon.x64.dll", "Malleable C2")}
      OR {_case("Mozilla/5.0 (compatible; MSIE 9.0; Windows NT 6.1; WOW64; Trident/5.0; BOIE9;ENWB)")}
      OR (contains(h, 'FC.48.83.E4.F0.E8.') AND octet_length(content) < 10485760)""",
    "Ransomware_Common_Strings": f"""{_note} OR ({held("bitcoin", "monero")} AND {held(".onion")})
      OR ({_case("CryptGenRandom")} AND {_case("CryptEncrypt")} AND {_note})""",
    "WMI_Persistence": f"""{_number(*_wmi)} >= 2 OR ({_consumers} AND {_instance})
      OR ({held("Set-WmiInstance")} AND ({" OR ".join(_wmi)} OR {_consumers} OR {_instance}))""",
    "Suspicious_PE_Characteristics": f"""starts_with(h, '4D.5A.') AND ({_plain("UPX!", "UPX0", "MPRESS1", ".vmp0", "ASPack")} OR {_number(*_injects)} >= 2)""",
    "Office_Macro_Dropper": f"""contains(h, 'D0.CF.11.E0.A1.B1.1A.E1.') AND {held("Auto_Open", "AutoOpen", "Document_Open", "Workbook_Open")}
      AND ({held("powershell")} OR ({held("Shell(")} AND {_address}) OR ({held("WScript.Shell")} AND {_address}))""",
}


@query("signature_branches", f"""
WITH c AS (SELECT doc_id, from_hex({pick_sql(BRANCH_HEADS, f"n_chars % {len(BRANCH_HEADS)}")}) || encode(text)
  || from_hex({pick_sql(BRANCH_BYTES, f"n_chars % {len(BRANCH_BYTES)}")}) AS content FROM documents),
b AS MATERIALIZED (SELECT doc_id, content, regexp_replace(hex(content), '(..)', '\\1.', 'g') AS h FROM c)
""" + " UNION ALL ".join(f"SELECT doc_id, '{name}' AS rule_id FROM b WHERE {test}" for name, test in BRANCH_SQL.items()))
def _(spark, d):
    """Whole texts with bytes that reach, or just miss, each branch of the shipped signatures."""
    n = F.pmod("n_chars", F.lit(len(BRANCH_BYTES)))
    content = F.concat(F.unhex(pick(BRANCH_HEADS, n)), F.encode("text", "UTF-8"), F.unhex(pick(BRANCH_BYTES, n)))
    return scan_content(load(spark, d, "documents").select("doc_id", content.alias("content")), ["doc_id"], content="content").select("doc_id", "rule_id")


USER_SIGNATURES = [
    {"id": "license_text", "severity": "low", "strings": [("a", "MIT License", ""), ("b", "Apache License", "i")],
     "condition": "{1 of a,b}"},
    {"id": "leaked_token", "severity": "high", "strings": [("t1", "token =", "i"), ("q", '"', "")],
     "condition": "{2 of t1,q}"},
]


@query("user_signatures", """
SELECT doc_id, 'license_text' AS rule_id, 'low' AS severity FROM documents
WHERE contains(text, 'MIT License') OR contains(lower(text), 'apache license')
UNION ALL SELECT doc_id, 'leaked_token', 'high' FROM documents WHERE contains(lower(text), 'token =')
  AND contains(text, '"')""")
def _(spark, d):
    return scan_content(load(spark, d, "documents"), ["doc_id"], text="text", signatures=USER_SIGNATURES) \
        .select("doc_id", "rule_id", "severity")


@query("sample_report", with_sql(FILES_SQL, body="""
SELECT doc_id AS sample_id, md5(content) AS md5, sha256(content) AS sha256, CAST(size AS INTEGER) AS file_size,
  starts_with(head, '4D5A') AS is_pe FROM files"""))
def _(spark, d):
    r = samples.analyze(files(spark, d).select(F.col("doc_id").alias("sample_id"), "content"))
    return r.select("sample_id", "md5", "sha256", "file_size", "is_pe")


# Samples that reach every point of the score: executable heads with a header, imports, sections, high entropy, wide strings.
# Little-endian: the header starts at 64; machine 0x14c, three sections, linked 2024-03-16 18:12:16.
PE_HEAD = "4D5A" + "00" * 58 + "40000000" + "50450000" + "4C01" + "0300" + "00E1F565" + "00" * 12
EVERY_BYTE = "".join(f"{i:02X}" for i in range(256))
WIDE = "WScript.Shell CreateRemoteThread".encode("utf-16-le").hex().upper()
SAMPLE_HEX = f"concat(CASE n % 3 WHEN 0 THEN '{PE_HEAD}' WHEN 1 THEN '7F454C46' ELSE '' END, repeat('{EVERY_BYTE}', CAST(CASE n % 4 WHEN 2 THEN 1 WHEN 3 THEN 8 ELSE 0 END AS INT)))"
IMPORTS = [["CreateRemoteThread", "ReadFile"], ["ReadFile"], []]
SECTIONS = [[(".text", 6.1), ("UPX0", 7.9)], [(".text", 5.0)]]
PAIR = r"(?:(?:[2-6][0-9A-F]|7[0-9A-E])\.)"
WIDE_PAIR = r"(?:(?:[2-6][0-9A-F]|7[0-9A-E])\.00\.)"


def unhexed(list_sql: str, drop: str) -> str:
    return f"list_transform({list_sql}, lambda x: trim(decode(from_hex(replace(replace(x, '{drop}', ''), '.', '')))))"


SAMPLES_SQL = f"""
raw AS (SELECT doc_id, n_chars AS n, from_hex({SAMPLE_HEX.replace("n %", "n_chars %")}) || encode(left(text, 300)) || encode({_at(TAILS)})
    || from_hex(CASE WHEN n_chars % 7 = 0 THEN '{WIDE}' ELSE '' END) AS content FROM documents),
h AS (SELECT *, n % 3 = 0 AS pe, regexp_replace(hex(content), '(..)', '\\1.', 'g') AS h FROM raw),
e AS (SELECT doc_id, entropy(b) AS entropy FROM (SELECT doc_id, unnest(string_split(h, '.')[:-2]) AS b FROM h) GROUP BY doc_id),
s AS (SELECT h.*, entropy, {unhexed(f"regexp_extract_all(h, '{PAIR}{{6,}}', 0)", "~")} AS ascii, {unhexed(f"regexp_extract_all(h, '{WIDE_PAIR}{{6,}}', 0)", ".00.")} AS wide FROM h JOIN e USING (doc_id)),
u AS (SELECT doc_id, list(struct_pack(s, r) ORDER BY i) AS bad, list_sort(list_distinct(list(r))) AS reasons FROM (
  SELECT doc_id, s, i, {REASON_SQL} AS r FROM (SELECT doc_id, s, min(i) AS i FROM (SELECT doc_id, unnest(ascii || wide) AS s, generate_subscripts(ascii || wide, 1) AS i FROM s) GROUP BY ALL))
  WHERE r IS NOT NULL GROUP BY doc_id),
j AS (SELECT *, array_to_string(ascii || wide, chr(10)) AS joined FROM s),
tok AS (SELECT doc_id, count(*) FILTER (ioc_type = 'ip') AS ips, count(*) FILTER (ioc_type = 'domain') AS domains, count(*) FILTER (ioc_type = 'url') AS urls
  FROM ({distinct_tokens("j", "doc_id", "joined")}) GROUP BY doc_id),
f AS (SELECT s.*, coalesce(u.bad, []) AS bad, coalesce(u.reasons, []) AS reasons, CAST(coalesce(ips, 0) AS INTEGER) AS ips, CAST(coalesce(domains, 0) AS INTEGER) AS domains,
  CAST(coalesce(urls, 0) AS INTEGER) AS urls, pe AND n % 5 = 0 AS injects, pe AND n % 2 = 0 AS dense,
  CASE WHEN contains(hex(content), '55505821') THEN 'UPX Packer' WHEN contains(hex(content), '4E535030') THEN 'NSIS Packer' END AS packer
  FROM s LEFT JOIN u USING (doc_id) LEFT JOIN tok USING (doc_id))"""


def derived_samples(spark, d):
    docs = load(spark, d, "documents").withColumn("n", F.col("n_chars"))
    tail = F.element_at(F.array(*map(F.lit, TAILS)), (F.col("n") % len(TAILS) + 1).cast("int"))
    wide = F.when(F.col("n") % 7 == 0, F.unhex(F.lit(WIDE))).otherwise(F.unhex(F.lit("")))
    content = F.concat(F.unhex(F.expr(SAMPLE_HEX)), F.encode(F.left("text", F.lit(300)), "UTF-8"), F.encode(tail, "UTF-8"), wide)
    strings = lambda names: F.array(*map(F.lit, names)).cast("array<string>")
    part = lambda rows: F.array(*[F.struct(F.lit(n).alias("name"), F.lit(e).alias("entropy")) for n, e in rows])
    return docs.select(
        F.col("doc_id").alias("sample_id"), content.alias("content"),
        F.when(F.col("n") % 5 == 0, strings(IMPORTS[0])).when(F.col("n") % 5 == 1, strings(IMPORTS[1])).otherwise(strings(IMPORTS[2])).alias("imports"),
        F.when(F.col("n") % 2 == 0, part(SECTIONS[0])).otherwise(part(SECTIONS[1])).alias("sections"))


@query("sample_report_whole", with_sql(SAMPLES_SQL, body="""
SELECT doc_id AS sample_id, CAST(octet_length(content) AS INTEGER) AS file_size, md5(content) AS md5, sha1(content) AS sha1, sha256(content) AS sha256,
  CASE n % 3 WHEN 0 THEN 'PE Executable' WHEN 1 THEN 'ELF Executable' ELSE coalesce(NULL, 'Unknown') END AS file_type, lower(hex(content[1:4])) AS magic_bytes,
  round(entropy, 6) AS entropy, pe AS is_pe, CASE WHEN pe THEN '0x14c' END AS machine, CASE WHEN pe THEN 3 END AS num_sections,
  CASE WHEN pe THEN TIMESTAMP '2024-03-16 18:12:16' END AS link_time,
  CASE WHEN pe THEN CASE WHEN n % 2 = 0 THEN '.text/6.1/false UPX0/7.9/true' ELSE '.text/5.0/false' END ELSE '' END AS sections,
  CASE WHEN pe THEN CASE n % 5 WHEN 0 THEN 'CreateRemoteThread ReadFile' WHEN 1 THEN 'ReadFile' ELSE '' END ELSE '' END AS imports,
  md5(array_to_string(ascii, chr(10))) AS strings_ascii, md5(array_to_string(wide, chr(10))) AS strings_wide,
  md5(array_to_string(list_transform(bad, lambda b: b.s || '>' || b.r), chr(10))) AS suspicious, packer AS packer_detected, ips AS ip_count, domains AS domain_count, urls AS url_count,
  CAST(least(100, CASE WHEN entropy > 7.2 THEN 25 WHEN entropy > 6.5 THEN 10 ELSE 0 END + CASE WHEN packer IS NULL THEN 0 ELSE 20 END + CASE WHEN injects THEN 30 ELSE 0 END
    + CASE WHEN dense THEN 15 ELSE 0 END + least(len(bad) * 3, 20) + CASE WHEN ips + domains + urls > 0 THEN 10 ELSE 0 END) AS INTEGER) AS threat_score,
  array_to_string(list_filter([CASE WHEN entropy > 7.2 THEN 'Very high entropy (' || printf('%.2f', entropy) || ') - possible encryption/packing' WHEN entropy > 6.5 THEN 'High entropy (' || printf('%.2f', entropy) || ')' END,
    'Packer detected: ' || packer, CASE WHEN injects THEN 'Process injection APIs: CreateRemoteThread' END, CASE WHEN dense THEN 'High entropy sections: UPX0' END,
    CASE WHEN len(bad) > 0 THEN 'Suspicious strings: ' || array_to_string(reasons, ', ') END,
    CASE WHEN ips + domains + urls > 0 THEN 'Embedded network IOCs: ' || ips || ' IPs, ' || domains || ' domains' END], lambda x: x IS NOT NULL), '|') AS threat_indicators
FROM f"""))
def _(spark, d):
    r = samples.analyze(derived_samples(spark, d))
    lines = lambda c: F.md5(F.array_join(c, "\n"))
    section = lambda s: F.concat_ws("/", s["name"], s["entropy"].cast("string"), s["suspicious"].cast("string"))
    return r.select(
        "sample_id", "file_size", "md5", "sha1", "sha256", "file_type", "magic_bytes", F.round("entropy", 6).alias("entropy"), "is_pe",
        F.when(F.col("is_pe"), F.col("header.machine")).alias("machine"), F.when(F.col("is_pe"), F.col("header.num_sections")).alias("num_sections"),
        F.when(F.col("is_pe"), F.col("header.link_time").cast("timestamp_ntz")).alias("link_time"),
        F.array_join(F.transform("sections", section), " ").alias("sections"), F.array_join("imports", " ").alias("imports"),
        lines("strings_ascii").alias("strings_ascii"), lines("strings_wide").alias("strings_wide"),
        lines(F.transform("suspicious", lambda s: F.concat(s["value"], F.lit(">"), s["reason"]))).alias("suspicious"), "packer_detected", "ip_count", "domain_count", "url_count",
        F.col("threat_score").cast("int").alias("threat_score"), F.array_join("threat_indicators", "|").alias("threat_indicators"))


@query("sample_scores", with_sql(FILES_SQL, f"""
s AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(body, '[\\x20-\\x7e]{{6,}}', 0),
  lambda x: trim(x))) AS strings FROM files)""", f"""
hits AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(strings) AS s FROM s)
  WHERE {REASON_SQL} IS NOT NULL GROUP BY doc_id)""", f"""
net AS (SELECT doc_id, array_to_string(strings, chr(10)) AS joined FROM s)""", f"""
tok AS (SELECT DISTINCT doc_id FROM ({distinct_tokens('net', 'doc_id', 'joined')})
  WHERE ioc_type IN ('ip', 'domain', 'url'))""", body="""
SELECT f.doc_id AS sample_id, CAST(
  (CASE WHEN contains(f.body, 'UPX!') AND octet_length(f.content) <= 2048 OR contains(hex(f.content[1:2048]),
     hex('UPX!'::BLOB)) OR contains(hex(f.content[1:2048]), hex('NSP0'::BLOB)) THEN 20 ELSE 0 END)
  + least(coalesce(hits.n, 0) * 3, 20) + (CASE WHEN tok.doc_id IS NULL THEN 0 ELSE 10 END) AS INTEGER) AS threat_score
FROM files f LEFT JOIN hits USING (doc_id) LEFT JOIN tok USING (doc_id)"""))
def _(spark, d):
    # Text content: entropy stays below 6.5, so packer, strings and tokens decide.
    f = files(spark, d)
    strings = F.transform(F.regexp_extract_all("body", F.lit(r"[\x20-\x7e]{6,}"), F.lit(0)), lambda s: F.trim(s))
    r = f.select("doc_id", "content", F.array_distinct(strings).alias("s"))
    joined = F.array_join("s", "\n")
    r = r.select("doc_id", binary.packer("content", PACKER_SEARCH_BYTES).alias("packer"), binary.byte_entropy("content").alias("entropy"),
                 F.size(text.suspicious_strings("s", 200)).alias("bad"), joined.alias("joined"))
    network = (F.size(tokens.ipv4("joined")) + F.size(tokens.domains("joined")) + F.size(tokens.urls("joined"))) > 0
    score = samples.threat_score_without_content("entropy", F.col("packer"), F.col("bad"), network)
    return r.select(F.col("doc_id").alias("sample_id"), score.cast("int").alias("threat_score"))


# ---- reputation -----------------------------------------------------------

@query("reputation_join", with_sql(DOC_TOKENS, body="""
SELECT c.source, c.ioc_type, c.value, CAST(c.rank AS INTEGER) AS rank, coalesce(p.pages, 0) AS pages FROM (
  SELECT *, row_number() OVER (PARTITION BY source, ioc_type ORDER BY value) AS rank FROM
    (SELECT DISTINCT source, ioc_type, value FROM doc_tokens JOIN documents USING (doc_id))) c
LEFT JOIN (SELECT 'domain' AS ioc_type, regexp_extract(lower(url), '^https?://([^/?#]+)', 1) AS value,
  count(*) AS pages FROM pages GROUP BY ALL) p USING (ioc_type, value) WHERE c.rank <= 10"""))
def _(spark, d):
    t = tokens.token_rows(load(spark, d, "documents"), "text", ["source"])
    rep = page_hosts(spark, d).withColumnRenamed("weight", "pages")
    return matching.enrich(t, rep, 10, ["source"]).select(
        "source", "ioc_type", "value", "rank", F.coalesce("pages", F.lit(0)).alias("pages"))


def label_reports(spark, d):
    """Reputation reports: one per labelled document."""
    docs = load(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    lab = load(spark, d, "labels")
    n = F.pmod("doc_id", F.lit(5)).cast("bigint")
    stats = F.create_map(
        F.lit("malicious"), F.col("toxic").cast("bigint") * (n + 1),
        F.lit("suspicious"), (1 - F.col("quality")).cast("bigint"), F.lit("harmless"), n)
    verdict = F.create_map(
        F.lit("e1"), F.struct(F.when(F.col("toxic") == 1, "malicious").otherwise("harmless").alias("category"),
                              F.concat(F.lit("name"), n.cast("string")).alias("result")),
        F.lit("e2"), F.struct(F.when(F.col("quality") == 0, "suspicious").otherwise("undetected").alias("category"),
                              F.lit("generic").alias("result")))
    return docs.join(lab, "doc_id", "left").select(
        "doc_id", "hash", F.col("quality").isNotNull().alias("found"),
        F.when(F.col("quality").isNotNull(), stats).alias("stats"),
        F.when(F.col("quality").isNotNull(), verdict).alias("results"))


@query("file_reputation", """
SELECT doc_id, found, CASE WHEN found THEN m > 0 END AS is_malicious, CASE WHEN found THEN m + s END AS detections,
  CASE WHEN found THEN CASE WHEN m + s + n = 0 THEN 1 ELSE m + s + n END END AS total_engines,
  CASE WHEN found THEN (m + s) || '/' || CASE WHEN m + s + n = 0 THEN 1 ELSE m + s + n END END AS detection_ratio,
  CASE WHEN found THEN array_to_string(list_sort(list_filter([CASE s WHEN 1 THEN 'generic' END,
    CASE WHEN toxic = 1 THEN 'name' || n END], lambda x: x IS NOT NULL)), '|') END AS threat_names
FROM (SELECT d.doc_id, l.quality IS NOT NULL AS found, toxic, CAST(toxic * (doc_id % 5 + 1) AS BIGINT) AS m,
        CAST(1 - quality AS BIGINT) AS s, CAST(doc_id % 5 AS BIGINT) AS n
      FROM documents d LEFT JOIN labels l USING (doc_id))""")
def _(spark, d):
    r = label_reports(spark, d).withColumn("key", F.struct("doc_id", "hash"))
    out = reputation.file_reputation(r, "key", names=10)
    return out.select("key.doc_id", "found", "is_malicious", "detections", "total_engines", "detection_ratio",
                      F.array_join("threat_names", "|").alias("threat_names"))


@query("network_reputation", """
SELECT doc_id, found, CASE WHEN found THEN m > 0 END AS is_malicious, CASE WHEN found THEN m END AS detections,
  CASE WHEN found THEN CASE WHEN m + s + n = 0 THEN 1 ELSE m + s + n END END AS total_engines
FROM (SELECT d.doc_id, l.quality IS NOT NULL AS found, CAST(toxic * (doc_id % 5 + 1) AS BIGINT) AS m,
        CAST(1 - quality AS BIGINT) AS s, CAST(doc_id % 5 AS BIGINT) AS n
      FROM documents d LEFT JOIN labels l USING (doc_id))""")
def _(spark, d):
    return reputation.network_reputation(label_reports(spark, d), "doc_id")


@query("sandbox_verdicts", """
SELECT o_orderkey AS report_id, sandbox,
  CASE sandbox WHEN 'cuckoo' THEN CASE WHEN score >= 7 THEN 'malicious' WHEN score >= 4 THEN 'suspicious' ELSE 'clean' END
    WHEN 'anyrun' THEN CASE code WHEN 1 THEN 'clean' WHEN 2 THEN 'suspicious' WHEN 3 THEN 'malicious' ELSE 'unknown' END
    ELSE CASE WHEN pct >= 15 THEN 'malicious' WHEN pct >= 5 THEN 'suspicious' ELSE 'clean' END END AS verdict,
  CAST(CASE sandbox WHEN 'cuckoo' THEN trunc(score * 10) WHEN 'anyrun' THEN code * 20 ELSE pct END AS INTEGER) AS score
FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'cuckoo' WHEN 'O' THEN 'anyrun' ELSE 'service' END AS sandbox,
  floor(o_totalprice / 5000) / 10 AS score, CAST(o_custkey % 5 AS INT) AS code,
  (o_orderkey % 30) * 100 // (o_orderkey % 30 + 60) AS pct FROM orders)""")
def _(spark, d):
    o = load(spark, d, "orders")
    s = F.col("o_orderstatus")
    m = F.pmod("o_orderkey", F.lit(30)).cast("bigint")
    rows = o.select(
        F.col("o_orderkey").alias("report_id"),
        F.when(s == "F", "cuckoo").when(s == "O", "anyrun").otherwise("service").alias("sandbox"),
        F.lit("").alias("sha256"), (F.floor(F.col("o_totalprice") / 5000) / 10).alias("score"),
        F.pmod("o_custkey", F.lit(5)).cast("int").alias("verdict_code"),
        (F.pmod("o_custkey", F.lit(5)) * 20).cast("int").alias("code_score"),
        F.create_map(F.lit("malicious"), m, F.lit("harmless"), F.lit(60).cast("bigint")).alias("stats"))
    return reputation.sandbox_verdicts(rows).drop("sha256")


@query("behaviours_per_process", """
SELECT user_id, event_id, CAST(rank AS INTEGER) AS rank FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM events)
WHERE rank <= 50""")
def _(spark, d):
    return reputation.behaviours(load(spark, d, "events"), ["user_id"], ["ts", "event_id"], 50) \
        .select("user_id", "event_id", "rank")


@query("longest_names", """
SELECT source, doc_id, name, CAST(rank AS INTEGER) AS rank FROM (
  SELECT source, doc_id, lang AS name, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank
  FROM documents) WHERE rank <= 5""")
def _(spark, d):
    docs = load(spark, d, "documents").withColumn("name", F.col("lang"))
    return first_per_group(docs, ["source"], [F.desc("n_chars"), "doc_id"], 5) \
        .select("source", "doc_id", "name", "rank")




# ---- feeds ----------------------------------------------------------------

@query("feed_rows", f"""
SELECT lower({HOST_SQL}) AS value, 'domain' AS ioc_type, 'list' AS source, CASE WHEN page_id % 3 = 0 THEN 50 ELSE page_id % 100 END AS confidence,
  'medium' AS severity FROM pages WHERE page_id % 5 <> 0""")
def _(spark, d):
    """Rows of a list with other column names; a bad confidence drops a row, a missing one counts as 50."""
    p = load(spark, d, "pages")
    number = F.when(F.pmod("page_id", F.lit(5)) == 0, "high").when(F.pmod("page_id", F.lit(3)) == 0, " ") \
        .otherwise(F.pmod("page_id", F.lit(100)).cast("string"))
    rows = p.select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("Indicator"), F.lit("Domain ").alias("Kind"), number.alias("confidence"),
                    F.lit("list").alias("source"))
    out = feeds.feed_from_rows(rows, {"value": "Indicator", "type": "Kind"})
    return out.select("value", "ioc_type", "source", F.col("confidence").cast("bigint").alias("confidence"), "severity")


def _export_lines(spark, d):
    """One event export per page, as JSON text: its host, its host with a port, and a type that is not known."""
    p = load(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"))
    attribute = lambda kind, value, confidence: F.struct(
        F.lit(kind).alias("type"), value.alias("value"), F.lit("c").alias("comment"), confidence.cast("string").alias("confidence"))
    return p.select(F.to_json(F.struct(F.struct(
        F.concat(F.lit("event "), F.col("page_id").cast("string")).alias("info"), F.array(
            attribute("domain", F.upper("host"), F.pmod("page_id", F.lit(4)) * 25), attribute("hostname", F.col("host"), F.lit(None)),
            attribute("domain|ip", F.concat("host", F.lit("|203.0.113.9")), F.lit(80)), attribute("mutex", F.col("host"), F.lit(90)),
        ).alias("Attribute")).alias("Event"))).alias("value"))


EXPORT_SQL = f"""
SELECT 'event ' || page_id AS source, {HOST_SQL} AS value, 'domain' AS ioc_type,
  unnest([CASE WHEN page_id % 4 = 0 THEN 75 ELSE page_id % 4 * 25 END, 75, 80]) AS confidence FROM pages"""


@query("feed_event_export", EXPORT_SQL)
def _(spark, d):
    out = feeds.event_export_feed(feeds.parsed_rows(_export_lines(spark, d), feeds.EXPORT_SCHEMA))
    return out.select("source", "value", "ioc_type", F.col("confidence").cast("bigint").alias("confidence"))


def _pulse_lines(spark, d):
    p = load(spark, d, "pages")
    item = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("indicator"), F.lit("60").alias("confidence"))
    return p.select(F.to_json(F.struct(F.lit("pulse").alias("name"), F.array(
        item("URL", F.upper("url")), item("FileHash-MD5", F.md5("html")), item("YARA", F.col("url"))).alias("indicators"))).alias("value"))


@query("feed_pulse", """
SELECT 'pulse' AS source, unnest([lower(url), md5(html)]) AS value, unnest(['url', 'hash_md5']) AS ioc_type, 60 AS confidence FROM pages""")
def _(spark, d):
    return feeds.pulse_feed(feeds.parsed_rows(_pulse_lines(spark, d), feeds.PULSE_SCHEMA)).select("source", "value", "ioc_type", "confidence")


@query("feed_union_best", f"""
SELECT value, ioc_type, max(confidence) AS confidence FROM ({EXPORT_SQL} UNION ALL
  SELECT 'pulse', unnest([lower(url), md5(html)]), unnest(['url', 'hash_md5']), 60 FROM pages) GROUP BY ALL""")
def _(spark, d):
    """Two feeds as one, the most trusted row of each indicator."""
    both = feeds.union_feeds(feeds.event_export_feed(feeds.parsed_rows(_export_lines(spark, d), feeds.EXPORT_SCHEMA)),
                             feeds.pulse_feed(feeds.parsed_rows(_pulse_lines(spark, d), feeds.PULSE_SCHEMA)), distinct=True)
    return both.select("value", "ioc_type", F.col("confidence").cast("bigint").alias("confidence"))


# ---- formats and tags -----------------------------------------------------

@query("timeline_times", """
SELECT event_id, style, ts AS at FROM events, (SELECT unnest([0, 1, 2]) AS style)
UNION ALL SELECT event_id, 3, CAST(NULL AS TIMESTAMP) FROM events""")
def _(spark, d):
    """The same time in three formats, and a text that is none."""
    shapes = ["yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXX"]
    ts = F.col("ts").cast("timestamp")
    texts = F.array(*[F.date_format(ts, s) for s in shapes], F.concat(F.lit("at "), ts.cast("string")))
    rows = load(spark, d, "events").select("event_id", F.posexplode(texts).alias("style", "text"))
    return rows.select("event_id", "style", times.timeline_time("text").cast("timestamp_ntz").alias("at"))


@query("wide_strings", """
SELECT page_id, url AS found FROM pages""")
def _(spark, d):
    """Two-byte strings between zero bytes."""
    p = load(spark, d, "pages")
    content = F.concat(F.unhex(F.lit("000000")), F.encode("url", "UTF-16LE"), F.unhex(F.lit("00000000")))
    return p.select("page_id", F.explode(binary.wide_strings(content)).alias("found"))


@query("technique_tags", """
SELECT event_id, CASE WHEN k % 3 = 0 THEN NULL ELSE 'T1' || (100 + k) || '.001' END AS technique
FROM (SELECT event_id, CAST(props ->> '$.k' AS INT) AS k FROM events)""")
def _(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    tags = F.array(F.lit("attack.execution"), F.when(F.pmod(k, F.lit(3)) == 0, F.lit("car.2013")).otherwise(
        F.concat(F.lit("attack.t1"), (k + 100).cast("string"), F.lit(".001"))), F.lit("attack.t9999"))
    last = F.when(F.pmod(k, F.lit(3)) == 0, F.slice(tags, 1, 2)).otherwise(tags)
    return load(spark, d, "events").select("event_id", text.technique_tag(last).alias("technique"))
