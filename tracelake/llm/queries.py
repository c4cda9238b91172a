"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import ann, chat, exact_dedup, html_text, mixing, packing, quality, sharding, simhash, token_files, url_filter, vector_codes, whitening
from tracelake.llm.common import read
from tracelake.llm.url_filter import LONG_SUFFIXES, UrlRule

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

URL_RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bin_completion_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(read(spark, sf_dir, "documents"), tokenizer(), length=1024, end_id=2)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.packed(digests, capacity=1024)


def op2_consistent_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.sharded(read(spark, sf_dir, "documents"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op3_bit_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_files.write_tokens(read(spark, sf_dir, "documents"), tokenizer(), end_id=0)
    return token_files.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_groups(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def op5_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"), keep="largest")


OP6_SQL = f"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents),
ranked AS (SELECT *, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
                  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) AS place
           FROM t WINDOW g AS (PARTITION BY text_sha256))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked
"""


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled page is bad when its label is of low quality or toxic."""
    labels = read(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    rows = url_filter.judged(read(spark, sf_dir, "pages"), outcomes, URL_RULES)
    return rows.select("page_id", "host", "path", "rule", "verdict", F.round("bad_rate", 6).alias("bad_rate"), F.round("bad_bound", 6).alias("bad_bound"))


def _strength_sql(table: str) -> str:
    """Strength of the prior by the method of moments, over groups (n, k, prior)."""
    return f"""
    SELECT CASE WHEN noise IS NULL OR noise = 0 OR n = squares / n THEN 10000.0
                WHEN between_ > 0 THEN least(greatest(1 / between_ - 1, 1.0), 10000.0) ELSE 10000.0 END AS m
    FROM (SELECT *, (spread - (g - 1) * (noise / n)) / (n - squares / n) / (noise / n) AS between_
          FROM (SELECT sum(n)::DOUBLE AS n, sum(n * n)::DOUBLE AS squares, count(*) AS g,
                       sum(n * pow(k / n - prior, 2)) AS spread, sum(n * prior * (1 - prior)) AS noise FROM {table}))"""


OP7_SQL = f"""
WITH urls AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM urls),
ends AS (SELECT *, regexp_extract(host, '([^.]*[.])?[^.]*$', 0) AS two, regexp_extract(host, '([^.]*[.])?([^.]*[.])?[^.]*$', 0) AS three FROM parts),
levels AS (SELECT page_id, host, path, CASE WHEN two IN {LONG_SUFFIXES} THEN two ELSE regexp_extract(host, '[^.]*$', 0) END AS suffix,
                  CASE WHEN two IN {LONG_SUFFIXES} THEN three ELSE two END AS domain FROM ends),
labelled AS (SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum((quality = 0 OR toxic = 1)::INT)::DOUBLE AS k
             FROM levels JOIN labels ON page_id = doc_id WHERE (quality = 0 OR toxic = 1) IS NOT NULL GROUP BY ALL),
overall AS (SELECT coalesce(sum(k) / sum(n), 0) AS p FROM labelled),
s1 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(p) AS prior FROM labelled, overall GROUP BY suffix),
m1 AS ({_strength_sql('s1')}),
s2 AS (SELECT suffix, (k + m * prior) / (n + m) AS rate FROM s1, m1),
d1 AS (SELECT domain, sum(n) AS n, sum(k) AS k, any_value(rate) AS prior FROM labelled JOIN s2 USING (suffix) GROUP BY domain),
m2 AS ({_strength_sql('d1')}),
d2 AS (SELECT domain, (k + m * prior) / (n + m) AS rate FROM d1, m2),
h1 AS (SELECT host, n, k, rate AS prior FROM labelled JOIN d2 USING (domain)),
m3 AS ({_strength_sql('h1')}),
rates AS (SELECT l.*, coalesce(h1.n, 0) AS n, m,
                 (coalesce(h1.k, 0) + m * coalesce(d2.rate, s2.rate, p)) / (coalesce(h1.n, 0) + m) AS bad_rate
          FROM levels l LEFT JOIN h1 USING (host) LEFT JOIN d2 USING (domain) LEFT JOIN s2 USING (suffix), m3, overall),
bounds AS (SELECT *, greatest(bad_rate - 1.645 * sqrt(bad_rate * (1 - bad_rate) / (n + m + 1)), 0.0) AS bad_bound FROM rates),
ruled AS (SELECT *, CASE
    WHEN regexp_matches(host, '(^|[.])example[.]org$') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN regexp_matches(host, '(^|[.])example[.]org$') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN regexp_matches(host, '(^|[.])com$') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN regexp_matches(host, '(^|[.])com$') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN regexp_matches(host, '(^|[.])org$') AND starts_with(path, '/') THEN 'org/' END AS rule FROM bounds)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN bad_bound >= 0.5 THEN 'block' ELSE 'allow' END AS verdict,
       round(bad_rate, 6) AS bad_rate, round(bad_bound, 6) AS bad_bound
FROM ruled
"""


def op8_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scorer = quality.train(docs, read(spark, sf_dir, "labels"))
    rows = quality.scored(docs.select("doc_id", "text"), scorer)
    return rows.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix_table(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP9_SQL = r"""
WITH t AS (
    SELECT doc_id, source, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS size,
           -ln((('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, md5(x))), 1, 12))::BIGINT + 0.5) / 281474976710656.0)
           / ((length(regexp_replace(x, '[^\p{L}]', '', 'g')) + 1) / (length(x) + 1)) AS key
    FROM (SELECT *, coalesce(text, '') AS x FROM documents)),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM t GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
              source_size * 3 AS cap, sum(source_size) OVER () AS budget FROM s0),
s2 AS (SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS left_,
              sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS over_ FROM s1),
s3 AS (SELECT *, cap > left_ * weight / over_ AS free FROM s2),
s4 AS (SELECT source, source_size, CASE WHEN free THEN arg_max(left_, over_) FILTER (free) OVER () * weight / max(over_) FILTER (free) OVER () ELSE cap::DOUBLE END AS target FROM s3),
s5 AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs FROM s4),
r AS (SELECT t.doc_id, t.size, s5.source_size, s5.target, s5.epochs, s5.target - s5.epochs * s5.source_size AS rest,
             coalesce(sum(size) OVER (PARTITION BY t.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 AS middle
      FROM t JOIN s5 ON t.source IS NOT DISTINCT FROM s5.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * (epochs + (rest > 0 AND middle <= rest)::INT))::BIGINT AS taken FROM r
"""

def op10_tree_model_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    rows = html_text.extracted(pages, html_text.train(pages))
    return rows.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op11_gnat_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector_codes.vector_codes(read(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _codes_sql(rounds: int = 6) -> str:
    """Each round: the nearest entry of every part by a minimum over all entries, then the floors of the means."""

    def assign(k: int) -> str:
        return f"""
a{k} AS MATERIALIZED (SELECT r, part, arg_min(entry, square * 16 + entry) AS entry, min(square) AS square FROM (
    SELECT r, x.part, b.entry, sum((x.x - b.x) * (x.x - b.x)) AS square FROM xs x JOIN b{k} b ON x.part = b.part AND x.place = b.place GROUP BY ALL) GROUP BY r, part)"""

    def move(k: int) -> str:
        return f"""
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.place, coalesce((s - ((s % n) + n) % n) // n, b.x) AS x FROM b{k} b LEFT JOIN (
    SELECT part, entry, place, sum(x) AS s, count(*) AS n FROM xs JOIN a{k} USING (r, part) GROUP BY ALL) USING (part, entry, place))"""

    steps = ",".join(assign(k) + "," + move(k) for k in range(rounds))
    return f"""
WITH rs AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r FROM embeddings
                         WHERE len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
xs AS MATERIALIZED (SELECT r, i * 8 // len(embedding) AS part, i % (len(embedding) // 8) AS place, floor(4096 * embedding[i + 1]::DOUBLE)::BIGINT AS x
                    FROM (SELECT r, embedding, unnest(range(len(embedding))) AS i FROM rs)),
b0 AS MATERIALIZED (SELECT part, r AS entry, place, x FROM xs WHERE r < 16),{steps},{assign(rounds)},
coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(square)::BIGINT AS error FROM a{rounds} GROUP BY r),
digest AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM rs JOIN coded USING (r), digest
"""


def op12_chat_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts are marks."""
    said = "</s>[INST] ok [/INST]"
    marks = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(marks)
    return chat.read_back(chat.formatted(rows))


OP12_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
f AS (SELECT *, lag(role, 1, '') OVER o AS before, lead(role) OVER o IS NULL AS last,
             regexp_replace(text, '([<\[])(\\*)(/?(?:s>|(?:INST|SYS|ROLE)\]))', '\1\\\2\3', 'g') AS safe,
             regexp_replace(role, '([<\[])(\\*)(/?(?:s>|(?:INST|SYS|ROLE)\]))', '\1\\\2\3', 'g') AS safe_role
      FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
g AS (SELECT *, CASE role WHEN 'system' THEN '[SYS] ' || safe || ' [/SYS]' WHEN 'user' THEN '<s>[INST] ' || safe || ' [/INST]'
                          WHEN 'assistant' THEN ' ' || safe || '</s>' ELSE '[ROLE] ' || safe_role || ' [/ROLE] ' || safe || '[/ROLE]' END AS formatted,
             ((before IN ('', 'assistant') AND role = 'user') OR (before = '' AND role = 'system') OR (before = 'system' AND role = 'user')
              OR (before = 'user' AND role = 'assistant')) AS fits FROM f)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(formatted))::BIGINT AS formatted_chars, count(*) FILTER (NOT fits) AS bad_turns,
       bool_and(fits) AND bool_or(last AND role = 'assistant') AS valid
FROM g GROUP BY conv_id
"""


def op13_bidiagonal_qd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whitened(read(spark, sf_dir, "embeddings"), components=8, scale=1024, shift=100_000)
    return rows.withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {
    "op1_bin_completion_packing": op1_bin_completion_packing,
    "op2_consistent_hash_shards": op2_consistent_hash_shards,
    "op3_bit_packed_tokens": op3_bit_packed_tokens,
    "op4_simhash_golay": op4_simhash_golay,
    "op5_multi_index_hashing": op5_multi_index_hashing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_url_reputation": op7_url_reputation,
    "op8_pu_quality": op8_pu_quality,
    "op9_mix_sources": op9_mix_sources,
    "op10_tree_model_text": op10_tree_model_text,
    "op11_gnat_vector_codes": op11_gnat_vector_codes,
    "op12_chat_state_machine": op12_chat_state_machine,
    "op13_bidiagonal_qd_whitening": op13_bidiagonal_qd_whitening,
}
ORACLES: dict[str, str | None] = {
    "op6_exact_dedup": OP6_SQL,
    "op7_url_reputation": OP7_SQL,
    "op9_mix_sources": OP9_SQL,
    "op11_gnat_vector_codes": _codes_sql(),
    "op12_chat_state_machine": OP12_SQL,
}
