"""Queries on evidence, cases and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.content.cases import PHASES, REPORT_CAPS, TASK_TEMPLATES
from tracelake.content.lookups import NOTIFICATION_DEADLINES
from tracelake.functions import tokens
from tracelake.operators import cases as cs
from tracelake.operators import evidence as ev
from tracelake.operators import reports
from tracelake.operators.hunts import event_findings
from tracelake.plans.registry import query
from tracelake.plans.text import DOC_TOKENS
from tracelake.plans.views import FILES_SQL, TELEMETRY_SQL, files, load, pick, pick_sql, sql_text, telemetry, with_sql

# ---- evidence -------------------------------------------------------------
# Evidence: all documents. Current state: the labelled documents; those of low
# quality have lost their line breaks since, the unlabelled ones are missing.

NOW_SQL = """
now AS (SELECT d.doc_id, CASE WHEN l.quality = 1 THEN d.text ELSE replace(d.text, chr(10), ' ') || '!' END AS text
  FROM documents d JOIN labels l USING (doc_id))"""


def evidence_pair(spark, d):
    docs = load(spark, d, "documents")
    path = F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    digests = lambda c: [F.md5(c).alias("md5"), F.sha1(c).alias("sha1"), F.sha2(c, 256).alias("sha256")]
    text = F.col("text")
    before = docs.select("doc_id", path.alias("source_path"), *digests(text))
    changed = F.when(F.col("quality") == 1, text).otherwise(F.concat(F.translate(text, "\n", " "), F.lit("!")))
    after = docs.join(load(spark, d, "labels"), "doc_id").select("doc_id", path.alias("path"), *digests(changed))
    return before, after


STATUS_SQL = """
v AS (SELECT d.doc_id, d.source, n.doc_id IS NOT NULL AS here, coalesce(md5(d.text) = md5(n.text), FALSE) AS intact
  FROM documents d LEFT JOIN now n USING (doc_id))"""


@query("integrity_verify", with_sql(NOW_SQL, STATUS_SQL, body="""
SELECT doc_id, intact AS md5_match, intact AS sha1_match, intact AS sha256_match, intact,
  CASE WHEN NOT here THEN 'MISSING' WHEN intact THEN 'INTACT' ELSE 'MODIFIED' END AS status FROM v"""))
def _(spark, d):
    return ev.verify(*evidence_pair(spark, d)).select(
        "doc_id", "md5_match", "sha1_match", "sha256_match", "intact", "status")


@query("verification_totals", with_sql(NOW_SQL, STATUS_SQL, body="""
SELECT source, count(*) AS items, count(*) FILTER (intact) AS intact_items, count(*) FILTER (NOT here) AS missing_items,
  bool_and(intact) AS all_intact FROM v GROUP BY source"""))
def _(spark, d):
    before, after = evidence_pair(spark, d)
    v = ev.verify(before, after, ("md5", "sha256")).withColumn("source", F.split_part("source_path", F.lit("/"), F.lit(1)))
    return ev.verification_totals(v, ["source"])


@query("snapshot_drift", """
SELECT coalesce(b.p_partkey, a.l_partkey) AS key, CASE WHEN b.p_partkey IS NULL THEN 'added' WHEN a.l_partkey IS NULL
  THEN 'removed' WHEN b.h = a.h THEN 'unchanged' ELSE 'changed' END AS drift
FROM (SELECT p_partkey, md5(CAST(p_partkey % 7 AS VARCHAR)) AS h FROM part) b
FULL JOIN (SELECT l_partkey, md5(CAST(l_partkey % 7 + CASE WHEN max(l_quantity) >= 50 THEN 1 ELSE 0 END AS VARCHAR)) AS h
  FROM lineitem GROUP BY l_partkey) a ON b.p_partkey = a.l_partkey""")
def _(spark, d):
    part, li = load(spark, d, "part"), load(spark, d, "lineitem")
    seven = lambda c: F.pmod(c, F.lit(7))
    before = part.select(
        F.col("p_partkey").alias("key"), F.md5(seven("p_partkey").cast("string")).alias("h"))
    busy = F.when(F.col("q") >= 50, 1).otherwise(0)
    after = li.groupBy("l_partkey").agg(F.max("l_quantity").alias("q")).select(
        F.col("l_partkey").alias("key"), F.md5((seven("l_partkey") + busy).cast("string")).alias("h"))
    return ev.drift(before, after, "key", "h").select("key", "drift")


EVIDENCE_SQL = """
evidence AS (SELECT doc_id AS evidence_id, source AS case_id, lang AS evidence_type, 'doc ' || doc_id AS description,
  source || '/' || doc_id AS source_path, CAST(n_chars AS BIGINT) AS file_size_bytes, md5(text) AS md5, sha1(text) AS sha1,
  sha256(text) AS sha256, 'analyst' AS acquired_by, '2024-01-15T10:00:00' AS acquisition_timestamp FROM documents)"""


def evidence_items(spark, d):
    docs = load(spark, d, "documents")
    text = lambda c: F.col(c).cast("string")
    log = F.array(
        F.struct(F.lit("2024-01-15T10:00:00+00:00").alias("timestamp"), F.lit("acquired").alias("action"),
                 F.lit("analyst").alias("actor"), F.lit("lab").alias("location"), F.lit("").alias("notes")),
        F.struct(F.lit("2024-01-16T09:30:00+00:00").alias("timestamp"), F.lit("accessed").alias("action"),
                 F.col("lang").alias("actor"), F.lit("working copy").alias("location"), F.lit("").alias("notes")))
    return docs.select(
        F.col("doc_id").alias("evidence_id"), F.col("source").alias("case_id"), F.col("lang").alias("evidence_type"),
        F.concat(F.lit("doc "), text("doc_id")).alias("description"),
        F.concat(F.col("source"), F.lit("/"), text("doc_id")).alias("source_path"),
        F.col("n_chars").cast("bigint").alias("file_size_bytes"), F.md5("text").alias("md5"), F.sha1("text").alias("sha1"),
        F.sha2("text", 256).alias("sha256"), F.lit("analyst").alias("acquired_by"),
        F.lit("2024-01-15T10:00:00").alias("acquisition_timestamp"), log.alias("custody_log"),
        F.array("lang", "source").alias("tags"), F.lit("").alias("notes"))


@query("evidence_log", with_sql(EVIDENCE_SQL, body="""
SELECT CAST(evidence_id AS VARCHAR) AS "Evidence ID", case_id AS "Case ID", evidence_type AS "Type",
  description AS "Description", source_path AS "Source Path", file_size_bytes AS "File Size (bytes)", md5 AS "MD5",
  sha1 AS "SHA1", sha256 AS "SHA256", acquired_by AS "Acquired By", acquisition_timestamp AS "Acquisition Time",
  'acquired by analyst @ 2024-01-15T10:00:00; accessed by ' || evidence_type || ' @ 2024-01-16T09:30:00'
    AS "Chain of Custody Events", evidence_type || ', ' || case_id AS "Tags", '' AS "Notes" FROM evidence"""))
def _(spark, d):
    return ev.evidence_log(evidence_items(spark, d))


@query("ediscovery_lines", with_sql(EVIDENCE_SQL, body="""
SELECT evidence_id, array_to_string(list_transform([CAST(evidence_id AS VARCHAR), CAST(evidence_id AS VARCHAR), description,
  left(acquisition_timestamp, 10), evidence_type, acquired_by, md5, sha256, source_path, CAST(file_size_bytes AS VARCHAR)],
  lambda x: chr(255) || x || chr(255)), chr(254)) AS line FROM evidence"""))
def _(spark, d):
    return ev.load_file_lines(evidence_items(spark, d))


@query("custody_rows", with_sql(EVIDENCE_SQL, body="""
SELECT evidence_id, case_id, 1 AS seq, 'acquired' AS action, 'analyst' AS actor FROM evidence
UNION ALL SELECT evidence_id, case_id, 2, 'accessed', evidence_type FROM evidence"""))
def _(spark, d):
    return ev.custody_rows(evidence_items(spark, d)).select("evidence_id", "case_id", "seq", "action", "actor")


@query("artifact_manifest", with_sql(FILES_SQL, body="""
SELECT lang AS artifact_type, path, size AS size_bytes, md5(content) AS md5, sha256(content) AS sha256,
  mtime AS collected_at FROM files"""))
def _(spark, d):
    f = files(spark, d).withColumns({"artifact_type": F.col("lang"), "collected_at": F.col("mtime")})
    return ev.manifest(f)


@query("acquired_evidence", """
SELECT 'EV-' || upper(left(sha256(source || chr(31) || source || '/' || doc_id), 8)) AS evidence_id, source AS case_id,
  source || '/' || doc_id AS source_path, sha1(text) AS sha1, CAST(octet_length(encode(text)) AS BIGINT) AS file_size_bytes
FROM documents""")
def _(spark, d):
    docs = load(spark, d, "documents").select(
        F.col("source"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        F.encode("text", "UTF-8").alias("content"), F.lit("2024-01-15").alias("acquired_at"))
    return ev.acquire(docs, "source", "analyst").select(
        "evidence_id", "case_id", "source_path", "sha1", "file_size_bytes")


ACTIONS = ["acquired", "transferred", "accessed", "analyzed", "stored"]
CUSTODY_SQL = f"""
custody AS (SELECT conv_id AS evidence_id, turn AS seq, CASE WHEN turn = 0 AND role <> 'system' THEN 'acquired'
    ELSE {pick_sql(ACTIONS, 'length(text) % 5')} END AS action,
  TIMESTAMP '2024-01-01' + to_minutes(CAST(turn * 10 - length(text) % 40 AS INT)) AS ts FROM conversations)"""


@query("custody_check", with_sql(CUSTODY_SQL, body="""
SELECT evidence_id, seq, place, CASE WHEN place = 1 AND action <> 'acquired' THEN 'not acquired first'
  WHEN place > 1 AND action = 'acquired' THEN 'acquired again' WHEN ts < before THEN 'out of order' END AS issue
FROM (SELECT *, row_number() OVER w AS place, lag(ts) OVER w AS before FROM custody
      WINDOW w AS (PARTITION BY evidence_id ORDER BY seq))"""))
def _(spark, d):
    c = load(spark, d, "conversations")
    n = F.length("text")
    minutes = (F.col("turn") * 10 - F.pmod(n, F.lit(40))).cast("int")
    rows = c.select(
        F.col("conv_id").alias("evidence_id"), F.col("turn").alias("seq"),
        F.when((F.col("turn") == 0) & (F.col("role") != "system"), "acquired")
        .otherwise(pick(ACTIONS, F.pmod(n, F.lit(5)))).alias("action"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
         + F.make_dt_interval(F.lit(0), F.lit(0), minutes)).alias("timestamp"))
    return ev.custody_check(rows).select("evidence_id", "seq", "place", "issue")


# ---- cases ----------------------------------------------------------------

CASE_SQL = f"""
cases AS (SELECT c_custkey AS case_id, c_name AS lead_analyst, {pick_sql(PHASES, 'c_nationkey % 7')} AS current_phase
  FROM customer),
templates AS (SELECT unnest({[t[0] for t in TASK_TEMPLATES]}) AS phase, unnest({[t[1] for t in TASK_TEMPLATES]}) AS seq,
  unnest([{', '.join(sql_text(t[2]) for t in TASK_TEMPLATES)}]) AS title,
  unnest({[t[3] for t in TASK_TEMPLATES]}) AS priority,
  unnest([{', '.join(sql_text(t[4]) for t in TASK_TEMPLATES)}]) AS description),
tasks AS (SELECT case_id, phase, seq, title, description, priority, lead_analyst AS assigned_to,
  CASE WHEN (case_id + seq) % 3 = 0 THEN 'completed' ELSE 'pending' END AS status
  FROM cases JOIN templates ON current_phase = phase)"""


def case_tables(spark, d):
    c = load(spark, d, "customer")
    cases = c.select(F.col("c_custkey").alias("case_id"), F.col("c_name").alias("lead_analyst"),
                     pick(PHASES, F.pmod("c_nationkey", F.lit(7))).alias("current_phase"))
    tasks = cs.seed_tasks(cases).withColumn(
        "status", F.when(F.pmod(F.col("case_id") + F.col("seq"), F.lit(3)) == 0, "completed").otherwise("pending"))
    return cases, tasks


@query("seeded_tasks", with_sql(CASE_SQL, body="""
SELECT 'T-' || upper(left(sha256(case_id || chr(31) || phase || chr(31) || seq), 6)) AS task_id, case_id, phase, seq, title,
  description, priority, assigned_to FROM tasks"""))
def _(spark, d):
    return case_tables(spark, d)[1].drop("status")


@query("open_tasks", with_sql(CASE_SQL, body="""
SELECT case_id, title FROM tasks WHERE status <> 'completed' AND phase = 'containment'"""))
def _(spark, d):
    return cs.open_tasks(case_tables(spark, d)[1], "containment").select("case_id", "title")


@query("next_phases", with_sql(CASE_SQL, body=f"""
SELECT case_id, ({PHASES})[least(list_position({PHASES}, current_phase) + 1, 7)] AS next_phase FROM cases"""))
def _(spark, d):
    return case_tables(spark, d)[0].select("case_id", cs.next_phase("current_phase").alias("next_phase"))


@query("last_notes", """
SELECT conv_id AS case_id, turn, CAST(rank AS INTEGER) AS rank FROM (SELECT conv_id, turn,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations) WHERE rank <= 5""")
def _(spark, d):
    notes = load(spark, d, "conversations").withColumnRenamed("conv_id", "case_id")
    return cs.last_notes(notes, 5, ("turn",)).select("case_id", "turn", "rank")


@query("phase_durations", """
SELECT o_orderkey, o_custkey AS case_id, CAST(epoch(lead(o_orderdate) OVER w) - epoch(o_orderdate) AS BIGINT) AS seconds
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def _(spark, d):
    o = load(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("case_id"), F.col("o_orderdate").alias("ts"),
                                        F.col("o_orderkey").alias("phase"))
    return cs.phase_durations(o).select("o_orderkey", "case_id", "seconds")


@query("case_status", with_sql(CASE_SQL, DOC_TOKENS, body="""
SELECT case_id, 'summary' AS section, CAST(1 AS BIGINT) AS rank, 'IOCs: ' || coalesce(i.n, 0) || ', Open Tasks: ' ||
  coalesce(t.n, 0) AS text FROM cases LEFT JOIN (SELECT doc_id AS case_id, count(DISTINCT value) AS n FROM doc_tokens
  GROUP BY doc_id) i USING (case_id) LEFT JOIN (SELECT case_id, count(*) AS n FROM tasks WHERE status <> 'completed'
  GROUP BY case_id) t USING (case_id)
UNION ALL SELECT case_id, 'open_task', CAST(seq AS BIGINT), '[' || upper(priority) || '] T-' || upper(left(sha256(case_id
  || chr(31) || phase || chr(31) || seq), 6)) || ': ' || title || ' (assigned: ' || assigned_to || ')' FROM tasks
  WHERE status <> 'completed'
UNION ALL SELECT conv_id, 'note', rank, '[' || turn || '] ' || role || ': ' || left(text, 100) FROM (SELECT *,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations) WHERE rank <= 5"""))
def _(spark, d):
    cases, tasks = case_tables(spark, d)
    notes = load(spark, d, "conversations").select(
        F.col("conv_id").alias("case_id"), F.col("turn").alias("ts"), F.col("role").alias("author"),
        F.col("text").alias("content"), F.col("turn").alias("note_id"))
    found = tokens.token_rows(load(spark, d, "documents").withColumnRenamed("doc_id", "case_id"), "text", ["case_id"])
    return cs.status_rows(cases, tasks, notes, found, last=5, width=100)


@query("reversal_guide", """
SELECT o_orderkey AS action_id, '[' || CASE o_orderstatus WHEN 'F' THEN 'block_ip' WHEN 'O' THEN 'disable_account' ELSE
  'kill_process' END || '] c' || o_custkey AS line, 'Reversal: undo c' || o_custkey AS reversal,
  CASE o_orderstatus WHEN 'F' THEN 'inbound rule only; remove the outbound rule as well' END AS note
FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 100000""")
def _(spark, d):
    o = load(spark, d, "orders")
    s, target = F.col("o_orderstatus"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    actions = o.select(
        F.col("o_orderkey").alias("action_id"),
        F.when(s == "F", "block_ip").when(s == "O", "disable_account").otherwise("kill_process").alias("action_type"),
        target.alias("target"), (s != "P").alias("reversible"),
        F.when(F.col("o_totalprice") > 100000, F.concat(F.lit("undo "), target)).alias("reversal_command"))
    return cs.reversal_guide(actions)


@query("notification_deadlines", f"""
SELECT o_orderkey, regime, notify, o_orderdate + to_hours(hours) AS deadline FROM orders, (
  SELECT unnest({[r[0] for r in NOTIFICATION_DEADLINES]}) AS regime, unnest({[r[1] for r in NOTIFICATION_DEADLINES]}) AS hours,
  unnest({[r[2] for r in NOTIFICATION_DEADLINES]}) AS notify) r""")
def _(spark, d):
    return cs.notification_deadlines(load(spark, d, "orders"), "o_orderkey", "o_orderdate")


# ---- reports --------------------------------------------------------------

REPORT_SQL = """
tl AS (SELECT 'src' || (user_id % 20) AS case_id, ts, event_id, 'event ' || event_code AS description, host FROM telemetry),
ranked_tl AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id) AS rank FROM tl),
ioc AS (SELECT DISTINCT source AS case_id, ioc_type, value FROM doc_tokens JOIN documents USING (doc_id)),
ranked_ioc AS (SELECT *, row_number() OVER (PARTITION BY case_id, ioc_type ORDER BY value) AS rank FROM ioc),
ranked_ev AS (SELECT source AS case_id, doc_id, lang, sha256(text) AS sha256,
  row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents)"""


@query("case_report", with_sql(TELEMETRY_SQL, DOC_TOKENS, REPORT_SQL, body="""
SELECT DISTINCT source AS case_id, 'summary' AS section, 1 AS rank, 'case ' || source AS text FROM documents
UNION ALL SELECT case_id, 'timeline', CAST(rank AS INTEGER), strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || description || ' ' || host
FROM ranked_tl WHERE rank <= 50
UNION ALL SELECT case_id, 'indicator_' || ioc_type, CAST(rank AS INTEGER), value FROM ranked_ioc
WHERE (ioc_type IN ('ip', 'domain', 'hash_sha256') AND rank <= 20) OR (ioc_type = 'url' AND rank <= 10)
UNION ALL SELECT case_id, 'evidence', CAST(rank AS INTEGER), 'doc ' || doc_id || ' ' || left(sha256, 16) FROM ranked_ev
WHERE rank <= 20
UNION ALL SELECT 'src' || (user_id % 20), 'action', NULL, event_type || ' ' || host FROM telemetry"""))
def _(spark, d):
    docs = load(spark, d, "documents")
    t = telemetry(spark, d).withColumn("case_id", F.concat(F.lit("src"), F.pmod("user_id", F.lit(20)).cast("string")))
    tl = t.select("case_id", "ts", "event_id", "host", F.lit("info").alias("severity"), F.lit("Sysmon").alias("source"),
                  F.concat(F.lit("event "), F.col("event_code").cast("string")).alias("description"))
    found = tokens.token_rows(docs, "text", ["source"]).withColumnRenamed("source", "case_id")
    cases = docs.select(F.col("source").alias("case_id")).distinct().select(
        "case_id", F.concat(F.lit("case "), F.col("case_id")).alias("title"), F.lit("high").alias("severity"),
        F.lit("malware").alias("category"))
    actions = t.select(
        "case_id", F.col("event_id").alias("action_id"), F.col("event_type").alias("action_type"),
        F.col("host").alias("target"), F.lit(True).alias("success"))
    r = reports.case_report(cases, tl, found, evidence_items(spark, d), actions, REPORT_CAPS,
                            {"timeline": 60, "evidence": 40, "sha256": 16})
    g = lambda k: F.try_element_at("fields", F.lit(k))
    text = (F.when(F.col("section") == "summary", g("title"))
            .when(F.col("section") == "timeline", F.concat_ws(" ", g("timestamp"), g("description"), g("host")))
            .when(F.col("section") == "evidence", F.concat_ws(" ", g("description"), g("sha256")))
            .when(F.col("section") == "action", F.concat_ws(" ", g("action_type"), g("target")))
            .otherwise(g("value")))
    return r.select("case_id", "section", "rank", text.alias("text"))


@query("forensic_findings_section", with_sql(TELEMETRY_SQL, body="""
SELECT host AS case_id, 'hunt' AS section, unnest(['findings', 'last']) AS item,
  unnest([CAST(count(*) AS VARCHAR), CAST(max(event_id) AS VARCHAR)]) AS value FROM telemetry
WHERE contains(lower(image), 'powershell') AND regexp_matches(cmdline, '(?i)-e(?:nc(?:oded)?)?(?:Command)?\\s+[A-Za-z0-9+/=]{20,}')
GROUP BY host"""))
def _(spark, d):
    f = event_findings(telemetry(spark, d), only=["HYP-003"]).groupBy("host").agg(
        F.count("*").alias("n"), F.max("event_id").alias("last"))
    return reports.findings_section(f, "host", "hunt", {"findings": F.col("n"), "last": F.col("last")})
