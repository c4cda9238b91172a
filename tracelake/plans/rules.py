"""Queries on hunts and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.content.alert_rules import ALERT_FIELDS, ALERT_RULES
from tracelake.content.collection_policy import COLLECTION_POLICY, POLICY_FIELDS
from tracelake.content.hunts import ENCODED_COMMAND, HYPOTHESES
from tracelake.operators import hunts, reports
from tracelake.operators.ordered import count_within
from tracelake.operators.timeline import conform, technique_name, technique_phases
from tracelake.plans.registry import query
from tracelake.plans.text import DGA_SQL, dns_queries
from tracelake.plans.views import EVENT_FIELDS, TELEMETRY_SQL, load, sql_text, telemetry, with_sql
from tracelake.rules.alerts import alert_rule, frequency_hits, scan_alerts, shipped_alert_rules
from tracelake.rules.policy import collected, policy_rules
from tracelake.rules.predicates import catalogue, coverage, scan
from tracelake.rules.sigma import Fields, shipped_sigma_rules, sigma_rule

# ---- hunts ----------------------------------------------------------------

LOLBIN_SQL = """
SELECT event_id, host, 'HYP-001' AS rule_id, 'LOLBin abuse detected: ' || lower(image) || ' with suspicious cmdline'
  AS description FROM telemetry, (SELECT unnest(['certutil.exe', 'mshta.exe', 'regsvr32.exe', 'rundll32.exe', 'wscript.exe', 'cscript.exe', 'msiexec.exe',
  'installutil.exe', 'cmstp.exe', 'xwizard.exe', 'syncappvpublishingserver.exe', 'appsyncpublishingserver.exe', 'odbcconf.exe']) AS name) n
WHERE contains(lower(image), name) AND (contains(lower(cmdline), 'http') OR contains(lower(cmdline), '\\temp\\')
  OR contains(lower(cmdline), 'base64'))"""
BASE = "string_split(replace(lower(source_image), '\\', '/'), '/')[-1]"
LSASS_SQL = f"""
SELECT event_id, host, 'HYP-002' AS rule_id, 'LSASS access by unexpected process: ' || lower(source_image) AS description
FROM telemetry WHERE contains(lower(target_image), 'lsass.exe')
  AND NOT regexp_matches({BASE}, 'antimalware|defender|antivirus|splunk|sysmon')
  AND {BASE} NOT IN ('system', 'csrss.exe', 'wininit.exe', 'services.exe', 'svchost.exe')"""
LSASS_COMPAT_SQL = """
SELECT event_id, host FROM telemetry WHERE contains(lower(target_image), 'lsass.exe')
  AND NOT regexp_matches(lower(source_image), 'antimalware|defender|antivirus|splunk|sysmon|system')"""
SHELL_SQL = f"""
SELECT event_id, host, 'HYP-003' AS rule_id, 'Suspicious encoded PowerShell command' AS description FROM telemetry
WHERE contains(lower(image), 'powershell') AND regexp_matches(cmdline, {sql_text(ENCODED_COMMAND)})"""
LATERAL_SQL = """
SELECT event_id, host, 'HYP-004' AS rule_id, 'Remote execution from another host' AS description FROM telemetry
WHERE (event_code = 7045 AND contains(lower(service_name), 'psexesvc')) OR (ends_with(lower(parent_image),
  '\\wmiprvse.exe') AND regexp_matches(lower(image), '\\\\(cmd|powershell|cscript|wscript|mshta)\\.exe$'))"""
TASK_SQL = """
SELECT event_id, host, 'HYP-005' AS rule_id, 'Scheduled task created outside business hours' AS description
FROM telemetry WHERE event_code = 4698 AND (dayofweek(ts) IN (0, 6) OR hour(ts) < 8 OR hour(ts) >= 18)"""
ALL_HUNTS = " UNION ALL ".join([LOLBIN_SQL, LSASS_SQL, SHELL_SQL, LATERAL_SQL, TASK_SQL])
SHORT = ["event_id", "host", "rule_id", "description"]
# All seven: the tests of single events, generated names as of a day, and logins at unusual hours.
SEVEN_SQL = f"""
SELECT event_id, host, rule_id, description, ts FROM ({ALL_HUNTS}) JOIN (SELECT event_id, ts FROM telemetry) USING (event_id)
UNION ALL SELECT CAST(NULL AS BIGINT), 'network', 'HYP-006', 'Potential DGA domain: ' || query_name || ' (entropy=' ||
  format('{{:.2f}}', entropy) || ', queries=' || queries || ')', TIMESTAMP '2024-01-31' FROM ({DGA_SQL})
UNION ALL SELECT event_id, 'host-' || user_id, 'HYP-007',
  'Login of ' || user_id || ' at hour ' || hour || ', ' || logins || ' of ' || total || ' logins', ts
FROM (SELECT event_id, user_id, ts, CAST(hour(ts) AS INTEGER) AS hour, count(*) OVER (PARTITION BY user_id, hour(ts)) AS logins,
  count(*) OVER (PARTITION BY user_id) AS total FROM events) WHERE logins <= 0.1 * total AND total >= 10"""


def seven(spark, d):
    names = hunts.generated_names(dns_queries(spark, d), min_label=5, min_entropy=2.0, min_queries=2)
    logins = load(spark, d, "events").withColumn("host", F.concat(F.lit("host-"), F.col("user_id").cast("string")))
    return hunts.all_findings(
        hunts.event_findings(telemetry(spark, d), widths=(200, 300)),
        hunts.generated_name_findings(names, "query_name", F.lit("2024-01-31").cast("timestamp_ntz")),
        hunts.unusual_login_findings(hunts.unusual_logins(logins, "user_id", max_share=0.1, min_history=10), "user_id"))


def _hunt(spark, d, rule):
    return hunts.event_findings(telemetry(spark, d), only=[rule]).select(*SHORT)


for _name, _rule, _sql in [("hunt_lolbin", "HYP-001", LOLBIN_SQL), ("hunt_lsass", "HYP-002", LSASS_SQL),
                           ("hunt_encoded_shell", "HYP-003", SHELL_SQL), ("hunt_lateral_movement", "HYP-004", LATERAL_SQL),
                           ("hunt_task_off_hours", "HYP-005", TASK_SQL)]:
    query(_name, with_sql(TELEMETRY_SQL, body=_sql))(lambda spark, d, rule=_rule: _hunt(spark, d, rule))


@query("hunt_lsass_compat", with_sql(TELEMETRY_SQL, body=LSASS_COMPAT_SQL))
def _(spark, d):
    return hunts.event_findings(telemetry(spark, d), compat=True, only=["HYP-002"]).select("event_id", "host")


@query("hunt_all", with_sql(TELEMETRY_SQL, f"f AS ({SEVEN_SQL})", body=f"""
SELECT event_id, host, rule_id, description, ts, title, severity, mitre, CASE rule_id WHEN 'HYP-006' THEN 3 WHEN 'HYP-007' THEN 3
  WHEN 'HYP-001' THEN 3 WHEN 'HYP-002' THEN 2 WHEN 'HYP-004' THEN 3 ELSE 1 END AS facts FROM f JOIN (
  SELECT unnest({[h[0] for h in HYPOTHESES]}) AS rule_id, unnest({[h[1] for h in HYPOTHESES]}) AS title,
    unnest({[h[2] for h in HYPOTHESES]}) AS mitre, unnest({[h[3] for h in HYPOTHESES]}) AS severity) USING (rule_id)"""))
def _(spark, d):
    return seven(spark, d).select(*SHORT, "ts", "title", "severity", "mitre", F.size("evidence").alias("facts"))


@query("findings_per_hypothesis", with_sql(TELEMETRY_SQL, f"f AS ({SEVEN_SQL})", body=f"""
SELECT h.rule_id, h.technique, coalesce(n, 0) AS findings FROM (
  SELECT unnest({[h[0] for h in HYPOTHESES]}) AS rule_id, unnest({[h[2] for h in HYPOTHESES]}) AS technique) h
LEFT JOIN (SELECT rule_id, count(*) AS n FROM f GROUP BY ALL) USING (rule_id)"""))
def _(spark, d):
    f = seven(spark, d)
    return reports.findings_per_hypothesis(f).select("rule_id", "technique", "findings")


@query("hunt_report", with_sql(TELEMETRY_SQL, f"f AS ({SEVEN_SQL})", body=f"""
SELECT rule_id, CAST(rank AS INTEGER) AS rank, upper_severity || host || ': ' || left(description, 80) AS text FROM (
  SELECT f.*, CASE rule_id WHEN 'HYP-002' THEN '[CRITICAL] ' WHEN 'HYP-005' THEN '[MEDIUM] ' WHEN 'HYP-007' THEN '[MEDIUM] ' ELSE '[HIGH] ' END
    AS upper_severity, row_number() OVER (PARTITION BY rule_id ORDER BY ts, event_id, description) AS rank
  FROM f) WHERE rank <= 5
UNION ALL SELECT h.rule_id, 0, '[' || h.rule_id || '] ' || h.title || ' | ' || h.technique || ' | findings: ' || coalesce(n, 0)
FROM (SELECT unnest({[h[0] for h in HYPOTHESES]}) AS rule_id, unnest({[h[1] for h in HYPOTHESES]}) AS title,
  unnest({[h[2] for h in HYPOTHESES]}) AS technique) h
LEFT JOIN (SELECT rule_id, count(*) AS n FROM f GROUP BY ALL) USING (rule_id)"""))
def _(spark, d):
    return reports.hunt_report(seven(spark, d), first=5, width=80)


@query("custom_hunt", """
SELECT event_id, 'host-' || user_id AS host, 'CUSTOM' AS rule_id, 'large value' AS description, 'T1041' AS mitre
FROM events WHERE value > 150""")
def _(spark, d):
    rows = hunts.custom_hunt(telemetry(spark, d).select("event_id", "ts", "host", "value"), "large value",
                             lambda e: e.where(F.col("value") > 150), technique="T1041")
    return rows.select("event_id", "host", "rule_id", "description", "mitre")


# ---- alert rules ----------------------------------------------------------

def _gate_sql(source):
    code = source.removeprefix("sysmon_event")
    return f"channel = 'sysmon' AND event_code = {code}" if code != source else f"channel = '{source}'"


def _rule_sql(row):
    rule_id, level, technique, _, source, conditions, _ = row
    tests = [_gate_sql(source)]
    for field, pattern, *negate in conditions:
        column = f"coalesce(CAST({ALERT_FIELDS[field]} AS VARCHAR), '')"
        tests.append(("NOT " if negate else "") + f"regexp_matches({column}, {sql_text(pattern)})")
    return (f"SELECT event_id, ts, host, '{rule_id}' AS rule_id, {level} AS level, '{technique}' AS mitre FROM telemetry "
            f"WHERE {' AND '.join(tests)}")


ALERT_HITS = "hits AS (" + " UNION ALL ".join(_rule_sql(r) for r in ALERT_RULES) + ")"
KEEP = ["event_id", "ts", "host"]


# One rule of each kind of gate and condition, in full: these do not follow the shipped table when it changes.
WRITTEN_OUT = {
    "100002": """
SELECT event_id, ts, host, '100002' AS rule_id, 14 AS level, 'T1003.001' AS mitre FROM telemetry WHERE channel = 'sysmon' AND event_code = 10
  AND contains(lower(target_image), 'lsass.exe')
  AND NOT regexp_matches(coalesce(lower(source_image), ''), 'svchost\\.exe|wininit\\.exe|csrss\\.exe|system|antimalware|msmpeng')""",
    "100020": """
SELECT event_id, ts, host, '100020' AS rule_id, 12 AS level, 'T1218.014' AS mitre FROM telemetry WHERE channel = 'sysmon'
  AND contains(lower(image), 'certutil.exe') AND (contains(lower(cmdline), '-decode') OR contains(lower(cmdline), '-urlcache')
  OR contains(lower(cmdline), '-encode') OR contains(lower(cmdline), 'http://') OR contains(lower(cmdline), 'https://'))""",
    "100041": """
SELECT event_id, ts, host, '100041' AS rule_id, 14 AS level, 'T1053.005' AS mitre FROM telemetry WHERE channel = 'windows'
  AND event_code = 4698 AND (contains(lower(task_content), '\\temp\\') OR contains(lower(task_content), '\\appdata\\')
  OR contains(lower(task_content), '\\public\\'))""",
}

for _row in ALERT_RULES:
    query(f"alert_rule_{_row[0]}", with_sql(TELEMETRY_SQL, body=WRITTEN_OUT.get(_row[0]) or _rule_sql(_row)))(
        lambda spark, d, row=_row: scan(telemetry(spark, d), [alert_rule(*row)], KEEP).drop("title", "severity"))


@query("rule_scan_multi", with_sql(TELEMETRY_SQL, ALERT_HITS, body="""
SELECT event_id, host, rule_id, level, mitre FROM hits"""))
def _(spark, d):
    return scan_alerts(telemetry(spark, d), KEEP).select("event_id", "host", "rule_id", "level", "mitre")


@query("alert_rule_100080", with_sql(TELEMETRY_SQL, ALERT_HITS, body="""
SELECT rule_id, host, ts, hits FROM (SELECT '100080' AS rule_id, host, ts, count(*) OVER (PARTITION BY host ORDER BY ts
  RANGE BETWEEN INTERVAL 864000 SECOND PRECEDING AND CURRENT ROW) AS hits FROM hits WHERE rule_id = '100082')
WHERE hits >= 2"""))
def _(spark, d):
    # The shipped rule (50 hits in 30 s) never fires at this density: two hits in ten days do.
    rule = [("100080", 15, "T1486", "Mass creation", "100082", 2, 864_000, "")]
    return frequency_hits(scan_alerts(telemetry(spark, d), KEEP), rules=rule).select("rule_id", "host", "ts", "hits")


@query("frequency_rule_shipped", with_sql(TELEMETRY_SQL, ALERT_HITS, body="""
SELECT host, ts, hits FROM (SELECT host, ts, count(*) OVER (PARTITION BY host ORDER BY ts
  RANGE BETWEEN INTERVAL 30 SECOND PRECEDING AND CURRENT ROW) AS hits FROM hits WHERE rule_id = '100082')"""))
def _(spark, d):
    hits = scan_alerts(telemetry(spark, d), KEEP).where(F.col("rule_id") == "100082")
    return count_within(hits, ["host"], "ts", 30).select("host", "ts", "hits")


@query("frequency_rule_fires", """
WITH shifted AS (SELECT event_id, 'host-' || (event_id // 60) % 7 AS host, TIMESTAMP '2024-01-01' + to_milliseconds(event_id * CASE WHEN (event_id // 60) % 2 = 0 THEN 600 ELSE 620 END) AS ts FROM events)
SELECT '100080' AS rule_id, host, ts, hits FROM (SELECT host, ts, count(*) OVER (PARTITION BY host ORDER BY ts RANGE BETWEEN INTERVAL 30 SECOND PRECEDING AND CURRENT ROW) AS hits FROM shifted)
WHERE hits >= 50""")
def _(spark, d):
    """The shipped frequency rule on dense rows: hosts write files every 600 ms (50 in 30 s and more) or every 620 ms (49)."""
    e = load(spark, d, "events")
    block = F.floor(F.col("event_id") / 60)
    millis = F.col("event_id") * F.when(block % 2 == 0, 600).otherwise(620)
    start = F.unix_millis(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    rows = e.select("event_id", F.concat(F.lit("host-"), block % 7).alias("host"), F.timestamp_millis(start + millis).cast("timestamp_ntz").alias("ts"),
                    *[F.lit(v).alias(n) for n, v in {"channel": "sysmon", "event_code": 11, "file_path": "D:\\a.locked"}.items()])
    rules = [r for r in shipped_alert_rules() if r.rule_id == "100082"]
    shown = rows.withColumns({c: F.lit(None).cast("string") for c in EVENT_FIELDS if c not in rows.columns})
    return frequency_hits(scan_alerts(shown, KEEP, rules)).select("rule_id", "host", "ts", "hits")


@query("technique_phases", with_sql(TELEMETRY_SQL, ALERT_HITS, body="""
SELECT mitre, row_number() OVER (PARTITION BY mitre ORDER BY ts, host, event_id, rule_id) AS seq, ts, host FROM hits"""))
def _(spark, d):
    hits = scan_alerts(telemetry(spark, d), KEEP)
    # source and category are the same for every row, so host, event and rule break ties.
    t = conform(hits, category=F.lit("alert"), source=F.lit("rules"), description=F.col("rule_id"),
                event_id=F.lpad(F.col("event_id").cast("string"), 20, "0"))
    return technique_phases(t).select("mitre", "seq", "ts", "host")


@query("technique_names", with_sql(TELEMETRY_SQL, ALERT_HITS, body="""
SELECT mitre, count(*) AS events, CASE split_part(mitre, '.', 1) WHEN 'T1003' THEN 'Credential Dumping'
  WHEN 'T1055' THEN 'Process Injection' WHEN 'T1059' THEN 'Command and Scripting Interpreter'
  WHEN 'T1053' THEN 'Scheduled Task/Job' WHEN 'T1547' THEN 'Boot/Logon Autostart Execution'
  WHEN 'T1021' THEN 'Remote Services' WHEN 'T1071' THEN 'Application Layer Protocol (C2)'
  WHEN 'T1041' THEN 'Exfiltration Over C2 Channel' WHEN 'T1486' THEN 'Data Encrypted for Impact (Ransomware)' END AS name
FROM hits GROUP BY mitre"""))
def _(spark, d):
    hits = scan_alerts(telemetry(spark, d), KEEP).groupBy("mitre").agg(F.count("*").alias("events"))
    return hits.withColumn("name", technique_name("mitre"))


@query("detection_coverage", with_sql(TELEMETRY_SQL, ALERT_HITS, body=f"""
SELECT mitre, count(*) AS rules, max(level) AS max_level, CAST(sum(coalesce(n, 0)) AS BIGINT) AS hits FROM (
  SELECT unnest({[r[0] for r in ALERT_RULES]}) AS rule_id, unnest({[r[1] for r in ALERT_RULES]}) AS level,
    unnest({[r[2] for r in ALERT_RULES]}) AS mitre) r
LEFT JOIN (SELECT rule_id, count(*) AS n FROM hits GROUP BY rule_id) USING (rule_id) GROUP BY mitre"""))
def _(spark, d):
    hits = scan_alerts(telemetry(spark, d), KEEP)
    return coverage(catalogue(spark, shipped_alert_rules()), hits)


@query("rule_catalogue_hits", with_sql(TELEMETRY_SQL, ALERT_HITS, body="""
SELECT rule_id, level, count(*) AS hits FROM hits WHERE level >= 14 GROUP BY ALL"""))
def _(spark, d):
    from tracelake.operators.alerts import rules_by

    table = rules_by(catalogue(spark, shipped_alert_rules()), level_min=14, group="mitre_attack")
    hits = scan_alerts(telemetry(spark, d), KEEP).groupBy("rule_id").agg(F.count("*").alias("hits"))
    return table.join(hits, "rule_id").select("rule_id", "level", "hits")


# ---- Sigma ----------------------------------------------------------------

SIGMA_SQL = """
SELECT event_id, '42afa7b3-0c2e-4c5b-b23e-aa6f58a7c8e1' AS rule_id FROM telemetry WHERE event_code = 7045
  AND contains(lower(service_name), 'psexesvc')
UNION ALL SELECT event_id, 'bc5cb6c7-0e1b-4d78-ace2-0e5c1a7a4b21' FROM telemetry WHERE ends_with(lower(image), '\\reg.exe')
  AND contains(lower(cmdline), '\\\\')
UNION ALL SELECT event_id, 'd7c50c2a-1f34-4e88-b9a7-3c8d4f1e9b02' FROM telemetry
WHERE ends_with(lower(parent_image), '\\wmiprvse.exe')
  AND regexp_matches(lower(image), '\\\\(cmd|powershell|cscript|wscript|mshta)\\.exe$')"""


@query("sigma_scan", with_sql(TELEMETRY_SQL, body=SIGMA_SQL))
def _(spark, d):
    return scan(telemetry(spark, d), shipped_sigma_rules(), ["event_id"]).select("event_id", "rule_id")


@query("sigma_scan_compat", with_sql(TELEMETRY_SQL, body="""
SELECT event_id, '42afa7b3-0c2e-4c5b-b23e-aa6f58a7c8e1' AS rule_id FROM telemetry
WHERE contains(lower(service_name), 'psexesvc')"""))
def _(spark, d):
    return scan(telemetry(spark, d), shipped_sigma_rules(compat=True), ["event_id"]).select("event_id", "rule_id")


USER_SIGMA = [
    {"id": "u1", "title": "tools outside the system folder", "level": "low",
     "detection": {"tool": {"Image|re": "(?i)tools"}, "thread": {"EventID": 8}, "safe": {"TargetImage|endswith": "game.exe"},
                   "condition": "tool and thread and not safe"}},
    {"id": "u2", "title": "either", "level": "medium",
     "detection": {"a": {"CommandLine|contains|all": ["certutil", "http"]}, "b": ["mshta", "scrobj"],
                   "condition": "(a or b)"}},
]


@query("sigma_user_rules", with_sql(TELEMETRY_SQL, body="""
SELECT event_id, 'u1' AS rule_id, 5 AS level FROM telemetry WHERE regexp_matches(image, '(?i)tools') AND event_code = 8
  AND NOT ends_with(lower(target_image), 'game.exe')
UNION ALL SELECT event_id, 'u2', 8 FROM telemetry WHERE (contains(lower(cmdline), 'certutil') AND contains(lower(cmdline),
  'http')) OR contains(lower(cmdline), 'mshta') OR contains(lower(cmdline), 'scrobj')"""))
def _(spark, d):
    rules = [sigma_rule(doc, Fields(event_text="cmdline")) for doc in USER_SIGMA]
    return scan(telemetry(spark, d), rules, ["event_id"]).select("event_id", "rule_id", "level")


@query("keyword_selector_documents", """
SELECT doc_id, 'k' AS rule_id FROM documents WHERE (contains(lower(text), 'license') OR contains(lower(text), 'token'))
  AND NOT contains(lower(text), 'mit license')""")
def _(spark, d):
    doc = {"id": "k", "title": "keywords", "level": "low",
           "detection": {"words": ["license", "token"], "mit": ["MIT License"], "condition": "words and not mit"}}
    return scan(load(spark, d, "documents"), [sigma_rule(doc, Fields(event_text="text"))], ["doc_id"]) \
        .select("doc_id", "rule_id")


# ---- collection policy ----------------------------------------------------

def _policy_sql():
    have = set(EVENT_FIELDS)

    def test(field, operator, value):
        column = POLICY_FIELDS[field]
        if column not in have:
            return "FALSE"
        left, right = f"lower(coalesce(CAST({column} AS VARCHAR), ''))", sql_text(value.lower())
        return {"is": f"{left} = {right}", "contains": f"contains({left}, {right})",
                "end with": f"ends_with({left}, {right})"}[operator]

    cases = []
    for kind, (codes, include, exclude) in COLLECTION_POLICY.items():
        tests = [f"event_code IN ({', '.join(map(str, codes))})"]
        if include:
            tests.append("(" + " OR ".join(test(*c) for c in include) + ")")
        if exclude:
            tests.append("NOT (" + " OR ".join(test(*c) for c in exclude) + ")")
        cases.append(f"WHEN {' AND '.join(tests)} THEN '{kind}'")
    return "CASE " + " ".join(cases) + " END"


# Three kinds in full: includes of a number and of names, includes with excludes, excludes only.
@query("collection_policy_written_out", with_sql(TELEMETRY_SQL, body="""
SELECT event_id, 'NetworkConnect' AS rule_id FROM telemetry WHERE event_code = 3 AND (dst_port IN (4444, 1337, 31337, 8888, 9001, 9030)
  OR regexp_matches(lower(image), '(powershell|cmd|mshta|wscript|cscript|regsvr32|rundll32|certutil|bitsadmin)\\.exe$'))
UNION ALL SELECT event_id, 'ProcessAccess' FROM telemetry WHERE event_code = 10
  AND regexp_matches(lower(target_image), '(lsass\\.exe|sam\\.exe|ntds\\.dit)$')
  AND coalesce(lower(source_image), '') NOT IN ('c:\\windows\\system32\\wininit.exe', 'c:\\windows\\system32\\csrss.exe')
  AND NOT contains(coalesce(lower(source_image), ''), 'msmpeng.exe')
UNION ALL SELECT event_id, 'ProcessCreate' FROM telemetry WHERE event_code = 1 AND coalesce(lower(image), '') <> 'c:\\windows\\system32\\conhost.exe'
  AND NOT ends_with(coalesce(lower(image), ''), 'svchost.exe')
  AND NOT contains(coalesce(lower(cmdline), ''), 'c:\\windows\\system32\\dllhost.exe /processid')"""))
def _(spark, d):
    t = telemetry(spark, d)
    kinds = [r for r in policy_rules(t.columns) if r.rule_id in ("NetworkConnect", "ProcessAccess", "ProcessCreate")]
    return scan(t, kinds, ["event_id"]).select("event_id", "rule_id")


@query("collection_policy", with_sql(TELEMETRY_SQL, body=f"""
SELECT * FROM (SELECT event_id, {_policy_sql()} AS collected_as FROM telemetry) WHERE collected_as IS NOT NULL"""))
def _(spark, d):
    return collected(telemetry(spark, d)).select("event_id", "collected_as")
