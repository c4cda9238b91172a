"""Queries on timelines, alerts and normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.content.lookups import HIGH_VALUE_WINDOWS_EVENTS, TRIAGE_BUNDLE_EVENT_IDS
from tracelake.operators import alerts as al
from tracelake.operators import normalize as nz
from tracelake.operators import timeline as tl
from tracelake.operators.ordered import first_per_group
from tracelake.plans.registry import query
from tracelake.plans.views import (
    ALERTS_SQL, SQL_CATEGORY, SQL_SEVERITY, TELEMETRY_SQL, TIMELINE_SQL, alerts, load, telemetry, timeline, with_sql,
)
from tracelake.sources.events import parse_event_lines, parse_log_lines


@query("timeline_union", with_sql(TIMELINE_SQL, body="SELECT * FROM timeline"))
def _(spark, d):
    return timeline(spark, d).select("ts", "category", "description", "source", "host", "event_id", "severity")


@query("timeline_summary", with_sql(TIMELINE_SQL, body="""
SELECT CASE WHEN grouping(category) = 0 THEN 'category' WHEN grouping(severity) = 0 THEN 'severity'
  WHEN grouping(host) = 0 THEN 'host' WHEN grouping(source) = 0 THEN 'source' ELSE 'total' END AS dimension,
  coalesce(category, severity, host, source) AS value, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts
FROM timeline GROUP BY GROUPING SETS ((category), (severity), (host), (source), ())"""))
def _(spark, d):
    return tl.summary(timeline(spark, d))


@query("timeline_for_host", with_sql(TIMELINE_SQL, body="""
SELECT ts, category, source, event_id FROM timeline WHERE lower(host) = 'host-7'"""))
def _(spark, d):
    return tl.for_host(timeline(spark, d), "HOST-7").select("ts", "category", "source", "event_id")


@query("timeline_by_severity", with_sql(TIMELINE_SQL, body="""
SELECT ts, host, event_id FROM timeline WHERE severity = 'critical'"""))
def _(spark, d):
    return tl.by_severity(timeline(spark, d), "critical").select("ts", "host", "event_id")


@query("timeline_ordered", with_sql(TIMELINE_SQL, body="""
SELECT ts, source, host, event_id FROM timeline ORDER BY ts, source, host, category, event_id, description"""))
def _(spark, d):
    return tl.ordered(timeline(spark, d)).select("ts", "source", "host", "event_id")


@query("timeline_export", with_sql(TIMELINE_SQL, body="""
SELECT strftime(l.ts, '%Y-%m-%dT%H:%M:%S.%f') AS "Timestamp (UTC)", severity AS "Severity", category AS "Category",
  source AS "Source", l.host AS "Host", CASE source WHEN 'Sysmon' THEN 'user-' || split_part(l.host, '-', 2) ELSE '' END
  AS "User", '' AS "Process", description AS "Description", coalesce(t.file_path, '') AS "File Path", '' AS "Network Info",
  l.event_id AS "Event ID", '' AS "MITRE", '' AS "Note"
FROM timeline l LEFT JOIN telemetry t ON l.source = 'Sysmon' AND l.event_id = CAST(t.event_id AS VARCHAR)"""))
def _(spark, d):
    return tl.export_rows(timeline(spark, d))


@query("severity_map", with_sql(ALERTS_SQL, body=f"""
SELECT alert_id, {SQL_SEVERITY.format('coalesce(rule_level, 3)')} AS timeline_severity,
  {SQL_SEVERITY.format('coalesce(rule_level, 5)').replace("'info'", "'low'")} AS case_severity,
  CASE WHEN coalesce(rule_level, 5) >= 12 THEN 4 WHEN coalesce(rule_level, 5) >= 9 THEN 3
    WHEN coalesce(rule_level, 5) >= 6 THEN 2 ELSE 1 END AS severity_number FROM alerts"""))
def _(spark, d):
    case = nz.level_severity("rule_level", 5, "low")
    return alerts(spark, d).select("alert_id", nz.level_severity("rule_level", 3).alias("timeline_severity"),
                                   case.alias("case_severity"), nz.severity_number(case).alias("severity_number"))


@query("category_map", with_sql(TELEMETRY_SQL, body=f"""
SELECT event_id, event_code, {SQL_CATEGORY} AS category FROM telemetry"""))
def _(spark, d):
    return telemetry(spark, d).select("event_id", "event_code", nz.telemetry_category("event_code").alias("category"))


@query("event_descriptions", with_sql(TELEMETRY_SQL, body="""
SELECT event_id, CASE event_code
  WHEN 1 THEN 'Process Created: ' || image || ' (PID:' || event_id || ') Parent:' || parent_image
  WHEN 3 THEN 'Network Connection: ' || image || ' -> ' || host || ':' || dst_port
  WHEN 7 THEN 'DLL Loaded:  by ' || image WHEN 11 THEN 'File Created: ' || file_path || ' by ' || image
  WHEN 13 THEN 'Registry Set: ' || registry_key || ' = ' WHEN 22 THEN 'DNS Query: ' || query_name || ' by ' || image
  ELSE 'Sysmon Event ' || event_code END AS description FROM telemetry"""))
def _(spark, d):
    c = F.col
    text = nz.telemetry_description("event_code", {
        "Image": c("image"), "ProcessId": c("event_id"), "ParentImage": c("parent_image"), "DestinationIp": c("host"),
        "DestinationPort": c("dst_port"), "TargetFilename": c("file_path"), "TargetObject": c("registry_key"),
        "QueryName": c("query_name")})
    return telemetry(spark, d).select("event_id", text.alias("description"))


@query("alert_query", with_sql(ALERTS_SQL, body="""
SELECT alert_id, agent_id, rule_level, ts FROM alerts WHERE rule_level >= 6
  AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' ORDER BY ts DESC, alert_id DESC LIMIT 500"""))
def _(spark, d):
    return al.query_alerts(alerts(spark, d), level_min=6, start="2024-01-05 00:00:00", end="2024-01-25 00:00:00",
                           limit=500) \
        .select("alert_id", "agent_id", "rule_level", "ts")


@query("alert_query_agent", with_sql(ALERTS_SQL, body="""
SELECT alert_id, rule_level, ts FROM alerts WHERE rule_level >= 5 AND agent_id = 7
ORDER BY ts DESC, alert_id DESC LIMIT 500"""))
def _(spark, d):
    return al.query_alerts(alerts(spark, d), level_min=5, agent_id=7, limit=500).select("alert_id", "rule_level", "ts")


OBSERVED = """list_filter([agent_ip, nullif(srcip, ''), nullif(dstip, ''), nullif(sha256, ''), nullif(hash, '')],
  lambda x: x IS NOT NULL)"""


@query("case_alerts", with_sql(ALERTS_SQL, body=f"""
SELECT alert_id, '[Wazuh] ' || rule_description AS title, 'wazuh' AS type, 'Wazuh' AS source,
  'WAZUH-' || alert_id AS source_ref, array_to_string([rule_description, 'wazuh'], ',') AS tags,
  array_to_string({OBSERVED}, ',') AS observables, severity AS severity_name,
  CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END AS severity,
  chr(10) || '**Wazuh Alert**' || chr(10) || chr(10) || '- **Agent**: ' || agent_name || ' (' || agent_ip || ')' || chr(10)
  || '- **Rule ID**: ' || coalesce(rule_id, 'N/A') || chr(10) || '- **Rule Description**: ' || rule_description || chr(10)
  || '- **Level**: ' || coalesce(rule_level, 5) || chr(10) || '- **Groups**: ' || rule_description || chr(10)
  || '- **Timestamp**: ' || timestamp || chr(10) || chr(10) || '**Full Alert**:' || chr(10) || '```json' || chr(10)
  || left(raw, 2000) || chr(10) || '```' || chr(10) AS description
FROM (SELECT *, CASE WHEN coalesce(rule_level, 5) >= 12 THEN 'critical' WHEN coalesce(rule_level, 5) >= 9 THEN 'high'
  WHEN coalesce(rule_level, 5) >= 6 THEN 'medium' ELSE 'low' END AS severity FROM alerts)"""))
def _(spark, d):
    rows = nz.case_alerts(alerts(spark, d), alert_width=2000)
    return rows.select("alert_id", "title", "type", "source", "source_ref", "severity_name", "severity", "description",
                       F.array_join("tags", ",").alias("tags"),
                       F.array_join(F.transform("observables", lambda o: o["data"]), ",").alias("observables"))


@query("automation_rows", with_sql(ALERTS_SQL, body=f"""
SELECT alert_id, 'full_soc_automation' AS pipeline, 'wazuh_alert,virustotal_lookup,thehive_case,email_notification' AS steps,
  rule_description || ',wazuh,automated' AS tags, rule_id, timestamp, agent_name,
  CASE WHEN contains(h, 'SHA256=') THEN regexp_extract(h, 'SHA256=([0-9a-fA-F]{{64}})', 1) ELSE h END
  AS file_hash, coalesce(nullif(srcip, ''), agent_ip, '') AS source_ip, coalesce(dstip, '') AS destination_ip,
  '[' || coalesce(rule_level, 0) || '] ' || rule_description AS title,
  {SQL_SEVERITY.format('coalesce(rule_level, 3)').replace("'info'", "'low'")} AS severity
FROM (SELECT *, coalesce(nullif(event_hashes, ''), nullif(hash, ''), nullif(sha256, ''), '') AS h FROM alerts)"""))
def _(spark, d):
    rows = nz.automation_rows(alerts(spark, d))
    return rows.select("alert_id", "pipeline", F.array_join("steps", ",").alias("steps"), "alert.rule_id", "alert.timestamp",
                       "alert.agent_name", "enrichment.*", "case_data.title", "case_data.severity",
                       F.array_join("case_data.tags", ",").alias("tags"))


@query("alert_payloads", with_sql(ALERTS_SQL, body="""
SELECT alert_id, 'wazuh' AS source, timestamp, rule_id, rule_level, rule_description, agent_name, agent_ip,
  CAST(k AS VARCHAR) AS inside FROM alerts"""))
def _(spark, d):
    rows = nz.alert_payload(alerts(spark, d))
    get = lambda n: F.get_json_object("payload", f"$.{n}").alias(n)
    return rows.select("alert_id", get("source"), get("timestamp"), F.get_json_object("payload", "$.full_alert.k").alias("inside"),
                       get("rule_id"), F.get_json_object("payload", "$.rule_level").cast("int")
                       .alias("rule_level"), get("rule_description"), get("agent_name"), get("agent_ip"))


@query("notification_rows", with_sql(ALERTS_SQL, body="""
SELECT 'send_email' AS action, 'soc@example.org' AS recipient, 'Alert ' || alert_id AS subject,
  rule_description AS body, 'normal' AS priority, ts AS timestamp FROM alerts"""))
def _(spark, d):
    return nz.notification_rows(
        alerts(spark, d), F.lit("soc@example.org"),
        F.concat(F.lit("Alert "), F.col("alert_id").cast("string")), "rule_description", as_of=F.col("ts"))


@query("case_creation_rows", with_sql(ALERTS_SQL, body=f"""
SELECT 'create_thehive_case' AS action, '[Wazuh] ' || rule_description AS title, len({OBSERVED}) AS observables FROM alerts"""))
def _(spark, d):
    rows = nz.case_creation_rows(nz.case_alerts(alerts(spark, d)))
    return rows.select("action", "title", F.size("observables").cast("bigint").alias("observables"))


@query("agent_summary", """
SELECT c_mktsegment AS os, count(*) AS total_agents, count(*) FILTER (c_acctbal > 0) AS active_agents,
  count(*) FILTER (c_acctbal <= 0) AS disconnected_agents, CAST(grouping(c_mktsegment) AS INTEGER) AS overall
FROM customer GROUP BY GROUPING SETS ((c_mktsegment), ())""")
def _(spark, d):
    c = load(spark, d, "customer")
    return al.agent_summary(c.select(
        F.col("c_mktsegment").alias("os"),
        F.when(F.col("c_acctbal") > 0, "active").otherwise("disconnected").alias("status")))


@query("agents_active", """
SELECT c_custkey AS agent_id, c_name AS name FROM customer WHERE c_acctbal > 0""")
def _(spark, d):
    c = load(spark, d, "customer").withColumn(
        "status", F.when(F.col("c_acctbal") > 0, "active").otherwise("disconnected"))
    return al.agents_by_status(c).select(F.col("c_custkey").alias("agent_id"), F.col("c_name").alias("name"))


@query("vulnerabilities_by_severity", """
SELECT p_partkey AS finding_id, p_brand AS agent_id FROM part WHERE p_size > 40""")
def _(spark, d):
    p = load(spark, d, "part").withColumn(
        "severity", F.when(F.col("p_size") > 40, "High").when(F.col("p_size") > 20, "Medium").otherwise("Low"))
    rows = p.select(F.col("p_partkey").alias("finding_id"), F.col("p_brand").alias("agent_id"), "severity")
    return al.vulnerabilities(rows).select("finding_id", "agent_id")


HIGH_VALUE_SQL = "CASE event_code " + " ".join(
    f"WHEN {k} THEN '{v}'" for k, v in HIGH_VALUE_WINDOWS_EVENTS.items()) + " END"


@query("high_value_events", with_sql(TELEMETRY_SQL, body=f"""
SELECT event_id, {HIGH_VALUE_SQL} AS label FROM telemetry WHERE {HIGH_VALUE_SQL} IS NOT NULL"""))
def _(spark, d):
    rows = telemetry(spark, d).withColumn("label", al.high_value("event_code", HIGH_VALUE_WINDOWS_EVENTS))
    return rows.where(F.col("label").isNotNull()).select("event_id", "label")


@query("bundle_events", with_sql(TELEMETRY_SQL, body=f"""
SELECT event_code, event_id, CAST(rank AS INTEGER) AS rank FROM (SELECT event_code, event_id,
  row_number() OVER (PARTITION BY event_code ORDER BY ts DESC, event_id DESC) AS rank FROM telemetry
  WHERE event_code IN ({', '.join(map(str, TRIAGE_BUNDLE_EVENT_IDS))})) WHERE rank <= 50"""))
def _(spark, d):
    rows = telemetry(spark, d).where(F.col("event_code").isin(TRIAGE_BUNDLE_EVENT_IDS)) \
        .select("event_code", "event_id", "ts")
    return first_per_group(rows, ["event_code"], [F.desc("ts"), F.desc("event_id")], 50) \
        .select("event_code", "event_id", "rank")


@query("patient_zero", """
SELECT event_type, 'host-' || arg_min(user_id, (ts, event_id)) AS first_host, min(ts) AS first_ts
FROM events WHERE value > 100 GROUP BY event_type""")
def _(spark, d):
    e = load(spark, d, "events").where(F.col("value") > 100)
    e = e.withColumn("host", F.concat(F.lit("host-"), F.col("user_id").cast("string")))
    return tl.first_affected(e, ["event_type"], "host", "ts", "event_id")


@query("dwell_time", """
SELECT user_id, min(ts) FILTER (value > 100) AS first_artifact, min(ts) FILTER (event_type = 'error') AS first_detection,
  CAST(epoch(date_trunc('second', min(ts) FILTER (event_type = 'error'))) - epoch(date_trunc('second', min(ts) FILTER
  (value > 100))) AS BIGINT) AS dwell_seconds FROM events GROUP BY user_id""")
def _(spark, d):
    return tl.dwell_time(load(spark, d, "events"), ["user_id"], "ts", F.col("value") > 100,
                         F.col("event_type") == "error")


@query("canonical_events", """
SELECT event_id, 'host-' || user_id AS host, CASE event_type WHEN 'view' THEN '' ELSE event_type || '.exe' END AS image,
  CASE event_type WHEN 'signup' THEN 'nested' ELSE '' END AS cmdline FROM events""")
def _(spark, d):
    # Each event is written as JSON in one of three layouts, and read back as raw text.
    e = load(spark, d, "events")
    host = F.concat(F.lit("host-"), F.col("user_id").cast("string"))
    image = F.concat(F.col("event_type"), F.lit(".exe"))
    kind = F.col("event_type")
    line = (
        F.when(kind == "signup", F.to_json(F.struct(
            F.struct(image.alias("Image"), F.lit("nested").alias("CommandLine")).alias("process"),
            F.struct(host.alias("name")).alias("agent"))))
        .when(kind == "purchase", F.to_json(F.struct(
            F.struct(F.lit("").alias("Image"), image.alias("exe")).alias("data"), host.alias("host"))))
        .when(kind == "view", F.to_json(F.struct(
            F.struct(F.lit("x").alias("other")).alias("data"), image.alias("Image"), host.alias("host"))))
        .otherwise(F.to_json(F.struct(image.alias("process_name"), host.alias("host")))))
    raw = parse_event_lines(e.select("event_id", line.alias("value")))
    return nz.canonical_events(raw, ids=["event_id"]).select("event_id", "host", "image", "cmdline")


@query("skipped_event_lines", """
SELECT count(*) AS lines, count(*) FILTER (event_type = 'error') AS skipped FROM events""")
def _(spark, d):
    e = load(spark, d, "events")
    line = F.when(F.col("event_type") == "error", F.lit('{"broken": ')).otherwise(F.col("props"))
    parsed = parse_event_lines(e.select(line.alias("value")))
    return parsed.agg(F.count("*").alias("lines"), F.count_if(F.col("event").isNull()).alias("skipped"))


@query("log_lines", """
SELECT event_id, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN date_trunc('second', ts)
    WHEN 'click' THEN date_trunc('second', ts) WHEN 'purchase' THEN date_trunc('second', ts) ELSE ts END AS ts,
  CASE event_type WHEN 'error' THEN 'unknown' WHEN 'signup' THEN 'app' WHEN 'purchase' THEN 'Security'
    ELSE 'host-' || user_id END AS source,
  CASE event_type WHEN 'error' THEN 'UNKNOWN' WHEN 'signup' THEN 'WARN' WHEN 'purchase' THEN 'INFORMATION'
    ELSE 'INFO' END AS level,
  CASE event_type WHEN 'error' THEN 'free text ' || event_id ELSE 'message ' || event_id END AS message,
  CASE event_type WHEN 'error' THEN 'unknown' WHEN 'signup' THEN 'json' WHEN 'purchase' THEN 'windows' ELSE 'syslog' END
    AS format,
  CASE event_type WHEN 'purchase' THEN 4624 WHEN 'signup' THEN CAST(user_id AS INT) END AS log_event_id FROM events""")
def _(spark, d):
    e = load(spark, d, "events")
    kind, uid, eid = F.col("event_type"), F.col("user_id").cast("string"), F.col("event_id").cast("string")
    ts = F.col("ts").cast("timestamp")
    stamp = lambda f: F.date_format(ts, f)
    message = F.concat(F.lit("message "), eid)
    line = (
        F.when(kind == "signup", F.to_json(F.struct(
            stamp("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.lit("app").alias("source"),
            F.lit("warn").alias("level"), F.col("user_id").alias("EventID"), message.alias("msg"))))
        .when(kind == "purchase", F.concat(stamp("yyyy-MM-dd HH:mm:ss"), F.lit(" Information Security 4624 "), message))
        .when(kind == "view", F.concat(F.lit("<34>"), stamp("MMM d HH:mm:ss"), F.lit(" host-"), uid, F.lit(" sshd: "), message))
        .when(kind == "click", F.concat(stamp("MMM dd HH:mm:ss"), F.lit(" host-"), uid, F.lit(" cron[1]: "), message))
        .otherwise(F.concat(F.lit("free text "), eid)))
    rows = parse_log_lines(e.select(F.col("event_id").alias("row_id"), line.alias("value")), year=2024, keep=["row_id"])
    return rows.select(F.col("row_id").alias("event_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), "source",
                       "level", "message", "format", F.col("event_id").alias("log_event_id"))
