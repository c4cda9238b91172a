"""Readers of event, alert, telemetry and log files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.content import messages
from tracelake.content.lookups import WINDOWS_AUTH_IDS, WINDOWS_PROCESS_IDS
from tracelake.functions.binding import let
from tracelake.functions.text import cut, filled
from tracelake.functions.times import log_time, timeline_time
from tracelake.operators.normalize import level_severity, telemetry_category, telemetry_description
from tracelake.operators.timeline import conform

CORRUPT = "_corrupt"


# ---- SRC-01, SRC-02: raw events -------------------------------------------

def parse_event_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """NDJSON lines as VARIANT events; a line that is no JSON has a NULL event."""
    return lines.withColumn("event", F.try_parse_json(F.col(column)))


def read_events(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Raw events: (event VARIANT). NDJSON by default; array for files that hold one JSON array.

    Lines that are no JSON are skipped; skipped_lines() reports how many.
    """
    lines = spark.read.text(path, wholetext=array)
    if array:
        whole = lines.withColumn("whole", F.try_parse_json("value"))
        items = F.variant_get("whole", "$", "array<variant>")
        return whole.where(F.col("whole").isNotNull()).select(F.explode(items).alias("event"))
    return parse_event_lines(lines).where(F.col("event").isNotNull()).select("event")


def skipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines read and lines skipped, in one row."""
    parsed = parse_event_lines(spark.read.text(path))
    filled_line = F.trim("value") != ""
    return parsed.agg(F.count("*").alias("lines"),
                      F.count_if(F.col("event").isNull() & filled_line).alias("skipped"))


def events_from_rows(spark: SparkSession, rows: list[str]) -> DataFrame:
    """Events given as JSON texts."""
    return parse_event_lines(spark.createDataFrame([(r,) for r in rows], "value string")) \
        .where(F.col("event").isNotNull()).select("event")


# ---- SRC-03: alerts -------------------------------------------------------

ALERT_SCHEMA = (
    "id string, timestamp string, `@timestamp` string, "
    "rule struct<id:string,level:int,description:string,groups:array<string>,mitre:struct<id:array<string>>>, "
    "agent struct<id:string,name:string,ip:string>, syscheck struct<path:string>, "
    "data struct<srcip:string,dstip:string,src_ip:string,dst_ip:string,sha256:string,hash:string,"
    "file_hash:string,win:struct<system:map<string,string>,eventdata:map<string,string>>>"
)


def parse_alert_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Alert NDJSON lines (batch or stream) with the declared schema, and raw, the whole line; lines that are no JSON are skipped."""
    parsed = F.from_json(column, f"{ALERT_SCHEMA}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT})
    rows = lines.where(F.trim(column) != "").select(parsed.alias("a"), F.col(column).alias("raw")).select("a.*", "raw")
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return parse_alert_lines(spark.read.text(path))


def flat_alerts(alerts: DataFrame) -> DataFrame:
    """Flat alert columns, as the outgoing rows and the alert query need them."""
    return alerts.select(
        F.col("id").alias("alert_id"), F.coalesce(filled("timestamp"), filled("`@timestamp`")).alias("timestamp"),
        timeline_time(F.coalesce(filled("timestamp"), filled("`@timestamp`"))).alias("ts"),
        F.col("rule.id").alias("rule_id"), F.col("rule.level").alias("rule_level"),
        F.col("rule.description").alias("rule_description"), F.col("rule.groups").alias("rule_groups"),
        F.col("agent.id").alias("agent_id"), F.col("agent.name").alias("agent_name"),
        F.col("agent.ip").alias("agent_ip"), F.col("syscheck.path").alias("file_path"),
        F.col("data.srcip").alias("srcip"), F.col("data.dstip").alias("dstip"),
        F.col("data.src_ip").alias("src_ip"), F.col("data.dst_ip").alias("dst_ip"),
        F.col("data.sha256").alias("sha256"), F.col("data.hash").alias("hash"),
        F.col("data.file_hash").alias("file_hash"), "raw",
        F.try_element_at("data.win.eventdata", F.lit("hashes")).alias("event_hashes"))


def alert_timeline(alerts: DataFrame, technique: Column | None = None) -> DataFrame:
    """Alerts as timeline rows. Rows without a readable time are left out."""
    ts = timeline_time(F.coalesce(filled("timestamp"), filled("`@timestamp`")))
    rows = alerts.withColumn("ts", ts).where(F.col("ts").isNotNull())
    return conform(
        rows, category=F.lit("alert"), description=F.coalesce("rule.description", F.lit(messages.ALERT_DESCRIPTION_DEFAULT)),
        source=F.lit(messages.ALERT_SOURCE), host=F.coalesce("agent.name", F.lit("unknown")), event_id=F.col("rule.id"),
        rule_name=F.col("rule.description"), severity=level_severity("rule.level", default=3),
        file_path=F.col("syscheck.path"), mitre=technique if technique is not None else F.get("rule.mitre.id", 0),
        raw=F.col("raw"))


# ---- SRC-04: endpoint telemetry -------------------------------------------

TELEMETRY_FIELDS = [
    "UtcTime", "TimeCreated", "EventID", "Computer", "User", "Image", "ProcessName", "ProcessId", "ParentImage",
    "TargetFilename", "ImageLoaded", "DestinationIp", "DestinationPort", "TargetObject", "Details", "QueryName",
]


def read_telemetry_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def telemetry_timeline(rows: DataFrame) -> DataFrame:
    """Endpoint telemetry as timeline rows; an address without a port gives NULL."""
    have = set(rows.columns)
    get = lambda n: filled(n) if n in have else F.lit(None).cast("string")
    code = F.coalesce(get("EventID").try_cast("int"), F.lit(0))
    ts = timeline_time(F.coalesce(get("UtcTime"), get("TimeCreated")))
    out = rows.withColumn("ts", ts).where(F.col("ts").isNotNull())
    pid = get("ProcessId").try_cast("int")
    network = F.when(get("DestinationPort").isNotNull(),
                     F.concat(get("DestinationIp"), F.lit(":"), get("DestinationPort")))
    return conform(
        out, category=telemetry_category(code),
        description=telemetry_description(code, {n: get(n) for n in TELEMETRY_FIELDS}),
        source=F.lit("Sysmon"), host=F.coalesce(get("Computer"), F.lit("unknown")), user_name=get("User"),
        process=F.coalesce(get("Image"), get("ProcessName")), pid=F.nullif(pid, F.lit(0)),
        file_path=F.coalesce(get("TargetFilename"), get("ImageLoaded")), network_info=network,
        registry_key=get("TargetObject"), event_id=code,
        raw=F.to_json(F.struct(*[F.col(c) for c in rows.columns])))


# ---- SRC-05, SRC-06: Windows events ---------------------------------------

def windows_timeline(events: DataFrame, data_width: int | None = None) -> DataFrame:
    """Windows event JSON (VARIANT events) as timeline rows. TimeCreated may be an object or a text."""
    text = lambda p: F.try_variant_get("event", p, "string")
    ts = timeline_time(F.coalesce(text("$.System.TimeCreated.SystemTime"), text("$.System.TimeCreated")))
    rows = events.withColumn("ts", ts).where(F.col("ts").isNotNull())
    code = F.coalesce(text("$.System.EventID").try_cast("int"), F.lit(0))
    data = F.coalesce(F.to_json(F.try_variant_get("event", "$.EventData", "variant")), F.lit("{}"))
    category = F.when(code.isin(WINDOWS_AUTH_IDS), "auth").when(code.isin(WINDOWS_PROCESS_IDS), "process") \
                .otherwise("service")
    return conform(
        rows, category=category,
        description=F.concat(F.lit("EventID "), code.cast("string"), F.lit(": "), cut(data, data_width)),
        source=F.lit("Windows Event Log"), host=F.coalesce(text("$.System.Computer"), F.lit("unknown")),
        event_id=code, raw=F.to_json("event"))


WINDOWS_XML = (
    "System struct<EventID:string,Level:string,Computer:string,TimeCreated:struct<_SystemTime:string>>, "
    "EventData struct<Data:array<struct<_Name:string,_VALUE:string>>>")


def read_windows_xml(spark: SparkSession, path: str) -> DataFrame:
    """Windows event XML export as log rows; a file that is no XML gives no rows."""
    rows = spark.read.format("xml").option("rowTag", "Event").option("ignoreNamespace", True) \
        .option("mode", "DROPMALFORMED").schema(WINDOWS_XML).load(path)
    return rows.select(
        log_time("System.TimeCreated._SystemTime").alias("ts"), F.lit("Windows Event Log").alias("source"),
        F.col("System.EventID").try_cast("int").alias("event_id"),
        F.coalesce("System.Level", F.lit("INFO")).alias("level"),
        F.coalesce(F.to_json("EventData"), F.lit("")).alias("message"))


# ---- SRC-07, SRC-08: notes ------------------------------------------------

def note_timeline(notes: DataFrame) -> DataFrame:
    """Analyst notes (ts_text, note, analyst, host) as timeline rows."""
    rows = notes.withColumn("ts", timeline_time("ts_text"))
    return conform(
        rows, category=F.lit("analyst_note"), description=F.col("note"),
        source=F.concat(F.lit("Analyst: "), F.col("analyst")), host=F.coalesce("host", F.lit("N/A")),
        severity=F.lit("info"), analyst_note=F.col("note"))


# ---- SRC-09: log lines ----------------------------------------------------

# Line shapes.
WINDOWS_LINE = (r"^(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})\s+(\w+)\s+([^\s]+)\s+(\d+)\s+(.*)")
SYSLOG_LINE = r"^(<\d+>)?(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^:]+):\s*(.*)$"


def parse_log_lines(lines: DataFrame, column: str = "value", year: int | None = None,
                    keep: list[str] | None = None) -> DataFrame:
    """Log lines of mixed formats: JSON, Windows text, syslog, else unknown. Blank lines are dropped."""
    line = F.trim(F.col(column))
    rows = lines.select(*(keep or []), line.alias("raw")).where(F.col("raw") != "")
    raw = F.col("raw")
    rows = rows.withColumn("_json", F.when(raw.startswith("{"), F.try_parse_json(raw)))
    js = lambda *names: filled(*[F.try_variant_get("_json", f"$.{n}", "string") for n in names])
    is_json, is_win, is_sys = F.col("_json").isNotNull(), raw.rlike(WINDOWS_LINE), raw.rlike(SYSLOG_LINE)
    win = lambda i: F.regexp_extract(raw, WINDOWS_LINE, i)
    sysl = lambda i: F.regexp_extract(raw, SYSLOG_LINE, i)
    pick = lambda j, w, s, other: F.when(is_json, j).when(is_win, w).when(is_sys, s).otherwise(other)
    json_time = F.try_variant_get("_json", "$['@timestamp']", "string")
    null = F.lit(None).cast("string")
    return rows.select(
        *(keep or []),
        log_time(pick(F.coalesce(js("timestamp"), F.nullif(json_time, F.lit("")), js("time")),
                      F.regexp_replace(win(1), r"\s+", " "), sysl(2), null), year).alias("ts"),
        pick(F.coalesce(F.try_variant_get("_json", "$.source", "string"),
                        F.try_variant_get("_json", "$.host", "string"), F.lit("unknown")),
             win(3), sysl(3), F.lit("unknown")).alias("source"),
        pick(js("event_id", "EventID"), win(4), null, null).try_cast("int").alias("event_id"),
        F.upper(pick(F.coalesce(F.try_variant_get("_json", "$.level", "string"),
                                F.try_variant_get("_json", "$.severity", "string"), F.lit("info")),
                     win(2), F.lit("INFO"), F.lit("UNKNOWN"))).alias("level"),
        pick(F.coalesce(F.try_variant_get("_json", "$.message", "string"),
                        F.try_variant_get("_json", "$.msg", "string"), raw),
             win(5), sysl(5), raw).alias("message"),
        pick(F.lit("json"), F.lit("windows"), F.lit("syslog"), F.lit("unknown")).alias("format"),
        F.when(~is_json & ~is_win & is_sys, sysl(4)).alias("process"), "raw")


def read_logs(spark: SparkSession, path: str, year: int | None = None) -> DataFrame:
    return parse_log_lines(spark.read.text(path), year=year)


# ---- SRC-20: block-structured event text ----------------------------------

def read_event_blocks(spark: SparkSession, path: str, marker: str = "Event[") -> DataFrame:
    """Records that start at the marker, as a map of 'key: value' lines (cut at the first colon)."""
    blocks = spark.read.option("lineSep", marker).text(path)
    lines, is_pair = F.split("value", r"\r?\n"), lambda s: F.contains(s, F.lit(":")) & ~s.rlike(r"^\d+\]")
    pairs = F.transform(
        F.filter(lines, is_pair),
        lambda s: F.struct(F.trim(F.split_part(s, F.lit(":"), F.lit(1))).alias("key"),
                           F.trim(F.regexp_replace(s, r"^[^:]*:", "")).alias("value")))
    # The last value of a repeated key wins. The pairs are bound: the lambda would make all of them again for each.
    unique = let(pairs, lambda made: F.filter(made, lambda p, i: ~F.exists(
        F.slice(made, i + 2, F.size(made)), lambda q: q["key"] == p["key"])))
    return blocks.where(F.exists(lines, is_pair)).select(F.map_from_entries(unique).alias("fields"))
