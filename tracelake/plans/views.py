"""Security tables derived from the given tables.

The given tables hold no telemetry, so each role is read off a table whose rows
have the right shape: events are endpoint events, lineitem rows are packets,
orders are DNS answers and case logs, documents are files and samples,
conversations are notes and custody logs. Every row of a table takes part.

Each view exists twice: as a DataFrame, and as SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.content.messages import ALERT_SOURCE
from tracelake.session import apply_settings


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. The session setting tracelake.text.partitions, unset by default, deals the rows of text
    tables out over so many tasks: for local runs on small tables whose file is one row group, hence one task."""
    table = apply_settings(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    tasks = spark.conf.get("tracelake.text.partitions", None) if name in ("documents", "pages", "conversations", "events") else None
    return table if tasks is None else table.repartition(int(tasks))


# ---- one value list, two spellings ----------------------------------------

def pick(values: list, index: Column) -> Column:
    """values[index] as a folded literal array: no join, no shuffle."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def sql_text(value) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def pick_sql(values: list, index: str) -> str:
    return f"([{', '.join(sql_text(v) for v in values)}])[CAST({index} AS INT) + 1]"


# ---- endpoint events ------------------------------------------------------

SYS = "C:\\Windows\\System32\\"
EVENT_FIELDS = [
    "channel", "event_code", "image", "cmdline", "parent_image", "target_image", "source_image",
    "original_file_name", "file_path", "registry_key", "query_name", "dst_port", "initiated", "task_content",
    "service_name", "status",
]


def _shape(channel, code, **fields):
    row = {"channel": channel, "event_code": code, **fields}
    return [row.get(f) if f in ("event_code", "dst_port") else row.get(f, "") for f in EVENT_FIELDS]


# Event shapes: for each rule at least one row that matches and one that does not.
SHAPES = [
    _shape("sysmon", 1, image=SYS + "certutil.exe", cmdline="certutil -urlcache -f http://files.example.org/a", parent_image=SYS + "cmd.exe", original_file_name="CertUtil.exe"),
    _shape("sysmon", 1, image=SYS + "certutil.exe", cmdline="certutil -hashfile a.txt", parent_image=SYS + "cmd.exe", original_file_name="CertUtil.exe"),
    _shape("sysmon", 1, image=SYS + "mshta.exe", cmdline="mshta javascript:close()", parent_image=SYS + "wbem\\WmiPrvSE.exe"),
    _shape("sysmon", 1, image=SYS + "regsvr32.exe", cmdline="regsvr32 /s /i:https://files.example.org/b scrobj.dll", parent_image=SYS + "explorer.exe"),
    _shape("sysmon", 1, image=SYS + "regsvr32.exe", cmdline="regsvr32 local.dll", parent_image=SYS + "explorer.exe"),
    _shape("sysmon", 1, image=SYS + "WindowsPowerShell\\powershell.exe", cmdline="powershell -enc QUFBQUFBQUFBQUFBQUFBQUFBQUFBQUE=", parent_image=SYS + "wbem\\WmiPrvSE.exe"),
    _shape("sysmon", 1, image=SYS + "WindowsPowerShell\\powershell.exe", cmdline="powershell -e QUFB", parent_image=SYS + "explorer.exe"),
    _shape("sysmon", 1, image=SYS + "WindowsPowerShell\\powershell.exe", cmdline="powershell (New-Object Net.WebClient).DownloadString('x')", parent_image=SYS + "cmd.exe"),
    _shape("sysmon", 1, image=SYS + "WindowsPowerShell\\powershell.exe", cmdline="Set-MpPreference -DisableRealtimeMonitoring 1", parent_image=SYS + "cmd.exe"),
    _shape("sysmon", 1, image=SYS + "notepad.exe", cmdline="notepad notes.txt", parent_image=SYS + "explorer.exe", original_file_name="NOTEPAD.EXE"),
    _shape("sysmon", 1, image="C:\\Tools\\renamed.exe", cmdline="renamed", parent_image=SYS + "cmd.exe", original_file_name="Mimikatz.exe"),
    _shape("sysmon", 1, image=SYS + "rundll32.exe", cmdline="rundll32 C:\\Temp\\x.dll,Run", parent_image=SYS + "cmd.exe"),
    _shape("sysmon", 1, image=SYS + "svchost.exe", cmdline="svchost -k netsvcs", parent_image=SYS + "services.exe"),
    _shape("sysmon", 1, image=SYS + "reg.exe", cmdline="reg query \\\\server1\\HKLM", parent_image=SYS + "cmd.exe"),
    _shape("sysmon", 1, image=SYS + "reg.exe", cmdline="reg query HKLM", parent_image=SYS + "cmd.exe"),
    _shape("sysmon", 2, image=SYS + "explorer.exe", file_path=SYS + "drivers\\a.sys"),
    _shape("sysmon", 2, image=SYS + "explorer.exe", file_path="D:\\work\\report.docx"),
    _shape("sysmon", 3, image=SYS + "WindowsPowerShell\\powershell.exe", dst_port=443, initiated="true"),
    _shape("sysmon", 3, image="C:\\Apps\\browser.exe", dst_port=443, initiated="false"),
    _shape("sysmon", 3, image="C:\\Apps\\tool.exe", dst_port=4444, initiated="true"),
    _shape("sysmon", 3, image="C:\\Apps\\mail.exe", dst_port=25, initiated="true"),
    _shape("sysmon", 7, image="C:\\Apps\\tool.exe"),
    _shape("sysmon", 8, image="C:\\Tools\\inj.exe", source_image="C:\\Tools\\inj.exe", target_image=SYS + "svchost.exe"),
    _shape("sysmon", 8, image="C:\\Tools\\inj.exe", source_image="C:\\Tools\\inj.exe", target_image="C:\\Apps\\game.exe"),
    _shape("sysmon", 10, source_image="C:\\Tools\\dump.exe", target_image=SYS + "lsass.exe"),
    _shape("sysmon", 10, source_image=SYS + "rogue.exe", target_image=SYS + "lsass.exe"),
    _shape("sysmon", 10, source_image="C:\\Program Files\\Defender\\MsMpEng.exe", target_image=SYS + "lsass.exe"),
    _shape("sysmon", 10, source_image=SYS + "csrss.exe", target_image=SYS + "lsass.exe"),
    _shape("sysmon", 10, source_image="C:\\Tools\\dump.exe", target_image="C:\\Apps\\game.exe"),
    _shape("sysmon", 11, image="C:\\Apps\\crypt.exe", file_path="D:\\share\\plan.xlsx.locked"),
    _shape("sysmon", 11, image="C:\\Apps\\crypt.exe", file_path="D:\\share\\HOW_TO_DECRYPT.txt"),
    _shape("sysmon", 11, image="C:\\Apps\\word.exe", file_path="D:\\share\\plan.xlsx"),
    _shape("sysmon", 11, image="C:\\Apps\\word.exe", file_path="C:\\Users\\a\\AppData\\Local\\run.ps1"),
    _shape("sysmon", 13, image="C:\\Apps\\setup.exe", registry_key="HKLM\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Run\\upd"),
    _shape("sysmon", 13, image="C:\\Apps\\setup.exe", registry_key="HKLM\\SOFTWARE\\Policies\\Microsoft\\Windows Defender\\Real-Time\\DisableRealtimeMonitoring"),
    _shape("sysmon", 13, image="C:\\Apps\\setup.exe", registry_key="HKCU\\SOFTWARE\\Vendor\\Settings"),
    _shape("sysmon", 22, image="C:\\Apps\\browser.exe", query_name="update.vendor.xyz"),
    _shape("sysmon", 22, image="C:\\Apps\\browser.exe", query_name="www.example.org"),
    _shape("sysmon", 22, image=SYS + "cmd.exe", query_name="time.windows.com"),
    _shape("windows", 4698, task_content="<Exec>C:\\Users\\Public\\run.bat</Exec>"),
    _shape("windows", 4698, task_content="<Exec>C:\\Apps\\backup.exe</Exec>"),
    _shape("windows", 7045, service_name="PSEXESVC"),
    _shape("windows", 7045, service_name="Spooler"),
    _shape("windows", 4776, status="0xC000006A"),
    _shape("windows", 4776, status="0x0"),
    _shape("windows", 1102),
    _shape("windows", 4624),
]
KINDS = ["signup", "purchase", "view", "click", "error"]


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoint events: events rows, shaped by their type and property."""
    e = load(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.array_position(F.array(*[F.lit(x) for x in KINDS]), F.col("event_type")) - 1
    base = e.select(
        "event_id", "ts", "user_id", "event_type", "value", k.alias("k"),
        F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("host"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("user_name"),
        F.pmod(k + kind * 7, F.lit(len(SHAPES))).cast("int").alias("shape"))
    return base.withColumns({
        name: pick([s[i] for s in SHAPES], F.col("shape")) for i, name in enumerate(EVENT_FIELDS)})


_KIND_SQL = "list_position([" + ", ".join(f"'{x}'" for x in KINDS) + "], event_type) - 1"
_FIELDS_SQL = ",\n  ".join(
    f"{pick_sql([s[i] for s in SHAPES], 'shape')} AS {name}" for i, name in enumerate(EVENT_FIELDS))
TELEMETRY_SQL = f"""
telemetry AS (
SELECT *,
  {_FIELDS_SQL}
FROM (SELECT event_id, ts, user_id, event_type, value,
        CAST(props ->> '$.k' AS INT) AS k,
        'host-' || user_id AS host, 'user-' || user_id AS user_name,
        CAST((CAST(props ->> '$.k' AS INT) + ({_KIND_SQL}) * 7) % {len(SHAPES)} AS INT) AS shape
      FROM events))"""


# ---- packets and DNS ------------------------------------------------------

PORTS = [80, 443, 4444, 8080, 53, 1337, 22]


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets: lineitem rows. Supplier is the source, part the destination, price the size."""
    li = load(spark, sf_dir, "lineitem")
    s, p, n = F.col("l_suppkey"), F.col("l_partkey"), F.col("l_linenumber")
    text = lambda c: c.cast("string")
    site = F.pmod(p, F.lit(16))
    return li.select(
        F.col("l_shipdate").alias("ts"),
        F.concat(F.lit("10.0."), text(F.pmod(F.floor(s / 256), F.lit(256))), F.lit("."),
                 text(F.pmod(s, F.lit(256)))).alias("src_ip"),
        F.concat(F.when(site < 4, "192.168.1.").otherwise("198.51.100."), text(site)).alias("dst_ip"),
        (F.pmod(F.col("l_orderkey"), F.lit(60000)) + 1024).cast("int").alias("src_port"),
        pick(PORTS, n - 1).alias("dst_port"),
        F.when(n == 5, "UDP").when(n == 7, "OTHER").otherwise("TCP").alias("protocol"),
        F.floor("l_extendedprice").cast("bigint").alias("length"))


PACKETS_SQL = f"""
packets AS (
SELECT l_shipdate AS ts,
  '10.0.' || ((l_suppkey // 256) % 256) || '.' || (l_suppkey % 256) AS src_ip,
  CASE WHEN l_partkey % 16 < 4 THEN '192.168.1.' ELSE '198.51.100.' END || (l_partkey % 16) AS dst_ip,
  CAST(l_orderkey % 60000 + 1024 AS INT) AS src_port,
  {pick_sql(PORTS, 'l_linenumber - 1')} AS dst_port,
  CASE l_linenumber WHEN 5 THEN 'UDP' WHEN 7 THEN 'OTHER' ELSE 'TCP' END AS protocol,
  CAST(floor(l_extendedprice) AS BIGINT) AS length
FROM lineitem),
flows AS (
SELECT src_ip, dst_ip, dst_port, protocol, count(*) AS packet_count, CAST(sum(length) AS BIGINT) AS bytes_total,
  min(ts) AS first_seen, max(ts) AS last_seen
FROM packets GROUP BY ALL)"""


def dns_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    text = lambda c: c.cast("string")
    return o.select(
        F.col("o_orderdate").alias("ts"),
        F.concat(F.lit("h"), text(F.pmod("o_custkey", F.lit(50))), F.lit(".example.net")).alias("query_name"),
        F.array(F.concat(F.lit("198.51.100."), text(F.pmod("o_orderkey", F.lit(16))))).alias("response_ips"),
        F.concat(F.lit("10.0.0."), text(F.pmod("o_custkey", F.lit(256)))).alias("src_ip"))


DNS_SQL = """
dns AS (
SELECT o_orderdate AS ts, 'h' || (o_custkey % 50) || '.example.net' AS query_name,
  '198.51.100.' || (o_orderkey % 16) AS dst_ip, '10.0.0.' || (o_custkey % 256) AS src_ip
FROM orders)"""

LIMIT_BYTES = 600_000


# ---- files and samples ----------------------------------------------------

HEADS = ["", "4D5A9000", "7F454C46", "504B0304", "25504446", "D0CF11E0A1B11AE1", "89504E47", "FFD8FFE0", "1F8B0800",
         "377ABCAF", "52617221", "2321", "3C3F786D6C"]
TAILS = ["", " UPX! packed", " connect http://files.example.org/a now", " 198.51.100.7 ", " CreateRemoteThread",
         " powershell -enc x", " base64,AAAA", " AutoOpen WScript.Shell http://files.example.org",
         " Your files have been encrypted", " bitcoin wallet at abc.onion", " lsadump::sam", " keylog",
         " __EventFilter __EventConsumer", " VirtualAllocEx WriteProcessMemory", " beacon.dll", " plain", " NSP0"]
FOLDERS = ["/tmp", "/home/a/Downloads", "/usr/bin", "/opt/data", "/var/log"]
SUFFIXES = [".txt", ".exe", ".pdf.exe", ".ps1", "", ".dll", ".docx", ".js", ".tar.gz"]
MODES = [420, 493, 2541, 1517]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files: documents with leading bytes, a tail, a path and times."""
    d = load(spark, sf_dir, "documents")
    n = F.col("n_chars")
    at = lambda values: pick(values, F.pmod(n, F.lit(len(values))))
    content = F.concat(F.unhex(at(HEADS)), F.encode("text", "UTF-8"), F.encode(at(TAILS), "UTF-8"))
    long = F.when(F.pmod(n, F.lit(11)) == 0, F.repeat(F.lit("x"), F.lit(110))).otherwise("")
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), long, at(SUFFIXES))
    hours = lambda c: F.make_dt_interval(F.lit(0), c.cast("int"))
    base = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return d.select(
        "doc_id", "source", "lang", F.concat(at(FOLDERS), F.lit("/"), name).alias("path"), name.alias("name"),
        content.alias("content"), F.octet_length(content).cast("bigint").alias("size"),
        (base - hours(F.pmod(n, F.lit(96)))).alias("mtime"), (base - hours(F.pmod(n, F.lit(48)))).alias("atime"),
        (base - hours(F.pmod(n, F.lit(200)))).alias("ctime"), at(MODES).alias("mode"),
        F.concat(F.col("text"), at(TAILS)).alias("body"))


def _at(values: list) -> str:
    return pick_sql(values, f"n_chars % {len(values)}")


FILES_SQL = f"""
files0 AS (
SELECT doc_id, source, lang, n_chars,
  'f' || doc_id || CASE WHEN n_chars % 11 = 0 THEN repeat('x', 110) ELSE '' END || {_at(SUFFIXES)} AS name,
  {_at(FOLDERS)} AS folder,
  {_at(SUFFIXES)} AS suffix,
  from_hex({_at(HEADS)}) || encode(text) || encode({_at(TAILS)}) AS content,
  upper({_at(HEADS)}) AS head, text || {_at(TAILS)} AS body,
  TIMESTAMP '2024-01-31' - to_hours(CAST(n_chars % 96 AS INT)) AS mtime,
  TIMESTAMP '2024-01-31' - to_hours(CAST(n_chars % 48 AS INT)) AS atime,
  TIMESTAMP '2024-01-31' - to_hours(CAST(n_chars % 200 AS INT)) AS ctime,
  {_at(MODES)} AS mode
FROM documents),
files AS (SELECT *, folder || '/' || name AS path, CAST(octet_length(content) AS BIGINT) AS size FROM files0)"""


# ---- alerts ---------------------------------------------------------------

def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts: events rows; the value gives the level."""
    e = load(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    sha = F.sha2(F.col("props"), 256)
    net = F.concat(F.lit("203.0.113."), k.cast("string"))
    return e.select(
        F.col("event_id").alias("alert_id"), "ts", F.col("ts").cast("string").alias("timestamp"),
        k.cast("string").alias("rule_id"),
        F.when(F.col("value") < 200, F.pmod(F.floor("value"), F.lit(16)).cast("int")).alias("rule_level"),
        F.col("event_type").alias("rule_description"), F.array("event_type").alias("rule_groups"),
        F.col("user_id").alias("agent_id"), F.concat(F.lit("host-"), F.col("user_id").cast("string")).alias("agent_name"),
        F.concat(F.lit("10.1.0."), F.pmod("user_id", F.lit(256)).cast("string")).alias("agent_ip"),
        F.when(F.pmod(k, F.lit(3)) == 0, net).when(F.pmod(k, F.lit(3)) == 1, "").alias("srcip"),
        F.when(F.pmod(k, F.lit(5)) == 0, net).alias("dstip"),
        F.when(F.pmod(k, F.lit(4)) == 0, F.concat(F.lit("MD5=0,SHA256="), sha, F.lit(",IMPHASH=0")))
        .when(F.pmod(k, F.lit(4)) == 1, F.md5("props")).when(F.pmod(k, F.lit(4)) == 2, "").alias("event_hashes"),
        F.when(F.pmod(k, F.lit(2)) == 0, F.md5("props")).alias("hash"),
        F.when(F.pmod(k, F.lit(7)) == 0, sha).alias("sha256"), F.col("props").alias("raw"))


ALERTS_SQL = """
alerts0 AS (SELECT *, CAST(props ->> '$.k' AS INT) AS k FROM events),
alerts AS (
SELECT event_id AS alert_id, ts, k, CAST(k AS VARCHAR) AS rule_id,
  CASE WHEN value < 200 THEN CAST(floor(value) AS INT) % 16 END AS rule_level,
  event_type AS rule_description, user_id AS agent_id, 'host-' || user_id AS agent_name,
  '10.1.0.' || (user_id % 256) AS agent_ip,
  CASE k % 3 WHEN 0 THEN '203.0.113.' || k WHEN 1 THEN '' END AS srcip,
  CASE k % 5 WHEN 0 THEN '203.0.113.' || k END AS dstip,
  CASE k % 4 WHEN 0 THEN 'MD5=0,SHA256=' || sha256(props) || ',IMPHASH=0' WHEN 1 THEN md5(props) WHEN 2 THEN '' END
    AS event_hashes,
  CASE k % 2 WHEN 0 THEN md5(props) END AS hash, CASE k % 7 WHEN 0 THEN sha256(props) END AS sha256, props AS raw,
  strftime(ts, '%Y-%m-%d %H:%M:%S') || rtrim(rtrim(strftime(ts, '.%f'), '0'), '.') AS timestamp
FROM alerts0)"""


# ---- timelines ------------------------------------------------------------

SQL_CATEGORY = "CASE event_code " + " ".join(
    f"WHEN {c} THEN '{n}'" for c, n in {
        1: "process", 2: "file", 3: "network", 7: "service", 8: "process", 10: "process", 11: "file",
        13: "registry", 22: "network"}.items()) + " ELSE 'other' END"

SQL_SEVERITY = ("CASE WHEN {0} >= 12 THEN 'critical' WHEN {0} >= 9 THEN 'high' WHEN {0} >= 6 THEN 'medium' "
                "WHEN {0} >= 3 THEN 'low' ELSE 'info' END")

TIMELINE_SQL = TELEMETRY_SQL + "," + ALERTS_SQL + f""",
timeline AS (
SELECT ts, {SQL_CATEGORY} AS category, 'event ' || event_code AS description, 'Sysmon' AS source, host,
  CAST(event_id AS VARCHAR) AS event_id, 'info' AS severity
FROM telemetry
UNION ALL
SELECT ts, 'alert', rule_description, 'Wazuh', agent_name, CAST(alert_id AS VARCHAR),
  {SQL_SEVERITY.format('coalesce(rule_level, 3)')}
FROM alerts
UNION ALL
SELECT o_orderdate, 'analyst_note', 'order ' || o_orderstatus, 'Analyst: c' || o_custkey, 'N/A',
  CAST(o_orderkey AS VARCHAR), 'info'
FROM orders)"""


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry, alerts and notes as one timeline."""
    from tracelake.operators.normalize import level_severity, telemetry_category
    from tracelake.operators.timeline import conform, union_timelines

    t = conform(telemetry(spark, sf_dir), category=telemetry_category("event_code"),
                description=F.concat(F.lit("event "), F.col("event_code").cast("string")), source=F.lit("Sysmon"),
                severity=F.lit("info"))
    a = conform(alerts(spark, sf_dir), category=F.lit("alert"), description=F.col("rule_description"),
                source=F.lit(ALERT_SOURCE), host=F.col("agent_name"), event_id=F.col("alert_id"),
                severity=level_severity("rule_level", default=3))
    o = load(spark, sf_dir, "orders")
    n = conform(o, ts=F.col("o_orderdate"), category=F.lit("analyst_note"),
                description=F.concat(F.lit("order "), F.col("o_orderstatus")),
                source=F.concat(F.lit("Analyst: c"), F.col("o_custkey").cast("string")), host=F.lit("N/A"),
                event_id=F.col("o_orderkey"), severity=F.lit("info"))
    return union_timelines(t, a, n)


def with_sql(*views: str, body: str) -> str:
    return "WITH " + ",".join(v.strip() for v in views) + "\n" + body.strip()
