"""Readers of packets, files, memory output, evidence, host bundles, reports and cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.functions.text import cut
from pyspark.sql import types as T

# ---- documents: a file each, or many to a file ------------------------------

def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """Documents (name, text) that sinks.writers.packed_files wrote."""
    return spark.read.schema("name string, text string").parquet(path)


def json_documents(spark: SparkSession, path: str, schema: str, packed: bool = False) -> DataFrame:
    """Rows of JSON documents (an object or an array each) with _file, the path of their document.

    One that is no JSON gives a row of NULLs, an empty one none, in either form.
    """
    if not packed:
        return spark.read.option("multiLine", True).schema(schema).json(path).withColumn("_file", F.col("_metadata.file_path"))
    nothing = F.array(F.lit(None).cast(f"struct<{schema}>"))
    items = F.coalesce(F.from_json("text", f"array<struct<{schema}>>"), nothing)
    rows = read_packed(spark, path).where(F.trim("text") != "")
    return rows.select(F.explode(items).alias("item"), F.col("name").alias("_file")).select("item.*", "_file")


def _stem(file: str) -> Column:
    """The file name without its suffix."""
    return F.regexp_replace(F.regexp_extract(file, "[^/]*$", 0), r"\.[^.]*$", "")


# ---- SRC-14: decoded packets ----------------------------------------------

PACKET_LAYERS = [
    "ip.src", "ip.dst", "tcp.srcport", "tcp.dstport", "udp.srcport", "udp.dstport", "frame.time_epoch", "frame.len",
]
PACKET_SCHEMA = T.StructType([T.StructField("_source", T.StructType([T.StructField("layers", T.StructType(
    [T.StructField(n, T.ArrayType(T.StringType())) for n in PACKET_LAYERS]))]))])


def packet_rows(decoded: DataFrame) -> DataFrame:
    """Decoded packet JSON as packet rows. Neither TCP nor UDP is OTHER."""
    get = lambda n: F.get(F.col(f"_source.layers.`{n}`"), 0)
    has = lambda n: F.col(f"_source.layers.`{n}`").isNotNull()
    port = lambda side: F.coalesce(
        F.coalesce(get(f"tcp.{side}port"), get(f"udp.{side}port")).try_cast("int"), F.lit(0))
    epoch = get("frame.time_epoch").try_cast("decimal(20,6)")
    return decoded.select(
        F.timestamp_micros((epoch * 1_000_000).cast("bigint")).alias("ts"),
        F.coalesce(get("ip.src"), F.lit("")).alias("src_ip"), F.coalesce(get("ip.dst"), F.lit("")).alias("dst_ip"),
        port("src").alias("src_port"), port("dst").alias("dst_port"),
        F.when(has("tcp.srcport"), "TCP").when(has("udp.srcport"), "UDP").otherwise("OTHER").alias("protocol"),
        F.coalesce(get("frame.len").try_cast("bigint"), F.lit(0)).alias("length"))


def read_packets(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return packet_rows(spark.read.schema(PACKET_SCHEMA).option("multiLine", multi_line).json(path))


# ---- SRC-15: files --------------------------------------------------------

def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Files below a folder: path, size, mtime, content. Other times come from an inventory table."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.load(path)
    return rows.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("size"),
                       F.col("modificationTime").alias("mtime"), "content")


# ---- SRC-16: memory plugin text -------------------------------------------

def read_plugin_lines(spark: SparkSession, path: str) -> DataFrame:
    """Plugin output as (image_id, line_no, line); the image is the file name without its suffix.

    Files are read in splits. line_no is the start of the split plus the row's place
    in its task: it rises in the order of the file, with gaps, since no split
    holds more lines than bytes.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = spark.read.text(path).select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("image_id"),
        (F.col("_metadata.file_block_start") + place).alias("line_no"), F.col("value").alias("line"))
    return rows


# ---- SRC-17: evidence registry --------------------------------------------

EVIDENCE_ITEM = (
    "struct<evidence_id:string,case_id:string,description:string,source_path:string,"
    "acquisition_timestamp:string,acquired_by:string,md5:string,sha1:string,sha256:string,"
    "file_size_bytes:bigint,evidence_type:string,"
    "custody_log:array<struct<timestamp:string,action:string,actor:string,location:string,notes:string>>,"
    "tags:array<string>,notes:string>")


def read_evidence(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    raw = json_documents(spark, path, f"case_id string, analyst string, generated string, evidence_items array<{EVIDENCE_ITEM}>", packed)
    return raw.select(F.explode("evidence_items").alias("e")).select("e.*")


# ---- SRC-18, 19, 21, 22: host bundles -------------------------------------

def read_host_json(spark: SparkSession, path: str, schema: str, host_level: bool = True, packed: bool = False) -> DataFrame:
    """Collector JSON (an array per file); host is the folder of the file."""
    rows = json_documents(spark, path, schema, packed)
    if host_level:
        rows = rows.withColumn("host", F.regexp_extract("_file", r"([^/]+)/[^/]+$", 1))
    return rows.drop("_file")


def _packed_csv(documents: DataFrame, drop_malformed: bool) -> DataFrame:
    """Rows of CSV documents (name, text) with _file. As with files, the first document names the columns and each one's first line is its header."""
    spark = documents.sparkSession
    lines = F.filter(F.split("text", "\r\n|\r|\n"), lambda x: F.trim(x) != "")
    first = documents.select(F.get(lines, 0).alias("line")).where(F.col("line").isNotNull()).first()
    header = spark.read.option("header", True).option("escape", '"').csv(spark.sparkContext.parallelize([first["line"]] if first else [], 1)).columns
    schema = ", ".join(f"`{h.replace('`', '``')}` string" for h in [*header, *(["_corrupt"] if drop_malformed else [])])
    options = {"escape": '"', "columnNameOfCorruptRecord": "_corrupt"}
    rows = documents.select(F.explode(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("line"), F.col("name").alias("_file"))
    rows = rows.select(F.from_csv("line", schema, options).alias("row"), "_file").select("row.*", "_file")
    return rows.where(F.col("_corrupt").isNull()).drop("_corrupt") if drop_malformed else rows


def read_host_csv(spark: SparkSession, path: str, drop_malformed: bool = False, packed: str | None = None) -> DataFrame:
    """Collector CSV with host and case_id taken from the folders .../case/host/file.

    packed: path holds packed documents, of which those with this file name below case/host are read.
    """
    if packed is not None:
        rows = _packed_csv(read_packed(spark, path).where(F.regexp_like("name", F.lit("^[^/]+/[^/]+/[^/]+$")) & F.endswith("name", F.lit(f"/{packed}"))), drop_malformed)
    else:
        rows = spark.read.option("header", True).option("escape", '"') \
            .option("mode", "DROPMALFORMED" if drop_malformed else "PERMISSIVE").csv(path).withColumn("_file", F.col("_metadata.file_path"))
    file = F.col("_file")
    return rows.withColumns({
        "host": F.regexp_extract(file, r"([^/]+)/[^/]+$", 1),
        "case_id": F.regexp_extract(file, r"([^/]+)/[^/]+/[^/]+$", 1)}).drop("_file")


def read_tasks_csv(spark: SparkSession, path: str) -> DataFrame:
    """Task list with a quoted header; rows with another number of fields are dropped."""
    lines = spark.read.text(path)
    header = spark.read.option("header", True).csv(path).columns  # names only: reads the first line
    cells = F.transform(F.split("value", '","'), lambda v: F.regexp_replace(v, '^"+|"+$', ""))
    rows = lines.select(cells.alias("c")).where((F.size("c") == len(header)))
    title = F.array(*[F.lit(h) for h in header])
    return rows.where(F.col("c") != title).select(
        *[F.get("c", i).alias(h) for i, h in enumerate(header)])


BUNDLE = {
    "processes": "01_processes.csv", "connections": "02_network_connections.csv", "dns_cache": "02_dns_cache.csv",
    "logons": "03_recent_logons.csv", "tasks": "04_scheduled_tasks.csv", "services": "05_services.csv",
    "autoruns": "06_autoruns.csv", "prefetch": "07_prefetch.csv", "recent_files": "08_recent_files.csv",
    "events": "09_security_events.csv", "manifest": "00_manifest.csv",
}


def read_bundle(spark: SparkSession, root: str, artifact: str, packed: bool = False) -> DataFrame:
    """One artifact of the triage bundles below root/case/host/."""
    if packed:
        return read_host_csv(spark, root, packed=BUNDLE[artifact])
    return read_host_csv(spark, f"{root}/*/*/{BUNDLE[artifact]}")


def read_accounts(spark: SparkSession, path: str) -> DataFrame:
    """Colon-separated account file: rows with at least seven fields."""
    parts = F.split(F.trim("value"), ":")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") >= 7)
    return rows.select(F.get("p", 0).alias("username"), F.get("p", 2).alias("uid"), F.get("p", 3).alias("gid"),
                       F.get("p", 5).alias("home"), F.get("p", 6).alias("shell"))


def autorun_rows(lines: DataFrame) -> DataFrame:
    """Registry query output (host, registry_key, line): lines that hold a value."""
    return lines.where(F.col("line").contains("REG_")).select("host", "registry_key", F.trim("line").alias("entry"))


# ---- SRC-23: sandbox reports ----------------------------------------------

CUCKOO_SCHEMA = (
    "target struct<file:struct<sha256:string>>, info struct<score:double,started:string,ended:string>, "
    "behavior struct<processes:array<struct<process_name:string,pid:int,"
    "calls:array<struct<category:string,api:string,arguments:map<string,string>,time:string>>>>>, "
    "network struct<hosts:array<struct<ip:string>>,domains:array<struct<domain:string>>,"
    "http:array<struct<uri:string>>>, dropped array<struct<name:string>>, ttps array<struct<ttp:string>>")
ANYRUN_SCHEMA = (
    "data struct<verdict:int,hashes:struct<sha256:string>,date:string,"
    "scores:struct<verdict:struct<score:int>>,ioc:struct<ip:array<string>>,mitre:array<struct<id:string>>>")
SERVICE_SCHEMA = "data struct<attributes:struct<sha256:string,date:string,stats:map<string,bigint>>>"


def read_sandbox(spark: SparkSession, path: str, dialect: str, packed: bool = False) -> DataFrame:
    """Sandbox reports of one dialect in the common shape; the report id is the file name."""
    schema = {"cuckoo": CUCKOO_SCHEMA, "anyrun": ANYRUN_SCHEMA, "service": SERVICE_SCHEMA}[dialect]
    raw = json_documents(spark, path, schema, packed).withColumn("report_id", _stem("_file"))
    null = lambda t: F.lit(None).cast(t)
    strings = "array<string>"
    if dialect == "cuckoo":
        cells = dict(sha256=F.col("target.file.sha256"), score=F.col("info.score"),
                     started=F.col("info.started"), ended=F.col("info.ended"),
                     hosts=F.col("network.hosts.ip"), domains=F.col("network.domains.domain"),
                     urls=F.col("network.http.uri"), techniques=F.col("ttps.ttp"))
    elif dialect == "anyrun":
        cells = dict(sha256=F.col("data.hashes.sha256"), verdict_code=F.col("data.verdict"),
                     code_score=F.col("data.scores.verdict.score"), started=F.col("data.date"),
                     ended=F.col("data.date"), hosts=F.col("data.ioc.ip"), techniques=F.col("data.mitre.id"))
    else:
        cells = dict(sha256=F.col("data.attributes.sha256"), started=F.col("data.attributes.date"),
                     stats=F.col("data.attributes.stats"))
    shape = dict(sha256="string", score="double", verdict_code="int", code_score="int",
                 stats="map<string,bigint>", started="string", ended="string", hosts=strings, domains=strings,
                 urls=strings, techniques=strings)
    return raw.select("report_id", F.lit(dialect).alias("sandbox"),
                      *[F.coalesce(cells.get(n, null(t)), null(t)).alias(n) for n, t in shape.items()])


def sandbox_calls(raw_reports: DataFrame, detail_width: int | None = None) -> DataFrame:
    """Behaviour rows of the first dialect: one per call, with its place in the process."""
    procs = raw_reports.select("report_id", F.posexplode("behavior.processes").alias("process_no", "p"))
    calls = procs.select("report_id", "process_no", "p.process_name", "p.pid",
                         F.posexplode("p.calls").alias("call_no", "c"))
    return calls.select(
        "report_id", "process_no", "call_no", F.coalesce("process_name", F.lit("")).alias("process"),
        F.coalesce("pid", F.lit(0)).alias("pid"), F.coalesce("c.category", F.lit("other")).alias("category"),
        F.coalesce("c.api", F.lit("")).alias("action"),
        cut(F.coalesce(F.to_json("c.arguments"), F.lit("{}")), detail_width).alias("detail"),
        F.coalesce("c.time", F.lit("")).alias("timestamp"))


def read_sandbox_calls(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    return sandbox_calls(json_documents(spark, path, CUCKOO_SCHEMA, packed).withColumn("report_id", _stem("_file")))


# ---- SRC-24: reputation reports -------------------------------------------

REPUTATION_SCHEMA = (
    "id string, error string, data struct<attributes:struct<last_analysis_stats:map<string,bigint>,"
    "last_analysis_results:map<string,struct<category:string,result:string>>,whois:string,country:string,"
    "as_owner:string,registrar:string,title:string,tags:array<string>>>")


def read_reputation(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Reputation reports (NDJSON, id is the asked value): key, found, stats, results, whois."""
    raw = spark.read.schema(REPUTATION_SCHEMA).json(path)
    return raw.select(
        F.col("id").alias(key), F.col("error").isNull().alias("found"),
        F.col("data.attributes.last_analysis_stats").alias("stats"),
        F.col("data.attributes.last_analysis_results").alias("results"),
        F.col("data.attributes.whois").alias("whois"))


# ---- SRC-25: cases --------------------------------------------------------

CASE_SCHEMA = (
    "incident_id string, title string, category string, severity string, created_at string, reported_by string, "
    "lead_analyst string, affected_systems array<string>, current_phase string, description string, "
    "tasks array<struct<task_id:string,phase:string,title:string,description:string,assigned_to:string,"
    "status:string,priority:string,created_at:string,completed_at:string,notes:string>>, "
    "notes array<struct<note_id:string,timestamp:string,author:string,phase:string,content:string,"
    "iocs:array<string>>>, iocs array<string>, closed_at string, executive_summary string, "
    "timeline_events array<struct<timestamp:string,event:string,actor:string,phase:string>>")


def read_cases(spark: SparkSession, path: str, packed: bool = False) -> dict[str, DataFrame]:
    """Case files as tables: cases, tasks, notes, log, indicators and systems."""
    raw = json_documents(spark, path, CASE_SCHEMA, packed).drop("_file").withColumnRenamed("incident_id", "case_id")
    part = lambda c: raw.select("case_id", F.explode(c).alias("x"))
    value = lambda c, n: part(c).select("case_id", F.col("x").alias(n)).distinct()
    numbered = raw.select("case_id", F.posexplode("tasks").alias("n", "x"))
    return {
        "cases": raw.drop("tasks", "notes", "iocs", "affected_systems", "timeline_events"),
        "tasks": numbered.select("case_id", (F.col("n") + 1).alias("seq"), "x.*"),
        "notes": part("notes").select("case_id", "x.*").withColumn("ts", F.col("timestamp").try_cast("timestamp")),
        "log": part("timeline_events").select("case_id", "x.*")
        .withColumn("ts", F.col("timestamp").try_cast("timestamp")),
        "indicators": value("iocs", "value"), "systems": value("affected_systems", "host"),
    }
