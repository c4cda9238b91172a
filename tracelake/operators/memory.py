"""Memory snapshot tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.paths import address_host, address_port, number_or_hex
from tracelake.operators.ordered import with_last_known, with_running_sum


def _split(lines: DataFrame, least: int) -> DataFrame:
    parts = lines.withColumn("_p", F.split("line", "\t"))
    return parts.where(F.size("_p") >= least)


def _digits(at: int):
    """A field of digits only, else NULL."""
    value = F.get("_p", at)
    return F.when(value.rlike("^[0-9]+$"), value.try_cast("int"))


def process_rows(lines: DataFrame) -> DataFrame:
    """Process list or scan lines (image_id, line): rows that start with a process id."""
    rows = _split(lines, 7).where(F.get("_p", 0).rlike("^[0-9]+$") & F.get("_p", 1).try_cast("int").isNotNull())
    return rows.select(
        "image_id", _digits(0).alias("pid"), F.get("_p", 1).try_cast("int").alias("ppid"),
        F.get("_p", 2).alias("name"), F.get("_p", 3).alias("offset"),
        F.coalesce(_digits(4), F.lit(0)).alias("threads"), F.coalesce(_digits(5), F.lit(0)).alias("handles"),
        _digits(6).alias("session_id"),
        F.coalesce(F.lower(F.trim(F.get("_p", 7))) == "true", F.lit(False)).alias("wow64"),
        F.trim(F.get("_p", 8)).alias("create_time"), F.trim(F.get("_p", 9)).alias("exit_time"))


def connection_rows(lines: DataFrame) -> DataFrame:
    rows = _split(lines, 8)
    local, remote = F.get("_p", 2), F.get("_p", 3)
    return rows.select(
        "image_id", F.get("_p", 0).alias("offset"), F.get("_p", 1).alias("protocol"),
        address_host(local).alias("local_addr"), address_port(local).alias("local_port"),
        address_host(remote).alias("foreign_addr"), address_port(remote).alias("foreign_port"),
        F.get("_p", 4).alias("state"), F.coalesce(_digits(5), F.lit(0)).alias("pid"),
        F.get("_p", 6).alias("owner"), F.trim(F.get("_p", 7)).alias("created"))


def dll_rows(lines: DataFrame) -> DataFrame:
    """Module lines with the process id of the header line above them.

    lines: image_id, line_no, line. The id is filled forward per image.
    """
    header = F.col("line").rlike(r"^[0-9]+\s+\S+") & ~F.col("line").startswith("0x")
    pid = F.when(header, F.regexp_extract("line", r"^([0-9]+)", 1).try_cast("int"))
    known = with_last_known(lines.withColumn("_header", header), ["image_id"], ["line_no"], pid, "pid")
    rows = _split(known.where(~F.col("_header")), 4).where(F.get("_p", 0).startswith("0x"))
    size = number_or_hex(F.get("_p", 1))
    return rows.where(size.isNotNull()).select(
        "image_id", F.coalesce("pid", F.lit(0)).alias("pid"), F.get("_p", 0).alias("base"), size.alias("size"),
        F.get("_p", 2).alias("name"), F.trim(F.get("_p", 3)).alias("full_path"),
        F.trim(F.get("_p", 4)).alias("load_time"))


def marked_records(lines: DataFrame, keys: list[str], order: str, marker) -> DataFrame:
    """Lines numbered by the record they belong to; a record starts at a marker line.

    Long form (keys, record, order, is_header, line). Lines before the first
    marker belong to no record and are left out.
    """
    rows = lines.withColumn("is_header", marker)
    numbered = with_running_sum(rows, keys, [order], F.col("is_header").cast("bigint"), "record")
    return numbered.where(F.col("record") > 0)


def injection_records(lines: DataFrame) -> DataFrame:
    marker = F.col("line").startswith("PID:") | F.col("line").contains("Process:")
    return marked_records(lines, ["image_id"], "line_no", marker)


def signature_hits(lines: DataFrame) -> DataFrame:
    rows = _split(lines, 3)
    return rows.select("image_id", F.get("_p", 0).alias("rule"), F.get("_p", 1).alias("offset"),
                       F.get("_p", 2).alias("pid"), F.coalesce(F.get("_p", 3), F.lit("N/A")).alias("process"))


def hive_rows(lines: DataFrame) -> DataFrame:
    rows = _split(lines, 2).where(F.get("_p", 0).startswith("0x"))
    return rows.select("image_id", F.get("_p", 0).alias("offset"), F.trim(F.get("_p", 1)).alias("name"))


def command_lines(lines: DataFrame) -> DataFrame:
    line = F.col("line")
    keep = line.contains("Command line") | (line.contains(": ") & (F.length(line) > 10))
    return lines.where(keep).select("image_id", F.trim(line).alias("command"))


def hidden_processes(listed: DataFrame, scanned: DataFrame) -> DataFrame:
    """(image_id, pid) seen by the scan and missing from the list."""
    ids = scanned.select("image_id", "pid").distinct()
    return ids.join(listed.select("image_id", "pid").distinct(), ["image_id", "pid"], "left_anti")


def hidden_summary(listed: DataFrame, scanned: DataFrame) -> DataFrame:
    """Per image: ids listed, ids scanned, ids hidden, and whether any is hidden."""
    seen = lambda df, tag: df.select("image_id", "pid").distinct().withColumn(tag, F.lit(1))
    both = seen(listed, "_l").join(seen(scanned, "_s"), ["image_id", "pid"], "full")
    hidden = F.count_if(F.col("_l").isNull())
    return both.groupBy("image_id").agg(
        F.count("_l").alias("listed"), F.count("_s").alias("scanned"),
        hidden.alias("hidden"), (hidden > 0).alias("tampering_suspected"))
