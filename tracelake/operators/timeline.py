"""One ordered timeline out of many sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.content.lookups import TECHNIQUE_NAMES
from tracelake.functions.text import parent_technique
from tracelake.operators.ordered import Sizes, with_position

COLUMNS = {
    "ts": "timestamp", "category": "string", "description": "string", "source": "string",
    "host": "string", "user_name": "string", "process": "string", "pid": "int",
    "file_path": "string", "network_info": "string", "registry_key": "string",
    "event_id": "string", "rule_name": "string", "mitre": "string", "severity": "string",
    "raw": "string", "analyst_note": "string",
}
ORDER = ["ts", "source", "host", "category", "event_id", "description"]


def conform(df: DataFrame, **overrides: Column) -> DataFrame:
    """The 17 timeline columns; missing ones are NULL, severity defaults to info."""
    have = set(df.columns)
    out = []
    for name, kind in COLUMNS.items():
        if name in overrides:
            c = overrides[name]
        elif name in have:
            c = F.col(name)
        elif name == "severity":
            c = F.lit("info")
        else:
            c = F.lit(None)
        out.append((c if name == "ts" else c.cast(kind)).alias(name))
    return df.select(*out)


def union_timelines(*sources: DataFrame) -> DataFrame:
    """All sources as one timeline. Rows are not sorted here: the sink sorts once."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def ordered(timeline: DataFrame) -> DataFrame:
    """Global time order with tie-breakers (a range-partitioned sort)."""
    return timeline.orderBy(*ORDER)


def by_severity(timeline: DataFrame, severity: str) -> DataFrame:
    return timeline.where(F.col("severity") == severity)


def for_host(timeline: DataFrame, host: str) -> DataFrame:
    return timeline.where(F.lower("host") == host.lower())


def summary(timeline: DataFrame, approximate_hosts: bool = False) -> DataFrame:
    """Total, time range, and counts by category, severity, host and source, in one pass.

    Rows: (dimension, value, events, first_ts, last_ts); dimension 'total' holds
    the time range.
    """
    dims = ["category", "severity", "host", "source"]
    t = timeline.select("ts", *dims)
    grouped = t.groupingSets([[F.col(d)] for d in dims] + [[]], *[F.col(d) for d in dims]).agg(
        F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    name, value = F.lit("total"), F.lit(None).cast("string")
    for d in reversed(dims):
        name = F.when(F.col(f"_g_{d}") == 0, d).otherwise(name)
        value = F.when(F.col(f"_g_{d}") == 0, F.col(d)).otherwise(value)
    out = grouped.select(name.alias("dimension"), value.alias("value"), "events", "first_ts", "last_ts")
    if approximate_hosts:
        hosts = timeline.agg(F.approx_count_distinct("host").alias("events"))
        out = out.unionByName(hosts.withColumn("dimension", F.lit("approximate_hosts")), allowMissingColumns=True)
    return out


def technique_phases(timeline: DataFrame, sizes: Sizes | None = None) -> DataFrame:
    """Events of each technique, numbered in time order.

    Long form instead of one list per technique: the group may be of any size.
    """
    hits = timeline.where(F.col("mitre").isNotNull() & (F.col("mitre") != ""))
    numbered = with_position(hits, ["mitre"], ORDER, "seq", sizes)
    return numbered.select("mitre", "seq", "ts", "description", "host")


def technique_name(technique) -> Column:
    """Short name of a technique; sub-techniques take the name of their parent."""
    pairs = [x for k, v in TECHNIQUE_NAMES.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), parent_technique(technique))


def first_affected(events: DataFrame, keys: list[str], host: str, ts: str, tie: str) -> DataFrame:
    """Patient zero: the host of the earliest event of each case."""
    return events.groupBy(*keys).agg(
        F.min_by(host, F.struct(ts, tie)).alias("first_host"), F.min(ts).alias("first_ts"))


def dwell_time(events: DataFrame, keys: list[str], ts: str, malicious: Column, detected: Column) -> DataFrame:
    """Seconds from the earliest malicious artifact to the first detection."""
    out = events.groupBy(*keys).agg(
        F.min(F.when(malicious, F.col(ts))).alias("first_artifact"),
        F.min(F.when(detected, F.col(ts))).alias("first_detection"))
    seconds = F.unix_seconds(F.col("first_detection").cast("timestamp")) \
        - F.unix_seconds(F.col("first_artifact").cast("timestamp"))
    return out.withColumn("dwell_seconds", seconds)


def export_rows(timeline: DataFrame) -> DataFrame:
    """Timeline table with the 13 export headings; NULL prints as empty text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return timeline.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("Timestamp (UTC)"),
        text("severity").alias("Severity"), text("category").alias("Category"), text("source").alias("Source"),
        text("host").alias("Host"), text("user_name").alias("User"), text("process").alias("Process"),
        text("description").alias("Description"), text("file_path").alias("File Path"),
        text("network_info").alias("Network Info"), text("event_id").alias("Event ID"),
        text("mitre").alias("MITRE"), text("analyst_note").alias("Note"))
