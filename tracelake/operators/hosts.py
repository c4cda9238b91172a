"""Host snapshots: processes, sockets, sessions, risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.content import messages
from tracelake.content.lookups import SOCKET_PORTS, SUSPICIOUS_PROCESSES
from tracelake.functions.paths import address_port
from tracelake.functions.text import fill
from tracelake.operators.ordered import Sizes, as_of


def suspicious_process(name) -> Column:
    name = F.col(name) if isinstance(name, str) else name
    return F.coalesce(F.lower(name).isin(SUSPICIOUS_PROCESSES), F.lit(False))


def suspicious_socket(remote) -> Column:
    return F.coalesce(address_port(remote).isin(SOCKET_PORTS), F.lit(False))


def sockets_with_process(sockets: DataFrame, processes: DataFrame) -> DataFrame:
    """Sockets with the name of the owning process, N/A where unknown.

    One name per (host, pid) is kept first, so the join cannot multiply rows.
    """
    names = processes.groupBy("host", "pid").agg(F.max("name").alias("process"))
    return sockets.join(names, ["host", "pid"], "left").withColumn("process", F.coalesce("process", F.lit("N/A")))


def process_tree(processes: DataFrame, sizes: Sizes | None = None) -> DataFrame:
    """Each process with its parent: the latest process of that id, on that host, started no later.

    Ids are reused, so the parent is found as of the start time, without pairing
    every process with every earlier one of the same id.
    """
    starts = processes.groupBy("host", F.col("pid").alias("ppid"), F.col("create_time").alias("_started")) \
                      .agg(F.max("name").alias("parent_name"))
    return as_of(processes, starts, ["host", "ppid"], "create_time", "_started", "parent_name", sizes=sizes)


def host_risk(processes: DataFrame, sockets: DataFrame, sessions: DataFrame,
              recent_files: DataFrame | None = None) -> DataFrame:
    """Score, rating, indicators and actions per host.

    Each table is folded per host on its own (partial sums per task), then the
    small per-host rows are added up. The check of executables in temp folders is
    on only when recent_files is given.
    """
    p = processes.groupBy("host").agg(
        F.count_if(suspicious_process("name")).alias("bad_processes"),
        F.array_sort(F.collect_set(F.when(suspicious_process("name"), F.lower("name")))).alias("bad_names"))
    s = sockets.groupBy("host").agg(F.count_if(suspicious_socket("remote")).alias("bad_sockets"))
    u = sessions.groupBy("host").agg(F.count("*").alias("session_count"))
    parts = [p, s, u]
    if recent_files is not None:
        parts.append(recent_files.groupBy("host").agg(
            F.count_if(F.col("extension").isin(".exe", ".ps1", ".dll")).alias("bad_files")))
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "host", "full")
    n = lambda c: F.coalesce(c, F.lit(0))
    bad_p, bad_s, many = n("bad_processes") > 0, n("bad_sockets") > 0, n("session_count") > 3
    bad_f = n("bad_files") > 0 if recent_files is not None else F.lit(False)
    points = lambda test, value: F.when(test, value).otherwise(0)
    score = F.least(F.lit(100), points(bad_p, 20) + points(bad_s, 30) + points(many, 15) + points(bad_f, 25))
    indicators = F.array_compact(F.array(
        F.when(bad_p, fill(messages.HOST_PROCESSES, F.array_join("bad_names", ", "))),
        F.when(bad_s, fill(messages.HOST_SOCKETS, n("bad_sockets"))),
        F.when(many, fill(messages.HOST_SESSIONS, n("session_count"))),
        F.when(bad_f, F.lit(messages.HOST_FILES))))
    rated = out.withColumns({"score": score, "indicators": indicators})
    rating = F.when(F.col("score") >= 70, "critical").when(F.col("score") >= 40, "high") \
              .when(F.col("score") >= 20, "medium").otherwise("low")
    head = (F.when(F.col("score") >= 70, messages.HOST_ACTION_CRITICAL)
            .when(F.col("score") >= 40, messages.HOST_ACTION_HIGH)
            .when(F.col("score") >= 20, messages.HOST_ACTION_MEDIUM))
    actions = F.array_compact(F.array(
        head, F.when(bad_s, F.lit(messages.HOST_ACTION_SOCKETS)), F.when(many, F.lit(messages.HOST_ACTION_SESSIONS)),
        F.when(bad_f, F.lit(messages.HOST_ACTION_FILES))))
    fallback = F.array(F.lit(messages.HOST_ACTION_LOW))
    return rated.select("host", "score", rating.alias("rating"), "indicators",
                        F.when(F.size(actions) > 0, actions).otherwise(fallback).alias("actions"))
