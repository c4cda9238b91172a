"""Packets and flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.content import messages
from tracelake.content.lookups import BEACON_INTERVALS, FLOW_PORTS, LARGE_FLOW_BYTES
from tracelake.functions.text import fill
from tracelake.functions.times import micros
from tracelake.functions.tokens import is_private
from tracelake.operators.ordered import Sizes, as_of, with_previous

FLOW_KEYS = ["src_ip", "dst_ip", "dst_port", "protocol"]


def flows(packets: DataFrame, extra_keys: list[str] | None = None) -> DataFrame:
    """Flows by source, destination, port and protocol.

    A plain grouped aggregate: each task folds its packets first, so a flow that
    holds most packets moves one row per task.
    """
    return packets.groupBy(*(extra_keys or []), *FLOW_KEYS).agg(
        F.count("*").alias("packet_count"), F.sum("length").alias("bytes_total"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def flow_reason(port="dst_port", total="bytes_total", ports=None, limit: int = LARGE_FLOW_BYTES) -> Column:
    """Why a flow is suspicious, or NULL: a listed port wins over the volume."""
    listed = F.col(port).isin(ports or FLOW_PORTS)
    megabytes = F.format_string("%.1f", F.col(total) / 1048576.0)
    return F.when(listed, fill(messages.FLOW_PORT, F.col(port))) \
            .when(F.col(total) > limit, fill(messages.FLOW_VOLUME, megabytes))


def flag_flows(flow_rows: DataFrame, ports=None, limit: int = LARGE_FLOW_BYTES) -> DataFrame:
    reason = flow_reason(ports=ports, limit=limit)
    return flow_rows.withColumns({"suspicious": reason.isNotNull(), "reason": F.coalesce(reason, F.lit(""))})


def endpoint_top(packets: DataFrame, ip: str, port: str, n: int = 10) -> DataFrame:
    """Busiest ip:port endpoints; ties by name."""
    name = F.concat_ws(":", F.col(ip), F.col(port).cast("string"))
    return packets.groupBy(name.alias("endpoint")).agg(F.count("*").alias("packets")) \
                  .orderBy(F.desc("packets"), "endpoint").limit(n)


def top_talkers(packets: DataFrame, n: int = 10) -> DataFrame:
    return endpoint_top(packets, "src_ip", "src_port", n)


def top_destinations(packets: DataFrame, n: int = 10) -> DataFrame:
    return endpoint_top(packets, "dst_ip", "dst_port", n)


def protocol_breakdown(packets: DataFrame) -> DataFrame:
    return packets.groupBy("protocol").agg(F.count("*").alias("packets"))


def capture_summary(packets: DataFrame, dns: DataFrame | None = None, ports=None,
                    limit: int = LARGE_FLOW_BYTES, approximate: bool = False) -> DataFrame:
    """One row: packets, flows, suspicious flows and DNS queries.

    Everything but the DNS count comes from one aggregate over the flows. With
    approximate, hosts are counted by sketch.
    """
    f = flag_flows(flows(packets), ports, limit)
    hosts = F.approx_count_distinct if approximate else F.count_distinct
    rows = f.select("packet_count", "suspicious", "src_ip", F.lit(True).alias("_flow"))
    if dns is not None:
        # Answers are rows of the same aggregate, marked as such: no join of two totals.
        rows = rows.unionByName(dns.select(F.lit(False).alias("_flow")), allowMissingColumns=True)
    return rows.agg(
        F.coalesce(F.sum("packet_count"), F.lit(0)).alias("total_packets"),
        F.count_if("_flow").alias("total_connections"),
        F.count_if("suspicious").alias("suspicious_connections"),
        hosts("src_ip").alias("source_hosts"), F.count_if(~F.col("_flow")).alias("dns_queries"))


def name_flows(flow_rows: DataFrame, dns: DataFrame, sizes: Sizes | None = None) -> DataFrame:
    """Flows with the name whose latest answer, at or before the first packet, gave the address.

    dns: ts, query_name, response_ips array, src_ip.
    """
    answers = dns.select("ts", "query_name", F.explode("response_ips").alias("dst_ip"), "src_ip")
    one = answers.groupBy("src_ip", "dst_ip", "ts").agg(F.max("query_name").alias("dns_name"))
    return as_of(flow_rows, one, ["src_ip", "dst_ip"], "first_seen", "ts", "dns_name", sizes=sizes)


def interval_profile(events: DataFrame, keys: list[str], ts: str, order: list[str],
                     expected=None, tolerance: float = 0.1, sizes: Sizes | None = None) -> DataFrame:
    """Inter-arrival profile per key: events, mean, deviation, and hits of expected intervals.

    The lag is taken in chunks of the order, then all is folded per key.
    """
    expected = expected or BEACON_INTERVALS
    d = events.withColumn("_at", micros(ts))
    d = with_previous(d, keys, order, F.col("_at"), "_before", sizes)
    d = d.withColumn("_gap", (F.col("_at") - F.col("_before")) / F.lit(1_000_000.0))
    near = [F.count_if(F.abs(F.col("_gap") - s) <= s * tolerance).alias(f"near_{s}") for s in expected]
    return d.groupBy(*keys).agg(
        F.count("*").alias("events"), F.avg("_gap").alias("mean_gap"),
        F.stddev_pop("_gap").alias("gap_deviation"), *near)


def beacons(profile: DataFrame, min_events: int = 5, max_variation: float = 0.1, min_share: float = 0.8,
            expected=None) -> DataFrame:
    """Keys whose intervals hardly vary, or mostly sit at one expected interval."""
    expected = expected or BEACON_INTERVALS
    variation = F.when(F.col("mean_gap") > 0, F.col("gap_deviation") / F.col("mean_gap"))
    best = F.greatest(*[F.col(f"near_{s}") for s in expected]) if len(expected) > 1 \
        else F.col(f"near_{expected[0]}")
    share = best / F.greatest(F.col("events") - 1, F.lit(1))
    return profile.withColumns({"variation": variation, "regular_share": share}) \
        .where((F.col("events") >= min_events)
               & ((F.col("variation") <= max_variation) | (F.col("regular_share") >= min_share)))


def egress_over(flow_rows: DataFrame, known: DataFrame | None = None, limit: int = LARGE_FLOW_BYTES) -> DataFrame:
    """Source and public destination pairs above the limit, known destinations left out."""
    out = flow_rows.where(~is_private("dst_ip"))
    if known is not None:
        out = out.join(known.select("dst_ip").distinct(), "dst_ip", "left_anti")
    return out.groupBy("src_ip", "dst_ip").agg(F.sum("bytes_total").alias("bytes_out")) \
              .where(F.col("bytes_out") > limit)


def flow_export(flow_rows: DataFrame) -> DataFrame:
    """Flow table with the export headings."""
    name = F.col("dns_name") if "dns_name" in flow_rows.columns else F.lit(None).cast("string")
    return flow_rows.select(
        F.col("src_ip").alias("Src IP"), F.col("dst_ip").alias("Dst IP"), F.col("dst_port").alias("Dst Port"),
        F.col("protocol").alias("Protocol"), F.col("packet_count").alias("Packets"),
        F.col("bytes_total").alias("Bytes"), F.col("first_seen").alias("First Seen"),
        F.col("last_seen").alias("Last Seen"), F.coalesce(name, F.lit("")).alias("DNS Name"),
        F.col("suspicious").alias("Suspicious"), F.col("reason").alias("Reason"))
