"""Queries on packets, flows and time-ordered behaviour."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracelake.content.lookups import FLOW_PORTS
from tracelake.operators import flows as fl
from tracelake.operators.alerts import newest
from tracelake.operators.hunts import login_baseline, off_hours, unusual_logins, unusual_logins_so_far
from tracelake.operators.ordered import (
    count_within, sessions, with_last_known, with_position, with_running_sum,
)
from tracelake.operators.sketches import daily_sketches, distinct_error, distinct_of, merged, quantile_of, rank_error
from tracelake.plans.registry import query
from tracelake.plans.views import (
    DNS_SQL, LIMIT_BYTES, PACKETS_SQL, dns_answers, load, packets, telemetry, with_sql,
)
from tracelake.session import work_folder

PORT_LIST = ", ".join(str(p) for p in FLOW_PORTS)
REASON = f"""CASE WHEN dst_port IN ({PORT_LIST}) THEN 'Known C2/malware port: ' || dst_port
  WHEN bytes_total > {LIMIT_BYTES} THEN 'Large data transfer: ' || format('{{:.1f}}', bytes_total / 1048576.0) || ' MB' END"""


@query("flow_aggregate", with_sql(PACKETS_SQL, body="SELECT * FROM flows"))
def _(spark, d):
    return fl.flows(packets(spark, d))


@query("flow_suspicious", with_sql(PACKETS_SQL, body=f"""
SELECT src_ip, dst_ip, dst_port, protocol, bytes_total, {REASON} AS reason FROM flows WHERE {REASON} IS NOT NULL"""))
def _(spark, d):
    f = fl.flag_flows(fl.flows(packets(spark, d)), limit=LIMIT_BYTES)
    return f.where("suspicious").select("src_ip", "dst_ip", "dst_port", "protocol", "bytes_total", "reason")


@query("top_talkers", with_sql(PACKETS_SQL, body="""
SELECT src_ip || ':' || src_port AS endpoint, count(*) AS packets FROM packets GROUP BY ALL
ORDER BY packets DESC, endpoint LIMIT 10"""))
def _(spark, d):
    return fl.top_talkers(packets(spark, d))


@query("top_destinations", with_sql(PACKETS_SQL, body="""
SELECT dst_ip || ':' || dst_port AS endpoint, count(*) AS packets FROM packets GROUP BY ALL
ORDER BY packets DESC, endpoint LIMIT 10"""))
def _(spark, d):
    return fl.top_destinations(packets(spark, d))


@query("protocol_breakdown", with_sql(PACKETS_SQL, body="""
SELECT protocol, count(*) AS packets FROM packets GROUP BY ALL"""))
def _(spark, d):
    return fl.protocol_breakdown(packets(spark, d))


@query("capture_summary", with_sql(PACKETS_SQL, DNS_SQL, body=f"""
SELECT CAST(sum(packet_count) AS BIGINT) AS total_packets, count(*) AS total_connections,
  count(*) FILTER (WHERE {REASON} IS NOT NULL) AS suspicious_connections, count(DISTINCT src_ip) AS source_hosts,
  (SELECT count(*) FROM dns) AS dns_queries FROM flows"""))
def _(spark, d):
    return fl.capture_summary(packets(spark, d), dns_answers(spark, d), limit=LIMIT_BYTES)


@query("capture_summary_approximate", with_sql(PACKETS_SQL, body="""
SELECT CAST(sum(packet_count) AS BIGINT) AS total_packets, count(*) AS total_connections, true AS hosts_within_bound FROM flows"""))
def _(spark, d):
    """The sketch's count of hosts lies within three of its standard errors (5 %) of the exact count."""
    rows = packets(spark, d)
    guess = fl.capture_summary(rows, limit=LIMIT_BYTES, approximate=True)
    exact = rows.agg(F.count_distinct("src_ip").alias("hosts")).scalar()
    return guess.select("total_packets", "total_connections", (F.abs(F.col("source_hosts") - exact) <= exact * 0.15).alias("hosts_within_bound"))


@query("flow_dns_names", with_sql(PACKETS_SQL, DNS_SQL, """
answers AS (SELECT src_ip, dst_ip, ts, max(query_name) AS dns_name FROM dns GROUP BY ALL)""", body="""
SELECT f.src_ip, f.dst_ip, f.dst_port, f.protocol, f.first_seen, a.dns_name
FROM flows f ASOF LEFT JOIN answers a ON f.src_ip = a.src_ip AND f.dst_ip = a.dst_ip AND f.first_seen >= a.ts"""))
def _(spark, d):
    named = fl.name_flows(fl.flows(packets(spark, d)), dns_answers(spark, d))
    return named.select("src_ip", "dst_ip", "dst_port", "protocol", "first_seen", "dns_name")


@query("flow_export", with_sql(PACKETS_SQL, DNS_SQL, """
answers AS (SELECT src_ip, dst_ip, ts, max(query_name) AS dns_name FROM dns GROUP BY ALL)""", body=f"""
SELECT src_ip AS "Src IP", dst_ip AS "Dst IP", dst_port AS "Dst Port", protocol AS "Protocol",
  packet_count AS "Packets", bytes_total AS "Bytes", first_seen AS "First Seen", last_seen AS "Last Seen",
  coalesce(dns_name, '') AS "DNS Name", {REASON} IS NOT NULL AS "Suspicious", coalesce({REASON}, '') AS "Reason"
FROM (SELECT f.*, a.dns_name FROM flows f ASOF LEFT JOIN answers a
  ON f.src_ip = a.src_ip AND f.dst_ip = a.dst_ip AND f.first_seen >= a.ts)"""))
def _(spark, d):
    named = fl.name_flows(fl.flows(packets(spark, d)), dns_answers(spark, d))
    return fl.flow_export(fl.flag_flows(named, limit=LIMIT_BYTES))


@query("egress_over_limit", with_sql(PACKETS_SQL, DNS_SQL, body="""
SELECT src_ip, dst_ip, CAST(sum(bytes_total) AS BIGINT) AS bytes_out FROM flows
WHERE NOT starts_with(dst_ip, '192.168.') AND dst_ip NOT IN (SELECT dst_ip FROM dns WHERE src_ip = '10.0.0.7'
  AND query_name = 'h7.example.net')
GROUP BY ALL HAVING sum(bytes_total) > 2000000"""))
def _(spark, d):
    known = dns_answers(spark, d).where((F.col("src_ip") == "10.0.0.7") & (F.col("query_name") == "h7.example.net")) \
        .select(F.explode("response_ips").alias("dst_ip"))
    return fl.egress_over(fl.flows(packets(spark, d)), known, 2_000_000)


PROFILE_SQL = """
gaps AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id))
  / 1000000.0 AS gap FROM events),
profile AS (SELECT user_id, count(*) AS events, avg(gap) AS mean_gap, stddev_pop(gap) AS gap_deviation,
  count(*) FILTER (abs(gap - 3600) <= 1800) AS near_3600, count(*) FILTER (abs(gap - 7200) <= 3600) AS near_7200
  FROM gaps GROUP BY user_id)"""


def user_profile(spark, d):
    return fl.interval_profile(load(spark, d, "events"), ["user_id"], "ts", ["ts", "event_id"],
                               expected=[3600, 7200], tolerance=0.5)


@query("interval_profile", with_sql(PROFILE_SQL, body="""
SELECT user_id, events, round(mean_gap, 3) AS mean_gap, round(gap_deviation, 3) AS gap_deviation, near_3600, near_7200
FROM profile"""))
def _(spark, d):
    p = user_profile(spark, d)
    return p.withColumns({c: F.round(c, 3) for c in ("mean_gap", "gap_deviation")})


@query("beacons", with_sql(PROFILE_SQL, body="""
SELECT user_id, events, round(gap_deviation / mean_gap, 4) AS variation,
  round(greatest(near_3600, near_7200) / greatest(events - 1, 1), 4) AS regular_share FROM profile
WHERE events >= 5 AND (gap_deviation / mean_gap <= 0.9 OR greatest(near_3600, near_7200) / greatest(events - 1, 1) >= 0.25)"""))
def _(spark, d):
    b = fl.beacons(user_profile(spark, d), min_events=5, max_variation=0.9, min_share=0.25, expected=[3600, 7200])
    return b.select("user_id", "events", F.round("variation", 4).alias("variation"),
                    F.round("regular_share", 4).alias("regular_share"))


@query("burst_windows", """
SELECT event_type, ts, hits FROM (SELECT event_type, ts, count(*) OVER (PARTITION BY event_type ORDER BY ts
  RANGE BETWEEN INTERVAL 1800 SECOND PRECEDING AND CURRENT ROW) AS hits FROM events) WHERE hits >= 5""")
def _(spark, d):
    hits = count_within(load(spark, d, "events"), ["event_type"], "ts", 1800)
    # Equal times would share one row: repeat it for each.
    return hits.where(F.col("hits") >= 5).select(
        "event_type", "ts", "hits", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_")).drop("_")


@query("activity_sessions", """
SELECT user_id, session_start, max(ts) AS session_last, count(*) AS events FROM (
  SELECT user_id, ts, max(start) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_start FROM (
    SELECT *, CASE WHEN before IS NULL OR epoch_us(ts) - epoch_us(before) > 21600000000 THEN ts END AS start FROM (
      SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)))
GROUP BY user_id, session_start""")
def _(spark, d):
    return sessions(load(spark, d, "events"), ["user_id"], "ts", ["ts", "event_id"], 21_600)


@query("login_baseline", """
SELECT user_id, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS logins,
  CAST(sum(count(*)) OVER (PARTITION BY user_id) AS BIGINT) AS total,
  round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS share FROM events GROUP BY user_id, hour(ts)""")
def _(spark, d):
    b = login_baseline(load(spark, d, "events"), "user_id")
    return b.withColumn("share", F.round("share", 6))


@query("unusual_logins", """
SELECT event_id, user_id, hour, share FROM (
  SELECT event_id, user_id, CAST(hour(ts) AS INTEGER) AS hour,
    round(count(*) OVER (PARTITION BY user_id, hour(ts)) / count(*) OVER (PARTITION BY user_id), 6) AS share,
    count(*) OVER (PARTITION BY user_id) AS total FROM events) WHERE share <= 0.02 AND total >= 20""")
def _(spark, d):
    u = unusual_logins(load(spark, d, "events"), "user_id")
    return u.select("event_id", "user_id", "hour", F.round("share", 6).alias("share"))


@query("unusual_logins_so_far", """
SELECT event_id, user_id, hour, logins, total, round(logins / total, 6) AS share FROM (
  SELECT event_id, user_id, CAST(hour(ts) AS INTEGER) AS hour,
    count(*) OVER (PARTITION BY user_id, hour(ts) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS logins,
    count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS total FROM events)
WHERE total >= 20 AND logins / total <= 0.02""")
def _(spark, d):
    u = unusual_logins_so_far(load(spark, d, "events"), "user_id")
    return u.select("event_id", "user_id", "hour", "logins", "total", F.round("share", 6).alias("share"))


@query("sketches_by_week", """
SELECT date_trunc('week', ts)::DATE AS week, count(*) AS rows, count(DISTINCT event_id) AS events, TRUE AS events_within, count(DISTINCT user_id) AS users,
  TRUE AS users_within, TRUE AS median_within, TRUE AS top_within FROM events GROUP BY ALL""")
def _(spark, d):
    """Daily sketches, stored and merged by week, beside the exact figures: within their bounds or not."""
    e, path = load(spark, d, "events"), work_folder(spark, "sketches")
    daily_sketches(e, "ts", {"events": F.col("event_id"), "users": F.col("user_id")}, {"value": F.col("value")}).write.parquet(path)
    week = lambda c: F.date_trunc("week", c).cast("date").alias("week")
    weeks = merged(spark.read.parquet(path), week(F.col("day").cast("timestamp_ntz")))
    found = weeks.select("week", "rows", distinct_of("events").alias("e"), distinct_of("users").alias("u"), quantile_of("value", 0.5).alias("q50"), quantile_of("value", 0.95).alias("q95"))
    # Where the estimated quantiles really lie: one more pass, over a join with one row per week.
    own = e.withColumn("week", week(F.col("ts"))).join(F.broadcast(found.select("week", "q50", "q95")), "week")
    exact = own.groupBy("week").agg(F.count_distinct("event_id").alias("events"), F.count_distinct("user_id").alias("users"), *[
        f(F.col("value") <= F.col(q)).alias(f"{n}_{q}") for q in ("q50", "q95") for n, f in (("upto", F.count_if),)], *[
        F.count_if(F.col("value") < F.col(q)).alias(f"below_{q}") for q in ("q50", "q95")])
    off = lambda q, share: (F.col(f"below_{q}") / F.col("rows") <= share + rank_error()) & (F.col(f"upto_{q}") / F.col("rows") >= share - rank_error())
    near = lambda n, c: F.abs(F.col(c) - F.col(n)) <= distinct_error() * F.col(n)
    return found.join(exact, "week").select("week", "rows", "events", near("events", "e").alias("events_within"), "users", near("users", "u").alias("users_within"),
                                            off("q50", 0.5).alias("median_within"), off("q95", 0.95).alias("top_within"))


@query("off_hours", """
SELECT event_id, host, ts FROM (SELECT event_id, 'host-' || user_id AS host, ts FROM events)
WHERE dayofweek(ts) IN (0, 6) OR hour(ts) < 8 OR hour(ts) >= 18""")
def _(spark, d):
    return telemetry(spark, d).where(off_hours("ts")).select("event_id", "host", "ts")


@query("forward_fill", """
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER
  (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_signup FROM events""")
def _(spark, d):
    e = load(spark, d, "events")
    mark = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return with_last_known(e, ["user_id"], ["ts", "event_id"], mark, "last_signup") \
        .select("event_id", "user_id", "last_signup")


@query("marker_groups", """
SELECT conv_id, turn, record FROM (SELECT conv_id, turn, CAST(sum(CASE role WHEN 'user' THEN 1 ELSE 0 END) OVER
  (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS record FROM conversations) WHERE record > 0""")
def _(spark, d):
    c = load(spark, d, "conversations")
    rows = with_running_sum(c, ["conv_id"], ["turn"], (F.col("role") == "user").cast("bigint"), "record")
    return rows.where(F.col("record") > 0).select("conv_id", "turn", "record")


@query("sequential_ids", """
SELECT event_id, 'CONTAIN-' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END
  AS action_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS n FROM events)""")
def _(spark, d):
    from tracelake.operators.cases import numbered

    e = load(spark, d, "events")
    return numbered(e, [], ["ts", "event_id"], "CONTAIN").select("event_id", "action_id")


@query("row_positions", """
SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS position FROM events""")
def _(spark, d):
    return with_position(load(spark, d, "events"), ["event_type"], ["ts", "event_id"]) \
        .select("event_id", "position")


@query("newest_events", """
SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 200""")
def _(spark, d):
    return newest(load(spark, d, "events"), "ts", 200, "event_id").select("event_id", "user_id", "ts")
