"""Alert, agent, rule and vulnerability queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def query_alerts(alerts: DataFrame, level_min: int = 0, agent_id=None, start=None, end=None, limit: int | None = None,
                 tie: str = "alert_id") -> DataFrame:
    """Alerts by level, agent and inclusive time range, newest first: the newest limit, or all."""
    out = alerts
    if level_min > 0:
        out = out.where(F.col("rule_level") >= level_min)
    if agent_id is not None:
        out = out.where(F.col("agent_id") == agent_id)
    if start is not None:
        out = out.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        out = out.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    out = out.orderBy(F.desc("ts"), F.desc(tie))
    return out if limit is None else out.limit(limit)


def newest(df: DataFrame, ts: str, n: int, tie: str) -> DataFrame:
    """Newest n rows (top-k: each task keeps n rows)."""
    return df.orderBy(F.desc(ts), F.desc(tie)).limit(n)


def agents_by_status(agents: DataFrame, status: str = "active") -> DataFrame:
    return agents.where(F.col("status") == status)


def agent_summary(agents: DataFrame) -> DataFrame:
    """Agents in total and by state, overall (os is NULL) and per operating system."""
    grouped = agents.groupingSets([[F.col("os")], []], F.col("os")).agg(
        F.count("*").alias("total_agents"),
        F.count_if(F.col("status") == "active").alias("active_agents"),
        F.count_if(F.col("status") == "disconnected").alias("disconnected_agents"),
        F.grouping("os").cast("int").alias("overall"))
    return grouped


def rules_by(catalogue: DataFrame, level_min: int = 0, group: str | None = None) -> DataFrame:
    out = catalogue.where(F.col("level") >= level_min) if level_min else catalogue
    return out if group is None else out.where(F.array_contains(F.split("groups", ","), group))


def vulnerabilities(rows: DataFrame, agent_id=None, severity: str = "High") -> DataFrame:
    out = rows.where(F.col("severity") == severity)
    return out if agent_id is None else out.where(F.col("agent_id") == agent_id)


def high_value(code, labels: dict[int, str]) -> Column:
    """Label of a high-value event id, or NULL."""
    pairs = [x for k, v in labels.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), (F.col(code) if isinstance(code, str) else code).cast("int"))
