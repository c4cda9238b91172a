"""Report rows for hunts and cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.content.hunts import HYPOTHESES
from tracelake.functions.text import cut
from tracelake.operators.ordered import first_per_group


def hypothesis_table(spark) -> DataFrame:
    return spark.createDataFrame(
        [(h, t, m, s) for h, t, m, s in HYPOTHESES],
        "rule_id string, hypothesis string, technique string, hypothesis_severity string")


def findings_per_hypothesis(findings: DataFrame) -> DataFrame:
    """Findings per hypothesis, with a row for each hypothesis."""
    counted = findings.groupBy("rule_id").agg(F.count("*").alias("findings"))
    return hypothesis_table(findings.sparkSession).join(counted, "rule_id", "left") \
        .select("rule_id", "hypothesis", "technique", F.coalesce("findings", F.lit(0)).alias("findings"))


def hunt_report(findings: DataFrame, first: int | None = None, width: int | None = None) -> DataFrame:
    """Rows (rule_id, rank, text): rank 0 is the heading, then the first findings in time order."""
    heads = findings_per_hypothesis(findings).select(
        "rule_id", F.lit(0).alias("rank"),
        F.concat(F.lit("["), F.col("rule_id"), F.lit("] "), F.col("hypothesis"), F.lit(" | "), F.col("technique"),
                 F.lit(" | findings: "), F.col("findings").cast("string")).alias("text"))
    top = first_per_group(findings, ["rule_id"], ["ts", "event_id", "description"], first).select(
        "rule_id", "rank",
        F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("host"), F.lit(": "),
                 cut("description", width)).alias("text"))
    return heads.unionByName(top)


def section(rows: DataFrame, case: str, name, order: list, cap: int | None, fields: dict[str, Column]) -> DataFrame:
    """Ranked rows of one report section: (case_id, section, rank, fields).

    Without a cap every row is kept and rank is NULL.
    """
    name = F.lit(name) if isinstance(name, str) else name
    pairs = [x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))]
    # Fields and sort keys only: nothing else takes part in the shuffle.
    slim = rows.select(F.col(case).alias("case_id"), name.alias("section"), F.create_map(*pairs).alias("fields"),
                       F.struct(*order).alias("_order"))
    if cap is None:
        return slim.select("case_id", "section", F.lit(None).cast("int").alias("rank"), "fields")
    ranked = first_per_group(slim, ["case_id", "section"], ["_order"], cap)
    return ranked.select("case_id", "section", F.col("rank").cast("int").alias("rank"), "fields")


def case_report(cases: DataFrame, timeline: DataFrame, indicators: DataFrame, evidence: DataFrame,
                actions: DataFrame | None = None, caps: dict | None = None,
                widths: dict | None = None) -> DataFrame:
    """Report rows of many cases at once.

    cases: case_id, title, severity, category. timeline: case_id, ts, severity,
    description, source, host, event_id. indicators: case_id, ioc_type, value.
    evidence: case_id, evidence_id, evidence_type, description, sha256,
    acquired_by. actions: case_id, action_id, action_type, target, success.
    caps: rows per section (keys as in REPORT_CAPS). widths: characters of
    timeline, evidence and sha256 texts. What is not named is kept whole.
    """
    caps, widths = caps or {}, widths or {}
    f = F.col
    parts = [
        cases.select("case_id", F.lit("summary").alias("section"), F.lit(1).alias("rank"), F.create_map(
            F.lit("title"), f("title"), F.lit("severity"), F.upper("severity"),
            F.lit("category"), f("category")).alias("fields")),
        section(timeline, "case_id", "timeline", ["ts", "event_id"], caps.get("timeline"), {
            "timestamp": F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "severity": f("severity"),
            "description": cut("description", widths.get("timeline")), "source": f("source"), "host": f("host")}),
        section(evidence, "case_id", "evidence", ["evidence_id"], caps.get("evidence"), {
            "evidence_id": f("evidence_id"), "type": f("evidence_type"), "description": cut("description", widths.get("evidence")),
            "sha256": cut("sha256", widths.get("sha256")), "acquired_by": f("acquired_by")}),
    ]
    # One ranking for all indicator types, so the tokens are extracted once.
    kinds = ["ip", "domain", "hash_sha256", "url"]
    distinct = indicators.where(f("ioc_type").isin(kinds)).select("case_id", "ioc_type", "value").distinct()
    listed = section(distinct, "case_id", F.concat(F.lit("indicator_"), f("ioc_type")), ["value"],
                     max((caps.get(k) or 0 for k in kinds), default=0) if all(caps.get(k) for k in kinds) else None,
                     {"value": f("value")})
    within = F.lit(False)
    for kind in kinds:
        here = f("section") == f"indicator_{kind}"
        within = within | (here & (f("rank") <= caps[kind]) if caps.get(kind) else here)
    parts.append(listed.where(within))
    if actions is not None:
        parts.append(section(actions, "case_id", "action", ["action_id"], None, {
            "action_type": f("action_type"), "target": f("target"), "success": f("success")}))
    return reduce(lambda a, b: a.unionByName(b), parts)


def findings_section(rows: DataFrame, case: str, name: str, values: dict[str, Column]) -> DataFrame:
    """Findings of a forensic report: one row per key, as (case_id, section, item, value)."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(k).alias("item"), v.cast("string").alias("value")) for k, v in values.items()]))
    return rows.select(F.col(case).alias("case_id"), F.lit(name).alias("section"), pairs.alias("p")) \
               .select("case_id", "section", "p.item", "p.value")
