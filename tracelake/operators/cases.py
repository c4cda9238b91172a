"""Cases: tasks, notes, phases, containment actions, deadlines, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.content.cases import CASE_CATEGORIES, CASE_SEVERITIES, PHASES, TASK_TEMPLATES
from tracelake.content.lookups import NOTIFICATION_DEADLINES
from tracelake.functions.hashing import stable_id
from tracelake.functions.text import cut
from tracelake.operators.ordered import Sizes, first_per_group, with_next, with_position


def valid_cases(cases: DataFrame) -> DataFrame:
    """Cases whose phase, severity and category are known values."""
    return cases.where(F.col("current_phase").isin(PHASES) & F.col("severity").isin(CASE_SEVERITIES)
                       & F.col("category").isin(CASE_CATEGORIES))


def next_phase(phase) -> Column:
    """Phase after this one; the last phase stays."""
    phase = F.col(phase) if isinstance(phase, str) else phase
    pairs = [x for a, b in zip(PHASES, PHASES[1:]) for x in (F.lit(a), F.lit(b))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), phase), phase)


def seed_tasks(cases: DataFrame, phase: str = "current_phase") -> DataFrame:
    """Template tasks of the phase each case enters (25 templates, held on the plan)."""
    templates = cases.sparkSession.createDataFrame(
        TASK_TEMPLATES, "phase string, seq int, title string, priority string, description string")
    out = cases.select("case_id", F.col(phase).alias("phase"), "lead_analyst") \
               .join(F.broadcast(templates), "phase")  # 25 rows, fixed
    return out.select(stable_id("T-", "case_id", "phase", "seq", length=6).alias("task_id"), "case_id", "phase",
                      "seq", "title", "description", "priority", F.col("lead_analyst").alias("assigned_to"),
                      F.lit("pending").alias("status"))


def open_tasks(tasks: DataFrame, phase: str | None = None) -> DataFrame:
    out = tasks.where(F.col("status") != "completed")
    return out if phase is None else out.where(F.col("phase") == phase)


def last_notes(notes: DataFrame, n: int | None = None, order=("ts", "note_id")) -> DataFrame:
    """Notes per case, newest first: the newest n, or all."""
    return first_per_group(notes, ["case_id"], [F.desc(c) for c in order], n)


def phase_durations(log: DataFrame, sizes: Sizes | None = None) -> DataFrame:
    """Seconds each case stayed in the phase of each log row (NULL for the last)."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    out = with_next(log.withColumn("_at", at), ["case_id"], ["ts", "phase"], F.col("_at"), "_then", sizes)
    seconds = ((F.col("_then") - F.col("_at")) / 1_000_000).cast("bigint")
    return out.withColumn("seconds", seconds).drop("_at", "_then")


def status_rows(cases: DataFrame, tasks: DataFrame, notes: DataFrame, indicators: DataFrame,
                last: int | None = None, width: int | None = None) -> DataFrame:
    """Status of each case as rows (case_id, section, rank, text)."""
    counts = (
        cases.select("case_id")
        .join(open_tasks(tasks).groupBy("case_id").agg(F.count("*").alias("tasks")), "case_id", "left")
        .join(indicators.groupBy("case_id").agg(F.count_distinct("value").alias("iocs")), "case_id", "left"))
    head = counts.select("case_id", F.lit("summary").alias("section"), F.lit(1).cast("bigint").alias("rank"),
                         F.concat(F.lit("IOCs: "), F.coalesce("iocs", F.lit(0)).cast("string"),
                                  F.lit(", Open Tasks: "), F.coalesce("tasks", F.lit(0)).cast("string")).alias("text"))
    todo = open_tasks(tasks).select(
        "case_id", F.lit("open_task").alias("section"), F.col("seq").cast("bigint").alias("rank"),
        F.concat(F.lit("["), F.upper("priority"), F.lit("] "), F.col("task_id"), F.lit(": "), F.col("title"),
                 F.lit(" (assigned: "), F.col("assigned_to"), F.lit(")")).alias("text"))
    said = last_notes(notes, last).select(
        "case_id", F.lit("note").alias("section"), F.col("rank").cast("bigint").alias("rank"),
        F.concat(F.lit("["), F.col("ts").cast("string"), F.lit("] "), F.col("author"), F.lit(": "),
                 cut("content", width)).alias("text"))
    return head.unionByName(todo).unionByName(said)


def numbered(rows: DataFrame, keys: list[str], order: list[str], prefix: str, start: int = 1,
             width: int = 4, name: str = "action_id", sizes: Sizes | None = None) -> DataFrame:
    """PREFIX-0001 style ids in order within the keys."""
    out = with_position(rows, keys, order, "_n", sizes)
    number = (F.col("_n") + (start - 1)).cast("string")
    padded = F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number)
    return out.withColumn(name, F.concat(F.lit(f"{prefix}-"), padded)).drop("_n")


def reversal_guide(actions: DataFrame) -> DataFrame:
    """Undo line of each reversible action that has a command.

    Undoing an address block removes the inbound rule only; the note says so.
    """
    undo = actions.where(F.col("reversible") & F.col("reversal_command").isNotNull()
                         & (F.col("reversal_command") != ""))
    note = F.when(F.col("action_type") == "block_ip", "inbound rule only; remove the outbound rule as well")
    return undo.select(
        "action_id",
        F.concat(F.lit("["), F.col("action_type"), F.lit("] "), F.col("target")).alias("line"),
        F.concat(F.lit("Reversal: "), F.col("reversal_command")).alias("reversal"), note.alias("note"))


def notification_deadlines(breaches: DataFrame, key: str, ts: str) -> DataFrame:
    """Latest notification time per breach and regime."""
    regimes = F.explode(F.array(*[
        F.struct(F.lit(r).alias("regime"), F.lit(h).alias("hours"), F.lit(w).alias("notify"))
        for r, h, w in NOTIFICATION_DEADLINES]))
    out = breaches.select(key, ts, regimes.alias("r"))
    due = F.expr(f"{ts} + make_interval(0, 0, 0, 0, r.hours)")
    return out.select(key, "r.regime", "r.notify", due.alias("deadline"))
