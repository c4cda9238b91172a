"""Hunt hypotheses: detectors that turn events into findings.

Findings share one schema: rule_id, title, ts, host, description, evidence,
severity, mitre, event_id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.content import messages
from tracelake.content.hunts import (
    DGA_MIN_ENTROPY, DGA_MIN_LABEL, DGA_MIN_QUERIES, ENCODED_COMMAND, HYPOTHESES, LOLBIN_ARGUMENTS,
    LOLBINS, LSASS_SAFE_BASENAMES, LSASS_SAFE_WORDS, TRUSTED_DNS_SUFFIXES,
)
from tracelake.functions.paths import file_name
from tracelake.functions.text import contains_any, cut, fill, first_label, one_of, text_entropy
from tracelake.operators.ordered import Ordered, Sizes


HYPOTHESIS = {h[0]: h for h in HYPOTHESES}
FINDING = ["rule_id", "title", "ts", "host", "description", "evidence", "severity", "mitre", "event_id"]


def _finding(rule_id: str, description: Column, evidence: dict[str, Column]) -> Column:
    _, title, technique, severity = HYPOTHESIS[rule_id]
    pairs = [x for k, v in evidence.items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(
        F.lit(rule_id).alias("rule_id"), F.lit(title).alias("title"), description.alias("description"),
        F.create_map(*pairs).alias("evidence"), F.lit(severity).alias("severity"), F.lit(technique).alias("mitre"))


def lolbin_findings(image="image", cmdline="cmdline", parent="parent_image", width: int | None = None) -> Column:
    """HYP-001: one finding per living-off-the-land binary named by the image."""
    image, parent = F.lower(F.col(image)), F.lower(F.col(parent))
    names = F.when(contains_any(cmdline, LOLBIN_ARGUMENTS), one_of(image, LOLBINS)) \
             .otherwise(F.array().cast("array<string>"))
    made = _finding("HYP-001", fill(messages.HUNT_LOLBIN, image),
                    {"image": image, "cmdline": cut(cmdline, width), "parent": parent})
    return F.transform(names, lambda _: made)


def lsass_test(target="target_image", source="source_image", compat: bool = False) -> Column:
    """HYP-002. compat clears a source by any safe word, also within its folder names."""
    target, source = F.lower(F.col(target)), F.lower(F.col(source))
    if compat:
        return target.contains("lsass.exe") & ~contains_any(source, LSASS_SAFE_WORDS)
    words = [w for w in LSASS_SAFE_WORDS if w != "system"]
    name = file_name(source)
    return target.contains("lsass.exe") & ~contains_any(name, words) & ~name.isin(LSASS_SAFE_BASENAMES)


def lsass_finding(target="target_image", source="source_image") -> Column:
    source_low = F.lower(F.col(source))
    return _finding("HYP-002", fill(messages.HUNT_LSASS, source_low),
                    {"source": source_low, "target": F.lower(F.col(target))})


def encoded_shell_test(image="image", cmdline="cmdline") -> Column:
    """HYP-003: PowerShell with an encoded command of at least 20 characters."""
    return F.lower(F.col(image)).contains("powershell") & F.col(cmdline).rlike(ENCODED_COMMAND)


def encoded_shell_finding(cmdline="cmdline", width: int | None = None) -> Column:
    return _finding("HYP-003", F.lit(messages.HUNT_ENCODED_SHELL), {"cmdline": cut(cmdline, width)})


def lateral_movement_test(code="event_code", service="service_name", parent="parent_image",
                          image="image") -> Column:
    """HYP-004: remote-execution service installed, or WMI host process starting a shell."""
    service_made = (F.col(code).cast("string") == "7045") & F.lower(F.col(service)).contains("psexesvc")
    shells = F.lower(F.col(image)).rlike(r"\\(cmd|powershell|cscript|wscript|mshta)\.exe$")
    return F.coalesce(service_made, F.lit(False)) \
        | F.coalesce(F.lower(F.col(parent)).endswith("\\wmiprvse.exe") & shells, F.lit(False))


def off_hours(ts, start: int = 8, end: int = 18) -> Column:
    """Outside [start, end) on weekdays, or at any time on Saturday or Sunday."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.dayofweek(ts).isin(1, 7) | (F.hour(ts) < start) | (F.hour(ts) >= end)


def task_off_hours_test(code="event_code", ts="ts", start: int = 8, end: int = 18) -> Column:
    """HYP-005: scheduled task created outside business hours."""
    return (F.col(code).cast("string") == "4698") & off_hours(ts, start, end)


def event_findings(events: DataFrame, compat: bool = False, shell_image="image", shell_cmdline="cmdline",
                   only: list[str] | None = None, widths: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """All hypotheses that look at one event at a time, in a single scan.

    events: event_id, ts, host, event_code, image, cmdline, parent_image,
    target_image, source_image, service_name. widths: characters of the command
    line kept as evidence of HYP-001 and HYP-003; None keeps all.
    """
    none = F.array()
    single = lambda test, finding: F.when(test, F.array(finding))
    parts = {
        "HYP-001": lolbin_findings(width=widths[0]),
        "HYP-002": single(lsass_test(compat=compat), lsass_finding()),
        "HYP-003": single(encoded_shell_test(shell_image, shell_cmdline), encoded_shell_finding(shell_cmdline, widths[1])),
        "HYP-004": single(lateral_movement_test(), _finding(
            "HYP-004", F.lit("Remote execution from another host"),
            {"service": F.col("service_name"), "parent": F.col("parent_image"), "image": F.col("image")})),
        "HYP-005": single(task_off_hours_test(), _finding(
            "HYP-005", F.lit("Scheduled task created outside business hours"), {"task": F.col("task_content")})),
    }
    shape = "array<struct<rule_id:string,title:string,description:string,evidence:map<string,string>," \
            "severity:string,mitre:string>>"
    lists = [F.coalesce(parts[k].cast(shape), none.cast(shape)) for k in parts if only is None or k in only]
    found = events.select("event_id", "ts", "host", F.explode(F.flatten(F.array(*lists))).alias("f"))
    return found.select("f.rule_id", "f.title", "ts", "host", "f.description", "f.evidence", "f.severity",
                        "f.mitre", "event_id")


def query_counts(queries: DataFrame, name: str = "query_name", trusted=None) -> DataFrame:
    """Queries per exact name; names under a trusted suffix are left out (case matters)."""
    out = queries.where(F.col(name).isNotNull() & (F.col(name) != ""))
    for suffix in TRUSTED_DNS_SUFFIXES if trusted is None else trusted:
        out = out.where(~F.col(name).endswith(suffix))
    return out.groupBy(name).agg(F.count("*").alias("queries"))


def generated_names(queries: DataFrame, name: str = "query_name", min_label: int = DGA_MIN_LABEL,
                    min_entropy: float = DGA_MIN_ENTROPY, min_queries: int = DGA_MIN_QUERIES) -> DataFrame:
    """HYP-006: names that look generated. The count runs first, so entropy is
    computed once per distinct name."""
    counted = query_counts(queries, name).where(F.col("queries") >= min_queries)
    label = first_label(name)
    scored = counted.withColumn("label", label).where(F.length("label") >= min_label) \
                    .withColumn("entropy", text_entropy("label"))
    return scored.where(F.col("entropy") > min_entropy)


def generated_name_findings(candidates: DataFrame, name: str, as_of: Column) -> DataFrame:
    _, title, technique, severity = HYPOTHESIS["HYP-006"]
    return candidates.select(
        F.lit("HYP-006").alias("rule_id"), F.lit(title).alias("title"), as_of.alias("ts"),
        F.lit("network").alias("host"),
        fill(messages.HUNT_GENERATED_NAME, F.col(name), F.format_string("%.2f", F.col("entropy")),
             F.col("queries")).alias("description"),
        F.create_map(F.lit("domain"), F.col(name), F.lit("query_count"), F.col("queries").cast("string"),
                     F.lit("entropy"), F.col("entropy").cast("string")).alias("evidence"),
        F.lit(severity).alias("severity"), F.lit(technique).alias("mitre"),
        F.lit(None).cast("bigint").alias("event_id"))


def login_baseline(logins: DataFrame, user: str = "user_name", ts: str = "ts") -> DataFrame:
    """Share of each hour in the history of each user: at most 24 rows per user."""
    hourly = logins.groupBy(user, F.hour(ts).alias("hour")).agg(F.count("*").alias("logins"))
    total = hourly.groupBy(user).agg(F.sum("logins").alias("total"))
    return hourly.join(total, user).withColumn("share", F.col("logins") / F.col("total"))


def unusual_logins(logins: DataFrame, user: str = "user_name", ts: str = "ts", max_share: float = 0.02,
                   min_history: int = 20) -> DataFrame:
    """HYP-007: logins at hours that make up a small share of the user's history."""
    base = login_baseline(logins, user, ts).where(
        (F.col("share") <= max_share) & (F.col("total") >= min_history))
    return logins.withColumn("hour", F.hour(ts)).join(base.select(user, "hour", "logins", "total", "share"),
                                                      [user, "hour"])


def unusual_logins_so_far(logins: DataFrame, user: str = "user_name", ts: str = "ts", order: list[str] = ("event_id",), max_share: float = 0.02,
                          min_history: int = 20, sizes: Sizes | None = None) -> DataFrame:
    """HYP-007 as the logins come: each is judged by the user's earlier ones only, never by itself or by what came later.

    logins and total count earlier rows: at that hour, and in all. order breaks ties of ts. A user's histogram of 24 hours
    goes from chunk to chunk, so an account that makes a third of all logins is spread over many tasks.
    """
    rows = logins.where(F.col(ts).isNotNull()).withColumn("hour", F.hour(ts))
    seen = Ordered(rows, [user], [ts, *order], sizes).count_same(F.col("hour"), "logins").position("total").rows()
    seen = seen.withColumns({"logins": F.col("logins") - 1, "total": F.col("total") - 1})
    return seen.withColumn("share", F.try_divide("logins", "total")).where((F.col("total") >= min_history) & (F.col("share") <= max_share))


def unusual_login_findings(rows: DataFrame, user: str = "user_name", ts: str = "ts", host: str = "host") -> DataFrame:
    """HYP-007: rows of unusual_logins as findings."""
    _, title, technique, severity = HYPOTHESIS["HYP-007"]
    return rows.select(
        F.lit("HYP-007").alias("rule_id"), F.lit(title).alias("title"), F.col(ts).alias("ts"), F.col(host).alias("host"),
        fill(messages.HUNT_LOGIN_TIME, F.col(user), F.col("hour"), F.col("logins"), F.col("total")).alias("description"),
        F.create_map(F.lit("user"), F.col(user).cast("string"), F.lit("hour"), F.col("hour").cast("string"),
                     F.lit("share"), F.round("share", 6).cast("string")).alias("evidence"),
        F.lit(severity).alias("severity"), F.lit(technique).alias("mitre"), F.col("event_id").cast("bigint").alias("event_id"))


def custom_hunt(events: DataFrame, title: str, hunt: Callable[[DataFrame], DataFrame], technique: str = "",
                severity: str = "medium", as_of: Column | None = None) -> DataFrame:
    """Findings of a user's function over the events: host defaults to unknown,
    description to the title, and all columns of its rows become the evidence."""
    rows = events.transform(hunt)
    have = set(rows.columns)
    pick = lambda c, default: F.coalesce(F.col(c).cast("string"), F.lit(default)) if c in have else F.lit(default)
    pairs = [x for c in rows.columns for x in (F.lit(c), F.col(c).cast("string"))]
    ts = F.col("ts") if "ts" in have else (as_of if as_of is not None else F.lit(None).cast("timestamp"))
    return rows.select(
        F.lit("CUSTOM").alias("rule_id"), F.lit(title).alias("title"), ts.alias("ts"),
        pick("host", "unknown").alias("host"), pick("description", title).alias("description"),
        F.create_map(*pairs).alias("evidence"), F.lit(severity).alias("severity"),
        F.lit(technique).alias("mitre"),
        (F.col("event_id").cast("bigint") if "event_id" in have else F.lit(None).cast("bigint")).alias("event_id"))


def all_findings(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [p.select(*FINDING) for p in parts])
