"""Rules as Spark SQL predicates over the columns of an event table.

A rule carries its condition as SQL text. The same text builds the Column of a
scan and fills the rule catalogue, so what is listed is what runs.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, replace
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """gate: a cheap test that the predicate implies; a scan tries the rules of one gate only on rows that pass it."""

    rule_id: str
    title: str
    severity: str
    predicate: str
    level: int | None = None
    technique: str | None = None
    groups: str = ""
    gate: str = "true"

    def column(self) -> Column:
        return F.coalesce(F.expr(self.predicate), F.lit(False))


def quote(value) -> str:
    """A Spark SQL string literal."""
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_of(column: str | None) -> str:
    """SQL text of a field: empty text where the field is NULL or the table lacks it."""
    return "''" if column is None else f"coalesce(cast(`{column}` as string), '')"


def matches(column: str | None, pattern: str, negate: bool = False) -> str:
    test = f"{text_of(column)} rlike {quote(pattern)}"
    return f"(not ({test}))" if negate else f"({test})"


def contains(column: str | None, value: str) -> str:
    return f"contains(lower({text_of(column)}), {quote(str(value).lower())})"


def starts(column: str | None, value: str) -> str:
    return f"startswith(lower({text_of(column)}), {quote(str(value).lower())})"


def ends(column: str | None, value: str) -> str:
    return f"endswith(lower({text_of(column)}), {quote(str(value).lower())})"


def equals(column: str | None, value) -> str:
    return f"(lower({text_of(column)}) = {quote(str(value).lower())})"


def all_of(parts: list[str]) -> str:
    return "(" + " and ".join(parts) + ")" if parts else "true"


def any_of(parts: list[str]) -> str:
    return "(" + " or ".join(parts) + ")" if parts else "false"


LOWERED = re.compile(r"lower\(coalesce\(cast\(`([^`]+)` as string\), ''\)\)")


def _lowered_once(events: DataFrame, rules: list[Rule]) -> tuple[DataFrame, list[Rule]]:
    """Events with a lower-case column for each field that several tests lower, and the rules reading those columns."""
    uses = Counter(field for r in rules for field in LOWERED.findall(r.predicate))
    taken = {c.lower() for c in events.columns}
    free = (name for name in map("_low{}".format, count()) if name not in taken)
    names = {field: next(free) for field, n in uses.items() if n > 1}
    if not names:
        return events, rules
    columns = {name: F.expr(f"lower({text_of(field)})") for field, name in names.items()}
    reads = lambda m: f"`{names[m[1]]}`" if m[1] in names else m[0]
    return events.withColumns(columns), [replace(r, predicate=LOWERED.sub(reads, r.predicate)) for r in rules]


def scan(events: DataFrame, rules: list[Rule], keep: list[str]) -> DataFrame:
    """One row per event and rule that matches, in a single pass over the events.

    Rules are grouped by their gate, and a row meets only the rules of the gates it passes; a field that several
    tests read in lower case is lowered once. The matching rules become an array of structs with the rule's metadata as
    literals, which is then exploded. No join, no shuffle, one scan for any number of rules.
    """
    if not rules:
        raise ValueError("a scan needs at least one rule")
    prepared, rules = _lowered_once(events, rules)
    gates: dict[str, list[Column]] = {}
    for r in rules:
        gates.setdefault(r.gate, []).append(F.when(r.column(), F.struct(
            F.lit(r.rule_id).alias("rule_id"), F.lit(r.title).alias("title"),
            F.lit(r.severity).alias("severity"), F.lit(r.level).cast("int").alias("level"),
            F.lit(r.technique).cast("string").alias("mitre"))))
    hits = [F.when(F.expr(gate), F.array_compact(F.array(*tests))) for gate, tests in gates.items()]
    # explode drops rows without a hit, so no separate filter repeats the predicates.
    found = prepared.select(*keep, F.explode(F.flatten(F.array_compact(F.array(*hits)))).alias("hit"))
    return found.select(*keep, "hit.*")


def catalogue(spark, rules: list[Rule]) -> DataFrame:
    """Rule table: id, title, level, severity, technique, groups and predicate text."""
    rows = [(r.rule_id, r.title, r.level, r.severity, r.technique, r.groups, r.predicate) for r in rules]
    return spark.createDataFrame(
        rows, "rule_id string, title string, level int, severity string, mitre string, groups string, predicate string")


def coverage(rules_table: DataFrame, hits: DataFrame) -> DataFrame:
    """Detections per technique: rules, highest level, and hits (0 where nothing fired)."""
    fired = hits.groupBy("rule_id").agg(F.count("*").alias("hits"))
    return rules_table.join(fired, "rule_id", "left").groupBy("mitre").agg(
        F.count("*").alias("rules"), F.max("level").alias("max_level"),
        F.sum(F.coalesce("hits", F.lit(0))).alias("hits"))
