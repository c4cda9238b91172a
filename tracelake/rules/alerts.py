"""Alert rules: shipped content, XML loader, frequency rules."""

from __future__ import annotations

import xml.etree.ElementTree as ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.content.alert_rules import ALERT_FIELDS, ALERT_RULES, FREQUENCY_RULES
from tracelake.operators.ordered import count_within
from tracelake.rules.predicates import Rule, all_of, matches, scan


def level_name(level: int) -> str:
    for least, name in ((12, "critical"), (9, "high"), (6, "medium"), (3, "low")):
        if level >= least:
            return name
    return "info"


def gate(source: str) -> str:
    """Which log source an event must come from: 'sysmon', 'windows', or one event code of sysmon."""
    if source.startswith("sysmon_event"):
        return f"(channel = 'sysmon' and event_code = {int(source.removeprefix('sysmon_event'))})"
    return f"(channel = '{source}')"


def alert_rule(rule_id, level, technique, title, source, conditions, groups="", fields=None, columns=None) -> Rule:
    fields = fields or ALERT_FIELDS
    tests = []
    for field, pattern, *flag in conditions:
        column = fields.get(field)
        if columns is not None and column not in columns:
            column = None
        tests.append(matches(column, pattern, negate=bool(flag)))
    return Rule(rule_id, title, level_name(level), all_of([gate(source), *tests]), level, technique, groups, gate(source))


def shipped_alert_rules() -> list[Rule]:
    return [alert_rule(*row) for row in ALERT_RULES]


def load_alert_rules(path: str, fields=None) -> tuple[list[Rule], list[tuple]]:
    """Rules of an alert-rule XML file: plain rules, and frequency rules as rows. A broken file raises ValueError with its name."""
    try:
        root = ElementTree.parse(path).getroot()
    except ElementTree.ParseError as error:
        raise ValueError(f"{path}: {error}") from error
    plain, frequent = [], []
    for node in root.iter("rule"):
        rule_id, level = node.get("id"), int(node.get("level"))
        technique = node.findtext("mitre/id")
        title, groups = node.findtext("description") or "", node.findtext("group") or ""
        if node.get("frequency"):
            frequent.append((rule_id, level, technique, title, node.findtext("if_matched_sid"),
                             int(node.get("frequency")), int(node.get("timeframe")), groups))
            continue
        conditions = [
            (f.get("name"), f.text, "not") if f.get("negate") == "yes" else (f.get("name"), f.text)
            for f in node.findall("field")]
        plain.append(alert_rule(rule_id, level, technique, title, node.findtext("if_group"), conditions,
                                groups, fields))
    return plain, frequent


def scan_alerts(events: DataFrame, keep: list[str], rules: list[Rule] | None = None) -> DataFrame:
    return scan(events, rules or shipped_alert_rules(), keep)


def frequency_hits(hits: DataFrame, host: str = "host", ts: str = "ts", rules=None) -> DataFrame:
    """Hosts and times at which a counted rule reached its number of hits in its time frame."""
    out = None
    for rule_id, level, technique, title, counted, times, seconds, _ in rules or FREQUENCY_RULES:
        rows = hits.where(F.col("rule_id") == counted).select(host, ts)
        found = count_within(rows, [host], ts, seconds).where(F.col("hits") >= times).select(
            F.lit(rule_id).alias("rule_id"), F.lit(level).alias("level"), F.lit(technique).alias("mitre"),
            host, ts, "hits")
        out = found if out is None else out.unionByName(found)
    return out
