"""Telemetry collection policy: which events to keep."""

from __future__ import annotations

import xml.etree.ElementTree as ElementTree

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.content.collection_policy import COLLECTION_POLICY, POLICY_FIELDS
from tracelake.rules.predicates import Rule, all_of, any_of, contains, ends, equals

TESTS = {"is": equals, "contains": contains, "end with": ends}


def of_codes(codes) -> str:
    return f"event_code in ({', '.join(str(c) for c in codes)})"


def kept(codes, include, exclude, fields=None, columns=None) -> str:
    """Predicate of one event kind: any include, and no exclude."""
    fields = fields or POLICY_FIELDS

    def test(field, operator, value):
        if operator not in TESTS:
            raise ValueError(f"unknown condition {operator!r} of field {field!r}; known: {', '.join(sorted(TESTS))}")
        column = fields.get(field)
        return TESTS[operator](column if columns is None or column in columns else None, value)

    parts = [of_codes(codes)]
    if include:
        parts.append(any_of([test(*c) for c in include]))
    if exclude:
        parts.append("(not " + any_of([test(*c) for c in exclude]) + ")")
    return all_of(parts)


def policy_kinds(columns=None, policy=None, fields=None) -> dict[str, str]:
    return {kind: kept(*body, fields=fields, columns=columns)
            for kind, body in (policy or COLLECTION_POLICY).items()}


def policy_rules(columns=None, policy=None, fields=None) -> list[Rule]:
    """The policy as rules of a scan, one per event kind."""
    policy = policy or COLLECTION_POLICY
    return [Rule(kind, kind, "info", predicate, gate=of_codes(policy[kind][0]))
            for kind, predicate in policy_kinds(columns, policy, fields).items()]


def collected(events: DataFrame, policy=None, fields=None) -> DataFrame:
    """Events the policy keeps, with the event kind that kept them."""
    chain = None
    for kind, predicate in policy_kinds(events.columns, policy, fields).items():
        hit = F.expr(predicate)
        chain = F.when(hit, kind) if chain is None else chain.when(hit, kind)
    return events.withColumn("collected_as", chain).where(F.col("collected_as").isNotNull())


# Event codes of the policy's element names.
EVENT_CODES = {kind: body[0] for kind, body in COLLECTION_POLICY.items()}


def _root(path: str) -> ElementTree.Element:
    try:
        return ElementTree.parse(path).getroot()
    except ElementTree.ParseError as error:
        raise ValueError(f"{path}: {error}") from error


def load_policy(path: str) -> dict[str, tuple]:
    """Policy of a telemetry configuration XML file. A broken file raises ValueError with its name."""
    out: dict[str, list] = {}
    for group in _root(path).iter("RuleGroup"):
        for node in group:
            if node.tag not in EVENT_CODES:
                continue
            body = out.setdefault(node.tag, [EVENT_CODES[node.tag], [], []])
            target = body[1] if node.get("onmatch") == "include" else body[2]
            target += [(c.tag, c.get("condition"), c.text) for c in node]
    return {kind: tuple(body) for kind, body in out.items()}
