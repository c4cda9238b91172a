"""Sigma rules as predicates.

The default mode reads selectors as the format defines them: field modifiers,
numeric equality, and conditions with and, or, not and parentheses. A condition
is already a boolean expression of selector names, so each name is replaced by
the SQL text of its selector and Spark evaluates the rest.

compat mode answers as the first tool of this kind did: numbers are ignored,
field names with a modifier never match, and a condition is cut at the letters
"and" or "or" without regard to words.
"""

from __future__ import annotations

import fnmatch
import re
from pathlib import Path

from tracelake.content.sigma_docs import SIGMA_DOCS, SIGMA_FIELDS, SIGMA_LEVELS
from tracelake.rules.predicates import Rule, all_of, any_of, contains, ends, equals, matches, starts

SEVERITIES = {"informational": "info", "low": "low", "medium": "medium", "high": "high", "critical": "critical"}
OPERATORS = {"and", "or", "not"}


class Fields:
    """Rule field names -> columns of the table; unknown names read as empty text."""

    def __init__(self, mapping=None, columns=None, event_text: str | None = None):
        self.mapping = SIGMA_FIELDS if mapping is None else mapping
        self.columns = columns
        self.event_text = event_text

    def column(self, name: str) -> str | None:
        column = self.mapping.get(name, name if self.columns and name in self.columns else None)
        return None if self.columns is not None and column not in self.columns else column


def _unescape(value) -> str:
    """A doubled backslash stands for one."""
    return str(value).replace("\\\\", "\\")


def _value_test(column, value, modifiers) -> str:
    if isinstance(value, (int, float)) and not isinstance(value, bool) and not modifiers:
        return equals(column, value)
    if "re" in modifiers:
        return matches(column, str(value))
    value = _unescape(value)
    if "startswith" in modifiers:
        return starts(column, value)
    if "endswith" in modifiers:
        return ends(column, value)
    return contains(column, value)


def _selector(selector, fields: Fields) -> str:
    if isinstance(selector, dict):
        tests = []
        for name, value in selector.items():
            field, *modifiers = name.split("|")
            column = fields.column(field)
            values = value if isinstance(value, list) else [value]
            each = [_value_test(column, v, modifiers) for v in values]
            tests.append(all_of(each) if "all" in modifiers else any_of(each))
        return all_of(tests)
    if isinstance(selector, list):
        return any_of([_selector(s, fields) for s in selector])
    return contains(fields.event_text, str(selector)) if fields.event_text else "false"


def _selector_compat(selector, fields: Fields) -> str:
    if isinstance(selector, dict):
        tests = []
        for name, value in selector.items():
            column = None if "|" in name else fields.column(name)
            if isinstance(value, list):
                tests.append(any_of([contains(column, v) for v in value]))
            elif isinstance(value, str):
                tests.append(contains(column, value))
        return all_of(tests)
    if isinstance(selector, list):
        return any_of([_selector_compat(s, fields) for s in selector])
    if isinstance(selector, str) and fields.event_text:
        return contains(fields.event_text, selector)
    return "false"


def _amount(count: str, pattern: str, parts: dict[str, str]) -> str:
    """`1 of sel*`, `all of them`: so many of the selectors whose names fit."""
    if pattern.lower() == "them":
        chosen = [p for n, p in parts.items() if not n.startswith("_")]
    else:
        chosen = [p for n, p in parts.items() if fnmatch.fnmatchcase(n, pattern)]
    if not chosen:
        raise ValueError(f"no selector fits {pattern!r}")
    if count == "all":
        return all_of(chosen)
    if int(count) == 1:
        return any_of(chosen)
    return "(" + " + ".join(f"int(coalesce({p}, false))" for p in chosen) + f" >= {int(count)})"


def _condition(condition: str, parts: dict[str, str]) -> str:
    """SQL of a condition: selector names, and, or, not, parentheses, N of a pattern, all of a pattern.

    Anything else raises ValueError, so that one bad rule cannot spoil the SQL of a scan.
    """
    tokens = re.findall(r"[A-Za-z0-9_*?-]+|[()]|\S", condition)
    at, out = 0, []

    def take() -> str:
        nonlocal at
        if at == len(tokens):
            raise ValueError(f"condition ends too early: {condition!r}")
        at += 1
        return tokens[at - 1]

    def operand() -> None:
        word = take()
        low = word.lower()
        if low == "not":
            out.append("not")
            operand()
        elif word == "(":
            out.append("(")
            chain()
            if take() != ")":
                raise ValueError(f"parenthesis left open: {condition!r}")
            out.append(")")
        elif (low == "all" or low.isdigit()) and at < len(tokens) and tokens[at].lower() == "of":
            take()
            out.append(_amount(low, take(), parts))
        elif re.fullmatch(r"[A-Za-z_][A-Za-z0-9_-]*", word) and low not in OPERATORS:
            out.append(parts.get(word, "false"))
        else:
            raise ValueError(f"unexpected {word!r} in condition {condition!r}")

    def chain() -> None:
        operand()
        while at < len(tokens) and tokens[at].lower() in ("and", "or"):
            out.append(take().lower())
            operand()

    chain()
    if at < len(tokens):
        raise ValueError(f"unexpected {tokens[at]!r} in condition {condition!r}")
    return "(" + " ".join(out) + ")"


def _condition_compat(condition: str, parts: dict[str, str]) -> str:
    pick = lambda word: parts.get(word.strip(), "false")
    if condition == "selection":
        return pick(condition)
    for letters, combine in (("and", all_of), ("or", any_of)):
        if letters in condition:
            return combine([pick(w) for w in condition.split(letters)])
    return f"(not {pick(condition.replace('not', ''))})" if "not" in condition else "false"


def technique_of(tags) -> str | None:
    tagged = [t for t in tags or [] if t.startswith("attack.t")]
    return tagged[0].removeprefix("attack.").upper() if tagged else None


def sigma_rule(doc: dict, fields: Fields | None = None, compat: bool = False) -> Rule:
    fields = fields or Fields()
    detection = dict(doc["detection"])
    condition = detection.pop("condition", "selection")
    read = _selector_compat if compat else _selector
    parts = {name: read(body, fields) for name, body in detection.items()}
    predicate = (_condition_compat if compat else _condition)(condition, parts)
    level = doc.get("level", "medium")
    return Rule(str(doc.get("id", "")), doc.get("title", "Unknown"), SEVERITIES.get(level, "medium"),
                predicate, SIGMA_LEVELS.get(level, 5), technique_of(doc.get("tags")), f"sigma,{level}")


def shipped_sigma_rules(fields: Fields | None = None, compat: bool = False) -> list[Rule]:
    return [sigma_rule(d, fields, compat) for d in SIGMA_DOCS]


def load_sigma(path: str, fields: Fields | None = None, compat: bool = False,
               recursive: bool = True) -> tuple[list[Rule], list[str]]:
    """Rules of a YAML file or folder, every document of each file, and what could not be read."""
    try:
        import yaml
    except ImportError as error:
        raise ImportError("reading Sigma files needs PyYAML") from error
    root = Path(path)
    pattern = "**/*.yml" if recursive else "*.yml"
    rules, problems = [], []
    for file in [root] if root.is_file() else sorted(root.glob(pattern)):
        try:
            for doc in yaml.safe_load_all(file.read_text(encoding="utf-8")):
                if isinstance(doc, dict) and "detection" in doc:
                    try:
                        rules.append(sigma_rule(doc, fields, compat))
                    except (ValueError, TypeError, AttributeError) as error:
                        problems.append(f"{file}: {doc.get('id', doc.get('title', 'a rule'))}: {error}")
        except yaml.YAMLError as error:
            problems.append(f"{file}: {error}")
    return rules, problems
