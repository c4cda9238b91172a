"""Chat formatting: a finite-state machine over roles walks the turns of a conversation and emits text segments.

A template declares the marks around the text of each role, whether that text is under the loss, and which role may follow
which. The machine's state is the role of the turn before; a turn that may not follow is emitted all the same, with fits = false, and
the machine goes on from it.

Texts and foreign role names may hold the template's marks. Each look-alike gets a backslash after its first character, and look-alikes that have
backslashes there get one more, so no text holds a mark, and taking one backslash away gives the text back exactly.

Rows are dealt by conversation and sorted by turn once; a task then streams through them and holds one row at a time, so a
conversation of any length takes bounded memory. Its rows do go through one task: the digest of a whole conversation
depends on their order. Reading back works on the formatted rows alone.

Defined results: null texts and roles are empty ones. Turns with equal numbers are ordered by role, then text; turns without a number come
last. Repeated rows are turns of their own. Rows without a conv_id form one conversation. Roles that the template does not name
have marks that carry the name, and fit nowhere. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Anything that looks like a mark: its first character, backslashes, the rest.
MARK = r"([<\[])(\\*)(/?(?:s>|(?:INST|SYS|ROLE)\]))"
_MARK, _ESCAPED = re.compile(MARK), re.compile(MARK.replace(r"(\\*)", r"\\(\\*)"))


@dataclass(frozen=True)
class Role:
    """Marks before and after a text, and whether the text is under the loss."""

    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """roles by name. follows: (state, role) pairs that are allowed; the first state is "". ends: states a conversation may end in."""

    roles: dict[str, Role] = field(default_factory=lambda: {
        "system": Role("[SYS] ", " [/SYS]"),
        "user": Role("<s>[INST] ", " [/INST]"),
        "assistant": Role(" ", "</s>", loss=True),
    })
    other: Role = Role("[ROLE] {role} [/ROLE] ", "[/ROLE]")
    follows: frozenset[tuple[str, str]] = frozenset({("", "system"), ("", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")})
    ends: frozenset[str] = frozenset({"assistant"})


def escaped(text: str) -> str:
    return _MARK.sub(r"\1\\\2\3", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


class Machine:
    """Walks the turns of one conversation."""

    def __init__(self, template: Template):
        self.template, self.state = template, ""

    def turn(self, role: str, text: str) -> tuple[bool, list[tuple[str, bool]]]:
        """(whether the turn may stand here, its segments (text, under the loss))"""
        fits = (self.state, role) in self.template.follows
        self.state = role
        marks = self.template.roles.get(role)
        if marks is None:
            marks = self.template.other
            marks = Role(marks.opens.replace("{role}", escaped(role)), marks.closes)
        return fits, [(marks.opens, False), (escaped(text), marks.loss), (marks.closes, False)]


class Reader:
    """Takes a turn's formatted text apart by its marks."""

    def __init__(self, template: Template):
        shapes = [(re.escape(name), m) for name, m in template.roles.items()]
        self.names = list(template.roles)
        forms = [f"{re.escape(m.opens)}(?P<t{i}>.*?){re.escape(m.closes)}" for i, (_, m) in enumerate(shapes)]
        before, after = template.other.opens.split("{role}")
        forms.append(f"{re.escape(before)}(?P<name>.*?){re.escape(after)}(?P<t{len(shapes)}>.*?){re.escape(template.other.closes)}")
        self.turn_form = re.compile("|".join(forms), re.S)

    def turn(self, text: str) -> tuple[str, str]:
        """(role, text)"""
        found = self.turn_form.fullmatch(text)
        if found is None:
            raise ValueError("this is not a formatted turn")
        kind = next(i for i in range(len(self.names) + 1) if found[f"t{i}"] is not None)
        role = self.names[kind] if kind < len(self.names) else unescaped(found["name"])
        return role, unescaped(found[f"t{kind}"])

    def turns(self, text: str) -> list[tuple[str, str]]:
        """(role, text) of all turns of a whole formatted conversation."""
        out, at = [], 0
        while at < len(text):
            found = self.turn_form.match(text, at)
            if found is None:
                raise ValueError("this is not a formatted conversation")
            out.append(self.turn(found[0]))
            at = found.end()
        return out


SEGMENTS = "array<struct<text: string, loss: boolean>>"


def formatted(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, position, fits, segments), one row per turn of conversations (conv_id, turn, role, text).

    position counts from 0. The rows of a conversation stand together and in order. The segments of all its rows, joined, are its
    text for the model; those with loss = true are what is learned.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shape = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
        current, machine, position = object(), Machine(template), 0
        for batch in batches:
            places, fits, segments = [], [], []
            for conv_id, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv_id != current:
                    current, machine, position = conv_id, Machine(template), 0
                fit, parts = machine.turn(role, text)
                places.append(position)
                fits.append(fit)
                segments.append([{"text": t, "loss": x} for t, x in parts])
                position += 1
            columns = [batch.column(0), pa.array(places, pa.int32()), pa.array(fits, pa.bool_()), pa.array(segments, shape)]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "position", "fits", "segments"])

    return rows.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, position int, fits boolean, segments {SEGMENTS}")


def arranged(turns: DataFrame) -> DataFrame:
    """Formatted rows that were stored: each conversation together and in order again."""
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "position")


def read_back(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation, from formatted rows that stand together and in order: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, bad_turns, valid).

    turns_sha256: of role, line end, text, line end of every turn. loss_*: of all text under the loss, unescaped. bad_turns: turns that
    do not fit; valid: there is none, and the last state is an end.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "bad_turns", "valid"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("conv_id", turns_type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
                            ("formatted_chars", pa.int64()), ("bad_turns", pa.int64()), ("valid", pa.bool_())])
        reader, start = Reader(template), object()
        current, done = start, []

        def close():
            if current is not start:
                done.append((current, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars, bad, bad == 0 and role in template.ends))

        n = loss_chars = chars = bad = 0
        whole, loss, role = hashlib.sha256(), hashlib.sha256(), ""
        for batch in batches:
            for conv_id, fits, segments in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if conv_id != current:
                    close()
                    current, n, loss_chars, chars, bad = conv_id, 0, 0, 0, 0
                    whole, loss, role = hashlib.sha256(), hashlib.sha256(), ""
                text = "".join(s["text"] for s in segments)
                role, said = reader.turn(text)
                learned = unescaped("".join(s["text"] for s in segments if s["loss"]))
                whole.update(f"{role}\n{said}\n".encode())
                loss.update(learned.encode())
                n, loss_chars, chars, bad = n + 1, loss_chars + len(learned), chars + len(text), bad + (not fits)
            if len(done) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_type

    turns_type = to_arrow_type(turns.schema["conv_id"].dataType)
    fields = dict(zip(names, [kind, "long", "string", "long", "string", "long", "long", "boolean"], strict=True))
    return turns.select("conv_id", "fits", "segments").mapInArrow(run, ", ".join(f"{k} {v}" for k, v in fields.items()))
