"""String measures and classifications."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.content.lookups import SUSPICIOUS_STRINGS
from tracelake.functions.binding import let


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_entropy(value) -> Column:
    """Shannon entropy in bits per character, case ignored; 0 for empty text.

    Each distinct character is counted by how much the text shrinks without it,
    which keeps the expression inside the JVM.
    """

    def measure(low: Column) -> Column:
        size = F.length(low)
        letters = F.filter(F.array_distinct(F.split(low, "")), lambda c: c != F.lit(""))

        def part(acc, letter):
            share = (size - F.length(F.replace(low, letter, F.lit("")))) / size
            return acc - share * F.log2(share)

        return F.when(size == 0, F.lit(0.0)).otherwise(F.aggregate(letters, F.lit(0.0), part))

    return let(F.lower(_col(value)), measure)


def first_label(domain) -> Column:
    return F.split_part(_col(domain), F.lit("."), F.lit(1))


def technique_tag(tags) -> Column:
    """First attack.tNNNN tag as a technique id."""
    hits = F.filter(_col(tags), lambda t: t.startswith("attack.t"))
    return F.upper(F.replace(F.get(hits, 0), F.lit("attack."), F.lit("")))


def parent_technique(technique) -> Column:
    return F.split_part(_col(technique), F.lit("."), F.lit(1))


def _literals(pattern: str) -> list[str] | None:
    """The words of a pattern that is a plain list of words, ignoring case; else None."""
    body = pattern.removeprefix("(?i)")
    words = [w.replace("\\.", ".") for w in body.split("|")]
    plain = pattern.startswith("(?i)") and all(re.fullmatch(r"[A-Za-z0-9_.,]+", w) for w in words)
    dots = body.count(".") == body.count("\\.")
    return [w.lower() for w in words] if plain and dots else None


def string_reason(value) -> Column:
    """Reason of the first matching suspicious pattern, or NULL.

    Lists of words are substring tests on the lowered text, which is several times
    faster than a case-insensitive regular expression; the others run as they are.
    """
    value = _col(value)

    def choose(pair: Column) -> Column:
        chain = None
        for pattern, reason in SUSPICIOUS_STRINGS:
            words = _literals(pattern)
            if words is None:
                hit = pair["raw"].rlike(pattern)
            else:
                hit = F.lit(False)
                for word in words:
                    hit = hit | F.contains(pair["low"], F.lit(word))
            chain = F.when(hit, reason) if chain is None else chain.when(hit, reason)
        return chain

    return let(F.struct(value.alias("raw"), F.lower(value).alias("low")), choose)


def suspicious_strings(strings, width: int | None = None) -> Column:
    """(value, reason) for each distinct suspicious string of an array; width cuts the values."""
    tagged = F.transform(
        F.array_distinct(_col(strings)),
        lambda s: F.struct(cut(s, width).alias("value"), string_reason(s).alias("reason")),
    )
    return F.filter(tagged, lambda t: t["reason"].isNotNull())


def one_of(value, names) -> Column:
    """Names that occur in the lowered value, as an array."""
    low = F.lower(_col(value))
    return F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(low, n))


def contains_any(value, words) -> Column:
    low = F.lower(_col(value))
    hit = F.lit(False)
    for word in words:
        hit = hit | low.contains(word)
    return hit


def filled(*cols) -> Column:
    """First column that is neither NULL nor an empty string."""
    return F.coalesce(*[F.nullif(_col(c).cast("string"), F.lit("")) for c in cols])


def cut(value, width: int | None) -> Column:
    """The first width characters; all of them without a width."""
    return _col(value) if width is None else F.left(_col(value), F.lit(width))


def first_items(values, n: int | None) -> Column:
    """The first n elements of an array; all of them without an n."""
    return _col(values) if n is None else F.slice(_col(values), 1, n)


def event_text(event) -> Column:
    """JSON text of a struct, map or VARIANT event, lowered, for text search."""
    return F.lower(F.to_json(_col(event)))


# A key as part of a path: quoted unless it is a plain name.
PLAIN_KEY = r"^[A-Za-z_][A-Za-z0-9_]*$"
# A key that may hold a token.
TELLING_KEY = r"\.|-\d|[0-9a-fA-F]{32}"
# The plain names again, with a class that Java asks once per character.
PLAIN_KEY_WORD = r"^(?!\d)\w+$"


def event_leaves(event, levels: int = 8) -> Column:
    """All values of a VARIANT event: array of (path, text), text as it is in the event, not its JSON spelling.

    Keys that may hold a token (a dot, a dash before a digit, 32 hex digits) come as well, under the path of their
    value and a ~. What lies deeper than levels comes as one JSON text under the path of its top, so nothing is left out.
    """
    nothing = F.lit(None).cast("string")
    leaf = lambda path, value, text: F.struct(path.alias("path"), value.alias("value"), text.alias("text"))

    done = F.lit(None).cast("variant")

    def inside(x: Column) -> Column:
        value, path = x["value"], x["path"]

        def entry(e: Column) -> Column:
            name = F.when(e["key"].rlike(PLAIN_KEY), e["key"]).otherwise(F.concat(F.lit('"'), e["key"], F.lit('"')))
            at = F.concat(path, F.lit("."), name)
            own = F.array(leaf(at, e["value"], nothing))
            key = F.array(leaf(F.concat(at, F.lit("~")), done, e["key"]))
            return F.when(e["key"].rlike(TELLING_KEY), F.concat(own, key)).otherwise(own)

        items = lambda: F.transform(value.cast("array<variant>"), lambda v, i: leaf(
            F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), v, nothing))
        # The kind is asked first: a cast that fails costs more than all the rest.
        return F.when(value.isNull(), F.array(x)).otherwise(let(F.left(F.schema_of_variant(value), F.lit(6)), lambda kind: (
            F.when(kind == "OBJECT", F.flatten(F.transform(F.map_entries(value.cast("map<string,variant>")), entry)))
            .when(kind == "ARRAY<", items())
            .otherwise(F.array(leaf(path, done, value.cast("string")))))))

    found = F.array(leaf(F.lit("$"), _col(event), nothing))
    for _ in range(levels):
        found = F.flatten(F.transform(found, inside))
    # In the JSON of what is too deep, an escape such as \\n must not run into the token behind it.
    rest = lambda v: F.when(F.left(F.schema_of_variant(v), F.lit(6)).isin("OBJECT", "ARRAY<"), F.regexp_replace(F.to_json(v), r'\\[nrtbf"/]', " ")) \
        .otherwise(F.try_variant_get(v, "$", "string"))
    flat = F.transform(found, lambda x: F.struct(x["path"].alias("path"), F.coalesce(x["text"], rest(x["value"])).alias("text")))
    return F.filter(flat, lambda x: x["text"].isNotNull())


def event_leaf_rows(df: DataFrame, event: str, ids: list[str], levels: int = 8) -> DataFrame:
    """(ids, path, text): the leaves of VARIANT events as rows, the same as event_leaves.

    Each level is one generator without functions on array elements, so Spark compiles all levels into one loop; a
    cast to a kind that a value does not have gives NULL at little cost, where its schema would spell out all below it.
    """
    value, fields, items, key, nothing = F.col("_value"), F.col("_fields"), F.col("_items"), F.col("_entry.key"), F.lit(None)
    kinds = [F.try_variant_get("_value", "$", kind).alias(name) for kind, name in (("map<string,variant>", "_fields"), ("array<variant>", "_items"))]
    plain = F.when(fields.isNull() & items.isNull(), value.cast("string"))
    # A key that may hold a token is an entry more, without value.
    keys = F.arrays_zip(F.map_keys(fields).alias("key"), F.array().cast("array<variant>").alias("value"))
    places = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>")).cast("array<string>")
    entries = F.when(fields.isNotNull(), F.concat(F.map_entries(fields), keys)).when(items.isNotNull(), F.arrays_zip(places.alias("key"), items.alias("value")))
    named, placed, alone = F.col("_named"), F.col("_placed"), F.col("_entry.value").isNull()
    telling = (key.contains(".") | key.contains("-") | (F.octet_length(key) >= 32)) & key.rlike(TELLING_KEY)  # most keys need no pattern
    name = F.when(key.rlike(PLAIN_KEY_WORD), key).otherwise(F.concat(F.lit('"'), key, F.lit('"')))
    path = F.when(named, F.concat("path", F.lit("."), name, F.when(alone, F.lit("~")).otherwise(F.lit("")))) \
        .when(placed, F.concat("path", F.lit("["), key, F.lit("]"))).otherwise(F.col("path"))

    rows = df.select(*ids, F.lit("$").alias("path"), F.col(event).alias("_value"), nothing.cast("string").alias("_text"))
    for _ in range(levels):
        # A plain value becomes text where it is found, and is asked no more.
        rows = rows.select(*ids, "path", "_value", "_text", *kinds)
        rows = rows.select(*ids, "path", F.coalesce("_text", plain).alias("_text"), fields.isNotNull().alias("_named"), items.isNotNull().alias("_placed"),
                           F.explode_outer(entries).alias("_entry"))
        rows = rows.where((F.when(named, ~alone | telling).when(placed, ~alone).otherwise(True)) & ~F.is_variant_null("_entry.value"))
        rows = rows.select(*ids, path.alias("path"), F.col("_entry.value").alias("_value"), F.when(named & alone, key).otherwise(F.col("_text")).alias("_text"))
    # Asked of the value, since a filter on the text would make the text twice.
    rows = rows.where(F.col("_text").isNotNull() | (value.isNotNull() & ~F.is_variant_null("_value"))).select(*ids, "path", "_value", "_text", *kinds)
    # In the JSON of what is too deep, an escape such as \\n must not run into the token behind it.
    rest = F.when(fields.isNotNull() | items.isNotNull(), F.regexp_replace(F.to_json(value), r'\\[nrtbf"/]', " "))
    return rows.select(*ids, "path", F.coalesce("_text", rest, plain).alias("text"))


def fill(template: str, *values: Column) -> Column:
    """The template with its {} marks replaced by the values, in order; NULL if a value is."""
    pieces = template.split("{}")
    parts = [F.lit(pieces[0])]
    for value, piece in zip(values, pieces[1:]):
        parts += [value.cast("string"), F.lit(piece)]
    return F.concat(*parts)
