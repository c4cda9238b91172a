"""Addresses, numbers and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def address_host(value) -> Column:
    """Everything before the last colon (works for IPv6)."""
    value = _col(value)
    return F.regexp_extract(value, r"^(.*):([^:]*)$", 1)


def address_port(value) -> Column:
    """Digits after the last colon, else 0."""
    digits = F.regexp_extract(_col(value), r":([0-9]+)$", 1)
    return F.coalesce(digits.try_cast("int"), F.lit(0))


def number_or_hex(value) -> Column:
    """A decimal number, or a hex number with 0x; NULL when it does not fit."""
    value = _col(value)
    digits = F.regexp_extract(value, "^0x0*([0-9A-Fa-f]*)", 1)
    hexadecimal = F.when(F.length(digits) <= 16, F.conv(F.when(digits == "", "0").otherwise(digits), 16, 10).try_cast("bigint"))
    return F.when(value.startswith("0x"), hexadecimal) \
            .otherwise(value.try_cast("bigint"))


def file_name(path) -> Column:
    return F.element_at(F.split(_col(path), r"[/\\]"), -1)


def folder(path) -> Column:
    return F.regexp_replace(_col(path), r"[/\\][^/\\]*$", "")


def suffix(name) -> Column:
    """Lowered last extension with its dot; empty for none and for dot files."""
    return F.lower(F.regexp_extract(_col(name), r"[^.](\.[^.\s]+)$", 1))


def is_hidden(name) -> Column:
    return _col(name).startswith(".")


def octal_mode(mode) -> Column:
    """Permission bits as 0oNNN text."""
    bits = _col(mode).cast("int").bitwiseAND(0o7777)
    return F.concat(F.lit("0o"), F.conv(bits.cast("string"), 10, 8))
