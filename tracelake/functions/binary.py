"""File content: kind, packer, strings, header fields, signature offsets, entropy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.content.lookups import (
    FILE_MAGIC, PACKER_MARKERS, SAMPLE_MAGIC,
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def head_hex(content, n: int = 8) -> Column:
    return F.hex(F.substring(_col(content), 1, n))


def latin1(content) -> Column:
    """Bytes as text, one character per byte."""
    return F.decode(_col(content), "ISO-8859-1")


def magic(content, table, default: str | None) -> Column:
    head = head_hex(content)
    chain = None
    for prefix, label in table:
        hit = head.startswith(prefix)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain.otherwise(F.lit(default).cast("string"))


def file_kind(content) -> Column:
    """Kind by leading bytes for the file inventory; NULL when unknown."""
    return magic(content, FILE_MAGIC, None)


def sample_kind(content) -> Column:
    """Kind by leading bytes for sample analysis; Unknown otherwise."""
    return magic(content, SAMPLE_MAGIC, "Unknown")


def packer(content, search_bytes: int | None = None) -> Column:
    """First packer marker found, or NULL; search_bytes limits the search to so many leading bytes."""
    head = latin1(_col(content) if search_bytes is None else F.substring(_col(content), 1, search_bytes))
    chain = None
    for marker, label in PACKER_MARKERS:
        hit = head.contains(marker)
        chain = F.when(hit, label) if chain is None else chain.when(hit, label)
    return chain


def ascii_strings(content, min_length: int = 6) -> Column:
    found = F.regexp_extract_all(latin1(content), F.lit(r"[\x20-\x7e]{%d,}" % min_length), F.lit(0))
    return F.transform(found, lambda s: F.trim(s))


def wide_strings(content, min_length: int = 6) -> Column:
    found = F.regexp_extract_all(
        latin1(content), F.lit(r"(?:[\x20-\x7e]\x00){%d,}" % min_length), F.lit(0))
    return F.transform(found, lambda s: F.trim(F.replace(s, F.lit("\x00"), F.lit(""))))


def little_endian(content, offset, size: int) -> Column:
    """Unsigned little-endian number at a zero-based offset."""
    content = _col(content)
    offset = offset if isinstance(offset, Column) else F.lit(offset)
    parts = [F.hex(F.substring(content, offset + F.lit(i + 1), F.lit(1))) for i in reversed(range(size))]
    return F.conv(F.concat(*parts), 16, 10).cast("bigint")


def header_fields(content) -> Column:
    """struct(machine, num_sections, link_time) of an executable; NULL when too short."""
    content = _col(content)
    size = F.octet_length(content)
    start = little_endian(content, 0x3C, 4).cast("int")
    number = lambda at, n: little_endian(content, start + F.lit(at), n)
    fields = F.struct(
        F.concat(F.lit("0x"), F.lower(F.hex(number(4, 2)))).alias("machine"),
        number(6, 2).cast("int").alias("num_sections"),
        F.timestamp_seconds(number(8, 4)).alias("link_time"),
    )
    fits = (size >= 64) & (little_endian(content, 0x3C, 4) + 24 <= size)
    return F.when(F.coalesce(fits, F.lit(False)), fields)


def signature_offsets(content, signature_hex: str) -> Column:
    """Zero-based offsets of a byte signature, left to right without overlap."""
    mark = bytes.fromhex(signature_hex)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def offsets(values: pd.Series) -> pd.Series:
        def one(raw):
            found, at = [], -1 if raw is None else raw.find(mark)
            while at >= 0:
                found.append(at)
                at = raw.find(mark, at + len(mark))
            return found

        return values.map(one)

    return offsets(_col(content))


def content_chunks(df: DataFrame, path: str, content: str, size: int = 1 << 20, overlap: int = 7) -> DataFrame:
    """(path, base, own_bytes, chunk) rows of bounded size.

    Each chunk carries a few bytes of the next one, so a signature across the
    border is seen; an offset belongs to the chunk if it is below own_bytes.
    """
    length = F.octet_length(content)
    starts = F.explode(F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0)), F.lit(size)))
    out = df.where(length > 0).select(F.col(path), F.col(content), starts.alias("base"))
    return out.select(
        path, F.col("base").cast("bigint").alias("base"),
        F.least(F.lit(size), F.octet_length(content) - F.col("base")).cast("bigint").alias("own_bytes"),
        F.substring(F.col(content), F.col("base") + 1, F.lit(size + overlap)).alias("chunk"))


@F.pandas_udf(T.ArrayType(T.LongType()))
def byte_counts(content: pd.Series, own_bytes: pd.Series) -> pd.Series:
    """256 counts: how often each byte value occurs in the first own_bytes bytes."""

    def one(raw, own) -> list | None:
        if raw is None:
            return None
        return np.bincount(np.frombuffer(raw, dtype=np.uint8)[: int(own)], minlength=256).tolist()

    return pd.Series([one(r, n) for r, n in zip(content, own_bytes)])


@F.pandas_udf(T.DoubleType())
def byte_entropy(content: pd.Series) -> pd.Series:
    """Shannon entropy in bits per byte, 0 to 8; 0 for empty content."""

    def one(raw) -> float | None:
        if raw is None:
            return None
        if len(raw) == 0:
            return 0.0
        counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
        share = counts[counts > 0] / len(raw)
        return float(-(share * np.log2(share)).sum()) + 0.0

    return content.map(one)
