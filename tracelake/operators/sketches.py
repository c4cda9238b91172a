"""Counts and quantiles kept as mergeable sketches: one small row per day (and key), merged for any span later.

Exact distinct counts and quantiles of a span need all its rows again. A sketch per day is kept instead; the
sketches of a span merge into what one pass over its rows would have given, within the same bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HLL_BITS = 12
KLL_K = 200


def distinct_error(bits: int = HLL_BITS, deviations: float = 3.0) -> float:
    """Relative error that an estimated distinct count stays within, in so many standard deviations."""
    return deviations * 1.04 / 2 ** (bits / 2)


def rank_error(k: int = KLL_K) -> float:
    """Share of the rows by which the rank of an estimated quantile may be off, nearly always (published fit of the KLL error)."""
    return 2.296 / k**0.9021


def daily_sketches(rows: DataFrame, ts: str, distinct: dict[str, Column], values: dict[str, Column], keys: list[str] = (), bits: int = HLL_BITS,
                   k: int = KLL_K) -> DataFrame:
    """(keys, day, rows, distinct_<name>, values_<name>): one row per day and key, of a few kilobytes per sketch."""
    counted = [F.hll_sketch_agg(c, bits).alias(f"distinct_{n}") for n, c in distinct.items()]
    ranked = [F.expr(f"kll_sketch_agg_double(_value_{n}, {k})").alias(f"values_{n}") for n in values]
    made = rows.withColumns({f"_value_{n}": c.cast("double") for n, c in values.items()})
    return made.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.count("*").alias("rows"), *counted, *ranked)


def merged(sketches: DataFrame, *keys) -> DataFrame:
    """Sketches of whole spans from those of their days; keys are columns or expressions, none for one row."""
    out = [F.sum("rows").alias("rows")]
    for name in sketches.columns:
        if name.startswith("distinct_"):
            out.append(F.hll_union_agg(name).alias(name))
        elif name.startswith("values_"):
            out.append(F.expr(f"kll_merge_agg_double({name})").alias(name))
    return sketches.groupBy(*keys).agg(*out)


def distinct_of(name: str) -> Column:
    return F.hll_sketch_estimate(f"distinct_{name}")


def quantile_of(name: str, share: float) -> Column:
    return F.expr(f"kll_sketch_get_quantile_double(values_{name}, {share}D)")


def rank_of(name: str, value: float) -> Column:
    """Share of the values at or below a value."""
    return F.expr(f"kll_sketch_get_rank_double(values_{name}, {value}D)")
