"""Vectors from Arrow batches, as several operators read them."""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pyarrow as pa


def matrix(column: pa.Array, width: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(mask of the rows that take part, their vectors): of that width, no component null, non-finite or of limit or more in magnitude."""
    import pyarrow as pa
    import pyarrow.compute as pc

    fit = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == width
    flat = column.filter(pa.array(fit)).flatten().to_numpy(zero_copy_only=False)  # a null component becomes NaN
    x = flat.astype(np.float64).reshape(-1, width)
    fine = (np.abs(x) < limit).all(1)
    fit[np.flatnonzero(fit)[~fine]] = False
    return fit, x[fine]


def within(vector: Column, limit: Column | float) -> Column:
    """The same test on a column."""
    below = F.forall(vector, lambda x: F.coalesce(F.abs(x).cast("double") < limit, F.lit(False)))
    return F.coalesce(below, F.lit(False))


def usual_width(vectors: DataFrame, limit: Column | float, multiple: int = 1) -> int:
    """The most frequent length of vectors (column v) that take part, the smaller of equals; 0 where none does."""
    sizes = vectors.filter(within(F.col("v"), limit)).groupBy(F.size("v").alias("width")).count()
    best = sizes.filter((F.col("width") > 0) & (F.col("width") % multiple == 0)).orderBy(F.desc("count"), "width").first()
    return best["width"] if best else 0
