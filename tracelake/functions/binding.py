"""Name an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once.

    A lambda of transform or filter evaluates the columns it refers to for every
    element, so an expensive outer value must be bound before it is used there.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), 0)
