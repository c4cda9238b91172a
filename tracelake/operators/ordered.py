"""Ordered scans over groups of any size.

A plain window puts a whole group into one task. Here the rows are cut into chunks
of their order by (keys, order), at points taken from a sample of the rows, so
chunks hold about equally many rows whatever the keys and times are: a host that
holds a third of all rows, or a second that holds them all, spreads over many.
The window runs inside (chunk, keys). Only the last group of a chunk can go on in the
next one, so what is carried on is one row per chunk, gathered by one aggregate over
the few columns it needs and joined back by broadcast: its size is the number of chunks.
Rows are shuffled once, and the result is that of the plain window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tracelake.functions.binding import let
from tracelake.functions.times import micros

CHUNK = "_chunk"


@dataclass
class Sizes:
    """rows: of a chunk, about. most: chunks at most; beyond rows x most rows, chunks grow. sampled: rows per chunk that place the cuts."""

    rows: int = 1_000_000
    most: int = 4_096
    sampled: int = 64


SIZES = Sizes()


def _cut_points(rows: DataFrame, place: Column, sizes: Sizes) -> list[Row]:
    """Places, rising, that cut rows into chunks; none for rows that fit one chunk."""
    places = rows.select(place.alias("p"))
    n = places.count()
    chunks = min(sizes.most, -(-n // max(1, sizes.rows)))
    if chunks < 2:
        return []
    sample = places.sample(min(1.0, chunks * sizes.sampled / n), seed=7)
    # chunks x sampled rows, about: the one window that sees them all is bounded.
    tiles = sample.select("p", F.ntile(chunks).over(Window.orderBy("p")).alias("tile"))
    found = tiles.groupBy("tile").agg(F.min("p").alias("p")).orderBy("tile").collect()
    return [r["p"] for r in found[1:]]


def _chunk_of(place: Column, points: list[Row], rows: DataFrame) -> Column:
    """Number of the points at or below place, by bisection."""
    kinds = [f.dataType for f in rows.select(place.alias("p")).schema["p"].dataType.fields]
    cuts = F.array(*[F.struct(*[F.lit(v).cast(t).alias(f"c{i}") for i, (v, t) in enumerate(zip(p, kinds, strict=True))]) for p in points])
    steps = [1 << k for k in range(len(points).bit_length() - 1, -1, -1)]

    def step(p: Column) -> Callable[[Column, Column], Column]:
        reached = lambda at, s: (at + s <= len(points)) & (F.get(cuts, at + s - 1) <= p)
        return lambda at, s: F.when(reached(at, s), at + s).otherwise(at)

    return let(place, lambda p: F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step(p)))


class Ordered:
    """Rows of df with results that depend on the order of the rows with equal keys. order should leave no ties.

    Each method adds a column and gives an Ordered again; all share the same chunks, hence one shuffle. rows() ends.
    """

    def __init__(self, df: DataFrame, keys, order, sizes: Sizes | None = None):
        self.keys = list(keys)
        # Keys are constant within a group, so they add nothing to its order.
        self.order = [o for o in order if not (isinstance(o, str) and o in self.keys)]
        self.columns = df.columns
        parts = [F.col(c) if isinstance(c, str) else c for c in [*self.keys, *self.order]]
        self.place = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(parts)])
        points = _cut_points(df, self.place, sizes or SIZES)
        self.chunks = len(points) + 1
        self.df = df.withColumn(CHUNK, _chunk_of(self.place, points, df)) if points else df

    def rows(self) -> DataFrame:
        return self.df.select(*self.columns)

    def previous(self, value: Column, name: str) -> Ordered:
        """value of the row before (lag by one)."""
        near = F.lag(F.struct(value.alias("v"))).over(self._inside())
        if self.chunks == 1:
            return self._with(name, near["v"])
        last = F.max_by(F.struct(self._key().alias("key"), F.struct(value.alias("v")).alias("state")), self.place)
        return self._carried(name, near, self._states(last), lambda now, before: now)._field(name)

    def following(self, value: Column, name: str) -> Ordered:
        """value of the row after (lead by one)."""
        near = F.lead(F.struct(value.alias("v"))).over(self._inside())
        if self.chunks == 1:
            return self._with(name, near["v"])
        first = F.min_by(F.struct(self._key().alias("key"), F.struct(value.alias("v")).alias("state")), self.place)
        return self._carried(name, near, self._states(first)[::-1], lambda now, after: now)._field(name)

    def last_known(self, value: Column, name: str) -> Ordered:
        """Latest value that is not NULL at or before the row (forward fill)."""
        near = F.last(value, ignorenulls=True).over(self._inside().rowsBetween(Window.unboundedPreceding, Window.currentRow))
        if self.chunks == 1:
            return self._with(name, near)
        known = F.max_by(F.struct(self._key().alias("key"), value.alias("state")), F.when(value.isNotNull(), self.place))
        ends = F.struct(F.min(self._key()).alias("first"), F.max(self._key()).alias("key"), known.alias("known"))

        def fold(now: Row, before: tuple | None) -> tuple | None:
            if now["known"] is not None and now["known"]["key"] == now["key"]:
                return now["known"]
            return before if before is not None and now["first"] == now["key"] == before["key"] else None

        return self._carried(name, near, self._states(ends), fold)

    def running_sum(self, value: Column, name: str) -> Ordered:
        """Sum from the start of the group up to the row; NULL counts as nothing."""
        near = F.sum(value).over(self._inside().rowsBetween(Window.unboundedPreceding, Window.currentRow))
        near = F.coalesce(near, F.lit(0))
        if self.chunks == 1:
            return self._with(name, near)
        sums = self.df.groupBy(CHUNK, self._key().alias("key")).agg(F.sum(value).alias("state"))
        last = F.struct(F.min("key").alias("first"), F.max("key").alias("key"), F.max_by("state", "key").alias("state"))
        states = sums.groupBy(CHUNK).agg(last.alias("s")).orderBy(CHUNK).collect()

        def fold(now: Row, before: Row | None) -> Row:
            if before is None or before["state"] is None or not now["first"] == now["key"] == before["key"]:
                return now
            return Row(key=now["key"], state=before["state"] + (now["state"] or 0))

        return self._carried(name, near, states, fold, F.sum(value), lambda near, carry: near + F.coalesce(carry, F.lit(0)))

    def position(self, name: str) -> Ordered:
        """1, 2, 3, ... (row_number)"""
        return self.running_sum(F.lit(1).cast("bigint"), name)

    def count_same(self, value: Column, name: str) -> Ordered:
        """How many rows up to this one, within the keys, have its value. value is not NULL and has few distinct values: what
        a chunk leaves to the next one is its counts per value."""
        near = F.row_number().over(Window.partitionBy(*([CHUNK] if self.chunks > 1 else []), *self.keys, value).orderBy(*self.order)).cast("bigint")
        if self.chunks == 1:
            return self._with(name, near)
        counts = self.df.groupBy(CHUNK, self._key().alias("key"), value.alias("v")).agg(F.count("*").alias("n"))
        state = F.map_from_entries(F.collect_list(F.struct("v", "n")))
        maps = counts.groupBy(CHUNK, "key").agg(state.alias("state"))
        last = F.struct(F.min("key").alias("first"), F.max("key").alias("key"), F.max_by("state", "key").alias("state"))
        states = maps.groupBy(CHUNK).agg(last.alias("s")).orderBy(CHUNK).collect()

        def fold(now: Row, before: Row | None) -> Row:
            if before is None or not now["first"] == now["key"] == before["key"]:
                return now
            both = {v: before["state"].get(v, 0) + now["state"].get(v, 0) for v in {**before["state"], **now["state"]}}
            return Row(key=now["key"], state=both)

        kept = F.map_from_entries(F.collect_list(F.struct(value.alias("v"), F.lit(1).cast("bigint").alias("n"))))
        return self._carried(name, near, states, fold, kept, lambda near, carry: near + F.coalesce(F.try_element_at(carry, value), F.lit(0)))

    def _inside(self):
        return Window.partitionBy(*([CHUNK] if self.chunks > 1 else []), *self.keys).orderBy(*self.order)

    def _key(self) -> Column:
        return F.struct(F.lit(0).alias("none"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(self.keys)])

    def _states(self, state: Column) -> list[Row]:
        """(chunk, s), one row per chunk that has rows."""
        return self.df.groupBy(CHUNK).agg(state.alias("s")).orderBy(CHUNK).collect()

    def _with(self, name: str, result: Column) -> Ordered:
        out = object.__new__(Ordered)
        out.__dict__ |= self.__dict__
        out.df = self.df.withColumn(name, result)
        out.columns = [*[c for c in self.columns if c != name], name]
        return out

    def _field(self, name: str) -> Ordered:
        return self._with(name, F.col(name)["v"])

    def _carried(self, name: str, near: Column, states: list[Row], fold, kind: Column | None = None, join=F.coalesce) -> Ordered:
        """near, completed by what the chunks before (in the order of states) leave to the same keys."""
        carry, before = [], None
        for r in states:
            if before is not None and before["state"] is not None:
                carry.append((r[CHUNK], before["key"], before["state"]))
            before = fold(r["s"], before)
        types = self.df.select(self._key().alias("key"), near.alias("near")).schema if kind is None else \
            self.df.groupBy(self._key().alias("key")).agg(kind.alias("near")).schema
        shape = StructType([StructField("_chunk_at", IntegerType()), StructField("_chunk_key", types["key"].dataType), StructField("_chunk_carry", types["near"].dataType)])
        table = self.df.sparkSession.createDataFrame(carry, shape)
        keys = [F.col(f"_chunk_key.k{i}").alias(f"_chunk_key{i}") for i in range(len(self.keys))]
        table = F.broadcast(table.select("_chunk_at", *keys, "_chunk_carry"))  # one row per chunk at most
        same = F.col(CHUNK) == F.col("_chunk_at")
        for i, k in enumerate(self.keys):
            same &= F.col(k).eqNullSafe(F.col(f"_chunk_key{i}"))
        out = self._with("_chunk_near", near)
        out.df = out.df.join(table, same, "left")
        out = out._with(name, join(F.col("_chunk_near"), F.col("_chunk_carry")))
        out.columns = [c for c in out.columns if c != "_chunk_near"]
        out.df = out.df.select(*out.columns, CHUNK)
        return out


def with_previous(df: DataFrame, keys, order, value: Column, name: str = "previous", sizes: Sizes | None = None) -> DataFrame:
    """value of the row before, in order, within the keys (lag by one)."""
    return Ordered(df, keys, order, sizes).previous(value, name).rows()


def with_next(df: DataFrame, keys, order, value: Column, name: str = "following", sizes: Sizes | None = None) -> DataFrame:
    """value of the row after, in order, within the keys (lead by one)."""
    return Ordered(df, keys, order, sizes).following(value, name).rows()


def with_last_known(df: DataFrame, keys, order, value: Column, name: str = "known", sizes: Sizes | None = None) -> DataFrame:
    """Latest value that is not NULL at or before the row (forward fill)."""
    return Ordered(df, keys, order, sizes).last_known(value, name).rows()


def with_running_sum(df: DataFrame, keys, order, value: Column, name: str = "running", sizes: Sizes | None = None) -> DataFrame:
    """Sum from the start of the group up to the row."""
    return Ordered(df, keys, order, sizes).running_sum(value, name).rows()


def with_position(df: DataFrame, keys, order, name: str = "position", sizes: Sizes | None = None) -> DataFrame:
    """1, 2, 3, ... in order within the keys (row_number); keys may be empty."""
    return Ordered(df, keys, order, sizes).position(name).rows()


def first_per_group(df: DataFrame, keys, order, n: int | None, name: str = "rank") -> DataFrame:
    """First n rows per group with their rank; without an n all rows are ranked.

    The rank limit sits directly on the window, so Spark keeps at most n rows per
    group in each task before the shuffle: a hot group never moves whole.
    """
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked if n is None else ranked.where(F.col(name) <= n)


def count_within(df: DataFrame, keys, ts: str, seconds: int, name: str = "hits") -> DataFrame:
    """(keys, ts, name): rows of the same keys in the window [ts - seconds, ts].

    Rows with equal keys and time are counted first. Each count then goes to its
    own span of that many seconds and to the next one as context, so the sliding
    frame never needs more than two spans of a group in one task.
    """
    width = seconds * 1_000_000
    counted = df.groupBy(*keys, ts).agg(F.count("*").alias("_n")).withColumn("_at", micros(ts))
    own = F.floor(F.col("_at") / F.lit(width)).cast("bigint")
    spread = counted.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))) \
                    .withColumn(CHUNK, own + F.col("_copy"))
    frame = Window.partitionBy(*keys, CHUNK).orderBy("_at").rangeBetween(-width, 0)
    return spread.withColumn(name, F.sum("_n").over(frame)) \
                 .where(F.col("_copy") == 0).select(*keys, ts, F.col("_n").alias("rows"), name)


def as_of(left: DataFrame, right: DataFrame, keys, left_ts: str, right_ts: str, value: str,
          name: str | None = None, sizes: Sizes | None = None) -> DataFrame:
    """Left rows with the latest right value at or before the left time.

    Both sides are laid on one time line per key and the value is filled forward,
    so no pairs are formed. right must hold at most one row per key and time.
    """
    name = name or value
    rows = left.withColumn("_side", F.lit(1)).withColumn("_ts", F.col(left_ts).cast("timestamp"))
    marks = right.select(*keys, F.col(right_ts).cast("timestamp").alias("_ts"),
                         F.col(value).alias("_mark"), F.lit(0).alias("_side"))
    line = rows.unionByName(marks, allowMissingColumns=True)
    # Equal rows of the left side may come in any order: they get the same value.
    known = with_last_known(line, keys, ["_ts", "_side"], F.col("_mark"), "_known", sizes)
    return known.where(F.col("_side") == 1).withColumn(name, F.col("_known")) \
                .drop("_side", "_ts", "_mark", "_known")


def sessions(df: DataFrame, keys, ts: str, order, gap_seconds: int, sizes: Sizes | None = None) -> DataFrame:
    """Activity sessions: a new one starts when the pause is longer than the gap."""
    d = Ordered(df.withColumn("_micros", micros(ts)), keys, order, sizes).previous(F.col("_micros"), "_before")
    start = F.when(F.col("_before").isNull() | (F.col("_micros") - F.col("_before") > gap_seconds * 1_000_000),
                   F.col(ts))
    d = d.last_known(start, "session_start").rows()
    return d.groupBy(*keys, "session_start").agg(
        F.max(ts).alias("session_last"), F.count("*").alias("events"))
