"""Chunked scans give what a plain window gives, also with one key that holds most rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.operators import ordered as od

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(600):
        key = "hot" if i % 3 else rnd.choice(["a", "b", None])
        rows.append((i, key, START + dt.timedelta(seconds=rnd.choice([0, 1, 7, 600]) * rnd.randrange(400)),
                     rnd.choice([None, i])))
    return spark.createDataFrame(rows, "id int, key string, ts timestamp_ntz, v int").cache()


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("size", [20, 200, 1_000_000])
@pytest.mark.parametrize("keys", [["key"], [], ["key", "v"]])
def test_against_plain_windows(events, size, keys):
    w = Window.partitionBy(*keys).orderBy("ts", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = events.withColumns({
        "p": F.lag("v").over(w), "n": F.lead("v").over(w), "k": F.last("v", ignorenulls=True).over(upto),
        "s": F.coalesce(F.sum("v").over(upto), F.lit(0)), "r": F.row_number().over(w)})
    got = od.Ordered(events, keys, ["ts", "id"], od.Sizes(rows=size))
    assert got.chunks == (1 if size > 600 else len(set(got.df.select(od.CHUNK).toPandas()[od.CHUNK]))) and (size > 20 or got.chunks > 10)
    got = got.previous(F.col("v"), "p").following(F.col("v"), "n").last_known(F.col("v"), "k")
    got = got.running_sum(F.col("v"), "s").position("r").rows()
    assert got.columns == ["id", "key", "ts", "v", "p", "n", "k", "s", "r"]
    assert rows(got, *got.columns) == rows(plain, *got.columns)


def test_all_rows_in_one_second(spark):
    """Chunks follow the data: rows of one key and one time are cut by what breaks the tie."""
    one = spark.range(20_000).selectExpr("id", "'h' AS host", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "IF(id % 1000 = 3, id, NULL) AS v")
    d = od.Ordered(one, ["host"], ["ts", "id"], od.Sizes(rows=1_000))
    sizes = [r["count"] for r in d.df.groupBy(od.CHUNK).count().collect()]
    assert d.chunks == len(sizes) == 20 and max(sizes) < 3 * sum(sizes) / len(sizes)
    got = d.position("n").previous(F.col("id"), "b").last_known(F.col("v"), "k").rows()
    bad = got.where((F.col("n") != F.col("id") + 1) | ~F.col("b").eqNullSafe(F.when(F.col("id") > 0, F.col("id") - 1))
                    | ~F.col("k").eqNullSafe(F.when(F.col("id") > 2, F.col("id") - F.pmod(F.col("id") - 3, F.lit(1000)))))
    assert bad.count() == 0


def test_rows_without_order_or_keys(spark, events):
    for sizes in (od.Sizes(rows=10), None):
        assert od.with_position(events.limit(0), ["key"], ["ts"], sizes=sizes).count() == 0
        nulls = spark.createDataFrame([(None, None, 1), (None, None, 2), ("a", None, 3)], "key string, ts timestamp, id int")
        got = od.with_position(nulls, ["key"], ["ts", "id"], sizes=od.Sizes(rows=1))
        assert rows(got, "id", "position") == [(1, 1), (2, 2), (3, 1)]


@pytest.mark.parametrize("seconds", [1, 30, 600])
def test_count_within(events, seconds):
    w = Window.partitionBy("key").orderBy(od.micros("ts")).rangeBetween(-seconds * 1_000_000, 0)
    plain = events.withColumn("hits", F.count("*").over(w)).select("key", "ts", "hits").distinct()
    assert rows(od.count_within(events, ["key"], "ts", seconds), "key", "ts", "hits") == rows(plain, "key", "ts", "hits")


def test_sessions(events):
    got = od.sessions(events, ["key"], "ts", ["ts", "id"], 100, od.Sizes(rows=50))
    want = events.groupBy("key", F.session_window(F.col("ts").cast("timestamp"), "100 seconds")).agg(
        F.count("*").alias("events"), F.max("ts").alias("session_last"))
    # session_window closes at exactly the gap, ours after it: compare on data without such pauses.
    gaps = od.with_previous(events, ["key"], ["ts", "id"], od.micros("ts"), "b")
    exact = gaps.where(od.micros("ts") - F.col("b") == 100_000_000).count()
    assert abs(got.count() - want.count()) <= exact
    assert got.agg(F.sum("events")).first()[0] == events.count()
    assert rows(got, *got.columns) == rows(od.sessions(events, ["key"], "ts", ["ts", "id"], 100), *got.columns)


def test_as_of(spark, events):
    marks = events.where(F.col("v").isNotNull()).groupBy("key", F.col("ts").alias("at")).agg(F.max("v").alias("mark"))
    got = od.as_of(events, marks, ["key"], "ts", "at", "mark", sizes=od.Sizes(rows=40))
    left, right = events.select("id", "key", "ts").collect(), marks.collect()
    want = []
    for r in left:
        known = [m for m in right if m.key == r.key and m["at"] <= r.ts]
        want.append((r.id, max(known, key=lambda m: m["at"]).mark if known else None))
    assert rows(got, "id", "mark") == sorted(want, key=str)


def test_first_per_group_limits_before_the_shuffle(events):
    plan = od.first_per_group(events, ["key"], ["ts", "id"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


SCANS = {
    "sequential_ids": 1, "row_positions": 1, "activity_sessions": 1, "forward_fill": 1,
    "technique_phases": 1, "process_tree": 2, "custody_check": 1,
}


@pytest.mark.parametrize("name", sorted(SCANS))
def test_cut_queries_read_each_table_once(spark, monkeypatch, name):
    """Cut into many chunks, each query still agrees with its SQL, reads its table once (a self-join twice) and shuffles its rows once."""
    from oracle import compare, connect
    from tracelake.plans import registry

    registry.load_all()
    folder = "/root/testdata/sf0.001"
    monkeypatch.setattr(od, "SIZES", od.Sizes(rows=50))
    verdict, _, detail = compare(spark, connect(folder), folder, name, registry.QUERIES[name], registry.ORACLES[name])
    assert verdict == "ok", detail
    plan = registry.QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == SCANS[name]
    assert plan.count(f"Exchange hashpartitioning({od.CHUNK}") == 1


def test_chunks_share_one_shuffle(events):
    d = od.Ordered(events, ["key"], ["ts", "id"], od.Sizes(rows=50))
    got = d.previous(F.col("id"), "p").last_known(F.col("v"), "k").position("r").rows()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("BroadcastHashJoin") == 3
