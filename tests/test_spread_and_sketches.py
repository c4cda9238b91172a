"""Hot keys that are found, sketches that merge, and login histories."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.operators import hunts, matching, sketches
from tracelake.operators.ordered import Ordered, Sizes


@pytest.fixture(scope="module")
def tokens(spark):
    """One value in half of all rows, one in a tenth, the rest spread; a few NULLs."""
    return spark.range(20_000).selectExpr("id", "'domain' AS ioc_type", """
        CASE WHEN id % 2 = 0 THEN 'hot' WHEN id % 10 = 1 THEN 'warm' WHEN id % 1000 = 3 THEN NULL ELSE concat('v', id % 3000) END AS value""")


def test_heavy_keys_are_found(spark, tokens):
    heavy = matching.heavy_keys(tokens, ["ioc_type", "value"])
    names = {r.h: r.value for r in tokens.select("value", F.xxhash64("ioc_type", "value").alias("h")).distinct().collect()}
    assert {names[h]: n for h, n in heavy.items()} == {"hot": 32, "warm": 7}
    assert matching.heavy_keys(tokens.where("id % 1000 = 5"), ["value"], 0.5) == {} == matching.heavy_keys(tokens.limit(0), ["value"])
    with pytest.raises(ValueError):
        matching.heavy_keys(tokens, ["value"], 0)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_heavy_join_spreads_and_agrees(spark, tokens, how):
    feed = spark.createDataFrame([("domain", "hot", 1), ("domain", "hot", 2), ("domain", "v7", 3), ("domain", None, 4)], "ioc_type string, value string, w int")
    got = matching.heavy_join(tokens, feed, ["ioc_type", "value"], how=how)
    want = tokens.join(feed, ["ioc_type", "value"], how)
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    heavy = matching.heavy_keys(tokens, ["ioc_type", "value"])
    salts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in heavy.items() for x in p]), F.xxhash64("ioc_type", "value")), F.lit(1))
    dealt = tokens.withColumn("s", F.pmod(F.xxhash64(F.lit(7), *tokens.columns), salts).cast("int")).repartition(16, "ioc_type", "value", "s")
    sizes = sorted(r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2], sizes


def test_sketches_of_days_merge_into_spans(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(f"2024-01-{d:02d}", rng.randrange(4_000), rng.gauss(0, 1)) for d in range(1, 11) for _ in range(3_000)], "d string, who int, v double")
    daily = sketches.daily_sketches(rows, "d", {"who": F.col("who")}, {"v": F.col("v")})
    assert daily.count() == 10 and daily.columns == ["day", "rows", "distinct_who", "values_v"]
    for span in (daily, daily.where("day > '2024-01-04'")):
        own = rows.where("d > '2024-01-04'") if span is not daily else rows
        m = sketches.merged(span).select("rows", sketches.distinct_of("who").alias("n"), *[sketches.quantile_of("v", q).alias(f"q{i}") for i, q in enumerate((0.1, 0.5, 0.99))],
                                         sketches.rank_of("v", 0.0).alias("r")).first()
        exact = own.agg(F.count_distinct("who")).first()[0]
        assert m.rows == own.count() and abs(m.n - exact) <= sketches.distinct_error() * exact
        for i, q in enumerate((0.1, 0.5, 0.99)):
            assert abs(own.where(F.col("v") <= m[f"q{i}"]).count() / m.rows - q) <= sketches.rank_error() + 1 / m.rows
        assert abs(own.where("v <= 0").count() / m.rows - m.r) <= sketches.rank_error()
    assert sketches.merged(daily, "day").count() == 10 and sketches.daily_sketches(rows.limit(0), "d", {"w": F.col("who")}, {}).count() == 0


@pytest.mark.parametrize("size", [15, 150, 1_000_000])
def test_login_history_before_each_login(spark, size):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "hot", "hot", "hot", None]), f"2024-01-{1 + rng.randrange(28):02d} {min(23, int(rng.expovariate(0.2))):02d}:00:00") for i in range(900)]
    logins = spark.createDataFrame(rows, "event_id int, user_name string, t string").select("event_id", "user_name", F.col("t").cast("timestamp").alias("ts"))
    got = hunts.unusual_logins_so_far(logins, max_share=0.06, min_history=10, sizes=Sizes(rows=size))
    before = lambda *k: Window.partitionBy(*k).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    want = logins.withColumn("hour", F.hour("ts")).withColumns({"logins": F.count("*").over(before("user_name", "hour")), "total": F.count("*").over(before("user_name"))})
    want = want.where("total >= 10 AND logins / total <= 0.06")
    cols = ["event_id", "hour", "logins", "total"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect())) and got.count() > 10
    assert Ordered(logins, ["user_name"], ["ts", "event_id"], Sizes(rows=size)).chunks == (1 if size > 900 else pytest.approx(900 / size, rel=0.3))
