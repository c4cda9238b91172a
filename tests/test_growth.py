"""Plans and files that must not grow faster than their tables."""

import json
import re

from pyspark.sql import functions as F

from tracelake.functions import tokens as tk
from tracelake.functions.text import event_leaf_rows, event_leaves
from tracelake.operators.matching import feed_side, match_event_paths, match_valid
from tracelake.plans import streams
from tracelake.sources.events import read_event_blocks
from tracelake.streaming import feeds as st


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_valid_tokens_are_made_and_joined_once(spark):
    day = "timestamp_ntz '2024-01-0{}'"
    tokens = spark.range(2000).selectExpr("id", "'ip' AS ioc_type", "concat('v', id % 50) AS value", f"{day.format(2)} AS ts")
    feed = spark.range(4).selectExpr("'ip' AS ioc_type", "concat('v', id) AS value", "id AS weight",
                                     f"IF(id < 3, {day.format(1)}, NULL) AS first_seen", f"IF(id = 1, NULL, IF(id = 2, {day.format(2)}, {day.format(3)})) AS expires")
    got = match_valid(tokens, feed, bits=1 << 10)
    assert plan_of(got).count("Join ") == 1
    assert {r.value: r["count"] for r in got.groupBy("value").count().collect()} == {"v0": 40, "v1": 40, "v3": 40}


ODD = [
    {"a": {"b": "Evil.Example.ORG", "c": [1, [2, {"d": "CVE-2024-12345"}], None, {}, []]}, "k.example.net": {"x": True, "y-1": [None]}, "": "", "t": "line\nnext.example.com"},
    {"k.example.net": None, "a" * 32: {"e": {"f": "line\nlast.example.com"}}}, ["203.0.113.9", {"mail": "A@b.example.org"}], "plain", 5.5, None, {}, [], [[[[1.5]]]],
    {"m": "A" * 32 + " " + "b" * 40, "s": "C" * 64 + "." + "d" * 33, "n": "x" * 64 + ".com a.b.c1 -a.de HTTP://Q.org/%20?"},
]


def test_leaves_and_tokens_of_events_are_compiled(spark):
    df = spark.createDataFrame([(i, json.dumps(e)) for i, e in enumerate(ODD)] + [(99, "no json"), (100, None)], "id int, j string")
    df = df.select("id", F.try_parse_json("j").alias("e"))
    plan = plan_of(tk.event_path_tokens(df, "e", ["id"]))
    assert "lambda" not in plan and plan.count("parseJson") <= 1
    for levels in (1, 2, 8):
        rows = event_leaf_rows(df, "e", ["id"], levels)
        want = df.select("id", F.explode(event_leaves("e", levels)).alias("l")).select("id", "l.path", "l.text")
        assert rows.columns == want.columns and sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.collect()))
    low = want.withColumn("text", F.lower("text"))
    kinds = {"ip": tk.EVENT_IP, "domain": tk.EVENT_DOMAIN, "hash_sha256": tk.EVENT_SHA256, "url": tk.URL, "email": tk.EMAIL, "cve": tk.CVE, "hash_md5": tk.MD5, "hash_sha1": tk.SHA1}
    found = [(r.id, r.path, k, v) for k, p in kinds.items() for r in low.select("id", "path", F.array_distinct(tk.find_all("text", p)).alias("v")).collect() for v in r.v]
    got = sorted(map(tuple, tk.event_path_tokens(df, "e", ["id"]).collect()))
    assert got == sorted(found) and set(kinds) == {k for _, _, k, _ in got}


def test_patterns_of_lowered_texts_find_the_same_in_one_pass(spark):
    low = " -_.@:/x\u0130\u212a\u00e9\n"
    pieces = ["a.bc", "A-.b.co", "1.2.3.4", "999.1.1.1.", "HTTPS://Q/x'", "http://", "a@b.cd", "CVE-2024-12345678", "cve-2024-1234", "A" * 32, "b" * 40, "c" * 64, "9" * 33, "x" * 64 + ".com", "e1" * 16 + ".org"]
    texts = [a + s + b for a in pieces for b in pieces for s in low]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    kinds = {"ip": tk.EVENT_IP, "domain": tk.EVENT_DOMAIN, "hash_sha256": tk.EVENT_SHA256, "url": tk.URL, "email": tk.EMAIL, "cve": tk.CVE, "hash_md5": tk.MD5, "hash_sha1": tk.SHA1}
    lists = df.select("id", *[F.array_distinct(tk.find_all(F.lower("text"), p)).alias(k) for k, p in kinds.items()]).collect()
    for extended in (True, False):
        got = tk.event_token_rows(df, "text", ["id"], extended=extended)
        want = [(r.id, k, v) for r in lists for k in (kinds if extended else list(kinds)[:3]) for v in r[k]]
        assert sorted(map(tuple, got.collect())) == sorted(want) and len({k for _, k, _ in want}) == (8 if extended else 3)
        # A text is asked for a dot once, and for digests by the search itself.
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count(", .)") == 1 and not re.search(r"RLIKE\([^,]*, [^,]*\{32\}", plan)


def test_tokens_of_events_do_not_move_to_a_small_feed(spark):
    events = spark.range(50).select("id", F.parse_json(F.concat(F.lit('{"h":"h'), F.col("id"), F.lit('.example.com"}'))).alias("e"))
    feed = spark.range(20_000).select(F.lit("domain").alias("ioc_type"), F.concat(F.lit("h"), F.col("id") * 2, F.lit(".example.com")).alias("value"))
    got = match_event_paths(events, "e", ["id"], feed)
    assert "BuildRight" in got._jdf.queryExecution().executedPlan().toString() and sorted(r.id for r in got.collect()) == list(range(0, 50, 2))
    tokens = spark.range(5).select(F.lit("domain").alias("ioc_type"), F.concat(F.lit("h"), F.col("id"), F.lit(".example.com")).alias("value"))
    merged = tokens.join(feed_side(feed, 100), ["ioc_type", "value"])
    assert "SortMergeJoin" in merged._jdf.queryExecution().executedPlan().toString() and merged.count() == 3


def test_valid_tokens_are_never_copied_to_the_driver(spark):
    day = "timestamp_ntz '2024-01-0{}'"
    tokens = spark.range(50).selectExpr("id", "'ip' AS ioc_type", "concat('v', id) AS value", f"{day.format(2)} AS ts")
    feed = spark.range(20_000).selectExpr("'ip' AS ioc_type", "concat('v', id * 2) AS value", f"{day.format(1)} AS first_seen", f"IF(id % 2 = 0, NULL, {day.format(3)}) AS expires")
    got = match_valid(tokens, feed)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan and sorted(r.id for r in got.collect()) == list(range(0, 50, 2))


def test_valid_tokens_get_their_keys_in_compiled_code(spark):
    day = "timestamp_ntz '2024-01-0{}'"
    tokens = spark.range(6).selectExpr("id", "'ip' AS ioc_type", "'v' AS value", f"IF(id = 5, NULL, {day.format(1)} + make_dt_interval(cast(id AS int))) AS ts")
    feed = spark.range(3).selectExpr("'ip' AS ioc_type", "'v' AS value", "id AS weight", f"IF(id = 0, {day.format(2)}, NULL) AS first_seen", f"IF(id = 2, NULL, {day.format(4)}) AS expires")
    got = match_valid(tokens, feed)
    made = [line for line in plan_of(got).splitlines() if "Generate explode" in line]
    assert made and not any("lambda" in line for line in made)
    # One entry with both bounds, one that ends, one without bounds; a token without time meets none.
    assert sorted((r.id, r.weight) for r in got.collect()) == [(0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (3, 2), (4, 2)]


def test_pairs_of_a_block_are_made_once(spark, write):
    got = read_event_blocks(spark, write("blocks.txt", "Event[1]:\n A: 1\n A: 2: x\nnothing\nEvent[2]:\nnothing\nEvent[3]:\nB: \n"))
    assert plan_of(got).count("split_part(") <= 1
    assert sorted(map(str, (r.fields for r in got.collect()))) == sorted(map(str, [{"A": "2: x"}, {"B": ""}]))


def test_batches_of_large_streams_have_more_files(spark, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 100)
    rows = spark.range(1000).select(F.col("id").alias("event_id"), F.lit("h").alias("host"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    got = st.run_available(streams.arriving(rows, "event_id", "host"))
    assert streams.real(got).count() == 1000 and got.count() == 1000 + 2 * 4
