"""Byte ranges, repeatable appends, event leaves and expiring feeds."""

import collections
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tracelake.functions import tokens
from tracelake.functions.text import event_leaves
from tracelake.operators import files as fs
from tracelake.operators import matching
from tracelake.sinks.batches import append_batch, batches, read_batches, unpublished
from tracelake.sinks.writers import text_files
from tracelake.sources.ranges import file_ranges, file_sizes

MARKS = [("4D5A90", "a"), ("DEADBEEF", "b")]


@pytest.fixture(scope="module")
def image(tmp_path_factory):
    """A file longer than a range, with marks on every kind of border, and an empty one."""
    rng, root = random.Random(3), tmp_path_factory.mktemp("img")
    raw = bytearray(rng.randbytes(300_000))
    places = {0, 299_996, 65_535, 65_536, 131_071, 99, 1_022, 1_023, 1_024, 200_000}
    for at in places:
        raw[at : at + 4] = bytes.fromhex("DEADBEEF")
    (root / "sub").mkdir()
    (root / "sub" / "a b.img").write_bytes(raw)
    (root / "empty.img").write_bytes(b"")
    return str(root), bytes(raw)


@pytest.mark.parametrize("size, chunk", [(1 << 16, 1 << 10), (1 << 16, 1 << 20), (7_001, 333), (1 << 20, 4_096)])
def test_ranges_give_the_file(spark, image, size, chunk):
    root, raw = image
    parts = file_ranges(spark, root, 3, size, chunk).orderBy("base").collect()
    assert b"".join(bytes(r.chunk[: r.own_bytes]) for r in parts) == raw
    assert max(len(r.chunk) for r in parts) <= min(size, chunk) + 3
    assert all(bytes(r.chunk) == raw[r.base : r.base + r.own_bytes + 3] for r in parts)


def test_carving_and_entropy_over_ranges(spark, image):
    root, raw = image
    want = [(s, i) for s, _ in MARKS for i in range(len(raw)) if raw.startswith(bytes.fromhex(s), i)]
    assert len(want) >= 7
    parts = file_ranges(spark, root, fs.overlap_of(MARKS), 1 << 14, 1_000)
    assert sorted((r.signature, r.offset) for r in fs.carve_ranges(parts, MARKS).collect()) == sorted(want)
    counts = collections.Counter(raw)
    entropy = -sum(n / len(raw) * math.log2(n / len(raw)) for n in counts.values())
    got = fs.range_entropy(parts, ["path"]).collect()
    assert len(got) == 1 and got[0].size == len(raw) and abs(got[0].entropy - entropy) < 1e-9
    one = spark.createDataFrame([("x", bytearray(b"aaaa"))], "path string, content binary")
    assert fs.range_entropy(fs.content_chunks(one, "path", "content", 3, 2), ["path"]).first().entropy == 0


def test_files_are_listed_without_their_content(spark, image):
    plan = file_sizes(spark, image[0])._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]
    assert [r.size for r in file_sizes(spark, image[0]).collect()] == [300_000]  # Spark lists no empty file
    with pytest.raises(ValueError):
        file_ranges(spark, image[0], chunk=0)


def test_a_repeated_batch_counts_once(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "id long"
    (tmp_path / "log").mkdir()
    append_batch(spark.range(5), path, "b-1")
    append_batch(spark.range(5, 8), path, "b-2")
    append_batch(spark.range(100, 104), path, "b-1")
    assert sorted(r.id for r in read_batches(spark, path, schema).collect()) == [5, 6, 7, 100, 101, 102, 103]
    assert {r.batch: r.rows for r in batches(spark, path).collect()} == {"b-1": 4, "b-2": 3}
    assert unpublished(spark, path).count() == 1
    append_batch(spark.range(0), path, "b-2")
    assert read_batches(spark, path, schema).count() == 4
    with pytest.raises(ValueError):
        append_batch(spark.range(1), path, "../x")


def test_a_batch_that_fails_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "log")
    append_batch(spark.range(3), path, "b-1")
    bad = spark.range(4).withColumn("id", F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("long")))
    with pytest.raises(Exception, match="lost"):
        append_batch(bad, path, "b-1")
    assert read_batches(spark, path, "id long").count() == 3


def test_text_files(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.json", "é"), ("b.txt", None)], "name string, text string")
    assert sorted(tuple(r) for r in text_files(rows, str(tmp_path)).collect()) == [("a/x.json", 2), ("b.txt", 0)]
    assert (tmp_path / "a" / "x.json").read_text() == "é"


EVENTS = [
    {"a": {"b": "Evil.Example.ORG", "c": [1, [2, {"d": "CVE-2024-12345"}], None, {}]}, "k.example.net": {"x": True}, "t": "line\nnext.example.com", "deep": {"e": {"f": "line\nlast.example.com"}}},
    ["203.0.113.9", {"mail": "A@b.example.org"}], "plain", 5.5, None, {},
]


def leaves(value, path="$"):
    if isinstance(value, dict):
        for k, v in value.items():
            at = f"{path}.{k}" if k.isidentifier() else f'{path}."{k}"'
            yield from leaves(v, at)
            if "." in k:
                yield at + "~", k
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from leaves(v, f"{path}[{i}]")
    elif value is not None:
        yield path, json.dumps(value) if not isinstance(value, str) else value


def test_leaves_of_events(spark):
    df = spark.createDataFrame([(i, json.dumps(e)) for i, e in enumerate(EVENTS)] + [(99, "no json")], "id int, j string")
    df = df.select("id", F.try_parse_json("j").alias("e"))
    got = {r.id: sorted((x.path, x.text) for x in r.l) for r in df.select("id", event_leaves("e").alias("l")).collect()}
    assert got == {**{i: sorted(leaves(e)) for i, e in enumerate(EVENTS)}, 99: []}
    # What is deeper than the levels comes as one text, so its tokens are still found.
    flat = df.select("id", event_leaves("e", 1).alias("l")).where("id = 0").first().l
    assert any(x.path == "$.a" and "CVE-2024-12345" in x.text for x in flat)
    shallow, deep = ({(r.ioc_type, r.value) for r in tokens.event_path_tokens(df, "e", ["id"], levels=n).collect()} for n in (1, 8))
    assert shallow == deep and {("cve", "cve-2024-12345"), ("domain", "next.example.com"), ("domain", "last.example.com"), ("ip", "203.0.113.9"), ("email", "a@b.example.org")} <= deep


def test_feed_entries_count_while_valid(spark):
    day = lambda d, h=0: f"2024-01-{d:02d} {h:02d}:00:00"
    rows = [(i, "domain", v, day(*t)) for i, (v, t) in enumerate([("x", (4, 23)), ("x", (5,)), ("x", (7, 23)), ("x", (8,)), ("x", (20,)), ("y", (1,)), ("z", (9,)), ("n", (9,)), ("x", (12,))])]
    events = spark.createDataFrame(rows, "id int, ioc_type string, value string, t string").select("id", "ioc_type", "value", F.col("t").cast("timestamp").alias("ts"))
    events = events.union(spark.sql("SELECT 100, 'domain', 'x', CAST(NULL AS timestamp)"))
    entries = [("x", day(5), day(8), "first"), ("x", day(12), day(13), "again"), ("x", day(11), None, "open"), ("y", None, day(2), "old"), ("z", None, None, "always"),
               ("z", day(3), day(2), "never"), ("w", day(1), day(30), "none")]
    feed = spark.createDataFrame([("domain", *e) for e in entries], "ioc_type string, value string, f string, u string, tag string").select(
        "ioc_type", "value", F.col("f").cast("timestamp").alias("first_seen"), F.col("u").cast("timestamp").alias("expires"), "tag")
    want = [(1, "first"), (2, "first"), (4, "open"), (5, "old"), (6, "always"), (8, "again"), (8, "open")]
    for seconds in (3_600, 86_400, 10_000_000):
        got = matching.match_valid(events, feed, "ts", seconds)
        assert got.columns == ["ioc_type", "value", "id", "ts", "tag"]
        assert sorted((r.id, r.tag) for r in got.collect()) == want


def test_csv_keeps_spaces(spark, tmp_path):
    from tracelake.sinks.writers import hits_csv

    row = spark.createDataFrame([("t", "h", " v ", "ip", "high", 1, "s", 'say "hi", twice ')], "hit_time string, host string, value string, ioc_type string, severity string, "
                                "confidence int, source string, description string")
    hits_csv(row, f"{tmp_path}/h")
    got = spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/h").first()
    assert (got["IOC Value"], got["Description"]) == (" v ", 'say "hi", twice ')
