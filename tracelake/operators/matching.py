"""Indicator matching: events, digests and keywords against feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.content.lookups import INDICATOR_TYPES
from tracelake.functions.binding import let
from tracelake.functions.tokens import (
    BUNDLE_TYPES, DOMAIN, event_path_tokens, event_token_rows, find_all, token_rows, urls,
)
from tracelake.functions.times import micros
from tracelake.operators.ordered import first_per_group


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salts: int, how: str = "inner") -> DataFrame:
    """Equi-join in which each key of the left side is spread over `salts` tasks.

    The right side is repeated once per salt, so use it where right holds few rows
    per key. `how` may be inner or left.
    """
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")


def heavy_keys(rows: DataFrame, on: list[str], share: float = 1 / 64) -> dict[int, int]:
    """hash -> salts of the keys that hold more than a share of the rows, found by one sketch pass; 1 / share of them at most.

    salts: how often the share goes into the key's rows, so that many tasks get no more than a share each.
    """
    if not 0 < share <= 1:
        raise ValueError("share lies above 0 and at most 1")
    most = -(-1 // share)
    key = F.xxhash64(*on).alias("_key")
    # A sketch with many counters beyond the wanted keys misses none that is so frequent.
    found = rows.select(key).agg(F.expr(f"approx_top_k(_key, {int(most)}, {int(min(1_000_000, 64 * most))})").alias("top"), F.count("*").alias("n")).first()
    limit = share * found["n"]
    return {r["item"]: int(-(-r["count"] // limit)) for r in found["top"] if r["count"] > limit}


def heavy_join(left: DataFrame, right: DataFrame, on: list[str], share: float = 1 / 64, how: str = "inner") -> DataFrame:
    """Equi-join in which only the keys that are heavy on the left are spread over tasks, each over as many as it needs.

    The rows of right with such a key are repeated; all others move once. Rows of left that are equal in all columns
    stay together, so keep an id in them. how may be inner or left.
    """
    heavy = heavy_keys(left, on, share)
    if not heavy:
        return left.join(right, on, how)
    known = F.create_map(*[F.lit(x) for pair in heavy.items() for x in pair])
    salts = F.coalesce(F.try_element_at(known, F.xxhash64(*on)), F.lit(1))
    spread = left.withColumn("_salt", F.pmod(F.xxhash64(F.lit(7), *left.columns), salts).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return spread.join(copies, [*on, "_salt"], how).drop("_salt")


def match_tokens(tokens: DataFrame, feed: DataFrame, salts: int | None = 1) -> DataFrame:
    """Token rows (ids, ioc_type, value) that a feed lists.

    No broadcast is forced: Spark broadcasts the feed when its measured size is
    below the limit of the session, and joins by shuffle otherwise. For a feed
    beyond that limit set salts, so that one hot indicator is spread; with None the
    hot indicators are found first, and only they are spread.
    """
    if salts is None:
        return heavy_join(tokens, feed, ["ioc_type", "value"])
    if salts > 1:
        return salted_join(tokens, feed, ["ioc_type", "value"], salts)
    return tokens.join(feed, ["ioc_type", "value"])


def feed_side(feed: DataFrame, few: int = 200_000) -> DataFrame:
    """The feed, marked as what a join with tokens copies to every task (few rows, counted) or merges (more).

    Spark takes the tokens of a table for no larger than its files, and might copy them or shuffle all of them to a small feed.
    """
    return feed.hint("broadcast" if feed.limit(few + 1).count() <= few else "merge")


def match_events(events: DataFrame, text: str, ids: list[str], feed: DataFrame,
                 per_occurrence: bool = False, extended: bool = False, salts: int = 1) -> DataFrame:
    """One hit per event and feed entry; per_occurrence keeps repeats within an event."""
    tokens = event_token_rows(events, text, ids, distinct=not per_occurrence, extended=extended)
    return match_tokens(tokens, feed, salts)


def likely_tokens(tokens: DataFrame, feed: DataFrame, on: list[str], bits: int = 1 << 24) -> DataFrame:
    """The token rows whose key a bitmap of the feed's keys has: all that match, and few others, before any shuffle."""
    bitmap = _bitmap(feed.select(F.xxhash64(*on).alias("_key")), bits)
    return tokens.where(_taken(F.xxhash64(*on), bitmap, bits))


def match_valid(tokens: DataFrame, feed: DataFrame, ts: str = "ts", seconds: int = 86_400, bits: int = 1 << 24) -> DataFrame:
    """Token rows (ioc_type, value, ts, ...) with the feed entries that are valid at their time: first_seen <= ts < expires.

    feed: ioc_type, value, first_seen, expires, ...; a NULL bound is open. An entry with both bounds is joined by the time
    buckets it covers, so a value that was listed many times meets only what is near in time, and the events
    of a frequent value spread over their buckets. Choose seconds so that an entry covers few buckets.

    Tokens are made once: a row is joined by its bucket, by no bucket (entries with an open bound), by both or by neither, as
    bitmaps of the feed's keys allow, so only rows that are likely to match are shuffled, and none where the feed is small (feed_side).
    bits, a power of two: size of a bitmap.
    """
    at, bucket = micros(ts), lambda c: F.floor(c / F.lit(seconds * 1_000_000)).cast("long")
    always = F.lit(-(1 << 63)).cast("long")  # in place of a bucket: no time has this one
    on = ["ioc_type", "value", "_bucket"]
    versions = feed.withColumns({"_from": micros("first_seen"), "_until": micros("expires")}).drop("first_seen", "expires")
    bounded = F.col("_from").isNotNull() & F.col("_until").isNotNull()
    covered = F.when(~bounded, F.array(always)).when(F.col("_from") < F.col("_until"), F.sequence(bucket(F.col("_from")), bucket(F.col("_until") - 1)))
    entries = versions.withColumn("_bucket", F.explode(covered))
    bitmap = _bitmap(entries.select(F.xxhash64(*on).alias("_key")), bits)
    rows = tokens.withColumn("_at", at).where(F.col("_at").isNotNull())
    # Both keys as rows, then the bitmap: without functions on array elements, so that Spark compiles the step.
    rows = rows.withColumn("_bucket", F.explode(F.array(bucket(F.col("_at")), always))).where(_taken(F.xxhash64(*on), bitmap, bits))
    inside = F.coalesce(F.col("_at") >= F.col("_from"), F.lit(True)) & F.coalesce(F.col("_at") < F.col("_until"), F.lit(True))
    return rows.join(feed_side(entries), on).where(inside).drop("_at", "_from", "_until", "_bucket")


def match_event_paths(events: DataFrame, event: str, ids: list[str], feed: DataFrame, ts: str | None = None,
                      levels: int = 8, salts: int = 1, seconds: int = 86_400) -> DataFrame:
    """(ids, path, ioc_type, value, feed columns): what whole VARIANT events share with a feed, on all eight types of tokens.

    With ts, a feed entry counts while it is valid at the event's time.
    """
    if ts is None:
        tokens = event_path_tokens(events, event, ids, levels=levels)
        return match_tokens(likely_tokens(tokens, feed, ["ioc_type", "value"]), feed_side(feed), salts)
    tokens = event_path_tokens(events, event, list(dict.fromkeys([*ids, ts])), levels=levels)
    return match_valid(tokens, feed, ts, seconds)


def match_digests(hashes: DataFrame, column: str, feed: DataFrame) -> DataFrame:
    """Digest list against a feed; the type follows from the length."""
    value = F.lower(F.col(column))
    size = F.length(value)
    kind = (F.when(size == 32, "hash_md5").when(size == 40, "hash_sha1").when(size == 64, "hash_sha256"))
    return hashes.withColumns({"ioc_type": kind, "value": value}).where(kind.isNotNull()) \
                 .join(feed, ["ioc_type", "value"])


def feed_counts(feed: DataFrame) -> DataFrame:
    """Entries per indicator type, with a row for each type."""
    domain = feed.sparkSession.createDataFrame([(t,) for t in INDICATOR_TYPES], "ioc_type string")
    counted = feed.groupBy("ioc_type").agg(F.count("*").alias("n"))
    return domain.join(counted, "ioc_type", "left").select("ioc_type", F.coalesce("n", F.lit(0)).alias("n"))


def keyword_flags(text, words: list[str]) -> Column:
    """Words of a short list that occur in the text, case ignored."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    marks = [F.when(low.contains(w.lower()), F.lit(w)) for w in words]
    return F.array_compact(F.array(*marks))


def _words(text) -> Column:
    """Runs of ASCII letters and digits, in text order."""
    return F.filter(F.split(text, "[^A-Za-z0-9]+"), lambda w: w != F.lit(""))


def _inner_words(text) -> Column:
    """Words of a keyword that have a separator on both sides inside it."""
    inner = let(F.split(text, "[^A-Za-z0-9]+"), lambda parts: F.when(
        F.size(parts) > 2, F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))))
        .otherwise(F.array().cast("array<string>")))
    return F.filter(inner, lambda w: w != F.lit(""))


def _grams(words: Column, n: int) -> Column:
    """Distinct runs of n words. The word list is laid beside itself, shifted, so the work is linear."""

    def build(w: Column) -> Column:
        shifted = [F.slice(w, F.lit(i + 1), F.greatest(F.size(w) - i, F.lit(0))).alias(f"w{i}") for i in range(n)]
        runs = F.filter(F.arrays_zip(*shifted), lambda z: z[f"w{n - 1}"].isNotNull())
        return F.array_distinct(F.transform(runs, lambda z: F.concat_ws(" ", *[z[f"w{i}"] for i in range(n)])))

    return let(words, build)


def _own_key(words: DataFrame, keys: Column) -> DataFrame:
    """(_word, _key): a key that no other keyword has, the longest one; else its longest key.

    A phrase that opens a third of the feed would pair every text that holds it
    with all of them; a key of the keyword's own part does not.
    """
    spread = words.select("_word", F.explode(keys).alias("_key"))
    shared = spread.groupBy("_key").agg(F.count("*").alias("_n"))
    best = F.max_by("_key", F.struct(F.col("_n") == 1, F.length("_key"), "_key")).alias("_key")
    return spread.join(shared, "_key").groupBy("_word").agg(best)


def _bitmap(keys: DataFrame, bits: int) -> Column:
    """Which of `bits` hash places the keys take, as one array of 64-bit numbers: bits / 8 bytes, however many keys."""
    place = F.pmod(F.xxhash64("_key"), F.lit(bits))
    numbers = keys.groupBy(F.shiftright(place, 6).cast("int").alias("_at")) \
                  .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(63).cast("int"))).alias("_bits"))
    # Every place as a row, those without a key included, in order.
    spark = keys.sparkSession
    every = spark.range(bits // 64).select(F.col("id").cast("int").alias("_at"), F.lit(0).cast("bigint").alias("_bits"))
    filled = numbers.unionByName(every).groupBy("_at").agg(F.bit_or("_bits").alias("_bits"))
    return filled.select(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_bits"))), lambda p: p["_bits"])).scalar()


def _taken(key: Column, bitmap: Column, bits: int) -> Column:
    """Whether the bitmap has the key's place: false only for keys that are not in it."""
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    number = F.element_at(bitmap, (F.shiftright(place, 6) + 1).cast("int"))
    return F.call_function("shiftright", number, place.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def match_keywords(texts: DataFrame, text: str, ids: list[str], feed: DataFrame, keyword: str,
                   feed_ids: list[str], anchor_words: int = 3, short_length: int = 8, bits: int = 1 << 20) -> DataFrame:
    """Rows whose text contains a keyword of a large feed, case ignored: (ids, feed_ids).

    contains() has no join key, so one is made. A keyword with enough inner words
    (words that have a separator on both sides inside the keyword) must show the
    same words in a row in any text that contains it; one such run is the key.
    Other keywords use a run of their characters. A key that no other keyword has is
    taken where there is one. Runs of a text are dropped before any shuffle unless a bitmap of
    the feed's keys has their place, so only texts with a likely key are shuffled. Candidates are then checked with contains(), so
    the result is exact. bits, a power of two: size of the bitmap; about twice the number of
    keys or more keeps it sharp. ids must identify a text.
    """
    t = texts.select(*ids, F.lower(F.col(text)).alias("_text")).where(F.length("_text") > 0)
    f = feed.select(*feed_ids, F.lower(F.col(keyword)).alias("_word")).where(F.length("_word") > 0)
    words = f.select("_word").distinct().withColumn("_inner", _inner_words(F.col("_word")))
    by_words = F.size("_inner") >= anchor_words
    whole_or_cuts = F.when(F.length("_word") <= short_length, F.array("_word")).otherwise(
        F.array_distinct(F.regexp_extract_all("_word", F.lit("(?s)(?=(.{%d}))" % short_length), F.lit(1))))
    runs_of_word = F.when(by_words, _grams(F.col("_inner"), anchor_words)).otherwise(whole_or_cuts)
    keys = _own_key(words, runs_of_word)

    # At most short_length numbers: without short keywords no run of characters is made at all.
    short = words.where(~by_words).select(F.least(F.length("_word"), F.lit(short_length)).alias("_n"))
    lengths = short.select(F.collect_set("_n")).scalar()
    pieces = F.flatten(F.transform(
        F.col("_lengths"),
        # All runs of n characters, found by one pass of a look-ahead.
        lambda n: F.regexp_extract_all(F.col("_text"), F.concat(
            F.lit("(?s)(?=(.{"), n.cast("string"), F.lit("}))")), F.lit(1))))
    runs = F.array_union(_grams(_words(F.col("_text")), anchor_words), pieces)
    made = t.withColumn("_lengths", lengths).withColumn("_runs", runs).drop("_lengths")
    # The text stays beside its runs: it is copied for the runs that pass the bitmap only.
    # The bitmap has all runs of the keywords, of which the chosen keys are some: it needs no join.
    bitmap = _bitmap(words.select(F.explode(runs_of_word).alias("_key")), bits)
    # explode_outer, since for explode Spark would compute the runs again in a filter on their number.
    likely = made.select(*ids, "_text", F.explode_outer("_runs").alias("_key")).where(_taken(F.col("_key"), bitmap, bits))
    found = likely.join(keys, "_key").where(F.contains("_text", "_word")).select(*ids, "_word")
    return found.join(f, "_word").select(*ids, *feed_ids).distinct()


def enrich(indicators: DataFrame, reputation: DataFrame, per_type: int | None = None,
           group: list[str] | None = None) -> DataFrame:
    """Indicators of each type, the first per_type or all, with their reputation (NULL where unknown)."""
    keys = [*(group or []), "ioc_type"]
    chosen = first_per_group(indicators.select(*keys, "value").distinct(), keys, ["value"], per_type)
    return chosen.join(reputation, ["ioc_type", "value"], "left")


DOT_WINDOW = 24


def _dot_windows(url, width: int = DOT_WINDOW) -> Column:
    """For each dot of a URL, what stands around it: 1 to width characters before, the dot, two characters after.

    A URL that holds a domain holds the window of the domain's last dot, so windows
    are join keys; their number grows with the dots of a URL, not with its length.
    """
    runs = F.filter(find_all(url, "[A-Za-z0-9.-]+"), lambda r: F.contains(r, F.lit(".")))

    def windows(n: int) -> Column:
        # A look-ahead from each start finds dots that lie n characters further on.
        pattern = F.lit(r"(?=([A-Za-z0-9.-]{%d}\.[A-Za-z]{2}))" % n)
        return F.flatten(F.transform(runs, lambda r: F.regexp_extract_all(r, pattern, F.lit(1))))

    return F.array_distinct(F.concat(*[windows(n) for n in range(1, width + 1)]))


def _last_dot(domain, width: int = DOT_WINDOW) -> Column:
    """The window of a domain's last dot."""
    return F.regexp_extract(domain, r"([A-Za-z0-9.-]{1,%d}\.[A-Za-z]{2})[A-Za-z]*$" % width, 1)


def case_tokens(rows: DataFrame, text: str, case: str, exclude_private: bool = True) -> DataFrame:
    """Distinct tokens of each case, as if its texts were one: (case, ioc_type, value).

    A domain is left out when it is part of a URL anywhere in the case, not only in
    its own row. Domains meet URLs by equality of the case and of the window around the
    domain's last dot, and contains() decides: a case of any size is spread over its
    windows, and the anti join stops at a domain's first URL.
    """
    others = [k for k in BUNDLE_TYPES if k != "domains"]
    plain = token_rows(rows, text, [case], kinds=others, exclude_private=exclude_private).distinct()
    raw = rows.select(case, F.explode(F.array_distinct(find_all(text, DOMAIN))).alias("_domain")).distinct()
    addresses = rows.select(case, F.explode(F.array_distinct(urls(text))).alias("_url")).distinct()
    windows = addresses.select(F.col(case).alias("_case"), "_url", F.explode(_dot_windows("_url")).alias("_key"))
    inside = (F.col(case) == F.col("_case")) & (_last_dot("_domain") == F.col("_key")) & F.contains("_url", "_domain")
    alone = raw.join(windows, inside, "left_anti")
    return plain.unionByName(alone.select(
        case, F.lit("domain").alias("ioc_type"), F.lower("_domain").alias("value")).distinct())
