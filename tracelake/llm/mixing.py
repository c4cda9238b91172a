"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key scaled by its quality weight. Within its
source, documents are taken in the order of their keys until the budget is met;
whole epochs come first, so only the part of the budget below one epoch selects.

Rows are never sorted whole. Sums per (source, key bucket) show the one bucket in
which a source's budget ends, only that bucket is put in order, and its last taken
key is the source's cut. A document's copies then follow from its own key.

Defined results: null texts have no words; a null source is a source of its own,
last in order. Documents without words cost nothing and follow the same rule.
Rows alike in id, text and source share one key and are taken or left together.
Columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import WORD, if_small, written

LETTERS = r"[^\p{L}]"  # letters of every script


@dataclass(frozen=True)
class Mix:
    """weights: of the sources by code point, null last, repeating. share: of all words that the mix holds.
    most: a source is taken at most so often. bucket_rows: rows put in order at once, about."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.0
    most: int = 3
    seed: int = 42
    bucket_rows: int = 20_000


def letter_share(text: Column) -> Column:
    """Quality weight in (0, 1]: the share of letters."""
    text = F.coalesce(text, F.lit(""))
    return (F.length(F.regexp_replace(text, LETTERS, "")) + 1) / (F.length(text) + 1)


def _keyed(docs: DataFrame, mix: Mix, *carried: Column) -> DataFrame:
    """(source, doc_id, size, key): key is exponential with the quality weight as its rate."""
    text = F.coalesce("text", F.lit(""))
    name = F.concat(F.lit(f"{mix.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.md5(text)))
    u = (F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("bigint") + 0.5) / float(2**48)
    return docs.select(*carried, F.struct("source").alias("source"), "doc_id",
                       F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"),
                       (-F.log(u) / letter_share(F.col("text"))).alias("key"))


def _targets(base: DataFrame, mix: Mix) -> DataFrame:
    """(source, source_size, target): water filling below the cap of each source.

    In order of cap per weight, sources are capped as long as their cap is within
    their share of what the sources before them left; the rest share by weight.
    One row per source goes through this window.
    """
    everything, order = Window.partitionBy(), Window.orderBy(F.col("source.source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in mix.weights])
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source.source").asc_nulls_last())
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = sizes.withColumn("weight", F.element_at(weights, (F.row_number().over(order) - 1) % len(mix.weights) + 1))
    s = s.withColumn("cap", F.col("source_size") * mix.most).withColumn("budget", F.sum("source_size").over(everything) * mix.share)
    s = s.withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("over", F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
    free = F.col("cap") > F.col("left") * F.col("weight") / F.col("over")
    # The first source that is not capped fixes what all later ones share.
    first = F.max(F.when(free, F.struct("over", "left"))).over(everything)
    s = s.withColumn("first", first)
    target = F.when(free, F.col("first.left") * F.col("weight") / F.col("first.over")).otherwise(F.col("cap"))
    return s.select("source", "source_size", target.cast("double").alias("target"))


def _bucket(buckets: Column) -> Column:
    """Place of a key's order of size: keys of any weight spread, since the buckets are narrow on the scale of logarithms.

    A key of weight w is exponential with rate w, so its logarithm lies within a few units of -log(w), wherever that is.
    """
    return F.floor(F.log("key") * buckets / 4)


def _cuts(base: DataFrame, mix: Mix) -> DataFrame:
    """(source, source_size, target, epochs, cut): cut is the last key taken in the epoch that is not whole."""
    buckets = max(16, base.count() // mix.bucket_rows)
    base = base.withColumn("bucket", _bucket(F.lit(buckets)))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = base.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    targets = _targets(base, mix).withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
    targets = targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    ends = sums.join(targets, "source").filter("rest > 0 and before <= rest and rest < before + words").select("source", "bucket", "before", "rest")
    # A document is taken when its middle is within the budget, which brings the sum nearest to it.
    place = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    last = (
        base.join(if_small(ends), ["source", "bucket"])
        .withColumn("middle", F.col("before") + F.coalesce(F.sum("size").over(place), F.lit(0)) + F.col("size") / 2)
        .groupBy("source", "bucket")
        .agg(F.max(F.when(F.col("middle") <= F.col("rest"), F.struct("key", "doc_id", "size"))).alias("within"))
    )
    # Where nothing of that bucket is taken, within is null and the cut is the bucket's lower edge.
    return targets.join(last, "source", "left").select("source", "source_size", "target", "epochs", "within",
                                                       F.col("bucket").alias("ends"), F.lit(buckets).alias("buckets"))


def _copies(base: DataFrame, cuts: DataFrame) -> DataFrame:
    bucket = _bucket(F.col("buckets"))
    inside = F.struct("key", "doc_id", "size") <= F.col("within")
    taken = F.coalesce((bucket < F.col("ends")) | ((bucket == F.col("ends")) & F.coalesce(inside, F.lit(False))), F.lit(False))
    return base.join(if_small(cuts), "source").withColumn("copies", (F.col("epochs") + taken.cast("int")).cast("int"))


def mix_table(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), one row per document, those left out included."""
    base = written(_keyed(docs, mix), "mix")
    cuts = written(_cuts(base, mix), "cuts")
    return _copies(base, cuts).select("doc_id", F.col("source.source").alias("source"), "size", "source_size", "target", "copies")


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: rows of docs with all their columns, each as often as it is taken."""
    cuts = written(_cuts(written(_keyed(docs, mix), "mix"), mix), "cuts")
    rows = _keyed(docs, mix, F.struct(*docs.columns).alias("_row"))
    times = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")
    return _copies(rows, cuts).filter("copies > 0").select("_row", times).select("_row.*")
