"""Exact deduplication: 128-bit content hash, bytes compared inside each hash group.

One aggregate groups by (hash, bytes): rows of one hash with other bytes are
another group, so a collision never merges texts. Copies collapse inside each map
task, so a group of any size reaches the shuffle as one row per task.

Defined results: null texts count as empty, and empty texts are equal to each
other. A null doc_id is smaller than any other; a group of null ids keeps one row.
Of repeated rows (same id, same text) one is kept. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import ascii_lower


def _md5(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, keep: str = "smallest", digest: Callable[[Column], Column] = _md5) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of docs.

    keep: "smallest" or "largest" id of a group stays. digest: the content hash; a
    weak one changes the grouping work, never the result.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    text = docs.select("doc_id", ascii_lower(F.col("text")).alias("bytes"))
    groups = (
        text.groupBy(digest(F.col("bytes")).alias("hash"), "bytes")
        .agg(F.count("*").alias("group_size"), best("doc_id").alias("keep_id"))
        .select("hash", F.sha2("bytes", 256).alias("text_sha256"), "group_size", "keep_id")
    )
    ids = (
        text.select("doc_id", digest(F.col("bytes")).alias("hash"), F.sha2("bytes", 256).alias("text_sha256"))
        .groupBy("hash", "text_sha256", "doc_id").agg(F.count("*").alias("copies"))
    )
    copy = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return (
        ids.join(groups, ["hash", "text_sha256"])
        .select("doc_id", "keep_id", "group_size", "text_sha256", copy)
        .select("doc_id", "keep_id", "group_size",
                (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")
    )


def drop_copies(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    stays = exact_groups(docs, keep).filter("kept").select(F.struct("doc_id", "text_sha256").alias("_stays"))
    key = F.struct("doc_id", F.sha2(ascii_lower(F.col("text")), 256).alias("text_sha256"))
    # A struct is never null, so rows without an id find their group as well.
    return docs.withColumn("_stays", key).join(stays, "_stays", "left_semi").dropDuplicates(["_stays"]).select(*docs.columns)
