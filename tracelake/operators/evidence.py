"""Evidence integrity, custody, drift and export rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.hashing import digest, stable_id
from tracelake.operators.ordered import Ordered, Sizes

FIELD_SEPARATOR = "þ"
TEXT_QUALIFIER = "ÿ"


def acquire(files: DataFrame, case: str, analyst: str) -> DataFrame:
    """Evidence rows of files (path, content, acquired_at) with digests and a repeatable id."""
    return files.select(
        stable_id("EV-", case, "path").alias("evidence_id"), F.col(case).alias("case_id"),
        F.col("path").alias("source_path"), F.col("acquired_at").alias("acquisition_timestamp"),
        F.lit(analyst).alias("acquired_by"), digest("content", "md5").alias("md5"),
        digest("content", "sha1").alias("sha1"), digest("content", "sha256").alias("sha256"),
        F.octet_length("content").cast("bigint").alias("file_size_bytes"))


def verify(evidence: DataFrame, current: DataFrame, algorithms=("md5", "sha1", "sha256"),
           path: str = "source_path") -> DataFrame:
    """Acquisition digests against current ones; a missing file is not intact.

    current: path and the digests. Status is INTACT, MODIFIED or MISSING.
    """
    now = current.select(F.col("path").alias(path), F.lit(True).alias("_found"),
                         *[F.col(a).alias(f"_now_{a}") for a in algorithms])
    out = evidence.join(now, path, "left")
    same = {f"{a}_match": F.coalesce(F.col(a) == F.col(f"_now_{a}"), F.lit(False)) for a in algorithms}
    out = out.withColumns(same)
    intact = F.lit(True)
    for name in same:
        intact = intact & F.col(name)
    status = F.when(F.col("_found").isNull(), "MISSING").when(intact, "INTACT").otherwise("MODIFIED")
    return out.withColumns({"intact": intact, "status": status}) \
              .drop("_found", *[f"_now_{a}" for a in algorithms])


def verification_totals(verified: DataFrame, keys: list[str] | None = None) -> DataFrame:
    grouped = verified.groupBy(*keys) if keys else verified
    return grouped.agg(
        F.count("*").alias("items"), F.count_if("intact").alias("intact_items"),
        F.count_if(F.col("status") == "MISSING").alias("missing_items"), F.bool_and("intact").alias("all_intact"))


def drift(before: DataFrame, after: DataFrame, key: str, digest_column: str) -> DataFrame:
    """Artifacts added, removed, changed or unchanged between two snapshots."""
    b = before.select(key, F.col(digest_column).alias("before_digest"))
    a = after.select(key, F.col(digest_column).alias("after_digest"))
    status = (F.when(F.col("before_digest").isNull(), "added").when(F.col("after_digest").isNull(), "removed")
              .when(F.col("before_digest") == F.col("after_digest"), "unchanged").otherwise("changed"))
    return b.join(a, key, "full").withColumn("drift", status)


def custody_rows(evidence: DataFrame) -> DataFrame:
    """One row per custody event, with its position in the log."""
    return evidence.select("evidence_id", "case_id", F.posexplode("custody_log").alias("seq", "e")) \
                   .select("evidence_id", "case_id", (F.col("seq") + 1).alias("seq"), "e.*")


def custody_check(custody: DataFrame, order: str = "seq", sizes: Sizes | None = None) -> DataFrame:
    """Each custody event with what is wrong with its place: the log must open with
    'acquired' and never go back in time."""
    at = F.col("timestamp").cast("timestamp")
    c = Ordered(custody, ["evidence_id"], [order], sizes).position("place").previous(at, "previous_ts").rows()
    issue = (F.when((F.col("place") == 1) & (F.col("action") != "acquired"), "not acquired first")
             .when((F.col("place") > 1) & (F.col("action") == "acquired"), "acquired again")
             .when(at < F.col("previous_ts"), "out of order"))
    return c.withColumn("issue", issue).drop("previous_ts")


def evidence_log(evidence: DataFrame) -> DataFrame:
    """Evidence table with the 14 export headings."""
    event = lambda e: F.concat(
        F.coalesce(e["action"], F.lit("?")), F.lit(" by "), F.coalesce(e["actor"], F.lit("?")), F.lit(" @ "),
        F.left(F.coalesce(e["timestamp"].cast("string"), F.lit("?")), F.lit(19)))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    empty = F.array().cast("array<string>")
    return evidence.select(
        text("evidence_id").alias("Evidence ID"), text("case_id").alias("Case ID"),
        text("evidence_type").alias("Type"), text("description").alias("Description"),
        text("source_path").alias("Source Path"),
        F.coalesce("file_size_bytes", F.lit(0).cast("bigint")).alias("File Size (bytes)"),
        text("md5").alias("MD5"), text("sha1").alias("SHA1"), text("sha256").alias("SHA256"),
        text("acquired_by").alias("Acquired By"), text("acquisition_timestamp").alias("Acquisition Time"),
        F.coalesce(F.array_join(F.transform("custody_log", event), "; "), F.lit("")).alias("Chain of Custody Events"),
        F.array_join(F.coalesce("tags", empty), ", ").alias("Tags"), text("notes").alias("Notes"))


LOAD_FILE_FIELDS = ["BEGDOC", "ENDDOC", "FILENAME", "DOCDATE", "DOCTYPE", "CUSTODIAN",
                    "MD5HASH", "SHA256HASH", "FILEPATH", "FILESIZE"]


def load_file_header(separator: str = FIELD_SEPARATOR, qualifier: str = TEXT_QUALIFIER) -> str:
    return separator.join(f"{qualifier}{h}{qualifier}" for h in LOAD_FILE_FIELDS)


def load_file_lines(evidence: DataFrame, separator: str = FIELD_SEPARATOR,
                    qualifier: str = TEXT_QUALIFIER) -> DataFrame:
    """E-discovery load file, one line per item, each field wrapped in the qualifier."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    item = F.coalesce(F.col("evidence_id").cast("string"), F.lit("N/A"))
    fields = [item, item, text(F.col("description")),
              F.left(text(F.col("acquisition_timestamp")), F.lit(10)), text(F.col("evidence_type")),
              text(F.col("acquired_by")), text(F.col("md5")), text(F.col("sha256")), text(F.col("source_path")),
              F.coalesce("file_size_bytes", F.lit(0).cast("bigint")).cast("string")]
    wrapped = [F.concat(F.lit(qualifier), f, F.lit(qualifier)) for f in fields]
    return evidence.select("evidence_id", F.concat_ws(separator, *wrapped).alias("line"))


def manifest(files: DataFrame) -> DataFrame:
    """Artifact manifest: type, path, size, digests (NULL where unreadable), time."""
    return files.select("artifact_type", "path", F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint")
                        .alias("size_bytes"), digest("content", "md5").alias("md5"),
                        digest("content", "sha256").alias("sha256"), "collected_at")


