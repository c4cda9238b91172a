"""Appends that can be repeated.

A batch is written to a folder of its own and becomes visible by its entry in the manifest, which names that
folder. Writing a batch id again writes another folder and replaces the entry: readers, who follow the manifest, see
each batch once, and never half of one. Folders that no entry names hold attempts that failed or were replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "batch string, folder string, rows long"


def append_batch(df: DataFrame, path: str, batch: str | int, fmt: str = "parquet", **options) -> None:
    """Rows of df as the batch of this id below path; a repeat replaces what the id held before."""
    batch = str(batch)
    if not batch.replace("-", "").replace("_", "").isalnum():
        raise ValueError("a batch id has letters, digits, - and _")
    spark = df.sparkSession
    folder = f"data/{batch}-{uuid.uuid4().hex}"
    df.write.format(fmt).options(**options).save(f"{path}/{folder}")
    rows = spark.read.format(fmt).options(**options).schema(df.schema).load(f"{path}/{folder}").count()
    # One small file per batch id: the last step, and the only one that readers see.
    entry = spark.createDataFrame([(batch, folder, rows)], ENTRY)
    entry.coalesce(1).write.mode("overwrite").json(f"{path}/manifest/{batch}")


def batches(spark: SparkSession, path: str) -> DataFrame:
    """(batch, folder, rows) of all published batches."""
    return spark.read.schema(ENTRY).json(f"{path}/manifest/*")


def read_batches(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options) -> DataFrame:
    """All published rows. The driver holds one path per batch, as any listing of files does."""
    folders = [f"{path}/{r['folder']}" for r in batches(spark, path).orderBy("batch").collect()]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.format(fmt).options(**options).schema(schema).load(folders)


def batch_sink(stream: DataFrame, path: str, checkpoint: str, rows=lambda batch: batch, fmt: str = "parquet"):
    """A stream's micro-batches as batches of that id, so a batch that Spark repeats after a failure counts once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        append_batch(rows(batch), path, batch_id, fmt)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def unpublished(spark: SparkSession, path: str) -> DataFrame:
    """Data folders that no manifest entry names: safe to remove once no writer is at work."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path}/data").select(
        F.regexp_extract("path", r"/(data/[^/]+)/[^/]*$", 1).alias("folder")).distinct()
    return found.join(batches(spark, path).select("folder"), "folder", "left_anti")
