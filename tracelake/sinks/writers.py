"""Writers. Each writes in parallel; sorted output is range-partitioned first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import cut
from tracelake.operators.evidence import evidence_log, load_file_header, load_file_lines
from tracelake.operators.files import mac_ordered
from tracelake.operators.flows import flow_export
from tracelake.operators.timeline import export_rows, ordered, summary
from tracelake.sources.ranges import store_of


def _csv(df: DataFrame, path: str, mode: str = "error") -> None:
    # Spark's writer trims texts unless it is told not to.
    df.write.mode(mode).option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).csv(path)


def timeline_csv(timeline: DataFrame, path: str, mode: str = "error") -> None:
    _csv(export_rows(ordered(timeline)), path, mode)


def timeline_json(timeline: DataFrame, path: str, mode: str = "error") -> None:
    """Events below path/events and the summary below path/summary."""
    ordered(timeline).write.mode(mode).json(f"{path}/events")
    summary(timeline).write.mode(mode).json(f"{path}/summary")


def hit_rows(hits: DataFrame, width: int | None = None) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return hits.select(
        text("hit_time").alias("Hit Time"), text("host").alias("Host"), F.col("value").alias("IOC Value"),
        F.col("ioc_type").alias("IOC Type"), text("severity").alias("Severity"),
        F.col("confidence").alias("Confidence"), text("source").alias("Source"),
        F.regexp_replace("ioc_type", "^hash_", "").alias("Matched Field"),
        cut(text("description"), width).alias("Description"))


def hits_csv(hits: DataFrame, path: str, mode: str = "error", width: int | None = None) -> None:
    _csv(hit_rows(hits, width), path, mode)


def flows_csv(flagged: DataFrame, path: str, mode: str = "error") -> None:
    _csv(flow_export(flagged), path, mode)


def mac_csv(timeline: DataFrame, path: str, mode: str = "error") -> None:
    rows = mac_ordered(timeline).select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("Timestamp (UTC)"),
        F.col("event_type").alias("Event Type"), F.col("path").alias("File Path"), F.col("size").alias("Size (bytes)"))
    _csv(rows, path, mode)


def evidence_csv(evidence: DataFrame, path: str, mode: str = "error") -> None:
    _csv(evidence_log(evidence), path, mode)


def load_file(evidence: DataFrame, path: str, mode: str = "error", **marks) -> None:
    """E-discovery load file; every part starts with the header line."""
    lines = load_file_lines(evidence, **marks).select(F.col("line").alias(load_file_header(**marks)))
    lines.write.mode(mode).option("header", True).option("quoteAll", False).option("quote", "\u0000") \
        .option("escape", "\u0000").option("sep", "\u0001").csv(path)


def custody_table(custody: DataFrame, path: str, mode: str = "error") -> None:
    custody.orderBy("evidence_id", "seq").write.mode(mode).parquet(path)


def report_table(rows: DataFrame, path: str, mode: str = "error") -> None:
    """Report rows, one folder per case. Rows of a case come together first, so a case is one file, not one per task."""
    rows.repartition("case_id").write.mode(mode).partitionBy("case_id").parquet(path)


def text_files(rows: DataFrame, root: str, name: str = "name", text: str = "text") -> DataFrame:
    """Write the text of each row to root/name, in the tasks that hold the rows; returns (name, bytes) of what was written.

    For documents that must be a file of their own: reports, registries, bundles. A repeated task writes the same
    file again. Files are opened with pyarrow's file systems; the returned rows are what triggers the writing.
    """
    def write(batches):
        import pyarrow as pa

        store, inner = store_of(root)
        for batch in batches:
            sizes = []
            for at, content in zip(*(c.to_pylist() for c in batch.columns)):
                target = f"{inner}/{at}"
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                raw = (content or "").encode()
                with store.open_output_stream(target) as out:
                    out.write(raw)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["name", "bytes"])

    return rows.select(F.col(name).alias("name"), F.col(text).alias("text")).mapInArrow(write, "name string, bytes long")


def packed_files(rows: DataFrame, root: str, name: str = "name", text: str = "text", mode: str = "error") -> None:
    """The same documents, many to a file: Parquet rows (name, text) below root.

    For documents without bound in number: whoever lists a folder of a file each holds all their names at once, and opens every
    file. The readers of such documents take either form (packed=True).
    """
    rows.select(F.col(name).alias("name"), F.coalesce(F.col(text), F.lit("")).alias("text")) \
        .write.mode(mode).option("compression", "zstd").parquet(root)


def json_table(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Append-only JSON log: scan results, evidence registry, cases, actions."""
    rows.write.mode(mode).json(path)
