"""Files of any size as byte ranges.

Spark lists the files; each task then reads its own ranges at their offsets and hands them on in chunks, so
neither a whole file nor a whole range is ever one row. A 100 GB image is as parallel as 100 GB of small files.

Files are opened with pyarrow's file systems, which know local paths, hdfs, s3 and gs. A store that only
Spark can open has to be read with read_files, a file per row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = "path string, base long, own_bytes long, chunk binary"


def store_of(path: str):
    """(file system, path in it) of a path as Spark shows it, with spaces and the like as they are."""
    from pyarrow import fs

    if "://" in path and not path.startswith("file:"):
        scheme, _, rest = path.partition("://")
        host, _, inner = rest.partition("/")
        store, base = fs.FileSystem.from_uri(f"{scheme}://{host}/")
        return store, f"{base.rstrip('/')}/{inner}"
    return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")


def file_sizes(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, size) of the files below a folder; their content is not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", F.col("length").alias("size"))


def file_ranges(spark: SparkSession, path: str, overlap: int = 0, size: int = 64 << 20, chunk: int = 1 << 20,
                pattern: str | None = None) -> DataFrame:
    """(path, base, own_bytes, chunk): consecutive chunks of all files, each with up to overlap bytes of what follows it.

    size: bytes of a range, the unit of work of a task. A finding belongs to a chunk when it starts below own_bytes.
    Empty files have no chunks.
    """
    if size < 1 or chunk < 1 or overlap < 0:
        raise ValueError("size and chunk are one byte at least, overlap none at least")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(size).cast("long")))
    ranges = file_sizes(spark, path, pattern).where("size > 0").select("path", "size", starts.alias("start"))
    ranges = ranges.repartition("path", "start")  # small rows: this deals out the reading

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for uri, whole, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, inner = store_of(uri)
                with store.open_input_file(inner) as file:
                    for base in range(start, min(start + size, whole), chunk):
                        own = min(chunk, start + size - base, whole - base)
                        raw = file.read_at(min(own + overlap, whole - base), base)
                        columns = [pa.array([uri]), pa.array([base], pa.int64()), pa.array([own], pa.int64()), pa.array([raw], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, ["path", "base", "own_bytes", "chunk"])

    return ranges.mapInArrow(read, CHUNKS)
