"""File inventory, MAC timeline, suspicious files, carving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.content import messages
from tracelake.content.lookups import (
    DOUBLE_EXTENSION, EXECUTABLE_EXTENSIONS, FILE_MAGIC, LONG_NAME, SCRIPT_EXTENSIONS, TEMP_PATH,
)
from tracelake.functions.binary import byte_counts, content_chunks, file_kind, signature_offsets
from tracelake.functions.hashing import digest
from tracelake.functions.paths import file_name, folder, is_hidden, octal_mode, suffix
from tracelake.functions.text import fill
from tracelake.operators.ordered import first_per_group


def suspicious_reasons(path, name, extension, kind) -> Column:
    """Why a file is suspicious, as an array in fixed order; empty when it is not."""
    path, name, extension, kind = [F.col(c) if isinstance(c, str) else c for c in (path, name, extension, kind)]
    wrong_kind = F.coalesce(kind.contains("Executable"), F.lit(False)) & ~extension.isin(EXECUTABLE_EXTENSIONS)
    return F.array_compact(F.array(
        F.when(wrong_kind, fill(messages.FILE_WRONG_KIND, extension)),
        F.when(name.rlike(DOUBLE_EXTENSION), F.lit(messages.FILE_DOUBLE_EXTENSION)),
        F.when(extension.isin(SCRIPT_EXTENSIONS) & path.rlike(TEMP_PATH),
               fill(messages.FILE_RISKY_FOLDER, folder(path))),
        F.when(F.length(name) > LONG_NAME, fill(messages.FILE_LONG_NAME, F.length(name)))))


def inventory(files: DataFrame, hashes: bool = True, hash_below: int | None = None) -> DataFrame:
    """File metadata: names, kind, digests and reasons.

    files: path, size, mtime, content, and where known atime, ctime and mode.
    hash_below: files of so many bytes and more get no digests; without it all do.
    """
    have = set(files.columns)
    name = file_name("path")
    base = files.withColumns({
        "name": name, "extension": suffix(name), "magic_type": file_kind("content"),
        "is_hidden": is_hidden(name),
        "permissions": octal_mode("mode") if "mode" in have else F.lit(None).cast("string"),
    })
    if hashes:
        small = F.lit(True) if hash_below is None else F.col("size") < hash_below
        base = base.withColumns({
            "md5": F.when(small, digest("content", "md5")), "sha256": F.when(small, digest("content", "sha256"))})
    reasons = suspicious_reasons("path", "name", "extension", "magic_type")
    out = base.withColumn("reasons", reasons).withColumn("is_suspicious", F.size("reasons") > 0)
    return out.drop("content")


def suspicious_files(files: DataFrame) -> DataFrame:
    return inventory(files).where("is_suspicious")


def mac_timeline(files: DataFrame) -> DataFrame:
    """Three rows per file: modified, accessed, changed."""
    entry = lambda c, label: F.struct(F.col(c).alias("ts"), F.lit(label).alias("event_type"))
    rows = F.explode(F.array(entry("mtime", "modified"), entry("atime", "accessed"),
                             entry("ctime", "changed/created")))
    return files.select("path", "size", rows.alias("e")).select("e.ts", "e.event_type", "path", "size")


def mac_ordered(timeline: DataFrame) -> DataFrame:
    return timeline.orderBy("ts", "path", "event_type")


def recent_files(files: DataFrame, as_of: Column, hours: int = 24, folders=None,
                 per_folder: int | None = None) -> DataFrame:
    """Files changed within the hours before as_of, the first per_folder of each folder by name, or all.

    The time filter comes before the cap, so that no recent file is lost to an old one.
    """
    path = F.col("path")
    out = files.withColumns({"folder": folder(path), "extension": suffix(file_name(path))})
    if folders:
        at = F.lit(False)
        for f in folders:
            at = at | F.lower(path).startswith(f.lower())
        out = out.where(at)
    out = out.where(F.col("mtime") > as_of - F.expr(f"INTERVAL {int(hours)} HOURS"))
    return first_per_group(out, ["folder"], ["path"], per_folder)


def privileged_files(files: DataFrame) -> DataFrame:
    """Files with the set-user or set-group bit."""
    return files.where(F.col("mode").cast("int").bitwiseAND(0o6000) > 0)


def changed_system_files(files: DataFrame, as_of: Column, days: int = 7,
                         folders=("/usr/bin/", "/usr/sbin/", "/bin/", "/sbin/")) -> DataFrame:
    at = F.lit(False)
    for f in folders:
        at = at | F.col("path").startswith(f)
    return files.where(at & (F.col("mtime") > as_of - F.expr(f"INTERVAL {int(days)} DAYS")))


def prefetch_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("mtime"), "name")


def carve(files: DataFrame, signatures=None, chunk: int = 1 << 20) -> DataFrame:
    """(path, signature, label, offset) of each signature in the raw bytes.

    Images are read as chunks of bounded size, with a few bytes of overlap.
    """
    return carve_ranges(content_chunks(files, "path", "content", chunk, overlap_of(signatures)), signatures)


def overlap_of(signatures=None) -> int:
    """Bytes that a chunk must hold of the next one, so that no signature is cut."""
    return max(len(s) // 2 for s, _ in signatures or FILE_MAGIC) - 1


def carve_ranges(parts: DataFrame, signatures=None) -> DataFrame:
    """The same over chunks (path, base, own_bytes, chunk) with an overlap, as sources.ranges reads them from files of any size.

    A signature whose end is also its start (such as 6161) is counted without overlap inside a chunk only.
    """
    table = signatures or FILE_MAGIC
    found = F.array(*[
        F.struct(F.lit(s).alias("signature"), F.lit(label).alias("label"),
                 signature_offsets("chunk", s).alias("offsets")) for s, label in table])
    rows = parts.select("path", "base", "own_bytes", F.explode(found).alias("f")) \
                .select("path", "base", "own_bytes", "f.signature", "f.label", F.explode("f.offsets").alias("at"))
    return rows.where(F.col("at") < F.col("own_bytes")) \
               .select("path", "signature", "label", (F.col("base") + F.col("at")).alias("offset"))


def range_histogram(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, byte, n): how often each byte value occurs in the chunks' own bytes; 256 rows per key at most."""
    counts = parts.select(*keys, F.posexplode(byte_counts("chunk", "own_bytes")).alias("byte", "n")).where("n > 0")
    return counts.groupBy(*keys, "byte").agg(F.sum("n").alias("n"))


def range_entropy(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, size, entropy): Shannon entropy in bits per byte of all bytes of a key, from sums over chunks."""
    n = F.col("n").cast("double")
    sums = range_histogram(parts, keys).groupBy(*keys).agg(F.sum("n").alias("size"), F.sum(n * F.log2(n)).alias("_s"))
    size = F.col("size").cast("double")
    return sums.withColumn("entropy", F.greatest(F.log2(size) - F.col("_s") / size, F.lit(0.0))).drop("_s")


def carved_slices(files: DataFrame, offsets: DataFrame, size: int = 10 * 1024 * 1024) -> DataFrame:
    """The bytes from each offset on, up to size."""
    return offsets.join(files.select("path", "content"), "path").withColumn(
        "slice", F.substring(F.col("content"), F.col("offset").cast("int") + 1, F.lit(size))).drop("content")
