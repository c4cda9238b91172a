"""Token files: ids bit-packed at a fixed width, with block offsets for random access.

An id takes the bits that the vocabulary needs at least. A segment holds whole
documents of one shard in ascending doc_id order; its ids are packed in blocks of a
fixed number of ids, each starting at a whole byte, and a table of block offsets
leads to any range of ids without unpacking the rest. Segments are the rows of a
Parquet table, so writing them is atomic and works in any store that Spark reaches.

Layout of a segment, little-endian: magic "TLP1", bits (u1), three zero bytes, ids
per block (u4), blocks (u4), ids (u8), offsets of the blocks and the end (u8 each),
counted from the first block; then the blocks, most significant bit first.

Defined results: a null text is an empty one. A null doc_id comes first. Rows of the
same doc_id come in the order of their texts' hash. An empty table gives no segments.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.common import if_small, partitions, shared_folder
from tracelake.llm.tokens import ID, encoded, vocabulary_size

MAGIC = b"TLP1"
HEAD = "<4sB3xIIQ"
BLOCK_IDS = 4096
SEGMENT_IDS = 1 << 18


def width(vocabulary: int) -> int:
    """Bits that the largest id needs."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    """A segment of ids. block_ids is a multiple of 8, so that blocks start at whole bytes."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"id {int(ids.max())} does not fit in {bits} bits")
    blocks = []
    for at in range(0, len(ids), block_ids):
        octets = ids[at : at + block_ids].astype(">u4").view(np.uint8).reshape(-1, 4)
        # A width of whole bytes needs no shifting of bits.
        blocks.append((np.packbits(np.unpackbits(octets, axis=1)[:, 32 - bits :]) if bits % 8 else octets[:, 4 - bits // 8 :]).tobytes())
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    return struct.pack(HEAD, MAGIC, bits, block_ids, len(blocks), len(ids)) + offsets.tobytes() + b"".join(blocks)


def unpack(data: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids start to stop of a segment; only the blocks that hold them are unpacked."""
    magic, bits, block_ids, blocks, n = struct.unpack_from(HEAD, data)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, ID)
    offsets = np.frombuffer(data, "<u8", blocks + 1, struct.calcsize(HEAD))
    base = struct.calcsize(HEAD) + 8 * (blocks + 1)
    first, last = start // block_ids, (stop - 1) // block_ids
    # Blocks before the last are full and end at whole bytes, so neighbours unpack as one run.
    held = min((last + 1) * block_ids, n) - first * block_ids
    raw = np.frombuffer(data, np.uint8, int(offsets[last + 1] - offsets[first]), base + int(offsets[first]))
    if bits % 8:
        wide = np.zeros((held, 32), np.uint8)
        wide[:, 32 - bits :] = np.unpackbits(raw, count=held * bits).reshape(held, bits)
        octets = np.packbits(wide, axis=1)
    else:
        octets = np.zeros((held, 4), np.uint8)
        octets[:, 4 - bits // 8 :] = raw.reshape(held, bits // 8)
    ids = octets.view(">u4").ravel().astype(ID)
    return ids[start - first * block_ids : stop - first * block_ids]


def _segments(batches: Iterator, bits: int, segment_ids: int) -> Iterator:
    """Rows (doc_id, ids) of one shard in order -> its segments."""
    import pyarrow as pa
    from pyspark import TaskContext

    shard, before, number = TaskContext.get().partitionId(), 0, 0
    doc_ids, parts, lengths = [], [], []

    def close():
        nonlocal before, number
        ids = np.frombuffer(b"".join(parts), ID)
        columns = [[shard], [number], [before], [len(ids)], [doc_ids], [lengths], [pack(ids, bits)]]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        row = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)],
                                         ["shard", "segment", "before", "n_ids", "doc_ids", "lengths", "data"])
        before, number = before + len(ids), number + 1
        return row

    held = 0
    for batch in batches:
        for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n = len(ids) // ID.itemsize
            if held and held + n > segment_ids:
                yield close()
                doc_ids, parts, lengths, held = [], [], [], 0
            doc_ids.append(doc_id)
            parts.append(ids)
            lengths.append(n)
            held += n
    if held:
        yield close()


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0, path: str | None = None, segment_ids: int = SEGMENT_IDS) -> str:
    """Write the ids of docs (doc_id, text) as token segments; the folder they are in."""
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/tracelake-tokens-{uuid.uuid4().hex}"
    bits = width(vocabulary_size(tokenizer))
    order = ["doc_id", F.xxhash64("text")]
    spread = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").repartitionByRange(partitions(spark), *order)
    segments = spread.sortWithinPartitions(*order).mapInArrow(
        lambda batches: _segments(encoded(batches, tokenizer, end_id), bits, segment_ids),
        "shard int, segment int, before long, n_ids long, doc_ids array<bigint>, lengths array<bigint>, data binary")
    segments.write.option("compression", "zstd").parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from token segments; start counts the ids of all documents before."""
    segments = spark.read.parquet(path)
    # One row per shard, which is one file of the table.
    shards = segments.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select("shard", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)).alias("base"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                ids = [unpack(row["data"], a, b).tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["base"] + row["before"], pa.int64()),
                           pa.array(row["lengths"], pa.int64()), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    return segments.join(if_small(base), "shard").select("base", "before", "doc_ids", "lengths", "data").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary")
