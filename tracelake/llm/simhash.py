"""SimHash near-duplicates by Golay-code fuzzy hashing.

The 64 fingerprint bits are three segments of 22, 21 and 21 bits. Two fingerprints that
differ in at most three bits have two segments that differ in at most one bit each:
were the second worst segment two bits off, the worst would be as well, four in all.
Each segment is decoded in the binary Golay code [23, 12, 7], whose codewords have every 23-bit word within
three bits. A word x and a word y one bit from it meet at y's own codeword, which
lies within four bits of x: x has one such codeword, or six when it is three bits from its own. So each
fingerprint is kept under the codewords of its three pairs of segments, and looks under all
codewords within four bits; what shares a pair of codewords is compared bit by bit.

Copies are one fingerprint: they collapse before anything is compared, with their smallest id.
Linked fingerprints form components by alternating large-star and small-star steps.

Defined results: null and empty texts have fingerprint zero and are linked like any
other. A null doc_id is smaller than any other only where a whole component has none; it
never names a component otherwise. Repeated rows are rows of their own. Other columns are not read.
"""

from __future__ import annotations

import functools
import string
from collections.abc import Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import written

SEED = 42
# Segments as (shift, bits).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = tuple(combinations(range(3), 2))
# Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
LENGTH, CHECKS, RADIUS = 23, 11, 3
LOWERED = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def fingerprint(text: str, shingle: int = 3) -> int:
    """A bit is 1 when it is set in over half of the shingles' hashes, repeats included."""
    import xxhash

    words = text.encode().translate(LOWERED).split()  # bytes split at ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - shingle + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[-n:] - 1).tolist()
    hash_of = xxhash.xxh64_intdigest
    hashes = np.array([hash_of(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, bits): bits is the fingerprint as a signed 64-bit integer."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = np.array([fingerprint(x or "", shingle) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, bits long")


@functools.lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndromes of the 2^8, 2^8 and 2^7 values of a word's bytes, leader of each syndrome, other patterns).

    leader: the error pattern of at most three bits. other: the five patterns of four
    bits with the same syndrome, where the leader has three; else the leader again.
    """
    rest = np.zeros(LENGTH, np.int64)
    for i in range(LENGTH):
        word = 1 << i
        for bit in range(LENGTH - 1, CHECKS - 1, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - CHECKS)
        rest[i] = word
    values = np.arange(256)
    bytes_ = np.zeros((3, 256), np.int64)
    for byte in range(3):
        for bit in range(8):
            if byte * 8 + bit < LENGTH:
                bytes_[byte] ^= np.where(values >> bit & 1, rest[byte * 8 + bit], 0)
    leader = np.zeros(1 << CHECKS, np.int64)
    other = [[] for _ in range(1 << CHECKS)]
    for weight in range(1, RADIUS + 2):
        for bits in combinations(range(LENGTH), weight):
            pattern, syndrome = sum(1 << b for b in bits), 0
            for b in bits:
                syndrome ^= int(rest[b])
            if weight <= RADIUS:
                leader[syndrome] = pattern
            else:
                other[syndrome].append(pattern)
    filled = np.array([(x + [int(leader[s])] * 5)[:5] for s, x in enumerate(other)], np.int64)
    return bytes_, leader, filled


def nearby_codewords(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word, the indices (data bits) of the codewords within four bits: six columns, the nearest first.

    A word whose own codeword is nearer than three bits has no other; its columns repeat it.
    """
    bytes_, leader, other = golay_tables()
    syndrome = bytes_[0][words & 255] ^ bytes_[1][words >> 8 & 255] ^ bytes_[2][words >> 16 & 127]
    patterns = np.concatenate([leader[syndrome][:, None], other[syndrome]], axis=1)
    return (words[:, None] ^ patterns) >> CHECKS


def code_keys(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints: (n, 3) under which they are kept, (n, 3 x 36) under which they look; repeats are -1."""
    unsigned = bits.view(np.uint64)
    near = [nearby_codewords(((unsigned >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64)) for s, n in SEGMENTS]
    keep, look = [], []
    for k, (a, b) in enumerate(PAIRS):
        keys = (k << 24) | near[a][:, :, None] << 12 | near[b][:, None, :]
        # Where a word has one codeword only, its other columns repeat it.
        own = [np.concatenate([np.zeros((len(bits), 1), bool), x[:, 1:] == x[:, :1]], axis=1) for x in (near[a], near[b])]
        keys = np.where(own[0][:, :, None] | own[1][:, None, :], -1, keys).reshape(len(bits), -1)
        keep.append(keys[:, 0])
        look.append(keys)
    return np.stack(keep, 1), np.concatenate(look, 1)


def _keyed(prints: DataFrame, looking: bool) -> DataFrame:
    """(key, bits) rows of distinct fingerprints."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                bits = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
                keys = code_keys(bits)[looking]
                row, column = np.nonzero(keys >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(keys[row, column].astype(np.int32)), pa.array(bits[row])], ["key", "bits"])

    return prints.select("bits").mapInArrow(run, "key int, bits long")


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(prints: DataFrame, within: int = 3) -> DataFrame:
    """(a, b): distinct fingerprints a < b that differ in at most within (three or fewer) bits, each pair once."""
    if within > 3:
        raise ValueError("two segments within one bit are certain up to three bits only")
    kept = _keyed(prints, False).withColumnRenamed("bits", "b")
    looks = _keyed(prints, True).withColumnRenamed("bits", "a")
    near = (looks["key"] == kept["key"]) & (F.col("a") != F.col("b")) & (distance("a", "b") <= within)
    return looks.join(kept, near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of edges (a, b) a < b: root is the smallest node reachable. Nodes without edges do not appear.

    Each step hangs every node's neighbours on the smallest of them, first the larger
    ones, then the smaller ones; the steps end when the edges are stars. Steps are
    written, so a lost executor repeats one step at most.
    """
    edges = written(edges, "edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root"))
        large = both.filter("b > a").join(least, "a").select(F.col("root").alias("a"), "b").distinct()
        # Small star: each node's smaller neighbours hang on the smallest of them.
        low = large.groupBy("b").agg(F.min("a").alias("root"))
        small = large.join(low, "b").select(F.col("root").alias("a"), F.when(F.col("a") == F.col("root"), F.col("b")).otherwise(F.col("a")).alias("b"))
        step = written(small.filter("a < b").distinct(), "edges")
        if step.exceptAll(edges).isEmpty() and edges.exceptAll(step).isEmpty():
            return step.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
                step.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        edges = step


def _rooted(docs: DataFrame, within: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(rows of docs with their fingerprints, written; (bits, least, root), one row per fingerprint)."""
    rows = written(fingerprints(docs, shingle), "prints")
    prints = written(rows.groupBy("bits").agg(F.min("doc_id").alias("least")), "distinct")
    tree = components(links(prints, within))
    return rows, prints.join(tree, prints["bits"] == tree["node"], "left").select("bits", "least", F.coalesce("root", "bits").alias("root"))


def near_groups(docs: DataFrame, within: int = 3, shingle: int = 3) -> DataFrame:
    """(doc_id, bits, component_id), one row per row of docs; component_id is the smallest doc_id reachable."""
    rows, named = _rooted(docs, within, shingle)
    # Both sides of this join have one row per fingerprint at most.
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = named.join(names, "root").select("bits", "component_id")
    return rows.join(ids, "bits").select("doc_id", "bits", "component_id")


def drop_near_copies(docs: DataFrame, within: int = 3, shingle: int = 3) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component, that of the smallest id (nulls last, then by text)."""
    # The place of a row is fixed once it is written; a struct keeps the columns of docs apart from ours.
    kept = written(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows")
    prints, named = _rooted(kept.select(F.col("row").alias("doc_id"), "doc.text"), within, shingle)
    rank = F.struct(F.col("doc.doc_id").isNull(), "doc.doc_id", F.sha2(F.coalesce("doc.text", F.lit("")), 256), "row")
    ranked = prints.withColumnRenamed("doc_id", "row").join(kept.select("row", rank.alias("rank")), "row")
    stays = ranked.join(named.select("bits", "root"), "bits").groupBy("root").agg(F.min("rank")["row"].alias("row")).select("row")
    return kept.join(stays, "row", "left_semi").select("doc.*")
