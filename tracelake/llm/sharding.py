"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has virtual nodes at hashed places of a ring. A key belongs to the next
node clockwise; when that shard is full, it continues clockwise to the next shard
with room. Capacities differ by one row at most and add up to all rows, so
every shard ends exactly full.

Keys of one ring cell meet the same nodes in the same order, so the walk is done
on the counts of the cells: a table of CELLS rows, whatever the number of keys.
Which keys of a cell overflow follows from their ranks in ring order, counted in
sub-cells small enough to sort.

Defined results: null texts have no bytes. A null doc_id takes its place on the ring
from its text. Repeated rows are rows of their own. Other columns are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL_BITS = 12
CELLS = 1 << CELL_BITS
SUB_ROWS = 5_000


def ring(shards: int, nodes: int) -> list[int | None]:
    """The shard whose node lies in each cell; a node whose cell is taken moves to the next free one."""
    if shards * nodes > CELLS:
        raise ValueError(f"{shards} shards of {nodes} nodes do not fit in {CELLS} cells")
    cells: list[int | None] = [None] * CELLS
    for shard in range(shards):
        for node in range(nodes):
            at = int.from_bytes(hashlib.md5(f"shard-{shard}-node-{node}".encode()).digest()[:4], "big") % CELLS
            while cells[at] is not None:
                at = (at + 1) % CELLS
            cells[at] = shard
    return cells


def preferences(shards: int, nodes: int) -> list[list[int]]:
    """For each cell, the shards in the order in which they come clockwise."""
    cells = ring(shards, nodes)
    found: list[list[int]] = [[] for _ in range(CELLS)]
    order: list[int] = []
    for at in range(2 * CELLS - 1, -1, -1):
        shard = cells[at % CELLS]
        if shard is not None:
            order = [shard, *(s for s in order if s != shard)]
        if at < CELLS:
            found[at] = order
    return found


def walk(counts: dict[int, int], shards: int, nodes: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, shard, first rank, end rank, first slot): how the keys of each cell spread over the shards.

    In the k-th round, the keys that are still without a place ask the k-th shard of
    their cell; a shard takes them in ring order until it is full.
    """
    rows = sum(counts.values())
    room = [rows // shards + (s < rows % shards) for s in range(shards)]
    slot, placed, plan = [0] * shards, dict.fromkeys(counts, 0), []
    wish = preferences(shards, nodes)
    for turn in range(shards):
        for cell in sorted(counts):
            shard = wish[cell][turn]
            n = min(counts[cell] - placed[cell], room[shard])
            if n:
                plan.append((cell, shard, placed[cell], placed[cell] + n, slot[shard]))
                placed[cell] += n
                room[shard] -= n
                slot[shard] += n
    return plan


def sharded(docs: DataFrame, shards: int = 8, nodes: int = 64) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): slot is the row's place in its shard, gapless from 0."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    place = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.md5(text)))
    # Sub-cells double until they hold about SUB_ROWS rows each.
    bits = min(40, max(0, (docs.count() // (CELLS * SUB_ROWS)).bit_length()))
    cell = F.shiftrightunsigned("place", 64 - CELL_BITS).cast("int").alias("cell")
    sub = F.shiftrightunsigned("place", 64 - CELL_BITS - bits).bitwiseAND((1 << bits) - 1).alias("sub")
    counts = docs.select(place.alias("place")).groupBy(cell, sub).agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("cell").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0))).select("cell", "sub", "before")
    # CELLS rows at most, and CELLS x shards rows of the plan.
    cells = {r["cell"]: r["n"] for r in counts.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(walk(cells, shards, nodes), "cell int, shard int, first long, end long, slot0 long")
    inside = Window.partitionBy("cell", "sub").orderBy("place", "doc_id", "size", "text_crc32")
    rows = (
        docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
                    F.crc32(text.cast("binary")).alias("text_crc32"), place.alias("place"))
        .select("*", cell, sub)
        .withColumn("inside", F.row_number().over(inside) - 1)
        .join(before, ["cell", "sub"])
        .withColumn("rank", F.col("before") + F.col("inside"))
        .drop("sub")
    )
    return (
        rows.join(F.broadcast(plan), (rows["cell"] == plan["cell"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
        .select("doc_id", "size", "text_crc32", "shard", (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"))
    )
