"""Best-fit packing of token pieces into sequences by bin completion.

A piece is known to the packing by its length alone, so the problem is a table of
counts, one per length up to the sequence length: bounded, whatever the number of
pieces. Bin completion runs on that table: around the largest length left, the
undominated fillings are enumerated, a filling is used as often as the counts
allow, branches whose waste cannot beat the incumbent are cut, and best-fit
decreasing gives the first incumbent. The search ends at the lower bound or after
a number of nodes; the incumbent then holds every piece.

Spark does the rest: cutting, counting, ranking pieces of one length, and giving each
rank its place. Ranks count within tasks first, so a length that a third of all pieces
share is as cheap as any other.

Defined results: a null text is an empty one and gives a piece of the end id alone.
Rows with a null or repeated doc_id are documents of their own. Columns of the pieces
other than length are kept; those named part, rank, sequence_id and offset are replaced.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import written
from tracelake.llm.tokens import ID, encoded

Pattern = tuple[tuple[int, int], ...]  # (length, how many), longest first


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, Pattern]]:
    """(times, pattern) of best-fit decreasing; equal bins are handled together."""
    open_: dict[int, list[tuple[int, dict[int, int]]]] = {capacity: []}
    rooms: list[int] = []  # what open bins have left, ascending
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                bins, pattern = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            else:
                room, bins, pattern = capacity, left, {}
            fit = room // length
            used, each = (min(bins, left // fit), fit) if left >= fit else (1, left)
            left -= used * each
            if bins > used and pattern:
                if room not in open_:
                    insort(rooms, room)
                open_.setdefault(room, []).append((bins - used, pattern))
            room -= each * length
            if room not in open_:
                insort(rooms, room)
            open_.setdefault(room, []).append((used, {**pattern, length: each}))
    return [(bins, tuple(sorted(p.items(), reverse=True))) for group in open_.values() for bins, p in group]


def fillings(counts: dict[int, int], lengths: list[int], room: int, most: int) -> list[tuple[int, Pattern]]:
    """(waste, pattern) of undominated ways to fill room from counts, least waste first.

    A filling is dominated when one piece that it leaves out fits in the place of some
    of its pieces that are no longer together: a single piece of exactly room dominates all
    others. most: fillings looked at, at most; the search then goes on with those.
    """
    if counts.get(room, 0):
        return [(0, ((room, 1),))]
    usable = [x for x in lengths if x <= room]
    if not usable:
        return [(room, ())]
    smallest, found = usable[-1], []
    ascending = usable[::-1]
    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, room, ())]
    looked = 0
    while stack and looked < most:
        at, left, chosen = stack.pop()
        if left < smallest or at == len(usable):
            looked += 1
            if not _dominated(chosen, left, ascending, counts):
                found.append((left, tuple(sorted(Counter(chosen).items(), reverse=True))))
                if left == 0 and len(found) >= 8:
                    break
            continue
        while at < len(usable) and usable[at] > left:
            at += 1
        if at == len(usable):
            stack.append((at, left, chosen))
            continue
        length = usable[at]
        stack.append((at + 1, left, chosen))  # without another one of this length
        if chosen.count(length) < counts[length]:
            stack.append((at, left - length, (*chosen, length)))
    return sorted(set(found), key=lambda x: (x[0], sum(n for _, n in x[1])))


def _dominated(chosen: tuple[int, ...], left: int, ascending: list[int], counts: dict[int, int]) -> bool:
    """Whether a piece left out could take the place of one or two chosen ones, or of nothing, without loss."""
    taken = Counter(chosen)
    together = {a + b for i, a in enumerate(chosen) for b in chosen[i + 1 :]}
    for total in {0, *taken, *together}:
        at = bisect_left(ascending, total if total in together else total + 1)
        while at < len(ascending) and ascending[at] <= total + left:
            if counts[ascending[at]] > taken[ascending[at]]:
                return True
            at += 1
    return False


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins.

    For each small length, pieces above capacity less it stand alone but for shorter ones, pieces
    above half have a bin each, and pieces from it up to half fill what those leave, then bins of their own.
    """
    best = -(-sum(x * n for x, n in counts.items()) // capacity)
    above = sum(n for x, n in counts.items() if 2 * x > capacity)
    for small in counts:
        if 2 * small <= capacity:
            room = sum((capacity - x) * n for x, n in counts.items() if 2 * x > capacity and x <= capacity - small)
            volume = sum(x * n for x, n in counts.items() if small <= x and 2 * x <= capacity)
            best = max(best, above + max(0, -(-(volume - room) // capacity)))
    return max(best, above)


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = 3_000, most: int = 200) -> list[tuple[int, Pattern]]:
    """(times, pattern) that hold all counts in as few bins as the search finds."""
    left = {x: n for x, n in counts.items() if n}
    if any(not 0 < x <= capacity for x in left):
        raise ValueError(f"lengths lie between 1 and {capacity}")
    best = best_fit(left, capacity)
    bins, bound = sum(t for t, _ in best), lower_bound(left, capacity)
    volume = sum(x * n for x, n in left.items())
    waste, made = 0, []  # of the bins chosen so far

    def choices() -> Iterator[tuple[int, Pattern, int]]:
        lengths = sorted((x for x, n in left.items() if n), reverse=True)
        largest = lengths[0]
        left[largest] -= 1
        ways = fillings(left, [x for x in lengths if left[x]], capacity - largest, most)
        left[largest] += 1
        for unused, way in ways:
            pattern = Counter(dict(way))
            pattern[largest] += 1
            for times in range(min(left[x] // n for x, n in pattern.items()), 0, -1):
                yield times, tuple(sorted(pattern.items(), reverse=True)), unused

    stack = [choices()] if left and bins > bound else []
    while stack and nodes:
        step = next(stack[-1], None)
        if len(made) == len(stack):  # the choice made here before is taken back
            times, pattern, unused = made.pop()
            waste -= times * unused
            for x, n in pattern:
                left[x] += times * n
        if step is None:
            stack.pop()
            continue
        times, pattern, unused = step
        # To win, all bins together waste at most what one bin fewer than the incumbent's would leave over.
        if waste + times * unused > (bins - 1) * capacity - volume:
            continue
        nodes -= 1
        made.append(step)
        waste += times * unused
        for x, n in pattern:
            left[x] -= times * n
        if any(left.values()):
            stack.append(choices())
            continue
        best = [(t, p) for t, p, _ in made]
        bins = sum(t for t, _ in best)
        if bins <= bound:
            break
    return best


def token_pieces(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids): documents with their end id; the longer ones are cut, their first piece is the shorter."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in encoded(batches, tokenizer, end_id):
            rows, piece, start, size, parts = [], [], [], [], []
            for row, ids in enumerate(batch.column(1).to_pylist()):
                n = len(ids) // ID.itemsize
                cuts = [0, *range(n % length or length, n + 1, length)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append(row)
                    piece.append(k)
                    start.append(a)
                    size.append(b - a)
                    parts.append(ids[a * ID.itemsize : b * ID.itemsize])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(size, pa.int64()), pa.array(parts, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def placements(patterns: list[tuple[int, Pattern]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, pieces per sequence, first sequence, first offset) by first rank."""
    ranks: Counter = Counter()
    table: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for times, pattern in patterns:
        offset = 0
        for length, n in pattern:
            table.setdefault(length, []).append((ranks[length], n, sequence, offset))
            ranks[length] += times * n
            offset += length * n
        sequence += times
    return {x: np.array(rows, np.int64) for x, rows in table.items()}


def packed(pieces: DataFrame, capacity: int = 1024, nodes: int = 3_000) -> DataFrame:
    """pieces with sequence_id and offset; within a sequence the pieces lie end to end from 0."""
    kept = pieces.drop("part", "rank", "sequence_id", "offset")
    # A row's task and its number within the task are fixed by writing them.
    rows = written(kept.withColumn("part", F.spark_partition_id()).withColumn("rank", F.monotonically_increasing_id()), "pieces")
    counts = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = placements(bin_completion(histogram, capacity, nodes))
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    names = kept.columns
    place = F.row_number().over(Window.partitionBy("length", "part").orderBy("rank")) - 1
    ready = rows.withColumn("rank", place).join(before, ["length", "part"]).select(*names, (F.col("before") + F.col("rank")).cast("bigint").alias("rank"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.drop("rank").schema), "sequence_id long, offset long"])
    at = names.index("length")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            lengths, ranks = batch.column(at).to_numpy(zero_copy_only=False), batch.column(len(names)).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                here = lengths == length
                first, n, start, off = table[int(length)][np.searchsorted(table[int(length)][:, 0], ranks[here], "right") - 1].T
                sequence[here] = start + (ranks[here] - first) // n
                offset[here] = off + (ranks[here] - first) % n * length
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence), pa.array(offset)],
                                             [*names, "sequence_id", "offset"])

    return ready.mapInArrow(run, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids, doc_ids): the packed sequences themselves, from pieces that carry ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))  # a sequence's own pieces
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.aggregate("p.length", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("length"),
        F.aggregate("p.ids", F.lit(b"").cast("binary"), lambda a, b: F.concat(a, b)).alias("ids"), F.col("p.doc_id").alias("doc_ids"))
