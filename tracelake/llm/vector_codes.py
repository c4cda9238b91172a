"""Vector codes: each part of a vector becomes the number of its nearest codebook entry, found in a GNAT.

A GNAT (geometric near-neighbour access tree) over the entries of a codebook: each node has a few split points, far from
one another; every other entry of the node belongs to its nearest split point's child. For each split point and each child
the node stores the range of their distances. A search measures the distance to a split point and drops every
child, its split point included, whose range shows that all of it is farther away than the best entry so far.

Exact: components are integers, and so are squared distances; those decide, ties going to the lower index. Roots of
them only serve to drop children: they are rounded outwards, and a child goes only when it is strictly
farther, so no entry that ties with the best is lost.

Codebooks are fitted by rounds of assigning all parts and moving each entry to the floor of its parts' mean. A task returns the
count and sums per entry, so a round moves parts x entries x positions numbers per task and that many to the driver.
Codebooks have a fixed size, and every round reads all vectors.

Defined results: vectors that are null or hold null or non-finite components take no part. Neither do those whose length differs from the
usual one (a multiple of the number of parts) or with components so large (46,340 at 64 dimensions) that squared distances leave 64
bits. With fewer vectors than entries, each is an entry. Rows of equal id are ordered by their vectors, null ids come
last; repeated rows are rows of their own. No rows, no codes. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import if_small, written
from tracelake.llm.vectors import matrix, usual_width, within


@dataclass(frozen=True)
class Coding:
    """scale: components become floor(scale * component). fanout: split points of a node."""

    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    fanout: int = 4


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to y, in 64-bit integers."""
    return ((x - y) ** 2).sum(1)


def below(square: np.ndarray) -> np.ndarray:
    """No more than the root. Two steps down outweigh the roundings of the conversion and of the root."""
    root = np.sqrt(np.asarray(square, np.float64))
    return np.maximum(np.nextafter(np.nextafter(root, -np.inf), -np.inf), 0.0)


def above(square: np.ndarray) -> np.ndarray:
    """No less than the root."""
    root = np.sqrt(np.asarray(square, np.float64))
    return np.nextafter(np.nextafter(root, np.inf), np.inf)


@dataclass(frozen=True)
class Node:
    """splits: entry indices. children: a node or None for each. low, high [i, j]: range of distances from split i to child j and its split."""

    splits: tuple[int, ...]
    children: tuple[Node | None, ...]
    low: np.ndarray
    high: np.ndarray


class Gnat:
    """entries: (m, d) integers."""

    def __init__(self, entries: np.ndarray, fanout: int = 4):
        self.entries, self.fanout = entries, max(2, fanout)
        self.root = self._grow(np.arange(len(entries))) if len(entries) else None

    def _grow(self, members: np.ndarray) -> Node:
        x = self.entries
        far = np.stack([squares(x[members], x[members[0]])])
        splits = [0]
        while len(splits) < min(self.fanout, len(members)):  # the member farthest from all split points
            away = far.min(0)
            away[splits] = -1
            splits.append(int(away.argmax()))
            far = np.vstack([far, squares(x[members], x[members[splits[-1]]])])
        child = far.argmin(0)
        child[splits] = np.arange(len(splits))  # equal entries may be split points together
        groups = [np.flatnonzero(child == j) for j in range(len(splits))]
        low = np.array([[below(far[i, g].min()) for g in groups] for i in range(len(splits))])
        high = np.array([[above(far[i, g].max()) for g in groups] for i in range(len(splits))])
        rest = [members[g[g != s]] for g, s in zip(groups, splits, strict=True)]
        return Node(tuple(int(members[s]) for s in splits), tuple(self._grow(r) if len(r) else None for r in rest), low, high)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index, squared distance) of the nearest entry for each row of x, and how many distances were measured."""
        index = np.full(len(x), len(self.entries), np.int64)
        least = np.full(len(x), np.iinfo(np.int64).max)
        measured = self._search(self.root, x, np.arange(len(x)), index, least) if self.root else 0
        return index, least, measured

    def _search(self, node: Node, x: np.ndarray, rows: np.ndarray, index: np.ndarray, least: np.ndarray) -> int:
        alive = np.ones((len(rows), len(node.splits)), bool)
        measured = 0
        for i, split in enumerate(node.splits):
            at = np.flatnonzero(alive[:, i])
            mine = rows[at]
            square = squares(x[mine], self.entries[split])
            measured += len(at)
            better = (square < least[mine]) | ((square == least[mine]) & (split < index[mine]))
            least[mine[better]], index[mine[better]] = square[better], split
            reach = above(least[mine])
            beyond = below(square)[:, None] > np.nextafter(node.high[i][None, :] + reach[:, None], np.inf)
            short = np.nextafter(above(square) + reach, np.inf)[:, None] < node.low[i][None, :]
            alive[at] &= ~(beyond | short)
        for j, child in enumerate(node.children):
            if child is not None and alive[:, j].any():
                measured += self._search(child, x, rows[alive[:, j]], index, least)
        return measured


def _limit(width: int, scale: int) -> float:
    """Components below this keep the squared distance of two whole vectors within 63 bits."""
    return math.sqrt(2.0**61 / width) / scale


@dataclass(frozen=True)
class Codebooks:
    """books: (entries, width / parts) integers for each part."""

    books: tuple[np.ndarray, ...]
    width: int
    coding: Coding

    def integers(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(mask of the rows that take part, their integer vectors)"""
        taking, x = matrix(column, self.width, _limit(self.width, self.coding.scale))
        return taking, np.floor(self.coding.scale * x).astype(np.int64)

    def trees(self) -> list[Gnat]:
        return [Gnat(b, self.coding.fanout) for b in self.books]

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(str(c) for b in self.books for c in b.ravel().tolist()).encode()).hexdigest()


def _cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return [np.ascontiguousarray(p) for p in np.split(x, parts, axis=1)]


def _sums(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(part, entry, place, n, total): counts and component sums of the parts nearest to each entry."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        trees, parts = books.trees(), books.coding.parts
        count = np.zeros((parts, len(books.books[0])), np.int64)
        total = np.zeros((*count.shape, books.width // parts), np.int64)
        for batch in batches:
            _, x = books.integers(batch.column(0))
            for p, part in enumerate(_cut(x, parts)):
                index, _, _ = trees[p].nearest(part)
                count[p] += np.bincount(index, minlength=count.shape[1])
                for e in np.unique(index):
                    total[p, e] += part[index == e].sum(0)
        used = np.argwhere(np.broadcast_to(count[:, :, None] > 0, total.shape))
        if len(used):
            p, e, _ = used.T
            columns = [*used.astype(np.int32).T, count[p, e], total[tuple(used.T)]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "entry", "place", "n", "total"])

    rows = vectors.select("v").mapInArrow(run, "part int, entry int, place int, n long, total long")
    exact = F.sum(F.col("total").cast("decimal(38,0)"))
    return rows.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), exact.alias("total"))


def fit(vectors: DataFrame, coding: Coding = Coding()) -> Codebooks | None:
    """Codebooks for vectors (vec_id, embedding), from all of them; None where none takes part."""
    rows = vectors.select("vec_id", F.col("embedding").alias("v"))
    fine = F.sqrt(F.lit(2.0**61) / F.size("v")) / coding.scale
    width = usual_width(rows, fine, coding.parts)
    if not width:
        return None
    first = rows.filter((F.size("v") == width) & within(F.col("v"), fine)).orderBy(F.col("vec_id").asc_nulls_last(), "v")
    start = np.floor(coding.scale * np.array([r["v"] for r in first.limit(coding.entries).collect()], np.float64)).astype(np.int64)
    books = Codebooks(tuple(_cut(start, coding.parts)), width, coding)
    for _ in range(coding.rounds):
        moved = [b.copy() for b in books.books]
        for r in _sums(rows, books).collect():  # parts x entries x places rows at most
            moved[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
        books = Codebooks(tuple(moved), width, coding)
    return books


def encoded(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of the vectors that take part: two hex digits per part, and the squared distance to the entries.

    A code of more than two hex digits per part cannot be: books hold 256 entries at most here.
    """
    if len(books.books[0]) > 256:
        raise ValueError("two hex digits name 256 entries at most")
    label = vectors.schema["label"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        trees = books.trees()
        for batch in batches:
            taking, x = books.integers(batch.column(2))
            codes, error = np.zeros((len(x), len(trees)), np.uint8), np.zeros(len(x), np.int64)
            for p, part in enumerate(_cut(x, len(trees))):
                codes[:, p], least, _ = trees[p].nearest(part)
                error += least
            mask, size = pa.array(taking), 2 * len(trees)
            text = codes.tobytes().hex()
            code = pa.array([text[i : i + size] for i in range(0, len(text), size)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask), code, pa.array(error)], ["vec_id", "label", "code", "error"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {kind}, label {label}, code string, error long")


def vector_codes(vectors: DataFrame, coding: Coding = Coding()) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of vectors (vec_id, embedding, label)."""
    books = fit(vectors, coding)
    if books is None:
        none = vectors.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return none.withColumn("label_error", F.col("error")).withColumn("codebooks_sha256", F.col("code"))
    codes = written(encoded(vectors, books), "codes")
    totals = written(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    joined = codes.join(if_small(totals), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
