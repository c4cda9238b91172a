"""Whitening of vectors by a bidiagonal qd solver.

The rows x are centred, y = x - mean, and their covariance is Y'Y / n. It is never formed: blocks of rows are reduced to
a triangle R by QR, triangles are joined and reduced again in a tree, and Y'Y = R'R. Householder reflections from both sides
make R bidiagonal, R = U B V'. The dqds iteration finds the singular values of B, each to nearly full relative accuracy.
For each value wanted, two factorisations of B'B - value, one from the top and one from the bottom, are joined where they fit best (a
twisted factorisation); the vector it gives, turned by V, is a component. Values so close that their vectors
would not come out orthogonal are solved again against the vectors before them.

Sums, triangles and rows are dealt by Spark; the driver gets one sum per dimension and one triangle.

Integers: a component c becomes x = floor(scale * c) + shift, so sums and deviations are exact.

Defined results: vectors that are null or hold null or non-finite components take no part; neither do those whose length differs from the
usual one or with components of 2^47 / scale or more. Components without variance (one row, equal rows, dependent dimensions) cannot be
whitened and are left out. Repeated rows count as often as they come. No rows, no result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import written
from tracelake.llm.vectors import matrix, usual_width

EPS = float(np.finfo(float).eps)


# Householder, dqds and twisted factorisations, on one matrix.


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V) with r = U B V' for the square matrix r."""
    a, n = np.array(r, np.float64), len(r)
    v = np.eye(n)

    def mirror(x: np.ndarray) -> tuple[np.ndarray, float] | None:
        """w and t so that (1 - t w w') x lies on the first axis."""
        size = np.linalg.norm(x)
        if len(x) < 2 or not np.any(x[1:]):
            return None
        w = x.copy()
        w[0] += math.copysign(size, x[0])
        w /= np.abs(w).max()
        return w, 2.0 / float(w @ w)

    for k in range(n):
        if (m := mirror(a[k:, k])) is not None:
            a[k:, k:] -= np.outer(m[0] * m[1], m[0] @ a[k:, k:])
            a[k + 1 :, k] = 0.0
        if k + 2 < n and (m := mirror(a[k, k + 1 :])) is not None:
            a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ m[0], m[0] * m[1])
            a[k, k + 2 :] = 0.0
            v[:, k + 1 :] -= np.outer(v[:, k + 1 :] @ m[0], m[0] * m[1])
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), v


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One dqds transform. (q, e, least d); a negative least d says that the shift exceeds the least value."""
    d = q[0] - shift
    least, qs, es = d, [], []
    for i in range(len(e)):
        if d < 0:
            return qs, es, d
        whole = d + e[i]
        if whole == 0:  # a zero value: the rest stands alone
            qs.append(0.0)
            es.append(0.0)
            d = q[i + 1] - shift
        else:
            part = q[i + 1] / whole
            qs.append(whole)
            es.append(e[i] * part)
            d = d * part - shift
        least = min(least, d)
    qs.append(d)
    return qs, es, least


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Squares of the singular values, falling, of the bidiagonal matrix with squared diagonal q and squared superdiagonal e."""
    found: list[float] = []
    small = (100 * EPS) ** 2
    work = [(list(q), list(e), 0.0)]
    while work:
        q, e, base = work.pop()
        for _ in range(200 * len(q) + 200):
            if len(q) == 1:
                found.append(base + q[0])
                break
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= small * (base + min(q[i], q[i + 1])) or e[i] <= small * base), None)
            if cut is not None:
                work += [(q[: cut + 1], e[:cut], base), (q[cut + 1 :], e[cut + 1 :], base)]
                break
            if 1.5 * q[0] < q[-1]:  # the values are found from the small end
                q, e = q[::-1], e[::-1]
            # The last two rows bound the least value from above; their tie to the rest says how far it may lie below.
            x, y, tie = q[-2] + e[-1], q[-1], q[-1] * e[-1]
            bound = q[-2] * q[-1] / ((x + y) / 2 + math.sqrt(((x - y) / 2) ** 2 + tie)) if x + y > 0 else 0.0
            loose = math.sqrt(q[-2] * e[-2]) if len(e) > 1 else 0.0
            for shift in (max(bound - loose, 0.0), max(bound - loose, 0.0) * 0.25, 0.0):
                qs, es, least = _step(q, e, shift * (1 - 4 * EPS))
                if least >= 0 or shift == 0.0:
                    break
            q, e, base = [max(x, 0.0) for x in qs], es, base + shift * (1 - 4 * EPS)
        else:
            raise ArithmeticError("the qd iteration does not converge")
    return sorted(found, reverse=True)


class Twisted:
    """B'B - value, factorised from both ends and joined at the row with the smallest remainder."""

    def __init__(self, q: np.ndarray, ratio: np.ndarray, value: float, floor: float):
        n = len(q)
        down, left, up, right = np.zeros(n), np.zeros(n - 1), np.zeros(n), np.zeros(n - 1)
        s, tops = -value, np.zeros(n)
        for i in range(n):
            tops[i] = s
            down[i] = s + q[i] or floor
            if i < n - 1:
                left[i] = q[i] * ratio[i] / down[i]
                s = left[i] * ratio[i] * s - value
        p, ends = q[-1] - value, np.zeros(n)
        ends[-1] = p
        for i in range(n - 2, -1, -1):
            up[i + 1] = q[i] * ratio[i] ** 2 + p or floor
            part = q[i] / up[i + 1]
            right[i] = ratio[i] * part
            p = p * part - value
            ends[i] = p
        remainder = tops + ends + value
        self.at = int(np.argmin(np.abs(remainder)))
        self.remainder = float(remainder[self.at]) or floor
        self.down, self.left, self.up, self.right = down, left, up, right

    def vector(self) -> np.ndarray:
        """The solution whose only remainder is at the twist."""
        z = np.zeros(len(self.down))
        z[self.at] = 1.0
        return self._spread(z)

    def solve(self, b: np.ndarray) -> np.ndarray:
        z, n, r = np.array(b, np.float64), len(b), self.at
        for i in range(r):
            z[i + 1] -= self.left[i] * z[i]
        for i in range(n - 2, r - 1, -1):
            z[i] -= self.right[i] * z[i + 1]
        z[:r] /= self.down[:r]
        z[r + 1 :] /= self.up[r + 1 :]
        z[r] /= self.remainder
        return self._spread(z)

    def _spread(self, z: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore", invalid="ignore"):
            for i in range(self.at - 1, -1, -1):
                z[i] -= self.left[i] * z[i + 1]
            for i in range(self.at, len(z) - 1):
                z[i + 1] -= self.right[i] * z[i]
        return z / np.abs(z).max()


def _orthogonal(z: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, float]:
    """(the part of z, as a unit vector, that the columns of before leave; its share of z)"""
    z = z / np.linalg.norm(z)
    rest = z - before @ (before.T @ z)
    left = float(np.linalg.norm(rest))
    rest /= left or 1.0
    rest -= before @ (before.T @ rest)
    return rest / (np.linalg.norm(rest) or 1.0), left


def right_vectors(diagonal: np.ndarray, upper: np.ndarray, values: list[float], near: float = 1e-3) -> np.ndarray:
    """Columns: unit eigenvectors of B'B for its given values (falling)."""
    top = max(values[0], np.finfo(float).tiny)
    floor = EPS * EPS * top
    diagonal = np.where(np.abs(diagonal) < EPS * math.sqrt(top) * EPS, EPS * EPS * math.sqrt(top), diagonal)
    q, ratio = diagonal**2, upper / diagonal[:-1]
    out = np.zeros((len(q), len(values)))
    rng = np.random.default_rng(0)
    for k, value in enumerate(values):
        factors = Twisted(q, ratio, value, floor)
        z = factors.vector()
        close = [j for j in range(k) if values[j] - value <= near * values[j]]
        if close:
            before = out[:, close]
            z, left = _orthogonal(z, before)
            if left < 0.1:  # z is one of the vectors before: start from another one
                z, left = _orthogonal(rng.normal(size=len(q)), before)
                for _ in range(10):
                    z, left = _orthogonal(factors.solve(z), before)
                    if left > 0.1:
                        break
        out[:, k] = z / np.linalg.norm(z)
    return out


def principal(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(values, falling; their unit vectors as columns; sum of all values) of r'r for the square matrix r, without values that are rounding only."""
    size = float(np.abs(r).max(initial=0))
    if size == 0:
        return np.zeros(0), np.zeros((len(r), 0)), 0.0
    diagonal, upper, v = bidiagonal(r / size)
    values = dqds((diagonal**2).tolist(), (upper**2).tolist())
    kept = [x for x in values[:most] if x > (len(r) * EPS) ** 2 * values[0]]
    vectors = v @ right_vectors(diagonal, upper, kept)
    vectors *= np.sign(vectors[np.abs(vectors).argmax(0), range(len(kept))])
    return np.array(kept) * size**2, vectors, math.fsum(values) * size**2


# The rows, on Spark.


@dataclass(frozen=True)
class Frame:
    """Of the fitted rows: width, n, exact sums per dimension; scale and shift make components integers."""

    width: int
    n: int
    sums: tuple[int, ...]
    scale: int
    shift: int

    def spread(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(mask of the rows that take part, n * x - sums as exact integers)"""
        taking, x = _integers(column, self.width, self.scale, self.shift)
        most = max(int(np.abs(x).max(initial=0)) * self.n, *(abs(s) for s in self.sums))
        kind = np.int64 if most < 1 << 62 else object
        return taking, x.astype(kind) * self.n - np.array(self.sums, kind)

    def centred(self, spread: np.ndarray) -> np.ndarray:
        return spread.astype(np.float64) / self.n


def _integers(column, width: int, scale: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    taking, x = matrix(column, width, 2.0**47 / scale)
    return taking, np.floor(scale * x).astype(np.int64) + shift


def measure(vectors: DataFrame, scale: int, shift: int) -> Frame | None:
    """The frame of vectors (column v); None where none takes part."""
    width = usual_width(vectors, 2.0**47 / scale)
    if not width:
        return None

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total, n = [0] * width, 0
        for batch in batches:
            _, x = _integers(batch.column(0), width, scale, shift)
            total = [a + b for a, b in zip(total, x.sum(0).tolist(), strict=True)]
            n += len(x)
        if n:
            columns = [pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, ["place", "n", "total"])

    rows = vectors.select("v").mapInArrow(run, "place int, n long, total decimal(38,0)")
    sums = rows.groupBy("place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("place").collect()  # one row per dimension
    return Frame(width, sums[0]["n"], tuple(int(r["total"]) for r in sums), scale, shift)


def _triangle(blocks: list[np.ndarray], width: int) -> np.ndarray:
    r = np.linalg.qr(np.concatenate([np.zeros((0, width)), *blocks]), mode="r")
    return r if len(r) == width else np.concatenate([r, np.zeros((width - len(r), width))])


def triangle(vectors: DataFrame, frame: Frame, fan_in: int = 8) -> np.ndarray:
    """R with R'R = Y'Y for the centred rows Y of vectors (column v)."""
    width = frame.width

    def blocks(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        r = None
        for batch in batches:
            _, spread = frame.spread(batch.column(0))
            if len(spread):
                r = _triangle([*([] if r is None else [r]), frame.centred(spread)], width)
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], ["place", "r"])

    def join(key, rows):
        import pandas as pd

        r = _triangle([np.frombuffer(x, np.float64).reshape(width, width) for x in rows.sort_values("place")["r"]], width)
        return pd.DataFrame({"place": [key[0]], "r": [r.tobytes()]})

    level = written(vectors.select("v").mapInArrow(blocks, "place long, r binary"), "triangles")
    places = level.agg(F.max("place")).first()[0]
    while places > 0:
        level = level.withColumn("up", F.floor(F.col("place") / fan_in)).groupBy("up").applyInPandas(join, "place long, r binary")
        places //= fan_in
    return np.frombuffer(level.first()["r"], np.float64).reshape(width, width)


def whitened(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of vectors (vec_id, embedding), a row per vector and component.

    deviation, decimal(38,0): sum over dimensions of (n x - sum)^2. whitened: the centred row on the component, over the root of its
    variance. explained: share of the variance. identity_error: how far the covariance of whitened is from the identity, at most.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = vectors.select("vec_id", F.col("embedding").alias("v"))
    frame = measure(rows, scale, shift)
    values, axes, whole = principal(triangle(rows, frame), components) if frame else (np.zeros(0), np.zeros((0, 0)), 0.0)
    k = len(values)
    if not k:
        shape = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], shape)
    weights = [np.ascontiguousarray(axes[:, i]) / math.sqrt(values[i] / frame.n) for i in range(k)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            taking, spread = frame.spread(batch.column(1))
            exact = spread if spread.size and float(np.abs(spread).max()) ** 2 * frame.width < 2.0**62 else spread.astype(object)
            deviation = [Decimal(int(d)) for d in (exact**2).sum(1)] if len(spread) else []
            y = frame.centred(spread)
            w = np.stack([(y * x).sum(1) for x in weights], 1)  # row by row, so equal rows get equal values
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, k, dtype=np.int32)), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(taking)), pa.array(deviation, pa.decimal128(38, 0)), lists], ["vec_id", "deviation", "w"])

    wide = written(rows.mapInArrow(run, f"vec_id {kind}, deviation decimal(38,0), w array<double>"), "whitened")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = wide.agg(*(F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs, strict=True))
    explained = F.array(*(F.lit(float(x / whole)) for x in values))
    long = wide.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return long.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(frame.n).cast("long").alias("n"), "deviation", "whitened",
                       explained[F.col("at")].alias("explained"), F.lit(float(error)).alias("identity_error"))
