"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; everything else is unlabelled web
text. A linear scorer on text features minimises the non-negative unbiased risk
(logistic loss): with class prior p, p E_pos[l(g)] + max(0, E_unl[l(-g)] - p E_pos[l(-g)]). When
the bracket turns negative, the step goes against it, so the scorer cannot win by
calling labelled rows special. The prior is estimated from a first scorer that tells
positives from unlabelled text: above a threshold that only good text reaches, the
two groups' shares stand in the ratio of the prior; the threshold with the lowest
upper confidence bound is used.

The scorer is fitted on a sample of rows whose size is a parameter; sums that
the fit needs are no larger than that sample. Scoring reads every whole text.

Defined results: null and empty texts have the features of an empty text and get a
score. Rows with a null doc_id count as held out. A document with several labels is a positive
only when all of them are 1; null labels are none. Without positives every score is 0.5.
Repeated rows are scored alike. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAMES = (
    "letters", "upper", "digits", "space", "marks", "symbols", "accented", "upper_words", "title_words", "letter_words",
    "single_words", "word_length", "distinct", "top_word", "echo", "size", "line_length", "line_copies", "marks_per_word", "symbols_per_word",
)
FEW = 6  # ordinary words of five letters that every text is given besides its own
SYMBOLS = "#*%$&|~^=<>{}[]\\/_@+`"


def _classes() -> np.ndarray:
    """Class of a character by code point up to 127, and of all others at 128."""
    table = np.full(129, 4, np.int64)  # other marks
    for code in range(128):
        c = chr(code)
        table[code] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c.isspace() else 5 if c in SYMBOLS else 4
    table[128] = 6
    return table


CLASSES = _classes()


def features(text: str) -> list[float]:
    """Shares in 0 to 1 and logarithms of sizes. Short texts are drawn towards an ordinary one, as a few words prove little."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    lower, upper, digits, space, marks, symbols, accented = np.bincount(CLASSES[np.minimum(codes, 128)], minlength=7).tolist()
    words, n = text.split(), len(text) + 6 * FEW
    k, counts, letters = len(words) + FEW, Counter(words), lower + upper + 5 * FEW
    lower, space = lower + 5 * FEW, space + FEW
    lines = text.split("\n")
    return [
        (lower + upper + accented) / n, upper / letters, digits / n, space / n, marks / n, symbols / n, accented / n,
        sum(map(str.isupper, words)) / k, sum(map(str.istitle, words)) / k, (sum(map(str.isalpha, words)) + FEW) / k,
        sum(len(w) == 1 for w in words) / k, float(np.log1p((n - space) / k)), float(np.log1p(len(counts) + FEW) / np.log1p(k)),
        max(counts.values(), default=0) / k, sum(map(eq, words, words[1:])) / k, float(np.log1p(k)), float(np.log1p(n / len(lines))),
        1 - len(set(lines)) / len(lines), min(marks / k, 4.0), min(symbols / k, 4.0),
    ]


@dataclass(frozen=True)
class Fit:
    """rows: of each of the two groups that the fit reads, about; steps, rate, decay: of gradient descent."""

    rows: int = 20_000
    steps: int = 400
    rate: float = 0.05
    decay: float = 1e-3
    folds: int = 5
    seed: int = 42


@dataclass(frozen=True)
class Scorer:
    """A linear scorer on standardised features; prior: the estimated share of good text."""

    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        # Summed row by row: a matrix product rounds by a row's place in its batch, and equal texts must score alike.
        z = _standard(x, np.array(self.centre), np.array(self.scale))
        return sigmoid((z * np.array(self.weights)).sum(1) + self.bias)


def sigmoid(g: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(g / 2))


def _standard(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - centre) / scale, -8, 8)


def _descend(gradient, size: int, fit: Fit) -> tuple[np.ndarray, float]:
    """Adam on full batches, from zero."""
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, fit.steps + 1):
        g = gradient(w[:-1], w[-1])
        g[:-1] += fit.decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - fit.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _mean_gradient(x: np.ndarray, w: np.ndarray, b: float, sign: int) -> np.ndarray:
    """Of the mean of log(1 + exp(-sign g)) over the rows."""
    slope = -sign * sigmoid(-sign * (x @ w + b)) / len(x)
    return np.append(slope @ x, slope.sum())


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives in unlabelled text, from the scores of both groups."""
    edges = np.quantile(positive, np.linspace(0, 0.9, 91))
    up = np.array([(unlabelled >= e).mean() for e in edges])
    pp = np.array([(positive >= e).mean() for e in edges])
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(unlabelled)) + 1 / np.sqrt(len(positive)))
    best = int(np.argmin((up + slack) / pp))
    return float(np.clip(up[best] / pp[best], 0.05, 0.99))


def fit_scorer(positive: np.ndarray, unlabelled: np.ndarray, fit: Fit = Fit()) -> Scorer:
    size = len(NAMES)
    if not len(positive) or not len(unlabelled):
        return Scorer((0.0,) * size, (1.0,) * size, (0.0,) * size, 0.0, 0.5)
    centre, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = _standard(positive, centre, scale), _standard(unlabelled, centre, scale)
    w, b = _descend(lambda w, b: 0.5 * (_mean_gradient(p, w, b, 1) + _mean_gradient(u, w, b, -1)), size, fit)
    prior = estimated_prior(p @ w + b, u @ w + b)

    def gradient(w: np.ndarray, b: float) -> np.ndarray:
        negative = np.logaddexp(0, u @ w + b).mean() - prior * np.logaddexp(0, p @ w + b).mean()
        bracket = _mean_gradient(u, w, b, -1) - prior * _mean_gradient(p, w, b, -1)
        return prior * _mean_gradient(p, w, b, 1) + bracket if negative >= 0 else -bracket

    w, b = _descend(gradient, size, fit)
    return Scorer(tuple(centre.tolist()), tuple(scale.tolist()), tuple(w.tolist()), b, prior)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows whose labels are never learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def _feature_rows(docs: DataFrame, rows: int) -> np.ndarray:
    """Features of so many rows of docs at most, on the driver. They are made where the texts are read; only numbers move."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = [features(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64()))], ["x"])

    found = docs.select("text").mapInArrow(run, "x array<double>").limit(rows).collect()
    return np.array([r["x"] for r in found], np.float64).reshape(-1, len(NAMES))


def _sampled(df: DataFrame, rows: int, seed: int) -> DataFrame:
    """About rows of df by hash of doc_id."""
    share = min(1.0, rows / max(df.count(), 1))
    return df.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) < share * (1 << 20))


def train(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Scorer:
    """labels (doc_id, quality)."""
    known = labels.filter("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    good = known.filter((F.col("quality") == 1) & ~held_out(F.col("doc_id"), fit.folds)).select("doc_id")
    chosen = F.broadcast(_sampled(good, fit.rows, fit.seed).limit(2 * fit.rows))  # 2 x fit.rows ids at most
    texts = docs.select("doc_id", "text")
    positive = _feature_rows(texts.join(chosen, "doc_id", "left_semi"), 2 * fit.rows)
    unlabelled = _feature_rows(_sampled(texts.filter(~held_out(F.col("doc_id"), fit.folds)), fit.rows, fit.seed + 1), 2 * fit.rows)
    return fit_scorer(positive, unlabelled, fit)


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """docs (all columns, a column named score is replaced) with score."""
    kept = docs.drop("score")
    at = kept.columns.index("text")
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "score double"])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = np.array([features(t or "") for t in batch.column(at).to_pylist()]).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scorer.score(x))], [*batch.schema.names, "score"])

    return kept.mapInArrow(run, fields)
