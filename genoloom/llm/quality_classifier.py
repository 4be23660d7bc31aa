"""Document quality by regularised quadratic discriminant analysis.

Each class has a mean and a covariance of transformed document statistics. A class covariance is shrunk towards the pooled
one, and that towards a multiple of the identity; its Cholesky factor is kept. A document's raw score is the difference of
the two log densities, that is of Mahalanobis distances and log determinants, plus the log ratio of the class sizes. A
logistic curve, fitted on the training rows' raw scores, turns it into a probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from genoloom.session import materialize

STATISTICS = (
    "words", "word_length", "word_length_spread", "upper", "digits", "marks", "symbols", "other_signs", "beyond_ascii", "lines", "line_length",
    "duplicate_lines", "repeated_pairs", "repeated_windows", "distinct_words", "top_word", "same_as_previous", "symbol_words", "short_words", "sentence_ends", "capital_words",
)
BINS, SPAN = 4000, 200.0

_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_MARKS = b".,;:!?'\"()-"
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\r\x0b\x0c"
_PLAIN = bytes(range(97, 123)) + _UPPER + _DIGITS + _MARKS + _SYMBOLS + _SPACES + bytes(range(128, 256))


def statistics_of(data: bytes) -> list[float]:
    """The transformed statistics of a UTF-8 text: logarithms of counts, square roots of shares. An empty text has zeros."""
    words = data.split()
    n, size = len(words), max(1, len(data))
    share = lambda chars: (len(data) - len(data.translate(None, chars))) / size
    if not n:
        return [0.0] * len(STATISTICS)
    lengths = np.fromiter(map(len, words), np.float64, n)
    lines = [x for x in data.split(b"\n") if x.strip()]
    counts = Counter(words)
    pairs = max(1, n - 1)
    windows = max(1, n - 4)
    raw = (
        share(_UPPER), share(_DIGITS), share(_MARKS), share(_SYMBOLS), len(data.translate(None, _PLAIN)) / size, share(bytes(range(128, 256))),
    )
    roots = (
        1 - len(set(lines)) / len(lines),
        1 - len(set(zip(words, words[1:]))) / pairs if n > 1 else 0.0,
        1 - len(set(zip(words, words[1:], words[2:], words[3:], words[4:]))) / windows if n > 4 else 0.0,
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / pairs,
        sum(w[-1] in _SYMBOLS for w in words) / n,
        float((lengths <= 3).mean()),
        sum(w[-1] in b".!?" for w in words) / n,
        sum(w[0] in _UPPER for w in words) / n,
    )
    return [
        np.log1p(n), np.log(lengths.mean()), np.log1p(lengths.std()), *np.sqrt(raw), np.log1p(len(lines)), np.log1p(len(data) / len(lines)), *np.sqrt(np.maximum(0.0, roots)),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x array<double>) of whole texts; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                x = [statistics_of(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=[id_col, "x"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, T.StructType([docs.schema[id_col], T.StructField("x", T.ArrayType(T.DoubleType()))]))


@dataclass(frozen=True)
class Model:
    """Means, inverse Cholesky factors and log determinants of classes 0 and 1, and the logistic curve."""

    centre: np.ndarray
    spread: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    inverse_factors: tuple[np.ndarray, np.ndarray]
    log_dets: tuple[float, float]
    log_ratio: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.spread, -8, 8)
        d = [((z - m) @ f.T) ** 2 for m, f in zip(self.means, self.inverse_factors)]
        return 0.5 * (d[0].sum(axis=1) + self.log_dets[0] - d[1].sum(axis=1) - self.log_dets[1]) + self.log_ratio

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.clip(self.raw(x), -SPAN, SPAN) + self.shift, -500, 500)))


def _sums(train: DataFrame, centre: np.ndarray, spread: np.ndarray) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class: rows, sum and sum of products of the standardised, clipped statistics. Only these sums reach the driver."""
    d = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + d + d * d))
        for b in batches:
            y = b.column("y").to_numpy()
            x = b.column("x").flatten().to_numpy().reshape(-1, d)
            z = np.clip((x - centre) / spread, -8, 8)
            for c in (0, 1):
                own = z[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        for c in (0, 1):
            if total[c, 0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(total.shape[1], c)), pa.array(np.arange(total.shape[1])), pa.array(total[c])], names=["y", "k", "v"])

    out = {c: np.zeros(1 + d + d * d) for c in (0, 1)}
    for r in train.mapInArrow(run, "y long, k long, v double").groupBy("y", "k").agg(F.sum("v").alias("v")).collect():
        out[r.y][r.k] = r.v
    return {c: (v[0], v[1 : 1 + d], v[1 + d :].reshape(d, d)) for c, v in out.items()}


def fit(train: DataFrame, class_shrinkage: float = 0.15, identity_shrinkage: float = 0.02) -> Model | None:
    """A model from all rows of train (x, y in 0 and 1); None if a class has no rows."""
    d = len(STATISTICS)
    first = _sums(train, np.zeros(d), np.full(d, 1.0))
    n = {c: first[c][0] for c in (0, 1)}
    if not n[0] or not n[1]:
        return None
    every = n[0] + n[1]
    centre = (first[0][1] + first[1][1]) / every
    spread = np.sqrt(np.maximum(np.diag(first[0][2] + first[1][2]) / every - centre**2, 0))
    spread[spread < 1e-9] = 1.0
    sums = _sums(train, centre, spread)
    means = [sums[c][1] / n[c] for c in (0, 1)]
    covs = [sums[c][2] / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / every
    factors, dets = [], []
    for c in (0, 1):
        s = (1 - class_shrinkage) * covs[c] + class_shrinkage * pooled
        s = (1 - identity_shrinkage) * s + identity_shrinkage * max(np.trace(s) / d, 1e-6) * np.eye(d)
        factor = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(factor))
        dets.append(float(2 * np.log(np.diag(factor)).sum()))
    model = Model(centre, spread, tuple(means), tuple(factors), tuple(dets), float(np.log(n[1] / n[0])))
    return Model(**{**model.__dict__, **_curve(train, model)})


def _curve(train: DataFrame, model: Model) -> dict[str, float]:
    """The logistic curve over the raw scores, from a histogram of fixed size."""
    d = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BINS), np.int64)
        for b in batches:
            raw = np.clip(model.raw(b.column("x").flatten().to_numpy().reshape(-1, d)), -SPAN, SPAN)
            np.add.at(total, (b.column("y").to_numpy().astype(int), np.minimum(BINS - 1, ((raw + SPAN) / (2 * SPAN) * BINS).astype(int))), 1)
        c, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(k), pa.array(total[c, k])], names=["y", "k", "v"])

    n = np.zeros((2, BINS))
    for r in train.mapInArrow(run, "y long, k long, v long").groupBy("y", "k").agg(F.sum("v").alias("v")).collect():
        n[r.y, r.k] = r.v
    s = (np.arange(BINS) + 0.5) / BINS * 2 * SPAN - SPAN
    w = np.array([0.05, 0.0])
    for _ in range(100):  # damped Newton steps with a weak prior that keeps separable classes finite
        p = 1 / (1 + np.exp(-np.clip(w[0] * s + w[1], -500, 500)))
        all_n = n.sum(axis=0)
        g = np.array([((all_n * p - n[1]) * s).sum() + 1e-2 * w[0], (all_n * p - n[1]).sum() + 1e-2 * w[1]])
        q = all_n * p * (1 - p)
        h = np.array([[(q * s * s).sum() + 1e-2, (q * s).sum()], [(q * s).sum(), q.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 0.5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return {"slope": max(float(w[0]), 1e-4), "shift": float(w[1])}


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, cut: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) of each row of docs.

    Labels (id, 0 or 1) are learnt only from rows whose crc32(id as text) modulo ``folds`` is not 0; other label values,
    null labels and null ids are not learnt from. All such rows are used; what reaches the driver are sums of fixed size.
    Without labels of both classes every score is 0.5. Scores come from the text's statistics alone; null and empty texts
    have the statistics of a text without words. held_out is false for null ids.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))
    stats = materialize(document_statistics(docs, id_col, text_col), "quality-statistics")
    known = labels.select(F.col(id_col), F.col(label_col).cast("long").alias("y")).where(F.col("y").isin(0, 1) & F.col(id_col).isNotNull())
    train = materialize(stats.where(~held).join(known, id_col).select("x", "y"), "quality-train")
    model = fit(train)
    d = len(STATISTICS)
    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(-1, d)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x) if model else np.full(len(x), 0.5))], names=[id_col, "score"])

    scored = stats.mapInArrow(run, schema)
    return scored.select(id_col, held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
