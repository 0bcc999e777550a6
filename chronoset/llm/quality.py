"""A quality classifier: regularised quadratic discriminant analysis over transformed statistics of a text.

Each class has a mean and a covariance, shrunk towards the pooled one and then towards its diagonal; moments are summed over all
labelled rows. A score is the logistic of the log-density difference, from Mahalanobis distances by cached Cholesky factors.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .common import cut, fold

_UPPER = X.byte_class((65, 90))
_LOWER = X.byte_class((97, 122), (0x80, 0xFF))
_DIGIT = X.byte_class((48, 57))
_STOP = X.byte_class((0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F))
_SPACE = ~X.NON_SPACE
_MARK = ~(_UPPER | _LOWER | _DIGIT | _STOP | _SPACE)
FEATURES = ["words", "word_length", "spread", "upper", "digit", "stop", "mark", "marked_words", "odd_words", "new_words", "new_pairs", "repeats", "most_common", "lines", "line_length"]
D = len(FEATURES)


def _log(x: np.ndarray, least: float = 1e-3) -> np.ndarray:
    return np.log(x + least)


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; logarithms of sizes and shares."""
    low = X.LOWER[data]
    w = X.words(low, off, X.NON_SPACE)
    h = X.word_hashes(low, w)
    n = len(off) - 1
    text = np.repeat(np.arange(n), np.diff(w.off))
    words = np.diff(w.off).astype(float)
    size = np.maximum(np.diff(off), 1).astype(float)
    some = np.maximum(words, 1)

    def share(kind: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(kind[data])))
        return (sums[off[1:]] - sums[off[:-1]]) / size

    def per_text(of_word: np.ndarray) -> np.ndarray:
        return np.bincount(text, of_word, minlength=n) / some

    length = (w.end - w.start).astype(float)
    mean = per_text(length)
    spread = np.sqrt(np.maximum(per_text(length**2) - mean**2, 0))
    tail, head = low[w.end - 1] if len(h) else low[:0], low[w.start] if len(h) else low[:0]
    pair = X.grams(h, 2)
    pair_text = text[: len(pair)]
    inside = pair_text == text[1 : len(pair) + 1]
    repeats = np.bincount(pair_text[inside], (h[:-1] == h[1:])[inside], minlength=n)[:n] if len(pair) else np.zeros(n)
    fresh, fresh_pairs, top = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        a, b = w.off[i], w.off[i + 1]
        if b > a:
            kinds, many = np.unique(h[a:b], return_counts=True)
            fresh[i], top[i] = len(kinds) / (b - a), many.max() / (b - a)
            fresh_pairs[i] = len(np.unique(pair[a : b - 1])) / (b - a - 1) if b - a > 1 else 1
    lines = np.concatenate(([0], np.cumsum(data == 10)))
    lines = lines[off[1:]] - lines[off[:-1]] + 1.0
    cols = [np.log1p(words), _log(mean), _log(spread), _log(share(_UPPER)), _log(share(_DIGIT)), _log(share(_STOP)), _log(share(_MARK)), _log(per_text(_MARK[tail] * 1.0)), _log(per_text(_MARK[head] * 1.0)), _log(fresh), _log(fresh_pairs), _log(repeats / some), _log(top), np.log(lines), np.log1p(size / lines)]
    return np.stack(cols, axis=1)


class Model(NamedTuple):
    prior: float  # log-odds of class 1
    means: np.ndarray
    factors: np.ndarray  # inverse Cholesky factors
    log_dets: np.ndarray
    cooling: float


def table(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each row's whole text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in X.slices(b.column(1)):
                x = statistics(s.data, s.off)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.lo, s.hi - s.lo), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, x binary")


def fit(labelled: DataFrame, pool: float = 0.1, diagonal: float = 0.05, floor: float = 1e-3) -> Model | None:
    """labelled: (x, label). Covariances are (1 - pool) own + pool common, then (1 - diagonal) of that and its diagonal.

    None if a class has no rows. The cooling factor divides log-densities by the mean excess of their spread, as statistics
    aren't normal; it is learnt from the same moments' quadratic forms in a second pass.
    """
    k = 1 + D + D * D

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(2 * k)
        for b in batches:
            if len(b):
                x = np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=np.float64).reshape(-1, D)
                y = b.column(1).to_numpy(zero_copy_only=False)
                for c in (0, 1):
                    own = x[y == c]
                    out[c * k : (c + 1) * k] += np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
        return out

    labelled = labelled.where("x is not null and label in (0, 1)").select("x", F.col("label").cast("int").alias("label"))
    got = fold(labelled, moments, 2 * k, "float64").reshape(2, k)
    if not (got[:, 0] > 0).all():
        return None
    means = got[:, 1 : D + 1] / got[:, :1]
    covs = got[:, D + 1 :].reshape(2, D, D) / got[:, 0, None, None] - means[:, :, None] * means[:, None, :]
    common = (got[:, 0, None, None] * covs).sum(axis=0) / got[:, 0].sum()
    factors, dets = [], []
    for c in (0, 1):
        cov = (1 - pool) * covs[c] + pool * common
        cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + floor * np.eye(D)
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        dets.append(2 * np.log(np.diag(low)).sum())
    model = Model(float(np.log(got[1, 0] / got[0, 0])), means, np.stack(factors), np.array(dets), 1.0)

    def spread(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        """Counts of each class by margin, over a fixed grid."""
        out = np.zeros(2 * len(GRID))
        for b in batches:
            if len(b):
                m = margins(model, np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=np.float64).reshape(-1, D))
                y = b.column(1).to_numpy(zero_copy_only=False)
                out += np.bincount(y * len(GRID) + np.searchsorted(GRID[:-1], m), minlength=2 * len(GRID))
        return out

    seen = fold(labelled, spread, 2 * len(GRID), "float64").reshape(2, -1)
    return _calibrated(model, seen)


GRID = np.linspace(-60, 60, 241)


def _calibrated(model: Model, seen: np.ndarray) -> Model:
    """A slope and an intercept that make margins log-odds (Platt), by Newton's method over the grid."""
    m, n, good = np.clip(GRID, -60, 60), seen.sum(axis=0), (seen[1] + 1e-9)
    rate = (seen[1].sum() + 1) / (n.sum() + 2)
    w = np.array([1.0 * 0.2, np.log(rate / (1 - rate))])
    z = np.stack([m, np.ones_like(m)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        grad = z.T @ (n * p - good) + 1e-3 * w
        hess = (z * (n * p * (1 - p) + 1e-9)[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return model._replace(prior=float(w[1]), cooling=float(max(w[0], 1e-3)))


def margins(model: Model, x: np.ndarray) -> np.ndarray:
    """Log-density of class 1 less that of class 0."""
    far = [(((x - model.means[c]) @ model.factors[c].T) ** 2).sum(axis=1) + model.log_dets[c] for c in (0, 1)]
    return (far[0] - far[1]) / 2


def score(rows: DataFrame, model: Model | None) -> DataFrame:
    """rows (doc_id, x) with score: 0 to 1, higher if class 1 is likelier; 0.5 for all if nothing could be learnt."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if held.value is None or not len(b):
                s = np.full(len(b), 0.5)
            else:
                z = held.value.cooling * np.clip(margins(held.value, np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.float64).reshape(-1, D)), -60, 60) + held.value.prior
                s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round(s, 6))], ["doc_id", "score"])

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, name: str, learn: F.Column) -> DataFrame:
    """(doc_id, score) of each row of docs, learnt from labels (doc_id, `name`) where `learn` holds of doc_id.

    A label of a document is the least of its rows' labels; others than 0 and 1 teach nothing. A null or empty text has the
    statistics of no words. A null doc_id is scored but not learnt from; repeated rows each give a row, and teach once each. Other
    columns of docs or labels, whatever their names, don't matter. An empty table gives no rows.
    """
    rows = cut(table(docs))
    own = labels.where(learn & F.col(name).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("labelled_id")).agg(F.min(name).alias("label"))
    return score(rows, fit(cut(rows.join(own, rows["doc_id"] == own["labelled_id"]).select("x", F.col("label").cast("int").alias("label")))))
