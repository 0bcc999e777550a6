"""A counterfactual-regularised toxicity classifier.

Logistic regression over which words and beginnings of words a text has (hashed; scaled by their smoothed log-odds in the sample). For each labelled
sentence that has an identity term, the term is swapped with the others of its group and the square of the score's change (as
log-odds) is added to the loss, so that a neutral mention of a group moves the score no more than a mention of any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X

BITS = 18
DIMS = 1 << BITS
#: Bytes of a word's beginning; words of one stem share it.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Labelled rows of each class that the classifier is fitted to, at most.
SAMPLE_ROWS = 2000
#: Weight of the squared change of score on a swap, in the loss.
SWAP_WEIGHT = 5.0
#: Sampled texts that a feature is in, at least; what is rarer is left to the L2 term only from there on.
LEAST = 3

#: Identity terms in groups whose members can stand for each other; each group has neutral words.
IDENTITY_GROUPS: tuple[tuple[str, ...], ...] = (
    ("person", "man", "woman", "nonbinary", "transgender"),
    ("people", "men", "women", "gays", "lesbians", "christians", "muslims", "jews", "hindus", "buddhists", "atheists", "immigrants", "refugees"),
    ("someone", "boy", "girl"),
    ("human", "gay", "lesbian", "bisexual", "queer", "straight", "homosexual", "heterosexual"),
    ("religious", "christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant"),
    ("local", "black", "white", "asian", "african", "european", "latino", "arab", "american", "mexican", "chinese", "indian"),
    ("adult", "old", "young", "elderly", "teenage"),
    ("able", "disabled", "blind", "deaf"),
)


def buckets(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct buckets of each text's words and of the beginnings of its longer words."""
    low = X.LOWER[data]
    w = X.words(low, off, X.ALNUM)
    parts, bounds = [X.word_hashes(low, w) >> X.U64(64 - BITS)], [w.off]
    size = w.end - w.start
    for n in BEGINNINGS:
        longer = size > n
        start = w.start[longer]
        parts.append(X.mix(X.word_hashes(low, X.Words(start, start + n, w.off)) + X.U64(n)) >> X.U64(64 - BITS))
        bounds.append(np.concatenate(([0], np.cumsum(longer)))[w.off])
    parts = [p.astype(np.int32) for p in parts]
    return [np.unique(np.concatenate([p[b[i] : b[i + 1]] for p, b in zip(parts, bounds, strict=True)])) for i in range(len(off) - 1)]


def term_buckets(terms: tuple[str, ...]) -> np.ndarray:
    (s,) = X.slices(pa.array([" ".join(terms)]))
    w = X.words(s.data, s.off, X.ALNUM)
    return (X.word_hashes(s.data, w) >> X.U64(64 - BITS)).astype(np.int64)


def term_features(term: str) -> np.ndarray:
    """All buckets that the term gives a text, the word's own first."""
    (s,) = X.slices(pa.array([term]))
    (own,) = term_buckets((term,))
    (every,) = buckets(s.data, s.off)
    return np.concatenate(([own], every[every != own])).astype(np.int64)


def _sentences(data: np.ndarray, off: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """How many sentences have each term."""
    low = X.LOWER[data]
    w = X.words(low, off, X.ALNUM)
    h = X.word_hashes(low, w) >> X.U64(64 - BITS)
    at = np.flatnonzero(np.isin(h, terms.astype(np.uint64)))
    ends = np.cumsum(np.isin(low, np.frombuffer(b".!?\n", dtype=np.uint8)))
    sentence = ends[w.start[at]] if len(at) else at
    text = np.searchsorted(off, w.start[at], "right") if len(at) else at
    pairs = np.unique(np.stack([text, sentence, h[at].astype(np.int64)], axis=1), axis=0) if len(at) else np.zeros((0, 3), dtype=np.int64)
    return np.array([(pairs[:, 2] == t).sum() for t in terms])


class Model(NamedTuple):
    weights: np.ndarray
    bias: float


def _lbfgs(f, w: np.ndarray, rounds: int = 60, memory: int = 8) -> np.ndarray:  # noqa: ANN001
    """Minimises f, which gives a value and a gradient."""
    value, grad = f(w)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, used = grad.copy(), []
        for s, y, r in reversed(steps):
            a = r * (s @ q)
            used.append(a)
            q -= a * y
        if steps:
            s, y, _ = steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y, r), a in zip(steps, reversed(used), strict=True):
            q += (a - r * (y @ q)) * s
        step, slope = 1.0 if steps else min(1.0, 1.0 / max(1e-12, np.abs(grad).sum())), grad @ q
        if slope <= 1e-10:
            break
        while True:
            new, new_grad = f(w - step * q)
            if new <= value - 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        s, y = -step * q, new_grad - grad
        if s @ y > 1e-12:
            steps = [*steps[1 - memory :], (s, y, 1 / (s @ y))]
        done = abs(value - new) < 1e-8 * max(1.0, abs(value))
        w, value, grad = w - step * q, new, new_grad
        if done:
            break
    return w


def train(rows: list[np.ndarray], label: np.ndarray, weight: np.ndarray, swaps: list[tuple[int | np.ndarray, int | np.ndarray, float]], l2: float = 1.0, least: int = LEAST, swap_weight: float = SWAP_WEIGHT, rate: float | None = None) -> Model:
    """rows: each text's buckets. swaps: (term, other, sentences), where a term is all its
    buckets, the word's own first, or that alone. rate: of class 1, for the bias where nothing else speaks."""
    n = len(rows)
    if not n or not 0 < label.sum() < n:
        return Model(np.zeros(DIMS), float(np.log(((rate or 0) + 1e-3) / (1 - (rate or 0) + 1e-3))))
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    seen = np.bincount(flat, minlength=DIMS)
    bad = np.bincount(flat[label[owner] > 0], minlength=DIMS)
    # counts of the sample, unweighted: what few sampled rows don't have is no evidence of its own
    odds = np.log((bad + 0.5) / (label.sum() + 1)) - np.log((seen - bad + 0.5) / (n - label.sum() + 1))
    sides = [[np.atleast_1d(t) for t in x[:2]] for x in swaps]
    terms = sorted({int(t[0]) for x in sides for t in x})
    kept = seen >= least
    kept[terms] = True
    scale = np.where(kept, odds, 0.0)
    scale[terms] = 1.0
    feats = np.flatnonzero(kept)
    ids = np.full(DIMS, -1, dtype=np.int32)
    ids[feats] = np.arange(len(feats), dtype=np.int32)
    use = kept[flat]
    col, row = ids[flat[use]], owner[use]
    del flat, owner, use
    size = scale[feats]
    parts = [(i, ids[t], sign) for i, x in enumerate(sides) for t, sign in zip(x, (1.0, -1.0), strict=True)]
    swap = np.concatenate([np.full(len(t), i) for i, t, _ in parts] or [np.zeros(0, np.int64)])
    sign = np.concatenate([np.full(len(t), v) for _, t, v in parts] or [np.zeros(0)])
    part = np.concatenate([t for _, t, _ in parts] or [np.zeros(0, np.int64)]).astype(np.int64)
    swap, sign, part = swap[part >= 0], sign[part >= 0], part[part >= 0]
    sign = sign * size[part]
    c = np.array([x[2] for x in swaps])
    m = len(feats)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(row, (size * w[:m])[col], minlength=n) + w[m]
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        value = (weight * (np.logaddexp(0, z) - label * z)).sum() + l2 / 2 * (w[:m] @ w[:m])
        d = weight * (p - label)
        grad = np.append(size * np.bincount(col, d[row], minlength=m) + l2 * w[:m], d.sum())
        if len(c):
            gap = np.bincount(swap, sign * w[part], minlength=len(c))
            value += swap_weight / 2 * (c * gap * gap).sum()
            grad[:m] += np.bincount(part, sign * swap_weight * (c * gap)[swap], minlength=m)
        return float(value), grad

    w = _lbfgs(loss, np.zeros(m + 1))
    out = np.zeros(DIMS)
    out[feats] = w[:m] * size
    return Model(out, float(w[m]))


def fit(docs: DataFrame, labels: DataFrame, name: str, learn: F.Column, sample_rows: int = SAMPLE_ROWS, groups: tuple[tuple[str, ...], ...] = IDENTITY_GROUPS, swap_weight: float = SWAP_WEIGHT) -> Model:
    """Learns from at most sample_rows labelled documents of each class, drawn by a hash of doc_id, weighed to the classes' true sizes.

    A document's label is the greatest of its rows' labels; others than 0 and 1 teach nothing.
    """
    own = labels.where(learn & F.col(name).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("labelled_id")).agg(F.max(name).cast("int").alias("label"))
    sizes = {r[0]: r[1] for r in own.groupBy("label").count().collect()}
    order = [F.xxhash64("labelled_id", F.lit("toxicity")), F.col("labelled_id")]
    drawn = own.where("label = 0").orderBy(*order).limit(sample_rows).union(own.where("label = 1").orderBy(*order).limit(sample_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = texts.join(F.broadcast(drawn), texts["doc_id"] == drawn["labelled_id"]).select("doc_id", "label", "text")  # 2 sample_rows at most
    flat = np.unique(np.concatenate([term_buckets(g) for g in groups])) if groups else np.zeros(0, np.int64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in X.slices(b.column(2)):
                part = b.slice(s.lo, s.hi - s.lo)
                found = buckets(s.data, s.off)
                each = [_sentences(s.data[s.off[i] : s.off[i + 1]], np.array([0, s.off[i + 1] - s.off[i]]), flat) if np.isin(found[i], flat).any() else None for i in range(len(found))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([f.tobytes() for f in found], pa.binary()), pa.array([None if e is None else e.astype(np.int64).tobytes() for e in each], pa.binary())], ["doc_id", "label", "words", "terms"])

    got = sorted((tuple(r) for r in sample.mapInArrow(rows, "doc_id long, label int, words binary, terms binary").collect()), key=lambda r: (r[0], r[2]))
    label = np.array([r[1] for r in got], dtype=float)
    words = [np.frombuffer(r[2], dtype=np.int32) for r in got]
    have = {y: max(1, int((label == y).sum())) for y in (0, 1)}
    weight = np.array([sizes[int(y)] / have[int(y)] for y in label])
    weight *= len(got) / max(1e-9, weight.sum())
    sentences = np.zeros(len(flat))
    for r in got:
        if r[3] is not None:
            sentences += np.frombuffer(r[3], dtype=np.int64)
    swaps = []
    for g in groups:
        t = [term_features(x) for x in g]
        for i in t:
            for j in t:
                if i[0] != j[0]:
                    swaps.append((i, j, (1.0 + sentences[np.searchsorted(flat, i[0])]) / (len(t) - 1)))
    rate = sizes.get(1, 0) / max(1, sum(sizes.values()))
    return train(words, label, weight, swaps, swap_weight=swap_weight, rate=rate)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row: 0 to 1, higher if class 1 is likelier.

    A null or empty text has the score of no words. Equal texts have equal scores; repeated rows each give a row; an empty table
    gives none. A null doc_id stays. Other columns, whatever their names, don't matter.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in X.slices(b.column(1)):
                z = np.array([held.value.weights[x].sum() for x in buckets(s.data, s.off)]) + held.value.bias
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.lo, s.hi - s.lo), pa.array(np.round(1 / (1 + np.exp(-np.clip(z, -40, 40))), 6))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(rows, "doc_id long, score double")
