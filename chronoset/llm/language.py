"""Language identification by nearest centroid.

A text's vector has the TF-IDF weights of its hashed character n-grams (1 to 3 characters of the lower-cased text, with all but
letters as spaces), of unit length. Each language has several centroids, clustered by cosine from a bounded sample of labelled
texts; document frequencies are counted over all labelled texts. The language of the most similar centroid is predicted. Texts
much farther from it than its own sample are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold

DIMS = 4096
#: Labelled texts that centroids are fitted to, at most, dealt evenly to the languages; LEAST_SAMPLE of each at least.
SAMPLE_ROWS = 4000
LEAST_SAMPLE = 20
CENTROIDS = 4
#: Sampled texts that a centroid stands for, at least, unless it is its language's only one.
LEAST_TEXTS = 8
#: Characters of a slice of texts.
SLICE_CHARS = 1 << 18
SLICE_TEXTS = 128

_LETTER = np.fromiter((chr(i).isalpha() for i in range(1 << 16)), dtype=bool, count=1 << 16)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int, list[str | None]]]:
    """Some texts at a time, of a bounded number of bytes unless one alone is longer."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    lo = total = 0
    for i, n in enumerate(size):
        total += int(n)
        if total >= SLICE_CHARS or i + 1 - lo >= SLICE_TEXTS:
            yield lo, i + 1, texts.slice(lo, i + 1 - lo).to_pylist()
            lo, total = i + 1, 0
    if lo < len(size):
        yield lo, len(size), texts.slice(lo).to_pylist()


def counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram counts of each text, and whether it has a letter."""
    raw = np.frombuffer(" ".join((t or "").lower() for t in texts).encode("utf-32-le") if texts else b"", dtype=np.uint32)
    size = np.array([len((t or "").lower()) for t in texts], dtype=np.int64)
    first = np.cumsum(size + 1) - size - 1
    letter = _LETTER[np.minimum(raw, 0xFFFF)]
    high = np.flatnonzero(raw > 0xFFFF)
    if len(high):
        kinds, which = np.unique(raw[high], return_inverse=True)
        letter[high] = np.array([chr(k).isalpha() for k in kinds])[which]
    code = np.where(letter, raw, 32).astype(np.uint32)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), size + 1)[: len(raw)]
    left = np.repeat((first + size).astype(np.int32), size + 1)[: len(raw)] - np.arange(len(raw), dtype=np.int32)  # characters of the text from here on
    out = np.zeros(len(texts) * DIMS, dtype=np.int64)
    h = code * np.uint32(0x9E3779B1)
    grown = h
    for n in (1, 2, 3):
        if n > 1:
            grown = np.zeros_like(h)
            grown[: len(h) - n + 1] = before[: len(h) - n + 1] * np.uint32(0x85EBCA6B) + h[n - 1 :]
        before = grown
        mixed = (grown ^ (grown >> np.uint32(15))) * np.uint32(0xC2B2AE35 + 2 * n)
        keep = (left >= n) & (letter if n == 1 else np.ones(1, dtype=bool))
        if n > 1:
            keep = keep.copy()
            keep[: len(h) - n + 1] &= letter[: len(h) - n + 1] | letter[n - 1 :]
        out += np.bincount((text * DIMS + (mixed >> np.uint32(20)).astype(np.int32))[keep], minlength=len(out))
    has = np.bincount(text[letter & (left > 0)], minlength=len(texts)) > 0 if len(raw) else np.zeros(len(texts), dtype=bool)
    return out.reshape(len(texts), DIMS), has


def vectors(found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (np.log1p(found) * idf).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray  # the language of a centroid
    least: np.ndarray  # similarity below which a text is rejected
    sharpness: float


def _cluster(x: np.ndarray, k: int, rounds: int = 8, least_texts: int = LEAST_TEXTS) -> np.ndarray:
    """Centroids of spherical k-means; starts at the mean's nearest row, then at rows least like those chosen.

    A centroid with fewer than `least_texts` rows says nothing of its language's spread: its rows go to the others.
    """
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(chosen) < min(k, len(x)):
        like = (x @ x[chosen].T).max(axis=1)
        if like.min() > 0.999:
            break
        chosen.append(int(np.argsort(like, kind="stable")[len(x) // 10 if len(x) > 50 else 0]))
    c = x[chosen]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        rows = np.bincount(own, minlength=len(c))
        kept = np.flatnonzero(rows >= least_texts) if (rows >= least_texts).any() else np.array([int(np.argmax(rows))])
        if len(kept) < len(c):
            c = c[kept]
            own = np.argmax(x @ c.T, axis=1)
        c = np.stack([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, k: int = CENTROIDS, sharpness: float = 25.0, slack: float = 0.5) -> Model:
    """labelled: (key, text, lang); rows of null text or lang, or without a letter, teach nothing.

    slack: a text is rejected if its similarity is below this part of the lowest hundredth of its language's sample, each text
    of which is compared with its nearest centroid.
    """
    labelled = labelled.where("text is not null and lang is not null").select(F.col("key").cast("string").alias("key"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))

    def seen(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(DIMS + 1, dtype=np.int64)
        for b in batches:
            for _, _, texts in _slices(b.column(0)):
                found, has = counts(texts)
                total[:DIMS] += (found > 0).sum(axis=0)
                total[DIMS] += has.sum()
        return total

    seen_in = fold(labelled.select("text"), seen, DIMS + 1)
    idf = np.log((1 + seen_in[DIMS]) / (1 + seen_in[:DIMS])) + 1
    rows = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}  # one row a language
    per = max(LEAST_SAMPLE, sample_rows // max(1, len(rows)))
    ask = per + 5 * per**0.5  # so that a hash draws `per` but rarely fewer
    draw = F.pmod(F.xxhash64("key", F.lit("language")), F.lit(1 << 30))
    share = F.lit(None).cast("long")
    for lang, n in rows.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1 << 30, int((1 << 30) * ask / n)))).otherwise(share)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, texts in _slices(b.column(2)):
                found, has = counts(texts)
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([np.minimum(f, 65535).astype(np.uint16).tobytes() if ok else None for f, ok in zip(found, has, strict=True)], pa.binary())], ["draw", "lang", "counts"])

    drawn = labelled.withColumn("draw", draw).where(F.col("draw") < share).select("draw", "lang", "text").mapInArrow(sparse, "draw long, lang string, counts binary").where("counts is not null")
    taken = sorted((tuple(r) for r in drawn.collect()), key=lambda r: (r[1], r[0], r[2]))  # about sample_rows
    languages = sorted({r[1] for r in taken})
    parts, owner, least = [], [], []
    for i, lang in enumerate(languages):
        x = vectors(np.stack([np.frombuffer(r[2], dtype=np.uint16) for r in taken if r[1] == lang][:per]), idf)
        c = _cluster(x, k)
        parts += list(c)
        owner += [i] * len(c)
        least += [slack * float(np.quantile((x @ c.T).max(axis=1), 0.01))] * len(c)
    return Model(languages, idf, np.stack(parts) if parts else np.zeros((0, DIMS), np.float32), np.array(owner, dtype=np.int64), np.array(least), sharpness)


def _judge(model: Model, column: pa.Array) -> tuple[list[str], list[float], list[bool], list[float]]:
    langs, scores, out, near = [], [], [], []
    for lo, hi, texts in _slices(column):
        found, has = counts(texts)
        if not len(model.owner):
            has[:] = False
            like = np.zeros((hi - lo, 1))
        else:
            like = vectors(found, model.idf) @ model.centroids.T
        best = np.argmax(like, axis=1)
        top = like[np.arange(len(like)), best]
        each = np.stack([like[:, model.owner == i].max(axis=1) for i in range(len(model.languages))], axis=1) if len(model.owner) else like
        score = 1 / np.exp(model.sharpness * (each - top[:, None])).sum(axis=1)
        for i in range(hi - lo):
            ok = bool(has[i])
            langs.append(model.languages[model.owner[best[i]]] if ok else "und")
            scores.append(round(float(score[i]), 6) if ok else 0.0)
            near.append(round(float(top[i]), 6) if ok else 0.0)
            out.append(not ok or bool(top[i] < model.least[best[i]]))
    return langs, scores, out, near


_NAMES = ["lang_pred", "score", "rejected", "similarity"]


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of docs with lang_pred, score (0 to 1), rejected and similarity (cosine to the nearest centroid).

    Only the column `text` is looked at. A null text, one without a letter, or any text if nothing was learnt: `und`, score 0,
    rejected. Equal texts get equal rows; very long texts count whole. An empty table gives none.
    """
    from pyspark.sql.types import StructType

    held = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*keep, *([] if text in keep else [F.col(text).cast("string").alias(text)]))
    at = docs.columns.index(text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores, out, near = _judge(held.value, b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(out, pa.bool_()), pa.array(near, pa.float64())], [*keep, *_NAMES])

    kind = StructType([*docs.schema.fields[: len(keep)], *StructType.fromDDL("lang_pred string, score double, rejected boolean, similarity double").fields])
    return docs.mapInArrow(rows, kind)


def keep_known(docs: DataFrame, learn: Column) -> DataFrame:
    """docs without texts that are rejected; learnt from the rows of docs where `learn` holds. Columns are those of docs.

    Null texts and texts without a letter are rejected, and all if nothing is learnt; repeated rows go or stay together.
    """
    model = fit(docs.where(learn).select(F.col("doc_id").alias("key"), "text", "lang"))
    own = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(own))])
    return identify(plain, model, plain.columns, f"c{own.index('text')}").where("not rejected").drop(*_NAMES).toDF(*own)
