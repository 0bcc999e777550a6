"""Benchmark decontamination by a prefix-filtered join of word windows.

A window is `size` consecutive words of an item (all of a shorter one). Its word shingles are ordered by how rare they are in all
documents (counted in a sketch of fixed size; any order gives the same hits); as a match must contain the whole window, the prefix
of that order that it can't miss has length one, so documents meet a window only at its rarest shingle. The shingle's place in the
window gives the place where a match would start (positional bound) and end (length bound); there the document's words are
compared with the window's, word by word.

A benchmark of up to `block_words` words is broadcast, and documents pass through one narrow map. A larger one is joined by a
shuffle on the anchor: documents send only places that a bitmap of all anchors, of fixed size, lets through, once for equal texts;
an anchor that many documents have is dealt over parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as X
from .common import cut, fold, keyed_join

#: Words of a benchmark that is broadcast; about 250 bytes a word in each Python worker.
BLOCK_WORDS = 400_000
WINDOW = 13
SHINGLE = 3
#: Places of the sketch that counts shingles, and of the bitmap of anchors, as powers of two.
SKETCH_BITS, FILTER_BITS = 18, 27
#: Hits of one anchor that one task joins.
HOT = 100_000


class Block(NamedTuple):
    """Windows by length and rarest shingle. Postings of an anchor: off[i]:off[i + 1]."""

    width: int  # words of a shingle
    anchors: np.ndarray
    off: np.ndarray
    place: np.ndarray  # of the anchor in the window
    length: np.ndarray
    begin: np.ndarray  # of the window's words in `words`
    words: np.ndarray
    item_off: np.ndarray  # items of a posting
    items: np.ndarray
    names: list[str | None]


def _items(items: DataFrame) -> DataFrame:
    return items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()


def _sketch(texts: DataFrame, shingle: int) -> np.ndarray:
    """How often shingles are found in the documents, by the first bits of their hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for b in batches:
            for s in X.slices(b.column(0)):
                low = X.LOWER[s.data]
                runs = X.grams(X.word_hashes(low, X.words(low, s.off, X.ALNUM)), shingle)
                total += np.bincount((runs >> X.U64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        return total

    return fold(texts, count, 1 << SKETCH_BITS)


def _anchor(part: np.ndarray, shingle: int, counts: np.ndarray) -> tuple[int, int, int]:
    """(hash, place, words) of a window's rarest shingle; ties to the smaller hash, then to the first place."""
    n = min(shingle, len(part))
    own = X.grams(part, n)
    place = int(np.lexsort((own, counts[(own >> X.U64(64 - SKETCH_BITS)).astype(np.int64)]))[0])
    return int(own[place]), place, n


_BITS = 22


def _filter(keys: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << _BITS, dtype=bool)
    seen[(keys >> X.U64(64 - _BITS)).astype(np.int64)] = True
    return seen


_FILTERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _find(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values that are among the sorted keys, and which key each is."""
    held = _FILTERS.get(id(keys))
    if held is None or held[0] is not keys:
        if len(_FILTERS) > 8:
            _FILTERS.clear()
        held = _FILTERS[id(keys)] = (keys, _filter(keys))
    at = np.flatnonzero(held[1][(values >> X.U64(64 - _BITS)).astype(np.int64)])
    key = np.searchsorted(keys, values[at])
    hit = keys[np.minimum(key, len(keys) - 1)] == values[at] if len(keys) else np.zeros(0, bool)
    return at[hit], key[hit]


def _index(counts: np.ndarray, rows: list[tuple[str | None, str]], size: int, shingle: int) -> list[Block]:
    """The windows of all items, for a broadcast."""
    names = sorted({r[0] for r in rows}, key=lambda x: (x is None, x))
    number = {x: i for i, x in enumerate(names)}
    found: dict[bytes, tuple[int, int, set[int]]] = {}
    parts, at = [np.zeros(0, X.U64)], 0
    for s in X.slices(pa.array([r[1] for r in rows])):
        low = X.LOWER[s.data]
        w = X.words(low, s.off, X.ALNUM)
        h = X.word_hashes(low, w)
        for i in range(s.hi - s.lo):
            own = h[w.off[i] : w.off[i + 1]]
            for k in range(max(1, len(own) - size + 1) if len(own) else 0):
                n = min(size, len(own))
                found.setdefault(own[k : k + n].tobytes(), (at + int(w.off[i]) + k, n, set()))[2].add(number[rows[s.lo + i][0]])
        parts.append(h)
        at += len(h)
    words = np.concatenate(parts)
    by_width: dict[int, list[tuple]] = {}
    for begin, n, who in found.values():
        key, place, width = _anchor(words[begin : begin + n], shingle, counts)
        by_width.setdefault(width, []).append((key, place, n, begin, sorted(who)))
    out = []
    for width, postings in sorted(by_width.items()):
        postings.sort(key=lambda p: (p[0], p[2], p[1], p[3]))
        keys = np.array([p[0] for p in postings], dtype=X.U64)
        anchors, first = np.unique(keys, return_index=True)
        place, length, begin = (np.array([p[i] for p in postings], dtype=np.int64) for i in (1, 2, 3))
        out.append(Block(width, anchors, np.append(first, len(keys)), place, length, begin, words, np.cumsum([0] + [len(p[4]) for p in postings]), np.array([i for p in postings for i in p[4]], dtype=np.int64), names))
    return out


def _match(block: Block, h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, length, posting) of each window found; off: of each text's words."""
    at, key = _find(block.anchors, X.grams(h, block.width))
    many = block.off[key + 1] - block.off[key]
    post = np.repeat(block.off[key] - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
    begin = np.repeat(at, many) - block.place[post]
    text = np.searchsorted(off, np.repeat(at, many), "right") - 1
    fits = (begin >= off[text]) & (begin + block.length[post] <= off[text + 1])
    begin, post = begin[fits], post[fits]
    for k in range(int(block.length[post].max()) if len(post) else 0):
        longer = block.length[post] > k
        same = ~longer
        same[longer] = h[begin[longer] + k] == block.words[block.begin[post[longer]] + k]
        begin, post = begin[same], post[same]
    return begin, block.length[post], post


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _scan(texts: pa.Array, blocks: list[Block]) -> Iterator[tuple[int, int, list[int], list[list[dict]], list[list[str]]]]:
    """Of each slice: rows, words of each text, and the spans and items found."""
    for s in X.slices(texts):
        low = X.LOWER[s.data]
        w = X.words(low, s.off, X.ALNUM)
        h = X.word_hashes(low, w)
        n = s.hi - s.lo
        spans: list[list[dict]] = [[] for _ in range(n)]
        items: list[set[str]] = [set() for _ in range(n)]
        edge = np.zeros(len(h) + 1, dtype=np.int64)
        touched: set[int] = set()
        for block in blocks:
            begin, length, post = _match(block, h, w.off)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + length, -1)
            text = np.searchsorted(w.off, begin, "right") - 1
            touched.update(text.tolist())
            for t, p in set(zip(text.tolist(), post.tolist(), strict=True)):
                items[t].update(x for i in block.items[block.item_off[p] : block.item_off[p + 1]] if (x := block.names[i]) is not None)
        hit = np.cumsum(edge[:-1]) > 0
        for t in touched:
            own = np.concatenate(([False], hit[w.off[t] : w.off[t + 1]], [False]))
            change = np.flatnonzero(own[1:] != own[:-1])
            spans[t] = [{"first": int(a), "last": int(b) - 1} for a, b in zip(change[::2], change[1::2], strict=True)]
        yield s.lo, s.hi, np.diff(w.off).tolist(), spans, [sorted(x) for x in items]


def find_contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, shingle: int = SHINGLE, block_words: int = BLOCK_WORDS, keep_text: bool = True) -> DataFrame:
    """docs (text and any other columns; without text if not keep_text) with n_words, spans (closed ranges of hit words) and items (ids found, sorted as strings).

    A column of docs with one of those names is replaced. Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z is
    lower-cased. A null or empty text has no words and no hits; items with null or no words find nothing; an item with a null id
    marks words but isn't listed. Repeated items count once; repeated documents each give a row; empty tables find nothing.
    """
    docs = docs.drop(*(c for c in docs.columns if c in {"n_words", "spans", "items"}))
    items = cut(_items(items))
    most = items.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0  # no text has more words
    texts = docs.select(F.col("text").cast("string").alias("text"))
    if most > block_words:
        return _by_shuffle(docs, texts, items, size, shingle, keep_text)
    rows = [tuple(r) for r in items.collect()]  # about block_words words at most
    held = docs.sparkSession.sparkContext.broadcast(_index(_sketch(texts, shingle), rows, size, shingle) if rows else [])

    def find(texts: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        for lo, hi, n, spans, found in _scan(texts, held.value):
            yield lo, hi, [pa.array(n, pa.int64()), pa.array(spans, _SPANS), pa.array(found, pa.list_(pa.string()))]

    return _pass(docs, find, "n_words long, spans array<struct<first:long,last:long>>, items array<string>", keep_text)


def _pass(df: DataFrame, find: Any, added: str, keep_text: bool) -> DataFrame:
    """df with the columns that find() makes of slices of the texts."""
    from pyspark.sql.types import StructType

    at = df.columns.index("text")
    df = df.withColumn("text", F.col("text").cast("string"))
    kept = [i for i in range(len(df.columns)) if keep_text or i != at]
    more = StructType.fromDDL(added)
    names = [df.columns[i] for i in kept] + more.names

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, made in find(b.column(at)):
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.columns[i] for i in kept), *made], names)

    return df.mapInArrow(rows, StructType([*(df.schema.fields[i] for i in kept), *more.fields]))


def _digest(data: np.ndarray) -> bytes:
    return hashlib.blake2b(data.tobytes(), digest_size=16).digest()


def _by_shuffle(docs: DataFrame, texts: DataFrame, items: DataFrame, size: int, shingle: int, keep_text: bool) -> DataFrame:
    """find_contamination() for a benchmark of any size: nothing but sketches of fixed size and short lists is broadcast."""
    send = docs.sparkSession.sparkContext.broadcast
    counts = send(_sketch(texts, shingle))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in X.slices(b.column(1)):
                low = X.LOWER[s.data]
                w = X.words(low, s.off, X.ALNUM)
                h = X.word_hashes(low, w)
                for i in range(s.hi - s.lo):
                    a, z = int(w.off[i]), int(w.off[i + 1])
                    words = [low[w.start[j] : w.end[j]].tobytes().decode(errors="replace") for j in range(a, z)]
                    out = []
                    for k in range(max(1, z - a - size + 1) if z > a else 0):
                        key, place, _ = _anchor(h[a + k : min(z, a + k + size)], shingle, counts.value)
                        out.append((np.uint64(key).astype(np.int64).item(), place, words[k : k + size]))
                    if out:
                        cols = list(zip(*out, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.string())), pa.array([b.column(0)[s.lo + i].as_py()] * len(out), pa.string())], ["anchor", "place", "words", "item_id"])

    found = items.select("item_id", "text").mapInArrow(windows, "anchor long, place int, words array<string>, item_id string")
    wanted = cut(found.groupBy("anchor", "place", "words").agg(F.collect_set("item_id").alias("who")))

    def mark(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        bits = np.zeros(1 << FILTER_BITS - 3, dtype=np.uint8)
        for b in batches:
            h = b.column(0).to_numpy().view(np.uint64) >> X.U64(64 - FILTER_BITS)
            np.bitwise_or.at(bits, (h >> X.U64(3)).astype(np.int64), np.left_shift(1, (h & X.U64(7)).astype(np.uint8)).astype(np.uint8))
        return bits

    marks = send(fold(wanted.select("anchor"), mark, 1 << FILTER_BITS - 3, "uint8", add=np.bitwise_or))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = marks.value
        for b in batches:
            for s in X.slices(b.column(0)):
                low = X.LOWER[s.data]
                w = X.words(low, s.off, X.ALNUM)
                h = X.word_hashes(low, w)
                out: list[tuple] = []
                keys: dict[int, bytes] = {}
                for n in range(1, shingle + 1):
                    runs = X.grams(h, n)
                    place = runs >> X.U64(64 - FILTER_BITS)
                    at = np.flatnonzero((bits[(place >> X.U64(3)).astype(np.int64)] >> (place & X.U64(7)).astype(np.uint8)) & 1)
                    text = np.searchsorted(w.off, at, "right") - 1
                    fits = at + n <= w.off[text + 1]
                    for j, t in zip(at[fits].tolist(), text[fits].tolist(), strict=True):
                        a, z = max(int(w.off[t]), j - size + n), min(int(w.off[t + 1]), j + size)
                        if t not in keys:
                            keys[t] = _digest(s.data[s.off[t] : s.off[t + 1]])
                        out.append((keys[t], int(runs[j].astype(np.int64)), j - int(w.off[t]), j - a, [low[w.start[i] : w.end[i]].tobytes().decode(errors="replace") for i in range(a, z)]))
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string())), strict=True)], ["key", "anchor", "at", "lead", "near"])

    near = cut(texts.mapInArrow(hits, "key binary, anchor long, at long, lead int, near array<string>").dropDuplicates(["key", "anchor", "at"]))
    hot = near.groupBy("anchor").count().where(F.col("count") > HOT).select("anchor", F.ceil(F.col("count") / HOT).cast("int").alias("parts"))  # a HOT-th of the hits at most
    one = F.coalesce("parts", F.lit(1))
    near = near.join(F.broadcast(hot), "anchor", "left").withColumn("part", F.pmod(F.xxhash64("key"), one).cast("int")).drop("parts")
    wanted = wanted.join(F.broadcast(hot), "anchor", "left").withColumn("part", F.explode(F.sequence(F.lit(0), one - 1))).drop("parts")
    same = (F.col("place") <= F.col("lead")) & (F.slice("near", F.col("lead") - F.col("place") + 1, F.size("words")) == F.col("words"))
    met = near.join(wanted, ["anchor", "part"]).where(same).select("key", (F.col("at") - F.col("place")).alias("first"), (F.col("at") - F.col("place") + F.size("words") - 1).alias("last"), "who")
    met = cut(met)
    own = Window.partitionBy("key").orderBy("first", "last")
    ended = F.max("last").over(own.rowsBetween(Window.unboundedPreceding, -1))
    spans = met.select("key", "first", "last", F.coalesce(F.col("first") > ended + 1, F.lit(True)).cast("int").alias("new")).withColumn("span", F.sum("new").over(own))
    spans = spans.groupBy("key", "span").agg(F.min("first").alias("first"), F.max("last").alias("last")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))
    names = met.select("key", F.explode_outer("who").alias("item")).groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    made = cut(spans.join(names, "key").withColumnRenamed("key", "__key"))

    def count(texts: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        for s in X.slices(texts):
            w = X.words(X.LOWER[s.data], s.off, X.ALNUM)
            yield s.lo, s.hi, [pa.array(np.diff(w.off)), pa.array([_digest(s.data[s.off[i] : s.off[i + 1]]) for i in range(s.hi - s.lo)], pa.binary())]

    out = keyed_join(_pass(docs, count, "n_words long, __key binary", keep_text), made, "__key", "left").drop("__key")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return out.select(*(c for c in out.columns if c not in ("spans", "items")), empty("spans", "array<struct<first:bigint,last:bigint>>"), empty("items", "array<string>"))


def hit_words() -> Any:
    """The number of hit words, from spans."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)


def is_contaminated(times: int = 20) -> Any:
    """At least one word in `times` is hit."""
    return (F.size("spans") > 0) & (hit_words() * times >= F.col("n_words"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without contaminated ones, with the columns of docs, whatever their names.

    A null text or one without words is clean; repeated rows go or stay together; empty tables give what there is.
    """
    own = docs.columns
    plain = docs.toDF(*["text" if c == "text" else f"c{i}" for i, c in enumerate(own)])
    return find_contamination(plain, items).where(~is_contaminated()).select(*plain.columns).toDF(*own)


#: DuckDB: the digest columns of op3 from find_contamination(), by equality of whole windows.
HITS_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         COALESCE(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), i AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, k, k + 12), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM b WHERE len(w) > 0)
), g AS (
  SELECT r, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)
), m AS (SELECT r, k, i.n, item_id FROM g JOIN i ON i.n = g.n AND i.g = g.g
), h AS (SELECT r, count(DISTINCT k + j) AS hit FROM (SELECT DISTINCT r, k, n FROM m), range(13) t(j) WHERE j < n GROUP BY r
), t AS (SELECT r, count(*) AS items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT r, item_id::VARCHAR AS name FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, COALESCE(hit, 0)::BIGINT AS n_hit, COALESCE(items, 0)::BIGINT AS n_items, sha256(COALESCE(names, '')) AS items_sha256,
       COALESCE(hit, 0) > 0 AND 20 * COALESCE(hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
