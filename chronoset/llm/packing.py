"""Best-fit packing of token sequences in bulk-synchronous rounds.

Documents are sorted by length and open sequences (gaps) by room, both by a range sort that spreads equal sizes over partitions.
A round takes the documents of an octave of lengths, longest octave first. Its sweep goes over the sorted runs: each run of equal
documents goes to the run of gaps that is its successor in size, then to the next, and what no gap holds opens sequences; documents
and gaps of equal sizes meet by rank, so no two want the same place. Then the gaps get their new room and are sorted again.

The sweep needs only how many documents and gaps there are of each size, at most `capacity` numbers, and gives runs of matches;
executors find each document's match by its rank. All together is what best-fit decreasing does one document at a time: a document
goes where it leaves the least room.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, ranked

CAPACITY = 1024
#: The id that ends a document.
END = 2
#: Characters that are encoded at once, if a text has a place to part it.
SLICE = 1 << 16
#: Ids in a batch, about.
BATCH_IDS = 1 << 20
#: Between two words of ASCII letters or digits a token always ends, whatever stands around them.
_PART = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z])")


@lru_cache(maxsize=2)
def encoder(vocabulary: str = "byte_bpe_50k.tiktoken", special: tuple[tuple[str, int], ...] = (("<|endoftext|>", 50256),)):  # noqa: ANN201
    """The public byte-level tokenizer: its ranks give the ids of byte_bpe_50k.json, three times as fast."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(special))


def encode(text: str, most: int = SLICE) -> np.ndarray:
    """The ids of a text, a slice of it at a time."""
    own = encoder()
    out, at = [], 0
    while len(text) - at > most and (m := _PART.search(text, at + most)):
        out.append(own.encode_to_numpy(text[at : m.start()], allowed_special="all"))
        at = m.start()
    out.append(own.encode_to_numpy(text[at:], allowed_special="all"))
    return np.concatenate(out)


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(key, piece, start, length, ids): each whole text's ids and the end's, cut into pieces of `capacity` if there are more.

    The first piece of those takes what is over, the others are full. ids are little-endian unsigned 32-bit numbers. A null text is
    empty: its only id is the end's. Repeated rows give repeated pieces, a null key is kept, an empty table gives no rows. Other
    columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            kind = b.schema.field(0).type
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.append(encode(t.as_py() or ""), np.uint32(end)).astype("<u4")
                first = len(ids) % capacity or min(len(ids), capacity)
                for i, stop in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, stop - capacity) if i else 0
                    rows.append((k, i, start, stop - start, ids[start:stop].tobytes()))
                    held += stop - start
                    if held >= BATCH_IDS:
                        yield _batch(rows, kind)
                        rows, held = [], 0
        if rows:
            yield _batch(rows, kind)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids binary")


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "piece", "start", "length", "ids"])


def sweep(lengths: dict[int, int], rooms: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], list[tuple], int]:
    """Matches of a round (length, first, room, gap, each, used), the gaps' use (room, first, count, used), and sequences opened.

    lengths and rooms: how many documents and gaps there are of each. Opened sequences are gaps of room `capacity`, ranked from 0.
    """
    runs: list[list[tuple[int, float, float, int]]] = [[] for _ in range(capacity + 1)]  # by room now: (room before, first, end, used)
    for room, n in rooms.items():
        runs[room].append((room, 0, n, 0))
    runs[capacity].append((capacity, 0, float("inf"), 0))
    out = []
    for s in sorted(lengths, reverse=True):
        d, n = 0, lengths[s]
        for room in range(s, capacity + 1):
            if d == n:
                break
            left = []
            for was, a, b, used in runs[room]:
                for each, gaps in ((room // s, (n - d) // (room // s)), (n - d, 1)):  # full ones, then the one that gets the rest
                    gaps = min(gaps, b - a)
                    if d < n and gaps and (each := min(each, n - d)):
                        out.append((s, d, was, a, each, used))
                        runs[room - each * s].append((was, a, a + gaps, used + each * s))
                        d, a = d + each * gaps, a + gaps
                if a < b:
                    left.append((was, a, b, used))
            runs[room] = left
    ends = [(was, int(a), int(b - a), used) for own in runs for was, a, b, used in own if b < float("inf")]
    opened = sum(n for was, _, n, _ in ends if was == capacity)
    return out, ends, opened


def _found(keys: np.ndarray, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The last run that begins at or before each (size, rank)."""
    return np.searchsorted(keys, (size << 44) | rank, "right") - 1


def _runs(rows: list[tuple], by: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The rows, as columns, in the order of a size and a rank, and both as one number."""
    rows = sorted(rows, key=lambda x: (x[by[0]], x[by[1]]))
    table = np.array(rows, dtype=np.int64).reshape(len(rows), -1).T if rows else np.zeros((8, 0), dtype=np.int64)
    return table, (table[by[0]] << 44) | table[by[1]]


def _used(gaps: DataFrame, ends: list[tuple]) -> DataFrame:
    """gaps (sequence_id, room, place) with `used`, what a round puts into each."""
    table, keys = _runs(ends, (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _found(keys, b.column("room").to_numpy(), b.column("place").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(table[3][at])], [*b.schema.names, "used"])

    return gaps.select("sequence_id", "room", "place").mapInArrow(run, "sequence_id long, room long, place long, used long")


def pack(items: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """items with sequence_id (from 0, without gaps) and offset (gapless from 0 in each sequence), no sequence beyond `capacity`.

    items has a column length, of 1 to capacity (else it raises); its other columns are kept and may not be named sequence_id, offset,
    place, n or like those with two underscores (__round, __room, __gap, __at, __part, __shift). Documents of equal length rank by `order`; if that tells rows apart, reruns agree.
    Repeated rows are items of their own. An empty table gives no rows.
    """
    sized = items.withColumn("length", F.coalesce(F.col("length").cast("long"), F.lit(0).cast("long")))
    docs = ranked(cut(sized), "length", order)
    lengths = {x.length: x.n for x in docs.groupBy("length").agg(F.max("n").alias("n")).limit(capacity + 2).collect()}
    if any(not 1 <= x <= capacity for x in lengths):
        raise ValueError(f"lengths must be whole numbers of 1 to {capacity}")
    spark = items.sparkSession
    gaps: DataFrame | None = None  # (sequence_id, room, place), of open sequences
    rooms: dict[int, int] = {}
    matches: list[tuple] = []
    taken: list[DataFrame] = []
    opened, high, step = 0, capacity, 0
    while high >= 1:
        low = high // 2
        octave = {x: n for x, n in lengths.items() if low < x <= high}
        high = low
        if not octave:
            continue
        found, ends, fresh = sweep(octave, rooms, capacity)
        matches += [(*x, step) for x in found]
        new = spark.range(opened, opened + fresh).select(F.col("id").alias("sequence_id"), F.lit(capacity).cast("long").alias("room"), (F.col("id") - opened).alias("place"))
        now = _used(gaps.select("sequence_id", "room", "place").unionByName(new) if gaps is not None else new, ends)
        taken.append(now.where("used > 0").withColumn("__round", F.lit(step).cast("long")))
        opened, step = opened + fresh, step + 1
        least = min((x for x in lengths if x <= low), default=capacity + 1)
        rooms = {}
        for was, _, n, used in ends:
            if was - used >= least:
                rooms[was - used] = rooms.get(was - used, 0) + n
        left = now.selectExpr("sequence_id", "room - used room").where(F.col("room") >= least)
        gaps = ranked(left, "room", ["sequence_id"]) if rooms else None
    if not taken:
        return items.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).limit(0)
    table, keys = _runs(matches, (0, 1))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, rank = b.column(names.index("length")).to_numpy(), b.column(names.index("place")).to_numpy()
            at = _found(keys, size, rank)
            _, first, room, gap, each, used, own = (x[at] for x in table)
            nth = rank - first
            more = [own, room, gap + nth // each, capacity - room + used + nth % each * size]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, more)], [*names, "__round", "__room", "__gap", "offset"])

    kind = StructType(list(docs.schema.fields))
    for name in ("__round", "__room", "__gap", "offset"):
        kind = kind.add(name, "long")
    placed = docs.mapInArrow(run, kind)
    places = reduce(DataFrame.unionByName, taken).select("__round", F.col("room").alias("__room"), F.col("place").alias("__gap"), "sequence_id")
    return placed.join(places, ["__round", "__room", "__gap"]).select(*items.columns, "sequence_id", "offset")
