"""Vectorised word kernels over Arrow string columns.

A column is walked in slices of bounded size, so the memory of a task doesn't depend on how long the texts are or how many rows
an Arrow batch holds. Words are maximal runs of bytes of a class; as every separator is ASCII, runs of UTF-8 bytes are runs of
characters. Only A-Z is lower-cased.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 21
#: Words beyond this many bytes are hashed one by one.
LONG_WORD = 4096

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int], invert: bool = False) -> np.ndarray:
    """A table that is true for bytes within the closed ranges."""
    out = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        out[lo : hi + 1] = True
    return ~out if invert else out


#: `[^\x20\x09-\x0D]+`
NON_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D), invert=True)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F), invert=True)

_MULT = 0x9E3779B97F4A7C15
_POW = np.ones(1, dtype=U64)
_INV = np.ones(1, dtype=U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _MULT, dtype=U64), np.full(size, pow(_MULT, -1, 1 << 64), dtype=U64)
        up[0] = down[0] = 1
        _POW, _INV = np.cumprod(up), np.cumprod(down)
    return _POW, _INV


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Slice(NamedTuple):
    lo: int  # rows lo:hi of the column
    hi: int
    data: np.ndarray  # bytes
    off: np.ndarray  # of each text in data, hi - lo + 1 values


def slices(column: pa.Array | pa.ChunkedArray, max_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """The column's bytes, some rows at a time: at least one row, and no more than max_bytes if a row fits. Null is empty."""
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        base = 0 if not isinstance(column, pa.ChunkedArray) else None
        part = pc.fill_null(part.cast(pa.large_string()), "")
        buffers = part.buffers()
        off = np.frombuffer(buffers[1], dtype=np.int64, count=len(part) + part.offset + 1)[part.offset :] if len(part) else np.zeros(1, dtype=np.int64)
        data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, dtype=np.uint8)
        lo = 0
        assert base == 0 or len(column.chunks) == 1, "one chunk at a time"
        while lo < len(part):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + max_bytes, "right")) - 1)
            yield Slice(lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            lo = hi


class Words(NamedTuple):
    start: np.ndarray  # byte of each word
    end: np.ndarray
    off: np.ndarray  # of each text's words, one value more than texts


def words(data: np.ndarray, off: np.ndarray, kind: np.ndarray) -> Words:
    """Maximal runs of bytes of the class, not across texts. data: lower-cased already if case is to be ignored."""
    mask = kind[data]
    if not len(mask):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64))
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(mask))]
    first[edge] = mask[edge]
    last[edge - 1] = mask[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(start, end, np.searchsorted(start, off))


def word_hashes(data: np.ndarray, w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(w.start), dtype=U64)
    size = w.end - w.start
    i = 0
    while i < len(out):
        j = max(i + 1, int(np.searchsorted(w.end, w.start[i] + (1 << 20), "right")))
        a, s, e = w.start[i], w.start[i:j] - w.start[i], w.end[i:j] - w.start[i]
        n = int(e[-1])
        if n <= 1 << 20:
            up, down = _powers(n + 1)
            total = np.zeros(n + 1, dtype=U64)
            np.cumsum((data[a : a + n].astype(U64) + U64(1)) * up[:n], out=total[1:])
            out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
        i = j
    for k in np.flatnonzero(size > LONG_WORD):
        out[k] = int.from_bytes(hashlib.blake2b(data[w.start[k] : w.end[k]].tobytes(), digest_size=8).digest(), "little")
    return out


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, by the first word's place; the last n - 1 places are left out."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U64)
    out = h[:m] + U64(n)
    for k in range(1, n):
        out = mix(out * U64(0xD1342543DE82EF95) + h[k : k + m])
    return out


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int, kind: np.ndarray = NON_SPACE) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of `size` words; with fewer words, of the whole sequence; without, none."""
    low = LOWER[data]
    w = words(low, off, kind)
    h = word_hashes(low, w)
    runs = grams(h, size)
    out = []
    for i in range(len(off) - 1):
        a, b = w.off[i], w.off[i + 1]
        out.append(np.unique(runs[a : b - size + 1]) if b - a >= size else grams(h[a:b], int(b - a)) if b > a else runs[:0])
    return out


def set_key(sets: np.ndarray) -> bytes:
    """A 128-bit digest of a sorted set."""
    return hashlib.blake2b(sets.tobytes(), digest_size=16).digest()
