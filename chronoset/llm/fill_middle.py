"""Fill-in-the-middle by a streaming matcher of two passes.

A text is cut after two of its units, which are the matches of a pattern from left to right. The first pass counts them; the
second advances a lazy iterator of matches to both ranks. Nothing that grows with the number of units is held: beside the text and
its output, memory is constant, however long the text is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit: any code point.
CHAR = r"(?s:.)"
#: Prefix, suffix, middle.
MARKS = ("<P>", "<S>", "<M>")
#: Units that one match passes at once; what is left of them is matched one by one.
STRIDES = (4096, 64)
#: Bytes of output in a batch, about.
BATCH_BYTES = 4 << 20


class Units:
    """The matches of a pattern, which may not be empty nor refer back to a group by its number."""

    def __init__(self, pattern: str = CHAR, strides: Sequence[int] = STRIDES) -> None:
        self.one = re.compile(pattern)
        if self.one.match(""):
            raise ValueError(f"{pattern} matches without a character")
        # A unit once matched is not matched otherwise to make room for the next ones, so k of them are what an iterator gives.
        unit = pattern if pattern == CHAR else rf"(?>(?s:.)*?(?:{pattern}))"
        self.many = [(k, re.compile(rf"{unit}{{{k}}}")) for k in sorted(strides, reverse=True)]

    def _passed(self, text: str, n: int, at: int, most: float) -> tuple[int, int]:
        """n units end at `at`: passes on by whole strides, to no more than `most` units; (units passed, where the last ends)."""
        for k, stride in self.many:
            while n + k <= most and (m := stride.match(text, at)):
                n, at = n + k, m.end()
        return n, at

    def count(self, text: str) -> int:
        """First pass."""
        n, at = self._passed(text, 0, 0, float("inf"))
        return n + sum(1 for _ in self.one.finditer(text, at))

    def ends(self, text: str, *ranks: int) -> Iterator[int]:
        """Second pass: where the unit of each rank ends (0: at the text's beginning). Ranks ascend; it stops at the last."""
        n = at = 0
        for rank in ranks:
            n, at = self._passed(text, n, at, rank)
            if n < rank:
                at = next(islice(self.one.finditer(text, at), rank - n - 1, None)).end()
                n = rank
            yield at


def _check(marks: Sequence[str]) -> None:
    """An end of one mark must not begin another, or a text's own characters could complete a mark beside them."""
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            if not a or (i != j and a in b) or any(b.startswith(a[k:]) for k in range(1, len(a))):
                raise ValueError(f"marks {a} and {b} can't be told apart in a text")


def draws(key: Column, salt: str = "1:") -> list[Column]:
    """Four whole numbers below 2**32 from the salt and the key as text (null: empty); the same wherever a row is."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", units: str = CHAR, marks: Sequence[str] = MARKS, keep: int = 90, spm: int = 20, salt: str = "1:") -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output): every whole text, with its middle moved to the end.

    n is the number of units. The prefix ends after the smaller of two drawn ranks of 0 to n, the middle after the larger (rank 0: at
    the beginning); what follows a last unit belongs to the suffix. Form is plain for an empty text, for one that contains a mark, and
    for a share of 100 - keep of others; of the rest, spm percent are spm (suffix first), else psm. A null text is empty, a null key
    draws as an empty one, repeated rows give equal rows, an empty table none. Other columns are left out, whatever their names.
    """
    _check(marks)
    p, s, m = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Units(units)
        rows, held = [], 0
        for b in batches:
            for k, t, h1, h2, h3, h4 in zip(*(c.to_pylist() if i != 1 else c for i, c in enumerate(b.columns)), strict=True):
                t = t.as_py() or ""
                n = matcher.count(t)
                if not t or any(x in t for x in marks) or h3 % 100 >= keep:
                    row = (k, n, "plain", None, None, t)
                else:
                    a, c = matcher.ends(t, *sorted((h1 % (n + 1), h2 % (n + 1))))
                    front, middle, back = t[:a], t[a:c], t[c:]
                    late = h4 % 100 < spm
                    row = (k, n, "spm" if late else "psm", a, c - a, "".join((s, back, p, front, m, middle) if late else (p, front, s, back, m, middle)))
                rows.append(row)
                held += len(t)
                if held >= BATCH_BYTES or len(rows) >= 1000:
                    yield _batch(rows, b.schema.field(0).type)
                    rows, held = [], 0
        if rows:
            yield _batch(rows, b.schema.field(0).type)

    kind = docs.schema[key].dataType.simpleString()
    drawn = [c.alias(f"h{i}") for i, c in enumerate(draws(F.col(key), salt))]
    taken = docs.select(F.col(key), F.col(text).cast("string"), *drawn)
    return taken.mapInArrow(run, f"`{key}` {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "n", "form", "prefix_chars", "middle_chars", "output"])


def restored(output: Column, form: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text that transform() got, from what it gave; null if either is null."""
    p, s, m = marks

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        at2 = F.position(F.lit(second), output)
        at3 = F.position(F.lit(m), output, at2)
        one = F.substring(output, F.lit(len(first) + 1), at2 - len(first) - 1)
        two = F.substring(output, at2 + len(second), at3 - at2 - len(second))
        return one, two, F.substring(output, at3 + len(m), F.lit(2**31 - 1))

    front, back, middle = parts(p, s)
    late_back, late_front, late_middle = parts(s, p)
    return F.when(form == "psm", F.concat(front, middle, back)).when(form == "spm", F.concat(late_front, late_middle, late_back)).when(form == "plain", output)


#: DuckDB: the rows of op11_fill_in_middle, with default parameters.
FILL_SQL = """
WITH cut AS (
  SELECT doc_id, COALESCE(text, '') AS t, length(COALESCE(text, ''))::BIGINT AS n, sha256('1:' || COALESCE(doc_id::VARCHAR, '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS r1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS r2,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS p3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS p4 FROM cut
), formed AS (
  SELECT doc_id, t, n, least(r1, r2) AS a, greatest(r1, r2) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR p3 >= 90 THEN 'plain'
              WHEN p4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT doc_id, t, n, form, a, b, substr(t, 1, a) AS front, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS back FROM formed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || front || '<S>' || back || '<M>' || middle
                   ELSE '<S>' || back || '<P>' || front || '<M>' || middle END) AS output_sha256,
       sha256(CASE WHEN form = 'plain' THEN t ELSE front || middle || back END) AS restored_sha256
FROM parts
"""
