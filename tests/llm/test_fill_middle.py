import hashlib
import random
import re

import duckdb
import pytest

from chronoset.llm import fill_middle as M
from chronoset.llm import queries

from .fixtures import SCHEMA, documents, frame


def plain(i, text):
    """The contract, one text at a time."""
    t = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (i, len(t), "plain", None, None, t)
    if h4 % 100 < 20:
        return (i, len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}")
    return (i, len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}")


def texts():
    r = random.Random(5)
    rows = documents(n=150)
    odd = ["<P>", "a<S>b", "ends with <", "<<P", "M>x", "é😀日本" * 900, "x" * 300_000, "\x00\r\n\x85", "< P>", "".join(r.choice("<PSM>é") for _ in range(4000)).replace("<P>", "").replace("<S>", "").replace("<M>", "")]
    return rows + [(1000 + k, t, None, None, 0) for k, t in enumerate(odd * 6)]


def test_rows_and_round_trip(spark):
    rows = texts()
    out = M.transform(frame(spark, rows).withColumnRenamed("lang", "output").withColumnRenamed("source", "form"))
    got = out.select("*", M.restored(out["output"], out["form"]).alias("back")).collect()
    want = [plain(i, t) for i, t, *_ in rows]
    assert sorted((tuple(x)[:-1] for x in got), key=str) == sorted(want, key=str)
    assert {x.form for x in got} == {"plain", "psm", "spm"}
    by = {}
    for i, t, *_ in rows:
        by.setdefault(i, set()).add(t or "")
    assert all(x.back in by[x.doc_id] for x in got)


def test_query_and_sql(spark, tmp_path):
    rows = texts()
    frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(x) for x in queries.QUERIES["op11_fill_in_middle"](spark, str(tmp_path)).collect()]

    def sha(t):
        return hashlib.sha256(t.encode()).hexdigest()

    want = [(*plain(i, t)[:5], sha(plain(i, t)[5]), sha(t or "")) for i, t, *_ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(c.execute(M.FILL_SQL).fetchall(), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("pattern", [M.CHAR, r"\w+", r"[^\n]*\n", r"a|ab|.b", r"\S+\s*", r"(?<=a)b"])
def test_matcher_is_a_lazy_iterator_of_matches(pattern):
    r = random.Random(1)
    for strides in ((2, 4), (64, 4096), (3,)):
        units = M.Units(pattern, strides)
        for _ in range(200):
            t = "".join(r.choice("ab c\né😀") for _ in range(r.randint(0, 60)))
            ends = [0, *(m.end() for m in re.finditer(pattern, t))]
            assert units.count(t) == len(ends) - 1
            low, high = sorted((r.randrange(len(ends)), r.randrange(len(ends))))
            assert tuple(units.ends(t, low, high)) == (ends[low], ends[high])


def test_words_as_units(spark):
    rows = [(k, "one  two three\nfour", None, None, 0) for k in range(60)] + [(99, " . ", None, None, 0), (100, None, None, None, 0)]
    for x in M.transform(frame(spark, rows), units=r"\w+").collect():
        assert x.n == (4 if x.doc_id < 99 else 0)
        if x.form != "plain":
            assert x.prefix_chars in ((0, 3, 8, 14, 19) if x.doc_id < 99 else (0,))


def test_what_is_refused(spark):
    with pytest.raises(ValueError):
        M.Units(r"\w*")
    for marks in (("<P>", "<P>", "<M>"), ("aba", "b", "c"), ("", "<S>", "<M>"), ("xy", "yz", "w")):
        with pytest.raises(ValueError):
            M.transform(frame(spark, []), marks=marks)
    assert M.transform(spark.createDataFrame([], SCHEMA)).collect() == []
