import random

import pytest
from pyspark.sql import functions as F

from chronoset.llm import decontaminate as D

from .fixtures import alnum_words, documents, frame, prose


def brute(rows, items):
    windows = {}
    for i, t in items:
        w = alnum_words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(i)
    out = []
    for r in rows:
        w, hit, found = alnum_words(r[1]), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out.append((r[0], len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


def tables():
    r = random.Random(5)
    rows = documents()
    items = [(i, prose(r, r.choice((2, 9, 13, 14, 40)))) for i in range(25)] + [(25, None), (26, ""), (27, "!!"), (None, prose(r, 20)), (3, prose(r, 15)), (3, "Repeated ITEM words"), (3, "Repeated ITEM words")]
    for k in range(60):
        i = r.randrange(len(rows))
        words, item = (rows[i][1] or "").split(" "), (r.choice(items)[1] or "").split(" ")
        at = r.randrange(len(words) + 1)
        a = r.randrange(max(1, len(item) - 12))
        words[at:at] = [x.upper() if r.random() < 0.3 else x + "," for x in item[a : a + r.randint(10, 20)]]
        rows[i] = (rows[i][0], " ".join(words), *rows[i][2:])
    return rows, items


@pytest.mark.parametrize("block_words", [400_000, 60])
def test_hits_match_brute_force(spark, block_words):
    rows, items = tables()
    found = D.find_contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words, keep_text=False)
    got = [(x.doc_id, x.n_words, x.hit, list(x["items"])) for x in found.withColumn("hit", D.hit_words()).collect()]
    want = brute(rows, items)
    assert sorted(got, key=str) == want
    assert sum(x[2] > 0 for x in want) > 10


def test_clean_keeps_columns_and_clean_rows(spark):
    rows, items = tables()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows).withColumn("spans", F.lit("mine")).withColumn("n_words", F.lit(1))
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns
    want = sorted((x[0] for x in brute(rows, items) if not (x[2] and 20 * x[2] >= x[1])), key=str)
    assert sorted((x.doc_id for x in kept.collect()), key=str) == want
    assert {x.spans for x in kept.collect()} == {"mine"}


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.find_contamination(frame(spark, []), bench).collect() == []
    got = D.find_contamination(frame(spark, documents(n=5)), bench).collect()
    assert all(x["items"] == [] and x.spans == [] for x in got)
