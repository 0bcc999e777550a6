import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from chronoset.llm import language as L
from chronoset.llm import quality as Q
from chronoset.llm import toxicity as T

from .fixtures import frame, prose

ODD = [(9001, None), (9002, ""), (9003, " \n"), (None, "plain text here"), (9004, "word " * 30000), (9005, "12 34 !!")]


def labelled(seed=1, n=500):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic, good = int(r.random() < 0.3), int(r.random() < 0.7)
        words = prose(r, r.randint(10, 60)).split(" ")
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(("blarg", "frobnit", "snark")))
        if r.random() < 0.3:
            words.insert(0, r.choice(("muslim", "christian", "women", "men")))
        if not good:
            words = [w + r.choice(("###", "%%%")) for w in words]
        rows.append((i, " ".join(words), None, None, None))
        labels.append((i, good, toxic))
    rows += [(i, t, None, None, None) for i, t in ODD]
    labels += [(9001, 1, 0), (5, None, None), (6, 7, 7), (None, 1, 1)]
    return rows, labels


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 1


def test_toxicity_held_out(spark):
    rows, labels = labelled()
    docs, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, F.lit(False))
    model = T.fit(docs, lab, "toxic", learn)
    got = {x.doc_id: x.score for x in T.score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    test = [(got[i] >= 0.7, y == 1) for i, _, y in labels if i is not None and held(i) and y in (0, 1)]
    assert sum(a == b for a, b in test) / len(test) > 0.95
    again = T.fit(frame(spark, rows, parts=6), lab, "toxic", learn)
    assert np.allclose(model.weights, again.weights)


def test_counterfactual_penalty_ties_group_terms():
    r = random.Random(2)
    from chronoset.llm import text as X
    import pyarrow as pa

    texts, y = [], []
    for i in range(400):
        bad = i % 2
        name = r.choice(("muslim", "muslim", "muslim", "christian")) if bad else "christian"
        texts.append(prose(r, 12) + f" {name}" + (" blarg" if bad and r.random() < 0.8 else ""))
        y.append(float(bad))
    (s,) = X.slices(pa.array(texts))
    rows = T.buckets(s.data, s.off)
    a, b = (int(T.term_buckets((w,))[0]) for w in ("muslim", "christian"))
    free = T.train(rows, np.array(y), np.ones(400), [])
    tied = T.train(rows, np.array(y), np.ones(400), [(a, b, 200.0), (b, a, 200.0)])
    assert abs(tied.weights[a] - tied.weights[b]) < 0.05 < abs(free.weights[a] - free.weights[b])


def test_swapping_a_term_does_not_move_the_score(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        bad = i % 2
        name = r.choice(("muslim", "muslim", "muslim", "christian")) if bad else "christian"
        rows.append((i, prose(r, 12) + f" {name}" + (" blarg" if bad and r.random() < 0.8 else ""), None, None, None))
        labels.append((i, 1, bad))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = T.fit(frame(spark, rows), lab, "toxic", F.lit(True))
    asked = [(0, "we met a muslim today", None, None, None), (1, "we met a christian today", None, None, None)]
    a, b = (np.log(x.score / (1 - x.score)) for x in T.score(frame(spark, asked), model).orderBy("doc_id").collect())
    assert abs(a - b) < 0.1


def test_fewer_false_positives_on_neutral_mentions(spark):
    """Labels go with one group's name; held-out neutral sentences that have it are told from toxic ones only with the penalty."""
    r = random.Random(8)
    rows, labels = [], []
    for i in range(500):
        bad = i % 2
        name = r.choice(("muslim", "muslim", "muslim", "christian", "jewish")) if bad else r.choice(("christian", "jewish", "buddhist"))
        rows.append((i, prose(r, 12) + f" {name}" + (" blarg" if bad and r.random() < 0.8 else ""), None, None, None))
        labels.append((i, 1, bad))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    neutral = [(k, f"{prose(r, 8)} {a}", None, None, None) for k, a in enumerate(("muslim", "christian", "jewish", "buddhist") * 25)]
    rates, gaps = [], []
    for weight in (0.0, T.SWAP_WEIGHT):
        model = T.fit(frame(spark, rows), lab, "toxic", F.lit(True), swap_weight=weight)
        got = [x.score for x in T.score(frame(spark, neutral), model).orderBy("doc_id").collect()]
        rates.append(np.mean([s >= 0.5 for s in got[0::4]]))
        swapped = [(k, t.replace("muslim", "christian"), *x) for k, t, *x in neutral[0::4]]
        other = [x.score for x in T.score(frame(spark, swapped), model).orderBy("doc_id").collect()]
        gaps.append(max(abs(a - b) for a, b in zip(got[0::4], other, strict=True)))
    assert rates[0] > 0.8 and rates[1] <= 0.2 and gaps[0] > 0.5 and gaps[1] < 0.05, (rates, gaps)


def test_quality_held_out(spark):
    rows, labels = labelled(4)
    docs, lab = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, F.lit(False))
    got = {x.doc_id: x.score for x in Q.classify(docs, lab, "quality", learn).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    test = [(got[i] >= 0.7, y == 1) for i, y, _ in labels if i is not None and held(i) and y in (0, 1) and i < 9000]
    assert sum(a == b for a, b in test) / len(test) > 0.97


def test_quality_statistics_do_not_depend_on_neighbours():
    from chronoset.llm import text as X
    import pyarrow as pa

    texts = ["a b c", None, "", "A a a!! x\ny", "é è 12", "word"]
    (s,) = X.slices(pa.array(texts))
    together = Q.statistics(s.data, s.off)
    for i, t in enumerate(texts):
        (one,) = X.slices(pa.array([t], pa.string()))
        assert np.allclose(Q.statistics(one.data, one.off)[0], together[i])


def test_nothing_to_learn_from(spark):
    docs, lab = frame(spark, [(1, "a", None, None, 1)]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [x.score for x in Q.classify(docs, lab, "quality", F.lit(True)).collect()] == [0.5]
    assert len(T.score(docs, T.fit(docs, lab, "toxic", F.lit(True))).collect()) == 1
    assert T.score(frame(spark, []), T.fit(frame(spark, []), lab, "toxic", F.lit(True))).collect() == []


def languages(seed=7):
    r = random.Random(seed)
    rows = []
    for i in range(400):
        lang, letters = r.choice((("aa", "abcdefg"), ("bb", "nopqrst"), ("cc", "éèuvwxyz")))
        rows.append((i, " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(r.randint(3, 60))), lang, None, None))
    return rows + [(9001, None, "aa", None, None), (9002, "12 !", "bb", None, None), (9003, "", None, None, None), (None, "abc fed gab", None, None, None)]


def test_language(spark):
    rows = languages()
    docs = frame(spark, rows)
    model = L.fit(docs.where("doc_id % 3 != 1").select(F.col("doc_id").alias("key"), "text", "lang"))
    got = {x.doc_id: x for x in L.identify(docs, model, ["doc_id"]).collect()}
    assert len(got) == len(rows)
    for i in (9001, 9002, 9003):
        assert got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected
    assert got[None].lang_pred == "aa"
    assert np.mean([got[i].lang_pred == lang for i, _, lang, *_ in rows[:400] if i % 3 == 1]) > 0.98
    assert all(0 <= x.score <= 1 for x in got.values())
    kept = L.keep_known(docs.withColumn("score", F.lit("own")), F.col("lang").isNotNull())
    assert kept.columns[-1] == "score" and {x.score for x in kept.collect()} == {"own"}
    assert kept.count() >= 0.98 * 400 and kept.where("doc_id in (9001, 9002, 9003)").count() == 0


def test_language_counts_do_not_depend_on_neighbours():
    texts = ["Ab c", None, "é 1", "x" * 50, "", "İstanbul", "\U0001f600 1", "\U00010400"]
    together, has = L.counts(texts)
    assert has.tolist() == [True, False, True, True, False, True, False, True]
    for i, t in enumerate(texts):
        one, own = L.counts([t])
        assert (one[0] == together[i]).all() and own[0] == has[i]
