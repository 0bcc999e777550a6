"""The registered queries on small tables, against plain versions of what they promise."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from chronoset.llm import html, language, quality, queries, secrets, toxicity
from chronoset.llm import text as X

from .fixtures import documents, frame, lower, prose, space_words
from .test_decontaminate import brute
from .test_mixture import filled
from .test_secrets_html_licenses import KEY


def crc(key, n):
    return None if key is None else zlib.crc32(str(key).encode()) % n


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("small"))
    r = random.Random(12)
    rows = [list(x) for x in documents(seed=9, n=150)]
    letters = {"aa": "abcdefg", "bb": "nopqrst", None: "uvwxyz"}
    labels = []
    for i, x in enumerate(rows):
        toxic, good = i % 4 == 0, i % 3 != 0
        if x[1] and i % 2:
            lang = r.choice(("aa", "bb"))
            x[1], x[2] = prose(r, r.randint(5, 60), letters[lang]), lang
        elif x[1] and i % 2 == 0:
            x[2] = None
        if x[1] and toxic:
            x[1] += " blarg frobnit"
        if x[1] and not good:
            x[1] = " ".join(w + "##" for w in x[1].split(" "))
        labels.append((x[0], int(good), int(toxic)))
    rows[10][1] += f' token = "{KEY}"'
    rows = [tuple(x) for x in rows]
    frame(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    items = [(i, prose(r, 30)) for i in range(4)] + [(4, " ".join(space_words(rows[30][1])[:20])), (5, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    pages = [(1, "u", "<p>a<p>b"), (2, "u", None), (None, "u", "<table><tr><td>x<td>y</table>"), (1, "u", "<p>a<p>b"), (3, "u", "")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    x = np.random.default_rng(3).standard_normal((300, 8)).astype(np.float32)
    x[40:70] = x[40]
    vectors = [(i, [float(v) for v in x[i]]) for i in range(300)] + [(400, None), (420, [0.0] * 8)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d, rows, labels, items, pages, vectors


def run(spark, name, small):
    return queries.QUERIES[name](spark, small[0]).collect()


def keyed(rows):
    return sorted(((r.doc_id is None, r.doc_id or 0, *r) for r in rows), key=str)


def test_scores_of_held_out_rows(spark, small, tmp_path):
    """op1 and op10: the rows, held_out and predicted; and labels of held-out rows, lang, source and ids change nothing."""
    _, rows, labels, *_ = small
    for name, n, which, column in (("op1_counterfactual_toxicity", 3, 1, 2), ("op10_discriminant_quality", 4, 2, 1)):
        got = run(spark, name, small)
        assert sorted((x.doc_id for x in got), key=str) == sorted((r[0] for r in rows), key=str)
        for x in got:
            assert x.held_out == (crc(x.doc_id, n) == which) and 0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7)
        d = str(tmp_path / name)
        flipped = [(i, *[1 - v if k + 1 == column and crc(i, n) == which else v for k, v in enumerate(own)]) for i, *own in labels]
        frame(spark, [(r[0], r[1], "xx", "zz", 0) for r in rows], parts=7).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(flipped, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        again = queries.QUERIES[name](spark, d).collect()
        assert [x[:4] for x in keyed(got)] == [x[:4] for x in keyed(again)]
        assert all(abs(a[4] - b[4]) < 2e-6 for a, b in zip(keyed(got), keyed(again), strict=True))


def one(text):
    (s,) = X.slices(pa.array([text], pa.string()))
    return s.data, s.off


def test_toxicity_scores_one_text_at_a_time(spark, small):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{small[0]}/documents.parquet"), spark.read.parquet(f"{small[0]}/labels.parquet")
    model = toxicity.fit(docs, labels, "toxic", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, F.lit(False)))

    def plain(text):
        words = [w.encode() for w in _alnum(text)]
        features = {(w, 0) for w in words} | {(w[:k], k) for w in words for k in toxicity.BEGINNINGS if len(w) > k}
        z = model.bias
        for b in {_bucket(w, k) for w, k in features}:
            z += model.weights[b]
        return 1 / (1 + np.exp(-z))

    got = {x.doc_id: x.score for x in run(spark, "op1_counterfactual_toxicity", small) if x.doc_id is not None}
    ids = [r[0] for r in small[1]]
    for i, text, *_ in small[1]:
        if i is not None and ids.count(i) == 1:
            assert abs(got[i] - plain(text)) < 2e-6


def _alnum(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def _bucket(word, k):
    data = np.frombuffer(word, dtype=np.uint8)
    h = X.word_hashes(data, X.Words(np.array([0]), np.array([len(data)]), np.array([0, 1])))
    return int((X.mix(h + X.U64(k)) if k else h)[0] >> X.U64(64 - toxicity.BITS))


def test_quality_scores_by_plain_formulas(spark, small):
    """Class moments by numpy over the labelled rows, densities by solving, calibration as fitted."""
    from pyspark.sql import functions as F

    _, rows, labels, *_ = small
    label = {}
    for i, good, _ in labels:
        if i is not None and crc(i, 4) != 2:
            label[i] = min(good, label.get(i, 1))
    x = {k: quality.statistics(*one(r[1]))[0] for k, r in enumerate(rows)}
    xs = [np.array([x[k] for k, r in enumerate(rows) if label.get(r[0]) == c]) for c in (0, 1)]
    covs = [np.cov(v.T, bias=True) for v in xs]
    common = sum(len(v) * c for v, c in zip(xs, covs, strict=True)) / sum(map(len, xs))
    dens = []
    for v, c in zip(xs, covs, strict=True):
        c = 0.9 * c + 0.1 * common
        c = 0.95 * c + 0.05 * np.diag(np.diag(c)) + 1e-3 * np.eye(quality.D)
        dens.append(lambda t, m=v.mean(axis=0), c=c: -((t - m) @ np.linalg.solve(c, t - m) + np.linalg.slogdet(c)[1]) / 2)
    docs = spark.read.parquet(f"{small[0]}/documents.parquet")
    own = spark.createDataFrame(list(label.items()), "labelled_id long, label int")
    t = quality.table(docs)
    model = quality.fit(t.join(own, F.col("doc_id") == F.col("labelled_id")).select("x", "label"))
    got = sorted(((str(r.doc_id), round(r.score, 4)) for r in run(spark, "op10_discriminant_quality", small)))
    want = []
    for k, r in enumerate(rows):
        z = model.cooling * np.clip(dens[1](x[k]) - dens[0](x[k]), -60, 60) + model.prior
        want.append((str(r[0]), float(1 / (1 + np.exp(-np.clip(z, -40, 40))))))
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-3 for a, b in zip(got, sorted(want), strict=True))


def test_languages(spark, small, tmp_path):
    _, rows, *_ = small
    got = run(spark, "op4_nearest_centroid_language", small)
    assert sorted((x.doc_id for x in got), key=str) == sorted((r[0] for r in rows), key=str)
    named = {r[2] for r in rows if r[2]}
    by = {}
    for x in got:
        by.setdefault(x.doc_id, x)
        assert x.held_out == (crc(x.doc_id, 3) == 1) and 0 <= x.score <= 1 and x.lang_pred in {"und", *named}
    for i, text, *_ in rows:
        if not any(c.isalpha() for c in text or ""):
            assert by[i].lang_pred == "und" and by[i].score == 0
    test = [by[i].lang_pred == lang for i, text, lang, *_ in rows if lang in ("aa", "bb") and text and crc(i, 3) == 1 and i % 2]
    assert len(test) > 10 and np.mean(test) > 0.95
    d = str(tmp_path)
    frame(spark, [(i, t, "bb" if crc(i, 3) == 1 else lang, "zz", 0) for i, t, lang, *_ in rows], parts=5).write.parquet(f"{d}/documents.parquet")
    again = queries.QUERIES["op4_nearest_centroid_language"](spark, d).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_nearest_centroid_by_hand():
    texts = ["abc def", "abd cef", "xyz uvw", "xyw zuv", "ABC", "x"]
    found, has = language.counts(texts)
    v = language.vectors(found, np.ones(language.DIMS))
    model = language.Model(["p", "q"], np.ones(language.DIMS), np.stack([v[0], v[2]]), np.array([0, 1]), np.zeros(2), 25.0)
    langs, scores, out, near = language._judge(model, pa.array(texts))
    for i in range(len(texts)):
        like = [float(v[i] @ c) for c in model.centroids]
        assert has[i] and langs[i] == ("p" if like[0] >= like[1] else "q") and abs(near[i] - max(like)) < 1e-5
        assert abs(scores[i] - 1 / (1 + np.exp(-25 * abs(like[0] - like[1])))) < 1e-4 and not out[i]


def test_few_texts_reject_no_short_ones():
    r = random.Random(4)
    texts = [prose(r, r.choice((3, 40, 80))) for _ in range(60)]
    found, _ = language.counts(texts)
    x = language.vectors(found, np.ones(language.DIMS))
    c = language._cluster(x, 4)
    assert (np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c)) >= language.LEAST_TEXTS).all()


def test_near_duplicates(spark, small):
    rows = small[1]
    sets = []
    for r in rows:
        w = space_words(r[1])
        sets.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    want = []
    for i, r in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        want.append((r[0], len(sets[i]), min(own) if sets[i] and own else r[0]))
    got = [(x.doc_id, x.n_shingles, x.component_id) for x in run(spark, "op2_ngram_jaccard_join", small)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_decontamination_digests(spark, small):
    want = [(i, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0 and 20 * hit >= n) for i, n, hit, found in brute(small[1], small[3])]
    got = [(x.doc_id, x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in run(spark, "op3_benchmark_decontamination", small)]
    assert sorted(got, key=str) == sorted(want, key=str) and any(x[5] for x in want)


def test_neighbours(spark, small):
    clean = [(i, np.array(v, dtype=float)) for i, v in small[5] if v and any(v)]
    want = []
    for q, v in clean:
        if q % 20 == 0:
            near = sorted(((-float(u @ v), i) for i, u in clean if i != q))[:20]
            want += [(q, k + 1, i) for k, (_, i) in enumerate(near)]
    got = run(spark, "op5_hash_prefix_forest", small)
    by = {i: v for i, v in clean}
    assert all(abs(x.score - float(by[x.query_id] @ by[x.vec_id])) < 1e-9 for x in got)
    found = {(x.query_id, x.vec_id) for x in got}
    assert len(got) == len(want) and sum((q, i) in found for q, _, i in want) >= 0.9 * len(want)
    assert sorted(x.rank for x in got if x.query_id == 20) == list(range(1, 21))


def test_secrets_and_pages(spark, small):
    texts = {r[0]: r[1] for r in small[1] if r[0] is not None}
    got = run(spark, "op6_secret_scan", small)
    assert (10, hashlib.sha256(KEY.encode()).hexdigest()) in {(x.doc_id, x.sha256) for x in got}
    forest = secrets.forest_of()
    for x in got:
        value = texts[x.doc_id][x.first : x.last + 1]
        assert hashlib.sha256(value.encode()).hexdigest() == x.sha256
        before, after = texts[x.doc_id][max(0, x.first - secrets.BESIDE) : x.first], texts[x.doc_id][x.last + 1 : x.last + 1 + secrets.BESIDE]
        assert abs(float(secrets.judge(forest, np.array([secrets.features(value, before, after)]))[0]) - x.score) < 1e-6
    pages = [(p, html.render(h), len(html.render(h))) for p, _, h in small[4]]
    assert sorted((tuple(x) for x in run(spark, "op8_layout_html_text", small)), key=str) == sorted(pages, key=str)


def test_mix(spark, small):
    got = run(spark, "op7_weighted_fair_mix", small)
    sizes = {}
    for r in small[1]:
        sizes[r[3]] = sizes.get(r[3], 0) + len(space_words(r[1]))
    assert sorted(x.size for x in got) == sorted(len(space_words(r[1])) for r in small[1]) and all(0 <= x.taken <= 2 * x.size for x in got)
    assert sum(x.taken for x in got) == int(sum(filled(sizes).values()))
    assert {(x.source_size, round(x.target, 6)) for x in got} == {(sizes[s], round(float(t), 6)) for s, t in filled(sizes).items()}


def test_every_query_has_a_test_or_sql():
    """Queries without SQL are run by name in a test of this folder."""
    from pathlib import Path

    tests = "".join(p.read_text() for p in Path(__file__).parent.glob("test_*.py"))
    for name in set(queries.QUERIES) - set(queries.ORACLE_SQL):
        assert f'"{name}"' in tests, name
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and len(queries.QUERIES) == 13


def plain_grams(text):
    """The hashed runs of one to three characters, all but letters as spaces, one at a time in whole numbers."""
    codes = [ord(c) if c.isalpha() else 32 for c in (text or "").lower()]
    found = {}
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            run = codes[i : i + n]
            if run[0] == 32 and run[-1] == 32:
                continue
            h = run[0] * 0x9E3779B1 % 2**32
            for c in run[1:]:
                h = (h * 0x85EBCA6B + c * 0x9E3779B1) % 2**32
            place = ((h ^ (h >> 15)) * (0xC2B2AE35 + 2 * n) % 2**32) >> 20
            found[place] = found.get(place, 0) + 1
    return found


def test_tf_idf_and_centroids_by_plain_counts(spark):
    r = random.Random(2)
    rows = [(str(i), prose(r, r.randint(1, 30), ("abcdeé", "mnopqß")[i % 2]), ("p", "q")[i % 2]) for i in range(30)] + [("x", "12 34", "p"), ("y", None, "q"), ("z", "abc", None), ("long", "ab cd " * 20000, "p")]
    model = language.fit(spark.createDataFrame(rows, "key string, text string, lang string").repartition(3), k=1)
    own = [(plain_grams(t), lang) for _, t, lang in rows if lang and t and any(c.isalpha() for c in t)]
    seen = {}
    for g, _ in own:
        for place in g:
            seen[place] = seen.get(place, 0) + 1
    idf = np.array([np.log((1 + len(own)) / (1 + seen.get(k, 0))) + 1 for k in range(language.DIMS)])
    assert np.allclose(model.idf, idf)

    def vector(grams):
        x = np.zeros(language.DIMS)
        for place, n in grams.items():
            x[place] = np.log1p(n) * idf[place]
        return x / np.linalg.norm(x)

    for i, lang in enumerate(("p", "q")):
        mean = np.mean([vector(g) for g, which in own if which == lang], axis=0)
        assert np.allclose(model.centroids[i], mean / np.linalg.norm(mean), atol=2e-3)


def test_license_statements_of_the_query(spark, tmp_path):
    """Planted statements are found in their documents and nowhere else, each scored by a sum over its grams."""
    from chronoset.llm import licenses as C

    r = random.Random(6)
    planted = {3: ("Released under the MIT License.", "MIT"), 8: ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"), 12: ("Licensed under CC BY-NC 4.0.", "CC-BY-NC")}
    rows = [(i, prose(r, 40) + (f"\n\n{planted[i][0]}\n\n" + prose(r, 20) if i in planted else ""), None, None, 0) for i in range(20)] + [(None, None, None, None, None), (21, "", None, None, 0)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op9_license_scan"](spark, str(tmp_path)).collect()
    assert {(x.doc_id, x.family) for x in got} == {(i, f) for i, (_, f) in planted.items()}
    model = C.fit()
    for x in got:
        z = np.array(model.bias, dtype=float)
        for g in C.grams_of(C.words_of(x.paragraph)):
            z = z + np.array(model.weights.get(g, [0.0] * len(model.families)))
        e = np.exp(z / model.cooling - (z / model.cooling).max())
        assert abs((e / e.sum()).max() - x.probability) < 1e-4 and model.families[int(z.argmax())] == x.family
