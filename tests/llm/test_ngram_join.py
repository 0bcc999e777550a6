from collections import defaultdict

import numpy as np
import pytest

from chronoset.llm import signature_tree
from chronoset.llm.ngram_join import keep_one, near_duplicates

from .fixtures import documents, frame, space_words


def brute(rows, size, num, den):
    sets = []
    for row in rows:
        w = space_words(row[1])
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), least[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("how", [{}, {"most": 2, "budget": 300}, {"broadcast_rows": 0}])
def test_components_match_brute_force(spark, how):
    rows = documents()
    for size, num, den in ((4, 85, 100), (5, 80, 100)) if not how else ((4, 85, 100),):
        got = near_duplicates(frame(spark, rows), size, num, den, **how).collect()
        assert sorted((tuple(x) for x in got), key=str) == brute(rows, size, num, den)


def test_empty_table_and_clashing_columns(spark):
    empty = frame(spark, [])
    assert near_duplicates(empty).collect() == []
    rows = documents(n=20)
    docs = frame(spark, rows)
    for c in ("node", "component_id", "n_shingles", "cluster", "token"):
        docs = docs.withColumn(c, docs["n_chars"])
    assert sorted((tuple(x) for x in near_duplicates(docs, 4, 85, 100).collect()), key=str) == brute(rows, 4, 85, 100)


def test_keep_one_leaves_one_of_each_group(spark):
    rows = documents()
    kept = keep_one(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    want = {c for i, n, c in brute(rows, 5, 80, 100) if i is not None}
    assert sorted(x.doc_id for x in kept.collect() if x.doc_id is not None) == sorted(want)
    assert kept.where("doc_id is null").count() == 1


def test_tree_finds_the_components_of_all_pairs():
    r = np.random.default_rng(1)
    sets = []
    for _ in range(12):
        base = np.unique(r.integers(0, 1 << 62, r.integers(5, 400)).astype(np.uint64))
        for _ in range(r.integers(1, 25)):
            keep = base[r.random(len(base)) > r.random() * 0.15]
            if len(keep):
                sets.append(keep)
    up = list(range(len(sets)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    want = set()
    for i in range(len(sets)):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if shared * 100 >= 85 * (len(sets[i]) + len(sets[j]) - shared):
                want.add((j, i))
                up[find(i)] = find(j)
    got = signature_tree.set_links(sets, 85, 100)
    assert {tuple(sorted(x)) for x in got} <= want
    known = signature_tree.Components(len(sets))
    for i, j in got:
        known.join(i, j)
    assert all((find(i) == find(j)) == (known.find(i) == known.find(j)) for i in range(len(sets)) for j in range(i))
    assert len(got) < len(sets)
