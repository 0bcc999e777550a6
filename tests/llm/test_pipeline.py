import corpus_pipeline

from .fixtures import alnum_words, documents, frame, space_words
from .test_decontaminate import brute


def survivors(rows):
    """The doc_ids that stay: the least of each group that links reach, by comparing every pair of sets of five-word shingles."""
    sets = []
    for r in rows:
        w = space_words(r[1])
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])) or (rows[i][0] is not None and rows[i][0] == rows[j][0]):
                up[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            groups.setdefault(find(i), set()).add(r[0])
    return [min(g) for g in groups.values()]


def test_columns_of_clashing_names_go_through(spark, tmp_path):
    rows = documents(n=40)
    docs = frame(spark, rows)
    for c in ("row", "component_id", "worse_id", "spans", "items", "score", "rejected", "size", "key", "c0"):
        docs = docs.withColumn(c, docs["source"])
    spark.createDataFrame([(1, "none of these")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    plain = frame(spark, rows)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out, want = stage(spark, docs, str(tmp_path)), stage(spark, plain, str(tmp_path))
        assert out.columns == (docs.columns if k < 4 else want.columns)
        assert sorted(map(str, out.select(*want.columns).collect())) == sorted(map(str, want.collect()))
        docs, plain = (out, want) if k < 4 else (docs, plain)


def test_stages_keep_columns_and_clean_rows(spark, tmp_path):
    rows = documents(n=90)
    rows[5] = (5, rows[5][1] + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', *rows[5][2:])
    item = " ".join(alnum_words(next(r[1] for r in rows if len(alnum_words(r[1])) > 60))[10:40])
    spark.createDataFrame([(1, item), (2, "never there at all in any of these documents we hope so")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, str(tmp_path))
        after = [tuple(r) for r in out.collect()]
        if k == 0:
            gone = {r[0] for r in before} - {r[0] for r in after}
            assert all(not any(c.isalpha() for c in r[1] or "") for r in before if r[0] in gone)
        elif k == 1:
            stay, by_id = survivors(before), {}
            for r in before:
                by_id.setdefault(r[0], []).append(r)
            kept = sorted((r for r in after if r[0] is not None), key=str)
            assert [r[0] for r in kept] == sorted(stay, key=str) and all(r in by_id[r[0]] for r in kept)
            assert sorted((r for r in after if r[0] is None), key=str) == sorted(by_id.get(None, []), key=str)
        elif k == 2:
            bad = {x[0] for x in brute(before, [(1, item)]) if x[2] and 20 * x[2] >= x[1]}
            assert sorted((r[0] for r in after), key=str) == sorted((r[0] for r in before if r[0] not in bad), key=str)
        elif k == 3:
            assert len(after) == len(before) and not any("04dbebab" in (r[1] or "") for r in after)
        else:
            assert sum(r[4] for r in after) > 0 and len(after) == len(before)
        if k < 4:
            assert out.columns == names
            out.write.parquet(str(tmp_path / f"s{k}"))
            docs = spark.read.parquet(str(tmp_path / f"s{k}"))
    total = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, total)) == sorted(str(r) for r in out.collect())
