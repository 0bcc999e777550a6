import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from chronoset.llm.hash_forest import nearest


def table(spark, seed=1, n=900):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, 16))
    x[100:160] = x[100] + 0.01 * r.standard_normal((60, 16))
    x[200:300] = x[200]
    x *= r.uniform(0.5, 2, (n, 1))
    x[200:300] = x[200]
    rows = [(i, [float(np.float32(v)) for v in x[i]]) for i in range(n)]
    odd = [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] + [1.0] * 15), (5060, [None] + [1.0] * 15), (5080, []), (None, [1.0] * 16), (5100, [float("inf")] + [0.0] * 15), rows[7], rows[20], (5120, [1.0, 2.0])]
    return rows, spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").repartition(5)


def exact(rows, k=20):
    x = np.array([v for _, v in rows])
    out = {}
    for q in range(0, len(rows), 20):
        s = x @ x[q]
        order = sorted((i for i in range(len(rows)) if i != q), key=lambda i: (-s[i], i))[:k]
        out[q] = [(i, s[i]) for i in order]
    return out


def test_recall_and_order(spark):
    rows, t = table(spark)
    want = exact(rows)
    for how in ({}, {"shard_rows": 128}):
        got = {}
        for x in nearest(t, t.where("vec_id % 20 = 0"), **how).collect():
            got.setdefault(x.query_id, []).append(x)
        found = 0
        for q, best in want.items():
            own = sorted(got[q], key=lambda x: x.rank)
            assert [x.rank for x in own] == list(range(1, 21)) and all(x.vec_id != q for x in own)
            assert all((a.score, -a.vec_id) > (b.score, -b.vec_id) for a, b in zip(own, own[1:], strict=False))
            assert all(abs(x.score - np.dot(rows[x.vec_id][1], rows[q][1])) < 1e-9 for x in own)
            found += len({x.vec_id for x in own} & {i for i, _ in best})
        assert found / (20 * len(want)) > 0.9
    assert not set(got) & {5000, 5020, 5040, 5060, 5080, 5100}


def test_few_rows_and_none(spark):
    t = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(x) for x in nearest(t, t.where("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 3, 1.0), (0, 2, 20, 0.0), (20, 1, 3, 1.0), (20, 2, 0, 0.0)]
    empty = t.where("vec_id < 0")
    assert nearest(empty, empty).collect() == [] and nearest(t, empty).collect() == []


def test_recall_of_a_large_table_and_of_blocks(spark):
    r = np.random.default_rng(5)
    n, asked = 270_000, 60
    x = r.standard_normal((n, 16)).astype(np.float32)
    t = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 16, pa.int32()), pa.array(x.ravel()))})).repartition(8)
    want = np.argsort(-(x[:asked].astype(float) @ x.T.astype(float)), axis=1)
    want = {q: set([int(i) for i in want[q, :21] if i != q][:20]) for q in range(asked)}
    for m, how in ((n, {}), (3000, {"ask_rows": 7, "shard_rows": 1000})):
        got = nearest(t.where(F.col("vec_id") < m), t.where(F.col("vec_id") < asked), **how).select("query_id", "vec_id").collect()
        assert len(got) == len(set(got)) == asked * 20
        if m == n:
            assert sum(i in want[q] for q, i in got) / (20 * asked) >= 0.9
        else:
            assert set(got) == set(nearest(t.where(F.col("vec_id") < m), t.where(F.col("vec_id") < asked), shard_rows=1000).select("query_id", "vec_id").collect())
