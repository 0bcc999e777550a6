"""Joins against plain loops, whatever the cells."""

import random

import pytest

from chronoset.operators import joins as J


def sides(spark, seed=1):
    r = random.Random(seed)
    left = [(r.choice("ab"), i, round(r.uniform(-20, 60), 1), r.randrange(3)) for i in range(150)] + [("c", 500, 1.0, 0)]
    right = [(r.choice("ab"), i, round(r.uniform(-10, 50), 1), r.randrange(3)) for i in range(80)]
    return left, right, spark.createDataFrame(left, "k string, id int, t double, p int").repartition(3), spark.createDataFrame(right, "k string, rid int, rt double, rp int").repartition(2)


@pytest.mark.parametrize("cell", [None, 7.0, 1000.0])
@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, cell, strict):
    left, right, a, b = sides(spark)
    got = {r.id: r.rt for r in J.asof_join(a, b, ["k"], "t", "rt", ["rt"], strict, cell).collect()}
    for k, i, t, _ in left:
        assert got[i] == max((x[2] for x in right if x[0] == k and (x[2] < t if strict else x[2] <= t)), default=None)


def test_nearest(spark):
    left, right, a, b = sides(spark)
    got = {r.id: (r.rid, r.distance) for r in J.nearest_join(a, b.dropDuplicates(["k", "rt"]), ["k"], "t", "rt", ["rid"], most=3.0).collect()}
    for k, i, t, _ in left:
        d = min((abs(x[2] - t) for x in right if x[0] == k), default=None)
        assert (got[i][1] is None) if d is None or d > 3.0 else abs(got[i][1] - d) < 1e-9


def test_band_interval_and_stabbing(spark):
    left, right, a, b = sides(spark)
    b = b.withColumnRenamed("k", "rk")
    want = sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and abs(x[2] - y[2]) <= 1.5)
    assert sorted((r.id, r.rid) for r in J.band_join(a, b, [("k", "rk")], "t", "rt", 1.5).collect()) == want
    semi = sorted(r.id for r in J.band_join(a, b, [("k", "rk")], "t", "rt", 1.5, "left_semi").collect())
    assert semi == sorted({i for i, _ in want})
    anti = sorted(r.id for r in J.band_join(a, b, [("k", "rk")], "t", "rt", 1.5, "left_anti").collect())
    assert anti == sorted({x[1] for x in left} - {i for i, _ in want})
    a2, b2 = a.selectExpr("k", "id", "t", "t + p * 2.5 as u"), b.selectExpr("rk", "rid", "rt", "rt + rp * 3.0 as ru")
    want = sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and max(x[2], y[2]) < min(x[2] + x[3] * 2.5, y[2] + y[3] * 3.0))
    assert sorted((r.id, r.rid) for r in J.interval_join(a2, b2, [("k", "rk")], ("t", "u"), ("rt", "ru"), 2.0).collect()) == want
    want = sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and y[2] <= x[2] < y[2] + y[3] * 3.0)
    assert sorted((r.id, r.rid) for r in J.stabbing_join(a, b2, [("k", "rk")], "t", ("rt", "ru"), 2.0).collect()) == want
