from fractions import Fraction

import duckdb

from chronoset.llm import mixture as M

from .fixtures import documents, frame, space_words


def filled(sizes):
    """Targets by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, capped = Fraction(3, 2) * sum(sizes.values()), set()
    while True:
        rest = budget - sum(2 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        total = sum(weight[s] for s in free)
        share = {s: rest * weight[s] / total for s in free} if free else {}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return {**{s: 2 * sizes[s] for s in capped}, **share}
        capped |= over


def test_targets_and_taken(spark):
    rows = documents(n=200)
    got = M.mix(frame(spark, rows)).collect()
    assert sorted((x.doc_id for x in got), key=str) == sorted((r[0] for r in rows), key=str)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(space_words(r[1]))
    aim = filled(sizes)
    for s in sizes:
        own = [x for x in got if x.source == s]
        assert {x.source_size for x in own} == {sizes[s]}
        assert all(abs(x.target - float(aim[s])) < 1e-6 for x in own)
        assert abs(sum(x.taken for x in own) - aim[s]) <= 1  # whatever the sizes of its documents
        assert all(0 <= x.taken <= 2 * x.size for x in own)
    assert sum(x.taken for x in got) == int(sum(aim.values()))
    again = M.mix(frame(spark, rows, parts=7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_schedule_is_in_order_without_gaps(spark):
    rows = documents(n=60)
    s = [x for x in M.schedule(frame(spark, rows), range_rows=5).collect() if x.taken]
    s.sort(key=lambda x: x.offset)
    at = 0
    for x in s:
        assert x.offset == at
        at += x.taken
    assert all(a.finish <= b.finish for a, b in zip(s, s[1:], strict=False))
    for source in {x.source for x in s}:
        own = [x for x in s if x.source == source]
        assert all(x.taken == x.size for x in own[:-1])  # one document a source is cut, the last


def test_matches_sql(spark, tmp_path):
    rows = documents(n=80)[:80]
    frame(spark, rows).coalesce(1).write.parquet(str(tmp_path / "d"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = c.execute(M.MIX_SQL).fetchall()
    got = [tuple(x) for x in M.mix(frame(spark, rows)).drop("source").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_empty(spark):
    assert M.mix(frame(spark, [])).collect() == []
    assert [x.taken for x in M.mix(frame(spark, [(1, None, None, "a", 0)])).collect()] == [0]
