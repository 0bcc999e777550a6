import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from chronoset.llm import merkle as M
from chronoset.llm import queries

from .fixtures import SCHEMA, documents, frame, lower


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (row[0], row[3], row[2], row[4], row[1])))


def climb(nodes, arity=16):
    """The root of some nodes, and for each the siblings on its way, by carrying every node up one level at a time."""
    paths = [[] for _ in nodes]
    here = list(range(len(nodes)))
    while len(nodes) > 1:
        for k in range(len(paths)):
            first = here[k] // arity * arity
            paths[k].append(("".join(nodes[first : here[k]]), "".join(nodes[here[k] + 1 : first + arity])))
            here[k] //= arity
        nodes = [sha("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)]
    return nodes[0], paths


def plain(rows, arity=16):
    """(doc_id, leaf, subroot, root, siblings) by source."""
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in order}
    trees = {s: climb([leaf(r) for r in own[s]], arity) for s in order}
    root, over = climb([trees[s][0] for s in order], arity)
    return [(r, leaf(r), trees[s][0], root, path + over[k]) for k, s in enumerate(order) for r, path in zip(own[s], trees[s][1], strict=True)]


def expected(rows):
    for r, own, subroot, root, path in plain(rows):
        now = own
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
            now = leaf((r[0], None if r[1] is None else lower(r[1]), *r[2:]))
        for a, b in path:
            now = sha(a + now + b)
        yield (r[0], own, subroot, root, sha("".join(a + b for a, b in path)), now, now == root)


def test_query_and_sql(spark, tmp_path):
    rows = documents(n=700)
    rows = [(i, t, lang, "hot" if k % 3 else s, n) for k, (i, t, lang, s, n) in enumerate(rows)]
    frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(x) for x in queries.QUERIES["op12_merkle_manifest"](spark, str(tmp_path)).collect()), key=str)
    want = sorted(expected(rows), key=str)
    assert got == want and {x[-1] for x in got} == {True, False}
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(c.execute(M.MANIFEST_SQL).fetchall(), key=str) == want


@pytest.mark.parametrize(("depth", "most", "groups"), [(1, 1, 3), (1, 2, 40), (2, 3, 1), (1, 1000, 5), (2, 1, 9)])
def test_every_way_to_the_top_gives_the_same(spark, depth, most, groups):
    """Blocks of few leaves and tops of few nodes: the top is reduced in several rounds, over leaves and over sources."""
    rows = [(i, t, lang, f"s{(i or 0) % groups}" if i is None or i % 7 else None, n) for i, t, lang, _, n in documents(n=90)]
    got = M.manifest(frame(spark, rows), arity=2, depth=depth, most=most).collect()
    want = [(r[0], r[3], own, subroot, root, [a for a, _ in path], [b for _, b in path]) for r, own, subroot, root, path in plain(rows, arity=2)]
    assert sorted(((x.doc_id, x.source, x.leaf, x.subroot, x.root, x.before, x.after) for x in got), key=str) == sorted(want, key=str)


def test_a_changed_row_does_not_fold_to_the_root(spark):
    rows = M.manifest(frame(spark, documents(n=50)), carry={"other": F.sha2(F.lit("x").cast("binary"), 256)})
    told = rows.select((M.folded(F.col("leaf"), F.col("before"), F.col("after")) == F.col("root")).alias("own"), (M.folded(F.col("other"), F.col("before"), F.col("after")) == F.col("root")).alias("other"))
    assert {tuple(x) for x in told.collect()} == {(True, False)}


def test_few_rows_and_clashing_names(spark):
    assert M.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
    one = (1, None, None, None, None)
    (x,) = M.manifest(frame(spark, [one])).collect()
    assert x.leaf == x.subroot == x.root == leaf(one) and x.before == x.after == [] and x.source is None
    rows = documents(n=20)
    clash = frame(spark, rows).withColumn("leaf", F.lit(1)).withColumn("g", F.lit(2)).withColumn("place", F.lit(3)).withColumn("n", F.lit(4))
    a = M.manifest(clash).select("leaf", "root", "place").collect()
    b = M.manifest(frame(spark, rows)).select("leaf", "root", "place").collect()
    assert sorted(a) == sorted(b)
