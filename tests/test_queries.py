"""Every registered query that has SQL, against DuckDB on the smallest driver tables."""

import math
from pathlib import Path

import duckdb
import pytest

from chronoset.plans import catalog

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool):
        return x
    try:
        return round(float(x), 9) + 0.0
    except (TypeError, ValueError):
        return str(x)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, str(DATA))
    names = sorted(found.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in found.collect()), key=str)
    rel = duck.execute(catalog.ORACLE_SQL[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == names
    want = sorted((tuple(plain(dict(zip(cols, r, strict=True))[c]) for c in names) for r in rel.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_kernel_query_runs_alike_however_rows_are_dealt(spark, name):
    one = sorted(map(str, catalog.QUERIES[name](spark, str(DATA)).collect()))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert one == sorted(map(str, catalog.QUERIES[name](spark, str(DATA)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert one


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
