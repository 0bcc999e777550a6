"""Queries with SQL on rows that the smallest tables don't have: notes of one tick, values of zero."""

from datetime import datetime, timedelta

import duckdb
import pytest

from chronoset.plans import catalog


def plain(x):
    return round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", ["score_notes", "midi_notes", "join_features", "classify_extras"])
def test_odd_events(spark, tmp_path, name):
    first = datetime(2024, 1, 1)
    # (hours, pitch, value, type): two notes within a tick, of one pitch and of two, also across a bar line; a value of 0 first and between
    made = [(1.0, 3, 0.0, "click"), (1.05, 3, 2.0, "purchase"), (2.0, 5, 1.0, "view"), (2.0001, 5, 0.0, "view"), (2.0002, 7, 1.0, "view"), (3.9, 4, 0.0, "click"), (4.0, 4, 1.0, "click"), (4.0001, 4, 3.0, "purchase"), (7.99999, 2, 1.0, "click"), (9.0, 3, 0.0, "click"), (9.2, 3, 0.0, "purchase"), (12.0, 3, 4.0, "view")]
    rows = [(i, first + timedelta(hours=h), 5, kind, value, f'{{"k": {k}}}') for i, (h, k, value, kind) in enumerate(made)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    for t in ("lineitem", "orders"):
        duck.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    duck.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    rel = duck.execute(catalog.ORACLE_SQL[name])
    cols = [d[0] for d in rel.description]
    want = sorted(str([plain(x) for x in r]) for r in rel.fetchall())
    assert sorted(str([plain(r[c]) for c in cols]) for r in got.collect()) == want
