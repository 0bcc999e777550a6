"""Queries over every row of small tables, against loops."""

import random
from collections import defaultdict
from datetime import datetime, timedelta
from itertools import combinations
from statistics import median

import pytest

from chronoset.operators import kernels
from chronoset.plans import catalog
from chronoset.sources import project


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Tables of events: 40 tracks, of which each overlaps others."""
    r, d = random.Random(3), str(tmp_path_factory.mktemp("small"))
    begin = datetime(2024, 1, 1)
    rows = [(i, begin + timedelta(seconds=r.randrange(3600 * 30)), r.randrange(40), r.choice(("view", "click")), r.uniform(0.1, 90), '{"k": %d}' % r.randrange(100)) for i in range(600)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
    return d


def run(spark, name, d):
    return catalog.QUERIES[name](spark, d).collect()


def sounding(spark, d):
    """The notes of each voice, and the pairs of one voice that sound together with what they share."""
    groups = defaultdict(list)
    for n in project.notes(spark, d).collect():
        groups[n.source, n.track // 10].append((n.note_id, n.onset, n.onset + 0.4 + n.confidence, n.pitch, n.confidence, n.pitch + 12 * (n.note_id % 4)))
    pairs = {}
    for g in groups.values():
        for a, b in combinations(sorted(g), 2):
            if a[1] < b[2] and b[1] < a[2]:
                pairs[a, b] = min(a[2], b[2]) - max(a[1], b[1])
    return groups, pairs


def test_overlaps_of_all_tracks(spark, small):
    groups, pairs = sounding(spark, small)
    assert len(groups) == 8 and sum(map(len, groups.values())) == 600
    want = {(a[0], b[0]): (round(s, 6), s >= 0.06 or s >= 0.3 * min(a[2] - a[1], b[2] - b[1])) for (a, b), s in pairs.items()}
    got = run(spark, "overlapping_pairs", small)
    assert len(got) == len(want) > 500 and {(x.a_id, x.b_id): (round(x.shared, 6), x.meaningful) for x in got} == want

    ghosts = set()
    for (a, b), s in pairs.items():
        for x, y in ((a, b), (b, a)):
            if y[5] - x[5] in (12, 19, 24, 28, 31, 34, 36) and s >= 0.5 * (y[2] - y[1]) and y[4] <= 0.6 * x[4]:
                ghosts.add(y[0])
    assert ghosts and sorted(x.ghost for x in run(spark, "ghosts", small)) == sorted(ghosts)

    near = {(a[0], b[0]) for (a, b), s in pairs.items() if s >= 0.06}
    over = defaultdict(list)
    for a, b in near:
        over[a].append(b)
    triples = sorted((a, *bc) for a, bs in over.items() for bc in combinations(sorted(bs), 2) if bc in near)
    assert triples and sorted(map(tuple, run(spark, "voice_triples", small))) == triples


def test_voices_of_all_tracks(spark, small):
    groups, _ = sounding(spark, small)
    want = {}
    for g in groups.values():
        stretch, ended = [], float("-inf")
        for n in [*sorted(g, key=lambda n: (n[1], n[0])), None]:
            if n is None or n[1] >= ended:
                want |= dict(zip([x[0] for x in stretch], kernels.two_voices([x[1:4] for x in stretch]), strict=True))
                stretch = []
            if n:
                stretch.append(n)
                ended = max(ended, n[2])
    got = run(spark, "two_voices", small)
    assert len(got) == len(want) == 600 and {x.note_id: x.voice for x in got} == want


def test_bars_of_every_frame(spark, tmp_path):
    r, begin = random.Random(4), datetime(2024, 1, 1)
    rows = [(i, i, s, 1, 5.0, float(i), round(r.uniform(0, 0.1), 2), 0.0, "N", "O", begin + timedelta(hours=i)) for s, n in ((1, 450), (2, 30)) for i in range(n)]
    kind = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {}
    for s in (1, 2):
        size = [1.0 + x[6] for x in rows if x[2] == s]
        for i in range(len(size)):
            want[s, i] = sum(size[:i]), sum(size[:i]) - i * median(size)
    got = {(x.track, x.frame): (x.start, x.overrun) for x in run(spark, "page_bars", str(tmp_path))}
    assert len(got) == 480 and all(got[k] == pytest.approx(v, abs=2e-5) for k, v in want.items())


def test_lines_of_400_points(spark, tmp_path):
    r, begin = random.Random(6), datetime(2024, 1, 1)
    rows = [(s * 1000 + i, begin + timedelta(minutes=5 * i), s, "view", r.uniform(0.1, 90), '{"k": 1}') for s, n in ((1, 401), (2, 67), (3, 999)) for i in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    tracks, want = defaultdict(list), {}
    for n in project.notes(spark, str(tmp_path)).collect():
        tracks[n.track].append((n.onset, n.confidence))
    for k, p in tracks.items():
        p = sorted(p)
        p = [p[int(i * (len(p) / 400))] for i in range(400)] if len(p) > 400 else p
        slope = median((b[1] - a[1]) / (b[0] - a[0]) for a, b in combinations(p, 2))
        want[k] = slope, median(y - slope * x for x, y in p)
    got = {x.track: (x.slope, x.intercept) for x in run(spark, "theil_sen", str(tmp_path))}
    assert len(got) == 3 and all(got[k] == pytest.approx(v, abs=2e-6) for k, v in want.items())
