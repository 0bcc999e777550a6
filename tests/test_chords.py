"""Chords, joined splits and a clock's verdict against loops that take one note at a time."""

import math
import random

import pytest
from pyspark.sql import functions as F

from chronoset.functions import scalar
from chronoset.operators import chords

NOTE = "track long, note_id long, onset double, duration double, pitch int"


def loop(line, extras, tolerance, longest):
    """The hosts as a list that grows while the extras are taken in time."""
    hosts = [[n, set(), n[3]] for n in sorted(line, key=lambda n: (n[2], n[1]))]
    for e in sorted(extras, key=lambda n: (n[2], n[1])):
        near = None
        for h in hosts:
            d = abs(h[0][2] - e[2])
            if d <= tolerance and (near is None or d < near[0]):
                near = (d, h)
        if near is None:
            hosts.append([e, set(), e[3]])
        elif e[4] != near[1][0][4]:
            near[1][1].add(e[4])
            near[1][2] = max(near[1][2], e[3])
    return sorted((h[0][1], h[2] if longest else h[0][3], h[0][4], sorted(h[1])) for h in hosts)


@pytest.mark.parametrize("longest", [True, False])
def test_chords_as_extras_are_taken_in_time(spark, longest):
    r = random.Random(12)
    line, extras, i = [], [], 0
    for track in range(8):
        span = (1.0, 3.0, 10.0)[track % 3]
        for side, n in ((line, (0, 12, 40)[track % 3]), (extras, 60)):
            for _ in range(n):
                i += 1
                side.append((track, i, round(r.uniform(0, span), 5), round(r.uniform(0.05, 0.6), 3), r.randint(55, 62)))
    want = sorted(x for t in range(8) for x in loop([n for n in line if n[0] == t], [n for n in extras if n[0] == t], 0.03, longest))
    for parts in (1, 7):
        out = chords.with_chords(spark.createDataFrame(line, NOTE).repartition(parts), spark.createDataFrame(extras, NOTE).repartition(parts), 0.03, longest).collect()
        assert sorted((x.note_id, x.duration, x.pitch, list(x.chord)) for x in out) == want
    assert any(x[3] for x in want)
    empty = spark.createDataFrame([], NOTE)
    assert chords.with_chords(empty, empty, 0.03).collect() == []


def test_what_joins_and_what_parts(spark):
    rows = [(0, 1, 0.0, 1.0, 60), (0, 2, 1.0, 0.5, 60), (0, 3, 1.52, 0.5, 60), (0, 4, 2.02, 0.5, 62), (0, 5, 2.6, 0.4, 62), (1, 6, 0.0, 1.0, 60), (1, 7, 1.0, 1.0, 60)]
    notes = spark.createDataFrame([(*x, 0.1 * x[1]) for x in rows], NOTE + ", confidence double")
    frames = [(0, k, 60.2 if k < 202 else 62.0) for k in range(300)] + [(1, k, 60.0 if k != 103 else None) for k in range(300)]
    trace = spark.createDataFrame(frames, "track long, frame long, pitch double")
    none = spark.createDataFrame([], "track long, t double")
    join = lambda t, a: {x.note_id: (round(x.duration, 6), round(x.confidence, 6), x.joined) for x in chords.rejoin_splits(notes, t, a, 0.01, 0.03, 0.05, 0.04).collect()}
    assert join(trace, none) == {1: (2.02, 0.3, 3), 4: (0.5, 0.4, 1), 5: (0.4, 0.5, 1), 6: (1.0, 0.6, 1), 7: (1.0, 0.7, 1)}
    hit = spark.createDataFrame([(0, 1.03), (0, 9.0)], "track long, t double")
    assert join(trace, hit) == {1: (1.0, 0.1, 1), 2: (1.02, 0.3, 2), 4: (0.5, 0.4, 1), 5: (0.4, 0.5, 1), 6: (1.0, 0.6, 1), 7: (1.0, 0.7, 1)}
    assert all(x[2] == 1 for x in join(trace.where("frame < 100"), none).values())  # the trace ends before the join


def test_binomial_tail(spark):
    r = random.Random(4)
    rows = [(n, k, p) for n in (1, 2, 7, 40, 300) for k in {0, 1, n // 2, n - 1, n, r.randint(0, n)} for p in (0.0, 1e-3, 0.1, 0.5, 0.97, 1.0)]
    rows += [(5, 6, 0.5)]
    got = spark.createDataFrame(rows, "n long, k long, p double").select("n", "k", "p", scalar.binomial_tail(F.col("n"), F.col("k"), F.col("p")).alias("tail")).collect()
    for x in got:
        want = 1.0 if x.k <= 0 else sum(math.comb(x.n, i) * x.p**i * (1 - x.p) ** (x.n - i) for i in range(x.k, x.n + 1))
        assert x.tail == pytest.approx(want, rel=1e-9, abs=1e-15), x


def test_clocks(spark):
    rows = [(100, 95, 480), (100, 95, 24), (100, 80, 480), (0, 0, 480), (50, 50, 0xE728), (3, 3, 480), (3, 3, 48), (40, 40, 96)]
    got = [x.kind for x in spark.createDataFrame(rows, "n long, hits long, division int").select(scalar.timing_kind(F.col("n"), F.col("hits"), F.col("division"))[2].alias("kind")).collect()]

    def plain(n, hits, division):
        if not n or division & 0x8000:
            return "unknown"
        on = lambda t: 2 * min(24 * t % division, division - 24 * t % division) <= 24
        p = sum(map(on, range(division))) / division
        tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(hits, n + 1))
        return "performed" if hits / n < 0.9 else "quantized" if tail < 1e-3 else "unknown"

    assert got == [plain(*x) for x in rows] and set(got) == {"performed", "quantized", "unknown"}
