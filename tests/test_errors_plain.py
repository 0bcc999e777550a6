"""The error ladders against a loop over notes, frames and rules, and their edges by hand."""

import random
from collections import defaultdict
from datetime import datetime, timedelta
from statistics import median

import pytest

from chronoset.operators import errors
from chronoset.plans import catalog, error_queries
from chronoset.sources import project

NOTE = "rec long, id long, onset double, duration double, pitch int"


def notes(spark, *rows):
    return spark.createDataFrame([(0, i, *r) for i, r in enumerate(rows)], NOTE)


def test_what_covers_a_note(spark):
    ours = notes(spark, (1.0, 0.5, 62), (2.0, 0.5, 60), (2.1, 0.9, 64))
    points = notes(spark, (1.05, 1.0, 60), (1.06, 1.0, 60), (1.5, 1.0, 60), (1.51, 1.0, 60), (2.2, 1.0, 64), (2.2, 1.0, 61))
    at = {x.id: (x.same, x.cover_id) for x in errors.covering(points, ours, 0.0).collect()}
    assert at == {1: (False, 0), 2: (False, 0), 4: (True, 2), 5: (False, 1)}  # an attack's first 50 ms cover nothing, an end does
    assert 3 in {x.id for x in errors.covering(points, ours, 0.05).collect()}


def test_bodies_begin_up_to_the_end(spark):
    pair = spark.createDataFrame([(0, 7, 1, 1.0, 0.2, 62, 1.01, 61)], "rec long, ref_id long, est_id long, ref_onset double, ref_duration double, ref_pitch int, est_onset double, est_pitch int")
    for onset, kind in ((1.01, "neighbour"), (1.02, "attack_transient"), (1.25, "attack_transient"), (1.26, "neighbour")):
        (x,) = errors.classify_pairs(pair, notes(spark, (onset, 0.1, 62)), 0.05, 0.05).collect()
        assert x["class"] == kind and (x.body_id == 0) == (kind != "neighbour")


def test_the_body_of_an_attack_is_late(spark):
    ref, est = notes(spark, (1.0, 0.5, 62), (2.0, 0.3, 64)), notes(spark, (1.01, 0.08, 61), (1.09, 0.4, 62), (2.0, 0.3, 64), (2.2, 0.1, 64))
    hits, pairs = spark.createDataFrame([(1, 2)], "ref_id long, est_id long"), spark.createDataFrame([(0, 0)], "ref_id long, est_id long")
    est = est.selectExpr("rec", "id + 100 id", "onset", "duration", "pitch", "0.5D confidence")
    hits, pairs = (x.selectExpr("ref_id", "est_id + 100 est_id") for x in (hits, pairs))
    other = est.where("false")
    extras = lambda extra: errors.classify_extra(extra, ref, other, 0.05, 12.0, 2.0, 0.3, 1.0, 1.0)
    rows = errors.classify_all(ref, est, hits, pairs, lambda m: m.selectExpr("id", "'x' class"), extras, 0.05, 0.05)
    got = {(x.population, x.ref_id, x.est_id, x["class"]) for x in rows.collect()}
    assert got == {("hit", 1, 102, "hit"), ("pair", 0, 100, "attack_transient"), ("extra", None, 101, "body_late"), ("extra", None, 103, "split_sustain")}
    parts = errors.deficit(rows).collect()
    assert abs(sum(x.part for x in parts) - (1 - 2 / 6)) < 1e-9


def test_a_note_beside_one_of_no_confidence_is_louder_without_bound(spark):
    extra = notes(spark, (1.0, 0.5, 62), (9.0, 0.5, 62)).selectExpr("*", "0.0D confidence")
    other = notes(spark, (1.1, 0.5, 62), (9.1, 0.5, 62)).selectExpr("*", "if(id = 0, 0.4D, 0.0D) confidence")
    rows = errors.classify_extra(extra, notes(spark, (30.0, 0.5, 70)), other, 0.05, 12.0, 2.0, 0.3, 1.0, 1.0).collect()
    assert {(x.id, x["class"]) for x in rows} == {(0, "bleed_cross_stem"), (1, "bleed_cross_stem")}  # 0.4 / 0 is infinite; 0 / 0 is NaN, which is above all


def test_runs_of_frames_of_one_time_do_not_depend_on_their_order(spark):
    note = notes(spark, (1.0, 1.0, 60))
    rows = [(0, 1.1, 60.0, 0.5, 9.0), (0, 1.2, 60.0, 0.5, 9.0), (0, 1.2, 64.0, 0.5, 9.0), (0, 1.2, 60.2, 0.5, 9.0), (0, 1.3, 60.0, 0.5, 9.0)]
    for dealt in (rows, rows[::-1], rows[2:] + rows[:2]):
        frames = spark.createDataFrame(dealt, "rec long, t double, f0 double, periodicity double, level double").coalesce(1)
        (x,) = errors.frame_facts(note, frames, 0.03, 0.05, 0.05, 5.0, 0.5).collect()
        assert (x.frames, x.run) == (5, 3)


def augment(edges, free, seen, owner):
    for i in edges[free]:
        if i not in seen:
            seen.add(i)
            if i not in owner or augment(edges, owner[i], seen, owner):
                owner[i] = free
                return True
    return False


def least_cost(left, right, cost):
    """Most pairs of least cost, by shortest augmenting paths over the residual graph (Bellman and Ford)."""
    of_left, of_right = {}, {}
    while True:
        dist, came = {("l", i): 0.0 for i in left if i not in of_left}, {}
        for _ in range(len(left) + len(right)):
            moved = False
            for (i, j), c in cost.items():
                for a, b, step in ((("l", i), ("r", j), c),) if of_left.get(i) != j else ((("r", j), ("l", i), -c),):
                    if a in dist and dist[a] + step < dist.get(b, 1e9) - 1e-12:
                        dist[b], came[b], moved = dist[a] + step, a, True
            if not moved:
                break
        ends = [(dist["r", j], j) for j in right if j not in of_right and ("r", j) in dist]
        if not ends:
            return {(i, j) for i, j in of_left.items()}
        at = ("r", min(ends)[1])
        while at in came:
            before = came[at]
            if at[0] == "r":
                of_left[before[1]], of_right[at[1]] = at[1], before[1]
            at = before


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    r, d = random.Random(7), str(tmp_path_factory.mktemp("small"))
    begin = datetime(2024, 1, 1)
    rows = []
    for i in range(900):
        at = r.randrange(24 * 3600 * 4) / 4
        rows.append((i, begin + timedelta(seconds=at), r.randrange(100), r.choice(("view", "click", "purchase")), r.uniform(0.1, 90), '{"k": %d}' % r.randrange(100)))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{d}/events.parquet")
    lines = [(i, r.randrange(24), begin.date(), i, 1, float(r.randrange(1, 50)), r.randrange(0, 11) / 100, float(r.randrange(900, 100000)), r.choice("NAR")) for i in range(6000)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_shipdate date, l_partkey long, l_linenumber int, l_quantity double, l_discount double, l_extendedprice double, l_returnflag string").write.parquet(f"{d}/lineitem.parquet")
    return d


def test_every_note_of_a_recording(spark, small):
    sides = defaultdict(list)
    for n in project.notes(spark, small).collect():
        sides[n.track // 50, n.source].append((n.onset, n.note_id, n.duration, n.pitch, n.confidence))
    frames = defaultdict(list)
    for x in error_queries._evidence(spark, small).collect():
        frames[x.rec].append((x.t, x.f0, x.periodicity, x.level))
    rows = defaultdict(list)
    for x in catalog.QUERIES["solo_errors"](spark, small).collect():
        rows[x.rec].append(x)
    kinds = set()
    for rec in {k[0] for k in sides}:
        ref, est, other = (sorted(sides[rec, s]) for s in ("view", "click", "purchase"))
        by = {n[1]: n for n in [*ref, *est, *other]}
        got = {(x.population, x.ref_id, x.est_id): x["class"] for x in rows[rec]}
        assert len(got) == len(rows[rec])
        hits = {k[1:] for k in got if k[0] == "hit"}
        edges = {a[1]: [b[1] for b in est if a[3] == b[3] and abs(a[0] - b[0]) <= 0.05] for a in ref}
        owner = {}
        assert len(hits) == sum(augment(edges, i, set(), owner) for i in edges) and all(j in edges[i] for i, j in hits)
        ref_free, est_free = ([n for n in own if n[1] not in {h[k] for h in hits}] for k, own in ((0, ref), (1, est)))
        cost = {(a[1], b[1]): abs(a[0] - b[0]) + 0.05 * (a[3] != b[3]) for a in ref_free for b in est_free if abs(a[0] - b[0]) <= 0.15}
        best = least_cost([n[1] for n in ref_free], [n[1] for n in est_free], cost)
        pairs = {k[1:] for k in got if k[0] == "pair"}
        assert len(pairs) == len(best) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
        assert abs(sum(cost[x] for x in pairs) - sum(cost[x] for x in best)) < 1e-9
        want, bodies = {("hit", *h): "hit" for h in hits}, set()
        for i, j in pairs:
            (ro, _, rd, rp, _), (eo, _, _, ep, _) = by[i], by[j]
            later = [n[1] for n in est if n[3] == rp and eo < n[0] <= ro + rd + 0.05]
            if rp == ep:
                kind = "unaligned" if abs(eo - ro) <= 0.05 else "timing_late" if eo > ro else "timing_early"
            elif later:
                kind = "attack_transient"
                bodies.add(later[0])
            else:
                step = abs(ep - rp)
                kind = "loose" if abs(eo - ro) > 0.05 else "octave" if step in (12, 24) else "neighbour" if step in (1, 2) else "other_pitch"
            want["pair", i, j] = kind
        for o, i, d, p, _ in ref_free:
            if i not in {x for x, _ in pairs}:
                want["miss", i, None] = missed(o, d, p, est, other, frames[rec])
        for o, j, _, p, c in est_free:
            if j not in {x for _, x in pairs}:
                kind = extra(o, p, c, ref, other)
                want["extra", None, j] = "body_late" if kind == "split_sustain" and j in bodies else kind
        assert got == want
        kinds |= set(want.values())
    assert len(kinds) > 12, kinds


def missed(o, d, p, est, other, frames):
    cover = sorted((n for n in est if n[0] + 0.05 < o <= n[0] + n[2]), key=lambda n: (n[3] != p, n[0], n[1]))
    if cover:
        return "merged" if cover[0][3] == p else "absorbed" if cover[0][0] + cover[0][2] - o >= 0.2 else "squeezed"
    if any(n[3] == p and abs(n[0] - o) <= 0.1 for n in other):
        return "not_picked"
    own = sorted(f for f in frames if o - 0.03 <= f[0] < o + max(d, 0.05))
    if not own:
        return "unclassified"
    if sum(f[3] for f in own) / len(own) < 25000:
        return "left_stem"
    loud, heard = [f[3] >= 30000 for f in own], [f[2] >= 0.05 for f in own]
    live = [f for f, a, b in zip(own, loud, heard, strict=True) if a and b]
    if not any(loud):
        return "gated"
    if not any(heard):
        return "unvoiced"
    if not live:
        return "gated"
    run = best = 0
    for f in own:
        run = run + 1 if f[1] is not None and abs(f[1] - p) <= 0.5 else 0
        best = max(best, run)
    if best == 1:
        return "too_short"
    if best >= 2:
        near = [n[3] for n in est if abs(n[0] - o) <= 2.0]
        return "dropped_register" if len(near) >= 3 and p < median(near) - 4 else "dropped"
    pitches = [f[1] for f in live if f[1] is not None]
    if not pitches:
        return "unclassified"
    off = abs(median(pitches) - p)
    return "tracked_octave" if abs(off - 12) <= 0.5 or abs(off - 24) <= 0.5 else "tracked_other"


def extra(o, p, c, ref, other):
    cover = sorted((n for n in ref if n[0] + 0.05 < o <= n[0] + n[2] + 0.05), key=lambda n: (n[3] != p, n[0], n[1]))
    if cover and cover[0][3] == p:
        return "split_sustain"
    near = [n[3] for n in ref if abs(n[0] - o) <= 2.0]
    if len(near) >= 3 and p < median(near) - 4:
        return "bleed_register"
    beside = [n[4] for n in other if n[3] == p and abs(n[0] - o) <= 0.3]
    if beside and max(beside) / c >= 1.0:
        return "bleed_cross_stem"
    if cover:
        step = abs(p - cover[0][3])
        return "fragment_octave" if step in (12, 24) else "fragment_neighbour" if step in (1, 2) else "fragment_other"
    before, after = [n[0] for n in ref if n[0] <= o], [n[0] for n in ref if n[0] > o]
    if before and after:
        return "between_phrases" if min(after) - max(before) >= 1.0 else "between_notes"
    return "between_phrases" if before or after else "unclassified"
