"""Repair of found beats: doubled and ghost beats taken out, dropped ones put in, stretches thinned to what a metronome counts.

What is judged again after each change is a keyed fixpoint: every round changes each track once at most, tracks that don't change
any more are done, and a track that still changes after the last round raises.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import grid, kernels, signal
from .islands import by, island_id
from .joins import nearest_join, stabbing_join
from .lineage import settled
from .stats import modal_interval

#: Intervals either side that a reference pulse is taken over; of those, the least that fit it.
REACH, FIT = 8, 3
#: Intervals of a metronome's side, how far one may be off it, and how far both sides' pulses apart.
SIDE, CLEAN, AGREE = 8, 0.35, 0.15


def fixpoint(rows: DataFrame, key: str, step: Callable[[DataFrame], DataFrame], most: int = 64) -> DataFrame:
    """rows after step() has been applied to each key's until they don't change, with `rounds`, the changes that took.

    step gives the rows of each key with a column `changed`, the same for all rows of the key; a key is not seen again once it is
    false. Raises if a key still changes after `most` rounds.
    """
    done, live = [], rows
    for n in range(most + 1):
        out = settled(step(live))
        done.append(out.where("not changed").drop("changed").withColumn("rounds", F.lit(n)))
        live = out.where("changed").drop("changed")
        if live.isEmpty():
            return reduce(DataFrame.unionByName, done)
    raise RuntimeError(f"rows of some {key} still change after {most} rounds")


def pulse_octave(beats: DataFrame, marks: DataFrame, near: float = 0.15, fine: float = 0.2, twos: float = 0.5, least: int = 20) -> DataFrame:
    """(track, share, pairs, two, pulse): the pulse of beats (track, t) whose commonest interval is the wrong octave, else null.

    It is where `fine` of the intervals are half of that, and of the downbeat marks (track, mark) that follow each other by the beats
    nearest them, where the first one's interval is the commonest one, `least` or more do and `twos` of them two beats apart.
    """
    w = by("track", "t")
    b = beats.select("track", "t").withColumn("i", F.row_number().over(w) - 1).withColumn("gap", F.lead("t").over(w) - F.col("t"))
    b = b.join(modal_interval(beats).select("track", F.col("mode").alias("seed")), "track")
    half = F.abs(F.col("gap") / F.col("seed") / 0.5 - 1) <= near
    runs = b.where("gap is not null and seed > 0").groupBy("track").agg(F.count_if(half).alias("halves"), F.count("*").alias("n"), F.percentile(F.when(half, F.col("gap")), 0.5).alias("half"))
    at = nearest_join(marks.select("track", "mark"), b.select("track", F.col("t").alias("b_t"), "i", "gap", "seed"), ["track"], "mark", "b_t", ["i", "gap", "seed"])
    v = by("track", "i")
    at = at.where("i is not null").select("track", "i", "gap", "seed").distinct().withColumn("on", F.lead("i").over(v) - F.col("i"))
    whole = F.col("on").isNotNull() & F.col("gap").isNotNull() & (F.abs(F.col("gap") / F.col("seed") - 1) <= near)
    pairs = at.groupBy("track").agg(F.count_if(whole).alias("pairs"), F.count_if(whole & (F.col("on") == 2)).alias("two"))
    out = runs.join(pairs, "track", "left").fillna(0, ["pairs", "two"])
    wrong = (F.col("n") >= 3) & (F.col("halves") >= fine * F.col("n")) & (F.col("pairs") >= least) & (F.col("two") >= twos * F.col("pairs"))
    return out.select("track", (F.col("halves") / F.col("n")).alias("share"), "pairs", "two", F.when(wrong, F.col("half")).alias("pulse"))


def with_pulse(beats: DataFrame, seeds: DataFrame | None = None, near: float = 0.15) -> DataFrame:
    """beats (track, t, ...) with i, n, gap and pulse: the reference of the interval after each beat; null at the last one.

    seeds: (track, seed); without one, or with a null seed, the commonest interval. An interval votes for the pulse that it holds a
    whole number of, or twice itself if it is half a seed; with fewer than FIT votes within REACH the seed stands.
    """
    w = by("track", "t")
    b = beats.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("track"))).withColumn("gap", F.lead("t").over(w) - F.col("t"))
    own = modal_interval(beats.select("track", "t")).select("track", F.col("mode").alias("__own"))
    b = b.join(own, "track", "left")
    b = b.join(seeds.select("track", F.col("seed").alias("__seed")), "track", "left") if seeds is not None else b.withColumn("__seed", F.lit(None).cast("double"))
    seed = F.coalesce(F.when(F.col("__seed") > 0, F.col("__seed")), F.col("__own"))
    ratio = F.col("gap") / seed
    vote = F.when(ratio >= 0.75, F.col("gap") / F.bround(ratio)).when(F.abs(ratio / 0.5 - 1) <= near, F.col("gap") * 2)
    reach = w.rowsBetween(-REACH, REACH)
    b = b.withColumn("__vote", vote).withColumn("__votes", F.count("__vote").over(reach)).withColumn("__mid", F.percentile("__vote", 0.5).over(reach))
    pulse = F.when(F.col("gap").isNotNull(), F.when(F.col("__votes") >= FIT, F.col("__mid")).otherwise(seed))
    return b.withColumn("pulse", pulse).drop("__own", "__seed", "__vote", "__votes", "__mid")


def jump(left: Column, right: Column, apart: Column, agree: float = AGREE) -> Column:
    """How many beats a count runs ahead over a stretch, by a metronome: left are the SIDE + 1 beats up to it, right those from its end
    on, which the grid numbers `apart` higher. Null where a side is short or not steady, or both differ in their pulse."""
    size = F.lit(SIDE)
    one, two = (F.get(left, size) - F.get(left, F.lit(0))) / SIDE, (F.get(right, size) - F.get(right, F.lit(0))) / SIDE
    pulse = (one + two) / 2
    steady = lambda x, p: (p > 0) & F.forall(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda k: F.abs(F.get(x, k + 1) - F.get(x, k) - p) <= CLEAN * p)
    middle = lambda x, first: F.get(F.array_sort(F.transform(x, lambda t, k: t - pulse * (k + first))), F.lit(SIDE // 2))
    good = (F.size(left) == SIDE + 1) & (F.size(right) == SIDE + 1) & steady(left, one) & steady(right, two) & (F.abs(one - two) <= agree * pulse)
    return F.when(good, (middle(left, F.lit(-SIDE)) - middle(right, apart)) / pulse)


def drop_doubled(beats: DataFrame, seeds: DataFrame | None = None, tolerance: float = 0.15) -> DataFrame:
    """(track, t) without the middle beats of two intervals that make one pulse, or of a short pair between ordinary intervals."""
    b = with_pulse(beats.select("track", "t"), seeds).select("track", "t", "pulse")
    kind = dict(beats.dtypes)["track"]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"track": g["track"].iloc[0], "t": signal.drop_doubled(g["t"].to_numpy(), g["pulse"].to_numpy()[:-1], tolerance)})

    return kernels.per_group(b, ["track"], ["t"], run, f"track {kind}, t double")


def drop_ghosts(beats: DataFrame, seeds: DataFrame | None = None, tolerance: float = 0.15, short: float = 0.6, fit: float = 0.4, most: int = 64) -> DataFrame:
    """(track, t, rounds) without the beats that a metronome says are one too many, the shortest interval for its pulse first.

    Of the two beats of an interval under `short` of its pulse the one goes that is farther from half way between their neighbours.
    """

    def step(rows: DataFrame) -> DataFrame:
        w = by("track", "t")
        b = with_pulse(rows, seeds)
        sides = b.withColumn("__l", F.collect_list("t").over(w.rowsBetween(-SIDE - 1, -1))).withColumn("__r", F.collect_list("t").over(w.rowsBetween(2, SIDE + 2)))
        sides = sides.withColumn("__next", F.lead("t").over(w)).where((F.col("n") >= 4) & F.col("i").between(1, F.col("n") - 3) & (F.col("pulse") > 0) & (F.col("gap") < short * F.col("pulse")))
        sides = sides.withColumn("jump", jump(F.col("__l"), F.col("__r"), F.lit(3), tolerance)).where(F.abs(F.col("jump") - 1) <= fit)
        middle = (F.get("__l", F.lit(SIDE)) + F.get("__r", F.lit(0))) / 2
        goes = F.when(F.abs(F.col("t") - middle) > F.abs(F.col("__next") - middle), F.col("t")).otherwise(F.col("__next"))
        pick = sides.groupBy("track").agg(F.min_by(goes, F.struct(F.col("gap") / F.col("pulse"), F.col("i"))).alias("__goes"))
        return rows.join(pick, "track", "left").where("__goes is null or t != __goes").withColumn("changed", F.col("__goes").isNotNull()).drop("__goes")

    return fixpoint(beats.select("track", "t"), "track", step, most)


def insert_dropped(beats: DataFrame, seeds: DataFrame | None = None, longest: int = 8) -> DataFrame:
    """(track, t, implied): beats, with as many even ones in each gap as pulses fit, if those make it 2 to `longest` intervals."""
    b = with_pulse(beats.select("track", "t"), seeds)
    count = F.coalesce(F.when(F.col("pulse") > 0, F.bround(F.col("gap") / F.col("pulse")).cast("int")), F.lit(1))
    b = b.withColumn("count", F.when(count.between(2, longest), count).otherwise(1)).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    return b.select("track", F.when(F.col("k") == 0, F.col("t")).otherwise(F.col("t") + F.col("k") * (F.col("gap") / F.col("count"))).alias("t"), (F.col("k") > 0).alias("implied"))


def readings(beats: DataFrame, tolerance: float = 0.15, reach: int = 3, rest: float = 0.35, fit: float = 0.4) -> DataFrame:
    """(track, first, last, part, jump): doubted stretches of beats (track, t, implied) by place, and what a metronome counts too many.

    A stretch whose count the metronome confirms is left out. Where it can't be read because others crowd its right side, the first
    run of them that can is read as one stretch, which is part 1; a stretch of its own is part 0.
    """
    b = settled(beats.select("track", "t", "implied"))
    w = by("track", "t")
    sides = b.withColumn("i", F.row_number().over(w) - 1).withColumn("l", F.collect_list("t").over(w.rowsBetween(-SIDE, 0))).withColumn("r", F.collect_list("t").over(w.rowsBetween(0, SIDE)))
    sides = settled(sides.select("track", "i", "l", "r"))

    def read(stretches: DataFrame) -> DataFrame:
        x = stretches.join(sides.select("track", F.col("i").alias("first"), "l"), ["track", "first"]).join(sides.select("track", F.col("i").alias("last"), "r"), ["track", "last"])
        return x.withColumn("jump", jump(F.col("l"), F.col("r"), F.col("last") - F.col("first"), tolerance)).drop("l", "r")

    found = read(grid.doubts(b, reach, rest).select("track", "first", "last"))
    v = by("track", "first")
    found = settled(found.where(F.col("jump").isNull() | (F.abs("jump") > fit)))
    near = found.withColumn("k", F.row_number().over(v)).withColumn("crowd", island_id(F.coalesce(F.col("first") - F.lag("last").over(v) > SIDE, F.lit(True)), v))
    later = near.select(F.col("track").alias("l_track"), F.col("crowd").alias("l_crowd"), F.col("k").alias("l_k"), F.col("last").alias("l_last"))
    runs = near.where("jump is null").join(later, (F.col("track") == F.col("l_track")) & (F.col("crowd") == F.col("l_crowd")) & (F.col("l_k") > F.col("k")))
    runs = read(runs.select("track", "first", F.col("l_last").alias("last"))).where("jump is not null")
    first = runs.groupBy("track", "first").agg(F.min(F.struct("last", "jump")).alias("x")).select("track", "first", "x.last", F.lit(1).alias("part"), "x.jump")
    return found.select("track", "first", "last", F.lit(0).alias("part"), "jump").union(first)


def thin_by_metronome(beats: DataFrame, tolerance: float = 0.15, fit: float = 0.3, extra: int = 4, snap: float = 0.25, most: int = 64) -> DataFrame:
    """(track, t, implied, rounds): beats whose doubted stretches hold a whole number of beats too many, laid out again with fewer.

    A new beat is the found one nearest its place, if that is within `snap` of a step, and implied otherwise. The first stretch of a
    track goes first, and the track is read again.
    """

    def step(rows: DataFrame) -> DataFrame:
        rows = settled(rows)
        n = F.bround("jump")
        fits = readings(rows, tolerance).withColumn("many", n).where(n.between(1, extra) & (F.abs(F.col("jump") - n) <= fit) & (F.col("last") - F.col("first") - n >= 1))
        pick = fits.groupBy("track").agg(F.min(F.struct("first", "part", "last", "many")).alias("x")).select("track", "x.*")
        b = rows.withColumn("i", F.row_number().over(by("track", "t")) - 1)
        ends = pick.join(b.select("track", F.col("i").alias("first"), F.col("t").alias("a")), ["track", "first"]).join(b.select("track", F.col("i").alias("last"), F.col("t").alias("z")), ["track", "last"])
        ends = settled(ends.withColumn("count", (F.col("last") - F.col("first") - F.col("many")).cast("int")).withColumn("size", (F.col("z") - F.col("a")) / F.col("count")))
        held = b.join(ends.select("track", "first", "last"), "track", "left")
        inner = F.coalesce((F.col("i") > F.col("first")) & (F.col("i") < F.col("last")), F.lit(False))
        ideal = ends.where("count > 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("count") - 1))).select("track", (F.col("a") + F.col("k") * F.col("size")).alias("ideal"), "size")
        real = held.where(inner & ~F.col("implied")).select("track", F.col("t").alias("b_t"), F.col("t").alias("real"))
        laid = nearest_join(ideal, real, ["track"], "ideal", "b_t", ["real"])
        kept = F.coalesce(F.abs(F.col("real") - F.col("ideal")) <= snap * F.col("size"), F.lit(False))
        laid = laid.select("track", F.when(kept, F.col("real")).otherwise(F.col("ideal")).alias("t"), (~kept).alias("implied"))
        out = held.where(~inner).select("track", "t", "implied").union(laid)
        return out.join(ends.select("track", F.lit(True).alias("changed")), "track", "left").fillna(False, ["changed"])

    return fixpoint(beats.select("track", "t", "implied"), "track", step, most)


def repair(beats: DataFrame, marks: DataFrame | None = None, tolerance: float = 0.15, longest: int = 8) -> DataFrame:
    """(track, t, implied): found beats (track, t) with the wrong ones taken out, the missing ones put in and stretches thinned.

    marks: (track, mark), the downbeats that a tracker found; they only tell the octave of the pulse. Repeated beats are one; a track
    of one beat keeps it; null times and tracks take no part.
    """
    b = settled(beats.select("track", F.col("t").cast("double").alias("t")).where("track is not null and t is not null").distinct())
    seeds = settled(pulse_octave(b, marks).select("track", F.col("pulse").alias("seed"))) if marks is not None else None
    b = settled(drop_doubled(b, seeds, tolerance))
    b = drop_ghosts(b, seeds, tolerance).drop("rounds")
    return thin_by_metronome(settled(insert_dropped(b, seeds, longest)), tolerance).drop("rounds")


def settle(doubts: DataFrame, beats: DataFrame, marks: DataFrame, reach: float = 8.0, near: float = 0.05, least: int = 3, pulses: int = 4) -> DataFrame:
    """doubts (track, first, last, ...) without those that the downbeat marks (track, mark) keep one phase across.

    A mark votes for the phase of the beat within `near` of it; the marks up to `reach` before a doubt and after it, `least` of them
    each side, are compared by their commonest phase (of several, that of the earliest mark).
    """
    b = beats.select("track", "t").withColumn("i", F.row_number().over(by("track", "t")) - 1)
    at = nearest_join(marks.select("track", "mark"), b.select("track", F.col("t").alias("b_t"), "i"), ["track"], "mark", "b_t", ["i"], near).where("i is not null")
    votes = at.select(F.col("track").alias("v_track"), "mark", (F.col("i") % pulses).alias("phase"))
    d = settled(doubts.join(b.select("track", F.col("i").alias("first"), F.col("t").alias("__from")), ["track", "first"]).join(b.select("track", F.col("i").alias("last"), F.col("t").alias("__to")), ["track", "last"]))
    before = F.col("mark").between(F.col("__from") - reach, F.col("__from"))
    after = F.col("mark").between(F.col("__to"), F.col("__to") + reach)
    spans = d.select("track", "first", "last", "__from", "__to", (F.col("__from") - reach).alias("__lo"), (F.col("__to") + reach + 1e-9).alias("__hi"))
    met = stabbing_join(votes, spans, [("v_track", "track")], "mark", ("__lo", "__hi"), 4 * reach).withColumn("side", F.when(before, 0).when(after, 1)).where("side is not null")
    n = met.groupBy("track", "first", "last", "side", "phase").agg(F.count("*").alias("n"), F.min("mark").alias("m"))
    best = n.groupBy("track", "first", "last", "side").agg(F.sum("n").alias("all"), F.max_by("phase", F.struct("n", -F.col("m"))).alias("phase")).where(F.col("all") >= least)
    same = best.groupBy("track", "first", "last").agg(F.count("*").alias("sides"), F.min("phase").alias("a"), F.max("phase").alias("z")).where("sides = 2 and a = z")
    return d.join(same, ["track", "first", "last"], "left_anti").select(*doubts.columns)
