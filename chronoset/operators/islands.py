"""Gaps and islands: runs, fills, clusters, phrases, gaps and what is put into them. Every track is one sorted window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(track: str | list[str], *order: str | Column) -> Window:
    return Window.partitionBy(*([track] if isinstance(track, str) else track)).orderBy(*order)


def island_id(new: Column, w: Window) -> Column:
    """A running count of rows that begin an island."""
    return F.sum(F.when(new, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def voiced_runs(frames: DataFrame) -> DataFrame:
    """(track, first, last, frames) of each maximal run of frames with a pitch."""
    w = by("track", "frame")
    on = F.col("pitch").isNotNull()
    new = on & F.coalesce(F.lag("pitch").over(w).isNull(), F.lit(True))
    runs = frames.withColumn("run", island_id(new, w)).where(on)
    return runs.groupBy("track", "run").agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("frames")).drop("run")


def fill_short_gaps(frames: DataFrame, longest: int) -> DataFrame:
    """frames with `filled`: pitch, carried forward over inner runs of at most `longest` frames without one."""
    w = by("track", "frame")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    last = F.last(F.when(F.col("pitch").isNotNull(), F.struct("frame", "pitch")), ignorenulls=True).over(back)
    next_ = F.first(F.when(F.col("pitch").isNotNull(), F.col("frame")), ignorenulls=True).over(ahead)
    out = frames.withColumn("__last", last).withColumn("__next", next_)
    short = F.col("__next") - F.col("__last.frame") - 1 <= longest
    return out.withColumn("filled", F.coalesce(F.col("pitch"), F.when(short, F.col("__last.pitch")))).drop("__last", "__next")


def in_runs(frames: DataFrame, value: str) -> DataFrame:
    """Frames that have a value, with `run`, the same for all of a maximal run of them."""
    return frames.withColumn("run", island_id(F.col(value).isNull(), by("track", "frame"))).where(F.col(value).isNotNull())


def persistent_changes(runs: DataFrame, value: str, persist: int) -> DataFrame:
    """runs with `change`: true where another value takes over for `persist` frames of a run or more; shorter spells change nothing."""
    w = by(["track", "run"], "frame")
    new = F.coalesce(F.col(value) != F.lag(value).over(w), F.lit(True))
    s = runs.withColumn("__new", new).withColumn("__spell", island_id(F.col("__new"), w))
    size = F.count("*").over(Window.partitionBy("track", "run", "__spell"))
    s = s.withColumn("__lasts", (size >= persist) | (F.col("__spell") == 1))
    before = F.last(F.when(F.col("__lasts"), F.col(value)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    change = F.col("__new") & F.col("__lasts") & (F.col(value) != before)
    return s.withColumn("change", F.coalesce(change, F.lit(False))).drop("__new", "__spell", "__lasts")


def segment_runs(frames: DataFrame, persist: int, least: int, hop: float) -> DataFrame:
    """Notes from frames with filled, onset (true where something is struck) and periodicity.

    A voiced run is cut where another rounded pitch persists and where something is struck after its first frame. A first change of
    pitch before `persist` frames, with nothing struck up to it, is a scoop into the note and no cut. Pieces of fewer than `least`
    frames go; a note has its piece's median pitch and mean periodicity.
    """
    runs = in_runs(frames, "filled").withColumn("near", F.bround("filled"))
    own = Window.partitionBy("track", "run")
    f = persistent_changes(runs, "near", persist).withColumn("start", F.min("frame").over(own))
    f = f.withColumn("struck", F.coalesce("onset", F.lit(False)) & (F.col("frame") > F.col("start")))
    first = F.min(F.when(F.col("change"), F.col("frame"))).over(own)
    struck = F.min(F.when(F.col("struck"), F.col("frame"))).over(own)
    scoop = (F.col("frame") == first) & (F.col("frame") - F.col("start") < persist) & F.coalesce(struck > first, F.lit(True))
    f = f.withColumn("cut", F.col("struck") | (F.col("change") & ~scoop))
    seg = f.withColumn("seg", island_id(F.col("cut"), by(["track", "run"], "frame")))
    out = seg.groupBy("track", "run", "seg").agg(F.min("frame").alias("first"), F.count("*").alias("n"), F.percentile("filled", 0.5).alias("mid"), F.avg("periodicity").alias("mean"))
    out = out.where(F.col("n") >= least)
    return out.select("track", (F.col("first") * hop).alias("onset"), (F.col("n") * hop).alias("duration"), F.bround("mid").cast("int").alias("pitch"), F.round("mean", 6).alias("confidence"))


def anchored_clusters(notes: DataFrame, gap: float) -> DataFrame:
    """notes with `cluster`: a new one begins where the onset is more than `gap` after the cluster's FIRST onset (not chained).

    First onsets more than `gap` apart (by chain) can't share a cluster, so only chained runs are folded, each an array of its own.
    """
    w = by("track", "onset", "note_id")
    new = F.coalesce(F.col("onset") - F.lag("onset").over(w) > gap, F.lit(True))
    chained = notes.withColumn("chain", island_id(new, w))
    at = F.array_sort(F.collect_list(F.struct("onset", "note_id")))
    runs = chained.groupBy("track", "chain").agg(at.alias("rows"))
    zero = F.struct(F.lit(None).cast("double").alias("first"), F.lit(0).alias("n"), F.expr("cast(array() as array<struct<note_id:bigint,c:int>>)").alias("out"))

    def step(a: Column, x: Column) -> Column:
        fresh = a["first"].isNull() | (x["onset"] - a["first"] > gap)
        n = F.when(fresh, a["n"] + 1).otherwise(a["n"])
        return F.struct(F.when(fresh, x["onset"]).otherwise(a["first"]).alias("first"), n.alias("n"), F.concat(a["out"], F.array(F.struct(x["note_id"].alias("note_id"), n.alias("c")))).alias("out"))

    runs = runs.select("track", "chain", F.explode(F.aggregate("rows", zero, step)["out"]).alias("x")).select("track", "chain", F.col("x.note_id").alias("note_id"), F.col("x.c").alias("part"))
    out = chained.join(runs, ["track", "chain", "note_id"])
    first = F.min("onset").over(Window.partitionBy("track", "chain", "part"))
    return out.withColumn("cluster", first).drop("chain", "part")


def phrases(notes: DataFrame, rest: float) -> DataFrame:
    """notes with `phrase`: a new one begins where the onset is `rest` or more after everything so far has ended."""
    w = by("track", "onset", "note_id")
    ended = F.max(F.col("onset") + F.col("duration")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return notes.withColumn("phrase", island_id(F.coalesce(F.col("onset") - ended >= rest, F.lit(True)), w))


def merge_intervals(spans: DataFrame, key: str, lo: str, hi: str) -> DataFrame:
    """(key, lo, hi) of the unions of spans that overlap or touch."""
    w = by(key, lo, hi)
    ended = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = spans.withColumn("__id", island_id(F.coalesce(F.col(lo) > ended, F.lit(True)), w))
    return s.groupBy(key, "__id").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("__id")


def coverage_gaps(times: DataFrame, time: str, start: float, end: float, most: float = 3.0) -> DataFrame:
    """(track, lo, hi) of gaps longer than `most` median intervals between times, the edges start and end among them."""
    w = by("track", time)
    steps = times.select("track", F.col(time).alias("lo"), F.lead(time).over(w).alias("hi"))
    mid = steps.groupBy("track").agg(F.percentile(F.col("hi") - F.col("lo"), 0.5).alias("mid"))
    edges = times.select("track").distinct().select("track", F.explode(F.array(F.lit(float(start)), F.lit(float(end)))).alias(time)).union(times.select("track", time))
    gaps = edges.select("track", F.col(time).alias("lo"), F.lead(time).over(w).alias("hi")).join(mid, "track")
    return gaps.where((F.col("hi") - F.col("lo")) > most * F.col("mid")).select("track", "lo", "hi")


def repair_rate(beats: DataFrame, tolerance: float = 0.15, run: int = 3, factor: int = 4) -> DataFrame:
    """(track, t, implied): beats, with runs of `run` intervals or more of the same multiple of the median filled evenly."""
    w = by("track", "t")
    steps = beats.select("track", "t", (F.lead("t").over(w) - F.col("t")).alias("gap"))
    mid = steps.groupBy("track").agg(F.percentile("gap", 0.5).alias("mid"))
    steps = steps.join(mid, "track").withColumn("k", F.bround(F.col("gap") / F.col("mid")).cast("int"))
    exact = F.col("k").between(2, factor) & (F.abs(F.col("gap") / (F.col("k") * F.col("mid")) - 1) <= tolerance)
    steps = steps.withColumn("k", F.when(exact, F.col("k")))
    new = F.coalesce(~F.col("k").eqNullSafe(F.lag("k").over(w)), F.lit(True)) | (F.row_number().over(w) == 1)
    steps = steps.withColumn("__id", island_id(new, w)).withColumn("n", F.count("*").over(Window.partitionBy("track", "__id")))
    more = F.when(F.col("k").isNotNull() & (F.col("n") >= run), F.col("k")).otherwise(1)
    out = steps.withColumn("parts", more).select("track", "t", "gap", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"))
    return out.select("track", F.when(F.col("i") == 0, F.col("t")).otherwise(F.col("t") + F.col("gap") * F.col("i") / F.col("parts")).alias("t"), (F.col("i") > 0).alias("implied"))


def insert_implied(beats: DataFrame, longest: int = 8) -> DataFrame:
    """(track, t, implied): beats, with round(gap / median) - 1 even ones in each gap, if that is `longest` or fewer."""
    w = by("track", "t")
    steps = beats.select("track", "t", (F.lead("t").over(w) - F.col("t")).alias("gap"))
    mid = steps.groupBy("track").agg(F.percentile("gap", 0.5).alias("mid"))
    n = F.coalesce(F.bround(F.col("gap") / F.col("mid")).cast("int"), F.lit(1))
    steps = steps.join(mid, "track").withColumn("n", F.when((n >= 2) & (n - 1 <= longest), n).otherwise(1))
    out = steps.select("track", "t", "gap", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    return out.select("track", F.when(F.col("i") == 0, F.col("t")).otherwise(F.col("t") + F.col("gap") * F.col("i") / F.col("n")).alias("t"), (F.col("i") > 0).alias("implied"))


def merge_touching(notes: DataFrame, touch: float, keys: list[str]) -> DataFrame:
    """Chains of rows of equal keys, each starting within `touch` of the last one's end, as one: first onset, last end, row count."""
    w = by(keys, "onset", "note_id")
    ended = F.lag(F.col("onset") + F.col("duration")).over(w)
    c = notes.withColumn("__id", island_id(F.coalesce(F.abs(F.col("onset") - ended) > touch, F.lit(True)), w))
    out = c.groupBy(*keys, "__id").agg(F.min("onset").alias("onset"), F.max(F.col("onset") + F.col("duration")).alias("end"), F.count("*").alias("joined"))
    return out.drop("__id")


def absorb_lead_ins(notes: DataFrame, longest: float) -> DataFrame:
    """(track, onset, pitch, graces): each chain of notes no longer than `longest` goes into the note after it, with its onset."""
    w = by("track", "onset", "note_id")
    short = F.col("duration") <= longest
    ends = notes.withColumn("__short", short).withColumn("__id", F.coalesce(F.sum(F.when(~short, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    g = ends.groupBy("track", "__id").agg(F.min("onset").alias("onset"), F.max_by("pitch", F.struct("onset", "note_id")).alias("pitch"), (F.count("*") - 1).alias("graces"), F.min("__short").alias("open"))
    return g.select("track", "onset", "pitch", "graces", "open")
