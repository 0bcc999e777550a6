"""Neighbourhood operators: centred medians, outliers, lags, folds and what follows from the next row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .islands import by


def median_smooth(frames: DataFrame, half: int) -> DataFrame:
    """frames with `smooth`: the median of the pitches within `half` frames; null where there is no pitch."""
    w = by("track", "frame").rowsBetween(-half, half)
    return frames.withColumn("smooth", F.when(F.col("pitch").isNotNull(), F.percentile("pitch", 0.5).over(w)))


def reject_line_outliers(notes: DataFrame, window: float, floor: float, loudness: str | None = None, quiet: float = 0.0) -> DataFrame:
    """notes without those more than `floor` below the median pitch of all notes within `window` of theirs, or more than `quiet` below
    their median of the column `loudness`. A floor of 0 is no test."""
    near = f"over (partition by track order by onset range between {window:f}d preceding and {window:f}d following)"
    out = notes.withColumn("__mid", F.expr(f"percentile(pitch, 0.5) {near}"))
    keep = F.lit(True) if floor <= 0 else F.col("pitch") >= F.col("__mid") - floor
    if loudness is not None and quiet > 0:
        out = out.withColumn("__loud", F.expr(f"percentile(`{loudness}`, 0.5) {near}"))
        keep &= F.round(F.col(loudness) - F.col("__loud"), 9) >= -quiet
    return out.where(keep).drop("__mid", "__loud")


def fold_octaves(notes: DataFrame, context: int = 2) -> DataFrame:
    """notes with `folded`: pitch moved an octave towards the median of `context` rows either side, if 11 to 13 away from it."""
    w = by("track", "onset", "note_id")
    near = F.concat(F.collect_list("pitch").over(w.rowsBetween(-context, -1)), F.collect_list("pitch").over(w.rowsBetween(1, context)))
    out = notes.withColumn("__near", F.array_sort(near)).withColumn("__n", F.size("__near"))
    at = lambda i: F.try_element_at("__near", i.cast("int"))
    mid = (at(F.floor((F.col("__n") + 1) / 2)) + at(F.floor((F.col("__n") + 2) / 2))) / 2
    off = F.col("pitch") - mid
    return out.withColumn("folded", F.when((F.col("__n") > 0) & F.abs(off).between(11, 13), F.col("pitch") - F.signum(off).cast("int") * 12).otherwise(F.col("pitch"))).drop("__near", "__n")


def line_lag(candidates: DataFrame, window: int = 4, cap: float = 0.2, floor: float = 0.08, least: int = 3, pushed: float = 0.88, early: float = 0.35) -> DataFrame:
    """(track, beat_idx, lag) from (track, beat_idx, phase), one row an onset: the median of candidates within `window` beats.

    Candidates of a beat: its first phase, if `early` or less, and its last less 1, if `pushed` or more. None with fewer than
    `least`, below the floor, or if the beat before has a pushed onset; no more than the cap or the first phase; only positive.
    """
    per = candidates.groupBy("track", "beat_idx").agg(F.min("phase").alias("first"), F.max("phase").alias("last"))
    cand = F.filter(F.array(F.when(F.col("first") <= early, F.col("first")), F.when(F.col("last") >= pushed, F.col("last") - 1)), lambda x: x.isNotNull())
    each = per.select("track", "beat_idx", F.explode(cand).alias("c")).withColumn("own", F.lit(0))
    rows = each.unionByName(per.select("track", "beat_idx", F.lit(None).cast("double").alias("c"), F.lit(1).alias("own")))
    near = by("track", "beat_idx").rangeBetween(-window, window)
    rows = rows.withColumn("mid", F.percentile("c", 0.5).over(near)).withColumn("n", F.count("c").over(near)).where("own = 1")
    before = F.max("last").over(by("track", "beat_idx").rangeBetween(-1, -1))
    out = per.withColumn("before", before).join(rows.select("track", "beat_idx", "mid", "n"), ["track", "beat_idx"])
    ok = (F.col("n") >= least) & (F.col("mid") >= max(floor, 1e-9)) & (F.coalesce(F.col("before"), F.lit(0.0)) < pushed)
    return out.where(ok).select("track", "beat_idx", F.least(F.lit(cap), "mid", "first").alias("lag")).where("lag > 0")


def velocities(notes: DataFrame) -> DataFrame:
    """notes with `rank`: confidence as a percentile rank within the track, ties low; 0 for a single note."""
    return notes.withColumn("rank", F.percent_rank().over(by("track", "confidence")))


def without_overlap(notes: DataFrame, tick: float = 1e-6) -> DataFrame:
    """notes cut at the next onset of the track; those that leave nothing, or share a later note's onset, go."""
    w = by("track", "onset", "note_id")
    cut = F.least(F.col("duration"), F.coalesce(F.lead("onset").over(w) - F.col("onset"), F.col("duration")))
    return notes.withColumn("duration", cut).where(F.col("duration") > tick)


def close_short_gaps(notes: DataFrame, rest: float, tick: float = 1e-6) -> DataFrame:
    """notes, lengthened to the next onset where what is between is longer than a tick and shorter than `rest`."""
    gap = F.lead("onset").over(by("track", "onset", "note_id")) - F.col("onset")
    left = gap - F.col("duration")
    return notes.withColumn("duration", F.when((left > tick) & (left < rest - tick), gap).otherwise(F.col("duration")))


def placement_errors(points: DataFrame, x: str, y: str) -> DataFrame:
    """points with `error`: y less what its neighbours give at x by a straight line; null at the ends."""
    w = by("track", x)
    x0, y0, x1, y1 = F.lag(x).over(w), F.lag(y).over(w), F.lead(x).over(w), F.lead(y).over(w)
    return points.withColumn("error", F.when(x1 > x0, F.col(y) - (y0 + (y1 - y0) * (F.col(x) - x0) / (x1 - x0))))


def rolling_mode(rows: DataFrame, value: str, order: list[str], half: int) -> DataFrame:
    """rows with `mode`: the most frequent value within `half` rows of the track, ties to the smaller."""
    w = by("track", *order).rowsBetween(-half, half)
    seen = rows.withColumn("__v", F.collect_list(value).over(w))
    counted = F.transform(F.array_distinct("__v"), lambda v: F.struct(F.size(F.filter("__v", lambda u: u == v)).alias("n"), (-v).alias("v")))
    return seen.withColumn("mode", -F.array_max(counted)["v"]).drop("__v")


def line_events(notes: DataFrame) -> DataFrame:
    """(track, onset, duration): one event an onset, the longest, cut at the next onset."""
    one = notes.groupBy("track", F.round("onset", 6).alias("onset")).agg(F.max("duration").alias("duration"))
    gap = F.lead("onset").over(by("track", "onset")) - F.col("onset")
    return one.withColumn("duration", F.least("duration", F.coalesce(gap, F.col("duration"))))


def edge_period(beats: DataFrame, k: int = 8) -> DataFrame:
    """(track, first, last): the upper median of the first and last k positive intervals."""
    w = by("track", "t")
    steps = beats.select("track", "t", (F.lead("t").over(w) - F.col("t")).alias("gap")).where("gap > 0")
    up, down = F.row_number().over(w), F.row_number().over(by("track", F.desc("t")))
    steps = steps.withColumn("__i", up).withColumn("__j", down)

    def upper(which: str):  # noqa: ANN202
        values = F.array_sort(F.collect_list(F.when(F.col(which) <= k, F.col("gap"))))
        return F.element_at(values, F.floor(F.size(values) / 2).cast("int") + 1)

    return steps.groupBy("track").agg(upper("__i").alias("first"), upper("__j").alias("last"))


def middle(values: str) -> Column:
    """The median of a sorted array without nulls; null of an empty one."""
    half = F.size(values) / 2
    return (F.get(values, F.ceil(half).cast("int") - 1) + F.get(values, F.floor(half).cast("int"))) / 2


def with_reference_pulse(steps: DataFrame, half: int = 8, least: int = 3) -> DataFrame:
    """steps (track, t, gap, ...) with pulse: intervals over the modal one made comparable, then their centred median; the modal one
    with fewer; null where gap is. A track's rows are dealt once."""
    bins = steps.where("gap is not null").groupBy("track", F.bround("gap", 2).alias("b")).count()
    seed = bins.groupBy("track").agg(F.max_by("b", F.struct("count", -F.col("b"))).alias("__seed"))
    r = F.col("gap") / F.col("__seed")
    v = F.when(r >= 0.75, F.col("gap") / F.bround(r)).when(F.abs(r / 0.5 - 1) <= 0.15, F.col("gap") * 2)
    near = by("track", "t").rowsBetween(-half, half)
    out = steps.join(seed, "track", "left").withColumn("__v", v).withColumn("__v", F.sort_array(F.collect_list("__v").over(near)))
    pulse = F.when(F.size("__v") >= least, middle("__v")).otherwise(F.col("__seed"))
    return out.withColumn("pulse", F.when(F.col("gap").isNotNull(), pulse)).drop("__v", "__seed")


def reference_pulse(beats: DataFrame, half: int = 8, least: int = 3) -> DataFrame:
    """(track, t, pulse) of with_reference_pulse(), of all intervals."""
    steps = beats.select("track", "t", (F.lead("t").over(by("track", "t")) - F.col("t")).alias("gap"))
    return with_reference_pulse(steps, half, least).where("gap is not null").select("track", "t", "pulse")


def flag_peaks(frames: DataFrame, value: str, half: int, above: float, name: str, edges: bool = True) -> DataFrame:
    """frames with `name`: whether the value is the largest of its neighbours' and `above` or more over the mean within `half` frames;
    without edges, not in a track's first or last frame."""
    w = by("track", "frame")
    v = F.col(value)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    mean = F.avg(value).over(w.rowsBetween(-half, half))
    top = (v >= F.coalesce(before, v)) & (v > F.coalesce(after, v - 1)) if edges else F.coalesce((v >= before) & (v > after), F.lit(False))
    return frames.withColumn(name, top & (v >= mean + above))


def peaks(frames: DataFrame, value: str, half: int, above: float, edges: bool = True) -> DataFrame:
    """The frames that flag_peaks() finds."""
    return flag_peaks(frames, value, half, above, "__ok", edges).where("__ok").drop("__ok")
