"""From phases to written rhythm: grids, signatures, bars and ties; and how two readings of one line differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .islands import by


def choose_grid(phased: DataFrame, grids: tuple[int, ...] = (2, 4, 3, 8, 6, 12), slack: float = 0.05) -> DataFrame:
    """(track, beat_idx, grid, error, n): for each beat the first grid whose mean snap error is within the slack of the best.

    A grid must keep the beat's onsets apart: as many places as onsets, if any grid does; else the finest is taken.
    """
    per = phased.groupBy("track", "beat_idx").agg(F.array_sort(F.collect_list("phase")).alias("p"))
    each = per.select("track", "beat_idx", "p", F.posexplode(F.array(*[F.lit(g) for g in grids])).alias("rank", "grid"))
    near = F.transform("p", lambda x: F.bround(x * F.col("grid")) / F.col("grid"))
    error = F.aggregate(F.zip_with("p", near, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / F.size("p")
    each = each.withColumn("apart", F.size(F.array_distinct(near)) == F.size("p")).withColumn("error", F.round(error, 9))
    own = Window.partitionBy("track", "beat_idx")
    each = each.withColumn("best", F.min(F.when(F.col("apart"), F.col("error"))).over(own))
    fits = F.col("apart") & (F.col("error") <= F.col("best") + slack)
    picked = each.groupBy("track", "beat_idx").agg(F.min(F.when(fits, F.struct("rank", "grid", "error"))).alias("x"), F.max_by(F.struct("grid", "error"), "grid").alias("y"), F.first(F.size("p")).alias("n"))
    return picked.select("track", "beat_idx", F.coalesce("x.grid", "y.grid").alias("grid"), F.coalesce("x.error", "y.error").alias("error"), "n")


def quantize(phased: DataFrame, grids: DataFrame, pulses: int = 4) -> DataFrame:
    """phased rows with bar, beat (on the beat's grid, in the bar) and residual, in beats; replay() gives the time back."""
    out = phased.join(grids.select("track", "beat_idx", "grid"), ["track", "beat_idx"])
    near = F.bround(F.col("phase") * F.col("grid")) / F.col("grid")
    at = F.col("beat_idx") + near
    return out.withColumn("bar", F.floor(at / pulses).cast("long")).withColumn("beat", at - F.floor(at / pulses) * pulses).withColumn("residual", F.col("phase") - near)


def replay(quantized: DataFrame, pulses: int = 4) -> Column:
    """The position in beats of quantized rows."""
    return F.col("bar") * pulses + F.col("beat") + F.col("residual")


def onset_signatures(phased: DataFrame, bins: int = 12) -> DataFrame:
    """(track, beat_idx, signature): O where a bin of the beat has an onset, a dot where not."""
    per = phased.groupBy("track", "beat_idx").agg(F.collect_set(F.floor(F.col("phase") * bins).cast("int")).alias("at"))
    tokens = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.when(F.array_contains("at", k), "O").otherwise("."))
    return per.select("track", "beat_idx", F.array_join(tokens, "").alias("signature"))


def split_at_bars(notes: DataFrame, start: str, length: str, bar: float) -> DataFrame:
    """Each row once for each bar it reaches: bar_no, at (in the bar), size, tied_in, tied_out."""
    lo, hi = F.col(start), F.col(start) + F.col(length)
    out = notes.withColumn("bar_no", F.explode(F.sequence(F.floor(lo / bar), F.greatest(F.floor(lo / bar), F.ceil(hi / bar) - 1))))
    a, b = F.greatest(lo, F.col("bar_no") * bar), F.least(hi, (F.col("bar_no") + 1) * bar)
    return out.withColumn("at", a - F.col("bar_no") * bar).withColumn("size", b - a).withColumn("tied_in", F.col("bar_no") * bar > lo).withColumn("tied_out", (F.col("bar_no") + 1) * bar < hi)


def pair_class(delta: Column, ref: Column, est: Column, late: float, early: float) -> Column:
    """The first rule that fires on a matched pair: delta = estimate - reference, in time."""
    step = F.abs(est - ref)
    return (
        F.when((step == 0) & (delta > late), "timing_late").when((step == 0) & (delta < -early), "timing_early").when(step == 0, "loose")
        .when(F.pmod(step, F.lit(12)) == 0, "octave").when(step <= 2, "neighbour").otherwise("other_pitch")
    )


def grid_votes(rows: DataFrame, keys: list[str], place: str, pulses: int, least: int = 4, share: float = 0.5) -> DataFrame:
    """(keys, phase, votes, share, trusted): the place modulo the pulses that most rows have, ties to the smaller."""
    votes = rows.groupBy(*keys, F.pmod(F.col(place), F.lit(pulses)).alias("phase")).agg(F.count("*").alias("n"))
    out = votes.groupBy(*keys).agg(F.max_by("phase", F.struct("n", -F.col("phase"))).alias("phase"), F.max("n").alias("votes"), F.sum("n").alias("all"))
    part = F.col("votes") / F.col("all")
    return out.select(*keys, "phase", "votes", part.alias("share"), ((F.col("all") >= least) & (part >= share)).alias("trusted"))


def mark_lead_ins(notes: DataFrame, longest: float, touch: float, times: float = 3.0) -> DataFrame:
    """notes with lead_in: short, touching the next one, which is of the same pitch or a step up and `times` as long; stretched to it."""
    w = by("track", "onset", "note_id")
    nxt, pitch, size = F.lead("onset").over(w), F.lead("pitch").over(w), F.lead("duration").over(w)
    ok = (F.col("duration") <= longest) & (F.abs(nxt - F.col("onset") - F.col("duration")) <= touch) & (pitch - F.col("pitch")).isin(0, 1) & (size >= times * F.col("duration"))
    out = notes.withColumn("lead_in", F.coalesce(ok, F.lit(False))).withColumn("__next", nxt)
    return out.withColumn("duration", F.when(F.col("lead_in"), F.col("__next") - F.col("onset")).otherwise(F.col("duration"))).drop("__next")


def polyphony(notes: DataFrame, keys: list[str], window: float) -> DataFrame:
    """(keys, share): of consecutive onsets within the window, how many overlap."""
    w = by(keys, "onset", "note_id")
    gap, ended = F.col("onset") - F.lag("onset").over(w), F.lag(F.col("onset") + F.col("duration")).over(w)
    near = notes.withColumn("near", gap <= window).withColumn("both", (gap <= window) & (ended > F.col("onset")))
    return near.groupBy(*keys).agg(F.when(F.count_if("near") > 0, F.count_if("both") / F.count_if("near")).alias("share"))


def route(levels: DataFrame, least: float = 0.6, margin: float = 1.0) -> DataFrame:
    """(track, lead, share, margin, call) from (track, stem, level, share): which stem leads, if it is clear."""
    w = Window.partitionBy("track").orderBy(F.desc("share"), F.desc("level"), "stem")
    top = levels.withColumn("k", F.row_number().over(w)).withColumn("rival", F.lead("level").over(w)).where("k = 1")
    gap = F.col("level") - F.col("rival")
    call = F.when((F.col("share") >= least) & (gap >= margin), "lead").when(F.col("share") >= least, "comping").when(gap >= margin, "mixed").otherwise("unsure")
    return top.select("track", F.col("stem").alias("lead"), "share", gap.alias("margin"), call.alias("call"))


def best_span(records: DataFrame, spans: DataFrame, cell: float, floor: float = 0.5) -> DataFrame:
    """(record, span, iou): of spans that share `floor` of the shorter with a record, the one of largest intersection over union.

    records: (key, record, r0, r1); spans: (skey, span, s0, s1).
    """
    from .joins import interval_join

    both = interval_join(records, spans, [("key", "skey")], ("r0", "r1"), ("s0", "s1"), cell)
    shared = F.least("r1", "s1") - F.greatest("r0", "s0")
    iou = shared / (F.greatest("r1", "s1") - F.least("r0", "s0"))
    kept = both.where(shared >= floor * F.least(F.col("r1") - F.col("r0"), F.col("s1") - F.col("s0"))).withColumn("iou", F.round(iou, 9))
    return kept.groupBy("record").agg(F.max_by("span", F.struct("iou", -F.col("span"))).alias("span"), F.max("iou").alias("iou"))


def narrowest_cover(spans: DataFrame, wanted: DataFrame, cell: float) -> DataFrame:
    """(want, span): the shortest span that covers each wanted stretch; spans (skey, span, s0, s1), wanted (key, want, w0, w1)."""
    from .joins import stabbing_join

    held = stabbing_join(wanted, spans, [("key", "skey")], "w0", ("s0", "s1"), cell).where("s1 >= w1")
    return held.groupBy("want").agg(F.min_by("span", F.struct(F.round(F.col("s1") - F.col("s0"), 9), "span")).alias("span"))
