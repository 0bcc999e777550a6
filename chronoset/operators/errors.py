"""Why a note was missed or made up: ladders of rules over what sounds at its time.

Reference and estimate are notes of a recording (rec, id, onset, duration, pitch); frames are (rec, t, f0, periodicity, live_level).
Every fact is an interval or band join on the recording and a cell of time, aggregated to one row a note.
Fixed values: the names of the classes, and which rule goes before which.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio as quotient
from .islands import by, island_id
from .joins import band_join, stabbing_join
from .lineage import settled


def _octave(step: Column) -> Column:
    return F.abs(step).isin(12, 24)


def frame_facts(notes: DataFrame, frames: DataFrame, lead: float, shortest: float, voiced: float, floor: float, agree: float, cell: float = 1.0) -> DataFrame:
    """(id, frames, most, energetic, live, at_ref, run, live_f0, level) of notes that have frames within their window.

    energetic, live and at_ref are shares of frames; run is the longest run of frames at the note's pitch; live_f0 is the median of
    frames that are loud and voiced. Frames of one time follow one another by f0, periodicity and level, so a run doesn't depend on
    how rows are dealt.
    """
    n = notes.select(F.col("rec").alias("n_rec"), "id", "pitch", (F.col("onset") - lead).alias("__lo"), (F.col("onset") + F.greatest("duration", F.lit(shortest))).alias("__hi"))
    at = stabbing_join(frames, n, [("rec", "n_rec")], "t", ("__lo", "__hi"), cell)
    loud, heard = F.col("level") >= floor, F.col("periodicity") >= voiced
    same = F.coalesce(F.abs(F.col("f0") - F.col("pitch")) <= agree, F.lit(False))
    at = at.withColumn("same", same).withColumn("spell", island_id(~F.col("same"), by("id", "t", "f0", "periodicity", "level")))
    runs = at.where("same").groupBy("id", "spell").count().groupBy("id").agg(F.max("count").alias("run"))
    facts = at.groupBy("id").agg(
        F.count("*").alias("frames"), F.max("periodicity").alias("most"), F.avg(loud.cast("double")).alias("energetic"), F.avg((loud & heard).cast("double")).alias("live"),
        F.avg(F.col("same").cast("double")).alias("at_ref"), F.percentile(F.when(loud & heard, F.col("f0")), 0.5).alias("live_f0"), F.avg("level").alias("level"),
    )
    return facts.join(runs, "id", "left").withColumn("run", F.coalesce("run", F.lit(0)))


#: A note's first moments are its attack: what begins within them is struck with it, not covered by it.
ATTACK = 0.05


def covering(points: DataFrame, notes: DataFrame, slack: float, attack: float = ATTACK, cell: float = 1.0) -> DataFrame:
    """(id, same, cover_id, cover_pitch, cover_end) of points that notes cover, from after their attack up to their end and slack.

    A note of the point's own pitch goes first, then the one that begins first (of those, the least id).
    """
    end = F.col("onset") + F.col("duration")
    spans = notes.select(F.col("rec").alias("c_rec"), F.col("id").alias("c_id"), F.col("pitch").alias("c_pitch"), F.col("onset").alias("c_on"), (F.col("onset") + attack).alias("c_lo"), end.alias("c_end"), (end + slack).alias("c_hi"))
    met = stabbing_join(points.select("rec", "id", "onset", "pitch"), spans, [("rec", "c_rec")], "onset", ("c_lo", "c_hi"), cell, right=True)
    same = F.col("c_pitch") == F.col("pitch")
    best = F.min(F.struct((~same).alias("other"), "c_on", "c_id", "c_pitch", "c_end")).alias("b")
    return met.groupBy("id").agg(best).select("id", (~F.col("b.other")).alias("same"), F.col("b.c_id").alias("cover_id"), F.col("b.c_pitch").alias("cover_pitch"), F.col("b.c_end").alias("cover_end"))


def line_median(points: DataFrame, notes: DataFrame, window: float, least: int = 3) -> DataFrame:
    """(id, line): the median pitch of notes within the window, of `least` or more."""
    near = band_join(points.select("rec", "id", "onset"), notes.select(F.col("rec").alias("l_rec"), F.col("onset").alias("l_on"), F.col("pitch").alias("l_pitch")), [("rec", "l_rec")], "onset", "l_on", window)
    return near.groupBy("id").agg(F.when(F.count("*") >= least, F.percentile("l_pitch", 0.5)).alias("line"))


def classify_miss(missed: DataFrame, estimate: DataFrame, facts: DataFrame, heard: DataFrame, silent: float, voiced: float, shortest: float, hop: float, register: float, window: float, agree: float) -> DataFrame:
    """(id, class) of missed reference notes. facts: frame_facts(); heard: ids that another detector has."""
    out = missed.join(covering(missed, estimate, 0.0), "id", "left").join(facts, "id", "left").join(line_median(missed, estimate, window), "id", "left")
    out = out.join(heard.select("id", F.lit(True).alias("heard")), "id", "left")
    off = F.abs(F.col("live_f0") - F.col("pitch"))
    frames = round(shortest / hop)
    rule = (
        F.when(F.col("same"), "merged")
        .when(F.col("cover_id").isNotNull() & (F.col("cover_end") - F.col("onset") >= shortest), "absorbed").when(F.col("cover_id").isNotNull(), "squeezed")
        .when(F.col("heard"), "not_picked").when(F.col("level") < silent, "left_stem")
        .when(F.col("frames").isNull(), "unclassified").when(F.col("energetic") == 0, "gated").when(F.col("most") < voiced, "unvoiced").when(F.col("live") == 0, "gated")
        .when(F.col("run").between(1, frames - 1), "too_short").when((F.col("run") >= frames) & (F.col("pitch") < F.col("line") - register), "dropped_register").when(F.col("run") >= frames, "dropped")
        .when((F.abs(off - 12) <= agree) | (F.abs(off - 24) <= agree), "tracked_octave").when(F.col("live_f0").isNotNull(), "tracked_other").otherwise("unclassified")
    )
    return out.select("id", rule.alias("class"))


def classify_extra(extra: DataFrame, reference: DataFrame, other: DataFrame, slack: float, register: float, window: float, tolerance: float, ratio: float, gap: float) -> DataFrame:
    """(id, class) of notes of ours that no reference note matches. other: notes of another stem, with confidence as have `extra`.

    Beside a confidence of 0 another stem's note is louder without bound, whatever its own."""
    stem = other.select(F.col("rec").alias("s_rec"), F.col("pitch").alias("s_pitch"), F.col("onset").alias("s_on"), F.col("confidence").alias("s_conf"))
    beside = band_join(extra.select("rec", "id", "onset", "pitch", "confidence"), stem, [("rec", "s_rec"), ("pitch", "s_pitch")], "onset", "s_on", tolerance)
    beside = beside.groupBy("id").agg(quotient(F.max("s_conf"), F.first("confidence")).alias("ratio"))
    # the gap of the reference around each note: the last onset up to it and the first after it
    both = reference.select("rec", F.lit(None).cast("long").alias("id"), "onset", F.lit(0).alias("side")).union(extra.select("rec", "id", "onset", F.lit(1)))
    w = by("rec", "onset", "side", "id")
    ref = F.when(F.col("side") == 0, F.col("onset"))
    around = both.withColumn("before", F.last(ref, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.first(ref, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    around = around.where("side = 1").select("id", "before", "after")
    out = extra.join(covering(extra, reference, slack), "id", "left").join(line_median(extra, reference, window), "id", "left").join(beside, "id", "left").join(around, "id")
    step = F.col("pitch") - F.col("cover_pitch")
    rule = (
        F.when(F.col("same"), "split_sustain").when(F.col("pitch") < F.col("line") - register, "bleed_register").when(F.col("ratio") >= ratio, "bleed_cross_stem")
        .when(_octave(step), "fragment_octave").when(F.abs(step).isin(1, 2), "fragment_neighbour").when(F.col("cover_id").isNotNull(), "fragment_other")
        .when(F.col("after") - F.col("before") >= gap, "between_phrases").when(F.col("before").isNotNull() & F.col("after").isNotNull(), "between_notes")
        .when(F.col("before").isNotNull() | F.col("after").isNotNull(), "between_phrases").otherwise("unclassified")
    )
    return out.select("id", rule.alias("class"))


def classify_pairs(pairs: DataFrame, estimate: DataFrame, tolerance: float, slack: float) -> DataFrame:
    """(ref_id, est_id, class, body_id) of pairs (rec, ref_id, est_id, ref_onset, ref_duration, ref_pitch, est_onset, est_pitch).

    An unequal pitch with a later note of ours at the reference pitch, which begins within the reference note (its end and slack
    included), is the attack split off; body_id is the first such note.
    """
    body = estimate.select(F.col("rec").alias("b_rec"), F.col("pitch").alias("b_pitch"), F.col("onset").alias("b_on"), F.col("id").alias("b_id"))
    p = pairs.withColumn("__end", F.col("ref_onset") + F.col("ref_duration") + slack)
    spans = p.where("ref_pitch != est_pitch").select("rec", "ref_pitch", "ref_id", "est_id", F.col("est_onset").alias("__from"), F.col("__end").alias("__to"))
    later = stabbing_join(body, spans, [("b_rec", "rec"), ("b_pitch", "ref_pitch")], "b_on", ("__from", "__to"), 1.0, right=True)
    later = later.groupBy("ref_id", "est_id").agg(F.min(F.struct("b_on", "b_id")).alias("body"))
    dt, step = F.col("est_onset") - F.col("ref_onset"), F.col("est_pitch") - F.col("ref_pitch")
    rule = (
        F.when((step == 0) & (F.abs(dt) <= tolerance), "unaligned").when((step == 0) & (dt > 0), "timing_late").when(step == 0, "timing_early").when(F.col("body").isNotNull(), "attack_transient")
        .when(F.abs(dt) > tolerance, "loose").when(_octave(step), "octave").when(F.abs(step).isin(1, 2), "neighbour").otherwise("other_pitch")
    )
    return p.join(later, ["ref_id", "est_id"], "left").select("ref_id", "est_id", rule.alias("class"), F.col("body.b_id").alias("body_id"))


def classify_all(reference: DataFrame, estimate: DataFrame, hits: DataFrame, pairs: DataFrame, misses: Callable[[DataFrame], DataFrame], extras: Callable[[DataFrame], DataFrame], tolerance: float, slack: float) -> DataFrame:
    """(rec, population, ref_id, est_id, class) of every note of either side: hit, pair, miss or extra.

    hits and pairs are (ref_id, est_id), of notes that occur in one of them at most, once; misses and extras classify what is left, as
    (id, class). The body behind an attack that was split off is the same fault: an extra that is one and would be a split sustain is
    body_late.
    """
    r = reference.select("rec", F.col("id").alias("ref_id"), F.col("onset").alias("ref_onset"), F.col("duration").alias("ref_duration"), F.col("pitch").alias("ref_pitch"))
    e = estimate.select(F.col("id").alias("est_id"), F.col("onset").alias("est_onset"), F.col("pitch").alias("est_pitch"))
    judged = settled(classify_pairs(settled(pairs.join(r, "ref_id").join(e, "est_id")), estimate, tolerance, slack))
    left = lambda notes, side: notes.join(hits.select(F.col(side).alias("id")).union(pairs.select(F.col(side).alias("id"))), "id", "left_anti")
    bodies = judged.where("body_id is not null").select(F.col("body_id").alias("id"), F.lit(True).alias("body")).distinct()
    late = F.when(F.col("body") & (F.col("class") == "split_sustain"), "body_late").otherwise(F.col("class"))
    over = extras(left(estimate, "est_id")).join(bodies, "id", "left").select("id", late.alias("class"))
    none = F.lit(None).cast("long")
    rows = hits.select(F.lit("hit").alias("population"), "ref_id", "est_id", F.lit("hit").alias("class")).union(judged.select(F.lit("pair"), "ref_id", "est_id", "class"))
    rows = rows.union(misses(left(reference, "ref_id")).select(F.lit("miss"), "id", none, "class")).union(over.select(F.lit("extra"), none, "id", "class"))
    recs = reference.select("id", "rec").union(estimate.select("id", "rec"))
    return rows.withColumn("id", F.coalesce("ref_id", "est_id")).join(recs, "id").select("rec", "population", "ref_id", "est_id", "class")


def deficit(rows: DataFrame) -> DataFrame:
    """(rec, population, class, n, part) of classify_all(): what each class takes of 1 - F1, in which a pair counts for both sides."""
    n = rows.groupBy("rec", "population", "class").agg(F.count("*").alias("n"))
    weight = F.when(F.col("population").isin("hit", "pair"), 2).otherwise(1)
    all_ = F.sum(F.col("n") * weight).over(Window.partitionBy("rec"))
    return n.withColumn("part", F.col("n") * weight / all_).where("population != 'hit'").select("rec", "population", "class", "n", "part")
