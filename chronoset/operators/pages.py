"""Written music: notated positions and lengths, figures, scraps, beams, and how two writings of one line agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .islands import by, island_id
from .windows import rolling_mode

TICK = 1e-6


def position(bar: Column, beat: Column, tatum: Column, division: Column, period: Column) -> Column:
    """Beats from the line of bar 0, with beat and tatum from 1."""
    return bar * period + (beat - 1) + (tatum - 1) / division


def one_metre(rows: DataFrame) -> DataFrame:
    """(melid, bar_length, n, first, last) of melodies whose every row has one period and the denominator 4; rows: melid, bar, beat, period, denom."""
    at = (F.col("bar") - 1) * F.col("period") + F.col("beat")
    m = rows.groupBy("melid").agg(F.count_distinct("period", "denom").alias("metres"), F.min("denom").alias("denom"), F.min("period").alias("bar_length"), F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))
    return m.where("metres = 1 and denom = 4").select("melid", "bar_length", "n", "first", "last")


def written_length(beat: Column, length: Column, gap: Column, fill: float, cap: float, hold: int, close: float, held: float = 1.5) -> Column:
    """The length, or the gap to the next note where it is no longer than the cap, is filled to that part, runs from a beat to a beat
    within `hold`, or leaves a rest of at most `close` after a note of `held` beats or more."""
    near = lambda x, y: F.abs(x - y) <= TICK
    to_beat = near(beat, F.bround(beat)) & near(gap, F.bround(gap)) & F.bround(gap).between(1, hold)
    rest = gap - length
    short = (rest > TICK) & (rest <= close + TICK) & (length >= held - TICK)
    return F.when((gap > TICK) & ((gap <= cap + TICK) | (length >= fill * gap) | to_beat | short), gap).otherwise(length)


def staccato(beat: Column, length: Column, gap: Column, longest: float = 0.5, bar: float = 4.0) -> Column:
    """A short note on an eighth with a quarter's room before the next one, that stays in its bar as a quarter."""
    room = F.coalesce(gap, F.lit(1e9)) >= 2 * longest - TICK
    return (length <= longest + TICK) & room & (F.abs(beat * 2 - F.bround(beat * 2)) <= TICK) & (beat + 2 * longest <= bar + TICK)


def isolated_lags(per_beat: DataFrame, most: int, low: float, high: float, pushed: float, before: float, cap: float) -> DataFrame:
    """(track, beat_idx, lag) from (track, beat_idx, n, first, last): beats of few notes whose first is late and whose last isn't
    pushed, after a beat without a note that may be written on their line."""
    was = F.max("last").over(by("track", "beat_idx").rangeBetween(-1, -1))
    ok = (F.col("n") <= most) & F.col("first").between(low, high) & (F.col("last") < pushed) & (F.coalesce("was", F.lit(0.0)) < before)
    return per_beat.withColumn("was", was).where(ok).select("track", "beat_idx", F.least(F.lit(cap), "first").alias("lag"))


def quarter_triplets(phases: DataFrame, end: float, first: float, gap: tuple[float, float], ratio: float) -> DataFrame:
    """(track, unit, a, b, triplet): halves of a bar with three onsets before `end`, the first by `first`; a and b are the gaps."""
    each = phases.select("track", F.explode(F.array(F.struct(F.col("beat_idx").alias("unit"), F.col("phase").alias("x")), F.struct((F.col("beat_idx") - 1).alias("unit"), (F.col("phase") + 1.0).alias("x")))).alias("p")).select("track", "p.unit", "p.x")
    v = each.where((F.col("x") < end) & (F.col("unit") >= 0) & (F.col("unit") % 2 == 0)).groupBy("track", "unit").agg(F.array_sort(F.collect_list("x")).alias("v"))
    v = v.where((F.size("v") == 3) & (F.element_at("v", 1) <= first))
    v = v.withColumn("a", F.element_at("v", 2) - F.element_at("v", 1)).withColumn("b", F.element_at("v", 3) - F.element_at("v", 2))
    even = (F.greatest("a", "b") / F.least("a", "b") <= ratio) & F.col("a").between(*gap) & F.col("b").between(*gap)
    return v.select("track", "unit", "a", "b", even.alias("triplet"))


def neighbours(notes: DataFrame) -> DataFrame:
    """notes with the pitch, onset and end of those before and after them in their track."""
    w = by("track", "onset", "note_id")
    end = F.col("onset") + F.col("duration")
    return notes.withColumn("before_pitch", F.lag("pitch").over(w)).withColumn("before_end", F.lag(end).over(w)).withColumn("after_pitch", F.lead("pitch").over(w)).withColumn("after_onset", F.lead("onset").over(w))


def join_bends(notes: DataFrame, widest: int, touch: float) -> DataFrame:
    """(track, onset, duration, pitch, bends): a note a few semitones from its neighbours, which share a pitch and touch it, is a
    bend; it and the note after it go into the one before."""
    end = F.col("onset") + F.col("duration")
    b = neighbours(notes)
    bend = (F.col("before_pitch") == F.col("after_pitch")) & F.abs(F.col("pitch") - F.col("before_pitch")).between(1, widest) & (F.abs(F.col("onset") - F.col("before_end")) <= touch) & (F.abs(F.col("after_onset") - end) <= touch)
    w = by("track", "onset", "note_id")
    b = b.withColumn("bend", F.coalesce(bend, F.lit(False))).withColumn("joined", F.col("bend") | F.coalesce(F.lag("bend").over(w), F.lit(False))).withColumn("held", island_id(~F.col("joined"), w))
    last = F.max(F.when(F.col("bend"), F.col("onset")).otherwise(end))
    return b.groupBy("track", "held").agg(F.min("onset").alias("onset"), (last - F.min("onset")).alias("duration"), F.min_by("pitch", F.struct("onset", "note_id")).alias("pitch"), F.count_if("bend").alias("bends")).drop("held")


def beat_agreement(pairs: DataFrame, bar: float) -> DataFrame:
    """(track, beat_offset, beat_share, on_the_bar, beat_n) of pairs (track, onset, ours, theirs): differences modulo the bar, to the
    nearest half; of equally frequent ones the first seen."""
    x = F.bround(F.pmod(F.col("ours") - F.col("theirs"), F.lit(bar)) * 2) / 2
    c = pairs.groupBy("track", F.when(x >= bar, 0.0).otherwise(x).alias("d")).agg(F.count("*").alias("n"), F.min("onset").alias("seen"))
    total = F.sum("n")
    return c.groupBy("track").agg(F.max_by("d", F.struct("n", -F.col("seen"))).alias("beat_offset"), F.round(F.max("n") / total, 6).alias("beat_share"), F.round(F.sum(F.when(F.col("d") == 0, F.col("n")).otherwise(0)) / total, 6).alias("on_the_bar"), total.alias("beat_n"))


def difference_trace(pairs: DataFrame, half: int, least: int) -> DataFrame:
    """(track, ours, before, after): where the rolling mode of the difference changes for `least` notes or more."""
    d = pairs.withColumn("x", F.bround((F.col("ours") - F.col("theirs")) * 2) / 2)
    d = rolling_mode(d, "x", ["onset", "note_id"], half).withColumn("frame", F.row_number().over(by("track", "onset", "note_id")))
    w = by("track", "frame")
    spell = d.withColumn("spell", island_id(F.coalesce(F.col("mode") != F.lag("mode").over(w), F.lit(True)), w)).groupBy("track", "spell").agg(F.min("frame").alias("frame"), F.count("*").alias("n"), F.first("mode").alias("after"))
    lasting = spell.where(F.col("n") >= least).withColumn("before", F.lag("after").over(by("track", "spell"))).where("before != after")
    return lasting.join(d.select("track", "frame", "ours"), ["track", "frame"]).select("track", "ours", "before", "after")


def bars_on_grid(origins: DataFrame, pulses: int, edge: float, least: int, floor: float) -> DataFrame:
    """(track, votes, phase, share, first, last, trusted) of origins (track, origin, i): where each match puts the page's bar one.

    The most frequent phase wins, the first seen of equals; of the votes for it, those of either edge of the page say which bar is
    first and last, and all do where an edge has none.
    """
    seen = lambda rows, key: rows.groupBy("track", key).agg(F.count("*").alias("n"), F.min("i").alias("seen"))
    top = lambda c: F.struct("n", -F.col("seen"))  # noqa: E731, ARG005
    o = origins.withColumn("phase", F.pmod("origin", F.lit(pulses)))
    best = seen(o, "phase").groupBy("track").agg(F.max_by("phase", top(None)).alias("phase"), F.max("n").alias("top"), F.sum("n").alias("votes"))
    on = o.join(best, ["track", "phase"])
    size = F.greatest(F.lit(1), F.bround(F.col("votes") * edge))
    mode = lambda rows, name: seen(rows, "origin").groupBy("track").agg(F.max_by("origin", top(None)).alias(name))
    out = best.join(mode(on, "all"), "track").join(mode(on.where(F.col("i") <= size), "head"), "track", "left").join(mode(on.where(F.col("i") > F.col("votes") - size), "tail"), "track", "left")
    share = F.col("top") / F.col("votes")
    return out.select("track", "votes", "phase", share.alias("share"), F.coalesce("head", "all").alias("first"), F.coalesce("tail", "all").alias("last"), ((F.col("votes") >= least) & (share >= floor)).alias("trusted"))


def weighted_median(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """(keys, median): the least value with half of the weight up to it."""
    by_value = rows.groupBy(*keys, F.col(value).alias("v")).agg(F.sum(weight).alias("w"))
    upto = F.sum("w").over(Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("w").over(Window.partitionBy(*keys))
    return by_value.withColumn("upto", upto).withColumn("total", total).where(F.col("upto") >= F.col("total") / 2).groupBy(*keys).agg(F.min("v").alias("median"))


def beam_marks(written: DataFrame, longest: float = 0.5) -> DataFrame:
    """(note_id, mark) of flagged notes that follow each other within a beat."""
    w = by("track", "bar", "beat", "note_id")
    b = written.withColumn("flagged", (F.col("len") <= longest) & (F.col("len") > 0)).withColumn("at", F.floor("beat"))
    on = F.col("flagged") & F.lag("flagged").over(w) & (F.lag("bar").over(w) == F.col("bar")) & (F.lag("at").over(w) == F.col("at"))
    b = b.withColumn("group", island_id(~F.coalesce(on, F.lit(False)), w))
    own = Window.partitionBy("track", "group")
    b = b.withColumn("n", F.count("*").over(own)).withColumn("k", F.row_number().over(own.orderBy("beat", "note_id"))).where("n > 1")
    return b.select("note_id", F.when(F.col("k") == 1, "begin").when(F.col("k") == F.col("n"), "end").otherwise("continue").alias("mark"))


def triplet_fit(offsets: Column, latest: float = 0.15, step: float = 0.005) -> Column:
    """(thirds, eighths): the mean distance of three onsets from a half bar's thirds, and from the nearest eighths, each at its best lag."""
    lags = F.sequence(F.lit(0), F.lit(round(latest / step)))
    at = lambda i: F.get(offsets, F.lit(i))
    mean = lambda f: F.round(F.array_min(F.transform(lags, lambda k: sum((f(at(i) - k * step, i) for i in range(3)), F.lit(0.0)) / 3)), 9)
    return F.struct(mean(lambda x, i: F.abs(x - i * 2 / 3)).alias("thirds"), mean(lambda x, i: F.abs(x - 0.5 * F.bround(x / 0.5))).alias("eighths"))


def head_triplets(notes: DataFrame, early: float, fit: float, better: float, alone_fit: float, alone_better: float) -> DataFrame:
    """(track, unit, upper, lower) of half bars that two voices play as a quarter-note triplet, from (track, voice, pos) in beats.

    Both hold three onsets that fit the thirds within `fit` and `better` times nearer than eighths; or one does within the stricter
    bounds, and the other holds none. An onset a little before a half bar is its own.
    """
    n = notes.withColumn("unit", (F.floor((F.col("pos") + early) / 2) * 2).cast("int"))
    v = n.groupBy("track", "unit", "voice").agg(F.array_sort(F.collect_list(F.round(F.col("pos") - F.col("unit"), 9))).alias("o")).withColumn("n", F.size("o"))
    v = v.withColumn("f", F.when(F.col("n") == 3, triplet_fit(F.col("o"))))
    within = lambda most, times: F.coalesce((F.col("f.thirds") <= most) & (F.col("f.eighths") >= times * F.col("f.thirds")), F.lit(False))
    v = v.withColumn("good", within(fit, better)).withColumn("alone", within(alone_fit, alone_better))
    of = lambda voice, c: F.max(F.when(F.col("voice") == voice, F.col(c)))
    h = v.groupBy("track", "unit").agg(F.coalesce(of(1, "n"), F.lit(0)).alias("upper"), F.coalesce(of(2, "n"), F.lit(0)).alias("lower"), F.min("good").alias("both"), F.max("alone").alias("one"))
    return h.where("(upper = 3 and lower = 3 and both) or (upper + lower = 3 and (upper = 0 or lower = 0) and one)").select("track", "unit", "upper", "lower")
