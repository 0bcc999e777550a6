"""The metrical grid: steady intervals, spans, sections, bar lines and doubts of a track's beats (track, t, implied)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .islands import by, island_id
from .windows import middle, with_reference_pulse


def placed(beats: DataFrame) -> DataFrame:
    """beats with i, their place from 0, and gap, the time to the next."""
    w = by("track", "t")
    return beats.withColumn("i", F.row_number().over(w) - 1).withColumn("gap", F.lead("t").over(w) - F.col("t"))


def numbered(beats: DataFrame) -> DataFrame:
    """placed() beats with pulse, the reference of the interval.

    All windows and groups here and below are a track's or parts of it, so a track's beats are dealt once and stay where they are.
    """
    return with_reference_pulse(placed(beats))


def steady_intervals(beats: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """numbered() beats with steady: whether the interval after each is within the tolerance of its pulse.

    Implied beats divide a gap evenly, so all of a gap's intervals are steady only if the gap is a whole number of pulses, to within
    the tolerance of one.
    """
    b = numbered(beats)
    own = F.coalesce(F.abs(F.col("gap") - F.col("pulse")) <= tolerance * F.col("pulse"), F.lit(False))
    b = b.withColumn("found", island_id(~F.col("implied"), by("track", "t")))
    part = Window.partitionBy("track", "found")
    whole = F.abs(F.sum("gap").over(part) - F.count("gap").over(part) * F.percentile("pulse", 0.5).over(part)) <= tolerance * F.percentile("pulse", 0.5).over(part)
    return b.withColumn("steady", own & ((F.count("gap").over(part) == 1) | F.coalesce(whole, F.lit(False)))).drop("found")


def metrical_spans(steady: DataFrame, bridge: int = 1, least: int = 8) -> DataFrame:
    """(track, first, last, detected): places of the first and last beat of each maximal run of steady intervals.

    Runs with no more than `bridge` beats between them, no longer than that many pulses and one, are one; implied beats at the ends
    are cut off; a span has `least` detected beats.
    """
    w = by("track", "i")
    new = F.col("steady") & F.coalesce(~F.lag("steady").over(w), F.lit(True))
    # of an interval's first beat, the detected ones before it and the next one; of its last beat, those up to it and the last one. All
    # of them rise with i, so a span has its first beat's least and its last beat's most
    real = F.when(~F.col("implied"), F.col("i"))
    upto, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    s = steady.withColumn("run", island_id(new, w)).withColumn("__upto", F.count(real).over(upto)).withColumn("__from", F.min(real).over(on)).withColumn("__to", F.max(real).over(upto))
    s = s.withColumn("__before", F.col("__upto") - F.when(~F.col("implied"), 1).otherwise(0)).withColumn("__upto", F.lead("__upto").over(w)).withColumn("__to", F.lead("__to").over(w))
    runs = s.where("steady").groupBy("track", "run").agg(F.min("i").alias("first"), (F.max("i") + 1).alias("last"), F.min("t").alias("from"), F.max(F.col("t") + F.col("gap")).alias("to"), F.min("__before").alias("before"), F.max("__upto").alias("upto"), F.min("__from").alias("real_first"), F.max("__to").alias("real_last"))
    pulse = steady.groupBy("track").agg(F.percentile("gap", 0.5).alias("typical"))
    v = by("track", "first")
    apart = (F.col("first") - F.lag("last").over(v) - 1 > bridge) | (F.col("from") - F.lag("to").over(v) > (bridge + 1) * F.col("typical"))
    spans = runs.join(pulse, "track").withColumn("span", island_id(F.coalesce(apart, F.lit(True)), v)).groupBy("track", "span").agg(F.min("real_first").alias("first"), F.max("real_last").alias("last"), (F.max("upto") - F.min("before")).alias("detected"))
    return spans.where(F.col("detected") >= max(least, 1)).select("track", "first", "last", "detected")


def sections(spans: DataFrame, phase: DataFrame | Column, pulses: int = 4) -> DataFrame:
    """(track, first, last, bar, crossed) of spans that hold a bar: first is their first bar line, bar its number.

    phase: (track, phase), the place of bar lines modulo the pulses, or a column of the spans. Bars are counted through what lies between spans; crossed is
    true where something does.
    """
    w = by("track", "first")
    s = spans.join(phase, "track") if isinstance(phase, DataFrame) else spans.withColumn("phase", phase)
    s = s.withColumn("line", F.col("first") + F.pmod(F.col("phase") - F.col("first"), F.lit(pulses)))
    s = s.withColumn("crossed", F.coalesce(F.col("first") > F.lag("last").over(w) + 1, F.lit(False))).where(F.col("line") + pulses <= F.col("last") + 1)
    one = F.min("line").over(Window.partitionBy("track"))
    return s.select("track", F.col("line").alias("first"), "last", (1 + F.floor((F.col("line") - one) / pulses)).alias("bar"), "crossed")


def bar_lines(sections_: DataFrame, pulses: int = 4) -> DataFrame:
    """(track, i, bar): the place and number of each bar line."""
    s = sections_.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("last") - F.col("first")) / pulses))))
    return s.select("track", (F.col("first") + F.col("k") * pulses).alias("i"), (F.col("bar") + F.col("k")).alias("bar"))


def doubts(beats: DataFrame, reach: int = 4, rest: float = 0.5) -> DataFrame:
    """(track, first, last, held, counted): stretches between found beats that hold another number of pulses than was counted.

    Each found beat is compared with the next `reach` found ones; stretches that share a beat are one. held: the whole stretch in
    pulses, by the median of its intervals' references.
    """
    # a found beat with the references of its intervals up to the next found one
    b = numbered(beats).withColumn("f", island_id(~F.col("implied"), by("track", "t"))).where("f > 0")
    found = b.groupBy("track", "f").agg(F.min("i").alias("i"), F.min("t").alias("t"), F.collect_list("pulse").alias("pulses"))
    w = by("track", "i")
    each = range(1, reach + 1)
    pulses = lambda k: F.sort_array(F.flatten(F.array("pulses", *[F.lead("pulses", j).over(w) for j in range(1, k)])))
    own = found.select("*", *[c for k in each for c in (F.lead("i", k).over(w).alias(f"i{k}"), F.lead("t", k).over(w).alias(f"t{k}"), pulses(k).alias(f"p{k}"))])
    off = lambda k: F.abs(_held(F.col(f"t{k}") - F.col("t"), middle(f"p{k}"), F.col(f"i{k}") - F.col("i")) - (F.col(f"i{k}") - F.col("i"))) > rest
    own = own.select("track", "i", "t", "pulses", F.array_max(F.array(*[F.when(off(k), F.struct(F.col(f"i{k}").alias("last"), F.col(f"t{k}").alias("to"))) for k in each])).alias("x")).select("track", "i", "t", "pulses", "x.*")
    # a stretch begins where no earlier one reaches, and holds the found beats before its end
    new = F.col("last").isNotNull() & F.coalesce(F.col("i") > F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    within = F.col("i") < F.max("last").over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = own.withColumn("run", island_id(new, w)).withColumn("within", within).where("within")
    runs = runs.withColumn("pulse", F.explode_outer("pulses")).groupBy("track", "run").agg(F.min("i").alias("first"), F.max("last").alias("last"), (F.max("to") - F.min("t")).alias("size"), F.percentile("pulse", 0.5).alias("mid"))
    return runs.select("track", "first", "last", _held(F.col("size"), F.col("mid"), F.col("last") - F.col("first")).alias("held"), (F.col("last") - F.col("first")).alias("counted"))


def _held(size: Column, pulse: Column, counted: Column) -> Column:
    """A stretch's size in pulses; what was counted, without a pulse."""
    return F.when(pulse > 0, size / pulse).otherwise(counted.cast("double"))


def relay(pins: DataFrame, beats: DataFrame, most: int, snap: float) -> DataFrame:
    """(track, t, kind): a track's pins, and between two of them no more than `most` pulses apart as many beats as pulses fit, evenly;
    each is the beat found nearest its place, if that is within `snap` of a step, and implied otherwise.

    The pulse is the track's median interval; a count of pulses is rounded half up.
    """
    from .joins import nearest_join

    w = by("track", "t")
    pulse = beats.select("track", (F.lead("t").over(w) - F.col("t")).alias("gap")).groupBy("track").agg(F.percentile("gap", 0.5).alias("pulse"))
    p = pins.select("track", "t", (F.lead("t").over(w) - F.col("t")).alias("gap")).join(pulse, "track")
    p = p.withColumn("n", F.floor(F.col("gap") / F.col("pulse") + 0.5)).where((F.col("n") >= 2) & (F.col("gap") <= most * F.col("pulse")))
    step = F.col("gap") / F.col("n")
    ideal = p.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1))).select("track", (F.col("t") + F.col("k") * step).alias("ideal"), step.alias("step"))
    near = nearest_join(ideal, beats.select("track", F.col("t").alias("b_t"), F.col("t").alias("found")), ["track"], "ideal", "b_t", ["found"])
    held = F.coalesce(F.abs(F.col("found") - F.col("ideal")) <= snap * F.col("step"), F.lit(False))
    laid = near.select("track", F.when(held, F.col("found")).otherwise(F.col("ideal")).alias("t"), F.when(held, "found").otherwise("implied").alias("kind"))
    return pins.select("track", "t", F.lit("pin").alias("kind")).union(laid)
