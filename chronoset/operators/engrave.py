"""Notes and rests as the tied symbols that a metre asks for: units of a bar divided again and again, one level of them at a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .islands import by
from .lineage import settled

TICK = 1e-6
#: Fixed values, in quarters: what one symbol can be as long as, and what a unit of a metre is halved down through.
VALUES = (8.0, 6.0, 4.0, 3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.375, 0.25, 0.1875, 0.125)
UNITS = (8.0, 4.0, 2.0, 1.0, 0.5, 0.25, 0.125)
#: So many in the time of so many.
TUPLETS = ((3, 2), (5, 4), (7, 4))
#: Levels of units, at most: a bar of a hundred quarters has no more.
LEVELS = 32


def _near(x: Column, y: Column | float) -> Column:
    return F.abs(x - y) < TICK


def _one_of(x: Column, values: tuple[float, ...]) -> Column:
    out = F.lit(False)
    for v in values:
        out |= _near(x, v)
    return out


def _on(x: Column, lo: Column, unit: Column, n: int) -> Column:
    parts = (x - lo) * n / unit
    return F.abs(parts - F.bround(parts)) < 1e-4


def _points(lo: Column, unit: Column) -> Column:
    """Where a unit is divided: a power of two in two, three of them in three; of others the longest value is taken off the front."""
    third = unit / 3
    front = F.lit(None).cast("double")
    for v in reversed(UNITS):
        front = F.when(unit > v + TICK, F.lit(v)).otherwise(front)
    return F.when(_one_of(unit, UNITS), F.array(lo + unit / 2)).when(_one_of(third, UNITS), F.array(lo + third, lo + 2 * third)).otherwise(F.array(lo + F.coalesce(front, unit / 2)))


def _syncopated(a: Column, length: Column, lo: Column) -> Column:
    """A value that lies evenly about the division it crosses, or a dotted one that begins on its own dot's grid."""
    half, dot = (a - lo) / (length / 2), (a - lo) / (length / 3)
    even = (F.abs(half - F.bround(half)) * length / 2 <= TICK) & (F.pmod(F.bround(half), F.lit(2)) == 1)
    return F.when(_one_of(length, UNITS), even).when(_one_of(length / 1.5, UNITS), F.abs(dot - F.bround(dot)) * length / 3 <= TICK).otherwise(F.lit(False))


def _level(spans: DataFrame, rest: list[str]) -> DataFrame:
    """What becomes of spans (done, a, b, lo, hi, tuplet) that aren't done in their unit: a symbol, or the same in a part of the unit,
    or two parts. Columns that several rules need are made once."""
    a, b, lo, hi = (F.col(k) for k in ("a", "b", "lo", "hi"))
    live = ~F.col("done")
    s = spans.withColumn("n", b - a).withColumn("unit", hi - lo).withColumn("points", F.when(live, _points(lo, hi - lo)))
    s = s.withColumn("over", F.when(live, F.filter("points", lambda p: (a < p - TICK) & (b > p + TICK)))).withColumn("value", live & _one_of(F.col("n"), VALUES))
    n, unit, over = F.col("n"), F.col("unit"), F.col("over")
    made = lambda done, x, y, u, v, tuplet=0: F.struct(F.lit(done).alias("done"), x.alias("a"), y.alias("b"), u.alias("lo"), v.alias("hi"), F.lit(tuplet).alias("tuplet"))
    shown = F.col("rest") & (unit > 1 + TICK)  # a rest shows the beat: in a longer unit it fills it or is divided
    begins, ends = _near(a, lo), _near(b, hi)
    free = F.col("value") & (begins | ends | (F.size(over) == 0) | ((F.size("points") == 1) & _syncopated(a, n, lo)))
    which = F.when(~live, -1).when(F.when(shown, begins & ends).otherwise(free), 0)
    halves = _near(unit, 2.0) & F.exists("thirds", lambda t: _near(t, lo))
    which = which.when(halves & _one_of(n * 1.5, VALUES) & _on(a, lo, unit, 3) & _on(b, lo, unit, 3), 3)
    for many, time in TUPLETS:
        which = which.when((unit <= 1 + TICK) & _one_of(n * many / time, VALUES) & _on(a, lo, unit, many) & _on(b, lo, unit, many), many)
    s = s.withColumn("which", which.when(unit <= 0.125 + TICK, 0))
    open_ = F.col("which").isNull()
    s = s.withColumn("bounds", F.when(open_, F.concat(F.array(lo), "points", F.array(hi))))
    pairs = F.zip_with(F.slice("bounds", 1, F.size("bounds") - 1), F.slice("bounds", 2, F.size("bounds") - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    s = s.withColumn("part", F.when(open_, F.get(F.filter(pairs, lambda p: (a >= p["x"] - TICK) & (b <= p["y"] + TICK)), F.lit(0))))
    cut = F.get(over, F.lit(0))
    head = F.coalesce(F.array_max(F.filter("bounds", lambda x: x <= a + TICK)), lo)
    become = (
        F.when(F.col("which") == -1, F.array(F.struct("done", "a", "b", "lo", "hi", "tuplet")))
        .when(F.col("which").isNotNull(), F.array(F.struct(F.lit(True).alias("done"), "a", "b", "lo", "hi", F.col("which").alias("tuplet"))))
        .when(F.col("part").isNotNull(), F.array(made(False, a, b, F.col("part.x"), F.col("part.y")))).when(F.size(over) == 0, F.array(made(True, a, b, lo, hi)))
        .otherwise(F.array(made(False, a, cut, head, cut), made(False, cut, b, cut, hi)))
    )
    return s.select(*rest, F.explode(become).alias("x")).select(*rest, "x.*").where(b - a > TICK)


def split_for_meter(spans: DataFrame) -> DataFrame:
    """spans (start, duration, bar_length, rest, thirds, ...) once for each symbol: start and duration are the symbol's, tuplet how many
    stand in the time of the next lower power of two, 0 for none.

    A symbol is one that exists in its length and doesn't hide the beat; else the span is cut at the divisions of the bar. thirds: the
    begins of units of two quarters that are read as triplets. Spans of no length, or with a null, have no symbol. Each different span
    is divided once, and joined to the rows that have it.
    """
    keys = ["start", "duration", "bar_length", "rest", "thirds"]
    more = [c for c in spans.columns if c not in keys]
    asked = spans.select(*keys).where("duration > 0").distinct()
    own = ["rest", "thirds", "k"]
    out = asked.withColumn("k", F.struct(*keys)).select(*own, F.lit(False).alias("done"), F.col("start").alias("a"), (F.col("start") + F.col("duration")).alias("b"), F.lit(0.0).alias("lo"), F.col("bar_length").alias("hi"), F.lit(0).alias("tuplet"))
    done, live = [], out.where(F.col("b") - F.col("a") > TICK)
    for _ in range(LEVELS):
        out = settled(_level(live, own))
        done.append(out.where("done"))
        live = out.where("not done")
        if live.isEmpty():
            break
    else:
        raise RuntimeError(f"a bar is not divided after {LEVELS} levels of units")
    made = reduce(DataFrame.unionByName, done).select("k.*", F.struct(F.col("a").alias("start"), (F.col("b") - F.col("a")).alias("duration"), "tuplet").alias("s")).groupBy(*keys).agg(F.collect_list("s").alias("symbols"))
    return spans.join(made, keys).select(*more, "rest", "bar_length", F.explode("symbols").alias("s")).select(*more, "rest", "bar_length", "s.*")


def gaps(notes: DataFrame, bars: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, duration, bar_length) of the time of bars (keys, bar_length) that no note (keys, start, duration) takes."""
    w = by(keys, "start", "duration")
    upto = F.coalesce(F.max(F.col("start") + F.col("duration")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    before = notes.withColumn("upto", upto).where(F.col("start") > F.col("upto") + TICK).select(*keys, F.col("upto").alias("from"), F.col("start").alias("to"))
    last = bars.join(notes.groupBy(*keys).agg(F.max(F.col("start") + F.col("duration")).alias("end")), keys, "left").withColumn("from", F.coalesce("end", F.lit(0.0)))
    after = last.where(F.col("from") < F.col("bar_length") - TICK).select(*keys, "from", F.col("bar_length").alias("to"))
    return before.union(after).join(bars, keys).select(*keys, F.col("from").alias("start"), (F.col("to") - F.col("from")).alias("duration"), "bar_length")


def triplet_halves(notes: DataFrame, bars: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, thirds) of bars of 2, 4, 6 or 8 quarters: begins of the units of two quarters whose notes all begin on their thirds, one
    at least off the unit's begin."""
    at = notes.join(bars, keys).where(_one_of(F.col("bar_length"), (2.0, 4.0, 6.0, 8.0))).withColumn("unit", 2.0 * F.floor(F.col("start") / 2 + TICK))
    part = (F.col("start") - F.col("unit")) * 1.5
    own = at.where(F.col("unit") + 2 <= F.col("bar_length") + TICK).groupBy(*keys, "unit").agg(F.bool_and(F.abs(part - F.bround(part)) < 1e-4).alias("all"), F.bool_or(F.bround(part).isin(1.0, 2.0)).alias("off"))
    return own.where(F.col("all") & F.col("off")).groupBy(*keys).agg(F.sort_array(F.collect_list("unit")).alias("thirds"))


def written(notes: DataFrame, bars: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bar_length, rest, start, duration, tuplet, ...) of each symbol of bars (keys, bar_length), notes and rests.

    notes: (keys, start, duration, ...), each within its bar and none over another, so that a bar's symbols add up to its length;
    further columns are null for rests. A bar without notes is filled with rests.
    """
    thirds = triplet_halves(notes, bars, keys)
    more = [c for c in notes.columns if c not in (*keys, "start", "duration")]
    own = notes.join(bars, keys).withColumn("rest", F.lit(False))
    idle = gaps(notes, bars, keys).withColumn("rest", F.lit(True))
    for c in more:
        idle = idle.withColumn(c, F.lit(None).cast(dict(notes.dtypes)[c]))
    spans = own.unionByName(idle).join(thirds, keys, "left").withColumn("thirds", F.coalesce("thirds", F.array().cast("array<double>")))
    return split_for_meter(spans)
