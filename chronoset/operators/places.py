"""Where notes are placed: classes of placement, metronomes laid over a count, anchors, runs, and small record forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .islands import by, island_id
from .joins import asof_join

#: Places within a beat in 24ths.
BINARY, THIRDS, OFFBEAT, FINE = (0, 6, 12, 18), (8, 16), (12, 16, 18), (3, 9, 15, 21, 4, 20)
#: Metres whose pulses are not their numerator.
METERS = {"3/8": (3, 8, 1), "6/8": (6, 8, 2), "9/8": (9, 8, 3), "12/8": (12, 8, 4)}


def placement_class(human: Column, ours: Column, division: Column, onsets: Column) -> Column:
    """One of eleven kinds of difference of two places in 24ths, by the annotated division and the onsets of the beat.

    Fixed values: the names of the kinds, and which goes before which.
    """
    d, h, o = ours - human, human % 24, ours % 24
    same = F.floor(human / 24) == F.floor(ours / 24)
    swung = same & (onsets <= 2) & h.isin(*OFFBEAT)
    half = same & h.isin(12, 16)
    return (
        F.when(swung & (o == 18), "late offbeat as dotted").when(d == 0, "hit").when(swung & (o == 12), "swing convention").when((o == 0) & (F.abs(d) <= 6), "annotation literal")
        .when((division >= 5) | ~h.isin(*BINARY, *THIRDS, *FINE), "below the grid").when(h.isin(*THIRDS) & o.isin(*BINARY) & (onsets >= 3), "triplet as binary").when(h.isin(*BINARY) & o.isin(*THIRDS), "binary as triplet")
        .when(half & (o < h), "early offbeat as 16th").when(half & (o > h) & ~o.isin(*THIRDS), "late offbeat as dotted")
        .when((h == 0) & d.between(1, 6), "laid-back beat after it").when((h == 0) & d.between(-6, -1), "pushed beat before it").otherwise("other")
    )


def meter(name: Column, pulses: Column) -> list[Column]:
    """numerator, denominator and pulses of a metre's name; pulses that are given go first."""
    known = F.create_map(*[x for k, v in METERS.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    found, parts = F.try_element_at(known, name), F.split(name, "/")
    numerator = F.coalesce(found[0], F.get(parts, 0).try_cast("int"))
    return [numerator.alias("numerator"), F.coalesce(found[1], F.get(parts, 1).try_cast("int")).alias("denominator"), F.greatest(F.lit(1), F.coalesce(pulses, found[2], numerator)).alias("pulses")]


def metronome_jumps(beats: DataFrame, side: int, clean: float, agree: float) -> DataFrame:
    """(track, i, jump) of places where `side` intervals before and after are steady and of one pulse: the beats that the count on the
    right runs ahead of the left's, by median phases."""
    w = by("track", "t")
    b = beats.select("track", "t").withColumn("i", F.row_number().over(w) - 1)
    b = b.withColumn("l", F.collect_list("t").over(w.rowsBetween(-side, 0))).withColumn("r", F.collect_list("t").over(w.rowsBetween(1, side + 1)))
    b = b.where((F.size("l") == side + 1) & (F.size("r") == side + 1))
    pulse = lambda x: (F.get(x, F.lit(side)) - F.get(x, F.lit(0))) / side
    b = b.withColumn("pl", pulse(F.col("l"))).withColumn("pr", pulse(F.col("r"))).withColumn("p", (F.col("pl") + F.col("pr")) / 2)
    steady = lambda x, p: F.forall(F.sequence(F.lit(0), F.lit(side - 1)), lambda k: F.abs(F.get(x, k + 1) - F.get(x, k) - p) <= clean * p)
    b = b.where(steady(F.col("l"), F.col("pl")) & steady(F.col("r"), F.col("pr")) & (F.abs(F.col("pl") - F.col("pr")) <= agree * F.col("p")))

    def phase(x: Column, zero: int) -> Column:
        v = F.array_sort(F.transform(x, lambda t, k: t - F.col("p") * (k - zero)))
        return (F.get(v, F.lit(side // 2)) + F.get(v, F.lit((side + 1) // 2))) / 2

    return b.select("track", "i", ((phase(F.col("l"), side) - phase(F.col("r"), -1)) / F.col("p")).alias("jump"))


def run_around(above: DataFrame, peak: DataFrame, gap: int) -> DataFrame:
    """(track, first, after): the run of frames around each track's peak, over gaps of up to `gap` frames."""
    apart = F.col("frame") - F.lag("frame").over(by("track", "frame")) > gap + 1
    runs = above.select("track", "frame").withColumn("run", island_id(F.coalesce(apart, F.lit(True)), by("track", "frame")))
    own = runs.join(peak.withColumnRenamed("peak", "frame"), ["track", "frame"]).select("track", "run")
    return runs.join(own, ["track", "run"]).groupBy("track").agg(F.min("frame").alias("first"), (F.max("frame") + 1).alias("after"))


def bar_events(points: DataFrame, length: float, tolerance: float) -> DataFrame:
    """(track, bar, start, after) from (track, bar, pos, rest): a note lasts to the next note, rest or bar line; a bar that begins with
    neither begins with a note tied in, from -1."""
    cuts = points.select("track", "bar", "pos").union(points.select("track", "bar", F.lit(length))).distinct()
    cuts = cuts.withColumn("after", F.lead("pos").over(by(["track", "bar"], "pos")))
    played = cuts.join(points.where("not rest").select("track", "bar", "pos"), ["track", "bar", "pos"]).select("track", "bar", F.col("pos").alias("start"), "after")
    tied = cuts.groupBy("track", "bar").agg(F.min("pos").alias("after")).where(F.col("after") > tolerance).select("track", "bar", F.lit(-1.0), "after")
    return played.union(tied)


def interpolate(missed: DataFrame, anchors: DataFrame) -> DataFrame:
    """missed (track, note_id, pos) with seconds, from anchors (track, note_id, onset, pos) whose positions rise; a track with one
    anchor places none."""
    w = by("track", "onset", "note_id")
    upto = F.max("pos").over(w.rowsBetween(Window.unboundedPreceding, -1))
    a = anchors.withColumn("upto", upto).where("upto is null or pos > upto").withColumn("k", F.row_number().over(by("track", "pos"))).withColumn("n", F.count("*").over(Window.partitionBy("track"))).where("n >= 2")
    at = asof_join(missed, a.select("track", F.col("pos").alias("a_pos"), "k"), ["track"], "pos", "a_pos", ["k"], strict=True)
    size = a.groupBy("track").agg(F.max("n").alias("n"))
    at = at.join(size, "track").withColumn("lo", F.greatest(F.lit(1), F.least(F.coalesce("k", F.lit(0)), F.col("n") - 1)).cast("int"))
    ends = a.select("track", F.col("k").alias("lo"), F.col("pos").alias("p0"), F.col("onset").alias("t0"), F.lead("pos").over(by("track", "pos")).alias("p1"), F.lead("onset").over(by("track", "pos")).alias("t1"))
    out = at.join(ends, ["track", "lo"])
    return out.select("track", "note_id", "pos", (F.col("t0") + (F.col("pos") - F.col("p0")) * (F.col("t1") - F.col("t0")) / (F.col("p1") - F.col("p0"))).alias("seconds"))


def page_tier(printed: Column, unread: Column, unprinted: Column, filled: Column, most_unread: float, most_unprinted: float, least: float) -> Column:
    """silver where few printed notes were not read, few read ones are not printed, and enough bars are full; bronze otherwise, also
    where the print or the bars are not known."""
    good = (unread / printed <= most_unread) & (unprinted / printed <= most_unprinted) & (filled >= least)
    return F.when(F.coalesce(good, F.lit(False)), "silver").otherwise("bronze")


def last_field(text: str, name: str, form: str) -> Column:
    """The last value that `name: value` has in the text, null if it has none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(f"{name}: ({form})"), F.lit(1)), F.lit(-1))


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The row of each key that was written last; of rows written at once the greatest."""
    rest = [c for c in base.columns if c not in (*keys, at)]
    last = base.unionByName(updates).groupBy(*keys).agg(F.max(F.struct(at, *rest)).alias("x"))
    return last.select(*keys, "x.*")


def repeated_section(features: DataFrame, shortest: int, smooth: int, floor: float, drop: float, gap: int, edge: float, least: float) -> DataFrame:
    """(track, first, after, lag, similarity): a stretch of bars near a track's begin that comes again near its end.

    features: (track, bar, i, v), rows of unit length a bar. For each lag of `shortest` bars or a third of the track and more, the
    diagonal of the bars' similarity is averaged over `smooth` bars (with what is beyond its ends as nothing); the run around its peak
    over values of `floor` at least, and no more than `drop` under the peak, over gaps of `gap` bars, is the lag's stretch. It counts if it starts
    in the first `edge` of the track and its repetition ends in the last; the strongest one wins, if it reaches `least`.
    """
    n = features.groupBy("track").agg((F.max("bar") + 1).alias("bars"))
    a = features.join(n, "track")
    b = features.select(F.col("track").alias("b_track"), F.col("bar").alias("b_bar"), F.col("i").alias("b_i"), F.col("v").alias("b_v"))
    far = F.greatest(F.lit(shortest), F.floor(F.col("bars") / 3))
    pairs = a.join(b, (F.col("track") == F.col("b_track")) & (F.col("i") == F.col("b_i")) & (F.col("b_bar") >= F.col("bar") + far))
    like = pairs.groupBy("track", "bars", (F.col("b_bar") - F.col("bar")).alias("lag"), "bar").agg(F.sum(F.col("v") * F.col("b_v")).alias("raw"))
    w = Window.partitionBy("track", "lag").orderBy("bar").rangeBetween(-(smooth // 2), smooth - smooth // 2 - 1)
    s = like.withColumn("s", F.round(F.sum("raw").over(w) / smooth, 9)).withColumn("peak", F.max("s").over(Window.partitionBy("track", "lag")))
    s = s.withColumn("at", F.min(F.when(F.col("s") == F.col("peak"), F.col("bar"))).over(Window.partitionBy("track", "lag")))
    above = s.where(F.col("s") >= F.greatest(F.lit(floor), F.col("peak") - drop))
    apart = F.col("bar") - F.lag("bar").over(by(["track", "lag"], "bar")) > gap + 1
    runs = above.withColumn("run", island_id(F.coalesce(apart, F.lit(True)), by(["track", "lag"], "bar")))
    runs = runs.groupBy("track", "lag", "run", "bars", "peak", "at").agg(F.min("bar").alias("first"), (F.max("bar") + 1).alias("after"))
    runs = runs.where(F.col("at").between(F.col("first"), F.col("after") - 1) & (F.col("first") <= edge * F.col("bars")) & (F.col("after") + F.col("lag") >= (1 - edge) * F.col("bars")) & (F.col("peak") >= least))
    best = runs.groupBy("track").agg(F.max_by(F.struct("first", "after", "lag", "peak"), F.struct("peak", -F.col("lag"))).alias("x"))
    return best.select("track", "x.first", "x.after", "x.lag", F.col("x.peak").alias("similarity"))
