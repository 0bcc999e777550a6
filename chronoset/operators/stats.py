"""Robust and rank statistics, tumbling windows and scorecards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .islands import by


def intervals(beats: DataFrame) -> DataFrame:
    return beats.select("track", "t", (F.lead("t").over(by("track", "t")) - F.col("t")).alias("gap"))


def median_interval(beats: DataFrame) -> DataFrame:
    return intervals(beats).where("gap is not null").groupBy("track").agg(F.percentile("gap", 0.5).alias("median"))


def local_tempo(beats: DataFrame) -> DataFrame:
    """(track, t, bpm, outlier): 60 over the interval, the last repeated; outlier: half an octave or more off the median of 3 or more."""
    w = by("track", "t")
    bpm = intervals(beats).withColumn("bpm", F.when(F.col("gap") > 0, 60.0 / F.col("gap")))
    bpm = bpm.withColumn("bpm", F.coalesce("bpm", F.lag("bpm").over(w)))
    own = Window.partitionBy("track")
    off = F.abs(F.log2(F.col("bpm") / F.percentile("bpm", 0.5).over(own))) >= 0.5
    return bpm.select("track", "t", "bpm", F.coalesce(off & (F.count("bpm").over(own) >= 3), F.lit(False)).alias("outlier"))


def modal_interval(beats: DataFrame, digits: int = 2) -> DataFrame:
    """(track, mode, n): the most frequent rounded interval, ties to the smaller."""
    bins = intervals(beats).where("gap is not null").groupBy("track", F.bround("gap", digits).alias("b")).agg(F.count("*").alias("n"))
    return bins.groupBy("track").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("mode"), F.max("n").alias("n"))


def dominant_phase(phases: DataFrame, keys: list[str], width: float = 0.02, near: float = 0.06) -> DataFrame:
    """(keys, phi, concentration, error, n) from rows with `phase`: a histogram's smoothed peak, then twice the median around it.

    Bins weigh 1, 2, 1 with their neighbours; ties go to the bin nearer the median, then to the lower one.
    """
    own = Window.partitionBy(*keys)
    by_bin = own.orderBy("__bin")
    p = phases.select(*keys, "phase", F.floor(F.col("phase") / width).alias("__bin"))
    p = p.withColumn("__mid", F.percentile("phase", 0.5).over(own)).withColumn("__n", F.count("*").over(own))
    p = p.withColumn("__mass", F.count("*").over(by_bin.rangeBetween(-1, 1)) + F.count("*").over(by_bin.rangeBetween(0, 0)))
    far = F.round(F.abs(F.col("__bin") - F.col("__mid") / width), 9)
    peak = F.max(F.struct(F.col("__mass"), (-far).alias("far"), (-F.col("__bin")).alias("bin"))).over(own)
    p = p.withColumn("__phi", (0.5 - peak["bin"]) * width)
    near_by = F.when(F.abs(F.col("phase") - F.col("__phi")) <= near, F.col("phase"))
    p = p.withColumn("__phi", F.percentile(near_by, 0.5).over(own))
    out = p.groupBy(*keys).agg(F.percentile(near_by, 0.5).alias("phi"), F.count(near_by).alias("m"), F.stddev_pop(near_by).alias("sd"), F.first("__n").alias("n"))
    return out.where("m > 0").select(*keys, "phi", (F.col("m") / F.col("n")).alias("concentration"), (F.col("sd") / F.sqrt("m")).alias("error"), "n")


def swing_spans(phased: DataFrame, beats: int, window: int = 16, low: float = 0.35, high: float = 0.85, least: int = 4, swung: float = 0.55) -> DataFrame:
    """Tumbling windows over beats: (track, start_beat, end_beat, phi, bur, confidence, z, is_swung, n) from notes with a phase."""
    off = phased.where((F.col("phase") > low) & (F.col("phase") < high)).withColumn("start_beat", (F.floor(F.col("beat_idx") / window) * window).cast("int"))
    spans = dominant_phase(off, ["track", "start_beat"]).where(F.col("n") >= least)
    rel = F.col("error") / (F.col("phi") * (1 - F.col("phi")))
    conf = F.col("concentration") * F.least(F.lit(1.0), F.col("n") / 8.0) / (1 + rel / 0.10)
    z = F.when(F.col("error") > 0, (F.col("phi") - 0.5) / F.col("error")).otherwise(F.lit(float("inf")))
    floor = 2 * 0.06 / (high - low)
    return spans.select(
        "track", "start_beat", F.least(F.col("start_beat") + window, F.lit(beats - 1)).alias("end_beat"), "phi", (F.col("phi") / (1 - F.col("phi"))).alias("bur"), conf.alias("confidence"), z.alias("z"),
        ((F.col("phi") > swung) & (z > 2) & (F.col("concentration") > floor * 1.2)).alias("is_swung"), "n",
    )


def pooled_phase(spans: DataFrame, ceiling: float = 1.6) -> DataFrame:
    """(track, beat_idx, phi): swung spans' phases drawn to the track's by confidence, if the track's is beyond the ceiling."""
    own = spans.where("is_swung")
    track = own.groupBy("track").agg((F.sum(F.col("confidence") * F.col("phi")) / F.sum("confidence")).alias("mean"), F.avg("confidence").alias("trust"))
    trust = F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("trust"))), F.lit(3.0))
    top = 1 + (ceiling - 1) * (1 - trust)
    track = track.where(F.col("mean") > top / (1 + top)).select("track", "mean")
    phi = F.col("confidence") * F.col("phi") + (1 - F.col("confidence")) * F.col("mean")
    return own.join(track, "track").select("track", F.explode(F.sequence(F.col("start_beat"), F.col("end_beat") - 1)).alias("beat_idx"), phi.alias("phi"))


def circular_mean(rows: DataFrame, keys: list[str], value: str, period: float = 1.0) -> DataFrame:
    """(keys, offset, concentration): the mean direction of values on a circle, within half a period either side of 0."""
    turn = 2 * 3.141592653589793 / period
    s, c = F.sum(F.sin(F.col(value) * turn)), F.sum(F.cos(F.col(value) * turn))
    return rows.groupBy(*keys).agg((F.atan2(s, c) / turn).alias("offset"), (F.sqrt(s * s + c * c) / F.count(value)).alias("concentration"))


def standardize(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    own = Window.partitionBy(*keys)
    sd = F.stddev_pop(value).over(own)
    return rows.withColumn("standard", F.when(sd > 0, (F.col(value) - F.avg(value).over(own)) / sd).otherwise(0.0))


def running_sum(rows: DataFrame, keys: list[str], order: str, value: str, name: str, cell: float | None = None) -> DataFrame:
    """rows with `name`: the sum of `value` over the rows of a key (not null) that come before, rows of a key differing in `order`.

    cell: the width of `order` that one task sorts of a key; sums of whole cells, one row a cell, are carried. Without it a key is one
    sorted window.
    """
    before = lambda w: F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if cell is None:
        return rows.withColumn(name, before(Window.partitionBy(*keys).orderBy(order)))
    dealt = rows.withColumn("__cell", F.floor(F.col(order) / cell))
    cells = dealt.groupBy(*keys, "__cell").agg(F.sum(value).alias(value))
    cells = cells.withColumn("__base", before(Window.partitionBy(*keys).orderBy("__cell"))).drop(value)
    out = dealt.join(cells, [*keys, "__cell"]).withColumn(name, F.col("__base") + before(Window.partitionBy(*keys, "__cell").orderBy(order)))
    return out.drop("__cell", "__base")


def mid_rank_auc(rows: DataFrame, keys: list[str], score: str, good: str, cell: float | None = None) -> DataFrame:
    """(keys, auc): the chance that a good row scores higher, ties counting half; null without both kinds.

    Rows are counted by score first, so the ranks are running sums over distinct scores; cell as in running_sum().
    """
    by_score = rows.groupBy(*keys, score).agg(F.count("*").alias("n"), F.sum(F.col(good).cast("long")).alias("g")).withColumn("bad", F.col("n") - F.col("g"))
    ranked = running_sum(by_score, keys, score, "bad", "below", cell)
    u = F.sum(F.col("g") * (F.col("below") + F.col("bad") / 2.0))
    pairs = F.sum("g") * F.sum("bad")
    return ranked.groupBy(*keys).agg(F.when(pairs > 0, u / pairs).alias("auc"))


def share_in_lowest(rows: DataFrame, keys: list[str], score: str, flag: str, part: float, cell: float | None = None) -> DataFrame:
    """(keys, share): the part of flagged rows among the lowest `part` of scores; a tie across the cut counts in proportion."""
    by_score = rows.groupBy(*keys, score).agg(F.count("*").alias("n"), F.sum(F.col(flag).cast("long")).alias("f"))
    total = by_score.groupBy(*keys).agg(F.sum("n").alias("total"))
    out = running_sum(by_score, keys, score, "n", "before", cell).join(total, keys)
    out = out.withColumn("left", F.greatest(F.lit(0.0), part * F.col("total") - F.col("before")))
    taken = F.sum(F.col("f") * F.least(F.lit(1.0), F.col("left") / F.col("n")))
    return out.groupBy(*keys).agg(F.when(F.sum("f") > 0, taken / F.sum("f")).alias("share"))


def entropy(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*keys))
    return counts.withColumn("p", p).groupBy(*keys).agg(F.sum(-F.col("p") * F.log2("p")).alias("bits"))


def theil_sen(points: DataFrame, keys: list[str], x: str, y: str, most: int = 400) -> DataFrame:
    """(keys, slope, intercept): the median slope of all pairs of points and the median rest.

    Of more than `most` points, `most` are used: the points int(i * (n / most)) of n in order of x. Points without x or y take no
    part; a key without two different x has no row. A key's points are one row, whose pairs are never rows.
    """
    w = Window.partitionBy(*keys).orderBy(x, y)
    p = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    step = F.col("__n") / F.lit(float(most))
    near = F.floor(F.col("__i") / step)
    drawn = lambda i: (i < most) & (F.floor(i * step) == F.col("__i"))
    p = p.where((F.col("__n") <= most) | drawn(near) | drawn(near + 1))
    each = p.groupBy(*keys).agg(F.collect_list(F.col(x).cast("double")).alias("x"), F.collect_list(F.col(y).cast("double")).alias("y"))  # `most` points a key

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [_line(np.asarray(u), np.asarray(v)) for u, v in zip(b["x"], b["y"], strict=True)]
            yield b[keys].assign(slope=[f[0] for f in found], intercept=[f[1] for f in found]).dropna(subset=["slope"])

    kinds = dict(points.dtypes)
    return each.mapInPandas(lines, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", slope double, intercept double")


def _line(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The median slope of all pairs with unequal x, and the median rest; nan without such a pair."""
    i, j = np.triu_indices(len(x), 1)
    dx = x[j] - x[i]
    some = dx != 0
    if not some.any():
        return float("nan"), float("nan")
    slope = float(np.median((y[j] - y[i])[some] / dx[some]))
    return slope, float(np.median(y - slope * x))


def inlier_line(points: DataFrame, keys: list[str], x: str, y: str, near: float, least: int) -> DataFrame:
    """theil_sen(), and again through the points within `near` of the line where there are `least` or more."""
    first = theil_sen(points, keys, x, y)
    kept = points.join(first, keys).where(F.round(F.abs(F.col(y) - (F.col("slope") * F.col(x) + F.col("intercept"))), 9) <= near).drop("slope", "intercept")
    enough = kept.groupBy(*keys).count().where(F.col("count") >= least).drop("count")
    again = theil_sen(kept, keys, x, y).join(enough, keys).withColumnRenamed("slope", "__slope").withColumnRenamed("intercept", "__intercept")
    return first.join(again, keys, "left").select(*keys, F.coalesce("__slope", "slope").alias("slope"), F.coalesce("__intercept", "intercept").alias("intercept"))


def order_statistic(rows: DataFrame, keys: list[str], value: str, part: float, cell: float | None = None) -> DataFrame:
    """(keys, value): the value at place floor(part * n) of a key's values in order, without interpolation; the last for part 1.

    Values are counted first, so the running sum is over distinct ones.
    """
    by_value = rows.groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    total = by_value.groupBy(*keys).agg(F.sum("n").alias("total"))
    place = F.least(F.col("total") - 1, F.floor(F.col("total") * part))
    upto = running_sum(by_value, keys, "value", "n", "before", cell).join(total, keys)
    return upto.where(F.col("before") + F.col("n") > place).groupBy(*keys).agg(F.min("value").alias("value"))
