"""Joins on time: as-of, nearest, band (semi and anti) and interval joins.

Band and interval joins meet on an equi-key: time is cut into cells, the wider side is repeated for the cells that it reaches, and
the exact condition follows. So a track or a pitch that holds many rows is dealt over many tasks, and no join is a nested loop.
As-of joins sort both sides of a key together; the last row of the right side so far is carried forward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_t: str, right_t: str, columns: list[str], strict: bool = False, cell: float | None = None) -> DataFrame:
    """left with `columns` of the last row of right at or before left_t (before, if strict); null if there is none.

    cell: the length of time that one task sorts of a key; what a cell begins with is carried from the cells before it, one row a
    cell. Without it a key is one sorted window.
    """
    carried = F.struct(*[F.col(c) for c in columns])
    order = F.lit(1 if strict else -1)
    a = left.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(on)], F.col(left_t).cast("double").alias("__t"), F.lit(0).alias("__side"), F.struct(*[F.col(c) for c in left.columns]).alias("__left"), F.lit(None).cast(right.select(carried.alias("x")).schema[0].dataType).alias("__right"))
    b = right.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(on)], F.col(right_t).cast("double").alias("__t"), order.alias("__side"), F.lit(None).cast(left.select(F.struct(*[F.col(c) for c in left.columns]).alias("x")).schema[0].dataType).alias("__left"), carried.alias("__right"))
    both, keys = a.union(b), [f"__k{i}" for i in range(len(on))]
    so_far = F.last("__right", ignorenulls=True)
    if cell is None:
        own = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("__right", so_far.over(own))
    else:
        both = both.withColumn("__cell", F.floor(F.col("__t") / cell))
        last = F.max_by("__right", F.when(F.col("__right").isNotNull(), F.struct("__t", "__side")))
        before = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = both.groupBy(*keys, "__cell").agg(last.alias("__last")).withColumn("__carried", F.last("__last", ignorenulls=True).over(before)).drop("__last")
        own = Window.partitionBy(*keys, "__cell").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
        both = both.join(cells, [*keys, "__cell"]).withColumn("__right", F.coalesce(so_far.over(own), "__carried"))
    both = both.where("__left is not null")
    return both.select("__left.*", *[F.col(f"__right.{c}").alias(c) for c in columns])


def beat_phase(notes: DataFrame, beats: DataFrame, time: str = "onset", cell: float | None = None) -> DataFrame:
    """notes with beat_idx and phase: where `time` is between its beat and the next, 0 up to 1; null before the first beat and from
    the last on."""
    own = Window.partitionBy("track").orderBy("t", "beat_idx")
    spans = beats.select("track", "t", "beat_idx", F.lead("t").over(own).alias("__next")).withColumn("__from", F.col("t"))
    out = asof_join(notes, spans, ["track"], time, "t", ["beat_idx", "__from", "__next"], cell=cell)
    inside = F.col("__next").isNotNull() & (F.col("__next") > F.col("__from"))
    phase = F.when(inside, (F.col(time) - F.col("__from")) / (F.col("__next") - F.col("__from")))
    return out.withColumn("phase", phase).withColumn("beat_idx", F.when(inside, F.col("beat_idx"))).drop("__from", "__next")


def nearest_join(left: DataFrame, right: DataFrame, on: list[str], left_t: str, right_t: str, columns: list[str], most: float | None = None) -> DataFrame:
    """left with `columns` of the row of right nearest in time, ties to the earlier; null beyond `most`."""
    before = asof_join(left, right.withColumn("__t0", F.col(right_t)), on, left_t, right_t, ["__t0", *columns])
    before = before.select(*left.columns, "__t0", F.struct(*columns).alias("__b"))
    turned = right.withColumn("__neg", -F.col(right_t)).withColumn("__t1", F.col(right_t))
    both = asof_join(before.withColumn("__lneg", -F.col(left_t)), turned, on, "__lneg", "__neg", ["__t1", *columns])
    both = both.select(*left.columns, "__t0", "__b", "__t1", F.struct(*columns).alias("__a"))
    d0, d1 = F.col(left_t) - F.col("__t0"), F.col("__t1") - F.col(left_t)
    far = F.lit(float("inf"))
    first = F.coalesce(d0, far) <= F.coalesce(d1, far)
    d = F.when(first, d0).otherwise(d1)
    ok = d.isNotNull() if most is None else d <= most
    pick = F.when(ok, F.when(first, F.col("__b")).otherwise(F.col("__a")))
    return both.select(*left.columns, *[pick[c].alias(c) for c in columns], F.when(ok, d).alias("distance"))


def _cells(lo: Column, hi: Column, cell: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / cell), F.floor(hi / cell)))


def band_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], left_t: str, right_t: str, tolerance: float, how: str = "inner", extra: Column | None = None) -> DataFrame:
    """Rows whose keys are equal and whose times differ by no more than the tolerance, which is both the band and the cell.

    Names of both sides must differ. For inner joins, the right side is repeated for three cells; semi and anti joins likewise.
    """
    cell = max(tolerance, 1e-9)
    a = left.withColumn("__cell", F.floor(F.col(left_t) / cell))
    b = right.withColumn("__near", _cells(F.col(right_t) - cell, F.col(right_t) + cell, cell))
    cond = (F.col("__cell") == F.col("__near")) & (F.abs(F.col(left_t) - F.col(right_t)) <= tolerance)
    for x, y in on:
        cond &= a[x] == b[y]
    if extra is not None:
        cond &= extra
    out = a.join(b, cond, how)
    return out.drop("__cell", "__near")


def interval_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], left_span: tuple[str, str], right_span: tuple[str, str], cell: float, closed: bool = False) -> DataFrame:
    """Pairs of rows whose intervals overlap (touch, if closed), once each; names of both sides must differ.

    Both sides are repeated for the cells that they reach; a pair is kept in the cell where its overlap starts.
    """
    a = left.withColumn("__cell", _cells(F.col(left_span[0]), F.col(left_span[1]), cell))
    b = right.withColumn("__near", _cells(F.col(right_span[0]), F.col(right_span[1]), cell))
    lo, hi = F.greatest(F.col(left_span[0]), F.col(right_span[0])), F.least(F.col(left_span[1]), F.col(right_span[1]))
    cond = (F.col("__cell") == F.col("__near")) & (lo <= hi if closed else lo < hi) & (F.floor(lo / cell) == F.col("__cell"))
    for x, y in on:
        cond &= a[x] == b[y]
    return a.join(b, cond).drop("__cell", "__near")


def stabbing_join(points: DataFrame, spans: DataFrame, on: list[tuple[str, str]], time: str, span: tuple[str, str], cell: float, right: bool = False) -> DataFrame:
    """Points with the spans [from, to) that hold them, or (from, to] if `right`; names of both sides must differ."""
    a = points.withColumn("__cell", F.floor(F.col(time) / cell))
    b = spans.withColumn("__near", _cells(F.col(span[0]), F.greatest(*map(F.col, span)), cell))
    t, lo, hi = F.col(time), F.col(span[0]), F.col(span[1])
    cond = (F.col("__cell") == F.col("__near")) & ((t > lo) & (t <= hi) if right else (t >= lo) & (t < hi))
    for x, y in on:
        cond &= a[x] == b[y]
    return a.join(b, cond).drop("__cell", "__near")
