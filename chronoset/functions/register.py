"""SQL-callable forms: register(spark) makes align_tokens, cluster_onsets, segment_changepoints, theil_sen_slope, dominant_phase_of
and circular_mean_of known to SQL. Table functions take arrays of one track's rows; aggregates take columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import DoubleType

from ..operators import kernels


@udtf(returnType="a_place: int, b_place: int")
class AlignTokens:
    """One row for each aligned pair or gap of two arrays."""

    def eval(self, a: list, b: list):  # noqa: ANN201
        yield from kernels.align(list(a or []), list(b or []))


@udtf(returnType="onset: double, cluster: double")
class ClusterOnsets:
    """Each onset with the first of its cluster; a cluster ends more than `gap` after its first onset."""

    def eval(self, onsets: list, gap: float):  # noqa: ANN201
        first = None
        for t in sorted(x for x in onsets or [] if x is not None):
            if first is None or t - first > gap:
                first = t
            yield t, first


@udtf(returnType="place: int")
class SegmentChangepoints:
    """Where segments but the first begin in a series, by least squares and a penalty."""

    def eval(self, values: list, penalty: float, least: int):  # noqa: ANN201
        for i in kernels.change_points(np.array(values or [], dtype=float).reshape(-1, 1), penalty, least):
            yield (int(i),)


@pandas_udf(DoubleType())
def theil_sen_slope(x: pd.Series, y: pd.Series) -> float:
    """The median slope of all pairs, of 400 points at most, evenly thinned."""
    keep = x.notna() & y.notna()
    a, b = x[keep].to_numpy(float), y[keep].to_numpy(float)
    order = np.lexsort((b, a))
    step = -(-len(order) // 400) or 1
    a, b = a[order][::step], b[order][::step]
    i, j = np.triu_indices(len(a), 1)
    run = a[j] - a[i]
    return float(np.median((b[j] - b[i])[run != 0] / run[run != 0])) if (run != 0).any() else float("nan")


@pandas_udf(DoubleType())
def dominant_phase_of(phase: pd.Series) -> float:
    """The centre of the densest cluster of phases."""
    p = phase.dropna().to_numpy(float)
    if not len(p):
        return float("nan")
    bins = np.bincount(np.floor(p / 0.02).astype(int), minlength=52)
    mass = 2 * bins + np.append(0, bins[:-1]) + np.append(bins[1:], 0)
    own = np.flatnonzero(bins)
    best = min(own, key=lambda k: (-mass[k], abs(k - np.median(p) / 0.02), k))
    centre = (best + 0.5) * 0.02
    for _ in range(2):
        near = p[np.abs(p - centre) <= 0.06]
        if not len(near):
            return float("nan")
        centre = float(np.median(near))
    return centre


@pandas_udf(DoubleType())
def circular_mean_of(value: pd.Series) -> float:
    """The mean direction of values on a circle of length 1."""
    turn = 2 * np.pi * value.dropna().to_numpy(float)
    return float(np.arctan2(np.sin(turn).sum(), np.cos(turn).sum()) / (2 * np.pi)) if len(turn) else float("nan")


#: The place of the last of an array of times that is no later: an SQL function, as an expression.
AS_OF_BEAT = "CREATE OR REPLACE TEMPORARY FUNCTION as_of_beat(t DOUBLE, beats ARRAY<DOUBLE>) RETURNS INT RETURN nullif(size(filter(beats, b -> b <= t)), 0) - 1"


def register(spark: SparkSession) -> None:
    spark.sql(AS_OF_BEAT)
    for name, f in (("align_tokens", AlignTokens), ("cluster_onsets", ClusterOnsets), ("segment_changepoints", SegmentChangepoints)):
        spark.udtf.register(name, f)
    for name, f in (("theil_sen_slope", theil_sen_slope), ("dominant_phase_of", dominant_phase_of), ("circular_mean_of", circular_mean_of)):
        spark.udf.register(name, f)
