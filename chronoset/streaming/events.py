"""Streaming forms of the windowed operators. Event time is a timestamp column; rows later than the watermark are dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, time: str, keys: list[str], value: str, width: str, late: str) -> DataFrame:
    """(keys, start, n, mean, low, high) of each window."""
    w = events.withWatermark(time, late).groupBy(F.window(time, width), *keys)
    out = w.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(*keys, F.col("window.start").alias("start"), "n", "mean", "low", "high")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """(keys, start, end, n) of runs without a gap: chained, unlike anchored clusters."""
    w = events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
    return w.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def anchored(events: DataFrame, time: str, key: str, gap_seconds: float, late: str) -> DataFrame:
    """(key, first, n): clusters anchored on their first row, closed once the watermark is past their reach.

    Rows wait in the key's state until the watermark has passed them and are then taken in order of time, so what comes out doesn't
    depend on how rows are dealt to batches, as long as they come within `late`. The state holds no more than the rows of that time.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    gap = round(gap_seconds * 1e6)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, n, waiting = state.get if state.exists else (0, 0, [])
        waiting = list(waiting)
        if not state.hasTimedOut:
            waiting += [int(t.value // 1000) for b in batches for t in b[time]]
        passed = state.getCurrentWatermarkMs() * 1000
        out = []
        for us in sorted(t for t in waiting if t <= passed):
            if n and us - first > gap:
                out.append((k[0], pd.Timestamp(first, unit="us"), n))
                n = 0
            first, n = us if not n else first, n + 1
        waiting = [t for t in waiting if t > passed]
        if n and passed > first + gap:
            out.append((k[0], pd.Timestamp(first, unit="us"), n))
            n = 0
        if n or waiting:
            state.update((first, n, waiting))
            then = min([*waiting, *([first + gap] if n else [])])
            state.setTimeoutTimestamp(max(then // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[key, "first", "n"])

    marked = events.select(key, time).withWatermark(time, late)
    kind = marked.schema[key].dataType.simpleString()
    return marked.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, first timestamp, n long", "first long, n long, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)
