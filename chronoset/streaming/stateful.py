"""Stateful streaming operators: peaks with a refractory time, and runs that are filled and cut into segments.

A row waits in its key's state until the watermark has passed it, and rows are then taken in order of time; so what comes out doesn't
depend on how rows are dealt to batches, as long as they come within `late`. Besides the waiting rows the state is one open peak or
run. Timers let a key's last rows out when no more of them come. The session needs the RocksDB state store:
spark.sql.streaming.stateStore.providerClass = org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider.
"""

from __future__ import annotations

import math
from abc import abstractmethod
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class InOrder(StatefulProcessor):
    """Takes the rows (time in microseconds, value) of each key in order, once the watermark has passed them."""

    #: Of what step() keeps between rows, and of what it gives.
    kept: str
    columns: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, v double")
        self.open = handle.getValueState("open", self.kept)

    @abstractmethod
    def step(self, state: tuple | None, us: int, v: float) -> tuple[tuple | None, list[tuple]]:
        """The state after a row, and what it lets out."""

    def ends(self, state: tuple) -> int | None:
        """The time from which on the state lets something out without a further row."""
        return None

    def end(self, state: tuple) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def _go(self, key: tuple, fresh: list[tuple[int, float]], passed: int) -> Iterator[pd.DataFrame]:
        rows = [(int(r[0]), float("nan") if r[1] is None else float(r[1])) for r in self.waiting.get()] if self.waiting.exists() else []
        rows = sorted(rows + fresh, key=lambda r: (r[0], -math.inf if math.isnan(r[1]) else r[1]))
        state = tuple(self.open.get()) if self.open.exists() else None
        out: list[tuple] = []
        ready = [r for r in rows if r[0] <= passed]
        for us, v in ready:
            state, some = self.step(state, us, v)
            out += some
        if state is not None and (due := self.ends(state)) is not None and passed > due:
            state, some = self.end(state)
            out += some
        left = rows[len(ready) :]
        if left:
            self.waiting.put([(us, None if math.isnan(v) else v) for us, v in left])
        elif self.waiting.exists():
            self.waiting.clear()
        if state is not None:
            self.open.update(state)
        elif self.open.exists():
            self.open.clear()
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        due = self.ends(state) if state is not None else None
        then = min([*(us for us, _ in left[:1]), *([due] if due is not None else [])], default=None)
        if then is not None:
            self.handle.registerTimer(max(then // 1000 + 1, passed // 1000 + 1))
        if out:
            yield pd.DataFrame([(*key, *x) for x in out], columns=["key", *self.columns])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fresh = [(int(us), float("nan") if v is None else float(v)) for b in rows for us, v in zip(b["us"], b["v"], strict=True)]
        yield from self._go(key, fresh, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._go(key, [], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


class Peaks(InOrder):
    kept = "us long, v double, before double, taken long"
    columns = ["us", "v"]

    def __init__(self, gap: int, floor: float) -> None:
        self.gap, self.floor = gap, floor

    def step(self, state: tuple | None, us: int, v: float) -> tuple[tuple | None, list[tuple]]:
        if math.isnan(v):
            return state, []
        if state is None:
            return (us, v, None, None), []
        at, own, before, taken = state
        if before is not None and own >= before and own > v and own >= self.floor and (taken is None or at - taken >= self.gap):
            return (us, v, own, at), [(at, own)]
        return (us, v, own, taken), []


class Segments(InOrder):
    kept = "value long, first long, last long, n long, total double, c_value long, c_first long, c_last long, c_n long, c_total double"
    columns = ["first", "last", "n", "mean"]

    def __init__(self, gap: int, persist: int, least: int) -> None:
        self.gap, self.persist, self.least = gap, persist, least

    def _out(self, s: tuple) -> list[tuple]:
        return [(s[1], s[2], s[3], s[4] / s[3])] if s[3] >= self.least else []

    @staticmethod
    def _joined(s: tuple) -> tuple:
        """The open segment with the spell that didn't last."""
        return s if s[5] is None else (s[0], s[1], s[7], s[3] + s[8], s[4] + s[9], None, None, None, 0, 0.0)

    def ends(self, state: tuple) -> int:
        return (state[7] if state[5] is not None else state[2]) + self.gap

    def end(self, state: tuple) -> tuple[tuple | None, list[tuple]]:
        return None, self._out(self._joined(state))

    def step(self, state: tuple | None, us: int, v: float) -> tuple[tuple | None, list[tuple]]:
        if math.isnan(v):
            return state, []
        value, out = math.floor(v + 0.5), []
        if state is not None and us > self.ends(state):
            state, out = self.end(state)
        if state is None:
            return (value, us, us, 1, v, None, None, None, 0, 0.0), out
        if value == state[0]:
            s = self._joined(state)
            return (s[0], s[1], us, s[3] + 1, s[4] + v, None, None, None, 0, 0.0), out
        if value == state[5]:
            state = (*state[:7], us, state[8] + 1, state[9] + v)
        else:
            state = (*self._joined(state)[:5], value, us, us, 1, v)
        if state[8] >= self.persist:
            out += self._out(state)
            state = (*state[5:], None, None, None, 0, 0.0)
        return state, out


def _run(events: DataFrame, time: str, key: str, value: str, late: str, processor: InOrder, schema: str) -> DataFrame:
    kind = dict(events.dtypes)[key]
    marked = events.withWatermark(time, late).select(F.col(key).alias("key"), F.col(time).alias("__time"), F.unix_micros(F.col(time)).alias("us"), F.col(value).cast("double").alias("v"))
    return marked.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=f"key {kind}, {schema}", outputMode="Append", timeMode="EventTime")


def peaks(events: DataFrame, time: str, key: str, value: str, gap_seconds: float, floor: float, late: str) -> DataFrame:
    """(key, time, value) of rows that are no less than the row before and more than the one after, at least `floor`, and `gap_seconds`
    or more after the key's last peak taken. Rows without a value are no rows; of rows at one time the least comes first."""
    out = _run(events, time, key, value, late, Peaks(round(gap_seconds * 1e6), floor), "us long, v double")
    return out.select(F.col("key").alias(key), F.timestamp_micros("us").alias(time), F.col("v").alias(value))


def segments(events: DataFrame, time: str, key: str, value: str, gap_seconds: float, persist: int, least: int, late: str) -> DataFrame:
    """(key, first, last, n, mean) of segments: rows with a value, each within `gap_seconds` of the last one, of one rounded value.

    A run is cut where another rounded value (half up) lasts `persist` rows; shorter spells change nothing. Segments of fewer than
    `least` rows are left out. A segment comes out when the next one begins or the watermark is past its gap.
    """
    out = _run(events, time, key, value, late, Segments(round(gap_seconds * 1e6), persist, least), "first long, last long, n long, mean double")
    return out.select(F.col("key").alias(key), F.timestamp_micros("first").alias("first"), F.timestamp_micros("last").alias("last"), "n", "mean")
