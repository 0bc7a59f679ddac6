"""The state of every sample of a stream, and its intervals with their values at both ends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

_ROW = "entity long, idx long, t double, episode long, member boolean, state string"
_CLOSED = "start double, end double, first_idx long, last_idx long, n_samples long, first_value double, last_value double"
OUTPUT = f"{_ROW}, closed struct<{_CLOSED.replace(' ', ':').replace(',:', ', ')}>"
_COLUMNS = ["idx", "t", "episode", "member", "state", "closed"]


class _States(StatefulProcessor):
    """Of each entity it keeps its episode, the interval open in it, and the low samples that may yet begin one.

    Those are fewer than ``required``. A timer at the time of the last sample
    plus ``idle`` drops an entity that went silent.
    """

    def __init__(self, low: float, high: float, required: int, idle_ms: int):
        self.low, self.high, self.required, self.idle_ms = low, high, required, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.episode = handle.getValueState("episode", "number long, stable boolean, timer long")
        self.interval = handle.getValueState("interval", _CLOSED)
        self.pending = handle.getListState("pending", "idx long, t double, value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values(["t", "idx"])
        number, stable, timer = self.episode.get() if self.episode.exists() else (0, False, None)
        interval = self.interval.get() if stable else None
        pending = [tuple(r) for r in self.pending.get()] if self.pending.exists() else []
        out: list[tuple] = []

        def give_up() -> None:
            """The samples held back belong to no interval."""
            out.extend((i, t, number, False, "turning", None) for i, t, _ in pending)
            pending.clear()

        last = False
        for idx, t, motion, value, last in zip(got["idx"], got["t"], got["motion"], got["value"], got["last"], strict=True):
            idx, t, value = int(idx), float(t), None if pd.isna(value) else float(value)
            if idx > 0 and motion <= self.low:
                if stable:
                    out.append((idx, t, number, True, "stable", None))
                    interval = (interval[0], t, interval[2], idx, interval[4] + 1, interval[5], value)
                else:
                    pending.append((idx, t, value))
                    if len(pending) >= self.required:
                        out += [(i, at, number, True, "stable" if i == idx else "turning", None) for i, at, _ in pending]
                        (first, start, begun), stable = pending[0], True
                        interval = (start, t, first, idx, len(pending), begun, value)
                        pending.clear()
            elif idx == 0 or motion >= self.high:
                give_up()
                number += 1
                out.append((idx, t, number, False, "turning", interval))
                stable, interval = False, None
            else:
                give_up()
                out.append((idx, t, number, False, "stable" if stable else "turning", None))
        if timer is not None:
            self.handle.deleteTimer(timer)
        if last:
            give_up()
            if stable:
                out[-1] = (*out[-1][:5], interval) if out[-1][5] is None else out[-1]
            self._forget()
        else:
            due = max(int(got["t"].max() * 1000), timerValues.getCurrentWatermarkInMs()) + self.idle_ms
            self.handle.registerTimer(due)
            self.episode.update((number, bool(stable), due))
            if stable:
                self.interval.update(interval)
            else:
                self.interval.clear()
            if pending:
                self.pending.put(pending)
            else:
                self.pending.clear()
        yield self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        number, stable, _ = self.episode.get()
        out = [(i, t, number, False, "turning", None) for i, t, _ in self.pending.get()] if self.pending.exists() else []
        if stable:
            interval = self.interval.get()
            # No sample closes it, so a row of its own does.
            out.append((None, None, number, None, None, interval))
        self._forget()
        yield self._rows(key, out)

    def _forget(self) -> None:
        self.episode.clear()
        self.interval.clear()
        self.pending.clear()

    def _rows(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=_COLUMNS).astype({"idx": "Int64", "t": "Float64", "episode": "int64", "member": "boolean", "state": "object", "closed": "object"})
        names = [c.split()[0] for c in _CLOSED.split(", ")]
        frame["closed"] = [None if c is None else dict(zip(names, c, strict=True)) for _, _, _, _, _, c in out]
        frame.insert(0, "entity", key[0])
        return frame

    def close(self) -> None:
        pass


def sample_states(stream: DataFrame, low: float, high: float, required: int, late: str = "0 seconds", idle_seconds: float = 3600.0) -> DataFrame:
    """Every sample of a stream with ``episode, member, state``, as the batch operator gives them, and the interval it closes.

    ``stream`` has ``entity, idx, t, motion, value, last``; ``t`` is seconds
    since 1970. Rows of an entity come in order of time over the micro-batches.
    A low sample is held back until it is known whether it begins an interval,
    which takes ``required - 1`` samples at most. ``closed`` is the interval
    that a row ends: bounds, count, and ``value`` at its first and last sample.

    A row with ``last`` true ends its series: what is open is closed on it and
    the entity's state is removed. An entity without rows for ``idle_seconds``
    by the watermark, which is ``late`` behind, is ended too; an interval still
    open then has a row of its own, without a sample. Needs the RocksDB state
    store, as any operator with several states of an entity.
    """
    timed = stream.withColumn("_at", F.timestamp_micros((F.col("t") * 1_000_000).cast("long"))).withWatermark("_at", late)
    rows = timed.select("entity", "idx", "t", "motion", F.col("value").cast("double").alias("value"), "last", "_at")
    made = _States(low, high, required, int(idle_seconds * 1000))
    return rows.groupBy("entity").transformWithStateInPandas(statefulProcessor=made, outputStructType=OUTPUT, outputMode="append", timeMode="eventTime")


def closed_intervals(states: DataFrame) -> DataFrame:
    """The intervals among the rows of ``sample_states``."""
    return states.where("closed is not null").select("entity", "closed.*")
