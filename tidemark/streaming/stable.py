"""Stable intervals of a stream, with a small state per entity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "entity long, start double, end double, first_idx long, last_idx long, n_samples long"
# Bounds and count of the pending low run and of the open interval.
STATE = "stable boolean, p_start double, p_end double, p_first long, p_last long, p_n long, s_start double, s_end double, s_first long, s_last long, s_n long"

_NONE = (0.0, 0.0, -1, -1, 0)


def _extended(run: tuple, t: float, idx: int) -> tuple:
    return (t, t, idx, idx, 1) if run[4] == 0 else (run[0], t, run[2], idx, run[4] + 1)


def stable_intervals(stream: DataFrame, low: float, high: float, required: int) -> DataFrame:
    """Closed intervals of a stream of ``entity, idx, t, motion, last``.

    Rows of an entity arrive in order of time over the micro-batches; inside
    one they are sorted. A row with ``last`` true ends its series, closes what
    is open and removes the entity's state. The state of an entity is ten
    numbers, however long its intervals are. Results equal those of the batch
    operator.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            stable, *rest = state.get
            pending, segment = tuple(rest[:5]), tuple(rest[5:])
        else:
            stable, pending, segment = False, _NONE, _NONE
        closed: list[tuple] = []
        ended = False
        # One micro-batch of an entity: only what orders and measures a row is kept.
        rows = pd.concat([b[["idx", "t", "motion", "last"]] for b in batches]).sort_values(["t", "idx"])
        for idx, t, motion, last in zip(rows["idx"], rows["t"], rows["motion"], rows["last"], strict=True):
            ended = bool(last)
            if idx > 0 and motion <= low:
                if stable:
                    segment = _extended(segment, t, idx)
                else:
                    pending = _extended(pending, t, idx)
                    if pending[4] >= required:
                        stable, segment, pending = True, pending, _NONE
            else:
                pending = _NONE
                if idx == 0 or motion >= high:
                    if stable:
                        closed.append(segment)
                    stable, segment = False, _NONE
            if last:
                if stable:
                    closed.append(segment)
                stable, pending, segment = False, _NONE, _NONE
        if ended:
            state.remove()
        else:
            state.update((bool(stable), *map(_number, pending), *map(_number, segment)))
        out = pd.DataFrame(closed, columns=["start", "end", "first_idx", "last_idx", "n_samples"])
        out.insert(0, "entity", key[0])
        yield out.astype({"entity": "int64", "first_idx": "int64", "last_idx": "int64", "n_samples": "int64", "start": "float64", "end": "float64"})

    return stream.groupBy("entity").applyInPandasWithState(advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def _number(x):
    return x.item() if hasattr(x, "item") else x
