"""Order-dependent operators: a fold over each entity's sorted rows.

The rows of an entity are streamed in order through one task, which keeps only
the fold's state from row to row; a group may be of any size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def _fold(df: DataFrame, entity: str, columns: list[Column], out: str, start: Callable, step: Callable, close: Callable | None = None) -> DataFrame:
    """Rows that ``step(state, *columns)`` gives for each row in order of ``columns``, and ``close(state)`` after an entity's last.

    ``out`` is the schema of the rows without the entity; ``start()`` is the
    state before an entity's first row, which ``step`` changes in place.
    """
    rows = df.select(F.col(entity).alias("entity"), *columns)
    fields = StructType.fromDDL(out).fields
    names = ["entity", *[f.name for f in fields]]
    kinds = [{"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[f.dataType.simpleString()] for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, at, state, kind = False, None, None, None
        for batch in batches:
            given = []
            kind = batch.column(0).type
            for key, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not begun or key != at:
                    if begun and close:
                        given += [(at, *r) for r in close(state)]
                    begun, at, state = True, key, start()
                given += [(at, *r) for r in step(state, *row)]
            yield packed(given, kind)
        if begun and close:
            yield packed([(at, *r) for r in close(state)], kind)

    def packed(given: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        listed = list(zip(*given, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(listed, [kind, *kinds], strict=True)], names=names)

    schema = StructType([StructField("entity", rows.schema["entity"].dataType), *fields])
    return rows.repartition("entity").sortWithinPartitions(*rows.columns).mapInArrow(run, schema)


def _within(a: float | None, b: float | None, most: float) -> bool:
    return a is not None and b is not None and a - b <= most


def nms_topk(points: DataFrame, limit: int, separation: float) -> DataFrame:
    """Best points per entity that lie ``separation`` or more apart, by falling score, then time.

    ``points`` has ``entity, t, score``. Less than one gives none.
    """
    if limit < 1:
        return points.limit(0).select("entity", F.lit(0).alias("place"), "t", "score")

    def step(kept: list, minus: float | None, t: float | None) -> list[tuple]:
        if len(kept) >= limit or any(k is None or t is None or abs(k - t) < separation for k in kept):
            return []
        kept.append(t)
        return [(len(kept) - 1, t, None if minus is None else -minus)]

    columns = [(-F.col("score")).cast("double").alias("minus"), F.col("t").cast("double").alias("t")]
    return _fold(points, "entity", columns, "place int, t double, score double", list, step)


def span_groups(windows: DataFrame, max_gap: float, max_span: float, max_members: int | None = None) -> DataFrame:
    """Group neighbouring windows of an entity while gap, whole span and count allow.

    ``windows`` has ``entity, start, end``. Returns per group its number, first
    start, last end and number of windows.
    """

    # The state is the open group: number, first start, last end and count.
    def step(s: list, start: float | None, end: float | None) -> list[tuple]:
        fits = s and _within(start, s[2], max_gap) and _within(end, s[1], max_span) and not (max_members and s[3] >= max_members)
        done = [] if fits or not s else [tuple(s)]
        s[:] = [s[0], s[1], end, s[3] + 1] if fits else [s[0] + 1 if s else 0, start, end, 1]
        return done

    columns = [F.col(c).cast("double").alias(c) for c in ("start", "end")]
    return _fold(windows, "entity", columns, "grp int, start double, end double, n_windows int", list, step, lambda s: [tuple(s)])


def window_dedupe(rows: DataFrame, distance: int, window: int) -> DataFrame:
    """Compare each item with the last ``window`` originals before it, newest first.

    ``rows`` has ``entity, id, hash``. An item whose hash differs in ``distance``
    bits or fewer from one of them is a duplicate of the newest such; all
    others are originals themselves.
    """
    bits = (1 << 64) - 1

    # Roots are listed newest first.
    def step(roots: list, item: int | None, value: int | None) -> list[tuple]:
        near = (i for i, h in roots if h is not None and value is not None and ((h ^ value) & bits).bit_count() <= distance)
        root = next(near, None)
        if root is None:
            roots.insert(0, (item, value))
            del roots[window:]
        return [(item, root)]

    columns = [F.col(c).cast("long").alias(c) for c in ("id", "hash")]
    return _fold(rows, "entity", columns, "id long, duplicate_of long", list, step)


def chain_premerge(intervals: DataFrame, max_gap: float, max_change: float) -> DataFrame:
    """Merge an interval into the merged one before it, if it follows closely and looks alike at both ends.

    ``intervals`` has ``entity, start, end, first_value, last_value``. The first
    value of a merged interval is that of its first member, so the chain does
    not drift.
    """

    def near(a: float | None, b: float | None) -> bool:
        return a is not None and b is not None and abs(a - b) <= max_change

    # The state is the open interval: number, start, end, count, first and last value.
    def step(s: list, start: float | None, end: float | None, first: float | None, last: float | None) -> list[tuple]:
        alike = s and _within(start, s[2], max_gap) and near(first, s[4]) and near(last, s[5])
        done = [] if alike or not s else [tuple(s[:4])]
        s[:] = [s[0], s[1], end, s[3] + 1, s[4], last] if alike else [s[0] + 1 if s else 0, start, end, 1, first, last]
        return done

    columns = [F.col(c).cast("double").alias(c) for c in ("start", "end", "first_value", "last_value")]
    return _fold(intervals, "entity", columns, "grp int, start double, end double, n_merged int", list, step, lambda s: [tuple(s[:4])])


def replay_edits(edits: DataFrame, cap: int = 30) -> DataFrame:
    """Final state of a page after its edits: toggles, undo and redo.

    ``edits`` has ``entity, turn, action`` in ``toggle, undo, redo``. A new edit
    clears what could be redone; ``cap`` edits at most can be undone.
    """

    # The state is the number of edits, whether enabled, and what can be undone and redone.
    def step(s: list, turn: object, action: str | None) -> list[tuple]:
        n, enabled, undo, redo = s
        if action == "toggle":
            enabled, undo, redo = not enabled, min(undo + 1, cap), 0
        elif action == "undo" and undo > 0:
            enabled, undo, redo = not enabled, undo - 1, redo + 1
        elif action == "redo" and redo > 0:
            enabled, undo, redo = not enabled, undo + 1, redo - 1
        s[:] = [n + 1, enabled, undo, redo]
        return []

    columns = [F.col("turn").alias("turn"), F.col("action").alias("action")]
    return _fold(edits, "entity", columns, "n_edits int, enabled boolean, undo int, redo int", lambda: [0, True, 0, 0], step, lambda s: [tuple(s)])
