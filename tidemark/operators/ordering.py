"""Places and running sums in a global order, without a global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import stage_table

#: So many rows, where their number is known, are ordered by one task.
ONE_TASK = 100_000
#: monotonically_increasing_id has the task's number from this bit on.
_TASK_BIT = 33


def unused(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` has not, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def in_order(
    df: DataFrame, order: list[Column], place: str = "place", total: str | None = None, sums: dict[str, str] | None = None, rows: int | None = None
) -> DataFrame:
    """Add each row's ``place`` from 0 in the order of ``order``.

    ``total`` names a column for the number of all rows; ``sums`` maps a column
    to the name of its sum over all rows before the row. Rows that ``order``
    doesn't tell apart take any of their places.

    Rows are dealt by ranges, sorted task by task and written; then each task's
    rows and sums are added up, and what lies before a task is added to the
    places inside it. The only window without a partitioning runs over one row
    per task of the sort. Give ``rows``, where the number of rows was counted:
    up to ``ONE_TASK`` of them are ordered at once.
    """
    sums = sums or {}
    if rows is not None and rows <= ONE_TASK:
        lower = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        placed = df.withColumn(place, (F.row_number().over(W.orderBy(*order)) - 1).cast("long"))
        if total:
            placed = placed.withColumn(total, F.lit(rows).cast("long"))
        return placed.withColumns({name: F.coalesce(F.sum(c).over(lower), F.lit(0)) for c, name in sums.items()})
    at, task, first = unused(df, "at"), unused(df, "task"), unused(df, "first")
    before = {c: unused(df, f"before_{c}") for c in sums}
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    run = stage_table(spread.withColumn(at, F.monotonically_increasing_id()), "ordered").withColumn(task, F.shiftright(at, _TASK_BIT))
    upto = W.orderBy(task).rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    tasks = run.groupBy(task).agg(F.count(F.lit(1)).alias(first), *[F.sum(c).alias(before[c]) for c in sums])
    offsets = tasks.select(
        task,
        F.coalesce(F.sum(first).over(upto), F.lit(0)).alias(first),
        *([F.sum(first).over(everything).alias(total)] if total else []),
        *[F.coalesce(F.sum(b).over(upto), F.lit(0)).alias(b) for b in before.values()],
    )
    placed = run.join(F.broadcast(offsets), task).withColumn(place, F.col(first) + F.col(at).bitwiseAND(F.lit((1 << _TASK_BIT) - 1)))
    inside = W.partitionBy(task).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    for c, name in sums.items():
        placed = placed.withColumn(name, F.col(before[c]) + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return placed.drop(at, task, first, *before.values())
