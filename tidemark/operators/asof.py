"""As-of and band joins without nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: list[str],
    left_time: str,
    right_time: str,
    payload: str,
    backward: bool = True,
    exact: bool = True,
    tie: str | None = None,
) -> DataFrame:
    """Add the struct ``payload``: the right row nearest in time before (or after) each left row.

    Both sides are laid into one stream per key and the last right row seen is
    carried on: one shuffle, linear in the rows, whatever the gaps. Right rows
    at the left row's time count if ``exact``; of several at one time the one
    with the smallest ``tie`` is taken. Null if there is none.
    """
    kind = right.schema
    empty = F.lit(None).cast(kind)
    # A right row comes first in the stream where equal times match, else last.
    side = 0 if exact else 2
    order_tie = F.col(tie) if tie else F.lit(0)
    rights = right.select(*by, F.col(right_time).cast("double").alias("_at"), F.lit(side).alias("_side"), order_tie.cast("double").alias("_tie"), F.lit(None).cast(left.schema).alias("_row"), F.struct(*right.columns).alias("_seen"))
    lefts = left.select(*by, F.col(left_time).cast("double").alias("_at"), F.lit(1).alias("_side"), F.lit(0.0).alias("_tie"), F.struct(*left.columns).alias("_row"), empty.alias("_seen"))
    at = F.col("_at") if backward else -F.col("_at")
    # The carried row is the last one, so the preferred tie must come last.
    stream = W.partitionBy(*by).orderBy(at, "_side", F.col("_tie").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = lefts.unionByName(rights).withColumn("_last", F.last("_seen", ignorenulls=True).over(stream))
    return carried.where("_side = 1").select("_row.*", F.col("_last").alias(payload))


def first_at_or_after(requests: DataFrame, frames: DataFrame, by: list[str], asked: str, time: str, tie: str, payload: str) -> DataFrame:
    """Add the struct ``payload`` to every request: the first frame at or after the time asked for, null if there is none.

    Each time of a key is looked up once, however often it is asked for; the
    answers go back to all requests of that time.
    """
    found = asof_join(requests.select(*by, asked).distinct(), frames, by, asked, time, payload, backward=False, tie=tie)
    return requests.join(found, [*by, asked], "left")


def band_join(left: DataFrame, right: DataFrame, by: list[str], low: Column, high: Column, point: Column, width: float, how: str = "inner") -> DataFrame:
    """Join where ``low <= point <= high``, with ``low``/``high`` of the right and ``point`` of the left side.

    Time is cut into buckets of ``width``; a right interval is listed in every
    bucket it meets, so the join is an equi-join on key and bucket. Choose a
    width near the usual length of an interval. ``how`` may be inner,
    left_semi or left_anti.
    """
    spread = right.withColumn("_bucket", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    l, r = left.withColumn("_bucket", F.floor(point / width)).alias("l"), spread.alias("r")
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in [*by, "_bucket"]]
    inside = (point >= low) & (point <= high)
    for s in same:
        inside = inside & s
    joined = l.join(r, inside, how)
    return joined.drop("_bucket")
