"""Series on fixed grids: the sample that a grid point shows, checks of a series' length, values between points, smoothing along rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Grid points of one sample are listed in blocks of so many, so that no row holds a long list.
_BLOCK = 4096


def slot_of(time: Column, origin: Column, rate: Column | float) -> Column:
    """The grid point that a time is nearest to; halves go to the later one."""
    return F.floor((time - origin) * rate + 0.5).cast("long")


def _each_slot(first: Column, after: Column, rows: DataFrame, name: str) -> DataFrame:
    """A row for each whole number from ``first`` to before ``after``, listed block by block."""
    n = after - first
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / _BLOCK).cast("long"))
    in_block = rows.withColumns({"_first": first, "_many": n}).where("_many > 0").withColumn("_block", F.explode(blocks))
    begin = F.col("_block") * _BLOCK
    inside = F.sequence(begin, F.least(begin + _BLOCK, F.col("_many")) - 1)
    return in_block.withColumn(name, F.explode(inside)).withColumn(name, F.col(name) + F.col("_first")).drop("_first", "_many", "_block")


def on_grid(samples: DataFrame, rate: Column | float, by: list[str], start: str | None = None, order: tuple[str, ...] = ("t",)) -> DataFrame:
    """A series at ``rate`` points per unit of time: the sample shown at each grid point.

    Grid point k lies at ``start + k / rate``; ``start`` is a column that is
    equal over a series (``by``), or the series' first time. Samples before it
    are left out, and the first one after it is taken for its begin, as a
    source read from there gives it. A sample belongs to its nearest grid point; a point shows the
    last sample that belongs to it or to a point before. So a rate above the
    samples' own repeats them and one below leaves some out; the last point is
    that of the last sample. Adds ``k, time, repeated`` (the point before shows
    the same sample) and ``passed`` (samples of the point that it doesn't show).

    One shuffle by series and linear in samples and grid points. Null times and
    series without samples give no rows; of equal times the last in ``order``
    counts.
    """
    series = W.partitionBy(*by)
    kept = samples.where(F.col("t").isNotNull() & (F.col("t") >= F.col(start) if start else F.lit(True)))
    placed = kept.withColumn("_slot", slot_of(F.col("t"), F.min("t").over(series), rate)).withColumn("_begin", F.col(start) if start else F.min("t").over(series))
    point = series.orderBy("_slot")
    last = placed.withColumns(
        {
            "_behind": F.row_number().over(W.partitionBy(*by, "_slot").orderBy(*[F.col(c).desc() for c in order])),
            "passed": F.count(F.lit(1)).over(W.partitionBy(*by, "_slot")) - 1,
        }
    ).where("_behind = 1")
    until = last.withColumn("_next", F.coalesce(F.lead("_slot").over(point), F.col("_slot") + 1))
    rows = _each_slot(F.col("_slot"), F.col("_next"), until, "k")
    repeated = F.col("k") > F.col("_slot")
    return rows.withColumns(
        {"time": F.col("_begin") + F.col("k") / rate, "repeated": repeated, "passed": F.when(repeated, F.lit(0).cast("long")).otherwise(F.col("passed"))}
    ).drop("_slot", "_begin", "_behind", "_next")


def grid_checks(samples: DataFrame, expected: DataFrame, rate: float, by: list[str]) -> DataFrame:
    """Whether each series covers the time it should: ``n_points, n_wanted, status``.

    ``expected`` has ``by`` and ``duration``, each series once. A series that
    ends more than one grid point before its duration is ``truncated``, one
    without samples ``empty``, one of no known or positive duration
    ``unknown``; else it is ``ok``.
    """
    ends = samples.where("t is not null").groupBy(*by).agg(F.min("t").alias("_first"), F.max("t").alias("_last"))
    joined = expected.select(*by, "duration").join(ends, by, "left")
    points = F.coalesce(slot_of(F.col("_last"), F.col("_first"), rate) + 1, F.lit(0)).cast("long")
    wanted = F.when(F.col("duration") > 0, F.floor(F.col("duration") * rate + 0.5).cast("long"))
    status = (
        F.when(F.col("n_points") == 0, "empty").when(F.col("n_wanted").isNull(), "unknown").when(F.col("n_points") < F.col("n_wanted") - 1, "truncated").otherwise("ok")
    )
    return joined.withColumns({"n_points": points, "n_wanted": wanted}).withColumn("status", status).select(*by, "n_points", "n_wanted", "status")


def interpolated(points: DataFrame, wanted: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Add ``y`` to each row of ``wanted``, on the straight line between the points before and after its ``x``.

    Outside of the points the first or last value holds. Of points with equal
    ``x`` the largest value counts to the right of them and at the place
    itself, the smallest to the left. Keys without points, and null places,
    have null; null points are left out; rows of ``wanted`` that are equal stay.

    Points and wanted rows are laid into one stream per key and both neighbours
    carried on from either side: one shuffle, linear in the rows.
    """
    known = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"), F.lit(0).alias("_side"), F.col(y).cast("double").alias("_y"), F.lit(None).cast(wanted.schema).alias("_row"))
    asked = wanted.select(*by, F.col(x).cast("double").alias("_x"), F.lit(1).alias("_side"), F.lit(None).cast("double").alias("_y"), F.struct(*wanted.columns).alias("_row"))
    stream = W.partitionBy(*by).orderBy("_x", "_side", "_y")
    point = F.when(F.col("_side") == 0, F.struct("_x", "_y"))
    laid = known.unionByName(asked).withColumns(
        {
            "_a": F.last(point, ignorenulls=True).over(stream.rowsBetween(W.unboundedPreceding, W.currentRow)),
            "_b": F.first(point, ignorenulls=True).over(stream.rowsBetween(W.currentRow, W.unboundedFollowing)),
        }
    )
    a, b = F.col("_a"), F.col("_b")
    slope = (b["_y"] - a["_y"]) / (b["_x"] - a["_x"])
    value = F.when(F.col("_x").isNull(), F.lit(None)).when(a.isNull(), b["_y"]).when(b.isNull(), a["_y"]).otherwise(a["_y"] + slope * (F.col("_x") - a["_x"]))
    return laid.where("_side = 1").withColumn(y, value).select("_row.*", y)


def gaussian_weights(width: int) -> list[float]:
    """Weights of a smoothing window of ``width`` rows, which is odd; its deviation is a quarter of the width, at least 1. They add up to 1."""
    sigma, middle = max(1.0, width / 4), (width - 1) / 2
    raw = [math.exp(-((i - middle) ** 2) / (2 * sigma * sigma)) for i in range(width)]
    return [w / sum(raw) for w in raw]


def window_of_rows(n: Column, share: float = 0.05, least: int = 3, most: int = 81) -> Column:
    """Width of the smoothing window of a run of ``n`` rows: a share of them, odd, no more than there are."""
    rounded = F.greatest(F.lit(least), F.least(F.lit(most), F.bround(n * share).cast("int")))
    odd = rounded + F.when(rounded % 2 == 0, 1).otherwise(0)
    return F.when((odd > n) & (n > 1), n - F.when(n % 2 == 0, 1).otherwise(0)).otherwise(odd).cast("int")


def smoothed_rows(rows: DataFrame, by: list[str], place: str, value: str, n: str, most: int = 81) -> DataFrame:
    """Replace ``value`` by its Gaussian mean over the rows around, in the order of ``place``.

    Rows of a key are numbered from 0 to before ``n``; beyond either end the
    first or last value is repeated. Keys of different ``n`` have windows of
    different widths; a window of less than 3 rows changes nothing. Each row
    looks at ``most`` rows at most.
    """
    series = W.partitionBy(*by).orderBy(place)
    pad = most // 2
    width = window_of_rows(F.col(n), most=most)
    kernels = F.create_map(*[x for w in range(3, most + 1, 2) for x in (F.lit(w), F.array(*map(F.lit, gaussian_weights(w))))])
    whole = W.partitionBy(*by).orderBy(place).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    near = rows.withColumns(
        {
            "_w": width,
            "_near": F.collect_list(value).over(series.rowsBetween(-pad, pad)),
            "_first": F.first(value).over(whole),
            "_last": F.last(value).over(whole),
        }
    )
    # The list starts ``before`` rows before this one; what a window misses at either end is padded.
    half, before = F.floor(F.col("_w") / 2).cast("int"), F.least(F.col(place), F.lit(pad)).cast("int")
    left = F.greatest(F.lit(0), half - F.col(place)).cast("int")
    right = F.greatest(F.lit(0), F.col(place) + half - (F.col(n) - 1)).cast("int")
    inside = F.slice(F.col("_near"), before - F.least(half, F.col(place)).cast("int") + 1, F.col("_w") - left - right)
    padded = F.concat(F.array_repeat("_first", left), inside, F.array_repeat("_last", right))
    weighted = F.aggregate(F.zip_with(padded, kernels[F.col("_w")], lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)
    return near.withColumn(value, F.when(F.col("_w") >= 3, weighted).otherwise(F.col(value))).drop("_w", "_near", "_first", "_last")


def row_strengths(points: DataFrame, sizes: DataFrame, by: list[str], fallback: float = 0.0, most: float = 0.35) -> DataFrame:
    """A strength for each row of a raster from a profile of a few points: ``by, row, strength``.

    ``points`` has ``by, y`` (0 at the top, 1 at the bottom) and ``strength``;
    ``sizes`` has ``by, height``. Places and strengths are cut to their ranges.
    Rows between points are interpolated and smoothed; a single point holds for
    all rows, and a key without points has ``fallback`` throughout. Heights of
    0 or less, or null, give no rows.
    """
    cut = lambda v, top: F.least(F.lit(top), F.greatest(F.lit(0.0), v))
    sized = sizes.where("height > 0").select(*by, F.col("height").cast("long").alias("_n"))
    placed = points.join(sized, by).select(*by, (cut(F.col("y"), 1.0) * F.greatest(F.lit(1), F.col("_n") - 1)).alias("_at"), cut(F.col("strength"), most).alias("strength"))
    counts = placed.where("_at is not null and strength is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("_points"))
    rows = _each_slot(F.lit(0).cast("long"), F.col("_n"), sized.join(counts, by, "left"), "row").withColumn("_at", F.col("row").cast("double"))
    between = interpolated(placed, rows, by, "_at", "strength")
    many = smoothed_rows(between, by, "row", "strength", "_n").withColumn("strength", cut(F.col("strength"), most))
    # Smoothing a constant changes nothing, so one point needs no case of its own.
    return many.select(*by, "row", F.when(F.col("_points").isNull(), F.lit(float(fallback))).otherwise(F.col("strength")).alias("strength"))


def profile_at(points: DataFrame, centres: list[float], by: list[str], x: str, y: str, most: float) -> DataFrame:
    """A profile's values at given ascending centres, each mixed with a fifth of either neighbour: ``by, place, x, y``.

    Profiles of less than two points are left out. Beyond the first and last
    centre the value there is repeated; values are cut to 0 and ``most``.
    """
    enough = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 2").select(*by)
    wanted = enough.select("*", F.posexplode(F.array(*map(F.lit, centres))).alias("place", x))
    at = interpolated(points, wanted, by, x, y)
    order = W.partitionBy(*by).orderBy("place")
    value = F.col(y)
    mixed = 0.2 * F.coalesce(F.lag(y).over(order), value) + 0.6 * value + 0.2 * F.coalesce(F.lead(y).over(order), value)
    return at.withColumn(y, F.least(F.lit(most), F.greatest(F.lit(0.0), mixed)))
