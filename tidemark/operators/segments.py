"""Segmentation of ordered series: stable intervals, transitions and what lies between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import stage_table
from .asof import asof_join

_ORDER = ("t", "idx")


def _by(*keys: str):
    return W.partitionBy(*keys).orderBy(*_ORDER)


def classify(samples: DataFrame, low: float, high: float) -> DataFrame:
    """Flags ``is_low``, ``is_high`` and ``is_mid`` of each sample.

    The first sample has nothing before it and counts as high. A sample at or
    below ``low`` is low and never high.
    """
    first = F.col("idx") == 0
    is_low = ~first & (F.col("motion") <= low)
    is_high = first | (~is_low & (F.col("motion") >= high))
    return samples.withColumns({"is_low": is_low, "is_high": is_high, "is_mid": ~is_low & ~is_high})


def _count(flag: str) -> Column:
    return F.sum(F.col(flag).cast("int"))


def hysteresis(samples: DataFrame, low: float, high: float, required: int) -> DataFrame:
    """State of each sample under two thresholds.

    High samples open episodes, middling ones break an episode's low runs. The
    first run of ``required`` low samples makes the episode stable from its
    start; later middling samples are passed over. Adds ``episode``, ``member``
    (the sample belongs to the episode's interval) and ``state``. All windows
    share the partitioning by entity: one shuffle.
    """
    flags = classify(samples, low, high)
    opened = flags.withColumn("episode", _count("is_high").over(_by("entity")))
    runs = opened.withColumn("run", _count("is_mid").over(_by("entity", "episode")))
    sized = runs.withColumns(
        {
            "run_low": _count("is_low").over(W.partitionBy("entity", "episode", "run")),
            "low_so_far": _count("is_low").over(_by("entity", "episode", "run")),
        }
    )
    first_run = F.min(F.when(F.col("run_low") >= required, F.col("run"))).over(W.partitionBy("entity", "episode"))
    found = sized.withColumn("first_run", first_run)
    stable = (F.col("run") > F.col("first_run")) | ((F.col("run") == F.col("first_run")) & (F.col("low_so_far") >= required))
    return found.withColumns(
        {
            "member": F.coalesce(F.col("is_low") & (F.col("run") >= F.col("first_run")), F.lit(False)),
            "state": F.when(stable, F.lit("stable")).otherwise(F.lit("turning")),
        }
    ).drop("run_low", "low_so_far", "first_run", "run")


def stable_intervals(samples: DataFrame, low: float, high: float, required: int) -> DataFrame:
    """One row per stable interval: bounds, count and number within its entity."""
    grouped = (
        hysteresis(samples, low, high, required)
        .where("member")
        .groupBy("entity", "episode")
        .agg(
            F.min("t").alias("start"),
            F.max("t").alias("end"),
            F.min("idx").alias("first_idx"),
            F.max("idx").alias("last_idx"),
            F.count(F.lit(1)).alias("n_samples"),
        )
    )
    return grouped.withColumn("interval", F.row_number().over(W.partitionBy("entity").orderBy("start", "first_idx")))


def coarse_score(sharpness: Column, motion: Column, motion_weight: float) -> Column:
    return F.log1p(F.greatest(sharpness, F.lit(0.0))) - motion_weight * motion


def binned_candidates(samples: DataFrame, low: float, high: float, required: int, limit: int, motion_weight: float = 30.0) -> DataFrame:
    """The best sample of each of up to ``limit`` equal time bins of every interval; the earliest of equals."""
    interval = W.partitionBy("entity", "episode")
    members = hysteresis(samples, low, high, required).where("member")
    binned = members.withColumns(
        {
            "bin": F.ntile(limit).over(interval.orderBy(*_ORDER)),
            "score": coarse_score(F.col("sharpness"), F.col("motion"), motion_weight),
        }
    )
    place = F.row_number().over(W.partitionBy("entity", "episode", "bin").orderBy(F.col("score").desc(), *_ORDER))
    return binned.withColumn("_place", place).where("_place = 1").select("entity", "episode", "bin", "idx", "t", "motion", "sharpness", "score")


def primary_of_representatives(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Mark up to ``limit`` representatives per group as primary.

    The latest is always one; the earlier ones are cut into ``limit - 1`` bins
    by time and each bin's best score is taken, the later of equals. ``rows``
    has the keys, ``idx`` and ``score``.
    """
    group = W.partitionBy(*keys)
    marked = rows.withColumn("_latest", F.col("idx") == F.max("idx").over(group))
    bins = W.partitionBy(*keys, "_latest").orderBy("idx")
    binned = marked.withColumn("_bin", F.ntile(max(limit - 1, 1)).over(bins))
    best = F.row_number().over(W.partitionBy(*keys, "_latest", "_bin").orderBy(F.col("score").desc(), F.col("idx").desc()))
    picked = F.col("_latest") | ((F.col("_best") == 1) & F.lit(limit > 1))
    return binned.withColumn("_best", best).withColumn("is_primary", picked).drop("_latest", "_bin", "_best")


def turn_runs(samples: DataFrame, low: float, high: float, fps: float) -> DataFrame:
    """Samples from the first high run on, with their transition event's number ``event``.

    Runs of samples at or above ``high`` are parts of one event unless they
    are ``max(.15, 1.5 / fps)`` seconds apart and the quietest sample between
    them is at or below 55 % of the way from ``low`` to ``high``. The first
    sample of a series is left out. All windows share the partitioning by
    entity: one shuffle and no join.
    """
    order, run = _by("entity"), W.partitionBy("entity", "run")
    body = samples.where("idx > 0").withColumn("hi", F.col("motion") >= high)
    starts = body.withColumn("_start", (F.col("hi") & ~F.coalesce(F.lag("hi").over(order), F.lit(False))).cast("int"))
    ran = starts.withColumn("run", F.sum("_start").over(order)).where("run > 0")
    # A run's end and valley are known at each of its rows, so at the row before the next run.
    sized = ran.withColumns(
        {"_end": F.max(F.when(F.col("hi"), F.col("t"))).over(run), "_valley": F.min(F.when(~F.col("hi"), F.col("motion"))).over(run)}
    )
    apart = F.col("t") - F.lag("_end").over(order) >= max(0.15, 1.5 / max(fps, 1.0))
    quiet = F.coalesce(F.lag("_valley").over(order), F.lit(high)) <= low + 0.55 * (high - low)
    opens = F.when((F.col("_start") == 1) & (F.lag("run").over(order).isNull() | (apart & quiet)), 1).otherwise(0)
    return sized.withColumn("_new", opens).withColumn("event", F.sum("_new").over(order)).drop("_start", "_end", "_valley", "_new")


def turn_events(samples: DataFrame, low: float, high: float, fps: float) -> DataFrame:
    """Transition events: bounds, peak (the earliest of equals) and number of high samples."""
    peak = F.max(F.when(F.col("hi"), F.struct("motion", (-F.col("t")).alias("minus_t"))))
    return (
        turn_runs(samples, low, high, fps)
        .groupBy("entity", "event")
        .agg(
            F.min(F.when(F.col("hi"), F.col("t"))).alias("start"),
            F.max(F.when(F.col("hi"), F.col("t"))).alias("end"),
            peak.alias("peak"),
            F.count_if("hi").alias("n_samples"),
        )
        .select(
            "entity",
            "event",
            F.format_string("turn_%04d", "event").alias("id"),
            "start",
            "end",
            (-F.col("peak.minus_t")).alias("peak_time"),
            F.col("peak.motion").alias("peak_motion"),
            "n_samples",
        )
    )


def missing_windows(samples: DataFrame, low: float, high: float, required: int, fps: float) -> DataFrame:
    """Windows between neighbouring events without an interval, with their quietest sample.

    A window counts if no interval's midpoint lies strictly between the two
    events' peaks and its quietest sample (the earliest of equals) is at or
    below 65 % of the way from ``low`` to ``high``. ``before`` and ``after``
    are the intervals that end or start nearest to that sample. All matching is
    by event number or in one ordered stream per entity; intervals are written
    once, as three matches read them.
    """
    of_event = W.partitionBy("entity", "event")
    ahead = _by("entity").rowsBetween(1, W.unboundedFollowing)
    marked = turn_runs(samples, low, high, fps).withColumns(
        {"_end": F.max(F.when(F.col("hi"), F.col("t"))).over(of_event), "_later": F.first(F.when(F.col("hi"), F.col("t")), ignorenulls=True).over(ahead)}
    )
    inside = ~F.col("hi") & (F.col("t") > F.col("_end")) & (F.col("t") < F.col("_later"))
    peak = F.max(F.when(F.col("hi"), F.struct("motion", (-F.col("t")).alias("minus_t"))))
    # Events with the quietest sample after each come from one pass.
    events = marked.groupBy("entity", "event").agg(
        F.min(F.when(F.col("hi"), F.col("t"))).alias("start"), F.max("_end").alias("window_start"), peak.alias("peak"), F.min(F.when(inside, F.struct("motion", "t"))).alias("best")
    )
    nxt = W.partitionBy("entity").orderBy("event")
    paired = events.select(
        "entity",
        "event",
        F.format_string("turn_%04d", "event").alias("left_turn"),
        F.format_string("turn_%04d", F.lead("event").over(nxt)).alias("right_turn"),
        "window_start",
        F.lead("start").over(nxt).alias("window_end"),
        (-F.col("peak.minus_t")).alias("left_peak"),
        (-F.lead("peak.minus_t").over(nxt)).alias("right_peak"),
        "best",
    )
    pairs = paired.where((F.col("window_end") > F.col("window_start")) & (F.col("best.motion") <= low + 0.65 * (high - low)))
    segments = stage_table(stable_intervals(samples, low, high, required).select("entity", "interval", "start", "end"), "intervals")
    middles = segments.select("entity", ((F.col("start") + F.col("end")) / 2).alias("mid"))
    # The first midpoint after the left peak lies before the right one, or none does.
    near = asof_join(pairs, middles, ["entity"], "left_peak", "mid", "_mid", backward=False, exact=False)
    empty = near.where("_mid is null or _mid.mid >= right_peak")
    found = empty.select("entity", F.concat_ws("-", "left_turn", "right_turn").alias("id"), F.col("best.t").alias("time"), F.col("best.motion").alias("motion"), "window_start", "window_end", "left_turn", "right_turn")
    return with_neighbours(found, segments)


def with_neighbours(points: DataFrame, segments: DataFrame) -> DataFrame:
    """Add ``before`` and ``after``: the intervals that end at or before, or start at or after, each point."""
    a = asof_join(points, segments, ["entity"], "time", "end", "_before", tie="interval")
    b = asof_join(a, segments, ["entity"], "time", "start", "_after", backward=False, tie="interval")
    return b.withColumns({"before": F.col("_before.interval"), "after": F.col("_after.interval")}).drop("_before", "_after")


def longest_low_run(samples: DataFrame, low: float, fps: float, min_seconds: float) -> DataFrame:
    """Per entity the best run of low samples: the longest, then sharpest, then quietest, then earliest.

    Runs shorter than ``max(2, ceil(fps * min_seconds))`` samples don't count.
    """
    least = max(2, -int(-fps * min_seconds // 1))
    flagged = samples.withColumn("is_low", F.col("motion") <= low)
    islands = flagged.withColumn("island", F.sum((~F.col("is_low")).cast("int")).over(_by("entity"))).where("is_low")
    runs = (
        islands.groupBy("entity", "island")
        .agg(
            F.min("t").alias("start"),
            F.max("t").alias("end"),
            F.count(F.lit(1)).alias("n_samples"),
            F.round(F.avg("sharpness"), 9).alias("mean_sharpness"),
            F.round(F.avg("motion"), 9).alias("mean_motion"),
        )
        .where(F.col("n_samples") >= least)
    )
    best = W.partitionBy("entity").orderBy((F.col("end") - F.col("start")).desc(), F.col("mean_sharpness").desc(), "mean_motion", "start", "island")
    return runs.withColumn("_place", F.row_number().over(best)).where("_place = 1").drop("_place", "island")


def interval_gap_flags(intervals: DataFrame, factor: float = 3.0) -> DataFrame:
    """Gap between each interval's start and the one before; flagged if above ``factor`` times the median."""
    order = W.partitionBy("entity").orderBy("start", "interval")
    gaps = intervals.withColumn("gap", F.col("start") - F.lag("start").over(order))
    typical = F.coalesce(F.median("gap").over(W.partitionBy("entity")), F.lit(0.0))
    return gaps.withColumn("typical_gap", typical).withColumn(
        "interval_gap", F.coalesce((F.col("typical_gap") > 0) & (F.col("gap") > F.col("typical_gap") * factor), F.lit(False))
    )


def cadence_gaps(points: DataFrame, factor: float = 1.8, most: int = 4) -> DataFrame:
    """Evenly spaced guesses inside unusually long gaps of a cadence.

    ``points`` has ``entity, interval, start``. An entity needs three points
    and two positive gaps. A gap of ``factor`` medians or more gets one guess
    less than its rounded multiple, between 1 and ``most``.
    """
    group = W.partitionBy("entity")
    order = group.orderBy("start", "interval")
    gaps = points.withColumns(
        {"prev": F.lag("start").over(order), "prev_interval": F.lag("interval").over(order), "n_points": F.count(F.lit(1)).over(group)}
    ).withColumn("gap", F.col("start") - F.col("prev"))
    positive = F.when(F.col("gap") > 0, F.col("gap"))
    typical = gaps.withColumns({"typical_gap": F.median(positive).over(group), "n_gaps": F.count(positive).over(group)})
    rated = typical.where("n_points >= 3 and n_gaps >= 2 and typical_gap > 0").withColumn("ratio", F.col("gap") / F.col("typical_gap")).where(F.col("ratio") >= factor)
    counted = rated.withColumn("n_missing", F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.col("ratio") + 0.5).cast("int") - 1)))
    spread = counted.withColumn("position", F.explode(F.sequence(F.lit(1), F.col("n_missing"))))
    return spread.select("entity", F.col("prev_interval").alias("before"), F.col("interval").alias("after"), "position", "n_missing", (F.col("prev") + F.col("gap") * F.col("position") / (F.col("n_missing") + 1)).alias("time"), "gap", "typical_gap")
