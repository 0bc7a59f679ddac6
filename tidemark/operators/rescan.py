"""A second, denser pass over parts of a series that the first pass leaves in doubt.

Windows come from the first pass. Samples of the denser series are joined to
them by time buckets, put on the window's own grid and measured anew inside it;
what is found is merged with what was known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .asof import asof_join, band_join
from .folds import _fold, span_groups
from .resample import on_grid


def effective_rate(requested: float, source: float | None, analysed: float) -> float | None:
    """The rate of a second pass: that asked for, no more than the source has; None if the first pass was as dense."""
    rate = min(requested, source) if source and source > 0 else requested
    return None if rate <= analysed + 1e-6 else rate


def grouped_windows(windows: DataFrame, max_gap: float, max_span: float) -> DataFrame:
    """Add ``grp, grp_start, grp_end``: windows of an entity near enough to be read together.

    ``windows`` has ``entity, window_start, window_end``; those of an entity
    follow each other.
    """
    spans = windows.select("entity", F.col("window_start").alias("start"), F.col("window_end").alias("end"))
    groups = span_groups(spans, max_gap, max_span).select("entity", "grp", F.col("start").alias("grp_start"), F.col("end").alias("grp_end"))
    found = asof_join(windows, groups, ["entity"], "window_start", "grp_start", "_group")
    return found.select("*", *[F.col("_group")[c].alias(c) for c in ("grp", "grp_start", "grp_end")]).drop("_group")


def samples_of_groups(dense: DataFrame, groups: DataFrame, rate: float, width: float) -> DataFrame:
    """The samples of the denser series that lie in a group of windows, on a grid that begins at the group's start.

    ``dense`` has ``entity, t`` and whatever was measured; its columns of other
    names are kept. Samples are matched by buckets of ``width``, so that none
    outside of the groups goes further than the join; give that part of the
    series alone where the source can be pruned by time.
    """
    spans = groups.select(F.col("entity").alias("_entity"), "grp", "grp_start", "grp_end").distinct()
    bucketed = dense.withColumn("_entity", F.col("entity"))
    inside = band_join(bucketed, spans, ["_entity"], F.col("grp_start"), F.col("grp_end") + 0.5 / rate, F.col("t"), width)
    kept = inside.select(*dense.columns, "grp", "grp_start")
    return on_grid(kept, rate, ["entity", "grp"], "grp_start", order=("t", *[c for c in dense.columns if c not in ("entity", "t")]))


def samples_in_windows(sampled: DataFrame, windows: DataFrame, key: str, rate: float, width: float, change: Column, first_motion: float = 1.0) -> DataFrame:
    """Samples of each window with ``n`` (their place from 0) and ``motion``, the change since the sample before.

    ``sampled`` comes from ``samples_of_groups``; ``change`` is an expression over
    it in which ``before`` is a struct of the window's sample before. Half a
    grid step beyond either end still belongs to a window, so a sample may
    belong to two. The first one has nothing before it and counts as moving.
    """
    half = 0.5 / rate
    spans = windows.select(F.col("entity").alias("_entity"), F.col("grp").alias("_grp"), key, "window_start", "window_end")
    keyed = sampled.withColumns({"_entity": F.col("entity"), "_grp": F.col("grp")})
    found = band_join(keyed, spans, ["_entity", "_grp"], F.col("window_start") - half, F.col("window_end") + half, F.col("time"), width)
    rows = found.select(*sampled.columns, key, "window_start", "window_end")
    order = W.partitionBy("entity", key).orderBy("time")
    before = rows.withColumns({"n": F.row_number().over(order) - 1, "before": F.lag(F.struct(*sampled.columns)).over(order)})
    return before.withColumn("motion", F.when(F.col("before").isNull(), F.lit(first_motion)).otherwise(change)).drop("before")


def best_runs(samples: DataFrame, keys: list[str], low: float, least: int) -> DataFrame:
    """Per window its best run of samples at or below ``low``: ``start, end, n_samples`` and, of its quietest sample, ``time, motion, look``.

    The longest counts, then the sharpest, the quietest and the earliest; runs
    of less than ``least`` samples don't. ``samples`` has ``n, time, motion,
    sharpness, look``.
    """
    order = W.partitionBy(*keys).orderBy("n")
    flagged = samples.withColumn("_low", F.col("motion") <= low)
    islands = flagged.withColumn("_island", F.sum((~F.col("_low")).cast("int")).over(order)).where("_low")
    runs = islands.groupBy(*keys, "_island").agg(
        F.min("time").alias("start"),
        F.max("time").alias("end"),
        F.count(F.lit(1)).alias("n_samples"),
        F.round(F.avg("sharpness"), 9).alias("_sharp"),
        F.round(F.avg("motion"), 9).alias("_mean"),
        F.min(F.struct("motion", "time", "look")).alias("_quiet"),
    )
    best = W.partitionBy(*keys).orderBy((F.col("end") - F.col("start")).desc(), F.col("_sharp").desc(), "_mean", "start")
    chosen = runs.where(F.col("n_samples") >= least).withColumn("_place", F.row_number().over(best)).where("_place = 1")
    return chosen.select(*keys, "start", "end", "n_samples", "_quiet.time", "_quiet.motion", "_quiet.look")


def recovered_or_merged(runs: DataFrame, segments: DataFrame, max_seconds: float, max_away: float, max_change: float, nearest: int = 3) -> DataFrame:
    """Whether each run found is a segment of its own: ``entity, start, target_start``, null where it is.

    A run no longer than ``max_seconds`` is tried against the ``nearest``
    segments, by the distance of their nearer end from the run's quietest
    sample, those recovered from runs before it included. It belongs to the
    first one whose edge on its side lies ``max_away`` or less from that sample
    and looks alike (``max_change`` or less). Of equally near ones segments of
    the first pass come first, then earlier ones.

    ``runs`` has ``entity, start, end, time, look``; ``segments`` has ``entity,
    start, end, first_look, last_look`` and those of an entity don't overlap.
    One stream per entity; its state is the runs not decided yet, which are
    those since the third segment before, and the segments around them.
    """
    # Rows of the stream: time, whether a run, start, end, looks at either end (of a run, its quietest sample's).
    columns = ["entity", "at", "is_run", "start", "end", "a", "b"]
    segs = segments.select("entity", F.col("start").alias("at"), F.lit(0).alias("is_run"), "start", "end", F.col("first_look").alias("a"), F.col("last_look").alias("b"))
    found = runs.select("entity", F.col("time").alias("at"), F.lit(1).alias("is_run"), "start", "end", F.col("look").alias("a"), F.col("look").alias("b"))
    stream = segs.unionByName(found).select(*columns)

    def near(at: float, segment: tuple) -> tuple:
        start, end, _, _, made = segment
        return min(abs(at - start), abs(at - end)), made, start

    def decide(state: dict) -> list[tuple]:
        at, start, end, look = state["open"].pop(0)[:4]
        target = None
        if end - start <= max_seconds:
            for s_start, s_end, a, b, _ in sorted(state["known"], key=lambda s: near(at, s))[:nearest]:
                edge, seen = (s_end, b) if s_end <= at else (s_start, a)
                if abs(edge - at) <= max_away and look is not None and seen is not None and abs(look - seen) <= max_change:
                    target = s_start
                    break
        if target is None:
            state["known"].append((start, end, look, look, 1))
        return [(start, target)]

    def step(state: dict, at: float, is_run: int, start: float, end: float, a: float | None, b: float | None) -> list[tuple]:
        if is_run:
            state["open"].append([at, start, end, a, 0])
            return []
        state["known"].append((start, end, a, b, 0))
        for run in state["open"]:
            run[4] += 1
        out = []
        while state["open"] and state["open"][0][4] >= nearest:
            out += decide(state)
        if not state["open"]:
            # Of what lies behind, no more than the last few can be among the nearest.
            state["known"] = sorted(state["known"])[-nearest:]
        return out

    def close(state: dict) -> list[tuple]:
        out = []
        while state["open"]:
            out += decide(state)
        return out

    typed = [F.col("at").cast("double").alias("at"), F.col("is_run"), *[F.col(c).cast("double").alias(c) for c in columns[3:]]]
    return _fold(stream, "entity", typed, "start double, target_start double", lambda: {"known": [], "open": []}, step, close)


def chosen_of_bins(samples: DataFrame, keys: list[str], limit: int, motion_weight: float = 30.0) -> DataFrame:
    """One sample of each of up to ``limit`` equal bins of a window's samples, the sharp and still one, the earliest of equals."""
    order = W.partitionBy(*keys).orderBy("n")
    scored = samples.withColumns({"bin": F.ntile(limit).over(order), "score": F.round(F.log1p(F.col("sharpness")) - motion_weight * F.col("motion"), 9)})
    best = F.row_number().over(W.partitionBy(*keys, "bin").orderBy(F.col("score").desc(), "n"))
    return scored.withColumn("_best", best).where("_best = 1").drop("_best")


def added_candidates(picked: DataFrame, known: DataFrame, keys: list[str], tolerance: float, width: float) -> DataFrame:
    """Known candidates and, after them, those picked that lie more than ``tolerance`` from all known ones of their key.

    ``known`` has the keys, ``cand, t`` and ``chosen``; new ones are numbered
    on by time. What was chosen stays chosen, and nothing new is. Adds
    ``rescanned``.
    """
    spans = known.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("t").alias("_t"))
    asked = picked.select(*keys, F.col("time").alias("t"), *[F.col(k).alias(f"_{k}") for k in keys])
    new = band_join(asked, spans, [f"_{k}" for k in keys], F.col("_t") - tolerance, F.col("_t") + tolerance, F.col("t"), width, "left_anti").select(*keys, "t")
    rows = known.select(*keys, "cand", "t", "chosen", F.lit(False).alias("rescanned")).unionByName(
        new.select(*keys, F.lit(None).cast("long").alias("cand"), "t", F.lit(False).alias("chosen"), F.lit(True).alias("rescanned"))
    )
    group = W.partitionBy(*keys)
    number = F.row_number().over(W.partitionBy(*keys, "rescanned").orderBy("t"))
    last = F.coalesce(F.max("cand").over(group), F.lit(-1))
    return rows.withColumn("_last", last).withColumn("cand", F.coalesce(F.col("cand"), F.col("_last") + number)).drop("_last")
