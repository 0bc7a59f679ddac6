"""Scores, reasons and choices among the candidates of a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.config import Config

# Reason codes and the named sets of them.
BLOCKING = ["low_sharpness", "glare_overlap", "high_motion", "page_quad_uncertain", "underexposed"]
STAGED = [*BLOCKING, "hand_overlap"]
RECOVERABLE = ["low_sharpness", "hand_overlap", "glare_overlap", "high_motion"]
FIX_TRIGGERS = [
    "low_sharpness", "high_motion", "hand_overlap", "glare_overlap", "finger_repair_incomplete",
    "occlusion_repair_incomplete", "final_unresolved_finger", "final_finger_repair_residual", "final_glare_residual",
]
FIX_RISKS = [
    "low_sharpness", "high_motion", "hand_overlap", "glare_overlap",
    "page_quad_uncertain", "underexposed", "source_frame_clipped", "page_contour_low_confidence",
]
#: Weight of each measure in the relative score, and whether more is better.
RELATIVE = {"focus": (0.35, True), "motion": (0.15, False), "hand": (0.20, False), "glare": (0.10, False), "score": (0.20, True)}


def codes(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def composite_score(c: Config) -> Column:
    """Weighted absolute score; a measure that was not taken costs nothing."""
    return (
        c.sharpness_weight * F.log1p("sharpness") / 8
        - c.motion_weight * F.least(F.lit(1.0), F.col("motion") / c.turn_threshold)
        - c.hand_overlap_weight * F.coalesce("hand", F.lit(0.0))
        - c.glare_overlap_weight * F.coalesce("glare", F.lit(0.0))
        - c.distortion_weight * F.col("distortion")
        - c.flatness_weight * F.col("flatness")
        - c.clipping_weight * F.col("clipping")
        - c.exposure_weight * F.col("exposure")
    )


def suspect_reasons(c: Config) -> Column:
    """Codes of what is wrong with a candidate, in fixed order."""
    checks = [
        (F.col("sharpness") < c.suspect_sharpness, "low_sharpness"),
        (F.col("hand").isNull(), "hand_detection_disabled"),
        (F.col("hand") > c.suspect_hand_overlap, "hand_overlap"),
        (F.coalesce("glare", F.lit(0.0)) > c.suspect_glare_overlap, "glare_overlap"),
        (F.col("motion") > c.motion_threshold, "high_motion"),
        (F.col("distortion") > 0.25, "page_quad_uncertain"),
        (F.col("exposure") > 0.3, "underexposed"),
    ]
    return F.array_compact(F.array(*[F.when(test, F.lit(code)) for test, code in checks]))


def scored(candidates: DataFrame, c: Config) -> DataFrame:
    return candidates.withColumns(
        {
            "score": F.round(composite_score(c), 9),
            "focus": F.round(F.log1p(F.greatest("sharpness", F.lit(0.0))) / 8, 9),
            "suspect": suspect_reasons(c),
        }
    )


def mid_rank(value: str, group: list[str], more_is_better: bool) -> Column:
    """Rank of a value in its group from 0 to 1; ties share their middle rank.

    Null, NaN and infinities have no rank and don't count. One value alone, or
    values that are all equal, rank one half. All windows are partitioned by
    the group alone, so any number of measures shares one shuffle.
    """
    x = F.when(finite(F.col(value)), F.col(value))
    g = W.partitionBy(*group)
    ordered = g.orderBy(x.asc_nulls_last())
    n = F.count(x).over(g)
    lower = F.rank().over(ordered) - 1
    ties = F.count(x).over(ordered.rangeBetween(W.currentRow, W.currentRow))
    flat = (n <= 1) | (F.max(x).over(g) - F.min(x).over(g) <= 1e-12)
    rank = (lower + (ties - 1) / 2) / (n - 1)
    rank = rank if more_is_better else 1 - rank
    return F.when(x.isNull(), F.lit(None)).otherwise(F.when(flat, F.lit(0.5)).otherwise(rank))


def relative_scores(candidates: DataFrame, group: list[str]) -> DataFrame:
    """Add ``rel_<measure>`` and ``selection_score``, weighted over the measures that exist."""
    ranked = candidates.withColumns({f"rel_{m}": mid_rank(m, group, better) for m, (_, better) in RELATIVE.items()})
    total = sum((F.coalesce(F.col(f"rel_{m}"), F.lit(0.0)) * w for m, (w, _) in RELATIVE.items()), F.lit(0.0))
    weight = sum((F.when(F.col(f"rel_{m}").isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for m, (w, _) in RELATIVE.items()), F.lit(0.0))
    value = F.when(weight > 0, total / weight).otherwise(F.coalesce("score", F.lit(0.0)))
    return ranked.withColumn("selection_score", F.round(value, 9))


def with_places(candidates: DataFrame, group: list[str]) -> DataFrame:
    """Add ``place``: the order of choice among the candidates of each group, from 1.

    Candidates without a blocking reason come first; where there is none, all
    count. Of these the best selection score (the first of equals) is taken,
    unless others have clearly less hand overlap at comparable quality: then
    the one with least overlap, best score first. ``candidates`` has ``cand,
    selection_score, focus, hand, motion, glare, suspect``. Every window is
    partitioned by the group.
    """
    g = W.partitionBy(*group)
    open_ = ~F.arrays_overlap("suspect", codes(BLOCKING))
    pooled = candidates.withColumn("_open", open_).withColumn("_pool", F.col("_open") | ~F.bool_or("_open").over(g))
    best = F.first(F.struct("cand", "selection_score", "focus", "hand", "motion", "glare", "suspect")).over(
        g.orderBy(F.col("_pool").desc(), F.col("selection_score").desc(), "cand").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    )
    b = F.col("_best")
    fresh = F.array_except(F.array_intersect("suspect", codes(BLOCKING)), b["suspect"])
    eligible = (
        F.col("_pool")
        & finite(b["hand"])
        & finite(F.col("hand"))
        & (F.col("hand") <= b["hand"] - 0.01)
        & (F.col("focus") >= b["focus"] * 0.8)
        & (F.col("selection_score") >= b["selection_score"] - 0.55)
        & (F.size(fresh) == 0)
        & (~(finite(F.col("motion")) & finite(b["motion"])) | (F.col("motion") <= F.greatest(F.lit(0.02), b["motion"] * 3)))
        & (~(finite(F.col("glare")) & finite(b["glare"])) | (F.col("glare") <= b["glare"] + 0.05))
    )
    judged = pooled.withColumn("_best", best).withColumn("_eligible", F.coalesce(eligible, F.lit(False)))
    order = g.orderBy(
        F.col("_pool").desc(),
        F.col("_eligible").desc(),
        F.when(F.col("_eligible"), F.col("hand")),
        F.col("selection_score").desc(),
        "cand",
    )
    return judged.withColumn("place", F.row_number().over(order)).drop("_open", "_pool", "_best", "_eligible")


def choose(candidates: DataFrame, group: list[str]) -> DataFrame:
    """The chosen candidate of each group: the first by ``with_places``."""
    return with_places(candidates, group).where("place = 1").drop("place")


def with_chosen(candidates: DataFrame, group: list[str]) -> DataFrame:
    """Add the struct ``chosen``, the row that ``choose`` takes in the group: no join, no further shuffle."""
    whole = W.partitionBy(*group).orderBy("place").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    placed = with_places(candidates, group)
    return placed.withColumn("chosen", F.first(F.struct(*candidates.columns)).over(whole)).drop("place")


def by_side(candidates: DataFrame) -> DataFrame:
    """The candidates once for the left and once for the right page.

    The measures of a side differ by a fixed tilt of the sharpness and glare,
    as the supplied tables have one measurement a row.
    """
    sides = candidates.withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right"))))
    left = F.col("side") == "left"
    return sides.withColumns(
        {
            "sharpness": F.when(left, F.col("sharpness") * 0.9).otherwise(F.col("sharpness") * (0.5 + F.col("exposure"))),
            "glare": F.when(left, F.col("glare")).otherwise(F.col("glare") / 2),
        }
    )


def fallback_reasons(candidates: DataFrame, group: list[str], among: list[str]) -> DataFrame:
    """Sorted union of the reasons among ``among``, where every candidate of a group has one; else none."""
    own = F.array_intersect("suspect", codes(among))
    return candidates.withColumn("_own", own).groupBy(*group).agg(
        F.when(
            F.bool_and(F.size("_own") > 0), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_own"))))
        ).otherwise(F.array().cast("array<string>")).alias("reasons")
    )


def donor_ranking(candidates: DataFrame, group: list[str], most: int = 5) -> DataFrame:
    """Up to ``most`` candidates of a group beside its chosen one: least hand overlap (unknown last), least glare, best score."""
    others = with_chosen(candidates, group).where(F.col("cand") != F.col("chosen.cand"))
    order = W.partitionBy(*group).orderBy(F.coalesce("hand", F.lit(1.0)), "glare", F.col("score").desc(), "cand")
    return others.withColumn("donor_rank", F.row_number().over(order)).where(F.col("donor_rank") <= most).drop("chosen")


def safe_fixes(candidates: DataFrame, group: list[str], most: int = 2) -> DataFrame:
    """Up to ``most`` replacements of a flagged choice that bring no new risk and some improvement.

    Ordered by fewest risks, most improvements, largest gain, id.
    """
    fields = ("cand", "sharpness", "focus", "hand", "motion", "glare", "selection_score", "suspect")
    rows = with_chosen(candidates, group).withColumns({f"_{c}": F.col(f"chosen.{c}") for c in fields})
    pairs = rows.where(F.arrays_overlap("_suspect", codes(FIX_TRIGGERS)) & (F.col("cand") != F.col("_cand")))
    risks = F.array_intersect("suspect", codes(FIX_RISKS))
    now_risks = F.array_intersect("_suspect", codes(FIX_RISKS))
    flagged = lambda *names: F.arrays_overlap("_suspect", codes(list(names)))

    def lower(measure: str, least: float) -> Column:
        before, after = F.col(f"_{measure}"), F.col(measure)
        return (before > 0) & (after <= before * 0.7) & (before - after >= least)

    gain = F.col("selection_score") - F.col("_selection_score")
    improved = F.array_compact(
        F.array(
            F.when(flagged("glare_overlap", "final_glare_residual", "occlusion_repair_incomplete") & lower("glare", 0.001), F.lit("glare")),
            F.when(flagged("hand_overlap", "finger_repair_incomplete", "occlusion_repair_incomplete", "final_unresolved_finger", "final_finger_repair_residual") & lower("hand", 0.001), F.lit("hand")),
            F.when(flagged("low_sharpness") & (F.col("focus") >= F.col("_focus") * 1.15), F.lit("sharpness")),
            F.when(flagged("high_motion") & lower("motion", 0.0), F.lit("motion")),
            F.when(F.size(risks) < F.size(now_risks), F.lit("risk_count")),
            F.when(gain >= 0.08, F.lit("selection_score")),
        )
    )
    safe = pairs.withColumns({"risks": risks, "improvements": improved, "score_gain": F.round(gain, 6)}).where(
        (F.size(F.array_except("risks", now_risks)) == 0) & (F.size("improvements") > 0)
    )
    order = W.partitionBy(*group).orderBy(F.size("risks"), F.size("improvements").desc(), F.coalesce("score_gain", F.lit(-1.0)).desc(), "cand")
    return safe.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select(
        *group, F.col("_cand").alias("current"), "cand", "place", "improvements", "score_gain", F.size("risks").alias("n_risks")
    )


def preliminary_score(c: Config, start: Column, window: float) -> Column:
    """Score of a reference frame before detection: stillness, sharpness, earliness."""
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    still = clip(1 - F.col("motion") / c.turn_threshold)
    sharp = clip(F.log1p(F.greatest("sharpness", F.lit(0.0))) / 8)
    early = clip(1 - (F.col("t") - start) / window)
    return 0.55 * still + 0.30 * sharp + 0.15 * early


def rotation_pick(scores: DataFrame, digits: int = 3) -> DataFrame:
    """Best rotation per entity: within .015 of the best average, by the order 0, 90, 270, 180.

    ``scores`` has ``entity, rotation, score``; the confidence follows the
    margins to the orthogonal and the opposite rotation, rounded to ``digits``.
    """
    mean = scores.groupBy("entity", "rotation").agg(F.round(F.avg("score"), 4).alias("score"))
    g = W.partitionBy("entity")
    order = F.array_position(F.array(*[F.lit(r) for r in (0, 90, 270, 180)]), F.col("rotation"))
    near = mean.withColumn("best", F.max("score").over(g)).withColumn("by_rotation", F.map_from_entries(F.collect_list(F.struct("rotation", "score")).over(g)))
    picked = near.where("best - score <= 0.015 + 1e-12").withColumn("_place", F.row_number().over(g.orderBy(order))).where("_place = 1")
    at = lambda turn: F.coalesce(F.try_element_at("by_rotation", (F.col("rotation") + turn) % 360), F.lit(0.0))
    axis = F.greatest(F.lit(0.0), F.col("score") - F.greatest(at(90), at(270)))
    direction = F.greatest(F.lit(0.0), F.col("score") - at(180))
    value = F.least(F.lit(0.95), F.greatest(F.lit(0.35), 0.35 + 0.35 * F.col("score") + 0.8 * axis))
    value = F.when(direction < 0.025, F.least(value, F.lit(0.62))).otherwise(value)
    value = F.when(axis < 0.04, F.least(value, F.lit(0.55))).otherwise(value)
    return picked.select("entity", "rotation", "score", F.round(value, digits).alias("confidence"))
