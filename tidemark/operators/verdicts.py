"""Verdicts from measured columns: final checks, alignment gates, tracking, nested residuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _reasons(checks: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for test, code in checks]))


def final_codes() -> Column:
    """Codes of what a rendered page's measures make suspect, in fixed order; a measure that is null raises none.

    Reads ``edge_fraction, edge_score, glare, luma_std, white, black, whitened,
    normalised, fill, finger, unresolved, residual, line_before, line_after``.
    """
    c = F.col
    drop = c("line_before") - c("line_after")
    # Codes and thresholds.
    fill = (c("normalised") & (c("whitened") >= 0.30)) | F.coalesce(c("fill") >= 0.25, F.lit(False))
    return _reasons(
        [
            ((c("edge_fraction") >= 0.72) & (c("edge_score") >= 0.48), "final_edge_crop_suspected"),
            (c("glare") >= 0.003, "final_glare_residual"),
            ((c("white") >= 0.985) & (c("luma_std") <= 12), "final_near_blank_white"),
            ((c("black") >= 0.97) & (c("luma_std") <= 12), "final_near_blank_black"),
            (fill, "final_background_fill_large"),
            (c("finger") & c("unresolved"), "final_unresolved_finger"),
            (c("finger") & (c("residual") >= 0.14), "final_finger_repair_residual"),
            ((c("line_before") >= 0.8) & (c("line_after") <= c("line_before") * 0.62) & (drop >= 0.35), "final_dewarp_line_regression"),
        ]
    )


def alignment_gates(density: Column) -> dict[str, Column]:
    """``suspect`` and ``duplicate`` of an alignment's measures; a hidden part lowers what a duplicate must correlate by.

    Reads ``inliers, inlier_ratio, half_inliers, balance, coverage_x,
    coverage_y, overlap, correlation``.
    """
    c = F.col

    def all_at_least(**least: float) -> Column:
        test = F.lit(True)
        for name, value in least.items():
            test = test & (c(name) >= value)
        return test

    # Three sets of thresholds.
    suspect = (density >= 0.025) & all_at_least(inliers=40, inlier_ratio=0.35, coverage_x=0.25, coverage_y=0.30, overlap=0.45, correlation=0.30)
    plain = (density >= 0.04) & all_at_least(inliers=60, inlier_ratio=0.45, half_inliers=20, balance=0.08, coverage_x=0.40, coverage_y=0.45, overlap=0.55, correlation=0.45)
    hidden = all_at_least(inliers=120, inlier_ratio=0.40, half_inliers=40, balance=0.20, coverage_x=0.58, coverage_y=0.65, overlap=0.75, correlation=0.25)
    return {"duplicate": plain | hidden, "suspect": suspect | plain | hidden}


def tracking_status(max_step: float, max_total: float) -> Column:
    """Status of a tracked region by its shift since the last and since the first frame, and by its change of area."""
    area = F.col("area_ratio")
    return (
        F.when(F.col("step_shift") > max_step, "step_shift_too_large")
        .when(F.col("total_shift") > max_total, "total_shift_too_large")
        .when(~area.between(0.70, 1.40), "area_change_too_large")
        .otherwise("tracked")
    )


def largest_residual(components: Column) -> Column:
    """The largest finite ``residual`` of all donors of all components; null if there is none."""
    values = F.flatten(F.transform(components, lambda c: F.transform(c["donors"], lambda d: d["residual"])))
    return F.array_max(F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def largest_shift(components: Column) -> Column:
    """The largest shift of all donors whose ``method`` is local; null if there is none."""
    local = F.filter(F.flatten(F.transform(components, lambda c: c["donors"])), lambda d: d["method"] == "local")
    return F.array_max(F.transform(local, lambda d: F.sqrt(d["dx"] * d["dx"] + d["dy"] * d["dy"])))


def local_components(components: Column) -> Column:
    """How many components have a donor whose ``method`` is local."""
    return F.coalesce(F.size(F.filter(components, lambda c: F.exists(c["donors"], lambda d: d["method"] == "local"))), F.lit(0)).cast("long")


def check_summary(rows: DataFrame, by: str) -> DataFrame:
    """Passed and all checks of each name, and whether all passed."""
    return rows.groupBy(by).agg(F.count_if("passed").alias("n_passed"), F.count(F.lit(1)).alias("n_checks"), F.bool_and("passed").alias("all_passed"))


def smoothstep(v: Column) -> Column:
    return v * v * (3 - 2 * v)


def strength_from_ratio(ratio: Column) -> Column:
    """How strongly a spacing ratio below .96 is corrected; tiny corrections are none."""
    raw = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (0.96 - ratio) * 0.9))
    return F.when(raw < 0.015, 0.0).otherwise(raw)


def reference_score(start: Column, window: float, turn: float) -> Column:
    """Score of a reference frame after detection: confidence, stillness, sharpness, earliness."""
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    still, sharp = clip(1 - F.col("motion") / turn), clip(F.log1p(F.greatest("sharpness", F.lit(0.0))) / 8)
    return 0.58 * F.col("confidence") + 0.22 * still + 0.12 * sharp + 0.08 * clip(1 - (F.col("t") - start) / window)


def fitted_size(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """A frame's size when its width is at most ``most``; heights are rounded half to even, 2 at least."""
    w = F.least(F.lit(most), width)
    return w, F.greatest(F.lit(2), F.bround(height * w / width).cast("int"))


def resolved(name: str, *levels: str, default) -> Column:
    """A setting by the first of the map columns ``levels`` that has it, else the default."""
    return F.coalesce(*[F.try_element_at(F.col(level), F.lit(name)) for level in levels], F.lit(default))


def same_content(distance: int, alike: float, similar: float) -> dict[str, Column]:
    """``duplicate`` and ``suspect`` of two images by hash distance, likeness of the whole and its halves, and alignment.

    Reads ``hash_distance, ssim, half_ssim`` (a list), ``contrast`` (the lower
    one) and ``alignment`` (duplicate, suspect), which may be null where none
    was found. Images of little contrast are never duplicates.
    """
    # Fixed value: least contrast.
    informative = F.col("contrast") >= 8
    direct = informative & (F.col("hash_distance") <= distance) & (F.least(F.col("ssim"), F.array_min("half_ssim")) >= alike)
    aligned = lambda name: informative & F.coalesce(F.col("alignment")[name], F.lit(False))
    duplicate = direct | aligned("duplicate")
    return {"duplicate": duplicate, "suspect": duplicate | (F.col("ssim") >= similar) | aligned("suspect")}


def input_limits(group: list[str], longest: float, widest: int, most_pixels: int) -> Column:
    """Codes of the limits that a source breaks, by itself or with the others of its group.

    Reads ``width, height, duration``. A duration that isn't a positive number
    counts as none.
    """
    d = F.col("duration")
    usable = ~F.isnan(d) & (d > 0) & (d < float("inf"))
    total = F.sum(F.when(usable, d)).over(W.partitionBy(*group))
    return _reasons(
        [
            (~F.coalesce(usable, F.lit(False)), "duration_invalid"),
            (usable & (d > longest), "duration_limit"),
            (F.greatest("width", "height") > widest, "dimension_limit"),
            (F.col("width").cast("long") * F.col("height") > most_pixels, "pixel_limit"),
            (total > longest, "total_duration_limit"),
        ]
    )


def alignment_summary(rows: DataFrame, group: list[str], aligned: Column, shift: Column, number: str) -> DataFrame:
    """``n_attempted`` (all but the anchor), ``n_aligned``, the largest shift and the first that has it."""
    best = F.max(F.struct(shift.alias("shift"), (-F.col(number)).alias("minus")))
    found = rows.groupBy(*group).agg((F.count(F.lit(1)) - 1).alias("n_attempted"), F.count_if(aligned).alias("n_aligned"), best.alias("best"))
    return found.select(*group, "n_attempted", "n_aligned", F.col("best.shift").alias("max_shift"), (-F.col("best.minus")).alias("most_shifted"))
