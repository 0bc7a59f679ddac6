"""Reports over output pages: counts, summaries, numbering, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Review categories with their reason codes.
CATEGORIES = {
    "repair": ["finger_repair_incomplete", "final_unresolved_finger", "final_finger_repair_residual"],
    "contour": ["page_quad_uncertain", "page_contour_low_confidence", "source_frame_clipped", "final_edge_crop_suspected"],
    "glare": ["glare_overlap", "final_glare_residual"],
    "dewarp": ["dewarp_low_confidence", "final_dewarp_line_regression"],
    "duplicate": ["duplicate_suspected", "final_duplicate_suspected"],
    "finish": ["final_background_fill_large", "final_near_blank_white", "final_near_blank_black"],
    "input": [
        "low_sharpness", "hand_detection_disabled", "hand_overlap", "high_motion", "underexposed",
        "interval_gap", "manual_frame", "manual_frame_motion_unmeasured",
    ],
}


def page_count_check(pages: DataFrame, expected: Column, complete: Column | None = None) -> DataFrame:
    """Physical pages per project against ``expected``; a spread counts as two pages.

    Only enabled pages count; a page without the flag is enabled.
    """
    counted = pages.groupBy("project").agg(
        F.sum(F.when(F.coalesce("enabled", F.lit(True)), F.when(F.col("side") == "spread", 2).otherwise(1)).otherwise(0)).alias("actual"),
        F.count_if(F.coalesce("enabled", F.lit(True))).alias("output_items"),
    )
    checked = counted.withColumn("expected", expected).withColumn("difference", F.col("actual") - F.col("expected"))
    done = F.lit(True) if complete is None else complete
    status = (
        F.when(F.col("expected").isNull(), "unset")
        .when(~done, "pending")
        .when(F.col("difference") == 0, "match")
        .when(F.col("difference") < 0, "short")
        .otherwise("over")
    )
    return checked.withColumn("status", status)


def all_reasons() -> Column:
    return F.array_distinct(F.concat("suspect", "final_reasons"))


def review_summary(pages: DataFrame) -> DataFrame:
    """Enabled pages of each project that need review, and those of each category; a page may be in several."""
    flagged = pages.where("enabled").withColumn("reasons", all_reasons()).where(F.size("reasons") > 0)
    matches = F.array_compact(
        F.array(
            F.lit("total"),
            *[F.when(F.arrays_overlap("reasons", F.array(*map(F.lit, codes))), F.lit(name)) for name, codes in CATEGORIES.items()],
        )
    )
    return flagged.select("project", F.explode(matches).alias("category")).groupBy("project", "category").agg(F.count(F.lit(1)).alias("n_pages"))


def running_numbers(pages: DataFrame) -> DataFrame:
    """Number of each enabled page in order; none for the others."""
    order = W.partitionBy("project").orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow)
    count = F.sum(F.col("enabled").cast("int")).over(order)
    return pages.withColumn("number", F.when(F.col("enabled"), count))


def contact_sheets(pages: DataFrame, per_sheet: int = 80, columns: int = 5) -> DataFrame:
    """Sheet, row and column of each page on contact sheets."""
    at = F.col("position")
    return pages.withColumns(
        {
            "sheet": F.floor(at / per_sheet).cast("long"),
            "row": F.floor(at % per_sheet / columns).cast("long"),
            "column": (at % columns).cast("long"),
        }
    )


def project_catalog(pages: DataFrame) -> DataFrame:
    """Projects by name with their pages, enabled pages and distinct reasons."""
    return pages.groupBy("project").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count_if("enabled").alias("n_enabled"),
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(all_reasons())))), ",").alias("reasons"),
    )


def adjacent_duplicates(pages: DataFrame, distance: int) -> DataFrame:
    """Enabled pages whose hash is near that of the enabled page before; an unreadable page (null) breaks the chain."""
    order = W.partitionBy("project").orderBy("position")
    shown = pages.where("enabled").withColumn("_before", F.lag("hash").over(order))
    apart = F.bit_count(F.col("hash").bitwiseXOR(F.col("_before")))
    return shown.withColumn("distance", apart).where(F.col("distance") <= distance).drop("_before")


def duplicate_promotion(pages: DataFrame) -> DataFrame:
    """For each duplicate page pair, whether the newer copy should replace the older.

    ``pages`` has ``grp, item, enabled, hand, focus, hard, repair``. Both must
    be measured, the newer no less sharp than 80 %, without a new hard risk or
    more repair risks, and cleaner: .01 less hand overlap, or fewer repair
    risks at no more than .005 more.
    """
    order = W.partitionBy("grp").orderBy("item")
    old = {c: F.lag(c).over(order) for c in ("item", "hand", "focus", "hard", "repair")}
    pairs = pages.withColumns({f"old_{c}": v for c, v in old.items()}).where("old_item is not null")
    sound = (
        (F.col("focus") >= F.col("old_focus") * 0.8)
        & (F.size(F.array_except("hard", "old_hard")) == 0)
        & (F.size("repair") <= F.size("old_repair"))
    )
    cleaner = (F.col("hand") <= F.col("old_hand") - 0.01) | (
        (F.size("repair") < F.size("old_repair")) & (F.col("hand") <= F.col("old_hand") + 0.005)
    )
    return pairs.select("grp", F.col("old_item").alias("older"), F.col("item").alias("newer"), F.coalesce(sound & cleaner, F.lit(False)).alias("promote"))


def constraint_violations(rows: DataFrame, rules: dict[str, Column], key: list[str]) -> DataFrame:
    """One row per broken rule: the key and the rule's name. A rule that is null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(*key, F.explode(broken).alias("rule"))


def timings_rollup(timings: DataFrame) -> DataFrame:
    """Seconds, calls and mean milliseconds by name."""
    return timings.groupBy("name").agg(F.sum("seconds").alias("seconds"), F.sum("calls").alias("calls")).withColumn(
        "avg_ms", F.round(1000 * F.col("seconds") / F.greatest("calls", F.lit(1)), 3)
    )
