"""Choice of a spread's candidates for the spread itself and for each of its pages, in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import RELATIVE, finite, relative_scores, with_places

GRAINS = ("spread", "left", "right")
#: Measures of a candidate at each grain; any of them may be null.
MEASURES = ("sharpness", "sharpness_uniformity", "motion", "hand", "glare_overlap", "glare", "score")


def focus(m: Column) -> Column:
    """How sharp a candidate is: its uniformity where that is finite, else the logarithm of its sharpness, else null."""
    sharp = F.when(finite(m["sharpness"]), F.log1p(F.greatest(m["sharpness"], F.lit(0.0))) / 8)
    return F.round(F.when(finite(m["sharpness_uniformity"]), m["sharpness_uniformity"]).otherwise(sharp), 9)


def graded(records: DataFrame) -> DataFrame:
    """Each candidate at each grain, with ranks inside its group (``rel_<measure>``) and ``selection_score``.

    ``records`` has ``spread, cand``, the structs ``metrics, left, right`` of
    ``MEASURES``, ``suspect`` and, null where a page has none of its own,
    ``left_suspect`` and ``right_suspect``. Ranks count only where every
    candidate of the spread has all three structs (``complete``); else the
    absolute score does, and a candidate without one is worst.

    One exchange by spread serves all windows of all grains.
    """
    whole = F.col("metrics").isNotNull() & F.col("left").isNotNull() & F.col("right").isNotNull()
    judged = records.withColumn("complete", F.bool_and(whole).over(W.partitionBy("spread")))
    per_grain = [
        F.struct(F.lit("spread").alias("grain"), F.col("metrics").alias("m"), F.col("suspect").alias("suspect")),
        *[F.struct(F.lit(side).alias("grain"), F.col(side).alias("m"), F.coalesce(f"{side}_suspect", "suspect").alias("suspect")) for side in GRAINS[1:]],
    ]
    rows = judged.select("spread", "cand", "complete", F.explode(F.array(*per_grain)).alias("g")).select("spread", "cand", "complete", "g.*")
    m = F.col("m")
    seen = F.coalesce(m["glare_overlap"], m["glare"])
    measured = rows.select(
        "spread", "cand", "complete", "grain", F.coalesce("suspect", F.array().cast("array<string>")).alias("suspect"),
        focus(m).alias("focus"), m["motion"].alias("motion"), m["hand"].alias("hand"), m["score"].alias("score"), seen.alias("_seen"), F.coalesce(seen, F.lit(0.0)).alias("glare"),
    )
    ranked = relative_scores(measured, ["spread", "grain"])
    absolute = F.when(finite(F.col("score")), F.col("score")).otherwise(F.lit(float("-inf")))
    value = F.when(F.col("complete"), F.col("selection_score")).otherwise(absolute)
    return ranked.withColumns({"selection_score": value, "glare": F.col("_seen"), **{f"rel_{name}": F.when(F.col("complete"), F.round(f"rel_{name}", 4)) for name in RELATIVE}}).drop("_seen")


def selected(records: DataFrame, mode: str) -> DataFrame:
    """Per spread the candidate chosen for it and for its pages: ``spread, complete, chosen, left, right``.

    ``mode`` is ``spread``, which takes the spread's choice for both pages, or
    ``per_page``. Each grain prefers readable candidates, and of these one with
    clearly less hand overlap at comparable quality. Of equals the smaller
    ``cand`` is taken.
    """
    if mode not in ("spread", "per_page"):
        raise ValueError(f"unknown mode {mode}")
    chosen = with_places(graded(records), ["spread", "grain"]).where("place = 1")
    of = {g: F.max(F.when(F.col("grain") == g, F.col("cand"))) for g in GRAINS}
    pages = {side: of["spread" if mode == "spread" else side].alias(side) for side in GRAINS[1:]}
    return chosen.groupBy("spread").agg(F.bool_and("complete").alias("complete"), of["spread"].alias("chosen"), *pages.values())
