"""One-dimensional profiles: peaks, spacing, smoothing; and groups of look-alikes in a sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def peaks(profile: DataFrame, share: float = 0.72, lift: float = 0.35) -> DataFrame:
    """Local maxima of ``id, pos, v`` that are high: at or above the ``share`` quantile and the mean plus ``lift`` deviations.

    A peak is no lower than the value before and higher than the one after it.
    """
    order, whole = W.partitionBy("id").orderBy("pos"), W.partitionBy("id")
    near = profile.withColumns({"_left": F.lag("v").over(order), "_right": F.lead("v").over(order)})
    floor = F.greatest(F.percentile("v", F.lit(share)).over(whole), F.avg("v").over(whole) + lift * F.stddev_pop("v").over(whole))
    judged = near.withColumn("_floor", floor)
    return judged.where("v >= _left and v > _right and v >= _floor").select("id", "pos", "v")


def smoothed(profile: DataFrame) -> DataFrame:
    """Three-tap smoothing by .2, .6, .2; the ends stand for what lies beyond them."""
    order = W.partitionBy("id").orderBy("pos")
    left, right = F.coalesce(F.lag("v").over(order), F.col("v")), F.coalesce(F.lead("v").over(order), F.col("v"))
    return profile.withColumn("smooth", 0.2 * left + 0.6 * F.col("v") + 0.2 * right)


def smoothness(profile: DataFrame) -> DataFrame:
    """Upper quartile of the absolute changes, and the score that falls with it."""
    order = W.partitionBy("id").orderBy("pos")
    changes = profile.withColumn("_change", F.abs(F.col("v") - F.lag("v").over(order)))
    found = changes.groupBy("id").agg(F.percentile("_change", F.lit(0.75)).alias("change_p75"), F.count("v").alias("n"))
    return found.withColumn("smoothness", 0.4 + 0.6 * F.greatest(F.lit(0.0), 1 - F.col("change_p75")))


def spacing_ratio(points: DataFrame, length: int) -> DataFrame:
    """Median gap between neighbouring points in the middle half of a profile over that in the rest."""
    order = W.partitionBy("id").orderBy("pos")
    gaps = points.withColumn("next", F.lead("pos").over(order)).where("next is not null")
    middle = (F.col("pos") + F.col("next")) / 2
    inner = middle.between(length * 0.25, length * 0.75)
    gap = F.col("next") - F.col("pos")
    found = gaps.groupBy("id").agg(F.median(F.when(inner, gap)).alias("inner_gap"), F.median(F.when(~inner, gap)).alias("outer_gap"))
    return found.withColumn("ratio", F.col("inner_gap") / F.col("outer_gap"))


def collapse_runs(rows: DataFrame, distance: int) -> DataFrame:
    """Runs of items whose hash is near that of the item just before; the last of each run stands for it.

    ``rows`` has ``grp, id, hash``. Returns all rows with ``run`` and ``representative``.
    """
    order = W.partitionBy("grp").orderBy("id")
    apart = F.bit_count(F.col("hash").bitwiseXOR(F.lag("hash").over(order)))
    opened = rows.withColumn("_new", (~F.coalesce(apart <= distance, F.lit(False))).cast("int"))
    runs = opened.withColumn("run", F.sum("_new").over(order))
    return runs.withColumn("representative", F.max("id").over(W.partitionBy("grp", "run"))).drop("_new")


def nearest_two(queries: DataFrame, rows: DataFrame, ratio: float) -> DataFrame:
    """Nearest item of the same group for each query, if it is clearly nearer than the second.

    Distances are numbers of differing bits; ties go to the smaller id.
    """
    q = queries.select("grp", F.col("id").alias("query"), F.col("hash").alias("_q"))
    pairs = rows.join(q, "grp").where("id <> query").withColumn("distance", F.bit_count(F.col("hash").bitwiseXOR(F.col("_q"))))
    order = W.partitionBy("query").orderBy("distance", "id")
    two = pairs.withColumn("_place", F.row_number().over(order)).where("_place <= 2")
    best = two.groupBy("query").agg(
        F.min(F.struct("_place", "id", "distance")).alias("first"), F.max(F.struct("_place", "distance")).alias("second"), F.count(F.lit(1)).alias("n")
    )
    clear = best.where((F.col("n") == 2) & (F.col("first.distance") < ratio * F.col("second.distance")))
    return clear.select("query", F.col("first.id").alias("nearest"), F.col("first.distance").alias("distance"))


def classify_presets(rows: DataFrame, presets: list[tuple[str, dict[str, str]]]) -> DataFrame:
    """Name of the first preset all of whose settings a row has, else ``custom``."""
    chain = F
    for name, settings in presets:
        matches = F.lit(True)
        for key, value in settings.items():
            matches = matches & F.col(key).eqNullSafe(F.lit(value))
        chain = chain.when(matches, F.lit(name))
    return rows.withColumn("preset", chain.otherwise(F.lit("custom")))


def masked_medians(pixels: DataFrame, group: list[str], least: int = 3) -> DataFrame:
    """Median of each pixel over a group's rasters and the median of the deviations from it, where ``valid``: ``n, n_valid, mid, mad``.

    ``pixels`` has ``group, pos, v`` and ``valid``. Groups of less than
    ``least`` rasters are left out; a pixel that is valid nowhere has a null
    median and the largest deviation, 255. Values are counted by pixel before
    the medians are taken, so a group may be of any size.
    """
    at = [*group, "pos"]
    good = F.coalesce(F.col("valid") & F.col("v").isNotNull(), F.lit(False))
    counts = pixels.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("n_valid"), F.median(F.when(good, F.col("v").cast("double"))).alias("mid"))
    away = pixels.where(good).join(counts.select(*at, "mid"), at).groupBy(*at).agg(F.median(F.abs(F.col("v").cast("double") - F.col("mid"))).alias("mad"))
    return counts.where(F.col("n") >= least).join(away, at, "left").withColumn("mad", F.coalesce("mad", F.lit(255.0)))


#: Least support of an edge, share of a hand from which it counts as covered, frames that count.
EDGE_SUPPORT, EDGE_HAND, EDGE_FRAMES = 0.22, 0.18, 2


def edge_evidence(frames: DataFrame, key: str, support: float = EDGE_SUPPORT, hand: float = EDGE_HAND, most: int = EDGE_FRAMES) -> DataFrame:
    """Per key and edge the means over its ``most`` best supported frames, and what makes it uncertain.

    ``frames`` has the key, ``edge, frame, support, visible_support,
    occlusion``. Of equally supported frames the earlier counts. Adds
    ``reasons`` (``weak_edge``, ``hand_occlusion``), and for the key the
    ``uncertain`` edges and its ``least_support``. One shuffle by key.
    """
    order = W.partitionBy(key, "edge").orderBy(F.col("support").desc(), "frame")
    best = frames.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= most)
    means = best.groupBy(key, "edge").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 9).alias(c) for c in ("support", "visible_support", "occlusion")])
    reasons = F.array_compact(F.array(F.when(F.col("support") < support, "weak_edge"), F.when(F.col("occlusion") >= hand, "hand_occlusion")))
    judged = means.withColumn("reasons", reasons)
    every = W.partitionBy(key)
    doubtful = F.array_sort(F.array_compact(F.collect_list(F.when(F.size("reasons") > 0, F.col("edge"))).over(every)))
    return judged.withColumns({"uncertain": doubtful, "least_support": F.min("support").over(every)})
