"""Choice among proposed quads: those that differ, and whether the best is clear."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .consensus import CORNERS

#: Corners nearer than this on average are one proposal; a lead up to this margin is no clear one; so many are shown.
SAME, MARGIN, SHOWN = 0.025, 0.035, 3


def distance(x: Column, y: Column) -> Column:
    """Length of a vector; many times faster than ``hypot``, whose guard against overflow no page needs."""
    return F.sqrt(x * x + y * y)


def corner_distance(a: Column, b: Column) -> Column:
    """Mean distance of the corners of two quads, structs of ``x0, y0 .. x3, y3``."""
    parts = [distance(a[f"x{i}"] - b[f"x{i}"], a[f"y{i}"] - b[f"y{i}"]) for i in range(4)]
    return sum(parts[1:], parts[0]) / 4


def distinct(quads: DataFrame, key: str, same: float = SAME, margin: float = MARGIN, shown: int = SHOWN) -> DataFrame:
    """Per ``key``: ``n_distinct, best, runner_up, ambiguous, top``.

    A proposal counts if it lies ``same`` or more from all better ones that
    count; of equal ``confidence`` the smaller ``id`` is better. The best one is
    ambiguous if the next leads it by ``margin`` or less. ``top`` lists the ids
    of the first ``shown``. A key has few proposals, folded as one short list;
    null confidences are worst.
    """
    ranked = quads.withColumn("_minus", -F.col("confidence"))
    listed = ranked.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("_minus").isNull().alias("_none"), "_minus", "id", "confidence", *CORNERS))).alias("qs"))
    kept = F.aggregate("qs", F.slice("qs", 1, 0), lambda ks, q: F.when(F.forall(ks, lambda k: corner_distance(k, q) >= same), F.concat(ks, F.array(q))).otherwise(ks))
    found = listed.select(key, kept.alias("ks"))
    one, two = F.try_element_at("ks", F.lit(1)), F.try_element_at("ks", F.lit(2))
    close = F.coalesce(F.round(one["confidence"] - two["confidence"], 9) <= margin, F.lit(False))
    top = F.array_join(F.transform(F.slice("ks", 1, shown), lambda k: k["id"].cast("string")), ",")
    return found.select(key, F.size("ks").alias("n_distinct"), one["id"].alias("best"), two["id"].alias("runner_up"), close.alias("ambiguous"), top.alias("top"))
