"""Agreement of several detections of one quadrilateral."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CORNERS = [f"{axis}{i}" for i in range(4) for axis in ("x", "y")]


def _apart(a: Column, b: Column) -> Column:
    """Mean distance of corresponding corners of two structs."""
    parts = [F.sqrt((a[f"x{i}"] - b[f"x{i}"]) * (a[f"x{i}"] - b[f"x{i}"]) + (a[f"y{i}"] - b[f"y{i}"]) * (a[f"y{i}"] - b[f"y{i}"])) for i in range(4)]
    return sum(parts[1:], parts[0]) / 4


def largest_cluster(quads: DataFrame, group: list[str], deviation: float, anchor: str | None = None) -> DataFrame:
    """Members of the largest set of quads near one of them; then one with the anchor, most confidence, smallest id.

    ``quads`` has the group's keys, ``id``, the corners and ``confidence``;
    ``anchor`` names a boolean column that is true for the quad of the
    candidate at hand. A group is the handful of detections of one spread side,
    compared as one short list: one exchange by group, no join.
    """
    listed = quads.groupBy(*group).agg(F.collect_list(F.struct(*[c for c in quads.columns if c not in group])).alias("_all"))

    # Each center's neighbours are listed once and then rated.
    near = F.transform("_all", lambda a: F.struct(a["id"].alias("id"), F.filter("_all", lambda q: F.round(_apart(a, q), 9) <= deviation).alias("near")))

    def rated(r: Column) -> Column:
        weight = F.round(F.aggregate(r["near"], F.lit(0.0), lambda s, q: s + F.coalesce(q["confidence"], F.lit(0.0))), 9)
        with_anchor = F.exists(r["near"], lambda q: F.coalesce(q[anchor], F.lit(False))) if anchor else F.lit(False)
        return F.struct((-F.size(r["near"])).alias("n"), (~with_anchor).alias("far"), (-weight).alias("weight"), r["id"].alias("id"), r["near"].alias("near"))

    # A center whose corners are unknown has nothing near it, not even itself.
    best = F.array_min(F.transform(F.filter(near, lambda r: F.size(r["near"]) > 0), rated))["near"]
    return listed.select(*group, F.inline(best)).select(*quads.columns)


def trimmed(cluster: DataFrame, group: list[str], deviation: float) -> DataFrame:
    """Drop members far from the corner-wise median: beyond three scaled median deviations.

    Clusters of fewer than three, or of which fewer than two would stay, are kept.
    """
    g = W.partitionBy(*group)
    centered = cluster.withColumns({f"m_{c}": F.median(c).over(g) for c in CORNERS}).withColumn("n", F.count(F.lit(1)).over(g))
    off = [F.sqrt(F.pow(F.col(f"x{i}") - F.col(f"m_x{i}"), 2) + F.pow(F.col(f"y{i}") - F.col(f"m_y{i}"), 2)) for i in range(4)]
    residual = centered.withColumn("residual", F.round(sum(off[1:], off[0]) / 4, 9)).withColumn("med", F.median("residual").over(g))
    spread = residual.withColumn("mad", F.median(F.abs(F.col("residual") - F.col("med"))).over(g))
    limit = F.least(F.lit(deviation), F.greatest(F.lit(0.004), F.col("med") + 3 * 1.4826 * F.col("mad")))
    judged = spread.withColumn("_in", F.col("residual") <= limit + 1e-9).withColumn("_n_in", F.count_if("_in").over(g))
    return judged.where((F.col("n") < 3) | (F.col("_n_in") < 2) | F.col("_in")).select(*cluster.columns)


def weighted_quad(members: DataFrame, group: list[str]) -> DataFrame:
    """Confidence-weighted mean corners and confidence."""
    w = F.greatest("confidence", F.lit(1e-6))
    mean = lambda c: (F.sum(w * F.col(c)) / F.sum(w))
    return members.groupBy(*group).agg(
        *[F.round(mean(c), 9).alias(c) for c in CORNERS],
        F.round(mean("confidence"), 9).alias("confidence"),
        F.count(F.lit(1)).alias("n_members"),
    )
