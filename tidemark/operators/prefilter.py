"""Which of a group's look-alike candidates are looked at first, later or never."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .segments import primary_of_representatives


def candidate_plan(rows: DataFrame, group: list[str], limit: int, distance: int) -> DataFrame:
    """Add ``representative``, ``role`` and ``n_representatives`` to candidates.

    ``rows`` has the group, ``idx`` from 0 without gaps, ``hash`` and ``score``.
    Of neighbours whose hashes differ in ``distance`` bits or fewer the last
    stands for all; groups of ``limit`` candidates or fewer are left alone. Too
    few representatives are padded by evenly spaced candidates. A candidate
    belongs to the next representative at or after it, the tail to the last
    one. Roles are primary (up to ``limit`` representatives over time, the
    latest always), remaining and suppressed. All windows share the
    partitioning by group.
    """
    g = W.partitionBy(*group)
    order = g.orderBy("idx")
    apart = F.bit_count(F.col("hash").bitwiseXOR(F.lead("hash").over(order)))
    n = F.count(F.lit(1)).over(g)
    found = rows.withColumns({"_n": n, "_rep": (n <= limit) | ~F.coalesce(apart <= distance, F.lit(False))})
    few = F.sum(F.col("_rep").cast("int")).over(g) < F.least(F.lit(limit), F.col("_n"))
    even = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda k: F.floor(k * (F.col("_n") - 1) / max(limit - 1, 1)))
    padded = found.withColumn("_few", few).withColumn("_rep", F.col("_rep") | (F.col("_few") & F.array_contains(even, F.col("idx").cast("long"))))
    own = F.when(F.col("_rep"), F.col("idx"))
    following = F.min(own).over(order.rowsBetween(0, W.unboundedFollowing))
    placed = padded.withColumns(
        {"representative": F.coalesce(following, F.max(own).over(g)), "n_representatives": F.sum(F.col("_rep").cast("int")).over(g)}
    )
    marked = primary_of_representatives(placed, [*group, "_rep"], limit)
    primary = F.col("_rep") & (F.col("is_primary") | (F.col("n_representatives") <= limit))
    role = F.when(primary, "primary").when(F.col("_rep"), "remaining").otherwise("suppressed")
    return marked.withColumn("role", role).drop("_n", "_rep", "_few", "is_primary")
