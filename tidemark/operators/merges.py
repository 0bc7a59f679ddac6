"""Merges by key, checks of key sets, groups of duplicates and positional joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Old rows with the values of the new row of the same key, where there is one; the columns ``keep`` stay the old ones."""
    taken = [c for c in new.columns if c not in [*keys, *keep] and c in old.columns]
    fresh = new.select(*keys, F.struct(*taken).alias("_new"))
    joined = old.join(fresh, keys, "left")
    values = {c: F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)) for c in taken}
    return joined.withColumns(values).select(*old.columns)


def key_sets(current: DataFrame, asked: DataFrame, group: list[str], key: str) -> DataFrame:
    """Per group whether ``asked`` lists every current key exactly once: ``n_current, n_asked, n_missing, n_unknown, n_repeated, is_permutation``.

    Both sides are counted by key first, so that one row a key is compared.
    """
    a = current.select(*group, key, F.lit(1).alias("_has"), F.lit(0).alias("_asks"))
    b = asked.select(*group, key, F.lit(0).alias("_has"), F.lit(1).alias("_asks"))
    per_key = a.unionByName(b).groupBy(*group, key).agg(F.sum("_has").alias("has"), F.sum("_asks").alias("asks"))
    found = per_key.groupBy(*group).agg(
        F.sum("has").alias("n_current"),
        F.sum("asks").alias("n_asked"),
        F.count_if(F.col("asks") == 0).alias("n_missing"),
        F.count_if(F.col("has") == 0).alias("n_unknown"),
        F.count_if(F.col("asks") > 1).alias("n_repeated"),
    )
    return found.withColumn("is_permutation", (F.col("n_missing") == 0) & (F.col("n_unknown") == 0) & (F.col("n_repeated") == 0))


def duplicate_groups(rows: DataFrame, group: list[str]) -> DataFrame:
    """Add ``root`` (the item that a row repeats, or itself), ``n_members`` and ``n_shown`` of its group.

    ``rows`` has ``id, duplicate_of, enabled, touched``. ``protected`` is true
    for groups of several members one of which was edited by hand; ``open`` for
    those where a cleaner copy may take over: exactly one shown and not
    protected.
    """
    rooted = rows.withColumn("root", F.coalesce("duplicate_of", "id"))
    g = W.partitionBy(*group, "root")
    several = F.count(F.lit(1)).over(g) > 1
    found = rooted.withColumns(
        {
            "n_members": F.count(F.lit(1)).over(g),
            "n_shown": F.count_if("enabled").over(g),
            "protected": several & F.bool_or("touched").over(g),
        }
    )
    return found.withColumn("open", (F.col("n_members") > 1) & (F.col("n_shown") == 1) & ~F.col("protected"))


def zip_by_position(left: DataFrame, right: DataFrame, group: list[str]) -> DataFrame:
    """Rows of both sides at the same ``position``; ``complete`` is false for a group whose sides differ in length."""
    joined = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), [*group, "position"], "full")
    whole = F.bool_and(F.col("_l").isNotNull() & F.col("_r").isNotNull()).over(W.partitionBy(*group))
    return joined.withColumn("complete", whole).drop("_l", "_r")


def next_ids(rows: DataFrame, group: list[str], number: str, first: int = 0) -> DataFrame:
    """The number that a new row of each group gets: one above the largest, or ``first``."""
    return rows.groupBy(*group).agg(F.coalesce(F.max(number) + 1, F.lit(first)).cast("long").alias("next_id"))


def first_finite(*columns: str) -> Column:
    """The first of the columns that is a finite number; null if none is."""
    def own(c: str) -> Column:
        return F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c))

    return F.coalesce(*[own(c) for c in columns])


def prefer_newer(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """Per group whether the newer rows are cleaner than the older ones and may replace them: ``n_keys, same_keys, prefer``.

    ``rows`` has the group, ``key`` (a side, once an age), ``newer``, ``hand``,
    ``focus`` and lists ``hard`` and ``repair`` of risks. Both ages must have
    the same keys and finite measures; no key may lose a fifth of its focus or
    gain a hard risk. All rows of a group meet in one exchange.
    """

    def of(newer: bool, name: str) -> Column:
        return F.max(F.when(F.col("newer") == newer, F.col(name))).alias(f"{'new' if newer else 'old'}_{name}")

    packed = rows.withColumns({"seen": F.lit(1), "hand": first_finite("hand"), "focus": first_finite("focus")})
    names = ["seen", "hand", "focus", "hard", "repair"]
    per_key = packed.repartition(*group).groupBy(*group, key).agg(*[of(age, n) for age in (False, True) for n in names])
    c = F.col
    both = c("old_seen").isNotNull() & c("new_seen").isNotNull()
    # Shares and margins.
    fine = (c("new_focus") >= c("old_focus") * 0.8) & c("old_hand").isNotNull() & c("new_hand").isNotNull() & (F.size(F.array_except("new_hard", "old_hard")) == 0)
    found = per_key.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.bool_and(both).alias("same_keys"),
        F.bool_and(both & F.coalesce(fine, F.lit(False))).alias("_fine"),
        F.avg("old_hand").alias("_oh"),
        F.avg("new_hand").alias("_nh"),
        F.sum(F.size(F.coalesce("old_repair", F.array().cast("array<string>")))).alias("_or"),
        F.sum(F.size(F.coalesce("new_repair", F.array().cast("array<string>")))).alias("_nr"),
    )
    cleaner = (c("_nh") <= c("_oh") - 0.01) | ((c("_nr") < c("_or")) & (c("_nh") <= c("_oh") + 0.005))
    prefer = c("_fine") & (c("_nr") <= c("_or")) & F.coalesce(cleaner, F.lit(False))
    return found.select(*group, "n_keys", "same_keys", prefer.alias("prefer"))


def relaid(pages: DataFrame, fresh: DataFrame, saved: DataFrame) -> DataFrame:
    """Pages in order after the spreads of ``fresh`` got other pages: ``project, page, position, spread, enabled``.

    ``pages`` has ``project, page, position, spread, enabled``, ``fresh``
    ``project, spread, page`` and ``saved`` ``project, page, place, enabled`` of
    the time when the spread had that layout before. New pages stand where the
    first old one stood, in the order saved, unknown ones last; what isn't
    saved is shown if any page of the spread was.
    """
    spread = ["project", "spread"]
    was = pages.groupBy(*spread).agg(F.min("position").alias("at"), F.bool_or("enabled").alias("any"))
    kept = pages.join(fresh.select(*spread).distinct(), spread, "left_anti").select("project", "page", "spread", "enabled", F.col("position").alias("at"), F.lit(None).cast("long").alias("place"))
    known = saved.select("project", "page", F.col("place").cast("long").alias("place"), F.col("enabled").alias("shown"))
    new = fresh.join(was, spread).join(known, ["project", "page"], "left")
    new = new.select("project", "page", "spread", F.coalesce("shown", "any").alias("enabled"), "at", "place")
    order = W.partitionBy("project").orderBy("at", F.col("place").asc_nulls_last(), "page")
    every = kept.unionByName(new).withColumn("position", (F.row_number().over(order) - 1).cast("long"))
    return every.select("project", "page", "position", "spread", "enabled")


def last_valid(events: DataFrame, known: DataFrame, group: list[str], key: str, seq: str) -> DataFrame:
    """The last event of each group that names a known key, and how many were rejected: ``chosen, n_rejected``."""
    keys = known.select(*group, key).distinct().withColumn("_known", F.lit(True))
    judged = events.join(keys, [*group, key], "left")
    chosen = F.max_by(F.when(F.col("_known"), F.col(key)), F.when(F.col("_known"), F.col(seq)))
    return judged.groupBy(*group).agg(chosen.alias("chosen"), F.count_if(F.col("_known").isNull()).alias("n_rejected"))
