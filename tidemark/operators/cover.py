"""Greedy cover of a target's bits by donors' bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A donor helps with so many bits at least; weights of what it covers, of its alignment and of how little remains.
LEAST, WEIGHTS = 8, (0.50, 0.30, 0.20)


def bit_total(words: Column) -> Column:
    """Set bits of a list of 64-bit words."""
    return F.aggregate(F.transform(words, lambda w: F.bit_count(w)), F.lit(0), lambda s, n: s + n)


def greedy_cover(targets: DataFrame, donors: DataFrame, keys: list[str], least: int = LEAST, weights: tuple[float, float, float] = WEIGHTS) -> DataFrame:
    """Donors taken one after the other until none covers ``least`` of the bits left: ``keys, total, left, picks``.

    ``targets`` has the keys and ``mask`` (a list of 64-bit words), ``donors``
    the keys, ``donor`` and lists ``clean`` of as many words, ``score`` and
    ``residual`` from 0 to 1. The best donor is that of the largest weighted sum
    of the share of the left bits that it covers, its score, and how little
    remains of it; of equals the one that covers more, then the smaller
    ``donor``. A donor that covers too little is out for good, as what is left
    only shrinks. ``picks`` lists donors with the bits that each took.

    A target's donors are a handful, folded as one short list, and a donor is
    taken once; so the fold has as many steps as there are donors. Targets
    without donors keep all their bits; null masks are empty.
    """
    cover, align, rest = weights
    listed = donors.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("donor", "clean", "score", "residual"))).alias("_donors"))
    joined = targets.join(listed, keys, "left").withColumn("_mask", F.coalesce("mask", F.array().cast("array<long>")))
    meet = lambda a, b: F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))
    start = F.struct(F.col("_mask").alias("open"), F.slice(F.array(F.struct(F.lit(None).cast(donors.schema["donor"].dataType).alias("donor"), F.lit(0).alias("bits"))), 1, 0).alias("picks"))

    def step(state: Column, _: Column) -> Column:
        left = bit_total(state["open"])
        taken = F.transform(state["picks"], lambda p: p["donor"])

        def rated(d: Column) -> Column:
            usable = meet(state["open"], d["clean"])
            bits = bit_total(usable)
            quality = F.round(cover * (bits / left) + align * d["score"] + rest * (1 - d["residual"]), 9)
            return F.struct((-quality).alias("worse"), (-bits).alias("fewer"), d["donor"].alias("donor"), bits.alias("bits"), usable.alias("usable"))

        usable = F.filter(F.transform(F.filter("_donors", lambda d: ~F.array_contains(taken, d["donor"])), rated), lambda r: r["bits"] >= least)
        best = F.try_element_at(F.array_sort(usable), F.lit(1))
        nxt = F.struct(
            F.zip_with(state["open"], best["usable"], lambda x, y: x.bitwiseAND(F.bitwise_not(y))).alias("open"),
            F.concat(state["picks"], F.array(F.struct(best["donor"].alias("donor"), best["bits"].alias("bits")))).alias("picks"),
        )
        return F.when((left >= least) & best.isNotNull(), nxt).otherwise(state)

    rounds = F.when(F.size("_donors") > 0, F.sequence(F.lit(1), F.size("_donors"))).otherwise(F.array().cast("array<int>"))
    done = joined.withColumn("_done", F.aggregate(rounds, start, step))
    return done.select(*keys, bit_total(F.col("_mask")).alias("total"), bit_total(F.col("_done.open")).alias("left"), F.col("_done.picks").alias("picks"))
