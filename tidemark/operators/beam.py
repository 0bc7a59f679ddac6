"""Search for a better quad by moving its edges: a beam of bounded width for each key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import polygons
from .proposals import corner_distance

#: Width of the beam, shares that edges move by, step after step, nearness of quads that are one, least area.
WIDTH, STEPS, SAME, MIN_AREA = 2, (0.10, 0.05), 0.012, 0.02

_CORNERS = [f"{axis}{i}" for i in range(4) for axis in "xy"]


def moved(q: Column, left: float = 0.0, right: float = 0.0, top: float = 0.0, bottom: float = 0.0) -> Column:
    """The quad ``q``, a struct of corners, with edges moved outward by shares of its own extent, cut to the unit square."""
    along = lambda a, b, share: a + (b - a) * share
    at = [(-left, -top), (1 + right, -top), (1 + right, 1 + bottom), (-left, 1 + bottom)]
    fields = []
    for i, (u, v) in enumerate(at):
        for axis in "xy":
            value = along(along(q[f"{axis}0"], q[f"{axis}1"], u), along(q[f"{axis}3"], q[f"{axis}2"], u), v)
            fields.append(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)).alias(f"{axis}{i}"))
    return F.struct(*fields)


def _apart(quads: Column, same: float) -> Column:
    """The quads that lie ``same`` or more from all kept before them."""
    return F.aggregate(quads, F.slice(quads, 1, 0), lambda kept, q: F.when(F.forall(kept, lambda k: corner_distance(k, q) >= same), F.concat(kept, F.array(q))).otherwise(kept))


def _ranked(quads: Column, score: Callable[[Column], Column]) -> Column:
    """Structs ``minus, place`` and ``q`` by falling score; of equal ones the earlier."""
    return F.array_sort(F.transform(quads, lambda q, i: F.struct((-F.round(score(q), 9)).alias("minus"), i.alias("place"), q.alias("q"))))


def beam_search(seeds: DataFrame, key: list[str], quads: str, score: Callable[[Column], Column], width: int = WIDTH, steps: tuple[float, ...] = STEPS, same: float = SAME, min_area: float = MIN_AREA) -> DataFrame:
    """Per key the quads found: ``best`` (up to ``width``, with ``score`` and corners), ``evaluated`` and ``kept_seed``.

    ``quads`` is a column of a few quads (structs of corners) in their order;
    ``score`` is an expression over such a struct, which may use other columns
    of the row. At every step each quad of the beam is kept and each of its
    edges moved in and out; quads below ``min_area`` and those near one listed
    before are left out, and the ``width`` best go on. Of the last ranking and
    the first, the best of either comes first, then the rest of the last, as
    far as they differ. ``evaluated`` counts quads that differ in the third
    decimal, each once; ``kept_seed`` says whether the best seed is among the
    found. Keys without quads find none.

    A key's frontier is at most nine quads for each of the beam, so the search
    stays in one row and nothing is joined or shuffled. Quads are moved and
    compared for a batch of rows at once; scores are expressions.
    """
    frame = seeds.withColumn("_first", _ranked(_apart(F.filter(quads, lambda q: q.isNotNull()), same), score))
    frame = frame.withColumn("_last", F.col("_first")).withColumn("_seen", F.transform("_first", lambda r: r["q"]))
    for share in steps:
        grown = polygons.grown_quads(share, same, min_area)(F.transform(F.slice("_last", 1, width), lambda r: r["q"]))
        # Each step's lists are columns of their own, so that none is worked out twice.
        frame = frame.withColumn("_grown", grown).withColumn("_last", _ranked(F.col("_grown"), score)).withColumn("_seen", F.concat("_seen", "_grown"))
    order = F.concat(F.slice("_last", 1, 1), F.slice("_first", 1, 1), F.slice("_last", F.lit(2), F.greatest(F.size("_last") - 1, F.lit(0))))
    empty = F.slice(order, 1, 0)
    found = F.aggregate(order, empty, lambda out, r: F.when((F.size(out) < width) & F.forall(out, lambda o: corner_distance(o["q"], r["q"]) >= same), F.concat(out, F.array(r))).otherwise(out))
    names = F.transform("_seen", lambda q: F.concat_ws(",", *[F.bround(q[c] * 1000).cast("int").cast("string") for c in _CORNERS]))
    done = frame.withColumns({"_found": found, "evaluated": F.size(F.array_distinct(names))})
    seed = F.try_element_at("_first", F.lit(1))
    kept = F.coalesce(F.exists("_found", lambda r: corner_distance(r["q"], seed["q"]) < same), F.lit(False))
    best = F.transform("_found", lambda r: F.struct((-r["minus"]).alias("score"), *[r["q"][c].alias(c) for c in _CORNERS]))
    return done.select(*key, best.alias("best"), "evaluated", kept.alias("kept_seed"))
