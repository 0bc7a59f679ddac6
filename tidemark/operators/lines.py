"""Outlines from straight lines: pairs of horizontal ones with pairs of vertical ones."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .proposals import corner_distance

#: Outlines of a batch that are worked out at once, about.
COMBINED = 500_000
#: Images whose outlines are handed on at once.
IMAGES = 500
#: Scores of a batch may differ from Spark's by less than this.
SLACK = 1e-8

_LINE = ["place", "slope", "rank", "segment"]
_FOUND = ["area", "aspect", "rank", "segment", *[f"{axis}{i}" for i in range(4) for axis in "xy"]]


@dataclass(frozen=True)
class Outline:
    """Least gaps, how far corners may lie outside, ranges, the best aspect, numbers kept, nearness and weights."""

    least_down: float = 0.25
    least_across: float = 0.12
    outside: float = 0.02
    areas: tuple[float, float] = (0.05, 0.9)
    aspects: tuple[float, float] = (0.4, 1.6)
    aspect: float = 0.72
    first: int = 120
    shown: int = 8
    same: float = 0.025
    weights: tuple[float, float, float, float, float] = (0.28, 0.20, 0.18, 0.06, 0.28)


def _product(na: np.ndarray, nb: np.ndarray, oa: np.ndarray, ob: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group by group each of ``na`` rows from ``oa`` on with each of ``nb`` rows from ``ob`` on: groups and rows of both."""
    total = na * nb
    group = np.repeat(np.arange(len(total)), total)
    nth = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    return group, oa[group] + nth // nb[group], ob[group] + nth % nb[group]


def _pairs(image: np.ndarray, rows: np.ndarray, place: np.ndarray, least: float, images: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of an image's lines (``rows``, by image) that lie ``least`` or more apart, the one nearer the origin first, and their numbers by image."""
    n = np.bincount(image[rows], minlength=images)
    at = np.cumsum(n) - n
    of, a, b = _product(n, n, at, at)
    far = place[rows[b]] - place[rows[a]] >= least
    return rows[a[far]], rows[b[far]], np.bincount(of[far], minlength=images)


def _places(h: np.ndarray, v: np.ndarray, place: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where horizontal lines, ``y = place + slope * (x - 1/2)``, meet vertical ones, ``x = place + slope * (y - 1/2)``."""
    x = (place[v] + slope[v] * (place[h] - 0.5 * slope[h] - 0.5)) / (1 - slope[v] * slope[h])
    return x, place[h] + slope[h] * (x - 0.5)


def _best(image: np.ndarray, score: np.ndarray, first: int) -> np.ndarray:
    """Places of each image's ``first`` best scores and of those that lie within ``SLACK`` of them, by image; NaN is worst."""
    worst = np.where(np.isnan(score), -np.inf, score)
    order = np.lexsort((-worst, image))
    of, value = image[order], worst[order]
    begin = np.searchsorted(of, of)
    last = np.minimum(begin + first, np.searchsorted(of, of, side="right")) - 1
    return order[(value >= value[last] - SLACK) | (value == value[last])]


def _combined(image: np.ndarray, vertical: np.ndarray, line: np.ndarray, images: int, rules: Outline) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best outlines of some images: their images, their four lines, and what ``_FOUND`` names."""
    place, slope, rank, segment = line
    top, bottom, n_top = _pairs(image, np.flatnonzero(~vertical), place, rules.least_down, images)
    left, right, n_side = _pairs(image, np.flatnonzero(vertical), place, rules.least_across, images)
    side_at = np.cumsum(n_side) - n_side
    of_top = np.repeat(np.arange(images), n_top)
    # Pairs of horizontal lines in runs that meet a bounded number of pairs of vertical ones.
    met = np.cumsum(n_side[of_top])
    found, begin = [], 0
    while begin < len(of_top):
        end = max(begin + 1, int(np.searchsorted(met, (met[begin - 1] if begin else 0) + COMBINED, side="right")))
        run = np.arange(begin, end)
        _, t, s = _product(np.ones(len(run), np.int64), n_side[of_top[run]], run, side_at[of_top[run]])
        begin = end
        lines = np.stack([top[t], bottom[t], left[s], right[s]])
        t, b, le, r = lines
        x, y = map(np.stack, zip(*[_places(h, v, place, slope) for h, v in ((t, le), (t, r), (b, r), (b, le))], strict=True))
        inside = ((x >= -rules.outside) & (x <= 1 + rules.outside) & (y >= -rules.outside) & (y <= 1 + rules.outside)).all(0)
        x, y, lines, t = x[:, inside], y[:, inside], lines[:, inside], t[inside]
        u, v = np.roll(x, -1, 0), np.roll(y, -1, 0)
        length = np.sqrt((u - x) * (u - x) + (v - y) * (v - y))
        twice = x * v - u * y
        area = np.abs(twice[0] + twice[1] + twice[2] + twice[3]) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            aspect = (length[0] + length[2]) / (length[1] + length[3])
        fine = (area >= rules.areas[0]) & (area <= rules.areas[1]) & (aspect >= rules.aspects[0]) & (aspect <= rules.aspects[1])
        x, y, lines, area, aspect = x[:, fine], y[:, fine], lines[:, fine], area[fine], aspect[fine]
        mean = lambda z: (0.0 + z[lines[0]] + z[lines[1]] + z[lines[2]] + z[lines[3]]) / 4  # noqa: B023, E731
        values = np.stack([area, aspect, mean(rank), mean(segment), *[z[i] for i in range(4) for z in (x, y)]], 1)
        w_area, w_aspect, w_rank, w_segment, _ = rules.weights
        score = w_area * np.minimum(area / 0.3, 1.0) + w_aspect * np.exp(-np.abs(np.log(aspect / rules.aspect))) + w_rank * values[:, 2] + w_segment * values[:, 3]
        kept = _best(image[lines[0]], score, rules.first)
        found.append((image[lines[0]][kept], lines[:, kept], values[kept], score[kept]))
    if not found:
        return np.empty(0, np.int64), np.empty((4, 0), np.int64), np.empty((0, len(_FOUND)))
    of, lines, values, score = (np.concatenate(x, 1 if k == 1 else 0) for k, x in enumerate(zip(*found, strict=True)))
    kept = _best(of, score, rules.first)
    return of[kept], lines[:, kept], values[kept]


def outlines(lines: DataFrame, steepest: float, rules: Outline = Outline(), support: Callable[..., Column] | None = None) -> DataFrame:
    """The best outlines of each image that differ: ``image, place`` from 1, ``confidence, lines`` and corners.

    ``lines`` has ``image, id, kind`` (``h`` or ``v``), ``place`` (where it
    meets the image's middle, 0 to 1), ``slope``, at most ``steepest`` either
    way, and ``rank`` and ``segment``, what speaks for it. The ``first`` outlines by area, aspect and lines are scored
    again with ``support``, an expression over their four corners (structs of
    ``x`` and ``y``), and the ``shown`` best that differ are kept. Equal ones go by the
    ids of their lines.

    An image's lines are one short list, dealt once; its outlines are worked
    out in the task that has it, batch by batch, and no more than the ``first``
    best of them leave it, so nothing but the lines is exchanged or sorted.
    Lines of unknown place or slope bound nothing.
    """
    known = lines.where("kind in ('h', 'v')")
    listed = known.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("id", (F.col("kind") == "v").alias("vertical"), *[F.col(c).cast("double").alias(c) for c in _LINE]))).alias("_lines"))
    names = ["top", "bottom", "left", "right"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, IMAGES):
                part = batch.slice(at, IMAGES)
                held = part.column("_lines")
                sizes = pc.list_value_length(held).to_numpy(zero_copy_only=False)
                start, image = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
                _, vertical, *line = held.flatten().flatten()
                line = np.stack([c.to_numpy(zero_copy_only=False) for c in line])
                of, four, values = _combined(image, vertical.to_numpy(zero_copy_only=False), line, len(sizes), rules)
                places = [pa.array((n - start[of]).astype(np.int32)) for n in four]
                found = pa.StructArray.from_arrays([*places, *[pa.array(values[:, k], from_pandas=True) for k in range(len(_FOUND))]], [*names, *_FOUND])
                offsets = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(sizes))))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("image"), held, pa.ListArray.from_arrays(pa.array(offsets), found)], ["image", "_lines", "_found"])

    fields = ", ".join([f"{c}: int" for c in names] + [f"{c}: double" for c in _FOUND])
    schema = StructType([*listed.schema.fields, *StructType.fromDDL(f"_found array<struct<{fields}>>").fields])
    met = listed.mapInArrow(run, schema)
    w_area, w_aspect, w_rank, w_segment, w_support = rules.weights

    def rated(o: Column) -> Column:
        score = w_area * F.least(o["area"] / 0.3, F.lit(1.0)) + w_aspect * F.exp(-F.abs(F.log(o["aspect"] / rules.aspect))) + w_rank * o["rank"] + w_segment * o["segment"]
        minus = -F.round(score, 9)
        named = F.array(*[F.get("_lines", o[c])["id"] for c in names])
        corners = [F.struct(o[f"x{i}"].alias("x"), o[f"y{i}"].alias("y")).alias(f"q{i}") for i in range(4)]
        return F.struct(minus.isNull().alias("none"), minus.alias("minus"), named.alias("lines"), *corners)

    cut = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))

    def judged(o: Column) -> Column:
        more = support(*[o[f"q{i}"] for i in range(4)]) if support is not None else F.lit(0.0)
        flat = [cut(o[f"q{i}"][axis]).alias(f"{axis}{i}") for i in range(4) for axis in "xy"]
        return F.struct((-F.round(-o["minus"] + w_support * more, 9)).alias("minus"), o["lines"].alias("lines"), *flat)

    best = met.select("image", F.slice(F.array_sort(F.transform("_found", rated)), 1, rules.first).alias("_best"))
    listed = best.select("image", F.array_sort(F.transform("_best", judged)).alias("_all"))
    apart = F.aggregate(
        "_all", F.slice("_all", 1, 0), lambda out, o: F.when((F.size(out) < rules.shown) & F.forall(out, lambda k: corner_distance(k, o) >= rules.same), F.concat(out, F.array(o))).otherwise(out)
    )
    rows = listed.select("image", F.posexplode(apart).alias("place", "o"))
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), -F.col("o.minus")))
    return rows.select("image", (F.col("place") + 1).alias("place"), confidence.alias("confidence"), "o.lines", *[F.col(f"o.{axis}{i}").alias(f"{axis}{i}") for i in range(4) for axis in "xy"])
