"""Checked patches of settings: what each sets, which are refused and why, and what holds in the end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import signed_area

PAGES = ("left", "right")
#: A quad smaller than this is none.
MIN_AREA = 0.005


@dataclass(frozen=True)
class Setting:
    """A setting that may be patched: its ``kind`` (bool, number, choice or quad), what it may be, and where."""

    name: str
    kind: str
    low: float = 0.0
    high: float = 1.0
    choices: tuple[str, ...] = ()
    sides: tuple[str, ...] = ("left", "right", "spread")


#: The settings of a page.
PAGE_SETTINGS = (
    Setting("dewarp", "bool", sides=PAGES),
    Setting("illumination_correction", "bool"),
    Setting("white_normalization", "bool"),
    Setting("manual_quad", "quad", sides=PAGES),
    Setting("page_quad_mode", "choice", choices=("auto", "manual"), sides=PAGES),
    Setting("spine_ratio", "number", low=0.25, high=0.75, sides=("spread",)),
)
#: Sides that take no settings at all.
CLOSED = ("cover", "external")


def quad_of(value: Column) -> Column:
    """The polygon written as a JSON list of four points; null if it isn't one."""
    points = F.from_json(value, "array<array<double>>")
    whole = (F.size(points) == 4) & F.forall(points, lambda p: F.coalesce((F.size(p) == 2) & F.forall(p, lambda v: F.coalesce(v.between(0, 1), F.lit(False))), F.lit(False)))
    at = F.transform(points, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))
    return F.when(whole, at)


def is_quad(value: Column) -> Column:
    """Four corners inside the unit square, convex, clockwise from the top left, and large enough."""
    q = quad_of(value)
    corner = [F.get(q, i % 4) for i in range(6)]
    turns = F.lit(True)
    for a, b, c in zip(corner, corner[1:], corner[2:], strict=False):
        turns = turns & ((b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"]) > 0)
    return F.coalesce(q.isNotNull() & turns & (F.abs(signed_area(q)) >= MIN_AREA), F.lit(False))


def _problem(setting: Setting, value: Column, side: Column) -> Column:
    """Why a value can't be set; null if it can, or if the patch hasn't it."""
    if setting.kind == "bool":
        fits, said = value.isin("true", "false"), "must be a boolean"
    elif setting.kind == "choice":
        fits, said = value.isin(*setting.choices), f"must be {' or '.join(setting.choices)}"
    elif setting.kind == "number":
        number = value.try_cast("double")
        fits, said = F.coalesce(number.between(setting.low, setting.high), F.lit(False)), f"must be {setting.low}..{setting.high}"
    else:
        fits, said = is_quad(value), "must be a quad"
    where = side.isin(*setting.sides)
    return F.when(value.isNull(), F.lit(None)).when(~fits, f"{setting.name} {said}").when(~where, f"{setting.name} is only available for {', '.join(setting.sides)}")


def judged(patches: DataFrame, settings: tuple[Setting, ...] = PAGE_SETTINGS) -> DataFrame:
    """Add ``reason``: why a patch is refused as a whole, null if it is applied.

    ``patches`` has ``spread, side, seq`` and ``settings`` (a map of texts). A
    patch is refused for a side that takes none, if it is empty, for settings
    that are unknown, or for the first setting that can't be set, null values
    included. A contour can be ``manual`` only with a quad: the patch's own, or
    one that an earlier patch of the side left; ``auto`` removes it.

    Whether a quad is there follows from the last patch before that brought or
    removed one, which doesn't depend on what was refused for want of one; so
    windows say it, and a side's patches are not folded.
    """
    value = lambda name: F.try_element_at(F.col("settings"), F.lit(name))
    names = F.map_keys("settings")
    unknown = F.array_sort(F.array_except(names, F.array(*[F.lit(s.name) for s in settings])))
    nulls = F.array_sort(F.filter(names, lambda n: F.try_element_at(F.col("settings"), n).isNull()))
    static = F.coalesce(
        F.when(F.col("side").isin(*CLOSED), "no settings here"),
        F.when(F.col("settings").isNull() | (F.size("settings") == 0), "no settings given"),
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown settings: "), F.array_join(unknown, ", "))),
        F.when(F.size(nulls) > 0, F.concat(F.lit("settings without a value: "), F.array_join(nulls, ", "))),
        *[_problem(s, value(s.name), F.col("side")) for s in settings],
    )
    order = W.partitionBy("spread", "side").orderBy("seq")
    mode, quad = value("page_quad_mode"), value("manual_quad")
    brings = F.when(F.col("_static").isNull(), F.when(mode == "auto", False).when(quad.isNotNull(), True))
    had = F.coalesce(F.last("_brings", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))
    marked = patches.withColumn("_static", static).withColumn("_brings", brings).withColumn("_had", had)
    wants = F.when(F.coalesce((mode == "manual") & quad.isNull() & ~F.col("_had"), F.lit(False)), "a manual contour needs manual_quad")
    return marked.withColumn("reason", F.coalesce("_static", wants)).drop("_static", "_brings", "_had")


def settled(patches: DataFrame, settings: tuple[Setting, ...] = PAGE_SETTINGS) -> DataFrame:
    """What holds after all patches that are applied: ``spread, side, name, value, seq``, the last value of each setting.

    A patch with the contour ``auto`` removes ``manual_quad``, its own too.
    """
    applied = judged(patches, settings).where("reason is null")
    removed = F.map_from_arrays(F.array(F.lit("manual_quad")), F.array(F.lit(None).cast("string")))
    rest = F.map_filter("settings", lambda k, _: k != "manual_quad")
    effect = F.when(F.try_element_at(F.col("settings"), F.lit("page_quad_mode")) == "auto", F.map_concat(rest, removed)).otherwise(F.col("settings"))
    entries = applied.select("spread", "side", "seq", F.explode(effect).alias("name", "value"))
    last = entries.groupBy("spread", "side", "name").agg(F.max(F.struct("seq", "value")).alias("_last"))
    return last.where("_last.value is not null").select("spread", "side", "name", "_last.value", "_last.seq")
