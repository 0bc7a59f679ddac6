"""Named queries of checked patches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalog import query
from .operators import patches
from .sources.adapters import table

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
#: Quads as they are written: one that is valid, one the wrong way round, one with three corners.
_GOOD, _TURNED, _SHORT = "[[0.1,0.1],[0.9,0.1],[0.9,0.9],[0.1,0.8]]", "[[0.1,0.1],[0.1,0.8],[0.9,0.9],[0.9,0.1]]", "[[0.1,0.1],[0.9,0.1],[0.9,0.9]]"

_PATCHES_SQL = f"""patches AS (
  SELECT l_orderkey // 8 AS spread, ['left', 'right', 'spread', 'left', 'right', 'cover'][(l_partkey % 6 + 1)::INT] AS side,
    row_number() OVER (PARTITION BY l_orderkey // 8 ORDER BY l_orderkey, {_ORDER}) AS seq,
    CASE WHEN l_suppkey % 4 = 0 THEN CASE WHEN l_quantity > 45 THEN 'yes' WHEN l_quantity > 20 THEN 'true' ELSE 'false' END END AS dewarp,
    CASE WHEN l_suppkey % 3 = 0 THEN CASE WHEN l_discount > 0.05::DOUBLE THEN 'true' ELSE 'false' END END AS illumination_correction,
    CASE WHEN l_suppkey % 5 = 1 THEN CASE WHEN l_tax > 0.07::DOUBLE THEN '1' ELSE 'true' END END AS white_normalization,
    CASE WHEN l_suppkey % 7 = 2 THEN CASE WHEN l_quantity < 8 THEN '{_TURNED}' WHEN l_quantity < 14 THEN '{_SHORT}' ELSE '{_GOOD}' END END AS manual_quad,
    CASE WHEN l_suppkey % 2 = 0 THEN CASE WHEN l_linenumber = 7 THEN 'other' WHEN l_linenumber % 2 = 0 THEN 'manual' ELSE 'auto' END END AS page_quad_mode,
    CASE WHEN l_suppkey % 9 = 4 THEN (l_discount * 8)::VARCHAR END AS spine_ratio, CASE WHEN l_suppkey % 41 = 5 THEN 'x' END AS zoom, l_discount * 8 AS ratio FROM lineitem
), static AS (
  SELECT *, coalesce(CASE WHEN side = 'cover' THEN 'no settings here' END,
    CASE WHEN dewarp IS NULL AND illumination_correction IS NULL AND white_normalization IS NULL AND manual_quad IS NULL AND page_quad_mode IS NULL AND spine_ratio IS NULL AND zoom IS NULL THEN 'no settings given' END,
    CASE WHEN zoom IS NOT NULL THEN 'unknown settings: zoom' END,
    CASE WHEN dewarp = 'yes' THEN 'dewarp must be a boolean' WHEN dewarp IS NOT NULL AND side = 'spread' THEN 'dewarp is only available for left, right' END,
    CASE WHEN white_normalization = '1' THEN 'white_normalization must be a boolean' END,
    CASE WHEN manual_quad <> '{_GOOD}' THEN 'manual_quad must be a quad' WHEN manual_quad IS NOT NULL AND side = 'spread' THEN 'manual_quad is only available for left, right' END,
    CASE WHEN page_quad_mode = 'other' THEN 'page_quad_mode must be auto or manual' WHEN page_quad_mode IS NOT NULL AND side = 'spread' THEN 'page_quad_mode is only available for left, right' END,
    CASE WHEN spine_ratio IS NOT NULL AND NOT ratio BETWEEN 0.25::DOUBLE AND 0.75::DOUBLE THEN 'spine_ratio must be 0.25..0.75' WHEN spine_ratio IS NOT NULL AND side <> 'spread' THEN 'spine_ratio is only available for spread' END) AS wrong
  FROM patches
), stepped AS (
  SELECT *, coalesce(last_value(CASE WHEN wrong IS NULL AND page_quad_mode = 'auto' THEN false WHEN wrong IS NULL AND manual_quad IS NOT NULL THEN true END IGNORE NULLS)
    OVER (PARTITION BY spread, side ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS had FROM static
), judged AS (
  SELECT *, coalesce(wrong, CASE WHEN page_quad_mode = 'manual' AND manual_quad IS NULL AND NOT had THEN 'a manual contour needs manual_quad' END) AS reason FROM stepped
)"""


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    s, q = c("l_suppkey"), c("l_quantity")
    given = {
        "dewarp": F.when(s % 4 == 0, F.when(q > 45, "yes").when(q > 20, "true").otherwise("false")),
        "illumination_correction": F.when(s % 3 == 0, F.when(c("l_discount") > 0.05, "true").otherwise("false")),
        "white_normalization": F.when(s % 5 == 1, F.when(c("l_tax") > 0.07, "1").otherwise("true")),
        "manual_quad": F.when(s % 7 == 2, F.when(q < 8, _TURNED).when(q < 14, _SHORT).otherwise(_GOOD)),
        "page_quad_mode": F.when(s % 2 == 0, F.when(c("l_linenumber") == 7, "other").when(c("l_linenumber") % 2 == 0, "manual").otherwise("auto")),
        "spine_ratio": F.when(s % 9 == 4, (c("l_discount") * 8).cast("string")),
        "zoom": F.when(s % 41 == 5, "x"),
    }
    every = F.create_map(*[x for name, value in given.items() for x in (F.lit(name), value)])
    spread = F.floor(c("l_orderkey") / 8).cast("long")
    order = W.partitionBy(spread).orderBy("l_orderkey", *_ORDER.split(", "))
    sides = F.array(*map(F.lit, ("left", "right", "spread", "left", "right", "cover")))
    return table(spark, sf_dir, "lineitem").select(
        spread.alias("spread"), F.element_at(sides, (c("l_partkey") % 6 + 1).cast("int")).alias("side"), F.row_number().over(order).cast("long").alias("seq"), F.map_filter(every, lambda _, v: v.isNotNull()).alias("settings")
    )


@query(f"WITH {_PATCHES_SQL} SELECT spread, side, seq, reason IS NULL AS applied, reason FROM judged")
def judged_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every patch of a log, and why those that are refused are."""
    return patches.judged(_patches(spark, sf_dir)).select("spread", "side", "seq", F.col("reason").isNull().alias("applied"), "reason")


_NAMES = ["dewarp", "illumination_correction", "white_normalization", "manual_quad", "page_quad_mode"]


@query(
    f"""
WITH {_PATCHES_SQL}, entries AS (
  {" UNION ALL ".join(f"SELECT spread, side, seq, '{n}' AS name, {'CASE WHEN page_quad_mode IS DISTINCT FROM ' + repr('auto') + ' THEN manual_quad END' if n == 'manual_quad' else n} AS value FROM judged WHERE reason IS NULL AND ({n} IS NOT NULL{' OR page_quad_mode = ' + repr('auto') if n == 'manual_quad' else ''})" for n in _NAMES)}
  UNION ALL SELECT spread, side, seq, 'spine_ratio', 'set' FROM judged WHERE reason IS NULL AND spine_ratio IS NOT NULL
), ends AS (
  SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY spread, side, name ORDER BY seq DESC) = 1
)
SELECT spread, side, name, value, seq FROM ends WHERE value IS NOT NULL
"""
)
def settled_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings of every page after all patches that were applied. Numbers are written differently by engines, so they are only said to be set."""
    found = patches.settled(_patches(spark, sf_dir))
    return found.withColumn("value", F.when(F.col("name") == "spine_ratio", "set").otherwise(F.col("value")))
