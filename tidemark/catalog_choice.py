"""Named queries of choices in full: pages of a spread, outlines of an image."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalog import _choose_sql, _relative_sql, query
from .operators import lines, profiles, selection
from .sources.adapters import dealt, table

_LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
#: Measures of a spread and of its pages, each from columns of its own. One page in thirty has none.
_GRAINS = {
    "spread": ("l_extendedprice / 100", "CASE WHEN l_partkey % 3 = 0 THEN l_partkey % 17 / 20.0::DOUBLE END", "l_discount / 4", "CASE WHEN l_returnflag <> 'R' THEN l_tax / 4 END", "l_quantity / 500", "l_suppkey % 29 / 30.0::DOUBLE"),
    "left": ("l_extendedprice / 90", "NULL::DOUBLE", "l_discount / 5", "CASE WHEN l_returnflag <> 'A' THEN l_tax / 6 END", "l_partkey % 9 / 100.0::DOUBLE", "l_suppkey % 23 / 25.0::DOUBLE"),
    "right": ("l_extendedprice % 700", "CASE WHEN l_partkey % 5 = 0 THEN l_partkey % 13 / 15.0::DOUBLE END", "l_discount / 3", "l_tax / 5", "CASE WHEN l_partkey % 2 = 0 THEN l_quantity / 400 END", "CASE WHEN l_suppkey % 8 > 0 THEN l_suppkey % 19 / 20.0::DOUBLE END"),
}
_SUSPECT = {
    "suspect": "list_filter([CASE WHEN l_quantity > 40 THEN 'glare_overlap' END, CASE WHEN l_discount > 0.08::DOUBLE THEN 'high_motion' END, CASE WHEN l_tax > 0.06::DOUBLE THEN 'hand_overlap' END], lambda x: x IS NOT NULL)",
    "left_suspect": "CASE WHEN l_partkey % 4 = 0 THEN ['low_sharpness'] WHEN l_partkey % 4 = 1 THEN []::VARCHAR[] END",
    "right_suspect": "NULL::VARCHAR[]",
}


def _grain_sql(grain: str) -> str:
    sharp, uniform, motion, hand, glare, score = _GRAINS[grain]
    suspect = "suspect" if grain == "spread" else f"coalesce({grain}_suspect, suspect)"
    null = "has_right" if grain == "right" else "true"
    value = lambda x: f"CASE WHEN {null} THEN {x} END"
    return f"""SELECT spread, cand, complete, '{grain}' AS grain, {suspect} AS suspect, round(coalesce({value(uniform)}, ln(1 + greatest(0, {value(sharp)})) / 8), 9) AS focus, {value(motion)} AS motion,
    {value(hand)} AS hand, {value(score)} AS score, {value(glare)} AS seen, coalesce({value(glare)}, 0) AS glare FROM records"""


_RECORDS_SQL = f"""rows AS (
  SELECT *, l_orderkey AS spread, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) - 1 AS cand, NOT (l_suppkey % 10 = 7 AND l_linenumber % 3 = 1) AS has_right,
    {", ".join(f"{v} AS {k}" for k, v in _SUSPECT.items())} FROM lineitem
), records AS (
  SELECT *, bool_and(has_right) OVER (PARTITION BY spread) AS complete FROM rows
), grains AS (
  {" UNION ALL ".join(_grain_sql(g) for g in selection.GRAINS)}
)"""


@query(
    f"""
WITH {_RECORDS_SQL}, {_relative_sql("grains", "spread, grain").replace("relative AS (", "ranks AS (")}, relative AS (
  SELECT * REPLACE (CASE WHEN complete THEN selection_score ELSE coalesce(score, '-Infinity'::DOUBLE) END AS selection_score, seen AS glare) FROM ranks
), {_choose_sql("spread, grain")}, picks AS (
  SELECT spread, bool_and(complete) AS complete, max(cand) FILTER (grain = 'spread') AS chosen, max(cand) FILTER (grain = 'left') AS "left", max(cand) FILTER (grain = 'right') AS "right" FROM chosen GROUP BY spread
)
SELECT 'per_page' AS mode, * FROM picks UNION ALL SELECT 'spread', spread, complete, chosen, chosen, chosen FROM picks
"""
)
def selected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates chosen for every spread and its two pages, in both modes; incomplete spreads by absolute scores."""
    c = F.col
    rows = dealt(table(spark, sf_dir, "lineitem"), "l_orderkey", copies=3).withColumn("cand", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*_LINE_ORDER.split(", "))) - 1)

    def measures(sharp, uniform, motion, hand, glare, score):
        values = dict(zip(selection.MEASURES, (sharp, uniform, motion, hand, glare, None, score), strict=True))
        return F.struct(*[(F.lit(None) if v is None else v).cast("double").alias(k) for k, v in values.items()])

    spread = measures(
        c("l_extendedprice") / 100, F.when(c("l_partkey") % 3 == 0, c("l_partkey") % 17 / F.lit(20.0)), c("l_discount") / 4, F.when(c("l_returnflag") != "R", c("l_tax") / 4),
        c("l_quantity") / 500, c("l_suppkey") % 29 / F.lit(30.0),
    )
    left = measures(
        c("l_extendedprice") / 90, None, c("l_discount") / 5, F.when(c("l_returnflag") != "A", c("l_tax") / 6), c("l_partkey") % 9 / F.lit(100.0), c("l_suppkey") % 23 / F.lit(25.0)
    )
    right = measures(
        c("l_extendedprice") % 700, F.when(c("l_partkey") % 5 == 0, c("l_partkey") % 13 / F.lit(15.0)), c("l_discount") / 3, c("l_tax") / 5,
        F.when(c("l_partkey") % 2 == 0, c("l_quantity") / 400), F.when(c("l_suppkey") % 8 > 0, c("l_suppkey") % 19 / F.lit(20.0)),
    )
    suspect = F.array_compact(F.array(F.when(c("l_quantity") > 40, "glare_overlap"), F.when(c("l_discount") > 0.08, "high_motion"), F.when(c("l_tax") > 0.06, "hand_overlap")))
    left_suspect = F.when(c("l_partkey") % 4 == 0, F.array(F.lit("low_sharpness"))).when(c("l_partkey") % 4 == 1, F.array().cast("array<string>"))
    records = rows.select(
        c("l_orderkey").alias("spread"), c("cand").cast("long").alias("cand"), spread.alias("metrics"), left.alias("left"),
        F.when(~((c("l_suppkey") % 10 == 7) & (c("l_linenumber") % 3 == 1)), right).alias("right"),
        suspect.alias("suspect"), left_suspect.alias("left_suspect"), F.lit(None).cast("array<string>").alias("right_suspect"),
    )
    both = selection.selected(records, "per_page")
    # In the other mode the spread's choice is that of both pages.
    modes = F.array(F.struct(F.lit("per_page").alias("mode"), "left", "right"), F.struct(F.lit("spread").alias("mode"), c("chosen").alias("left"), c("chosen").alias("right")))
    return both.select("spread", "complete", "chosen", F.explode(modes).alias("m")).select("m.mode", "spread", "complete", "chosen", "m.left", "m.right")


_RULES = lines.Outline()
_STEEPEST = 0.1
_QS = [("t", "l"), ("t", "r"), ("b", "r"), ("b", "l")]


def _corner_sql(h: str, v: str) -> tuple[str, str]:
    x = f"(({v}.place + {v}.slope * ({h}.place - 0.5::DOUBLE * {h}.slope - 0.5::DOUBLE)) / (1 - {v}.slope * {h}.slope))"
    return x, f"({h}.place + {h}.slope * ({x} - 0.5::DOUBLE))"


_XY = {f"{axis}{i}": e for i, hv in enumerate(_QS) for axis, e in zip("xy", _corner_sql(*hv), strict=True)}
_LENGTHS = [f"sqrt(pow(x{(i + 1) % 4} - x{i}, 2) + pow(y{(i + 1) % 4} - y{i}, 2))" for i in range(4)]
_AREA = "abs(" + " + ".join(f"(x{i} * y{(i + 1) % 4} - x{(i + 1) % 4} * y{i})" for i in range(4)) + ") / 2"
_APART = "(" + " + ".join(f"sqrt(pow(k.x{i} - one[1].x{i}, 2) + pow(k.y{i} - one[1].y{i}, 2))" for i in range(4)) + ") / 4"
_CUT = ", ".join(f"'{c}': least(1.0::DOUBLE, greatest(0.0::DOUBLE, {c}))" for c in _XY)


@query(
    f"""
WITH all_lines AS (
  SELECT l_orderkey // 4 AS image, l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber % 2 = 0 THEN 'h' ELSE 'v' END AS kind, (l_partkey * 7 + l_linenumber * 31) % 97 / 97.0::DOUBLE AS place,
    (l_suppkey % 21 - 10) / 100.0::DOUBLE AS slope, l_quantity / 50 AS rank, l_tax * 10 AS segment FROM lineitem
), quads AS (
  SELECT t.image, [t.id, b.id, l.id, r.id] AS lines, (t.rank + b.rank + l.rank + r.rank) / 4 AS rank, (t.segment + b.segment + l.segment + r.segment) / 4 AS segment, {", ".join(f"{e} AS {c}" for c, e in _XY.items())}
  FROM all_lines t JOIN all_lines b ON b.image = t.image AND t.kind = 'h' AND b.kind = 'h' AND b.place - t.place >= {_RULES.least_down}::DOUBLE
  JOIN all_lines l ON l.image = t.image AND l.kind = 'v' JOIN all_lines r ON r.image = t.image AND r.kind = 'v' AND r.place - l.place >= {_RULES.least_across}::DOUBLE
), shaped AS (
  SELECT *, {_AREA} AS area, ({_LENGTHS[0]} + {_LENGTHS[2]}) / ({_LENGTHS[1]} + {_LENGTHS[3]}) AS aspect FROM quads
  WHERE {" AND ".join(f"{c} BETWEEN {-_RULES.outside}::DOUBLE AND {1 + _RULES.outside}::DOUBLE" for c in _XY)}
), rated AS (
  SELECT *, round(0.28::DOUBLE * least(area / 0.3::DOUBLE, 1) + 0.2::DOUBLE * exp(-abs(ln(aspect / 0.72::DOUBLE))) + 0.18::DOUBLE * rank + 0.06::DOUBLE * segment, 9) AS score FROM shaped
  WHERE area BETWEEN {_RULES.areas[0]}::DOUBLE AND {_RULES.areas[1]}::DOUBLE AND aspect BETWEEN {_RULES.aspects[0]}::DOUBLE AND {_RULES.aspects[1]}::DOUBLE
), first_choice AS (
  SELECT *, round(score + 0.28::DOUBLE * (1 - abs(x0 + x2 - 1)), 9) AS confidence FROM rated QUALIFY row_number() OVER (PARTITION BY image ORDER BY score DESC, lines) <= {_RULES.first}
), listed AS MATERIALIZED (
  SELECT image, list({{'confidence': confidence, 'lines': lines, {_CUT}}} ORDER BY confidence DESC, lines) AS qs FROM first_choice GROUP BY image
), kept AS MATERIALIZED (
  SELECT image, list_reduce(list_transform(qs, lambda q: [q]), lambda ks, one: CASE WHEN len(ks) < {_RULES.shown} AND len(list_filter(ks, lambda k: {_APART} < {_RULES.same}::DOUBLE)) = 0 THEN list_concat(ks, one) ELSE ks END) AS ks FROM listed
)
SELECT image, place::INT AS place, array_to_string(ks[place].lines, ',') AS lines, round(least(1, greatest(0, ks[place].confidence)), 6) AS confidence, round(ks[place].x0, 6) AS x0, round(ks[place].y2, 6) AS y2
FROM (SELECT image, ks, unnest(range(1, len(ks) + 1)) AS place FROM kept)
"""
)
def line_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best outlines of every image that differ, from pairs of its horizontal and of its vertical lines."""
    c = F.col
    found = dealt(table(spark, sf_dir, "lineitem").withColumn("image", F.floor(c("l_orderkey") / 4).cast("long")), "image").select(
        "image", (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), F.when(c("l_linenumber") % 2 == 0, "h").otherwise("v").alias("kind"),
        ((c("l_partkey") * 7 + c("l_linenumber") * 31) % 97 / F.lit(97.0)).alias("place"), ((c("l_suppkey") % 21 - 10) / F.lit(100.0)).alias("slope"),
        (c("l_quantity") / 50).alias("rank"), (c("l_tax") * 10).alias("segment"),
    )
    support = lambda *q: 1 - F.abs(q[0]["x"] + q[2]["x"] - 1)
    rows = lines.outlines(found, _STEEPEST, _RULES, support)
    named = F.array_join(F.transform("lines", lambda x: x.cast("string")), ",")
    return rows.select("image", "place", named.alias("lines"), F.round("confidence", 6).alias("confidence"), F.round("x0", 6).alias("x0"), F.round("y2", 6).alias("y2"))


#: A raster's pixels above a bound that differs by raster don't count.
_BOUND = "0.02::DOUBLE + (vec_id % 13) / 50.0::DOUBLE"


@query(
    f"""
WITH pixels AS (
  SELECT label AS grp, pos::INT - 1 AS pos, embedding[pos]::DOUBLE AS v, embedding[pos]::DOUBLE < {_BOUND} AS valid FROM embeddings, range(1, 65) r(pos)
), medians AS (
  SELECT grp, pos, count(*) AS n, count(*) FILTER (valid) AS n_valid, median(v) FILTER (valid) AS mid FROM pixels GROUP BY grp, pos HAVING count(*) >= 3
), away AS (
  SELECT p.grp, p.pos, median(abs(v - mid)) AS mad FROM pixels p JOIN medians m ON m.grp = p.grp AND m.pos = p.pos WHERE valid GROUP BY p.grp, p.pos
)
SELECT m.grp, m.pos, n, n_valid, round(mid, 9) AS mid, coalesce(round(mad, 9), 255) AS mad FROM medians m LEFT JOIN away a ON a.grp = m.grp AND a.pos = m.pos
"""
)
def masked_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and deviation of each pixel over a group's rasters, without those masked."""
    bound = F.lit(0.02) + F.col("vec_id") % 13 / F.lit(50.0)
    pixels = table(spark, sf_dir, "embeddings").select(F.col("label").alias("grp"), bound.alias("bound"), F.posexplode("embedding").alias("pos", "v"))
    found = profiles.masked_medians(pixels.select("grp", "pos", F.col("v").cast("double").alias("v"), (F.col("v").cast("double") < F.col("bound")).alias("valid")), ["grp"])
    return found.select("grp", "pos", "n", "n_valid", F.round("mid", 9).alias("mid"), F.round("mad", 9).alias("mad"))


@query(
    f"""
WITH frames AS (
  SELECT l_orderkey // 4 AS spread, ['top', 'right', 'bottom', 'left'][(l_partkey % 4 + 1)::INT] AS edge,
    l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) AS frame,
    l_quantity / 80 AS support, l_quantity / 60 AS visible_support, l_tax * 3 AS occlusion FROM lineitem
), means AS (
  SELECT spread, edge, count(*) AS n, avg(support) AS support, avg(visible_support) AS visible_support, avg(occlusion) AS occlusion
  FROM (SELECT * FROM frames QUALIFY row_number() OVER (PARTITION BY spread, edge ORDER BY support DESC, frame) <= 2) GROUP BY spread, edge
), judged AS (
  SELECT *, list_filter([CASE WHEN round(support, 9) < 0.22::DOUBLE THEN 'weak_edge' END, CASE WHEN round(occlusion, 9) >= 0.18::DOUBLE THEN 'hand_occlusion' END], lambda x: x IS NOT NULL) AS reasons FROM means
)
SELECT spread, edge, n, round(support, 9) AS support, round(visible_support, 9) AS visible_support, round(occlusion, 9) AS occlusion, array_to_string(reasons, ',') AS reasons,
  coalesce(array_to_string(list_sort(list(edge) FILTER (len(reasons) > 0) OVER (PARTITION BY spread)), ','), '') AS uncertain, round(min(support) OVER (PARTITION BY spread), 9) AS least_support FROM judged
"""
)
def edge_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks for each edge of a spread in its two best frames, and which edges are uncertain."""
    c = F.col
    edges = F.array(*map(F.lit, ("top", "right", "bottom", "left")))
    within = F.row_number().over(W.partitionBy("l_orderkey").orderBy(*_LINE_ORDER.split(", ")))
    frames = table(spark, sf_dir, "lineitem").select(
        F.floor(c("l_orderkey") / 4).cast("long").alias("spread"), F.element_at(edges, (c("l_partkey") % 4 + 1).cast("int")).alias("edge"), (c("l_orderkey") * 1000 + within).alias("frame"),
        (c("l_quantity") / 80).alias("support"), (c("l_quantity") / 60).alias("visible_support"), (c("l_tax") * 3).alias("occlusion"),
    )
    found = profiles.edge_evidence(frames, "spread")
    rounded = [F.round(x, 9).alias(x) for x in ("support", "visible_support", "occlusion")]
    return found.select("spread", "edge", "n", *rounded, F.array_join("reasons", ",").alias("reasons"), F.array_join("uncertain", ",").alias("uncertain"), F.round("least_support", 9).alias("least_support"))
