"""Named queries of quads that overlap, are covered, tracked and searched for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalog import query
from .catalog_more import QUADS_SQL, _quads
from .functions import geometry, polygons
from .operators import beam, cover, tracking
from .sources.adapters import table

_CORNERS = [f"{axis}{i}" for i in range(4) for axis in "xy"]

#: A quad and the next of its side, moved by shares of the page, or drawn to a half about its own first corner.
_PAIRS_SQL = f"""{QUADS_SQL}, pairs AS (
  SELECT id, {", ".join(f"lead({c}) OVER w AS n{c}" for c in _CORNERS)}, id % 5 * 0.2::DOUBLE AS shift, {", ".join(_CORNERS)} FROM quads WINDOW w AS (PARTITION BY spread, side ORDER BY id)
), placed AS (
  SELECT id, [{", ".join(f"{{'x': x{i}, 'y': y{i}}}" for i in range(4))}] AS a,
    CASE WHEN id % 7 = 0 THEN [{", ".join(f"{{'x': x0 + (x{i} - x0) * 0.5::DOUBLE, 'y': y0 + (y{i} - y0) * 0.5::DOUBLE}}" for i in (3, 2, 1, 0))}]
      ELSE [{", ".join(f"{{'x': nx{i} + shift, 'y': ny{i}}}" for i in range(4))}] END AS b
  FROM pairs WHERE nx0 IS NOT NULL OR id % 7 = 0
)"""


def _area_sql(p: str) -> str:
    """Twice the signed area of a list of points."""
    return f"coalesce(list_sum(list_transform(range(1, len({p}) + 1), lambda i: {p}[i].x * {p}[i % len({p}) + 1].y - {p}[i % len({p}) + 1].x * {p}[i].y)), 0)"


def _cut_sql(k: int) -> str:
    """The table ``cut{k+1}``: the polygon ``p`` of ``cut{k}`` cut by the k-th edge of ``b``."""
    side = "((q.x - o.x) * ({0}.y - o.y) - (q.y - o.y) * ({0}.x - o.x))"
    return f"""sides{k} AS (
  SELECT *, b[{k + 1}] AS o, b[{(k + 1) % 4 + 1}] AS q FROM cut{k}
), marked{k} AS (
  SELECT * EXCLUDE (p), list_transform(range(1, len(p) + 1), lambda i: {{'u': p[i], 'v': p[i % len(p) + 1]}}) AS p FROM sides{k}
), valued{k} AS (
  SELECT * EXCLUDE (p), list_transform(p, lambda e: {{'u': e.u, 'v': e.v, 'su': {side.format("e.u")}, 'sv': {side.format("e.v")}}}) AS p FROM marked{k}
), cut{k + 1} AS (
  SELECT * EXCLUDE (p, o, q), flatten(list_transform(p, lambda e: list_concat(CASE WHEN e.su >= 0 THEN [e.u] ELSE [] END,
    CASE WHEN (e.su > 0 AND e.sv < 0) OR (e.su < 0 AND e.sv > 0) THEN [{{'x': e.u.x + (e.v.x - e.u.x) * (e.su / (e.su - e.sv)), 'y': e.u.y + (e.v.y - e.u.y) * (e.su / (e.su - e.sv))}}] ELSE [] END))) AS p FROM valued{k}
)"""


@query(
    f"""
WITH {_PAIRS_SQL}, cut0 AS (
  SELECT id, a, CASE WHEN {_area_sql("b")} < 0 THEN list_reverse(b) ELSE b END AS b, a AS p FROM placed
), {", ".join(_cut_sql(k) for k in range(4))}, areas AS (
  SELECT id, abs({_area_sql("a")}) / 2 AS area_a, abs({_area_sql("b")}) / 2 AS area_b, abs({_area_sql("p")}) / 2 AS shared FROM cut4
)
SELECT id, round(shared, 9) AS common_area, round(CASE WHEN area_a <= 0 OR area_b <= 0 THEN 0 ELSE shared / (area_a + area_b - shared) END, 9) AS share FROM areas
"""
)
def quad_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a quad and the next of its side cover the same: apart, touching, overlapping or one inside the other."""
    following = W.partitionBy("spread", "side").orderBy("id")
    pairs = _quads(spark, sf_dir).select("id", *_CORNERS, *[F.lead(c).over(following).alias(f"n{c}") for c in _CORNERS]).where("nx0 is not null or id % 7 = 0")
    c = F.col
    half = geometry.ring(*[(c("x0") + (c(f"x{i}") - c("x0")) * 0.5, c("y0") + (c(f"y{i}") - c("y0")) * 0.5) for i in (3, 2, 1, 0)])
    shifted = geometry.ring(*[(c(f"nx{i}") + c("id") % 5 * 0.2, c(f"ny{i}")) for i in range(4)])
    placed = pairs.select("id", geometry.quad_ring().alias("a"), F.when(c("id") % 7 == 0, half).otherwise(shifted).alias("b"))
    met = placed.select("id", polygons.overlap_areas("a", "b").alias("areas"))
    a, b, both = (c(f"areas.{k}") for k in ("a", "b", "common"))
    return met.select("id", F.round(both, 9).alias("common_area"), F.round(geometry.shared_part(a, b, both), 9).alias("share"))


#: Eight vectors that follow each other are one group: the first is the target, the others its donors. A raster's upper and lower half are components.
_DONORS_SQL = """
bits AS (
  SELECT vec_id // 8 AS grp, vec_id % 8 AS donor, half, (vec_id * 37 % 100) / 100.0::DOUBLE AS score, (vec_id * 53 % 100) / 100.0::DOUBLE AS residual,
    list_sum(list_transform(range(32), lambda i: CASE WHEN embedding[half * 32 + i + 1] > 0 THEN 1::BIGINT << i ELSE 0 END))::BIGINT AS word
  FROM embeddings, range(2) t(half)
)"""


@query(
    f"""
WITH RECURSIVE {_DONORS_SQL}, fold(grp, half, n, open, picks) AS (
  SELECT grp, half, 0, word, []::STRUCT(donor BIGINT, bits INTEGER)[] FROM bits WHERE donor = 0
  UNION ALL
  SELECT grp, half, n + 1, xor(open, usable), list_append(picks, {{'donor': donor, 'bits': bits}}) FROM (
    SELECT f.*, d.donor, f.open & d.word AS usable, bit_count(f.open & d.word)::INT AS bits,
      row_number() OVER (PARTITION BY f.grp, f.half ORDER BY round(0.5::DOUBLE * (bit_count(f.open & d.word) / bit_count(f.open)) + 0.3::DOUBLE * d.score + 0.2::DOUBLE * (1 - d.residual), 9) DESC, bit_count(f.open & d.word) DESC, d.donor) AS place
    FROM fold f JOIN bits d ON d.grp = f.grp AND d.half = f.half AND d.donor > 0
    WHERE bit_count(f.open) >= 3 AND bit_count(f.open & d.word) >= 3 AND NOT list_contains(list_transform(f.picks, lambda p: p.donor), d.donor)
  ) WHERE place = 1
), ends AS (
  SELECT grp, half, arg_max(open, n) AS open, arg_max(picks, n) AS picks FROM fold GROUP BY grp, half
)
SELECT e.grp, e.half, bit_count(b.word)::INT AS total, bit_count(e.open)::INT AS "left", array_to_string(list_transform(picks, lambda p: p.donor || ':' || p.bits), ',') AS picks
FROM ends e JOIN bits b ON b.grp = e.grp AND b.half = e.half AND b.donor = 0
"""
)
def donor_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which donors cover the set bits of a target, one after the other, and what they leave."""
    vec = F.col("vec_id")
    halves = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    pixels = F.slice("embedding", F.col("half") * 32 + 1, F.lit(32))
    word = F.aggregate(F.transform(pixels, lambda v, i: F.when(v > 0, F.shiftleft(F.lit(1).cast("long"), 0) * F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, v: s + v)
    bits = halves.select(F.floor(vec / 8).cast("long").alias("grp"), (vec % 8).alias("donor"), "half", (vec * 37 % 100 / F.lit(100.0)).alias("score"), (vec * 53 % 100 / F.lit(100.0)).alias("residual"), F.array(word).alias("clean"))
    targets = bits.where("donor = 0").select("grp", "half", F.col("clean").alias("mask"))
    found = cover.greedy_cover(targets, bits.where("donor > 0"), ["grp", "half"], least=3)
    picks = F.array_join(F.transform("picks", lambda p: F.concat_ws(":", p["donor"].cast("string"), p["bits"].cast("string"))), ",")
    return found.select("grp", F.col("half").cast("long").alias("half"), "total", "left", picks.alias("picks"))


#: Small moves of a page from the measures of order lines; one in eleven steps found no map, and some are far too large.
_LINE_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax"
_START = [0.2, 0.2, 0.8, 0.22, 0.78, 0.8, 0.22, 0.78]
_START_SQL = f"({_START}::DOUBLE[])"


def _point_sql(x: str, y: str) -> tuple[str, str]:
    z = f"(m6 * {x} + m7 * {y} + 1)"
    return f"((1 * {x} + m1 * {y} + m2) / {z})", f"((m3 * {x} + 1 * {y} + m5) / {z})"


_MOVED = {f"{axis}{i}": value for i in range(4) for axis, value in zip("xy", _point_sql(f"q[{2 * i + 1}]", f"q[{2 * i + 2}]"), strict=True)}
_AREA_OF = "(abs(" + " + ".join("({0}[%d] * {0}[%d] - {0}[%d] * {0}[%d])" % (2 * i + 1, (2 * i + 3) % 8 + 1, (2 * i + 2) % 8 + 1, 2 * i + 2) for i in range(4)) + ") / 2)"


def _farthest_sql(a: str, b: str) -> str:
    return "greatest(" + ", ".join(f"sqrt(pow({a}[{i}] - {b}[{i}], 2) + pow({a}[{i + 1}] - {b}[{i + 1}], 2))" for i in range(1, 9, 2)) + ")"


def _turn_sql(q: str, i: int) -> str:
    a, b, c = (2 * (k % 4) + 1 for k in (i, i + 1, i + 2))
    return f"({q}[{b}] - {q}[{a}]) * ({q}[{c + 1}] - {q}[{b + 1}]) - ({q}[{b + 1}] - {q}[{a + 1}]) * ({q}[{c}] - {q}[{b}]) > 0"


@query(
    f"""
WITH RECURSIVE steps AS (
  SELECT l_suppkey AS entity, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_LINE_ORDER}) - 1 AS idx, l_linenumber = 5 AND l_quantity % 2 = 0 AS none,
    (l_discount - 0.05::DOUBLE) / 20 AS m1, (l_tax - 0.04::DOUBLE) / 2 AS m2, (l_tax - 0.04::DOUBLE) / 20 AS m3, (l_quantity - 25.5::DOUBLE) / 1300 + CASE WHEN l_quantity = 50 THEN 0.6::DOUBLE ELSE 0 END AS m5,
    (l_discount - 0.05::DOUBLE) / 10 AS m6, (l_tax - 0.04::DOUBLE) / 10 AS m7 FROM lineitem
), chain(entity, idx, status, near, far, ratio, q) AS (
  SELECT DISTINCT entity, -1::BIGINT, '', NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, {_START}::DOUBLE[] FROM steps
  UNION ALL
  SELECT entity, idx, status, CASE WHEN ok THEN near END, CASE WHEN ok THEN far ELSE stayed END, CASE WHEN ok THEN ratio END, CASE WHEN status = 'tracked' THEN p ELSE q END FROM (
    SELECT *, CASE WHEN none THEN 'unavailable' WHEN NOT ok THEN 'invalid_transform' WHEN near > 0.08::DOUBLE THEN 'step_shift_too_large' WHEN far > 0.16::DOUBLE THEN 'total_shift_too_large'
      WHEN ratio < 0.7::DOUBLE OR ratio > 1.4::DOUBLE THEN 'area_change_too_large' ELSE 'tracked' END AS status FROM (
      SELECT *, NOT none AND inside AND {" AND ".join(_turn_sql("p", i) for i in range(4))} AND {_AREA_OF.format("p")} >= 0.005::DOUBLE AS ok,
        {_farthest_sql("p", "q")} AS near, {_farthest_sql("p", _START_SQL)} AS far, {_farthest_sql("q", _START_SQL)} AS stayed,
        {_AREA_OF.format("p")} / greatest({_AREA_OF.format(_START_SQL)}, 1e-6) AS ratio FROM (
        SELECT s.entity, s.idx, s.none, c.q, list_transform([{", ".join(_MOVED.values())}], lambda v: least(1.0::DOUBLE, greatest(0.0::DOUBLE, v))) AS p,
          {" AND ".join(f"{v} BETWEEN -0.05::DOUBLE AND 1.05::DOUBLE" for v in _MOVED.values())} AS inside
        FROM chain c JOIN steps s ON s.entity = c.entity AND s.idx = c.idx + 1)))
)
SELECT entity, idx, status, round(near, 6) AS step_shift, round(far, 6) AS total_shift, round(ratio, 6) AS area_ratio, {", ".join(f"round(q[{2 * i + k + 1}], 6) AS {axis}{i}" for i in range(4) for k, axis in enumerate("xy"))} FROM chain WHERE idx >= 0
"""
)
def tracked_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quad that each supplier's series of maps carries along, past those that can't be right."""
    lines, c = table(spark, sf_dir, "lineitem"), F.col
    order = W.partitionBy("l_suppkey").orderBy(*_LINE_ORDER.split(", "))
    found = ~((c("l_linenumber") == 5) & (c("l_quantity") % 2 == 0))
    maps = [
        F.lit(1.0), (c("l_discount") - 0.05) / 20, (c("l_tax") - 0.04) / 2,
        (c("l_tax") - 0.04) / 20, F.lit(1.0), (c("l_quantity") - 25.5) / 1300 + F.when(c("l_quantity") == 50, 0.6).otherwise(0.0),
        (c("l_discount") - 0.05) / 10, (c("l_tax") - 0.04) / 10, F.lit(1.0),
    ]
    steps = lines.select(c("l_suppkey").alias("entity"), (F.row_number().over(order) - 1).alias("idx"), *[F.when(found, m).alias(f"m{k}") for k, m in enumerate(maps)])
    quads = lines.select(c("l_suppkey").alias("entity")).distinct().select("entity", *[F.lit(v).alias(name) for v, name in zip(_START, _CORNERS, strict=True)])
    chain = tracking.tracking_chain(steps, quads)
    return chain.select("entity", "idx", "status", *[F.round(x, 6).alias(x) for x in ("step_shift", "total_shift", "area_ratio", *_CORNERS)])


#: The first quad of a side is the seed, beside one drawn outward; the last one is what is looked for. Corners are scaled by no short decimal, so that no score lies on a rounding tie.
_SCALE = 0.9731846253
_SCALED_SQL = "{" + ", ".join(f"'{c}': {c} * {_SCALE}::DOUBLE" for c in _CORNERS) + "}"
_SEARCHED_SQL = f"""{QUADS_SQL}, ends AS (
  SELECT spread, side, arg_min({_SCALED_SQL}, id) AS seed, arg_max({_SCALED_SQL}, id) AS goal FROM quads GROUP BY spread, side
)"""
_AT = [("-l", "-t"), ("1 + r", "-t"), ("1 + r", "1 + b"), ("-l", "1 + b")]


def _moved_quad_sql(q: str, move: dict[str, float]) -> str:
    out = []
    for i, at in enumerate(_AT):
        u, v = (f"({' '.join(repr(move.get(w.lstrip('-'), 0.0)) + '::DOUBLE' if w.lstrip('-') in 'lrtb' and not w.startswith('-') else '-(' + repr(move.get(w[1:], 0.0)) + '::DOUBLE)' if w.startswith('-') else w for w in e.split())})" for e in at)
        for axis in "xy":
            value = f"{q}.{axis}0 * (1 - {u}) * (1 - {v}) + {q}.{axis}1 * {u} * (1 - {v}) + {q}.{axis}2 * {u} * {v} + {q}.{axis}3 * (1 - {u}) * {v}"
            out.append(f"'{axis}{i}': least(1.0::DOUBLE, greatest(0.0::DOUBLE, {value}))")
    return "{" + ", ".join(out) + "}"


def _distance_sql(a: str, b: str) -> str:
    return "((" + " + ".join(f"sqrt(pow({a}.x{i} - {b}.x{i}, 2) + pow({a}.y{i} - {b}.y{i}, 2))" for i in range(4)) + ") / 4)"


def _apart_sql(quads: str) -> str:
    return f"list_reduce(list_transform({quads}, lambda q: [q]), lambda ks, one: list_concat(ks, list_filter(one, lambda o: len(list_filter(ks, lambda k: {_distance_sql('k', 'o')} < 0.012::DOUBLE)) = 0)))"


_RANK_SQL = f"list_sort(list_transform({{0}}, lambda q, i: {{{{'minus': -round(1 - {_distance_sql('q', 'goal')}, 9), 'place': i, 'q': q}}}}))"
_SEED_MOVES = [{"l": 0.06, "r": 0.12, "t": 0.12, "b": 0.12}]


def _search_sql(width: int) -> str:
    steps, previous = [], "ranked0"
    for k, share in enumerate(beam.STEPS, 1):
        moves = [{edge: sign * share} for edge in "lrtb" for sign in (-1, 1)]
        area = "abs(" + " + ".join(f"(q.x{i} * q.y{(i + 1) % 4} - q.x{(i + 1) % 4} * q.y{i})" for i in range(4)) + ") / 2"
        grown = f"flatten(list_transform(last[1:{width}], lambda r: list_concat([r.q], list_filter([{', '.join(_moved_quad_sql('r.q', m) for m in moves)}], lambda q: {area} >= 0.02::DOUBLE))))"
        steps.append(f"all_grown{k} AS MATERIALIZED (SELECT * EXCLUDE (last), {grown} AS grown FROM {previous})")
        steps.append(f"grown{k} AS MATERIALIZED (SELECT * EXCLUDE (grown), {_apart_sql('grown')} AS grown FROM all_grown{k})")
        steps.append(f"ranked{k} AS MATERIALIZED (SELECT * EXCLUDE (seen, grown), list_concat(seen, grown) AS seen, {_RANK_SQL.format('grown')} AS last FROM grown{k})")
        previous = f"ranked{k}"
    near = _distance_sql("k.q", "one[1].q")
    return f"""
WITH {_SEARCHED_SQL}, listed AS (
  SELECT *, {_apart_sql(f"[seed, {', '.join(_moved_quad_sql('seed', m) for m in _SEED_MOVES)}]")} AS seeds FROM ends
), ranked0 AS MATERIALIZED (
  SELECT *, seeds AS seen, {_RANK_SQL.format("seeds")} AS first, {_RANK_SQL.format("seeds")} AS last FROM listed
), {", ".join(steps)}, found AS (
  SELECT *, list_reduce(list_transform(list_concat(last[1:1], first[1:1], last[2:]), lambda r: [r]),
    lambda out, one: CASE WHEN len(out) < {width} AND len(list_filter(out, lambda k: {near} < 0.012::DOUBLE)) = 0 THEN list_concat(out, one) ELSE out END) AS found FROM {previous}
)
SELECT spread, side, {width} AS width, len(found)::INT AS n_found, round(-found[1].minus, 6) AS score, round(found[1].q.x0, 6) AS x0, round(found[1].q.y2, 6) AS y2,
  len(list_filter(found, lambda k: {_distance_sql("k.q", "first[1].q")} < 0.012::DOUBLE)) > 0 AS kept_seed FROM found"""


@query(f"SELECT * FROM ({_search_sql(1)}) UNION ALL SELECT * FROM ({_search_sql(2)})")
def searched_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quads found by moving the edges of a side's first quad towards its last, with beams of one and of two."""
    quad = F.struct(*[(F.col(c) * _SCALE).alias(c) for c in _CORNERS])
    ends = _quads(spark, sf_dir).groupBy("spread", "side").agg(F.min_by(quad, "id").alias("seed"), F.max_by(quad, "id").alias("goal"))
    seeds = ends.withColumn("seeds", F.array("seed", beam.moved(F.col("seed"), left=0.06, right=0.12, top=0.12, bottom=0.12)))
    goal = lambda q: 1 - beam.corner_distance(q, F.col("goal"))

    def searched(width: int) -> DataFrame:
        found = beam.beam_search(seeds, ["spread", "side"], "seeds", goal, width)
        one = F.try_element_at("best", F.lit(1))
        return found.select("spread", "side", F.lit(width).alias("width"), F.size("best").alias("n_found"), F.round(one["score"], 6).alias("score"), F.round(one["x0"], 6).alias("x0"), F.round(one["y2"], 6).alias("y2"), "kept_seed")

    return searched(1).unionByName(searched(2))
