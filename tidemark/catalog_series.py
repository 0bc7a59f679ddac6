"""Named queries of series on grids, between points and read again more densely."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalog import BINNED_SQL, BINS, DAY, HIGH, INTERVALS_SQL, LOW, MOTION_WEIGHT, REQUIRED, STATES_SQL, TURNS_SQL, query
from .operators import resample, rescan, segments
from .sources.adapters import SAMPLES_SQL, samples, table
from .sources.scratch import stage_table

#: Grid points a second: the supplied events come about twice a day.
FINE, COARSE = 4 / DAY, 0.5 / DAY


def _grid_sql(name: str, source: str, keys: str, rate: float, start: str | None = None) -> str:
    """Tables that end in ``name``: the rows of ``source`` on a grid."""
    begin = start or f"min(t) OVER (PARTITION BY {keys})"
    return f"""{name}_placed AS (
  SELECT *, {begin} AS begin_at, floor((t - min(t) OVER (PARTITION BY {keys})) * {rate!r}::DOUBLE + 0.5::DOUBLE)::BIGINT AS slot FROM {source} {f"WHERE t >= {start}" if start else ""}
), {name}_last AS (
  SELECT *, count(*) OVER (PARTITION BY {keys}, slot) - 1 AS beside FROM {name}_placed QUALIFY row_number() OVER (PARTITION BY {keys}, slot ORDER BY t DESC, idx DESC) = 1
), {name}_next AS (
  SELECT *, coalesce(lead(slot) OVER (PARTITION BY {keys} ORDER BY slot), slot + 1) AS next_slot FROM {name}_last
), {name} AS (
  SELECT * EXCLUDE (k), k, begin_at + k / {rate!r}::DOUBLE AS time, k > slot AS repeated, CASE WHEN k > slot THEN 0 ELSE beside END AS passed
  FROM (SELECT *, unnest(range(slot, next_slot)) AS k FROM {name}_next)
)"""


@query(
    f"""
WITH {SAMPLES_SQL}, {_grid_sql("fine", "samples", "entity", FINE)}, {_grid_sql("coarse", "samples", "entity", COARSE)}
SELECT 'fine' AS rate, entity, k, round(time, 6) AS time, idx, motion, repeated, passed FROM fine
UNION ALL SELECT 'coarse', entity, k, round(time, 6), idx, motion, repeated, passed FROM coarse
"""
)
def grid_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's samples on a grid denser, and on one sparser, than they are."""

    def at(rate: float, name: str) -> DataFrame:
        rows = resample.on_grid(samples(spark, sf_dir), rate, ["entity"], order=("t", "idx"))
        return rows.select(F.lit(name).alias("rate"), "entity", "k", F.round("time", 6).alias("time"), "idx", "motion", "repeated", "passed")

    return at(FINE, "fine").unionByName(at(COARSE, "coarse"))


@query(
    f"""
WITH {SAMPLES_SQL}, expected AS (
  SELECT c_custkey AS entity, CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE (27 + c_custkey % 5) * {DAY} END AS duration FROM customer
), counted AS (
  SELECT e.entity, coalesce(floor((max(t) - min(t)) * {FINE!r}::DOUBLE + 0.5::DOUBLE) + 1, 0)::BIGINT AS n_points, floor(any_value(duration) * {FINE!r}::DOUBLE + 0.5::DOUBLE)::BIGINT AS n_wanted
  FROM expected e LEFT JOIN samples s ON s.entity = e.entity GROUP BY e.entity
)
SELECT *, CASE WHEN n_points = 0 THEN 'empty' WHEN n_wanted IS NULL THEN 'unknown' WHEN n_points < n_wanted - 1 THEN 'truncated' ELSE 'ok' END AS status FROM counted
"""
)
def grid_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each customer's series is there and covers its time."""
    key = F.col("c_custkey")
    expected = table(spark, sf_dir, "customer").select(key.alias("entity"), F.when(key % 5 != 4, (27 + key % 5) * F.lit(DAY)).alias("duration"))
    return resample.grid_checks(samples(spark, sf_dir), expected, FINE, ["entity"])


#: Points of a profile: places and strengths of a customer's orders; the height is the customer's own.
_POINTS_SQL = """
points AS (
  SELECT o_custkey AS id, (o_totalprice % 1000) / 1000 AS y, (o_orderkey % 41 - 2) / 100.0::DOUBLE AS strength FROM orders
), sizes AS (
  SELECT c_custkey AS id, c_custkey % 230 AS height FROM customer
)"""


def _neighbours_sql(points: str, wanted: str, key: str, x: str, y: str) -> str:
    """Select list over ``wanted w``: the value between the points before and after."""
    return f"""SELECT w.*, CASE WHEN a IS NULL THEN b[2] WHEN b IS NULL THEN a[2] ELSE a[2] + (b[2] - a[2]) / (b[1] - a[1]) * (w.{x} - a[1]) END AS v FROM (
    SELECT w.*, max([p.{x}, p.{y}]) FILTER (p.{x} <= w.{x}) AS a, min([p.{x}, p.{y}]) FILTER (p.{x} > w.{x}) AS b
    FROM {wanted} w LEFT JOIN {points} p ON p.{key} = w.{key} GROUP BY ALL) w"""


_WIDTH_SQL = "greatest(3, least(81, round_even(n * 0.05::DOUBLE, 0)))::INT"


@query(
    f"""
WITH {_POINTS_SQL}, placed AS (
  SELECT p.id, least(1, greatest(0, y)) * greatest(1, height - 1) AS at, least(0.35::DOUBLE, greatest(0, strength)) AS strength FROM points p JOIN sizes s ON s.id = p.id WHERE height > 0
), wanted AS (
  SELECT id, height AS n, unnest(range(height)) AS row FROM sizes WHERE height > 0
), asked AS (
  SELECT *, row::DOUBLE AS at FROM wanted
), between_points AS (
  {_neighbours_sql("placed", "asked", "id", "at", "strength")}
), odd AS (
  SELECT *, {_WIDTH_SQL} + CASE WHEN {_WIDTH_SQL} % 2 = 0 THEN 1 ELSE 0 END AS w0 FROM between_points
), wide AS (
  SELECT *, CASE WHEN w0 > n AND n > 1 THEN n - CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END ELSE w0 END AS w FROM odd
), weights AS (
  SELECT w, i, exp(-pow(i - (w - 1) / 2, 2) / (2 * pow(greatest(1, w / 4), 2))) AS g FROM (SELECT DISTINCT w::INT AS w FROM wide WHERE w >= 3), range(81) t(i) WHERE i < w
), smooth AS (
  SELECT a.id, a.row, sum(b.v * g) / sum(g) AS v FROM wide a JOIN weights k ON k.w = a.w
  JOIN wide b ON b.id = a.id AND b.row = least(a.n - 1, greatest(0, a.row + k.i - (a.w - 1) // 2)) GROUP BY ALL
)
SELECT a.id, a.row, coalesce(round(least(0.35::DOUBLE, greatest(0, coalesce(s.v, a.v))), 9), 0.1::DOUBLE) AS strength FROM wide a LEFT JOIN smooth s ON s.id = a.id AND s.row = a.row
"""
)
def row_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strength for each row of a raster, between the points of its profile and smoothed."""
    points = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), (F.col("o_totalprice") % 1000 / 1000).alias("y"), ((F.col("o_orderkey") % 41 - 2) / F.lit(100.0)).alias("strength"))
    sizes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 230).alias("height"))
    return resample.row_strengths(points, sizes, ["id"], fallback=0.1).withColumn("strength", F.round("strength", 9))


CENTRES = [round(0.08 + 0.105 * k, 3) for k in range(9)]


@query(
    f"""
WITH points AS (
  SELECT l_orderkey AS id, l_discount * 10 AS y, CASE WHEN s < 0.015::DOUBLE THEN 0 ELSE s END AS strength
  FROM (SELECT l_orderkey, l_discount, least(0.35::DOUBLE, greatest(0, (0.96::DOUBLE - (0.5::DOUBLE + l_tax * 6)) * 0.9::DOUBLE)) AS s FROM lineitem)
), asked AS (
  SELECT id, unnest(range(9)) AS place, unnest({CENTRES}::DOUBLE[]) AS y FROM (SELECT id FROM points GROUP BY id HAVING count(*) >= 2)
), between_points AS (
  {_neighbours_sql("points", "asked", "id", "y", "strength")}
)
SELECT id, place, y, round(least(0.35::DOUBLE, greatest(0, 0.2::DOUBLE * coalesce(lag(v) OVER o, v) + 0.6::DOUBLE * v + 0.2::DOUBLE * coalesce(lead(v) OVER o, v))), 9) AS strength
FROM between_points WINDOW o AS (PARTITION BY id ORDER BY place)
"""
)
def strength_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strengths from measured ratios, at nine fixed centres."""
    raw = F.least(F.lit(0.35), F.greatest(F.lit(0.0), (0.96 - (0.5 + F.col("l_tax") * 6)) * 0.9))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_discount") * 10).alias("y"), F.when(raw < 0.015, 0.0).otherwise(raw).alias("strength"))
    found = resample.profile_at(lines, CENTRES, ["id"], "y", "strength", 0.35)
    return found.select("id", F.col("place").cast("long").alias("place"), "y", F.round("strength", 9).alias("strength"))


#: The first pass looks twice a day, the second six times a day if the source has so many.
FIRST, SECOND, SOURCE = 2 / DAY, 6 / DAY, 5 / DAY
RATE = rescan.effective_rate(SECOND, SOURCE, FIRST)
#: Windows are read together up to these gaps and spans; runs of 3 samples count, and are tried against segments up to these lengths.
GAP, SPAN, STILL, LEAST = 1.0 * DAY, 8.0 * DAY, 40.0, 3
SHORT, AWAY, ALIKE = 0.8 * DAY, 2.0 * DAY, 25.0


def first_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples as a first, sparse pass sees them."""
    rows = resample.on_grid(samples(spark, sf_dir), FIRST, ["entity"], order=("t", "idx"))
    return rows.select("entity", F.col("k").alias("idx"), F.col("time").alias("t"), "motion", "sharpness")


def second_pass(dense: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """Samples of the windows, read in groups of neighbouring ones, with the change from sample to sample as motion."""
    sampled = rescan.samples_of_groups(dense.select("entity", "t", "idx", F.col("motion").alias("look"), "sharpness"), windows, RATE, DAY)
    change = F.abs(F.col("look") - F.col("before.look"))
    return rescan.samples_in_windows(sampled, windows, key, RATE, DAY, change, first_motion=1000.0)


_FIRST_SQL = f"""{SAMPLES_SQL}, {_grid_sql("first_grid", "samples", "entity", FIRST)}, first_samples AS (
  SELECT entity, k AS idx, time AS t, motion, sharpness FROM first_grid
), {STATES_SQL.split(SAMPLES_SQL + ",", 1)[1].replace("FROM samples", "FROM first_samples")}, {TURNS_SQL.split(SAMPLES_SQL + ",", 1)[1].replace("FROM samples", "FROM first_samples")}, segs AS (
  SELECT entity, min(t) AS start, max(t) AS "end", arg_min(motion, t) AS first_look, arg_max(motion, t) AS last_look FROM states WHERE member GROUP BY entity, episode
), pairs AS (
  SELECT entity, event, id AS left_turn, "end" AS window_start, peak_time AS left_peak, lead(id) OVER w AS right_turn, lead(start) OVER w AS window_end, lead(peak_time) OVER w AS right_peak
  FROM turns WINDOW w AS (PARTITION BY entity ORDER BY event)
), empty_pairs AS (
  SELECT * FROM pairs p WHERE window_end > window_start AND NOT EXISTS (
    SELECT 1 FROM segs i WHERE i.entity = p.entity AND (i.start + i."end") / 2 > p.left_peak AND (i.start + i."end") / 2 < p.right_peak)
), windows AS (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY window_start) AS win FROM (
    SELECT p.entity, left_turn || '-' || right_turn AS id, p.window_start, p.window_end, count(*) AS n_first
    FROM empty_pairs p JOIN first_samples s ON s.entity = p.entity AND s.t > p.window_start AND s.t < p.window_end
    GROUP BY ALL HAVING min(s.motion) <= {LOW + 0.65 * (HIGH - LOW)})
)"""


def _second_sql(key: str) -> str:
    """Tables from ``grouped`` (entity, key, window_start, window_end, grp_start, grp_end) on, which end in ``measured``."""
    half = f"{0.5 / RATE!r}::DOUBLE"
    return f"""inside AS (
  SELECT DISTINCT s.entity, s.idx, s.t, s.motion AS look, s.sharpness, g.grp_start FROM samples s JOIN grouped g ON s.entity = g.entity AND s.t >= g.grp_start AND s.t <= g.grp_end + {half}
), {_grid_sql("second_grid", "inside", "entity, grp_start", RATE, "grp_start")}, in_window AS (
  SELECT w.{key}, w.window_start, w.window_end, s.* FROM second_grid s JOIN grouped w ON w.entity = s.entity AND w.grp_start = s.grp_start AND s.time >= w.window_start - {half} AND s.time <= w.window_end + {half}
), measured AS (
  SELECT *, row_number() OVER (PARTITION BY entity, {key} ORDER BY time) - 1 AS n, coalesce(abs(look - lag(look) OVER (PARTITION BY entity, {key} ORDER BY time)), 1000.0::DOUBLE) AS motion FROM in_window
)"""


@query(
    f"""
WITH RECURSIVE {_FIRST_SQL}, fold(entity, win, g0, g1) AS (
  SELECT entity, win, window_start, window_end FROM windows WHERE win = 1
  UNION ALL
  SELECT w.entity, w.win, CASE WHEN w.window_start - f.g1 <= {GAP} AND w.window_end - f.g0 <= {SPAN} THEN f.g0 ELSE w.window_start END, w.window_end
  FROM fold f JOIN windows w ON w.entity = f.entity AND w.win = f.win + 1
), grouped AS (
  SELECT w.*, f.g0 AS grp_start, max(f.g1) OVER (PARTITION BY f.entity, f.g0) AS grp_end FROM windows w JOIN fold f ON f.entity = w.entity AND f.win = w.win
), {_second_sql("id")}, islands AS (
  SELECT *, sum((motion > {STILL})::INT) OVER (PARTITION BY entity, id ORDER BY n) AS island FROM measured
), low_runs AS (
  SELECT entity, id, min(time) AS start, max(time) AS "end", count(*) AS n_samples, round(avg(sharpness), 9) AS sharp, round(avg(motion), 9) AS mean, min({{'motion': motion, 'time': time, 'look': look}}) AS quiet
  FROM islands WHERE motion <= {STILL} GROUP BY entity, id, island HAVING count(*) >= {LEAST}
), best AS (
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY quiet.time) AS number FROM (
    SELECT * FROM low_runs QUALIFY row_number() OVER (PARTITION BY entity, id ORDER BY "end" - start DESC, sharp DESC, mean, start) = 1)
), known_lists AS (
  SELECT entity, list({{'s': start, 'e': "end", 'a': first_look, 'b': last_look, 'made': 0}} ORDER BY start) AS known FROM segs GROUP BY entity
), tried(entity, number, known, target) AS (
  SELECT b.entity, 0::BIGINT, coalesce(any_value(k.known), []), NULL::DOUBLE FROM best b LEFT JOIN known_lists k ON k.entity = b.entity GROUP BY b.entity
  UNION ALL
  SELECT entity, number, CASE WHEN target IS NULL THEN list_append(known, {{'s': start, 'e': "end", 'a': look, 'b': look, 'made': 1}}) ELSE known END, target FROM (
    SELECT b.entity, b.number, t.known, b.start, b."end", b.quiet.look AS look, CASE WHEN b."end" - b.start <= {SHORT} THEN list_filter(
      list_sort(list_transform(t.known, lambda s: {{'d': least(abs(b.quiet.time - s.s), abs(b.quiet.time - s.e)), 'made': s.made, 's': s.s, 'e': s.e, 'a': s.a, 'b': s.b}}))[1:3],
      lambda s: abs(CASE WHEN s.e <= b.quiet.time THEN s.e ELSE s.s END - b.quiet.time) <= {AWAY} AND abs(b.quiet.look - CASE WHEN s.e <= b.quiet.time THEN s.b ELSE s.a END) <= {ALIKE})[1].s END AS target
    FROM tried t JOIN best b ON b.entity = t.entity AND b.number = t.number + 1)
), counts AS (
  SELECT entity, id, count(*) AS n_second FROM measured GROUP BY entity, id
)
SELECT w.entity, w.id, w.n_first, c.n_second, round(b.start, 6) AS start, round(b."end", 6) AS "end", b.n_samples, round(b.quiet.time, 6) AS time, round(t.target, 6) AS target_start,
  CASE WHEN b.start IS NULL THEN 'none' WHEN t.target IS NULL THEN 'recovered' ELSE 'merged' END AS outcome
FROM windows w LEFT JOIN counts c ON c.entity = w.entity AND c.id = w.id LEFT JOIN best b ON b.entity = w.entity AND b.id = w.id LEFT JOIN tried t ON t.entity = b.entity AND t.number = b.number
"""
)
def rescanned_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows without a segment in a sparse pass, what a denser pass over them finds, and whether it belongs to a segment known."""
    first = stage_table(first_pass(spark, sf_dir), "first_pass")
    missing = segments.missing_windows(first, LOW, HIGH, REQUIRED, 10.0).select("entity", "id", "window_start", "window_end")
    windows = stage_table(rescan.grouped_windows(missing, GAP, SPAN), "windows")
    measured = stage_table(second_pass(samples(spark, sf_dir), windows, "id"), "second_pass")
    runs = stage_table(rescan.best_runs(measured, ["entity", "id"], STILL, LEAST), "runs")
    members = segments.hysteresis(first, LOW, HIGH, REQUIRED).where("member").groupBy("entity", "episode")
    known = members.agg(F.min("t").alias("start"), F.max("t").alias("end"), F.min_by("motion", "t").alias("first_look"), F.max_by("motion", "t").alias("last_look"))
    decided = rescan.recovered_or_merged(runs, known, SHORT, AWAY, ALIKE)
    met = first.select(F.col("entity").alias("_entity"), "t").join(windows.withColumnRenamed("entity", "_entity"), "_entity").where("t > window_start and t < window_end")
    n_first = met.groupBy(F.col("_entity").alias("entity"), "id").agg(F.count(F.lit(1)).alias("n_first"))
    n_second = measured.groupBy("entity", "id").agg(F.count(F.lit(1)).alias("n_second"))
    found = runs.join(decided, ["entity", "start"])
    rows = windows.select("entity", "id").join(n_first, ["entity", "id"], "left").join(n_second, ["entity", "id"], "left").join(found, ["entity", "id"], "left")
    outcome = F.when(F.col("start").isNull(), "none").when(F.col("target_start").isNull(), "recovered").otherwise("merged")
    rounded = [F.round(c, 6).alias(c) for c in ("start", "end", "time", "target_start")]
    return rows.select("entity", "id", "n_first", "n_second", *rounded, "n_samples", outcome.alias("outcome"))


#: A reviewed spread is looked at again so far around its choice; so many new candidates at most.
RADIUS, NEW = 1.0 * DAY, 4


@query(
    f"""
WITH {BINNED_SQL}, known AS (
  SELECT entity, episode, row_number() OVER (PARTITION BY entity, episode ORDER BY bin) - 1 AS cand, t, row_number() OVER (PARTITION BY entity, episode ORDER BY score DESC, bin) = 1 AS chosen FROM best_of_bin
), grouped AS (
  SELECT entity, episode, greatest(0, t - {RADIUS}) AS window_start, t + {RADIUS} AS window_end, greatest(0, t - {RADIUS}) AS grp_start, t + {RADIUS} AS grp_end FROM known WHERE chosen
), {_second_sql("episode")}, picks AS (
  SELECT * FROM (SELECT *, ntile({NEW}) OVER (PARTITION BY entity, episode ORDER BY n) AS bin, round(ln(1 + sharpness) - {MOTION_WEIGHT} * motion, 9) AS score FROM measured)
  QUALIFY row_number() OVER (PARTITION BY entity, episode, bin ORDER BY score DESC, n) = 1
), fresh AS (
  SELECT entity, episode, time AS t FROM picks p WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.entity = p.entity AND k.episode = p.episode AND p.time >= k.t - {0.5 / RATE!r}::DOUBLE AND p.time <= k.t + {0.5 / RATE!r}::DOUBLE)
)
SELECT entity, episode, cand, round(t, 6) AS t, chosen, false AS rescanned FROM known
UNION ALL SELECT f.entity, f.episode, m.last + row_number() OVER (PARTITION BY f.entity, f.episode ORDER BY f.t), round(f.t, 6), false, true
FROM fresh f JOIN (SELECT entity, episode, max(cand) AS last FROM known GROUP BY ALL) m ON m.entity = f.entity AND m.episode = f.episode
"""
)
def rescanned_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every spread after a denser look around the one chosen, which stays so."""
    best = segments.binned_candidates(samples(spark, sf_dir), LOW, HIGH, REQUIRED, BINS, MOTION_WEIGHT).withColumn("score", F.round("score", 9))
    spread = W.partitionBy("entity", "episode")
    known = best.select("entity", "episode", (F.row_number().over(spread.orderBy("bin")) - 1).cast("long").alias("cand"), "t", (F.row_number().over(spread.orderBy(F.col("score").desc(), "bin")) == 1).alias("chosen"))
    known = stage_table(known, "known_candidates")
    start, end = F.greatest(F.lit(0.0), F.col("t") - RADIUS), F.col("t") + RADIUS
    # Windows around choices may overlap, so each is read for itself.
    asked = known.where("chosen").select("entity", "episode", F.col("episode").alias("grp"), start.alias("window_start"), end.alias("window_end"), start.alias("grp_start"), end.alias("grp_end"))
    picked = rescan.chosen_of_bins(second_pass(samples(spark, sf_dir), asked, "episode"), ["entity", "episode"], NEW, MOTION_WEIGHT)
    return rescan.added_candidates(picked, known, ["entity", "episode"], 0.5 / RATE, DAY).withColumn("t", F.round("t", 6))
