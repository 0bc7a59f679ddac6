"""Named queries over profiles, sequences of look-alikes and detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalog import query
from .catalog_more import HASH_SQL, QUADS_SQL, _hashes, _quads
from .operators import folds, profiles
from .sources.adapters import table

PROFILE_SQL = """
profile AS (
  SELECT vec_id AS id, pos::INT - 1 AS pos, embedding[pos]::DOUBLE AS v FROM embeddings, range(1, 65) r(pos)
)"""
PEAKS_SQL = f"""{PROFILE_SQL}, near AS (
  SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS r FROM profile WINDOW w AS (PARTITION BY id ORDER BY pos)
), floors AS (
  SELECT id, greatest(quantile_cont(v, 0.72), avg(v) + 0.35::DOUBLE * stddev_pop(v)) AS floor FROM profile GROUP BY id
), peaks AS (
  SELECT n.id, n.pos, n.v FROM near n JOIN floors f ON n.id = f.id WHERE v >= l AND v > r AND v >= floor
)"""


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


@query(f"WITH {PEAKS_SQL} SELECT id, pos, round(v, 9) AS v FROM peaks")
def profile_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.peaks(_profile(spark, sf_dir)).withColumn("v", F.round("v", 9))


@query(
    f"""
WITH RECURSIVE {PEAKS_SQL}, ordered AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, pos) AS rn FROM peaks
), fold(id, rn, kept) AS (
  SELECT DISTINCT id, 0::BIGINT, []::DOUBLE[] FROM ordered
  UNION ALL
  SELECT f.id, o.rn, CASE WHEN len(f.kept) < 8 AND len(list_filter(f.kept, lambda k: abs(k - o.pos) < 5)) = 0 THEN list_append(f.kept, o.pos::DOUBLE) ELSE f.kept END
  FROM fold f JOIN ordered o ON o.id = f.id AND o.rn = f.rn + 1
)
SELECT id, unnest(kept)::INT AS pos FROM (SELECT id, arg_max(kept, rn) AS kept FROM fold GROUP BY id)
"""
)
def distinct_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks by falling height that lie five places or more apart, eight at most."""
    found = profiles.peaks(_profile(spark, sf_dir)).select(F.col("id").alias("entity"), F.col("pos").cast("double").alias("t"), F.col("v").alias("score"))
    return folds.nms_topk(found, 8, 5).select(F.col("entity").alias("id"), F.col("t").cast("int").alias("pos"))


@query(f"WITH {PROFILE_SQL} SELECT id, pos, round(0.2::DOUBLE * coalesce(lag(v) OVER w, v) + 0.6::DOUBLE * v + 0.2::DOUBLE * coalesce(lead(v) OVER w, v), 9) AS smooth FROM profile WINDOW w AS (PARTITION BY id ORDER BY pos)")
def profile_smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.smoothed(_profile(spark, sf_dir)).select("id", "pos", F.round("smooth", 9).alias("smooth"))


@query(
    f"""
WITH {PROFILE_SQL}, changes AS (
  SELECT id, v, abs(v - lag(v) OVER (PARTITION BY id ORDER BY pos)) AS change FROM profile
)
SELECT id, round(quantile_cont(change, 0.75), 9) AS change_p75, count(*) AS n, round(0.4::DOUBLE + 0.6::DOUBLE * greatest(0, 1 - quantile_cont(change, 0.75)), 9) AS smoothness
FROM changes GROUP BY id
"""
)
def profile_smoothness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profiles.smoothness(_profile(spark, sf_dir))
    return found.withColumns({"change_p75": F.round("change_p75", 9), "smoothness": F.round("smoothness", 9)})


@query(
    f"""
WITH {PEAKS_SQL}, gaps AS (
  SELECT id, pos, lead(pos) OVER (PARTITION BY id ORDER BY pos) AS next FROM peaks
), banded AS (
  SELECT id, next - pos AS gap, (pos + next) / 2 BETWEEN 16 AND 48 AS inside FROM gaps WHERE next IS NOT NULL
)
SELECT id, round(median(gap) FILTER (inside), 6) AS inner_gap, round(median(gap) FILTER (NOT inside), 6) AS outer_gap,
  round(median(gap) FILTER (inside) / median(gap) FILTER (NOT inside), 6) AS ratio FROM banded GROUP BY id
"""
)
def spacing_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = profiles.spacing_ratio(profiles.peaks(_profile(spark, sf_dir)), 64)
    return found.select("id", *[F.round(c, 6).alias(c) for c in ("inner_gap", "outer_gap", "ratio")])


@query(
    f"""
WITH {HASH_SQL}, opened AS (
  SELECT *, (NOT coalesce(bit_count(xor(hash, lag(hash) OVER (PARTITION BY grp ORDER BY id))) <= 26, false))::INT AS opens FROM hashes
), runs AS (
  SELECT grp, id, (sum(opens) OVER (PARTITION BY grp ORDER BY id))::BIGINT AS run FROM opened
)
SELECT grp, id, run, max(id) OVER (PARTITION BY grp, run) AS representative FROM runs
"""
)
def collapsed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.collapse_runs(_hashes(spark, sf_dir), 26).select("grp", "id", "run", "representative")


@query(
    f"""
WITH {HASH_SQL}, ranked AS (
  SELECT q.id AS query, r.id, bit_count(xor(q.hash, r.hash))::INT AS distance, row_number() OVER (PARTITION BY q.id ORDER BY bit_count(xor(q.hash, r.hash)), r.id) AS place
  FROM hashes q JOIN hashes r ON q.grp = r.grp AND q.id <> r.id WHERE q.id % 50 = 0
)
SELECT a.query, a.id AS nearest, a.distance FROM ranked a JOIN ranked b ON a.query = b.query AND a.place = 1 AND b.place = 2 WHERE a.distance < 0.95::DOUBLE * b.distance
"""
)
def nearest_by_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th item's nearest of its group, where clearly nearer than the second."""
    rows = _hashes(spark, sf_dir)
    return profiles.nearest_two(rows.where("id % 50 = 0"), rows, 0.95)


@query(
    """
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'open' WHEN l_returnflag = 'R' THEN 'returned'
  WHEN l_linestatus = 'F' THEN 'filled' ELSE 'custom' END AS preset FROM lineitem
"""
)
def preset_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    presets = [("open", {"l_returnflag": "N", "l_linestatus": "O"}), ("returned", {"l_returnflag": "R"}), ("filled", {"l_linestatus": "F"})]
    return profiles.classify_presets(table(spark, sf_dir, "lineitem"), presets).select("l_orderkey", "l_linenumber", "preset")


@query(
    f"""
WITH {QUADS_SQL}, best AS (
  SELECT * FROM quads QUALIFY row_number() OVER (PARTITION BY spread, side ORDER BY confidence DESC, id) <= 2
)
SELECT spread, side, count(*) AS n, round(avg(confidence), 9) AS support, round(avg(x0), 9) AS x0, round(avg(y0), 9) AS y0 FROM best GROUP BY spread, side
"""
)
def top_two_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the two best supported detections of each side."""
    order = W.partitionBy("spread", "side").orderBy(F.col("confidence").desc(), "id")
    best = _quads(spark, sf_dir).withColumn("_place", F.row_number().over(order)).where("_place <= 2")
    return best.groupBy("spread", "side").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 9).alias("support"), F.round(F.avg("x0"), 9).alias("x0"), F.round(F.avg("y0"), 9).alias("y0")
    )


@query(
    """
SELECT label AS grp, pos::INT - 1 AS pos, count(*) AS n, round(median(embedding[pos]::DOUBLE), 9) AS mid FROM embeddings, range(1, 65) r(pos) GROUP BY label, pos HAVING count(*) >= 3
"""
)
def temporal_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of each pixel over the rasters of a group, where three or more exist."""
    pixels = table(spark, sf_dir, "embeddings").select(F.col("label").alias("grp"), F.posexplode("embedding").alias("pos", "v"))
    found = pixels.groupBy("grp", "pos").agg(F.count(F.lit(1)).alias("n"), F.round(F.median(F.col("v").cast("double")), 9).alias("mid"))
    return found.where("n >= 3")
