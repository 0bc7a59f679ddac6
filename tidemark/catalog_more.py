"""Further named queries: folds, band joins, consensus, text keys and raster measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalog import (
    BINNED_SQL,
    CHOSEN_SQL,
    CONFIG,
    DAY,
    HIGH,
    INTERVALS_SQL,
    LOW,
    RELATIVE_SQL,
    SAMPLES_SQL,
    _interval_frame,
    _relative,
    binned_candidates,
    query,
)
from .functions import geometry, kernels, text
from .operators import asof, consensus, folds, ordering, ranking, review, segments
from .sources.adapters import CANDIDATES_SQL, GROUP_SQL, REVIEW_PAGES_SQL, candidates, dealt, rasters, review_pages, samples, seconds, table

SEPARATION, TOP = 3 * DAY, 3


@query(
    f"""
WITH RECURSIVE {BINNED_SQL}, points AS (
  SELECT entity, t, score, row_number() OVER (PARTITION BY entity ORDER BY score DESC, t) AS rn FROM best_of_bin
), fold(entity, rn, kept) AS (
  SELECT DISTINCT entity, 0::BIGINT, []::DOUBLE[] FROM points
  UNION ALL
  SELECT f.entity, p.rn, CASE WHEN len(f.kept) < {TOP} AND len(list_filter(f.kept, lambda k: abs(k - p.t) < {SEPARATION})) = 0
    THEN list_append(f.kept, p.t) ELSE f.kept END
  FROM fold f JOIN points p ON p.entity = f.entity AND p.rn = f.rn + 1
), ends AS (
  SELECT entity, arg_max(kept, rn) AS kept FROM fold GROUP BY entity
), picked AS (
  SELECT entity, unnest(range(len(kept))) AS place, kept FROM ends
)
SELECT k.entity, place::INT AS place, p.t, p.score FROM picked k JOIN points p ON p.entity = k.entity AND p.t = k.kept[place + 1]
"""
)
def nms_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.nms_topk(binned_candidates(spark, sf_dir).select("entity", "t", "score"), TOP, SEPARATION)


def _span_sql(gap: float, span: float, members: int | None) -> str:
    most = f"AND f.n < {members}" if members else ""
    return f"""
WITH RECURSIVE {INTERVALS_SQL}, rows_in AS (
  SELECT entity, start, "end", row_number() OVER (PARTITION BY entity ORDER BY start, "end") AS rn FROM intervals
), fold(entity, rn, grp, first, last, n) AS (
  SELECT entity, rn, 0, start, "end", 1 FROM rows_in WHERE rn = 1
  UNION ALL
  SELECT f.entity, r.rn,
    CASE WHEN r.start - f.last <= {gap} AND r."end" - f.first <= {span} {most} THEN f.grp ELSE f.grp + 1 END,
    CASE WHEN r.start - f.last <= {gap} AND r."end" - f.first <= {span} {most} THEN f.first ELSE r.start END, r."end",
    CASE WHEN r.start - f.last <= {gap} AND r."end" - f.first <= {span} {most} THEN f.n + 1 ELSE 1 END
  FROM fold f JOIN rows_in r ON r.entity = f.entity AND r.rn = f.rn + 1
)
SELECT entity, grp, min(first) AS start, max(last) AS "end", max(n) AS n_windows FROM fold GROUP BY entity, grp
"""


@query(_span_sql(2 * DAY, 8 * DAY, None))
def span_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.span_groups(_interval_frame(spark, sf_dir), 2 * DAY, 8 * DAY)


@query(_span_sql(3 * DAY, 15 * DAY, 3))
def decode_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.span_groups(_interval_frame(spark, sf_dir), 3 * DAY, 15 * DAY, 3)


_MERGE_GAP, _MERGE_CHANGE = 3 * DAY, 30.0


@query(
    f"""
WITH RECURSIVE {INTERVALS_SQL}, ended AS (
  SELECT i.entity, i.start, i."end", a.sharpness AS first_value, b.sharpness AS last_value,
    row_number() OVER (PARTITION BY i.entity ORDER BY i.start, i."end", a.sharpness, b.sharpness) AS rn
  FROM intervals i JOIN samples a ON a.entity = i.entity AND a.idx = i.first_idx JOIN samples b ON b.entity = i.entity AND b.idx = i.last_idx
), fold(entity, rn, grp, start, last, v0, v1, n) AS (
  SELECT entity, rn, 0, start, "end", first_value, last_value, 1 FROM ended WHERE rn = 1
  UNION ALL
  SELECT f.entity, e.rn, CASE WHEN same THEN f.grp ELSE f.grp + 1 END, CASE WHEN same THEN f.start ELSE e.start END, e."end",
    CASE WHEN same THEN f.v0 ELSE e.first_value END, e.last_value, CASE WHEN same THEN f.n + 1 ELSE 1 END
  FROM fold f JOIN (SELECT * FROM ended) e ON e.entity = f.entity AND e.rn = f.rn + 1,
    LATERAL (SELECT e.start - f.last <= {_MERGE_GAP} AND abs(e.first_value - f.v0) <= {_MERGE_CHANGE} AND abs(e.last_value - f.v1) <= {_MERGE_CHANGE} AS same)
)
SELECT entity, grp, min(start) AS start, max(last) AS "end", max(n) AS n_merged FROM fold GROUP BY entity, grp
"""
)
def chain_premerge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).select("entity", "idx", "sharpness")
    first = rows.select("entity", F.col("idx").alias("first_idx"), F.col("sharpness").alias("first_value"))
    last = rows.select("entity", F.col("idx").alias("last_idx"), F.col("sharpness").alias("last_value"))
    ended = _interval_frame(spark, sf_dir).join(first, ["entity", "first_idx"]).join(last, ["entity", "last_idx"])
    return folds.chain_premerge(ended, _MERGE_GAP, _MERGE_CHANGE)


HASH_SQL = (
    f"hashes AS (SELECT vec_id AS id, {GROUP_SQL} AS grp, ("
    + " + ".join(f"CASE WHEN embedding[{r * 8 + c + 2}] > embedding[{r * 8 + c + 1}] THEN {1 << (r * 7 + c)}::BIGINT ELSE 0 END" for r in range(8) for c in range(7))
    + ") AS hash FROM embeddings)"
)


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rasters(spark, sf_dir).select("id", "grp", kernels.difference_hash(F.col("pixels")).alias("hash"))


@query(f"WITH {HASH_SQL} SELECT id, grp, hash FROM hashes")
def difference_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashes(spark, sf_dir)


_NEAR, _BANDS = 13, 14


@query(f"WITH {HASH_SQL} SELECT a.id AS a, b.id AS b, bit_count(xor(a.hash, b.hash))::INT AS distance FROM hashes a JOIN hashes b ON a.id < b.id WHERE bit_count(xor(a.hash, b.hash)) <= {_NEAR}")
def dhash_near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within 13 of 56 bits: of 14 bands of 4 bits at least one is equal, so bands are join keys."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(_BANDS - 1)), lambda i: F.struct(i.alias("band"), F.shiftright(F.col("hash"), 0).alias("h")))
    keyed = _hashes(spark, sf_dir).withColumn("b", F.explode(bands)).select(
        "id", "hash", F.expr("b.band * 16 + (shiftright(hash, b.band * 4) & 15)").alias("key")
    )
    x, y = keyed.alias("x"), keyed.alias("y")
    distance = F.bit_count(F.col("x.hash").bitwiseXOR(F.col("y.hash")))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (distance <= _NEAR))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), distance.alias("distance")).distinct()


@query(
    f"""
WITH RECURSIVE {HASH_SQL}, ordered AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY id, hash) AS rn FROM hashes
), fold(grp, rn, id, roots, root) AS (
  SELECT grp, 0::BIGINT, NULL::BIGINT, []::STRUCT(id BIGINT, hash BIGINT)[], NULL::BIGINT FROM (SELECT DISTINCT grp FROM ordered)
  UNION ALL
  SELECT f.grp, o.rn, o.id, CASE WHEN hit IS NULL THEN list_concat([{{'id': o.id, 'hash': o.hash}}], f.roots)[1:3] ELSE f.roots END, hit
  FROM fold f JOIN ordered o ON o.grp = f.grp AND o.rn = f.rn + 1,
    LATERAL (SELECT list_filter(f.roots, lambda r: bit_count(xor(r.hash, o.hash)) <= 24)[1].id AS hit)
)
SELECT grp AS entity, id, root AS duplicate_of FROM fold WHERE rn > 0
"""
)
def window3_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hashes(spark, sf_dir).select(F.col("grp").alias("entity"), "id", "hash")
    return folds.window_dedupe(rows, 24, 3)


@query(
    f"""
WITH {HASH_SQL}, paged AS (
  SELECT h.*, row_number() OVER (PARTITION BY grp ORDER BY id) - 1 AS position FROM hashes h
), shown AS (
  SELECT grp AS project, id, position, hash, lag(hash) OVER (PARTITION BY grp ORDER BY position) AS before FROM paged
)
SELECT project, id, position, bit_count(xor(hash, before))::INT AS distance FROM shown WHERE bit_count(xor(hash, before)) <= 24
"""
)
def adjacent_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("grp").orderBy("id")
    pages = _hashes(spark, sf_dir).select(
        F.col("grp").alias("project"), "id", (F.row_number().over(order) - 1).cast("long").alias("position"), "hash", F.lit(True).alias("enabled")
    )
    return review.adjacent_duplicates(pages, 24).select("project", "id", "position", "distance")


@query(
    f"""
WITH {RELATIVE_SQL}, pages AS (
  SELECT spread // 2 AS grp, spread * 100 + cand AS item, hand, focus, list_filter(suspect, lambda x: list_contains(['low_sharpness', 'high_motion', 'underexposed', 'page_quad_uncertain'], x)) AS hard,
    list_filter(suspect, lambda x: x = 'hand_overlap') AS repair FROM relative
), pairs AS (
  SELECT *, lag(item) OVER w AS old_item, lag(hand) OVER w AS old_hand, lag(focus) OVER w AS old_focus, lag(hard) OVER w AS old_hard, lag(repair) OVER w AS old_repair
  FROM pages WINDOW w AS (PARTITION BY grp ORDER BY item)
)
SELECT grp, old_item AS older, item AS newer, coalesce(focus >= old_focus * 0.8::DOUBLE AND len(list_filter(hard, lambda x: NOT list_contains(old_hard, x))) = 0
  AND len(repair) <= len(old_repair) AND (hand <= old_hand - 0.01::DOUBLE OR (len(repair) < len(old_repair) AND hand <= old_hand + 0.005::DOUBLE)), false) AS promote
FROM pairs WHERE old_item IS NOT NULL
"""
)
def duplicate_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = ranking.codes(["low_sharpness", "high_motion", "underexposed", "page_quad_uncertain"])
    pages = _relative(spark, sf_dir).select(
        F.floor(F.col("spread") / 2).cast("long").alias("grp"),
        (F.col("spread") * 100 + F.col("cand")).alias("item"),
        "hand",
        "focus",
        F.array_intersect("suspect", hard).alias("hard"),
        F.array_intersect("suspect", ranking.codes(["hand_overlap"])).alias("repair"),
    )
    return review.duplicate_promotion(pages)


@query(
    f"""
WITH {BINNED_SQL}, existing AS (SELECT entity, t FROM best_of_bin WHERE bin = 1)
SELECT entity, idx, t FROM samples s WHERE motion <= {LOW}
  AND NOT EXISTS (SELECT 1 FROM existing e WHERE e.entity = s.entity AND s.t >= e.t - {DAY} AND s.t <= e.t + {DAY})
"""
)
def tolerance_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quiet samples that have no picked one within a day."""
    picked = binned_candidates(spark, sf_dir).where("bin = 1").select("entity", F.col("t").alias("at"))
    quiet = samples(spark, sf_dir).where(F.col("motion") <= LOW)
    near = F.col("at")
    return asof.band_join(quiet, picked, ["entity"], near - DAY, near + DAY, F.col("t"), 2 * DAY, "left_anti").select("entity", "idx", "t")


@query(
    f"""
WITH {INTERVALS_SQL}
SELECT entity, idx, t FROM samples s WHERE motion >= {HIGH}
  AND EXISTS (SELECT 1 FROM intervals i WHERE i.entity = s.entity AND s.t >= i.start - {DAY / 8} AND s.t <= i."end" + {DAY / 8})
"""
)
def containment_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loud samples inside an interval or within three hours of it."""
    spans = _interval_frame(spark, sf_dir).select("entity", "start", "end")
    loud = samples(spark, sf_dir).where(F.col("motion") >= HIGH)
    return asof.band_join(loud, spans, ["entity"], F.col("start") - DAY / 8, F.col("end") + DAY / 8, F.col("t"), 2 * DAY, "left_semi").select("entity", "idx", "t")


@query(
    f"""
WITH {INTERVALS_SQL}, fanned AS (
  SELECT s.entity, i."interval", s.idx, s.t, s.motion FROM samples s JOIN intervals i ON i.entity = s.entity AND s.t >= i.start - {DAY} AND s.t <= i."end" + {DAY}
)
SELECT *, round(motion - lag(motion) OVER (PARTITION BY entity, "interval" ORDER BY t, idx), 6) AS change FROM fanned
"""
)
def range_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples once for each interval that they lie in or within a day of, with the change inside it."""
    spans = _interval_frame(spark, sf_dir).select(F.col("entity").alias("of"), "interval", "start", "end")
    rows = samples(spark, sf_dir)
    spans = spans.withColumnRenamed("of", "entity")
    joined = asof.band_join(rows, spans, ["entity"], F.col("start") - DAY, F.col("end") + DAY, F.col("t"), 4 * DAY)
    fanned = joined.select("l.entity", "interval", "idx", "t", "motion")
    order = W.partitionBy("entity", "interval").orderBy("t", "idx")
    return fanned.withColumn("change", F.round(F.col("motion") - F.lag("motion").over(order), 6))


@query(
    f"""
WITH {INTERVALS_SQL}, ends AS (
  SELECT entity, "interval", start, "end" FROM intervals
), ranked AS (
  SELECT s.entity, s.idx, e."interval", greatest(0, greatest(e.start - s.t, s.t - e."end")) AS apart,
    row_number() OVER (PARTITION BY s.entity, s.idx ORDER BY greatest(0, greatest(e.start - s.t, s.t - e."end")), e."interval") AS place
  FROM samples s JOIN ends e ON e.entity = s.entity WHERE s.motion >= {HIGH}
)
SELECT entity, idx, "interval", round(apart, 4) AS apart, place::INT AS place FROM ranked WHERE place <= 3 AND apart <= {2 * DAY}
"""
)
def nearest_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three intervals nearest to each loud sample, at most two days away."""
    loud = samples(spark, sf_dir).where(F.col("motion") >= HIGH).select("entity", "idx", "t")
    spans = _interval_frame(spark, sf_dir).select("entity", "interval", "start", "end")
    near = asof.band_join(loud, spans, ["entity"], F.col("start") - 2 * DAY, F.col("end") + 2 * DAY, F.col("t"), 4 * DAY)
    away = F.greatest(F.lit(0.0), F.greatest(F.col("start") - F.col("t"), F.col("t") - F.col("end")))
    order = W.partitionBy("entity", "idx").orderBy("apart", "interval")
    ranked = near.select("l.entity", "idx", "interval", away.alias("apart")).withColumn("place", F.row_number().over(order))
    return ranked.where((F.col("place") <= 3) & (F.col("apart") <= 2 * DAY)).withColumn("apart", F.round("apart", 4))


_NATURAL_SQL = r"""
WITH parts AS (
  SELECT page_id, url, list_concat(CASE WHEN regexp_matches(url, '^[0-9]') THEN [''] ELSE [] END, regexp_extract_all(lower(url), '[0-9]+|[^0-9]+')) AS parts FROM pages
), keyed AS (
  SELECT page_id, url, CASE WHEN url IS NOT NULL THEN list_transform(parts, lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(length(ltrim(x, '0'))::VARCHAR, 10, '0') || ltrim(x, '0') ELSE x END) END AS key FROM parts
)
SELECT page_id, url, row_number() OVER (ORDER BY key NULLS FIRST, page_id NULLS FIRST) AS place FROM keyed
"""


@query(_NATURAL_SQL)
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All addresses with their places, numbers in them ordered by value."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", text.natural_key(F.col("url")).alias("key"))
    placed = ordering.in_order(pages, [F.col("key"), F.col("page_id")])
    return placed.withColumn("place", F.col("place") + 1).drop("key")


@query(_NATURAL_SQL)
def order_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as ``natural_order``, by the name of the build plan."""
    return natural_order(spark, sf_dir)


QUADS_SQL = """
quads AS (
  SELECT l_orderkey // 4 AS spread, ['left', 'right'][(l_linenumber % 2 + 1)::INT] AS side, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS id,
    0.1::DOUBLE + l_discount / 4 AS x0, 0.1::DOUBLE + l_tax / 4 AS y0, 0.9::DOUBLE - l_tax / 8 AS x1, 0.12::DOUBLE + l_discount / 8 AS y1,
    0.88::DOUBLE - l_discount / 8 AS x2, 0.9::DOUBLE - l_tax / 4 AS y2, 0.12::DOUBLE + l_tax / 8 AS x3, 0.88::DOUBLE - l_discount / 4 AS y3,
    (l_quantity + 10) / 64 AS confidence
  FROM lineitem
)"""


def _quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t = F.col("l_discount"), F.col("l_tax")
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    # Numbered inside an order, but dealt by spread: what groups by spread needs no further exchange.
    within = F.row_number().over(W.partitionBy("spread", "l_orderkey").orderBy(*order))
    return dealt(table(spark, sf_dir, "lineitem").withColumn("spread", F.floor(F.col("l_orderkey") / 4).cast("long")), "spread").select(
        "spread",
        F.when(F.col("l_linenumber") % 2 == 0, "left").otherwise("right").alias("side"),
        (F.col("l_orderkey") * 1000 + within).alias("id"),
        (0.1 + d / 4).alias("x0"), (0.1 + t / 4).alias("y0"), (0.9 - t / 8).alias("x1"), (0.12 + d / 8).alias("y1"),
        (0.88 - d / 8).alias("x2"), (0.9 - t / 4).alias("y2"), (0.12 + t / 8).alias("x3"), (0.88 - d / 4).alias("y3"),
        ((F.col("l_quantity") + 10) / 64).alias("confidence"),
    )


_ORDERED_ID = "row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS id"
QUADS_SQL = QUADS_SQL.replace(
    _ORDERED_ID,
    "l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS id",
)

_DEVIATION = 0.012
_DIST = "(" + " + ".join(f"sqrt(pow(a.x{i} - b.x{i}, 2) + pow(a.y{i} - b.y{i}, 2))" for i in range(4)) + ") / 4"
CLUSTER_SQL = f"""{QUADS_SQL}, near AS (
  SELECT a.spread, a.side, a.id AS center, count(*) AS n, round(sum(b.confidence), 9) AS weight, list(b.id) AS members, bool_or(b.id % 1000 = 2) AS with_anchor
  FROM quads a JOIN quads b ON a.spread = b.spread AND a.side = b.side WHERE round({_DIST}, 9) <= {_DEVIATION}::DOUBLE GROUP BY a.spread, a.side, a.id
), best AS (
  SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY spread, side ORDER BY n DESC, with_anchor DESC, weight DESC, center) = 1
), cluster AS (
  SELECT q.* FROM quads q JOIN (SELECT spread, side, unnest(members) AS id FROM best) m ON q.spread = m.spread AND q.side = m.side AND q.id = m.id
)"""
_MEDIANS = ", ".join(f"median({c}) OVER (PARTITION BY spread, side) AS m_{c}" for c in consensus.CORNERS)
_RESIDUAL = "(" + " + ".join(f"sqrt(pow(x{i} - m_x{i}, 2) + pow(y{i} - m_y{i}, 2))" for i in range(4)) + ") / 4"
TRIM_SQL = f"""{CLUSTER_SQL}, centered AS (
  SELECT *, {_MEDIANS}, count(*) OVER (PARTITION BY spread, side) AS n FROM cluster
), residuals AS (
  SELECT *, round({_RESIDUAL}, 9) AS residual FROM centered
), middles AS (
  SELECT *, median(residual) OVER (PARTITION BY spread, side) AS med FROM residuals
), mads AS (
  SELECT *, median(abs(residual - med)) OVER (PARTITION BY spread, side) AS mad FROM middles
), judged AS (
  SELECT *, residual <= least({_DEVIATION}::DOUBLE, greatest(0.004::DOUBLE, med + 3 * 1.4826::DOUBLE * mad)) + 1e-9 AS inside FROM mads
), trimmed AS (
  SELECT * FROM (SELECT *, count(*) FILTER (inside) OVER (PARTITION BY spread, side) AS n_in FROM judged) WHERE n < 3 OR n_in < 2 OR inside
)"""

_SIDE = ["spread", "side"]


def _cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    quads = _quads(spark, sf_dir).withColumn("anchor", F.col("id") % 1000 == 2)
    return consensus.largest_cluster(quads, _SIDE, _DEVIATION, "anchor").drop("anchor")


@query(f"WITH {CLUSTER_SQL} SELECT spread, side, id FROM cluster")
def consensus_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cluster(spark, sf_dir).select("spread", "side", "id")


@query(f"WITH {TRIM_SQL} SELECT spread, side, id FROM trimmed")
def mad_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    cluster = _cluster(spark, sf_dir)
    return consensus.trimmed(cluster, _SIDE, _DEVIATION).select("spread", "side", "id")


_W = "greatest(confidence, 1e-6)"


@query(
    f"WITH {QUADS_SQL} SELECT spread, side, {', '.join(f'round(sum({_W} * {c}) / sum({_W}), 9) AS {c}' for c in consensus.CORNERS)}, "
    f"round(sum({_W} * confidence) / sum({_W}), 9) AS confidence, count(*) AS n_members FROM quads GROUP BY spread, side"
)
def weighted_quad_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.weighted_quad(_quads(spark, sf_dir), _SIDE)


_EDGE = lambda i: f"sqrt(pow(x{(i + 1) % 4} - x{i % 4}, 2) + pow(y{(i + 1) % 4} - y{i % 4}, 2))"
_TURN = lambda i: (
    f"(x{(i + 1) % 4} - x{i}) * (y{(i + 2) % 4} - y{(i + 1) % 4}) - (y{(i + 1) % 4} - y{i}) * (x{(i + 2) % 4} - x{(i + 1) % 4})"
)
_COS = lambda i: (
    f"abs((x{(i + 1) % 4} - x{i}) * (x{(i + 2) % 4} - x{(i + 1) % 4}) + (y{(i + 1) % 4} - y{i}) * (y{(i + 2) % 4} - y{(i + 1) % 4})) / ({_EDGE(i)} * {_EDGE(i + 1)} + 1e-8)"
)


@query(
    f"""
WITH {QUADS_SQL}, folded AS (
  SELECT * REPLACE (CASE WHEN id % 9 = 4 THEN x0 - 0.05::DOUBLE ELSE x2 END AS x2, CASE WHEN id % 11 = 3 THEN y3 + 0.5::DOUBLE ELSE y3 END AS y3) FROM quads
)
SELECT id, round(({' + '.join(_COS(i) for i in range(4))}) / 4, 6) AS skew,
  round((abs({_EDGE(0)} - {_EDGE(2)}) / (greatest({_EDGE(0)}, {_EDGE(2)}) + 1e-8) + abs({_EDGE(1)} - {_EDGE(3)}) / (greatest({_EDGE(1)}, {_EDGE(3)}) + 1e-8)) / 2, 6) AS imbalance,
  round(abs({' + '.join(f'(x{i} * y{(i + 1) % 4} - x{(i + 1) % 4} * y{i})' for i in range(4))}) / 2, 6) AS area,
  round(1 - y3, 6) AS turned_x0, round(x3, 6) AS turned_y0
FROM folded WHERE least({", ".join(consensus.CORNERS)}) >= 0 AND greatest({", ".join(consensus.CORNERS)}) <= 1 AND {" AND ".join(f"{_TURN(i)} > 0" for i in range(4))}
  AND abs({' + '.join(f'(x{i} * y{(i + 1) % 4} - x{(i + 1) % 4} * y{i})' for i in range(4))}) / 2 >= 0.005::DOUBLE
"""
)
def quad_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shape of the valid quads; some are folded over or reach beyond the unit square, and are left out."""
    turned = geometry.rotated(90)
    folded = _quads(spark, sf_dir).withColumns(
        {"x2": F.when(F.col("id") % 9 == 4, F.col("x0") - 0.05).otherwise(F.col("x2")), "y3": F.when(F.col("id") % 11 == 3, F.col("y3") + 0.5).otherwise(F.col("y3"))}
    )
    return folded.where(geometry.is_valid()).select(
        "id",
        F.round(geometry.skew(), 6).alias("skew"),
        F.round(geometry.imbalance(), 6).alias("imbalance"),
        F.round(geometry.area(), 6).alias("area"),
        F.round(turned["x0"], 6).alias("turned_x0"),
        F.round(turned["y0"], 6).alias("turned_y0"),
    )


@query(
    f"""
WITH {CANDIDATES_SQL}
SELECT spread, cand, unnest(list_filter([CASE WHEN NOT coalesce(hand BETWEEN 0 AND 1, false) THEN 'hand_measured' END,
  CASE WHEN NOT coalesce(glare <= 0.015::DOUBLE, false) THEN 'glare_limit' END, CASE WHEN NOT coalesce(motion <= 0.02::DOUBLE, false) THEN 'motion_limit' END],
  lambda x: x IS NOT NULL)) AS rule FROM candidates
"""
)
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"hand_measured": F.col("hand").between(0, 1), "glare_limit": F.col("glare") <= 0.015, "motion_limit": F.col("motion") <= 0.02}
    return review.constraint_violations(candidates(spark, sf_dir), rules, ["spread", "cand"])


@query(
    """
WITH RECURSIVE edits AS (
  SELECT conv_id AS entity, turn, CASE role WHEN 'user' THEN 'toggle' WHEN 'assistant' THEN CASE WHEN turn % 4 = 1 THEN 'undo' ELSE 'redo' END ELSE 'toggle' END AS action,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS rn FROM conversations
), fold(entity, rn, enabled, undo, redo) AS (
  SELECT DISTINCT entity, 0::BIGINT, true, 0, 0 FROM edits
  UNION ALL
  SELECT f.entity, e.rn,
    CASE WHEN action = 'toggle' OR (action = 'undo' AND undo > 0) OR (action = 'redo' AND redo > 0) THEN NOT enabled ELSE enabled END,
    CASE WHEN action = 'toggle' THEN least(undo + 1, 30) WHEN action = 'undo' AND undo > 0 THEN undo - 1 WHEN action = 'redo' AND redo > 0 THEN undo + 1 ELSE undo END,
    CASE WHEN action = 'toggle' THEN 0 WHEN action = 'undo' AND undo > 0 THEN redo + 1 WHEN action = 'redo' AND redo > 0 THEN redo - 1 ELSE redo END
  FROM fold f JOIN edits e ON e.entity = f.entity AND e.rn = f.rn + 1
)
SELECT entity, max(rn)::INT AS n_edits, arg_max(enabled, rn) AS enabled, arg_max(undo, rn) AS undo, arg_max(redo, rn) AS redo FROM fold GROUP BY entity
"""
)
def edit_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("role") != "assistant", "toggle").when(F.col("turn") % 4 == 1, "undo").otherwise("redo")
    edits = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("entity"), "turn", action.alias("action"))
    return folds.replay_edits(edits)


@query(
    """
WITH mean AS (
  SELECT o_custkey AS entity, (o_orderkey % 4 * 90)::INT AS rotation, round(avg(o_totalprice / 500000), 4) AS score FROM orders GROUP BY ALL
), near AS (
  SELECT *, max(score) OVER (PARTITION BY entity) AS best FROM mean
), picked AS (
  SELECT * FROM near WHERE best - score <= 0.015::DOUBLE + 1e-12
  QUALIFY row_number() OVER (PARTITION BY entity ORDER BY list_position([0, 90, 270, 180], rotation)) = 1
), margins AS (
  SELECT p.*, greatest(0, score - greatest(
      coalesce((SELECT score FROM mean m WHERE m.entity = p.entity AND m.rotation = (p.rotation + 90) % 360), 0),
      coalesce((SELECT score FROM mean m WHERE m.entity = p.entity AND m.rotation = (p.rotation + 270) % 360), 0))) AS axis,
    greatest(0, score - coalesce((SELECT score FROM mean m WHERE m.entity = p.entity AND m.rotation = (p.rotation + 180) % 360), 0)) AS direction
  FROM picked p
), raw AS (
  SELECT *, least(0.95::DOUBLE, greatest(0.35::DOUBLE, 0.35::DOUBLE + 0.35::DOUBLE * score + 0.8::DOUBLE * axis)) AS v0 FROM margins
), capped AS (
  SELECT *, CASE WHEN direction < 0.025::DOUBLE THEN least(v0, 0.62::DOUBLE) ELSE v0 END AS v1 FROM raw
)
SELECT entity, rotation, score, round(CASE WHEN axis < 0.04::DOUBLE THEN least(v1, 0.55::DOUBLE) ELSE v1 END, 6) AS confidence FROM capped
"""
)
def rotation_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("entity"), (F.col("o_orderkey") % 4 * 90).cast("int").alias("rotation"), (F.col("o_totalprice") / 500000).alias("score")
    )
    return ranking.rotation_pick(scores, 6)


@query(
    f"""
WITH {SAMPLES_SQL}, spans AS (SELECT entity, idx, t - min(t) OVER (PARTITION BY entity) AS since, max(t) OVER (PARTITION BY entity) - min(t) OVER (PARTITION BY entity) AS duration FROM samples)
SELECT entity, idx, round(CASE WHEN duration <= 0 THEN 0 ELSE least(100, greatest(0, since / duration * 100)) END, 6) AS percent,
  (floor(since + 0.5::DOUBLE)::INT // 60)::VARCHAR || ':' || lpad((floor(since + 0.5::DOUBLE)::INT % 60)::VARCHAR, 2, '0') AS clock
FROM spans
"""
)
def timeline_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = W.partitionBy("entity")
    spans = samples(spark, sf_dir).withColumns({"at": F.col("t") - F.min("t").over(g), "duration": F.max("t").over(g) - F.min("t").over(g)})
    return spans.select("entity", "idx", F.round(text.timeline_percent(F.col("at"), F.col("duration")), 6).alias("percent"), text.clock(F.col("at")).alias("clock"))


@query(f"WITH {CHOSEN_SQL} SELECT spread, cand AS id, round(sharpness, 6) AS sharpness, round(motion, 6) AS motion, hand IS NULL AS hand_disabled, score, selection_score, array_to_string(suspect, ';') AS suspect FROM chosen")
def score_row_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen candidates as nested records, flattened to the wide rows of a score table."""
    nested = ranking.choose(_relative(spark, sf_dir), ["spread"]).select(
        "spread", F.struct(F.col("cand").alias("id"), F.struct("sharpness", "motion", "hand", "score", "selection_score").alias("metrics"), "suspect").alias("record")
    )
    m = F.col("record.metrics")
    return nested.select(
        "spread",
        "record.id",
        F.round(m["sharpness"], 6).alias("sharpness"),
        F.round(m["motion"], 6).alias("motion"),
        m["hand"].isNull().alias("hand_disabled"),
        m["score"].alias("score"),
        m["selection_score"].alias("selection_score"),
        F.array_join("record.suspect", ";").alias("suspect"),
    )


@query(
    """
SELECT event_type AS name, round(sum(value), 4) AS seconds, count(*) AS calls, round(1000 * sum(value) / count(*), 3) AS avg_ms FROM events GROUP BY event_type
"""
)
def timings_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    timings = table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("value").alias("seconds"), F.lit(1).alias("calls"))
    return review.timings_rollup(timings).withColumn("seconds", F.round("seconds", 4))


@query(
    f"""
WITH {BINNED_SQL}, marked AS (
  SELECT *, idx = max(idx) OVER (PARTITION BY entity, episode) AS latest FROM best_of_bin
), binned2 AS (
  SELECT *, ntile(2) OVER (PARTITION BY entity, episode, latest ORDER BY idx) AS b FROM marked
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY entity, episode, latest, b ORDER BY score DESC, idx DESC) AS place FROM binned2
)
SELECT entity, episode, idx, score, latest OR place = 1 AS is_primary FROM placed
"""
)
def primary_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = segments.primary_of_representatives(binned_candidates(spark, sf_dir), ["entity", "episode"], 3)
    return marked.select("entity", "episode", "idx", "score", "is_primary")


@query(
    f"""
WITH {SAMPLES_SQL}, early AS (
  SELECT *, t - min(t) OVER (PARTITION BY entity) AS elapsed FROM samples
)
SELECT entity, idx, round(0.55::DOUBLE * least(1, greatest(0, 1 - motion / {HIGH})) + 0.30::DOUBLE * least(1, greatest(0, ln(1 + greatest(sharpness, 0)) / 8))
  + 0.15::DOUBLE * least(1, greatest(0, 1 - elapsed / {10 * DAY})), 9) AS score,
  row_number() OVER (PARTITION BY entity ORDER BY round(0.55::DOUBLE * least(1, greatest(0, 1 - motion / {HIGH})) + 0.30::DOUBLE * least(1, greatest(0, ln(1 + greatest(sharpness, 0)) / 8))
  + 0.15::DOUBLE * least(1, greatest(0, 1 - elapsed / {10 * DAY})), 9) DESC, idx DESC)::INT AS place
FROM early WHERE elapsed <= {10 * DAY} AND motion <= {1.5 * HIGH} QUALIFY place <= 15
"""
)
def preliminary_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 best samples of each entity's first ten days; of equals the later."""
    first = F.min("t").over(W.partitionBy("entity"))
    early = samples(spark, sf_dir).withColumn("first", first).where((F.col("t") - F.col("first") <= 10 * DAY) & (F.col("motion") <= 1.5 * HIGH))
    c = CONFIG.__class__(motion_threshold=0.5, turn_threshold=1.0)
    unit = early.withColumn("motion", F.col("motion") / HIGH)
    scored = unit.withColumn("score", F.round(ranking.preliminary_score(c, F.col("first"), 10 * DAY), 9))
    place = F.row_number().over(W.partitionBy("entity").orderBy(F.col("score").desc(), F.col("idx").desc()))
    return scored.withColumn("place", place).where("place <= 15").select("entity", "idx", "score", "place")


@query(
    f"""
WITH {REVIEW_PAGES_SQL}, wanted AS (
  SELECT c.c_custkey AS spread, s.side, c.c_acctbal AS hand FROM customer c, (VALUES ('left'), ('right')) s(side)
)
SELECT p.page, p.spread, p.side, w.hand IS NOT NULL AS has_candidate, p.enabled FROM review_pages p LEFT JOIN wanted w ON p.spread = w.spread AND p.side = w.side
"""
)
def page_candidate_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the candidate of their spread and side, if there is one."""
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("spread"), F.explode(F.array(F.lit("left"), F.lit("right"))).alias("side"), F.lit(True).alias("found"))
    joined = review_pages(spark, sf_dir).join(wanted, ["spread", "side"], "left")
    return joined.select("page", "spread", "side", F.coalesce("found", F.lit(False)).alias("has_candidate"), "enabled")


@query(
    """
SELECT conv_id AS source, min(turn)::BIGINT AS first_turn, count(*) AS n_rows,
  (sum(count(*)) OVER (ORDER BY conv_id ROWS UNBOUNDED PRECEDING) - count(*))::BIGINT AS offset_before
FROM conversations GROUP BY conv_id
"""
)
def concatenated_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources laid end to end: each one's offset is the sum of all before it. They are placed and summed up by ranges of sources."""
    counted = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("source")).agg(F.min("turn").cast("long").alias("first_turn"), F.count(F.lit(1)).alias("n_rows"))
    return ordering.in_order(counted, [F.col("source")], sums={"n_rows": "offset_before"}).select("source", "first_turn", "n_rows", "offset_before")


_R, _C = "(i // 8)", "(i % 8)"
_MIRROR = lambda k: f"(7 - abs(7 - abs({k})))"
_PIXELS_SQL = f"""pixels AS (
  SELECT vec_id AS id, {GROUP_SQL} AS grp, list_transform(embedding, lambda x: x::DOUBLE * 64 + 128) AS p FROM embeddings
), framed AS (
  SELECT *, lag(p) OVER (PARTITION BY grp ORDER BY id) AS q FROM pixels
)"""
_TILE = lambda t: f"list_var_pop(list_transform(list_filter(range(64), lambda i: least({_R} // 3, 2) * 3 + least({_C} // 3, 2) = {t}), lambda i: lap[i + 1]))"
_SHIFTED = lambda dy, dx: (
    f"list_avg(list_transform(list_filter(range(64), lambda i: {_R} BETWEEN 1 AND 6 AND {_C} BETWEEN 1 AND 6), "
    f"lambda i: abs(q[i + 1] - p[({_R} + {8 - dy}) % 8 * 8 + ({_C} + {8 - dx}) % 8 + 1])))"
)


@query(
    f"""
WITH {_PIXELS_SQL}, responses AS (
  SELECT *, list_transform(range(64), lambda i: p[{_MIRROR(_R + " - 1")} * 8 + {_C} + 1] + p[{_MIRROR(_R + " + 1")} * 8 + {_C} + 1]
    + p[{_R} * 8 + {_MIRROR(_C + " - 1")} + 1] + p[{_R} * 8 + {_MIRROR(_C + " + 1")} + 1] - 4 * p[i + 1]) AS lap FROM framed
), tiled AS (
  SELECT id, grp, list_var_pop(lap) AS sharpness, list_sort([{", ".join(_TILE(t) for t in range(9))}]) AS tiles,
    CASE WHEN q IS NULL THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, least({", ".join(_SHIFTED(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1))}) / 255) END AS motion
  FROM responses
), ranked AS (
  SELECT *, tiles[5] AS tile_median, tiles[1] + (tiles[2] - tiles[1]) * 0.8::DOUBLE AS tile_p10, tiles[1] AS tile_worst FROM tiled
)
SELECT id, grp, round(sharpness, 6) AS sharpness, round(motion, 6) AS motion, round(tile_median, 6) AS tile_median, round(tile_p10, 6) AS tile_p10,
  round(tile_worst, 6) AS tile_worst, round((0.5::DOUBLE * ln(1 + tile_median) + 0.3::DOUBLE * ln(1 + tile_p10) + 0.2::DOUBLE * ln(1 + tile_worst)) / 8, 6) AS uniformity
FROM ranked
"""
)
def raster_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpness, tile statistics and change since the raster before; measured by Arrow-batched functions."""
    order = W.partitionBy("grp").orderBy("id")
    rows = rasters(spark, sf_dir).select("id", "grp", F.transform("pixels", lambda x: x.cast("double") * 64 + 128).alias("pixels"))
    rows = rows.withColumn("before", F.lag("pixels").over(order))
    measured = rows.select("id", "grp", kernels.sharpness("pixels").alias("sharpness"), kernels.sharpness_tiles("pixels").alias("tiles"), kernels.motion("before", "pixels").alias("motion"))
    stats = kernels.tile_statistics(F.col("tiles"))
    return measured.select("id", "grp", F.round("sharpness", 6).alias("sharpness"), F.round("motion", 6).alias("motion"), *[F.round(v, 6).alias(k) for k, v in stats.items()])


@query(
    f"""
WITH {_PIXELS_SQL}, moments AS (
  SELECT id, grp, list_avg(q) AS mq, list_avg(p) AS mp, list_var_pop(q) AS vq, list_var_pop(p) AS vp,
    list_avg(list_transform(range(64), lambda i: (q[i + 1] - list_avg(q)) * (p[i + 1] - list_avg(p)))) AS cov
  FROM framed WHERE q IS NOT NULL
)
SELECT id, grp, round((2 * mq * mp + 6.5025::DOUBLE) * (2 * cov + 58.5225::DOUBLE) / ((mq * mq + mp * mp + 6.5025::DOUBLE) * (vq + vp + 58.5225::DOUBLE)), 6) AS ssim FROM moments
"""
)
def raster_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural similarity of rasters that follow each other in a group."""
    order = W.partitionBy("grp").orderBy("id")
    rows = rasters(spark, sf_dir).select("id", "grp", F.transform("pixels", lambda x: x.cast("double") * 64 + 128).alias("pixels"))
    pairs = rows.withColumn("before", F.lag("pixels").over(order)).where("before is not null")
    return pairs.select("id", "grp", F.round(kernels.ssim("before", "pixels"), 6).alias("ssim"))
