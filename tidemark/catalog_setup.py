"""Named queries of sources, layouts, hypotheses and choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalog import DAY, HIGH, INTERVALS_SQL, _interval_frame, query
from .catalog_more import QUADS_SQL, _quads
from .functions import geometry, text
from .operators import asof, merges, verdicts
from .operators.consensus import CORNERS, weighted_quad
from .sources.adapters import CANDIDATES_SQL, REVIEW_PAGES_SQL, candidates, review_pages, samples, table

_W = "greatest(confidence, 1e-6)"
_MEAN_SQL = f"""{QUADS_SQL}, means AS (
  SELECT spread, side, {', '.join(f'round(sum({_W} * {c}) / sum({_W}), 9) AS {c}' for c in CORNERS)}, round(sum({_W} * confidence) / sum({_W}), 9) AS confidence FROM quads GROUP BY spread, side
)"""

#: Not a short decimal, so that no corner lies on a rounding tie.
_STEP = 1 / 33
#: Edge moves of a hypothesis: left, right, top, bottom.
_MOVES = [(0.0, 0.0, 0.0, 0.0), *[tuple(sign * _STEP if k == edge else 0.0 for k in range(4)) for edge in range(4) for sign in (-1, 1)]]
_AT = [("-l", "-t"), ("1 + r", "-t"), ("1 + r", "1 + b"), ("-l", "1 + b")]


def _moved_sql(axis: str, i: int) -> str:
    u, v = (f"({e})" for e in _AT[i])
    q = [f"{axis}{k}" for k in range(4)]
    return f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {q[0]} * (1 - {u}) * (1 - {v}) + {q[1]} * {u} * (1 - {v}) + {q[2]} * {u} * {v} + {q[3]} * (1 - {u}) * {v}))"


_AREA_SQL = "abs(" + " + ".join(f"(x{i} * y{(i + 1) % 4} - x{(i + 1) % 4} * y{i})" for i in range(4)) + ") / 2"


@query(
    f"""
WITH {_MEAN_SQL}, moves(variant, l, r, t, b) AS (
  VALUES {', '.join(f'({k}, {", ".join(f"{v}::DOUBLE" for v in m)})' for k, m in enumerate(_MOVES))}
), moved AS (
  SELECT spread, side, variant, {', '.join(f'{_moved_sql(a, i)} AS {a}{i}' for i in range(4) for a in 'xy')} FROM means, moves
)
SELECT spread, side, variant::INT AS variant, {', '.join(f'round({c}, 9) AS {c}' for c in CORNERS)} FROM moved WHERE {_AREA_SQL} >= 0.02::DOUBLE
"""
)
def edge_hypotheses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mean quad as it is and with one edge moved in or out; those that get too small are left out."""
    moves = F.array(*[F.struct(F.lit(k).alias("variant"), *[F.lit(v).alias(n) for n, v in zip("lrtb", m, strict=True)]) for k, m in enumerate(_MOVES)])
    rows = weighted_quad(_quads(spark, sf_dir), ["spread", "side"]).select("spread", "side", *CORNERS, F.inline(moves))
    moved = rows.select("spread", "side", "variant", *[v.alias(k) for k, v in geometry.moved_edges(*map(F.col, "lrtb")).items()])
    return moved.where(geometry.area() >= 0.02).select("spread", "side", "variant", *[F.round(c, 9).alias(c) for c in CORNERS])


_OUTER = [("left", 0), ("right", 1), ("right", 2), ("left", 3)]


@query(
    f"""
WITH {_MEAN_SQL}
SELECT l.spread, {', '.join(f'{s[0]}.{a}{i} AS {a}{i}' for s, i in _OUTER for a in 'xy')}, least(l.confidence, r.confidence) AS confidence
FROM means l JOIN means r ON l.spread = r.spread AND l.side = 'left' AND r.side = 'right' WHERE least(l.confidence, r.confidence) >= 0.55::DOUBLE
"""
)
def spread_from_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outer corners of both pages of a spread, where both were detected."""
    means = weighted_quad(_quads(spark, sf_dir), ["spread", "side"])
    page = F.struct(*CORNERS, "confidence")
    both = means.groupBy("spread").agg(*[F.max(F.when(F.col("side") == s, page)).alias(s) for s in ("left", "right")])
    sure = F.when(F.col("left").isNotNull() & F.col("right").isNotNull(), F.least("left.confidence", "right.confidence"))
    found = both.withColumn("confidence", sure).where("confidence >= 0.55")
    return found.select("spread", *[F.col(f"{s}.{a}{i}").alias(f"{a}{i}") for s, i in _OUTER for a in "xy"], "confidence")


_MATRIX = ["0.98", "x0 / 20", "y0 / 50", "y1 / 20", "1.0", "x3 / 10 - 0.02", "0.02", "0.01", "1.0"]
_D = [f"({e})::DOUBLE" for e in _MATRIX]
_Z = lambda i: f"({_D[6]} * x{i} + {_D[7]} * y{i} + {_D[8]})"
_PX = lambda i: f"(({_D[0]} * x{i} + {_D[1]} * y{i} + {_D[2]}) / {_Z(i)})"
_PY = lambda i: f"(({_D[3]} * x{i} + {_D[4]} * y{i} + {_D[5]}) / {_Z(i)})"
_NEAR = " AND ".join(f"{p(i)} BETWEEN -0.05::DOUBLE AND 1.05::DOUBLE" for i in range(4) for p in (_PX, _PY))
_LEN = lambda i: f"sqrt(pow((x{(i + 1) % 4} - x{i}) * 1919, 2) + pow((y{(i + 1) % 4} - y{i}) * 1079, 2))"


@query(
    f"""
WITH {_MEAN_SQL}
SELECT spread, side, {', '.join(f'round(CASE WHEN {_NEAR} THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, {p(i)})) END, 6) AS {a}{i}' for i in range(4) for a, p in (('x', _PX), ('y', _PY)))},
  (round_even(greatest({_LEN(0)}, {_LEN(2)}), 0) + 1)::INT AS width, (round_even(greatest({_LEN(1)}, {_LEN(3)}), 0) + 1)::INT AS height
FROM means
"""
)
def aligned_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quads carried over to another frame, null where they leave it, and the size in pixels of what they show."""
    means = weighted_quad(_quads(spark, sf_dir), ["spread", "side"])
    moved = geometry.projected_quad([F.expr(f"cast({e} as double)") for e in _MATRIX])
    width, height = geometry.natural_size(1920, 1080)
    return means.select("spread", "side", *[F.round(v, 6).alias(k) for k, v in moved.items()], width.cast("int").alias("width"), height.cast("int").alias("height"))


@query(
    f"""
WITH {CANDIDATES_SQL}, measured AS (
  SELECT spread, cand, (spread + cand) % 9 AS hash_distance, 1 - motion / 2 AS ssim, least(1 - flatness / 30, 1 - clipping / 8) AS half, sharpness / 40 AS contrast,
    CASE WHEN cand % 3 <> 0 THEN exposure > 0.3::DOUBLE END AS al_dup, CASE WHEN cand % 3 <> 0 THEN exposure > 0.2::DOUBLE END AS al_sus FROM candidates
), judged AS (
  SELECT *, contrast >= 8 AND ((hash_distance <= 4 AND least(ssim, half) >= 0.985::DOUBLE) OR coalesce(al_dup, false)) AS duplicate FROM measured
)
SELECT spread, cand, duplicate, duplicate OR ssim >= 0.94::DOUBLE OR (contrast >= 8 AND coalesce(al_sus, false)) AS suspect FROM judged
"""
)
def content_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate and suspect of image pairs; some have no alignment."""
    c = F.col
    aligned = F.when(c("cand") % 3 != 0, F.struct((c("exposure") > 0.3).alias("duplicate"), (c("exposure") > 0.2).alias("suspect")))
    rows = candidates(spark, sf_dir).withColumns(
        {
            "hash_distance": (c("spread") + c("cand")) % 9,
            "ssim": 1 - c("motion") / 2,
            "half_ssim": F.array(1 - c("flatness") / 30, 1 - c("clipping") / 8),
            "contrast": c("sharpness") / 40,
            "alignment": aligned,
        }
    )
    verdict = verdicts.same_content(4, 0.985, 0.94)
    return rows.select("spread", "cand", *[v.alias(k) for k, v in verdict.items()])


@query(
    """
WITH videos AS (
  SELECT o_orderkey AS source, o_custkey AS owner, (o_orderkey % 9000 + 1)::INT AS width, (o_custkey * 37 % 9000 + 1)::INT AS height,
    CASE WHEN o_orderkey % 17 = 0 THEN 'NaN'::DOUBLE WHEN o_orderkey % 19 = 0 THEN 0 ELSE o_totalprice / 30 END AS duration FROM orders
), judged AS (
  SELECT *, NOT isnan(duration) AND duration > 0 AS usable, sum(CASE WHEN NOT isnan(duration) AND duration > 0 THEN duration END) OVER (PARTITION BY owner) AS total FROM videos
)
SELECT source, array_to_string(list_filter([CASE WHEN NOT usable THEN 'duration_invalid' END, CASE WHEN usable AND duration > 14400 THEN 'duration_limit' END,
  CASE WHEN greatest(width, height) > 8192 THEN 'dimension_limit' END, CASE WHEN width::BIGINT * height > 40000000 THEN 'pixel_limit' END,
  CASE WHEN total > 14400 THEN 'total_duration_limit' END], lambda x: x IS NOT NULL), ',') AS broken FROM judged
"""
)
def source_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits that sources break by size, length or the length of all of an owner's."""
    key = F.col("o_orderkey")
    duration = F.when(key % 17 == 0, float("nan")).when(key % 19 == 0, 0.0).otherwise(F.col("o_totalprice") / 30)
    videos = table(spark, sf_dir, "orders").select(
        key.alias("source"), F.col("o_custkey").alias("owner"), (key % 9000 + 1).cast("int").alias("width"), (F.col("o_custkey") * 37 % 9000 + 1).cast("int").alias("height"), duration.alias("duration")
    )
    return videos.select("source", F.array_join(verdicts.input_limits(["owner"], 14_400.0, 8192, 40_000_000), ",").alias("broken"))


@query(
    f"""
WITH {CANDIDATES_SQL}
SELECT spread, count(*) - 1 AS n_attempted, count(*) FILTER (cand > 0 AND distortion <= 0.2::DOUBLE) AS n_aligned, max(distortion) AS max_shift, min_by(cand, (-distortion, cand)) AS most_shifted FROM candidates GROUP BY spread
"""
)
def alignment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a spread's candidates were aligned with the first, and the one shifted most."""
    aligned = (F.col("cand") > 0) & (F.col("distortion") <= 0.2)
    return verdicts.alignment_summary(candidates(spark, sf_dir), ["spread"], aligned, F.col("distortion"), "cand")


@query(
    f"""
WITH {CANDIDATES_SQL}, sides AS (
  SELECT spread // 2 AS grp, cand AS side, spread % 2 = 1 AS newer, CASE WHEN cand = 5 THEN 'NaN'::DOUBLE ELSE hand END AS hand, 1 - distortion AS focus,
    exposure > 0.45::DOUBLE AS hard, glare > 0.01::DOUBLE AS repair FROM candidates
), per_key AS (
  SELECT grp, side, count(*) FILTER (NOT newer) AS old_seen, count(*) FILTER (newer) AS new_seen, max(hand) FILTER (NOT newer AND isfinite(hand)) AS oh, max(hand) FILTER (newer AND isfinite(hand)) AS nh,
    max(focus) FILTER (NOT newer) AS old_focus, max(focus) FILTER (newer) AS new_focus, coalesce(bool_or(hard) FILTER (NOT newer), false) AS old_hard, coalesce(bool_or(hard) FILTER (newer), false) AS new_hard,
    coalesce(bool_or(repair) FILTER (NOT newer), false)::INT AS old_repair, coalesce(bool_or(repair) FILTER (newer), false)::INT AS new_repair FROM sides GROUP BY grp, side
), per_group AS (
  SELECT grp, count(*) AS n_keys, bool_and(old_seen > 0 AND new_seen > 0) AS same_keys,
    bool_and(coalesce(old_seen > 0 AND new_seen > 0 AND new_focus >= old_focus * 0.8::DOUBLE AND oh IS NOT NULL AND nh IS NOT NULL AND NOT (new_hard AND NOT old_hard), false)) AS fine,
    avg(oh) AS oh, avg(nh) AS nh, sum(old_repair) AS o_r, sum(new_repair) AS n_r FROM per_key GROUP BY grp
)
SELECT grp, n_keys, same_keys, fine AND n_r <= o_r AND coalesce(nh <= oh - 0.01::DOUBLE OR (n_r < o_r AND nh <= oh + 0.005::DOUBLE), false) AS prefer FROM per_group
"""
)
def newer_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the newer of two copies may replace the older one, side by side."""
    c = F.col
    risk = lambda test, code: F.array_compact(F.array(F.when(test, code)))
    rows = candidates(spark, sf_dir).select(
        F.floor(c("spread") / 2).cast("long").alias("grp"),
        c("cand").alias("side"),
        (c("spread") % 2 == 1).alias("newer"),
        F.when(c("cand") == 5, float("nan")).otherwise(c("hand")).alias("hand"),
        (1 - c("distortion")).alias("focus"),
        risk(c("exposure") > 0.45, "underexposed").alias("hard"),
        risk(c("glare") > 0.01, "final_unresolved_finger").alias("repair"),
    )
    return merges.prefer_newer(rows, ["grp"], "side")


@query(
    f"""
WITH {REVIEW_PAGES_SQL}, fresh AS (
  SELECT project, spread, unnest([-2 * spread - 1, -2 * spread - 2]) AS page FROM review_pages WHERE spread % 5 = 0 GROUP BY project, spread
), saved AS (
  SELECT project, page, CASE WHEN page % 2 = 0 THEN 0 ELSE 1 END AS place, page % 4 <> 0 AS shown FROM fresh WHERE spread % 2 = 0
), was AS (
  SELECT project, spread, min(position) AS first_at, bool_or(enabled) AS any_shown FROM review_pages GROUP BY project, spread
), every AS (
  SELECT project, page, spread, enabled, position AS first_at, NULL AS place FROM review_pages WHERE spread % 5 <> 0
  UNION ALL SELECT f.project, f.page, f.spread, coalesce(s.shown, w.any_shown), w.first_at, s.place FROM fresh f JOIN was w ON w.project = f.project AND w.spread = f.spread LEFT JOIN saved s ON s.project = f.project AND s.page = f.page
)
SELECT project, page, row_number() OVER (PARTITION BY project ORDER BY first_at, place NULLS LAST, page) - 1 AS position, spread, enabled FROM every
"""
)
def relaid_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth spread laid out anew, with order and flags of the time it had that layout before."""
    pages = review_pages(spark, sf_dir).select("project", "page", "position", "spread", "enabled")
    two = F.array(-2 * F.col("spread") - 1, -2 * F.col("spread") - 2)
    fresh = pages.where("spread % 5 = 0").select("project", "spread").distinct().select("project", "spread", F.explode(two).alias("page"))
    saved = fresh.where("spread % 2 = 0").select("project", "page", F.when(F.col("page") % 2 == 0, 0).otherwise(1).alias("place"), (F.col("page") % 4 != 0).alias("enabled"))
    return merges.relaid(pages, fresh, saved)


@query(
    f"""
WITH {CANDIDATES_SQL}, events AS (
  SELECT spread, seq, spread * seq % 9 AS cand FROM (SELECT DISTINCT spread FROM candidates), range(1, 4) t(seq)
), judged AS (
  SELECT e.*, EXISTS (SELECT 1 FROM candidates c WHERE c.spread = e.spread AND c.cand = e.cand) AS ok FROM events e
)
SELECT spread, coalesce(max_by(cand, seq) FILTER (ok), 0) AS selected, count(*) FILTER (NOT ok) AS n_rejected FROM judged GROUP BY spread
"""
)
def selected_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spread's candidate after three choices; those that don't exist are rejected."""
    known = candidates(spark, sf_dir).select("spread", "cand")
    events = known.select("spread").distinct().select("spread", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("seq"))
    events = events.withColumn("cand", F.col("spread") * F.col("seq") % 9)
    found = merges.last_valid(events, known, ["spread"], "cand", "seq")
    return found.select("spread", F.coalesce("chosen", F.lit(0)).alias("selected"), "n_rejected")


@query(
    f"""
WITH {INTERVALS_SQL}, added AS (
  SELECT user_id AS entity, max(epoch_us(ts) / 1e6) AS start FROM events GROUP BY user_id
), every AS (
  SELECT entity, "interval"::BIGINT AS id, start, false AS added FROM intervals
  UNION ALL SELECT a.entity, coalesce((SELECT max("interval") FROM intervals i WHERE i.entity = a.entity), -1) + 1, a.start, true FROM added a
)
SELECT entity, id::BIGINT AS id, start, added, row_number() OVER (PARTITION BY entity ORDER BY start, id)::INT AS place FROM every
"""
)
def added_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals and one frame more, in order of time; the new one gets the next free number."""
    old = _interval_frame(spark, sf_dir).select("entity", F.col("interval").cast("long").alias("id"), "start")
    ends = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("entity")).agg((F.unix_micros(F.max("ts").cast("timestamp")) / 1e6).alias("start"))
    both = old.withColumn("added", F.lit(False)).unionByName(ends.select("entity", F.lit(None).cast("long").alias("id"), "start", F.lit(True).alias("added")))
    free = F.coalesce(F.max("id").over(W.partitionBy("entity")) + 1, F.lit(0))
    named = both.withColumn("id", F.coalesce("id", free))
    return named.withColumn("place", F.row_number().over(W.partitionBy("entity").orderBy("start", "id")))


@query(
    f"""
WITH {INTERVALS_SQL}, placed AS (
  SELECT entity, "interval", CASE WHEN "interval" % 3 = 0 THEN start + 1 WHEN "interval" % 3 = 1 THEN (start + "end") / 2 ELSE start END - min(start) OVER w AS time, max("end") OVER w - min(start) OVER w AS duration
  FROM intervals WINDOW w AS (PARTITION BY entity)
)
SELECT entity, "interval", round(CASE WHEN duration > 0 THEN least(100.0::DOUBLE, greatest(0.0::DOUBLE, time / duration * 100)) ELSE 0.0 END, 6) AS percent,
  (floor(time + 0.5::DOUBLE)::BIGINT // 60)::VARCHAR || ':' || lpad((floor(time + 0.5::DOUBLE)::BIGINT % 60)::VARCHAR, 2, '0') AS shown FROM placed
"""
)
def spread_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a spread stands on the time line: at its chosen candidate, else its middle, else its start."""
    g, c = W.partitionBy("entity"), F.col
    chosen, end = F.when(c("interval") % 3 == 0, c("start") + 1), F.when(c("interval") % 3 != 2, c("end"))
    rows = _interval_frame(spark, sf_dir).withColumn("time", F.coalesce(chosen, (c("start") + end) / 2, "start") - F.min("start").over(g)).withColumn("duration", F.max("end").over(g) - F.min("start").over(g))
    return rows.select("entity", "interval", F.round(text.timeline_percent(c("time"), c("duration")), 6).alias("percent"), text.clock(c("time")).alias("shown"))


@query(
    f"""
WITH {INTERVALS_SQL}, asks AS (
  SELECT entity, "interval", unnest([0, 1, 2]) AS place, unnest(["end" + 60, start - 60, "end" + 60]) AS asked FROM intervals
)
SELECT entity, "interval", place::INT AS place, asked, (SELECT arg_min(idx, (t, idx)) FROM samples s WHERE s.entity = a.entity AND s.t >= asked) AS idx FROM asks a
"""
)
def frame_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sample at or after times around each interval; some are asked for twice, and some lie behind the last sample."""
    c = F.col
    asks = _interval_frame(spark, sf_dir).select("entity", "interval", F.posexplode(F.array(c("end") + 60, c("start") - 60, c("end") + 60)).alias("place", "asked"))
    frames = samples(spark, sf_dir).select("entity", "idx", "t")
    return asof.first_at_or_after(asks, frames, ["entity"], "asked", "t", "idx", "found").select("entity", "interval", "place", "asked", c("found.idx").alias("idx"))


@query(
    f"""
WITH {INTERVALS_SQL}, spans AS (
  SELECT entity, start, "end" FROM intervals UNION ALL SELECT entity, "end" + {DAY}, "end" + {2 * DAY} FROM intervals WHERE "interval" % 2 = 0
)
SELECT entity, idx, t FROM samples s WHERE motion >= {HIGH}
  AND EXISTS (SELECT 1 FROM spans p WHERE p.entity = s.entity AND s.t >= p.start - 0.15::DOUBLE AND s.t <= p."end" + 0.15::DOUBLE)
"""
)
def anchors_in_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loud samples inside a stable segment or a recovered window, once each."""
    stable = _interval_frame(spark, sf_dir).select("entity", "interval", "start", "end")
    recovered = stable.where("interval % 2 = 0").select("entity", (F.col("end") + DAY).alias("start"), (F.col("end") + 2 * DAY).alias("end"))
    spans = stable.drop("interval").unionByName(recovered)
    loud = samples(spark, sf_dir).where(F.col("motion") >= HIGH)
    return asof.band_join(loud, spans, ["entity"], F.col("start") - 0.15, F.col("end") + 0.15, F.col("t"), 2 * DAY, "left_semi").select("entity", "idx", "t")
