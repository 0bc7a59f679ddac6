"""Named queries over the supplied tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import geometry, kernels, text
from .operators import asof, consensus, folds, ranking, review, segments
from .plans.config import Config
from .sources import adapters
from .sources.adapters import CANDIDATES_SQL, REVIEW_PAGES_SQL, SAMPLES_SQL, candidates, rasters, review_pages, samples, seconds, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Thresholds that suit the supplied events.
LOW, HIGH, REQUIRED, FPS = 60.0, 120.0, 3, 10.0
BINS, MOTION_WEIGHT = 3, 0.03
DAY = 86400.0
CONFIG = Config(suspect_sharpness=100.0, suspect_hand_overlap=0.012, suspect_glare_overlap=0.01, motion_threshold=0.02, turn_threshold=0.025)


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return add


STATES_SQL = f"""{SAMPLES_SQL}, flags AS (
  SELECT *, idx > 0 AND motion <= {LOW} AS is_low, idx = 0 OR (motion > {LOW} AND motion >= {HIGH}) AS is_high FROM samples
), opened AS (
  SELECT *, NOT is_low AND NOT is_high AS is_mid, sum(is_high::INT) OVER (PARTITION BY entity ORDER BY t, idx) AS episode FROM flags
), runs AS (
  SELECT *, sum(is_mid::INT) OVER (PARTITION BY entity, episode ORDER BY t, idx) AS run FROM opened
), sized AS (
  SELECT *, sum(is_low::INT) OVER (PARTITION BY entity, episode, run) AS run_low,
    sum(is_low::INT) OVER (PARTITION BY entity, episode, run ORDER BY t, idx) AS low_so_far FROM runs
), firsts AS (
  SELECT *, min(CASE WHEN run_low >= {REQUIRED} THEN run END) OVER (PARTITION BY entity, episode) AS first_run FROM sized
), states AS (
  SELECT *, coalesce(is_low AND run >= first_run, false) AS member,
    CASE WHEN run > first_run OR (run = first_run AND low_so_far >= {REQUIRED}) THEN 'stable' ELSE 'turning' END AS state FROM firsts
)"""

INTERVALS_SQL = f"""{STATES_SQL}, intervals AS (
  SELECT entity, episode::BIGINT AS episode, min(t) AS start, max(t) AS "end", min(idx) AS first_idx, max(idx) AS last_idx,
    count(*) AS n_samples, row_number() OVER (PARTITION BY entity ORDER BY min(t), min(idx))::INT AS "interval"
  FROM states WHERE member GROUP BY entity, episode
)"""

BINNED_SQL = f"""{STATES_SQL}, binned AS (
  SELECT *, ntile({BINS}) OVER (PARTITION BY entity, episode ORDER BY t, idx)::INT AS bin,
    round(ln(1 + greatest(sharpness, 0)) - {MOTION_WEIGHT} * motion, 9) AS score
  FROM states WHERE member
), best_of_bin AS (
  SELECT entity, episode::BIGINT AS episode, bin, idx, t, motion, sharpness, score FROM binned
  QUALIFY row_number() OVER (PARTITION BY entity, episode, bin ORDER BY score DESC, t, idx) = 1
)"""

TURNS_SQL = f"""{SAMPLES_SQL}, body AS (
  SELECT *, motion >= {HIGH} AS hi FROM samples WHERE idx > 0
), starts AS (
  SELECT *, (hi AND NOT coalesce(lag(hi) OVER (PARTITION BY entity ORDER BY t, idx), false))::INT AS opens FROM body
), ran AS (
  SELECT *, sum(opens) OVER (PARTITION BY entity ORDER BY t, idx) AS run FROM starts
), run_sums AS (
  SELECT entity, run, min(t) FILTER (hi) AS run_start, max(t) FILTER (hi) AS run_end, min(motion) FILTER (NOT hi) AS valley
  FROM ran WHERE run > 0 GROUP BY entity, run
), judged AS (
  SELECT *, CASE WHEN lag(run) OVER w IS NULL OR (run_start - lag(run_end) OVER w >= {max(0.15, 1.5 / FPS)}
    AND coalesce(lag(valley) OVER w, {HIGH}) <= {LOW + 0.55 * (HIGH - LOW)}) THEN 1 ELSE 0 END AS opens
  FROM run_sums WINDOW w AS (PARTITION BY entity ORDER BY run)
), numbered AS (
  SELECT entity, run, sum(opens) OVER (PARTITION BY entity ORDER BY run) AS event FROM judged
), turn_rows AS (
  SELECT r.*, n.event FROM ran r JOIN numbered n ON r.entity = n.entity AND r.run = n.run
), turns AS (
  SELECT entity, event::BIGINT AS event, printf('turn_%04d', event::BIGINT) AS id, min(t) FILTER (hi) AS start, max(t) FILTER (hi) AS "end",
    arg_min(t, (-motion, t)) FILTER (hi) AS peak_time, max(motion) FILTER (hi) AS peak_motion, count(*) FILTER (hi) AS n_samples
  FROM turn_rows GROUP BY entity, event
)"""


def _interval_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.stable_intervals(samples(spark, sf_dir), LOW, HIGH, REQUIRED)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binned_candidates(spark, sf_dir)


@query(f"WITH {STATES_SQL} SELECT entity, idx, t, episode::BIGINT AS episode, member, state FROM states")
def sample_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segments.hysteresis(samples(spark, sf_dir), LOW, HIGH, REQUIRED)
    return found.select("entity", "idx", "t", "episode", "member", "state")


@query(f"WITH {INTERVALS_SQL} SELECT * FROM intervals")
def stable_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _interval_frame(spark, sf_dir)


@query(f"WITH {BINNED_SQL} SELECT * FROM best_of_bin")
def binned_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segments.binned_candidates(samples(spark, sf_dir), LOW, HIGH, REQUIRED, BINS, MOTION_WEIGHT)
    return found.withColumn("score", F.round("score", 9))


@query(f"WITH {TURNS_SQL} SELECT * FROM turns")
def turn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.turn_events(samples(spark, sf_dir), LOW, HIGH, FPS)


@query(
    f"""
WITH {TURNS_SQL}, {STATES_SQL.split(SAMPLES_SQL + ",", 1)[1]}, intervals AS (
  SELECT entity, min(t) AS start, max(t) AS "end", row_number() OVER (PARTITION BY entity ORDER BY min(t), min(idx))::INT AS number
  FROM states WHERE member GROUP BY entity, episode
), pairs AS (
  SELECT entity, event, id AS left_turn, "end" AS window_start, peak_time AS left_peak, lead(id) OVER w AS right_turn,
    lead(start) OVER w AS window_end, lead(peak_time) OVER w AS right_peak
  FROM turns WINDOW w AS (PARTITION BY entity ORDER BY event)
), empty_pairs AS (
  SELECT * FROM pairs p WHERE window_end > window_start AND NOT EXISTS (
    SELECT 1 FROM intervals i WHERE i.entity = p.entity AND (i.start + i."end") / 2 > p.left_peak AND (i.start + i."end") / 2 < p.right_peak)
), quiet AS (
  SELECT p.entity, p.event, p.left_turn, p.right_turn, p.window_start, p.window_end, min(s.motion) AS motion, arg_min(s.t, (s.motion, s.t)) AS time
  FROM empty_pairs p JOIN samples s ON s.entity = p.entity AND s.t > p.window_start AND s.t < p.window_end
  GROUP BY ALL HAVING min(s.motion) <= {LOW + 0.65 * (HIGH - LOW)}
)
SELECT entity, left_turn || '-' || right_turn AS id, time, motion, window_start, window_end, left_turn, right_turn,
  (SELECT arg_max(number, ("end", -number)) FROM intervals i WHERE i.entity = q.entity AND i."end" <= q.time) AS before,
  (SELECT arg_min(number, (start, number)) FROM intervals i WHERE i.entity = q.entity AND i.start >= q.time) AS after
FROM quiet q
"""
)
def missing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.missing_windows(samples(spark, sf_dir), LOW, HIGH, REQUIRED, FPS)


@query(
    f"""
WITH {INTERVALS_SQL}
SELECT s.entity, s.t AS time, s.motion,
  (SELECT arg_max("interval", ("end", -"interval")) FROM intervals i WHERE i.entity = s.entity AND i."end" <= s.t) AS before,
  (SELECT arg_min("interval", (start, "interval")) FROM intervals i WHERE i.entity = s.entity AND i.start >= s.t) AS after
FROM samples s WHERE motion >= {HIGH}
"""
)
def asof_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = samples(spark, sf_dir).where(F.col("motion") >= HIGH).select("entity", F.col("t").alias("time"), "motion")
    return segments.with_neighbours(points, _interval_frame(spark, sf_dir).select("entity", "interval", "start", "end"))


@query(
    f"""
WITH {SAMPLES_SQL}, islands AS (
  SELECT *, motion <= {LOW} AS is_low, sum((motion > {LOW})::INT) OVER (PARTITION BY entity ORDER BY t, idx) AS island FROM samples
), runs AS (
  SELECT entity, island, min(t) AS start, max(t) AS "end", count(*) AS n_samples, round(avg(sharpness), 9) AS mean_sharpness, round(avg(motion), 9) AS mean_motion
  FROM islands WHERE is_low GROUP BY entity, island HAVING count(*) >= 2
)
SELECT entity, start, "end", n_samples, mean_sharpness, mean_motion FROM runs
QUALIFY row_number() OVER (PARTITION BY entity ORDER BY "end" - start DESC, mean_sharpness DESC, mean_motion, start, island) = 1
"""
)
def longest_low_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.longest_low_run(samples(spark, sf_dir), LOW, FPS, 0.18)


@query(
    f"""
WITH {INTERVALS_SQL}, gaps AS (
  SELECT *, start - lag(start) OVER (PARTITION BY entity ORDER BY start, "interval") AS gap FROM intervals
), typical AS (
  SELECT *, coalesce(median(gap) OVER (PARTITION BY entity), 0) AS typical_gap FROM gaps
)
SELECT entity, "interval", start, round(gap, 6) AS gap, round(typical_gap, 6) AS typical_gap,
  coalesce(typical_gap > 0 AND gap > typical_gap * 1.8::DOUBLE, false) AS interval_gap
FROM typical
"""
)
def interval_gap_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = segments.interval_gap_flags(_interval_frame(spark, sf_dir), 1.8)
    return flagged.select("entity", "interval", "start", F.round("gap", 6).alias("gap"), F.round("typical_gap", 6).alias("typical_gap"), "interval_gap")


@query(
    f"""
WITH {INTERVALS_SQL}, gaps AS (
  SELECT entity, "interval", start, lag(start) OVER w AS prev, lag("interval") OVER w AS prev_interval, count(*) OVER (PARTITION BY entity) AS n_points,
    start - lag(start) OVER w AS gap
  FROM intervals WINDOW w AS (PARTITION BY entity ORDER BY start, "interval")
), typical AS (
  SELECT *, median(CASE WHEN gap > 0 THEN gap END) OVER (PARTITION BY entity) AS typical_gap,
    count(CASE WHEN gap > 0 THEN gap END) OVER (PARTITION BY entity) AS n_gaps FROM gaps
), rated AS (
  SELECT *, least(4, greatest(1, floor(gap / typical_gap + 0.5::DOUBLE)::INT - 1))::INT AS n_missing
  FROM typical WHERE n_points >= 3 AND n_gaps >= 2 AND typical_gap > 0 AND gap / typical_gap >= 1.8::DOUBLE
)
SELECT entity, prev_interval AS before, "interval" AS after, position::INT AS position, n_missing, round(prev + gap * position / (n_missing + 1), 4) AS time,
  round(gap, 6) AS gap, round(typical_gap, 6) AS typical_gap
FROM (SELECT *, unnest(range(1, n_missing + 1)) AS position FROM rated)
"""
)
def cadence_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = segments.cadence_gaps(_interval_frame(spark, sf_dir))
    return found.withColumns({"time": F.round("time", 4), "gap": F.round("gap", 6), "typical_gap": F.round("typical_gap", 6)})


C = CONFIG
SCORED_SQL = f"""{CANDIDATES_SQL}, scored AS (
  SELECT *, round({C.sharpness_weight}::DOUBLE * ln(1 + sharpness) / 8 - {C.motion_weight}::DOUBLE * least(1.0::DOUBLE, motion / {C.turn_threshold}::DOUBLE)
      - {C.hand_overlap_weight}::DOUBLE * coalesce(hand, 0) - {C.glare_overlap_weight}::DOUBLE * coalesce(glare, 0) - {C.distortion_weight}::DOUBLE * distortion
      - {C.flatness_weight}::DOUBLE * flatness - {C.clipping_weight}::DOUBLE * clipping - {C.exposure_weight}::DOUBLE * exposure, 9) AS score,
    round(ln(1 + greatest(sharpness, 0)) / 8, 9) AS focus,
    list_filter([CASE WHEN sharpness < {C.suspect_sharpness}::DOUBLE THEN 'low_sharpness' END, CASE WHEN hand IS NULL THEN 'hand_detection_disabled' END,
      CASE WHEN hand > {C.suspect_hand_overlap}::DOUBLE THEN 'hand_overlap' END, CASE WHEN coalesce(glare, 0) > {C.suspect_glare_overlap}::DOUBLE THEN 'glare_overlap' END,
      CASE WHEN motion > {C.motion_threshold}::DOUBLE THEN 'high_motion' END, CASE WHEN distortion > 0.25::DOUBLE THEN 'page_quad_uncertain' END,
      CASE WHEN exposure > 0.3::DOUBLE THEN 'underexposed' END], lambda x: x IS NOT NULL) AS suspect
  FROM source_rows
)"""


def _scored_from(source: str) -> str:
    return SCORED_SQL.replace("source_rows", source)


def _relative_sql(source: str, keys: str) -> str:
    ranks = []
    for m, (_, better) in ranking.RELATIVE.items():
        rank = f"""((rank() OVER (PARTITION BY {keys}, {m} IS NULL ORDER BY {m}) - 1) + (count({m}) OVER (PARTITION BY {keys}, {m}) - 1) / 2.0::DOUBLE)
        / (count({m}) OVER (PARTITION BY {keys}, {m} IS NULL) - 1)"""
        rank = rank if better else f"1 - {rank}"
        ranks.append(
            f"""CASE WHEN {m} IS NULL THEN NULL WHEN count({m}) OVER (PARTITION BY {keys}, {m} IS NULL) <= 1
      OR max({m}) OVER (PARTITION BY {keys}, {m} IS NULL) - min({m}) OVER (PARTITION BY {keys}, {m} IS NULL) <= 1e-12 THEN 0.5::DOUBLE
      ELSE {rank} END AS rel_{m}"""
        )
    total = " + ".join(f"coalesce(rel_{m}, 0) * {w}::DOUBLE" for m, (w, _) in ranking.RELATIVE.items())
    weight = " + ".join(f"CASE WHEN rel_{m} IS NULL THEN 0::DOUBLE ELSE {w}::DOUBLE END" for m, (w, _) in ranking.RELATIVE.items())
    return f"""ranked AS (
  SELECT *, {', '.join(ranks)} FROM {source}
), relative AS (
  SELECT *, round(CASE WHEN {weight} > 0 THEN ({total}) / ({weight}) ELSE coalesce(score, 0) END, 9) AS selection_score FROM ranked
)"""


def _codes(names: list[str]) -> str:
    return "[" + ", ".join(f"'{n}'" for n in names) + "]"


def _choose_sql(keys: str) -> str:
    fin = lambda x: f"({x} IS NOT NULL AND isfinite({x}))"
    return f"""flagged AS (
  SELECT *, list_has_any(suspect, {_codes(ranking.BLOCKING)}) AS blocked FROM relative
), pooled AS (
  SELECT *, bool_or(NOT blocked) OVER (PARTITION BY {keys}) AS any_readable FROM flagged
), pool AS (
  SELECT *, first_value({{'hand': hand, 'focus': focus, 'score': selection_score, 'motion': motion, 'glare': glare, 'suspect': suspect}})
    OVER (PARTITION BY {keys} ORDER BY selection_score DESC, cand) AS best
  FROM pooled WHERE NOT any_readable OR NOT blocked
), judged AS (
  SELECT *, coalesce({fin('best.hand')} AND {fin('hand')} AND hand <= best.hand - 0.01::DOUBLE AND focus >= best.focus * 0.8::DOUBLE
    AND selection_score >= best.score - 0.55::DOUBLE
    AND len(list_filter(suspect, lambda x: list_contains({_codes(ranking.BLOCKING)}, x) AND NOT list_contains(best.suspect, x))) = 0
    AND (NOT ({fin('motion')} AND {fin('best.motion')}) OR motion <= greatest(0.02::DOUBLE, best.motion * 3))
    AND (NOT ({fin('glare')} AND {fin('best.glare')}) OR glare <= best.glare + 0.05::DOUBLE), false) AS eligible
  FROM pool
), chosen AS (
  SELECT * FROM judged QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY eligible DESC, CASE WHEN eligible THEN hand END, selection_score DESC, cand) = 1
)"""


RELATIVE_SQL = f"{_scored_from('candidates')}, {_relative_sql('scored', 'spread')}"
CHOSEN_SQL = f"{RELATIVE_SQL}, {_choose_sql('spread')}"


def _relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.relative_scores(ranking.scored(candidates(spark, sf_dir), CONFIG), ["spread"])


def _sided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.scored(ranking.by_side(candidates(spark, sf_dir, copies=2)), CONFIG)


SIDED_SQL = f"""{CANDIDATES_SQL}, sided AS (
  SELECT c.* EXCLUDE (sharpness, glare), side, CASE WHEN side = 'left' THEN sharpness * 0.9::DOUBLE ELSE sharpness * (0.5::DOUBLE + exposure) END AS sharpness,
    CASE WHEN side = 'left' THEN glare ELSE glare / 2 END AS glare
  FROM candidates c, (VALUES ('left'), ('right')) s(side)
), {_scored_from('sided').split(CANDIDATES_SQL + ",", 1)[1]}"""


@query(f"WITH {_scored_from('candidates')} SELECT spread, cand, score, focus FROM scored")
def composite_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.scored(candidates(spark, sf_dir), CONFIG).select("spread", "cand", "score", "focus")


@query(f"WITH {_scored_from('candidates')} SELECT spread, cand, array_to_string(suspect, ',') AS reasons, len(suspect)::INT AS n_reasons FROM scored")
def suspect_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.scored(candidates(spark, sf_dir), CONFIG)
    return found.select("spread", "cand", F.array_join("suspect", ",").alias("reasons"), F.size("suspect").alias("n_reasons"))


@query(f"WITH {RELATIVE_SQL} SELECT spread, cand, selection_score, {', '.join(f'round(rel_{m}, 6) AS rel_{m}' for m in ranking.RELATIVE)} FROM relative")
def relative_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relative(spark, sf_dir).select("spread", "cand", "selection_score", *[F.round(f"rel_{m}", 6).alias(f"rel_{m}") for m in ranking.RELATIVE])


@query(f"WITH {CHOSEN_SQL} SELECT spread, cand, selection_score, hand FROM chosen")
def select_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.choose(_relative(spark, sf_dir), ["spread"]).select("spread", "cand", "selection_score", "hand")


@query(f"WITH {SIDED_SQL}, {_relative_sql('scored', 'spread, side')}, {_choose_sql('spread, side')} SELECT spread, side, cand, selection_score FROM chosen")
def select_per_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["spread", "side"]
    return ranking.choose(ranking.relative_scores(_sided(spark, sf_dir), keys), keys).select(*keys, "cand", "selection_score")


def _fallback_sql(source: str, keys: str, among: list[str]) -> str:
    own = f"list_filter(suspect, lambda x: list_contains({_codes(among)}, x))"
    return f"""SELECT {keys}, CASE WHEN bool_and(len({own}) > 0) THEN array_to_string(list_sort(list_distinct(flatten(list({own})))), ',') ELSE '' END AS reasons
FROM {source} GROUP BY {keys}"""


@query(f"WITH {_scored_from('candidates')} {_fallback_sql('scored', 'spread', ranking.RECOVERABLE)}")
def fallback_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.fallback_reasons(ranking.scored(candidates(spark, sf_dir), CONFIG), ["spread"], ranking.RECOVERABLE)
    return found.withColumn("reasons", F.array_join("reasons", ","))


@query(
    f"""
WITH {SIDED_SQL}, sides AS ({_fallback_sql('scored', 'spread, side', ranking.STAGED)})
SELECT spread, array_to_string(list_sort(list_distinct(flatten(list(string_split(reasons, ',')) FILTER (reasons <> '')))), ',') AS reasons
FROM sides GROUP BY spread HAVING bool_or(reasons <> '')
"""
)
def staged_fallback_per_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spreads of which one side failed everywhere; the reasons of such sides together."""
    sides = ranking.fallback_reasons(_sided(spark, sf_dir), ["spread", "side"], ranking.STAGED)
    union = F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons"))))
    return sides.where(F.size("reasons") > 0).groupBy("spread").agg(F.array_join(union, ",").alias("reasons"))


@query(
    f"""
WITH {CHOSEN_SQL}, others AS (
  SELECT r.* FROM relative r JOIN chosen c ON r.spread = c.spread AND r.cand <> c.cand
)
SELECT spread, cand, row_number() OVER (PARTITION BY spread ORDER BY coalesce(hand, 1), glare, score DESC, cand)::INT AS donor_rank
FROM others QUALIFY donor_rank <= 5
"""
)
def donor_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.donor_ranking(_relative(spark, sf_dir), ["spread"]).select("spread", "cand", "donor_rank")


_R = _codes(ranking.FIX_RISKS)


@query(
    f"""
WITH {CHOSEN_SQL}, pairs AS (
  SELECT r.spread, r.cand, c.cand AS current, c.suspect AS was, r.focus, c.focus AS was_focus, r.hand, c.hand AS was_hand, r.motion, c.motion AS was_motion,
    r.glare, c.glare AS was_glare, r.selection_score - c.selection_score AS gain,
    list_filter(r.suspect, lambda x: list_contains({_R}, x)) AS risks, list_filter(c.suspect, lambda x: list_contains({_R}, x)) AS was_risks
  FROM relative r JOIN chosen c ON r.spread = c.spread AND r.cand <> c.cand WHERE list_has_any(c.suspect, {_codes(ranking.FIX_TRIGGERS)})
), improved AS (
  SELECT *, list_filter([
    CASE WHEN list_contains(was, 'glare_overlap') AND was_glare > 0 AND glare <= was_glare * 0.7::DOUBLE AND was_glare - glare >= 0.001::DOUBLE THEN 'glare' END,
    CASE WHEN list_contains(was, 'hand_overlap') AND was_hand > 0 AND hand <= was_hand * 0.7::DOUBLE AND was_hand - hand >= 0.001::DOUBLE THEN 'hand' END,
    CASE WHEN list_contains(was, 'low_sharpness') AND focus >= was_focus * 1.15::DOUBLE THEN 'sharpness' END,
    CASE WHEN list_contains(was, 'high_motion') AND was_motion > 0 AND motion <= was_motion * 0.7::DOUBLE THEN 'motion' END,
    CASE WHEN len(risks) < len(was_risks) THEN 'risk_count' END,
    CASE WHEN gain >= 0.08::DOUBLE THEN 'selection_score' END], lambda x: x IS NOT NULL) AS improvements
  FROM pairs
)
SELECT spread, current, cand, row_number() OVER (PARTITION BY spread ORDER BY len(risks), len(improvements) DESC, coalesce(round(gain, 6), -1) DESC, cand)::INT AS place,
  array_to_string(improvements, ',') AS improvements, round(gain, 6) AS score_gain, len(risks)::INT AS n_risks
FROM improved WHERE len(list_filter(risks, lambda x: NOT list_contains(was_risks, x))) = 0 AND len(improvements) > 0 QUALIFY place <= 2
"""
)
def safe_fix_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.safe_fixes(_relative(spark, sf_dir), ["spread"]).withColumn("improvements", F.array_join("improvements", ","))


@query(
    f"""
WITH {REVIEW_PAGES_SQL}, counted AS (
  SELECT project, sum(CASE WHEN enabled THEN CASE WHEN side = 'spread' THEN 2 ELSE 1 END ELSE 0 END)::BIGINT AS actual, count(*) FILTER (enabled) AS output_items
  FROM review_pages GROUP BY project
), checked AS (
  SELECT *, CASE WHEN length(project) > 6 THEN actual + output_items % 3 - 1 END AS expected FROM counted
)
SELECT *, actual - expected AS difference,
  CASE WHEN expected IS NULL THEN 'unset' WHEN actual = expected THEN 'match' WHEN actual < expected THEN 'short' ELSE 'over' END AS status
FROM checked
"""
)
def page_count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = F.when(F.length("project") > 6, F.col("actual") + F.col("output_items") % 3 - 1)
    return review.page_count_check(review_pages(spark, sf_dir), expected)


@query(
    f"""
WITH {REVIEW_PAGES_SQL}, flagged AS (
  SELECT project, list_distinct(list_concat(suspect, final_reasons)) AS reasons FROM review_pages WHERE enabled
), matched AS (
  SELECT project, unnest(list_filter(['total', {', '.join(f"CASE WHEN list_has_any(reasons, {_codes(v)}) THEN '{k}' END" for k, v in review.CATEGORIES.items())}],
    lambda x: x IS NOT NULL)) AS category FROM flagged WHERE len(reasons) > 0
)
SELECT project, category, count(*) AS n_pages FROM matched GROUP BY project, category
"""
)
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_summary(review_pages(spark, sf_dir))


@query(
    f"""
WITH {REVIEW_PAGES_SQL}
SELECT project, page, position, CASE WHEN enabled THEN (sum(enabled::INT) OVER (PARTITION BY project ORDER BY position))::BIGINT END AS number FROM review_pages
"""
)
def running_page_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.running_numbers(review_pages(spark, sf_dir)).select("project", "page", "position", "number")


@query(f"WITH {REVIEW_PAGES_SQL} SELECT project, page, position // 80 AS sheet, position % 80 // 5 AS \"row\", position % 5 AS \"column\" FROM review_pages")
def contact_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.contact_sheets(review_pages(spark, sf_dir)).select("project", "page", "sheet", "row", "column")


@query(
    f"""
WITH {REVIEW_PAGES_SQL}
SELECT project, count(*) AS n_pages, count(*) FILTER (enabled) AS n_enabled,
  array_to_string(list_sort(list_distinct(flatten(list(list_concat(suspect, final_reasons))))), ',') AS reasons
FROM review_pages GROUP BY project
"""
)
def project_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.project_catalog(review_pages(spark, sf_dir))


@query(
    f"""
WITH {REVIEW_PAGES_SQL}
SELECT page, array_to_string(list_sort(list_filter(suspect, lambda x: list_contains(['low_sharpness', 'glare_overlap'], x))), ',') AS shared,
  array_to_string(list_sort(list_distinct(list_concat(suspect, final_reasons))), ',') AS combined,
  array_to_string(list_sort(list_filter(suspect, lambda x: x <> 'low_sharpness')), ',') AS others,
  len(list_filter(suspect, lambda x: NOT list_contains(['low_sharpness', 'glare_overlap'], x))) = 0 AS contained
FROM review_pages
"""
)
def set_ops_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection, union, difference and subset test of reason sets."""
    some = ranking.codes(["low_sharpness", "glare_overlap"])
    joined = lambda x: F.array_join(F.array_sort(x), ",")
    return review_pages(spark, sf_dir).select(
        "page",
        joined(F.array_intersect("suspect", some)).alias("shared"),
        joined(F.array_union("suspect", "final_reasons")).alias("combined"),
        joined(F.array_except("suspect", ranking.codes(["low_sharpness"]))).alias("others"),
        (F.size(F.array_except("suspect", some)) == 0).alias("contained"),
    )
