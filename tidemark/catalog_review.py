"""Named queries of review work: edits, merges, duplicate groups, prefilter plans and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalog import DAY, FPS, HIGH, INTERVALS_SQL, LOW, SAMPLES_SQL, TURNS_SQL, _interval_frame, query
from .catalog_more import HASH_SQL, QUADS_SQL, _hashes, _quads, concatenated_sources
from .operators import asof, edits, merges, prefilter, proposals, segments, verdicts
from .operators.ranking import finite
from .sources.adapters import CANDIDATES_SQL, REVIEW_PAGES_SQL, candidates, review_pages, samples, table

_LIMIT, _ALIKE = 3, 24


@query(
    f"""
WITH {HASH_SQL}, seqs AS (
  SELECT id // 10 AS seq, row_number() OVER (PARTITION BY id // 10 ORDER BY id) - 1 AS idx, hash, hash % 101 AS score FROM hashes
), runs AS (
  SELECT *, count(*) OVER (PARTITION BY seq) AS n, lead(hash) OVER (PARTITION BY seq ORDER BY idx) AS next FROM seqs
), first_reps AS (
  SELECT *, n <= {_LIMIT} OR next IS NULL OR bit_count(xor(hash, next)) > {_ALIKE} AS rep0 FROM runs
), reps AS (
  SELECT *, rep0 OR (sum(rep0::INT) OVER (PARTITION BY seq) < least({_LIMIT}, n) AND idx IN (0, (n - 1) // 2, n - 1)) AS rep FROM first_reps
), placed AS (
  SELECT *, coalesce(min(idx) FILTER (rep) OVER (PARTITION BY seq ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), max(idx) FILTER (rep) OVER (PARTITION BY seq)) AS representative,
    sum(rep::INT) OVER (PARTITION BY seq) AS n_representatives, idx = max(idx) FILTER (rep) OVER (PARTITION BY seq) AS latest FROM reps
), binned AS (
  SELECT *, CASE WHEN rep AND NOT latest THEN ntile({_LIMIT - 1}) OVER (PARTITION BY seq, rep, latest ORDER BY idx) END AS bin FROM placed
)
SELECT seq, idx, representative, n_representatives::BIGINT AS n_representatives, CASE WHEN NOT rep THEN 'suppressed'
  WHEN latest OR n_representatives <= {_LIMIT} OR row_number() OVER (PARTITION BY seq, rep, bin ORDER BY score DESC, idx DESC) = 1 THEN 'primary' ELSE 'remaining' END AS role
FROM binned
"""
)
def candidate_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Primary, remaining and suppressed candidates of sequences of ten rasters."""
    seq = F.floor(F.col("id") / 10).cast("long")
    rows = _hashes(spark, sf_dir).withColumn("seq", seq)
    rows = rows.withColumn("idx", (F.row_number().over(W.partitionBy("seq").orderBy("id")) - 1).cast("long")).withColumn("score", F.col("hash") % 101)
    found = prefilter.candidate_plan(rows.select("seq", "idx", "hash", "score"), ["seq"], _LIMIT, _ALIKE)
    return found.select("seq", "idx", "representative", "n_representatives", "role")


_ACTIONS = ["toggle", "move", "undo", "swap", "redo", "toggle", "move"]
_STATE = "{'o': o, 'd': d}"


@query(
    f"""
WITH RECURSIVE {REVIEW_PAGES_SQL}, log AS (
  SELECT project, position + 1 AS seq, page, spread, {_ACTIONS}[(page % {len(_ACTIONS)} + 1)::INT] AS action, page % 5 - 2 AS delta FROM review_pages
), pairs AS (
  SELECT project, spread, list(page ORDER BY page) AS two FROM review_pages GROUP BY project, spread HAVING count(*) = 2
), steps AS (
  SELECT l.*, two FROM log l LEFT JOIN pairs p ON p.project = l.project AND p.spread = l.spread
), fold(project, seq, o, d, undo, redo) AS (
  SELECT project, 0::BIGINT, list(page ORDER BY position), coalesce(list_sort(list(page) FILTER (NOT enabled)), []::BIGINT[]),
    []::STRUCT(o BIGINT[], d BIGINT[])[], []::STRUCT(o BIGINT[], d BIGINT[])[] FROM review_pages GROUP BY project
  UNION ALL
  SELECT project, seq, s.o, s.d,
    CASE WHEN action = 'undo' THEN undo[1:greatest(len(undo) - 1, 0)] WHEN s = was AND action <> 'redo' OR action = 'redo' AND len(redo) = 0 THEN undo ELSE list_append(undo, was)[-30:] END,
    CASE WHEN action = 'redo' THEN redo[1:greatest(len(redo) - 1, 0)] WHEN action = 'undo' THEN CASE WHEN len(undo) = 0 THEN redo ELSE list_append(redo, was)[-30:] END
      WHEN s = was THEN redo ELSE []::STRUCT(o BIGINT[], d BIGINT[])[] END
  FROM (
    SELECT f.project, e.seq, e.action, f.undo, f.redo, {_STATE} AS was, CASE
      WHEN action = 'toggle' THEN {{'o': o, 'd': CASE WHEN list_contains(d, page) THEN list_filter(d, lambda x: x <> page) ELSE list_sort(list_append(d, page)) END}}
      WHEN action = 'move' THEN {{'o': list_concat(list_concat(list_filter(o, lambda x: x <> page)[1:greatest(0, least(len(o) - 1, list_position(o, page) - 1 + delta))], [page]),
        list_filter(o, lambda x: x <> page)[greatest(0, least(len(o) - 1, list_position(o, page) - 1 + delta)) + 1:]), 'd': d}}
      WHEN action = 'swap' AND two IS NOT NULL THEN {{'o': list_transform(o, lambda x: CASE WHEN x = two[1] THEN two[2] WHEN x = two[2] THEN two[1] ELSE x END), 'd': d}}
      WHEN action = 'undo' AND len(undo) > 0 THEN undo[len(undo)]
      WHEN action = 'redo' AND len(redo) > 0 THEN redo[len(redo)]
      ELSE {_STATE} END AS s
    FROM fold f JOIN steps e ON e.project = f.project AND e.seq = f.seq + 1
  )
), ends AS (
  SELECT project, arg_max(o, seq) AS o, arg_max(d, seq) AS d FROM fold GROUP BY project
)
SELECT project, unnest(o) AS page, unnest(range(len(o))) AS position, NOT list_contains(d, unnest(o)) AS enabled FROM ends
"""
)
def edited_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each project after a log of toggles, moves, swaps, undos and redos."""
    pages = review_pages(spark, sf_dir)
    action = F.element_at(F.array(*map(F.lit, _ACTIONS)), (F.col("page") % len(_ACTIONS) + 1).cast("int"))
    number = F.when(action == "move", F.col("page") % 5 - 2).when(action == "swap", F.col("spread"))
    log = review_pages(spark, sf_dir).select("project", (F.col("position") + 1).alias("seq"), action.alias("action"), "page", number.alias("number"), F.lit(None).cast("array<long>").alias("pages"))
    return edits.replay(pages.select("project", "page", "position", "spread", "enabled"), log)


@query(
    f"""
WITH {REVIEW_PAGES_SQL}
SELECT project, page, CASE WHEN page % 3 = 0 THEN position + 100 ELSE position END AS position, CASE WHEN page % 3 = 0 THEN 'external' ELSE side END AS side, enabled
FROM review_pages UNION ALL SELECT project, -page, position + 100, 'external', NOT enabled FROM review_pages WHERE page % 50 = 0 AND page > 0
"""
)
def replaced_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third page replaced by key, what is shown kept; pages without an old row are added."""
    old = review_pages(spark, sf_dir).select("project", "page", "position", "side", "enabled")
    fresh = old.withColumns({"position": F.col("position") + 100, "side": F.lit("external"), "enabled": ~F.col("enabled")})
    new = fresh.where("page % 3 = 0").union(fresh.where("page % 50 = 0 and page > 0").withColumn("page", -F.col("page")))
    added = new.join(old.select("project", "page"), ["project", "page"], "left_anti").select(*old.columns)
    return merges.replace_by_key(old, new, ["project", "page"], ["enabled"]).unionByName(added)


@query(
    f"""
WITH {REVIEW_PAGES_SQL}, asked AS (
  SELECT project, page FROM review_pages WHERE page % 100 <> 7 UNION ALL SELECT project, page FROM review_pages WHERE page % 90 = 3
  UNION ALL SELECT project, -page - 1 FROM review_pages WHERE page % 120 = 5
), per_key AS (
  SELECT project, page, sum(h) AS has, sum(a) AS asks FROM (SELECT project, page, 1 AS h, 0 AS a FROM review_pages UNION ALL SELECT project, page, 0, 1 FROM asked) GROUP BY ALL
)
SELECT *, n_missing = 0 AND n_unknown = 0 AND n_repeated = 0 AS is_permutation FROM (
  SELECT project, sum(has)::BIGINT AS n_current, sum(asks)::BIGINT AS n_asked, count(*) FILTER (asks = 0) AS n_missing, count(*) FILTER (has = 0) AS n_unknown,
    count(*) FILTER (asks > 1) AS n_repeated FROM per_key GROUP BY project)
"""
)
def reorder_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a requested order lists every page of its project exactly once."""
    pages = review_pages(spark, sf_dir).select("project", "page")
    asked = pages.where("page % 100 <> 7").union(pages.where("page % 90 = 3")).union(pages.where("page % 120 = 5").withColumn("page", -F.col("page") - 1))
    return merges.key_sets(pages, asked, ["project"], "page")


@query(
    f"""
WITH {REVIEW_PAGES_SQL}, rooted AS (
  SELECT page AS id, enabled, page % 13 = 0 AS touched, page - page % 4 AS root FROM review_pages
)
SELECT id, root, count(*) OVER w AS n_members, count(*) FILTER (enabled) OVER w AS n_shown, count(*) OVER w > 1 AND bool_or(touched) OVER w AS protected,
  count(*) OVER w > 1 AND count(*) FILTER (enabled) OVER w = 1 AND NOT bool_or(touched) OVER w AS open
FROM rooted WINDOW w AS (PARTITION BY root)
"""
)
def duplicate_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of a root and what repeats it, those edited by hand protected."""
    p = F.col("page")
    rows = review_pages(spark, sf_dir).select(p.alias("id"), F.when(p % 4 != 0, p - p % 4).alias("duplicate_of"), "enabled", (p % 13 == 0).alias("touched"))
    return merges.duplicate_groups(rows, []).select("id", "root", "n_members", "n_shown", "protected", "open")


@query(
    f"""
WITH {REVIEW_PAGES_SQL}, l AS (
  SELECT project, row_number() OVER (PARTITION BY project ORDER BY position) - 1 AS position, page AS left_page FROM review_pages WHERE side = 'left'
), r AS (
  SELECT project, row_number() OVER (PARTITION BY project ORDER BY position) - 1 AS position, page AS right_page FROM review_pages WHERE side = 'right'
)
SELECT coalesce(l.project, r.project) AS project, coalesce(l.position, r.position) AS position, left_page, right_page,
  bool_and(left_page IS NOT NULL AND right_page IS NOT NULL) OVER (PARTITION BY coalesce(l.project, r.project)) AS complete
FROM l FULL JOIN r ON l.project = r.project AND l.position = r.position
"""
)
def zipped_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left and right pages by position; a project with more of one side is not complete."""
    place = (F.row_number().over(W.partitionBy("project").orderBy("position")) - 1).cast("long")

    def side(name: str) -> DataFrame:
        return review_pages(spark, sf_dir).where(F.col("side") == name).select("project", place.alias("position"), F.col("page").alias(f"{name}_page"))

    return merges.zip_by_position(side("left"), side("right"), ["project"])


@query(
    f"""
WITH {TURNS_SQL}, {INTERVALS_SQL.split(SAMPLES_SQL + ",", 1)[1]}, pairs AS (
  SELECT entity, event, "end" AS window_start, lead(start) OVER (PARTITION BY entity ORDER BY event) AS window_end FROM turns
)
SELECT entity, event, window_start, window_end FROM pairs p WHERE window_end > window_start
  AND NOT EXISTS (SELECT 1 FROM intervals i WHERE i.entity = p.entity AND i.start > p.window_start AND i.start < p.window_end)
"""
)
def open_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows between events that no interval starts inside of."""
    events = segments.turn_events(samples(spark, sf_dir), LOW, HIGH, FPS)
    ends = F.lead("start").over(W.partitionBy("entity").orderBy("event"))
    windows = events.select("entity", "event", F.col("end").alias("window_start"), ends.alias("window_end")).where("window_end > window_start")
    starts = _interval_frame(spark, sf_dir).select("entity", "start")
    # The next start after a window's begin lies inside the window, or none does.
    found = asof.asof_join(windows, starts, ["entity"], "window_start", "start", "_next", backward=False, exact=False)
    return found.where("_next is null or _next.start >= window_end").drop("_next")


@query(
    f"""
WITH {INTERVALS_SQL}, windows AS (
  SELECT entity, "interval" AS win, list(start) OVER (PARTITION BY entity ORDER BY "interval" ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS source_starts FROM intervals
  QUALIFY "interval" % 2 = 1
), exploded AS (
  SELECT entity, win, unnest(source_starts) AS start FROM windows
)
SELECT i.entity, i."interval", count(e.win) AS n_windows, coalesce(array_to_string(list_sort(list(e.win) FILTER (e.win IS NOT NULL)), ','), '') AS wins
FROM intervals i LEFT JOIN exploded e ON e.entity = i.entity AND e.start = i.start GROUP BY ALL
"""
)
def merged_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged windows that each interval's start is a source of, none or several."""
    spans = _interval_frame(spark, sf_dir).select("entity", "interval", "start")
    ahead = W.partitionBy("entity").orderBy("interval").rowsBetween(0, 2)
    wins = spans.withColumn("starts", F.collect_list("start").over(ahead)).where("interval % 2 = 1").select("entity", F.col("interval").alias("win"), F.explode("starts").alias("start"))
    joined = spans.join(wins, ["entity", "start"], "left").groupBy("entity", "interval")
    return joined.agg(F.count("win").alias("n_windows"), F.array_join(F.array_sort(F.collect_list("win")), ",").alias("wins"))


@query(
    """
WITH laid AS (
  SELECT conv_id, (sum(count(*)) OVER (ORDER BY conv_id ROWS UNBOUNDED PRECEDING) - count(*))::BIGINT AS offset_before, min(turn)::BIGINT AS first_turn FROM conversations GROUP BY conv_id
)
SELECT c.conv_id AS source, c.turn::BIGINT AS turn, offset_before + c.turn - first_turn AS t, offset_before + c.turn - first_turn < 1000000 AS within_limit
FROM conversations c JOIN laid l ON c.conv_id = l.conv_id
"""
)
def shifted_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources' rows on one time line, each source after those before it, and whether the total limit holds."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source"), F.col("turn").cast("long").alias("turn"))
    t = F.col("offset_before") + F.col("turn") - F.col("first_turn")
    return rows.join(concatenated_sources(spark, sf_dir), "source").select("source", "turn", t.cast("long").alias("t"), (t < 1_000_000).alias("within_limit"))


@query(
    f"""
WITH {INTERVALS_SQL}, every AS (
  SELECT entity, 'stable' AS kind, "interval", start FROM intervals UNION ALL SELECT entity, 'recovered', "interval", "end" + {DAY} FROM intervals WHERE "interval" % 2 = 0
), merged AS (
  SELECT entity, "interval" FROM intervals WHERE "interval" % 3 = 0
)
SELECT entity, kind, "interval", start, row_number() OVER (PARTITION BY entity ORDER BY start, kind, "interval")::INT AS number
FROM every e WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.entity = e.entity AND m."interval" = e."interval")
"""
)
def segments_with_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable and recovered segments in one order, without those that were merged."""
    spans = _interval_frame(spark, sf_dir).select("entity", "interval", "start", "end")
    stable = spans.select("entity", F.lit("stable").alias("kind"), "interval", "start")
    recovered = spans.where("interval % 2 = 0").select("entity", F.lit("recovered").alias("kind"), "interval", (F.col("end") + DAY).alias("start"))
    merged = spans.where("interval % 3 = 0").select("entity", "interval")
    left = stable.unionByName(recovered).join(merged, ["entity", "interval"], "left_anti")
    number = F.row_number().over(W.partitionBy("entity").orderBy("start", "kind", "interval"))
    return left.select("entity", "kind", "interval", "start", number.alias("number"))


@query(
    f"""
WITH {REVIEW_PAGES_SQL}, both_lists AS (SELECT page, list_concat(final_reasons, suspect, ['low_sharpness']) AS l FROM review_pages)
SELECT page, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS reasons FROM both_lists
"""
)
def reasons_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct reasons in order of first occurrence."""
    every = F.concat("final_reasons", "suspect", F.array(F.lit("low_sharpness")))
    return review_pages(spark, sf_dir).select("page", F.array_join(F.array_distinct(every), ",").alias("reasons"))


@query(
    f"""
WITH {CANDIDATES_SQL}, measured AS (
  SELECT spread, cand, exposure * 2 AS edge_fraction, distortion * 2 AS edge_score, glare, sharpness / 50 AS luma_std, 1 - clipping / 4 AS white, 0.9::DOUBLE + flatness / 6 AS black,
    flatness AS whitened, cand % 2 = 0 AS normalised, CASE WHEN cand % 3 = 0 THEN distortion END AS fill, hand IS NOT NULL AS finger, exposure > 0.4::DOUBLE AS unresolved,
    hand * 10 AS residual, 1 - exposure AS line_before, CASE WHEN cand <> 1 THEN distortion END AS line_after FROM candidates
)
SELECT spread, cand, array_to_string(list_filter([
  CASE WHEN edge_fraction >= 0.72::DOUBLE AND edge_score >= 0.48::DOUBLE THEN 'final_edge_crop_suspected' END, CASE WHEN glare >= 0.003::DOUBLE THEN 'final_glare_residual' END,
  CASE WHEN white >= 0.985::DOUBLE AND luma_std <= 12 THEN 'final_near_blank_white' END, CASE WHEN black >= 0.97::DOUBLE AND luma_std <= 12 THEN 'final_near_blank_black' END,
  CASE WHEN normalised AND whitened >= 0.3::DOUBLE OR fill >= 0.25::DOUBLE THEN 'final_background_fill_large' END, CASE WHEN finger AND unresolved THEN 'final_unresolved_finger' END,
  CASE WHEN finger AND residual >= 0.14::DOUBLE THEN 'final_finger_repair_residual' END,
  CASE WHEN line_before >= 0.8::DOUBLE AND line_after <= line_before * 0.62::DOUBLE AND line_before - line_after >= 0.35::DOUBLE THEN 'final_dewarp_line_regression' END
], lambda x: x IS NOT NULL), ',') AS reasons FROM measured
"""
)
def final_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the final checks from measure columns."""
    c = F.col
    measured = candidates(spark, sf_dir).withColumns(
        {
            "edge_fraction": c("exposure") * 2,
            "edge_score": c("distortion") * 2,
            "luma_std": c("sharpness") / 50,
            "white": 1 - c("clipping") / 4,
            "black": 0.9 + c("flatness") / 6,
            "whitened": c("flatness"),
            "normalised": c("cand") % 2 == 0,
            "fill": F.when(c("cand") % 3 == 0, c("distortion")),
            "finger": c("hand").isNotNull(),
            "unresolved": c("exposure") > 0.4,
            "residual": c("hand") * 10,
            "line_before": 1 - c("exposure"),
            "line_after": F.when(c("cand") != 1, c("distortion")),
        }
    )
    return measured.select("spread", "cand", F.array_join(verdicts.final_codes(), ",").alias("reasons"))


#: Measures of an alignment, as expressions that both engines read alike.
_GATES = {
    "inliers": "sharpness / 3",
    "inlier_ratio": "exposure + 0.2::DOUBLE",
    "half_inliers": "sharpness / 8",
    "balance": "distortion",
    "coverage_x": "0.2::DOUBLE + flatness",
    "coverage_y": "0.25::DOUBLE + flatness",
    "overlap": "0.4::DOUBLE + exposure",
    "correlation": "1 - exposure",
}


def _all_sql(**least: float) -> str:
    return " AND ".join(f"{k} >= {v}::DOUBLE" for k, v in least.items())


@query(
    f"""
WITH {CANDIDATES_SQL}, measured AS (
  SELECT spread, cand, {", ".join(f"{sql} AS {k}" for k, sql in _GATES.items())}, clipping AS density, motion * 2 AS step_shift, distortion AS total_shift, 0.5::DOUBLE + exposure * 2 AS area_ratio FROM candidates
), judged AS (
  SELECT *, density >= 0.04::DOUBLE AND {_all_sql(inliers=60, inlier_ratio=0.45, half_inliers=20, balance=0.08, coverage_x=0.40, coverage_y=0.45, overlap=0.55, correlation=0.45)}
    OR {_all_sql(inliers=120, inlier_ratio=0.40, half_inliers=40, balance=0.20, coverage_x=0.58, coverage_y=0.65, overlap=0.75, correlation=0.25)} AS duplicate,
    density >= 0.025::DOUBLE AND {_all_sql(inliers=40, inlier_ratio=0.35, coverage_x=0.25, coverage_y=0.30, overlap=0.45, correlation=0.30)} AS alike FROM measured
)
SELECT spread, cand, duplicate, alike OR duplicate AS suspect, CASE WHEN step_shift > 0.03::DOUBLE THEN 'step_shift_too_large' WHEN total_shift > 0.3::DOUBLE THEN 'total_shift_too_large'
  WHEN NOT (area_ratio BETWEEN 0.7::DOUBLE AND 1.4::DOUBLE) THEN 'area_change_too_large' ELSE 'tracked' END AS status FROM judged
"""
)
def alignment_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suspect and duplicate by alignment measures, and the status of a tracked region."""
    c = F.col
    more = {"step_shift": c("motion") * 2, "total_shift": c("distortion"), "area_ratio": 0.5 + c("exposure") * 2}
    rows = candidates(spark, sf_dir).withColumns({**{k: F.expr(v) for k, v in _GATES.items()}, **more})
    gates = verdicts.alignment_gates(c("clipping"))
    return rows.select("spread", "cand", gates["duplicate"].alias("duplicate"), gates["suspect"].alias("suspect"), verdicts.tracking_status(0.03, 0.3).alias("status"))


_DONORS_SQL = "[{'residual': hand, 'method': CASE WHEN cand % 2 = 0 THEN 'local' ELSE 'global' END, 'dx': motion, 'dy': glare}, {'residual': CASE WHEN cand % 3 = 0 THEN 'NaN'::DOUBLE ELSE distortion END, 'method': 'local', 'dx': exposure, 'dy': clipping}]"


@query(
    f"""
WITH {CANDIDATES_SQL}, parts AS (
  SELECT spread, [{{'donors': {_DONORS_SQL}}}, {{'donors': CASE WHEN cand % 5 = 0 THEN [] ELSE {_DONORS_SQL}[1:1] END}}] AS components, spread * 100 + cand AS id FROM candidates
), flat AS (
  SELECT id, i, d FROM (SELECT id, i, unnest(components[i].donors) AS d FROM parts, range(1, 3) t(i))
)
SELECT id, round(max(d.residual) FILTER (isfinite(d.residual)), 9) AS max_residual, round(max(sqrt(d.dx * d.dx + d.dy * d.dy)) FILTER (d.method = 'local'), 9) AS max_shift,
  count(DISTINCT CASE WHEN d.method = 'local' THEN i END) AS n_local FROM flat GROUP BY id
"""
)
def repair_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest finite residual and local shift over nested components and donors."""
    c = F.col

    def donor(residual, method, dx, dy):
        return F.struct(residual.alias("residual"), method.alias("method"), dx.alias("dx"), dy.alias("dy"))

    one = donor(c("hand"), F.when(c("cand") % 2 == 0, "local").otherwise("global"), c("motion"), c("glare"))
    two = donor(F.when(c("cand") % 3 == 0, float("nan")).otherwise(c("distortion")), F.lit("local"), c("exposure"), c("clipping"))
    second = F.when(c("cand") % 5 == 0, F.array_repeat(one, 0)).otherwise(F.array(one))
    parts = candidates(spark, sf_dir).select(
        (c("spread") * 100 + c("cand")).alias("id"), F.array(F.struct(F.array(one, two).alias("donors")), F.struct(second.alias("donors"))).alias("components")
    )
    return parts.select(
        "id",
        F.round(verdicts.largest_residual(c("components")), 9).alias("max_residual"),
        F.round(verdicts.largest_shift(c("components")), 9).alias("max_shift"),
        verdicts.local_components(c("components")).alias("n_local"),
    )


@query(
    f"""
WITH {CANDIDATES_SQL}, checks AS (
  SELECT 'sharp' AS name, sharpness >= 100 AS passed FROM candidates UNION ALL SELECT 'still', motion <= 0.05::DOUBLE FROM candidates UNION ALL SELECT 'whole', clipping < 1 FROM candidates
)
SELECT name, count(*) FILTER (passed) AS n_passed, count(*) AS n_checks, bool_and(passed) AS all_passed FROM checks GROUP BY name
"""
)
def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passed checks by name."""
    c = F.col
    named = F.array(
        F.struct(F.lit("sharp").alias("name"), (c("sharpness") >= 100).alias("passed")),
        F.struct(F.lit("still").alias("name"), (c("motion") <= 0.05).alias("passed")),
        F.struct(F.lit("whole").alias("name"), (c("clipping") < 1).alias("passed")),
    )
    return verdicts.check_summary(candidates(spark, sf_dir).select(F.inline(named)), "name")


@query(
    f"""
WITH {CANDIDATES_SQL}, clipped AS (
  SELECT spread, cand, greatest(0, least(1, 1 - motion / 0.025::DOUBLE)) AS still, greatest(0, least(1, ln(1 + greatest(sharpness, 0)) / 8)) AS sharp, greatest(0, least(1, 1 - cand / 5)) AS early,
    1 - exposure AS confidence, distortion, (1000 + cand * 100)::INT AS width, (700 + spread % 13)::INT AS height, exposure FROM candidates
)
SELECT spread, cand, round(0.58::DOUBLE * confidence + 0.22::DOUBLE * still + 0.12::DOUBLE * sharp + 0.08::DOUBLE * early, 9) AS reference_score,
  least(1100, width)::INT AS fitted_width, greatest(2, round_even(height * least(1100, width)::DOUBLE / width, 0))::INT AS fitted_height,
  round(distortion * distortion * (3 - 2 * distortion), 9) AS eased,
  round(CASE WHEN greatest(0, least(1, (0.96::DOUBLE - exposure * 2) * 0.9::DOUBLE)) < 0.015::DOUBLE THEN 0 ELSE greatest(0, least(1, (0.96::DOUBLE - exposure * 2) * 0.9::DOUBLE)) END, 9) AS strength
FROM clipped
"""
)
def derived_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of reference frames, fitted sizes and eased strengths."""
    c = F.col
    width, height = (1000 + c("cand") * 100).cast("int"), (700 + c("spread") % 13).cast("int")
    w, h = verdicts.fitted_size(width, height, 1100)
    rows = candidates(spark, sf_dir).withColumns({"confidence": 1 - c("exposure"), "t": c("cand").cast("double")})
    return rows.select(
        "spread",
        "cand",
        F.round(verdicts.reference_score(F.lit(0.0), 5.0, 0.025), 9).alias("reference_score"),
        w.alias("fitted_width"),
        h.alias("fitted_height"),
        F.round(verdicts.smoothstep(c("distortion")), 9).alias("eased"),
        F.round(verdicts.strength_from_ratio(c("exposure") * 2), 9).alias("strength"),
    )


@query(
    f"""
WITH {REVIEW_PAGES_SQL}, leveled AS (
  SELECT page, CASE WHEN page % 3 = 0 THEN MAP {{'crop': page % 10}} ELSE MAP {{}}::MAP(VARCHAR, BIGINT) END AS own, CASE WHEN spread % 2 = 0 THEN MAP {{'crop': 100 + spread % 10, 'spine': spread % 7}} ELSE MAP {{}}::MAP(VARCHAR, BIGINT) END AS shared FROM review_pages
)
SELECT page, coalesce(own['crop'], shared['crop'], 50) AS crop, coalesce(own['spine'], shared['spine'], 7) AS spine FROM leveled
"""
)
def page_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of a page by its own value, that of its spread, or the default."""
    none = F.create_map().cast("map<string,bigint>")
    own = F.when(F.col("page") % 3 == 0, F.create_map(F.lit("crop"), F.col("page") % 10)).otherwise(none)
    shared = F.when(F.col("spread") % 2 == 0, F.create_map(F.lit("crop"), 100 + F.col("spread") % 10, F.lit("spine"), F.col("spread") % 7)).otherwise(none)
    rows = review_pages(spark, sf_dir).withColumns({"own": own, "shared": shared})
    return rows.select("page", verdicts.resolved("crop", "own", "shared", default=50).cast("long").alias("crop"), verdicts.resolved("spine", "own", "shared", default=7).cast("long").alias("spine"))


@query(
    f"""
WITH {CANDIDATES_SQL}, odd AS (
  SELECT spread, cand, motion, sharpness, CASE WHEN cand % 4 = 0 THEN 'NaN'::DOUBLE WHEN cand % 4 = 1 THEN NULL ELSE hand END AS first_value, CASE WHEN cand % 3 = 0 THEN 'Infinity'::DOUBLE ELSE glare END AS second_value FROM candidates
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY spread ORDER BY motion, -sharpness, cand) AS place FROM odd
)
SELECT spread, cand, CASE WHEN first_value IS NOT NULL AND isfinite(first_value) THEN first_value WHEN isfinite(second_value) THEN second_value END AS value,
  (max(cand) OVER (PARTITION BY spread) + 1)::BIGINT AS next_id, place = 1 AS is_peer FROM ranked
"""
)
def finite_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first finite of two measures, the next free number of a spread and its quietest candidate."""
    c, g = F.col, W.partitionBy("spread")
    odd = candidates(spark, sf_dir).withColumns(
        {
            "first_value": F.when(c("cand") % 4 == 0, float("nan")).when(c("cand") % 4 == 1, None).otherwise(c("hand")),
            "second_value": F.when(c("cand") % 3 == 0, float("inf")).otherwise(c("glare")),
        }
    )
    peer = F.min(F.struct("motion", (-c("sharpness")).alias("minus"), "cand")).over(g)["cand"]
    return odd.select("spread", "cand", merges.first_finite("first_value", "second_value").alias("value"), (F.max("cand").over(g) + 1).alias("next_id"), (peer == c("cand")).alias("is_peer"))


_CORNERS = [f"{a}{i}" for i in range(4) for a in "xy"]
_APART_SQL = " + ".join(f"sqrt((k.x{i} - q.x{i}) * (k.x{i} - q.x{i}) + (k.y{i} - q.y{i}) * (k.y{i} - q.y{i}))" for i in range(4))


@query(
    f"""
WITH {QUADS_SQL}, sorted AS (
  SELECT spread, list({{'confidence': confidence * 0.32::DOUBLE, 'id': id, {", ".join(f"'{c}': {c}" for c in _CORNERS)}}} ORDER BY confidence DESC, id) AS qs FROM quads GROUP BY spread
), kept AS (
  SELECT spread, list_reduce(list_transform(qs, lambda q: [q]), lambda ks, one: CASE WHEN len(list_filter(ks, lambda k: ({_APART_SQL.replace("q.", "one[1].")}) / 4 < 0.025::DOUBLE)) = 0 THEN list_concat(ks, one) ELSE ks END) AS ks FROM sorted
)
SELECT spread, len(ks)::INT AS n_distinct, ks[1].id AS best, ks[2].id AS runner_up, coalesce(round(ks[1].confidence - ks[2].confidence, 9) <= 0.035::DOUBLE, false) AS ambiguous,
  array_to_string(list_transform(ks[1:3], lambda k: k.id), ',') AS top FROM kept
"""
)
def distinct_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals of a spread that differ from all better ones; the best, the runner-up and whether they are hard to tell apart.

    A confidence of quarters of a hundredth has many pairs at the very margin.
    """
    return proposals.distinct(_quads(spark, sf_dir).withColumn("confidence", F.col("confidence") * 0.32), "spread")

