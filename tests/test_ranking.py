import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordering, ranking, review
from tidemark.plans.config import Config

ROWS = "grp long, cand long, selection_score double, focus double, hand double, motion double, glare double, suspect array<string>"


def chosen(spark, rows):
    return ranking.choose(spark.createDataFrame(rows, ROWS), ["grp"]).first().cand


def test_hand_wins_at_comparable_focus(spark):
    rows = [(1, 0, 0.9, 0.78, 0.11, 0.01, 0.0, []), (1, 1, 0.75, 0.75, 0.01, 0.02, 0.0, [])]
    assert chosen(spark, rows) == 1


def test_hand_loses_to_blur(spark):
    assert chosen(spark, [(1, 0, 0.9, 0.8, 0.12, 0.01, 0.0, []), (1, 1, 0.5, 0.2, 0.0, 0.01, 0.0, [])]) == 0


def test_readable_beats_risky(spark):
    rows = [(1, 0, 9.0, 0.8, None, 0.01, 0.0, ["high_motion"]), (1, 1, 5.0, 0.8, None, 0.01, 0.0, [])]
    assert chosen(spark, rows) == 1
    assert chosen(spark, [(*r[:-1], ["high_motion"]) for r in rows]) == 0


def test_unknown_hands_keep_the_best(spark):
    assert chosen(spark, [(1, 0, 0.9, 0.8, None, 0.1, None, []), (1, 1, 0.9, 0.8, None, 0.1, None, [])]) == 0


def test_mid_rank(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (1, None), (1, 5.0), (2, 7.0), (3, 4.0), (3, 4.0)], "g long, x double")
    got = sorted(tuple(r) for r in df.select("g", "x", ranking.mid_rank("x", ["g"], True).alias("r")).na.fill(-1.0).collect())
    assert got == [(1, -1.0, -1.0), (1, 1.0, 0.0), (1, 2.0, 0.5), (1, 2.0, 0.5), (1, 5.0, 1.0), (2, 7.0, 0.5), (3, 4.0, 0.5), (3, 4.0, 0.5)]


def test_fallback_needs_all(spark):
    one = [(1, ["low_sharpness"]), (1, ["high_motion"])]
    f = lambda rows: ranking.fallback_reasons(spark.createDataFrame(rows, "g long, suspect array<string>"), ["g"], ranking.RECOVERABLE).first().reasons
    assert f([*one, (1, [])]) == []
    assert f([*one, (1, ["glare_overlap"])]) == ["glare_overlap", "high_motion", "low_sharpness"]


def test_page_count(spark):
    pages = spark.createDataFrame(
        [("p", "spread", True), ("p", "external", True), ("p", "left", False), ("p", "cover", True)], "project string, side string, enabled boolean"
    )
    row = review.page_count_check(pages, F.lit(4)).first()
    assert (row.status, row.actual, row.output_items, row.difference) == ("match", 4, 3, 0)
    assert review.page_count_check(pages, F.lit(10), F.lit(False)).first().status == "pending"


def test_duplicate_promotion(spark):
    kind = "grp long, item long, hand double, focus double, hard array<string>, repair array<string>"
    f = lambda *rows: [r.promote for r in review.duplicate_promotion(spark.createDataFrame(list(rows), kind)).orderBy("newer").collect()]
    assert f((1, 1, 0.11, 0.9, [], ["finger_repair_incomplete"]), (1, 2, 0.006, 0.9, [], []), (1, 3, 0.008, 0.9, [], [])) == [True, False]
    assert f((1, 1, 0.11, 0.9, [], []), (1, 2, 0.0, 0.5, [], [])) == [False]
    assert f((1, 1, 0.11, 0.9, [], []), (1, 2, 0.0, 0.9, ["low_sharpness"], [])) == [False]
    assert f((1, 1, 0.11, 0.9, [], []), (1, 2, None, 0.9, [], [])) == [False]


@pytest.mark.parametrize("bad", [{"stable_frames": True}, {"stable_frames": 1}, {"turn_threshold": 0.001}, {"motion_weight": -1.0}, {"candidate_selection_mode": "x"}])
def test_config(bad):
    with pytest.raises(ValueError):
        Config(**bad).checked()
    Config().checked()


def test_mid_rank_leaves_out_what_is_not_finite(spark):
    rows = [(1, 1.0), (1, float("nan")), (1, 3.0), (1, float("inf")), (1, float("-inf")), (1, None), (1, 2.0)]
    df = spark.createDataFrame(rows, "g long, x double")
    got = {str(r.x): r.r for r in df.select("x", ranking.mid_rank("x", ["g"], False).alias("r")).collect()}
    assert got == {"1.0": 1.0, "2.0": 0.5, "3.0": 0.0, "nan": None, "inf": None, "-inf": None, "None": None}


def test_all_measures_share_one_shuffle(spark):
    from tidemark import catalog

    plan = catalog.relative_scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    plan = catalog.safe_fix_suggestions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_places_number_every_row(spark):
    rows = [(i * 7919 % 5003, "same" if i % 2 else f"k{i % 11}") for i in range(5003)]
    frame = spark.createDataFrame(rows, "id long, key string").repartition(7).withColumn("_at", F.lit(1))
    placed = ordering.in_order(frame, [F.col("key"), F.col("id")], total="all", sums={"id": "before"}).orderBy("place").collect()
    want, before = [], 0
    for n, (k, i) in enumerate(sorted((k, i) for i, k in rows)):
        want.append((i, k, n, 5003, before))
        before += i
    assert [(r.id, r.key, r.place, r["all"], r.before) for r in placed] == want
    few = ordering.in_order(frame, [F.col("key"), F.col("id")], total="all", sums={"id": "before"}, rows=5003).orderBy("place").collect()
    assert [(r.id, r.key, r.place, r["all"], r.before) for r in few] == want
    assert ordering.in_order(frame.limit(0), [F.col("key"), F.col("id")]).count() == 0


def test_every_page_has_a_place(spark):
    from tidemark import catalog_more

    places = [r.place for r in catalog_more.natural_order(spark, "/root/testdata/sf0.1").select("place").orderBy("place").collect()]
    assert places == list(range(1, 2501))


def test_adjacent_duplicates_pass_over_what_is_switched_off(spark):
    pages = spark.createDataFrame(
        [("p", 1, 0, 0b1111, True), ("p", 2, 1, 0b0000, False), ("p", 3, 2, 0b1110, True), ("p", 4, 3, None, True), ("p", 5, 4, 0b1110, True), ("q", 6, 0, 0b1110, True)],
        "project string, id long, position long, hash long, enabled boolean",
    )
    assert [(r.id, r.distance) for r in review.adjacent_duplicates(pages, 2).collect()] == [(3, 1)]
