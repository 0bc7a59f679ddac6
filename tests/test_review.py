import pytest
from pyspark.sql import functions as F

from tidemark.operators import edits, merges, prefilter, verdicts

EVENTS = "project string, seq long, action string, page long, number long, pages array<long>"


def replayed(spark, log, n=4):
    pages = spark.createDataFrame([("p", i, i, i // 2, i != 3) for i in range(n)], "project string, page long, position long, spread long, enabled boolean")
    events = spark.createDataFrame([("p", s, *e) for s, e in enumerate(log)], EVENTS)
    after = edits.replay(pages, events).orderBy("position").collect()
    said = [r.status for r in edits.replay(pages, events, statuses=True).orderBy("seq").collect()]
    return [r.page for r in after], {r.page for r in after if not r.enabled}, said


def test_moves_are_clamped_and_undone(spark):
    order, off, said = replayed(spark, [("move", 0, 9, None), ("move", 0, 1, None), ("toggle", 3, None, None), ("undo", None, None, None), ("undo", None, None, None), ("redo", None, None, None)])
    assert order == [1, 2, 3, 0] and off == {3} and said == ["applied", "unchanged", "applied", "applied", "applied", "applied"]


def test_a_new_edit_clears_redo(spark):
    order, off, said = replayed(spark, [("toggle", 0, None, None), ("undo", None, None, None), ("swap", None, 1, None), ("redo", None, None, None)])
    assert order == [0, 1, 3, 2] and off == {3} and said[-1] == "unchanged"


def test_orders_must_list_every_page_once(spark):
    order, _, said = replayed(spark, [("reorder", None, None, [3, 2, 1, 0]), ("reorder", None, None, [3, 2, 1]), ("reorder", None, None, [3, 3, 1, 0]), ("reorder", None, None, [3, 2, 1, 0])])
    assert order == [3, 2, 1, 0] and said == ["applied", "rejected", "rejected", "unchanged"]


def test_added_pages_clear_the_history(spark):
    order, _, said = replayed(spark, [("toggle", 1, None, None), ("add", 9, 1, None), ("undo", None, None, None), ("add", 9, 0, None), ("toggle", 77, None, None), ("swap", None, 9, None)])
    assert order == [0, 9, 1, 2, 3] and said == ["applied", "applied", "unchanged", "rejected", "rejected", "rejected"]


def test_history_holds_thirty_steps(spark):
    order, off, said = replayed(spark, [("toggle", 0, None, None)] * 41 + [("undo", None, None, None)] * 31)
    assert said[-1] == "unchanged" and said[-2] == "applied" and off == {0, 3}


@pytest.mark.parametrize(
    ("hashes", "roles"),
    [
        ([0, 0, 0], "ppp"),
        ([0, 0, 0, 0, 0], "pspsp"),
        ([0, 0, 255, 255, 0, 255], "srsppp"),
        ([0, 255, 0, 255, 0], "rprpp"),
    ],
)
def test_plan_of_look_alikes(spark, hashes, roles):
    rows = spark.createDataFrame([(1, i, h, float(10 * (i % 2) + i)) for i, h in enumerate(hashes)], "g long, idx long, hash long, score double")
    plan = prefilter.candidate_plan(rows, ["g"], 3, 2).orderBy("idx").collect()
    assert "".join(r.role[0] for r in plan) == roles
    reps = [r.idx for r in plan if r.role != "suppressed"]
    assert [r.representative for r in plan] == [min((x for x in reps if x >= r.idx), default=reps[-1]) for r in plan]


def test_replacing_keeps_what_is_shown(spark):
    kind = "k long, v string, enabled boolean"
    old, new = spark.createDataFrame([(1, "a", False), (2, None, True)], kind), spark.createDataFrame([(1, None, True), (3, "c", True)], kind)
    assert [tuple(r) for r in merges.replace_by_key(old, new, ["k"], ["enabled"]).orderBy("k").collect()] == [(1, None, False), (2, None, True)]


def test_duplicates_take_over_only_where_one_is_shown(spark):
    rows = spark.createDataFrame([(1, None, True, False), (2, 1, False, False), (3, None, True, False), (4, 3, True, False), (5, None, True, True), (6, 5, False, False), (7, None, True, False)], "id long, duplicate_of long, enabled boolean, touched boolean")
    assert {r.root for r in merges.duplicate_groups(rows, []).where("open").collect()} == {1}


def test_zip_names_groups_of_unequal_length(spark):
    kind = "g long, position long, {} string"
    found = merges.zip_by_position(spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (2, 1, "c")], kind.format("l")), spark.createDataFrame([(1, 0, "x"), (2, 0, "y")], kind.format("r")), ["g"])
    assert {(r.g, r.complete) for r in found.collect()} == {(1, True), (2, False)}


def test_missing_measures_raise_no_code(spark):
    names = "edge_fraction edge_score glare luma_std white black whitened fill residual line_before line_after".split()
    kind = ", ".join(f"{n} double" for n in names) + ", normalised boolean, finger boolean, unresolved boolean"
    df = spark.createDataFrame([tuple([None] * 14), (0.9, 0.5, 0.0, 5.0, 0.99, 0.0, 0.1, 0.3, 0.2, 0.9, 0.5, False, False, True)], kind)
    got = [r.codes for r in df.select(verdicts.final_codes().alias("codes")).collect()]
    assert got == [[], ["final_edge_crop_suspected", "final_near_blank_white", "final_background_fill_large", "final_dewarp_line_regression"]]


def test_heights_are_rounded_half_to_even(spark):
    w, h = verdicts.fitted_size(F.col("w"), F.col("h"), 100)
    df = spark.createDataFrame([(200, 5), (200, 7), (400, 1), (50, 33)], "w int, h int")
    assert [tuple(r) for r in df.select(w, h).collect()] == [(100, 2), (100, 4), (100, 2), (50, 33)]
