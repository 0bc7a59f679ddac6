"""Project files, measured series and resumable stages on disk."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import proposals
from tidemark.plans import stages
from tidemark.sources import projects, series

NAMES = ["a", "b c", "a=b", "50%", "a+b", "日本", "x/y", "q?#[1]", "%41"]


def manifests(spark, tmp_path, names, pages=2):
    for i, name in enumerate(names):
        folder = tmp_path / "made" / str(i)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "manifest.json").write_text(json.dumps({"version": 3, "source": name, "pages": [{"id": f"p{k}"} for k in range(pages)]}))
    read = projects.read_manifests(spark, str(tmp_path / "made/*/manifest.json"))
    return read.withColumn("project", F.col("source"))


def stored(spark, path):
    return {r.project: (r.source, len(r.pages)) for r in projects.read_manifests(spark, f"{path}/*/*.json").collect()}


def test_saving_one_project_leaves_the_others(spark, tmp_path):
    path = str(tmp_path / "out")
    projects.write_manifests(manifests(spark, tmp_path, NAMES), path)
    assert stored(spark, path) == {n: (n, 2) for n in NAMES}
    changed = manifests(spark, tmp_path, NAMES, pages=5)
    projects.write_manifests(changed.where("project = 'a'"), path)
    assert stored(spark, path) == {n: (n, 5 if n == "a" else 2) for n in NAMES}
    for name in NAMES[2:]:
        assert projects.remove_project(spark, path, name)
    assert set(stored(spark, path)) == {"a", "b c"} and not projects.remove_project(spark, path, "a=b")


def test_a_failed_save_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    projects.write_manifests(manifests(spark, tmp_path, ["a", "b"]), path)
    bad = manifests(spark, tmp_path, ["a", "b"], pages=7).withColumn("version", F.when(F.col("project") == "b", 9).otherwise(F.col("version")))
    with pytest.raises(Exception, match="unknown manifest version"):
        projects.write_manifests(bad.coalesce(1), path)
    assert stored(spark, path) == {"a": ("a", 2), "b": ("b", 2)}


def test_score_tables_may_be_missing(spark, tmp_path):
    path = str(tmp_path / "scores")
    assert projects.read_score_rows(spark, path).collect() == []
    rows = spark.createDataFrame([(1, "x"), (2, None)], "id int, name string")
    projects.write_score_rows(rows, path)
    projects.write_score_rows(rows.where("false"), path)
    assert sorted(map(tuple, projects.read_score_rows(spark, path).collect()), key=str) == [("1", "x"), ("2", None)]


def test_natural_order_of_long_numbers_and_letters(spark):
    want = ["", "1", "02a", "10", "p", "p1", "p001x", "p" + "9" * 22, "p1" + "0" * 24, "p1" + "0" * 24 + "b", "P!", "pa", "STRASSE 2", "straße 10"]
    rows = spark.createDataFrame([(w,) for w in reversed(want)], "w string")
    assert [r.w for r in rows.orderBy(text.natural_key(F.col("w")), "w").collect()] == want
    assert rows.select(text.natural_key(F.lit(None).cast("string")).alias("k")).first().k is None


def test_a_lead_of_the_margin_is_no_clear_one(spark):
    def quad(x):
        return [x, 0.1, x + 0.5, 0.1, x + 0.5, 0.9, x, 0.9]

    columns = "key long, id long, confidence double, " + ", ".join(f"{a}{i} double" for i in range(4) for a in "xy")
    rows = [(1, 1, 0.7, *quad(0.1)), (1, 2, 0.665, *quad(0.2)), (1, 3, 0.69, *quad(0.101)), (2, 4, 0.7, *quad(0.1)), (2, 5, 0.66499, *quad(0.2)), (3, 6, None, *quad(0.1)), (3, 7, 0.1, *quad(0.3))]
    got = {r.key: (r.n_distinct, r.best, r.runner_up, r.ambiguous, r.top) for r in proposals.distinct(spark.createDataFrame(rows, columns), "key").collect()}
    assert got == {1: (2, 1, 2, True, "1,2"), 2: (2, 4, 5, False, "4,5"), 3: (2, 7, 6, False, "7,6")}


def test_series_are_read_by_windows(spark, tmp_path):
    path = str(tmp_path / "series")
    rows = spark.createDataFrame([(e, float(t), t % 5) for e in range(3) for t in range(1000)] + [(0, None, 1)], "entity long, t double, v int")
    series.write_series(rows, path, 100.0)
    windows = spark.createDataFrame([(0, 105.0, 110.0), (1, 399.0, 401.0), (2, 9.0, 3.0)], "entity long, window_start double, window_end double")
    read = series.read_windows(spark, path, windows, 100.0)
    assert {int(r.t) // 100 for r in read.select("t").distinct().collect()} == {1, 3, 4}
    assert read.count() == 900
    assert {f.split("slot=")[1].split("/")[0] for f in read.inputFiles()} >= {"1", "3", "4"}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [slot" in plan
    assert series.read_windows(spark, path, windows.where("false"), 100.0).count() == 0
    assert {int(r.t) // 100 for r in series.read_windows(spark, path, windows.limit(1), 100.0, margin=10.0).select("t").distinct().collect()} == {0, 1}


def test_a_killed_job_makes_only_what_is_missing(spark, tmp_path):
    made = []

    def build(rows, fail=lambda keys: False):
        keys = sorted((r.k is not None, r.k or 0) for r in rows.select("k").distinct().collect())
        if fail(keys):
            raise RuntimeError("killed")
        made.extend(k for _, k in keys)
        return rows.groupBy("k").agg(F.sum("v").alias("total"))

    def inputs(**changed):
        return spark.createDataFrame([(k, changed.get(f"k{k}", 1) + i) for k in range(12) for i in range(3)] + [(None, 5)], "k int, v int")

    def resumed(df, settings="s", **kw):
        return sorted(map(tuple, stages.resumed_by_key(spark, str(tmp_path), "totals", df, ["k"], settings, lambda r: build(r, **kw), parts=4).collect()), key=str)

    calls = []

    def third(keys):
        calls.append(keys)
        return len(calls) == 3

    with pytest.raises(RuntimeError, match="killed"):
        resumed(inputs(), fail=third)
    first = set(made)
    assert 0 < len(first) < 13
    made.clear()
    want = sorted([(k, 6) for k in range(12)] + [(None, 5)], key=str)
    assert resumed(inputs()) == want
    assert set(made) == ({*range(12)} | {0}) - first or set(made) | first >= set(range(12)) and not set(made) & (first - {0})
    made.clear()
    assert resumed(inputs()) == want and made == []
    # Changed inputs of one key, then other settings, then keys that went.
    assert resumed(inputs(k7=10)) == sorted([(k, 33 if k == 7 else 6) for k in range(12)] + [(None, 5)], key=str) and made == [7]
    made.clear()
    assert resumed(inputs()) == want and made == []
    assert resumed(inputs(), settings="t") == want and len(made) == 13
    assert resumed(inputs().where("k < 3")) == [(0, 6), (1, 6), (2, 6)]
    assert stages.resumed_by_key(spark, str(tmp_path), "none", inputs().where("false"), ["k"], "s", build).collect() == []


def test_new_projects_take_no_others_place(spark, tmp_path):
    path = str(tmp_path / "out")
    projects.create_project(manifests(spark, tmp_path, ["a", "x/y"]), path)
    more = manifests(spark, tmp_path, ["b", "x/y"], pages=9)
    with pytest.raises(FileExistsError, match="x/y"):
        projects.create_project(more, path)
    assert stored(spark, path) == {"a": ("a", 2), "x/y": ("x/y", 2)}
    with pytest.raises(ValueError, match="needs a name"):
        projects.create_project(more.withColumn("project", F.lit(None).cast("string")), path)


def test_only_own_exports_are_replaced(spark):
    paths = ["output/a.pdf", "output/A.PDF", "./output//b.pdf", "output/.pdf", "/output/a.pdf", "output/../a.pdf", "output/x/a.pdf", "other/a.pdf", "output/a.cbz", "output/..", None, ""]
    got = projects.managed_exports(spark.createDataFrame([(p,) for p in paths], "path string"), ".pdf")
    assert [r.path for r in got.collect()] == paths[:3]


def test_empty_results_can_be_errors(spark):
    assert projects.some_rows(spark.range(2), "none").count() == 2
    with pytest.raises(ValueError, match="no stable intervals"):
        projects.some_rows(spark.range(0), "no stable intervals")


def test_page_counts_that_are_asked_for(spark):
    values = ["12", " +7 ", "", None, "0", "10001", "1.5", "x", "007", "99999999999999999999", "10000"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(projects.page_count(F.col("v")).alias("p")).select("p.*").collect()
    whole, between = "expected_page_count must be a positive integer", "expected_page_count must be 1..10000"
    assert [tuple(r) for r in got] == [(12, None), (7, None), (None, None), (None, None), (None, between), (None, between), (None, whole), (None, whole), (None, whole), (None, between), (10000, None)]


def test_book_metadata_and_what_becomes_of_it(spark):
    rows = [{"title": "  A \n b ", "author": "", "series": None}, None, {"titel": "x"}, {"language": "x" * 33}, {"volume": "1\x01"}, {"title": "A b"}]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, m map<string,string>").withColumn("b", projects.book_metadata(F.col("m")))
    old = F.create_map(F.lit("title"), F.lit("A b"))
    text = lambda c: F.map_entries(c).cast("string")
    got = df.orderBy("i").select("b.fields", "b.problem", projects.updated(text(old), text(F.col("b.fields")), F.col("b.problem")).alias("s")).collect()
    assert [r.fields for r in got] == [{"title": "A b"}, {}, None, None, None, {"title": "A b"}]
    assert [r.problem for r in got] == [None, None, "unknown book fields: titel", "book field language is too long", "book field volume has control characters", None]
    assert [r.s for r in got] == ["unchanged", "applied", "rejected", "rejected", "rejected", "unchanged"]


QUAD = [[0.1, 0.1], [0.9, 0.1], [0.9, 0.9], [0.1, 0.8]]


def corpus(**changed):
    sample = {"id": "s1", "time": 5.0, "expect_spread": True, "spread_quad": QUAD, "min_reference_iou": 0.5, **changed.pop("sample", {})}
    pair = {"id": "p1", "spread_quad": QUAD, "target_time": 1.0, "donor_times": [2.0], **changed.pop("pair", {})}
    video = {"id": "v1", "sha256": "a" * 64, "duration": 10.0, "expected_rotation": 90, "samples": [sample, {"id": "s2", "time": 1.0, "expect_spread": False}], "repair_pairs": [pair], **changed.pop("video", {})}
    return {"version": 1, "videos": [video], **changed}


@pytest.mark.parametrize(
    "changed, want",
    [
        ({}, []),
        ({"version": 2}, ["version must be 1"]),
        ({"videos": []}, ["no videos"]),
        ({"video": {"sha256": "A" * 64, "duration": 10.0, "expected_rotation": 45}}, ["expected_rotation must be 0, 90, 180 or 270", "sha256 must be 64 lowercase hexadecimal characters"]),
        ({"sample": {"id": "s2"}}, ["sample ids must be unique and not empty"] * 2),
        ({"sample": {"time": 9.8}}, ["consensus frames must be within the video"]),
        ({"sample": {"spread_quad": QUAD[::-1], "min_page_iou": 1.5, "consensus_offsets": [0.5, 0.5]}}, ["consensus_offsets must be finite and unique", "consensus_offsets must include 0", "consensus_offsets needs at least 3 values", "min_page_iou must be 0..1", "spread_quad must be a convex quad"]),
        ({"pair": {"donor_times": [], "target_time": 10.0}}, ["donor_times must be within the video", "target_time must be within the video"]),
    ],
)
def test_corpora_are_checked(spark, tmp_path, changed, want):
    from tidemark.sources import corpora

    (tmp_path / "cases.json").write_text(json.dumps(corpus(**changed)))
    found = corpora.problems(corpora.read_corpus(spark, str(tmp_path / "cases.json"))).collect()
    assert sorted(r.problem for r in found) == want


def test_detections_are_judged(spark, tmp_path):
    from tidemark.sources import corpora

    (tmp_path / "cases.json").write_text(json.dumps(corpus()))
    samples = corpora.samples_of(corpora.read_corpus(spark, str(tmp_path / "cases.json")))

    def passed(*quads):
        rows = spark.createDataFrame([("v1", i, q) for i, q in quads], "video string, id string, quad array<array<double>>")
        return {r.id: (r.detected, r.share, r.passed) for r in corpora.judged(samples, rows).collect()}

    assert passed(("s1", QUAD)) == {"s1": (True, 1.0, True), "s2": (False, None, True)}
    assert passed(("s1", [[x + 0.5, y] for x, y in QUAD]), ("s2", QUAD)) == {"s1": (True, pytest.approx(0.235, abs=0.05), False), "s2": (True, None, False)}
    assert passed()["s1"] == (False, None, False)


def test_patches_follow_what_earlier_ones_left(spark):
    from tidemark.operators import patches

    quad = json.dumps(QUAD)
    log = [
        ("left", {"page_quad_mode": "manual"}, "a manual contour needs manual_quad"),
        ("left", {"manual_quad": quad, "dewarp": "yes"}, "dewarp must be a boolean"),
        ("left", {"page_quad_mode": "manual"}, "a manual contour needs manual_quad"),
        ("left", {"manual_quad": quad}, None),
        ("left", {"page_quad_mode": "manual", "dewarp": "true"}, None),
        ("right", {"page_quad_mode": "manual"}, "a manual contour needs manual_quad"),
        ("left", {"page_quad_mode": "auto", "manual_quad": quad}, None),
        ("left", {"page_quad_mode": "manual"}, "a manual contour needs manual_quad"),
        ("cover", {"dewarp": "true"}, "no settings here"),
        ("spread", {"dewarp": "true"}, "dewarp is only available for left, right"),
        ("spread", {"spine_ratio": "0.8"}, "spine_ratio must be 0.25..0.75"),
        ("spread", {"spine_ratio": "0.4"}, None),
        ("spread", {"zoom": "1", "crop": "2"}, "unknown settings: crop, zoom"),
        ("right", {}, "no settings given"),
        ("right", {"manual_quad": json.dumps(QUAD[:3])}, "manual_quad must be a quad"),
        ("right", {"manual_quad": "null"}, "manual_quad must be a quad"),
        ("right", {"white_normalization": None}, "settings without a value: white_normalization"),
        ("left", {"dewarp": "false"}, None),
    ]
    df = spark.createDataFrame([(1, side, i, patch) for i, (side, patch, _) in enumerate(log)], "spread long, side string, seq long, settings map<string,string>")
    assert [r.reason for r in patches.judged(df).orderBy("seq").collect()] == [w for _, _, w in log]
    held = {(r.side, r.name): r.value for r in patches.settled(df).collect()}
    assert held == {("left", "page_quad_mode"): "auto", ("left", "dewarp"): "false", ("spread", "spine_ratio"): "0.4"}
