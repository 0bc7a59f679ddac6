"""Settings, manifests, merges and verdicts of odd rows."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, merges, verdicts
from tidemark.plans import stages
from tidemark.plans.config import CHOICES, RANGES, Config
from tidemark.sources import projects
from tidemark.streaming import progress


@pytest.mark.parametrize("name", sorted(RANGES))
def test_ranges_are_closed(name):
    low, high = RANGES[name]
    kind = type(getattr(Config(), name))
    for value in (low - 1, high + 1):
        assert any(name in p for p in Config(**{name: kind(value)}).problems())
    assert not any(f"{name} must lie" in p for p in Config(**{name: kind(high)}).problems())


@pytest.mark.parametrize("given", [*[{name: "?"} for name in CHOICES], {"finger_repair": 1}, {"jpeg_quality": 9.0}, {"contrast": float("nan")}, {"unheard": 1}, {"hand_backend": "none", "finger_repair": True}, {"roi_tracking_max_total": 0.05}])
def test_wrong_settings_fail(given):
    with pytest.raises(ValueError):
        Config.of(given)


def test_what_is_left_out_depends_on_what_is_given(tmp_path):
    assert Config().page_background_fill == "paper" and Config.of({}).page_background_fill == "preserve"
    assert not Config.of({"hand_backend": "none"}).finger_repair
    assert not Config.of({"rotation": 90}).auto_rotation and Config.of({"rotation": 0}).auto_rotation
    assert Config.of({"rotation": 90, "auto_rotation": True}).auto_rotation
    (tmp_path / "c.toml").write_text('pdf_dpi = 150\nhand_model = "m.task"')
    found = Config.load(str(tmp_path / "c.toml"))
    assert found.pdf_dpi == 150 and found.hand_model == str(tmp_path / "m.task")


def _manifests(spark, folder, **books):
    for name, book in books.items():
        (folder / name).mkdir()
        (folder / name / "manifest.json").write_text(json.dumps(book))
    return projects.read_manifests(spark, str(folder / "*/manifest.json"))


def test_older_manifests_keep_their_meaning(spark, tmp_path):
    read = _manifests(
        spark,
        tmp_path,
        first={"source": "a"},
        second={"version": 2, "config": {"dewarp_strength": 0.2, "finger_repair": True}},
        third={"version": 3, "config": {"image_format": "jpeg"}},
    )
    found = {r.project: r for r in read.collect()}
    assert {r.version for r in found.values()} == {3}
    assert found["first"].config["output_layout"] == "split" and found["first"].config["dewarp_mode"] == "off" and found["first"].pages == []
    assert found["second"].config["dewarp_mode"] == "manual" and found["second"].config["finger_repair"] == "true"
    assert found["third"].config == {"image_format": "jpeg"}


def test_newer_manifests_fail(spark, tmp_path):
    with pytest.raises(Exception, match="unknown manifest version 4"):
        _manifests(spark, tmp_path, book={"version": 4}).collect()


def test_catalog_names_sources(spark, tmp_path):
    read = _manifests(
        spark,
        tmp_path,
        one={"source": "/v/a.mov", "status": "ready", "pages": [{"id": "p"}]},
        two={"source": "/v/a.mov", "sources": ["/v/a.mov", "/v/b.mov"], "status": "ready"},
        pics={"source": "/v/folder", "source_type": "image_folder", "status": "new", "pages": [{"id": "p"}, {"id": "q"}]},
    )
    found = {r.project: (r.source_name, r.status, r.n_pages) for r in projects.catalog_of(read).collect()}
    assert found == {"one": ("a.mov", "ready", 1), "two": ("a.mov +1", "ready", 0), "pics": ("folder (2枚)", "new", 2)}
    projects.write_manifests(read, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).where("project = 'pics'").first().version == 3


def test_checkpoints_and_suffixes(spark, tmp_path):
    (tmp_path / "i.json").write_text('[{"start": 1, "end": 2.5}, {"start": 3, "end": 4}]')
    assert [(r.start, r.end) for r in projects.interval_records(spark, str(tmp_path / "i.json")).orderBy("start").collect()] == [(1, 2.5), (3, 4)]
    paths = spark.createDataFrame([("/a/b.MOV",), ("/a.mp4/c",), ("d.mp4",), (None,), ("mp4",)], "path string")
    assert sorted(r.path for r in projects.video_paths(paths).collect()) == ["/a/b.MOV", "d.mp4"]


SIDES = "g int, side string, newer boolean, hand double, focus double, hard array<string>, repair array<string>"


@pytest.mark.parametrize(
    ("new", "prefer"),
    [
        ([("left", 0.01, 0.9, [], [])], True),
        ([("left", 0.095, 0.9, [], [])], False),
        ([("left", 0.01, 0.5, [], [])], False),
        ([("left", 0.01, 0.9, ["high_motion"], [])], False),
        ([("left", float("nan"), 0.9, [], [])], False),
        ([("left", None, 0.9, [], [])], False),
        ([("right", 0.01, 0.9, [], [])], False),
        ([("left", 0.01, 0.9, [], ["a", "b"])], False),
        ([("left", 0.104, 0.9, [], [])], True),
        ([], False),
    ],
)
def test_newer_copies_must_be_cleaner(spark, new, prefer):
    old = [(1, "left", False, 0.1, 0.9, [], ["a"])]
    if new and new[0][1] == 0.095:
        old = [(1, "left", False, 0.1, 0.9, [], [])]
    rows = spark.createDataFrame(old + [(1, n[0], True, *n[1:]) for n in new], SIDES)
    (got,) = merges.prefer_newer(rows, ["g"], "side").collect()
    assert got.prefer is prefer


def test_new_layouts_stand_where_the_old_one_stood(spark):
    pages = spark.createDataFrame([("p", 1, 0, 1, False), ("p", 2, 1, 2, False), ("p", 3, 2, 2, True), ("p", 4, 3, 3, True)], "project string, page long, position long, spread long, enabled boolean")
    fresh = spark.createDataFrame([("p", 2, 20), ("p", 2, 21), ("p", 2, 22)], "project string, spread long, page long")
    saved = spark.createDataFrame([("p", 22, 0, False)], "project string, page long, place long, enabled boolean")
    got = merges.relaid(pages, fresh, saved).orderBy("position").collect()
    assert [(r.page, r.enabled) for r in got] == [(1, False), (22, False), (20, True), (21, True), (4, True)]


def test_choices_that_do_not_exist_are_rejected(spark):
    known = spark.createDataFrame([("s", 1), ("s", 2)], "g string, k int")
    events = spark.createDataFrame([("s", 1, 1), ("s", 2, 9), ("t", 1, 1)], "g string, seq int, k int")
    got = {r.g: (r.chosen, r.n_rejected) for r in merges.last_valid(events, known, ["g"], "k", "seq").collect()}
    assert got == {"s": (1, 1), "t": (None, 1)}


def test_limits_of_odd_durations(spark):
    rows = spark.createDataFrame([("a", 10, 10, None), ("a", 10, 10, float("nan")), ("a", 10, 10, 60.0), ("b", 8193, 10, 60.0), ("b", 7000, 7000, 50.0)], "g string, width int, height int, duration double")
    got = rows.select("g", "duration", verdicts.input_limits(["g"], 100.0, 8192, 40_000_000).alias("c")).collect()
    found = sorted((r.g, ",".join(r.c)) for r in got)
    assert found == [("a", ""), ("a", "duration_invalid"), ("a", "duration_invalid"), ("b", "dimension_limit,total_duration_limit"), ("b", "pixel_limit,total_duration_limit")]


def test_images_of_little_contrast_are_no_duplicates(spark):
    rows = spark.createDataFrame([(0, 1.0, [1.0, 1.0], 7.0, None), (0, 1.0, [1.0, 0.9], 9.0, None), (9, 0.5, [0.5, 0.5], 9.0, (True, True)), (0, 1.0, [1.0, 1.0], 9.0, None)], "hash_distance int, ssim double, half_ssim array<double>, contrast double, alignment struct<duplicate: boolean, suspect: boolean>")
    got = rows.select(*[v.alias(k) for k, v in verdicts.same_content(4, 0.985, 0.94).items()]).collect()
    assert [(r.duplicate, r.suspect) for r in got] == [(False, True), (False, True), (True, True), (True, True)]
    assert rows.where(F.col("contrast") < 8).count() == 1


def test_requests_keep_repeats_and_gaps(spark):
    asks = spark.createDataFrame([("k", 0, 2.0), ("k", 1, 1.5), ("k", 2, 2.0), ("k", 3, 9.0), ("none", 4, 1.0)], "k string, place int, asked double")
    frames = spark.createDataFrame([("k", 2.0, 7), ("k", 2.0, 5), ("k", 1.0, 1)], "k string, t double, idx int")
    got = asof.first_at_or_after(asks, frames, ["k"], "asked", "t", "idx", "f").orderBy("place").collect()
    assert [r.f.idx if r.f else None for r in got] == [5, 5, 5, None, None]


def test_stages_run_once_for_the_same_settings(spark, tmp_path):
    ran = []

    def build():
        ran.append(1)
        return spark.range(len(ran))

    counts = [stages.resumed(spark, str(tmp_path), "s", settings, build).count() for settings in ("a", "a", "b", "a")]
    assert counts == [1, 1, 2, 1] and len(ran) == 2
    # A table without the mark of a whole job is written again.
    for mark in tmp_path.glob("s-*/*SUCCESS*"):
        mark.unlink()
    assert stages.resumed(spark, str(tmp_path), "s", "a", build).count() == 3


def test_progress(spark, tmp_path):
    rows, seen = progress.observed(spark.createDataFrame([(1.0,), (3.0,)], "t double"))
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"n_rows": 2, "latest": 3.0}
    told = []
    listener = progress.Progress(lambda *x: told.append(x))
    spark.createDataFrame([(1.0,), (5.0,)], "t double").write.parquet(str(tmp_path / "in"))
    spark.streams.addListener(listener)
    try:
        stream = progress.reporting(spark.readStream.schema("t double").parquet(str(tmp_path / "in")))
        run = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        run.awaitTermination(60)
        deadline = time.time() + 20
        while not told and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert told and told[0][1:] == (2, 5.0)
