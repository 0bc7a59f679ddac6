import random

import pytest

from tidemark.operators import folds, segments

EVERY = "entity long, idx long, t double, motion double, sharpness double"


def trace(spark, motions, fps=10.0, sharpness=None, entity=1):
    sharpness = sharpness or [100.0] * len(motions)
    rows = [(entity, i, i / fps, float(m), float(s)) for i, (m, s) in enumerate(zip(motions, sharpness, strict=True))]
    return spark.createDataFrame(rows, EVERY)


def bounds(df):
    return [(r.first_idx, r.last_idx) for r in df.orderBy("start").collect()]


def test_stable_basic(spark):
    motions = [0.2, 0, 0, 0.02, 0, 0, 0, 0.005, 0.2, 0, 0, 0]
    assert bounds(segments.stable_intervals(trace(spark, motions), 0.01, 0.03, 3)) == [(4, 7), (9, 11)]


def test_too_short(spark):
    assert bounds(segments.stable_intervals(trace(spark, [1, 0, 0, 0, 0]), 0.01, 0.03, 5)) == []


def test_against_a_state_machine(spark):
    rng = random.Random(3)
    for entity in range(4):
        motions = [1.0] + [rng.choice([0.0, 0.005, 0.02, 0.05]) for _ in range(120)]
        want, pending, segment, stable = [], [], [], False
        for i, m in enumerate(motions):
            if i and m <= 0.01:
                (segment if stable else pending).append(i)
                if not stable and len(pending) >= 3:
                    stable, segment, pending = True, pending, []
            else:
                pending = []
                if stable and (i == 0 or m >= 0.03):
                    want.append((segment[0], segment[-1]))
                    stable, segment = False, []
        if stable:
            want.append((segment[0], segment[-1]))
        assert bounds(segments.stable_intervals(trace(spark, motions, entity=entity), 0.01, 0.03, 3)) == want


def test_bins_take_the_best(spark):
    samples = trace(spark, [1.0] + [0.0] * 100, sharpness=[0] + [500] * 10 + [100] * 90)
    picked = segments.binned_candidates(samples, 0.01, 0.03, 3, 7).orderBy("idx").collect()
    assert len(picked) == 7 and picked[-1].idx >= 85 and picked[0].idx == 1


TURNING = [1.0, *[0.006] * 5, 0.030, 0.050, 0.040, 0.017, 0.014, 0.016, 0.040, 0.050, 0.030, *[0.006] * 6]


def test_missing_between_turns(spark):
    samples = trace(spark, TURNING)
    assert segments.turn_events(samples, 0.012, 0.025, 10).count() == 2
    found = segments.missing_windows(samples, 0.012, 0.025, 5, 10).collect()
    assert [(r.time, r.motion, r.before, r.after) for r in found] == [(1.0, 0.014, 1, 2)]


def test_no_missing_where_stable(spark):
    motions = [1.0, *[0.006] * 5, 0.040, 0.050, 0.040, *[0.006] * 5, 0.040, 0.050, 0.040, *[0.006] * 2]
    samples = trace(spark, motions)
    assert segments.turn_events(samples, 0.012, 0.025, 10).count() == 2
    assert segments.missing_windows(samples, 0.012, 0.025, 5, 10).count() == 0


def test_noisy_turn_is_one_event(spark):
    motions = [1.0, 0.006, 0.006, 0.006, 0.040, 0.050, 0.023, 0.040, 0.045, 0.006, 0.006]
    (event,) = segments.turn_events(trace(spark, motions), 0.012, 0.025, 10).collect()
    assert event.peak_motion == 0.050 and event.id == "turn_0001"


def test_first_sample_is_no_turn(spark):
    assert segments.turn_events(trace(spark, [1.0, 0.005, 0.006, 0.005]), 0.012, 0.025, 10).count() == 0


def test_longest_low_run(spark):
    motions = [1.0, 0.005, 0.006, 0.030, 0.004, 0.004, 0.005, 0.005, 0.030]
    sharp = [100, 100, 110, 100, 90, 95, 100, 105, 100]
    (run,) = segments.longest_low_run(trace(spark, motions, 20, sharp), 0.012, 20, 0.18).collect()
    assert (run.n_samples, run.start) == (4, 0.2)
    assert segments.longest_low_run(trace(spark, motions[:4], 20, sharp[:4]), 0.012, 20, 0.18).count() == 0


@pytest.mark.parametrize(("starts", "want"), [([2, 4, 6, 8], []), ([2, 4, 8, 10], [6.0])])
def test_cadence_gaps(spark, starts, want):
    points = spark.createDataFrame([(1, i, float(s)) for i, s in enumerate(starts)], "entity long, interval int, start double")
    assert [r.time for r in segments.cadence_gaps(points).collect()] == want


def test_nms(spark):
    points = spark.createDataFrame([(1, 1.0, 0.9), (1, 1.3, 0.95), (1, 3.0, 0.8), (1, 5.0, 0.7)], "entity long, t double, score double")
    assert [r.t for r in folds.nms_topk(points, 3, 1.0).orderBy("place").collect()] == [1.3, 3.0, 5.0]
    assert folds.nms_topk(points, 0, 1.0).count() == 0


def test_span_groups(spark):
    windows = spark.createDataFrame([(1, 0.0, 0.4), (1, 0.6, 1.0), (1, 10.0, 10.4)], "entity long, start double, end double")
    assert [r.start for r in folds.span_groups(windows, 3, 24).orderBy("grp").collect()] == [0.0, 10.0]
    assert folds.span_groups(windows, 100, 100, 2).count() == 2


def test_edits_undo_and_redo(spark):
    def state(*actions):
        edits = spark.createDataFrame([(1, i, a) for i, a in enumerate(actions)], "entity long, turn long, action string")
        return tuple(folds.replay_edits(edits).select("enabled", "undo", "redo").first())

    assert state("toggle", "toggle") == (True, 2, 0)
    assert state("toggle", "undo") == (True, 0, 1)
    assert state("toggle", "undo", "redo") == (False, 1, 0)
    assert state("toggle", "undo", "toggle", "redo") == (False, 1, 0)
    assert state("undo", "redo") == (True, 0, 0)


def test_folds_stream_a_group_of_any_size(spark):
    rng = random.Random(9)
    rows = [(e, i, rng.choice([None, rng.getrandbits(6) - 32, -(1 << 63)])) for e, n in ((None, 50), (1, 6000), (2, 1)) for i in range(n)]
    want = []
    for entity in (None, 1, 2):
        roots = []
        for e, i, h in rows:
            if e == entity:
                near = [r for r, g in roots if h is not None and g is not None and bin((h ^ g) % 2**64).count("1") <= 2]
                want.append((e, i, near[0] if near else None))
                roots = roots if near else [(i, h), *roots][:3]
    shuffled = rng.sample(rows, len(rows))
    windows = [(1, float(i), i + 0.5) for i in range(5000)]
    intervals = [(1, float(i), i + 0.5, float(i // 10), float(i // 10)) for i in range(5000)]
    edits = [(1, i, "toggle" if i % 3 else "undo") for i in range(5001)]
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(size, "70")
    try:
        folded = [
            folds.window_dedupe(spark.createDataFrame(shuffled, "entity long, id long, hash long"), 2, 3),
            folds.span_groups(spark.createDataFrame(windows, "entity long, start double, end double"), 1, 9.5),
            folds.chain_premerge(spark.createDataFrame(intervals, "entity long, start double, end double, first_value double, last_value double"), 1, 0.5),
            folds.replay_edits(spark.createDataFrame(edits, "entity long, turn long, action string")),
            folds.nms_topk(spark.createDataFrame([(1, float(i), 1.0) for i in range(5000)], "entity long, t double, score double"), 400, 10),
        ]
        got = [sorted(map(tuple, df.collect()), key=str) for df in folded]
    finally:
        spark.conf.unset(size)
    assert got[0] == sorted(want, key=str)
    groups = sorted([(1, g, 10.0 * g, 10 * g + 9.5, 10) for g in range(500)], key=str)
    assert got[1] == groups and got[2] == groups
    assert got[3] == [(1, 5001, True, 30, 0)]
    assert got[4] == sorted([(1, p, 10.0 * p, 1.0) for p in range(400)], key=str)
    for df in folded:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_list" not in plan


def test_empty_series(spark):
    empty = spark.createDataFrame([], EVERY)
    assert segments.stable_intervals(empty, 1, 2, 3).count() == 0
    assert segments.missing_windows(empty, 1, 2, 3, 10).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming.stable import stable_intervals

    rng = random.Random(5)
    rows = [(e, i, i / 10, 1.0 if i == 0 else rng.choice([0.0, 0.005, 0.02, 0.05]), 100.0) for e in range(5) for i in range(60)]
    want = segments.stable_intervals(spark.createDataFrame(rows, EVERY), 0.01, 0.03, 3)
    schema = "entity long, idx long, t double, motion double, sharpness double, last boolean"
    for part in range(3):
        chunk = [(*r, r[1] == 59) for r in rows if r[1] // 20 == part]
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (
        stable_intervals(stream, 0.01, 0.03, 3)
        .writeStream.format("memory").queryName("closed").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    cols = ["entity", "start", "end", "first_idx", "last_idx", "n_samples"]
    key = lambda df: sorted(map(tuple, df.select(*cols).collect()))
    assert key(spark.table("closed")) == key(want)


