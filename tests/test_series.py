"""Grids, values between points, and a second pass over windows against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import resample, rescan, segments


def grid(times, rate, start=None):
    """Grid points of one series: k, time, number of the sample shown, repeated, passed over."""
    kept = sorted((t, i) for i, t in enumerate(times) if start is None or t >= start)
    slots = {}
    for t, i in kept:
        slots.setdefault(math.floor((t - kept[0][0]) * rate + 0.5), []).append(i)
    out, shown = [], None
    for k in range(max(slots) + 1 if slots else 0):
        here = slots.get(k)
        shown = here[-1] if here else shown
        out.append((k, (kept[0][0] if start is None else start) + k / rate, shown, not here, len(here) - 1 if here else 0))
    return out


@pytest.mark.parametrize("rate", [0.7, 10.0, 37.5])
@pytest.mark.parametrize("start", [None, 3.25])
def test_grid_of_uneven_samples(spark, rate, start):
    rng = random.Random(int(rate))
    series = {e: sorted(float(rng.choice([rng.uniform(0, 20), rng.randint(0, 20)])) for _ in range(n)) for e, n in ((1, 40), (2, 1), (3, 300))}
    rows = [(e, i, t) for e, times in series.items() for i, t in enumerate(times)] + [(4, 0, None)]
    df = spark.createDataFrame(rows, "e long, i long, t double").withColumn("start", F.lit(start).cast("double"))
    got = resample.on_grid(df, rate, ["e"], "start" if start is not None else None, order=("t", "i"))
    want = [(e, *r) for e, times in series.items() for r in grid(times, rate, start)]
    assert sorted(map(tuple, got.select("e", "k", "time", "i", "repeated", "passed").collect())) == sorted(want)


def test_long_gaps_are_listed_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(resample, "_BLOCK", 7)
    df = spark.createDataFrame([(1, 0.0, 0), (1, 100.0, 1)], "e long, t double, i int")
    got = resample.on_grid(df, 1.0, ["e"]).orderBy("k").collect()
    assert [(r.k, r.i, r.repeated) for r in got] == [(k, int(k == 100), 0 < k < 100) for k in range(101)]


def test_truncated_and_empty_series_have_names(spark):
    samples = spark.createDataFrame([(1, t / 10) for t in range(100)] + [(2, 0.0), (4, 1.0), (5, None)], "e long, t double")
    expected = spark.createDataFrame([(1, 9.9), (2, 5.0), (3, 5.0), (4, None), (5, 1.0)], "e long, duration double")
    got = {r.e: (r.n_points, r.n_wanted, r.status) for r in resample.grid_checks(samples, expected, 10.0, ["e"]).collect()}
    assert got == {1: (100, 99, "ok"), 2: (1, 50, "truncated"), 3: (0, 50, "empty"), 4: (1, None, "unknown"), 5: (0, 10, "empty")}


def test_interpolation_is_that_of_numpy(spark):
    rng = random.Random(4)
    points = {e: [(rng.choice([rng.uniform(0, 1), rng.randint(0, 4) / 4]), rng.uniform(-1, 1)) for _ in range(n)] for e, n in ((1, 1), (2, 9), (3, 25))}
    asked = [(e, rng.choice([rng.uniform(-0.2, 1.2), rng.randint(0, 4) / 4])) for e in (1, 2, 3) for _ in range(60)] + [(9, 0.5), (2, None)]
    rows = spark.createDataFrame([(e, *p) for e, ps in points.items() for p in ps] + [(2, None, 1.0), (2, 0.5, None)], "e long, x double, y double")
    got = resample.interpolated(rows, spark.createDataFrame(asked, "e long, x double"), ["e"], "x", "y").collect()
    assert len(got) == len(asked)
    for r in got:
        if r.e == 9 or r.x is None:
            assert r.y is None
        else:
            xs, ys = zip(*sorted(points[r.e]), strict=True)
            assert r.y == pytest.approx(np.interp(r.x, xs, ys), abs=1e-9)


def strengths(height, profile):
    """A strength for each row, from the definition."""
    points = sorted((min(1, max(0, y)) * max(1, height - 1), min(0.35, max(0, s))) for y, s in profile)
    values = np.interp(np.arange(height), [p[0] for p in points], [p[1] for p in points])
    width = max(3, min(81, round(height * 0.05)))
    width += width % 2 == 0
    if width > height > 1:
        width = height if height % 2 else height - 1
    if width >= 3:
        at = np.arange(width) - (width - 1) / 2
        kernel = np.exp(-(at**2) / (2 * max(1, width / 4) ** 2))
        values = np.convolve(np.pad(values, width // 2, mode="edge"), kernel / kernel.sum(), mode="valid")
    return np.clip(values, 0, 0.35)


def test_rows_between_points_are_smoothed(spark):
    rng = random.Random(6)
    heights = {0: 1, 1: 2, 2: 3, 3: 4, 4: 57, 5: 100, 6: 1700, 7: 130, 8: 40, 9: 0}
    points = {k: [(rng.uniform(-0.1, 1.1), rng.uniform(-0.1, 0.5)) for _ in range(n)] for k, n in enumerate((2, 3, 1, 5, 4, 9, 6, 1, 0, 2))}
    rows = spark.createDataFrame([(k, *p) for k, ps in points.items() for p in ps], "id long, y double, strength double")
    got = resample.row_strengths(rows, spark.createDataFrame(list(heights.items()), "id long, height int"), ["id"], fallback=0.2)
    found = {}
    for r in got.collect():
        found.setdefault(r.id, {})[r.row] = r.strength
    assert {k: len(v) for k, v in found.items()} == {k: h for k, h in heights.items() if h}
    for k, v in found.items():
        want = strengths(heights[k], points[k]) if points[k] else np.full(heights[k], 0.2)
        assert [v[i] for i in range(heights[k])] == pytest.approx(want.tolist(), abs=1e-9)


def test_profiles_of_one_point_have_none(spark):
    rows = spark.createDataFrame([(1, 0.5, 0.1), (2, 0.0, 0.0), (2, 1.0, 0.3)], "id long, y double, s double")
    got = resample.profile_at(rows, [0.1, 0.5, 0.9], ["id"], "y", "s", 0.25).orderBy("place").collect()
    between = [0.03, 0.15, 0.27]
    want = [0.8 * between[0] + 0.2 * between[1], 0.2 * between[0] + 0.6 * between[1] + 0.2 * between[2], 0.25]
    assert [r.id for r in got] == [2, 2, 2] and [r.s for r in got] == pytest.approx([want[0], want[1], min(0.25, 0.2 * between[1] + 0.8 * between[2])])


def test_rates_of_a_second_pass():
    assert rescan.effective_rate(60.0, 30.0, 10.0) == 30.0 and rescan.effective_rate(60.0, None, 10.0) == 60.0
    assert rescan.effective_rate(60.0, 0.0, 10.0) == 60.0 and rescan.effective_rate(60.0, 10.0, 10.0) is None


#: A trace whose second page the first pass misses.
TRACE = [1.0, *[0.006] * 5, 0.030, 0.050, 0.040, 0.017, 0.014, 0.016, 0.040, 0.050, 0.030, *[0.006] * 5]


@pytest.mark.parametrize("alike", [False, True])
def test_a_missed_page_is_recovered_or_merged(spark, alike):
    every = "entity long, idx long, t double, motion double, sharpness double"
    first = spark.createDataFrame([(1, i, i / 10, m, 100.0) for i, m in enumerate(TRACE)], every)
    missing = segments.missing_windows(first, 0.01, 0.03, 5, 10.0)
    found = missing.collect()
    assert [(r.time, r.motion) for r in found] == [(1.0, 0.014)]
    # The second pass sees a page that is held still in the middle of the window.
    look = 7.0 if alike else 50.0
    dense = spark.createDataFrame([(1, k, 0.80 + 0.04 * k, look if 3 <= k <= 9 else 100.0 + 9 * k, 100.0) for k in range(13)] + [(1, 99, 50.0, 0.0, 1.0), (2, 0, 0.9, 0.0, 1.0)], "entity long, idx long, t double, look double, sharpness double")
    windows = rescan.grouped_windows(missing.select("entity", "id", "window_start", "window_end"), 3.0, 24.0)
    sampled = rescan.samples_of_groups(dense, windows, 25.0, 1.0)
    assert {r.entity for r in sampled.collect()} == {1} and sampled.agg(F.max("time")).first()[0] < 2
    measured = rescan.samples_in_windows(sampled, windows, "id", 25.0, 1.0, F.abs(F.col("look") - F.col("before.look")) / 1000)
    runs = rescan.best_runs(measured, ["entity", "id"], 0.001, 3)
    run = runs.collect()
    assert len(run) == 1 and run[0].n_samples == 6
    known = spark.createDataFrame([(1, 0.1, 0.5, 7.0, 7.0), (1, 1.5, 1.9, 90.0, 90.0)], "entity long, start double, end double, first_look double, last_look double")
    decided = rescan.recovered_or_merged(runs, known, 0.8, 2.0, 10.0).collect()
    assert [r.target_start for r in decided] == [0.1 if alike else None]


def test_runs_are_decided_like_a_list_of_segments(spark):
    rng = random.Random(9)
    segs, runs = {}, {}
    for e in range(6):
        at, segs[e], runs[e] = 0.0, [], []
        for _ in range(40):
            at += rng.uniform(0.2, 1.5)
            length = rng.uniform(0.1, 1.0)
            if rng.random() < 0.5:
                segs[e].append((at, at + length, float(rng.randint(0, 3)), float(rng.randint(0, 3))))
            else:
                runs[e].append((at, at + length, at + rng.uniform(0, length), float(rng.randint(0, 3))))
            at += length
    want = {}
    for e in segs:
        known = [(*s, 0) for s in segs[e]]
        for start, end, time, look in runs[e]:
            target = None
            if end - start <= 0.8:
                for s in sorted(known, key=lambda s: (min(abs(time - s[0]), abs(time - s[1])), s[4], s[0]))[:3]:
                    edge, seen = (s[1], s[3]) if s[1] <= time else (s[0], s[2])
                    if abs(edge - time) <= 2.0 and abs(look - seen) <= 0.5:
                        target = s[0]
                        break
            if target is None:
                known.append((start, end, look, look, 1))
            want[e, start] = target
    a = spark.createDataFrame([(e, *r) for e, rs in runs.items() for r in rs], "entity long, start double, end double, time double, look double")
    b = spark.createDataFrame([(e, *s) for e, ss in segs.items() for s in ss], "entity long, start double, end double, first_look double, last_look double")
    got = {(r.entity, r.start): r.target_start for r in rescan.recovered_or_merged(a, b, 0.8, 2.0, 0.5).collect()}
    assert got == want and None in got.values() and any(v is not None for v in got.values())


def test_new_candidates_keep_away_from_known_ones(spark):
    known = spark.createDataFrame([(1, 0, 1.0, True), (1, 4, 2.0, False), (2, 0, 5.0, True)], "s long, cand long, t double, chosen boolean")
    picked = spark.createDataFrame([(1, 1.04), (1, 1.5), (1, 1.2), (1, 2.05), (2, 1.0), (3, 1.0)], "s long, time double")
    got = sorted(map(tuple, rescan.added_candidates(picked, known, ["s"], 0.05, 1.0).select("s", "cand", "t", "chosen", "rescanned").collect()))
    assert got == [(1, 0, 1.0, True, False), (1, 4, 2.0, False, False), (1, 5, 1.2, False, True), (1, 6, 1.5, False, True), (2, 0, 5.0, True, False), (2, 1, 1.0, False, True), (3, 0, 1.0, False, True)]


def test_no_plan_of_a_second_pass_has_a_cross_join(spark):
    from tidemark import catalog, catalog_series  # noqa: F401

    for name in ("rescanned_windows", "rescanned_candidates", "row_strengths", "grid_samples"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
