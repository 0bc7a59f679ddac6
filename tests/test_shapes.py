"""Overlaps, covers, tracks, searches, outlines and selections against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import geometry
from tidemark.operators import beam, cover, lines, selection, tracking

CORNERS = [f"{axis}{i}" for i in range(4) for axis in "xy"]


def polygon(points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def share(spark, a, b):
    common = geometry.overlap(polygon(a), polygon(b))
    return spark.range(1).select(geometry.overlap_share(polygon(a), polygon(b), common)).first()[0]


SQUARE = [(0, 0), (1, 0), (1, 1), (0, 1)]


@pytest.mark.parametrize(
    "other, want",
    [
        (SQUARE, 1.0),
        (SQUARE[::-1], 1.0),
        ([(x + 0.5, y) for x, y in SQUARE], 1 / 3),
        ([(x + 1, y) for x, y in SQUARE], 0.0),
        ([(x + 1, y + 1) for x, y in SQUARE], 0.0),
        ([(x + 3, y) for x, y in SQUARE], 0.0),
        ([(x / 2 + 0.25, y / 2 + 0.25) for x, y in SQUARE], 0.25),
        ([(x * 3 - 1, y * 3 - 1) for x, y in SQUARE[::-1]], 1 / 9),
        ([(0.5, -0.5), (1.5, 0.5), (0.5, 1.5), (-0.5, 0.5)], 0.5),
        ([(0, 0)] * 4, 0.0),
    ],
)
def test_overlap_of_known_polygons(spark, other, want):
    assert share(spark, SQUARE, other) == pytest.approx(want) and share(spark, other, SQUARE) == pytest.approx(want)


def test_overlap_against_points_thrown_at_it(spark):
    rng = random.Random(3)

    def quad():
        cx, cy, r = rng.uniform(0.3, 0.7), rng.uniform(0.3, 0.7), rng.uniform(0.15, 0.4)
        angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(4))
        return [(cx + r * math.cos(a), cy + r * math.sin(a)) for a in angles]

    def inside(q, p):
        return all((bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) >= 0 for (ax, ay), (bx, by) in zip(q, q[1:] + q[:1], strict=True))

    points = [(rng.random(), rng.random()) for _ in range(40_000)]
    for _ in range(6):
        a, b = quad(), quad()
        both, either = sum(inside(a, p) and inside(b, p) for p in points), sum(inside(a, p) or inside(b, p) for p in points)
        assert share(spark, a, b) == pytest.approx(both / either, abs=0.02)


def test_cover_against_sets(spark):
    rng = random.Random(2)
    targets, donors, want = [], [], {}
    for g in range(25):
        bits = [[rng.getrandbits(64) & rng.getrandbits(64) for _ in range(2)] for _ in range(rng.randint(1, 7))]
        mask = [rng.getrandbits(64), 0 if g % 5 == 0 else rng.getrandbits(64)]
        rated = [(d, w, rng.randint(0, 4) / 4, rng.randint(0, 4) / 4) for d, w in enumerate(bits)]
        signed = lambda w: [x - (1 << 64) if x >> 63 else x for x in w]
        targets.append((g, signed(mask)))
        donors += [(g, d, signed(w), s, r) for d, w, s, r in rated]
        left, picks, out = mask, [], set()
        while sum(x.bit_count() for x in left) >= 8:
            total = sum(x.bit_count() for x in left)
            options = []
            for d, w, s, r in rated:
                n = sum((x & y).bit_count() for x, y in zip(left, w, strict=True))
                if d not in out and n >= 8:
                    options.append((-round(0.5 * n / total + 0.3 * s + 0.2 * (1 - r), 9), -n, d, w))
            if not options:
                break
            _, n, d, w = min(options)
            left = [x & ~y for x, y in zip(left, w, strict=True)]
            picks.append((d, -n))
            out.add(d)
        want[g] = (sum(x.bit_count() for x in mask), sum(x.bit_count() for x in left), picks)
    targets += [(100, [1, 2]), (101, None)]
    want |= {100: (2, 2, []), 101: (0, 0, [])}
    got = cover.greedy_cover(spark.createDataFrame(targets, "g long, mask array<long>"), spark.createDataFrame(donors, "g long, donor int, clean array<long>, score double, residual double"), ["g"]).collect()
    assert {r.g: (r.total, r["left"], [tuple(p) for p in r.picks]) for r in got} == want
    assert any(len(w[2]) > 1 for w in want.values())


STEP = "entity long, idx long, " + ", ".join(f"m{k} double" for k in range(9))
START = [0.2, 0.2, 0.8, 0.2, 0.8, 0.8, 0.2, 0.8]


def moves(*steps):
    """Maps that shift by dx and dy and scale about the origin; None where no map was found."""
    return [(1, i, *([None] * 9 if s is None else [float(v) for v in (s[2], 0, s[0], 0, s[2], s[1], 0, 0, 1)])) for i, s in enumerate(steps)]


def test_tracks_pass_over_rejected_steps(spark):
    rows = moves((0.05, 0, 1), (0.2, 0, 1), None, (0.05, 0, 1), (0.05, 0.0, 1), (0.05, 0.05, 1), (2.0, 0, 1), (0, 0, 0.05), (-0.05, 0.0, 1))
    quads = spark.createDataFrame([(1, *START), (3, *START)], "entity long, " + ", ".join(f"{c} double" for c in CORNERS))
    got = tracking.tracking_chain(spark.createDataFrame(rows + [(2, 0, *[1.0] * 9)], STEP), quads).orderBy("idx").collect()
    assert [r.status for r in got] == [
        "tracked", "step_shift_too_large", "unavailable", "tracked", "tracked", "total_shift_too_large", "invalid_transform", "invalid_transform", "tracked",
    ]
    # The quad goes on from the last one trusted, not from the one tried.
    assert [round(r.x0, 6) for r in got] == [0.25, 0.25, 0.25, 0.3, 0.35, 0.35, 0.35, 0.35, 0.3]
    assert got[5].step_shift == pytest.approx(math.hypot(0.05, 0.05)) and got[2].step_shift is None and {r.entity for r in got} == {1}


def test_tracks_reject_areas_out_of_range(spark):
    quads = spark.createDataFrame([(1, 0.4, 0.4, 0.6, 0.4, 0.6, 0.6, 0.4, 0.6)], "entity long, " + ", ".join(f"{c} double" for c in CORNERS))
    about = lambda s: [(1, 0, s, 0.0, 0.5 * (1 - s), 0.0, s, 0.5 * (1 - s), 0.0, 0.0, 1.0)]
    status = lambda s: tracking.tracking_chain(spark.createDataFrame(about(s), STEP), quads).first().status
    assert [status(s) for s in (1.3, 1.15, 0.8, 0.86)] == ["area_change_too_large", "tracked", "area_change_too_large", "tracked"]


def test_beam_finds_what_moves_reach(spark):
    quad = F.struct(*[F.lit(v).alias(c) for c, v in zip(CORNERS, START, strict=True)])
    # The goal is the seed with its left edge moved out by a tenth and then its top by a twentieth.
    goal = beam.moved(beam.moved(quad, left=0.10), top=0.05)
    frame = spark.range(1).select("id", F.array(quad, F.lit(None).cast("struct<" + ", ".join(f"{c}: double" for c in CORNERS) + ">")).alias("seeds"), goal.alias("goal"))
    row = beam.beam_search(frame, ["id"], "seeds", lambda q: 1 - beam.corner_distance(q, F.col("goal")), width=2).first()
    assert row.best[0].score == pytest.approx(1.0, abs=1e-9) and len(row.best) == 2 and row.kept_seed
    assert row.evaluated > 9
    none = beam.beam_search(frame.withColumn("seeds", F.slice("seeds", 1, 0)), ["id"], "seeds", lambda q: F.lit(0.0)).first()
    assert none.best == [] and none.evaluated == 0 and not none.kept_seed


def test_outlines_of_a_frame_and_its_lines(spark):
    rows = [(1, 1, "h", 0.1, 0.0, 0.9, 0.5), (1, 2, "h", 0.9, 0.0, 0.9, 0.5), (1, 3, "v", 0.2, 0.0, 0.9, 0.5), (1, 4, "v", 0.8, 0.0, 0.9, 0.5), (1, 5, "v", 0.81, 0.02, 0.2, 0.1), (2, 6, "h", 0.1, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "image long, id long, kind string, place double, slope double, rank double, segment double")
    found = lines.outlines(df, 0.1).orderBy("place")
    got = found.collect()
    assert [r.lines for r in got] == [[1, 2, 3, 4]] and [got[0][c] for c in CORNERS] == pytest.approx([0.2, 0.1, 0.8, 0.1, 0.8, 0.9, 0.2, 0.9])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_bands_lose_no_outline(spark):
    rng = random.Random(1)
    rows = [(g, g * 100 + k, "hv"[k % 2], rng.uniform(0, 1), rng.uniform(-0.1, 0.1), rng.random(), rng.random()) for g in range(5) for k in range(14)]
    df = spark.createDataFrame(rows, "image long, id long, kind string, place double, slope double, rank double, segment double")
    rules = lines.Outline(first=10**6, shown=10**6, same=0.0)
    want = set()
    for g in range(5):
        h, v = ([r for r in rows if r[0] == g and r[2] == k] for k in "hv")
        for t in h:
            for b in h:
                for left in v:
                    for r in v:
                        if b[3] - t[3] >= 0.25 and r[3] - left[3] >= 0.12:
                            q = []
                            for hh, vv in ((t, left), (t, r), (b, r), (b, left)):
                                x = (vv[3] + vv[4] * (hh[3] - 0.5 * hh[4] - 0.5)) / (1 - vv[4] * hh[4])
                                q.append((x, hh[3] + hh[4] * (x - 0.5)))
                            area = abs(sum(q[i][0] * q[(i + 1) % 4][1] - q[(i + 1) % 4][0] * q[i][1] for i in range(4))) / 2
                            side = [math.dist(q[i], q[(i + 1) % 4]) for i in range(4)]
                            if all(-0.02 <= c <= 1.02 for p in q for c in p) and 0.05 <= area <= 0.9 and 0.4 <= (side[0] + side[2]) / (side[1] + side[3]) <= 1.6:
                                want.add((t[1], b[1], left[1], r[1]))
    got = {tuple(r.lines) for r in lines.outlines(df, 0.1, rules).select("lines").collect()}
    assert got == want and len(want) > 100


def record(spread, cand, metrics, left, right, suspect=(), left_suspect=None):
    fill = lambda m: None if m is None else {k: m.get(k) for k in selection.MEASURES}
    return spread, cand, fill(metrics), fill(left), fill(right), list(suspect), left_suspect, None


RECORD = "spread long, cand long, " + ", ".join(f"{g} struct<{', '.join(f'{m}: double' for m in selection.MEASURES)}>" for g in ("metrics", "left", "right")) + ", suspect array<string>, left_suspect array<string>, right_suspect array<string>"


def test_selection_by_grain_and_completeness(spark):
    good, bad = {"sharpness": 900.0, "motion": 0.0, "score": 0.5}, {"sharpness": 100.0, "motion": 0.01, "score": 0.9}
    rows = [
        # Complete: ranks decide, and each page has its own.
        record(1, 0, good, good, bad), record(1, 1, bad, bad, good),
        # One page is missing: the absolute score decides for all.
        record(2, 0, good, good, None), record(2, 1, bad, bad, bad),
        # A page's own reasons replace those of the spread; a blocked candidate is passed over.
        record(3, 0, good, good, good, ["high_motion"], []), record(3, 1, bad, bad, bad),
        # Less hand at comparable quality wins.
        record(4, 0, {**good, "hand": 0.10}, good, good), record(4, 1, {**good, "hand": 0.02, "sharpness": 850.0}, good, good),
        # Uniformity stands for sharpness; without any measure a score of zero is shared.
        record(5, 0, {"sharpness_uniformity": 0.2}, {}, {}), record(5, 1, {"sharpness_uniformity": 0.9, "sharpness": 1.0}, {}, {}),
    ]
    df = spark.createDataFrame(rows, RECORD)
    per_page = {r.spread: (r.complete, r.chosen, r["left"], r["right"]) for r in selection.selected(df, "per_page").collect()}
    assert per_page == {1: (True, 0, 0, 1), 2: (False, 1, 1, 1), 3: (True, 1, 0, 1), 4: (True, 1, 0, 0), 5: (True, 1, 0, 0)}
    spread = {r.spread: (r.chosen, r["left"], r["right"]) for r in selection.selected(df, "spread").collect()}
    assert spread == {k: (v[1], v[1], v[1]) for k, v in per_page.items()}
    with pytest.raises(ValueError, match="unknown mode"):
        selection.selected(df, "both")
    graded = {(r.spread, r.cand, r.grain): r for r in selection.graded(df).collect()}
    assert graded[1, 0, "spread"].rel_focus == 1.0 and graded[2, 0, "spread"].rel_focus is None and graded[2, 0, "right"].selection_score == float("-inf")


def test_all_grains_share_one_exchange(spark):
    plan = selection.selected(spark.createDataFrame([], RECORD), "per_page")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
