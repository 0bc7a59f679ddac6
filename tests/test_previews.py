"""Previews against plain loops over pixels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import previews


def area_mean(image, rows, columns):
    """The mean grey of the area under each new pixel, pixel by pixel."""
    h, w = len(image), len(image[0])
    out = []
    for i in range(rows):
        line = []
        for j in range(columns):
            total = 0.0
            for y in range(h):
                down = min((i + 1) * h / rows, y + 1) - max(i * h / rows, y)
                for x in range(w):
                    across = min((j + 1) * w / columns, x + 1) - max(j * w / columns, x)
                    if down > 0 and across > 0:
                        total += down * across * image[y][x]
            line.append(round(round(total / (h / rows) / (w / columns), 6)))
        out.append(line)
    return out


@pytest.mark.parametrize("shape, wanted", [((16, 18), (8, 9)), ((8, 16), (8, 9)), ((5, 7), (8, 9)), ((4, 4), (8, 8)), ((3, 3), (3, 3))])
def test_resizing_is_by_area(shape, wanted):
    rng = random.Random(1)
    image = [[rng.randint(0, 255) for _ in range(shape[1])] for _ in range(shape[0])]
    assert previews.resized(np.array([image], float), *wanted)[0].tolist() == area_mean(image, *wanted)


def hash_of(image):
    value = 0
    for row in area_mean(image, 8, 9):
        for a, b in zip(row, row[1:], strict=False):
            value = value << 1 | (b > a)
    return value - (1 << 64) if value >> 63 else value


def similarity_of(a, b, width, sigma):
    kernel = [np.exp(-((i - (width - 1) / 2) ** 2) / (2 * sigma**2)) for i in range(width)]
    kernel = [k / sum(kernel) for k in kernel]
    values = []
    for y in range(len(a) - width + 1):
        for x in range(len(a[0]) - width + 1):
            cells = [(kernel[i] * kernel[j], a[y + i][x + j], b[y + i][x + j]) for i in range(width) for j in range(width)]
            ma, mb = sum(g * p for g, p, _ in cells), sum(g * q for g, _, q in cells)
            va, vb, cov = sum(g * p * p for g, p, _ in cells) - ma * ma, sum(g * q * q for g, _, q in cells) - mb * mb, sum(g * p * q for g, p, q in cells) - ma * mb
            values.append((2 * ma * mb + previews.C1) * (2 * cov + previews.C2) / ((ma * ma + mb * mb + previews.C1) * (max(0, va) + max(0, vb) + previews.C2)))
    return sum(values) / len(values)


def test_hashes_and_similarity_of_a_table(spark, monkeypatch):
    rng = random.Random(5)
    # A small bound cuts the batch into parts.
    monkeypatch.setattr(previews, "CHUNK", 8 * 16 * 14 * 2)
    image = lambda: [[rng.randint(0, 255) for _ in range(14)] for _ in range(16)]
    flat = lambda m: None if m is None else [float(v) for row in m for v in row]
    pairs = []
    for i in range(9):
        a = image()
        pairs.append((i, a, [[min(255, v + (i % 3)) for v in row] for row in a] if i % 2 else image()))
    pairs += [(9, None, image()), (10, image(), None), (11, [[7] * 14] * 16, [[7] * 14] * 16)]
    df = spark.createDataFrame([(i, flat(a), flat(b)) for i, a, b in pairs], "i int, a array<double>, b array<double>")
    got = {r.i: r for r in df.select("i", previews.preview_hash(F.col("a"), 16, 14).alias("h"), previews.compared(F.col("a"), F.col("b"), 16, 14, 5, size=None).alias("m")).collect()}
    for i, a, b in pairs:
        assert got[i].h == (None if a is None else hash_of(a))
        if a is None or b is None:
            assert got[i].m is None
            continue
        halves = [(a, b), ([r[:7] for r in a], [r[:7] for r in b]), ([r[7:] for r in a], [r[7:] for r in b])]
        assert got[i].m.similar == pytest.approx(min(similarity_of(x, y, 5, 1.5) for x, y in halves), abs=1e-9)
        assert got[i].m.bits == ((hash_of(a) ^ hash_of(b)) & ((1 << 64) - 1)).bit_count()
        assert got[i].m.contrast == pytest.approx(min(np.std(a), np.std(b)))
    same = {r.i: r.same for r in df.select("i", previews.same_page(previews.compared(F.col("a"), F.col("b"), 16, 14, 5, size=None)).alias("same")).collect()}
    # A raster without contrast is nobody's page, however alike.
    assert [same[i] for i in (1, 3, 0, 9, 10, 11)] == [True, True, False, False, False, False]


def test_previews_of_the_usual_size(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (64, 64)).astype(float)
    moved = np.where(np.arange(64) < 32, a, np.roll(a, 1, axis=0))
    rows = [(0, a.ravel().tolist(), a.ravel().tolist()), (1, a.ravel().tolist(), moved.ravel().tolist())]
    df = spark.createDataFrame(rows, "i int, a array<double>, b array<double>")
    got = {r.i: r.m for r in df.select("i", previews.compared(F.col("a"), F.col("b"), 64, 64).alias("m")).collect()}
    assert got[0].similar == pytest.approx(1.0) and got[0].bits == 0
    # The left half is the same; the right one decides.
    assert got[1].similar < 0.5


def test_an_empty_table_has_no_hashes(spark):
    none = spark.createDataFrame([], "a array<double>")
    assert none.select(previews.preview_hash(F.col("a"), 8, 9)).collect() == []
