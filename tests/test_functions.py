import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import geometry, kernels, text
from tidemark.operators import asof
from tidemark.sources import projects


def test_natural_key(spark):
    names = spark.createDataFrame([("10.jpg",), ("2.jpg",), ("1.jpg",), ("a10b2",), ("a9b30",)], "n string")
    assert [r.n for r in names.orderBy(text.natural_key(F.col("n"))).collect()] == ["1.jpg", "2.jpg", "10.jpg", "a9b30", "a10b2"]


def test_text(spark):
    row = spark.range(1).select(
        text.file_stem(F.lit("a/b:c. ")).alias("a"), text.file_stem(F.lit("é" * 100)).alias("b"), text.clock(F.lit(75.5)).alias("c"),
        text.rational(F.lit("30000/1001")).alias("d"), text.rational(F.lit("1/0")).alias("e"), text.clean_field(F.lit("  a \n b "), 10).alias("f"),
    ).first()
    assert row.a == "a_b_c" and row.b == "é" * 90 and row.c == "1:16" and abs(row.d - 29.97) < 0.01 and row.e == 0 and row.f == "a b"


def test_quads(spark):
    names = [f"{a}{i}" for i in range(4) for a in "xy"]
    df = spark.createDataFrame([(0.1, 0.1, 0.9, 0.1, 0.9, 0.9, 0.1, 0.9), (0.1, 0.1, 0.9, 0.9, 0.9, 0.1, 0.1, 0.9)], names)
    rows = df.select(geometry.is_valid().alias("ok"), geometry.skew().alias("skew"), geometry.area().alias("area")).collect()
    assert rows[0].ok and not rows[1].ok and rows[0].skew < 1e-6 and abs(rows[0].area - 0.64) < 1e-9
    turned = df.limit(1).select(*[v.alias(k) for k, v in geometry.rotated(90).items()])
    assert turned.where(geometry.is_valid()).count() == 1


def test_kernels(spark):
    rng = np.random.default_rng(1)
    image = rng.random(64) * 255
    df = spark.createDataFrame([(image.tolist(), (image * 0 + 9).tolist())], "a array<double>, b array<double>")
    row = df.select(kernels.ssim("a", "a").alias("same"), kernels.ssim("a", "b").alias("other"), kernels.sharpness("a").alias("s"), kernels.sharpness("b").alias("flat"), kernels.motion("a", "a").alias("still"), kernels.difference_hash(F.col("a")).alias("h")).first()
    assert abs(row.same - 1) < 1e-9 and row.other < 0.5 and row.s > row.flat == 0 and row.still == 0
    bits = [image[r * 8 + c + 1] > image[r * 8 + c] for r in range(8) for c in range(7)]
    assert row.h == sum(1 << i for i, b in enumerate(bits) if b)
    left, right = df.select(kernels.split_spread("a").alias("p")).first().p
    assert len(left) == len(right) == 32


def test_asof(spark):
    left = spark.createDataFrame([("k", 1.0), ("k", 2.0), ("k", 3.5)], "k string, t double")
    right = spark.createDataFrame([("k", 2.0, 1), ("k", 2.0, 2), ("k", 3.0, 3)], "k string, at double, n int")
    got = lambda **o: [r.p.n if r.p else None for r in asof.asof_join(left, right, ["k"], "t", "at", "p", tie="n", **o).orderBy("t").collect()]
    assert got() == [None, 1, 3]
    assert got(exact=False) == [None, None, 3]
    assert got(backward=False) == [1, 1, None]


def test_archives_and_manifests(spark, tmp_path):
    pages = spark.createDataFrame([("p", 1, ".png", b"two"), ("p", 0, ".jpg", b"one")], "project string, position int, suffix string, content binary")
    (row,) = projects.page_archives(pages, {"title": "A & B"}).collect()
    with zipfile.ZipFile(io.BytesIO(row.archive)) as z:
        assert z.namelist() == ["001.jpg", "002.png", "ComicInfo.xml"] and z.read("001.jpg") == b"one"
        assert b"A &amp; B" in z.read("ComicInfo.xml")
    (tmp_path / "book").mkdir()
    (tmp_path / "book/manifest.json").write_text('{"version": 1, "source": "s", "pages": [{"id": "a", "side": "left"}, {"id": "b", "enabled": false}]}')
    pages = projects.pages_of(projects.read_manifests(spark, str(tmp_path / "*/manifest.json"))).orderBy("position").collect()
    assert [(p.project, p.id, p.enabled) for p in pages] == [("book", "a", True), ("book", "b", False)]
    for name in ("10.jpg", "2.jpg", "1.jpg", "note.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.name for r in projects.image_files(spark, str(tmp_path)).orderBy("position").collect()] == ["1.jpg", "2.jpg", "10.jpg"]
    with pytest.raises(ValueError):
        projects.image_files(spark, str(tmp_path), most=2)


def test_batches_of_several_sizes_and_nulls(spark):
    rng = random.Random(3)
    rows = [[float(rng.randint(0, 255)) for _ in range(side * side)] for side in (3, 8, 3, 5)]
    pairs = [(0, rows[0], rows[2]), (1, rows[1], rows[1]), (2, None, rows[3]), (3, rows[3], None), (4, rows[2], rows[0])]
    df = spark.createDataFrame(pairs, "i int, a array<double>, b array<double>").coalesce(1)
    got = {r.i: r for r in df.select("i", kernels.sharpness("a").alias("s"), kernels.sharpness_tiles("a").alias("t"), kernels.ssim("a", "b").alias("m"), kernels.motion("a", "b").alias("move"), kernels.split_spread("a").alias("halves")).collect()}
    assert got[2].s is None and got[2].t is None and got[2].halves is None and got[2].move == 1.0 and got[3].move == 1.0
    assert got[1].m == 1.0 and got[1].move == 0.0 and abs(got[0].m - got[4].m) < 1e-12 and len(got[3].t) == 9
    square = [rows[3][5 * k : 5 * k + 5] for k in range(5)]
    assert got[3].halves == [[v for r in square for v in r[:2]], [v for r in square for v in r[2:]]]
