"""Annotated samples that detections are measured by: reading, checking, judging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geometry import overlap, overlap_share
from ..operators.patches import is_quad

_POINTS = "array<array<double>>"
SCHEMA = f"""
version int, videos array<struct<id: string, filename: string, sha256: string, width: int, height: int, duration: double, expected_rotation: int,
  samples: array<struct<id: string, time: double, expect_spread: boolean, spread_quad: {_POINTS}, min_reference_iou: double, min_page_iou: double, consensus_offsets: array<double>, tags: array<string>>>,
  repair_pairs: array<struct<id: string, spread_quad: {_POINTS}, target_time: double, donor_times: array<double>>>>>
"""
#: Rotations, and the offsets of a sample that gives none.
ROTATIONS, OFFSETS = (0, 90, 180, 270), (-0.5, 0.0, 0.5)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row per video of the corpora below ``path``: ``file, version, place`` and the video's own fields."""
    read = spark.read.schema(SCHEMA).json(path, multiLine=True).withColumn("file", F.input_file_name())
    return read.select("file", "version", F.posexplode_outer("videos").alias("place", "v")).select("file", "version", "place", "v.*")


def samples_of(videos: DataFrame) -> DataFrame:
    rows = videos.select("file", F.col("id").alias("video"), "duration", F.posexplode("samples").alias("place", "s")).select("file", "video", "duration", "place", "s.*")
    return rows.withColumn("offsets", F.coalesce("consensus_offsets", F.array(*map(F.lit, OFFSETS))))


def pairs_of(videos: DataFrame) -> DataFrame:
    return videos.select("file", F.col("id").alias("video"), "duration", F.posexplode("repair_pairs").alias("place", "p")).select("file", "video", "duration", "place", "p.*")


def _within(time: Column, duration: Column) -> Column:
    return F.coalesce((time >= 0) & (time < duration), F.lit(False))


def _found(rows: DataFrame, owner: Column, item: Column, checks: list[tuple[Column, str]]) -> DataFrame:
    """A row for each check that fails; a check that is null fails."""
    said = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for ok, text in checks]))
    return rows.select("file", owner.alias("video"), item.alias("item"), F.explode(said).alias("problem"))


def problems(videos: DataFrame) -> DataFrame:
    """All that is wrong in corpora: ``file, video, item, problem``; no rows if they are sound."""
    unique = lambda *keys: (F.count(F.lit(1)).over(W.partitionBy(*keys)) == 1) & (F.length("id") > 0)
    none = F.lit(None).cast("string")
    whole = _found(videos.groupBy("file").agg(F.first("version").alias("version"), F.count("id").alias("n")), none, none, [(F.col("version") == 1, "version must be 1"), (F.col("n") > 0, "no videos")])
    named = videos.where("place is not null").withColumn("_unique", unique("file", "id"))
    video_checks = [
        (F.col("_unique"), "video ids must be unique and not empty"),
        (F.rlike("sha256", F.lit("^[0-9a-f]{64}$")), "sha256 must be 64 lowercase hexadecimal characters"),
        (F.col("expected_rotation").isin(*ROTATIONS), "expected_rotation must be 0, 90, 180 or 270"),
        (F.col("duration") > 0, "duration must be positive"),
    ]
    samples = samples_of(videos).withColumn("_unique", unique("file", "video", "id"))
    spread = F.col("expect_spread")
    finite = F.forall("offsets", lambda x: F.coalesce(x.between(-1e300, 1e300), F.lit(False)))
    only = lambda ok: ~F.coalesce(spread, F.lit(False)) | ok
    sample_checks = [
        (F.col("_unique"), "sample ids must be unique and not empty"),
        (_within(F.col("time"), F.col("duration")), "time must be within the video"),
        (spread.isNotNull(), "expect_spread must be boolean"),
        (only(is_quad(F.to_json("spread_quad"))), "spread_quad must be a convex quad"),
        *[(only(F.coalesce(c, F.lit(0.0)).between(0, 1)), f"{c} must be 0..1") for c in ("min_reference_iou", "min_page_iou")],
        (only(F.size("offsets") >= 3), "consensus_offsets needs at least 3 values"),
        (only(finite & (F.size(F.array_distinct("offsets")) == F.size("offsets"))), "consensus_offsets must be finite and unique"),
        (only(F.exists("offsets", lambda x: F.abs(x) <= 1e-9)), "consensus_offsets must include 0"),
        (only(F.forall("offsets", lambda x: _within(F.col("time") + x, F.col("duration")))), "consensus frames must be within the video"),
    ]
    pairs = pairs_of(videos).withColumn("_unique", unique("file", "video", "id"))
    pair_checks = [
        (F.col("_unique"), "repair pair ids must be unique and not empty"),
        (is_quad(F.to_json("spread_quad")), "spread_quad must be a convex quad"),
        (_within(F.col("target_time"), F.col("duration")), "target_time must be within the video"),
        ((F.size("donor_times") > 0) & F.forall("donor_times", lambda x: _within(x, F.col("duration"))), "donor_times must be within the video"),
    ]
    found = _found(named, F.col("id"), none, video_checks)
    found = found.unionByName(_found(samples, F.col("video"), F.col("id"), sample_checks)).unionByName(_found(pairs, F.col("video"), F.col("id"), pair_checks))
    return whole.unionByName(found)


def judged(samples: DataFrame, detections: DataFrame) -> DataFrame:
    """Each sample with the overlap of what was detected: ``video, id, expected, detected, share, passed``.

    ``detections`` has ``video, id`` and ``quad``, a list of points, null where
    nothing was found. A spread that is expected passes with an overlap of its
    ``min_reference_iou`` or more; one that isn't, if nothing was found.
    """
    rows = samples.join(detections.select("video", "id", F.col("quad").alias("_quad")), ["video", "id"], "left")
    as_ring = lambda c: F.transform(c, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))
    both = rows.withColumns({"_a": as_ring("spread_quad"), "_b": as_ring("_quad")})
    met = both.withColumn("_common", overlap(F.col("_a"), F.col("_b")))
    share = F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), overlap_share(F.col("_a"), F.col("_b"), F.col("_common")))
    detected = F.col("_quad").isNotNull()
    passed = F.when(F.col("expect_spread"), F.coalesce(share >= F.coalesce("min_reference_iou", F.lit(0.0)), F.lit(False))).otherwise(~detected)
    return met.select("video", "id", F.col("expect_spread").alias("expected"), detected.alias("detected"), F.round(share, 6).alias("share"), passed.alias("passed"))
