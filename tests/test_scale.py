"""Steps that must not grow faster than their input: exchanges, joins and chunks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import catalog, catalog_choice, catalog_more, catalog_review
from tidemark.functions import geometry, polygons
from tidemark.llm import dedup_minhash
from tidemark.operators import beam, lines, tracking
from tidemark.sources import adapters

SMALL = "/root/testdata/sf0.001"
CORNERS = [f"{axis}{i}" for i in range(4) for axis in "xy"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_tables_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(adapters, "TASK_ROWS", 100)
    assert adapters.dealt(spark.range(1000), "id").rdd.getNumPartitions() == 10
    assert adapters.dealt(spark.range(1000), "id", copies=3).rdd.getNumPartitions() == 30
    assert "REPARTITION_BY_NUM" not in plan(adapters.dealt(spark.range(100), "id"))
    for query in (catalog.select_per_side, catalog.safe_fix_suggestions, catalog.donor_ranking, catalog_choice.selected_pages, catalog_more.score_row_flatten):
        text = plan(query(spark, SMALL))
        assert text.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in text


def test_clusters_and_residuals_join_nothing(spark, monkeypatch):
    monkeypatch.setattr(adapters, "TASK_ROWS", 1000)
    assert plan(catalog_more.consensus_cluster(spark, SMALL)).count("Exchange hashpartitioning") == 1
    assert plan(catalog_more.mad_trim(spark, SMALL)).count("Exchange hashpartitioning") == 1
    assert "Join" not in plan(catalog_more.mad_trim(spark, SMALL)) + plan(catalog_review.repair_residuals(spark, SMALL))


def test_outlines_exchange_lines_only(spark, monkeypatch):
    text = plan(catalog_choice.line_outlines(spark, SMALL))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text and "Window" not in text
    # Runs of any size find the same.
    rng = random.Random(4)
    rows = [(g, g * 100 + k, "hv"[k % 2], rng.random(), rng.uniform(-0.1, 0.1), rng.random(), rng.random()) for g in range(4) for k in range(16)]
    df = spark.createDataFrame(rows, "image long, id long, kind string, place double, slope double, rank double, segment double")
    found = lambda: sorted((r.image, r.place, r.lines, r.confidence) for r in lines.outlines(df, 0.1).collect())
    whole = found()
    monkeypatch.setattr(lines, "COMBINED", 50)
    assert found() == whole and len(whole) > 8


def test_overlap_of_batches_is_that_of_expressions(spark):
    rng = random.Random(5)
    quad = lambda: [{"x": x + rng.uniform(-0.2, 0.2), "y": y + rng.uniform(-0.2, 0.2)} for x, y in ((0.2, 0.2), (0.8, 0.2), (0.8, 0.8), (0.2, 0.8))]
    rows = [(i, quad(), quad()[:: -1 if i % 2 else 1]) for i in range(60)] + [(60, None, quad()), (61, quad(), [])]
    df = spark.createDataFrame(rows, "id long, a array<struct<x: double, y: double>>, b array<struct<x: double, y: double>>")
    common = F.abs(geometry.signed_area(geometry.overlap(F.col("a"), F.col("b"))))
    got = df.where("id < 60").select(polygons.overlap_areas("a", "b")["common"].alias("g"), common.alias("w")).collect()
    assert [r.g for r in got] == pytest.approx([r.w for r in got], abs=1e-15)
    assert df.where("id = 60").select(polygons.overlap_areas("a", "b").alias("g")).first().g is None


def test_moves_of_batches_are_those_of_expressions(spark):
    quad = [0.2, 0.2, 0.8, 0.25, 0.78, 0.8, 0.22, 0.75]
    q = F.struct(*[F.lit(v).alias(c) for c, v in zip(CORNERS, quad, strict=True)])
    grown = spark.range(1).select(polygons.grown_quads(0.1, 0.012, 0.02)(F.array(q)).alias("g"), F.array(q, *[beam.moved(q, **{e: s * 0.1}) for e in ("left", "right", "top", "bottom") for s in (-1, 1)]).alias("w")).first()
    assert grown.g == grown.w and len(grown.g) == 9


def test_tracks_go_on_over_chunks(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(e, i, *([None] * 9 if rng.random() < 0.1 else [1.0, 0.0, rng.uniform(-0.04, 0.04), 0.0, 1.0, rng.uniform(-0.04, 0.04), 0.0, 0.0, 1.0])) for e in range(5) for i in range(40)]
    steps = spark.createDataFrame(rows, "entity long, idx long, " + ", ".join(f"m{k} double" for k in range(9)))
    quads = spark.createDataFrame([(e, 0.2, 0.2, 0.8, 0.2, 0.8, 0.8, 0.2, 0.8) for e in range(4)], "entity long, " + ", ".join(f"{c} double" for c in CORNERS))
    found = lambda: sorted(tracking.tracking_chain(steps, quads).collect(), key=lambda r: (r.entity, r.idx))
    whole = found()
    assert len(whole) == 160 and {r.status for r in whole} >= {"tracked", "unavailable", "total_shift_too_large"}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    monkeypatch.setattr(tracking, "CHUNK_ROWS", 7)
    try:
        assert found() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_usual_shingle_makes_no_family(spark, monkeypatch):
    """Texts in twos, alike but not linked, of which all share some of a few usual shingles, that no count of values knows."""
    none = np.array([], np.int64)
    monkeypatch.setattr(dedup_minhash, "_frequent_values", lambda nodes: (none, none))
    monkeypatch.setattr(dedup_minhash, "LIST_JOIN", 6)
    monkeypatch.setattr(dedup_minhash, "BLOCK", 5)
    sent, family_links = [], dedup_minhash._family_links
    monkeypatch.setattr(dedup_minhash, "_family_links", lambda members, *rest: sent.append(members.count()) or family_links(members, *rest))
    rows = []
    for i in range(120):
        usual = [f"u{(i // 2 + j) % 4}{c}" for j in range(2) for c in "abcd"]
        rows.append((i, " ".join([*usual, *(f"g{i // 2}w{k}" for k in range(60)), *(f"x{i}w{k}" for k in range(20))])))
    # Of a group too large for a join, some copies are linked with their neighbours only.
    rows += [(1000 + i, " ".join(f"n{k}" if k >= i % 9 * 5 else f"m{i % 9}v{k}" for k in range(100))) for i in range(30)]
    got = {r.doc_id: r.component_id for r in dedup_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()}
    sets = {i: set(dedup_minhash.shingle_set(t, 4).tolist()) for i, t in rows}
    want = {i: i for i in sets}
    for _ in sets:
        lower = {a: min(want[b] for b in sets if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])) for a in sets}
        if lower == want:
            break
        want = lower
    assert got == want and len(set(want.values())) > 120
    assert sum(sent) <= 30


def test_copies_with_the_same_lists_are_joined_once(spark, monkeypatch):
    """Two groups of texts that share most shingles but are not linked: joined rows follow the groups' lists, not their rows."""
    monkeypatch.setattr(dedup_minhash, "LIST_JOIN", 6)
    seen, spread_join = [], dedup_minhash._spread_join

    def counted(big, small, on, *rest):
        seen.append((on, big.count()))
        return spread_join(big, small, on, *rest)

    monkeypatch.setattr(dedup_minhash, "_spread_join", counted)
    usual = [f"u{k}" for k in range(100)]
    rows = [(i, " ".join([*usual, *(f"g{i % 2}w{k}" for k in range(16)), f"x{i}"])) for i in range(80)]
    got = {r.doc_id: r.component_id for r in dedup_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()}
    sets = {i: set(dedup_minhash.shingle_set(t, 4).tolist()) for i, t in rows}
    assert 60 * len(sets[0] | sets[1]) < 100 * len(sets[0] & sets[1]) < 80 * len(sets[0] | sets[1])
    assert got == {i: i % 2 for i in sets}
    joined = sum(n for on, n in seen if on in (["key"], ["lists"]))
    assert 0 < joined <= 12 * len(rows)
