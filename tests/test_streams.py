"""Streams give what the batch operators give, and forget what has ended."""

import random

import pytest

from tidemark.operators import segments
from tidemark.streaming import stable, states

EVERY = "entity long, idx long, t double, motion double, sharpness double"
STREAM = "entity long, idx long, t double, motion double, value double, last boolean"


@pytest.fixture(scope="module")
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def made(entities=4, n=60):
    rng = random.Random(8)
    return [(e, i, 1000.0 + i / 10, 1.0 if i == 0 else rng.choice([0.0, 0.005, 0.02, 0.05]), float(i % 7) if i % 5 else None) for e in range(entities) for i in range(n)]


def run(spark, rows, folder, operator, name):
    """Rows in order of time, a file and so a micro-batch for each third; the progress of the query."""
    n = 1 + max(r[1] for r in rows)
    for part in range(3):
        chunk = [r for r in rows if r[1] * 3 // n == part]
        spark.createDataFrame(chunk, STREAM).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    stream = spark.readStream.schema(STREAM).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    query = operator(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return query.recentProgress


def test_states_of_a_stream_are_those_of_the_batch(rocks, tmp_path):
    rows = made()
    stream = [(*r, r[1] == 59) for r in rows]
    progress = run(rocks, stream, tmp_path, lambda s: states.sample_states(s, 0.01, 0.03, 3), "states_all")
    got = rocks.table("states_all")
    batch = segments.hysteresis(rocks.createDataFrame([(*r[:4], 1.0) for r in rows], EVERY), 0.01, 0.03, 3)
    columns = ["entity", "idx", "t", "episode", "member", "state"]
    plain = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert plain(got) == plain(batch)

    want = sorted(map(tuple, segments.stable_intervals(rocks.createDataFrame([(*r[:4], 1.0) for r in rows], EVERY), 0.01, 0.03, 3).select("entity", "start", "end", "first_idx", "last_idx", "n_samples").collect()))
    closed = states.closed_intervals(got).collect()
    assert sorted(tuple(r)[:6] for r in closed) == want
    value = {(r[0], r[1]): r[4] for r in rows}
    assert all((r.first_value, r.last_value) == (value[r.entity, r.first_idx], value[r.entity, r.last_idx]) for r in closed)
    # All series ended, so nothing is kept.
    totals = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]
    assert max(totals) > 0 and totals[-1] == 0


def test_a_silent_entity_is_ended(rocks, tmp_path):
    # Entity 0 stops with an open interval, entity 1 with samples held back; entity 2 goes on and moves the watermark.
    rows = [(0, i, 1000.0 + i, 1.0 if i == 0 else 0.0, float(i), False) for i in range(6)]
    rows += [(1, i, 1000.0 + i, 1.0 if i == 0 else 0.02 if i < 4 else 0.0, 0.0, False) for i in range(6)]
    rows += [(2, i, 1000.0 + 10 * i, 0.05, 0.0, i == 29) for i in range(30)]
    run(rocks, rows, tmp_path, lambda s: states.sample_states(s, 0.01, 0.03, 3, idle_seconds=30), "states_idle")
    got = rocks.table("states_idle")
    assert got.where("idx is not null").count() == len(rows)
    assert [tuple(r) for r in states.closed_intervals(got).collect()] == [(0, 1001.0, 1005.0, 1, 5, 5, 1.0, 5.0)]
    assert {r.member for r in got.where("entity = 1").collect()} == {False}


def test_intervals_forget_a_series_that_ended(spark, tmp_path):
    rows = [(*r, r[1] == 59) for r in made()]
    progress = run(spark, rows, tmp_path, lambda s: stable.stable_intervals(s, 0.01, 0.03, 3), "intervals_all")
    totals = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]
    assert max(totals) == 4 and totals[-1] == 0
