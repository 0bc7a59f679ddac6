"""Operators over the whole corpus against plain Python and SQL."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from tidemark.llm import dedup_lines, dedup_minhash, mix_sources, queries, shard_hilbert

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, con, name):
    assert oracle.differences(con, queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name]) == ""


DOCS = "doc_id long, source string, lang string, text string"


def corpus(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def water_fill(sizes, weights, budget, most):
    caps = {s: most * n for s, n in sizes.items()}
    target, clamped = {}, set()
    while True:
        free = [s for s in sizes if s not in clamped]
        left = budget - sum(caps[s] for s in clamped)
        target = {s: caps[s] if s in clamped else left * weights[s] / sum(weights[x] for x in free) for s in sizes}
        over = {s for s in free if target[s] > caps[s] * (1 + 1e-12)}
        if not over:
            return target
        clamped |= over


def test_mix_targets_and_edges(spark):
    rows = [(i, f"s{i % 7}" if i % 7 else None, None, "w " * (1 + i % 7 * 9 + i % 5)) for i in range(700)]
    rows += [(10_000, "empty", None, None), (10_001, "empty", None, ""), (10_002, "s1", None, "w " * 3), (10_002, "s1", None, "w " * 3)]
    docs = corpus(spark, rows).withColumns({"mix": F.lit(1), "size": F.lit(2), "target": F.lit("x"), "_rank": F.lit(3)})
    got = mix_sources.op4_query(docs).collect()
    sizes = defaultdict(int)
    for _, s, _, t in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = water_fill(sizes, weights, 1.5 * sum(sizes.values()), 2.0)
    source = {r[0]: r[1] for r in rows}
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]] and abs(r.target - want[source[r.doc_id]]) < 1e-5
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source[r.doc_id]] += r.taken
    assert len(got) == len(rows)
    assert all(abs(taken[s] - want[s]) <= 0.05 * want[s] + 1 for s in sizes)
    again = mix_sources.op4_query(docs.repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mix_sources.op4_query(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("d", "bits"), [(2, 3), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(d, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
    index = shard_hilbert.hilbert_index(grid, bits)
    assert sorted(index) == list(range(len(grid)))
    path = grid[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_shards(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 20}", None if i % 5 == 0 else "en", "é" * (i % 50)) for i in range(997)]
    rows += [(5000, None, None, None), (5001, None, None, ""), (5002, "a", "b", "t"), (5002, "a", "b", "t")]
    docs = corpus(spark, rows).withColumns({"shard": F.lit(9), "hilbert": F.lit(8), "_at": F.lit(7)})
    got = shard_hilbert.op8_query(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    text = {r[0]: (r[3] or "").encode() for r in rows}
    assert all(r.size == len(text[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    # Along the curve, shards are runs of the index.
    ranges = sorted((min(x), max(x)) for x in ([r.hilbert for r in got if r.shard == s] for s in range(40)))
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    few = shard_hilbert.op8_query(docs.limit(3)).collect()
    assert len(few) == 3 and all(r.slot == 0 for r in few)
    assert shard_hilbert.op8_query(docs.limit(0)).count() == 0


def test_written_shards_prune(spark, tmp_path):
    docs = corpus(spark, [(i, f"s{i % 4}", "en", "x" * i) for i in range(100)])
    shard_hilbert.write_shards(shard_hilbert.shard_documents(docs, 8), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.select("shard").distinct().count() == 8


LONG = "this line is long enough to be compared with others, "


def kept_lines(rows, min_chars=40, min_docs=5):
    key = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x.strip(" \t\n\x0b\x0c\r"))
    where = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                where[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        order = lambda x: (x is not None, x)
        drop = [len(where.get(key(x), ())) >= min_docs and i != max(where[key(x)], key=order) for x in lines]
        out.append((i, len(lines), sum(drop), "\n".join(x for x, d in zip(lines, drop, strict=True) if not d)))
    return Counter(out)


def test_lines(spark, monkeypatch):
    rows = [(i, "\n".join([LONG + str(i % 3), "  " + LONG.upper() + "A\t", "short", LONG + str(i % 3), str(i)])) for i in range(30)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, LONG + "0\n" * 300), (7, LONG + "a"), (None, LONG + "1"), (None, LONG + "1\nx"), (5, rows[5][1])]
    rows += [(200 + i, "é" * 39 + "\n" + "é" * 40) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_lines": F.lit(1), "_text_hash": F.lit(2)})
    want = kept_lines(rows)
    found = lambda: Counter(tuple(r) for r in dedup_lines.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_text").collect())
    assert found() == want and sum(k[2] for k in want) > 60
    monkeypatch.setattr(dedup_lines, "HOT_SHARE", 5)
    assert found() == want
    assert dedup_lines.op9_query(docs.limit(0)).count() == 0


def test_bitmaps_stand_for_places(spark):
    runs = spark.createDataFrame([([2, 1, 3, 2],), ([0, 2],)], "runs array<int>")
    assert [r.p for r in runs.select(dedup_lines.dropped_places(F.col("runs")).alias("p")).collect()] == [[2, 6, 7], [0, 1]]


def components(rows, width, percent):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    by_set = defaultdict(list)
    for i, s in sets:
        if i is not None and s:
            by_set[s].append(i)

    def verdict(i, s):
        if i is not None:
            return find(i), find(i) == i
        return (find(by_set[s][0]), False) if by_set[s] else (None, True)

    return Counter((i, len(s), *verdict(i, s)) for i, s in sets)


def near_copies(n_groups=12, copies=14, words=90):
    rng = np.random.default_rng(4)
    passage = [f"p{k}" for k in range(70)]
    rows, i = [], 0
    for g in range(n_groups):
        base = [f"g{g}w{rng.integers(400)}" for _ in range(words)]
        for c in range(copies):
            text = list(base)
            for at in rng.integers(0, words, c // 2):
                text[at] = f"x{rng.integers(10**6)}"
            if g % 3 == 0:
                text += passage
            rows.append((i, " ".join(text)))
            i += 1
    return rows


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates(spark, monkeypatch, width):
    monkeypatch.setattr(dedup_minhash, "LIST_JOIN", 6)
    monkeypatch.setattr(dedup_minhash, "BLOCK", 5)
    rows = near_copies()
    rows += [(10_000, None), (10_001, ""), (10_002, "a b"), (10_003, "A\tb "), (10_004, "a b c"), (3, rows[3][1]), (None, rows[3][1]), (10_005, "z " * 30_000), (10_006, "Z " * 30_001)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "sketch": F.lit(2)})
    got = dedup_minhash.near_duplicates(docs, width, 80)
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id", "kept").collect())) == components(rows, width, 80)
    assert dedup_minhash.near_duplicates(docs.limit(0), width, 80).count() == 0


def test_near_duplicates_of_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = dedup_minhash.op10_query(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == components(rows, 4, 80)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 100), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in dedup_minhash.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 90}


def test_a_link_at_the_threshold_is_missed_once_in_a_billion():
    k = dedup_minhash.SKETCH
    for size in (52, k, 1000):
        drawn, need = min(size, k), dedup_minhash.values_needed(size, k, 80)
        below = sum(math.comb(drawn, c) * 0.8**c * 0.2 ** (drawn - c) for c in range(need))
        assert below <= 1e-9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_every_source_comes_near_its_target(spark, sf):
    got = mix_sources.mix_documents(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).collect()
    taken, smallest = defaultdict(int), {}
    for r in got:
        taken[r.source] += r.mix.taken
        if r.mix.size:
            smallest[r.source] = min(smallest.get(r.source, r.mix.size), r.mix.size)
    for source, target in {r.source: r.mix.target for r in got}.items():
        # Sources of a handful of documents have few to choose from.
        assert abs(taken[source] - target) <= max(0.01 * target, smallest.get(source, 0) / 2 + 1), source


def test_exchange_mends_uneven_sources(spark):
    sizes = [5_000, 900, 700, 400, 300, 120, 60, 33, 7, 3]
    rows = [(i, "a", None, "w " * n) for i, n in enumerate(sizes)] + [(100 + i, "b", None, "w " * 50) for i in range(200)] + [(999, None, None, "w " * 11)]
    got = mix_sources.op4_query(corpus(spark, rows)).collect()
    source = {r[0]: r[1] for r in rows}
    for s in ("a", "b"):
        mine = [r for r in got if source[r.doc_id] == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.02 * mine[0].target
    assert all(0 <= r.taken <= 2 * r.size and r.taken % r.size == 0 for r in got)
