"""Near-duplicate documents by bottom-k sketches of one hash function."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import free_name, settled, stage_table

#: Values that a sketch retains, and the chance to miss a link that is granted.
SKETCH = 64
MISS = 1e-9
#: Lists that the sketches of a linked pair have in common at least, where sets are large enough.
COMMON = 8
#: Values tracked by the sketch of frequent values; at most so many are broadcast.
FREQUENT = 20_000
#: Lists of more members are joined to families and compared block by block,
#: shorter ones by a join.
LIST_JOIN = 64
#: A block of a family has about twice so many nodes, and so many shingles, at most.
BLOCK = 256
BLOCK_SHINGLES = 2_000_000
#: Rows of one key that a task of a join meets, about; keys of more rows are salted.
SALT_ROWS = 1_000
#: A key is salted only if it also holds more than one in so many of all rows, so
#: there are fewer salted keys than this and their table may be broadcast.
SALT_KEYS = 50_000
#: Bytes of a text whose words are hashed at once.
SEGMENT = 1 << 20
#: Part of its retained values that a node shares with a head that it is first compared with.
HEAD_SHARE = 4
#: Ids that a semi-join broadcasts at most; beyond, it shuffles.
BROADCAST_IDS = 2_000_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2**64, for a segment."""
    up, down = np.full(SEGMENT + 1, _BASE), np.full(SEGMENT + 1, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _polynomial(data: np.ndarray) -> np.uint64:
    """A word's bytes as a polynomial in the base, piece by piece."""
    up, _ = _powers()
    total, factor = np.uint64(0), np.uint64(1)
    with np.errstate(over="ignore"):
        for at in range(0, len(data), SEGMENT):
            part = data[at : at + SEGMENT].astype(np.uint64) + np.uint64(1)
            total += factor * (part * up[: len(part)]).sum(dtype=np.uint64)
            factor *= up[len(part)]
    return total


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word that depends on its bytes only; segments of words share their sums."""
    up, down = _powers()
    sums = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        # Words i to j - 1 lie within one segment, unless the first alone is longer.
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, side="right")))
        base = starts[i]
        if ends[i] - base > SEGMENT:
            sums[i], i = _polynomial(data[base : ends[i]]), i + 1
            continue
        piece = data[base : ends[j - 1]].astype(np.uint64) + np.uint64(1)
        prefix = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * up[: len(piece)], out=prefix[1:])
        sums[i:j] = (prefix[ends[i:j] - base] - prefix[starts[i:j] - base]) * down[starts[i:j] - base]
        i = j
    return _mix(sums + (ends - starts).astype(np.uint64) * _BASE)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's shingles of ``width`` words.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Fewer
    words than ``width`` are one shingle; no words give an empty set.
    """
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    gap = np.concatenate(([True], _SPACE[data], [True]))
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])
    ends = np.flatnonzero(~gap[:-1] & gap[1:])
    n = len(starts)
    if not n:
        return np.empty(0, np.uint64)
    words = _word_hashes(data, starts, ends)
    size = min(width, n)
    m = n - size + 1
    h = words[:m] + np.uint64(size)
    for j in range(1, size):
        h = _mix(h * _BASE + words[j : m + j])
    return np.unique(_mix(h))


@cache
def least_shared(k: int, similarity: float = 0.8, miss: float = MISS) -> int:
    """Values of a union sketch of ``k`` that a linked pair shares but for a chance of ``miss``."""
    below, c = 0.0, 0
    while c < k:
        below += comb(k, c) * similarity**c * (1 - similarity) ** (k - c)
        if below > miss:
            break
        c += 1
    return max(c, 1)


def values_needed(n: int, k: int, percent: int) -> int:
    """Sketch values that a set of ``n`` shares with any set it is linked with.

    Exact where both sketches must be whole sets, else but for the chance ``MISS``.
    """
    if n * 100 <= k * percent:
        return max(1, -(-n * percent // 100))
    return least_shared(min(n, k), percent / 100)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact: 100 times the intersection is ``percent`` times the union or more."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return bool(shared) and 100 * shared >= percent * (len(a) + len(b) - shared)


def _sketches(documents: DataFrame, width: int, k: int) -> DataFrame:
    """doc_id, hash of the text, size of the set, 128-bit digest of the set, the k smallest hashes."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, d1, d2, kept = [], [], [], []
            for text in batch.column("text").to_pylist():
                own = shingle_set(text, width)
                digest = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), np.int64)
                sizes.append(len(own))
                d1.append(digest[0])
                d2.append(digest[1])
                kept.append(own[:k].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast("int64"), batch.column("t"), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(kept, pa.list_(pa.int64()))],
                ["doc_id", "t", "n", "d1", "d2", "sketch"],
            )

    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("t"))
    return rows.mapInArrow(sketch, "doc_id long, t long, n long, d1 long, d2 long, sketch array<long>")


def _spread_join(big: DataFrame, small: DataFrame, on: list[str], by: str, counts: DataFrame, how: str = "inner") -> DataFrame:
    """Join rows with their key's one row of ``small`` without a task for each key.

    ``counts`` has the keys with their number of rows in ``big``, as ``rows``.
    A key of many rows is salted: its rows are dealt by ``by``, and its row of
    ``small`` is repeated for each part. The table of such keys is short by
    ``SALT_KEYS`` and is broadcast.
    """
    total = counts.agg(F.sum("rows")).first()[0] or 0
    bound = max(SALT_ROWS, total // SALT_KEYS)
    hot = F.broadcast(counts.where(F.col("rows") > bound).select(*on, F.ceil(F.col("rows") / bound).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    left = big.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(by), parts).cast("int")).drop("_parts")
    right = small.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of lists with the part of their list that they fall in, by the list's size."""
    return rows.withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / SALT_ROWS)))


def _for_parts(lists: DataFrame) -> DataFrame:
    """One row per list, repeated for each part of it."""
    return lists.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / SALT_ROWS) - 1))).drop("size")


def _frequent_values(nodes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent sketch values and their counts, from a mergeable sketch of bounded size."""
    top = nodes.select(F.explode("sketch").alias("v")).agg(F.expr(f"approx_top_k(v, {FREQUENT}, {4 * FREQUENT})").alias("top")).first()[0]
    kept = sorted((r["item"], r["count"]) for r in top or [] if r["item"] is not None and r["count"] > 2)
    return np.array([v for v, _ in kept], np.int64), np.array([n for _, n in kept], np.int64)


def _retained(nodes: DataFrame, percent: int, k: int) -> DataFrame:
    """Rows of the inverted lists: value, node, set size, size class, values retained, parts of the list, part.

    Linked sketches share ``values_needed`` values, so their parts that remain
    without so many less t share t values, if all order values alike. Frequent
    values come last and are the ones left out; the order costs no link. Their
    lists are cut in parts, as they may hold a large part of all rows.
    """
    values, counts = _frequent_values(nodes)
    shared = nodes.sparkSession.sparkContext.broadcast((values, counts))
    share = percent / 100

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts = shared.value
        for batch in batches:
            v, node, size, kept, often = [], [], [], [], []
            for i, n, sketch in zip(batch.column("node").to_pylist(), batch.column("n").to_pylist(), batch.column("sketch"), strict=True):
                own = sketch.values.to_numpy()
                need = values_needed(n, k, percent)
                keep = len(own) - need + min(COMMON, need)
                seen = np.zeros(len(own), np.int64)
                if len(values):
                    at = np.minimum(np.searchsorted(values, own), len(values) - 1)
                    seen = np.where(values[at] == own, counts[at], 0)
                order = np.lexsort((own, seen))[:keep]
                v.append(own[order])
                often.append(seen[order])
                node.append(np.full(keep, i))
                size.append(np.full(keep, n))
                kept.append(np.full(keep, keep, np.int32))
            if v:
                n, of = np.concatenate(size), np.concatenate(node)
                # Linked sizes lie in one class or in neighbouring ones.
                level = np.floor(np.log(n) / -np.log(share)).astype(np.int32)
                parts = np.concatenate(often) // SALT_ROWS + 1
                part = (_mix(of.astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(v)), pa.array(of), pa.array(n), pa.array(level), pa.array(np.concatenate(kept)), pa.array(parts), pa.array(part)],
                    ["v", "node", "n", "level", "kept", "parts", "part"],
                )

    return nodes.select("node", "n", "sketch").mapInArrow(rows, "v long, node long, n long, level int, kept int, parts long, part long")


def _few(ids: DataFrame) -> bool:
    return ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS


def _verified(pairs: DataFrame, documents: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets are similar enough.

    A node may be the ``a`` of any number of pairs; its text is then sent to
    several tasks.
    """
    pairs = stage_table(pairs.select("a", "b"), "pairs")
    ids = stage_table(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), "text")
    texts = stage_table(texts.join(F.broadcast(ids) if _few(ids) else ids, "id", "left_semi"), "texts")
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    degrees = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("rows"))
    both = _spread_join(pairs.join(right, "b"), left, ["a"], "b", degrees).select("a", "b", "text_a", "text_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            kept = []
            for i in range(batch.num_rows):
                own = shingle_set(batch.column("text_a")[i].as_py(), width)
                kept.append(linked(own, shingle_set(batch.column("text_b")[i].as_py(), width), percent))
            kept = np.array(kept, dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array(a[kept]), pa.array(b[kept])], ["a", "b"])

    return both.mapInArrow(check, "a long, b long").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node with an edge reaches.

    Alternating large and small stars: every node's larger neighbours, then its
    smaller ones, are hung on the smallest node near it, until all edges lead
    to their component's smallest node. Minima are summed up before they are
    shuffled, a hub's edges are joined with its minimum in parts, and rounds
    are written, so a hub neither gathers its neighbours in one task nor
    lengthens the lineage.
    """
    return settled(edges.sparkSession, "components", lambda: _components(edges))


def _components(edges: DataFrame) -> DataFrame:
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = stage_table(edges, "edges")

    def hung(rows: DataFrame, on: str, by: str, low: DataFrame) -> DataFrame:
        """Rows with ``m``, the smallest neighbour below the node ``on``, if there is one."""
        counts = rows.groupBy(on).agg(F.count(F.lit(1)).alias("rows"))
        return _spread_join(rows, low.withColumnRenamed("u", on), [on], by, counts, "left")

    while True:
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        # The larger neighbours of a node hang on its smallest neighbour, or on itself.
        large = hung(edges, "v", "u", low).select("u", F.coalesce("m", "v").alias("v")).distinct()
        large = stage_table(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = hung(large, "u", "v", low).select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        small = stage_table(small, "small")
        # At the end every node has one edge, and none leads to a node that has one.
        split = small.groupBy("u").count().where("count > 1").limit(1).count()
        if not split and not small.join(small.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count():
            return small.select(F.col("u").alias("node"), F.col("v").alias("component"))
        edges = small


def _star_pairs(lists: DataFrame) -> DataFrame:
    """For every node the smaller node that heads most of its lists: (a, b) with a < b.

    A list is headed by its smallest node of the same size class. A head of
    less than one in ``HEAD_SHARE`` of a node's lists is left to the comparison
    of what lies in different components, which covers all pairs.
    """
    heads = lists.groupBy("v", "level").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("members"), F.max("size").alias("size")).where("members > 1").drop("members")
    joined = _dealt(lists).join(_for_parts(heads), ["v", "level", "part"])
    met = joined.where("head < node").groupBy("node", "head", "kept").agg(F.count(F.lit(1)).alias("shared"))
    best = met.where(F.col("shared") * HEAD_SHARE >= F.col("kept")).groupBy("node").agg(F.max(F.struct("shared", (-F.col("head")).alias("minus"))).alias("best"))
    return best.select((-F.col("best.minus")).alias("a"), F.col("node").alias("b"))


def _similar_sketches(pairs: DataFrame, nodes: DataFrame, percent: int, k: int) -> DataFrame:
    """Pairs that the estimate from the union sketch does not rule out."""
    share = percent / 100
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    joined = pairs.join(left, "a").join(right, "b")

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = np.zeros(batch.num_rows, dtype=bool)
            columns = [batch.column(c) for c in ("n_a", "n_b", "s_a", "s_b")]
            for i in range(batch.num_rows):
                n_a, n_b = columns[0][i].as_py(), columns[1][i].as_py()
                a, b = columns[2][i].values.to_numpy().view(np.uint64), columns[3][i].values.to_numpy().view(np.uint64)
                kept[i] = _may_link(a, b, max(n_a, n_b) < k, k, share)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(kept)), batch.column("b").filter(pa.array(kept))], ["a", "b"])

    return joined.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(estimate, "a long, b long")


def _may_link(a: np.ndarray, b: np.ndarray, whole: bool, k: int, share: float) -> bool:
    if whole:
        return linked(a, b, round(100 * share))
    union = np.union1d(a, b)[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return int(np.searchsorted(both, union[-1], side="right")) >= least_shared(len(union), share)


def _blocks(members: DataFrame) -> DataFrame:
    """Members with their block: ``node, family, component, first, parts, pure, own, n_blocks``.

    A family is cut by component: a large one has blocks of its own, the others
    share blocks. Blocks of a family are numbered from 0 to ``n_blocks`` - 1,
    those of one pool from ``first`` on. Their number follows from nodes and
    shingles, so that neither many nor very long texts make a block large.
    """
    counts = members.groupBy("family", "component").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    counts = stage_table(counts, "component_counts")
    pure = (F.col("rows") >= BLOCK) | (F.col("shingles") >= BLOCK_SHINGLES)
    pools = counts.withColumn("pool", F.when(pure, F.col("component")).otherwise(F.lit(-1)))
    pools = pools.withColumn("pure", F.col("pool") == F.col("component"))
    parts = F.ceil(F.greatest(F.sum("rows") / (2 * BLOCK), F.sum("shingles") / BLOCK_SHINGLES)).cast("int")
    sized = pools.groupBy("family", "pool", "pure").agg(parts.alias("parts"), F.count(F.lit(1)).alias("rows"))
    sized = stage_table(sized, "pools")
    order = W.partitionBy("family").orderBy("pure", "pool")
    numbered = sized.withColumns(
        {
            "first": (F.sum("parts").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("parts")).cast("int"),
            "n_blocks": F.sum("parts").over(W.partitionBy("family")).cast("int"),
        }
    ).drop("rows")
    keys = ["family", "pool", "pure"]
    placed = _spread_join(pools.select(*keys, "component"), numbered, keys, "component", sized.select(*keys, "rows"))
    joined = _spread_join(members.select("family", "component", "node"), placed.drop("pool"), ["family", "component"], "node", counts)
    return joined.withColumn("own", F.col("first") + F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))


def _family_links(members: DataFrame, documents: DataFrame, width: int, percent: int, k: int) -> DataFrame:
    """Links that join the components inside families: (a, b), by full sets.

    ``members`` has ``family, component, node, n``. A group holds the texts of
    two blocks of a family, but for blocks of one and the same component, which
    have nothing to join. Shared sketch values are counted for all its pairs at
    once; where some pair of different components has enough of them, shared
    shingles are counted likewise, which gives exact indexes. What links join
    is returned as one pair for each node.
    """
    ids = stage_table(_blocks(members), "members")
    texts = documents.select(F.col("doc_id").cast("long").alias("node"), "text")
    texts = texts.join(F.broadcast(ids) if _few(ids) else ids, "node")
    same = F.col("pure") & F.col("other").between(F.col("first"), F.col("first") + F.col("parts") - 1)
    spread = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).where(~same).select(
        "family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "text"
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        node, own, component = (group[c].to_numpy() for c in ("node", "own", "component"))
        sets = [shingle_set(t, width) for t in group["text"]]
        n = np.array([len(x) for x in sets])
        need = np.array([values_needed(x, k, percent) if x else k + 1 for x in n])
        flat = np.concatenate([x[:k] for x in sets])
        row = np.repeat(np.arange(len(sets)), np.minimum(n, k))
        enough = _co_occurrences(flat, row, len(sets)) >= np.maximum(need[:, None], need[None, :])
        enough &= 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
        if group["i"].iloc[0] != group["j"].iloc[0]:
            enough &= own[:, None] != own[None, :]
        enough &= component[:, None] != component[None, :]
        some = np.flatnonzero(enough.any(1))
        if not len(some):
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        flat = np.concatenate([sets[x] for x in some])
        shared = _co_occurrences(flat, np.repeat(np.arange(len(some)), n[some]), len(some))
        linked = enough[np.ix_(some, some)] & (100 * shared >= percent * (n[some][:, None] + n[some][None, :] - shared))
        # Every node takes the smallest place that its links reach.
        place = np.arange(len(some))
        while True:
            near = np.where(linked, place[None, :], len(some)).min(1)
            lower = np.minimum(place, near)
            lower = lower[lower]
            if (lower == place).all():
                break
            place = lower
        moved = np.flatnonzero(place != np.arange(len(some)))
        return pd.DataFrame({"a": node[some[place[moved]]], "b": node[some[moved]]})

    return spread.groupBy("family", "i", "j").applyInPandas(compare, "a long, b long").distinct()


def _co_occurrences(flat: np.ndarray, row: np.ndarray, m: int, dense: int = 24, chunk: int = 2048) -> np.ndarray:
    """Number of values that each pair of ``m`` rows shares; a row holds a value once.

    Values of many rows are counted by a product of 0-1 matrices, values of few
    by listing the pairs of their rows.
    """
    order = np.argsort(flat, kind="stable")
    row = row[order]
    starts = np.flatnonzero(np.concatenate(([True], flat[order][1:] != flat[order][:-1])))
    counts = np.diff(np.append(starts, len(flat)))
    pairs = np.zeros(m * m, np.int64)
    for c in range(2, dense + 1):
        rows = row[starts[counts == c][:, None] + np.arange(c)]
        i, j = np.triu_indices(c, 1)
        for at in range(0, len(rows), 20_000):
            part = rows[at : at + 20_000]
            pairs += np.bincount((part[:, i] * m + part[:, j]).ravel(), minlength=m * m)
    shared = pairs.reshape(m, m).astype(np.float32)
    shared += shared.T
    often = np.flatnonzero(counts > dense)
    for at in range(0, len(often), chunk):
        here = often[at : at + chunk]
        seen = np.zeros((m, len(here)), np.float32)
        for column, v in enumerate(here):
            seen[row[starts[v] : starts[v] + counts[v]], column] = 1
        shared += seen @ seen.T  # exact: counts stay below 2**24
    return shared


def _open_rows(lists: DataFrame, components: DataFrame) -> DataFrame:
    """Rows of the lists whose members lie in several components."""
    placed = lists.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = placed.groupBy("v").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("size").alias("size")).where("lo <> hi")
    return stage_table(_dealt(placed).join(_for_parts(several.select("v", "size")), ["v", "part"], "left_semi").drop("part"), "open")


def _fewest_lists(percent: int) -> Column:
    """Lists that a node of ``n`` values shares with any node it is linked with, at least."""
    return F.greatest(F.lit(1), F.least(F.lit(COMMON), F.floor(F.col("n") * (percent * percent / 1e4))))


def _bundles(nodes: DataFrame, percent: int) -> DataFrame:
    """``lists, node, n, component``: the lists of each class that a node with its ``lists`` is in, as one array.

    Lists fall in one class fewer than ``COMMON``, so of ``COMMON`` lists two
    lie in one class. Classes with one list of a node are left out. Sets that
    may be linked with one too small to share so many also have each list alone.
    """
    share = percent * percent / 1e4

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, times = [], []
            for n, lists in zip(batch.column("n").to_pylist(), batch.column("lists"), strict=True):
                own = np.sort(lists.values.to_numpy().view(np.uint64))
                mine = list(own[:, None]) if n * share * percent / 100 < COMMON else []
                if n * share >= COMMON:
                    classes = own % np.uint64(COMMON - 1)
                    mine += [part for c in range(COMMON - 1) if len(part := own[classes == c]) > 1]
                found += [part.view(np.int64) for part in mine]
                times.append(len(mine))
            of = batch.select(["node", "n", "component"]).take(pa.array(np.repeat(np.arange(batch.num_rows), times)))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64())), *of.columns], ["lists", "node", "n", "component"])

    return nodes.select("node", "n", "component", "lists").mapInArrow(bundles, "lists array<long>, node long, n long, component long")


def _pair_keys(heads: DataFrame) -> DataFrame:
    """``key, bundle, head, lo, hi``: nodes that share ``_fewest_lists`` are in bundles that share a key.

    A key is a pair of lists of one class, or a single list of a bundle that
    has no other.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, times = [], []
            for lists in batch.column("lists"):
                own = lists.values.to_numpy().view(np.uint64)
                i, j = np.triu_indices(len(own), 1)
                found.append(_mix(_mix(own[i]) + own[j]) if len(own) > 1 else _mix(own))
                times.append(len(found[-1]))
            if found:
                of = batch.select(["bundle", "head", "lo", "hi"]).take(pa.array(np.repeat(np.arange(batch.num_rows), times)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), *of.columns], ["key", "bundle", "head", "lo", "hi"])

    return heads.select("bundle", "head", "lo", "hi", "lists").mapInArrow(keys, "key long, bundle long, head long, lo long, hi long")


def _large_list_links(rows: DataFrame, documents: DataFrame, width: int, percent: int, k: int) -> DataFrame:
    """Links inside large lists, but for those of nodes that also share a short one.

    Nodes that are linked and share no short list share ``_fewest_lists`` large
    ones, so a node in fewer has no such link, and the others are looked at by
    pairs of lists. Near copies share many such pairs, and many of them the
    very same lists of a class, so pairs are made once for each such bundle of
    lists, for its smallest node. Nodes with a common pair are joined to a
    family, in which every pair of different components is compared once.
    Single lists would join most of a large table to one family, as texts that
    have nothing else in common share a usual shingle.
    """
    nodes = rows.groupBy("node").agg(F.min("n").alias("n"), F.min("component").alias("component"), F.collect_list("v").alias("lists"))
    bundles = stage_table(_bundles(nodes.where(F.size("lists") >= _fewest_lists(percent)), percent), "bundles")
    low = [F.min("component").alias("lo"), F.max("component").alias("hi")]
    heads = bundles.groupBy("lists").agg(F.min("node").alias("head"), *low, F.count(F.lit(1)).alias("rows"))
    heads = stage_table(heads.withColumn("bundle", F.monotonically_increasing_id()), "bundle_heads")
    keys = stage_table(_pair_keys(heads), "pair_keys")
    several = keys.groupBy("key").agg(F.min("head").alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("rows"))
    several = stage_table(several.where("lo <> hi").select("key", "b", "rows"), "pair_heads")
    met = _spread_join(keys, several.drop("rows"), ["key"], "bundle", several.select("key", "rows")).select("bundle", F.col("head").alias("a"), "b").distinct()
    met = stage_table(met, "met_bundles")
    # The nodes of a bundle hang on its smallest one.
    near = stage_table(heads.join(met.select("bundle").distinct(), "bundle", "left_semi").select("lists", "head", "rows"), "near_bundles")
    hung = _spread_join(bundles.select("lists", "node"), near.drop("rows"), ["lists"], "node", near.select("lists", "rows"))
    joined = met.select("a", "b").union(hung.select(F.col("node").alias("a"), F.col("head").alias("b"))).where("a <> b").distinct()
    below = connected_components(joined).select("node", F.col("component").alias("family"))
    families = below.union(below.select(F.col("family").alias("node"), "family")).distinct()
    placed = nodes.select("node", "component", "n")
    return _family_links(stage_table(families.join(placed, "node"), "families"), documents, width, percent, k)


def _short_list_links(rows: DataFrame, nodes: DataFrame, documents: DataFrame, width: int, percent: int, k: int) -> DataFrame:
    """Links across components inside short lists; a list's length bounds the pairs of a row."""
    x, y = rows.alias("x"), rows.alias("y")
    close = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    met = (
        x.join(y, (F.col("x.v") == F.col("y.v")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & close)
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        .distinct()
    )
    return _verified(_similar_sketches(met, nodes, percent, k), documents, width, percent)


def _classes(base: DataFrame, documents: DataFrame, width: int, percent: int, k: int) -> DataFrame:
    """Digests of sets with their component and the number of rows that have them."""
    spark = base.sparkSession
    known = base.where("n > 0 and doc_id is not null")
    nodes = known.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("node"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("rows"))
    nodes = stage_table(nodes, "nodes")
    retained = _retained(nodes, percent, k)
    sizes = retained.groupBy("v").agg(F.count(F.lit(1)).alias("size"), F.max("parts").alias("of")).where("size > 1")
    sizes = sizes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1))).drop("of")
    met = stage_table(retained.drop("parts").join(sizes, ["v", "part"]).drop("part"), "met")
    # A node linked with any other meets it, no smaller than by its share, in so many lists.
    able = met.groupBy("node", "n").agg(F.count(F.lit(1)).alias("lists")).where(F.col("lists") >= _fewest_lists(percent))
    lists = stage_table(met.join(able.select("node"), "node", "left_semi"), "lists")
    stars = settled(spark, "stars", lambda: _verified(_star_pairs(lists), documents, width, percent))
    first = connected_components(stars)

    def large_links() -> DataFrame:
        large = _open_rows(lists.where(F.col("size") > LIST_JOIN), first)
        return _large_list_links(large, documents, width, percent, k)

    links = stars.union(settled(spark, "family_links", large_links))
    second = connected_components(links)

    def short_links() -> DataFrame:
        short = _open_rows(lists.where(F.col("size") <= LIST_JOIN), second)
        return _short_list_links(short, nodes, documents, width, percent, k)

    components = connected_components(links.union(settled(spark, "short_links", short_links)))
    placed = nodes.select("d1", "d2", "n", "node", "rows").join(components, "node", "left")
    return placed.select("d1", "d2", "n", "rows", F.coalesce("component", "node").alias("component_id"))


def _verdicts(documents: DataFrame, width: int, percent: int, k: int) -> DataFrame:
    """Rows of ``base`` with ``component_id`` and ``kept``."""
    base = stage_table(_sketches(documents, width, k), "sketches")
    classes = settled(documents.sparkSession, "classes", lambda: _classes(base, documents, width, percent, k))
    digest = ["d1", "d2", "n"]
    out = _spread_join(base.drop("sketch"), classes.drop("rows"), digest, "doc_id", classes.select(*digest, "rows"), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.withColumns({"component_id": component, "kept": F.coalesce(F.col("doc_id") == component, F.col("component_id").isNull())})


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard index of ``percent`` % or more.

    Returns ``doc_id, n_shingles, component_id, kept``, a row for each row of
    ``documents``; other columns are ignored. component_id is the smallest
    doc_id reachable over links; it alone is kept. Documents without words
    (null and empty texts) are linked with nothing. Rows that repeat an id
    count as one document. A row with a null id belongs to the component of the
    ids whose set is the same as its own and isn't kept; if there are none, it
    has no component_id and is kept. Texts of any length are compared whole. An
    empty table gives no rows.

    Equal sets are one node. The k smallest hashes of a set are its sketch; the
    retained values form inverted lists. First every list links its members to
    its head only, which joins groups of copies in a number of comparisons
    proportional to their size. Then pairs of one list that still lie in
    different components are compared too, so no link between components is
    left out, but for the chance ``MISS`` that two sketches differ by far more
    than their sets. The union sketch rules pairs out with the same chance, and
    every link is confirmed on the full sets of both whole texts.
    """
    return _verdicts(documents, width, percent, k).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


def _but(rows: DataFrame, others: DataFrame, t: str) -> DataFrame:
    """Rows whose id and hash ``t`` of the text ``others`` has not; null ids are equal."""
    of = others.select(F.col("doc_id").alias(f"{t}_id"), F.col(t).alias(f"{t}_of"))
    return rows.join(of, F.col("doc_id").eqNullSafe(F.col(f"{t}_id")) & (F.col(t) == F.col(f"{t}_of")), "left_anti")


def drop_near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """The documents that stay, one row of each component.

    It is a row of the component's smallest id with the set that this id is
    known by; an id that stands for several sets keeps one row of each. Of rows
    with a null id and a set that no id has, one stays for each set; rows
    without words all stay, but of those that repeat an id only one.
    """
    t = free_name(documents, "t")
    v = stage_table(_verdicts(documents, width, percent, k).select("doc_id", F.col("t").alias(t), "d1", "d2", "n", "kept"), "verdicts")
    stays = v.where("kept").where("n > 0 or doc_id is not null").groupBy("doc_id", "d1", "d2", "n").agg(F.min(t).alias(t), F.count(F.lit(1)).alias("rows"))
    stays = stage_table(stays, "stays")
    hashed = documents.withColumn(t, F.xxhash64("text"))
    gone = stage_table(_but(v.select("doc_id", t).distinct(), stays, t), "gone")
    # Most rows stay, so texts are shuffled only where too many go to tell every task which.
    named = _but(hashed, F.broadcast(gone), t) if _few(gone) else _but(hashed, gone, t)
    # Texts are shuffled once more only where rows are repeated.
    if stays.where("rows > 1").limit(1).count():
        named = named.dropDuplicates(["doc_id", t])
    wordless = ~F.rlike(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    return named.drop(t).unionByName(documents.where(F.col("doc_id").isNull() & wordless))


_SHINGLES_SQL = r"string_split_regex(trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+')"

OP10_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, CASE WHEN w = [''] THEN [] ELSE w END AS w FROM (SELECT doc_id, {_SHINGLES_SQL} AS w FROM documents)
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM docs, unnest(range(1, greatest(len(w) - 3, 1) + 1)) t(i) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reached AS (
  SELECT a AS doc_id, least(a, b) AS low FROM both_ways
  UNION
  SELECT e.b, r.low FROM reached r JOIN both_ways e ON e.a = r.doc_id
), lowest AS (
  SELECT doc_id, min(low) AS low FROM reached GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(low, d.doc_id) AS component_id, coalesce(low, d.doc_id) = d.doc_id AS kept
FROM docs d LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest USING (doc_id)
"""


def op10_query(documents: DataFrame) -> DataFrame:
    return near_duplicates(documents.select("doc_id", "text"), width=4, percent=80)
