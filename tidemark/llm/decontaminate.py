"""Benchmark decontamination by Wu-Manber search over words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, stage_table

_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Windows in one search table; a larger benchmark is searched table by table.
WINDOWS_PER_TABLE = 200_000


def words_of(text: str | None) -> list[str]:
    """Runs of lower-cased ASCII letters, digits and all that is not ASCII."""
    return _WORD.findall(text.translate(_LOWER)) if text else []


@dataclass
class Patterns:
    """Wu-Manber tables of the test windows that have one length.

    The letters of the search are words. ``shift`` tells by the block of the
    last two words (one, where windows are single words) how far the search may
    go on; a block that it doesn't know occurs in no window, so a whole window
    less one block is skipped. ``buckets`` list the windows by their last block.
    """

    length: int
    block: int = field(init=False)
    shift: dict = field(default_factory=dict)
    buckets: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.block = min(2, self.length)

    def add(self, window: tuple[str, ...], items: tuple[str, ...]) -> None:
        m, b = self.length, self.block
        for end in range(b, m + 1):
            block = window[end - b : end]
            self.shift[block] = min(self.shift.get(block, m - b + 1), m - end)
        self.buckets.setdefault(window[m - b :], {})[window] = items

    def search(self, words: list[str]) -> Iterator[tuple[int, tuple[str, ...]]]:
        """Start and items of every occurrence."""
        m, b, n = self.length, self.block, len(words)
        most, shift, buckets = m - b + 1, self.shift, self.buckets
        end = m
        while end <= n:
            block = tuple(words[end - b : end])
            step = shift.get(block, most)
            if step:
                end += step
                continue
            items = buckets[block].get(tuple(words[end - m : end]))
            if items is not None:
                yield end - m, items
            end += 1


def _windows(words: list[str], size: int) -> Iterator[tuple[str, ...]]:
    if words:
        m = min(size, len(words))
        for i in range(len(words) - m + 1):
            yield tuple(words[i : i + m])


def _tables(benchmark: DataFrame, size: int, bound: int) -> Iterator[dict[int, Patterns]]:
    """Search tables of at most ``bound`` windows each, items read one at a time."""
    made: dict[tuple[str, ...], set[str]] = {}

    def table() -> dict[int, Patterns]:
        by_length: dict[int, Patterns] = {}
        for window, items in made.items():
            by_length.setdefault(len(window), Patterns(len(window))).add(window, tuple(sorted(items)))
        return by_length

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    for item, text in rows.toLocalIterator():
        for window in _windows(words_of(text), size):
            made.setdefault(window, set()).add(item)
            if len(made) >= bound:
                yield table()
                made = {}
    if made:
        yield table()


def _mark(words: list[str], tables: dict[int, Patterns], hits: bytearray, items: set[str]) -> None:
    for length, patterns in tables.items():
        for start, found in patterns.search(words):
            hits[start : start + length] = b"\x01" * length
            items.update(found)


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    text: str = "text",
    name: str = "overlap",
    windows_per_table: int = WINDOWS_PER_TABLE,
) -> DataFrame:
    """Add the struct ``name``: ``n_words, n_hit, n_items, items, contaminated``.

    A window is ``window`` consecutive words of a benchmark item, or all of a
    shorter item. A document word inside any occurrence is hit; a document is
    contaminated if a twentieth of its words are. Windows that several items
    share count for each. Null and empty texts have no words, items without
    words no windows; an empty benchmark hits nothing, an empty table gives no
    rows. Rows are searched one by one and whole, however long, so repeated
    rows and ids don't matter and nothing shuffles. A null item id is the empty
    text. An input column called ``name``, in any case of letters, is replaced.

    The search tables are broadcast in parts of ``windows_per_table`` windows.
    A benchmark of one part takes one pass over the documents; each further
    part takes one more, and the marks so far are written between the passes.
    """
    spark = documents.sparkSession
    marks = free_name(documents, "marks")
    mark_type = T.StructType(
        [
            T.StructField("hits", T.BinaryType()),
            T.StructField("n_hit", T.LongType()),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )
    frame = documents
    passes = 0
    schema = T.StructType([*documents.schema.fields, T.StructField(marks, mark_type)])
    pending = _tables(benchmark, window, windows_per_table)
    tables = next(pending, {})
    while True:
        following = next(pending, None)
        shared = spark.sparkContext.broadcast(tables)

        def scan(batches, shared=shared, first=passes == 0):
            tables = shared.value
            for batch in batches:
                out = []
                earlier = [None] * batch.num_rows if first else batch.column(marks).to_pylist()
                for body, before in zip(batch.column(text).to_pylist(), earlier, strict=True):
                    words = words_of(body)
                    hits = bytearray(before["hits"]) if before else bytearray(len(words))
                    items = set(before["items"]) if before else set()
                    _mark(words, tables, hits, items)
                    out.append({"hits": bytes(hits), "n_hit": sum(hits), "items": sorted(items)})
                kind = pa.struct([("hits", pa.binary()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string()))])
                kept = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != marks]
                names = [c for c in batch.schema.names if c != marks]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(out, kind)], [*names, marks])

        frame = frame.mapInArrow(scan, schema)
        passes += 1
        if following is None:
            break
        frame = stage_table(frame, "marks")
        tables = following
    hits = F.col(marks)["hits"]
    n_words = F.length(hits).cast("long")
    n_hit = F.col(marks)["n_hit"]
    overlap = F.struct(
        n_words.alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(F.col(marks)["items"]).cast("long").alias("n_items"),
        F.col(marks)["items"].alias("items"),
        ((n_hit > 0) & (20 * n_hit >= n_words)).alias("contaminated"),
    )
    return frame.withColumn(name, overlap).drop(marks)


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6_SQL = f"""
WITH docs AS (
  SELECT doc_id, {_WORDS_SQL} AS w FROM documents
), items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS_SQL} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
  FROM items, unnest(range(1, len(w) - least(13, len(w)) + 2)) t(i) WHERE len(w) > 0
), places AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS win
  FROM docs, (SELECT DISTINCT m FROM windows), unnest(range(1, len(w) - m + 2)) t(i)
), hits AS (
  SELECT doc_id, i, m, item FROM places JOIN windows USING (m, win)
), hit_words AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, list_sort(list(DISTINCT item)) AS found FROM hits GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(found), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(found, ','), '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def op6_query(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    rows = contamination(documents.select("doc_id", "text"), benchmark)
    o = F.col("overlap")
    return rows.select(
        "doc_id",
        o["n_words"].alias("n_words"),
        o["n_hit"].alias("n_hit"),
        o["n_items"].alias("n_items"),
        items_digest(o["items"]).alias("items_sha256"),
        o["contaminated"].alias("contaminated"),
    )
