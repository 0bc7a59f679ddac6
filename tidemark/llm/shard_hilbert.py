"""Sharding along a Hilbert curve over several metadata dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, in_order, stage_table


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index of each row of ``cells`` (n rows, d columns of ``bits`` bits) on the curve.

    The cell coordinates are first turned into the curve's transposed form,
    level by level, and their bits are then interleaved.
    """
    x = [c.astype(np.int64).copy() for c in cells.T]
    d = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(d):
            inverted = (x[i] & level) != 0
            swapped = np.where(inverted, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(inverted, x[0] ^ low, x[0] ^ swapped)
            if i:
                x[i] = x[i] ^ swapped
        level >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        flip = np.where((x[d - 1] & level) != 0, flip ^ (level - 1), flip)
        level >>= 1
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            index = (index << 1) | (((x[i] ^ flip) >> b) & 1)
    return index


def cell_starts(df: DataFrame, dims: list[str], cells: int) -> list[list[tuple[int, object]]]:
    """For each dimension the cells that hold values, with the smallest value of each.

    A value lies in cell ``cells * (rows below it) div (all rows)``, null below
    all; so cells hold about equally many rows and keep the order of whole
    values, texts included. Rows are counted by value task by task and summed
    up over ranges of values; the driver gets at most ``cells`` rows a
    dimension.
    """
    texts = [df.schema[c].dataType.typeName() == "string" for c in dims]
    value = [
        F.struct(
            F.lit(i).alias("dim"),
            (F.col(c) if text else F.lit(None).cast("string")).alias("s"),
            (F.lit(None).cast("double") if text else F.col(c).cast("double")).alias("x"),
        )
        for i, (c, text) in enumerate(zip(dims, texts, strict=True))
    ]
    counts = df.select(F.explode(F.array(*value)).alias("v")).groupBy("v.dim", "v.s", "v.x").agg(F.count(F.lit(1)).alias("n"))
    counts = stage_table(counts, "values")
    # Nulls come first in each dimension, and every dimension counts all rows.
    summed = in_order(counts, [F.col("dim"), F.col("s"), F.col("x")], sums={"n": "before"}, rows=counts.count()).drop("place")
    total = df.count()
    cell = F.expr(f"(before - dim * {total}L) * {cells} div {max(total, 1)}L")
    known = summed.where("s is not null or x is not null").groupBy("dim", cell.alias("cell")).agg(F.min("s").alias("s"), F.min("x").alias("x"))
    starts: list[list[tuple[int, object]]] = [[] for _ in dims]
    for row in sorted(known.collect(), key=lambda r: (r["dim"], r["cell"])):
        starts[row["dim"]].append((row["cell"], row["s"] if texts[row["dim"]] else row["x"]))
    return starts


def _cell(column: Column, starts: list[tuple[int, object]]) -> Column:
    """The last cell whose smallest value is not above the column's; null lies in the lowest."""
    chain = F.when(column.isNull(), F.lit(0))
    for cell, first in reversed(starts):
        chain = chain.when(column >= F.lit(first), F.lit(cell))
    return chain.otherwise(F.lit(0))


def hilbert_shards(
    df: DataFrame,
    dims: list[str],
    n_shards: int,
    tie: list[Column],
    bits: int = 5,
) -> DataFrame:
    """Sort by Hilbert index over ``dims`` and cut the run into equal counts of rows.

    Each dimension is quantised into ``2**bits`` cells of about equally many
    rows, nulls in the lowest; cells keep the order of values, so a shard file
    covers a small box of every dimension, which file statistics prune. Rows of
    one cell are ordered by ``tie``, so a crowded cell is spread over several
    tasks. Returns df with ``hilbert long, shard int, slot long``. Shard counts
    differ by at most one; slots run from 0 without gaps. An empty table gives
    an empty result; rows equal in cells and ties are interchangeable; columns
    of df that have those three names, in any case of letters, are replaced.

    The one shuffle of rows carries df's own columns: pass ids and metadata,
    not texts, where texts aren't needed.
    """
    df = df.drop("hilbert", "shard", "slot")
    starts = cell_starts(df, dims, 2**bits)

    @F.pandas_udf("long")
    def index(*cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([c.to_numpy() for c in cells], axis=1), bits))

    keys = [free_name(df, f"tie{i}") for i in range(len(tie))]
    place, total = free_name(df, "place"), free_name(df, "total")
    curve = df.withColumns({"hilbert": index(*[_cell(F.col(c), s) for c, s in zip(dims, starts, strict=True)]), **dict(zip(keys, tie, strict=True))})
    run = in_order(curve, [F.col("hilbert"), *map(F.col, keys)], place, total)
    # Shard s holds the places from ceil(s * total / n) to before the next shard's first.
    cut = run.withColumn("shard", F.expr(f"`{place}` * {n_shards} div `{total}`").cast("int"))
    first = F.expr(f"(shard * `{total}` + {n_shards - 1}) div {n_shards}")
    return cut.withColumn("slot", F.col(place) - first).drop(place, total, *keys)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order, so that file statistics are tight."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def document_frame(documents: DataFrame) -> DataFrame:
    """Ids and metadata of documents, with size and checksum of the text but not the text."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return documents.select(
        "doc_id",
        "source",
        "lang",
        (F.length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )


def shard_documents(documents: DataFrame, n_shards: int = 40) -> DataFrame:
    """Documents' ids with shard, slot and the law ``rows``.

    Null texts have no bytes (size 16, checksum 0). Null sources and languages
    share the lowest cell. Columns other than those of documents are ignored.
    """
    out = hilbert_shards(
        document_frame(documents),
        ["source", "lang", "size"],
        n_shards,
        [F.col("text_crc32"), F.col("doc_id")],
    )
    return out.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def _hilbert_sql(bits: int, d: int) -> str:
    """Common table expressions that turn cells x0, x1, ... of the table ``cells`` into ``curve.hilbert``, step by step."""
    steps, source = [], "cells"

    def step(**changed: str) -> None:
        nonlocal source
        name = f"turn{len(steps)}"
        steps.append(f"{name} AS (SELECT * REPLACE ({', '.join(f'{v} AS {k}' for k, v in changed.items())}) FROM {source})")
        source = name

    for level in (1 << b for b in range(bits - 1, 0, -1)):
        low = level - 1
        for i in range(d):
            inverted = f"x{i} & {level} <> 0"
            swapped = f"(xor(x0, x{i}) & {low})"
            changed = {"x0": f"CASE WHEN {inverted} THEN xor(x0, {low}) ELSE xor(x0, {swapped}) END"}
            if i:
                changed[f"x{i}"] = f"CASE WHEN {inverted} THEN x{i} ELSE xor(x{i}, {swapped}) END"
            step(**changed)
    for i in range(1, d):
        step(**{f"x{i}": f"xor(x{i}, x{i - 1})"})
    for level in (1 << b for b in range(bits - 1, 0, -1)):
        step(flip=f"CASE WHEN x{d - 1} & {level} <> 0 THEN xor(flip, {level - 1}) ELSE flip END")
    parts = [f"(((xor(x{i}, flip) >> {b}) & 1) << {b * d + d - 1 - i})" for b in range(bits) for i in range(d)]
    return f"{', '.join(steps)}, curve AS (SELECT *, {' + '.join(parts)} AS hilbert FROM {source})"


def _cell_sql(column: str, cells: int) -> str:
    return f"((rank() OVER (ORDER BY {column} NULLS FIRST) - 1) * {cells} // count(*) OVER ())::BIGINT"


# The checksum's table follows from its polynomial.
_CRC_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
OP8_SQL = f"""
WITH RECURSIVE crc_steps(i, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, {_CRC_STEP.format("v")} FROM crc_steps WHERE k < 8
), crc_table AS (
  SELECT list(v ORDER BY i) AS crc FROM crc_steps WHERE k = 8
), docs AS (
  SELECT doc_id, source, lang, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
      lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS text_crc32
  FROM documents, crc_table
), cells AS (
  SELECT *, CASE WHEN source IS NULL THEN 0 ELSE {_cell_sql("source", 32)} END AS x0, CASE WHEN lang IS NULL THEN 0 ELSE {_cell_sql("lang", 32)} END AS x1,
    {_cell_sql("size", 32)} AS x2, 0::BIGINT AS flip FROM docs
), {_hilbert_sql(5, 3)}, placed AS (
  SELECT *, row_number() OVER (ORDER BY hilbert, text_crc32, doc_id) - 1 AS place, count(*) OVER () AS total FROM curve
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place * 40 // total)::INT AS shard, place - (place * 40 // total * total + 39) // 40 AS slot,
  NULL::INT AS grown_shard, hilbert FROM placed
"""


def op8_query(documents: DataFrame) -> DataFrame:
    return shard_documents(documents).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "hilbert"
    )
