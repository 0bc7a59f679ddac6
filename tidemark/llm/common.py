"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import in_order
from ..operators.ordering import unused as free_name
from ..sources.scratch import remove_table, settled, shared_dir, stage_table, temporary_tables

__all__ = [
    "ASCII_LOWER", "ASCII_UPPER", "SPACE_CLASS", "free_name", "in_order", "labelled_sample", "let", "near_start", "one_text", "read_table",
    "remainder_of_crc32", "remove_table", "running", "settled", "shared_dir", "stage_table", "temporary_tables",
]

#: Word separators used by every operator: space, tab, \n, \v, \f and \r.
SPACE_CLASS = r"[\x20\x09-\x0D]"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()
#: Hashes are dealt over so many places when a part of them is taken.
_PLACES = 1 << 30


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, use) -> Column:
    """``use`` sees ``value`` as a variable, so it is computed once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(items: Column, start: Column, step, block: int = 256) -> Column:
    """The state before each item, where ``step(state, item)`` gives the next state.

    States are built block by block, so that no array grows by one element for
    each of a long list's items.
    """

    def blocked(blocks: Column) -> Column:
        firsts = F.aggregate(
            blocks, F.array(start), lambda seen, part: F.concat(seen, F.array(F.aggregate(part, F.element_at(seen, -1), step)))
        )

        def inside(x: Column) -> Column:
            states = F.aggregate(x["part"], F.array(x["first"]), lambda seen, i: F.concat(seen, F.array(step(F.element_at(seen, -1), i))))
            return F.slice(states, F.lit(1), F.size(x["part"]))

        return F.flatten(F.transform(F.arrays_zip(blocks.alias("part"), firsts.alias("first")), lambda x: F.when(x["part"].isNull(), F.array_repeat(start, 0)).otherwise(inside(x))))

    parts = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(items) - 1) / block).cast("int")), lambda b: F.slice(items, b * block + 1, F.lit(block))
    )
    return F.when(F.size(items) > 0, let(parts, blocked)).otherwise(F.array_repeat(start, 0))


def remainder_of_crc32(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def near_start(ids: Column, distinct: Column, wanted: int) -> Column:
    """Does the hash of the ids lie in the part of all hashes that holds about a fifth more than ``wanted`` of ``distinct`` ids?

    It keeps the sort that picks exactly ``wanted`` of them short.
    """
    return F.pmod(F.xxhash64(ids), F.lit(_PLACES)) * distinct.cast("double") <= (1.2 * wanted + 50) * _PLACES


def labelled_sample(labels: DataFrame, label: str, bound: int, where: Column) -> DataFrame:
    """At most ``bound`` labelled ids, the same ones on every run: ``doc_id, label``.

    Null ids and labels are left out; an id with several labels takes the
    smallest. The order is that of a hash of the id, so the sample is spread
    evenly. Its size is bounded, so the result may be broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & where)
    about = known.agg(F.approx_count_distinct("doc_id", 0.02)).first()[0]
    rows = known.where(near_start(F.col("doc_id"), F.lit(about), bound)).groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("label"))
    return rows.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(_PLACES)), "doc_id").limit(bound)


def one_text(documents: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    """The columns of ``ids`` with one ``text`` for each of its rows, the smallest of rows that repeat the keys.

    ``ids`` has a bounded number of rows and is broadcast. Tasks send no more
    than one text an id, however many rows repeat it.
    """
    rows = documents.select(*keys, "text").join(F.broadcast(ids), keys)
    return rows.groupBy(*ids.columns).agg(F.min("text").alias("text"))
