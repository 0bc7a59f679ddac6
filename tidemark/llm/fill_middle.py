"""Fill-in-the-middle: documents cut in three and put together in another order."""

from __future__ import annotations

import re
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let

#: A word with the white space before it, or white space at the end.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Marks before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
_CUTS = "n long, first long, second long"


def cut_points(text: str, low: int, high: int, unit: re.Pattern[str]) -> tuple[int, int, int]:
    """Number n of units of ``text``, and where two prefixes end: those of the
    smaller and of the larger of ``low % (n + 1)`` and ``high % (n + 1)`` units.

    The text is matched twice. The first pass only counts; the second advances
    the same lazy matcher to one rank, then on to the other. No units are kept,
    so beside the text itself the memory doesn't grow with it.
    """
    n = sum(1 for _ in unit.finditer(text))
    ranks = sorted((low % (n + 1), high % (n + 1)))
    matches, passed, ends, end = unit.finditer(text), 0, [], 0
    for rank in ranks:
        # The rank-th match, if it lies ahead; else the place reached stays.
        if (match := next(islice(matches, rank - passed - 1, None), None) if rank > passed else None) is not None:
            end = match.end()
        passed = rank
        ends.append(end)
    return n, ends[0], ends[1]


def _number(digest: Column, k: int) -> Column:
    """The k-th group of eight hexadecimal digits, from 0."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(
    documents: DataFrame,
    name: str = "fim",
    seed: int = 42,
    plain_percent: int = 50,
    spm_percent: int = 80,
    sentinels: tuple[str, str, str] = SENTINELS,
    unit: str = UNIT,
) -> DataFrame:
    """Add the struct ``name``: ``n, form, prefix_chars, middle_chars, output``.

    ``unit`` is a pattern whose matches, one after the other, are the whole
    text. Cuts, form and order come from sha256 of ``seed:doc_id``, so reruns
    agree and no row depends on another. ``form`` is ``plain`` for about
    100 - ``plain_percent`` of documents, for empty texts and for those that
    hold a sentinel; ``spm_percent`` of the others have the suffix first.
    Lengths are code points, null for ``plain``.

    Null texts count as empty, null ids as empty text in the seed. Repeated
    rows have the same cuts; an empty table gives no rows; very long texts cost
    two passes and no list. Nothing shuffles. An input column called ``name``,
    in any case of letters, is replaced.
    """
    documents = documents.drop(name)
    prefix_mark, suffix_mark, middle_mark = (F.lit(s) for s in sentinels)
    digest, cuts = free_name(documents, "digest"), free_name(documents, "cuts")
    pattern = re.compile(unit)

    @F.pandas_udf(_CUTS)
    def cut(texts: pd.Series, lows: pd.Series, highs: pd.Series) -> pd.DataFrame:
        rows = (cut_points(text, low, high, pattern) for text, low, high in zip(texts, lows, highs, strict=True))
        return pd.DataFrame(rows, columns=["n", "first", "second"]).astype("int64")

    text = F.coalesce(F.col("text"), F.lit(""))
    seeded = documents.withColumn(digest, F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256))
    at = seeded.withColumn(cuts, cut(text, _number(F.col(digest), 0), _number(F.col(digest), 1)))
    marked = F.contains(text, prefix_mark) | F.contains(text, suffix_mark) | F.contains(text, middle_mark)
    form = (
        F.when((text == "") | marked | (_number(F.col(digest), 2) % 100 >= plain_percent), "plain")
        .when(_number(F.col(digest), 3) % 100 < spm_percent, "spm")
        .otherwise("psm")
    )
    first, second = (F.col(cuts)[c].cast("int") for c in ("first", "second"))

    def put_together(kind: Column) -> Column:
        prefix, middle, suffix = F.substring(text, F.lit(1), first), F.substring(text, first + 1, second - first), F.substr(text, second + 1)
        output = (
            F.when(kind == "plain", text)
            .when(kind == "psm", F.concat(prefix_mark, prefix, suffix_mark, suffix, middle_mark, middle))
            .otherwise(F.concat(suffix_mark, suffix, prefix_mark, prefix, middle_mark, middle))
        )
        cut_up = kind != "plain"
        return F.struct(
            F.col(cuts)["n"].alias("n"),
            kind.alias("form"),
            F.when(cut_up, first.cast("long")).alias("prefix_chars"),
            F.when(cut_up, (second - first).cast("long")).alias("middle_chars"),
            output.alias("output"),
        )

    return at.withColumn(name, let(form, put_together)).drop(digest, cuts)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text of which ``fill_in_middle`` made ``output``; null if a sentinel that the form needs is missing.

    No text that was cut holds a sentinel, and none can end inside one, so the
    first occurrence of each is the one that was put in.
    """
    prefix_mark, suffix_mark, middle_mark = sentinels

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        at, end = F.locate(second, output), F.locate(middle_mark, output)
        start = len(first) + 1
        one = F.substring(output, F.lit(start), at - start)
        two = F.substring(output, at + len(second), end - at - len(second))
        whole = F.startswith(output, F.lit(first)) & (at > 0) & (end > at)
        return F.when(whole, one), two, F.substr(output, end + len(middle_mark))

    prefix, suffix, middle = parts(prefix_mark, suffix_mark)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(suffix_mark, prefix_mark)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)


def op12_query(documents: DataFrame) -> DataFrame:
    fim = F.col("fim")
    return fill_in_middle(documents.select("doc_id", "text")).select(
        "doc_id",
        fim["n"].alias("n"),
        fim["form"].alias("form"),
        fim["prefix_chars"].alias("prefix_chars"),
        fim["middle_chars"].alias("middle_chars"),
        F.sha2(fim["output"], 256).alias("output_sha256"),
        F.sha2(restored(fim["output"], fim["form"]), 256).alias("restored_sha256"),
    )


OP12_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents
), units AS (
  SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    ('0x' || substr(digest, 1, 8))::BIGINT AS h1, ('0x' || substr(digest, 9, 8))::BIGINT AS h2,
    ('0x' || substr(digest, 17, 8))::BIGINT AS h3, ('0x' || substr(digest, 25, 8))::BIGINT AS h4
  FROM texts
), ranked AS (
  SELECT *, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM units
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
    array_to_string(units[b + 1:], '') AS suffix
  FROM ranked
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(prefix || middle || suffix) AS restored_sha256
FROM parts
"""
