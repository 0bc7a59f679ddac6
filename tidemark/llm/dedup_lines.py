"""Line deduplication over the whole corpus by range-partitioned line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, free_name, let, running, stage_table

#: A hash that more than one in so many of all lines carry is hot. There are
#: fewer hot hashes than this, so their table may be broadcast.
HOT_SHARE = 2_000

_STRIP = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends and with A-Z lower-cased."""
    return F.translate(F.trim(line, F.lit(_STRIP)), ASCII_UPPER, ASCII_LOWER)


def long_lines(documents: DataFrame, min_chars: int) -> DataFrame:
    """Hashes and places of the lines whose key has ``min_chars`` code points or more.

    A line is known by two 64-bit hashes of its key, a row by its doc_id and a
    hash of its text, so rows that repeat an id don't mix up their places.
    """
    lines = documents.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")).alias("pos", "line"),
    ).where(F.length("line") >= min_chars)
    keyed = lines.select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select(
        F.xxhash64("key").alias("h1"),
        F.xxhash64(F.lit(1), F.col("key")).alias("h2"),
        "doc_id",
        "text_hash",
        "pos",
    )


def dropped_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """Places of the lines to drop: (doc_id, text_hash, pos).

    Hashes are range-partitioned and each partition is sorted by hash, falling
    document and position; the stream of a hash keeps its first document, the
    largest id, and drops the rest if it meets ``min_docs`` ids in all. Hot
    hashes, found by a mergeable top-k sketch, would crowd into one range:
    their document counts and largest ids are summed up beforehand, task by
    task, and joined back from a table of at most ``HOT_SHARE`` hashes.
    """
    sketch = lines.agg(
        F.count(F.lit(1)).alias("n"),
        F.expr(f"approx_top_k(h1, {HOT_SHARE}, {8 * HOT_SHARE})").alias("top"),
    )
    n, top = sketch.first()
    hot = [r["item"] for r in top or [] if r["item"] is not None and r["count"] * HOT_SHARE > n][:HOT_SHARE]
    place = ["doc_id", "text_hash", "pos"]
    if hot:
        hot_keys = F.broadcast(lines.sparkSession.createDataFrame([(h,) for h in hot], "h1 long"))
        hot_lines = lines.join(hot_keys, "h1", "left_semi")
        per_doc = hot_lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        # Grouping by the hash alone keeps one row per hot hash: the table stays bounded.
        per_hash = (
            per_doc.groupBy("h1", "h2")
            .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
            .where(F.col("n_docs") >= min_docs)
        )
        verdicts = per_hash.groupBy("h1").agg(F.collect_list(F.struct("h2", "keeper")).alias("verdicts"))
        hot_drop = (
            hot_lines.join(F.broadcast(verdicts), "h1")
            .where(F.exists("verdicts", lambda v: (v["h2"] == F.col("h2")) & ~v["keeper"].eqNullSafe(F.col("doc_id"))))
            .select(*place)
        )
        lines = lines.join(hot_keys, "h1", "left_anti")
    stream = W.partitionBy("h1", "h2").orderBy(F.col("doc_id").desc_nulls_last())
    # Sorted once, by position too; the windows find their order in place.
    ranged = lines.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", F.col("doc_id").desc_nulls_last(), "pos")
    ranged = ranged.withColumn("nth_doc", F.dense_rank().over(stream))
    whole = stream.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    met = ranged.withColumn("n_docs", F.max("nth_doc").over(whole))
    cold_drop = met.where((F.col("n_docs") >= min_docs) & (F.col("nth_doc") > 1)).select(*place)
    return cold_drop.unionByName(hot_drop) if hot else cold_drop


def keep_bitmaps(documents: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Compressed keep bitmaps of the rows that lose lines, instead of their texts.

    ``doc_id, text_hash, n_dropped, runs``: ``runs`` are the bitmap's run
    lengths, kept and dropped in turn, up to the last dropped line; all lines
    after it are kept. Rows that lose nothing are not listed.
    """
    lines = stage_table(long_lines(documents, min_chars), "lines")
    rows = dropped_lines(lines, min_docs).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    # A run of dropped lines begins where the previous place is not dropped, and ends likewise.
    begins = F.array_except("gone", F.transform("gone", lambda p: p + 1))
    ends = F.transform(F.array_except("gone", F.transform("gone", lambda p: p - 1)), lambda p: p + 1)
    spans = rows.withColumns({"begins": begins, "ends": ends})
    before = F.concat(F.array(F.lit(0)), F.slice("ends", F.lit(1), F.size("ends") - 1))
    runs = F.flatten(
        F.transform(
            F.arrays_zip(F.col("begins"), F.col("ends"), before.alias("before")),
            lambda r: F.array(r["begins"] - r["before"], r["ends"] - r["begins"]),
        )
    )
    return spans.select("doc_id", "text_hash", F.size("gone").cast("long").alias("n_dropped"), runs.alias("runs"))


def _starts(runs: Column) -> Column:
    """Where each run of a bitmap starts."""
    return running(runs, F.lit(0), lambda at, n: at + n)


def dropped_places(runs: Column) -> Column:
    """The dropped places that a bitmap's run lengths stand for."""
    # Runs are kept and dropped in turn, so each pair of them holds one run of dropped places.
    dropped = F.filter(F.arrays_zip(_starts(runs).alias("at"), runs.alias("n")), lambda x, i: i % 2 == 1)
    return F.flatten(F.transform(dropped, lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1)))


def _kept_text(body: Column, runs: Column) -> Column:
    """The text without its dropped lines: kept runs are cut out whole; all after the bitmap's end is kept."""

    def cut(parts: Column) -> Column:
        kept = F.filter(F.arrays_zip(_starts(runs).alias("at"), runs.alias("n")), lambda x, i: i % 2 == 0)
        pieces = F.transform(kept, lambda x: F.slice(parts, x["at"] + 1, x["n"]))
        end = F.aggregate(runs, F.lit(0), lambda a, n: a + n)
        return F.array_join(F.concat(F.flatten(pieces), F.slice(parts, end + 1, F.size(parts))), "\n")

    return let(F.split(body, "\n"), cut)


def apply_bitmaps(documents: DataFrame, bitmaps: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_lines, n_dropped, kept_text`` to documents; input columns of those names, in any case of letters, are replaced.

    The bitmaps are written first, so that their size is known: below Spark's
    threshold they are broadcast and no text is shuffled.
    """
    documents = documents.drop("n_lines", "n_dropped", "kept_text")
    bitmaps = stage_table(bitmaps, "bitmaps")
    key, of, of_hash, n, runs = (free_name(documents, x) for x in ("text_hash", "bitmap_id", "bitmap_hash", "bitmap_dropped", "bitmap_runs"))
    other = bitmaps.toDF(of, of_hash, n, runs)
    joined = documents.withColumn(key, F.xxhash64(text)).join(other, F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(key) == F.col(of_hash)), "left")
    body = F.coalesce(F.col(text), F.lit(""))
    return joined.withColumns(
        {
            "n_lines": (F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).cast("long"),
            "n_dropped": F.coalesce(F.col(n), F.lit(0)).cast("long"),
            "kept_text": F.when(F.col(runs).isNull(), body).otherwise(_kept_text(body, F.col(runs))),
        }
    ).drop(key, of, of_hash, n, runs)


def dedup_lines(documents: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Documents with ``n_lines, n_dropped, kept_text``.

    Lines whose key has ``min_chars`` code points and is found in ``min_docs``
    documents stay only in the largest doc_id. Null and empty texts have one
    empty line. A null id counts as one document, smaller than any other; rows
    that repeat an id count as one document and each keep or lose their own
    lines. Every line is compared, in texts of any length; of equal lines in
    the keeping document all stay. An empty table gives no rows. Input columns
    with the three names are replaced.
    """
    return apply_bitmaps(documents, keep_bitmaps(documents.select("doc_id", "text"), min_chars, min_docs))


def op9_query(documents: DataFrame) -> DataFrame:
    rows = dedup_lines(documents.select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.doc_id, k.pos, k.line, c.keeper IS NOT NULL AND c.keeper <> k.doc_id AS dropped
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
