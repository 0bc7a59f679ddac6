"""Named queries of previews: two vectors that follow each other are the halves of one of 8 by 16 grey values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalog import query
from .functions import previews
from .sources.adapters import table

_ROWS, _COLUMNS, _WIDTH = 8, 16, 5
_GREY = "least(255, greatest(0, round_even(embedding[{0}]::DOUBLE * 64 + 128, 0)))"

#: A preview is compared with the one two places on, or, one in three, with itself a little changed.
_PREVIEWS_SQL = f"""halves AS (
  SELECT vec_id // 2 AS id, vec_id % 2 AS side, [{", ".join(_GREY.format(i + 1) for i in range(64))}] AS p FROM embeddings
), whole AS (
  SELECT a.id, list_transform(range(128), lambda i: CASE WHEN i % 16 < 8 THEN a.p[i // 16 * 8 + i % 16 + 1] ELSE b.p[i // 16 * 8 + i % 16 - 7] END) AS p
  FROM halves a JOIN halves b ON a.id = b.id AND a.side = 0 AND b.side = 1
), paired AS (
  SELECT w.id, w.p, CASE WHEN w.id % 3 = 0 THEN list_transform(range(128), lambda i: CASE WHEN i % 7 = w.id % 7 THEN least(255, w.p[i + 1] + 2) ELSE w.p[i + 1] END) ELSE l.p END AS q FROM whole w LEFT JOIN whole l ON l.id = w.id + 2
)"""
_SMALL_SQL = "list_transform(range(72), lambda k: round_even(round(list_sum(list_transform(range(16), lambda j: greatest(0, least((k % 9 + 1) * 16 / 9, j + 1) - greatest(k % 9 * 16 / 9, j)) / (16 / 9) * {0}[k // 9 * 16 + j + 1])), 6), 0))"
_DIFFER_SQL = "list_sum(list_transform(range(64), lambda k: ((s[k // 8 * 9 + k % 8 + 2] > s[k // 8 * 9 + k % 8 + 1]) <> (t[k // 8 * 9 + k % 8 + 2] > t[k // 8 * 9 + k % 8 + 1]))::INT))"
_KERNEL = previews.gaussian(_WIDTH, 1.5).tolist()


@query(
    f"""
WITH {_PREVIEWS_SQL}, small AS (
  SELECT id, {_SMALL_SQL.format("p")} AS s, {_SMALL_SQL.format("q")} AS t FROM paired WHERE q IS NOT NULL
), kernel AS (
  SELECT y, x, {_KERNEL}[y + 1] * {_KERNEL}[x + 1] AS g FROM range({_WIDTH}) a(y), range({_WIDTH}) b(x)
), windows AS (
  SELECT view, y, x FROM range({_ROWS - _WIDTH + 1}) a(y), range({_COLUMNS - _WIDTH + 1}) b(x), (VALUES ('whole', 0, 15), ('left', 0, 7), ('right', 8, 15)) v(view, first, last) WHERE x >= first AND x + {_WIDTH - 1} <= last
), moments AS (
  SELECT id, view, w.y, w.x, sum(g * a) AS ma, sum(g * b) AS mb, sum(g * a * a) AS aa, sum(g * b * b) AS bb, sum(g * a * b) AS ab FROM (
    SELECT p.id, w.view, w.y, w.x, k.g, p.p[(w.y + k.y) * 16 + w.x + k.x + 1] AS a, p.q[(w.y + k.y) * 16 + w.x + k.x + 1] AS b FROM paired p, windows w, kernel k WHERE p.q IS NOT NULL) w
  GROUP BY id, view, w.y, w.x
), views AS (
  SELECT id, view, avg((2 * ma * mb + 6.5025::DOUBLE) * (2 * (ab - ma * mb) + 58.5225::DOUBLE)
    / ((ma * ma + mb * mb + 6.5025::DOUBLE) * (greatest(0, aa - ma * ma) + greatest(0, bb - mb * mb) + 58.5225::DOUBLE))) AS likeness FROM moments GROUP BY id, view
), least_of AS (
  SELECT id, min(likeness) AS likeness FROM views GROUP BY id
), measured AS (
  SELECT p.id, least(list_stddev_pop(p), list_stddev_pop(q)) AS contrast, {_DIFFER_SQL}::INT AS bits, likeness FROM paired p JOIN small s ON s.id = p.id JOIN least_of l ON l.id = p.id
)
SELECT id, round(contrast, 6) AS contrast, bits, round(likeness, 6) AS likeness, contrast >= 8 AND bits <= 4 AND round(likeness, 9) >= 0.99::DOUBLE AS same FROM measured
"""
)
def same_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two previews show the same page: contrast, bits of a 64-bit hash, and the least windowed similarity of whole and halves."""
    c = F.col
    grey = F.transform("embedding", lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.bround(x.cast("double") * 64 + 128))))
    halves = table(spark, sf_dir, "embeddings").select(F.floor(c("vec_id") / 2).cast("long").alias("id"), (c("vec_id") % 2).alias("side"), grey.alias("p"))
    both = halves.groupBy("id").agg(F.max(F.when(c("side") == 0, c("p"))).alias("a"), F.max(F.when(c("side") == 1, c("p"))).alias("b")).where("a is not null and b is not null")
    joined = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.concat(F.slice("a", r * 8 + 1, F.lit(8)), F.slice("b", r * 8 + 1, F.lit(8)))))
    whole = both.select("id", joined.alias("p"))
    later = whole.select((c("id") - 2).alias("id"), c("p").alias("q"))
    changed = F.transform("p", lambda v, i: F.when(i % 7 == c("id") % 7, F.least(F.lit(255.0), v + 2)).otherwise(v))
    pairs = whole.join(later, "id", "left").withColumn("q", F.when(c("id") % 3 == 0, changed).otherwise(c("q"))).where("q is not null")
    found = pairs.select("id", previews.compared(c("p"), c("q"), _ROWS, _COLUMNS, _WIDTH, size=None).alias("m"))
    same = previews.same_page(F.struct(c("m.contrast").alias("contrast"), c("m.bits").alias("bits"), F.round("m.similar", 9).alias("similar")))
    return found.select("id", F.round("m.contrast", 6).alias("contrast"), "m.bits", F.round("m.similar", 6).alias("likeness"), same.alias("same"))
