"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from .common import SPACE_CLASS, free_name, in_order, stage_table

#: Rows of one source that one task ranks; larger sources are salted.
ROWS_PER_SALT = 2_000
#: Seeded starts of the draw among which each group takes the one nearest its words.
STARTS = 16
#: So often a group's draw is mended by an exchange of two documents.
EXCHANGES = 3
#: So many sources at most are broadcast; of more, those that hold one in so many
#: documents, which are fewer, and the join shuffles the documents of the others.
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    parts = F.split(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+")
    # A separator at either end leaves one empty part there.
    return F.size(F.array_remove(parts, "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, max_epochs: float) -> DataFrame:
    """Per source: its size, rows and capped water-filled target.

    ``sizes`` has ``source`` and ``size``. Sources by code point, null last,
    take ``weights`` in turn. The budget is ``share`` times all sizes. A source
    whose part of it exceeds ``max_epochs`` times its size is clamped there;
    the excess goes to the others by weight until none is above. That end is
    reached at once: by rising cap per weight, the first k sources are clamped
    where the level of the rest, (budget - their caps) / (weights of the rest),
    exceeds the k-th cap per weight. Sources are placed and summed up by ranges,
    so their number is not limited; the driver gets totals and the level only.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per_source = stage_table(per_source, "source_sizes")
    n = per_source.count()
    placed = in_order(per_source, [F.col("source").asc_nulls_last()], rows=n)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    rated = placed.withColumns({"weight": weight, "cap": cap, "cap_ratio": cap / weight}).drop("place")
    filled = in_order(rated, [F.col("cap_ratio"), F.col("source").asc_nulls_last()], sums={"cap": "caps_before", "weight": "weights_before"}, rows=n)
    filled = stage_table(filled, "sources")
    words, all_weights = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    if words is None:
        return filled.select("source", "source_size", "n_docs", "weight", F.col("cap").alias("target"))
    level = (F.lit(words * float(share)) - F.col("caps_before")) / (F.lit(all_weights) - F.col("weights_before"))
    # The water level is that of the first source which is not clamped.
    water = filled.agg(F.min(F.when(level <= F.col("cap_ratio"), F.struct("cap_ratio", level.alias("level"))))).first()[0]
    target = F.col("cap") if water is None else F.least(F.col("cap"), F.col("weight") * F.lit(water["level"]))
    return filled.select("source", "source_size", "n_docs", "weight", target.alias("target"))


def _with_source(sized: DataFrame, targets: DataFrame, stat: str) -> DataFrame:
    """Rows with their source's row of ``targets`` as the struct ``stat``; no source's rows meet in one task."""
    def joined(rows: DataFrame, of: DataFrame) -> DataFrame:
        return rows.join(of.select(F.struct("source", "source_size", "n_docs", "target").alias(stat)), F.col("source").eqNullSafe(F.col(f"{stat}.source")))

    if targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return joined(sized, F.broadcast(targets))
    total = targets.agg(F.sum("n_docs")).first()[0]
    large = F.col("n_docs") * BROADCAST_SOURCES > F.lit(total)
    names = F.broadcast(targets.where(large).select(F.col("source").alias("_large")))
    others = sized.join(names, F.col("source").eqNullSafe(F.col("_large")), "left_anti")
    return joined(sized, F.broadcast(targets.where(large))).unionByName(joined(others, targets.where(~large)))


def _exchange(group: WindowSpec, size: Column, rank: Column, drawn: Column, wanted: Column) -> Column:
    """The change of a group's draw that brings its words nearest ``wanted``: ranks ``out`` and ``in``, -1 for none.

    A drawn document is best exchanged for one whose size is nearest its own
    less what is drawn too much. Both neighbours of that size among those not
    drawn are found in one order of the group's rows. Fewer changes win ties.
    """
    excess = F.sum(F.when(drawn, size).otherwise(0)).over(group) - wanted
    order = group.orderBy(F.when(drawn, size - excess).otherwise(size), rank)
    other = F.when(~drawn, F.struct(size.alias("size"), rank.alias("rank")))
    below = F.last(other, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    above = F.first(other, ignorenulls=True).over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    none = F.lit(-1)

    def option(miss: Column, changes: int, out: Column, into: Column) -> Column:
        return F.struct(F.abs(miss).alias("miss"), F.lit(changes).alias("changes"), out.alias("out"), into.alias("in"))

    def swap(partner: Column) -> Column:
        return F.when(partner.isNotNull(), option(excess - size + partner["size"], 2, rank, partner["rank"]))

    mine = F.when(drawn, F.least(option(excess - size, 1, rank, none), swap(below), swap(above))).otherwise(option(excess + size, 1, none, rank))
    return F.min(F.least(option(excess, 0, none, none), mine)).over(group)


def mix_sources(
    documents: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    name: str = "mix",
) -> DataFrame:
    """Add the struct ``name``: ``size, source_size, target, repeats, taken``.

    Sizes are words. A source is repeated ``target / source_size`` times: the
    whole part for every document, the rest for a seeded part of them. Those
    are drawn systematically down the source's documents ordered by size, from
    the seeded start of ``STARTS`` whose words come nearest the target. Then
    ``EXCHANGES`` times one drawn document is exchanged for one that isn't, or
    one is dropped or added, whichever comes nearest; so a source of few and
    uneven documents meets its target too, as far as its sizes allow. Large sources are ranked in salted
    groups, each drawn for its own share. The shuffle carries the columns
    given: pass ids alone where texts aren't needed.

    Null and empty texts have size 0. A null source is a source; one without
    words has target 0 and takes nothing. Rows that repeat an id are documents
    of their own; those equal in id and size are interchangeable, as their ties
    are. An empty table gives no rows. Reruns agree: the draw depends on ids,
    sizes and the seed only. An input column called ``name``, in any case of
    letters, is replaced.
    """
    size, key, rate, salt, rank, stat = (free_name(documents, x) for x in ("size", "key", "rate", "salt", "rank", "stat"))
    if "text" in documents.columns:
        sized = documents.withColumn(size, word_count(F.col("text")))
    else:
        sized = documents.withColumnRenamed("size", size)
    targets = stage_table(
        source_targets(sized.select("source", F.col(size).alias("size")), weights, share, max_epochs), "targets"
    )
    joined = _with_source(sized, targets, stat)

    def number(text: Column, at: int) -> Column:
        return F.conv(F.substring(text, at, 8), 16, 10).cast("long")

    rows = joined.withColumns(
        {
            key: F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
            rate: F.when(F.col(stat)["source_size"] > 0, F.col(stat)["target"] / F.col(stat)["source_size"]).otherwise(F.lit(0.0)),
        }
    ).withColumn(salt, number(F.col(key), 25) % F.ceil(F.col(stat)["n_docs"] / ROWS_PER_SALT))
    group = W.partitionBy("source", salt)
    ranked = rows.withColumn(rank, F.row_number().over(group.orderBy(F.col(size).desc(), key)))
    start_key = F.md5(F.concat(F.lit(f"{seed}:start:"), F.coalesce(F.col("source"), F.lit("")), F.lit(":"), F.col(salt).cast("string")))
    first = number(start_key, 1).cast("double") / F.lit(float(2**32))
    whole = F.floor(rate)
    part = F.col(rate) - whole

    def step(k: Column) -> Column:
        start = (first + k) - F.floor(first + k)
        return F.floor(F.col(rank) * part + start) - F.floor((F.col(rank) - 1) * part + start)

    wanted = F.floor(part * F.sum(size).over(group))
    misses = [F.abs(F.sum(step(F.lit(k / STARTS)) * F.col(size)).over(group) - wanted) for k in range(STARTS)]
    miss = [f"{stat}_{k}" for k in range(STARTS)]
    tried = ranked.withColumns(dict(zip(miss, misses, strict=True)))
    best = F.least(*[F.struct(F.col(c).alias("miss"), F.lit(k).alias("k")) for k, c in enumerate(miss)])["k"]
    drawn, change = f"{stat}_drawn", f"{stat}_change"
    chosen = tried.withColumn(f"{stat}_best", best).withColumn(drawn, step(F.col(f"{stat}_best") / F.lit(float(STARTS))) > 0)
    for _ in range(EXCHANGES):
        chosen = chosen.withColumn(change, _exchange(group, F.col(size), F.col(rank), F.col(drawn), wanted))
        stays = F.col(drawn) & (F.col(rank) != F.col(change)["out"])
        chosen = chosen.withColumn(drawn, stays | (F.col(rank) == F.col(change)["in"]))
    repeats = (whole + F.col(drawn).cast("int")).cast("int")
    mix = F.struct(
        F.col(size).alias("size"),
        F.col(stat)["source_size"].alias("source_size"),
        F.col(stat)["target"].alias("target"),
        repeats.alias("repeats"),
        (repeats * F.col(size)).cast("long").alias("taken"),
    )
    return chosen.withColumn(name, mix).drop(size, key, rate, salt, rank, stat, f"{stat}_best", drawn, change, *miss)


def mix_documents(documents: DataFrame, **options) -> DataFrame:
    """Ids and sources of all documents with their ``mix``; texts are measured but not shuffled."""
    return mix_sources(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")), **options)


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM sized GROUP BY source
), rated AS (
  SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
    source_size * 2.0::DOUBLE AS cap FROM per_source
), filled AS (
  SELECT *, cap / weight AS cap_ratio, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
    sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING) - cap AS caps_before,
    sum(weight) OVER () - sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING) + weight AS weights_left
  FROM rated
), levels AS (
  SELECT *, (budget - caps_before) / weights_left AS level FROM filled
), open_level AS (
  SELECT arg_min(level, cap_ratio) AS water FROM levels WHERE level <= cap_ratio
), targets AS (
  SELECT source, source_size, n_docs, coalesce(least(cap, weight * water), cap) AS target FROM levels, open_level
), keyed AS (
  SELECT s.doc_id, s.source, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    md5('17:' || coalesce(s.doc_id::VARCHAR, '')) AS key, ceil(t.n_docs / 2000.0)::BIGINT AS salts
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), salted AS (
  SELECT *, ('0x' || substr(key, 25, 8))::BIGINT % salts AS salt FROM keyed
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source, salt ORDER BY size DESC, key) AS rank,
    ('0x' || substr(md5('17:start:' || coalesce(source, '') || ':' || salt::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS first,
    rate - floor(rate) AS part
  FROM salted
), stepped AS (
  SELECT *, list_transform(range(16), lambda k: floor(rank * part + (first + k / 16.0::DOUBLE - floor(first + k / 16.0::DOUBLE)))
    - floor((rank - 1) * part + (first + k / 16.0::DOUBLE - floor(first + k / 16.0::DOUBLE)))) AS steps
  FROM ranked
), drawn AS (
  SELECT source, salt, k, abs(sum(steps[k + 1] * size) - floor(any_value(part) * sum(size))) AS miss
  FROM stepped, range(16) AS t(k) GROUP BY source, salt, k
), best AS (
  SELECT source, salt, arg_min(k, (miss, k)) AS k FROM drawn GROUP BY source, salt
), drawn0 AS (
  SELECT s.*, steps[b.k + 1] > 0 AS drawn FROM stepped s JOIN best b ON s.source IS NOT DISTINCT FROM b.source AND s.salt = b.salt
)EXCHANGED
SELECT doc_id, size, source_size, round(target, 6) AS target, ((floor(rate) + drawn::INT) * size)::BIGINT AS taken FROM drawnLAST
"""

_EXCHANGE_SQL = r"""
, excess{0} AS (
  SELECT *, sum(CASE WHEN drawn THEN size ELSE 0 END) OVER g - floor(part * sum(size) OVER g) AS excess FROM drawn{0} WINDOW g AS (PARTITION BY source, salt)
), neighbours{0} AS (
  SELECT *, last(CASE WHEN NOT drawn THEN {{'size': size, 'rank': rank}} END IGNORE NULLS) OVER (o ROWS UNBOUNDED PRECEDING) AS below,
    first(CASE WHEN NOT drawn THEN {{'size': size, 'rank': rank}} END IGNORE NULLS) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above
  FROM excess{0} WINDOW o AS (PARTITION BY source, salt ORDER BY CASE WHEN drawn THEN size - excess ELSE size END, rank)
), options{0} AS (
  SELECT *, list_min(list_filter([[abs(excess), 0, -1, -1], CASE WHEN drawn THEN [abs(excess - size), 1, rank, -1] ELSE [abs(excess + size), 1, -1, rank] END,
    CASE WHEN drawn AND below IS NOT NULL THEN [abs(excess - size + below.size), 2, rank, below.rank] END,
    CASE WHEN drawn AND above IS NOT NULL THEN [abs(excess - size + above.size), 2, rank, above.rank] END], lambda x: x IS NOT NULL)) AS mine FROM neighbours{0}
), changed{0} AS (
  SELECT *, min(mine) OVER (PARTITION BY source, salt) AS change FROM options{0}
), drawn{1} AS (
  SELECT * EXCLUDE (excess, below, above, mine, change) REPLACE ((drawn AND rank <> change[3]) OR rank = change[4] AS drawn) FROM changed{0}
)"""
OP4_SQL = OP4_SQL.replace("EXCHANGED", "".join(_EXCHANGE_SQL.format(k, k + 1) for k in range(EXCHANGES))).replace("drawnLAST", f"drawn{EXCHANGES}")


def op4_query(documents: DataFrame) -> DataFrame:
    m = F.col("mix")
    return mix_documents(documents).select(
        "doc_id",
        m["size"].alias("size"),
        m["source_size"].alias("source_size"),
        F.round(m["target"], 6).alias("target"),
        m["taken"].alias("taken"),
    )
