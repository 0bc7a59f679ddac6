"""Views over the supplied tables in the shape the series operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task sorts at most, about; a row kept by several sorts of a stage takes some 3 KB there.
TASK_ROWS = 100_000


def dealt(rows: DataFrame, key: str, copies: int = 1) -> DataFrame:
    """Rows dealt by ``key`` over so many tasks that what each of them sorts fits in its memory, however large the table.

    Left to itself, Spark sizes tasks by the bytes of the exchange, whereas
    what follows makes rows many times wider. ``copies`` is how often a row is
    repeated behind the exchange. Counting reads no column.
    """
    n = -(-rows.count() * copies // TASK_ROWS)
    return rows.repartition(max(n, rows.sparkSession.sparkContext.defaultParallelism), key) if n > 1 else rows


def seconds(ts) -> F.Column:
    """A timestamp without zone as seconds, read in the session's zone (UTC)."""
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a measured series: ``entity, idx, t, motion, sharpness``."""
    order = W.partitionBy("entity").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumnRenamed("user_id", "entity").select(
        "entity",
        (F.row_number().over(order) - 1).cast("long").alias("idx"),
        seconds("ts").alias("t"),
        F.col("value").alias("motion"),
        F.get_json_object("props", "$.k").cast("double").alias("sharpness"),
    )


SAMPLES_SQL = """
samples AS (
  SELECT user_id AS entity, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
    epoch_us(ts) / 1e6 AS t, value AS motion, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS sharpness
  FROM events
)"""

_LINE_ORDER = [
    "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def candidates(spark: SparkSession, sf_dir: str, copies: int = 1) -> DataFrame:
    """Order lines as candidates of a spread.

    ``spread, cand, t, sharpness, motion, hand (null where not measured), glare,
    distortion, flatness, clipping, exposure``. Lines may be equal in all
    columns; then they are interchangeable. ``copies`` is how often a query
    repeats them.
    """
    order = W.partitionBy("spread").orderBy(*_LINE_ORDER)
    return dealt(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "spread"), "spread", copies).select(
        "spread",
        (F.row_number().over(order) - 1).cast("long").alias("cand"),
        seconds("l_shipdate").alias("t"),
        (F.col("l_extendedprice") / 100).alias("sharpness"),
        (F.col("l_discount") / 4).alias("motion"),
        F.when(F.col("l_returnflag") != "R", F.col("l_tax") / 4).alias("hand"),
        F.when(F.col("l_quantity") > 40, (F.col("l_quantity") - 40) / 500).otherwise(F.lit(0.0)).alias("glare"),
        (F.col("l_suppkey") % 40 / 100).alias("distortion"),
        (F.col("l_suppkey") % 7 / 10).alias("flatness"),
        (F.col("l_partkey") % 11 / 50).alias("clipping"),
        (F.col("l_partkey") % 50 / 100).alias("exposure"),
    )


CANDIDATES_SQL = f"""
candidates AS (
  SELECT l_orderkey AS spread, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE_ORDER)}) - 1 AS cand,
    epoch_us(l_shipdate) / 1e6 AS t, l_extendedprice / 100 AS sharpness, l_discount / 4 AS motion,
    CASE WHEN l_returnflag <> 'R' THEN l_tax / 4 END AS hand,
    CASE WHEN l_quantity > 40 THEN (l_quantity - 40) / 500 ELSE 0.0::DOUBLE END AS glare,
    (l_suppkey % 40) / 100 AS distortion, (l_suppkey % 7) / 10 AS flatness,
    (l_partkey % 11) / 50 AS clipping, (l_partkey % 50) / 100 AS exposure
  FROM lineitem
)"""


#: Document ids that make one block of projects.
PROJECT_IDS = 20_000


def review_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as output pages of a project: a source's documents with ids of one block of ``PROJECT_IDS``.

    A project stays small however much a source holds, as its pages are ordered
    by one task.
    ``project, page, position, spread, side, enabled, suspect, final_reasons``.
    Labels cover some documents only; an unlabelled one has no label reasons.
    """
    block = F.floor(F.col("doc_id") / PROJECT_IDS).cast("string")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", F.col("source"), block).alias("project"), "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    joined = docs.join(labels, "doc_id", "left")
    order = W.partitionBy("project").orderBy("doc_id")
    return joined.select(
        "project",
        F.col("doc_id").alias("page"),
        (F.row_number().over(order) - 1).cast("long").alias("position"),
        F.floor(F.col("doc_id") / 2).cast("long").alias("spread"),
        F.element_at(F.array(*map(F.lit, ("spread", "left", "right", "cover"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("side"),
        (F.col("doc_id") % 7 != 3).alias("enabled"),
        F.array_compact(
            F.array(
                F.when(F.col("n_chars") < 300, F.lit("low_sharpness")),
                F.when(F.col("toxic") == 1, F.lit("glare_overlap")),
                F.when(F.col("doc_id") % 11 == 5, F.lit("page_quad_uncertain")),
            )
        ).alias("suspect"),
        F.array_compact(
            F.array(
                F.when(F.col("quality") == 0, F.lit("final_edge_crop_suspected")),
                F.when(F.col("n_chars") > 5000, F.lit("final_glare_residual")),
            )
        ).alias("final_reasons"),
    )


REVIEW_PAGES_SQL = f"""
review_pages AS (
  SELECT concat_ws('/', source, (d.doc_id // {PROJECT_IDS})::VARCHAR) AS project, d.doc_id AS page,
    row_number() OVER (PARTITION BY source, d.doc_id // {PROJECT_IDS} ORDER BY d.doc_id) - 1 AS position,
    d.doc_id // 2 AS spread, ['spread', 'left', 'right', 'cover'][(d.doc_id % 4 + 1)::INT] AS side, d.doc_id % 7 <> 3 AS enabled,
    list_filter([CASE WHEN n_chars < 300 THEN 'low_sharpness' END, CASE WHEN toxic = 1 THEN 'glare_overlap' END,
      CASE WHEN d.doc_id % 11 = 5 THEN 'page_quad_uncertain' END], lambda x: x IS NOT NULL) AS suspect,
    list_filter([CASE WHEN quality = 0 THEN 'final_edge_crop_suspected' END,
      CASE WHEN n_chars > 5000 THEN 'final_glare_residual' END], lambda x: x IS NOT NULL) AS final_reasons
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""


#: Raster ids that make one block of groups.
GROUP_IDS = 20_000


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings of 64 numbers as rasters of 8 by 8: ``id, grp, pixels``.

    A group is a label's rasters with ids of one block, so that a sequence
    which one task orders stays short.
    """
    block = F.floor(F.col("vec_id") / GROUP_IDS) * 1000
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), (F.col("label") + block).cast("long").alias("grp"), F.col("embedding").alias("pixels")
    )


GROUP_SQL = f"(label + vec_id // {GROUP_IDS} * 1000)::BIGINT"
