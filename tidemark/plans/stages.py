"""Stages that a job which starts again doesn't run twice."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def _whole(spark: SparkSession, path: str) -> bool:
    """Whether the job that wrote ``path`` was committed."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(mark)


def resumed(spark: SparkSession, folder: str, name: str, settings: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of stage ``name``: reread if a whole one of the same ``settings`` lies in ``folder``, else built and written.

    ``folder`` is one that all executors share. What a lost or cancelled job
    left half written is overwritten; other settings have a table of their own.
    """
    path = f"{folder.rstrip('/')}/{name}-{hashlib.sha256(settings.encode()).hexdigest()[:16]}"
    if not _whole(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def fingerprints(inputs: DataFrame, keys: list[str], settings: str = "") -> DataFrame:
    """``keys`` with ``fingerprint``, which changes with any row of the key in ``inputs`` and with ``settings``, but not with the rows' order."""
    row = F.xxhash64(*[F.col(c) for c in inputs.columns])
    sums = inputs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.bit_xor(row).alias("_xor"), F.sum(F.pmod(row, F.lit(1 << 31))).alias("_sum"))
    text = F.concat_ws(":", F.lit(hashlib.sha256(settings.encode()).hexdigest()), "_n", "_xor", "_sum")
    return sums.select(*keys, F.sha2(text, 256).alias("fingerprint"))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(Column.__and__, [a[k].eqNullSafe(b[k]) for k in keys])


def resumed_by_key(
    spark: SparkSession,
    folder: str,
    name: str,
    inputs: DataFrame,
    keys: list[str],
    settings: str,
    build: Callable[[DataFrame], DataFrame],
    parts: int = 8,
) -> DataFrame:
    """The rows that ``build`` gives for ``inputs``, made key by key at most once for the same inputs and settings.

    ``build`` takes some keys' rows of ``inputs`` and gives rows with ``keys``.
    Keys are dealt into ``parts`` commits. Each appends its rows, then writes
    down its keys with the fingerprints of their inputs; rows of a commit that
    isn't written down don't count. So a job that was killed, or whose inputs
    or settings changed in some keys, makes no more than what is missing. Keys
    that are no longer in ``inputs`` are left out of the result; null keys are
    keys.

    All matching is by key in shuffles; the driver gets the numbers of the
    parts that have work. Old rows stay in ``folder`` until it is removed.
    """
    base = f"{folder.rstrip('/')}/{name}"
    wanted = fingerprints(inputs, keys, settings)
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).alias("_part")
    kept = [*keys, "fingerprint"]

    def done() -> DataFrame:
        if not _whole(spark, f"{base}/done"):
            return wanted.where("false").withColumn("batch", F.lit(""))
        return spark.read.schema(StructType([*wanted.schema.fields, StructField("batch", StringType())])).parquet(f"{base}/done")

    todo = wanted.join(known := done().select(*kept), _same(wanted, known, kept), "left_anti").select(*keys, part)
    for row in todo.select("_part").distinct().orderBy("_part").collect():
        batch = uuid.uuid4().hex
        mine = wanted.join(known := done().select(*kept), _same(wanted, known, kept), "left_anti").where(part == row["_part"])
        some = inputs.join(mine, _same(inputs, mine, keys), "left_semi")
        build(some).withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{base}/rows")
        mine.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{base}/done")
    if not _whole(spark, f"{base}/rows"):
        return build(inputs.where("false"))
    # Two jobs at once may both have made a key; the smaller batch counts.
    every = done()
    current = every.join(wanted, _same(every, wanted, kept), "left_semi").groupBy(*keys).agg(F.min("batch").alias("batch"))
    made = spark.read.parquet(f"{base}/rows")
    return made.join(current, _same(made, current, [*keys, "batch"]), "left_semi").drop("batch")
