"""Measured series on disk, in folders by time, of which a reader opens those that its windows meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_series(samples: DataFrame, path: str, width: float) -> None:
    """Samples (``entity, t`` and others) below ``path``, one folder for each ``width`` of time, entities together."""
    cut = samples.where("t is not null").withColumn("slot", F.floor(F.col("t") / width).cast("long"))
    cut.repartition("slot", F.pmod(F.xxhash64("entity"), F.lit(16))).sortWithinPartitions("slot", "entity", "t").write.partitionBy("slot").mode("overwrite").parquet(path)


def read_windows(spark: SparkSession, path: str, windows: DataFrame, width: float, margin: float = 0.0) -> DataFrame:
    """The samples of the folders that ``window_start`` to ``window_end`` of any row meets, ``margin`` more at either end.

    Folders are chosen before anything is read. Their numbers are known to
    whoever lists the table, so the driver gets no more than it has anyway.
    """
    first, last = F.floor((F.col("window_start") - margin) / width), F.floor((F.col("window_end") + margin) / width)
    slots = [r[0] for r in windows.where("window_end >= window_start").select(F.explode(F.sequence(first, last))).distinct().collect()]
    return spark.read.parquet(path).where(F.col("slot").isin(slots) if slots else F.lit(False)).drop("slot")
