"""A training corpus from raw documents: filter, deduplicate, decontaminate, mix, shard.

Every stage takes all documents that the one before kept and, but for the
last, returns the columns of documents, whatever else these are called. A
stage given an empty table returns an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, dedup_minhash, mix_sources, quality_rules, shard_hilbert
from tidemark.llm.common import free_name, read_table, remove_table, shared_dir, temporary_tables

N_SHARDS = 40


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned quality rules keep.

    Null and empty texts have too few words and go. Rows are judged one by one,
    so equal texts share their fate, however long, and repeated rows stay
    repeated. Null ids teach nothing but are judged.
    """
    rules = quality_rules.learn_rules(docs, read_table(spark, sf_dir, "labels"))
    verdict = free_name(docs, "quality")
    judged = quality_rules.judge_quality(docs, rules, name=verdict)
    return judged.where(F.col(verdict)["kept"]).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, by shingles of five words.

    The smallest id of a component stays, as one row; rows with null ids stay
    only for texts that no id has, one for each. Texts without words are alike
    to nothing and stay, but of rows that repeat an id only one. Whole texts
    are compared.
    """
    return dedup_minhash.drop_near_duplicates(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text.

    Null and empty texts have no words and stay, as do repeated rows; texts are
    searched whole.
    """
    overlap = free_name(docs, "overlap")
    searched = decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"), name=overlap)
    return searched.where(~F.col(overlap)["contaminated"]).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources come near their target weights.

    A null source is a source. Texts without words weigh nothing and are drawn
    like others of their source. Repeated rows are documents of their own; the
    draw depends on ids and sizes, so rows equal in both are interchangeable.
    """
    name, copy = free_name(docs, "mix"), free_name(docs, "copy")
    mixed = mix_sources.mix_sources(docs, name=name)
    repeated = mixed.where(F.col(name)["repeats"] > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(name)["repeats"])))
    return repeated.select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with shard and slot along the Hilbert curve.

    Null sources, languages and texts (size 0) lie lowest. Rows equal in
    checksum and id are interchangeable. Columns of the input called hilbert,
    shard or slot, in any case of letters, are replaced or left out.
    """
    size = free_name(docs, "size")
    sized = docs.withColumn(size, F.length(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    tie = [F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")), F.col("doc_id")]
    return shard_hilbert.hilbert_shards(sized, ["source", "lang", size], N_SHARDS, tie).drop(size, "hilbert")


STAGES = [
    ("quality_rules", keep_quality),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix),
    ("shard", shard),
]

#: Learned rules and sketches have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written, and what is no longer needed is removed."""
    docs = read_table(spark, sf_dir, "documents")
    base, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        with temporary_tables(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            remove_table(spark, before)
        before = f"{base}/{name}"
    return docs
