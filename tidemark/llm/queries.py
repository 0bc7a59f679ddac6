"""The training-data queries: whole tables in, whole results out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontaminate,
    dedup_lines,
    dedup_minhash,
    fill_middle,
    language_mixture,
    merkle,
    mix_sources,
    personal_data,
    quality_pairs,
    quality_rules,
    shard_hilbert,
    token_files,
    token_trie,
)
from .common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_pairs.op1_query(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.op2_query(read_table(spark, sf_dir, "documents"))


def op3_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_mixture.op3_query(read_table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources.op4_query(read_table(spark, sf_dir, "documents"))


def op5_token_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_trie.op5_query(read_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op6_query(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op7_query(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_shard_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_hilbert.op8_query(read_table(spark, sf_dir, "documents"))


def op9_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines.op9_query(read_table(spark, sf_dir, "documents"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_minhash.op10_query(read_table(spark, sf_dir, "documents"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.op11_query(read_table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.op12_query(read_table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.op13_query(read_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_quality_pairs": op1_quality_pairs,
    "op2_personal_data": op2_personal_data,
    "op3_language_mixture": op3_language_mixture,
    "op4_mix_sources": op4_mix_sources,
    "op5_token_trie": op5_token_trie,
    "op6_decontaminate": op6_decontaminate,
    "op7_quality_rules": op7_quality_rules,
    "op8_shard_hilbert": op8_shard_hilbert,
    "op9_dedup_lines": op9_dedup_lines,
    "op10_minhash": op10_minhash,
    "op11_token_files": op11_token_files,
    "op12_fill_middle": op12_fill_middle,
    "op13_merkle": op13_merkle,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {
    "op4_mix_sources": mix_sources.OP4_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op8_shard_hilbert": shard_hilbert.OP8_SQL,
    "op9_dedup_lines": dedup_lines.OP9_SQL,
    "op10_minhash": dedup_minhash.OP10_SQL,
    "op12_fill_middle": fill_middle.OP12_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
