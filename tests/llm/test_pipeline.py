"""The corpus pipeline, stage by stage, on the smallest tables."""

import re
from collections import Counter

import corpus_pipeline
import __spark_entry__ as entry
from tidemark.llm import decontaminate

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen[-1], SF).write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    raw, quality, near, clean, mixed, sharded = seen
    assert all(x.columns == columns for x in seen[:-1])
    ids = [Counter(r.doc_id for r in x.select("doc_id").collect()) for x in seen]
    assert all(set(b) <= set(a) for a, b in zip(ids, ids[1:], strict=False))
    assert all(max(x.values()) == 1 for x in ids[:4]) and max(ids[4].values()) <= 2
    assert min(len((r.text or "").split()) for r in quality.select("text").collect()) >= 50
    texts = [r.text for r in near.select("text").collect()]
    assert len(texts) == len(set(texts)) and 0 < len(ids[2]) < len(ids[1])
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontaminate.op6_query(clean, bench).where("contaminated").count() == 0
    bad = {r.doc_id for r in decontaminate.op6_query(near, bench).where("contaminated").collect()}
    assert set(ids[2]) - set(ids[3]) == bad
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in clean.select("doc_id", "text").collect()}
    assert abs(sum(size[i] * n for i, n in ids[4].items()) / sum(size.values()) - 1.5) < 0.05
    assert ids[5] == ids[4]
    per_shard = Counter(r.shard for r in sharded.select("shard").collect())
    assert len(per_shard) == corpus_pipeline.N_SHARDS and max(per_shard.values()) - min(per_shard.values()) <= 1
    assert set(columns) < set(sharded.columns)


def test_run_and_registration(spark):
    assert "pipeline" in entry.queries() and corpus_pipeline.ORACLE_SQL is None
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in entry.queries()}
    assert corpus_pipeline.run(spark, SF).count() > 0
