"""The pipeline's stages against brute force on the smallest tables."""

import re

import pytest

import __spark_entry__
import corpus_pipeline
from tests.llm.test_operators import classes, place

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        out.append([r.asDict() for r in docs.collect()])
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    return out


def test_each_stage_does_its_part(spark, stages):
    quality, near, clean, mixed, sharded = stages
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(list(r) == columns for s in stages[:4] for r in s)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in quality}
    assert sum((i in kept) == bool(q) for i, q in labels.items()) >= 0.95 * len(labels)
    assert {r["doc_id"] for r in near} == set(classes([(r["doc_id"], r["text"]) for r in quality]).values())
    items = [WORD.findall(r["text"].lower()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    items = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in items]

    def leaks(text):
        w = WORD.findall(text.lower())
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        return any(len(own & i) >= 0.8 * len(i) for i in items)

    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in near if not leaks(r["text"])}
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in clean}
    tokens = [sum(len(WORD.findall(r["text"])) for r in s) for s in (clean, mixed)]
    assert 0.85 * tokens[0] <= tokens[1] <= tokens[0]
    got = sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharded), key=str)
    assert got == place([(r["doc_id"], r["text"]) for r in mixed])


def test_run_and_registration(spark, stages):
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect()}
    assert got == {r["doc_id"] for r in stages[-1]}
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10


def test_native_operators_run_no_python(spark):
    from borespark.llm.queries import QUERIES

    for name in ("op4_secret_scan", "op10_sharding"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ScalaUDF"))
