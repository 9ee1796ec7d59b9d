"""A corpus pipeline: quality, near-duplicates, benchmark leaks, source mix, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from borespark.llm import decontamination, mixing, near_duplicates, quality_classifier, sharding
from borespark.llm.common import DOCUMENT_COLUMNS, Scratch, crc_part, documents
from borespark.llm.queries import MIX_WEIGHTS, source_domain

#: Share of the tokens that reach the mix which it hands out; each document is used once at most.
MIX_BUDGET = 0.9


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = quality_classifier.train(docs, labels, crc_part(F.col("doc_id"), 3) != 1)
    return quality_classifier.keep_good(docs.select(*DOCUMENT_COLUMNS), machine)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the smallest id."""
    return near_duplicates.keep_one_of_each(docs.select(*DOCUMENT_COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.remove_contaminated(docs.select(*DOCUMENT_COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes tokens, whole; documents without words give none and go."""
    mixed = mixing.mix_sources(docs.select(*DOCUMENT_COLUMNS), source_domain(F.col("source")), MIX_WEIGHTS, budget=MIX_BUDGET, max_epochs=1, seed=7)
    return mixed.where((F.col("epochs") > 0) & (F.col("n_tokens") > 0) | (F.col("part") > 0)).select(*DOCUMENT_COLUMNS)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard and their place in it."""
    return sharding.shard_by_bytes(docs.select(*DOCUMENT_COLUMNS)).select(*DOCUMENT_COLUMNS, "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("source mix", mixing_stage),
    ("sharding", sharding_stage),
]
#: Classifier and sketches can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written to the shared folder and read again, then dropped."""
    scratch, docs = Scratch(spark, "pipeline"), documents(spark, sf_dir)
    for number, (name, stage) in enumerate(STAGES):
        read, docs = docs, stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = scratch.keep(docs, name.replace(" ", "-"))
            scratch.drop(read)
    return docs
