"""The registered queries of the operators: production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from borespark.llm import decontamination, language_id, language_model, mixing, near_duplicates, quality_classifier, quality_rules, secret_scan, sharding, token_counts
from borespark.llm.common import Scratch, crc_part, documents, word_count
from borespark.llm.oracles import ORACLES

#: Target weights of the mix, per level of the tree; missing names weigh 1.
MIX_WEIGHTS = {"domain": {"domain0": 2}, "lang": {"en": 3, "de": 2}}


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole length table of all documents: histogram, suffix sums, truncated totals per length."""
    return token_counts.suffix_table(token_counts.length_histogram(documents(spark, sf_dir)))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted are the documents labelled as good."""
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return quality_rules.quality_rules(documents(spark, sf_dir), good)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_classes(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.link_credentials(documents(spark, sf_dir))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of up to two words."""
    return language_model.score_texts(documents(spark, sf_dir), language_model.held_out_part(F.col("doc_id")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated_pairs(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_domain(source):
    """Sources fall into four domains by their number."""
    return F.concat(F.lit("domain"), (F.coalesce(F.regexp_extract(source, "([0-9]+)$", 1).try_cast("int"), F.lit(0)) % 4).cast("string"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = documents(spark, sf_dir).select("doc_id", "lang", "source", word_count(F.col("text")).alias("n_tokens"))
    counted = Scratch(spark, "mix").keep(counted, "documents")  # texts are read once
    mixed = mixing.mix_sources(counted, source_domain(F.col("source")), MIX_WEIGHTS, budget=1.0, max_epochs=4, seed=7, tokens=F.col("n_tokens"))
    return mixed.select("doc_id", "domain", "lang", "source", "n_tokens", "epochs", "part")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    machine = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), crc_part(F.col("doc_id"), 3) != 1)
    scored = quality_classifier.score_quality(docs, machine)
    return scored.select("doc_id", (crc_part(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by text, markup, suffix and host; documents, which have no markup or address, by text and source.

    The text model learns from the documents whose crc32(doc_id as text) mod 3 is not 1; held_out tells the others.
    """
    docs = documents(spark, sf_dir)
    held_out = crc_part(F.col("doc_id"), 3) == 1
    languages, table = language_id.text_model(docs.where(~held_out))
    pages = language_id.page_evidence(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumns({"doc_id": F.lit(None).cast("long"), "held_out": F.lit(True)})
    rows = pages.unionByName(language_id.document_evidence(docs).withColumns({"page_id": F.lit(None).cast("long"), "held_out": held_out}))
    return language_id.identify(rows, languages, table).select("page_id", "doc_id", "held_out", "host", "declared", "text_lang", "lang_pred", "confidence")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_quality_rules, op3_near_duplicates, op4_secret_scan, op5_language_model, op6_decontamination, op7_source_mix, op8_quality_classifier, op9_language_id, op10_sharding)}
__all__ = ["ORACLES", "QUERIES"]
