"""Quality rules: base statistics and a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from borespark.llm.common import map_counts, map_slices
from borespark.llm.kernels import Texts, base_statistics, gram_buckets

#: Byte windows and buckets of the multinomials, and the additive smoothing.
GRAM, BITS, SMOOTHING = 4, 16, 0.5
#: Mean log-likelihood ratio per window (natural logarithm) from which a text is kept.
THRESHOLD = -0.3
#: Fixed-point scale of the ratios, so that sums don't depend on their order.
SCALE = 1 << 24
#: Trusted ids that are broadcast at most (8 bytes each).
BROADCAST_IDS = 1_000_000
_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def gram_counts(docs: DataFrame, trusted: Column, gram: int = GRAM, bits: int = BITS) -> DataFrame:
    """(bucket, target, raw): counts of hashed windows in trusted texts and in all texts; at most 2**bits rows."""

    def run(part: pa.RecordBatch) -> np.ndarray:
        bucket, bounds = gram_buckets(Texts(part.column("text")), gram, bits)
        good = np.asarray(part.column("trusted").fill_null(False).to_numpy(zero_copy_only=False), bool)
        inside = np.repeat(good, np.diff(bounds))
        return np.stack([np.bincount(bucket[inside], minlength=1 << bits), np.bincount(bucket, minlength=1 << bits)])

    parts = map_counts(docs.select("text", trusted.alias("trusted")), run, ["target", "raw"])
    return parts.groupBy(F.col("cell").alias("bucket")).agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


def log_ratios(counts: DataFrame, bits: int = BITS, smoothing: float = SMOOTHING) -> np.ndarray:
    """ln(p_target / p_raw) per bucket in fixed point; 2**bits values at most reach the driver."""
    target, raw = np.zeros(1 << bits), np.zeros(1 << bits)
    rows = counts.toPandas()
    target[rows["bucket"]], raw[rows["bucket"]] = rows["target"], rows["raw"]
    # both multinomials are smoothed towards the raw one, so that a bucket unseen in the target is mild evidence
    prior = (raw + smoothing) / (raw.sum() + smoothing * len(raw))
    weight = smoothing * len(raw)
    p_target = (target + weight * prior) / (target.sum() + weight)
    return np.round(np.log(p_target / prior) * SCALE).astype(np.int64)


def mark_trusted(docs: DataFrame, ids: DataFrame, column: str = "trusted", broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """docs (doc_id, text) with a flag whether ids (doc_id) has the id.

    Up to ``broadcast_ids`` ids are sent to all tasks, so that texts stay where they are; more are joined by
    shuffle, to the same result.
    """
    good = ids.where("doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()
    small = good.limit(broadcast_ids + 1).count() <= broadcast_ids
    joined = docs.join(F.broadcast(good) if small else good, F.col("doc_id") == F.col("__id"), "left")
    return joined.withColumn(column, F.col("__id").isNotNull()).drop("__id")


def quality_rules(docs: DataFrame, trusted_ids: DataFrame, threshold: float = THRESHOLD, gram: int = GRAM, bits: int = BITS) -> DataFrame:
    """Per row of docs (doc_id, text): base statistics, base_failed, kept, llr.

    ``trusted_ids`` (doc_id) names the texts of the target multinomial; the raw one is counted over all
    rows.  llr is the sum of ln(p_target / p_raw) over the text's hashed byte windows divided by their
    number (0 for texts shorter than a window), exact in fixed point, so equal texts get equal verdicts.
    kept: base_failed is false and llr >= threshold.  Null texts count as empty ones and fail the base
    rules.  Without any trusted text every ratio is 0.  Repeated rows are judged each; other columns are
    not returned.
    """
    table = docs.sparkSession.sparkContext.broadcast(log_ratios(gram_counts(mark_trusted(docs.select("doc_id", "text"), trusted_ids), F.col("trusted"), gram, bits), bits))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(part.column("text"))
        stats = base_statistics(texts)
        bucket, cut = gram_buckets(texts, gram, bits)
        total = np.zeros(len(bucket) + 1, np.int64)
        np.cumsum(table.value[bucket], out=total[1:])
        llr = (total[cut[1:]] - total[cut[:-1]]) / np.maximum(np.diff(cut), 1) / SCALE
        failed = (stats["n_words"] < 10) | (100 * stats["n_repeat_words"] > 20 * stats["n_words"])
        columns = [part.column("doc_id")] + [pa.array(stats[k].astype(np.int64)) for k in _BASE] + [pa.array(failed), pa.array(~failed & (llr >= threshold)), pa.array(llr)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", *_BASE, "base_failed", "kept", "llr"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_slices(docs.select("doc_id", "text"), run, f"doc_id {kind}, " + ", ".join(f"{k} long" for k in _BASE) + ", base_failed boolean, kept boolean, llr double")
