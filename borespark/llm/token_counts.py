"""Token counts: the exact histogram of encoded lengths and what its suffix sums answer."""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from borespark.llm.common import Scratch, map_slices

#: Lengths in one block of the two-level suffix sums.
BLOCK = 4096
#: Splitting pattern of the byte-level vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@cache
def _encoding(data: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, column: str = "text") -> DataFrame:
    """(length long, docs long) per slice of texts: partial histograms of the encoded lengths.

    The vocabulary file (a fixed size, under 2 MB) is read on the driver and broadcast.  Null and empty
    texts have length 0.  Whole texts are encoded.
    """
    with open(vocabulary, "rb") as file:
        data = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        encode = _encoding(data.value, pattern).encode_ordinary
        lengths = [len(encode(x)) if x else 0 for x in part.column(0).to_pylist()]
        values, counts = np.unique(np.asarray(lengths, np.int64), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts.astype(np.int64))], ["length", "docs"])

    return map_slices(docs.select(F.col(column).alias("text")), run, "length long, docs long")


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, column: str = "text") -> DataFrame:
    """(length, docs): how many documents encode to each length; no rows for an empty table."""
    return encoded_lengths(docs, vocabulary, pattern, column).groupBy("length").agg(F.sum("docs").alias("docs"))


def suffix_table(histogram: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The histogram with its suffix sums, one row per length that occurs.

    length, docs, tokens (of that length); docs_at_least and tokens_at_least (suffix sums); docs_below and
    tokens_below; truncated_tokens: the tokens left if every text is cut to this length;  docs_share: the
    share of documents of at most this length (quantile q is the first row with docs_share >= q).

    Sums run in two levels, over blocks of ``BLOCK`` lengths and within them, so no task holds all lengths.
    The histogram, a row per length, is written once to the shared folder, as both levels read it.  No rows
    for an empty histogram.
    """
    scratch = scratch or Scratch(histogram.sparkSession, "lengths")
    h = scratch.keep(histogram.groupBy("length").agg(F.sum("docs").alias("docs")), "histogram").withColumn("tokens", F.col("length") * F.col("docs")).withColumn("block", F.floor(F.col("length") / BLOCK))
    sums = h.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = Window.orderBy("block")  # a row per block of lengths
    before, everything = blocks.rowsBetween(Window.unboundedPreceding, -1), blocks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sums.select(
        "block", F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"),
        F.sum("d").over(everything).alias("all_docs"), F.sum("t").over(everything).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, -1)
    h = h.join(sums, "block").withColumns({
        "docs_below": F.col("d0") + F.coalesce(F.sum("docs").over(inside), F.lit(0)),
        "tokens_below": F.col("t0") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)),
    })
    return h.select(
        "length", "docs", "tokens",
        (F.col("all_docs") - F.col("docs_below")).alias("docs_at_least"),
        (F.col("all_tokens") - F.col("tokens_below")).alias("tokens_at_least"),
        "docs_below", "tokens_below",
        (F.col("tokens_below") + F.col("length") * (F.col("all_docs") - F.col("docs_below"))).alias("truncated_tokens"),
        ((F.col("docs_below") + F.col("docs")) / F.col("all_docs")).alias("docs_share"),
    )


def context_limits(suffixes: DataFrame, limits: list[int]) -> DataFrame:
    """Per context limit: docs that fit, docs cut, tokens kept, tokens lost.  Any limit is answered exactly."""
    length, docs, tokens = F.col("length"), F.col("docs"), F.col("tokens")

    def total(x):
        return F.coalesce(F.sum(x), F.lit(0))

    parts = []  # every limit's sums, in one pass over the lengths
    for k, limit in enumerate(limits):
        fits, cut = length <= limit, length > limit
        parts.append(F.struct(
            F.lit(int(limit)).cast("long").alias("limit"), total(F.when(fits, docs)).alias("docs_fit"), total(F.when(cut, docs)).alias("docs_cut"),
            total(F.when(fits, tokens).otherwise(limit * docs)).alias("tokens_kept"), total(F.when(cut, tokens - limit * docs)).alias("tokens_lost"),
        ).alias(f"p{k}"))
    return suffixes.agg(*parts).select(F.explode(F.array(*[F.col(f"p{k}") for k in range(len(limits))])).alias("p")).select("p.*")


def length_quantiles(suffixes: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the smallest length that at least that share of the documents doesn't exceed."""
    parts = [F.struct(F.lit(float(q)).alias("share"), F.min(F.when(F.col("docs_share") >= q, F.col("length"))).alias("length")).alias(f"q{i}") for i, q in enumerate(shares)]
    return suffixes.agg(*parts).select(F.explode(F.array(*[F.col(f"q{i}") for i in range(len(shares))])).alias("q")).select("q.*")
