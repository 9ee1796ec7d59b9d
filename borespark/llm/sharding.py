"""Sharding by global byte-size prefix sums, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Boundaries of the logical partitions whose totals are summed; a fixed, small number of driver values.
CUTS = 256
#: Sub-partitions, by checksum, of one id that holds many rows.
SPLITS = 64


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def _partition(doc_id: Column, crc: Column, cuts: list) -> Column:
    """An increasing number of (doc_id, crc): ids at a cut have SPLITS partitions by checksum, others one."""
    position = F.when(doc_id.isNull(), F.lit(0))
    if not cuts:
        return position.otherwise(F.lit(2 * SPLITS)) + F.when(doc_id.isNull(), F.shiftright(crc, 26)).otherwise(F.lit(0))
    table = F.array(*[F.lit(c) for c in cuts])
    below = F.size(F.filter(table, lambda c: c < doc_id))
    equal = F.array_contains(table, doc_id)
    number = F.when(doc_id.isNull(), F.lit(0)).otherwise(2 * below + 2 + equal.cast("int")) * SPLITS
    return number + F.when(doc_id.isNull() | equal, F.shiftright(crc, 26)).otherwise(F.lit(0))


def shard_by_bytes(docs: DataFrame, shards: int = 16, cuts: int = CUTS) -> DataFrame:
    """docs with size, text_crc32, shard and slot: contiguous shards of nearly equal bytes.

    Rows are ordered by (doc_id, text_crc32, size), null ids first.  Quantiles of the ids cut that order
    into logical partitions; the partitions' totals (a few thousand rows at most) give each partition's
    start, and a running sum within each partition gives each row's byte offset and row number.  A row
    goes to shard floor(offset * shards / total), so the shards' bytes differ by less than two rows.
    slot counts from 0 within the shard.  Where the partitions' borders lie doesn't change the result.

    A frequent or missing id is split by checksum, so no key makes a large partition unless one id and
    text repeat.  size is the UTF-8 bytes of the text plus 1 (null: 1), text_crc32 that of the text (null:
    of the empty text).  Rows alike in the order are interchangeable.  Columns of docs with the names of
    the results are replaced.  An empty table gives no rows.
    """
    base = docs.withColumns({"size": text_size(F.col("text")), "text_crc32": F.crc32(F.coalesce("text", F.lit("")))})
    ids = docs.agg(F.percentile_approx("doc_id", [i / cuts for i in range(1, cuts)], 10_000).alias("q")).first()["q"] or []
    base = base.withColumn("__part", _partition(F.col("doc_id"), F.col("text_crc32"), sorted(set(ids))))
    totals = base.groupBy("__part").agg(F.sum("size").alias("__bytes"), F.count("*").alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__part", F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__b0"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__r0"), F.sum("__bytes").over(Window.partitionBy(F.lit(0))).alias("__all"))
    # at most 2 * (cuts + 1) * SPLITS rows, so the broadcast below is bounded
    inside = Window.partitionBy("__part").orderBy("doc_id", "text_crc32", "size")
    placed = base.withColumns({"__sum": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "__row": F.row_number().over(inside)})
    placed = placed.join(F.broadcast(starts), "__part")
    offset = F.col("__b0") + F.col("__sum") - F.col("size")
    shard = F.least(F.lit(shards - 1), F.floor(offset.cast("decimal(38,0)") * shards / F.col("__all"))).cast("int")
    placed = placed.withColumns({"shard": shard, "__no": F.col("__r0") + F.col("__row") - 1})
    firsts = placed.groupBy("shard").agg(F.min("__no").alias("__first"))  # a row per shard
    out = placed.join(F.broadcast(firsts.withColumnRenamed("shard", "__s")), F.col("shard") == F.col("__s"))
    out = out.withColumn("slot", F.col("__no") - F.col("__first"))
    return out.drop("__s", "__first", "__part", "__sum", "__row", "__b0", "__r0", "__all", "__no")
