"""MinHash near-dedup by ProbMinHash registers, banding and verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borespark.llm.common import Scratch, map_slices
from borespark.llm.components import connected_components
from borespark.llm.kernels import Texts, distinct_in
from borespark.llm.sketch import band_keys, prob_minhash

#: Buckets of up to so many different texts are compared in full; larger ones by leaders first.
SMALL_BUCKET = 16
#: Random leaders that every member of a larger bucket meets at first, besides two central ones.
LEADERS = 2
#: Nodes, of a hash and an id each, whose texts are looked up without a shuffle.
BROADCAST_NODES = 500_000


def _ragged(x: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *x])))


def _sketch(bands: int, rows: int, shingle: int):
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        node = part.column("node").to_numpy()
        _, first, back = np.unique(node, return_index=True, return_inverse=True)  # copies are sketched once a slice
        texts = Texts(part.column("text").take(pa.array(first)))
        element, doc = texts.shingles(shingle)
        doc, element, count = distinct_in(doc, element)
        registers = prob_minhash(doc, element, 1 + np.log(count), texts.n, bands * rows)
        keys = list(band_keys(registers, bands, rows).view(np.int64))
        size = np.bincount(doc, minlength=texts.n)
        repeats = np.zeros(texts.n, bool)
        repeats[doc[count > 1]] = True
        again = np.flatnonzero(repeats)  # of the others both sketches are the same
        if len(again):
            own = repeats[doc]
            plain = prob_minhash((np.cumsum(repeats) - 1)[doc[own]], element[own], np.ones(int(own.sum())), len(again), bands * rows)
            for i, more in zip(again, band_keys(plain, bands, rows).view(np.int64), strict=True):
                keys[i] = np.append(more, keys[i][keys[i] != more])

        ids = pa.table([pa.array(back.ravel()), part.column("doc_id")], ["at", "id"]).group_by("at").aggregate([("id", "min"), ("at", "count")]).sort_by("at")
        return pa.RecordBatch.from_arrays(
            [pa.array(node[first]), ids.column("id_min").combine_chunks(), ids.column("at_count").combine_chunks(), pa.array(size.astype(np.int64)), _ragged(keys)],
            ["node", "low", "copies", "size", "bands"],
        )

    return run


def _sets(shingle: int):
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(part.column("text"))
        element, doc = texts.shingles(shingle)
        doc, element, _ = distinct_in(doc, element)
        cut = np.searchsorted(doc, np.arange(texts.n + 1))
        return pa.RecordBatch.from_arrays([part.column("node"), pa.array([element[cut[i] : cut[i + 1]].tobytes() for i in range(texts.n)], pa.binary())], ["node", "elements"])

    return run


def _members(shingle: int):
    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = Texts(part.column("text"))
        doc, element, _ = distinct_in(*texts.shingles(shingle)[::-1])
        cut = np.searchsorted(doc, np.arange(texts.n + 1))
        return pa.RecordBatch.from_arrays([part.column("node"), _ragged([element[cut[i] : cut[i + 1]].view(np.int64) for i in range(texts.n)])], ["node", "own"])

    return run


def _verify(threshold: float):
    def run(batches):
        for batch in batches:
            left, right = batch.column("ea"), batch.column("eb")
            keep = []
            for i in range(batch.num_rows):
                x, y = np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(both > 0 and both >= threshold * (len(x) + len(y) - both) - 1e-9)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


def near_duplicate_classes(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, bands: int = 32, rows: int = 6, scratch: Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, node, component.

    Method.  Equal texts form one node.  A node's distinct ``shingle``-word windows, weighted by
    1 + ln(count), are sketched by ProbMinHash (``sketch.prob_minhash``): two nodes agree in a register
    with their probability Jaccard similarity.  A node that repeats a window is sketched once more with all
    weights 1: those registers agree with the Jaccard similarity of the sets, which decides, and where
    nothing is repeated the two sketches are the same.  ``bands`` bands of ``rows`` registers of each sketch
    give buckets; pairs out of the buckets are verified on the exact sets of windows (Jaccard of
    ``threshold`` or more), and the verified links' connected components are the classes.  A pair at
    similarity 0.8 is missed by all bands with probability 6e-5 at most, however often windows repeat.

    Pairs never grow with the square of a bucket: buckets of up to ``SMALL_BUCKET`` texts are compared in
    full; in a larger one each member meets a few leaders (two central members and ``LEADERS`` random
    ones).  Members of buckets that still hold several components after that are joined by the rarest of
    their shingles (``_across``), which finds every pair across components that has the similarity, so no link
    between components is lost by the size of a bucket, and what a bucket shares makes no pairs.

    class_id is the smallest doc_id of the class, class_size its number of rows.  A null text counts as
    empty; texts without words are alike only if equal.  Texts of 1 to 4 words have one shingle.  Repeated
    rows and repeated doc_ids count as rows of their own; a class without any doc_id has class_id null.
    doc_id is of any type that has an order.
    Columns other than doc_id and text are neither read nor returned.  Equality of texts is that of a
    64-bit hash.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "near")
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    sketched = map_slices(keyed, _sketch(bands, rows, shingle), f"node long, low {kind}, copies long, size long, bands array<long>")
    nodes = scratch.keep(sketched.groupBy("node").agg(F.min("low").alias("low"), F.sum("copies").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands")), "nodes")

    banded = nodes.where("size > 0").select("node", F.explode("bands").alias("key"))
    buckets = scratch.keep(banded.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).where("n > 1"), "buckets")
    pairs = buckets.where("n = 2").select("a", "b")
    members = scratch.keep(banded.join(buckets.where("n > 2").select("key", "n"), "key"), "members")
    small = members.where(F.col("n") <= SMALL_BUCKET).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("m"))
    small = small.select(F.explode(F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x.alias("a"), y.alias("b")))))).alias("p")).select("p.*")
    large = members.where(F.col("n") > SMALL_BUCKET)
    # a member that stands in the most company is central: the original of a group of copies, say
    company = large.groupBy("node").agg(F.sum("n").alias("company"))
    large = scratch.keep(large.join(company, "node"), "large")
    half = F.pmod(F.xxhash64("node", F.lit(-1)), F.lit(2))
    chosen = [F.max(F.when(half == h, F.struct("company", F.col("node").alias("x"))))["x"] for h in (0, 1)]
    chosen += [F.min(F.struct(F.xxhash64("node", "key", F.lit(k)).alias("h"), F.col("node").alias("x")))["x"] for k in range(LEADERS)]
    leaders = scratch.keep(large.groupBy("key").agg(*[c.alias(f"l{k}") for k, c in enumerate(chosen)]), "leaders")  # so that a frequent key's join can be split
    led = large.join(leaders, "key").select("node", F.explode(F.array_distinct(F.array_compact(F.array(*[f"l{k}" for k in range(len(chosen))])))).alias("l"))
    led = led.where("node <> l").select(F.least("node", "l").alias("a"), F.greatest("node", "l").alias("b"))
    pairs = scratch.keep(pairs.union(small).union(led).distinct(), "pairs")

    links = _verified(keyed, nodes, pairs, threshold, shingle, scratch)
    labels = connected_components(links, scratch)

    # larger buckets that still hold several components: only pairs across components are left to compare
    big = large.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = scratch.keep(big.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key"), "mixed")
    rest = scratch.keep(big.join(mixed, "key").select("node", "component").distinct(), "rest")
    if not rest.isEmpty():
        more = scratch.keep(_across(keyed, nodes, rest, threshold, shingle, scratch).join(pairs, ["a", "b"], "left_anti"), "more")
        links = links.union(_verified(keyed, nodes, more, threshold, shingle, scratch))
        labels = connected_components(links, scratch)

    classes = nodes.select("node", "low", "copies").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    classes = scratch.keep(classes, "classes")
    totals = classes.groupBy("component").agg(F.min("low").alias("class_id"), F.sum("copies").alias("class_size"))
    classes = classes.select("node", "component").join(totals, "component")
    out = keyed.select("doc_id", "node").join(classes, "node").select("doc_id", "class_id", "class_size", "node", "component")
    return scratch.keep_only(out, "result")


def _across(keyed: DataFrame, nodes: DataFrame, rest: DataFrame, threshold: float, shingle: int, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of different components among rest (node, component) that may have the similarity.

    In any fixed order of the shingles, two sets of that similarity share one of the first
    size - ceil(threshold * size) + 1 of each.  The order begins with the shingles that stand in one component
    alone, which join nothing, then goes from the rarest to the most frequent ones.  Two sets whose first common
    shingle has p and q others before it share size - p and size - q at most, which must be enough for both sizes.
    """
    need = rest.select("node").join(nodes.select("node", "low"), "node")
    own = map_slices(_texts_of(keyed, need, scratch), _members(shingle), "node long, own array<long>", limit=1 << 20)
    own = scratch.keep(own.groupBy("node").agg(F.first("own").alias("own")).join(rest, "node").where(F.size("own") > 0), "shingles")
    each = own.select("node", "component", F.explode("own").alias("element"))
    shared = each.groupBy("element").agg(F.count("*").alias("f"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    shared = scratch.keep(shared.where("lo <> hi").select("element", "f"), "shared")
    ranked = each.join(shared, "element", "left").select("node", F.struct(F.coalesce("f", F.lit(0)).alias("f"), "element").alias("e"))
    ranked = ranked.where("e.f > 0").groupBy("node").agg(F.sort_array(F.collect_list("e")).alias("e"))  # a text's own shingles
    size = F.size("own")
    first = size - F.ceil(threshold * size - 1e-9) + 1 - (size - F.size("e"))  # less those that stand in one component alone
    prefix = own.join(ranked, "node").where(first > 0).select("node", "component", size.alias("size"), (size - F.size("e")).alias("alone"), F.posexplode(F.slice("e", F.lit(1), first.cast("int"))).alias("p", "e"))
    prefix = scratch.keep(prefix.select("node", "component", "size", (F.col("size") - F.col("alone") - F.col("p")).alias("left"), F.col("e.element").alias("element")), "prefix")
    x, y = prefix.select([F.col(c).alias(f"x_{c}") for c in prefix.columns]), prefix.select([F.col(c).alias(f"y_{c}") for c in prefix.columns])
    sized = F.least("x_size", "y_size") >= threshold * F.greatest("x_size", "y_size") - 1e-9
    enough = F.least("x_left", "y_left") * (1 + threshold) >= threshold * (F.col("x_size") + F.col("y_size")) - 1e-9
    met = x.join(y, (F.col("x_element") == F.col("y_element")) & (F.col("x_component") < F.col("y_component")) & sized & enough)
    return met.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def _verified(keyed: DataFrame, nodes: DataFrame, pairs: DataFrame, threshold: float, shingle: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the Jaccard similarity."""
    sizes = nodes.select("node", "size")
    pairs = pairs.join(sizes.select(F.col("node").alias("a"), F.col("size").alias("sa")), "a").join(sizes.select(F.col("node").alias("b"), F.col("size").alias("sb")), "b")
    pairs = scratch.keep(pairs.where(F.least("sa", "sb") >= threshold * F.greatest("sa", "sb") - 1e-9).select("a", "b"), "sized")
    need = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "low"), "node")
    sets = map_slices(_texts_of(keyed, need, scratch), _sets(shingle), "node long, elements binary")
    sets = scratch.keep(sets.groupBy("node").agg(F.first("elements").alias("elements")), "sets")
    ready = pairs.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("ea")), "a").join(sets.select(F.col("node").alias("b"), F.col("elements").alias("eb")), "b")
    return scratch.keep(ready.mapInArrow(_verify(threshold), "a long, b long"), "links")


def _texts_of(keyed: DataFrame, need: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, text) of the nodes in need (node, low): the text of the document with the smallest id of each.

    Up to ``BROADCAST_NODES`` nodes are sent to all tasks, so that texts stay where they are; more are joined by shuffle.
    """
    ids = scratch.keep(need.select(F.col("node").alias("n"), "low"), "need")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_NODES else ids
    return keyed.join(ids, (F.col("node") == F.col("n")) & F.col("doc_id").eqNullSafe(F.col("low"))).select("node", "text")


def keep_one_of_each(docs: DataFrame, scratch: Scratch | None = None, **options) -> DataFrame:
    """The rows of docs, with all their columns, that represent their class: one row of each class.

    The representative has the smallest doc_id of its class (null where the class has none).
    """
    scratch = scratch or Scratch(docs.sparkSession, "near")
    classes = near_duplicate_classes(docs, scratch=scratch, **options)
    chosen = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("component").agg(F.min(F.struct("doc_id", "node")).alias("r"), F.count("*").alias("n"))
    chosen = scratch.keep(chosen.select(F.col("r.doc_id").alias("__near_id"), F.col("r.node").alias("__near_node"), "n"), "chosen")
    keyed = docs.select("*", F.xxhash64(F.coalesce("text", F.lit(""))).alias("__near_key"))
    kept = keyed.join(chosen, (F.col("__near_key") == F.col("__near_node")) & F.col("doc_id").eqNullSafe(F.col("__near_id")), "left_semi")
    again = chosen.where("n > 1")
    if again.isEmpty():
        return kept.drop("__near_key")
    # rows that repeat with id and text: one of them stays
    many = kept.join(again, (F.col("__near_key") == F.col("__near_node")) & F.col("doc_id").eqNullSafe(F.col("__near_id")), "left_semi").dropDuplicates(["__near_key"])
    once = kept.join(again, (F.col("__near_key") == F.col("__near_node")) & F.col("doc_id").eqNullSafe(F.col("__near_id")), "left_anti")
    return once.union(many).drop("__near_key")
