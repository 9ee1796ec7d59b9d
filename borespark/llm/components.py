"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borespark.llm.common import Scratch


def connected_components(links: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node long, component long) for every node of links (a long, b long).

    The component is its smallest node.  Each round hangs the neighbours of a node below the smallest of
    them; rows stay linear in the links, and every step is a partially aggregated minimum plus a join
    that the adaptive planner splits where a node is very frequent.  Each round is written to the shared
    folder.  The number of rounds grows with the logarithm of the nodes; the limit only guards against a
    defect and raises an error.  Self-links and nulls are ignored; no links give no rows.
    """
    edges = scratch.keep(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = _digest(edges)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = scratch.keep(large.distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v")
        new = scratch.keep(small.distinct(), "small")
        now = _digest(new)
        scratch.drop(large)
        scratch.drop(edges)
        edges, before, state = new, state, now
        if now == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _digest(edges: DataFrame) -> tuple:
    """Number of links and an order-free digest of them."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
