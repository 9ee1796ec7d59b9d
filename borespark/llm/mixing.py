"""Mixing sources to target weights by hierarchical budgeting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from borespark.llm.common import Scratch, word_count

#: Leaves up to which the plan is broadcast; above, the rows are joined with it by shuffle.
BROADCAST_LEAVES = 50_000
#: Hexadecimal digits of the seeded hash that number the groups of a leaf's order.
GROUP_DIGITS = 3
_EXACT = "decimal(38,0)"


def water_fill(children: DataFrame, parent: list[str], order: list[str]) -> DataFrame:
    """children (budget of the parent, cap, weight; longs) with ``share``: integers that add up.

    Each parent's budget is split by weight; a child that has less than its share (cap) gives what is
    lacking to its siblings, again by weight.  A child of weight 0 gets nothing.  A parent whose children
    lack altogether uses less than its budget.  Ties go by ``order``.
    """
    # children in the order in which they run dry as the water rises
    rising = Window.partitionBy(*parent).orderBy(F.try_divide(F.col("cap"), F.col("weight")).asc_nulls_last(), *order)
    before, rest = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    c = children.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(0))
    c = c.withColumns({"__c": F.coalesce(F.sum("cap").over(before), F.lit(0)), "__w": F.sum("weight").over(rest)})
    c = c.withColumn("__dry", (F.col("weight") == 0) | (F.col("cap").cast(_EXACT) * F.col("__w") <= F.col("weight").cast(_EXACT) * (F.col("budget") - F.col("__c"))))
    alike = Window.partitionBy(*parent)
    c = c.withColumns({"__left": F.col("budget") - F.coalesce(F.sum(F.when(F.col("__dry"), F.col("cap"))).over(alike), F.lit(0)), "__all": F.sum(F.when(~F.col("__dry"), F.col("weight"))).over(alike)})
    wet = F.sum(F.when(~F.col("__dry"), F.col("weight")).otherwise(0)).over(Window.partitionBy(*parent).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    c = c.withColumn("__run", wet)

    def part(upto: Column) -> Column:
        return F.floor(upto.cast(_EXACT) * F.col("__left").cast(_EXACT) / F.col("__all")).cast("long")

    share = F.when(F.col("__dry"), F.col("cap")).otherwise(part(F.col("__run")) - part(F.col("__run") - F.col("weight")))
    return c.withColumn("share", share.cast("long")).drop("__c", "__w", "__dry", "__left", "__all", "__run")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: int, max_epochs: int) -> DataFrame:
    """leaves (levels, tokens) with ``budget``: the token budget of each leaf of the tree.

    Weights go from the root to the leaves (missing: 1); shortages stay among siblings as long as these
    have tokens, since a node's capacity is the sum of its leaves' (tokens * max_epochs).
    """
    nodes = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    current = None
    for depth, level in enumerate(levels, 1):
        path = levels[:depth]
        table = weights.get(level, {})
        weight = F.lit(1)
        for value, w in table.items():
            weight = F.when(F.col(level) == value, F.lit(int(w))).otherwise(weight)
        children = nodes.groupBy(*path).agg(F.sum("cap").cast("long").alias("cap")).withColumn("weight", weight.cast("long"))
        children = children.withColumn("budget", F.lit(int(budget)).cast("long")) if current is None else children.join(current, path[:-1])
        current = water_fill(children, path[:-1] or [F.lit(0)], [level]).select(*path, F.col("share").alias("budget"))
    return leaves.join(current, levels)


def mix_sources(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], budget: float = 1.0, max_epochs: int = 4, seed: int = 1, tokens: Column | None = None, scratch: Scratch | None = None) -> DataFrame:
    """docs with domain, n_tokens, epochs and part: what each document gives to the mix.

    The tree is domain, lang, source.  ``budget`` is a share of all tokens.  Each leaf repeats all its
    documents for as many whole epochs as its budget holds (``epochs``), then takes a prefix of the next
    epoch's seeded order, md5(seed:epoch:doc_id); ``part`` is how many tokens of a document that prefix
    has, so that a leaf's tokens, n_tokens * epochs + part over its documents, equal its budget.  Tokens
    are words, or what ``tokens`` says of a row.

    The plan is made on a narrow table (leaf, id, tokens), written once, so that texts are counted once for
    it and once for the result; where docs hold the counts themselves (``tokens``), no text is read.

    A leaf's order is cut into groups by the hash's first digits; only the group that holds the end of
    the prefix is put in order, the others are in or out by the groups' totals, so that a leaf with a
    third of all rows needs no task of its own.  Rows of equal hash, id and token count are interchangeable.
    Null domain, lang, source or text count as empty strings in the tree; a leaf without tokens gives
    nothing.  Other columns of docs stay; columns named as the results are replaced.
    """
    scratch = scratch or Scratch(docs.sparkSession, "mix")
    levels = ["__domain", "__lang", "__source"]
    size = word_count(F.col("text")) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0).cast("long"))
    keyed = docs.withColumns({"__domain": F.coalesce(domain.cast("string"), F.lit("")), "__lang": F.coalesce("lang", F.lit("")), "__source": F.coalesce("source", F.lit(""))})
    narrow = scratch.keep(keyed.select(*levels, "doc_id", size.alias("n_tokens")), "counted")
    leaves = scratch.keep(narrow.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    total, n_leaves = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    names = {"domain": "__domain", "lang": "__lang", "source": "__source"}
    plan = leaf_budgets(leaves, levels, {names[k]: v for k, v in weights.items()}, int(total * budget), max_epochs)
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", full).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    plan = scratch.keep(plan.select(*levels, "epochs", F.col("rest").alias("__rest")), "plan")

    def put(df, table):
        return df.join(F.broadcast(table) if n_leaves <= BROADCAST_LEAVES else table, levels)

    def ordered(df):
        order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
        return put(df, plan).withColumn("__order", order).withColumn("__group", F.substring("__order", 1, GROUP_DIGITS))

    groups = ordered(narrow).where("__rest > 0").groupBy(*levels, "__group", "__rest").agg(F.sum("n_tokens").alias("t"))
    w = Window.partitionBy(*levels).orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("__before", F.coalesce(F.sum("t").over(w), F.lit(0))).where("__before < __rest and __before + t >= __rest")
    cut = scratch.keep(groups.select(*levels, F.col("__group").alias("__cut"), "__before"), "cut")
    scratch.drop(narrow)
    marked = ordered(keyed.drop("epochs", "__rest", "part"))
    marked = marked.join(F.broadcast(cut) if n_leaves <= BROADCAST_LEAVES else cut, levels, "left")
    # each branch counts the words of its own rows only: the filters come first
    inner = Window.partitionBy(*levels).orderBy("__order", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    at_cut = marked.where("__group = __cut").withColumn("n_tokens", size)
    at_cut = at_cut.withColumn("part", F.greatest(F.lit(0), F.least("n_tokens", F.col("__rest") - F.col("__before") - F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))).cast("long"))
    others = marked.where("__cut is null or __group <> __cut").withColumn("n_tokens", size)
    others = others.withColumn("part", F.when(F.col("__group") < F.col("__cut"), F.col("n_tokens")).otherwise(0).cast("long"))
    out = at_cut.unionByName(others).withColumn("domain", F.col("__domain"))
    return out.drop(*levels, "__order", "__group", "__rest", "__cut", "__before")
