"""Mixing sources to target weights by hierarchical budgeting.

Budgets flow down a tree (domain, language, source). Among siblings a budget is split by weight; what one
cannot supply goes to its siblings, and since a node's supply is that of its whole subtree, a shortage
leaves a subtree only when every leaf below is used up. Splits are whole-number arithmetic over the nodes,
in windows by parent. Each leaf then gives whole epochs plus a token-prefix of one more epoch, whose order
is the MD5 of seed, epoch and id.

The prefix needs no global order: tokens are summed in buckets of leading hash digits, only the bucket in
which the budget runs out is ordered, and each leaf ends with one threshold hash that every row compares
itself to. Only leaf-sized tables are joined to the rows: sent to all tasks up to MOST_LEAVES leaves, and beyond that joined
by leaf and a part of the leaf's rows, so that no leaf has to fit into one task.

Defined results: a null tree column is the node ''; a null or empty text has no tokens, counts as 0 and is
picked with its neighbours in order; rows of equal id share their place and are picked together; a weight
of 0 gives nothing; an empty table gives an empty result; a null id hashes as ''.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import SPACE, held, in_order, released, stored

ROWS_IN_BUCKET = 4096
MAX_DIGITS = 7
MOST_LEAVES, PARTS = 50_000, 64


def by_leaf(rows: DataFrame, leaves: DataFrame, tree: Sequence[str], key: str) -> DataFrame:
    """``rows`` joined to ``leaves`` (written before, one row for each leaf) by the tree's columns."""
    if leaves.limit(MOST_LEAVES + 1).count() <= MOST_LEAVES:
        return rows.join(F.broadcast(leaves), list(tree))
    parts = leaves.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    part = F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")
    return rows.withColumn("_part", part).join(parts, [*tree, "_part"]).drop("_part")


def n_tokens(text: Column) -> Column:
    """Number of words."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")


def order_key(key: str, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def split_budget(nodes: DataFrame, parent: Sequence[str], order: Sequence[str]) -> DataFrame:
    """nodes with weight, capacity and the parent's budget ``pool`` get ``budget``: shares by weight, capped at
    capacity, what is left over shared anew by weight among the siblings below their caps."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(1))
    up = by.orderBy(F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).asc_nulls_first(), *order)
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    usable = F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0)
    at = nodes.withColumns({
        "_left": F.greatest(F.lit(0), F.col("pool") - F.coalesce(F.sum(usable).over(before), F.lit(0))),
        "_weights": F.sum("weight").over(rest),
    })
    # the first sibling, in order of capacity by weight, that can supply its share: from there on none is short
    at = at.withColumn("_enough", (F.col("weight") > 0) & (F.col("capacity") * F.col("_weights") >= F.col("weight") * F.col("_left")))
    first = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = at.withColumns({
        "_left": F.first(F.when(F.col("_enough"), F.col("_left")), True).over(first),
        "_weights": F.first(F.when(F.col("_enough"), F.col("_weights")), True).over(first),
    })
    share = F.when(F.col("_left").isNull(), usable).otherwise(F.expr("(weight * _left) div _weights"))
    return at.withColumn("budget", F.least(share, usable).cast("long")).drop("_left", "_weights", "_enough")


def leaf_budgets(leaves: DataFrame, tree: Sequence[str], weights: dict[str, dict[str, int]], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """``leaves`` (tree columns, tokens) with the budget of each; share: the tokens wanted, as a fraction of all there are."""
    at = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    whole = (leaves.agg(F.sum("tokens")).first()[0] or 0) * share[0] // share[1]
    pool = None
    for depth in range(1, len(tree) + 1):
        parent, path = tree[: depth - 1], tree[:depth]
        of = weights.get(tree[depth - 1], {})
        weight = F.lit(of.get("*", 1)).cast("long")
        for value, w in of.items():
            weight = F.when(F.col(tree[depth - 1]) == value, F.lit(w).cast("long")).otherwise(weight)
        nodes = at.groupBy(*path).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight)
        nodes = nodes.withColumn("pool", F.lit(whole).cast("long")) if pool is None else nodes.join(pool, parent)
        pool = split_budget(nodes, parent, path).select(*path, F.col("budget").alias("pool"))
    return leaves.join(pool.withColumnRenamed("pool", "budget"), list(tree))


def leaf_plan(slim: DataFrame, tree: Sequence[str], weights: dict[str, dict[str, int]], share: tuple[int, int], max_epochs: int, seed: int, key: str) -> DataFrame:
    """Tree columns, budget, epochs (whole ones) and threshold (greatest hash taken from the next, null if none);
    ``slim`` has key, tree columns and n_tokens."""
    tree = list(tree)
    leaves = stored(slim.groupBy(*tree).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")), "leaves")
    plan = leaf_budgets(leaves, tree, weights, share, max_epochs).withColumns({
        "epochs": F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).cast("long"),
        "rest": F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0).cast("long"),
        "digits": F.least(F.lit(MAX_DIGITS), F.greatest(F.lit(1), F.ceil(F.log(16.0, F.col("rows") / F.lit(float(ROWS_IN_BUCKET)))))).cast("int"),
    })
    plan = stored(plan, "budgets")
    keyed = by_leaf(slim, plan.where("rest > 0").select(*tree, "epochs", "rest", "digits"), tree, key).select(
        *tree, "n_tokens", "rest", order_key(key, F.col("epochs"), seed).alias("k"), "digits"
    ).withColumn("bucket", F.expr("substring(k, 1, digits)"))
    sums = keyed.groupBy(*tree, "rest", "bucket").agg(F.sum("n_tokens").alias("n"))
    run = F.sum("n").over(Window.partitionBy(*tree).orderBy("bucket"))
    sums = sums.withColumn("end", run).withColumn("begin", F.col("end") - F.col("n"))
    edge = stored(sums.where("begin <= rest").groupBy(*tree).agg(F.max("bucket").alias("bucket"), F.max("begin").alias("begin"), F.max(F.when(F.col("end") <= F.col("rest"), F.col("bucket"))).alias("whole")), "edges")
    inside = by_leaf(keyed, edge.withColumnRenamed("bucket", "last"), tree, "k").where("bucket = last").withColumn("sofar", F.col("begin") + F.sum("n_tokens").over(Window.partitionBy(*tree).orderBy("k")))
    within = inside.where("sofar <= rest").groupBy(*tree).agg(F.max("k").alias("within"))
    # every hash with a wholly taken prefix sorts below that prefix followed by 'g'
    marks = edge.select(*tree, "whole").join(within, tree, "left").select(*tree, F.coalesce("within", F.concat("whole", F.lit("g"))).alias("threshold"))
    return stored(plan.join(marks, tree, "left").select(*tree, "tokens", "budget", "epochs", "threshold"), "plan")


def picked(docs: DataFrame, plan: DataFrame, tree: Sequence[str], seed: int, key: str) -> DataFrame:
    """``docs`` with a row for each epoch it is taken in; further column ``epoch``, in place of one of that name. docs has the
    tree columns."""
    tree = list(tree)
    at = docs.select(held(docs, "epoch").alias("_row"), F.col(key).alias("_key"), *[F.col(c) for c in tree])
    part = F.coalesce(order_key("_key", F.col("epochs"), seed) <= F.col("threshold"), F.lit(False))
    at = by_leaf(at, plan.select(*tree, "epochs", "threshold"), tree, "_key").withColumn("times", (F.col("epochs") + part.cast("long")).cast("int"))
    at = at.where("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    return at.select(*released(docs, "epoch", row="_row"), "epoch").select(*in_order(docs, "epoch"))
