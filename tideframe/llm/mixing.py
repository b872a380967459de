"""Mixing sources to target weights by hierarchical budgets, in DataFrame operations only.

Leaves are the distinct values of the ``levels`` columns (domain, language, source), a tree with one
level per column.  A node can give ``epochs`` times the tokens below it.  From the root down each
node's budget is dealt to its children by weight; a child gets no more than it can give, and what it
leaves goes to its siblings by weight again.  Since a node is never dealt more than it can give, a
shortage reaches a node's own siblings only when all its children are used up: siblings before
ancestors.  The shares are exact integers: children are ordered by what they can give per weight;
those whose fair share of what is left exceeds it are full, the others split the rest, and units
lost by rounding go to the first of them.

A leaf with budget b and t tokens takes all its documents b div t times and then the prefix of one
more seeded epoch: documents in order of a hash of seed, epoch and id, as long as the tokens before
a document are fewer than what is left.  The last document may reach over the budget.  The prefix is
found by summing tokens per hash bucket first; only the bucket in which it ends is ordered by row,
so a leaf with a third of all rows is spread like any other.

Defined results: null levels are nodes of their own, of weight ``default``; nodes of weight 0 or
less get nothing; documents without tokens are taken in the epochs they fall in; rows with the same
id in a leaf are taken together; null ids are one id; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tideframe.session import staged

BIG = "decimal(38,0)"


def word_tokens(text: Column) -> Column:
    """Words of a text: runs other than space and \\x09-\\x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def node_weights(weights: dict[tuple[str, ...], int], path: list[Column], default: int) -> Column:
    """The weight of the node at ``path``: a small table given by the user, as nested conditions."""
    own = [(k, w) for k, w in weights.items() if len(k) == len(path)]
    out = F.lit(default)
    for key, weight in own:
        same = F.lit(True)
        for column, value in zip(path, key):
            same = same & column.eqNullSafe(F.lit(value))
        out = F.when(same, F.lit(weight)).otherwise(out)
    return out.cast("long")


def deal(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """children: parent columns, ``name``, weight, room, budget (of the parent, at most what its
    children can give).  Replaces budget by the child's share."""
    by = Window.partitionBy(*parent)
    order = by.orderBy("full_at", F.col(name).asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weighted = children.where("weight > 0")
    # what a child can give per weight, in exact integers: room / weight scaled by a common factor
    steps = weighted.withColumn("full_at", F.expr(f"cast(room as {BIG}) * 1000000 div weight"))
    steps = steps.withColumn("left_over", F.col("budget") - F.coalesce(F.sum("room").over(before), F.lit(0))).withColumn("weights", F.sum("weight").over(onward))
    steps = steps.withColumn("full", F.col("room").cast(BIG) * F.col("weights") <= F.col("left_over").cast(BIG) * F.col("weight"))
    # full children are a prefix of the order; the others share what the prefix leaves
    steps = steps.withColumn("full", F.min(F.col("full").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    used = F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(by), F.lit(0))
    steps = steps.withColumn("rest", F.col("budget") - used).withColumn("rest_weight", F.sum(F.when(~F.col("full"), F.col("weight"))).over(by))
    steps = steps.withColumn("share", F.when(F.col("full"), F.col("room")).otherwise(F.least("room", F.expr(f"cast(rest as {BIG}) * weight div rest_weight"))))
    lost = F.col("budget") - F.sum("share").over(by)
    number = F.row_number().over(by.orderBy("full", "full_at", F.col(name).asc_nulls_first()))
    open_ = ~F.col("full")
    return steps.withColumn("budget", F.when(open_ & (number <= lost), F.least(F.col("share") + 1, F.col("room"))).otherwise(F.col("share"))).select(*children.columns)


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict, budget: int | None, epochs: int, default: int) -> DataFrame:
    """leaves: the levels and tokens.  Returns the levels, tokens and budget."""
    total = leaves.agg(F.sum("tokens").alias("can")).select(F.least(F.coalesce(F.col("can") * epochs, F.lit(0)), F.lit(budget).cast("long") if budget is not None else F.coalesce("can", F.lit(0))).alias("budget"))
    nodes = total
    for depth, name in enumerate(levels):
        parent, path = levels[:depth], levels[: depth + 1]
        rooms = leaves.groupBy(*path).agg((F.sum("tokens") * epochs).alias("room"))
        if depth:
            above = nodes.select(*[F.col(c).alias(f"_{c}") for c in parent], F.least("budget", "room").alias("budget"))
            match = F.lit(True)
            for c in parent:
                match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
            children = rooms.join(above, match).select(*path, "room", "budget")
        else:
            children = rooms.crossJoin(total)  # one row: the budget of the root
        children = children.withColumn("weight", node_weights(weights, [F.col(c) for c in path], default))
        # children without weight can't be dealt to: the parent's budget counts only the others
        can = F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("room"))).over(Window.partitionBy(*parent)), F.lit(0))
        nodes = deal(children.withColumn("budget", F.least("budget", can)), parent, name)
    return nodes.withColumn("tokens", F.expr(f"room div {epochs}")).select(*levels, "tokens", "budget")


def mix(docs: DataFrame, levels: list[str], weights: dict[tuple, int], tokens: Column, budget: int | None = None, epochs: int = 1, default: int = 1, seed: int = 1, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that the mix takes, one per epoch in which a row is taken, with columns
    mix_tokens and mix_epoch (from 0); input columns of these names are replaced.

    weights: target weight (a positive integer) of the node at each path of level values; other
    nodes have ``default``.  budget: tokens wanted, by default the tokens of the table; no more than
    ``epochs`` times the tokens of the table are given."""
    names = [c for c in docs.columns if c not in ("mix_tokens", "mix_epoch")]
    paths = [f"level{k}" for k in range(len(levels))]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *[F.col(c).alias(p) for c, p in zip(levels, paths)], F.col(id_col).cast("string").alias("row_id"), tokens.alias("mix_tokens"))
    sized = staged(row.drop("row"))
    leaves = sized.groupBy(*paths).agg(F.sum("mix_tokens").alias("tokens"))
    has = F.col("tokens") > 0
    plan = staged(leaf_budgets(leaves, paths, weights, budget, epochs, default).select(*[F.col(p).alias(f"_{p}") for p in paths], F.when(has, F.expr("budget div tokens")).otherwise(0).cast("int").alias("whole"), F.when(has, F.expr("budget % tokens")).otherwise(0).alias("more")))
    same = F.lit(True)
    for p in paths:
        same = same & F.col(p).eqNullSafe(F.col(f"_{p}"))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce("row_id", F.lit(""))).cast("binary"))
    bucket = F.substring("order", 1, 3)
    placed = sized.join(plan, same).withColumn("order", order).withColumn("bucket", bucket)
    # tokens per leaf and bucket, at most 4096 rows a leaf; the prefix ends in the edge bucket
    past = Window.partitionBy(*paths).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*paths, "bucket").agg(F.sum("mix_tokens").alias("tokens"), F.first("more").alias("more"))
    sums = sums.withColumn("before", F.coalesce(F.sum("tokens").over(past), F.lit(0)))
    ends = sums.where((F.col("more") > 0) & (F.col("before") + F.col("tokens") >= F.col("more"))).groupBy(*[F.col(p).alias(f"e_{p}") for p in paths]).agg(F.min(F.struct("bucket", "before")).alias("edge"))
    at_edge = F.col("bucket") == F.col("edge.bucket")
    for p in paths:
        at_edge = at_edge & F.col(p).eqNullSafe(F.col(f"e_{p}"))
    running = Window.partitionBy(*paths).orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    edge = placed.join(ends, at_edge).groupBy(*paths, "order").agg(F.sum("mix_tokens").alias("tokens"), F.first("more").alias("more"), F.first("edge").alias("edge"))
    edge = edge.withColumn("before", F.col("edge.before") + F.coalesce(F.sum("tokens").over(running), F.lit(0)))
    # rows up to this order are in the prefix: the last of the edge bucket that begins within the budget
    cuts = edge.groupBy(*[F.col(p).alias(f"c_{p}") for p in paths]).agg(F.max(F.when(F.col("before") < F.col("more"), F.col("order"))).alias("cut"))
    cut_of = F.lit(True)
    for p in paths:
        cut_of = cut_of & F.col(f"_{p}").eqNullSafe(F.col(f"c_{p}"))
    final = staged(plan.join(cuts, cut_of, "left").select(*[f"_{p}" for p in paths], "whole", "cut"))
    times = F.col("whole") + F.coalesce((order <= F.col("cut")).cast("int"), F.lit(0))
    taken = row.join(final, same).withColumn("times", times).where("times > 0").withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    return taken.select("row.*", "mix_tokens", "mix_epoch")
