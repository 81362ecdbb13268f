"""Ancestors over (child, parent) rows by pointer doubling: a chain of length n takes log n joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.lineage import cut

#: Rounds of doubling; 2**40 links are more than there can be rows.
ROUNDS = 40


def roots(links: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(child, root, depth) of every child; a row without a parent, or whose parent is no child, is a root.

    Every row points to an ancestor and knows how far it is.  A round lets it point to where its ancestor
    points, so distances double.  Rows that have arrived leave the joins, and the rest is checkpointed.  A
    child has one parent: of several the least counts.  Children on a cycle have no root and are left out,
    as no round brings them nearer to one; so are those below a cycle.
    """
    once = links.where(F.col(child).isNotNull()).groupBy(F.col(child).alias("child")).agg(F.min(parent).alias("up"))
    known = once.select(F.col("child").alias("_known"))
    first = once.join(known, F.col("up") == F.col("_known"), "left").select("child", F.when(F.col("_known").isNotNull(), F.col("up")).alias("up"))
    done = cut(first.where("up IS NULL").select("child", F.col("child").alias("root"), F.lit(0).cast("long").alias("depth")))
    open_ = cut(first.where("up IS NOT NULL").select("child", "up", F.lit(1).cast("long").alias("far")))
    out, left = done, open_.count()
    for _ in range(ROUNDS):
        if not left:
            break
        arrived = cut(open_.join(out.select(F.col("child").alias("up"), "root", F.col("depth").alias("_more")), "up").select("child", "root", (F.col("far") + F.col("_more")).alias("depth")))
        ahead = open_.select(F.col("child").alias("up"), F.col("up").alias("_up"), F.col("far").alias("_far"))
        rest = open_.join(arrived.select("child"), "child", "left_anti")
        open_ = cut(rest.join(ahead, "up").select("child", F.col("_up").alias("up"), (F.col("far") + F.col("_far")).alias("far")))
        out = cut(out.unionByName(arrived))
        now = open_.count()
        if now == left and arrived.isEmpty():
            break  # what is left goes round in cycles
        left = now
    return out.select(F.col("child").alias(child), "root", "depth")


def ancestors(links: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """(child, ancestor, distance) of every pair, itself at distance 0.  As many rows as there are pairs; cycles have none.

    Known pairs are extended by known pairs, so the distances that are covered double each round.
    """
    settled = roots(links, child, parent).select(F.col(child).alias("child"), "depth")
    once = links.groupBy(F.col(child).alias("child")).agg(F.min(parent).alias("ancestor")).join(settled.where("depth > 0").select("child"), "child", "left_semi")
    pairs, reach = cut(once.select("child", "ancestor", F.lit(1).cast("long").alias("distance"))), 1
    deepest = settled.agg(F.max("depth")).first()[0] or 0
    while reach < deepest:
        far = pairs.where(F.col("distance") == reach).select("child", F.col("ancestor").alias("_at"), F.col("distance").alias("_near"))
        more = far.join(pairs.select(F.col("child").alias("_at"), "ancestor", "distance"), "_at").select("child", "ancestor", (F.col("_near") + F.col("distance")).alias("distance"))
        pairs, reach = cut(pairs.unionByName(more)), 2 * reach
    own = settled.select("child", F.col("child").alias("ancestor"), F.lit(0).cast("long").alias("distance"))
    return own.unionByName(pairs).withColumnRenamed("child", child)
