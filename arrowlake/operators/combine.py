"""Metrics of sequences and classes combined: counts added, shares weighted by true positives, or classes averaged.

The tables hold one row a sequence, class and threshold. Roll-ups run over a category tree by the closure of its
ancestors, so that a node of any level gets the classes below it in one grouped aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import written


def combined(rows: DataFrame, by: list[str], counts: list[str], shares: list[str], weight: str) -> DataFrame:
    """Rows of equal ``by`` as one: counts are summed, shares averaged by ``weight`` (a share without any weight is 0)."""
    w = F.col(weight)
    total = F.greatest(F.lit(1.0), F.sum(w).cast("double"))
    return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counts], *[(F.sum(F.col(c) * w) / total).alias(c) for c in shares])


def class_averaged(rows: DataFrame, by: list[str], cls: str, counts: list[str], scores: list[str], empty: list[str], ignore_empty: bool = True) -> DataFrame:
    """Counts summed and scores averaged over the classes. ``ignore_empty`` leaves out a class all of whose ``empty``
    counts are zero in every row that shares its ``by`` but for thresholds; pass rows of one level of combination."""
    if ignore_empty:
        some = rows.groupBy(cls).agg(F.max(sum((F.col(c) for c in empty), F.lit(0))).alias("most")).where("most > 0").select(cls)
        rows = rows.join(some, cls, "left_semi")
    return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counts], *[F.avg(c).alias(c) for c in scores])


def ancestors(tree: DataFrame, node: str = "category_id", parent: str = "parent") -> DataFrame:
    """(category_id, ancestor, distance) of every node of ``tree`` (category_id, parent), itself at distance 0 included.

    Each round joins the known ways with themselves, so their length doubles; the rounds grow with the logarithm of the
    depth. A null parent is a root; a node without a row is a root too; several parents give several ways, of which the
    shortest counts. A loop gives each of its nodes the others as ancestors, once.
    """
    links = tree.where(F.col(parent).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("up"), F.lit(1).alias("distance"))
    nodes = tree.select(F.col(node).alias("node")).union(tree.select(F.col(parent))).where("node IS NOT NULL").distinct()
    ways = written(links.where("node <> up").groupBy("node", "up").agg(F.min("distance").alias("distance")))
    known = ways.agg(F.count("*"), F.sum("distance")).first()
    while known[0]:
        longer = ways.alias("a").join(ways.alias("b"), F.col("a.up") == F.col("b.node"))
        longer = longer.select("a.node", "b.up", (F.col("a.distance") + F.col("b.distance")).alias("distance")).where("node <> up")
        ways = written(ways.union(longer).groupBy("node", "up").agg(F.min("distance").alias("distance")))
        now = ways.agg(F.count("*"), F.sum("distance")).first()
        if now == known:
            break
        known = now
    itself = nodes.select("node", F.col("node").alias("up"), F.lit(0).alias("distance"))
    return ways.union(itself).select(F.col("node").alias("category_id"), F.col("up").alias("ancestor"), "distance")


def super_categories(rows: DataFrame, closure: DataFrame, by: list[str], counts: list[str], shares: list[str], weight: str) -> DataFrame:
    """``combined`` over the classes below every inner node of a tree, detection-averaged: ``category_id`` is the node."""
    below = closure.where("distance > 0").select("category_id", "ancestor").distinct()
    held = rows.join(below, "category_id").drop("category_id").withColumnRenamed("ancestor", "category_id")
    return combined(held, ["category_id", *by], counts, shares, weight)


def tagged(rows: DataFrame, tags: DataFrame, tag: str, seq: str = "video_id") -> DataFrame:
    """Rows of the sequences that carry a tag; ``tags`` is (video_id, tags array)."""
    chosen = tags.where(F.array_contains("tags", tag)).select(F.col(seq)).distinct()
    return rows.join(chosen, seq, "left_semi")
