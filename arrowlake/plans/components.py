"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .materialize import checkpointed


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; a component is named by its smallest node.

    Alternates large-star and small-star steps: each node points all its larger (then all its smaller)
    neighbours at the smallest one it knows. Every step is a grouped minimum and a join, both of which combine
    on the map side or split under adaptive execution, so a hub costs no more than its edges. Rounds grow with
    the logarithm of the longest path. Nulls and self loops are dropped; an empty input gives an empty output.
    """
    a, b = F.col(u), F.col(v)
    state = checkpointed(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    seen = _fingerprint(state)
    while seen[0]:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        nearest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(nearest, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        state = checkpointed(small)
        now = _fingerprint(state)
        if now == seen:
            break
        seen = now
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
