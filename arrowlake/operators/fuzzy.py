"""Pairs of similar strings by equality joins on signatures, instead of comparing all pairs of a group.

An edit destroys at most two of a string's distinct two-letter grams. So of two strings ``k`` edits apart, each lacks at
most ``2 k`` of the other's grams, and if both keep their ``2 k + 1`` rarest grams as signatures (in one order for all),
they share one. Strings too short for that are joined on what is left of them after up to ``k`` deletions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 2


def grams(text: Column) -> Column:
    """The distinct two-letter grams of a text; none if it has fewer letters."""
    n = F.length(text) - GRAM + 1
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(GRAM))))


def deletions(text: Column, k: int) -> Column:
    """The text and all that is left of it after up to ``k`` deletions of a letter."""
    last = every = F.array(text)
    for _ in range(k):
        shorter = F.transform(last, lambda t: F.transform(F.when(F.length(t) > 0, F.sequence(F.lit(1), F.length(t))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t)))))
        last = F.array_distinct(F.flatten(shorter))
        every = F.array_distinct(F.concat(every, last))
    return every


def candidates(a: DataFrame, b: DataFrame, key: list[str], left: str, right: str, budget: Column, most: int) -> DataFrame:
    """(key, left, right): all pairs within a key that may be as many edits apart as allowed, and some others.

    ``a`` is (key, left), ``b`` (key, right), each without repeats; keys have none of the names used here. ``budget``, of a column ``length``, is the most
    edits between a string of that length and any that it may be paired with; it is below a half of the letters less
    one, or else at most ``most``. A string takes part by its rarest grams among ``b``'s of its key, so a gram that many
    share is a signature of few. Nulls pair with nothing.
    """
    short = GRAM * most + GRAM - 1 + most  # partners of strings with too few grams are no longer than that
    sides = [(df.select(*key, F.col(c).alias("s"), F.length(c).alias("length")), c) for df, c in ((a, left), (b, right))]
    common = sides[1][0].select(*key, F.explode(grams(F.col("s"))).alias("gram")).groupBy(*key, "gram").agg(F.count("*").alias("held"))
    found = []
    for rows, name in sides:
        each = rows.select(*key, "s", budget.alias("budget"), F.explode(grams(F.col("s"))).alias("gram")).join(common, [*key, "gram"], "left")
        # a gram of no string in ``b`` comes first and meets nothing
        ordered = each.groupBy(*key, "s", "budget").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "gram"))).alias("all"))
        rare = ordered.select(*key, "s", F.explode(F.slice("all", F.lit(1), GRAM * F.col("budget") + 1)).alias("g")).select(*key, F.col("s").alias(name), F.col("g.gram").alias("signature"), F.lit(False).alias("cut"))
        cut = rows.where(F.col("length") <= short).select(*key, F.col("s").alias(name), F.explode(deletions(F.col("s"), most)).alias("signature"), F.lit(True).alias("cut"))
        found.append(rare.unionByName(cut))
    met = found[0].join(found[1], [*key, "signature", "cut"]).withColumn("length", F.length(left))
    return met.where(F.abs(F.col("length") - F.length(right)) <= budget).select(*key, left, right).distinct()
