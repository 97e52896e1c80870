"""Triplet scores: exact and relaxed matching per diagram, micro precision, recall and F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import normalize_label, normalize_relation, similar_at_least
from .greedy import first_fit

TRIPLET = ["graph_id", "src", "rel", "dst"]


def normalized_triplets(df: DataFrame, label_mode: str = "lower_strip", relation_mode: str = "default") -> DataFrame:
    """The set of normalised triplets of each diagram."""
    return df.select(
        "graph_id", normalize_label(F.col("src"), label_mode).alias("src"), normalize_relation(F.col("rel"), relation_mode).alias("rel"), normalize_label(F.col("dst"), label_mode).alias("dst")
    ).distinct()


def part_of(arrows: DataFrame) -> DataFrame:
    """Containment triplets from the locations of both ends of each arrow; ``none`` is no location."""
    sides = [arrows.select("graph_id", F.col(n).alias("src"), F.lit("partof").alias("rel"), F.col(f"{n}_loc").alias("dst")) for n in ("src", "dst")]
    both = sides[0].unionByName(sides[1])
    return both.where(F.col("dst").isNotNull() & ~F.lower(F.trim("dst")).isin("", "none")).distinct()


def relaxed_match(pred: DataFrame, gt: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Pairs (graph_id, gt triplet, predicted triplet) that are alike but not equal, one to one.

    Exact hits are set aside first. In sorted order each gold triplet takes the first free prediction of which all
    three parts are similar enough.
    """
    rest_gt, rest_pred = gt.join(pred, TRIPLET, "left_anti"), pred.join(gt, TRIPLET, "left_anti")
    g = rest_gt.select("graph_id", F.struct("src", "rel", "dst").alias("gold"))
    p = rest_pred.select("graph_id", F.struct("src", "rel", "dst").alias("predicted"))
    alike = [similar_at_least(F.col(f"gold.{c}"), F.col(f"predicted.{c}"), threshold) for c in ("rel", "src", "dst")]
    pairs = g.join(p, "graph_id").where(alike[0] & alike[1] & alike[2])
    w = Window.partitionBy("graph_id")
    ranked = pairs.select(
        "graph_id", F.dense_rank().over(w.orderBy("gold")).alias("g_no"), F.dense_rank().over(w.orderBy("predicted")).alias("p_no"), "gold.src", "gold.rel", "gold.dst"
    )
    return first_fit(ranked, ["graph_id"], "g_no", "p_no", ["g_no", "p_no"])


def rate(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def scores(counts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """P, R and F1, exact and relaxed, from counts of hits, predictions and gold triplets."""
    out = counts.withColumns({f"{k}precision": rate(F.col(f"{h}_hits"), F.col("total_pred")) for k, h in (("", "exact"), ("relaxed_", "relaxed"))})
    out = out.withColumns({f"{k}recall": rate(F.col(f"{h}_hits"), F.col("total_gt")) for k, h in (("", "exact"), ("relaxed_", "relaxed"))})
    f1 = {f"{k}f1": rate(2 * F.col(f"{k}precision") * F.col(f"{k}recall"), F.col(f"{k}precision") + F.col(f"{k}recall")) for k in ("", "relaxed_")}
    return out.withColumns(f1).withColumn("score", (F.col("f1") + F.col("relaxed_f1")) / 2)


def _counted(pred: DataFrame, gt: DataFrame, threshold: float) -> DataFrame:
    """One row per triplet with flags; predictions only of diagrams that have gold."""
    pred = pred.join(gt.select("graph_id").distinct(), "graph_id", "left_semi")
    exact = gt.join(pred, TRIPLET, "left_semi").select(*TRIPLET, F.lit("exact").alias("what"))
    near = relaxed_match(pred, gt, threshold).select(*TRIPLET, F.lit("relaxed").alias("what"))
    return exact.unionByName(near).unionByName(gt.select(*TRIPLET, F.lit("gt").alias("what"))).unionByName(pred.select(*TRIPLET, F.lit("pred").alias("what")))


def triplet_scores(pred: DataFrame, gt: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Micro scores over all gold diagrams; a diagram without predictions counts as misses."""
    missing = gt.select("graph_id").distinct().join(pred.select("graph_id").distinct(), "graph_id", "left_anti").agg(F.count("*").alias("missing"))
    n = lambda *kinds: F.count_if(F.col("what").isin(*kinds))
    counts = _counted(pred, gt, threshold).agg(n("exact").alias("exact_hits"), n("exact", "relaxed").alias("relaxed_hits"), n("pred").alias("total_pred"), n("gt").alias("total_gt"))
    return scores(counts.join(missing))


def triplet_scores_split(pred: DataFrame, gt: DataFrame, threshold: float = 0.85) -> DataFrame:
    """The same for connections, containments and overall; a relaxed hit belongs to its gold triplet's kind."""
    kind = F.when(F.col("rel") == "partof", "containment").otherwise("connection")
    n = lambda *kinds: F.count_if(F.col("what").isin(*kinds))
    rows = _counted(pred, gt, threshold).withColumn("kind", kind).groupingSets([["kind"], []], "kind")
    counts = rows.agg(n("exact").alias("exact_hits"), n("exact", "relaxed").alias("relaxed_hits"), n("pred").alias("total_pred"), n("gt").alias("total_gt"))
    return scores(counts.withColumn("kind", F.coalesce("kind", F.lit("overall"))))


def select_scope(gt: DataFrame, listed: DataFrame | None = None, listing: DataFrame | None = None) -> DataFrame:
    """Gold rows of the requested diagrams only: a test list beats an image listing (its files' stems).

    Fails if nothing is requested or a requested diagram has no gold; of list entries the first of id, image_name,
    file_name, image and image_path that is there counts.
    """
    if listed is not None:
        names = [F.col(c).cast("string") for c in ("id", "image_name", "file_name", "image", "image_path") if c in listed.columns]
        ids = listed.select(F.coalesce(*names).alias("name"))
    else:
        ids = listing.select(F.col(listing.columns[0]).cast("string").alias("name"))
    stem = F.regexp_replace(F.regexp_replace("name", r"^.*/", ""), r"\.[^.]*$", "")
    ids = ids.where("name IS NOT NULL").select(stem.alias("graph_id")).distinct()
    known = gt.select("graph_id").distinct()
    count, lost = ids.count(), ids.join(known, "graph_id", "left_anti").count()
    if not count or lost:
        raise ValueError(f"{count} diagrams requested, {lost} without ground truth")
    return gt.join(ids, "graph_id", "left_semi")
