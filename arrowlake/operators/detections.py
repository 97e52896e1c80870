"""Detection tables and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .assignment import assign_one_to_one
from .spatial import pair_overlap

THRESHOLDS = [i / 100 for i in range(50, 100, 5)]
BOX_EPS, IMAGE_EPS = 1e-4, 1e-6


def top_dets_per_image(dets: DataFrame, n: int) -> DataFrame:
    """The ``n`` highest scores of each image, ties to the smaller id."""
    w = Window.partitionBy("image_id").orderBy(F.desc("score"), "det_id")
    return dets.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r")


def dedup_across_shards(dets: DataFrame, key: list[str]) -> DataFrame:
    """A group is taken whole from the first shard that has it."""
    return dets.join(dets.groupBy(*key).agg(F.min("shard").alias("shard")), [*key, "shard"], "left_semi")


def fill_missing_images(gt: DataFrame, dets: DataFrame) -> DataFrame:
    """Every gold image once, with its detections or a row of nulls."""
    return gt.select("image_id").distinct().join(dets, "image_id", "left")


def normalise_dets(dets: DataFrame, arrays: list[str], places: int = 5) -> DataFrame:
    """Parallel arrays of boxes (x1, y1, x2, y2), labels and scores to rows: xywh and score rounded, halves to even."""
    rows = dets.select("image_id", "chunk", F.posexplode(F.arrays_zip(*arrays)).alias("pos", "d")).select("image_id", "chunk", "pos", "d.*")
    r = lambda c: F.bround(c, places)
    return rows.select("image_id", "chunk", "pos", r(F.col("x1")).alias("x"), r(F.col("y1")).alias("y"), r(F.col("x2") - F.col("x1")).alias("w"), r(F.col("y2") - F.col("y1")).alias("h"), r(F.col("score")).alias("score"))


def count_dets(images: DataFrame, dets: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per image the number of detections that score above the threshold."""
    return images.select("image_id").join(dets.groupBy("image_id").agg(F.count_if(F.col("score") > threshold).alias("n")), "image_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def positive_split(dets: DataFrame, gt: DataFrame) -> DataFrame:
    """Detections whose category has gold on that image."""
    return dets.join(gt.select("image_id", "category_id").distinct(), ["image_id", "category_id"], "left_semi")


def cgf1(gt: DataFrame, dets: DataFrame, images: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per IoU threshold: box counts, image-level counts and the scores made of them.

    Detections that score at least ``threshold`` are matched to gold optimally per image. Ratios of box counts are
    smoothed by 1e-4, those of image counts by 1e-6. cgF1 is the positive micro F1 times the image-level correlation.
    """
    kept = dets.where(F.col("score") >= threshold)
    pairs = pair_overlap(gt, kept, ["image_id"], ["iou"]).select("image_id", F.col("a.box_id").alias("box_id"), F.col("b.det_id").alias("det_id"), "iou")
    matched = assign_one_to_one(pairs, ["image_id"], "box_id", "det_id", "iou")
    levels = F.explode(F.array(*[F.lit(t) for t in THRESHOLDS])).alias("threshold")
    hits = matched.select("image_id", "iou", levels).groupBy("image_id", "threshold").agg(F.count_if(F.col("iou") >= F.col("threshold")).alias("tp"))
    per = images.select("image_id").distinct().join(gt.groupBy("image_id").agg(F.count("*").alias("n_gt")), "image_id", "left").join(kept.groupBy("image_id").agg(F.count("*").alias("n_dt")), "image_id", "left")
    per = per.select("image_id", F.coalesce("n_gt", F.lit(0)).alias("n_gt"), F.coalesce("n_dt", F.lit(0)).alias("n_dt"), levels).join(hits, ["image_id", "threshold"], "left")
    per = per.withColumn("tp", F.coalesce("tp", F.lit(0))).withColumns({"fp": F.col("n_dt") - F.col("tp"), "fn": F.col("n_gt") - F.col("tp"), "pos": F.col("n_gt") > 0})
    local = F.when(F.col("pos"), 2 * F.col("tp") / (F.col("n_dt") + F.col("n_gt")))
    both = F.col("n_dt") > 0
    c = per.withColumn("f1", local).groupBy("threshold").agg(
        *[F.sum(x).alias(x) for x in ("tp", "fp", "fn")],
        F.sum(F.when(F.col("pos"), F.col("fp")).otherwise(0)).alias("pos_fp"),
        F.count_if(F.col("pos") & both).alias("il_tp"), F.count_if(~F.col("pos") & both).alias("il_fp"), F.count_if(~F.col("pos") & ~both).alias("il_tn"), F.count_if(F.col("pos") & ~both).alias("il_fn"),
        F.avg("f1").alias("positive_macro_f1"),
    )
    over = lambda a, b, e: F.col(a) / (F.col(a) + F.col(b) + e)
    harmonic = lambda p, r, e: 2 * F.col(p) * F.col(r) / (F.col(p) + F.col(r) + e)
    c = c.withColumns({"precision": over("tp", "fp", BOX_EPS), "recall": over("tp", "fn", BOX_EPS), "positive_micro_precision": over("tp", "pos_fp", BOX_EPS), "il_precision": over("il_tp", "il_fp", IMAGE_EPS), "il_recall": over("il_tp", "il_fn", IMAGE_EPS), "il_fpr": over("il_fp", "il_tn", IMAGE_EPS)})
    root = F.sqrt((F.col("il_tp") + F.col("il_fp")).cast("double") * (F.col("il_tp") + F.col("il_fn")) * (F.col("il_tn") + F.col("il_fp")) * (F.col("il_tn") + F.col("il_fn")))
    mcc = (F.col("il_tp").cast("double") * F.col("il_tn") - F.col("il_fp").cast("double") * F.col("il_fn")) / (root + IMAGE_EPS)
    c = c.withColumns({"f1": harmonic("precision", "recall", BOX_EPS), "positive_micro_f1": harmonic("positive_micro_precision", "recall", BOX_EPS), "il_f1": harmonic("il_precision", "il_recall", IMAGE_EPS), "il_mcc": mcc})
    return c.withColumn("cgf1", F.col("positive_micro_f1") * F.col("il_mcc"))


def best_of_ground_truths(scores: DataFrame) -> DataFrame:
    """Per image the gold set (image_id, gt_no, f1 per threshold) of highest mean F1; an undefined mean wins, ties to the first."""
    means = scores.groupBy("image_id", "gt_no").agg(F.avg("f1").alias("mean_f1"))
    w = Window.partitionBy("image_id").orderBy(F.col("mean_f1").isNull().desc(), F.desc("mean_f1"), "gt_no")
    return means.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def exhaustive_scope(images: DataFrame, partial: DataFrame) -> DataFrame:
    """Images that no gold set marks as partly labelled (``partial``: image_id)."""
    return images.select("image_id").distinct().join(partial.select("image_id"), "image_id", "left_anti")
