"""Average precision: precision over the score order, at any scale of one category."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.materialize import written
from .detections import THRESHOLDS
from .greedy import first_fit
from .spatial import pair_overlap

# Area ranges of images and of videos, in pixels.
IMAGE_AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
VIDEO_AREAS = {"all": (0.0, 1e10), "small": (0.0, 128.0**2), "medium": (128.0**2, 256.0**2), "large": (256.0**2, 1e10)}


def running_counts(rows: DataFrame, group: list[str], order: list[Column], hit: str) -> DataFrame:
    """``rows`` with ``tp`` and ``n``: the sum of ``hit`` and the number of rows up to each, in ``order`` within ``group``.

    Rows are sorted by ranges, so a group of any size is spread over many tasks; each range counts for itself, and the
    totals of the ranges before it, a few rows a group, are added.
    """
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c) for c in group]
    ranged = written(rows.repartitionByRange(parts, *keys, *order).withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy(*group, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*group, "part").agg(F.sum(hit).alias("hits"), F.count("*").alias("size"))
    before = totals.select(*group, "part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c} before") for c in ("hits", "size")])
    own = ranged.withColumns({"tp": F.sum(hit).over(within), "n": F.count("*").over(within)})
    out = own.join(before, [*group, "part"])
    return out.withColumns({"tp": F.col("tp") + F.col("hits before"), "n": F.col("n") + F.col("size before")}).drop("part", "hits before", "size before")


def best_by_recall(rows: DataFrame, group: list[str], order: list[Column], names: list[str], gold: DataFrame) -> DataFrame:
    """(group, level, bin, precision, recall): the best precision and recall of each hundredth of recall, in ``order``.

    A row has two masks of bits, one a level: ``counted`` and, among these, ``hits``. ``gold`` is (group, level, n_gt).
    Rows are sorted by ranges, so a group of any size is spread over many tasks. A first pass adds up each range; the totals
    (a row a range and group, of two numbers a level) go through the driver and tell each range what lies before it, and a second
    pass streams the ranges in order, holding one batch.
    """
    spark, levels = rows.sparkSession, len(names)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col(c) for c in group]
    kept = rows.where("counted <> 0").dropna(subset=group)
    ranged = written(kept.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order).select(*group, "counted", "hits", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    bit = lambda c, i: F.sum(F.shiftright(c, i).bitwiseAND(F.lit(1))).alias(f"{c}{i}")
    totals = ranged.groupBy("part", *group).agg(*[bit(c, i) for c in ("counted", "hits") for i in range(levels)]).collect()
    n_gt = {tuple(r[c] for c in group) + (r["level"],): r["n_gt"] for r in gold.collect()}  # a row a group and level
    before: dict = {}
    last: dict = {}
    for r in sorted(totals, key=lambda r: r["part"]):
        key = tuple(r[c] for c in group)
        before[r["part"], key] = last.get(key, np.zeros((2, levels), np.int64))
        last[key] = before[r["part"], key] + np.array([[r[f"{c}{i}"] for i in range(levels)] for c in ("counted", "hits")])
    shared = spark.sparkContext.broadcast((before, n_gt))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (begin, gold_of), so_far, now = shared.value, None, None
        for batch in batches:
            if not len(batch):
                continue
            columns = [batch[c].to_numpy() for c in group]
            part, out = batch["part"].to_numpy(), []
            fresh = np.ones(len(batch), bool)
            fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in [part, *columns]])
            ends = np.append(np.flatnonzero(fresh), len(batch)).tolist()
            bits = [batch[c].to_numpy() for c in ("counted", "hits")]
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                key = tuple(c[lo].item() if hasattr(c[lo], "item") else c[lo] for c in columns)
                if (part[lo], key) != now:
                    now = (part[lo], key)
                    so_far = begin[now].copy()
                for i in range(levels):
                    own, hit = ((b[lo:hi] >> i) & 1 for b in bits)
                    n, tp = so_far[0, i] + np.cumsum(own), so_far[1, i] + np.cumsum(hit)
                    so_far[:, i] = n[-1], tp[-1]
                    most = gold_of.get((*key, names[i]))
                    use = own == 1
                    if most is None or not use.any():
                        continue
                    recall, precision = tp[use] / most, tp[use] / n[use]
                    bins = np.floor(recall * 100 + 1e-9).astype(np.int64)
                    first = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))  # recall never falls
                    best, top = np.maximum.reduceat(precision, first), np.maximum.reduceat(recall, first)
                    out += [(*key, names[i], *x) for x in zip(bins[first].tolist(), best.tolist(), top.tolist(), strict=True)]
            yield pd.DataFrame(out, columns=[*group, "level", "bin", "precision", "recall"])

    kinds = ", ".join(f"`{c}` {ranged.schema[c].dataType.simpleString()}" for c in group)
    # a part's rows lie in one file, written in order; files may be read in pieces, so pieces meet in their part again
    again = ranged.repartition(parts, "part").sortWithinPartitions("part", "at")
    found = again.mapInPandas(run, f"{kinds}, level string, bin long, precision double, recall double")
    return found.groupBy(*group, "level", "bin").agg(F.max("precision").alias("precision"), F.max("recall").alias("recall"))


def first_of_each(dets: DataFrame, max_dets: int) -> DataFrame:
    """The ``max_dets`` highest scores of each image and category, numbered by ``no``."""
    order = Window.partitionBy("image_id", "category_id").orderBy(F.desc("score"), "det_id")
    return dets.withColumn("no", F.row_number().over(order)).where(F.col("no") <= max_dets)


def average_precision(gt: DataFrame, dets: DataFrame, pairs: DataFrame, areas: dict[str, tuple[float, float]], max_dets: int = 100) -> DataFrame:
    """(category_id, area, threshold, ap, recall) by 101-point interpolation; -1 where a range has no gold.

    ``gt`` (image_id, category_id, box_id, size), ``dets`` (image_id, category_id, det_id, score, size) and ``pairs``
    (image_id, category_id, det_id, box_id, iou). In each image and category, detections take by falling score the free gold
    of highest IoU at the threshold, gold within the range before other gold. Detections that took gold outside the
    range, and those without gold that are outside it themselves, do not count.

    A detection stays one row, with a bit a range and threshold: at most six ranges. A pair that is alone at both its ends
    is settled where it stands; only contested pairs are repeated for the ranges and thresholds.
    """
    key = ["image_id", "category_id"]
    n, every_level = len(THRESHOLDS), (1 << len(THRESHOLDS)) - 1
    ranges = F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for i, (lo, hi) in enumerate(areas.values())])).alias("r")
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.lit(t).alias("least")) for i, t in enumerate(THRESHOLDS)])).alias("t")

    def mask(flag: Callable[[int, float, float], Column]) -> Column:
        """The bits of all thresholds of the ranges for which ``flag`` does not hold."""
        bits = [F.when(flag(lo, hi), F.lit(0)).otherwise(F.lit(every_level << (n * i))).cast("long") for i, (lo, hi) in enumerate(areas.values())]
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    out_of = mask(lambda lo, hi: (F.col("size") >= lo) & (F.col("size") <= hi))
    kept = first_of_each(dets, max_dets)
    gold = gt.select(*key, "box_id", out_of.alias("outside"))
    near = pairs.select(*key, "det_id", "box_id", "iou").where(F.col("iou") >= THRESHOLDS[0]).join(kept.select(*key, "det_id", "no"), [*key, "det_id"]).join(gold, [*key, "box_id"])
    for c, of in (("boxes", "det_id"), ("dets", "box_id")):
        near = near.withColumn(c, F.count("*").over(Window.partitionBy(*key, of)))
    near = written(near)
    reached = reduce(lambda a, b: a + b, [(F.col("iou") >= t).cast("long") * (1 << i) for i, t in enumerate(THRESHOLDS)])
    spread = reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(reached, n * i) for i in range(len(areas))])
    alone = near.where("boxes = 1 AND dets = 1").select(*key, "det_id", spread.alias("taken"), spread.bitwiseAND(F.col("outside")).alias("ignored"))
    rivals = near.where("boxes > 1 OR dets > 1").select(*key, "det_id", "box_id", "no", "iou", "outside", levels).where("iou >= t.least").select("*", ranges)
    at = F.col("r.no") * n + F.col("t.no")
    rivals = rivals.select(*key, "det_id", "box_id", "no", at.alias("at"), (-F.col("iou")).alias("worse"), F.getbit("outside", at).cast("boolean").alias("ignored"))
    won = first_fit(rivals, [*key, "at"], "det_id", "box_id", ["no", "ignored", "worse", "box_id"])
    power = F.expr("shiftleft(1L, at)")
    won = won.groupBy(*key, "det_id").agg(F.bit_or(power).alias("taken"), F.bit_or(F.when(F.col("ignored"), power).otherwise(F.lit(0).cast("long"))).alias("ignored"))
    rows = kept.select(*key, "det_id", "score", out_of.alias("out")).join(alone.unionByName(won), [*key, "det_id"], "left").fillna(0, ["taken", "ignored"])
    whole = F.lit((1 << (n * len(areas))) - 1).cast("long")
    dropped = F.col("taken").bitwiseAND(F.col("ignored")).bitwiseOR(F.bitwise_not(F.col("taken")).bitwiseAND(F.col("out")))
    rows = rows.withColumn("counted", whole.bitwiseAND(F.bitwise_not(dropped))).withColumn("hits", F.col("taken").bitwiseAND(F.bitwise_not(F.col("ignored"))))
    inside = gt.select("category_id", "size", F.explode(F.array(*[F.struct(F.lit(a).alias("area"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for a, (lo, hi) in areas.items()])).alias("r"))
    totals = inside.where("NOT (size < r.lo OR size > r.hi)").groupBy("category_id", F.col("r.area").alias("area")).agg(F.count("*").alias("n_gt"))
    by_level = F.explode(F.array(*[F.struct(F.lit(a).alias("area"), F.lit(t).alias("threshold"), F.lit(f"{a} {t}").alias("level")) for a in areas for t in THRESHOLDS])).alias("l")
    named = gt.select("category_id").union(dets.select("category_id")).distinct().select("category_id", by_level).select("category_id", "l.*")
    found = best_by_recall(rows, ["category_id"], [F.desc("score"), F.col("image_id"), F.col("det_id")], [f"{a} {t}" for a in areas for t in THRESHOLDS], named.join(totals, ["category_id", "area"]))
    # a point speaks for every recall up to its own, so the best of each hundredth is all that the interpolation reads
    group = ["category_id", "level"]
    onward = Window.partitionBy(*group).orderBy("bin")
    best = F.max("precision").over(onward.rowsBetween(0, Window.unboundedFollowing))
    bins = found.withColumns({"best": best, "before": F.lag("bin", 1, -1).over(onward)})  # 101 rows at most
    scores = bins.groupBy(*group).agg((F.sum((F.col("bin") - F.col("before")) * F.col("best")) / 101).alias("ap"), F.max("recall").alias("recall"))
    out = named.join(scores, group, "left").join(totals, ["category_id", "area"], "left")
    return out.select("category_id", "area", "threshold", *[F.when(F.col("n_gt").isNull(), -1.0).otherwise(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("ap", "recall")])


def ap_summary(per: DataFrame) -> DataFrame:
    """(area, ap, ap50, ap75, ar): means over categories that have gold, -1 where none has."""
    has, at = F.col("ap") >= 0, lambda t: F.abs(F.col("threshold") - t) < 1e-9
    mean = lambda c, keep: F.coalesce(F.avg(F.when(has & keep, F.col(c))), F.lit(-1.0))
    always = F.lit(True)
    return per.groupBy("area").agg(mean("ap", always).alias("ap"), mean("ap", at(0.5)).alias("ap50"), mean("ap", at(0.75)).alias("ap75"), mean("recall", always).alias("ar"))


def box_ap(gt: DataFrame, dets: DataFrame, areas: dict[str, tuple[float, float]] | None = None, max_dets: int = 100) -> DataFrame:
    """``average_precision`` of boxes (x1, y1, x2, y2) per image."""
    size = ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("size")
    key = ["image_id", "category_id"]
    pairs = pair_overlap(dets, gt, key, ["iou"]).select(*key, F.col("a.det_id").alias("det_id"), F.col("b.box_id").alias("box_id"), "iou")
    return average_precision(gt.select(*key, "box_id", size), dets.select(*key, "det_id", "score", size), pairs, areas or IMAGE_AREAS, max_dets)


def detection_ap(gt: DataFrame, dets: DataFrame, max_dets: int = 100) -> DataFrame:
    """(category_id, threshold, ap, recall) of boxes of any size; -1 without gold."""
    return box_ap(gt, dets, {"all": (float("-inf"), float("inf"))}, max_dets).drop("area")
