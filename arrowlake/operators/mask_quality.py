"""Region and boundary quality of masks, and the image scores made of them. Masks are run-length coded over a
column-major image; everything is arithmetic on runs, and no pixel is ever a row.

A mask's runs are cut at the columns, and travel as arrays in its row. Where several sets meet in a column (a mask and its
neighbour column, a boundary and another's surroundings), each run puts an event at its start and one at its end, and
running sums over the events of the column tell which sets cover each stretch between two events; tasks do that for
many masks at once by array arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.materialize import written
from . import mask_arrays as arrays
from .assignment import assign_one_to_one
from .detections import BOX_EPS, IMAGE_EPS, THRESHOLDS

TINY = 1e-9


def column_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, height, width, x, y1, y2): runs (run_start, run_end) cut at the columns of their image, rows y1 to y2 - 1."""
    h = F.col("height")
    first, last = F.floor(F.col("run_start") / h), F.floor((F.col("run_end") - 1) / h)
    cut = runs.where("run_end > run_start").select("*", F.explode(F.sequence(first, last)).alias("x"))
    y1, y2 = F.greatest(F.col("run_start") - F.col("x") * h, F.lit(0)), F.least(F.col("run_end") - F.col("x") * h, h)
    return cut.select(*keys, "height", "width", F.col("x").cast("long"), y1.cast("long").alias("y1"), y2.cast("long").alias("y2"))


def swept(layers: DataFrame, by: list[str], weights: list[str], chosen: Column) -> DataFrame:
    """(by, y1, y2): the stretches of each column where ``chosen`` holds of the sums of ``weights`` over the runs there."""
    ends = F.explode(F.array(F.struct(F.col("y1").alias("y"), *[F.col(w) for w in weights]), F.struct(F.col("y2").alias("y"), *[(-F.col(w)).alias(w) for w in weights]))).alias("e")
    events = layers.select(*by, ends).select(*by, "e.*").groupBy(*by, "y").agg(*[F.sum(w).alias(w) for w in weights])
    along = Window.partitionBy(*by).orderBy("y")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = events.select(*by, F.col("y").alias("y1"), F.lead("y").over(along).alias("y2"), *[F.sum(w).over(so_far).alias(w) for w in weights])
    return steps.where(F.col("y2").isNotNull() & chosen).select(*by, "y1", "y2")


def boundaries(columns: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, height, width, x, y1, y2): pixels that differ from their right, lower or lower right neighbour, as runs.

    Beyond the last row and column an image goes on as it ends. A pixel is one of these where the square of the four
    holds some of the mask, but not only.
    """
    h = F.col("height")
    some = columns.withColumns({"y1": F.greatest(F.col("y1") - 1, F.lit(0)), "some": F.lit(1), "full": F.lit(0)})
    full = columns.withColumns({"y2": F.when(F.col("y2") == h, h).otherwise(F.col("y2") - 1), "some": F.lit(0), "full": F.lit(1)}).where("y2 > y1")
    both = some.unionByName(full)
    at = F.when(F.col("x") == F.col("width") - 1, F.array(F.col("x"), F.col("x"), F.col("x") - 1)).otherwise(F.array(F.col("x"), F.col("x") - 1))
    spread = both.withColumn("x", F.explode(at)).where("x >= 0")
    by = [*keys, "height", "width", "x"]
    return swept(spread, by, ["some", "full"], (F.col("some") > 0) & (F.col("full") < 2))


def packed(columns: DataFrame, item: str, radius: Column | None = None) -> DataFrame:
    """(image_id, item, ...): a mask a row, its column runs as arrays, with its area and extent."""
    runs = F.collect_list(F.struct("x", "y1", "y2"))
    ends = [F.min("x"), F.max("x"), F.min("y1"), F.max("y2"), F.sum(F.col("y2") - F.col("y1"))]
    names = ["x_min", "x_max", "y_min", "y_max", "area"]
    out = columns.groupBy("image_id", item).agg(runs.alias("runs"), F.first("height").alias("height"), F.first("width").alias("width"), *[c.alias(n) for c, n in zip(ends, names, strict=True)])
    extra = [radius.cast("long").alias(f"{item}_radius")] if radius is not None else []
    return out.select("image_id", item, *[F.col(f"runs.{c}").alias(f"{item}_{c}") for c in ("x", "y1", "y2")], *[F.col(c).alias(f"{item}_{c}") for c in ("height", "width", *names)], *extra)


#: Runs that are worked on at once, surroundings included; a mask of more is one piece.
AT_ONCE = 500_000


def by_masks(rows: DataFrame, kept: list[str], name: str, value: Callable[[dict[str, np.ndarray], int], np.ndarray]) -> DataFrame:
    """``kept`` columns of ``rows`` (``packed`` masks of both sides, or of one where the other is null) with ``name``: ``value`` of the flat
    runs (owner, x, y1, y2) of each side and the columns by owner."""
    schema = rows.select(*kept).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reach = np.ones(batch.num_rows, np.int64)
            for side in ("g", "d"):
                grown = 2 * pc.fill_null(batch.column(f"{side}_radius"), 0).to_numpy(zero_copy_only=False) + 1 if f"{side}_radius" in batch.schema.names else 1
                reach = reach + pc.fill_null(pc.list_value_length(batch.column(f"{side}_x")), 0).to_numpy(zero_copy_only=False) * grown
            piece, lo = (np.cumsum(reach) - reach) // AT_ONCE, 0
            while lo < batch.num_rows:
                hi = int(np.searchsorted(piece, piece[lo], "right"))
                part, held = batch.slice(lo, hi - lo), {}
                for side in ("g", "d"):
                    n = pc.fill_null(pc.list_value_length(part.column(f"{side}_x")), 0).to_numpy(zero_copy_only=False)
                    flat = [part.column(f"{side}_{c}").flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("x", "y1", "y2")]
                    held[side] = (np.repeat(np.arange(len(n)), n), *flat)
                for c in part.schema.names:
                    if c.endswith(("_height", "_width", "_area", "_radius")):
                        held[c] = pc.fill_null(part.column(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                columns = [part.column(c) for c in kept] + [pa.array(value(held, part.num_rows), pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, name])
                lo = hi

    return rows.mapInArrow(run, schema)


def boundary_radius(share: float = 0.008) -> Column:
    """The usual tolerance: a share of the image's diagonal, rounded up."""
    return F.ceil(share * F.sqrt(F.col("height") * F.col("height") + F.col("width") * F.col("width"))).cast("long")


def boundary_f(pairs: DataFrame, gold: DataFrame, found: DataFrame, radius: Column) -> DataFrame:
    """``pairs`` (image_id, g, d) with ``f``: the harmonic mean of the shares of each boundary near the other.

    ``gold`` and ``found`` are column runs keyed by (image_id, g) and (image_id, d); ``radius`` is of their height and width. A mask
    without a boundary gives precision or recall 1 on its side, and 0 on the other if that one has a boundary. A mask travels as a row.
    """
    rows = pairs.join(packed(gold, "g", radius), ["image_id", "g"], "left").join(packed(found, "d", radius), ["image_id", "d"], "left")

    def f(held: dict, owners: int) -> np.ndarray:
        edges = {side: arrays.boundaries(*held[side], held[f"{side}_height"], held[f"{side}_width"]) for side in "gd"}
        n = {side: arrays.sized(e, owners) for side, e in edges.items()}
        share = {}
        for side, other in (("g", "d"), ("d", "g")):
            near = arrays.covered(edges[side], arrays.surroundings(*edges[other], held[f"{other}_height"], held[f"{other}_width"], held[f"{other}_radius"]), owners)
            part = near / np.maximum(n[side], 1)
            share[side] = np.where(n[side] == 0, 1.0, np.where(n[other] == 0, 0.0, part))
        below = share["d"] + share["g"]
        return np.divide(2 * share["d"] * share["g"], below, out=np.zeros(owners), where=below > 0)

    return by_masks(rows, pairs.columns, "f", f)


def mask_pairs(gold: DataFrame, found: DataFrame) -> DataFrame:
    """(image_id, g, d, iou) of masks that share a pixel: masks of an image whose extents meet are compared, each a row."""
    rows = packed(gold, "g").join(packed(found, "d"), "image_id")
    rows = rows.where("g_x_min <= d_x_max AND d_x_min <= g_x_max AND g_y_min < d_y_max AND d_y_min < g_y_max")

    def iou(held: dict, owners: int) -> np.ndarray:
        inter = arrays.covered(held["g"], held["d"], owners)
        return inter / np.maximum(held["g_area"] + held["d_area"] - inter, 1)

    return by_masks(rows, ["image_id", "g", "d"], "iou", iou).where("iou > 0")


def matched_masks(gold: DataFrame, found: DataFrame) -> DataFrame:
    """(image_id, g, d, iou): the assignment of highest total IoU. As many pairs as an image's smaller side has masks:
    those left without overlap pair up in the order of their ids."""
    best = written(assign_one_to_one(mask_pairs(gold, found), ["image_id"], "g", "d", "iou"))

    def rest(df: DataFrame, item: str) -> DataFrame:
        left = df.select("image_id", item).distinct().join(best.select("image_id", item), ["image_id", item], "left_anti")
        return left.withColumn("rank", F.row_number().over(Window.partitionBy("image_id").orderBy(item)))

    idle = rest(gold, "g").join(rest(found, "d"), ["image_id", "rank"]).select("image_id", "g", "d", F.lit(0.0).alias("iou"))
    return best.unionByName(idle)


def image_scores(images: DataFrame, gold: DataFrame, found: DataFrame, matches: DataFrame) -> DataFrame:
    """(image_id, threshold) with TP, FP, FN, F1 and whether the image is perfect; J, F and J&F where both sides have masks.

    ``matches`` is (image_id, g, d, iou, f). Images without masks on either side have no counts but are perfect.
    """
    n = lambda df, item, name: df.select("image_id", item).distinct().groupBy("image_id").agg(F.count("*").alias(name))
    per = images.select("image_id").distinct().join(n(gold, "g", "n_gt"), "image_id", "left").join(n(found, "d", "n_dt"), "image_id", "left").fillna(0, ["n_gt", "n_dt"])
    own = matches.groupBy("image_id").agg(
        F.avg("iou").alias("j"), (F.sum("f") / (F.count("*") + TINY)).alias("f"), *[F.count_if(F.col("iou") >= t).alias(f"tp{i}") for i, t in enumerate(THRESHOLDS)]
    )
    levels = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.coalesce(f"tp{i}", F.lit(0)).alias("tp")) for i, t in enumerate(THRESHOLDS)])).alias("level")
    out = per.join(own, "image_id", "left").select("image_id", "n_gt", "n_dt", "j", "f", levels).select("image_id", "n_gt", "n_dt", "j", "f", "level.*")
    out = out.withColumns({"fp": F.col("n_dt") - F.col("tp"), "fn": F.col("n_gt") - F.col("tp"), "jf": (F.col("j") + F.col("f")) / 2})
    precision, recall = F.col("tp") / (F.col("n_dt") + BOX_EPS), F.col("tp") / (F.col("n_gt") + BOX_EPS)
    f1 = F.when((F.col("n_gt") > 0) | (F.col("n_dt") > 0), 2 * precision * recall / (precision + recall + BOX_EPS))
    return out.withColumns({"f1": f1, "perfect": (F.col("fp") == 0) & (F.col("fn") == 0)})


def combined_scores(per: DataFrame) -> DataFrame:
    """One row a threshold over all images of ``image_scores``: micro and macro scores of the positive images, image-level
    counts and correlation, shares of perfect images, J, F and J&F, and the three cgF1 made of them. Ratios of box
    counts are smoothed by 1e-4, those of image counts by 1e-6, averages of counts by 1e-9; a macro score without
    images is null."""
    pos, some = F.col("n_gt") > 0, F.col("n_dt") > 0
    add = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0))
    c = per.groupBy("threshold").agg(
        *[F.sum(x).alias(x) for x in ("tp", "fp", "fn")], add("fp", pos).alias("positive_micro_fp"),
        F.count_if(pos & some).alias("il_tp"), F.count_if(~pos & some).alias("il_fp"), F.count_if(~pos & ~some).alias("il_tn"), F.count_if(pos & ~some).alias("il_fn"),
        F.count_if(pos & F.col("perfect")).alias("perfect_pos"), F.count_if(~pos & F.col("perfect")).alias("perfect_neg"), add("f1", pos & some).cast("double").alias("f1_sum"),
        *[F.sum(x).alias(f"{x}_sum") for x in ("j", "f", "jf")],
    )
    smooth = lambda a, b, e: F.col(a) / (F.col(a) + F.col(b) + e)
    harmonic = lambda p, r, e: 2 * F.col(p) * F.col(r) / (F.col(p) + F.col(r) + e)
    c = c.withColumns({
        "precision": smooth("tp", "fp", BOX_EPS), "recall": smooth("tp", "fn", BOX_EPS), "positive_micro_precision": smooth("tp", "positive_micro_fp", BOX_EPS),
        "il_precision": smooth("il_tp", "il_fp", IMAGE_EPS), "il_recall": smooth("il_tp", "il_fn", IMAGE_EPS), "il_fpr": smooth("il_fp", "il_tn", IMAGE_EPS),
        "positive_macro_f1": F.try_divide("f1_sum", F.col("il_tp")), "positive_w0dt_macro_f1": F.try_divide("f1_sum", F.col("il_tp") + F.col("il_fn")),
        "il_perfect_pos": F.col("perfect_pos") / (F.col("il_tp") + F.col("il_fn") + TINY), "il_perfect_neg": F.col("perfect_neg") / (F.col("il_fp") + F.col("il_tn") + TINY),
        **{x: F.coalesce(f"{x}_sum", F.lit(0.0)) / (F.col("il_tp") + TINY) for x in ("j", "f", "jf")},
    })
    product = lambda *cs: F.sqrt(cs[0].cast("double") * cs[1] * cs[2] * cs[3])
    tp, fp, tn, fn = (F.col(x) for x in ("il_tp", "il_fp", "il_tn", "il_fn"))
    mcc = (tp.cast("double") * tn - fp.cast("double") * fn) / (product(tp + fp, tp + fn, tn + fp, tn + fn) + IMAGE_EPS)
    c = c.withColumns({"f1": harmonic("precision", "recall", BOX_EPS), "positive_micro_f1": harmonic("positive_micro_precision", "recall", BOX_EPS), "il_f1": harmonic("il_precision", "il_recall", IMAGE_EPS), "il_mcc": mcc})
    c = c.withColumns({"cgf1": F.col("positive_macro_f1") * F.col("il_mcc"), "cgf1_w0dt": F.col("positive_w0dt_macro_f1") * F.col("il_mcc"), "cgf1_micro": F.col("positive_micro_f1") * F.col("il_mcc")})
    return c.drop("f1_sum", "j_sum", "f_sum", "jf_sum", "perfect_pos", "perfect_neg")


def cgf1_extended(gold: DataFrame, found: DataFrame, images: DataFrame, radius: Column, threshold: float = 0.5) -> DataFrame:
    """All scores of masks, one row an IoU threshold (see ``combined_scores``).

    ``gold`` is runs (image_id, g, height, width, run_start, run_end), ``found`` the like with ``d`` and ``score``, of
    which masks below ``threshold`` are left out; ``images`` lists every image. Cases: an empty mask has no runs and
    isn't a mask; an empty table on one side leaves every image without masks there; rows with a null key take no part.
    """
    a = written(column_runs(gold, ["image_id", "g"]))
    b = written(column_runs(found.where(F.col("score") >= threshold), ["image_id", "d"]))
    matches = written(matched_masks(a, b))
    return combined_scores(image_scores(images, a, b, boundary_f(matches, a, b, radius)))
