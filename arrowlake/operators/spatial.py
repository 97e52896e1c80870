"""Spatial operators: overlaps, assignments, suppression and run-length masks. Every join has an equality key."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import boxes
from ..plans.components import connected_components
from ..plans.materialize import written
from .frame_pairs import ious, over_frames, track_sums
from .greedy import suppress


def pair_overlap(a: DataFrame, b: DataFrame, on: list[str], kinds: list[str], touching: bool = True, cell: float | None = None) -> DataFrame:
    """Overlap measures of all pairs that share ``on``; columns of the sides come as structs ``a`` and ``b``.

    ``touching`` keeps only pairs that overlap. With ``cell`` the boxes of a key are spread over grid cells of that
    size, so that one key with very many boxes is compared cell by cell; each pair is taken in the one cell that holds
    the upper left corner of its intersection.
    """
    keys = [F.col(k) for k in on]
    left, right = a.select(*keys, F.struct("*").alias("a")), b.select(*keys, F.struct("*").alias("b"))
    if cell is not None:

        def spread(df: DataFrame, side: str) -> DataFrame:
            span = lambda lo, hi: F.sequence(F.floor(F.col(f"{side}.{lo}") / cell), F.floor(F.col(f"{side}.{hi}") / cell))
            return df.withColumn("cx", F.explode(span("x1", "x2"))).withColumn("cy", F.explode(span("y1", "y2")))

        pairs = spread(left, "a").join(spread(right, "b"), [*on, "cx", "cy"])
        at = lambda c: F.floor(F.greatest(f"a.{c}", f"b.{c}") / cell)
        pairs = pairs.where((F.col("cx") == at("x1")) & (F.col("cy") == at("y1"))).drop("cx", "cy")
    else:
        pairs = left.join(right, on)
    if touching:
        pairs = pairs.where("a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2")
    return pairs.withColumns({k: boxes.overlap(k) for k in kinds})


def point_similarity(a: DataFrame, b: DataFrame, on: list[str], zero_distance: float = 2.0) -> DataFrame:
    """max(0, 1 - distance / zero_distance) of all points (x, y) that share ``on``."""
    keys = [F.col(k) for k in on]
    pairs = a.select(*keys, F.struct("*").alias("a")).join(b.select(*keys, F.struct("*").alias("b")), on)
    d = F.sqrt(F.pow(F.col("a.x") - F.col("b.x"), 2) + F.pow(F.col("a.y") - F.col("b.y"), 2))
    return pairs.withColumn("similarity", F.greatest(F.lit(0.0), 1 - d / zero_distance))


def merge_near_arrows(arrows: DataFrame, iou: float = 0.6, fields: tuple[str, ...] = ("src", "rel", "dst")) -> DataFrame:
    """Arrows of an image joined where boxes overlap by ``iou`` and answers differ: the union box, fields joined in order."""
    answer = F.struct(*fields)
    items = arrows.withColumn("answer", answer)
    pairs = pair_overlap(items, items, ["image_id"], ["iou"]).where((F.col("a.box_id") < F.col("b.box_id")) & (F.col("iou") >= iou) & (F.col("a.answer") != F.col("b.answer")))
    ends = pairs.select(F.struct("image_id", F.col("a.box_id").alias("box_id")).alias("u"), F.struct("image_id", F.col("b.box_id").alias("box_id")).alias("v"))
    parts = connected_components(ends).select("node.image_id", "node.box_id", F.col("component.box_id").alias("first_id"))
    whole = arrows.join(parts, ["image_id", "box_id"], "left").withColumn("first_id", F.coalesce("first_id", "box_id"))
    ordered = F.sort_array(F.collect_list(F.struct("box_id", *fields)))
    merged = whole.groupBy("image_id", F.col("first_id")).agg(
        F.count("*").alias("members"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), ordered.alias("all")
    )
    joined = [F.array_join(F.col(f"all.{f}"), " || ").alias(f) for f in fields]
    return merged.select("image_id", F.col("first_id").alias("box_id"), "members", "x1", "y1", "x2", "y2", *joined)


def _centre(side: str) -> tuple[Column, Column]:
    x1, y1, x2, y2 = boxes.corners(side)
    return (x1 + x2) / 2, (y1 + y2) / 2


def assign_heads(heads: DataFrame, arrows: DataFrame, on: list[str], head: str, arrow: str) -> DataFrame:
    """Each head's arrow: of those whose box holds the head's centre, the one of highest IoU above 0; else null."""
    found = pair_overlap(heads, arrows, on, ["iou"]).where(boxes.contains("b.", *_centre("a.")))
    w = Window.partitionBy(*on, "head").orderBy(F.desc("iou"), "arrow")
    best = found.select(*on, F.col(f"a.{head}").alias("head"), F.col(f"b.{arrow}").alias("arrow"), "iou").withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    return heads.select(*on, F.col(head).alias("head")).join(best, [*on, "head"], "left")


def assign_heads_first(arrows: DataFrame, heads: DataFrame, on: list[str], head: str, arrow: str) -> DataFrame:
    """Per arrow the first head whose centre its box holds; arrows without one are dropped."""
    held = pair_overlap(heads, arrows, on, [], touching=False).where(boxes.contains("b.", *_centre("a.")))
    return held.groupBy(*on, F.col(f"b.{arrow}").alias("arrow")).agg(F.min(f"a.{head}").alias("head"))


def attach_conditions(texts: DataFrame, arrows: DataFrame, on: list[str], text: str, arrow: str, margin: float = 20) -> DataFrame:
    """Each text goes to the arrow, widened by ``margin``, of best IoU above 0; each arrow keeps its best text."""
    wide = arrows.withColumns(boxes.expanded(margin))
    found = pair_overlap(texts, wide, on, ["iou"]).where("iou > 0").select(*on, F.col(f"a.{text}").alias("text"), F.col(f"b.{arrow}").alias("arrow"), "iou")
    for key, other in (("text", "arrow"), ("arrow", "text")):
        w = Window.partitionBy(*on, key).orderBy(F.desc("iou"), other)
        found = found.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    return found


def classify_text(texts: DataFrame, nodes: DataFrame, on: list[str], text: str) -> DataFrame:
    """Texts with ``is_node``: whether some node's box holds the whole of theirs."""
    inside = pair_overlap(texts, nodes, on, [], touching=False).where("a.x1 >= b.x1 AND a.y1 >= b.y1 AND a.x2 <= b.x2 AND a.y2 <= b.y2")
    held = inside.select(*on, F.col(f"a.{text}").alias(text)).distinct().withColumn("is_node", F.lit(True))
    return texts.select(*on, text).join(held, [*on, text], "left").withColumn("is_node", F.coalesce("is_node", F.lit(False)))


#: Boxes of a drawing that are all compared with each of its points.
FEW_BOXES = 50


def nearest_boxes(points: DataFrame, nodes: DataFrame, on: list[str], point: str, node: str, cell: float) -> DataFrame:
    """(on, point, best) with ``best`` (d, node, text) of the nearest box to each point (x, y), ties to the least node.

    In a drawing of at most ``FEW_BOXES`` boxes all are compared: a point's cells would be as many rows. In others a grid of ``cell`` is searched first, in the nine cells about a point; what lies no farther than a cell is found for
    certain. Points without such a box go on to a grid of twice the size, until a cell spans everything. So a point meets
    the boxes of its surroundings only, however many its drawing has, and each round leaves the lonelier points.
    A box lies in every cell that it covers. Points of a drawing without boxes get no row.
    """
    asked = points.select(*on, F.col(point).alias("point"), "x", "y").where("x IS NOT NULL AND y IS NOT NULL")
    held = nodes.select(*on, F.col(node).alias("node"), "text", *boxes.CORNERS).where(" AND ".join(f"{c} IS NOT NULL" for c in boxes.CORNERS))
    many = written(held.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > FEW_BOXES).select(*on))
    if many.isEmpty():
        return _nearest_of_all(asked, held, on).withColumnRenamed("point", point)
    few = _nearest_of_all(asked.join(many, on, "left_anti"), held.join(many, on, "left_anti"), on)
    asked, held = written(asked.join(many, on, "left_semi")), written(held.join(many, on, "left_semi"))
    return few.unionByName(_nearest_by_cells(asked, held, on, cell)).withColumnRenamed("point", point)


def _nearest_of_all(asked: DataFrame, held: DataFrame, on: list[str]) -> DataFrame:
    """Each point beside all boxes of its drawing."""
    best = F.min(F.struct(boxes.distance_to("", F.col("x"), F.col("y")).alias("d"), "node", "text")).alias("best")
    return asked.join(held, on).groupBy(*on, "point").agg(best)


def _nearest_by_cells(asked: DataFrame, held: DataFrame, on: list[str], cell: float) -> DataFrame:
    corners = boxes.corners()
    ends = asked.select("x", "y").union(held.select("x1", "y1")).union(held.select("x2", "y2"))
    span = ends.agg((F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))).alias("s")).first()[0] or 0.0
    left, found, size = asked, None, cell
    while True:
        at = lambda c, by=size: F.floor(c / by)
        about = lambda c: F.explode(F.array(*[at(F.col(c)) + i for i in (-1, 0, 1)]))
        near = left.withColumn("cx", about("x")).withColumn("cy", about("y"))
        spread = held.withColumn("cx", F.explode(F.sequence(at(corners[0]), at(corners[2])))).withColumn("cy", F.explode(F.sequence(at(corners[1]), at(corners[3]))))
        pairs = near.join(spread, [*on, "cx", "cy"])
        best = F.min(F.struct(boxes.distance_to("", F.col("x"), F.col("y")).alias("d"), "node", "text")).alias("best")
        best = pairs.groupBy(*on, "point", "x", "y").agg(best)
        done = size > span
        sure = written(best if done else best.where(F.col("best.d") <= size))
        found = sure.select(*on, "point", "best") if found is None else found.unionByName(sure.select(*on, "point", "best"))
        if done:
            return found
        left = written(left.join(sure.select(*on, "point"), [*on, "point"], "left_anti"))
        if left.isEmpty():
            return found
        size *= 2


def nearest_node(arrows: DataFrame, nodes: DataFrame, on: list[str], arrow: str, node: str, cell: float | None = None) -> DataFrame:
    """Source and target node of each arrow: nearest to its tail - the box corner farthest from the head's centre (hx, hy) - and to the head.

    Arrows whose two ends carry the same text are dropped. With ``cell`` nodes are searched by ``nearest_boxes``, for
    drawings with very many of them.
    """
    x1, y1, x2, y2 = boxes.corners()
    spots = F.array(*[F.struct((F.pow(x - F.col("hx"), 2) + F.pow(y - F.col("hy"), 2)).alias("d"), F.lit(-i).alias("no"), x.alias("x"), y.alias("y")) for i, (x, y) in enumerate([(x1, y1), (x2, y1), (x1, y2), (x2, y2)])])
    tails = arrows.withColumn("tail", F.array_max(spots))
    if cell is None:
        pairs = tails.select(*on, F.struct("*").alias("a")).join(nodes.select(*on, F.struct("*").alias("b")), on)
        near = lambda x, y: F.min(F.struct(boxes.distance_to("b.", F.col(x), F.col(y)).alias("d"), F.col(f"b.{node}").alias("node"), F.col("b.text").alias("text")))
        out = pairs.groupBy(*on, F.col(f"a.{arrow}").alias("arrow")).agg(near("a.tail.x", "a.tail.y").alias("s"), near("a.hx", "a.hy").alias("t"))
    else:
        ends = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.col(x).alias("x"), F.col(y).alias("y")) for side, x, y in (("s", "tail.x", "tail.y"), ("t", "hx", "hy"))])).alias("e")
        points = tails.select(*on, F.col(arrow).alias("arrow"), ends).select(*on, F.struct("arrow", "e.side").alias("end"), "e.x", "e.y")
        best = nearest_boxes(points, nodes, on, "end", node, cell)
        of = lambda side: F.max(F.when(F.col("end.side") == side, F.col("best"))).alias(side)
        out = best.groupBy(*on, F.col("end.arrow").alias("arrow")).agg(of("s"), of("t"))
    return out.where("s.text <> t.text").select(*on, "arrow", F.col("s.node").alias("source"), F.col("t.node").alias("target"))


def point_edge_distance(points: DataFrame, items: DataFrame, on: list[str]) -> DataFrame:
    """(on, a, b, l, t, r, b_): signed distances of each point (x, y; struct ``b``) to the left, top, right and lower edge of
    each box (struct ``a``) that shares ``on``; all are positive inside."""
    pairs = items.select(*on, F.struct("*").alias("a")).join(points.select(*on, F.struct("*").alias("b")), on)
    x1, y1, x2, y2 = boxes.corners("a.")
    x, y = F.col("b.x"), F.col("b.y")
    return pairs.select(*on, "a", "b", (x - x1).alias("l"), (y - y1).alias("t"), (x2 - x).alias("r"), (y2 - y).alias("b_"))


def orient_by_points(arrows: DataFrame) -> DataFrame:
    """``a_is_source`` for arrows with node centres (ax, ay), (bx, by), head (hx, hy) and maybe a starting point (fx, fy)."""
    d = lambda p, q: F.pow(F.col(f"{p}x") - F.col(f"{q}x"), 2) + F.pow(F.col(f"{p}y") - F.col(f"{q}y"), 2)
    return arrows.withColumn("a_is_source", F.when(F.col("fx").isNotNull(), d("a", "f") < d("b", "f")).otherwise(~(d("a", "h") < d("b", "h"))))


def clip_and_drop(items: DataFrame, width: str, height: str) -> DataFrame:
    """Boxes clipped to their image; those left empty are dropped."""
    clip = lambda c, most: F.greatest(F.lit(0.0), F.least(F.col(c), F.col(most)))
    out = items.withColumns({"x1": clip("x1", width), "y1": clip("y1", height), "x2": clip("x2", width), "y2": clip("y2", height)})
    return out.where("x2 > x1 AND y2 > y1")


def median_area_filter(dets: DataFrame, on: list[str], ratio: float) -> DataFrame:
    """Drops boxes smaller than ``ratio`` of their image's upper median area, where it has three or more."""
    if ratio <= 0:
        return dets
    sized = dets.withColumn("area", boxes.area())
    areas = F.sort_array(F.collect_list("area"))
    medians = sized.groupBy(*on).agg(areas.alias("all")).select(*on, F.when(F.size("all") >= 3, F.get("all", (F.size("all") / 2).cast("int"))).alias("median"))
    return sized.join(medians, on).where("median IS NULL OR area >= " + repr(ratio) + " * median").drop("median", "area")


def nms(dets: DataFrame, on: list[str], det: str, threshold: float, kind: str = "iou", strict: bool = False, min_score: float | None = None) -> DataFrame:
    """Greedy suppression by score, ties to the smaller id: a box goes if its overlap with a kept one is at least
    (``strict``: above) the threshold. Empty boxes are skipped."""
    items = dets.where("x2 > x1 AND y2 > y1")
    if min_score is not None:
        items = items.where(F.col("score") > min_score)
    items = items.withColumn("rank", F.row_number().over(Window.partitionBy(*on).orderBy(F.desc("score"), det)))
    over = F.col("overlap") > threshold if strict else F.col("overlap") >= threshold
    pairs = pair_overlap(items, items, on, [kind]).withColumnRenamed(kind, "overlap").where((F.col("b.rank") < F.col("a.rank")) & over)
    conflicts = pairs.select(*on, F.col(f"a.{det}").alias(det), F.col(f"b.{det}").alias("earlier"))
    return suppress(items, conflicts, on, det, "rank").drop("rank")


def nms_frames(dets: DataFrame, threshold: float) -> DataFrame:
    """``nms`` of frames (video_id, frame, track_id, score, x1, y1, x2, y2) with very many boxes: a task takes a frame's boxes by falling
    score, each against those still left, so pairs are no rows."""

    def rule() -> Callable[[pd.DataFrame], pd.DataFrame]:
        def step(rows: pd.DataFrame) -> pd.DataFrame:
            left = np.lexsort((rows["track_id"].to_numpy(), -rows["score"].to_numpy(float)))
            corners, kept = rows[boxes.CORNERS].to_numpy(float), []
            while len(left):
                kept.append(left[0])
                left = left[1:][ious(corners[left[:1]], corners[left[1:]])[0] < threshold]
            return rows.iloc[kept]

        return step

    items = dets.where("x2 > x1 AND y2 > y1")
    return over_frames(items, rule, items.schema)


def nms_tracks(frames: DataFrame, threshold: float) -> DataFrame:
    """Tracks (video_id, track_id, score) left by suppression with the IoU of summed areas over frames both are in."""
    sums = track_sums(frames, frames, ["video_id"], threshold).where("gt_id <> dt_id").select("video_id", F.col("gt_id").alias("track_id"), F.col("dt_id").alias("other"), "inter", (F.col("both") - F.col("inter")).alias("union"))
    tracks = frames.groupBy("video_id", "track_id").agg(F.max("score").alias("score"))
    tracks = tracks.withColumn("rank", F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("score"), "track_id")))
    ranks = tracks.select("video_id", "track_id", "rank")
    near = sums.where(F.try_divide("inter", "union") >= threshold).join(ranks, ["video_id", "track_id"])
    near = near.join(ranks.toDF("video_id", "other", "other_rank"), ["video_id", "other"]).where("other_rank < rank")
    return suppress(tracks, near.select("video_id", "track_id", F.col("other").alias("earlier")), ["video_id"], "track_id", "rank").drop("rank")


def suppress_boundary(dets: DataFrame, width: float, height: float, margin: float = 0.025) -> DataFrame:
    """Detections whose centre is more than ``margin`` of the image from every edge."""
    cx, cy = _centre("")
    inside = lambda c, most: (c > margin * most) & (c < (1 - margin) * most)
    return dets.where(inside(cx, width) & inside(cy, height))


def mask_runs(masks: DataFrame, keys: list[str], counts: str) -> DataFrame:
    """(keys, run_start, run_end) of the set runs of uncompressed run-length counts, which begin with an unset run."""
    at = F.posexplode(counts).alias("p", "n")
    w = Window.partitionBy(*keys).orderBy("p")
    rows = masks.select(*keys, at).withColumn("run_end", F.sum("n").over(w))
    return rows.where("p % 2 = 1 AND n > 0").select(*keys, (F.col("run_end") - F.col("n")).cast("long").alias("run_start"), F.col("run_end").cast("long"))


def mask_overlap(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Intersection, areas and IoU of masks given as runs: an interval join within each key."""
    area = lambda df, name: df.groupBy(*on).agg(F.sum(F.col("run_end") - F.col("run_start")).alias(name))
    x, y = a.toDF(*on, "s1", "e1"), b.toDF(*on, "s2", "e2")
    met = x.join(y, on).where("s1 < e2 AND s2 < e1").groupBy(*on).agg(F.sum(F.least("e1", "e2") - F.greatest("s1", "s2")).alias("inter"))
    both = area(a, "area_a").join(area(b, "area_b"), on).join(met, on, "left").withColumn("inter", F.coalesce("inter", F.lit(0)))
    return both.withColumn("iou", F.coalesce(F.try_divide(F.col("inter").cast("double"), F.col("area_a") + F.col("area_b") - F.col("inter")), F.lit(0.0)))


def mask_union(runs: DataFrame, on: list[str]) -> DataFrame:
    """Disjoint runs of the union of a key's masks (gaps and islands)."""
    w = Window.partitionBy(*on).orderBy("run_start", "run_end")
    fresh = F.coalesce(F.col("run_start") > F.max("run_end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")
    marked = runs.withColumn("new", fresh).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*on, "island").agg(F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end")).drop("island")


def mask_to_box(runs: DataFrame, on: list[str], height: int) -> DataFrame:
    """Tight box of a mask from its runs over a column-major image of that height."""
    first, last = F.col("run_start"), F.col("run_end") - 1
    crosses = F.floor(first / height) != F.floor(last / height)
    top = F.when(crosses, 0).otherwise(first % height)
    bottom = F.when(crosses, height - 1).otherwise(last % height)
    return runs.groupBy(*on).agg(
        F.min(F.floor(first / height)).alias("x1"), F.min(top).alias("y1"), (F.max(F.floor(last / height)) + 1).alias("x2"), (F.max(bottom) + 1).alias("y2")
    )
