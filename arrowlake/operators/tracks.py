"""Track tables and tracking metrics. Frames come as rows (video_id, track_id, frame, x, y, w, h)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import boxes
from .datasets import dense_ids
from .frame_pairs import aligned_matches, association, track_sums


def cornered(frames: DataFrame) -> DataFrame:
    return frames.withColumns(boxes.from_xywh(*[F.col(c) for c in "xywh"]))


def frames_to_tracks(frames: DataFrame, key: list[str]) -> DataFrame:
    """Per track its boxes and areas over all frames of its video, with zeros where it is absent; area is the mean incl. zeros."""
    span = frames.groupBy("video_id").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    grid = frames.select("video_id", *key).distinct().join(span, "video_id").select("video_id", *key, F.explode(F.sequence("lo", "hi")).alias("frame"))
    rows = grid.join(frames.select("video_id", *key, "frame", "x", "y", "w", "h"), ["video_id", *key, "frame"], "left")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in "xywh"}
    ordered = F.sort_array(F.collect_list(F.struct("frame", "x", "y", "w", "h")))
    out = rows.withColumns(zero).groupBy("video_id", *key).agg(ordered.alias("boxes"), F.avg(F.col("w") * F.col("h")).alias("area"))
    return out


def tracks_to_frames(tracks: DataFrame, key: list[str]) -> DataFrame:
    """One row per visible frame of each track."""
    return tracks.select("video_id", *key, F.explode("boxes").alias("b")).select("video_id", *key, "b.*").where("w * h > 0")


def clean_track_preds(preds: DataFrame, threshold: float) -> DataFrame:
    """Frames of tracks that score above the threshold, empty boxes dropped, scores set to 1."""
    return preds.where((F.col("score") > threshold) & (F.col("w") > 0) & (F.col("h") > 0)).withColumn("score", F.lit(1.0))


def track_area(frames: DataFrame) -> DataFrame:
    """Mean of a track's non-zero areas."""
    a = F.col("w") * F.col("h")
    return frames.groupBy("video_id", "track_id").agg(F.coalesce(F.avg(F.when(a > 0, a)), F.lit(0.0)).alias("area"))


def remap_video_category(gt: DataFrame, dt: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(video_id, category_id, new_id) for each pair seen in either table, in sorted order from 1.

    ``pairs`` (video_id, category_id, pair_no) are further ones, negative ones among them: those not seen follow after
    the others, in the order of their first ``pair_no``.
    """
    key = ["video_id", "category_id"]
    seen = gt.select(*key).union(dt.select(*key)).distinct()
    out = dense_ids(seen, key, "new_id").select(*key, "new_id")
    if pairs is None:
        return out
    rest = pairs.groupBy(*key).agg(F.min("pair_no").alias("pair_no")).join(seen, key, "left_anti")
    last = out.agg(F.coalesce(F.max("new_id"), F.lit(0)).alias("last"))
    later = dense_ids(rest, ["pair_no", *key], "n").join(last)  # one row of ``last``
    return out.unionByName(later.select(*key, (F.col("n") + F.col("last")).cast("long").alias("new_id")))


def associate(tracks: DataFrame, dets: DataFrame, on: list[str], iou: float = 0.5, track_iou: float = 0.5, new_score: float = 0.3, one_to_one: bool = False, sure: float = 0.8) -> DataFrame:
    """(on, what, track_id, det_id): how a frame's detections (det_id, score, corners) meet its tracks (track_id, corners).

    ``matched``: pairs that overlap by ``iou``. ``new``: detections of ``new_score`` without such a track; in a frame without
    tracks every detection. ``unmatched``: tracks of some area that no detection overlaps by ``track_iou``, or, with
    ``one_to_one``, whose detection in the assignment of highest total overlap does not; none in a frame without
    tracks. ``empty``: tracks without area. ``sure``: for a track its detection of score and overlap ``sure``, among those whose
    best track it is (the least id on ties); of several the last id.
    """
    return association(tracks, dets, on, iou, track_iou, new_score, one_to_one, sure)


def unique_track_ids(frames: DataFrame) -> DataFrame:
    """``frames`` with ``unique_id``: the track id, or a new one above all where the id occurs in several videos."""
    tracks = frames.select("video_id", "track_id").distinct()
    shared = tracks.groupBy("track_id").agg(F.count("*").alias("c")).where("c > 1")
    most = tracks.agg(F.max("track_id").alias("top"))
    again = dense_ids(tracks.join(shared, "track_id").select("track_id", "video_id"), ["track_id", "video_id"], "n")
    numbered = again.join(most).select("video_id", "track_id", (F.col("top") + F.col("n")).alias("unique_id"))  # one row of ``most``
    return frames.join(numbered, ["video_id", "track_id"], "left").withColumn("unique_id", F.coalesce("unique_id", "track_id"))


def fill_video_ids(anns: DataFrame, images: DataFrame) -> DataFrame:
    """Missing video ids taken from the image."""
    known = images.select("image_id", F.col("video_id").alias("known"))
    return anns.join(known, "image_id", "left").withColumn("video_id", F.coalesce("video_id", "known")).drop("known")


def merge_categories(anns: DataFrame, merged: DataFrame) -> DataFrame:
    """Category ids replaced by their merge parent; ``merged`` is (parent, children array)."""
    to = merged.select(F.explode("children").alias("category_id"), "parent")
    return anns.join(to, "category_id", "left").withColumn("category_id", F.coalesce("parent", "category_id")).drop("parent")


def contiguous_ids(frames: DataFrame) -> DataFrame:
    """Per sequence and class, track ids from 0 in id order."""
    return frames.withColumn("new_id", F.dense_rank().over(Window.partitionBy("video_id", "category_id").orderBy("track_id")) - 1)


def check_unique_ids(frames: DataFrame) -> DataFrame:
    """Audit: ids that occur more than once in a frame."""
    return frames.groupBy("video_id", "frame", "track_id").agg(F.count("*").alias("n")).where("n > 1")


def subset_by_category(frames: DataFrame, ids: DataFrame, keep: bool = True) -> DataFrame:
    return frames.join(ids.select("category_id").distinct(), "category_id", "left_semi" if keep else "left_anti")


def track_counts(gt: DataFrame, dt: DataFrame) -> DataFrame:
    """Detections, gold detections, ids, gold ids and frames of each sequence."""
    rows = gt.select("video_id", "track_id", "frame", F.lit("gt").alias("side")).unionByName(dt.select("video_id", "track_id", "frame", F.lit("dt").alias("side")))
    of = lambda s, c: F.when(F.col("side") == s, F.col(c))
    return rows.groupBy("video_id").agg(
        F.count(of("dt", "track_id")).alias("dets"), F.count(of("gt", "track_id")).alias("gt_dets"), F.count_distinct(of("dt", "track_id")).alias("ids"),
        F.count_distinct(of("gt", "track_id")).alias("gt_ids"), F.count_distinct("frame").alias("frames"),
    )


def tracklet_iou(gt: DataFrame, dt: DataFrame, on: tuple[str, ...] = ("video_id",), least: float | None = None) -> DataFrame:
    """(on, gt_id, dt_id, iou) of tracks that meet: summed intersections over summed unions of all their frames.

    With ``least`` > 0 only pairs of that IoU or more; the frames that two tracks share tell most others apart."""
    on = list(on)
    met = track_sums(cornered(gt), cornered(dt), on, least)
    area = lambda df, name, size: df.groupBy(*on, F.col("track_id").alias(name)).agg(F.sum(F.col("w") * F.col("h")).alias(size))
    out = met.join(area(gt, "gt_id", "ga"), [*on, "gt_id"]).join(area(dt, "dt_id", "da"), [*on, "dt_id"])
    out = out.select(*on, "gt_id", "dt_id", F.coalesce(F.try_divide("inter", F.col("ga") + F.col("da") - F.col("inter")), F.lit(0.0)).alias("iou"))
    return out if least is None else out.where(F.col("iou") >= least)


ALPHAS = [i / 20 for i in range(1, 20)]


def hota(gt: DataFrame, dt: DataFrame) -> DataFrame:
    """(video_id, alpha) with TP, FN, FP, LocA, DetA/Re/Pr, AssA/Re/Pr, HOTA and OWTA.

    Similarities are normalised per frame by their row and column sums and summed into global alignments of id pairs;
    frames are then matched optimally on alignment times similarity, and counted at each alpha. A task holds one video: its
    boxes, and an array of its pairs of tracks.
    """
    sized = lambda df, name: cornered(df).withColumn(f"{name}_n", F.count("*").over(Window.partitionBy("video_id", "track_id"))).withColumnRenamed("track_id", name)
    matched = aligned_matches(sized(gt, "g"), sized(dt, "t"), ["video_id"])
    hits = matched.select("*", F.explode(F.array(*[F.lit(x) for x in ALPHAS])).alias("alpha")).where(F.col("sim") >= F.col("alpha") - 2.220446049250313e-16)
    ids = hits.groupBy("video_id", "alpha", "g", "t").agg(F.count("*").alias("m"), F.sum("sim").alias("loc"), F.first("g_n").alias("g_n"), F.first("t_n").alias("t_n"))
    m = F.col("m")
    sums = ids.groupBy("video_id", "alpha").agg(
        F.sum("m").alias("tp"), F.sum("loc").alias("loc"), F.sum(m * m / F.greatest(F.lit(1), F.col("g_n") + F.col("t_n") - m)).alias("a"), F.sum(m * m / F.greatest(F.lit(1), F.col("g_n"))).alias("ar"), F.sum(m * m / F.greatest(F.lit(1), F.col("t_n"))).alias("ap")
    )
    totals = track_counts(gt, dt).select("video_id", "gt_dets", "dets", F.explode(F.array(*[F.lit(x) for x in ALPHAS])).alias("alpha"))
    out = totals.join(sums, ["video_id", "alpha"], "left").fillna(0, ["tp"]).fillna(0.0, ["loc", "a", "ar", "ap"])
    one = lambda c: F.greatest(F.lit(1), c)
    tp, fn, fp = F.col("tp"), F.col("gt_dets") - F.col("tp"), F.col("dets") - F.col("tp")
    out = out.select(
        "video_id", "alpha", "tp", fn.alias("fn"), fp.alias("fp"), F.when(tp > 0, F.col("loc") / tp).otherwise(1.0).alias("loc_a"), (tp / one(tp + fn + fp)).alias("det_a"), (tp / one(tp + fn)).alias("det_re"), (tp / one(tp + fp)).alias("det_pr"),
        (F.col("a") / one(tp)).alias("ass_a"), (F.col("ar") / one(tp)).alias("ass_re"), (F.col("ap") / one(tp)).alias("ass_pr"),
    )
    return out.withColumns({"hota": F.sqrt(F.col("det_a") * F.col("ass_a")), "owta": F.sqrt(F.col("det_re") * F.col("ass_a"))})


def combine_sequences(per: DataFrame) -> DataFrame:
    """HOTA over all sequences: counts summed, association and localisation weighted by TP, the rest made anew."""
    tp = F.col("tp")
    weighted = lambda c: (F.sum(F.col(c) * tp) / F.greatest(F.lit(1.0), F.sum(tp).cast("double"))).alias(c)
    out = per.groupBy("alpha").agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp")], *[weighted(c) for c in ("ass_a", "ass_re", "ass_pr", "loc_a")])
    det = tp / F.greatest(F.lit(1), tp + F.col("fn") + F.col("fp"))
    return out.withColumn("det_a", det).withColumn("hota", F.sqrt(F.col("det_a") * F.col("ass_a")))


def confirmed_tracks(matches: DataFrame, n: int = 3) -> DataFrame:
    """(video_id, track_id, confirmed_at): the first frame at which a track has been matched in ``n`` frames on end."""
    w = Window.partitionBy("video_id", "track_id").orderBy("frame")
    rows = matches.withColumn("misses", F.sum((~F.col("matched")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.row_number().over(Window.partitionBy("video_id", "track_id", "misses").orderBy("frame")) - F.when(F.col("misses") > 0, 1).otherwise(0)
    return rows.withColumn("run", run).where(F.col("matched") & (F.col("run") >= n)).groupBy("video_id", "track_id").agg(F.min("frame").alias("confirmed_at"))


def hotstart_unmatched(matches: DataFrame, delay: int, misses: int = 3) -> DataFrame:
    """Tracks removed while still new: unmatched in ``misses`` frames or more within ``delay`` frames of their first."""
    first = F.min("frame").over(Window.partitionBy("video_id", "track_id"))
    young = matches.withColumn("first", first).where(F.col("frame") < F.col("first") + delay)
    return young.groupBy("video_id", "track_id").agg(F.count_if(~F.col("matched")).alias("n")).where(F.col("n") >= misses)


def resume(todo: DataFrame, done: DataFrame, keys: list[str], answer: str) -> DataFrame:
    """Keys without a non-empty answer yet."""
    finished = done.where(F.trim(F.coalesce(answer, F.lit(""))) != "").select(*keys).distinct()
    return todo.join(finished, keys, "left_anti")
