"""Comparisons of tracks inside tasks, against pairs as rows and plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrowlake.functions import boxes as fb
from arrowlake.operators import frame_pairs as fp
from arrowlake.operators import spatial, teta, tracks, video
from arrowlake.operators.assignment import solve, solve_matrix, solved


def frames(spark, seed, n=9, span=6, ids=0, score=False):
    rng = random.Random(seed)
    rows = [(v, ids + t, t % 2 + 1, f, *(float(rng.randint(0, 30)) for _ in "xy"), *(float(rng.randint(5, 25)) for _ in "wh"), (t * 7 % 10) / 10) for v in range(2) for t in range(n) for f in range(span) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "video_id long, track_id long, category_id long, frame long, x double, y double, w double, h double, score double")
    return df if score else df.drop("score")


def test_tables_are_solved_as_lists_of_pairs():
    rng = np.random.default_rng(3)
    for n, m, kinds in ((1, 1, 5), (4, 9, 3), (12, 7, 4), (30, 30, 1000), (40, 25, 6)):
        table = rng.integers(0, kinds, (n, m)) / kinds * (rng.random((n, m)) < 0.7)
        i, j = np.nonzero(table)
        listed = solve(i.tolist(), j.tolist(), table[i, j].tolist())
        p, q = solve_matrix(table)
        assert len(set(p)) == len(p) and len(set(q)) == len(q) and (table[p, q] > 0).all()
        assert abs(table[p, q].sum() - table[i[listed], j[listed]].sum()) < 1e-9
    table = rng.random((30, 30))
    i, j = np.nonzero(table)
    assert abs(table[i, j][solved(i, j, table[i, j])].sum() - table[solve_matrix(table)].sum()) < 1e-9


@pytest.mark.parametrize("block", [2, 1000])
def test_sums_of_blocks_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(fp, "BLOCK", block)
    a, b = tracks.cornered(frames(spark, 1)), tracks.cornered(frames(spark, 2, ids=100))
    a = a.unionByName(a.where("track_id = 3"))  # several boxes of a track in a frame
    met = spatial.pair_overlap(a, b, ["video_id", "frame"], [], touching=False)
    sums = met.groupBy("video_id", "a.track_id", "b.track_id").agg(F.sum(fb.intersection()), F.sum(fb.area("a.") + fb.area("b.")))
    assert sorted(map(tuple, fp.track_sums(a, b, ["video_id"]).collect())) == sorted(map(tuple, sums.collect()))


def test_no_pair_of_boxes_is_a_row(spark, monkeypatch):
    def never(*_, **__):
        raise AssertionError("pairs of boxes as rows")

    for module in (tracks, teta, video):
        for name in ("pair_overlap", "assign_one_to_one"):
            monkeypatch.setattr(module, name, never, raising=False)
    g, p = frames(spark, 4), frames(spark, 5, ids=100, score=True)
    assert tracks.hota(g, p).count() == 2 * 19
    assert teta.teta_counts(g, p, exhaustive=True).count() == 2 * 2 * 20
    assert video.open_world_filter(g, p, p.select("video_id", "category_id"), p.where("false").select("video_id", "category_id")).count() == p.count()


def test_only_tracks_that_count_are_compared(spark, monkeypatch):
    seen, compare = [], video.tracklet_iou
    monkeypatch.setattr(video, "tracklet_iou", lambda gt, dt, *a: (seen.append(dt.select("video_id", "track_id").distinct().count()), compare(gt, dt, *a))[1])
    video.video_ap(frames(spark, 4), frames(spark, 5, ids=100, score=True), max_dets=2)
    assert seen == [2 * 2 * 2]


def test_occlusion_from_boxes_is_that_from_pairs(spark, monkeypatch):
    monkeypatch.setattr(fp, "BLOCK", 3)
    g = tracks.cornered(frames(spark, 6)).withColumn("empty", (F.col("track_id") + F.col("frame")) % 5 == 0)
    near = spatial.pair_overlap(g, g, ["video_id", "frame"], ["iou"]).where("a.track_id < b.track_id AND iou >= 0.2")
    rows = video.suppress_recently_occluded(g.select("video_id", "frame", "track_id", "empty"), near.select("video_id", "frame", F.col("a.track_id").alias("one"), F.col("b.track_id").alias("two")))
    found = video.suppress_occluded_boxes(g, 0.2)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.collect()))
    assert found.where("suppressed").count()


def test_association_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(fp, "BLOCK", 2)
    t, d = tracks.cornered(frames(spark, 7)), tracks.cornered(frames(spark, 8, ids=50, score=True)).withColumnRenamed("track_id", "det_id")
    pairs = spatial.pair_overlap(t, d, ["video_id", "frame"], ["iou"]).where("iou >= 0.5").select("video_id", "frame", "a.track_id", "b.det_id")
    assert not hasattr(tracks, "pair_overlap")
    found = tracks.associate(t, d, ["video_id", "frame"])
    assert sorted(map(tuple, found.where("what = 'matched'").drop("what").collect())) == sorted(map(tuple, pairs.collect()))


def test_drawings_of_few_boxes_need_no_cells(spark, monkeypatch):
    rng = random.Random(11)
    at = lambda: (float(rng.randint(0, 60)), float(rng.randint(0, 60)))
    points = spark.createDataFrame([(i, p, *at()) for i in range(4) for p in range(12)], "image_id long, p long, x double, y double")
    nodes = spark.createDataFrame([(i, n, f"n{n}", x, y, x + 4, y + 3) for i in range(3) for n in range(60 if i == 1 else 5) for x, y in [at()]], "image_id long, n long, text string, x1 double, y1 double, x2 double, y2 double")
    nearest = lambda: sorted((r.image_id, r.p, *r.best) for r in spatial.nearest_boxes(points, nodes, ["image_id"], "p", "n", 7.0).collect())
    mixed = nearest()
    monkeypatch.setattr(spatial, "FEW_BOXES", 0)
    assert mixed == nearest() and len(mixed) == 36
    monkeypatch.setattr(spatial, "FEW_BOXES", 60)
    monkeypatch.setattr(spatial, "_nearest_by_cells", None)
    assert mixed == nearest()


def test_suppression_within_frames_is_that_of_pairs(spark, monkeypatch):
    d = tracks.cornered(frames(spark, 12, n=25, score=True)).drop("x", "y", "w", "h")
    by_pairs = sorted(map(tuple, spatial.nms(d, ["video_id", "frame"], "track_id", 0.3).select(*d.columns).collect()))
    monkeypatch.setattr(spatial, "pair_overlap", None)
    kept = spatial.nms_frames(d, 0.3)
    assert sorted(map(tuple, kept.collect())) == by_pairs and kept.count() < d.count()
