"""Properties and hand-computed cases of the spatial, graph, assignment and track operators."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from arrowlake.operators import graphs, spatial, tracks
from arrowlake.operators.assignment import assign_one_to_one, solve
from arrowlake.operators.datasets import k_groups_combos, split_train_val
from arrowlake.operators.detections import cgf1
from arrowlake.operators.precision import detection_ap
from arrowlake.operators.repair import snap_to_vocab
from arrowlake.plans.components import connected_components


def total(table):
    """The highest total of any one-to-one choice, by trying all."""
    k, wide = min(table.shape), table if table.shape[0] <= table.shape[1] else table.T
    return max(sum(wide[i, p[i]] for i in range(k)) for p in itertools.permutations(range(wide.shape[1]), k))


def sparse(table):
    return [list(x) for x in zip(*((i, j, table[i, j]) for i, j in zip(*np.nonzero(table))))] or [[], [], []]


def test_solver_finds_the_best_total():
    rng = np.random.default_rng(1)
    for trial in range(400):
        n, m = rng.integers(1, 6, 2)
        s = rng.integers(0, 9, (n, m)).astype(float) if trial % 2 else rng.random((n, m)) * (rng.random((n, m)) < 0.6)
        xs, ys, scores = sparse(s)
        chosen = solve(xs, ys, scores)
        assert len({xs[i] for i in chosen}) == len({ys[i] for i in chosen}) == len(chosen)
        assert abs(sum(scores[i] for i in chosen) - total(s)) < 1e-9


def test_solver_takes_a_large_sparse_group():
    rng = np.random.default_rng(2)
    n = 3000  # a dense table would have nine million cells
    xs, ys = np.repeat(np.arange(n), 4), rng.integers(0, n, 4 * n)
    key = np.unique(xs * n + ys)
    xs, ys = (key // n).tolist(), (key % n).tolist()
    scores = rng.random(len(xs)).tolist()
    chosen = solve(xs, ys, scores)
    assert len({xs[i] for i in chosen}) == len({ys[i] for i in chosen}) == len(chosen)
    greedy, free_x, free_y = 0.0, set(xs), set(ys)
    for s, x, y in sorted(zip(scores, xs, ys), reverse=True):
        if x in free_x and y in free_y:
            greedy, free_x, free_y = greedy + s, free_x - {x}, free_y - {y}
    assert sum(scores[i] for i in chosen) > greedy


def test_assignment_per_group(spark):
    rows = [(g, a, b, float((a * 7 + b * 3 + g) % 5)) for g in range(30) for a in range(3) for b in range(4)]
    out = assign_one_to_one(spark.createDataFrame(rows, "g int, a int, b int, s double"), ["g"], "a", "b", "s").toPandas()
    for g, part in out.groupby("g"):
        table = np.array([[(a * 7 + b * 3 + g) % 5 for b in range(4)] for a in range(3)], float)
        assert part.s.sum() == total(table)
        assert part.a.is_unique and part.b.is_unique


def test_nearest_boxes_on_a_grid(spark):
    rng = np.random.default_rng(3)
    nodes = [(d, i, f"n{i % 5}", *(x := [float(v) for v in rng.integers(-50, 400, 2)]), x[0] + float(rng.integers(0, 90)), x[1] + float(rng.integers(0, 9))) for d in (1, 2) for i in range(40)] + [(3, 0, "far", 9000.0, 9000.0, 9001.0, 9001.0)]
    points = [(d, i, *[float(v) for v in rng.integers(-200, 600, 2)]) for d in (1, 2, 3, 4) for i in range(60)]
    out = spatial.nearest_boxes(spark.createDataFrame(points, "image_id long, p long, x double, y double"), spark.createDataFrame(nodes, "image_id long, box_id long, text string, x1 double, y1 double, x2 double, y2 double"), ["image_id"], "p", "box_id", 7.0)
    got = {(r.image_id, r.p): (r.best.d, r.best.node) for r in out.collect()}
    for d, i, x, y in points:
        near = [(np.hypot(max(n[3] - x, x - n[5], 0), max(n[4] - y, y - n[6], 0)), n[1]) for n in nodes if n[0] == d]
        assert ((d, i) in got) == bool(near)
        if near:
            assert got[d, i][1] == min(near)[1] and abs(got[d, i][0] - min(near)[0]) < 1e-9


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (5, 5), (None, 3)]
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {**{i: 0 for i in range(21)}, 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def boxes(spark, rows):
    rows = [(*r[:3], *map(float, r[3:])) for r in rows]
    return spark.createDataFrame(rows, "image_id long, det_id long, category_id long, x1 double, y1 double, x2 double, y2 double, score double")


def test_nms_is_idempotent_and_strictness_differs(spark):
    d = boxes(spark, [(1, 1, 1, 0, 0, 10, 10, 0.9), (1, 2, 1, 0, 0, 10, 5, 0.8), (1, 3, 1, 50, 0, 60, 10, 0.7), (1, 4, 1, 5, 5, 5, 9, 0.9)])
    ids = lambda df: {r.det_id for r in df.collect()}
    assert ids(spatial.nms(d, ["image_id"], "det_id", 0.5)) == {1, 3}
    assert ids(spatial.nms(d, ["image_id"], "det_id", 0.5, strict=True)) == {1, 2, 3}
    once = spatial.nms(d, ["image_id"], "det_id", 0.3)
    assert ids(spatial.nms(once, ["image_id"], "det_id", 0.3)) == ids(once)


def test_perfect_detections(spark):
    d = boxes(spark, [(i, b, 1, 20.0 * b, 0.0, 20.0 * b + 10, 10.0, 0.9) for i in range(3) for b in range(3)])
    gold = d.withColumnRenamed("det_id", "box_id").drop("score")
    images = spark.range(5).withColumnRenamed("id", "image_id")
    row = cgf1(gold, d, images).where("threshold = 0.5").first()
    assert (row.tp, row.fp, row.fn, row.il_tp, row.il_tn) == (9, 0, 0, 3, 2)
    assert row.cgf1 > 0.999
    assert {round(r.ap, 6) for r in detection_ap(gold, d).collect()} == {1.0}


def test_self_comparison_has_hota_one(spark):
    f = spark.createDataFrame([(1, t, 1, n, 30.0 * t, 0.0, 10.0, 10.0) for t in range(3) for n in range(5)], "video_id long, track_id long, category_id long, frame long, x double, y double, w double, h double")
    assert {round(r.hota, 9) for r in tracks.hota(f, f.withColumn("track_id", F.col("track_id") + 9)).collect()} == {1.0}


def test_paths_and_ties(spark):
    t = spark.createDataFrame([(1, 1, "A", None, "B"), (1, 2, "A", "x", "C"), (1, 3, "B", None, "D"), (1, 4, "C", None, "D"), (1, 5, "D", " ", "pending")], "graph_id long, edge_no long, src string, cond string, dst string")
    nodes, edges = graphs.build_graph(t)
    assert {r.n for r in nodes.collect()} == {"a", "b", "c", "d"}
    pairs = spark.createDataFrame([(1, 1, "a", "d"), (1, 2, "d", "a"), (1, 3, "b", "b"), (1, 4, None, "a")], "graph_id long, pair_id long, s string, d string")
    out = {r.pair_id: r for r in graphs.find_path(pairs, edges).collect()}
    assert out[1].path == ["a", "b", "d"] and out[3].length == 0
    assert not out[2].found and not out[4].found
    assert graphs.find_path(pairs, edges, directed=False).where("pair_id = 2").first().length == 2


def test_snap_keeps_ties_and_case(spark):
    fields = spark.createDataFrame([(1, "cat"), (1, "Dog"), (1, "hous"), (1, "bat")], "graph_id long, text string")
    vocab = spark.createDataFrame([(1, "car"), (1, "cab"), (1, "dog"), (1, "house")], "graph_id long, word string")
    out = {r.text: r.snapped for r in snap_to_vocab(fields, vocab, max_dist=1).collect()}
    assert out == {"cat": "cat", "Dog": "Dog", "hous": "house", "bat": "bat"}


def test_sampling_sizes(spark):
    a = spark.range(95).select(F.lit(1).alias("graph_id"), F.col("id").alias("arrow_id"))
    parts = {r.part: r["count"] for r in split_train_val(a, ["arrow_id"]).groupBy("part").count().collect()}
    assert parts == {"val": 9, "train": 86}
    assert k_groups_combos(a.where("arrow_id < 6"), 2).count() == 6
    assert [r.ids for r in k_groups_combos(a.where("arrow_id < 2"), 3).collect()] == [[0, 1]]
