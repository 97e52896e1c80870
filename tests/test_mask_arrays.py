"""Array kernels of masks against pixels."""

import random

import numpy as np
from pyspark.sql import functions as F

from arrowlake.operators import mask_quality as mq


def test_boundary_scores_against_pixels_in_pieces(spark, monkeypatch):
    def never(*_, **__):
        raise AssertionError("events of runs as rows")

    monkeypatch.setattr(mq, "swept", never)
    monkeypatch.setattr(mq, "AT_ONCE", 60)
    rng, h, w = random.Random(9), 9, 11
    masks = {(i, s, m): np.array([[rng.random() < 0.6 for _ in range(w)] for _ in range(h)]) for i in range(3) for s in "gd" for m in range(3)}

    def runs(side):
        rows = []
        for (i, s, m), a in masks.items():
            flat = np.append(np.insert(a.T.ravel().astype(int), 0, 0), 0)
            if s == side:
                rows += [(i, m, h, w, int(x), int(y)) for x, y in zip(np.flatnonzero(np.diff(flat) == 1), np.flatnonzero(np.diff(flat) == -1))]
        df = spark.createDataFrame(rows, f"image_id long, {side} long, height long, width long, run_start long, run_end long")
        return mq.column_runs(df, ["image_id", side])

    def edge(a):
        b = np.pad(a, ((0, 1), (0, 1)), mode="edge")
        return (a != b[1:, :-1]) | (a != b[:-1, 1:]) | (a != b[1:, 1:])

    def near(a, r):
        return np.array([[a[max(y - r, 0) : y + r + 1, max(x - r, 0) : x + r + 1].any() for x in range(w)] for y in range(h)])

    gold, found = runs("g"), runs("d")
    pairs = mq.mask_pairs(gold, found)
    out = mq.boundary_f(pairs, gold, found, F.lit(1)).collect()
    assert len(out) == 27
    for r in out:
        a, b = masks[r.image_id, "g", r.g], masks[r.image_id, "d", r.d]
        assert abs(r.iou - (a & b).sum() / (a | b).sum()) < 1e-9
        e, f = edge(a), edge(b)
        p, q = (f & near(e, 1)).sum() / f.sum(), (e & near(f, 1)).sum() / e.sum()
        assert abs(r.f - 2 * p * q / (p + q)) < 1e-9
