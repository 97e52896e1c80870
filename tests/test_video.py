"""Average precision by area, occlusion and counters against plain Python."""

import random

import numpy as np

from arrowlake.operators import precision, video


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    inter = max(w, 0) * max(h, 0)
    size = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return inter / (size(a) + size(b) - inter)


def plain_ap(gold, dets, lo, hi, threshold):
    """One category: gold [(image, box)], dets [(image, id, score, box)]."""
    size = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    out_of = lambda x: not lo <= size(x) <= hi
    flags = []
    for image in {i for i, *_ in dets}:
        boxes = [(i, b) for i, (g, b) in enumerate(gold) if g == image]
        free = {i for i, _ in boxes}
        for _, no, score, box in sorted((d for d in dets if d[0] == image), key=lambda d: (-d[2], d[1])):
            near = sorted((out_of(b), -iou(box, b), i) for i, b in boxes if i in free and iou(box, b) >= threshold)
            if near:
                free.discard(near[0][2])
            if near and near[0][0] or not near and out_of(box):
                continue
            flags.append((-score, image, no, bool(near)))
    n = sum(not out_of(b) for _, b in gold)
    if not n:
        return -1.0
    hits = np.cumsum([h for *_, h in sorted(flags)]) if flags else np.zeros(0)
    recall, precision = hits / n, hits / np.arange(1, len(hits) + 1)
    return float(np.mean([max((p for p, r in zip(precision, recall) if r >= x - 1e-9), default=0.0) for x in np.linspace(0, 1, 101)]))


def test_precision_by_area_against_plain_python(spark):
    rng = random.Random(6)
    gold, dets = [], []
    for image in range(12):
        for _ in range(rng.randint(0, 5)):
            x, y, s = rng.randint(0, 150), rng.randint(0, 150), rng.choice([20, 30, 50, 120])
            gold.append((image, (x, y, x + s, y + s)))
            for _ in range(rng.randint(0, 2)):
                d = rng.randint(-3, 3)
                dets.append((image, len(dets), round(rng.random(), 2), (x + d, y, x + d + s, y + s + d)))
        dets.append((image, len(dets), rng.random(), (200, 200, 210, 210)))
    box = "x1 double, y1 double, x2 double, y2 double"
    g = spark.createDataFrame([(i, 1, n, *map(float, b)) for n, (i, b) in enumerate(gold)], f"image_id long, category_id long, box_id long, {box}")
    t = spark.createDataFrame([(i, 1, n, s, *map(float, b)) for i, n, s, b in dets], f"image_id long, category_id long, det_id long, score double, {box}")
    out = {(r.area, r.threshold): r.ap for r in precision.box_ap(g, t).collect()}
    for name, (lo, hi) in precision.IMAGE_AREAS.items():
        for threshold in (0.5, 0.75, 0.9):
            assert abs(out[name, threshold] - plain_ap(gold, dets, lo, hi, threshold)) < 1e-6


def test_occlusion_and_counters_against_plain_python(spark):
    rng = random.Random(7)
    frames = [(v, f, t, rng.random() < 0.3) for v in range(2) for f in range(15) for t in range(4)]
    pairs = [(v, f, a, b) for v in range(2) for f in range(15) for a in range(4) for b in range(a + 1, 4) if rng.random() < 0.4]
    df = spark.createDataFrame(frames, "video_id long, frame long, track_id long, empty boolean")
    out = {(r.video_id, r.frame, r.track_id): r.suppressed for r in video.suppress_recently_occluded(df, spark.createDataFrame(pairs, "video_id long, frame long, one long, two long")).collect()}
    for v in range(2):
        last = dict.fromkeys(range(4), -1)
        for f in range(15):
            gone = set()
            for w, n, a, b in pairs:
                if (w, n) == (v, f):
                    gone |= {a} if last[a] > last[b] > -1 else {b} if last[b] > last[a] > -1 else set()
            assert {t for t in range(4) if out[v, f, t]} == gone
            for w, n, t, empty in frames:
                if (w, n) == (v, f) and (empty or t in gone):
                    last[t] = f
    matched = spark.createDataFrame([(1, 1, f, f % 3 == 0 or f > 20) for f in range(40)], "video_id long, track_id long, frame long, matched boolean")
    alive, want = 0, []
    for f in range(40):
        alive = max(-4, min(8, alive + (1 if f % 3 == 0 or f > 20 else -1)))
        want.append(alive)
    assert [r.alive for r in video.keep_alive(matched).orderBy("frame").collect()] == want


def test_running_counts_of_one_hot_group(spark):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    rows = [("hot", rng.randint(0, 30) / 30, i, rng.randint(0, 1)) for i in range(3000)] + [(None, 0.5, 1, 1), ("small", 0.1, 2, 0)]
    df = spark.createDataFrame(rows, "kind string, score double, id long, hit int").repartition(7)
    out = precision.running_counts(df, ["kind"], [F.desc("score"), F.col("id")], "hit")
    got = {(r.kind, r.id): (r.tp, r.n) for r in out.collect()}
    ordered = sorted((r for r in rows if r[0] == "hot"), key=lambda r: (-r[1], r[2]))
    total = 0
    for n, r in enumerate(ordered, 1):
        total += r[3]
        assert got["hot", r[2]] == (total, n)
    assert got["small", 2] == (0, 1)


def test_uncontested_pairs_stay_one_row(spark, monkeypatch):
    from pyspark.sql import functions as F

    box = [(F.col("id") * 100.0).alias("x1"), F.lit(0.0).alias("y1"), (F.col("id") * 100.0 + 40).alias("x2"), F.lit(40.0).alias("y2")]
    ids = spark.range(60)
    gold = ids.select((F.col("id") % 7).alias("image_id"), F.lit(1).cast("long").alias("category_id"), F.col("id").alias("box_id"), *box)
    dets = ids.select((F.col("id") % 7).alias("image_id"), F.lit(1).cast("long").alias("category_id"), F.col("id").alias("det_id"), (F.col("id") / 60).alias("score"), *box)
    seen, fit = [], precision.first_fit
    monkeypatch.setattr(precision, "first_fit", lambda pairs, *a: (seen.append(pairs.count()), fit(pairs, *a))[1])
    out = {r.area: r.ap for r in precision.ap_summary(precision.box_ap(gold, dets)).collect()}
    assert seen == [0] and abs(out["all"] - 1) < 1e-9 and abs(out["medium"] - 1) < 1e-9 and out["small"] == -1
