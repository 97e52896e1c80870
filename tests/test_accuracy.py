"""Tracking accuracy, mask quality and combinations against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrowlake.operators import combine as co
from arrowlake.operators import mask_quality as mq
from arrowlake.operators import teta as te

EPS = 2.220446049250313e-16
FRAME = "video_id long, track_id long, category_id long, frame long, x double, y double, w double, h double"


def iou(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    i = max(w, 0) * max(h, 0)
    return i / (a[2] * a[3] + b[2] * b[3] - i)


def assign(score):
    """The best assignment by trying all; what has no score is paired by rank."""
    n, m = score.shape
    best, chosen = -1.0, []
    for k in range(min(n, m) + 1):
        for rows in itertools.combinations(range(n), k):
            for cols in itertools.permutations(range(m), k):
                if all(score[i, j] > 0 for i, j in zip(rows, cols)) and sum(score[i, j] for i, j in zip(rows, cols)) > best + 1e-12:
                    best, chosen = sum(score[i, j] for i, j in zip(rows, cols)), list(zip(rows, cols))
    rest = zip([i for i in range(n) if i not in [p[0] for p in chosen]], [j for j in range(m) if j not in [p[1] for p in chosen]])
    return chosen + list(rest)


def matching(gold, tracks, frames):
    """frame -> [(g, t, sim)] of the best alignment; both are frame -> {id: box}."""
    common, sims = {}, {}
    for f in frames:
        gs, ts = sorted(gold.get(f, {})), sorted(tracks.get(f, {}))
        sim = np.array([[iou(gold[f][g], tracks[f][t]) for t in ts] for g in gs]).reshape(len(gs), len(ts))
        sims[f] = gs, ts, sim
        whole = sim.sum(0, keepdims=True) + sim.sum(1, keepdims=True) - sim
        for (i, g), (j, t) in itertools.product(enumerate(gs), enumerate(ts)):
            common[g, t] = common.get((g, t), 0) + (sim[i, j] / whole[i, j] if whole[i, j] > EPS else 0)
    count = lambda side, x: sum(x in side.get(f, {}) for f in frames)
    out = {}
    for f, (gs, ts, sim) in sims.items():
        align = np.array([[common[g, t] / (count(gold, g) + count(tracks, t) - common[g, t]) for t in ts] for g in gs]).reshape(sim.shape)
        out[f] = [(gs[i], ts[j], sim[i, j]) for i, j in assign(align * sim)]
    return out


def teta_by_hand(gt, dt, exhaustive):
    """{(video, class): (6 x 20 counts, 3 x 20 shares)} from rows of FRAME."""
    classes, out = sorted({r[2] for r in gt} | {r[2] for r in dt}), {}
    for video in sorted({r[0] for r in gt} | {r[0] for r in dt}):
        frames = sorted({r[3] for r in gt + dt if r[0] == video})
        kind_g = {r[1]: r[2] for r in gt if r[0] == video}
        kind_t = {(r[3], r[1]): r[2] for r in dt if r[0] == video}
        box = lambda rows, keep: {f: {r[1]: r[4:] for r in rows if r[0] == video and r[3] == f and keep(r)} for f in frames}
        all_g, all_t = box(gt, lambda r: True), box(dt, lambda r: True)
        near_any = {t for f in frames for t in all_t[f] if any(iou(b, all_t[f][t]) >= 0.5 for b in all_g[f].values())}
        first = matching(all_g, {f: {t: b for t, b in all_t[f].items() if t in near_any} for f in frames}, frames)
        owner = {(f, t): kind_g[g] for f in frames for g, t, s in first[f] if s >= 0.5 - EPS}
        false = {c: np.zeros(20) for c in classes}
        res = {}
        for c in classes:
            gold = {f: {g: b for g, b in all_g[f].items() if kind_g[g] == c} for f in frames}
            near = {f: {t for t, b in all_t[f].items() if any(iou(x, b) >= 0.5 for x in gold[f].values()) and owner.get((f, t), c) == c} for f in frames}
            kept = set().union(*near.values())
            stray = sum(kind_t[f, t] == c and t not in near[f] for f in frames for t in all_t[f])
            counts, shares = np.zeros((5, 20)), np.zeros((3, 20))
            if not kept:
                counts[1] += sum(map(len, gold.values()))
                if exhaustive:
                    false[c] = np.full(20, float(stray))
                res[c] = counts, shares
                continue
            tracks = {f: {t: b for t, b in all_t[f].items() if t in kept} for f in frames}
            met = matching(gold, tracks, frames)
            if exhaustive:
                false[c] += stray
            n_g = {g: sum(g in gold[f] for f in frames) for f in frames for g in gold[f]}
            n_t = {t: sum(t in tracks[f] for f in frames) for t in kept}
            for a in range(20):
                pairs = {}
                for f in frames:
                    if not gold[f]:
                        continue
                    hit = [(g, t) for g, t, s in met[f] if s >= a / 20 - EPS]
                    counts[0, a] += len(hit)
                    counts[1, a] += len(gold[f]) - len(hit)
                    counts[2, a] += len(near[f] - {t for _, t in hit})
                    for g, t in hit:
                        pairs[g, t] = pairs.get((g, t), 0) + 1
                        right = kind_t[f, t] == c
                        counts[3, a] += right
                        counts[4, a] += not right
                        if not right:
                            false[kind_t[f, t]][a] += 1
                for (g, t), n in pairs.items():
                    for k, whole in enumerate((n_g[g] + n_t[t] - n, n_g[g], n_t[t])):
                        shares[k, a] += n * n / whole
                shares[:, a] /= max(1, counts[0, a])
            res[c] = counts, shares
        for c in classes:
            out[video, c] = *res[c], false[c]
    return out


@pytest.mark.parametrize("exhaustive", [False, True])
def test_teta_against_brute_force(spark, exhaustive):
    rng = random.Random(11)
    gt, dt = [], []
    for video in range(25):
        for track in range(rng.randint(0, 4)):
            kind = rng.randint(1, 3)
            for frame in range(3):
                if rng.random() < 0.8:
                    gt.append((video, track, kind, frame, rng.uniform(0, 12), rng.uniform(0, 6), rng.uniform(8, 14), rng.uniform(8, 14)))
        for g in [g for g in gt if g[0] == video]:
            if rng.random() < 0.8:
                dt.append((video, 100 + (g[1] if rng.random() < 0.8 else 7 + g[1]), rng.randint(1, 3), g[3], *(v + rng.uniform(-2, 2) for v in g[4:])))
        dt.append((video, 150, rng.randint(1, 3), 1, 80.0, 80.0, 5.0, 5.0))
    dt = list({(r[0], r[1], r[3]): r for r in dt}.values())
    got = te.teta_counts(spark.createDataFrame(gt, FRAME), spark.createDataFrame(dt, FRAME), exhaustive).collect()
    want, seen = teta_by_hand(gt, dt, exhaustive), set()
    for r in got:
        counts, shares, false = want[r.video_id, r.category_id]
        a = round(r.alpha * 20)
        seen.add((r.video_id, r.category_id, a))
        assert (r.loc_tp, r.loc_fn, r.loc_fp) == tuple(counts[:3, a]), r
        assert np.allclose([r.assoc_a, r.assoc_re, r.assoc_pr], shares[:, a]), r
        assert (r.cls_tp, r.cls_fn, r.cls_fp) == ((*counts[3:, a], false[a]) if a >= 10 else (None, None, None)), r
    for key, (counts, _, false) in want.items():
        if counts.any() or false.any():
            assert {(*key, a) for a in range(20)} <= seen


def test_teta_of_empty_sides(spark):
    some, none = spark.createDataFrame([(1, 1, 2, 0, 0.0, 0.0, 4.0, 4.0)], FRAME), spark.createDataFrame([], FRAME)
    assert {(r.loc_tp, r.loc_fn, r.loc_fp) for r in te.teta_counts(some, none).collect()} == {(0, 1, 0)}
    assert {(r.loc_tp, r.loc_fn, r.loc_fp, r.cls_fp) for r in te.teta_counts(none, some, True).where("alpha >= 0.5").collect()} == {(0, 0, 0, 1)}
    assert te.teta_counts(none, none).count() == 0
    scores = te.teta_scores(co.combined(te.teta_counts(some, some), ["category_id", "alpha"], te.COUNTS, te.SHARES, "loc_tp"), ["category_id"]).collect()
    assert {r.teta for r in scores} == {1.0}


def test_ancestors_and_averages(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(99, None), (7, 7)]
    closure = {(r.category_id, r.ancestor): r.distance for r in co.ancestors(spark.createDataFrame(chain, "category_id long, parent long")).collect()}
    assert closure[1, 40] == 39 and closure[39, 40] == 1 and closure[99, 99] == 0 and (40, 1) not in closure and len(closure) == 40 * 41 // 2 + 1
    loop = {(r.category_id, r.ancestor) for r in co.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "category_id long, parent long")).collect()}
    assert loop == set(itertools.product((1, 2, 3), repeat=2))
    rows = spark.createDataFrame([(1, 0.5, 4, 0, 0.5), (2, 0.5, 0, 0, 0.9), (3, 0.5, 1, 3, 1.0)], "category_id long, alpha double, tp long, fn long, score double")
    out = co.class_averaged(rows, ["alpha"], "category_id", ["tp", "fn"], ["score"], ["tp", "fn"]).first()
    assert (out.tp, out.fn, out.score) == (5, 3, 0.75)
    whole = co.combined(rows, ["alpha"], ["tp", "fn"], ["score"], "tp").first()
    assert whole.score == pytest.approx((4 * 0.5 + 1) / 5)
    tags = spark.createDataFrame([(1, ["hard"]), (2, None), (3, ["easy", "hard"])], "category_id long, tags array<string>")
    assert sorted(r.category_id for r in co.tagged(rows, tags, "hard", "category_id").collect()) == [1, 3]


RUN = "image_id long, {0} long, height long, width long, run_start long, run_end long"


def runs_of(mask):
    flat = np.concatenate([[0], mask.T.reshape(-1), [0]])
    edges = np.flatnonzero(np.diff(flat))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def edge_of(mask):
    p = np.pad(mask, ((0, 1), (0, 1)), mode="edge")
    n = p[:-1, :-1] + p[1:, :-1] + p[:-1, 1:] + p[1:, 1:]
    return (n > 0) & (n < 4)


def grown(edge, r):
    h, w = edge.shape
    out = np.zeros_like(edge)
    for y, x in zip(*np.nonzero(edge)):
        out[max(y - r, 0) : y + r + 1, max(x - r, 0) : x + r + 1] = True
    return out


def f_of(a, b, r):
    ea, eb = edge_of(a), edge_of(b)
    na, nb = ea.sum(), eb.sum()
    precision = 1 if nb == 0 else 0 if na == 0 else (eb & grown(ea, r)).sum() / nb
    recall = 1 if na == 0 else 0 if nb == 0 else (ea & grown(eb, r)).sum() / na
    return 0 if precision + recall == 0 else 2 * precision * recall / (precision + recall)


def random_mask(rng, h, w):
    kind = rng.integers(0, 4)
    if kind == 0:
        return np.ones((h, w), int)
    if kind == 1:
        return (rng.random((h, w)) < 0.6).astype(int)
    mask = np.zeros((h, w), int)
    y, x = rng.integers(0, h), rng.integers(0, w)
    mask[y : y + rng.integers(1, h + 1), x : x + rng.integers(1, w + 1)] = 1
    return mask


def test_mask_scores_against_pixels(spark):
    rng = np.random.default_rng(3)
    gold, found, masks = [], [], {}
    for image in range(50):
        h, w = int(rng.integers(1, 9)), int(rng.integers(1, 9))
        for side, rows, most in (("g", gold, 3), ("d", found, 3)):
            for k in range(int(rng.integers(0, most + 1))):
                mask = random_mask(rng, h, w)
                if not mask.any():
                    continue
                score = float(rng.choice([0.2, 0.5, 0.9]))
                if side == "g" or score >= 0.5:
                    masks.setdefault((image, side), {})[k] = mask
                rows += [(image, k, h, w, a, b) if side == "g" else (image, k, score, h, w, a, b) for a, b in runs_of(mask)]
    g = spark.createDataFrame(gold, RUN.format("g"))
    d = spark.createDataFrame(found, "image_id long, d long, score double, height long, width long, run_start long, run_end long")
    images = spark.range(50).withColumnRenamed("id", "image_id")
    a, b = mq.column_runs(g, ["image_id", "g"]), mq.column_runs(d.where("score >= 0.5"), ["image_id", "d"])
    edges = mq.boundaries(a, ["image_id", "g"]).collect()
    for (image, side), held in masks.items():
        for k, mask in held.items() if side == "g" else ():
            drawn = np.zeros_like(mask, bool)
            for r in edges:
                if (r.image_id, r.g) == (image, k):
                    assert not drawn[r.y1 : r.y2, r.x].any()
                    drawn[r.y1 : r.y2, r.x] = True
            assert (drawn == edge_of(mask)).all()
    radius = 1
    matches = mq.boundary_f(mq.matched_masks(a, b), a, b, F.lit(radius).cast("long")).collect()
    per = {}
    for r in matches:
        x, y = masks[r.image_id, "g"][r.g], masks[r.image_id, "d"][r.d]
        assert r.iou == pytest.approx((x & y).sum() / (x | y).sum())
        assert r.f == pytest.approx(f_of(x, y, radius))
        per.setdefault(r.image_id, []).append((r.iou, r.f))
    want = {k: 0.0 for k in ("tp", "fp", "fn", "macro", "il_tp", "il_fp", "il_tn", "il_fn", "pp", "pn", "j", "f", "pos_fp")}
    for image in range(50):
        gs, ds = masks.get((image, "g"), {}), masks.get((image, "d"), {})
        ious = np.array([[(x & y).sum() / (x | y).sum() for y in ds.values()] for x in gs.values()]).reshape(len(gs), len(ds))
        best = sum(ious[i, j] for i, j in assign(ious))
        own = per.get(image, [])
        assert len(own) == min(len(gs), len(ds)) and sum(i for i, _ in own) == pytest.approx(best)
        tp = sum(i >= 0.5 for i, _ in own)
        fp, fn = len(ds) - tp, len(gs) - tp
        pr, re = tp / (tp + fp + 1e-4), tp / (tp + fn + 1e-4)
        want["il_" + ("t" if bool(gs) == bool(ds) else "f") + ("p" if ds else "n")] += 1
        want["pp" if gs else "pn"] += fp == fn == 0
        for k, v in (("tp", tp), ("fp", fp), ("fn", fn), ("pos_fp", fp * bool(gs)), ("macro", 2 * pr * re / (pr + re + 1e-4) * bool(gs))):
            want[k] += v
        if own:
            want["j"] += np.mean([i for i, _ in own])
            want["f"] += sum(f for _, f in own) / (len(own) + 1e-9)
    out = mq.cgf1_extended(g, d, images, F.lit(radius).cast("long")).where("threshold = 0.5").first()
    assert all(out[k] == want[k] for k in ("tp", "fp", "fn", "il_tp", "il_fp", "il_tn", "il_fn")) and out.positive_micro_fp == want["pos_fp"]
    assert out.j == pytest.approx(want["j"] / want["il_tp"]) and out.f == pytest.approx(want["f"] / want["il_tp"]) and out.jf == pytest.approx((out.j + out.f) / 2)
    assert out.positive_macro_f1 == pytest.approx(want["macro"] / want["il_tp"]) and out.positive_w0dt_macro_f1 == pytest.approx(want["macro"] / (want["il_tp"] + want["il_fn"]))
    assert out.il_perfect_pos == pytest.approx(want["pp"] / (want["il_tp"] + want["il_fn"])) and out.il_perfect_neg == pytest.approx(want["pn"] / (want["il_fp"] + want["il_tn"]))
    assert out.cgf1 == pytest.approx(out.positive_macro_f1 * out.il_mcc)
    empty = mq.cgf1_extended(g.limit(0), d.limit(0), images, F.lit(radius)).where("threshold = 0.5").first()
    assert empty.il_tn == 50 and empty.j == 0 and empty.positive_macro_f1 is None


def test_association_modes_against_brute_force(spark):
    from arrowlake.operators import tracks as tr

    rng = random.Random(21)
    tracks, dets = [], []
    for frame in range(30):
        for k in range(rng.randint(0, 4)):
            x = rng.randint(0, 12)
            tracks.append((1, frame, k, float(x), 0.0, float(x + (0 if rng.random() < 0.15 else 10)), 10.0))
        for k in range(rng.randint(0, 4)):
            x = rng.randint(0, 12)
            dets.append((1, frame, 100 + k, rng.choice([0.1, 0.5, 0.9]), float(x), 0.0, float(x + 10), 10.0))
    corners = "x1 double, y1 double, x2 double, y2 double"
    t = spark.createDataFrame(tracks, f"video_id long, frame long, track_id long, {corners}")
    d = spark.createDataFrame(dets, f"video_id long, frame long, det_id long, score double, {corners}")
    size = lambda b: (b[0], b[1], b[2] - b[0], b[3] - b[1])
    for once in (False, True):
        want = set()
        for frame in range(30):
            own, seen = [x for x in tracks if x[1] == frame], [x for x in dets if x[1] == frame]
            some = [x for x in own if x[5] > x[3]]
            sim = np.array([[iou(size(a[3:]), size(b[4:])) for b in seen] for a in some]).reshape(len(some), len(seen))
            want |= {(frame, "empty", x[2], None) for x in own if x not in some}
            want |= {(frame, "matched", a[2], b[2]) for i, a in enumerate(some) for j, b in enumerate(seen) if sim[i, j] >= 0.5}
            fresh = {j for j, b in enumerate(seen) if (b[3] >= 0.3 or not own) and not (sim[:, j] >= 0.5).any()}
            want |= {(frame, "new", None, seen[j][2]) for j in fresh}
            hit = {i for i, j in assign(sim) if sim[i, j] >= 0.6} if once else {i for i in range(len(some)) if (sim[i] >= 0.6).any()}
            want |= {(frame, "unmatched", a[2], None) for i, a in enumerate(some) if i not in hit}
            sure = {}
            for j, b in enumerate(seen):
                if len(some) and b[3] >= 0.8 and sim[:, j].max() >= 0.8 and j not in fresh:
                    sure[some[int(sim[:, j].argmax())][2]] = b[2]
            want |= {(frame, "sure", k, v) for k, v in sure.items()}
        got = {(r.frame, r.what, r.track_id, r.det_id) for r in tr.associate(t, d, ["video_id", "frame"], 0.5, 0.6, 0.3, once).collect()}
        if once:  # of equally good assignments any may be taken
            loose = {x for x in got ^ want if x[1] == "unmatched"}
            assert got ^ want == loose and len({x for x in got if x[1] == "unmatched"}) == len({x for x in want if x[1] == "unmatched"})
        else:
            assert got == want
