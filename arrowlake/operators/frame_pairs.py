"""Pairs of tracks that share frames, compared inside tasks: boxes travel, pairs never do.

Where a video has many tracks, the pairs of boxes of its frames are far more than the boxes. So rows of boxes are dealt
by video (or by video and blocks of tracks), and a task compares a frame at a time by array arithmetic. What leaves a
task are sums over frames, matches, or the pairs asked for. Rows with a null key take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import boxes
from .assignment import solve_matrix

#: Tracks of a block: a task compares two blocks at a time, in arrays of so many numbers squared.
BLOCK = 1000
EPS = 2.220446049250313e-16


def areas(a: np.ndarray) -> np.ndarray:
    """Areas of boxes (x1, y1, x2, y2; rows)."""
    return np.maximum(a[:, 2] - a[:, 0], 0) * np.maximum(a[:, 3] - a[:, 1], 0)


def intersections(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersections of all boxes of two sets; 0 where disjoint."""
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    met = (w > 0) & (h > 0)
    w *= h
    w[~met] = 0
    return w


def ious(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of all boxes of two sets; 0 where disjoint or degenerate."""
    inter = intersections(a, b)
    union = areas(a)[:, None] + areas(b)[None, :]
    union -= inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=(inter > 0) & (union > 0))


def by_frame(g: pd.DataFrame, t: pd.DataFrame, g_name: str, t_name: str) -> Iterator[tuple]:
    """(frame, rows of g, boxes of g, rows of t, boxes of t) of the frames that both have, ids ascending."""
    sides = []
    for df, name in ((g, g_name), (t, t_name)):
        df = df.sort_values(["frame", name], kind="stable")
        frames = df["frame"].to_numpy()
        at = np.flatnonzero(np.append(True, frames[1:] != frames[:-1])) if len(frames) else np.zeros(0, int)
        sides.append((df.reset_index(drop=True), dict(zip(frames[at].tolist(), zip(at.tolist(), np.append(at[1:], len(frames)).tolist())))))
    (g, g_at), (t, t_at) = sides
    g_box, t_box = g[boxes.CORNERS].to_numpy(float), t[boxes.CORNERS].to_numpy(float)
    for frame, (a, b) in g_at.items():
        if frame in t_at:
            c, d = t_at[frame]
            yield frame, g.iloc[a:b], g_box[a:b], t.iloc[c:d], t_box[c:d]


def add_at(table: np.ndarray, i: np.ndarray, j: np.ndarray, values: np.ndarray) -> None:
    """Adds ``values`` to rows i (ascending) and columns j (ascending) of a table; a track with several boxes in a frame repeats."""
    if (i[1:] == i[:-1]).any() or (j[1:] == j[:-1]).any():
        np.add.at(table, np.ix_(i, j), values)
    else:
        table[np.ix_(i, j)] += values


def frame_matches(gt: DataFrame, dt: DataFrame, by: list[str], least: float) -> DataFrame:
    """(by, frame, g, t, iou): in each frame the assignment of highest total IoU, of pairs that reach ``least``.

    ``gt`` is (by, frame, g, x1, y1, x2, y2), ``dt`` the like with ``t``. A task holds one value of ``by``, and compares a frame at a time.
    """
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    names = [*by, "frame", "g", "t", "iou"]
    kinds = ", ".join([*(f"{c} {kind(gt, c)}" for c in by), f"frame {kind(gt, 'frame')}", f"g {kind(gt, 'g')}", f"t {kind(dt, 't')}", "iou double"])

    def run(value: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for frame, x, x_box, y, y_box in by_frame(a, b, "g", "t"):
            near = ious(x_box, y_box)
            near[near < least] = 0
            p, q = solve_matrix(near)
            out.append(pd.DataFrame({"frame": frame, "g": x["g"].to_numpy()[p], "t": y["t"].to_numpy()[q], "iou": near[p, q]}))
        found = pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: [] for c in names[len(by) :]})
        return found.assign(**dict(zip(by, value)))[names]

    g, t = gt.select(*by, "frame", "g", *boxes.CORNERS), dt.select(*by, "frame", "t", *boxes.CORNERS)
    return g.dropna(subset=[*by, "frame", "g"]).groupBy(*by).cogroup(t.dropna(subset=[*by, "frame", "t"]).toDF(*t.columns).groupBy(*by)).applyInPandas(run, kinds)


def occluded_by_older(ids: np.ndarray, corners: np.ndarray, last: dict, least: float) -> np.ndarray:
    """Which boxes of a frame are suppressed: those that overlap by ``least`` a track whose last occlusion (``last``, by id) is older than their own."""
    own = np.array([last.get(t, -1) for t in ids.tolist()], np.int64)
    lost, rivals = np.zeros(len(ids), bool), np.flatnonzero(own > -1)
    for at in np.array_split(rivals, max(1, -(-len(rivals) // BLOCK))):
        met = (ious(corners[at], corners[rivals]) >= least) & (own[rivals][None, :] < own[at][:, None]) & (ids[rivals][None, :] != ids[at][:, None])
        lost[at] = met.any(axis=1)
    return lost


def _blocks(df: DataFrame, on: list[str], name: str, own: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a block of their track, blocks of each value of ``on``)"""
    counts = df.groupBy(*on).agg(F.count_distinct(name).alias("tracks"))
    counts = counts.select(*on, F.ceil(F.col("tracks") / BLOCK).cast("int").alias(f"{own}_n"))
    return df.join(counts, on).withColumn(own, F.pmod(F.hash(name), F.col(f"{own}_n"))).drop(f"{own}_n"), counts


def track_sums(gt: DataFrame, dt: DataFrame, on: list[str], least: float | None = None) -> DataFrame:
    """(on, gt_id, dt_id, inter, both): summed intersections, and summed areas of both, over the frames that two tracks share.

    ``gt`` and ``dt`` are (on, frame, track_id, x1, y1, x2, y2). Tracks are dealt in blocks of about ``BLOCK``; a pair of blocks
    meets in one task. With ``least`` only pairs whose intersection is at least that share of the areas in shared frames.
    """
    cols = [*on, "frame", "track_id", *boxes.CORNERS]
    (g, g_blocks), (t, t_blocks) = (_blocks(df.select(*cols).dropna(subset=[*on, "frame", "track_id"]), on, "track_id", own) for df, own in ((gt, "gb"), (dt, "tb")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    g = g.join(t_blocks, on).withColumn("tb", every("tb_n")).drop("tb_n")
    t = t.join(g_blocks, on).withColumn("gb", every("gb_n")).drop("gb_n")
    t = t.toDF(*t.columns)  # ``gt`` and ``dt`` may be one table
    key = [*on, "gb", "tb"]
    ids = {c: gt.schema["track_id"].dataType.simpleString() for c in ("gt_id", "dt_id")}
    kinds = ", ".join([*(f"{c} {gt.schema[c].dataType.simpleString()}" for c in on), *(f"{c} {k}" for c, k in ids.items()), "inter double", "both double"])

    def run(value: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = [*on, "gt_id", "dt_id", "inter", "both"]
        g_ids, t_ids = np.unique(a["track_id"].to_numpy()), np.unique(b["track_id"].to_numpy())
        inter, both = np.zeros((len(g_ids), len(t_ids))), np.zeros((len(g_ids), len(t_ids)))
        met = np.zeros(inter.shape, bool)
        for _, x, x_box, y, y_box in by_frame(a, b, "track_id", "track_id"):
            i, j = np.searchsorted(g_ids, x["track_id"].to_numpy()), np.searchsorted(t_ids, y["track_id"].to_numpy())
            add_at(inter, i, j, intersections(x_box, y_box))
            add_at(both, i, j, areas(x_box)[:, None] + areas(y_box)[None, :])
            met[np.ix_(i, j)] = True
        if least is not None:
            met &= inter >= least * (both - inter) * (1 - 1e-12)
        i, j = np.nonzero(met)
        return pd.DataFrame(dict(zip(names, [*value[: len(on)], g_ids[i], t_ids[j], inter[i, j], both[i, j]])), columns=names)

    return g.groupBy(*key).cogroup(t.groupBy(*key)).applyInPandas(run, kinds)


def aligned_matches(gt: DataFrame, dt: DataFrame, by: list[str], least: float | None = None) -> DataFrame:
    """(by, frame, g, t, sim, g_n, t_n): in each frame the assignment of highest total of similarity times the tracks' alignment.

    ``gt`` is (by, frame, g, g_n, x1, y1, x2, y2), ``dt`` the like with ``t`` and ``t_n``; ``g_n`` and ``t_n`` are the numbers of frames
    of a track. Each frame's similarity is shared among its rivals, and summed over the frames for the alignment. With
    ``least`` only tracks of ``dt`` that reach it with some track of ``gt`` take part.

    A task holds one value of ``by``: its boxes, and an array of its tracks' pairs.
    """
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    kinds = ", ".join([*(f"{c} {kind(gt, c)}" for c in by), f"frame {kind(gt, 'frame')}", f"g {kind(gt, 'g')}", f"t {kind(dt, 't')}", "sim double", "g_n long", "t_n long"])
    names = [*by, "frame", "g", "t", "sim", "g_n", "t_n"]

    def run(value: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if least is not None:
            reach: set = set()
            for _, _, x_box, y, y_box in by_frame(a, b, "g", "t"):
                reach.update(y["t"].to_numpy()[(ious(x_box, y_box) >= least).any(axis=0)].tolist())
            b = b[b["t"].isin(reach)]
        g_ids, g_first = np.unique(a["g"].to_numpy(), return_index=True)
        t_ids, t_first = np.unique(b["t"].to_numpy(), return_index=True)
        g_n, t_n = a["g_n"].to_numpy()[g_first], b["t_n"].to_numpy()[t_first]
        align = np.zeros((len(g_ids), len(t_ids)))
        frames = []
        for frame, x, x_box, y, y_box in by_frame(a, b, "g", "t"):
            i, j = np.searchsorted(g_ids, x["g"].to_numpy()), np.searchsorted(t_ids, y["t"].to_numpy())
            sim = ious(x_box, y_box)
            below = sim.sum(axis=1)[:, None] + sim.sum(axis=0)[None, :] - sim
            add_at(align, i, j, np.divide(sim, below, out=np.zeros_like(sim), where=below > 0))
            frames.append((frame, i, j, x_box, y_box))
        align /= g_n[:, None] + t_n[None, :] - align
        out = []
        for frame, i, j, x_box, y_box in frames:
            sim = ious(x_box, y_box)
            p, q = solve_matrix(align[np.ix_(i, j)] * sim)
            out.append(pd.DataFrame({"frame": frame, "g": g_ids[i[p]], "t": t_ids[j[q]], "sim": sim[p, q], "g_n": g_n[i[p]], "t_n": t_n[j[q]]}))
        found = pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: [] for c in names[len(by) :]})
        return found.assign(**dict(zip(by, value)))[names]

    g = gt.select(*by, "frame", "g", "g_n", *boxes.CORNERS).dropna(subset=[*by, "frame", "g"])
    t = dt.select(*by, "frame", "t", "t_n", *boxes.CORNERS).dropna(subset=[*by, "frame", "t"])
    return g.groupBy(*by).cogroup(t.toDF(*t.columns).groupBy(*by)).applyInPandas(run, kinds)


def near_any(gt: DataFrame, dt: DataFrame, by: list[str], on: list[str], least: float) -> DataFrame:
    """(by, frame, t): boxes of ``dt`` (on, frame, t, x1, y1, x2, y2) that overlap some box of ``gt`` (by, frame, g, x1, y1, x2, y2) by ``least``.

    ``on`` are the columns of ``by`` that ``dt`` has too; all of ``dt`` is compared with each value of ``by``. A task holds the boxes of
    one value of ``on`` and compares a frame at a time.
    """
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    own = [c for c in by if c not in on]
    names = [*by, "frame", "t"]
    kinds = ", ".join([*(f"{c} {kind(gt, c)}" for c in by), f"frame {kind(gt, 'frame')}", f"t {kind(dt, 't')}"])

    def run(value: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, rows in a.groupby(own, sort=True) if own else [((), a)]:
            fixed = dict(zip(on, value)) | dict(zip(own, part if isinstance(part, tuple) else (part,)))
            for frame, _, x_box, y, y_box in by_frame(rows, b, "g", "t"):
                hit = y["t"].to_numpy()[(ious(x_box, y_box) >= least).any(axis=0)]
                if len(hit):
                    out.append(pd.DataFrame({"frame": frame, "t": hit}).assign(**fixed))
        return pd.concat(out, ignore_index=True)[names] if out else pd.DataFrame({c: [] for c in names})

    g = gt.select(*by, "frame", "g", *boxes.CORNERS).dropna()
    t = dt.select(*on, "frame", "t", *boxes.CORNERS).dropna()
    return g.groupBy(*on).cogroup(t.toDF(*t.columns).groupBy(*on)).applyInPandas(run, kinds)


def over_frames(frames: DataFrame, rule: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str | StructType) -> DataFrame:
    """What ``rule`` makes of each frame of ``frames`` (video_id, frame, track_id, ...), in order of the frames of a video.

    ``rule()`` begins a video. Rows are dealt by video and streamed in order; a task holds one frame and the rule's own state.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, video, step = None, None, None

        def closed(rows: pd.DataFrame) -> pd.DataFrame:
            nonlocal video, step
            if step is None or rows["video_id"].iloc[0] != video:
                video, step = rows["video_id"].iloc[0], rule()
            return step(rows.reset_index(drop=True))

        for batch in batches:
            held = batch if held is None or not len(held) else pd.concat([held, batch], ignore_index=True)
            at = held[["video_id", "frame"]].to_numpy()
            ends = np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1
            for lo, hi in zip(np.append(0, ends[:-1]), ends, strict=True) if len(ends) else ():
                yield closed(held.iloc[lo:hi])
            held = held.iloc[ends[-1] :] if len(ends) else held
        if held is not None and len(held):
            yield closed(held)

    return frames.repartition("video_id").sortWithinPartitions("video_id", "frame", "track_id").mapInPandas(run, schema)


def association(tracks: DataFrame, dets: DataFrame, on: list[str], iou: float, track_iou: float, new_score: float, one_to_one: bool, sure: float) -> DataFrame:
    """(on, what, track_id, det_id) of ``tracks.associate``. A task holds a frame's boxes and, at a time, the overlaps of its tracks with
    ``BLOCK`` detections; with ``one_to_one`` those with all."""
    names = [*on, "what", "track_id", "det_id"]
    kinds = ", ".join([*(f"{c} {tracks.schema[c].dataType.simpleString()}" for c in on), "what string", f"track_id {tracks.schema['track_id'].dataType.simpleString()}", f"det_id {dets.schema['det_id'].dataType.simpleString()}"])

    def run(value: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[str, np.ndarray | None, np.ndarray | None]] = []
        corners = a[boxes.CORNERS].to_numpy(float)
        some = areas(corners) > 0
        a_ids, corners, empty = a["track_id"].to_numpy()[some], corners[some], a["track_id"].to_numpy()[~some]
        b_ids, b_box, score = b["det_id"].to_numpy(), b[boxes.CORNERS].to_numpy(float), b["score"].to_numpy(float)
        whole = len(a) > 0 and not any(v is None or v != v for v in value)  # a frame of unknown key meets nothing
        fresh = score >= new_score if whole else np.ones(len(b), bool)
        closest, held = np.full(len(b), -1), np.zeros(len(a_ids), bool)
        if whole and len(a_ids) and len(b):
            order = np.argsort(a_ids, kind="stable")
            a_ids, corners = a_ids[order], corners[order]
            every = []
            for at in np.array_split(np.arange(len(b)), -(-len(b) // BLOCK)):
                near = ious(corners, b_box[at])
                i, j = np.nonzero(near >= iou) if iou > 0 else np.nonzero((near >= iou) & (near > 0))
                out.append(("matched", a_ids[i], b_ids[at[j]]))
                fresh[at[j]] = False
                best = near.argmax(axis=0)  # the least id of equal ones
                top = near[best, np.arange(len(at))]
                closest[at] = np.where((top > 0) & (top >= sure) & (score[at] >= sure), best, -1)
                every.append(near) if one_to_one else held.__ior__((near >= track_iou).any(axis=1))
            if one_to_one:
                near = np.concatenate(every, axis=1)
                p, q = solve_matrix(near)
                held[p[near[p, q] >= track_iou]] = True
        out += [("new", None, b_ids[fresh]), ("unmatched", a_ids[~held], None), ("empty", empty, None)]
        strong = np.flatnonzero((closest >= 0) & ~fresh)
        if len(strong):
            last = pd.DataFrame({"t": a_ids[closest[strong]], "d": b_ids[strong]}).groupby("t", sort=True)["d"].max()
            out.append(("sure", last.index.to_numpy(), last.to_numpy()))
        parts = []
        for what, t, d in out:
            n = len(d if t is None else t)
            if n:
                null = pd.array([pd.NA] * n, dtype="Int64")
                parts.append(pd.DataFrame({"what": what, "track_id": null if t is None else pd.array(t, dtype="Int64"), "det_id": null if d is None else pd.array(d, dtype="Int64")}))
        found = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: [] for c in names[len(on) :]})
        return found.assign(**dict(zip(on, value)))[names]

    a = tracks.select(*on, "track_id", *boxes.CORNERS).groupBy(*on)
    b = dets.select(*on, "det_id", "score", *boxes.CORNERS).toDF(*on, "det_id", "score", *boxes.CORNERS).groupBy(*on)
    return a.cogroup(b).applyInPandas(run, kinds)
