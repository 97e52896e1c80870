"""Video rules over streams of frames: hot start, delayed emission and occlusion, as twins of the batch operators.

Rows come as (video_id, frame, ts, track_id, ...), frames of a video at rising times ``ts``, which lie
after 1970 (Spark's first watermark). A video's rows wait until
the watermark passes their frame, which is then complete; so rows of a frame may arrive in any order and over many
batches. A row that arrives after that is late and dropped. State lies under the video and is written a batch at a
time: it survives restarts, and is bounded by what each rule says.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..operators.frame_pairs import occluded_by_older
from ..plans.materialize import shared_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FrameByFrame(StatefulProcessor):
    """Hands a video's complete frames to ``closed``, in order. ``fields``: the rows' columns beside key and time."""

    fields = "track_id long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = [x.split()[0] for x in self.fields.split(", ")]
        self.waiting = handle.getListState("waiting", f"frame long, at_ms long, {self.fields}")
        self.opened(handle)

    def opened(self, handle: StatefulProcessorHandle) -> None:
        """Declares the rule's own state."""

    def closed(self, video: int, frames: list[tuple[int, int, list[Row]]], watermark: int) -> Iterator[Row]:
        """Rows out of complete frames (frame, time, rows); without frames when a timer of the rule's own is due."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = [(r.frame, r.at_ms, *(r[c] for c in self.names)) for r in rows]
        self.waiting.appendList(held)
        for at in {x[1] for x in held}:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        watermark, kind = timerValues.getCurrentWatermarkInMs(), Row("frame", "at_ms", *self.names)
        held = [kind(*x) for x in self.waiting.get()] if self.waiting.exists() else []
        ready = sorted((x for x in held if x.at_ms <= watermark), key=lambda x: (x.frame, x.track_id is not None, x.track_id))
        if ready:
            rest = [tuple(x) for x in held if x.at_ms > watermark]
            self.waiting.put(rest) if rest else self.waiting.clear()
        frames = [(frame, own[0].at_ms, own) for frame, own in ((f, list(g)) for f, g in groupby(ready, key=lambda x: x.frame))]
        yield from self.closed(key[0], frames, watermark)

    def close(self) -> None:
        pass


class DelayedEmit(FrameByFrame):
    """Frames leave a buffer of ``delay`` frames without the tracks removed by then; rows with ``removed`` say that a
    track is removed from their frame on. ``idle_ms`` after its last frame a video is over: the rest goes out and its
    state is cleared. State: the rows of at most ``delay`` frames, and one number a removed track."""

    fields = "track_id long, removed boolean"
    output = "video_id long, track_id long, frame long, emitted_at long"

    def __init__(self, delay: int, idle_ms: int) -> None:
        self.delay, self.idle_ms = max(delay, 1), idle_ms

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.buffer = handle.getListState("buffer", "frame long, track_id long")
        self.gone = handle.getMapState("gone", "track_id long", "removed_at long")
        self.last = handle.getValueState("last", "frame long, at_ms long")

    def closed(self, video: int, frames: list, watermark: int) -> Iterator[Row]:
        held = [tuple(x) for x in self.buffer.get()] if self.buffer.exists() else []
        last = tuple(self.last.get()) if self.last.exists() else None
        before = last
        for frame, at, rows in frames:
            for r in rows:
                if r.removed and not self.gone.containsKey((r.track_id,)):
                    self.gone.updateValue((r.track_id,), (frame,))
            shown = [(frame, r.track_id) for r in rows if not r.removed]
            if shown:
                held, last = held + shown, (frame, at)
                order = sorted({f for f, _ in held})
                if len(order) >= self.delay:
                    yield from self._out(video, [x for x in held if x[0] == order[0]], frame)
                    held = [x for x in held if x[0] != order[0]]
        if last is not None and watermark >= last[1] + self.idle_ms:
            yield from self._out(video, held, last[0])
            for state in (self.buffer, self.gone, self.last):
                state.clear()
        elif frames and last is not None:
            self.buffer.put(held) if held else self.buffer.clear()
            self.last.update(last)
            if last != before:
                self.handle.registerTimer(last[1] + self.idle_ms)

    def _out(self, video: int, rows: list[tuple[int, int]], now: int) -> Iterator[Row]:
        for frame, track in rows:
            gone = self.gone.getValue((track,)) if self.gone.containsKey((track,)) else None
            if gone is None or gone[0] > now:
                yield Row(video_id=video, track_id=track, frame=frame, emitted_at=now)


class HotStart(FrameByFrame):
    """Tracks removed while new, within ``delay`` frames of their first: those unmatched in ``misses`` frames, and those
    that share a detection with an older track for the ``times``-th time. A track is reported once.

    State: three values a track and one a pair of tracks. A pair goes when the younger leaves its hot start, a track
    when it has not been seen for ``forget`` frames since; an id that comes back later is a new track.
    """

    fields = "track_id long, det_id long, matched boolean"
    output = "video_id long, track_id long, removed_at long, reason string"

    def __init__(self, delay: int, misses: int, times: int, forget: int) -> None:
        self.delay, self.misses, self.times, self.forget = delay, misses, times, forget

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.tracks = handle.getMapState("tracks", "track_id long", "first long, missed long, seen long, removed boolean")
        self.pairs = handle.getMapState("pairs", "older long, track_id long", "n long")

    def closed(self, video: int, frames: list, watermark: int) -> Iterator[Row]:
        if not frames:
            return
        known = {k[0]: list(v) for k, v in self.tracks.iterator()} if self.tracks.exists() else {}
        pairs = {tuple(k): v[0] for k, v in self.pairs.iterator()} if self.pairs.exists() else {}
        stored = set(known), set(pairs)
        for frame, _, rows in frames:
            for track in [t for t, x in known.items() if x[0] <= frame - self.delay and x[2] < frame - self.forget]:
                del known[track]
            found: dict[int, str] = {}
            for track in dict.fromkeys(r.track_id for r in rows):
                known.setdefault(track, [frame, 0, frame, False])[2] = frame
            young = {t for t in {r.track_id for r in rows} if known[t][0] > frame - self.delay}
            for r in rows:
                if not r.matched and r.track_id in young:
                    known[r.track_id][1] += 1
                    if known[r.track_id][1] == self.misses:
                        found.setdefault(r.track_id, "unmatched")
            shared: dict[int, list[int]] = {}
            for r in rows:
                if r.matched and r.det_id is not None:
                    shared.setdefault(r.det_id, []).append(r.track_id)
            for det in sorted(shared):
                own = sorted(shared[det], key=lambda t: (known[t][0], t))
                for track in own[1:]:
                    if track in young:
                        pairs[own[0], track] = pairs.get((own[0], track), 0) + 1
                        if pairs[own[0], track] == self.times:
                            found.setdefault(track, "duplicate")
            for track in sorted(found):
                if not known[track][3]:
                    known[track][3] = True
                    yield Row(video_id=video, track_id=track, removed_at=frame, reason=found[track])
        now = frames[-1][0]
        pairs = {k: n for k, n in pairs.items() if k[1] in known and known[k[1]][0] > now - self.delay}
        for track in stored[0] - set(known):
            self.tracks.removeKey((track,))
        for pair in stored[1] - set(pairs):
            self.pairs.removeKey(pair)
        for track, value in known.items():
            self.tracks.updateValue((track,), tuple(value))
        for pair, n in pairs.items():
            self.pairs.updateValue(pair, (n,))


class RecentlyOccluded(FrameByFrame):
    """Of two tracks that overlap (``others``: those a track overlaps), the one occluded more recently is suppressed, if
    the other was ever occluded. Empty and suppressed frames are occlusions.

    State: two numbers a track; a track not seen for ``forget`` frames is forgotten.
    """

    fields = "track_id long, empty boolean, others array<bigint>"
    output = "video_id long, frame long, track_id long, empty boolean, suppressed boolean"

    def __init__(self, forget: int) -> None:
        self.forget = forget

    def lost(self, rows: list[Row], last: dict[int, int]) -> list[bool]:
        """Which rows of a frame are suppressed, by the tracks' last occlusions."""
        return [any(-1 < last.get(o, -1) < last.get(r.track_id, -1) for o in r.others or ()) for r in rows]

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.tracks = handle.getMapState("tracks", "track_id long", "occluded long, seen long")

    def closed(self, video: int, frames: list, watermark: int) -> Iterator[Row]:
        if not frames:
            return
        known = {k[0]: tuple(v) for k, v in self.tracks.iterator()} if self.tracks.exists() else {}
        stored = set(known)
        for frame, _, rows in frames:
            known = {t: x for t, x in known.items() if x[1] >= frame - self.forget}
            last = {t: x[0] for t, x in known.items()}
            for r, lost in zip(rows, self.lost(rows, last), strict=True):
                mine = last.get(r.track_id, -1)
                known[r.track_id] = (frame if lost or r.empty else mine, frame)
                yield Row(video_id=video, frame=frame, track_id=r.track_id, empty=r.empty, suppressed=lost)
        for track in stored - set(known):
            self.tracks.removeKey((track,))
        for track, value in known.items():
            self.tracks.updateValue((track,), value)


class RecentlyOccludedBoxes(RecentlyOccluded):
    """The same from the boxes themselves: two overlap from an IoU of ``least`` on. Neither rows nor state hold pairs."""

    fields = "track_id long, empty boolean, x1 double, y1 double, x2 double, y2 double"

    def __init__(self, forget: int, least: float) -> None:
        super().__init__(forget)
        self.least = least

    def lost(self, rows: list[Row], last: dict[int, int]) -> list[bool]:
        corners = np.array([[r.x1, r.y1, r.x2, r.y2] for r in rows], float)
        return occluded_by_older(np.array([r.track_id for r in rows]), corners, last, self.least).tolist()


def over_frames(rows: DataFrame, rule: FrameByFrame, lateness: str = "0 seconds") -> DataFrame:
    """The stream of a rule's results over a stream of rows (video_id, frame, ts and the rule's fields). Frames are
    complete when the watermark, ``lateness`` behind the latest time seen, has passed them."""
    names = [x.split()[0] for x in rule.fields.split(", ")]
    timed = rows.withWatermark("ts", lateness).select("video_id", "frame", "ts", F.unix_millis("ts").alias("at_ms"), *names)
    return timed.groupBy("video_id").transformWithState(rule, rule.output, "append", "eventTime")


@contextmanager
def rocksdb(spark: SparkSession):
    """The session's state store set to the one that list and map states need, for the streams started inside."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def replayed(rows: DataFrame, stream: Callable[[DataFrame], DataFrame], output: str, parts: int = 3, order: str = "ts") -> DataFrame:
    """What a stream makes of a table that arrives in parts of rising ``order``: the query is started anew for each part, over
    the same checkpoint, and at last the watermark moves past all rows."""
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/replay-{uuid.uuid4().hex}"
    seconds = rows.select(F.unix_seconds(order).alias("s"))
    cuts = sorted(set(seconds.approxQuantile("s", [i / parts for i in range(1, parts)], 0.01)))
    at, last = F.unix_seconds(F.col(order)), seconds.agg(F.max("s")).first()[0]
    bounds = [None, *cuts, None]
    pieces = [rows.where((F.lit(True) if a is None else at > a) & (F.lit(True) if b is None else at <= b)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    empty = {c: F.lit(None).cast(t) for c, t in rows.dtypes}
    for i in range(2 if last is not None else 0):  # a video of its own, far later
        end = spark.range(1).select(*[(F.timestamp_seconds(F.lit(last + (i + 1) * 1_000_000)) if c == order else F.lit(-1).cast("long") if c in ("video_id", "frame") else v).alias(c) for c, v in empty.items()])
        pieces.append(end)
    with rocksdb(spark):
        for piece in pieces:
            piece.write.mode("append").parquet(f"{folder}/in")
            source = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
            query = stream(source).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
            query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(output).parquet(f"{folder}/out").where("video_id <> -1")
