"""Streams of frames against their batch twins, with restarts, late rows and bounded state."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from arrowlake.operators import video as v
from arrowlake.streaming import resume as rs
from arrowlake.streaming import video as sv

def ts():
    return F.timestamp_seconds(F.col("frame") + 1).alias("ts")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frames(spark, rng, videos=4, tracks=5, length=24):
    rows = [(video, t, f) for video in range(videos) for t in range(tracks) for f in range(rng.randint(0, 5), length) if rng.random() < 0.8]
    return spark.createDataFrame(rows, "video_id long, track_id long, frame long")


def test_delayed_emission_equals_the_batch(spark):
    table = frames(spark, random.Random(1))
    removed = table.where("track_id % 2 = 0").groupBy("video_id", "track_id").agg((F.min("frame") + 4).alias("removed_at"))
    events = table.select("video_id", "frame", ts(), "track_id", F.lit(False).alias("removed")).unionByName(
        removed.select("video_id", F.col("removed_at").alias("frame"), F.timestamp_seconds(F.col("removed_at") + 1).alias("ts"), "track_id", F.lit(True).alias("removed"))
    )
    for delay in (1, 5, 100):
        rule = sv.DelayedEmit(delay, 100_000)
        out = sv.replayed(events, lambda s: sv.over_frames(s, rule), rule.output)
        assert rows_of(out.select("video_id", "track_id", "frame", "emitted_at")) == rows_of(v.delayed_emit(table, removed, delay).select("video_id", "track_id", "frame", "emitted_at"))


def matches(spark, rng):
    rows = []
    for video in range(4):
        for track in range(8):
            start = rng.randint(0, 12)
            rows += [(video, f, track, rng.randint(0, 3), rng.random() < 0.6) for f in range(start, 25) if rng.random() < 0.9]
    return spark.createDataFrame(rows, "video_id long, frame long, track_id long, det_id long, matched boolean")


def test_hot_start_equals_the_batch(spark):
    table = matches(spark, random.Random(2))
    rule = sv.HotStart(delay=8, misses=3, times=2, forget=50)
    out = sv.replayed(table.withColumn("ts", ts()), lambda s: sv.over_frames(s, rule), rule.output)
    want = rows_of(v.hotstart_removed(table, 8, 3, 2))
    assert want and rows_of(out) == want


def test_occlusion_equals_the_batch(spark):
    rng = random.Random(3)
    table = frames(spark, rng).withColumn("empty", (F.col("frame") * 7 + F.col("track_id") * 3) % 4 == 0)
    held = [(r.video_id, r.frame, r.track_id) for r in table.collect()]
    near = [(a[0], a[1], a[2], b[2]) for a in held for b in held if a[:2] == b[:2] and a[2] < b[2] and rng.random() < 0.4]
    overlaps = spark.createDataFrame(near, "video_id long, frame long, one long, two long")
    rule = sv.RecentlyOccluded(forget=1000)
    source = v.overlapping(table, overlaps).withColumn("ts", ts())
    out = sv.replayed(source, lambda s: sv.over_frames(s, rule), rule.output)
    want = rows_of(v.suppress_recently_occluded(table, overlaps))
    assert any(r[-1] for r in want) and rows_of(out) == want


def test_late_rows_are_dropped_and_early_ones_wait(spark, tmp_path):
    rule = sv.DelayedEmit(1, 10_000)
    kind = "video_id long, frame long, ts timestamp, track_id long, removed boolean"

    def put(*rows):
        spark.createDataFrame([(*r, False) for r in rows], "video_id long, frame long, track_id long, removed boolean").withColumn("ts", ts()).select("video_id", "frame", "ts", "track_id", "removed").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        with sv.rocksdb(spark):
            out = sv.over_frames(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), rule, "2 seconds")
            out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return rows_of(spark.read.parquet(f"{tmp_path}/out").select("video_id", "frame", "track_id"))

    put((1, 3, 7), (1, 1, 7), (1, 2, 7))  # in any order
    assert put((1, 4, 7), (1, 3, 8)) == [(1, 1, 7), (1, 2, 7)]  # frame 3 is still open: track 8 is in time
    put((1, 9, 7))
    seen = put((1, 2, 9), (1, 30, 7))  # frame 2 is over: track 9 is late
    seen = put((2, 60, 1))
    assert (1, 3, 8) in seen and (1, 2, 9) not in seen and (1, 9, 7) in seen


class Memory:
    """State kept in a dictionary, to look into."""

    def __init__(self):
        self.held = {}

    def exists(self):
        return bool(self.held)

    def iterator(self):
        return iter([(k, v) for k, v in self.held.items()])

    def updateValue(self, key, value):  # noqa: N802
        self.held[tuple(key)] = value

    def removeKey(self, key):  # noqa: N802
        del self.held[tuple(key)]


@pytest.mark.parametrize("rule", [sv.HotStart(5, 3, 2, 10), sv.RecentlyOccluded(10)])
def test_state_stays_bounded(rule):
    class Handle:
        def getListState(self, *_):  # noqa: N802
            return Memory()

        getMapState = getListState  # noqa: N815

    rule.init(Handle())
    from pyspark.sql import Row

    most = 0
    for frame in range(400):
        tracks = range(frame // 2, frame // 2 + 3)  # a new track every other frame
        rows = [Row(frame=frame, at_ms=frame, track_id=t, det_id=0, matched=True, empty=t % 2 == 0, others=[x for x in tracks if x != t]) for t in tracks]
        list(rule.closed(1, [(frame, frame, rows)], frame))
        most = max(most, len(rule.tracks.held) + (len(rule.pairs.held) if hasattr(rule, "pairs") else 0))
    assert most < 40


def test_resume_upserts_once(spark, tmp_path):
    kind, keys = "image_id long, answer string, raw string, seq long", ["image_id"]
    source, folder, state = (f"{tmp_path}/{x}" for x in ("in", "table", "state"))
    todo = spark.range(6).withColumnRenamed("id", "image_id")

    def arrive(*rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(source)
        rs.upsert_stream(spark.readStream.schema(kind).parquet(source), folder, state, keys, "seq").awaitTermination()

    def left():
        return [r[0] for r in rs.left_to_do(todo, rs.current(spark, folder, kind, keys), keys, "answer", "raw").orderBy("image_id").collect()]

    assert left() == [0, 1, 2, 3, 4, 5]
    arrive((0, "a", None, 1), (1, " ", "", 1), (2, None, "raw", 1), (0, "b", None, 2))
    assert left() == [1, 3, 4, 5]
    arrive((1, "late", None, 3), (3, "", None, 3))
    assert left() == [3, 4, 5]
    before = rows_of(rs.current(spark, folder, kind, keys))
    assert (0, "b", None, 2) in [(r[0], *sorted_row) for r in rs.current(spark, folder, kind, keys).collect() for sorted_row in [(r.answer, r.raw, r.seq)]]
    shutil.rmtree(f"{state}/commits")  # the last batch was written but not committed: it is replayed
    arrive((4, "x", None, 4))
    again = rows_of(rs.current(spark, folder, kind, keys))
    assert [r for r in again if r[0] != 4] == before and left() == [3, 5]
    rs.compacted(spark, folder, kind, keys, f"{tmp_path}/small")
    assert rows_of(rs.current(spark, f"{tmp_path}/small", kind, keys)) == again
