"""The video rules and resumption as streams; each twin is that of the batch operator."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import CORNERS
from ..operators import video as v
from ..operators.tracks import cornered
from ..plans.materialize import shared_folder
from ..registry import ORACLE_SQL, query
from ..streaming import resume as rs
from ..streaming import video as sv


def timed(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.timestamp_seconds(F.col("frame") + 1))


@query("k4_delayed_emit_stream", "fx_track_frames")
def emitted(g: DataFrame) -> DataFrame:
    removed = g.where("track_id % 4 = 0").groupBy("video_id", "track_id").agg((F.min("frame") + 6).alias("frame"))
    shown = g.select("video_id", "track_id", "frame", F.lit(False).alias("removed"))
    events = timed(shown.unionByName(removed.withColumn("removed", F.lit(True))))
    rule = sv.DelayedEmit(5, 100_000)
    return sv.replayed(events, lambda s: sv.over_frames(s, rule), rule.output).select("video_id", "track_id", "frame", "emitted_at")


ORACLE_SQL["k4_delayed_emit_stream"] = ORACLE_SQL["k4_delayed_emit"]


def sightings(g: DataFrame) -> DataFrame:
    """Matches of tracks with detections: four detections a frame, a fifth of the tracks' frames unmatched."""
    return g.select("video_id", "frame", "track_id", (F.col("track_id") % 4).alias("det_id"), ((F.col("track_id") + F.col("frame")) % 5 != 0).alias("matched"))


REMOVED = """WITH m AS (SELECT video_id, frame, track_id % 4 AS det_id, track_id, (track_id + frame) % 5 <> 0 AS matched, min(frame) OVER (PARTITION BY video_id, track_id) AS first_frame FROM {fx_track_frames}),
u AS (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame) AS n FROM m WHERE NOT matched AND frame < first_frame + 15),
o AS (SELECT *, first(track_id) OVER w AS older, row_number() OVER w AS place FROM m WHERE matched WINDOW w AS (PARTITION BY video_id, frame, det_id ORDER BY first_frame, track_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY video_id, older, track_id ORDER BY frame, det_id) AS n FROM o WHERE place > 1),
a AS (SELECT video_id, track_id, frame, 'unmatched' AS reason, 0 AS k FROM u WHERE n = 2 UNION ALL SELECT video_id, track_id, frame, 'duplicate', 1 FROM p WHERE n = 3 AND first_frame > frame - 15)
SELECT video_id, track_id, frame AS removed_at, reason FROM (SELECT *, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame, k) AS r FROM a) q WHERE r = 1"""


@query("k3_hotstart_removed", "fx_track_frames", sql=REMOVED)
def removed(g: DataFrame) -> DataFrame:
    return v.hotstart_removed(sightings(g), 15, 2, 3)


@query("k3_hotstart_stream", "fx_track_frames", sql=REMOVED)
def removed_stream(g: DataFrame) -> DataFrame:
    rule = sv.HotStart(15, 2, 3, 1000)
    return sv.replayed(timed(sightings(g)), lambda s: sv.over_frames(s, rule), rule.output)


@query("k6_recently_occluded_stream", "fx_track_frames")
def occluded(g: DataFrame) -> DataFrame:
    rows = cornered(g).select("video_id", "frame", "track_id", ((F.col("frame") + F.col("track_id")) % 5 == 0).alias("empty"), *CORNERS)
    rule = sv.RecentlyOccludedBoxes(1000, 0.2)
    return sv.replayed(timed(rows), lambda s: sv.over_frames(s, rule), rule.output)


@query("k5_resume_stream", "fx_qa", sql="SELECT image_id, question_no FROM {fx_qa} WHERE predicted = 'unclear' AND question_no % 3 <> 1")
def left(q: DataFrame) -> DataFrame:
    """Answers arrive in three parts; unclear ones are blank at first, and a third of them is answered later."""
    spark, keys = q.sparkSession, ["image_id", "question_no"]
    folder = f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"
    first = q.select(*keys, F.when(F.col("predicted") != "unclear", F.col("predicted")).otherwise(" ").alias("answer"), F.lit(1).cast("long").alias("seq"))
    later = q.where("predicted = 'unclear' AND question_no % 3 = 1").select(*keys, F.lit("yes").alias("answer"), F.lit(2).cast("long").alias("seq"))
    for part in (first.where("image_id % 2 = 0"), first.where("image_id % 2 = 1"), later):
        part.write.mode("append").parquet(f"{folder}/in")
        rs.upsert_stream(spark.readStream.schema(part.schema).parquet(f"{folder}/in"), f"{folder}/table", f"{folder}/state", keys, "seq").awaitTermination()
    answers = rs.current(spark, f"{folder}/table", "image_id long, question_no long, answer string, seq long", keys)
    return rs.left_to_do(q.select(*keys), answers, keys, "answer")
