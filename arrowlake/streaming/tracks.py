"""Track confirmation over a stream of per-frame matches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.materialize import shared_folder

MATCH = "video_id long, track_id long, frame long, matched boolean"
CONFIRMED = "video_id long, track_id long, confirmed_at long"


def _confirm(n: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, done = state.get if state.exists else (0, False)
        rows = pd.concat(list(batches)).sort_values("frame")
        found = []
        for frame, matched in zip(rows.frame, rows.matched, strict=True):
            run = run + 1 if matched else 0
            if run >= n and not done:
                done = True
                found.append(int(frame))
        state.update((run, done))
        yield pd.DataFrame({"video_id": key[0], "track_id": key[1], "confirmed_at": found})

    return step


def confirm_stream(matches: DataFrame, n: int = 3) -> DataFrame:
    """Each track once, at the first frame at which it has been matched ``n`` times on end; a miss starts over.

    State is two values per track. Frames of a track must arrive in order from batch to batch; within a batch they
    are sorted. A confirmed track stays so, and repeats nothing.
    """
    return matches.groupBy("video_id", "track_id").applyInPandasWithState(_confirm(n), CONFIRMED, "run int, done boolean", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, schema: str) -> DataFrame:
    """What ``stream`` gives for all input there is now, through a Parquet sink in the shared folder."""
    spark: SparkSession = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")


def confirm_available(matches: DataFrame, files: int = 4, n: int = 3) -> DataFrame:
    """``matches`` written in parts of rising frames, each dealt by track to many files, then confirmed as a stream that takes
    about a part a batch."""
    spark = matches.sparkSession
    folder = f"{shared_folder(spark)}/frames-{uuid.uuid4().hex}"
    ordered = matches.select("video_id", "track_id", "frame", "matched")
    cuts = ordered.approxQuantile("frame", [i / files for i in range(1, files)], 0.01)
    last, tasks = None, int(spark.conf.get("spark.sql.shuffle.partitions"))
    for cut in [*sorted(set(cuts)), None]:
        part = ordered if last is None else ordered.where(ordered.frame > last)
        (part if cut is None else part.where(ordered.frame <= cut)).repartition(tasks, "video_id", "track_id").write.mode("append").parquet(folder)
        last = cut
    return run_available(confirm_stream(spark.readStream.schema(MATCH).option("maxFilesPerTrigger", tasks).parquet(folder), n), CONFIRMED)
