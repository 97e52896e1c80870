"""Answers that arrive as a stream, kept so that a run can go on where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

BATCH = "batch"


def upsert(batch: DataFrame, number: int, folder: str, keys: list[str], order: str) -> None:
    """Writes a batch of answers under its number: the last row of each key by ``order`` (ties to the greatest row).
    A batch that is written again replaces itself, so a replay changes nothing."""
    rest = [c for c in batch.columns if c not in keys]
    latest = batch.groupBy(*keys).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("row"))
    latest.select(*keys, "row.*").write.mode("overwrite").parquet(f"{folder}/{BATCH}={number}")


def upsert_stream(answers: DataFrame, folder: str, checkpoint: str, keys: list[str], order: str) -> StreamingQuery:
    """Starts the upsert of a stream of answers, for all input there is now."""
    writer = answers.writeStream.foreachBatch(lambda batch, number: upsert(batch, number, folder, keys, order))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str, schema: str, keys: list[str]) -> DataFrame:
    """The latest answer of each key: that of the highest batch number. A folder not yet written has none."""
    try:
        rows = spark.read.option("basePath", folder).schema(f"{schema}, {BATCH} long").parquet(folder)
    except AnalysisException:
        return spark.createDataFrame([], schema)
    rest = [c for c in rows.columns if c not in (*keys, BATCH)]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), BATCH).alias("row"))
    return newest.select(*keys, "row.*")


def left_to_do(todo: DataFrame, answers: DataFrame, keys: list[str], *filled: str) -> DataFrame:
    """Keys without an answer, or with one in which all of ``filled`` are blank."""
    text = [F.trim(F.coalesce(F.col(c), F.lit(""))) != "" for c in filled]
    some = text[0]
    for t in text[1:]:
        some = some | t
    return todo.join(answers.where(some).select(*keys).distinct(), keys, "left_anti")


def compacted(spark: SparkSession, folder: str, schema: str, keys: list[str], into: str) -> None:
    """The latest answers written as batch 0 of another folder; later batches may go on there."""
    current(spark, folder, schema, keys).write.mode("overwrite").parquet(f"{into}/{BATCH}=0")
