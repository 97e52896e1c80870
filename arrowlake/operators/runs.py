"""Question accuracy, judge votes and the choice of training runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.transcripts import parse_int, parse_yes_no


def qa_accuracy(qa: DataFrame) -> DataFrame:
    """correct, total and unparsed answers by sub-task, task and overall; unknown sub-tasks are left out."""
    counted = F.col("sub_task").isin("Num_Nodes", "Num_Arrows")
    arrow = F.col("sub_task").rlike(r"^Flowchart-is(True|False)-(AtoB|betweenAB)$")
    parsed = F.when(counted, parse_int(F.col("predicted")).cast("string")).otherwise(parse_yes_no(F.col("predicted")))
    task = F.when(counted, F.col("sub_task")).otherwise(F.concat(F.lit("Arrow_"), F.regexp_extract("sub_task", "[^-]+$", 0)))
    rows = qa.where(counted | arrow).select("sub_task", task.alias("task"), parsed.alias("parsed"), F.col("gt"))
    out = rows.groupingSets([["task", "sub_task"], ["task"], []], "task", "sub_task").agg(
        F.count_if(F.col("parsed") == F.col("gt")).alias("correct"), F.count("*").alias("total"), F.count_if(F.col("parsed").isNull()).alias("unparsed")
    )
    names = {c: F.coalesce(c, F.lit("all")) for c in ("task", "sub_task")}
    return out.withColumns(names).withColumn("accuracy", F.col("correct") / F.col("total"))


def judge_votes(votes: DataFrame) -> DataFrame:
    """Per question the label with most votes (ties: smallest), right if at least half of the judges, rounded up, agree."""
    sums = votes.groupBy("image_id", "question_no", "label").agg(F.sum("vote").alias("votes"), F.count("*").alias("n"), F.first("predicted").alias("predicted"))
    w = Window.partitionBy("image_id", "question_no").orderBy(F.desc("votes"), "label")
    top = sums.withColumn("r", F.row_number().over(w)).where("r = 1")
    right = (F.coalesce("predicted", F.lit("")) != "") & F.col("label").isNotNull() & (F.col("votes") >= F.floor((F.col("n") + 1) / 2))
    return top.select("image_id", "question_no", "label", "votes", right.alias("correct"))


def best_run(runs: DataFrame) -> DataFrame:
    """Per model and data set the run of lowest loss; ties to the smaller batch, then the earlier step."""
    w = Window.partitionBy("model_id", "dataset_id").orderBy("eval_loss", "bs", "step")
    return runs.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def best_epoch(epochs: DataFrame, key: str) -> DataFrame:
    """Per data set the step of highest mean of the three average precisions; ties to the earlier."""
    mean = (F.col("ap") + F.col("ap50") + F.col("ap75")) / 3
    w = Window.partitionBy(key).orderBy(F.desc("mean_ap"), "step")
    return epochs.select(key, "step", mean.alias("mean_ap")).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def modal_batch(runs: DataFrame, devices: int) -> DataFrame:
    """For each data set the commonest batch size among the others, the smaller on ties, and that times ``devices``.

    Counts per data set are taken from the totals, so the runs themselves are read once and never multiplied.
    """
    counts = runs.groupBy("dataset_id", "bs").agg(F.count("*").alias("own"))
    totals = counts.groupBy("bs").agg(F.sum("own").alias("all"))
    targets = counts.select(F.col("dataset_id").alias("target")).distinct()
    others = targets.join(totals).join(counts.withColumnRenamed("dataset_id", "target"), ["target", "bs"], "left")
    others = others.withColumn("n", F.col("all") - F.coalesce("own", F.lit(0))).where("n > 0")
    w = Window.partitionBy("target").orderBy(F.desc("n"), "bs")
    return others.withColumn("r", F.row_number().over(w)).where("r = 1").select("target", "bs", (F.col("bs") * devices).alias("global_batch"))


def latency_summary(workers: DataFrame) -> DataFrame:
    """Wall time is the slowest worker's; observed throughput is over wall time, ideal the sum of the workers' own."""
    return workers.agg(
        F.count("*").alias("workers"),
        F.sum("images").alias("images"),
        F.max("seconds").alias("wall_s"),
        (F.sum("seconds") / F.sum("images")).alias("mean_s_per_image"),
        (F.sum("images") / F.max("seconds")).alias("observed_per_s"),
        F.sum(F.col("images") / F.col("seconds")).alias("ideal_per_s"),
    )
