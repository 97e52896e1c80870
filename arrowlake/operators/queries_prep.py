"""Preparation of query, question and frame tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .datasets import seeded


def add_prefix_suffix(queries: DataFrame, prefix: str, suffix: str, only: list[str] | None = None) -> DataFrame:
    """Query texts with a prefix and a suffix, all or only listed ones; ``geometric`` stays as it is."""
    text = F.col("query_text")
    changes = (text != "geometric") & (text.isin(*only) if only is not None else F.lit(True))
    return queries.withColumn("query_text", F.when(changes, F.concat(F.lit(prefix), text, F.lit(suffix))).otherwise(text))


def cap_queries_video(queries: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` queries per video: those chosen on its first frame stay on every frame, by index."""
    first = queries.where("frame = 0")
    w = Window.partitionBy("video_id").orderBy(seeded(seed, "video_id", "idx"), "idx")
    kept = first.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).select("video_id", "idx")
    return queries.join(kept, ["video_id", "idx"], "left_semi")


def np_queries(videos: DataFrame, pairs: DataFrame, cats: DataFrame) -> DataFrame:
    """A row for every frame of every (video, noun phrase); ``agrees`` tells whether the phrase is its category's name."""
    frames = videos.select("video_id", F.posexplode("file_names").alias("frame", "file_name"))
    named = pairs.join(cats, "category_id").withColumn("agrees", F.col("noun_phrase") == F.col("name"))
    return named.join(frames, "video_id").select("video_id", "category_id", "noun_phrase", "frame", "file_name", "agrees")


def qa_tasks(samples: DataFrame, questions: dict[str, str], triplets: DataFrame) -> DataFrame:
    """(image_id, task, question, gold, block): a wide sample's questions as rows, with its image's triplet block.

    ``questions`` maps a task to the column of its question; the gold answer is in the column of the same name with
    ``_gt``. Blank questions are skipped, and samples without an image.
    """
    rows = F.array(*[F.struct(F.lit(t).alias("task"), F.col(c).alias("question"), F.col(f"{c}_gt").cast("string").alias("gold")) for t, c in questions.items()])
    long = samples.where("image_id IS NOT NULL").select("image_id", F.explode(rows).alias("q")).select("image_id", "q.*").where(F.coalesce(F.trim("question"), F.lit("")) != "")
    line = F.concat(F.lit("<"), "src", F.lit(", "), "rel", F.lit(", "), "dst", F.lit(">"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", line.alias("line"))))
    blocks = triplets.groupBy("image_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("block"))
    return long.join(blocks, "image_id", "left").withColumn("block", F.coalesce("block", F.lit("")))


def stroke_boxes(points: DataFrame, groups: DataFrame, size: float = 1333, pad: float = 20) -> DataFrame:
    """Pixel boxes of stroke groups: (diagram_id, stroke_id, x, y) points and (diagram_id, group_id, stroke_id) members.

    Each diagram is scaled so that its longer side fits ``size`` less the padding on both sides; corners are cut
    to whole pixels.
    """
    ext = points.groupBy("diagram_id").agg(F.min("x").alias("lx"), F.min("y").alias("ly"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("span"))
    scale = F.coalesce(F.try_divide(F.lit(size - 2 * pad), "span"), F.lit(1.0))
    box = points.join(groups, ["diagram_id", "stroke_id"]).groupBy("diagram_id", "group_id").agg(*[f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    px = lambda c, low: ((F.col(c) - F.col(low)) * scale + pad).cast("int")
    return box.join(ext, "diagram_id").select("diagram_id", "group_id", px("lox", "lx").alias("x1"), px("loy", "ly").alias("y1"), px("hix", "lx").alias("x2"), px("hiy", "ly").alias("y2"))


def flowchart_graph(nodes: DataFrame, arrows: DataFrame) -> DataFrame:
    """Arrow ends as texts, ``No Text`` for blank ones; diagrams in which every node is blank are dropped."""
    text = F.trim(F.coalesce("text", F.lit("")))
    live = nodes.groupBy("graph_id").agg(F.bool_or(text != "").alias("any")).where("any").select("graph_id")
    named = lambda c: nodes.select("graph_id", F.col("node_id").alias(c), F.when(text != "", text).otherwise("No Text").alias(f"{c}_text"))
    rows = arrows.join(live, "graph_id", "left_semi").join(named("s"), ["graph_id", "s"]).join(named("d"), ["graph_id", "d"])
    return rows.select("graph_id", "arrow_id", F.col("s_text").alias("src"), F.col("d_text").alias("dst"))


def preds_to_frames(preds: DataFrame, images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, unknown): visible boxes of predicted tracks (arrays ``boxes`` of (x, y, w, h) and ``areas``) with the image
    of their frame, and those whose frame isn't known. An area that is missing or not positive is w * h."""
    rows = preds.select("video_id", "track_id", F.posexplode(F.arrays_zip("boxes", "areas")).alias("frame", "b")).select("video_id", "track_id", "frame", "b.boxes.*", F.col("b.areas").alias("area"))
    rows = rows.where("x <> 0 OR y <> 0 OR w <> 0 OR h <> 0").withColumn("area", F.when(F.col("area") > 0, F.col("area")).otherwise(F.col("w") * F.col("h")))
    known = images.select("video_id", "frame", "image_id")
    return rows.join(known, ["video_id", "frame"]), rows.join(known, ["video_id", "frame"], "left_anti")


def video_np_scores(counts: DataFrame) -> DataFrame:
    """Per (video_id, category_id): mean F1 over thresholds, and F1 at 0.5 and 0.75; 1 where there is nothing to find or found."""
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(1.0))
    at = lambda t: F.max(F.when(F.abs(F.col("threshold") - t) < 1e-9, F.col("f1")))
    return counts.withColumn("f1", f1).groupBy("video_id", "category_id").agg(F.avg("f1").alias("f1_mean"), at(0.5).alias("f1_50"), at(0.75).alias("f1_75"))


def first_points(arrows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Triplets of arrows whose fields are arrays: the first element of each; graph ids renamed by ``names`` (from, to) where listed."""
    out = arrows.select("graph_id", *[F.get(c, F.lit(0)).alias(c) for c in ("src", "rel", "dst")]).where("src IS NOT NULL AND dst IS NOT NULL")
    if names is not None:
        out = out.join(names.toDF("graph_id", "to"), "graph_id", "left").withColumn("graph_id", F.coalesce("to", "graph_id")).drop("to")
    return out.distinct()


def remap_class_agnostic(gt: DataFrame, dt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with one category; gold track ids are renumbered from 1 by first appearance (frame, then id) in their video."""
    first = gt.groupBy("video_id", "track_id").agg(F.min("frame").alias("first"))
    ids = first.withColumn("new_id", F.row_number().over(Window.partitionBy("video_id").orderBy("first", "track_id"))).drop("first")
    one = F.lit(1).cast("long")
    return gt.join(ids, ["video_id", "track_id"]).withColumn("category_id", one), dt.withColumn("category_id", one)


def ytvis_tracks(tracks: DataFrame) -> DataFrame:
    """Tracks with array columns ``boxes`` and ``areas``: null boxes as zeros, null areas as 0, the track's area as the mean over all frames."""
    zero = F.array(*[F.lit(0.0)] * 4)
    out = tracks.withColumns({"boxes": F.transform("boxes", lambda b: F.coalesce(b, zero)), "areas": F.transform("areas", lambda a: F.coalesce(a, F.lit(0.0)))})
    return out.withColumn("area", F.when(F.size("areas") > 0, F.aggregate("areas", F.lit(0.0), lambda s, a: s + a) / F.size("areas")).otherwise(0.0))


def _lucky(p: float, seed: int) -> Column:
    """True for a share ``p`` of the queries, by a seeded hash."""
    return F.pmod(seeded(seed + 1, "image_id", "query_id"), F.lit(1_000_000)) < int(p * 1_000_000)


def rewrite_queries(queries: DataFrame, objects: DataFrame, p: float, seed: int = 42, keep_text: bool = False, text: str = "visual") -> DataFrame:
    """With probability ``p`` (by a seeded hash) a text query of the first stage that has a target and no box becomes a box
    query of one of its targets, chosen by hash, named ``text`` unless ``keep_text``; all others stay."""
    pick = seeded(seed, "image_id", "query_id", "box_id")
    chosen = queries.join(objects, ["image_id", "category_id"]).groupBy("image_id", "query_id").agg(F.min_by(F.struct("x1", "y1", "x2", "y2"), F.struct(pick, "box_id")).alias("target"))
    out = queries.join(chosen, ["image_id", "query_id"], "left")
    turns = _lucky(p, seed) & (F.col("stage") == 0) & F.col("input_box").isNull() & F.col("target").isNotNull()
    new = {"input_box": F.when(turns, F.col("target")).otherwise(F.col("input_box"))}
    if not keep_text:
        new["query_text"] = F.when(turns, text).otherwise(F.col("query_text"))
    return out.withColumns(new).drop("target")


def drop_input_boxes(queries: DataFrame) -> DataFrame:
    """Queries without their input boxes."""
    return queries.withColumn("input_box", F.lit(None).cast(queries.schema["input_box"].dataType))


def overwrite_text(queries: DataFrame, text: str, p: float = 1.0, seed: int = 42) -> DataFrame:
    """With probability ``p`` (by a seeded hash) a query's text is ``text``."""
    return queries.withColumn("query_text", F.when(_lucky(p, seed), text).otherwise(F.col("query_text")))
