"""Readers that put files in front of the parsers, and sinks for results, labels and COCO tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.queries_prep import first_points, ytvis_tracks
from . import triplets as t

TRACK = "struct<id:bigint,video_id:bigint,category_id:bigint,score:double,bboxes:array<array<double>>,areas:array<double>,iscrowd:int>"
TRACK_FILE = f"videos array<struct<id:bigint,width:double,height:double,length:bigint,file_names:array<string>>>, annotations array<{TRACK}>, categories array<struct<id:bigint,name:string>>"


def whole_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, text) of every file below ``path`` whose name matches ``glob``."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_predictions_dir(spark: SparkSession, root: str, located: bool = False) -> DataFrame:
    """Triplets of the ``arrow_triplets.json`` of each diagram folder."""
    return t.parse_predictions(whole_texts(spark, root, "arrow_triplets.json"), located)


def read_predictions_map(spark: SparkSession, path: str) -> DataFrame:
    """Triplets of a file that holds an object {image: [triplet]}."""
    return t.parse_predictions_map(whole_texts(spark, path))


def read_gt_tagged(spark: SparkSession, names: str, lines: str) -> DataFrame:
    """Triplets of a file of tagged lines; the line of the same number in ``names``, JSON with ``file_name``, names the diagram."""
    paired = t.pair_by_line(whole_texts(spark, names), whole_texts(spark, lines))
    name = F.coalesce(F.get_json_object("name", "$.file_name"), F.col("name"))
    return t.parse_tagged(paired.where("text <> ''").select(t.stem(name).alias("graph_id"), "text"))


def read_gt_angle(spark: SparkSession, root: str) -> DataFrame:
    """Triplets of one file of ``<s, r, t>`` lines per diagram, named by the file."""
    rows = whole_texts(spark, root, "*.txt").select(t.stem(F.col("path")).alias("graph_id"), F.explode(F.split("text", r"\r?\n")).alias("line"))
    return t.parse_angle(rows)


def _plain(arrows: DataFrame) -> DataFrame:
    return arrows.select("graph_id", F.col("source").alias("src"), F.col("condition").alias("rel"), F.col("target").alias("dst"), "source_loc", "target_loc")


def read_gt_points(spark: SparkSession, root: str) -> DataFrame:
    """Triplets of annotated arrows, the first of several texts at each end."""
    return first_points(_plain(t.read_arrows(spark, root)))


def read_gt_hier(spark: SparkSession, root: str, names: DataFrame | None = None) -> DataFrame:
    """``read_gt_points`` and the ``partof`` rows of both ends' locations; ``names`` (from, to) renames diagrams that it lists."""
    from ..operators.scoring import part_of

    arrows = _plain(t.read_arrows(spark, root))
    one = arrows.select("graph_id", *[F.get(c, F.lit(0)).alias(c) for c in ("src", "dst")], F.col("source_loc").alias("src_loc"), F.col("target_loc").alias("dst_loc"))
    inside = part_of(one)
    if names is not None:
        inside = inside.join(names.toDF("graph_id", "to"), "graph_id", "left").withColumn("graph_id", F.coalesce("to", "graph_id")).drop("to")
    return first_points(arrows, names).unionByName(inside.select("graph_id", "src", "rel", "dst")).distinct()


def read_gt_chat(spark: SparkSession, path: str) -> DataFrame:
    """Triplets of the assistant turns of a training file, a JSON array or one sample a line."""
    schema = "id string, image string, conversations array<struct<`from`:string,value:string>>"
    return t.parse_chat(spark.read.schema(schema).option("multiLine", True).json(path))


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of a COCO file."""
    return t.parse_coco(whole_texts(spark, path))


def read_ytvis(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tracks, videos) of a track file: an object with ``annotations`` and ``videos``, or a bare array of predicted tracks."""
    texts = whole_texts(spark, path)
    bare = F.trim("text").startswith("[")
    body = texts.select(F.when(bare, F.concat(F.lit('{"annotations": '), "text", F.lit("}"))).otherwise(F.col("text")).alias("text"))
    doc = body.select(F.from_json("text", TRACK_FILE).alias("d"))
    rows = doc.select(F.posexplode("d.annotations").alias("no", "a")).select(F.coalesce("a.id", F.col("no") + 1).alias("track_id"), "a.video_id", "a.category_id", "a.score", F.col("a.bboxes").alias("boxes"), "a.areas", "a.iscrowd")
    rows = rows.withColumn("areas", F.coalesce("areas", F.transform("boxes", lambda _: F.lit(None).cast("double"))))
    return ytvis_tracks(rows), doc.select(F.explode("d.videos").alias("v")).select("v.*")


def write_results(metrics: DataFrame, path: str) -> None:
    """A small table of metrics as one JSON object a line."""
    metrics.write.mode("overwrite").json(path)


def write_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str) -> None:
    """The three tables of a COCO set, a folder of JSON lines each: one object of the whole set would be one task's work."""
    for name, table in (("images", images), ("annotations", annotations), ("categories", categories)):
        table.write.mode("overwrite").json(f"{path}/{name}")
