"""Triplets and arrows from the file shapes in use. Each parser takes a DataFrame of texts; readers put files in front of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import keep_valid_triplets, strip

TEXT = T.StringType()
#: One arrow of an annotation, with the spellings that files use; a field is a string or an array, so it is read as JSON text.
ARROW = T.StructType([T.StructField(n, TEXT) for n in ("arrow_id", "source_node", "target_node", "source", "end", "start_point", "end_point", "condition", "source_location", "target_location", "annotated_image_path")] + [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("arrowhead_bbox", "matched_arrowhead_bbox")])
ANNOTATION = T.StructType([T.StructField("arrows", T.ArrayType(ARROW))])
PREDICTION = T.StructType([T.StructField(n, TEXT) for n in ("source_node", "target_node", "source", "end", "condition")])


def as_list(col: Column) -> Column:
    """A string, a JSON array of strings or a `` || `` joined string as an array of strings."""
    items = F.when(strip(col).startswith("["), F.from_json(col, "array<string>")).otherwise(F.split(col, r" \|\| "))
    return F.filter(F.transform(items, strip), lambda x: x != "")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")


def parse_annotations(files: DataFrame) -> DataFrame:
    """Arrow rows from (path, text) of one JSON per diagram folder; a ``_merged`` file beats the others of its folder,
    unreadable files and those without arrows give nothing."""
    folder = F.regexp_extract("path", r"([^/]+)/[^/]*$", 1)
    w = Window.partitionBy("graph_id").orderBy(F.col("path").endswith("_merged.json").desc(), "path")
    rows = files.select("path", folder.alias("graph_id"), F.from_json("text", ANNOTATION).alias("a")).where(F.size("a.arrows") > 0)
    rows = rows.withColumn("r", F.row_number().over(w)).where("r = 1").select("graph_id", F.explode("a.arrows").alias("x"))
    first = lambda *names: F.coalesce(*[F.col(f"x.{n}") for n in names])
    return rows.select(
        "graph_id", F.col("x.arrow_id").alias("arrow_id"), as_list(first("source_node", "start_point", "source")).alias("source"), as_list(first("target_node", "end_point", "end")).alias("target"),
        as_list(F.col("x.condition")).alias("condition"), F.col("x.source_location").alias("source_loc"), F.col("x.target_location").alias("target_loc"),
        first("matched_arrowhead_bbox", "arrowhead_bbox").alias("bbox"), F.col("x.annotated_image_path").alias("image_path"),
    )


def read_arrows(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)
    return parse_annotations(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def parse_predictions_map(texts: DataFrame) -> DataFrame:
    """(graph_id, src, rel, dst) from JSON objects {image: [triplet]}; both spellings of the ends, pending targets left out."""
    per = texts.select(F.explode(F.from_json("text", T.MapType(TEXT, T.ArrayType(PREDICTION)))).alias("image", "all"))
    rows = per.select(stem(F.col("image")).alias("graph_id"), F.explode("all").alias("t"))
    rows = rows.select("graph_id", F.coalesce("t.source_node", "t.source").alias("src"), F.col("t.condition").alias("rel"), F.coalesce("t.target_node", "t.end").alias("dst"))
    return keep_valid_triplets(rows).distinct()


def parse_tagged(lines: DataFrame) -> DataFrame:
    """(graph_id, no, src, rel, dst) from (graph_id, text) of ``<H> s <R> r <T> t`` sequences."""
    pattern = r"<H>\s*(.*?)\s*<R>\s*(.*?)\s*<T>\s*(.*?)\s*(?=<H>|$)"
    rows = lines.select("graph_id", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("no", "t"))
    return rows.select("graph_id", "no", *[F.regexp_extract("t", pattern, i + 1).alias(n) for i, n in enumerate(("src", "rel", "dst"))])


def pair_by_line(names: DataFrame, lines: DataFrame) -> DataFrame:
    """Names and lines, each one whole text (``text``), joined by line number."""
    numbered = lambda df, c: df.select(F.posexplode(F.split("text", "\n")).alias("no", c))
    return numbered(names, "name").join(numbered(lines, "text"), "no")


def parse_angle(lines: DataFrame) -> DataFrame:
    """(graph_id, src, rel, dst) from (graph_id, line) of ``<s, r, t>``; other lines are left out."""
    pattern = r"^\s*<\s*([^,<>]*?)\s*,\s*([^,<>]*?)\s*,\s*([^<>]*?)\s*>\s*$"
    return lines.where(F.col("line").rlike(pattern)).select("graph_id", *[F.regexp_extract("line", pattern, i + 1).alias(n) for i, n in enumerate(("src", "rel", "dst"))])


def parse_chat(samples: DataFrame) -> DataFrame:
    """Triplets of the assistant turn of (id, conversations): lines ``<a, r, b>`` with exactly three parts."""
    lines = samples.select(F.col("id").alias("graph_id"), F.explode(F.split(F.col("conversations")[1]["value"], "\n")).alias("line"))
    parts = F.split(F.regexp_replace(strip(F.col("line")), "^<|>$", ""), ",")
    rows = lines.where(strip(F.col("line")).startswith("<")).select("graph_id", parts.alias("p")).where(F.size("p") == 3)
    return rows.select("graph_id", *[strip(F.col("p")[i]).alias(n) for i, n in enumerate(("src", "rel", "dst"))])


def parse_coco(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories) of COCO JSON texts."""
    schema = "images array<struct<id:bigint,width:double,height:double,file_name:string>>, annotations array<struct<id:bigint,image_id:bigint,category_id:bigint,bbox:array<double>,area:double,iscrowd:int>>, categories array<struct<id:bigint,name:string>>"
    doc = texts.select(F.from_json("text", schema).alias("d"))
    return tuple(doc.select(F.explode(f"d.{n}").alias("x")).select("x.*") for n in ("images", "annotations", "categories"))


def resolve_paths(arrows: DataFrame, listing: DataFrame, base: str = "", marker: str = "training/") -> DataFrame:
    """``arrows`` (path, folder) with ``resolved``: the listed file named by the path as given, relative to its folder,
    under ``marker``, or by the suffix after that; else empty."""
    p = F.col("path")
    after = F.when(p.contains(marker), F.substring_index(p, marker, -1)).otherwise(p)
    root = F.lit(base) if base else F.lit("")
    options = F.array(p, F.concat_ws("/", "folder", p), F.concat(root, F.lit(marker), p), F.concat(root, F.lit(marker), after))
    rows = arrows.distinct().select("path", "folder", F.posexplode(options).alias("rank", "candidate"))
    found = rows.join(listing.select(F.col("file").alias("candidate")).distinct(), "candidate").groupBy("path", "folder").agg(F.min_by("candidate", "rank").alias("resolved"))
    return arrows.join(found, ["path", "folder"], "left").withColumn("resolved", F.coalesce("resolved", F.lit("")))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_labels(labels: DataFrame, path: str) -> None:
    """One folder per image id with its label text."""
    labels.select("image_id", "label").write.mode("overwrite").partitionBy("image_id").text(path)


def parse_predictions(files: DataFrame, located: bool = False) -> DataFrame:
    """(graph_id, src, rel, dst) from (path, text) of one JSON array of arrows per diagram folder; pending targets are left
    out, and with ``located`` both ends' locations add ``partof`` rows."""
    rows = files.select(F.regexp_extract("path", r"([^/]+)/[^/]*$", 1).alias("graph_id"), F.explode(F.from_json("text", T.ArrayType(ARROW))).alias("x"))
    rows = rows.select("graph_id", F.coalesce("x.source_node", "x.source").alias("src"), F.col("x.condition").alias("rel"), F.coalesce("x.target_node", "x.end").alias("dst"), F.col("x.source_location").alias("src_loc"), F.col("x.target_location").alias("dst_loc"))
    valid = keep_valid_triplets(rows)
    out = valid.select("graph_id", "src", "rel", "dst")
    if located:
        from ..operators.scoring import part_of

        out = out.unionByName(part_of(valid))
    return out.distinct()
