"""Queries of the preparation operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import queries_prep as qp
from ..registry import query


@query("b7_add_prefix_suffix", "fx_edges", sql="SELECT graph_id, arrow_id, CASE WHEN rel = 'Yes' THEN concat('the ', rel, '?') ELSE rel END AS query_text FROM {fx_edges}")
def affixes(e: DataFrame) -> DataFrame:
    return qp.add_prefix_suffix(e.select("graph_id", "arrow_id", F.col("rel").alias("query_text")), "the ", "?", ["Yes", "geometric"])


@query("g17_cap_queries_video", "fx_track_frames", sql="WITH q AS (SELECT DISTINCT video_id, track_id FROM {fx_track_frames}), n AS (SELECT video_id, least(3, count(*)) AS n FROM q GROUP BY ALL) SELECT video_id, f AS frame, n FROM n, (VALUES (0), (1)) t(f)")
def video_cap(f: DataFrame) -> DataFrame:
    q = f.select("video_id", F.col("track_id").alias("idx")).distinct().withColumn("frame", F.explode(F.array(F.lit(0), F.lit(1))))
    return qp.cap_queries_video(q, 3).groupBy("video_id", "frame").agg(F.count("*").alias("n"))


@query(
    "g14_np_queries",
    "fx_track_frames",
    sql="""WITH p AS (SELECT DISTINCT video_id, category_id FROM {fx_track_frames}), n AS (SELECT video_id, max(frame) AS n FROM {fx_track_frames} GROUP BY ALL)
SELECT p.video_id, p.category_id, concat('cat ', p.category_id) AS noun_phrase, f AS frame, concat(f, '.jpg') AS file_name, p.category_id <> 2 AS agrees FROM p JOIN n USING (video_id), (SELECT unnest(range(0, 40)) AS f) t WHERE f < n.n""",
)
def phrases(f: DataFrame) -> DataFrame:
    files = F.transform(F.sequence(F.lit(0), F.max("frame") - 1), lambda i: F.concat(i.cast("string"), F.lit(".jpg")))
    videos = f.groupBy("video_id").agg(files.alias("file_names"))
    pairs = f.select("video_id", "category_id").distinct().withColumn("noun_phrase", F.concat(F.lit("cat "), F.col("category_id").cast("string")))
    cats = f.select("category_id").distinct().withColumn("name", F.when(F.col("category_id") == 2, "dog").otherwise(F.concat(F.lit("cat "), F.col("category_id").cast("string"))))
    return qp.np_queries(videos, pairs, cats)


@query(
    "g21_qa_tasks",
    "fx_edges",
    sql="""WITH s AS (SELECT graph_id AS image_id, min(src) AS a, max(dst) AS b, count(*) AS n FROM {fx_edges} GROUP BY ALL),
b AS (SELECT graph_id AS image_id, string_agg(concat('<', src, ', ', rel, ', ', dst, '>'), chr(10) ORDER BY arrow_id) AS block FROM {fx_edges} WHERE graph_id % 2 = 0 GROUP BY ALL)
SELECT image_id, task, question, gold, coalesce(block, '') AS block FROM (SELECT image_id, 'edge' AS task, concat(a, ' to ', b, '?') AS question, 'yes' AS gold FROM s UNION ALL SELECT image_id, 'count', 'How many arrows?', CAST(n AS STRING) FROM s WHERE n > 2) q LEFT JOIN b USING (image_id)""",
)
def tasks(e: DataFrame) -> DataFrame:
    s = e.groupBy(F.col("graph_id").alias("image_id")).agg(F.concat(F.min("src"), F.lit(" to "), F.max("dst"), F.lit("?")).alias("edge"), F.count("*").alias("count_gt"))
    s = s.withColumns({"edge_gt": F.lit("yes"), "count": F.when(F.col("count_gt") > 2, "How many arrows?").otherwise(" ")})
    return qp.qa_tasks(s, {"edge": "edge", "count": "count"}, e.where("graph_id % 2 = 0").select(F.col("graph_id").alias("image_id"), F.col("arrow_id").alias("pos"), "src", "rel", "dst"))


@query(
    "e11_stroke_boxes",
    "fx_boxes",
    sql="""WITH p AS (SELECT image_id, box_id, x1 AS x, y1 AS y FROM {fx_boxes} UNION ALL SELECT image_id, box_id, x2, y2 FROM {fx_boxes}),
e AS (SELECT image_id, min(x) AS lx, min(y) AS ly, greatest(max(x) - min(x), max(y) - min(y)) AS span FROM p GROUP BY ALL)
SELECT image_id AS diagram_id, box_id % 2 AS group_id, CAST(trunc((min(x) - any_value(lx)) * (1293::DOUBLE / any_value(span)) + 20) AS INTEGER) AS x1, CAST(trunc((min(y) - any_value(ly)) * (1293::DOUBLE / any_value(span)) + 20) AS INTEGER) AS y1,
  CAST(trunc((max(x) - any_value(lx)) * (1293::DOUBLE / any_value(span)) + 20) AS INTEGER) AS x2, CAST(trunc((max(y) - any_value(ly)) * (1293::DOUBLE / any_value(span)) + 20) AS INTEGER) AS y2 FROM p JOIN e USING (image_id) GROUP BY image_id, box_id % 2""",
)
def strokes(b: DataFrame) -> DataFrame:
    points = b.select(F.col("image_id").alias("diagram_id"), F.col("box_id").alias("stroke_id"), F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p")).select("diagram_id", "stroke_id", "p.*")
    return qp.stroke_boxes(points, b.select(F.col("image_id").alias("diagram_id"), (F.col("box_id") % 2).alias("group_id"), F.col("box_id").alias("stroke_id")))


@query(
    "c9_flowchart_graph",
    "fx_edges",
    sql="""SELECT graph_id, arrow_id, CASE WHEN suppkey % 4 = 0 THEN 'No Text' ELSE src END AS src, CASE WHEN partkey % 5 = 0 THEN 'No Text' ELSE dst END AS dst FROM {fx_edges}
WHERE graph_id IN (SELECT graph_id FROM {fx_edges} WHERE suppkey % 4 <> 0 OR partkey % 5 <> 0)""",
)
def flowcharts(e: DataFrame) -> DataFrame:
    s = e.select("graph_id", F.concat(F.lit("S"), F.col("suppkey").cast("string")).alias("node_id"), F.when(F.col("suppkey") % 4 == 0, " ").otherwise(F.col("src")).alias("text"))
    d = e.select("graph_id", F.concat(F.lit("P"), F.col("partkey").cast("string")).alias("node_id"), F.when(F.col("partkey") % 5 != 0, F.col("dst")).alias("text"))
    arrows = e.select("graph_id", "arrow_id", F.concat(F.lit("S"), F.col("suppkey").cast("string")).alias("s"), F.concat(F.lit("P"), F.col("partkey").cast("string")).alias("d"))
    return qp.flowchart_graph(s.union(d).distinct(), arrows)


@query(
    "j2_preds_to_frames",
    "fx_pred_frames",
    sql="SELECT video_id, track_id, frame, video_id * 100 + frame AS image_id, CASE WHEN track_id % 2 = 0 THEN 7::DOUBLE ELSE w * h END AS area FROM {fx_pred_frames} WHERE frame <> 5",
)
def pred_rows(p: DataFrame) -> DataFrame:
    grid = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.coalesce(F.get(F.map_values(F.map_filter("at", lambda k, v: k == i)), F.lit(0)), F.struct(*[F.lit(0.0).alias(c) for c in "xywh"])))
    arrays = p.groupBy("video_id", "track_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("frame").cast("int").alias("k"), F.struct("x", "y", "w", "h").alias("v")))).alias("at"))
    arrays = arrays.select("video_id", "track_id", grid.alias("boxes"), F.array_repeat(F.when(F.col("track_id") % 2 == 0, 7.0), 32).alias("areas"))
    images = p.where("frame <> 5").select("video_id", "frame", (F.col("video_id") * 100 + F.col("frame")).alias("image_id")).distinct()
    return qp.preds_to_frames(arrays, images)[0].select("video_id", "track_id", F.col("frame").cast("long").alias("frame"), "image_id", "area")


@query(
    "i16_video_np_scores",
    "fx_pred_frames",
    sql="""WITH c AS (SELECT video_id, category_id, th, count(*) FILTER (score > th) AS tp, count(*) FILTER (frame % 2 = 0) AS fp, count(*) FILTER (score < 0.2::DOUBLE) AS fn FROM {fx_pred_frames}, (VALUES (0.5::DOUBLE), (0.75), (0.9)) t(th) GROUP BY ALL),
f AS (SELECT *, CASE WHEN 2 * tp + fp + fn = 0 THEN 1 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1 FROM c)
SELECT video_id, category_id, avg(f1) AS f1_mean, max(f1) FILTER (th = 0.5) AS f1_50, max(f1) FILTER (th = 0.75) AS f1_75 FROM f GROUP BY ALL""",
)
def np_scores(p: DataFrame) -> DataFrame:
    rows = p.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (0.5, 0.75, 0.9)])))
    counts = rows.groupBy("video_id", "category_id", "threshold").agg(F.count_if(F.col("score") > F.col("threshold")).alias("tp"), F.count_if(F.col("frame") % 2 == 0).alias("fp"), F.count_if(F.col("score") < 0.2).alias("fn"))
    return qp.video_np_scores(counts)


@query("a6_read_gt_points", "fx_edges", sql="SELECT DISTINCT graph_id, src, rel, dst FROM {fx_edges} WHERE suppkey % 4 <> 0")
def points(e: DataFrame) -> DataFrame:
    return qp.first_points(e.select("graph_id", F.when(F.col("suppkey") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("src", F.lit("x"))).alias("src"), F.array("rel").alias("rel"), F.array("dst").alias("dst")))


@query("a7_read_gt_hier", "fx_edges", sql="SELECT DISTINCT CASE WHEN graph_id % 2 = 0 THEN concat('image ', graph_id) ELSE CAST(graph_id AS STRING) END AS graph_id, src, rel, dst FROM {fx_edges}")
def hierarchical(e: DataFrame) -> DataFrame:
    rows = e.select(F.col("graph_id").cast("string").alias("graph_id"), *[F.array(c).alias(c) for c in ("src", "rel", "dst")])
    names = e.where("graph_id % 2 = 0").select(F.col("graph_id").cast("string").alias("a"), F.concat(F.lit("image "), F.col("graph_id").cast("string")).alias("b")).distinct()
    return qp.first_points(rows, names)


@query("j4_remap_class_agnostic", "fx_track_frames", "fx_pred_frames", sql="""WITH f AS (SELECT video_id, track_id, min(frame) AS f FROM {fx_track_frames} GROUP BY ALL), n AS (SELECT video_id, track_id, row_number() OVER (PARTITION BY video_id ORDER BY f, track_id) AS new_id FROM f)
SELECT video_id, track_id, frame, 1::BIGINT AS category_id, new_id FROM {fx_track_frames} JOIN n USING (video_id, track_id)""")
def agnostic(g: DataFrame, p: DataFrame) -> DataFrame:
    return qp.remap_class_agnostic(g, p)[0].select("video_id", "track_id", "frame", "category_id", F.col("new_id").cast("long").alias("new_id"))


@query("a10_read_ytvis", "fx_pred_frames", sql="WITH m AS (SELECT video_id, track_id, sum(CASE WHEN frame % 3 <> 0 THEN w * h ELSE 0 END) / count(*) AS area, count(*) FILTER (frame % 3 = 0) AS zeros FROM {fx_pred_frames} GROUP BY ALL) SELECT * FROM m")
def ytvis(p: DataFrame) -> DataFrame:
    shown = F.col("frame") % 3 != 0
    a = p.groupBy("video_id", "track_id").agg(F.collect_list(F.struct(F.when(shown, F.array("x", "y", "w", "h")).alias("b"), F.when(shown, F.col("w") * F.col("h")).alias("a"))).alias("all"))
    out = qp.ytvis_tracks(a.select("video_id", "track_id", F.col("all.b").alias("boxes"), F.col("all.a").alias("areas")))
    return out.select("video_id", "track_id", "area", F.size(F.filter("areas", lambda x: x == 0)).cast("long").alias("zeros"))


def _asked(b: DataFrame) -> DataFrame:
    box = F.struct("x1", "y1", "x2", "y2")
    return b.select("image_id", F.col("box_id").alias("query_id"), "category_id", F.lit("thing").alias("query_text"), (F.col("box_id") % 2).alias("stage"), F.when(F.col("box_id") % 5 == 0, box).alias("input_box"))


@query("g22_rewrite_queries", "fx_boxes")
def rewritten(b: DataFrame) -> DataFrame:
    return qp.rewrite_queries(_asked(b), b, 0.5).select("image_id", "query_id", "query_text", "stage")


@query(
    "g22_rewrite_rules",
    "fx_boxes",
    sql="""SELECT image_id, box_id AS query_id, CASE WHEN box_id % 2 = 0 AND box_id % 5 <> 0 THEN 'visual' ELSE 'thing' END AS turned, CASE WHEN box_id % 2 = 0 AND box_id % 5 <> 0 OR box_id % 5 = 0 THEN 1 ELSE 0 END AS boxes,
  'thing' AS kept, 0 AS without, 'other' AS overwritten, 'thing' AS never FROM {fx_boxes}""",
)
def rules(b: DataFrame) -> DataFrame:
    """All three rules with certainty, where chance plays no part: a query's only targets are those of its category."""
    asked, key = _asked(b), ["image_id", "query_id"]
    turned = qp.rewrite_queries(asked, b, 1.0).select(*key, F.col("query_text").alias("turned"), F.col("input_box").isNotNull().cast("int").alias("boxes"))
    kept = qp.rewrite_queries(asked, b, 1.0, keep_text=True).select(*key, F.col("query_text").alias("kept"))
    without = qp.drop_input_boxes(asked).select(*key, F.col("input_box").isNotNull().cast("int").alias("without"))
    other = qp.overwrite_text(asked, "other").select(*key, F.col("query_text").alias("overwritten"))
    never = qp.overwrite_text(asked, "other", 0.0).select(*key, F.col("query_text").alias("never"))
    return turned.join(kept, key).join(without, key).join(other, key).join(never, key)


@query("f4_snap_to_vocab_ratio", "fx_pred", "fx_vocab")
def by_ratio(p: DataFrame, v: DataFrame) -> DataFrame:
    from ..operators.repair import snap_to_vocab_ratio

    return snap_to_vocab_ratio(p.select("graph_id", "arrow_id", F.col("dst").alias("text")), v)


@query("a2_read_predictions_dir", "fx_pred", sql="SELECT DISTINCT CAST(graph_id AS STRING) AS graph_id, src, rel, dst FROM {fx_pred} UNION SELECT DISTINCT CAST(graph_id AS STRING), src, 'partof', 'lane 1' FROM {fx_pred} WHERE arrow_id % 2 = 0")
def predictions_dir(p: DataFrame) -> DataFrame:
    from ..sources.triplets import parse_predictions

    arrow = F.struct(F.col("src").alias("source_node"), F.col("rel").alias("condition"), F.col("dst").alias("end"), F.when(F.col("arrow_id") % 2 == 0, "lane 1").otherwise("none").alias("source_location"))
    files = p.groupBy("graph_id").agg(F.to_json(F.collect_list(arrow)).alias("text")).select(F.concat(F.lit("out/"), F.col("graph_id").cast("string"), F.lit("/arrow_triplets.json")).alias("path"), "text")
    return parse_predictions(files, located=True)
