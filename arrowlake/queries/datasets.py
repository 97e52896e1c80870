"""Data-set assembly queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import datasets as ds
from ..registry import query

PROMPT = "What does this arrow connect?"


def _arrows(e: DataFrame) -> DataFrame:
    return e.select("graph_id", "arrow_id", "src", "dst", F.when(F.col("rel") != "connectedTo", F.col("rel")).alias("cond"), F.concat(F.col("graph_id").cast("string"), F.lit(".png")).alias("image"))


ANSWER = "concat('source_node: ', src, chr(10), 'target_node: ', dst, chr(10), 'condition: ', CASE rel WHEN 'connectedTo' THEN 'None' ELSE rel END)"


@query("g1_arrow_samples", "fx_edges", sql=f"SELECT concat(graph_id, '_', arrow_id) AS id, concat(graph_id, '.png') AS image, 'human' AS asks, {ANSWER} AS answer FROM {{fx_edges}}")
def samples(e: DataFrame) -> DataFrame:
    return ds.arrow_samples(_arrows(e), PROMPT).select("id", "image", F.col("conversations")[0]["from"].alias("asks"), F.col("conversations")[1]["value"].alias("answer"))


@query(
    "g2_image_triplets",
    "fx_edges",
    sql="""WITH l AS (SELECT graph_id, concat('<', src, ', ', rel, ', ', dst, '>') AS line, min(arrow_id) AS p FROM {fx_edges} GROUP BY ALL)
SELECT graph_id, string_agg(line, chr(10) ORDER BY p) AS triplets FROM l GROUP BY graph_id""",
)
def lines(e: DataFrame) -> DataFrame:
    return ds.image_triplets(e)


@query("g3_k_groups_sliding", "fx_edges", sql="SELECT graph_id, arrow_id, (row_number() OVER (PARTITION BY graph_id ORDER BY arrow_id) - 1) // 3 AS group_no FROM {fx_edges}")
def sliding(e: DataFrame) -> DataFrame:
    return ds.k_groups_sliding(e, 3).select("graph_id", "arrow_id", "group_no")


@query(
    "g4_k_groups_combos",
    "fx_edges",
    sql="""SELECT a.graph_id, concat(a.arrow_id, ',', b.arrow_id, ',', c.arrow_id) AS ids FROM {fx_edges} a JOIN {fx_edges} b ON a.graph_id = b.graph_id AND a.arrow_id < b.arrow_id JOIN {fx_edges} c ON c.graph_id = b.graph_id AND b.arrow_id < c.arrow_id
UNION ALL SELECT graph_id, string_agg(arrow_id, ',' ORDER BY arrow_id) FROM {fx_edges} GROUP BY graph_id HAVING count(*) < 3""",
)
def combos(e: DataFrame) -> DataFrame:
    return ds.k_groups_combos(e, 3, mul=-1).select("graph_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("g4_k_groups_capped", "fx_edges", sql="""WITH n AS (SELECT graph_id, count(*) AS n FROM {fx_edges} GROUP BY ALL) SELECT graph_id, CASE WHEN n < 3 THEN 1 ELSE least(3 * CAST(ceil(n / 3) AS BIGINT), n * (n - 1) * (n - 2) // 6) END AS groups FROM n""")
def capped(e: DataFrame) -> DataFrame:
    return ds.k_groups_combos(e, 3).groupBy("graph_id").agg(F.count("*").alias("groups"))


@query(
    "g5_k_answers",
    "fx_edges",
    sql=f"""WITH g AS (SELECT graph_id, (arrow_id - 1) // 2 AS g, arrow_id, suppkey % 9 = 0 AS missing, {ANSWER} AS answer, (arrow_id - 1) % 2 + 1 AS i FROM {{fx_edges}})
SELECT graph_id, string_agg(concat('arrow_', i, ':', chr(10), answer), chr(10) || chr(10) ORDER BY i) AS text FROM g GROUP BY graph_id, g HAVING NOT bool_or(missing)""",
)
def answers(e: DataFrame) -> DataFrame:
    groups = ds.k_groups_sliding(e, 2).groupBy("graph_id", "group_no").agg(F.sort_array(F.collect_list("arrow_id")).alias("ids")).drop("group_no")
    given = e.where("suppkey % 9 <> 0").select("graph_id", "arrow_id", F.concat(F.lit("source_node: "), "src", F.lit("\ntarget_node: "), "dst", F.lit("\ncondition: "), F.when(F.col("rel") == "connectedTo", "None").otherwise(F.col("rel"))).alias("answer"))
    return ds.k_answers(groups, given).select("graph_id", "text")


@query("g6_split_train_val", "fx_edges", sql="SELECT 'val' AS part, greatest(1, count(*) // 10) AS n FROM {fx_edges} UNION ALL SELECT 'train', count(*) - greatest(1, count(*) // 10) FROM {fx_edges}")
def split(e: DataFrame) -> DataFrame:
    return ds.split_train_val(e, ["graph_id", "arrow_id"]).groupBy("part").agg(F.count("*").alias("n"))


@query("g7_leave_one_out", "fx_runs", sql="WITH d AS (SELECT DISTINCT dataset_id FROM {fx_runs}) SELECT d.dataset_id AS target, r.dataset_id AS _src, count(*) AS n FROM d JOIN {fx_runs} r ON r.dataset_id <> d.dataset_id GROUP BY ALL")
def others(r: DataFrame) -> DataFrame:
    return ds.leave_one_out(r, "dataset_id").groupBy("target", "_src").agg(F.count("*").alias("n"))


@query("g8_to_messages", "fx_edges", sql=f"SELECT concat(graph_id, '_', arrow_id) AS id, 'user/assistant' AS roles, {ANSWER} AS answer, concat(graph_id, '.png') AS image FROM {{fx_edges}}")
def messages(e: DataFrame) -> DataFrame:
    m = ds.to_messages(ds.arrow_samples(_arrows(e), PROMPT))
    return m.select("id", F.array_join(F.col("messages.role"), "/").alias("roles"), F.col("messages")[1]["content"].alias("answer"), F.col("images")[0].alias("image"))


@query("g9_to_openai_roles", "conversations", sql="SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user' ELSE 'assistant' END AS role, concat('[image] ', text) AS content FROM {conversations}")
def roles(c: DataFrame) -> DataFrame:
    talk = F.array(F.struct(F.when(F.col("role") == "user", "human").otherwise("gpt").alias("from"), F.concat(F.lit("<image> "), "text").alias("value")))
    return c.select("conv_id", "turn", F.explode(ds.to_openai_roles(talk)).alias("m")).select("conv_id", "turn", "m.*")


@query(
    "g10_build_coco",
    "fx_boxes",
    sql="SELECT row_number() OVER (ORDER BY image_id, box_id) AS id, dense_rank() OVER (ORDER BY image_id) AS image_id, category_id, x2 - x1 AS w, (x2 - x1) * (y2 - y1) AS area, 0 AS iscrowd FROM {fx_boxes} WHERE box_id > 2",
)
def coco(b: DataFrame) -> DataFrame:
    images = b.select("image_id").distinct()
    return ds.build_coco(b.where("box_id > 2"), images)[1].select("id", "image_id", "category_id", F.col("bbox")[2].alias("w"), "area", "iscrowd")


@query(
    "g11_coco_to_yolo",
    "fx_boxes",
    sql="""WITH l AS (SELECT image_id, string_agg(format('{:d} {:.6f} {:.6f} {:.6f} {:.6f}', category_id - 1, least(1, (x1 + x2) / 200), least(1, (y1 + y2) / 120), (x2 - x1) / 100, (y2 - y1) / 60), chr(10) ORDER BY box_id) AS label FROM {fx_boxes} WHERE box_id > 2 GROUP BY image_id)
SELECT DISTINCT b.image_id, coalesce(label, '') AS label FROM {fx_boxes} b LEFT JOIN l USING (image_id)""",
)
def yolo(b: DataFrame) -> DataFrame:
    images = b.select("image_id", F.lit(100.0).alias("width"), F.lit(60.0).alias("height")).distinct()
    return ds.coco_to_yolo(images, b.where("box_id > 2"), b.select("category_id").distinct())


@query("g12_reindex_one_based", "fx_boxes", sql="SELECT image_id + 1 - (SELECT min(image_id) FROM {fx_boxes}) AS image_id, box_id AS id, category_id FROM {fx_boxes}")
def reindexed(b: DataFrame) -> DataFrame:
    zero = b.agg(F.min("image_id").alias("z"))
    anns = b.join(zero).select((F.col("image_id") - F.col("z")).alias("image_id"), F.col("box_id").alias("id"), "category_id")
    out = ds.reindex_one_based({"images": anns.select(F.col("image_id").alias("id")).distinct(), "annotations": anns}, {"images": [("annotations", "image_id")]})
    return out["annotations"]


@query(
    "g13_category_queries",
    "fx_boxes",
    sql="""WITH i AS (SELECT DISTINCT image_id FROM {fx_boxes}), c AS (SELECT DISTINCT category_id FROM {fx_boxes})
SELECT i.image_id, c.category_id, coalesce(string_agg(box_id, ',' ORDER BY box_id), '') AS objects FROM i CROSS JOIN c LEFT JOIN {fx_boxes} b ON b.image_id = i.image_id AND b.category_id = c.category_id GROUP BY ALL""",
)
def by_category(b: DataFrame) -> DataFrame:
    q = ds.category_queries(b.select("image_id").distinct(), b, b.select("category_id").distinct())
    return q.select("image_id", "category_id", F.array_join(F.col("objects").cast("array<string>"), ",").alias("objects"))


@query(
    "g13_category_chunks",
    "fx_boxes",
    sql="""SELECT image_id, category_id, (category_id - 1) // 2 AS chunk, row_number() OVER (PARTITION BY image_id, (category_id - 1) // 2 ORDER BY category_id) - 1 AS query_no, string_agg(box_id, ',' ORDER BY box_id) AS objects FROM {fx_boxes} GROUP BY image_id, category_id""",
)
def by_chunk(b: DataFrame) -> DataFrame:
    q = ds.category_queries(b.select("image_id").distinct(), b, b.select("category_id").distinct(), negatives=False, chunk=2)
    return q.select("image_id", "category_id", "chunk", "query_no", F.array_join(F.col("objects").cast("array<string>"), ",").alias("objects"))


@query(
    "g15_filter_queries",
    "fx_boxes",
    sql="SELECT image_id, box_id, dense_rank() OVER (PARTITION BY image_id ORDER BY box_id) - 1 AS stage FROM {fx_boxes} WHERE category_id <> 2 AND (x2 - x1) * (y2 - y1) >= 150",
)
def filtered(b: DataFrame) -> DataFrame:
    rules = [F.col("category_id") == 2, (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) < 150]
    return ds.filter_queries(b.withColumn("stage", F.col("box_id")), rules).select("image_id", "box_id", F.col("stage").cast("long").alias("stage"))


@query("g16_cap_queries", "fx_boxes", sql="SELECT image_id, least(3, count(*)) AS n, least(3, count(*) FILTER (category_id = 1)) AS positives FROM {fx_boxes} GROUP BY image_id")
def cap(b: DataFrame) -> DataFrame:
    kept = ds.cap_queries(b, 3, "box_id", F.col("category_id") == 1)
    return kept.groupBy("image_id").agg(F.count("*").alias("n"), F.count_if(F.col("category_id") == 1).alias("positives"))


@query("g18_sample_stages", "fx_track_frames", sql="WITH f AS (SELECT DISTINCT video_id, frame FROM {fx_track_frames}), n AS (SELECT video_id, count(*) AS t FROM f GROUP BY ALL) SELECT video_id, least(t, 4) AS stages, least(5, greatest(1, (t - 1) // 3)) AS gap FROM n")
def stages(f: DataFrame) -> DataFrame:
    kept = ds.sample_stages(f, 4, 5)
    ranks = f.select("video_id", "frame").distinct().withColumn("t", F.expr("row_number() over (partition by video_id order by frame)"))
    return kept.join(ranks, ["video_id", "frame"]).groupBy("video_id").agg(F.count("*").alias("stages"), ((F.max("t") - F.min("t")) / F.greatest(F.count("*") - 1, F.lit(1))).cast("long").alias("gap"))


@query(
    "g19_uniform_sample",
    "fx_walk",
    sql="""WITH r AS (SELECT graph_id, edge_no, edge_no - 1 AS t, count(*) OVER (PARTITION BY graph_id) AS n FROM {fx_walk})
SELECT graph_id, edge_no FROM r WHERE n <= 5 OR t IN (0, round_even((n - 1) / 4, 0), round_even((n - 1) / 2, 0), round_even((n - 1) * 3 / 4, 0), n - 1)""",
)
def uniform(w: DataFrame) -> DataFrame:
    return ds.uniform_sample(w, "graph_id", "edge_no", 5).select("graph_id", "edge_no")


@query("g20_class_counts", "fx_runs", sql="SELECT i AS dataset_id, count(dataset_id) AS count FROM range(12) t(i) LEFT JOIN {fx_runs} ON dataset_id = i GROUP BY i")
def classes(r: DataFrame) -> DataFrame:
    return ds.class_counts(r, "dataset_id", 12)


@query("g23_tile_image", "fx_boxes", sql="SELECT image_id, box_id, f AS frame FROM {fx_boxes}, (VALUES (0), (1), (2)) t(f)")
def tiled(b: DataFrame) -> DataFrame:
    return ds.tile_image(b, 3).select("image_id", "box_id", "frame")
