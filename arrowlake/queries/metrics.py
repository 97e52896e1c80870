"""Scores of triplets, questions and runs."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import runs, scoring
from ..registry import query

NORMAL = """
n AS (SELECT 'g' AS side, graph_id, src, rel, dst FROM {fx_edges} UNION ALL SELECT 'p', graph_id, src, rel, dst FROM {fx_pred}),
t AS (SELECT DISTINCT side, graph_id, lower(trim(src)) AS src, CASE WHEN lower(trim(rel)) IN ('connected_with', 'connected', 'connectedto', '', 'none')
  THEN 'connect' ELSE lower(trim(rel)) END AS rel, lower(trim(dst)) AS dst FROM n),
g AS (SELECT graph_id, src, rel, dst FROM t WHERE side = 'g'), p AS (SELECT graph_id, src, rel, dst FROM t WHERE side = 'p'),
x AS (SELECT * FROM g INTERSECT SELECT * FROM p),
rg AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY src, rel, dst) AS no FROM (SELECT * FROM g EXCEPT SELECT * FROM x) q),
rp AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY src, rel, dst) AS no FROM (SELECT * FROM p EXCEPT SELECT * FROM x) q),
c AS (SELECT rg.graph_id, rg.no AS a, rp.no AS b, row_number() OVER (PARTITION BY rg.graph_id ORDER BY rg.no, rp.no) AS k FROM rg JOIN rp USING (graph_id)
  WHERE 1 - levenshtein(rg.src, rp.src)::DOUBLE / greatest(length(rg.src), length(rp.src)) >= 0.85::DOUBLE
    AND 1 - levenshtein(rg.rel, rp.rel)::DOUBLE / greatest(length(rg.rel), length(rp.rel)) >= 0.85::DOUBLE
    AND 1 - levenshtein(rg.dst, rp.dst)::DOUBLE / greatest(length(rg.dst), length(rp.dst)) >= 0.85::DOUBLE),
r(graph_id, k, ua, ub) AS (
  SELECT DISTINCT graph_id, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM c
  UNION ALL
  SELECT r.graph_id, c.k, CASE WHEN list_contains(ua, a) OR list_contains(ub, b) THEN ua ELSE list_append(ua, a) END,
    CASE WHEN list_contains(ua, a) OR list_contains(ub, b) THEN ub ELSE list_append(ub, b) END
  FROM r JOIN c ON c.graph_id = r.graph_id AND c.k = r.k + 1),
f AS (SELECT graph_id, arg_max(ua, k) AS ua FROM r GROUP BY graph_id)"""


@query(
    "f2_relaxed_match",
    "fx_edges",
    "fx_pred",
    sql=f"WITH RECURSIVE {NORMAL}, h AS (SELECT graph_id, unnest(ua) AS no FROM f) SELECT graph_id, src, rel, dst FROM rg JOIN h USING (graph_id, no)",
)
def relaxed(e: DataFrame, p: DataFrame) -> DataFrame:
    return scoring.relaxed_match(scoring.normalized_triplets(p), scoring.normalized_triplets(e)).select("graph_id", "src", "rel", "dst")


@query(
    "i1_triplet_scores",
    "fx_edges",
    "fx_pred",
    sql=f"""WITH RECURSIVE {NORMAL},
k AS (SELECT (SELECT count(*) FROM x) AS exact_hits, (SELECT count(*) FROM x) + (SELECT coalesce(sum(len(ua)), 0)::BIGINT FROM f) AS relaxed_hits,
  (SELECT count(*) FROM p) AS total_pred, (SELECT count(*) FROM g) AS total_gt,
  (SELECT count(DISTINCT graph_id) FROM g WHERE graph_id NOT IN (SELECT graph_id FROM p)) AS missing),
s AS (SELECT *, exact_hits::DOUBLE / total_pred AS precision, relaxed_hits::DOUBLE / total_pred AS relaxed_precision, exact_hits::DOUBLE / total_gt AS recall,
  relaxed_hits::DOUBLE / total_gt AS relaxed_recall FROM k),
u AS (SELECT *, 2 * precision * recall / (precision + recall) AS f1, 2 * relaxed_precision * relaxed_recall / (relaxed_precision + relaxed_recall) AS relaxed_f1 FROM s)
SELECT *, (f1 + relaxed_f1) / 2 AS score FROM u""",
)
def triplets(e: DataFrame, p: DataFrame) -> DataFrame:
    return scoring.triplet_scores(scoring.normalized_triplets(p), scoring.normalized_triplets(e))


SPLIT = NORMAL.replace("lower(trim(rel)) IN", "CASE rel WHEN 'No' THEN 'partof' ELSE lower(trim(rel)) END IN").replace("ELSE lower(trim(rel)) END AS rel", "WHEN rel = 'No' THEN 'partof' ELSE lower(trim(rel)) END AS rel")


@query(
    "i2_triplet_scores_split",
    "fx_edges",
    "fx_pred",
    sql=f"""WITH RECURSIVE {SPLIT}, h AS (SELECT graph_id, unnest(ua) AS no FROM f),
w AS (SELECT rel, 'exact' AS what FROM x UNION ALL SELECT rel, 'relaxed' FROM rg JOIN h USING (graph_id, no) UNION ALL SELECT rel, 'pred' FROM p WHERE graph_id IN (SELECT graph_id FROM g) UNION ALL SELECT rel, 'gt' FROM g),
k AS (SELECT coalesce(CASE WHEN rel = 'partof' THEN 'containment' ELSE 'connection' END, '') AS kind, what FROM w),
cc AS (SELECT coalesce(kind, 'overall') AS kind, count(*) FILTER (what = 'exact') AS exact_hits, count(*) FILTER (what IN ('exact', 'relaxed')) AS relaxed_hits, count(*) FILTER (what = 'pred') AS total_pred,
  count(*) FILTER (what = 'gt') AS total_gt FROM k GROUP BY GROUPING SETS ((kind), ())),
s AS (SELECT *, exact_hits::DOUBLE / total_pred AS precision, relaxed_hits::DOUBLE / total_pred AS relaxed_precision, exact_hits::DOUBLE / total_gt AS recall, relaxed_hits::DOUBLE / total_gt AS relaxed_recall FROM cc),
u AS (SELECT *, 2 * precision * recall / (precision + recall) AS f1, 2 * relaxed_precision * relaxed_recall / (relaxed_precision + relaxed_recall) AS relaxed_f1 FROM s)
SELECT *, (f1 + relaxed_f1) / 2 AS score FROM u""",
)
def split_triplets(e: DataFrame, p: DataFrame) -> DataFrame:
    part = lambda df: df.withColumn("rel", F.when(F.col("rel") == "No", "partof").otherwise(F.col("rel")))
    return scoring.triplet_scores_split(scoring.normalized_triplets(part(p)), scoring.normalized_triplets(part(e)))


@query("i3_select_scope", "fx_edges", "fx_pred", sql="SELECT graph_id, arrow_id FROM {fx_edges} WHERE graph_id IN (SELECT graph_id FROM {fx_pred} WHERE arrow_id = 2)")
def scope(e: DataFrame, p: DataFrame) -> DataFrame:
    asked = p.where("arrow_id = 2").select(F.concat(F.lit("set/"), F.col("graph_id").cast("string"), F.lit(".png")).alias("image"))
    return scoring.select_scope(e, listed=asked).select("graph_id", "arrow_id")


@query(
    "i4_qa_accuracy",
    "fx_qa",
    sql=r"""WITH a AS (SELECT sub_task, regexp_extract(sub_task, '[^-]+$') AS suffix, gt, predicted, lower(trim(predicted)) AS s FROM {fx_qa}),
b AS (SELECT sub_task, CASE WHEN sub_task LIKE 'Num%' THEN sub_task ELSE 'Arrow_' || suffix END AS task,
  CASE WHEN sub_task LIKE 'Num%' THEN nullif(regexp_extract(predicted, '-?[0-9]+'), '')
    WHEN s LIKE 'yes%' THEN 'yes' WHEN s LIKE 'no%' THEN 'no' END AS parsed, gt FROM a)
SELECT coalesce(task, 'all') AS task, coalesce(sub_task, 'all') AS sub_task, count(*) FILTER (parsed = gt) AS correct, count(*) AS total,
  count(*) FILTER (parsed IS NULL) AS unparsed, count(*) FILTER (parsed = gt)::DOUBLE / count(*) AS accuracy
FROM b GROUP BY GROUPING SETS ((task, sub_task), (task), ())""",
)
def questions(qa: DataFrame) -> DataFrame:
    return runs.qa_accuracy(qa)


@query(
    "i5_judge_votes",
    "fx_qa",
    sql="""WITH v AS (SELECT image_id, question_no, gt AS label, CASE WHEN (image_id + j) % 3 <> 0 THEN 1 ELSE 0 END AS vote, predicted FROM {fx_qa}, (VALUES (0), (1), (2)) t(j)),
s AS (SELECT image_id, question_no, label, sum(vote) AS yes, count(*) AS n, any_value(predicted) AS predicted FROM v GROUP BY ALL)
SELECT image_id, question_no, label, CAST(yes AS BIGINT) AS votes, predicted <> '' AND yes >= (n + 1) // 2 AS correct FROM s""",
)
def votes(qa: DataFrame) -> DataFrame:
    judges = qa.select("image_id", "question_no", F.col("gt").alias("label"), "predicted", F.explode(F.array(*[F.lit(j) for j in range(3)])).alias("j"))
    return runs.judge_votes(judges.withColumn("vote", F.when((F.col("image_id") + F.col("j")) % 3 != 0, 1).otherwise(0)))


@query(
    "i21_best_run",
    "fx_runs",
    sql="SELECT model_id, dataset_id, bs, step, eval_loss FROM (SELECT *, row_number() OVER (PARTITION BY model_id, dataset_id ORDER BY eval_loss, bs, step) AS r FROM {fx_runs}) t WHERE r = 1",
)
def best(r: DataFrame) -> DataFrame:
    return runs.best_run(r)


@query(
    "i22_best_epoch",
    "fx_runs",
    sql="""SELECT dataset_id, step, (1 - eval_loss + (1 - eval_loss) / 2 + (1 - eval_loss) / 4) / 3 AS mean_ap FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY eval_loss, step) AS r FROM {fx_runs}) t WHERE r = 1""",
)
def epoch(r: DataFrame) -> DataFrame:
    ap = 1 - F.col("eval_loss")
    return runs.best_epoch(r.select("dataset_id", "step", ap.alias("ap"), (ap / 2).alias("ap50"), (ap / 4).alias("ap75")), "dataset_id")


@query(
    "i23_modal_batch",
    "fx_runs",
    sql="""WITH d AS (SELECT DISTINCT dataset_id FROM {fx_runs}), c AS (SELECT d.dataset_id AS target, bs, count(*) AS n FROM d JOIN {fx_runs} r ON r.dataset_id <> d.dataset_id GROUP BY ALL)
SELECT target, bs, bs * 4 AS global_batch FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY n DESC, bs) AS r FROM c) t WHERE r = 1""",
)
def modal(r: DataFrame) -> DataFrame:
    return runs.modal_batch(r, devices=4)


@query(
    "i24_latency_summary",
    "fx_runs",
    sql="""WITH w AS (SELECT model_id AS worker, count(*) AS images, CAST(sum(bs) AS DOUBLE) AS seconds FROM {fx_runs} GROUP BY model_id)
SELECT count(*) AS workers, CAST(sum(images) AS BIGINT) AS images, max(seconds) AS wall_s, sum(seconds) / sum(images) AS mean_s_per_image,
  sum(images) / max(seconds) AS observed_per_s, sum(images / seconds) AS ideal_per_s FROM w""",
)
def latency(r: DataFrame) -> DataFrame:
    return runs.latency_summary(r.groupBy(F.col("model_id").alias("worker")).agg(F.count("*").alias("images"), F.sum("bs").cast("double").alias("seconds")))
