"""Detection and track queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detections as d
from ..operators import precision
from ..operators import tracks as t
from ..operators.assignment import assign_one_to_one
from ..operators.spatial import pair_overlap
from ..registry import ORACLE_SQL, query
from ..streaming.tracks import confirm_available
from .boxes import AREA, INTER, IOU, TOUCH


@query("j5_top_dets", "fx_dets", sql="SELECT image_id, det_id, score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS r FROM {fx_dets}) q WHERE r <= 2")
def top(x: DataFrame) -> DataFrame:
    return d.top_dets_per_image(x, 2).select("image_id", "det_id", "score")


@query("j6_dedup_across_shards", "fx_dets", sql="WITH s AS (SELECT *, det_id % 3 AS shard FROM {fx_dets}) SELECT image_id, det_id, shard FROM s WHERE shard = (SELECT min(shard) FROM s z WHERE z.image_id = s.image_id AND z.category_id = s.category_id)")
def shards(x: DataFrame) -> DataFrame:
    return d.dedup_across_shards(x.withColumn("shard", F.col("det_id") % 3), ["image_id", "category_id"]).select("image_id", "det_id", "shard")


@query("j7_fill_missing_images", "fx_boxes", "fx_dets", sql="SELECT DISTINCT b.image_id, d.det_id FROM {fx_boxes} b LEFT JOIN {fx_dets} d ON d.image_id = b.image_id AND d.score > 0.5")
def filled(b: DataFrame, x: DataFrame) -> DataFrame:
    return d.fill_missing_images(b, x.where("score > 0.5")).select("image_id", "det_id")


@query("j16_normalise_dets", "fx_dets", sql="SELECT image_id, category_id AS chunk, row_number() OVER (PARTITION BY image_id, category_id ORDER BY det_id) - 1 AS pos, round_even(x1 / 3, 5) AS x, round_even(y1 / 3, 5) AS y, round_even(x2 / 3 - x1 / 3, 5) AS w, round_even(y2 / 3 - y1 / 3, 5) AS h, round_even(score, 5) AS score FROM {fx_dets}")
def normal(x: DataFrame) -> DataFrame:
    cols = ["x1", "y1", "x2", "y2", "score"]
    rows = x.groupBy("image_id", F.col("category_id").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("det_id", *[(F.col(c) / 3).alias(c) if c != "score" else F.col(c) for c in cols]))).alias("a"))
    return d.normalise_dets(rows.select("image_id", "chunk", *[F.col(f"a.{c}").alias(c) for c in cols]), cols)


@query("j19_count_dets", "fx_boxes", "fx_dets", sql="SELECT b.image_id, (SELECT count(*) FROM {fx_dets} d WHERE d.image_id = b.image_id AND score > 0.5) AS n FROM (SELECT DISTINCT image_id FROM {fx_boxes}) b")
def counted(b: DataFrame, x: DataFrame) -> DataFrame:
    return d.count_dets(b.select("image_id").distinct(), x)


@query("i7_positive_split", "fx_dets", "fx_boxes", sql="SELECT image_id, det_id FROM {fx_dets} d WHERE EXISTS (SELECT 1 FROM {fx_boxes} b WHERE b.image_id = d.image_id AND b.category_id = d.category_id AND b.box_id % 2 = 0)")
def positives(x: DataFrame, b: DataFrame) -> DataFrame:
    return d.positive_split(x, b.where("box_id % 2 = 0")).select("image_id", "det_id")


@query("i8_assign_one_to_one", "fx_boxes", "fx_dets")
def assigned(b: DataFrame, x: DataFrame) -> DataFrame:
    pairs = pair_overlap(b, x, ["image_id"], ["iou"]).select("image_id", F.col("a.box_id").alias("box_id"), F.col("b.det_id").alias("det_id"), "iou")
    return assign_one_to_one(pairs, ["image_id"], "box_id", "det_id", "iou")


@query("i9_cgf1", "fx_boxes", "fx_dets")
def cgf1(b: DataFrame, x: DataFrame) -> DataFrame:
    return d.cgf1(b.where("box_id % 5 <> 0 AND image_id % 11 <> 0"), x, b.select("image_id").distinct())


@query("i6_detection_ap", "fx_boxes", "fx_dets")
def ap(b: DataFrame, x: DataFrame) -> DataFrame:
    return precision.detection_ap(b, x)


@query("i10_exhaustive_scope", "fx_boxes", sql="SELECT DISTINCT image_id FROM {fx_boxes} WHERE image_id NOT IN (SELECT image_id FROM {fx_boxes} WHERE box_id = 5)")
def exhaustive(b: DataFrame) -> DataFrame:
    return d.exhaustive_scope(b, b.where("box_id = 5"))


@query(
    "i11_best_of_ground_truths",
    "fx_dets",
    sql="""WITH m AS (SELECT image_id, det_id % 3 AS gt_no, avg(CASE WHEN score > 0.1 THEN score END) AS mean_f1 FROM {fx_dets} GROUP BY ALL)
SELECT image_id, gt_no, mean_f1 FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY mean_f1 IS NULL DESC, mean_f1 DESC, gt_no) AS r FROM m) q WHERE r = 1""",
)
def best_gt(x: DataFrame) -> DataFrame:
    return d.best_of_ground_truths(x.select("image_id", (F.col("det_id") % 3).alias("gt_no"), F.when(F.col("score") > 0.1, F.col("score")).alias("f1")))


GB = "SELECT video_id, track_id, frame, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM {0}"


@query(
    "i13_tracklet_iou",
    "fx_track_frames",
    "fx_pred_frames",
    sql=f"""WITH a AS ({GB.format('{fx_track_frames}')}), b AS ({GB.format('{fx_pred_frames}')}),
i AS (SELECT a.video_id, a.track_id AS gt_id, b.track_id AS dt_id, sum(CASE WHEN {TOUCH} THEN {INTER} ELSE 0 END) AS i FROM a JOIN b USING (video_id, frame) GROUP BY ALL),
ga AS (SELECT video_id, track_id AS gt_id, sum({AREA.format('a')}) AS ga FROM a GROUP BY ALL), da AS (SELECT video_id, track_id AS dt_id, sum({AREA.format('b')}) AS da FROM b GROUP BY ALL)
SELECT video_id, gt_id, dt_id, i / (ga + da - i) AS iou FROM i JOIN ga USING (video_id, gt_id) JOIN da USING (video_id, dt_id)""",
)
def tracklets(g: DataFrame, p: DataFrame) -> DataFrame:
    return t.tracklet_iou(g, p)


@query("i17_hota", "fx_track_frames", "fx_pred_frames")
def hota(g: DataFrame, p: DataFrame) -> DataFrame:
    return t.hota(g, p)


@query("i19_combine", "fx_track_frames", "fx_pred_frames")
def combined(g: DataFrame, p: DataFrame) -> DataFrame:
    return t.combine_sequences(t.hota(g, p))


@query(
    "i20_track_counts",
    "fx_track_frames",
    "fx_pred_frames",
    sql="""WITH r AS (SELECT video_id, track_id, frame, 0 AS s FROM {fx_track_frames} UNION ALL SELECT video_id, track_id, frame, 1 FROM {fx_pred_frames})
SELECT video_id, count(*) FILTER (s = 1) AS dets, count(*) FILTER (s = 0) AS gt_dets, count(DISTINCT track_id) FILTER (s = 1) AS ids, count(DISTINCT track_id) FILTER (s = 0) AS gt_ids, count(DISTINCT frame) AS frames FROM r GROUP BY video_id""",
)
def track_counts(g: DataFrame, p: DataFrame) -> DataFrame:
    return t.track_counts(g, p)


GRID = """s AS (SELECT video_id, min(frame) AS lo, max(frame) AS hi FROM {fx_pred_frames} GROUP BY ALL),
k AS (SELECT DISTINCT video_id, track_id FROM {fx_pred_frames}), g AS (SELECT video_id, track_id, unnest(range(lo, hi + 1)) AS frame FROM k JOIN s USING (video_id))"""


@query("j18_frames_to_tracks", "fx_pred_frames", sql=f"WITH {GRID} SELECT video_id, track_id, count(*) AS frames, count(p.frame) AS visible, sum(coalesce(w * h, 0)) / count(*) AS area FROM g LEFT JOIN {{fx_pred_frames}} p USING (video_id, track_id, frame) GROUP BY ALL")
def to_tracks(p: DataFrame) -> DataFrame:
    rows = t.frames_to_tracks(p, ["track_id"])
    return rows.select("video_id", "track_id", F.size("boxes").cast("long").alias("frames"), F.size(F.filter("boxes", lambda b: b["w"] > 0)).cast("long").alias("visible"), "area")


@query("j1_tracks_to_frames", "fx_pred_frames", sql="SELECT video_id, track_id, frame, x, y, w, h FROM {fx_pred_frames}")
def to_frames(p: DataFrame) -> DataFrame:
    return t.tracks_to_frames(t.frames_to_tracks(p, ["track_id"]), ["track_id"])


@query("j3_remap_video_category", "fx_track_frames", "fx_pred_frames", sql="SELECT video_id, category_id, row_number() OVER (ORDER BY video_id, category_id) AS new_id FROM (SELECT video_id, category_id FROM {fx_track_frames} UNION SELECT video_id, category_id FROM {fx_pred_frames}) q")
def remapped(g: DataFrame, p: DataFrame) -> DataFrame:
    return t.remap_video_category(g, p)


@query("j8_unique_track_ids", "fx_track_frames", sql="WITH c AS (SELECT track_id % 20 AS track_id, video_id, frame FROM {fx_track_frames}) SELECT count(DISTINCT (video_id, track_id)) AS tracks, count(DISTINCT (video_id, track_id)) AS ids FROM c")
def unique(g: DataFrame) -> DataFrame:
    out = t.unique_track_ids(g.withColumn("track_id", F.col("track_id") % 20))
    return out.agg(F.count_distinct("video_id", "track_id").alias("tracks"), F.count_distinct("unique_id").alias("ids"))


@query("j9_fill_video_ids", "fx_dets", sql="SELECT image_id, det_id, CASE WHEN det_id % 2 = 0 THEN image_id % 7 ELSE image_id % 5 END AS video_id FROM {fx_dets}")
def filled_ids(x: DataFrame) -> DataFrame:
    anns = x.select("image_id", "det_id", F.when(F.col("det_id") % 2 == 0, F.col("image_id") % 7).alias("video_id"))
    return t.fill_video_ids(anns, x.select("image_id", (F.col("image_id") % 5).alias("video_id")).distinct())


@query("j10_merge_categories", "fx_dets", sql="SELECT image_id, det_id, CASE WHEN category_id IN (2, 3) THEN 9 ELSE category_id END AS category_id FROM {fx_dets}")
def merged(x: DataFrame) -> DataFrame:
    parents = x.where("category_id > 1").groupBy(F.lit(9).cast("long").alias("parent")).agg(F.collect_set("category_id").alias("children"))
    return t.merge_categories(x.select("image_id", "det_id", "category_id"), parents)


@query("j11_contiguous_ids", "fx_track_frames", sql="SELECT video_id, track_id, frame, dense_rank() OVER (PARTITION BY video_id, category_id ORDER BY track_id) - 1 AS new_id FROM {fx_track_frames}")
def contiguous(g: DataFrame) -> DataFrame:
    return t.contiguous_ids(g).select("video_id", "track_id", "frame", F.col("new_id").cast("long").alias("new_id"))


@query("j12_check_unique_ids", "fx_track_frames", sql="SELECT video_id, frame, track_id % 4 AS track_id, count(*) AS n FROM {fx_track_frames} GROUP BY ALL HAVING count(*) > 1")
def audit(g: DataFrame) -> DataFrame:
    return t.check_unique_ids(g.withColumn("track_id", F.col("track_id") % 4))


@query("j13_subset_by_category", "fx_track_frames", sql="SELECT video_id, track_id, frame FROM {fx_track_frames} WHERE category_id IN (1, 3)")
def subset(g: DataFrame) -> DataFrame:
    return t.subset_by_category(g, g.where("category_id <> 2").select("category_id")).select("video_id", "track_id", "frame")


@query("j14_clean_track_preds", "fx_pred_frames", sql="SELECT video_id, track_id, frame, 1.0::DOUBLE AS score FROM {fx_pred_frames} WHERE score > 0.4")
def clean(p: DataFrame) -> DataFrame:
    return t.clean_track_preds(p, 0.4).select("video_id", "track_id", "frame", "score")


@query("j15_track_area", "fx_pred_frames", sql="SELECT video_id, track_id, sum(w * h) / count(*) AS area FROM {fx_pred_frames} GROUP BY ALL")
def areas(p: DataFrame) -> DataFrame:
    return t.track_area(p)


MATCHES = "m AS (SELECT g.video_id, g.track_id, g.frame, p.track_id IS NOT NULL AS matched FROM {fx_track_frames} g LEFT JOIN {fx_pred_frames} p ON p.video_id = g.video_id AND p.frame = g.frame AND p.track_id = g.track_id + 1000)"


def matches(g: DataFrame, p: DataFrame) -> DataFrame:
    hit = p.select("video_id", "frame", (F.col("track_id") - 1000).alias("track_id"), F.lit(True).alias("matched"))
    return g.select("video_id", "frame", "track_id").join(hit, ["video_id", "frame", "track_id"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


@query(
    "k2_confirm_tracks",
    "fx_track_frames",
    "fx_pred_frames",
    sql=f"""WITH {MATCHES}, r AS (SELECT *, matched AND lag(matched, 1, false) OVER w AND lag(matched, 2, false) OVER w AS three FROM m WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame))
SELECT video_id, track_id, min(frame) AS confirmed_at FROM r WHERE three GROUP BY ALL""",
)
def confirmed(g: DataFrame, p: DataFrame) -> DataFrame:
    return t.confirmed_tracks(matches(g, p))


@query(
    "k3_hotstart_unmatched",
    "fx_track_frames",
    "fx_pred_frames",
    sql=f"WITH {MATCHES}, f AS (SELECT video_id, track_id, min(frame) AS f FROM m GROUP BY ALL) SELECT video_id, track_id, count(*) FILTER (NOT matched) AS n FROM m JOIN f USING (video_id, track_id) WHERE frame < f + 20 GROUP BY ALL HAVING count(*) FILTER (NOT matched) >= 2",
)
def hotstart(g: DataFrame, p: DataFrame) -> DataFrame:
    return t.hotstart_unmatched(matches(g, p), 20, 2)


@query("k5_resume", "fx_qa", sql="SELECT image_id, question_no FROM {fx_qa} WHERE predicted = 'unclear'")
def left(q: DataFrame) -> DataFrame:
    todo = q.select("image_id", "question_no")
    return t.resume(todo, q.withColumn("predicted", F.when(F.col("predicted") != "unclear", F.col("predicted")).otherwise(" ")), ["image_id", "question_no"], "predicted")


NEAR = f"""a AS ({GB.format('{fx_track_frames}')}), b AS (SELECT video_id, track_id AS det_id, frame, x AS x1, y AS y1, x + w AS x2, y + h AS y2, score FROM {{fx_pred_frames}}),
n AS (SELECT a.video_id, a.frame, a.track_id, b.det_id, b.score, {IOU} AS iou FROM a JOIN b USING (video_id, frame) WHERE {TOUCH})"""


@query(
    "k1_associate",
    "fx_track_frames",
    "fx_pred_frames",
    sql=f"""WITH {NEAR}, o AS (SELECT * FROM n WHERE iou >= 0.5::DOUBLE),
fresh AS (SELECT video_id, frame, det_id FROM b WHERE (score >= 0.3 OR NOT EXISTS (SELECT 1 FROM a WHERE a.video_id = b.video_id AND a.frame = b.frame)) AND NOT EXISTS (SELECT 1 FROM o WHERE o.video_id = b.video_id AND o.frame = b.frame AND o.det_id = b.det_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame, det_id ORDER BY iou DESC, track_id) AS r FROM n)
SELECT video_id, frame, 'matched' AS what, track_id, det_id FROM o UNION ALL SELECT video_id, frame, 'new', NULL, det_id FROM fresh
UNION ALL SELECT video_id, frame, 'unmatched', track_id, NULL FROM a WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.video_id = a.video_id AND o.frame = a.frame AND o.track_id = a.track_id)
UNION ALL SELECT video_id, frame, 'sure', track_id, max(det_id) FROM best WHERE r = 1 AND score >= 0.8::DOUBLE AND iou >= 0.8::DOUBLE AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.video_id = best.video_id AND f.frame = best.frame AND f.det_id = best.det_id) GROUP BY ALL""",
)
def associated(g: DataFrame, p: DataFrame) -> DataFrame:
    return t.associate(t.cornered(g), t.cornered(p.withColumnRenamed("track_id", "det_id")), ["video_id", "frame"])


@query("k1_associate_one_to_one", "fx_track_frames", "fx_pred_frames")
def associated_once(g: DataFrame, p: DataFrame) -> DataFrame:
    return t.associate(t.cornered(g), t.cornered(p.withColumnRenamed("track_id", "det_id")), ["video_id", "frame"], track_iou=0.7, one_to_one=True)


@query(
    "j3_negative_pairs",
    "fx_track_frames",
    "fx_pred_frames",
    sql="""WITH s AS (SELECT video_id, category_id FROM {fx_track_frames} WHERE track_id % 4 <> 0 UNION SELECT video_id, category_id FROM {fx_pred_frames} WHERE score > 0.5),
i AS (SELECT video_id, category_id, row_number() OVER (ORDER BY video_id, category_id) AS new_id FROM s),
p AS (SELECT video_id, category_id, min(track_id * 7 % 5) AS pair_no FROM {fx_track_frames} GROUP BY ALL)
SELECT * FROM i UNION ALL SELECT video_id, category_id, row_number() OVER (ORDER BY pair_no, video_id, category_id) + (SELECT count(*) FROM i) FROM p ANTI JOIN s USING (video_id, category_id)""",
)
def with_negatives(g: DataFrame, p: DataFrame) -> DataFrame:
    pairs = g.select("video_id", "category_id", (F.col("track_id") * 7 % 5).alias("pair_no"))
    return t.remap_video_category(g.where("track_id % 4 <> 0"), p.where("score > 0.5"), pairs)


@query("k2_confirm_tracks_stream", "fx_track_frames", "fx_pred_frames")
def confirmed_stream(g: DataFrame, p: DataFrame) -> DataFrame:
    return confirm_available(matches(g, p))


ORACLE_SQL["k2_confirm_tracks_stream"] = ORACLE_SQL["k2_confirm_tracks"]
