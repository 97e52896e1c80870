"""Tracking accuracy by class, combinations over classes, and mask quality."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import combine as co
from ..operators import mask_quality as mq
from ..operators import teta as te
from ..registry import query

#: Predictions of every fifth track are given another class, those of every seventh are moved aside.
DT = """SELECT video_id, track_id, CASE WHEN track_id % 5 = 0 THEN category_id % 3 + 1 ELSE category_id END AS category_id, frame,
 CASE WHEN track_id % 7 = 0 THEN x + 9 ELSE x END AS x, y, w, h FROM {fx_pred_frames}"""


def confused(p: DataFrame) -> DataFrame:
    guess = F.when(F.col("track_id") % 5 == 0, F.col("category_id") % 3 + 1).otherwise(F.col("category_id"))
    x = F.when(F.col("track_id") % 7 == 0, F.col("x") + 9).otherwise(F.col("x"))
    return p.select("video_id", "track_id", guess.alias("category_id"), "frame", x.alias("x"), "y", "w", "h")


def apart(frames: DataFrame, first: int = 0) -> DataFrame:
    """Tracks in lanes of their own, so that no two compete for a match."""
    return frames.withColumn("y", F.col("y") + (F.col("track_id") - first) * 1000)


APART = f"""
WITH gt AS (SELECT video_id, track_id AS g, track_id AS lane, category_id, frame, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM {{fx_track_frames}}),
dt AS (SELECT video_id, track_id AS t, track_id - 1000 AS lane, category_id AS guess, frame, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM ({DT}) q),
levels AS (SELECT unnest(range(20)) AS lv),
inters AS (SELECT video_id, frame, g, category_id, t, guess, greatest(0, least(gt.x2, dt.x2) - greatest(gt.x1, dt.x1)) * greatest(0, least(gt.y2, dt.y2) - greatest(gt.y1, dt.y1)) AS i,
  (gt.x2 - gt.x1) * (gt.y2 - gt.y1) + (dt.x2 - dt.x1) * (dt.y2 - dt.y1) AS areas FROM gt JOIN dt USING (video_id, frame, lane)),
met AS (SELECT *, i / (areas - i) AS sim FROM inters WHERE i > 0),
near AS (SELECT video_id, frame, category_id, t FROM met WHERE sim >= 0.5), kept AS (SELECT DISTINCT video_id, category_id, t FROM near),
own AS (SELECT video_id, category_id, frame, g, t, guess, (SELECT max(lv) FROM levels WHERE sim >= lv / 20.0 - 2.220446049250313e-16) AS level FROM met SEMI JOIN kept USING (video_id, category_id, t)),
rest_g AS (SELECT video_id, category_id, frame, g, row_number() OVER (PARTITION BY video_id, category_id, frame ORDER BY g) AS r FROM gt ANTI JOIN own USING (video_id, category_id, frame, g)),
rest_t AS (SELECT video_id, category_id, frame, t, guess, row_number() OVER (PARTITION BY video_id, category_id, frame ORDER BY t) AS r FROM (SELECT kept.category_id, dt.* FROM dt JOIN kept USING (video_id, t)) ANTI JOIN own USING (video_id, category_id, frame, t)),
matched AS (SELECT * FROM own UNION ALL SELECT video_id, category_id, frame, g, t, guess, 0 FROM rest_g JOIN rest_t USING (video_id, category_id, frame, r)),
hits AS (SELECT matched.*, lv FROM matched JOIN levels ON level >= lv),
n AS (SELECT video_id, category_id, g, t, lv, count(*) AS n FROM hits GROUP BY ALL),
g_n AS (SELECT video_id, g, count(*) AS g_n FROM gt GROUP BY ALL), t_n AS (SELECT video_id, t, count(*) AS t_n FROM dt GROUP BY ALL),
assoc AS (SELECT video_id, category_id, lv, sum(n) AS loc_tp, sum(n * n / (g_n + t_n - n)) AS a, sum(n * n / g_n) AS re, sum(n * n / t_n) AS pr FROM n JOIN g_n USING (video_id, g) JOIN t_n USING (video_id, t) GROUP BY ALL),
fp AS (SELECT video_id, category_id, lv, count(*) FILTER (coalesce(m.level, -1) < lv) AS loc_fp FROM near LEFT JOIN matched m USING (video_id, category_id, frame, t), levels GROUP BY ALL),
cls AS (SELECT video_id, category_id, lv, count(*) FILTER (guess = category_id) AS cls_tp FROM hits GROUP BY ALL),
wrong AS (SELECT video_id, guess AS category_id, lv, count(*) AS cls_fp FROM hits WHERE guess <> category_id
  AND (category_id > guess OR EXISTS (SELECT 1 FROM kept k WHERE k.video_id = hits.video_id AND k.category_id = hits.guess)) GROUP BY ALL),
extra AS (SELECT video_id, guess AS category_id, count(*) AS extra FROM dt WHERE NOT EXISTS (SELECT 1 FROM near WHERE near.video_id = dt.video_id AND near.frame = dt.frame AND near.category_id = dt.guess AND near.t = dt.t) GROUP BY ALL),
gold AS (SELECT video_id, category_id, count(*) AS gold FROM gt GROUP BY ALL),
pairs AS (SELECT video_id, category_id FROM gt UNION SELECT video_id, guess FROM dt),
counts AS (
  SELECT video_id, category_id, lv / 20.0::DOUBLE AS alpha, coalesce(loc_tp, 0)::BIGINT AS loc_tp, (coalesce(gold, 0) - coalesce(loc_tp, 0))::BIGINT AS loc_fn, coalesce(loc_fp, 0) AS loc_fp,
    coalesce(a, 0) / greatest(1, coalesce(loc_tp, 0)) AS assoc_a, coalesce(re, 0) / greatest(1, coalesce(loc_tp, 0)) AS assoc_re, coalesce(pr, 0) / greatest(1, coalesce(loc_tp, 0)) AS assoc_pr,
    CASE WHEN lv >= 10 THEN coalesce(cls_tp, 0) END AS cls_tp, CASE WHEN lv >= 10 THEN (coalesce(loc_tp, 0) - coalesce(cls_tp, 0))::BIGINT END AS cls_fn, CASE WHEN lv >= 10 THEN coalesce(cls_fp, 0) + coalesce(extra, 0) END AS cls_fp
  FROM pairs CROSS JOIN levels LEFT JOIN gold USING (video_id, category_id) LEFT JOIN assoc USING (video_id, category_id, lv) LEFT JOIN fp USING (video_id, category_id, lv)
    LEFT JOIN cls USING (video_id, category_id, lv) LEFT JOIN wrong USING (video_id, category_id, lv) LEFT JOIN extra USING (video_id, category_id))"""


@query("i18_teta", "fx_track_frames", "fx_pred_frames")
def teta(g: DataFrame, p: DataFrame) -> DataFrame:
    return te.teta_counts(g, confused(p), exhaustive=True)


@query("i18_teta_apart", "fx_track_frames", "fx_pred_frames", sql=f"{APART} SELECT * FROM counts")
def teta_apart(g: DataFrame, p: DataFrame) -> DataFrame:
    return te.teta_counts(apart(g), apart(confused(p), 1000), exhaustive=True)


#: Categories 1 and 2 below 10, 3 below 11, both below 100.
TREE = [(1, 10), (2, 10), (3, 11), (10, 100), (11, 100)]
FLOATS = ["loc_a", "loc_re", "loc_pr", *te.SHARES, "cls_a", "cls_re", "cls_pr", "teta"]
_SUMS = ", ".join([f"sum({c})::BIGINT AS {c}" for c in te.COUNTS] + [f"sum({c} * loc_tp) / greatest(1, sum(loc_tp)) AS {c}" for c in te.SHARES])
_SCORED = """*, loc_tp / greatest(1, loc_tp + loc_fn + loc_fp) AS loc_a, loc_tp / greatest(1, loc_tp + loc_fn) AS loc_re, loc_tp / greatest(1, loc_tp + loc_fp) AS loc_pr,
 avg(cls_tp / greatest(1, cls_tp + cls_fn + cls_fp)) OVER (PARTITION BY {0}) AS cls_a, avg(cls_tp / greatest(1, cls_tp + cls_fn)) OVER (PARTITION BY {0}) AS cls_re, avg(cls_tp / greatest(1, cls_tp + cls_fp)) OVER (PARTITION BY {0}) AS cls_pr"""
_ALL = ", ".join([*te.COUNTS, *FLOATS])


@query(
    "i19_combine_classes",
    "fx_track_frames",
    "fx_pred_frames",
    sql=f"""{APART.replace("WITH gt AS", "WITH RECURSIVE gt AS", 1).strip()},
tree(c, p) AS (VALUES {", ".join(map(str, TREE))}), up(c, a) AS (SELECT c, p FROM tree UNION SELECT up.c, p FROM up JOIN tree ON tree.c = up.a),
per AS (SELECT category_id, alpha, {_SUMS} FROM counts GROUP BY ALL), classes AS (SELECT q.*, (loc_a + assoc_a + cls_a) / 3 AS teta FROM (SELECT {_SCORED.format("category_id")} FROM per) q),
filled AS (SELECT category_id FROM classes GROUP BY ALL HAVING max(loc_tp + loc_fn + loc_fp) > 0),
tops AS (SELECT a AS category_id, alpha, {_SUMS} FROM per JOIN up ON up.c = per.category_id GROUP BY ALL)
SELECT 'class' AS kind, category_id::BIGINT AS category_id, alpha, {_ALL} FROM classes
UNION ALL SELECT 'average', NULL, alpha, {", ".join(f"sum({c})::BIGINT" for c in te.COUNTS)}, {", ".join(f"avg({c})" for c in FLOATS)} FROM classes SEMI JOIN filled USING (category_id) GROUP BY alpha
UNION ALL SELECT 'above', category_id::BIGINT, alpha, {_ALL} FROM (SELECT q.*, (loc_a + assoc_a + cls_a) / 3 AS teta FROM (SELECT {_SCORED.format("category_id")} FROM tops) q) z""",
)
def combined_classes(g: DataFrame, p: DataFrame) -> DataFrame:
    per = co.combined(te.teta_counts(apart(g), apart(confused(p), 1000), exhaustive=True), ["category_id", "alpha"], te.COUNTS, te.SHARES, "loc_tp")
    classes = te.teta_scores(per, ["category_id"])
    average = co.class_averaged(classes, ["alpha"], "category_id", te.COUNTS, FLOATS, ["loc_tp", "loc_fn", "loc_fp"])
    tree = g.sparkSession.createDataFrame(TREE, "category_id long, parent long")
    above = te.teta_scores(co.super_categories(per, co.ancestors(tree), ["alpha"], te.COUNTS, te.SHARES, "loc_tp"), ["category_id"])
    rows = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("category_id").cast("long").alias("category_id"), "alpha", *te.COUNTS, *FLOATS)
    return rows(classes, "class").unionByName(rows(average.withColumn("category_id", F.lit(None)), "average")).unionByName(rows(above, "above"))


HEIGHT, WIDTH = 16, 24


def mask_columns(boxes: DataFrame, item: str, name: str) -> DataFrame:
    """Run-length masks of boxes at a quarter of their size, less their lower right corner."""
    x1, y1, x2, y2 = (F.floor(F.col(c) / 4).cast("long") for c in ("x1", "y1", "x2", "y2"))
    x = F.explode(F.sequence(x1, x2)).alias("x")
    rows = boxes.select("*", x, y1.alias("top"), y2.alias("bottom"), x2.alias("right")).where(f"x < {WIDTH}")
    low = F.least(F.when(F.col("x") == F.col("right"), F.col("bottom")).otherwise(F.col("bottom") + 1), F.lit(HEIGHT))
    runs = {"height": F.lit(HEIGHT).cast("long"), "width": F.lit(WIDTH).cast("long"), "run_start": F.col("x") * HEIGHT + F.col("top"), "run_end": F.col("x") * HEIGHT + low}
    extra = ["score"] if "score" in boxes.columns else []
    return rows.select("image_id", F.col(item).alias(name), *extra, *[c.alias(k) for k, c in runs.items()])


PIXELS = f"""SELECT DISTINCT image_id, {{1}} AS id, x, unnest(range(floor(y1 / 4)::BIGINT, least(CASE WHEN x = floor(x2 / 4)::BIGINT THEN floor(y2 / 4)::BIGINT ELSE floor(y2 / 4)::BIGINT + 1 END, {HEIGHT}))) AS y
 FROM (SELECT *, unnest(range(floor(x1 / 4)::BIGINT, floor(x2 / 4)::BIGINT + 1)) AS x FROM {{0}}) q WHERE x < {WIDTH}"""
EDGE = f"""SELECT image_id, id, x, y FROM (
 SELECT image_id, id, cx AS x, cy AS y, count(*) AS n FROM (
  SELECT image_id, id, unnest(CASE WHEN x = {WIDTH - 1} THEN [x, x, x - 1] ELSE [x, x - 1] END) AS cx, y FROM {{0}}) p,
  LATERAL (SELECT unnest(CASE WHEN p.y = {HEIGHT - 1} THEN [p.y, p.y, p.y - 1] ELSE [p.y, p.y - 1] END) AS cy) l
 WHERE cx >= 0 AND cy >= 0 GROUP BY ALL) q WHERE n < 4"""
NEAR = f"SELECT DISTINCT image_id, id, x + dx AS x, y + dy AS y FROM {{0}}, (VALUES (-1), (0), (1)) u(dx), (VALUES (-1), (0), (1)) v(dy) WHERE x + dx BETWEEN 0 AND {WIDTH - 1} AND y + dy BETWEEN 0 AND {HEIGHT - 1}"


@query(
    "i12_boundary_f",
    "fx_boxes",
    "fx_dets",
    sql=f"""WITH g AS ({PIXELS.format("{fx_boxes}", "box_id")}), d AS ({PIXELS.format("{fx_dets}", "det_id")}), ge AS ({EDGE.format("g")}), de AS ({EDGE.format("d")}), gn AS ({NEAR.format("ge")}), dn AS ({NEAR.format("de")}),
pairs AS (SELECT DISTINCT image_id, g.id FROM g JOIN d USING (image_id, id)),
n AS (SELECT image_id, id, (SELECT count(*) FROM ge WHERE ge.image_id = p.image_id AND ge.id = p.id) AS n_g, (SELECT count(*) FROM de WHERE de.image_id = p.image_id AND de.id = p.id) AS n_d,
  (SELECT count(*) FROM ge SEMI JOIN dn USING (image_id, id, x, y) WHERE ge.image_id = p.image_id AND ge.id = p.id) AS hit_g, (SELECT count(*) FROM de SEMI JOIN gn USING (image_id, id, x, y) WHERE de.image_id = p.image_id AND de.id = p.id) AS hit_d FROM pairs p),
s AS (SELECT image_id, id, CASE WHEN n_d = 0 THEN 1 WHEN n_g = 0 THEN 0 ELSE hit_d / n_d END AS pr, CASE WHEN n_g = 0 THEN 1 WHEN n_d = 0 THEN 0 ELSE hit_g / n_g END AS re FROM n)
SELECT image_id, id AS g, id AS d, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS f FROM s""",
)
def boundary_scores(b: DataFrame, x: DataFrame) -> DataFrame:
    gold, found = mq.column_runs(mask_columns(b, "box_id", "g"), ["image_id", "g"]), mq.column_runs(mask_columns(x, "det_id", "d"), ["image_id", "d"])
    pairs = gold.select("image_id", "g").distinct().join(found.select("image_id", F.col("d").alias("g")).distinct(), ["image_id", "g"]).withColumn("d", F.col("g"))
    return mq.boundary_f(pairs, gold, found, mq.boundary_radius())


@query("i12_cgf1_extended", "fx_boxes", "fx_dets")
def extended(b: DataFrame, x: DataFrame) -> DataFrame:
    gold = mask_columns(b.where("image_id % 11 <> 0"), "box_id", "g")  # images of other ids have no gold: the negative ones
    return mq.cgf1_extended(gold, mask_columns(x, "det_id", "d"), b.select("image_id").union(x.select("image_id")), mq.boundary_radius(), 0.3)
