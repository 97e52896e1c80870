"""Spatial queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes as fb
from ..operators import spatial as sp
from ..registry import ORACLE_SQL, query

INTER = "(least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))"
TOUCH = "a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2"
AREA = "({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1)"
IOU = f"({INTER} / ({AREA.format('a')} + {AREA.format('b')} - {INTER}))"
IOM = f"({INTER} / least({AREA.format('a')}, {AREA.format('b')}))"


def nms_sql(source: str, key: str, item: str, overlap: str, final: str, where: str = "true") -> str:
    """The greedy choice as a recursion over ranks; ``overlap`` is the condition under which a and b clash."""
    return f"""WITH RECURSIVE d AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, {item}) AS k FROM {source} WHERE {where}),
e AS (SELECT a.{key.split(',')[0]}, a.k, list(b.k) AS earlier FROM d a JOIN d b USING ({key}) WHERE b.k < a.k AND {overlap} GROUP BY ALL),
s AS (SELECT d.{key}, d.k, coalesce(e.earlier, []) AS earlier FROM d LEFT JOIN e ON e.{key} = d.{key} AND e.k = d.k),
r AS (SELECT DISTINCT {key}, 0::BIGINT AS k, []::BIGINT[] AS kept FROM d
  UNION ALL SELECT r.{key}, s.k, CASE WHEN list_has_any(s.earlier, r.kept) THEN r.kept ELSE list_append(r.kept, s.k) END FROM r JOIN s ON s.{key} = r.{key} AND s.k = r.k + 1),
f AS (SELECT {key}, unnest(arg_max(kept, k)) AS k FROM r GROUP BY {key})
{final}"""


@query(
    "e1_box_conversions",
    "fx_boxes",
    sql="""SELECT image_id, box_id, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h, (x2 - x1) * (y2 - y1) AS area, x1 * 2 AS sx1, y2 * 3 AS sy2,
  x1 - 4 AS ex1, y2 + 4 AS ey2, x1 + (x2 - x1) / 4 AS hx1, y2 - (y2 - y1) / 4 AS hy2 FROM {fx_boxes}""",
)
def conversions(b: DataFrame) -> DataFrame:
    c, s, e, h = fb.to_cxcywh(), fb.scaled(F.lit(2), F.lit(3)), fb.expanded(4), fb.shrunk(0.25)
    return b.select("image_id", "box_id", *[v.alias(k) for k, v in c.items()], fb.area().alias("area"), s["x1"].alias("sx1"), s["y2"].alias("sy2"), e["x1"].alias("ex1"), e["y2"].alias("ey2"), h["x1"].alias("hx1"), h["y2"].alias("hy2"))


PAIRS_SQL = f"""SELECT a.image_id, a.box_id AS a, b.box_id AS b, {IOU} AS iou, {INTER} / ({AREA.format('b')}) AS ioa, {IOM} AS iom,
  {IOU} - (((greatest(a.x2, b.x2) - least(a.x1, b.x1)) * (greatest(a.y2, b.y2) - least(a.y1, b.y1)) - ({AREA.format('a')} + {AREA.format('b')} - {INTER}))
    / ((greatest(a.x2, b.x2) - least(a.x1, b.x1)) * (greatest(a.y2, b.y2) - least(a.y1, b.y1)))) AS giou
FROM {{fx_boxes}} a JOIN {{fx_boxes}} b ON a.image_id = b.image_id AND a.box_id < b.box_id AND {TOUCH}"""


@query("e2_pair_overlap", "fx_boxes", sql=PAIRS_SQL)
def overlaps(b: DataFrame, cell: float | None = None) -> DataFrame:
    pairs = sp.pair_overlap(b, b, ["image_id"], ["iou", "ioa", "iom", "giou"], cell=cell).where("a.box_id < b.box_id")
    return pairs.select("image_id", F.col("a.box_id").alias("a"), F.col("b.box_id").alias("b"), "iou", "ioa", "iom", "giou")


@query("e2_pair_overlap_grid", "fx_boxes", sql=PAIRS_SQL)
def overlaps_by_cell(b: DataFrame) -> DataFrame:
    return overlaps(b, cell=16.0)


@query(
    "e3_point_similarity",
    "fx_boxes",
    "fx_dets",
    sql="""SELECT b.image_id, b.box_id, d.det_id, greatest(0.0::DOUBLE, 1 - sqrt((b.x1 - d.x1) ** 2 + (b.y1 - d.y1) ** 2) / 20) AS similarity FROM {fx_boxes} b JOIN {fx_dets} d USING (image_id)""",
)
def points(b: DataFrame, d: DataFrame) -> DataFrame:
    at = lambda df, k: df.select("image_id", k, F.col("x1").alias("x"), F.col("y1").alias("y"))
    out = sp.point_similarity(at(b, "box_id"), at(d, "det_id"), ["image_id"], 20.0)
    return out.select("image_id", "a.box_id", "b.det_id", "similarity")


@query(
    "e4_merge_near_arrows",
    "fx_boxes",
    "fx_edges",
    sql=f"""WITH RECURSIVE q AS (SELECT b.*, e.src, e.rel, e.dst FROM {{fx_boxes}} b JOIN {{fx_edges}} e ON e.graph_id = b.image_id AND e.arrow_id = b.box_id),
p AS (SELECT a.image_id, a.box_id AS u, b.box_id AS v FROM q a JOIN q b ON a.image_id = b.image_id AND a.box_id <> b.box_id AND {TOUCH}
  AND {IOU} >= 0.6::DOUBLE AND (a.src, a.rel, a.dst) <> (b.src, b.rel, b.dst)),
r AS (SELECT image_id, u, v FROM p UNION SELECT r.image_id, r.u, p.v FROM r JOIN p ON p.image_id = r.image_id AND p.u = r.v),
m AS (SELECT image_id, u, min(v) AS v FROM r GROUP BY ALL),
c AS (SELECT q.*, least(q.box_id, coalesce(m.v, q.box_id)) AS first_id FROM q LEFT JOIN m ON m.image_id = q.image_id AND m.u = q.box_id)
SELECT image_id, first_id AS box_id, count(*) AS members, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, string_agg(src, ' || ' ORDER BY box_id) AS src,
  string_agg(rel, ' || ' ORDER BY box_id) AS rel, string_agg(dst, ' || ' ORDER BY box_id) AS dst FROM c GROUP BY image_id, first_id""",
)
def merged(b: DataFrame, e: DataFrame) -> DataFrame:
    answers = e.select(F.col("graph_id").alias("image_id"), F.col("arrow_id").alias("box_id"), "src", "rel", "dst")
    return sp.merge_near_arrows(b.join(answers, ["image_id", "box_id"]))


CENTRE = "(a.x1 + a.x2) / 2 BETWEEN b.x1 AND b.x2 AND (a.y1 + a.y2) / 2 BETWEEN b.y1 AND b.y2"


@query(
    "e5_assign_heads",
    "fx_dets",
    "fx_boxes",
    sql=f"""WITH m AS (SELECT a.image_id, a.det_id AS head, b.box_id AS arrow, {IOU} AS iou FROM {{fx_dets}} a JOIN {{fx_boxes}} b USING (image_id) WHERE {TOUCH} AND {CENTRE}),
k AS (SELECT *, row_number() OVER (PARTITION BY image_id, head ORDER BY iou DESC, arrow) AS r FROM m)
SELECT d.image_id, d.det_id AS head, k.arrow, k.iou FROM {{fx_dets}} d LEFT JOIN k ON k.image_id = d.image_id AND k.head = d.det_id AND k.r = 1""",
)
def heads(d: DataFrame, b: DataFrame) -> DataFrame:
    return sp.assign_heads(d, b, ["image_id"], "det_id", "box_id")


@query("e6_assign_heads_first", "fx_boxes", "fx_dets", sql=f"SELECT a.image_id, b.box_id AS arrow, min(a.det_id) AS head FROM {{fx_dets}} a JOIN {{fx_boxes}} b USING (image_id) WHERE {CENTRE} GROUP BY ALL")
def first_heads(b: DataFrame, d: DataFrame) -> DataFrame:
    return sp.assign_heads_first(b, d, ["image_id"], "det_id", "box_id")


@query(
    "e7_attach_conditions",
    "fx_dets",
    "fx_boxes",
    sql=f"""WITH w AS (SELECT image_id, box_id, x1 - 20 AS x1, y1 - 20 AS y1, x2 + 20 AS x2, y2 + 20 AS y2 FROM {{fx_boxes}}),
m AS (SELECT a.image_id, a.det_id AS text, b.box_id AS arrow, {IOU} AS iou FROM {{fx_dets}} a JOIN w b USING (image_id) WHERE {TOUCH}),
k AS (SELECT *, row_number() OVER (PARTITION BY image_id, text ORDER BY iou DESC, arrow) AS r FROM m),
j AS (SELECT *, row_number() OVER (PARTITION BY image_id, arrow ORDER BY iou DESC, text) AS q FROM k WHERE r = 1) SELECT image_id, text, arrow, iou FROM j WHERE q = 1""",
)
def conditions(d: DataFrame, b: DataFrame) -> DataFrame:
    return sp.attach_conditions(d, b, ["image_id"], "det_id", "box_id")


@query(
    "e8_classify_text",
    "fx_dets",
    "fx_boxes",
    sql="""SELECT image_id, det_id, EXISTS (SELECT 1 FROM {fx_boxes} b WHERE b.image_id = d.image_id AND d.x1 + 2 >= b.x1 AND d.y1 + 2 >= b.y1 AND d.x2 - 2 <= b.x2 AND d.y2 - 2 <= b.y2) AS is_node FROM {fx_dets} d""",
)
def texts(d: DataFrame, b: DataFrame) -> DataFrame:
    small = d.withColumns(fb.expanded(-2))
    return sp.classify_text(small, b, ["image_id"], "det_id")


@query(
    "e9_nearest_node",
    "fx_dets",
    "fx_boxes",
    sql="""WITH n AS (SELECT image_id, box_id, x1, y1, x2, y2, 'n' || category_id AS text FROM {fx_boxes}),
a AS (SELECT image_id, det_id AS arrow, x1 + 1 AS hx, y1 + 2 AS hy, x1, y1, x2, y2 FROM {fx_dets}),
c AS (SELECT image_id, arrow, hx, hy, unnest([(x1, y1, 0), (x2, y1, -1), (x1, y2, -2), (x2, y2, -3)]) AS p FROM a),
t AS (SELECT image_id, arrow, hx, hy, arg_max((p[1], p[2]), ((p[1] - hx) ** 2 + (p[2] - hy) ** 2, p[3])) AS q FROM c GROUP BY ALL),
d AS (SELECT t.image_id, arrow, box_id, text, sqrt(greatest(x1 - q[1], q[1] - x2, 0) ** 2 + greatest(y1 - q[2], q[2] - y2, 0) ** 2) AS ds,
  sqrt(greatest(x1 - hx, hx - x2, 0) ** 2 + greatest(y1 - hy, hy - y2, 0) ** 2) AS dt FROM t JOIN n USING (image_id)),
s AS (SELECT image_id, arrow, arg_min((box_id, text), (ds, box_id)) AS s, arg_min((box_id, text), (dt, box_id)) AS t FROM d GROUP BY ALL)
SELECT image_id, arrow, s[1] AS source, t[1] AS target FROM s WHERE s[2] <> t[2]""",
)
def nearest(d: DataFrame, b: DataFrame) -> DataFrame:
    arrows = d.withColumns({"hx": F.col("x1") + 1, "hy": F.col("y1") + 2})
    nodes = b.withColumn("text", F.concat(F.lit("n"), F.col("category_id").cast("string")))
    return sp.nearest_node(arrows, nodes, ["image_id"], "det_id", "box_id")


@query("e9_nearest_node_grid", "fx_dets", "fx_boxes")
def nearest_on_grid(d: DataFrame, b: DataFrame) -> DataFrame:
    arrows = d.withColumns({"hx": F.col("x1") + 1, "hy": F.col("y1") + 2})
    nodes = b.withColumn("text", F.concat(F.lit("n"), F.col("category_id").cast("string")))
    return sp.nearest_node(arrows, nodes, ["image_id"], "det_id", "box_id", cell=16.0)


ORACLE_SQL["e9_nearest_node_grid"] = ORACLE_SQL["e9_nearest_node"]


@query(
    "e10_orient_by_points",
    "fx_dets",
    sql="""SELECT image_id, det_id, CASE WHEN det_id % 2 = 0 THEN (x1 - 30) ** 2 + (y1 - 20) ** 2 < (x2 - 30) ** 2 + (y2 - 20) ** 2
  ELSE NOT ((x1 - 50) ** 2 + (y1 - 10) ** 2 < (x2 - 50) ** 2 + (y2 - 10) ** 2) END AS a_is_source FROM {fx_dets}""",
)
def oriented(d: DataFrame) -> DataFrame:
    even = F.col("det_id") % 2 == 0
    rows = d.select("image_id", "det_id", F.col("x1").alias("ax"), F.col("y1").alias("ay"), F.col("x2").alias("bx"), F.col("y2").alias("by"), F.lit(50.0).alias("hx"), F.lit(10.0).alias("hy"), F.when(even, 30.0).alias("fx"), F.when(even, 20.0).alias("fy"))
    return sp.orient_by_points(rows).select("image_id", "det_id", "a_is_source")


@query(
    "e12_clip_and_drop",
    "fx_dets",
    sql="""SELECT image_id, det_id, greatest(0, least(x1 - 5, 50.0::DOUBLE)) AS x1, greatest(0, least(y1 - 5, 30.0::DOUBLE)) AS y1, least(x2 - 5, 50.0::DOUBLE) AS x2, least(y2 - 5, 30.0::DOUBLE) AS y2 FROM {fx_dets}
WHERE greatest(0, least(x1 - 5, 50)) < least(x2 - 5, 50) AND greatest(0, least(y1 - 5, 30)) < least(y2 - 5, 30)""",
)
def clipped(d: DataFrame) -> DataFrame:
    moved = d.select("image_id", "det_id", *[(F.col(c) - 5).alias(c) for c in fb.CORNERS], F.lit(50.0).alias("w"), F.lit(30.0).alias("h"))
    return sp.clip_and_drop(moved, "w", "h").drop("w", "h")


@query(
    "e13_median_area_filter",
    "fx_dets",
    sql="""WITH m AS (SELECT image_id, list_sort(list((x2 - x1) * (y2 - y1))) AS l FROM {fx_dets} GROUP BY image_id)
SELECT d.* FROM {fx_dets} d JOIN m USING (image_id) WHERE len(l) < 3 OR (x2 - x1) * (y2 - y1) >= 0.9::DOUBLE * l[len(l) // 2 + 1]""",
)
def medians(d: DataFrame) -> DataFrame:
    return sp.median_area_filter(d, ["image_id"], 0.9)


FRAMES = "(SELECT video_id, frame, track_id, x AS x1, y AS y1, x + w AS x2, y + h AS y2, score, video_id * 100 + frame AS vf FROM {fx_pred_frames}) z"


@query("e14_nms_frame", "fx_pred_frames", sql=nms_sql(FRAMES, "vf", "track_id", f"{TOUCH} AND {IOU} >= 0.3::DOUBLE", "SELECT d.video_id, d.frame, d.track_id, d.score FROM d JOIN f USING (vf, k)"))
def frame_nms(p: DataFrame) -> DataFrame:
    box = p.select("video_id", "frame", "track_id", "score", *[v.alias(k) for k, v in fb.from_xywh(*[F.col(c) for c in "xywh"]).items()])
    return sp.nms_frames(box, 0.3).select("video_id", "frame", "track_id", "score")


@query(
    "e15_nms_track",
    "fx_pred_frames",
    sql=f"""WITH RECURSIVE b AS (SELECT video_id, frame, track_id, x AS x1, y AS y1, x + w AS x2, y + h AS y2, score FROM {{fx_pred_frames}}),
o AS (SELECT a.video_id, a.track_id AS s, b.track_id AS t, sum(CASE WHEN {TOUCH} THEN {INTER} ELSE 0 END) AS i, sum({AREA.format('a')} + {AREA.format('b')} - CASE WHEN {TOUCH} THEN {INTER} ELSE 0 END) AS u
  FROM b a JOIN b ON a.video_id = b.video_id AND a.frame = b.frame AND a.track_id <> b.track_id GROUP BY ALL),
d AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, track_id) AS k FROM (SELECT video_id, track_id, max(score) AS score FROM b GROUP BY ALL) q),
e AS (SELECT a.video_id, a.k, list(c.k) AS earlier FROM d a JOIN o ON o.video_id = a.video_id AND o.s = a.track_id JOIN d c ON c.video_id = o.video_id AND c.track_id = o.t WHERE c.k < a.k AND i / u >= 0.15::DOUBLE GROUP BY ALL),
z AS (SELECT d.video_id, d.k, coalesce(earlier, []) AS earlier FROM d LEFT JOIN e USING (video_id, k)),
r AS (SELECT DISTINCT video_id, 0::BIGINT AS k, []::BIGINT[] AS kept FROM d UNION ALL
  SELECT r.video_id, z.k, CASE WHEN list_has_any(z.earlier, r.kept) THEN r.kept ELSE list_append(r.kept, z.k) END FROM r JOIN z ON z.video_id = r.video_id AND z.k = r.k + 1),
f AS (SELECT video_id, unnest(arg_max(kept, k)) AS k FROM r GROUP BY video_id) SELECT video_id, track_id, score FROM d JOIN f USING (video_id, k)""",
)
def track_nms(p: DataFrame) -> DataFrame:
    box = p.select("video_id", "frame", "track_id", "score", *[v.alias(k) for k, v in fb.from_xywh(*[F.col(c) for c in "xywh"]).items()])
    return sp.nms_tracks(box, 0.15)


@query("e16_nms_generic", "fx_dets", sql=nms_sql("{fx_dets}", "image_id", "det_id", f"{TOUCH} AND {IOU} > 0.25::DOUBLE", "SELECT image_id, det_id, category_id, x1, y1, x2, y2, score FROM d JOIN f USING (image_id, k)", "score > 0.2"))
def generic_nms(d: DataFrame) -> DataFrame:
    return sp.nms(d, ["image_id"], "det_id", 0.25, strict=True, min_score=0.2)


@query("e17_drop_overlapping_iom", "fx_dets", sql=nms_sql("{fx_dets}", "image_id", "det_id", f"{TOUCH} AND {IOM} > 0.3::DOUBLE", "SELECT image_id, det_id, category_id, x1, y1, x2, y2, score FROM d JOIN f USING (image_id, k)"))
def overlapping(d: DataFrame) -> DataFrame:
    return sp.nms(d, ["image_id"], "det_id", 0.3, kind="iom", strict=True)


@query(
    "e18_suppress_boundary",
    "fx_dets",
    sql="SELECT * FROM {fx_dets} WHERE (x1 + x2) / 2 > 10 AND (x1 + x2) / 2 < 90 AND (y1 + y2) / 2 > 6 AND (y1 + y2) / 2 < 54",
)
def boundary(d: DataFrame) -> DataFrame:
    return sp.suppress_boundary(d, 100.0, 60.0, 0.1)


RUNS = "SELECT image_id, {1} AS box_id, unnest([(x1, x1 + y1 + 1), (x1 + y1 + 6, x1 + y1 + 6 + x2 - x1)]) AS r FROM {0}"


def _runs(df: DataFrame, item: str) -> DataFrame:
    counts = F.array(*[c.cast("long") for c in (F.col("x1"), F.col("y1") + 1, F.lit(5), F.col("x2") - F.col("x1"))])
    return sp.mask_runs(df.select("image_id", F.col(item).alias("box_id"), counts.alias("counts")), ["image_id", "box_id"], "counts")


@query(
    "e19_mask_overlap",
    "fx_boxes",
    "fx_dets",
    sql=f"""WITH a AS ({RUNS.format('{fx_boxes}', 'box_id')}), b AS ({RUNS.format('{fx_dets}', 'det_id')}),
sa AS (SELECT image_id, box_id, sum(r[2] - r[1])::BIGINT AS area_a FROM a GROUP BY ALL), sb AS (SELECT image_id, box_id, sum(r[2] - r[1])::BIGINT AS area_b FROM b GROUP BY ALL),
i AS (SELECT a.image_id, a.box_id, sum(greatest(0, least(a.r[2], b.r[2]) - greatest(a.r[1], b.r[1])))::BIGINT AS inter FROM a JOIN b USING (image_id, box_id) GROUP BY ALL)
SELECT image_id, box_id, area_a, area_b, inter, inter::DOUBLE / (area_a + area_b - inter) AS iou FROM sa JOIN sb USING (image_id, box_id) JOIN i USING (image_id, box_id)""",
)
def masks(b: DataFrame, d: DataFrame) -> DataFrame:
    return sp.mask_overlap(_runs(b, "box_id"), _runs(d, "det_id"), ["image_id", "box_id"])


@query(
    "e20_point_edge_distance",
    "fx_boxes",
    "fx_dets",
    sql="SELECT b.image_id, b.box_id, d.det_id, d.x1 - b.x1 AS l, d.y1 - b.y1 AS t, b.x2 - d.x1 AS r, b.y2 - d.y1 AS b FROM {fx_boxes} b JOIN {fx_dets} d USING (image_id)",
)
def edges(b: DataFrame, d: DataFrame) -> DataFrame:
    points = d.select("image_id", "det_id", F.col("x1").alias("x"), F.col("y1").alias("y"))
    return sp.point_edge_distance(points, b, ["image_id"]).select("image_id", "a.box_id", "b.det_id", "l", "t", "r", F.col("b_").alias("b"))


@query(
    "e21_mask_union_box",
    "fx_boxes",
    sql=f"""WITH a AS ({RUNS.format('{fx_boxes}', 'box_id')}), c AS (SELECT DISTINCT image_id, unnest(range(r[1]::BIGINT, r[2]::BIGINT)) AS i FROM a)
SELECT image_id, count(*) AS area, min(i // 60) AS x1, min(i % 60) AS y1, max(i // 60) + 1 AS x2, max(i % 60) + 1 AS y2 FROM c GROUP BY image_id""",
)
def unions(b: DataFrame) -> DataFrame:
    union = sp.mask_union(_runs(b, "box_id").select("image_id", "run_start", "run_end"), ["image_id"])
    area = union.groupBy("image_id").agg(F.sum(F.col("run_end") - F.col("run_start")).alias("area"))
    return area.join(sp.mask_to_box(union, ["image_id"], 60), "image_id")
