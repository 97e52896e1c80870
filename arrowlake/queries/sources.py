"""Round trips through the file shapes."""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.datasets import ordered_join
from ..plans.materialize import shared_folder
from ..registry import query
from ..sources import diagrams, json_ranges, triplets

DISTINCT = "SELECT DISTINCT graph_id, src, rel, dst FROM {fx_edges}"


@query("a1_read_arrows", "fx_edges", sql="SELECT CAST(graph_id AS STRING) AS graph_id, CAST(arrow_id AS STRING) AS arrow_id, src, rel, dst FROM {fx_edges}")
def annotations(e: DataFrame) -> DataFrame:
    arrow = F.struct(F.col("arrow_id").cast("string").alias("arrow_id"), F.col("src").alias("source_node"), F.array("rel").alias("condition"), F.array("dst").alias("end_point"))
    files = e.groupBy("graph_id").agg(F.to_json(F.struct(F.collect_list(arrow).alias("arrows"))).alias("text"))
    both = files.select(F.concat(F.lit("root/"), F.col("graph_id").cast("string"), F.lit("/a_merged.json")).alias("path"), "text")
    both = both.unionByName(files.select(F.concat(F.lit("root/"), F.col("graph_id").cast("string"), F.lit("/a.json")).alias("path"), F.lit('{"arrows": [{"arrow_id": "0"}]}').alias("text")))
    return triplets.parse_annotations(both).select("graph_id", "arrow_id", F.col("source")[0].alias("src"), F.col("condition")[0].alias("rel"), F.col("target")[0].alias("dst"))


@query("a3_read_predictions_map", "fx_edges", sql="SELECT DISTINCT CAST(graph_id AS STRING) AS graph_id, src, rel, dst FROM {fx_edges}")
def predictions(e: DataFrame) -> DataFrame:
    t = F.struct(F.col("src").alias("source_node"), F.col("rel").alias("condition"), F.col("dst").alias("end"))
    per = e.groupBy("graph_id").agg(F.collect_list(t).alias("all"))
    return triplets.parse_predictions_map(per.select(F.to_json(F.create_map(F.concat(F.lit("a/"), F.col("graph_id").cast("string"), F.lit(".png")), "all")).alias("text")))


@query("a4_read_gt_tagged", "fx_edges", sql="SELECT graph_id, arrow_id - 1 AS no, src, rel, dst FROM {fx_edges}")
def tagged(e: DataFrame) -> DataFrame:
    one = F.concat(F.lit("<H> "), "src", F.lit(" <R> "), "rel", F.lit(" <T> "), "dst")
    out = triplets.parse_tagged(e.groupBy("graph_id").agg(ordered_join("arrow_id", one, " ").alias("text")))
    return out.withColumn("no", F.col("no").cast("long"))


@query("a5_read_gt_angle", "fx_edges", sql="SELECT graph_id, src, rel, dst FROM {fx_edges}")
def angle(e: DataFrame) -> DataFrame:
    line = F.concat(F.lit(" <"), "src", F.lit(", "), "rel", F.lit(", "), "dst", F.lit("> "))
    return triplets.parse_angle(e.select("graph_id", F.explode(F.array(line, F.lit("no triplet"))).alias("line")))


@query("a8_read_gt_chat", "fx_edges", sql="SELECT graph_id, src, rel, dst FROM {fx_edges}")
def chat(e: DataFrame) -> DataFrame:
    lines = ordered_join("arrow_id", F.concat(F.lit("<"), "src", F.lit(", "), "rel", F.lit(", "), "dst", F.lit(">")), "\n")
    talk = F.array(F.struct(F.lit("human").alias("from"), F.lit("?").alias("value")), F.struct(F.lit("gpt").alias("from"), F.concat(F.lit("<a, b>\n"), "lines").alias("value")))
    return triplets.parse_chat(e.groupBy("graph_id").agg(lines.alias("lines")).select(F.col("graph_id").alias("id"), talk.alias("conversations")))


@query("a9_read_coco", "fx_boxes", sql="SELECT image_id, box_id AS id, category_id, x2 - x1 AS w FROM {fx_boxes}")
def coco(b: DataFrame) -> DataFrame:
    ann = F.struct(F.col("box_id").alias("id"), "image_id", "category_id", F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("bbox"))
    texts = b.groupBy((F.col("image_id") % 50).alias("part")).agg(F.to_json(F.struct(F.collect_list(ann).alias("annotations"))).alias("text"))
    return triplets.parse_coco(texts)[1].select("image_id", "id", "category_id", F.col("bbox")[2].alias("w"))


@query("a11_resolve_paths", "fx_boxes", sql="SELECT image_id, box_id, CASE WHEN box_id % 2 = 0 THEN concat('training/fcb/', image_id, '.jpg') ELSE '' END AS resolved FROM {fx_boxes}")
def paths(b: DataFrame) -> DataFrame:
    name = lambda *parts: F.concat(*[F.lit(p) if p.startswith("/") or p.endswith("/") or "." in p else F.col(p).cast("string") for p in parts])
    asked = b.select("image_id", "box_id", F.lit("x").alias("folder"), F.when(F.col("box_id") % 4 == 0, name("/old/training/fcb/", "image_id", ".jpg")).when(F.col("box_id") % 2 == 0, name("fcb/", "image_id", ".jpg")).otherwise("missing.jpg").alias("path"))
    found = triplets.resolve_paths(asked.select("path", "folder").distinct(), b.select(name("training/fcb/", "image_id", ".jpg").alias("file")).distinct())
    return asked.join(found, ["path", "folder"]).select("image_id", "box_id", "resolved")


@query(
    "c1_mermaid_edges",
    "fx_sources",
    sql="""WITH d AS (SELECT graph_id, src, rel AS cond, dst, min(arrow_id) AS p FROM {fx_edges} GROUP BY ALL)
SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY p) AS arrow_id, src, cond, dst FROM d""",
)
def edges(s: DataFrame) -> DataFrame:
    return diagrams.mermaid_edges(s)


@query(
    "c2_mermaid_triplets",
    "fx_sources",
    sql=r"""SELECT DISTINCT graph_id, regexp_replace(lower(replace(src, '_', ' ')), '[^a-z0-9-]', '', 'g') AS src, CASE rel WHEN 'connectedTo' THEN 'connectedto' ELSE lower(rel) END AS rel,
  regexp_replace(lower(dst), '[^a-z0-9-]', '', 'g') AS dst FROM {fx_edges}""",
)
def strict(s: DataFrame) -> DataFrame:
    return diagrams.mermaid_triplets(s)


def _dense(e: DataFrame) -> DataFrame:
    """Declarations, then two edges a line in four spellings, some with escaped quotes; ids are told apart by a letter."""
    s, p = F.concat(F.lit("S"), F.col("suppkey").cast("string")), F.concat(F.lit("P"), F.col("partkey").cast("string"))
    node = F.concat(s, F.lit('[\\"'), "src", F.lit('\\"]; '), p, F.lit("(( "), "dst", F.lit("\u00a0))\n"))
    kind = F.col("arrow_id") % 4
    link = F.when(kind == 0, F.concat(F.lit('-->|"'), "rel", F.lit('"| '))).when(kind == 1, F.concat(F.lit("-- "), "rel", F.lit(" --> "))).when(kind == 2, F.lit("==> ")).otherwise(F.concat(F.lit("-.->|\\'"), "rel", F.lit("\\'|")))
    edge = F.concat(s, F.lit(" "), link, p, F.when(F.col("arrow_id") % 2 == 0, "\n").otherwise("; "))
    return e.groupBy("graph_id").agg(F.concat(F.lit("graph TD\n"), ordered_join("arrow_id", node, ""), ordered_join("arrow_id", edge, "")).alias("text"))


@query(
    "c1_mermaid_edges_dense",
    "fx_edges",
    sql="""WITH d AS (SELECT graph_id, src, CASE WHEN arrow_id % 4 IN (0, 3) THEN rel END AS cond, dst, min(arrow_id) AS p FROM {fx_edges} GROUP BY ALL)
SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY p) AS arrow_id, src, cond, dst FROM d""",
)
def dense_edges(e: DataFrame) -> DataFrame:
    return diagrams.mermaid_edges(_dense(e))


@query(
    "c2_mermaid_triplets_dense",
    "fx_edges",
    sql=r"""SELECT DISTINCT graph_id, regexp_replace(lower(replace(src, '_', ' ')), '[^a-z0-9-]', '', 'g') AS src, CASE rel WHEN 'connectedTo' THEN 'connectedto' ELSE lower(rel) END AS rel,
  regexp_replace(lower(dst), '[^a-z0-9-]', '', 'g') AS dst FROM {fx_edges} WHERE arrow_id % 4 = 0""",
)
def dense_triplets(e: DataFrame) -> DataFrame:
    return diagrams.mermaid_triplets(_dense(e))


def _dot(e: DataFrame) -> DataFrame:
    node = F.concat(F.lit('  P'), F.col("partkey").cast("string"), F.lit(' [shape=box, label="'), "dst", F.lit('"];\n'))
    edge = F.concat(F.lit("  S"), F.col("suppkey").cast("string"), F.lit(" -> P"), F.col("partkey").cast("string"), F.lit(" [label="), "rel", F.lit("];"))
    return e.groupBy("graph_id").agg(F.concat(F.lit("digraph {\n"), ordered_join("arrow_id", F.concat(node, edge), "\n"), F.lit("\n}")).alias("text"))


@query("c3_dot_nodes", "fx_edges", sql="SELECT graph_id, concat('P', partkey) AS id, dst AS text FROM {fx_edges}")
def dot_nodes(e: DataFrame) -> DataFrame:
    return diagrams.dot_nodes(_dot(e))


@query("c3_dot_edge_labels", "fx_edges", sql="SELECT graph_id, concat('S', suppkey) AS s, concat('P', partkey) AS d, rel AS label FROM {fx_edges}")
def dot_edges(e: DataFrame) -> DataFrame:
    return diagrams.dot_edge_labels(_dot(e)).drop("line_no")


@query("c7_immediate_container", "fx_edges", sql="SELECT graph_id, arrow_id, CASE WHEN suppkey % 3 = 0 THEN src WHEN partkey % 2 = 0 THEN dst END AS container FROM {fx_edges}")
def container(e: DataFrame) -> DataFrame:
    lane, pool = F.when(F.col("suppkey") % 3 == 0, F.col("src")).otherwise(""), F.when(F.col("partkey") % 2 == 0, F.col("dst"))
    return e.select("graph_id", "arrow_id", diagrams.immediate_container(lane, pool).alias("container"))


@query(
    "c12_arrowhead_bbox",
    "fx_boxes",
    sql="""WITH v AS (SELECT image_id, box_id, x2 AS tx, y2 AS ty, (x2 - x1) / sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS ux, (y2 - y1) / sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS uy FROM {fx_boxes})
SELECT image_id, box_id, least(tx, tx - ux * 10 - uy * 5, tx - ux * 10 + uy * 5) - 5 AS x1, least(ty, ty - uy * 10 + ux * 5, ty - uy * 10 - ux * 5) - 5 AS y1,
  greatest(tx, tx - ux * 10 - uy * 5, tx - ux * 10 + uy * 5) + 5 AS x2, greatest(ty, ty - uy * 10 + ux * 5, ty - uy * 10 - ux * 5) + 5 AS y2 FROM v""",
)
def head_boxes(b: DataFrame) -> DataFrame:
    box = diagrams.arrowhead_bbox(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), pad=5)
    return b.select("image_id", "box_id", *[v.alias(k) for k, v in box.items()])


@query("c11_polygon_tip_base", "fx_boxes", sql="SELECT image_id, box_id, x1 AS tip_x, y1 AS tip_y, (2 * x2 + x1) / 3 AS base_x, (2 * y2 + y1) / 3 AS base_y FROM {fx_boxes}")
def tips(b: DataFrame) -> DataFrame:
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return b.select("image_id", "box_id", diagrams.polygon_tip_base(F.array(p("x1", "y1"), p("x2", "y1"), p("x2", "y2"), p("x1", "y2"), p("x1", "y1"))).alias("t")).select("image_id", "box_id", "t.*")


def _grouped(e: DataFrame, opening, node, closing: str) -> DataFrame:
    """Texts in which each graph's targets stand in one of two groups, by the parity of their part."""
    side = F.col("partkey") % 2
    body = e.withColumn("side", side).groupBy("graph_id", "side").agg(F.concat(opening(F.col("side")), F.array_join(F.sort_array(F.collect_set(node)), "\n"), F.lit("\n" + closing)).alias("block"))
    return body.groupBy("graph_id").agg(F.array_join(F.sort_array(F.collect_list("block")), "\n").alias("text"))


HELD = "SELECT DISTINCT graph_id, concat('P', partkey) AS id, concat('side ', partkey % 2) AS container FROM {fx_edges}"
NAMED = "SELECT DISTINCT graph_id, concat('P', partkey) AS id, dst AS text FROM {fx_edges}"


def _says(*parts) -> "F.Column":
    return F.concat(*[F.lit(p) if not p.startswith("@") else F.col(p[1:]).cast("string") for p in parts])


@query("c3_dot_containment", "fx_edges", sql=HELD)
def dot_held(e: DataFrame) -> DataFrame:
    text = _grouped(e, lambda s: F.concat(F.lit("subgraph cluster_"), s.cast("string"), F.lit(' {\n label="side '), s.cast("string"), F.lit('";\n')), _says("P", "@partkey", " [shape=box];"), "}")
    return diagrams.dot_containment(text)


@query("c4_mermaid_containment", "fx_edges", sql=HELD)
def mermaid_held(e: DataFrame) -> DataFrame:
    return diagrams.mermaid_containment(_grouped(e, lambda s: F.concat(F.lit("subgraph side "), s.cast("string"), F.lit("\n")), _says("  P", "@partkey", "[x]"), "end"))


@query("c4_mermaid_declared", "fx_edges", sql=NAMED)
def mermaid_named(e: DataFrame) -> DataFrame:
    return diagrams.mermaid_declared(_grouped(e, lambda s: F.concat(F.lit("subgraph side "), s.cast("string"), F.lit("\n")), _says("  P", "@partkey", "[/", "@dst", "/]"), "end"))


@query("c5_plantuml_containment", "fx_edges", sql=HELD)
def plantuml_held(e: DataFrame) -> DataFrame:
    return diagrams.plantuml_containment(_grouped(e, lambda s: F.concat(F.lit('rectangle "side '), s.cast("string"), F.lit('" as Group'), s.cast("string"), F.lit(" {\n")), _says('  rectangle "', "@dst", '" as P', "@partkey"), "}"))


@query("c5_plantuml_nodes", "fx_edges", sql=NAMED)
def plantuml_named(e: DataFrame) -> DataFrame:
    return diagrams.plantuml_nodes(_grouped(e, lambda s: F.concat(F.lit('package "side '), s.cast("string"), F.lit('" as Group'), s.cast("string"), F.lit(" {\n")), _says('  rectangle "', "@dst", '" as P', "@partkey"), "}"))


@query(
    "c6_bpmn_flows",
    "fx_edges",
    sql="""SELECT graph_id AS doc_id, concat('F', arrow_id) AS flow_id, src AS source, concat('pool ', graph_id) AS source_pool, concat('lane ', suppkey % 2) AS source_lane,
  CASE rel WHEN 'connectedTo' THEN '' ELSE rel END AS condition, CASE WHEN partkey % 5 = 0 THEN 'task' WHEN partkey % 7 = 0 THEN concat('P', partkey) ELSE dst END AS target,
  CASE WHEN partkey % 5 <> 0 AND partkey % 7 = 0 THEN NULL ELSE concat('pool ', graph_id) END AS target_pool, '' AS target_lane FROM {fx_edges}""",
)
def bpmn(e: DataFrame) -> DataFrame:
    from ..sources.markup import bpmn_flows

    lane = e.groupBy("graph_id", (F.col("suppkey") % 2).alias("side")).agg(F.array_join(F.collect_set(_says("<bpmn:flowNodeRef>S", "@suppkey", "</bpmn:flowNodeRef>")), "").alias("refs"))
    lanes = lane.groupBy("graph_id").agg(F.array_join(F.collect_list(_says('<bpmn:lane id="l" name="lane ', "@side", '">', "@refs", "</bpmn:lane>")), "").alias("lanes"))
    name = F.when(F.col("partkey") % 5 == 0, "").otherwise(_says(' name="', "@dst", '"'))
    target = F.when((F.col("partkey") % 5 != 0) & (F.col("partkey") % 7 == 0), "").otherwise(F.concat(_says('<bpmn:task id="P', "@partkey", '"'), name, F.lit("/>")))
    cond = F.when(F.col("rel") == "connectedTo", "").otherwise(F.col("rel"))
    flow = F.concat(_says('<bpmn:sequenceFlow id="F', "@arrow_id", '" sourceRef="S', "@suppkey", '" targetRef="P', "@partkey", '" name=" '), cond, F.lit('"/>'))
    parts = e.groupBy("graph_id").agg(F.array_join(F.collect_set(F.concat(_says('<bpmn:userTask name="', "@src", '" id="S', "@suppkey", '"/>'), target)), "\n").alias("nodes"), F.array_join(F.collect_list(flow), "\n").alias("flows")).join(lanes, "graph_id")
    text = _says('<definitions><bpmn:collaboration><bpmn:participant name="pool\n', "@graph_id", '" processRef="p1"/></bpmn:collaboration><bpmn:process id="p1" name="other"><bpmn:laneSet>', "@lanes", "</bpmn:laneSet>", "@nodes", "@flows", "</bpmn:process></definitions>")
    return bpmn_flows(parts.select(F.col("graph_id").alias("doc_id"), text.alias("text")))


@query(
    "c8_inkml_relations",
    "fx_edges",
    sql="""SELECT graph_id AS diagram_id, concat('a', arrow_id) AS arrow_id, CASE WHEN suppkey % 3 = 0 THEN 'No Text' ELSE src END AS source, dst AS target, CASE rel WHEN 'connectedTo' THEN '' ELSE rel END AS condition
FROM {fx_edges} WHERE partkey % 11 <> 0""",
)
def inkml(e: DataFrame) -> DataFrame:
    from ..sources.markup import inkml_relations

    one = lambda i, kind, text: F.struct(i.alias("symbol_id"), F.lit(kind).alias("type"), text.cast("string").alias("text"))
    ids = {k: _says(k, "@arrow_id") for k in "astcr"}
    own = F.when(F.col("suppkey") % 3 == 0, " ").otherwise(F.col("src"))
    symbols = e.select("graph_id", F.explode(F.array(one(ids["a"], "arrow", F.lit(None)), one(ids["s"], "node", own), one(ids["t"], "node", F.lit("?")), one(ids["c"], "text", F.col("dst")), one(ids["r"], "text", F.when(F.col("rel") != "connectedTo", F.col("rel"))))).alias("x")).select(F.col("graph_id").alias("diagram_id"), "x.*")
    rel = lambda k, kind, *refs: F.struct((F.col("arrow_id") * 4 + k).alias("no"), F.lit(kind).alias("type"), F.array(*refs).alias("refs"))
    third = F.when(F.col("partkey") % 11 == 0, ids["c"]).otherwise(F.lit("unknown"))
    relations = e.select("graph_id", F.explode(F.array(rel(0, "arrow_connection", ids["s"], ids["a"], ids["t"], third), rel(1, "text_inside", ids["c"], ids["t"]), rel(2, "arrow_label", ids["a"], ids["r"]))).alias("x")).select(F.col("graph_id").alias("diagram_id"), "x.*")
    return inkml_relations(symbols, relations).drop("no")


@query(
    "c10_svg_arrow_tips",
    "fx_boxes",
    sql="""SELECT image_id AS doc_id, row_number() OVER (PARTITION BY image_id ORDER BY box_id) AS edge_no, concat('entity', box_id) AS source_id, concat('entity', category_id) AS target_id, x1 + 5 AS prev_x, y1 + 2.5::DOUBLE AS prev_y, x2 + 5 AS tip_x, y2 + 2.5::DOUBLE AS tip_y
FROM {fx_boxes} WHERE box_id % 4 <> 0""",
)
def svg(b: DataFrame) -> DataFrame:
    from ..sources.markup import svg_arrow_tips

    kind = F.when(F.col("box_id") % 4 == 0, "label-line").otherwise("edge flowchart-link")
    path = F.concat(F.lit('<path d="M1,1L'), _says("@x1", ",", "@y1", " L", "@x2", " ", "@y2", '" class="'), kind, _says(" LS-entity", "@box_id", " LE-entity", "@category_id", '"/>'))
    texts = b.groupBy("image_id").agg(F.concat(F.lit('<svg viewBox="-5 -2.5 100 100">'), ordered_join("box_id", path, "\n"), F.lit("</svg>")).alias("text"))
    return svg_arrow_tips(texts.select(F.col("image_id").alias("doc_id"), "text"))


def _kept_as_json(rows: DataFrame, record, key: str, field: str | None) -> str:
    """A folder of JSON documents, one for every eighth of the keys, each with all its records in one array."""
    folder = f"{shared_folder(rows.sparkSession)}/json-{uuid.uuid4().hex}"
    name = F.concat((F.col(key) % 8).cast("string"), F.lit(".json")).alias("name")
    head, tail = ("[", "null]") if field is None else (f'{{"info": {{"{field}": [{{}}]}}, "{field}": [', 'null], "end": [{}]}')
    lines = rows.select(name, F.lit(1).alias("no"), F.concat(F.to_json(record), F.lit(",")).alias("line"))
    files = lines.select("name").distinct()
    ends = files.select("name", F.explode(F.array(F.struct(F.lit(0).alias("no"), F.lit(head).alias("line")), F.struct(F.lit(2).alias("no"), F.lit(tail).alias("line")))).alias("e")).select("name", "e.*")
    json_ranges.write_label_files(lines.unionByName(ends), folder, order=["no", "line"])
    return folder


@query("a9_coco_ranges", "fx_boxes", sql="SELECT image_id, box_id, category_id, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h FROM {fx_boxes}")
def coco_ranges(b: DataFrame) -> DataFrame:
    record = F.struct(F.col("box_id").alias("id"), "image_id", "category_id", F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("bbox"), F.lit('"} [\\').alias("note"))
    folder = _kept_as_json(b, record, "image_id", "annotations")
    rows = json_ranges.read_json_array(b.sparkSession, folder, "annotations", json_ranges.COCO["annotations"], 1 << 16)
    return rows.select("image_id", F.col("id").alias("box_id"), "category_id", *[F.col("bbox")[i].alias(c) for i, c in enumerate("xywh")])


@query("a10_tracks_ranges", "fx_pred_frames", sql="SELECT video_id, track_id, count(*) AS frames, sum(x) AS x, max(score) AS score FROM {fx_pred_frames} GROUP BY ALL")
def tracks_ranges(p: DataFrame) -> DataFrame:
    tracks = p.groupBy("video_id", "track_id").agg(F.sort_array(F.collect_list(F.struct("frame", F.array(*"xywh").alias("box")))).alias("f"), F.max("score").alias("score"))
    record = F.struct(F.col("track_id").alias("id"), "video_id", "score", F.col("f.box").alias("bboxes"))
    rows = json_ranges.read_tracks_ranges(p.sparkSession, _kept_as_json(tracks, record, "track_id", None), True, 1 << 14)
    return rows.select("video_id", F.col("id").alias("track_id"), F.size("bboxes").cast("long").alias("frames"), F.aggregate("bboxes", F.lit(0.0), lambda a, x: a + x[0]).alias("x"), "score")


@query("a12_label_files", "fx_boxes", sql="SELECT concat(image_id // 50, '.txt') AS name, string_agg(concat(image_id, ' ', box_id, ' ', category_id), chr(10) ORDER BY image_id, box_id) || chr(10) AS text FROM {fx_boxes} GROUP BY ALL")
def label_files(b: DataFrame) -> DataFrame:
    spark, folder = b.sparkSession, f"{shared_folder(b.sparkSession)}/labels-{uuid.uuid4().hex}"
    name = F.concat(F.expr("image_id div 50").cast("string"), F.lit(".txt"))
    json_ranges.write_label_files(b.select(name.alias("name"), F.concat_ws(" ", "image_id", "box_id", "category_id").alias("line"), "image_id", "box_id"), folder, order=["image_id", "box_id"])
    texts = spark.read.text(folder, wholetext=True)
    return texts.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value").alias("text"))
