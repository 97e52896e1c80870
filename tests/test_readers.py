"""Readers on files of every shape in use, and the sinks."""

import json

from arrowlake.functions.text import math_label
from arrowlake.sources import markup, readers


def put(folder, name, body):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body if isinstance(body, str) else json.dumps(body))
    return str(path)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


TRIPLET = ("graph_id", "src", "rel", "dst")


def test_predictions(spark, tmp_path):
    put(tmp_path, "one/arrow_triplets.json", [{"source_node": "a", "target_node": "b", "condition": "yes", "source_location": "lane"}, {"source": "b", "end": "c"}, {"source_node": "c", "target_node": "Pending"}])
    put(tmp_path, "one/other.json", [{"source_node": "x", "target_node": "y"}])
    assert {(r[0], r[1], r[3]) for r in rows(readers.read_predictions_dir(spark, str(tmp_path)).na.fill(""), *TRIPLET)} == {("one", "a", "b"), ("one", "b", "c")}
    assert ("one", "a", "partof", "lane") in rows(readers.read_predictions_dir(spark, str(tmp_path), located=True).na.fill(""), *TRIPLET)
    path = put(tmp_path, "map.json", {"d/two.png": [{"source_node": "a", "condition": "no", "target_node": "b"}]})
    assert rows(readers.read_predictions_map(spark, path), *TRIPLET) == [("two", "a", "no", "b")]


def test_ground_truths(spark, tmp_path):
    names = put(tmp_path, "names.jsonl", '{"file_name": "a/g1.png"}\n{"file_name": "g2.png"}')
    lines = put(tmp_path, "lines.txt", "<H> s <R> yes <T> t <H> t <R> no <T> u\n<H> p <R> r <T> q")
    assert rows(readers.read_gt_tagged(spark, names, lines), *TRIPLET) == [("g1", "s", "yes", "t"), ("g1", "t", "no", "u"), ("g2", "p", "r", "q")]
    put(tmp_path, "angle/g3.txt", "<a, yes, b>\nnothing\n")
    put(tmp_path, "angle/g4.txt", "nothing\n")
    assert rows(readers.read_gt_angle(spark, str(tmp_path / "angle")), *TRIPLET) == [("g3", "a", "yes", "b")]
    arrow = {"arrow_id": 1, "start_point": ["A", "B"], "end_point": ["C"], "condition": ["yes"], "source_location": "lane 1"}
    put(tmp_path, "points/g5/a.json", {"arrows": [arrow]})
    assert rows(readers.read_gt_points(spark, str(tmp_path / "points")), *TRIPLET) == [("g5", "A", "yes", "C")]
    renamed = spark.createDataFrame([("g5", "image 5")], "a string, b string")
    assert rows(readers.read_gt_hier(spark, str(tmp_path / "points"), renamed), *TRIPLET) == [("image 5", "A", "partof", "lane 1"), ("image 5", "A", "yes", "C")]
    chat = put(tmp_path, "chat.json", [{"id": "g6", "image": "x", "conversations": [{"from": "human", "value": "?"}, {"from": "gpt", "value": "<a, yes, b>\n<a, b>"}]}])
    assert rows(readers.read_gt_chat(spark, chat), *TRIPLET) == [("g6", "a", "yes", "b")]


def test_coco_and_tracks(spark, tmp_path):
    path = put(tmp_path, "coco.json", {"images": [{"id": 0, "width": 640, "height": 480, "file_name": "t.jpg"}], "annotations": [{"id": 0, "image_id": 0, "category_id": 1, "bbox": [1, 2, 3, 4], "area": 12}], "categories": [{"id": 1, "name": "car"}]})
    images, anns, cats = readers.read_coco(spark, path)
    assert (images.first().file_name, anns.first().bbox, cats.first().name) == ("t.jpg", [1.0, 2.0, 3.0, 4.0], "car")
    readers.write_coco(images, anns, cats, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/annotations")).count() == 1
    tracks = [{"video_id": 1, "category_id": 2, "bboxes": [[1, 1, 2, 2], None], "areas": [4, None], "score": 0.5}]
    gold, videos = readers.read_ytvis(spark, put(tmp_path, "gold.json", {"videos": [{"id": 1, "length": 2}], "annotations": [{"id": 7, **tracks[0]}]}))
    r = gold.first()
    assert (r.track_id, r.boxes, r.areas, r.area) == (7, [[1.0, 1.0, 2.0, 2.0], [0.0] * 4], [4.0, 0.0], 2.0) and videos.first().length == 2
    pred, none = readers.read_ytvis(spark, put(tmp_path, "pred.json", [{"video_id": 1, "category_id": 2, "bboxes": [[1, 1, 2, 2]], "score": 0.5}]))
    assert pred.first().areas == [0.0] and none.count() == 0


def test_bpmn_corners(spark):
    text = """<?xml version="1.0"?><bpmn:definitions xmlns:bpmn="x"><bpmn:collaboration id="c"><bpmn:participant id="a" name="Buyer &amp;
      Co" processRef="p1"/><bpmn:messageFlow id="m" sourceRef="t1" targetRef="t9" name="order"/></bpmn:collaboration>
      <bpmn:process id="p1"><bpmn:laneSet><bpmn:lane id="l1" name="Desk"><bpmn:flowNodeRef>t1</bpmn:flowNodeRef></bpmn:lane></bpmn:laneSet>
      <bpmn:userTask id="t1" name="Ask"><bpmn:outgoing>f1</bpmn:outgoing></bpmn:userTask><bpmn:exclusiveGateway id="g1"/><bpmn:subProcess id="s1" name="Inner"><bpmn:task id="deep" name="Deep"/></bpmn:subProcess>
      <bpmn:sequenceFlow id="f1" sourceRef="t1" targetRef="g1"/><bpmn:sequenceFlow id="f2" sourceRef='g1' targetRef="deep" name=" yes "/></bpmn:process>
      <bpmn:process id="p2" name="Seller"><bpmn:task id="t9" name="Sell"/></bpmn:process></bpmn:definitions>"""
    out = {r.flow_id: r for r in markup.bpmn_flows(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert tuple(out["f1"])[2:] == ("Ask", "Buyer & Co", "Desk", "", "exclusiveGateway", "Buyer & Co", "")
    assert tuple(out["f2"])[2:] == ("exclusiveGateway", "Buyer & Co", "", "yes", "deep", None, "")
    assert tuple(out["m"])[2:] == ("Ask", "Buyer & Co", "Desk", "order", "Sell", "Seller", "")


def test_svg_dialects(spark):
    svg = '<svg><path id="L_a_b_0" d="M 0 0 C 1 1 2.5 -2 3e1,4"/><g><path class="djs-connection x" data-element-id="Flow_1" d="m1 2L3 4"/></g><path id="no" d="M1 1L2 2"/></svg>'
    df = spark.createDataFrame([(1, svg)], "doc_id long, text string")
    assert rows(markup.svg_arrow_tips(df, "numbered"), "source_id", "target_id", "prev_x", "prev_y", "tip_x", "tip_y") == [("a", "b", 2.5, -2.0, 30.0, 4.0)]
    assert rows(markup.svg_arrow_tips(df, "connection"), "source_id", "tip_x", "tip_y") == [("Flow_1", 3.0, 4.0)]


def test_math_labels(spark):
    texts = [(r"$\frac{\sqrt{x}}{2}$", "(sqrt(x))/(2)"), (r"a \leq b", "a <=q b"), ("x^{2} + y_{i}", "x^2 + y_i"), ("a \\\\\\\\ b", "a b"), (None, ""), (r"\alpha \cdot \beta", "alpha ·beta")]
    df = spark.createDataFrame([(t,) for t, _ in texts], "t string")
    assert [r.m for r in df.select(math_label(df.t).alias("m")).collect()] == [w for _, w in texts]
