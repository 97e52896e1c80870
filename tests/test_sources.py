"""File shapes: path resolution, merged annotations, angle lines, Mermaid, streaming parity."""

import json

from pyspark.sql import functions as F

from arrowlake.operators.tracks import confirmed_tracks
from arrowlake.sources import diagrams, triplets
from arrowlake.streaming.tracks import confirm_available


def test_paths_resolve_relative_and_relocated(spark):
    file = "training/fcb/sample/annotated_images/arrow.jpg"
    listing = spark.createDataFrame([("/new/Dataset/" + file,)], "file string")
    asked = spark.createDataFrame([("fcb/sample/annotated_images/arrow.jpg", "x"), ("/old/machine/Dataset/" + file, "x"), ("missing.jpg", "x")], "path string, folder string")
    out = [r.resolved for r in triplets.resolve_paths(asked, listing, "/new/Dataset/").orderBy(F.length("path")).collect()]
    assert out == ["", "/new/Dataset/" + file, "/new/Dataset/" + file]


def test_annotations_from_files(spark, tmp_path):
    arrow = {"arrow_id": 1, "start_point": ["A", "B"], "target_node": "C || D", "condition": "yes", "arrowhead_bbox": [1, 2, 3, 4.5]}
    for name, body in (("g1/a.json", {"arrows": [arrow]}), ("g1/a_merged.json", {"arrows": [arrow, arrow]}), ("g2/a.json", {"arrows": []}), ("g3/a.json", "not json")):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(body if isinstance(body, str) else json.dumps(body, indent=1))
    out = triplets.read_arrows(spark, str(tmp_path)).collect()
    assert [(r.graph_id, r.source, r.target, r.condition, r.bbox) for r in out] == [("g1", ["A", "B"], ["C", "D"], ["yes"], [1.0, 2.0, 3.0, 4.5])] * 2


def test_angle_lines(spark):
    lines = spark.createDataFrame([("g", "<a, yes, b>"), ("g", "<a, b>"), ("g", "text")], "graph_id string, line string")
    assert [tuple(r) for r in triplets.parse_angle(lines).collect()] == [("g", "a", "yes", "b")]


def test_mermaid(spark):
    text = 'graph TD\nA[short] --> B{"Is it?"}\nB -->|yes| C\nB -- no --> D(End)\nA[longer text] --> B'
    out = diagrams.mermaid_edges(spark.createDataFrame([("g", text)], "graph_id string, text string")).orderBy("arrow_id").collect()
    assert [(r.src, r.cond, r.dst) for r in out] == [("longer text", None, "Is it?"), ("Is it?", "yes", "C"), ("Is it?", None, "End")]


def test_stream_agrees_with_batch(spark):
    rows = [(v, t, n, (n * (t + 2) + v) % 4 != 0) for v in range(2) for t in range(4) for n in range(20)]
    m = spark.createDataFrame(rows, "video_id long, track_id long, frame long, matched boolean")
    assert sorted(confirm_available(m).collect()) == sorted(confirmed_tracks(m).select("video_id", "track_id", "confirmed_at").collect())


def test_mermaid_reads_every_edge_of_a_line(spark):
    lines = [r"A[One]; B((Two)); C{\"Three\"}", "A --> B; B -->|x| C", r"A -- yes --> C; C -.->|\'no\'| A; B ==> D", "A --> B", ""]
    text = "\n".join(lines)
    sources = spark.createDataFrame([("g", text), ("none", None), ("empty", "")], "graph_id string, text string")
    out = [tuple(r) for r in diagrams.mermaid_edges(sources).orderBy("arrow_id").collect()]
    assert out == [("g", 1, "One", None, "Two"), ("g", 2, "Two", "x", "Three"), ("g", 3, "One", None, "Three"), ("g", 4, "Three", "no", "One"), ("g", 5, "Two", None, "D")]
    strict = {tuple(r) for r in diagrams.mermaid_triplets(sources).collect()}
    assert strict == {("g", "one", "connect", "two"), ("g", "two", "x", "three")}


def test_strip_knows_unicode_blanks(spark):
    from pyspark.sql import functions as F

    from arrowlake.functions.text import normalize_label, strip

    blanks = "\u00a0\u3000\u2003\u0085\x1c \t\n"
    df = spark.createDataFrame([(f"{blanks}A b{blanks}",), (blanks,), ("",), (None,), ("a\n",)], "s string")
    assert [r[0] for r in df.select(strip(F.col("s"))).collect()] == ["A b", "", "", None, "a"]
    assert [r[0] for r in df.select(normalize_label(F.col("s"))).collect()] == ["a b", "", "", "", "a"]
