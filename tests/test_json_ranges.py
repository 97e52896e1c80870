"""Large JSON files read in ranges, and label files written by tasks."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from arrowlake.sources import json_ranges as jr


def odd_text(rng):
    return "".join(rng.choice(['"', "\\", "{", "}", "[", "]", ",", '"annotations": [', "é", "\n", "a", "\\\\"]) for _ in range(rng.randint(0, 12)))


def document(rng, n):
    items = [{"id": i, "name": odd_text(rng), "annotations": [{"id": -1}], "deep": {"x": [[odd_text(rng)], {}]}} for i in range(n)]
    return {"info": {"annotations": [{"id": -2}], "text": odd_text(rng)}, "images": [{"id": 5}], "annotations": items, "tail": [{"id": -3}]}


def found(path, size, field):
    """The two passes without Spark."""
    rows = []
    for name, n in jr._files(path):
        for start in range(0, n, size):
            behind = min(start, jr.BEHIND)
            data = jr.read_bytes(name, start - behind, behind + size)
            for inside, ends, change, falls, arrays in jr.summaries(data[:behind], data[behind:], jr._escaped_before(name, start), field):
                rows.append({"path": name, "start": start, "starts_inside": inside, "ends_inside": ends, "change": change, "falls": falls, "arrays": [dict(zip(("at", "depth", "closes"), a)) for a in arrays]})
    random.Random(0).shuffle(rows)
    out = []
    for p in jr.true_starts(rows, field):
        out += jr.elements(p["path"], p["start"], size, p["inside"], p["depth"], p["first"], p["last"], 1 if field is None else 2)
    return [json.loads(x) for x in out]


@pytest.mark.parametrize("indent", [None, 2])
def test_ranges_of_any_size_give_the_elements(tmp_path, indent):
    rng = random.Random(3)
    for trial in range(12):
        doc = document(rng, rng.randint(0, 9))
        path = f"{tmp_path}/{trial}.json"
        with open(path, "w") as file:
            json.dump(doc, file, indent=indent, ensure_ascii=trial % 2 == 0)
        for size in (1, 2, 7, 64, 1000, 1 << 20):
            assert found(path, size, "annotations") == doc["annotations"]
            assert found(path, size, "images") == doc["images"]
            assert found(path, size, "none") == []
        with open(path, "w") as file:
            json.dump(doc["annotations"], file, indent=indent)
        for size in (1, 7, 1000):
            assert found(path, size, None) == doc["annotations"]


def test_coco_file_in_many_ranges(spark, tmp_path):
    doc = {
        "categories": [{"id": 1, "name": 'a "quoted" } name'}],
        "images": [{"id": i, "width": 10.0, "height": 5.0, "file_name": f"{i}.jpg"} for i in range(300)],
        "annotations": [{"id": i, "image_id": i % 300, "category_id": 1, "bbox": [i, 1, 2.5, 3], "area": 7.5, "iscrowd": 0, "segmentation": {"size": [5, 10], "counts": "x{[\\\""}} for i in range(2000)],
    }
    with open(f"{tmp_path}/big.json", "w") as file:
        json.dump(doc, file)
    images, annotations, categories = jr.read_coco_ranges(spark, f"{tmp_path}/big.json", 10_000)
    assert annotations.rdd.getNumPartitions() > 10
    assert sorted(r.id for r in images.collect()) == list(range(300)) and categories.first().name == 'a "quoted" } name'
    rows = sorted(annotations.collect(), key=lambda r: r.id)
    assert [(r.id, r.image_id, r.bbox[0], r.area) for r in rows] == [(i, i % 300, float(i), 7.5) for i in range(2000)]
    assert jr.read_tracks_ranges(spark, f"{tmp_path}/big.json").count() == 2000
    assert jr.read_json_array(spark, f"{tmp_path}/big.json", "nothing", "id long").count() == 0


def test_label_files_appear_together(spark, tmp_path):
    rows = [(f"img{i:03d}.txt", f"0 {j} 1 1 1", j) for i in range(120) for j in range(i % 4)] + [("sub/empty.txt", None, 0), (None, "lost", 0)]
    labels = spark.createDataFrame(rows, "name string, line string, no int")
    os.makedirs(f"{tmp_path}/labels")
    jr.write_label_files(labels.where("name NOT LIKE '%/%'").unionByName(labels.where("name LIKE '%/%'").withColumn("name", F.lit("empty.txt"))), f"{tmp_path}/labels", order=["no"])
    files = sorted(os.listdir(f"{tmp_path}/labels"))
    assert files == sorted({r[0] for r in rows if r[0] and "/" not in r[0]} | {"empty.txt"})
    assert open(f"{tmp_path}/labels/img007.txt").read() == "0 0 1 1 1\n0 1 1 1 1\n0 2 1 1 1\n"
    assert os.path.getsize(f"{tmp_path}/labels/empty.txt") == 0

    bad = labels.withColumn("line", F.when(F.col("name") == "img003.txt", F.raise_error(F.lit("broken"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="broken"):
        jr.write_label_files(bad, f"{tmp_path}/other")
    assert not os.path.exists(f"{tmp_path}/other") or os.listdir(f"{tmp_path}/other") == []


def test_small_ranges_share_tasks():
    plans = [{"start": i} for i in range(12_800)]
    made = jr.pieces(plans, 1 << 16)
    assert len(made) == 100 and [p for piece in made for p in piece.plans] == plans
    assert len(jr.pieces(plans, 1 << 30)) == 12_800 and len(jr.pieces(plans[:40], 1 << 16)) == 40 and jr.pieces([], 1 << 16) == []


def test_a_value_that_goes_on_is_read_by_its_own_length(tmp_path, monkeypatch):
    read, sizes = jr.read_bytes, []
    monkeypatch.setattr(jr, "read_bytes", lambda path, start, size: (sizes.append(size), read(path, start, size))[1])
    long = json.dumps({"a": ["x\\\"]" * 5000]})
    (tmp_path / "a.json").write_text('[{"b": 1}, ' + long + ', {"c": 2}]' + " " * 100_000)
    assert jr._read_on(str(tmp_path / "a.json"), 11) == long
    assert sum(sizes) < 8 * len(long)
    sizes.clear()
    assert jr._read_on(str(tmp_path / "a.json"), 1) == '{"b": 1}' and sum(sizes) <= 4096
