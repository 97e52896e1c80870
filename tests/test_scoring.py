"""Evaluation regressions with literal rows."""

import pytest
from pyspark.sql import functions as F

from arrowlake.functions.text import edit_similarity
from arrowlake.operators.scoring import part_of, select_scope, triplet_scores, triplet_scores_split

SCHEMA = "graph_id string, src string, rel string, dst string"


def rows(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


def test_missing_diagram_counts_as_misses(spark):
    t = ("start", "connectedto", "end")
    out = triplet_scores(rows(spark, ("one", *t)), rows(spark, ("one", *t), ("two", *t))).first()
    assert (out.total_gt, out.missing, out.precision, out.recall) == (2, 1, 1.0, 0.5)
    assert out.f1 == pytest.approx(2 / 3)


def test_similarity_of_exactly_the_threshold_matches(spark):
    pred, gold = rows(spark, ("one", "abcdefghijklmnopqrst", "yes", "end")), rows(spark, ("one", "abcdefghijklmnopqXYZ", "yes", "end"))
    out = triplet_scores(pred, gold).first()
    assert (out.exact_hits, out.relaxed_hits) == (0, 1)
    s = spark.range(1).select(edit_similarity(F.lit("abcdefghijklmnopqrst"), F.lit("abcdefghijklmnopqXYZ")).alias("s")).first().s
    assert s == pytest.approx(0.85)


def test_containment_without_predictions_has_recall_zero(spark):
    out = {r.kind: r for r in triplet_scores_split(rows(spark).limit(0), rows(spark, ("one", "task", "partof", "lane"))).collect()}
    assert (out["containment"].total_gt, out["containment"].recall, out["overall"].f1) == (1, 0.0, 0.0)


def test_first_fit_is_not_best_fit(spark):
    gold = rows(spark, ("g", "abcdefghij", "r", "x"), ("g", "abcdefghik", "r", "x"))
    pred = rows(spark, ("g", "abcdefghil", "r", "x"))
    assert triplet_scores(pred, gold).first().relaxed_hits == 1


def test_scope(spark):
    gold = rows(spark, *[(g, "a", "b", "c") for g in ("train_one", "test_one", "test_two")])
    listing = spark.createDataFrame([("test_one.png",), ("a/test_two.jpg",)], "file string")
    names = lambda df: {r.graph_id for r in df.collect()}
    assert names(select_scope(gold, listing=listing)) == {"test_one", "test_two"}
    listed = spark.createDataFrame([("test_one",)], "id string")
    assert names(select_scope(gold, listed=listed, listing=listing)) == {"test_one"}
    with pytest.raises(ValueError):
        select_scope(gold, listed=spark.createDataFrame([("none",)], "id string"))


def test_part_of_leaves_out_none(spark):
    a = spark.createDataFrame([("g", "A", "Lane 1", "B", "none"), ("g", "A", "Lane 1", "C", None)], "graph_id string, src string, src_loc string, dst string, dst_loc string")
    assert [tuple(r) for r in part_of(a).collect()] == [("g", "A", "partof", "Lane 1")]
