"""Successors under null, repeated and hot ids; sketches that retain nothing; merging."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from arrowlake.llm import fingerprints as P


def text_hash(spark, texts):
    return {r.t: r.h for r in spark.createDataFrame([(t,) for t in set(texts)], "t string").select("t", F.xxhash64("t").alias("h")).collect()}


@pytest.mark.parametrize("coarse,bucket_rows", [(1000, 5), (4, 5), (4, 40), (1, 7)])
def test_successors_with_hot_null_and_repeated_ids(spark, monkeypatch, coarse, bucket_rows):
    monkeypatch.setattr(P, "COARSE", coarse)
    rng = random.Random(coarse * 100 + bucket_rows)
    rows = [(None, f"n{i}") for i in range(150)] + [(7, f"s{i}") for i in range(150)] + [(9, "same")] * 40
    rows += [(rng.choice([-(1 << 63), (1 << 63) - 1, rng.randrange(-(10**6), 10**6), rng.randrange(50)]), f"t{i}") for i in range(160)]
    rng.shuffle(rows)
    hashes = text_hash(spark, [t for _, t in rows])
    wanted = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], hashes[r[1]], r[1]))
    pairs = collections.Counter((i, t, n[1]) for (i, t), n in zip(wanted, wanted[1:] + wanted[:1]))
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    out = P.with_next(df, "id", "text", ["text"], bucket_rows)
    assert collections.Counter((r.id, r.text, r.next_text) for r in out.collect()) == pairs
    ordered = df.withColumn("order", F.coalesce("id", F.lit(-(1 << 63)))).withColumn("fine", F.xxhash64("text"))
    sizes = [r["count"] for r in P.bucketed(ordered.where("text <> 'same'"), "order", "fine", bucket_rows).groupBy("bucket").count().collect()]
    if coarse == 1000:
        assert max(sizes) <= 12 * bucket_rows  # neither the null nor the hot id fills a bucket


def plain_sketch(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    hashes = [hashlib.md5(" ".join(words[i : i + 5]).encode()).hexdigest()[:12] for i in range(max(len(words) - 5, 0) + 1)]
    return sorted({h for h in hashes if h < "2"})


def test_fingerprints_against_plain_python(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghij") + rng.choice("xyz")
    texts = ["", "a b c", "a b c", "x" * 50_000, *(" ".join(word() for _ in range(rng.choice([3, 9, 15, 60, 400]))) for _ in range(60)), " ".join(word() for _ in range(40_000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("own", F.lit(1)).withColumn("bucket", F.lit(2))
    rows = sorted(P.fingerprint_edits(df).collect())
    whole = lambda t: hashlib.md5(t.encode()).hexdigest()[:12]
    assert any(not plain_sketch(t) for t in texts)
    for r, t, n in zip(rows, texts, texts[1:] + texts[:1]):
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        a, b, c = (plain_sketch(x) for x in (t, edited, n))
        assert r.fingerprint == whole(t) + "".join(a) and r.edited_fingerprint == whole(edited) + "".join(b)
        for x, other, near, contained in ((b, edited, r.near_edited, r.contained_edited), (c, n, r.near_next, r.contained_next)):
            common, union = len(set(a) & set(x)), len(set(a) | set(x))
            assert near == (common / union if union else float(t == other))
            assert contained == (common / len(a) if a else float(t == other))


def test_merged_sketches_are_those_of_the_union(spark):
    rng = random.Random(3)
    a, b = (" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 9)) for _ in range(n)) for n in (300, 9))
    row = spark.range(1).select(P.merge_sketches(P.sketch(F.lit(a)), P.sketch(F.lit(b))).alias("m")).first()
    assert row.m == sorted({*plain_sketch(a), *plain_sketch(b)})


def test_the_plan_does_not_grow_with_the_number_of_buckets(spark):
    rows = spark.range(4000).select(F.col("id").alias("order"), F.xxhash64("id").alias("fine"))
    placed = P.bucketed(rows, "order", "fine", 4)
    assert len(placed._jdf.queryExecution().optimizedPlan().toString()) < 100_000
    assert placed.select("bucket").distinct().count() > 900
