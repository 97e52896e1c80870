"""Top-k search with repeated ids, empty and huge vectors, against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from arrowlake.llm import topk_search as T


def test_rows_repeating_an_id_are_candidates_of_each_other(spark):
    rng = random.Random(1)
    rows = [(20, [1.0, 0.5]), (20, [1.0, 0.5]), (21, [0.25, 0.25]), (40, []), (20, [-2.0, 3.0])] + [(rng.randint(0, 60), [rng.randint(-8, 8) / 4, rng.randint(-8, 8) / 4]) for _ in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumn("query_row", F.lit("clash"))
    out = T.top_k_search(df, F.col("vec_id") % 20 == 0, k=5, query_block=3, shard_rows=9, merge_fan_in=2).collect()
    scaled = [(i, np.floor(64 * np.array(v + [0.0] * (2 - len(v))))) for i, v in rows]
    wanted = []
    for n, (q, v) in enumerate(scaled):
        if q % 20 == 0:
            best = sorted((-int(v @ w), i) for m, (i, w) in enumerate(scaled) if m != n)[:5]
            wanted.append((q, [(i, -s) for s, i in best]))
    got = {}
    for r in out:
        got.setdefault((r.query_id, r.query_row), []).append((r["rank"], r.candidate_id, r.score))
    assert sorted(wanted) == sorted((q, [x[1:] for x in sorted(v)]) for (q, _), v in got.items())


def test_huge_components_saturate(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, -1.0]), (2, [-1e308, 5.0]), (3, [0.1, 0.2]), (4, [float("inf"), 1.0]), (5, None), (6, [1.0, None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {r.candidate_id: r.score for r in T.top_k_search(df, F.col("vec_id") == 0).collect()}
    assert out == {1: (1 << 63) - 1, 2: -(1 << 63), 3: (1 << 63) - 1}
