"""The Jaccard join on null and repeated ids, very long texts and copies, against brute force."""

import collections
import itertools
import random
import re
import time

from pyspark.sql import functions as F

from arrowlake.llm import ngram_join as N


def shingles(t, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return set() if not w else {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def plain_components(rows, percent=85):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((parent[i], parent[j]))
            parent = [a if p == b else p for p in parent]
    least = {}
    for (i, _), p in zip(rows, parent):
        if i is not None:
            least[p] = min(i, least.get(p, i))
    return [(i, len(s), least.get(p) if s else i) for (i, _), s, p in zip(rows, sets, parent)]


def prose(rng, n):
    return [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 99)) for _ in range(n)]


def test_null_and_repeated_ids_against_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(25):
        base = prose(rng, rng.randint(30, 90))
        for _ in range(rng.randint(1, 4)):
            near = list(base)
            near[rng.randrange(len(near))] = "new"
            rows.append((rng.choice([None, None, 5, rng.randint(0, 10**6)]), " ".join(rng.choice([base, near]))))
    rows += [(None, rows[0][1])] * 30 + [(5, rows[1][1])] * 30 + [(None, None), (None, ""), (7, " \n"), (8, "one"), (None, "ONE"), (None, "one")]
    long = prose(rng, 60_000)
    rows += [(900, " ".join(long)), (901, " ".join(long[:-40])), (None, " ".join(long[40:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("key", F.lit("clash")).withColumn("rep", F.lit(1))
    out = [(r.doc_id, r.n_shingles, r.component_id) for r in N.jaccard_components(df).collect()]
    assert collections.Counter(out) == collections.Counter(plain_components(rows))


def test_many_different_texts_without_an_id_cost_no_square(spark):
    rng = random.Random(6)
    rows = [(None, " ".join(prose(rng, 40))) for _ in range(6000)]
    rows += [(None, t + " end") for _, t in rows[:2000]]
    start = time.time()
    out = N.jaccard_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).groupBy("component").count().groupBy("count").count().toDF("size", "n")
    assert {r.size: r.n for r in out.collect()} == {1: 4000, 2: 2000}
    assert time.time() - start < 150
