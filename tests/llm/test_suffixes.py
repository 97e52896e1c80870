"""Crowded anchors, long texts and repeated ids of the repeat removal, against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrowlake.llm import suffix_dedup as S


def plain(texts, length):
    data = [(t or "").encode() for t in texts]
    places = collections.defaultdict(list)
    for i, b in enumerate(data):
        for p in range(len(b) - length + 1):
            places[b[p : p + length]].append((i, p))
    gone = [np.zeros(len(b), bool) for b in data]
    for found in places.values():
        if len(found) > 1:
            for i, p in found:
                gone[i][p : p + length] = True
    runs = [int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum()) for g in gone]
    return [(len(b), int(g.sum()), n, hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest()) for b, g, n in zip(data, gone, runs)]


def corpus(rng):
    noise = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, line = noise(55), noise(11)
    texts = [noise(rng.randint(0, 60)) + passage[rng.randint(0, 15) : rng.randint(30, 55)] + noise(rng.randint(0, 60)) for _ in range(60)]
    texts += [noise(rng.randint(5, 40)) + line + noise(rng.randint(5, 40)) for _ in range(60)]
    texts += [texts[0]] * 3 + [passage * 3, "aaaa" * 40, "ab" * 70, None, "", "x", noise(9000) + passage + noise(3000)]
    return texts


@pytest.mark.parametrize("hot", [0, 3, 20_000])
def test_crowded_anchors_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "CHUNK", 4096)
    texts = corpus(random.Random(hot))
    rows = [(rng_id, t) for rng_id, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("key", F.lit("clash")).withColumn("n_bytes", F.lit(0))
    out = {r.doc_id: tuple(r)[1:] for r in S.remove_repeats(df, 24, 8).collect()}
    assert [out[i] for i in range(len(texts))] == plain(texts, 24)


def test_null_and_repeated_ids_are_reported_as_they_come(spark):
    texts = corpus(random.Random(9))[:40]
    df = spark.createDataFrame([(rng, t) for rng, t in zip([None, 5] * 20, texts)], "doc_id long, text string")
    out = collections.Counter((r.doc_id, *tuple(r)[1:]) for r in S.remove_repeats(df, 24, 8).collect())
    assert out == collections.Counter((i, *w) for i, w in zip([None, 5] * 20, plain(texts, 24)))


def test_sorted_suffixes_tell_what_rows_share():
    rng = np.random.default_rng(1)
    rows, anchor = rng.integers(0, 2, (80, 13)).astype(np.uint8), rng.integers(0, 3, 80)
    order, common = S.sorted_suffixes(anchor, rows)
    for depth in range(14):
        got = S.classes(order, common, depth)
        want = [(a, r[:depth].tobytes()) for a, r in zip(anchor, rows)]
        assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(80) for j in range(80))
