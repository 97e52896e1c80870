"""Fuzzy lookup by signatures and drawn combinations against brute force."""

import itertools
import math
import random

from pyspark.sql import functions as F

from arrowlake.operators import datasets, graphs, repair
from arrowlake.operators.fuzzy import candidates


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(rng, text, edits, letters="abcd é"):
    for _ in range(edits):
        i, what = rng.randint(0, len(text)), rng.randint(0, 2)
        text = text[:i] + (rng.choice(letters) if what else "") + text[i + (what != 1) :]
    return text


def test_no_near_pair_is_lost(spark):
    rng = random.Random(1)
    words = {"", "a", "aa", "a" * 30} | {"".join(rng.choice("abcd é") for _ in range(rng.randint(0, 40))) for _ in range(120)}
    asked = {changed(rng, w, rng.randint(0, 3)) for w in words for _ in range(3)} | {"aaaaaaaab"}
    a = spark.createDataFrame([(1, x) for x in asked], "k int, q string")
    b = spark.createDataFrame([(1, x) for x in words] + [(2, "other"), (1, None)], "k int, w string")
    got = {(r.q, r.w) for r in candidates(a, b, ["k"], "q", "w", F.lit(2), 2).collect()}
    assert {(q, w) for q in asked for w in words if distance(q, w) <= 2} <= got
    ratio = {(r.q, r.w) for r in candidates(a.where("q <> ''"), b, ["k"], "q", "w", F.floor(0.15 / 0.85 * F.col("length") + 1e-9).cast("int"), 0).collect()}
    near = {(q, w) for q in asked for w in words if q and distance(q, w) <= 0.15 * max(len(q), len(w))}
    assert near <= ratio
    many = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(12, 20))) for _ in range(300)]
    few = spark.createDataFrame([(1, changed(rng, w, 1)) for w in many], "k int, q string")
    found = candidates(few, spark.createDataFrame([(1, w) for w in many], "k int, w string"), ["k"], "q", "w", F.lit(2), 2)
    assert 300 <= found.count() < 9000  # of 90,000 pairs


def test_snapping_and_resolving_as_by_all_pairs(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc ") for _ in range(rng.randint(2, 16))).strip() or "x" for _ in range(60)})
    asked = sorted({changed(rng, rng.choice(words), rng.randint(0, 3), "abcx") for _ in range(150)} | {"ABC"})
    fields = spark.createDataFrame([(1, t) for t in asked], "graph_id int, text string")
    out = {r.text: r.snapped for r in repair.snap_to_vocab(fields, spark.createDataFrame([(1, w) for w in words], "graph_id int, word string")).collect()}
    for t in asked:
        near = sorted((distance(t.lower(), w.lower()), w) for w in words if distance(t.lower(), w.lower()) <= 2 and abs(len(t) - len(w)) <= 2)
        alone = near and near[0][0] > 0 and (len(near) == 1 or near[1][0] > near[0][0])
        assert out[t] == (near[0][1] if alone else t), (t, near[:3])
    labels = sorted({" ".join(rng.choice(["load", "file", "check", "node", "value"]) for _ in range(rng.randint(1, 5))) for _ in range(40)})
    nodes = spark.createDataFrame([(1, n, n.title(), i) for i, n in enumerate(labels)], "graph_id int, n string, display string, first_pos int")
    queries = [changed(rng, rng.choice(labels), rng.randint(0, 3), "abcx") for _ in range(120)] + ["", None, "zz"]
    found = graphs.resolve_node(spark.createDataFrame([(1, i, q) for i, q in enumerate(queries)], "graph_id int, query_id int, query string"), nodes)
    got = {r.query_id: r.n for r in found.collect()}
    for i, q in enumerate(queries):
        plain = " ".join((q or "").split())
        sims = [(1 - distance(plain, n) / max(len(plain), len(n)), -k, n) for k, n in enumerate(labels)]
        best = max(sims)
        assert got[i] == (plain if plain in labels else best[2] if plain and best[0] >= 0.85 - 1e-12 else None), (q, best)


def test_unranking_covers_all_subsets():
    for n, k in [(1, 1), (6, 1), (7, 3), (9, 9), (8, 5)]:
        assert sorted(map(tuple, (datasets.unranked(r, k) for r in range(math.comb(n, k))))) == sorted(itertools.combinations(range(n), k))
    big = datasets.unranked(math.comb(10**6, 9) - 1, 9)
    assert big == list(range(10**6 - 9, 10**6))


def test_drawn_groups(spark):
    sizes = {1: 2, 2: 3, 3: 7, 4: 400, 5: 3000}
    arrows = spark.createDataFrame([(g, 10 * a) for g, n in sizes.items() for a in range(n)], "graph_id long, arrow_id long")
    out = {}
    for r in datasets.k_groups_combos(arrows, 3).collect():
        out.setdefault(r.graph_id, []).append(tuple(r.ids))
    assert out[1] == [(0, 10)] and out[2] == [(0, 10, 20)]
    for g, n in sizes.items():
        if n >= 3:
            assert len(out[g]) == len(set(out[g])) == min(math.comb(n, 3), 3 * math.ceil(n / 3))
            assert all(a < b < c for a, b, c in out[g])
    means = [sum(x[i] for x in out[5]) / len(out[5]) / 30000 for i in range(3)]
    assert all(abs(m - e) < 0.03 for m, e in zip(means, (0.25, 0.5, 0.75)))
    assert sorted(map(tuple, (r.ids for r in datasets.k_groups_combos(arrows.where("graph_id = 3"), 3, mul=-1).collect()))) == sorted(itertools.combinations(range(0, 70, 10), 3))
    again = {tuple(r.ids) for r in datasets.k_groups_combos(arrows.where("graph_id = 4").repartition(5), 3).collect()}
    assert again == set(out[4])


def test_small_vocabularies_need_no_signatures(spark, monkeypatch):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abC") for _ in range(rng.randint(1, 7)))
    words = [(k, word()) for k in range(6) for _ in range(4 if k else 90)] + [(7, None), (8, "abc")]
    texts = [(k, word()) for k in range(8) for _ in range(40)] + [(8, None), (9, "abc")]
    fields, vocab = spark.createDataFrame(texts, "graph_id int, text string"), spark.createDataFrame(words, "graph_id int, word string")
    held = lambda df: sorted((r.graph_id, r.text or "-", r.snapped or "-") for r in df.collect())
    mixed = held(repair.snap_to_vocab(fields, vocab, min_len=2, reserved=("aa",)))
    monkeypatch.setattr(repair, "MOST_WORDS", 0)
    assert mixed == held(repair.snap_to_vocab(fields, vocab, min_len=2, reserved=("aa",)))
    monkeypatch.undo()
    few, none = fields.where("graph_id > 0"), vocab.where("graph_id > 0")
    monkeypatch.setattr(repair, "candidates", None)
    assert held(repair.snap_to_vocab(few, none, min_len=2, reserved=("aa",))) == [x for x in mixed if x[0] > 0]
