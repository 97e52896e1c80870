"""Language scores against a plain restatement of the kernel, and tables with very many languages."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from arrowlake.llm import language_id as L
from arrowlake.llm.hashing import mix, raw_texts

ALPHABETS = {"aa": "abcdefgh  ", "bb": "uvwxyzéabc ", "cc": "klmnoabü "}


def text(rng, lang, n=70):
    return "".join(rng.choice(ALPHABETS[lang]) for _ in range(n))


def slots(t):
    data, out = bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode()), []
    for n, size in L.SPECTRA:
        grams = {int.from_bytes(data[i : i + n], "big") for i in range(len(data) - n + 1)}
        out.append({int(mix(np.array([g + (n << 40)], np.uint64))[0]) % size for g in grams})
    return out


def kernel(a, b):
    return sum(len(x & y) / np.sqrt(max(1, len(x)) * max(1, len(y))) for x, y in zip(slots(a), slots(b))) / len(L.SPECTRA)


def test_scores_against_plain_kernels():
    rng = random.Random(3)
    langs = sorted(rng.choice(list(ALPHABETS)) for _ in range(30))
    taught = [text(rng, x) for x in langs]
    asked = [text(rng, rng.choice(list(ALPHABETS)), rng.randint(2, 90)) for _ in range(50)] + ["A", "Ab", "éé"]
    rows = L.presence(*raw_texts(pa.array(taught)))
    classes, marks, weights = L.fit(rows, langs, landmarks=4, ridge=1e-3)
    got = L.normalised(L.presence(*raw_texts(pa.array(asked)))) @ marks.T @ weights

    chosen = [t for c in sorted(set(langs)) for t in [t for t, x in zip(taught, langs) if x == c][:4]]
    own = np.array([[kernel(a, b) for b in chosen] for a in chosen])
    values, vectors = np.linalg.eigh(own)
    assert values.min() > 1e-6 * values.max()
    root = vectors @ np.diag(values**-0.5) @ vectors.T  # another root of the inverse: scores don't depend on which
    z = np.array([[kernel(a, b) for b in chosen] for a in taught]) @ root
    weight = np.diag([1 / langs.count(x) for x in langs])
    target = np.array([[1.0 if x == c else -1.0 for c in classes] for x in langs])
    plain = np.linalg.solve(z.T @ weight @ z + 1e-3 * len(classes) * np.eye(len(chosen)), z.T @ weight @ target)
    want = np.array([[kernel(a, b) for b in chosen] for a in asked]) @ root @ plain
    assert np.allclose(got, want, atol=1e-4)
    assert (got[:-3].argmax(1) == want[:-3].argmax(1)).all()


def test_many_languages_long_texts_and_ties(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, text(rng, lang), lang) for i, lang in enumerate(list(ALPHABETS) * 60)]
    rows += [(1000 + i, text(rng, "aa"), f"dirty{i}") for i in range(40)]
    rows += [(2000, text(rng, "bb", 300_000), "bb"), (2001, "x", "bb"), (2001, "x", "bb"), (None, text(rng, "cc"), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("mine")).withColumn("lettered", F.lit(1))
    monkeypatch.setattr(L, "MOST_LANGUAGES", 3)
    out = {(r.doc.doc_id, r.doc.text): r for r in L.identify_language(df, F.lit(True)).collect()}
    assert {r.lang_pred for r in out.values()} == set(ALPHABETS) and all(r.doc.lang_pred == "mine" for r in out.values())
    right = [out[i, t].lang_pred == x for i, t, x in rows[:180]]
    assert np.mean(right) > 0.95 and out[rows[-4][0], rows[-4][1]].lang_pred == "bb" and out[None, rows[-1][1]].lang_pred == "cc"
