"""Given targets, fitted and given topics, and odd tables of the mixing operator."""

import random

import numpy as np
from pyspark.sql import functions as F

from arrowlake.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SUBJECTS = [[f"{a}{i}" for i in range(30)] for a in ("ship", "tree", "star", "coin")]


def corpus(rng, n=1200):
    rows = []
    for i in range(n):
        subject = rng.choice([0, 0, 0, 1, 2, 3])
        text = " ".join(["the"] + [rng.choice(SUBJECTS[subject] + ["and", "of"]) for _ in range(rng.randint(8, 60))])
        rows.append((i, text, rng.choice(["en"] * 6 + ["de"] * 2 + ["es"]), "hot" if i % 3 else f"s{rng.randint(0, 3)}", subject))
    return rows


def marginal(out, d):
    cells = out.groupBy(*mixing.DIMENSIONS).agg(F.sum(F.expr("tokens * probability")).alias("sampled")).toPandas()
    return (cells.groupby(d).sampled.sum() / cells.sampled.sum()).to_dict()


def test_given_targets_are_met(spark):
    docs = spark.createDataFrame(corpus(random.Random(1)), DOCS)
    weights = {"lang": {"en": 5, "de": 3, "es": 2}, "source": {"hot": 2, "s0": 1, "s1": 1}}
    out = mixing.mixed(docs, share=0.12, weights=weights, exponents={"topic": 1.0}, topic_col="n_chars").cache()
    lang, source, topic = (marginal(out, d) for d in mixing.DIMENSIONS[1::-1] + mixing.DIMENSIONS[2:])
    assert all(abs(lang[k] - v) < 0.005 for k, v in {"en": 0.5, "de": 0.3, "es": 0.2}.items())
    assert all(abs(source[k] - v) < 0.005 for k, v in {"hot": 0.5, "s0": 0.25, "s1": 0.25, "s2": 0, "s3": 0}.items())
    assert set(topic) == {0, 1, 2, 3}
    assert out.where("source IN ('s2', 's3') AND keep").count() == 0
    kept = out.where("keep").groupBy("lang").agg(F.sum("tokens").alias("t")).toPandas().set_index("lang").t
    assert np.allclose(kept["de"] / kept.sum(), 0.3, atol=0.06)


def test_fitted_topics_follow_the_subjects(spark):
    rows = corpus(random.Random(3), 600) + [(5000, None, "en", "s0", -1), (5001, "", None, None, -1), (5001, " \n", None, None, -1), (None, "ship1 " * 60_000, "en", "s1", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("topic", F.lit("clash")).withColumn("tokens", F.lit(0))
    out = mixing.describe(docs, topics=4).select("doc.doc_id", F.col("doc.n_chars").alias("subject"), "tokens", "topic").toPandas()
    assert len(out) == len(rows)
    assert set(out[out.subject < 0].topic) == {4} and set(out[out.subject < 0].tokens) == {0}
    told = out[out.subject >= 0]
    right = sum(part.topic.value_counts().iloc[0] for _, part in told.groupby("subject"))
    assert right > 0.95 * len(told) and told.groupby("topic").subject.agg(lambda x: x.value_counts(normalize=True).iloc[0]).min() > 0.9
    assert out[out.doc_id.isna()].tokens.tolist() == [60_000]
    assert mixing.describe(docs.limit(0)).count() == 0


def test_topics_are_fitted_on_every_text(spark):
    texts = [row[1] for row in corpus(random.Random(6), 3000)]
    docs = spark.createDataFrame([(t,) for t in [*texts, None, " \n"]], "text string")
    idf, centres = mixing.topic_model(docs, 5)
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in data])])
    words, _, _, first = mixing.WordHasher().words(np.frombuffer(b"".join(data), np.uint8), offsets)
    entries, ends = mixing.word_counts(words, first)
    assert np.array_equal(idf, np.log((1 + len(texts)) / (1 + np.bincount(entries["slot"], minlength=mixing.TOPIC_DIM))) + 0.01)
    x = np.concatenate(list(mixing.vectors(entries, ends, idf)))
    nearest = (x @ centres.T).argmax(1)
    again = np.stack([x[nearest == c].sum(0, dtype=np.float64) for c in range(5)])
    likeness = (again * centres).sum(1) / np.linalg.norm(again, axis=1) / np.linalg.norm(centres, axis=1)
    assert likeness.min() > 0.999  # each centre is that of all the texts nearest to it
    other = mixing.topic_model(docs.repartition(7), 5)
    assert np.array_equal(other[0], idf) and np.array_equal(other[1], centres)
