"""The quality classifier: rates against a simulation, statistics against plain Python, odd tables and other scripts."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arrowlake.llm import quality as Q
from arrowlake.llm.hashing import WordHasher, blocks, raw_texts


@pytest.mark.parametrize("detection", [0.5, 0.7])
@pytest.mark.parametrize("share", [0.1, 0.3])
def test_rates_of_simulated_labellers_are_recovered(detection, share):
    rng = np.random.default_rng(1)
    bad = rng.random(20_000) < share
    false = np.array([0.2, 0.02, 0.05, 0.1, 0.03, 0.01, 0.15, 0.05])
    found = rng.uniform(detection - 0.2, detection + 0.2, 8)
    objects = rng.random((20_000, 8)) < np.where(bad[:, None], found, false)
    silent = rng.random((20_000, 8)) < 0.05
    votes = np.where(silent, 1, np.where(objects, 0, 2))
    patterns = (votes @ 3 ** np.arange(8)).tolist()
    posterior, rates = Q.fit_votes(collections.Counter(patterns), 8)
    assert np.abs(rates[1, :, 0] - 0.95 * false).max() < 0.03 and np.abs(rates[0, :, 0] - 0.95 * found).max() < 0.03
    kept = np.array([posterior[p] >= 0.5 for p in patterns])
    assert kept[~bad].mean() > 0.95


def plain_em(patterns, labellers, rounds):
    rows = [([p // 3**j % 3 for j in range(labellers)], c) for p, c in sorted(patterns.items())]
    post = [(0.95, 0.5, 0.05)[min(2, v.count(0))] for v, _ in rows]
    for _ in range(rounds):
        like = []
        for side in (0, 1):
            weights = [c * (p if side else 1 - p) for (_, c), p in zip(rows, post)]
            total = sum(weights)
            every = sum(c for _, c in rows)
            rate = [[(sum(w for (v, _), w in zip(rows, weights) if v[j] == x) + 1) / (total + 3) for x in range(3)] for j in range(labellers)]
            like.append([(total + 1) / (every + 2) * np.prod([rate[j][x] for j, x in enumerate(v)]) for v, _ in rows])
        post = [g / (g + b) for b, g in zip(*like)]
    return post


def test_expectation_maximisation_against_plain_python():
    rng = random.Random(4)
    patterns = {rng.randrange(3**5): rng.randint(1, 40) for _ in range(60)}
    got, _ = Q.fit_votes(patterns, 5, rounds=7)
    assert np.allclose([got[k] for k in sorted(patterns)], plain_em(patterns, 5, 7), atol=1e-9)


def plain_statistics(text):
    marks, symbols = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), set("#$%&*|~^=<>{}[]\\@_")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    n, size = max(len(words), 1), max(len(text), 1)
    ups, downs = sum("A" <= c <= "Z" for c in text), sum("a" <= c <= "z" for c in text)
    content = sum(c not in marks and not ord(c) <= 32 for c in text)
    grams = lambda k: [tuple(lower[i : i + k]) for i in range(len(lower) - k + 1)]
    has_digit = lambda w: any("0" <= c <= "9" for c in w)
    upper = lambda w: [c for c in w if "A" <= c <= "Z"]
    some, enough = len(words) >= 10, len(words) >= 20
    return [
        sum(c in symbols for c in text) / size,
        sum(any(c in symbols for c in w) and not set(w) <= marks for w in words) / n,
        sum(set(w) <= marks for w in words) / n,
        sum(c in marks for c in text) / content if content >= 100 else 0,
        ups / (ups + downs) if ups + downs > 20 else 0,
        sum(len(upper(w)) >= 3 and not any("a" <= c <= "z" for c in w) for w in words) / n,
        text.count("!") / n,
        sum(any(a == b and a in marks for a, b in zip(w, w[1:])) for w in words) / n,
        sum(a == b for a, b in zip(lower, lower[1:])) / n if some else 0,
        1 - len(set(grams(3))) / len(grams(3)) if enough else 0,
        max(collections.Counter(lower).values()) / n if enough else 0,
        1 - len(set(grams(2))) / len(grams(2)) if some else 0,
        (2 * n) ** 0.5 / len(set(lower)) if some else 0,
        sum(len(w) > 22 and not has_digit(w) for w in words) / n,
        sum(min(len(w), 22) for w in words) / n,
    ]


def test_statistics_against_plain_python():
    rng = random.Random(2)
    pieces = ["the", "The", "of,", "!!", "a***b", "###", "HELLO!!", "x|", "|", "größer", "déjà-vu", "2024", "ab12cd34ef56ab12cd34ef56", "superlongwordwithoutanyend", "A", "\n", "\t", "“quoted”"]
    texts = ["", " ", "one", "!!", *(" ".join(rng.choice(pieces[: rng.randint(1, len(pieces))]) for _ in range(rng.randint(1, 60))) for _ in range(200))]
    data, offsets = raw_texts(pa.array(texts))
    got = np.vstack([Q.statistics(part, at, WordHasher()) for _, _, part, at in blocks(data, offsets, 500)])
    assert np.allclose(got, [plain_statistics(t) for t in texts])


CLEAN = [
    "Сегодня в городе открылась новая выставка современного искусства, которая продлится до конца следующего месяца. Посетители смогут увидеть произведения художников из двадцати стран.",
    "आज शहर में आधुनिक कला की एक नई प्रदर्शनी शुरू हुई जो अगले महीने के अंत तक चलेगी। दर्शक बीस देशों के कलाकारों की कृतियाँ देख सकेंगे।",
    "今天，这座城市开设了一场新的现代艺术展览，展览将持续到下个月底。观众可以看到来自二十个国家的艺术家的作品。博物馆每天开放，周一除外。",
    "Σήμερα άνοιξε στην πόλη μια νέα έκθεση σύγχρονης τέχνης που θα διαρκέσει μέχρι το τέλος του επόμενου μήνα.",
    "Die Donaudampfschifffahrtsgesellschaft fährt heute nicht mehr, weil der Fluss zu wenig Wasser führt und niemand mitfahren will.",
]


def prose(rng, n=80):
    return " ".join(rng.choice(["the", "of", "and", "a", "in", "river", "stone", "window", "garden", "letter", "market", "winter"]) + rng.choice(["", "", "s", ",", "."]) for _ in range(n))


def test_other_scripts_long_texts_and_clashing_columns(spark):
    rng = random.Random(3)
    good = [prose(rng) for _ in range(150)] + CLEAN + [prose(rng, 60_000)]
    junk = ["again " * 50, " | ".join(prose(rng).split()), prose(rng).upper().replace(" ", "!! "), " ".join(w + "###" for w in prose(rng).split())] * 5 + [" | ".join(prose(rng, 60_000).split())]
    rows = [(i % 40, t, True, "mine", "c") for i, t in enumerate(good + junk)] + [(None, t, None, None, "c") for t in (None, "", " \n")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, quality_keep boolean, quality_score string, score string")
    out = Q.scored(df).select("doc.text", F.col("doc.quality_score").alias("own"), "quality_score", "quality_keep").toPandas()
    verdict = dict(zip(out.text, out.quality_keep))
    assert len(out) == len(rows) and set(out.own.dropna()) == {"mine"}
    assert all(verdict[t] for t in good) and not any(verdict[t] for t in [*junk, None, "", " \n"])
    assert out.groupby("text").quality_score.nunique().max() == 1
    assert sorted(Q.quality_scores(df).columns) == sorted(df.columns)
    assert Q.quality_scores(df.limit(0)).count() == 0
