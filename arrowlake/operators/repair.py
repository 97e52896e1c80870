"""Label repair against vocabularies, and what it changed."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import written
from .fuzzy import candidates
from .scoring import rate

#: Words of a key that are compared with each of its texts; a key with more goes by signatures.
MOST_WORDS = 50


def snap_to_vocab(fields: DataFrame, vocab: DataFrame, key: str = "graph_id", text: str = "text", max_dist: int = 2, min_len: int = 0, reserved: tuple[str, ...] = ()) -> DataFrame:
    """``fields`` with ``snapped``: the unique closest word of its vocabulary (case aside, at most ``max_dist`` edits).

    A tie, or a word equal but for case, leaves the text as it is; so do reserved texts and those shorter than
    ``min_len``. A key of at most ``MOST_WORDS`` words has them all compared in the row, which is less work than the
    signatures of one text; larger vocabularies go by signatures.
    """
    words = vocab.select(key, "word").where("word IS NOT NULL").repartition(key).distinct()
    many = written(words.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > MOST_WORDS).select(key))
    if many.isEmpty():
        return _snapped_in_row(fields, words, key, text, max_dist, min_len, reserved)
    few, rest = _snapped_in_row(fields.join(many, key, "left_anti"), words.join(many, key, "left_anti"), key, text, max_dist, min_len, reserved), fields.join(many, key, "left_semi")
    return few.unionByName(_snapped_by_signature(rest, words.join(many, key, "left_semi"), key, text, max_dist, min_len, reserved))


def _snapped_in_row(fields: DataFrame, words: DataFrame, key: str, text: str, max_dist: int, min_len: int, reserved: tuple[str, ...]) -> DataFrame:
    """Each text beside its whole vocabulary, for vocabularies of at most ``MOST_WORDS``."""
    held = words.groupBy(key).agg(F.collect_list("word").alias("words"))
    known = F.transform("words", lambda w: F.struct(F.levenshtein(F.lower(text), F.lower(w), max_dist).alias("dist"), w.alias("word")))
    near = F.array_sort(F.filter(known, lambda c: (c.dist >= 0) & (F.abs(F.length(text) - F.length(c.word)) <= max_dist)))
    asked = F.length(text) >= min_len
    if reserved:
        asked = asked & ~F.lower(text).isin(*reserved)
    rows = fields.join(held, key, "left").withColumn("near", F.when(asked, near)).drop("words")
    first, second = F.get("near", F.lit(0)), F.get("near", F.lit(1))
    sure = (first.dist > 0) & (second.isNull() | (second.dist > first.dist))
    return rows.withColumn("snapped", F.when(sure, first.word).otherwise(F.col(text))).drop("near")


def _snapped_by_signature(fields: DataFrame, vocab: DataFrame, key: str, text: str, max_dist: int, min_len: int, reserved: tuple[str, ...]) -> DataFrame:
    """The same for vocabularies of any size: only pairs that share a signature of ``fuzzy.candidates`` are compared."""
    asked = fields.select(key, text).distinct().where(F.length(text) >= min_len)
    if reserved:
        asked = asked.where(~F.lower(text).isin(*reserved))
    words = vocab.select(key, "word").distinct()
    low_text, low_word = asked.select(key, F.lower(text).alias("low_text")).distinct(), words.select(key, F.lower("word").alias("low_word")).distinct()
    near = candidates(low_text, low_word, [key], "low_text", "low_word", F.lit(max_dist), max_dist).withColumn("dist", F.levenshtein("low_text", "low_word", max_dist)).where("dist >= 0")
    pairs = asked.withColumn("low_text", F.lower(text)).join(near, [key, "low_text"]).join(words.withColumn("low_word", F.lower("word")), [key, "low_word"])
    pairs = pairs.where(F.abs(F.length(text) - F.length("word")) <= max_dist)
    best = pairs.groupBy(key, text).agg(F.min(F.struct("dist", "word")).alias("best"), F.array_sort(F.collect_list("dist")).alias("all"))
    unique = best.where((F.col("best.dist") > 0) & ((F.size("all") == 1) | (F.get("all", F.lit(1)) > F.get("all", F.lit(0))))).select(key, text, F.col("best.word").alias("snapped"))
    return fields.join(unique, [key, text], "left").withColumn("snapped", F.coalesce("snapped", text))


def word_frequencies(texts: DataFrame, text: str) -> DataFrame:
    """(word, freq) of all runs of three or more letters in a corpus, lower-cased."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("t"))
    return counts.join(total).select("word", (F.col("c") / F.col("t")).alias("freq"))


def garbled_flag(texts: DataFrame, freq: DataFrame, keys: list[str], text: str, least: float = 5e-7) -> DataFrame:
    """(keys, garbled): whether any word of three letters or more is rarer than ``least`` in the frequency table."""
    words = texts.select(*keys, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    flags = words.join(freq, "word", "left").groupBy(*keys).agg(F.bool_or(F.coalesce("freq", F.lit(0.0)) < least).alias("garbled"))
    return texts.select(*keys).join(flags, keys, "left").withColumn("garbled", F.coalesce("garbled", F.lit(False)))


def vocab_union(tokens: list[DataFrame], min_score: float) -> DataFrame:
    """Distinct trimmed words of all sources (key, word, score) that score at least ``min_score``."""
    out = tokens[0]
    for t in tokens[1:]:
        out = out.unionByName(t)
    return out.where(F.col("score") >= min_score).select("graph_id", F.trim("word").alias("word")).where("word <> ''").distinct()


def correction_stats(before: DataFrame, after: DataFrame, vocab: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Totals: images, corrected images, images without a vocabulary, triplets, fields changed."""
    changed = sum(((~F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}"))).cast("long") for f in fields), F.lit(0))
    b, a = before.alias("b"), after.alias("a")
    rows = b.join(a, [F.col(f"b.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys], "full")
    per = rows.select(F.coalesce("b.graph_id", "a.graph_id").alias("graph_id"), changed.alias("changed")).groupBy("graph_id").agg(F.count("*").alias("triplets"), F.sum("changed").alias("changed"))
    known = vocab.select("graph_id").distinct().withColumn("known", F.lit(True))
    return per.join(known, "graph_id", "left").agg(
        F.count("*").alias("images"), F.count_if(F.col("changed") > 0).alias("corrected"), F.count_if(F.col("known").isNull()).alias("no_vocab"), F.sum("triplets").alias("triplets"), F.sum("changed").alias("fields_changed")
    )


def score_delta(before: DataFrame, after: DataFrame, key: str = "dataset", metric: str = "f1") -> DataFrame:
    """The metric before and after, and the difference, by data set."""
    both = before.select(key, F.col(metric).alias("before")).join(after.select(key, F.col(metric).alias("after")), key)
    return both.withColumn("delta", F.col("after") - F.col("before"))


def f1_of(hits: str, pred: str, gold: str):
    """F1 from counts, 0 where undefined."""
    return rate(2 * F.col(hits), F.col(pred) + F.col(gold))


def snap_to_vocab_ratio(texts: DataFrame, vocab: DataFrame, key: str = "graph_id", text: str = "text", least: float = 0.3) -> DataFrame:
    """``texts`` with ``snapped``: the vocabulary string of highest sequence-match ratio if it is above ``least``, else the text.

    The ratio (twice the matching characters over all) has no built-in form, so the distinct pairs that share a key
    are rated in Arrow batches; pairs whose lengths alone rule the ratio out never get there.
    """
    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])

    pairs = texts.select(key, text).distinct().join(vocab.select(key, "word").distinct(), key)
    reach = 2 * F.least(F.length(text), F.length("word")) / F.greatest(F.length(text) + F.length("word"), F.lit(1))
    same = pairs.where(F.col(text) == F.col("word")).select(key, text, "word", F.lit(1.0).alias("ratio"))
    rated = pairs.where((reach > least) & (F.col(text) != F.col("word"))).join(same, [key, text], "left_anti").withColumn("ratio", ratio(F.col(text), F.col("word")))
    best = same.unionByName(rated).where(F.col("ratio") > least).groupBy(key, text).agg(F.min(F.struct(-F.col("ratio"), "word")).alias("best"))
    return texts.join(best.select(key, text, F.col("best.word").alias("snapped")), [key, text], "left").withColumn("snapped", F.coalesce("snapped", text))
