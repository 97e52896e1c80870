"""Mixing documents to target weights by iterative proportional fitting.

Token counts are summed to cells (source, language, topic). Raking scales the cells until their sums over each
dimension meet the target marginals; each document is then kept with its cell's calibrated probability, decided
by a hash of the document, so that a rerun or a lost executor gives the same sample. Topics are given by a column, or
are the nearest of a few centres, which spherical k-means finds among the hashed word weights of all texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import checkpointed, written
from .hashing import WordHasher, blocks, mix, raw_texts

TOPICS, TOPIC_DIM, TOPIC_ROUNDS, TOPIC_STARTS, ROWS_AT_ONCE = 16, 1 << 10, 15, 5, 512
#: Unit vectors are rounded to whole numbers at this scale: products of two stay below 2^24 and their sums are whole,
#: so that no order of rows, batches or tasks changes a topic.
UNIT = 4000
SEED_DRAWS, ENOUGH_GAIN = 4, 1e-4
COUNTED = np.dtype([("slot", "<u2"), ("log", "<f2")])
DIMENSIONS = ("source", "lang", "topic")
NONE = "(none)"
#: A cell table of up to so many rows is raked in the driver and broadcast; a larger one is raked and joined by shuffles.
BROADCAST_CELLS = 100_000


def word_counts(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entries, ends): slot and log count of each text's hashed words, by text and slot, and where each text's begin and end."""
    entries, ends = [np.zeros(0, COUNTED)], [np.zeros(1, np.int64)]
    for lo in range(0, len(first) - 1, ROWS_AT_ONCE):
        at = first[lo : lo + ROWS_AT_ONCE + 1]
        rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
        slots = rows * TOPIC_DIM + (mix(words[at[0] : at[-1]]) % np.uint64(TOPIC_DIM)).astype(np.int64)
        counts = np.bincount(slots, minlength=(len(at) - 1) * TOPIC_DIM)
        some = np.flatnonzero(counts)
        part = np.empty(len(some), COUNTED)
        part["slot"], part["log"] = some % TOPIC_DIM, np.log1p(counts[some])
        entries.append(part)
        ends.append(ends[-1][-1] + np.searchsorted(some, TOPIC_DIM * np.arange(1, len(at))))
    return np.concatenate(entries), np.concatenate(ends)


def whole_units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, rounded to whole numbers at the scale ``UNIT``."""
    return np.rint(x * (UNIT / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))).astype(np.float32)


def vectors(entries: np.ndarray, ends: np.ndarray, idf: np.ndarray) -> Iterator[np.ndarray]:
    """Whole unit vectors of tf-idf, a block of texts at a time."""
    for lo in range(0, len(ends) - 1, ROWS_AT_ONCE):
        at = ends[lo : lo + ROWS_AT_ONCE + 1]
        part = entries[at[0] : at[-1]]
        n, slot = len(at) - 1, part["slot"].astype(np.int64)
        row, value = np.repeat(np.arange(n), np.diff(at)), part["log"].astype(np.float32) * idf[slot]
        size = np.sqrt(np.bincount(row, np.square(value), n))
        x = np.zeros((n, TOPIC_DIM), np.float32)
        x.reshape(-1)[row * TOPIC_DIM + slot] = np.rint(value * (UNIT / np.maximum(size, 1e-12))[row])
        yield x


def apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """1 - cosine of each row and its nearest centre."""
    size = np.sqrt(np.square(x, dtype=np.float64).sum(1)[:, None] * np.square(centres, dtype=np.float64).sum(1)[None])
    away = (1 - (x @ centres.T) / np.maximum(size, 1e-12)).min(1)
    return np.where(away > 1e-6, away, 0.0)


def first_centres(x: np.ndarray, weight: np.ndarray, topics: int) -> np.ndarray:
    """Spherical k-means of weighted vectors, the best of a few starts at far-apart ones."""
    best, found = -1.0, x[:1]
    for seed in range(TOPIC_STARTS):
        rng = np.random.default_rng(seed)
        centres = x[rng.choice(len(x), p=weight / weight.sum())][None]
        while len(centres) < min(topics, len(x)):
            away = weight * apart(x, centres)
            if not away.any():
                break
            centres = np.vstack([centres, x[rng.choice(len(x), p=away / away.sum())]])
        for _ in range(TOPIC_ROUNDS):
            nearest = (x @ centres.T).argmax(1)
            sums = np.stack([weight[nearest == c] @ x[nearest == c] for c in range(len(centres))])
            centres = np.where(sums.any(1, keepdims=True), whole_units(sums), centres)
        fit = float((x @ centres.T).max(1) @ weight)
        if fit > best:
            best, found = fit, centres
    return found


def _counted():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            data, offsets = raw_texts(batch.column("text"))
            for i, j, part, at in blocks(data, offsets):
                words, _, _, first = hasher.words(part, at)
                entries, ends = word_counts(words, first)
                x = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(COUNTED.itemsize * ends), pa.py_buffer(entries)])
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, j - i), x.cast(pa.binary())], names=["key", "x"])

    return run


def _entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = raw_texts(batch.column("x"))
    return data[offsets[0] : offsets[-1]].view(COUNTED), (offsets - offsets[0]) // COUNTED.itemsize


def _in_texts():
    """Of each task: the number of texts with a word in each slot, and under the slot ``TOPIC_DIM`` that of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(TOPIC_DIM + 1, np.int64)
        for batch in batches:
            held[:-1] += np.bincount(_entries(batch)[0]["slot"], minlength=TOPIC_DIM)
            held[-1] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held))), pa.array(held)], names=["slot", "n"])

    return run


def _drawn(idf: np.ndarray, centres: np.ndarray, draw: int, most: int):
    """Of each task: the ``most`` distinct texts that come first, each at a rate of its distance from the nearest centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[float, int, bytes]] = {}
        for batch in batches:
            key = batch.column("key").to_numpy()
            part = [apart(x, centres) if len(centres) else np.ones(len(x)) for x in vectors(*_entries(batch), idf)]
            rate = np.concatenate(part) if part else np.zeros(0)
            luck = ((mix(key.view(np.uint64) ^ mix(np.array([draw + 1], np.uint64))) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
            order = np.divide(-np.log(luck), rate, out=np.full(len(rate), np.inf), where=rate > 0)
            _, one = np.unique(key, return_index=True)
            one = one[np.isfinite(order[one])]
            for i in one[np.argsort(order[one], kind="stable")][:most].tolist():
                best[int(key[i])] = (float(order[i]), int(key[i]), batch.column("x")[i].as_py())
            best = {k[1]: k for k in sorted(best.values())[:most]}
        rows = list(zip(*best.values(), strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.float64(), pa.int64(), pa.binary()), strict=True)], names=["order", "key", "x"])

    return run


def _summed(idf: np.ndarray, centres: np.ndarray):
    """Of each task: the sum of the vectors nearest to each centre; under two more slots their number and their likeness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centres), TOPIC_DIM + 2), np.int64)
        for batch in batches:
            for x in vectors(*_entries(batch), idf):
                likeness = x @ centres.T
                nearest = likeness.argmax(1)
                own = (nearest == np.arange(len(centres))[:, None]).astype(np.float32)
                total[:, :TOPIC_DIM] += (own @ x).astype(np.int64)
                total[:, TOPIC_DIM] += np.bincount(nearest, minlength=len(centres))
                total[:, TOPIC_DIM + 1] += np.bincount(nearest, likeness.max(1), len(centres)).astype(np.int64)
        topic, slot = total.nonzero()
        yield pa.RecordBatch.from_arrays([pa.array(topic), pa.array(slot), pa.array(total[topic, slot])], names=["topic", "slot", "n"])

    return run


def _described(topics: int, model):
    """Tokens and topic of each text; without a model the topic is not worked out."""

    def nearest(words: np.ndarray, first: np.ndarray) -> np.ndarray:
        idf, centres = model.value
        found = np.concatenate([(x @ centres.T).argmax(1) for x in vectors(*word_counts(words, first), idf)])
        return np.where(np.diff(first) > 0, found, topics)

    @F.arrow_udf("tokens long, topic long")
    def described(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = WordHasher()
        for text in texts:
            data, offsets = raw_texts(text)
            tokens, topic = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, part, at in blocks(data, offsets):
                words, _, _, first = hasher.words(part, at)
                tokens.append(np.diff(first))
                topic.append(nearest(words, first) if model is not None else np.full(len(first) - 1, topics))
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(tokens), pa.int64()), pa.array(np.concatenate(topic), pa.int64())], names=["tokens", "topic"])

    return described


def topic_model(texts: DataFrame, topics: int = TOPICS) -> tuple[np.ndarray, np.ndarray]:
    """(weight of each word slot, centres): spherical k-means on tf-idf over every row of the one column ``text``.

    Frequencies are counted over all texts with words. Far-apart texts are drawn from all in a few passes, by a hash and at
    rates of their distances from those drawn before, and weighted by the texts that they are nearest to; their own
    clusters are the first centres. Each round then assigns all texts and sums all their vectors, until the likeness
    gains less than ``ENOUGH_GAIN`` of itself, or for ``TOPIC_ROUNDS``. A row counts as often as it occurs.
    """
    keyed = texts.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(F.xxhash64("text").alias("key"), "text")
    counted = written(keyed.mapInArrow(_counted(), "key long, x binary"))
    held = np.zeros(TOPIC_DIM + 1)
    for r in counted.mapInArrow(_in_texts(), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        held[r.slot] = r.n
    idf, centres = np.log((1 + held[-1]) / (1 + held[:-1])) + 0.01, np.zeros((0, TOPIC_DIM), np.float32)
    if not held[-1]:
        return idf, np.zeros((1, TOPIC_DIM), np.float32)
    for draw in range(SEED_DRAWS):
        rows = counted.mapInArrow(_drawn(idf, centres, draw, 2 * topics), "order double, key long, x binary")
        drawn = rows.dropDuplicates(["key"]).orderBy("order", "key").limit(2 * topics).select("x").collect()
        entries = [np.frombuffer(r.x, COUNTED) for r in drawn]
        ends = np.cumsum([0, *map(len, entries)])
        centres = np.vstack([centres, *vectors(np.concatenate(entries), ends, idf)]) if drawn else centres

    def sums(centres: np.ndarray) -> np.ndarray:
        total = np.zeros((len(centres), TOPIC_DIM + 2))
        added = counted.mapInArrow(_summed(idf, centres), "topic long, slot long, n long").groupBy("topic", "slot").agg(F.sum("n").alias("n")).toPandas()
        total[added.topic, added.slot] = added.n
        return total

    centres, fit = first_centres(centres, sums(centres)[:, TOPIC_DIM], topics), 0.0
    for _ in range(TOPIC_ROUNDS):
        total = sums(centres)
        new = total[:, TOPIC_DIM + 1].sum()
        centres = np.where(total[:, [TOPIC_DIM]] > 0, whole_units(total[:, :TOPIC_DIM]), centres)
        if new <= fit * (1 + ENOUGH_GAIN):
            break
        fit = new
    return idf, centres


def describe(
    docs: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topics: int = TOPICS, topic_col: str | None = None
) -> DataFrame:
    """(doc, source, lang, tokens, topic): the row as a struct and its cell.

    Tokens are words of the whole text. The topic is the number of the nearest centre of ``topic_model``, and the
    further topic ``topics`` for a text without words; with ``topic_col``, a whole number, it is that column (null is
    ``topics``). A null source or language is a value of its own.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    given = [] if topic_col is None else [F.coalesce(F.col(f"`{topic_col}`").cast("long"), F.lit(topics).cast("long")).alias("given")]
    rows = docs.select(
        whole.alias("doc"),
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NONE)).alias(n) for c, n in ((source_col, "source"), (lang_col, "lang"))],
        *given,
        F.explode(F.array(F.col(f"`{text_col}`").cast("string"))).alias("text"),  # a column: Spark takes no lambdas in a function's argument
    )
    model = None if given else docs.sparkSession.sparkContext.broadcast(topic_model(rows.select("text"), topics))
    rows = rows.withColumn("found", _described(topics, model)(F.col("text")))
    topic = F.col("given") if given else F.col("found.topic")
    return rows.select("doc", "source", "lang", F.col("found.tokens").alias("tokens"), topic.alias("topic"))


def tempered(cells: DataFrame, dimension: str, exponent: float) -> DataFrame:
    """Target shares of a dimension: its token shares to the power ``exponent``, made to sum to 1."""
    sums = cells.groupBy(dimension).agg(F.sum("tokens").alias("t")).where("t > 0").select(dimension, F.pow("t", F.lit(exponent)).alias("target"))
    total = sums.agg(F.sum("target")).first()[0] or 1.0
    return sums.select(dimension, (F.col("target") / total).alias("target"))


def reachable(cells: DataFrame, target: DataFrame, dimension: str, share: float) -> DataFrame:
    """``target`` as far as a sample of ``share`` of all tokens can meet it without taking a document twice.

    A value whose tokens fall short of its target is wanted whole, and what it lacks goes to the other values in
    proportion to their targets; each round of the loop finds the values that this makes whole in their turn.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    held = cells.groupBy(dimension).agg((F.sum("tokens") / F.lit(share * total)).alias("held")).join(target.hint("merge"), dimension)
    held, factor = checkpointed(held), 1.0
    while True:
        whole = F.col("held") <= F.col("target") * factor
        taken, rest = held.agg(F.sum(F.when(whole, F.col("held"))), F.sum(F.when(~whole, F.col("target")))).first()
        new = (1 - (taken or 0.0)) / rest if rest else factor
        if new <= factor * (1 + 1e-9):
            break
        factor = new
    return held.select(dimension, F.least("held", F.col("target") * factor).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = 20, tolerance: float = 1e-4, share: float | None = None) -> DataFrame:
    """``cells`` with ``weight``: positive shares whose sums over each dimension meet ``targets[dimension]``.

    ``cells`` has the dimensions and ``tokens``; a target table has a dimension's values and their shares. Values
    without a target get weight 0. Stops when no marginal is off by more than ``tolerance`` of its target, or
    after ``rounds``. The joins are by sort and merge: values may be many, and nothing gathers in the driver. Marginals that cells cannot meet together end at the last round's compromise.

    With ``share`` the weights are bounded by what the cells hold, and ``probability`` is added: the part of a cell's
    tokens that a sample so divided takes, at most 1. What the bound takes from a cell the next steps deal to the
    others; where the cells of a value are used up, so that weight is lost in a round, the sample shrinks by the
    lost share, which widens the bounds until the marginals are met. It begins at ``share`` of all tokens.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    state = cells.withColumn("weight", F.col("tokens") / F.lit(float(total)))
    for _ in range(rounds):
        off = F.lit(0.0)
        for d, target in targets.items():
            sums = state.groupBy(d).agg(F.sum("weight").alias("reached")).join(target.hint("merge"), d, "left")
            ratio = F.when(F.col("reached") > 0, F.coalesce("target", F.lit(0.0)) / F.col("reached")).otherwise(0.0)
            weight = F.col("weight") * F.col(f"ratio_{d}")
            weight = weight if share is None else F.least(weight, F.col("tokens") / F.lit(share * total))
            state = state.join(sums.select(d, ratio.alias(f"ratio_{d}")).hint("merge"), d).withColumn("weight", weight)
            off = F.greatest(off, F.abs(F.col(f"ratio_{d}") - 1))
        state = checkpointed(state.select(*cells.columns, "weight", off.alias("off")))
        worst, reached = state.agg(F.max(F.when(F.col("weight") > 0, F.col("off"))), F.sum("weight")).first()
        state, taken = state.drop("off"), share
        if worst is None or worst <= tolerance:
            break
        share = share and share * min(1.0, reached)
    return state if share is None else state.withColumn("probability", F.least(F.lit(1.0), F.lit(taken * total) * F.col("weight") / F.col("tokens")))


def given_targets(cells: DataFrame, dimension: str, weights: dict) -> DataFrame:
    """Target shares of a dimension from ``weights``, over the values that occur; a value without a weight gets none."""
    spark = cells.sparkSession
    named = spark.createDataFrame([(v, float(w)) for v, w in weights.items()], f"value {cells.schema[dimension].dataType.simpleString()}, target double")
    held = cells.groupBy(dimension).agg(F.sum("tokens").alias("t")).where("t > 0").select(dimension)
    found = held.join(named, F.col(dimension) == F.col("value"), "left").select(dimension, F.coalesce("target", F.lit(0.0)).alias("target"))
    total = found.agg(F.sum("target")).first()[0] or 1.0
    return found.select(dimension, (F.col("target") / total).alias("target"))


def bounded(
    cells: pd.DataFrame, exponents: dict[str, float], share: float, rounds: int = 2000, tolerance: float = 1e-4, weights: dict[str, dict] | None = None
) -> pd.DataFrame:
    """``tempered`` (or ``given_targets``), ``reachable`` and ``rake`` with ``share`` for cells in memory, in the same steps."""
    tokens = cells["tokens"].to_numpy(np.float64)
    total, taken, codes, targets = tokens.sum(), share, [], []
    for d in DIMENSIONS:
        code, values = pd.factorize(cells[d])
        held = np.bincount(code, tokens, len(values)) / (share * total)
        target = held ** exponents.get(d, 0.7)
        if weights and d in weights:
            target = np.array([float(weights[d].get(v, 0.0)) for v in values])
        target = target / (target.sum() or 1.0)
        if not target.any():
            targets.append(target)
            codes.append(code)
            continue
        load = np.divide(held, target, out=np.full(len(held), np.inf), where=target > 0)
        order = np.argsort(load)
        # the first so many in this order are wanted whole: the least number that leaves no other value short
        rest = np.cumsum(target[order][::-1])[::-1]
        left = 1 - np.concatenate([[0], np.cumsum(held[order])[:-1]])
        factor = np.divide(left, rest, out=np.full(len(rest), np.inf), where=rest > 0)
        fits = factor <= load[order] * (1 + 1e-12)
        fits &= np.isfinite(factor)
        targets.append(np.minimum(held, target * (factor[np.argmax(fits)] if fits.any() else np.inf)))
        codes.append(code)
    weight = tokens / total
    for _ in range(rounds):
        off, bound = 0.0, tokens / (taken * total)
        for code, target in zip(codes, targets, strict=True):
            sums = np.bincount(code, weight, len(target))
            ratio = np.divide(target, sums, out=np.zeros(len(sums)), where=sums > 0)
            off = max(off, float(np.abs(ratio - 1).max()))
            weight = np.minimum(weight * ratio[code], bound)
        if off <= tolerance:
            break
        taken *= min(1.0, weight.sum()) or 1.0
    return cells.assign(weight=weight, probability=np.minimum(1.0, weight / bound))


def chance(*columns: Column) -> Column:
    """A number in [0, 1) that depends on the columns' values alone."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def mixed(
    docs: DataFrame,
    share: float = 0.8,
    exponents: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    weights: dict[str, dict] | None = None,
    topic_col: str | None = None,
) -> DataFrame:
    """``describe(docs)`` with the cell's ``weight``, the ``probability`` and the decision ``keep``.

    The sample holds at most ``share`` of all tokens in expectation, divided as raked: raking is bounded by what the cells
    hold, so that no cell's probability is cut and every marginal of the sample meets its target, and the sample is
    as much smaller as that needs. ``exponents`` temper each dimension's own shares to its target (0 is even, 1 as
    it is; 0.7 by default); ``weights`` gives targets by value instead, for any of the dimensions (``{"lang": {"en": 3,
    "de": 1}}``; a value without a weight is left out). A value that holds less than its target is wanted whole (see
    ``reachable``). Where no sample meets all targets together, the one of the last round is drawn.
    Cases: null and empty texts have no tokens (and the topic
    of no words); cells without tokens are kept whole, as they cost nothing; repeated
    rows fare alike; the row's own columns travel in ``doc``, so their names cannot clash; an empty table gives an empty result.
    """
    exponents = dict.fromkeys(DIMENSIONS, 0.7) | (exponents or {})
    rows = describe(docs, text_col, topic_col=topic_col)
    cells = checkpointed(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    n = cells.count()
    counted = cells.where("tokens > 0").select(*DIMENSIONS, "tokens")
    if 0 < n <= BROADCAST_CELLS:
        known = counted.orderBy(*DIMENSIONS).toPandas()
        fitted = bounded(known, exponents, share, weights=weights) if len(known) else known.assign(weight=0.0, probability=1.0)
        rates = docs.sparkSession.createDataFrame(fitted, "source string, lang string, topic long, tokens long, weight double, probability double")
    else:
        wanted = {d: given_targets(counted, d, weights[d]) if d in (weights or {}) else tempered(counted, d, exponents[d]) for d in DIMENSIONS}
        targets = {d: reachable(counted, wanted[d], d, share) for d in DIMENSIONS}
        rates = rake(counted, targets, share=share)
    rates = rates.select(*DIMENSIONS, "weight", "probability")
    joined = rows.join(F.broadcast(rates) if n <= BROADCAST_CELLS else rates, list(DIMENSIONS), "left")
    joined = joined.withColumns({"weight": F.coalesce("weight", F.lit(0.0)), "probability": F.coalesce("probability", F.lit(1.0))})
    return joined.withColumn("keep", chance(F.col(f"doc.`{id_col}`"), F.col(f"doc.`{text_col}`")) < F.col("probability"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cell, calibrated probability and sampling decision."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    out = mixed(docs)
    return out.select("doc.doc_id", "source", "lang", "topic", "tokens", F.round("weight", 12).alias("cell_weight"), F.round("probability", 9).alias("probability"), "keep")
