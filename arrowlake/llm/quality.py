"""Quality classifier from a weak-label model.

Simple heuristics vote good, bad or abstain on every document. They overlap: each kind of junk is seen by several.
Expectation-maximisation over the counts of all vote patterns (a table of at most 3^labellers rows, whatever the
corpus) estimates how often each labeller says what about good and bad documents; nothing is presumed but that two
objections are bad to begin with. A labeller is thus believed as far as others bear it out, and one that objects
alone is overruled. The posteriors label a bounded sample, on which a linear scorer over hashed features is trained;
the scorer then rates every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import WordHasher, blocks, mix, raw_texts

DIM = 1 << 11
SAMPLE = 4000
# Each heuristic votes bad beyond the first bound, good within the second, and abstains between.
LABELLERS = {
    "symbols": (0.02, 0.006),
    "marked_words": (0.1, 0.02),
    "lone_marks": (0.1, 0.02),
    "mark_share": (0.16, 0.08),
    "capitals": (0.3, 0.12),
    "shouting": (0.25, 0.08),
    "exclamations": (0.15, 0.04),
    "doubled_marks": (0.1, 0.02),
    "echoes": (0.1, 0.02),
    "repeats": (0.5, 0.15),
    "top_word": (0.3, 0.16),
    "repeated_pairs": (0.65, 0.45),
    "few_kinds": (0.8, 0.5),
    "long_words": (0.15, 0.04),
    "word_length": (14.0, 10.0),
}
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#$%&*|~^=<>{}[]\\@_")] = True
MARKS = np.zeros(256, bool)
MARKS[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
#: Bytes as the scorer sees them: marks and white space as they are, letters and digits by case and kind, and all
#: bytes of other alphabets as lower-case letters, so that no script is judged by its mere letters.
SHAPES = np.arange(256, dtype=np.uint8)
SHAPES[[*range(97, 123), *range(128, 256)]] = ord("a")
SHAPES[65:91] = ord("A")
SHAPES[48:58] = ord("0")
OTHER_SCRIPT = 0xCD  # the first byte of UTF-8 characters beyond the Latin ones is at least this
BLOCK, ROWS = 1 << 18, 512  # bytes and texts that are looked at together
LONG_WORD, ENOUGH_WORDS, SOME_WORDS, ENOUGH_CHARS = 22, 20, 10, 100


def _sums(values: np.ndarray) -> np.ndarray:
    """Sums of values[:i] for each i."""
    out = np.zeros(len(values) + 1, np.int32)
    np.cumsum(values, out=out[1:])
    return out


def _segment(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]]."""
    total = _sums(values)
    return (total[at[1:]] - total[at[:-1]]).astype(np.float64)


def _parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for i, j, part, at in blocks(data, offsets, BLOCK):
        for lo in range(0, j - i, ROWS):
            own = at[lo : lo + ROWS + 1]
            yield i + lo, i + lo + len(own) - 1, part[own[0] : own[-1]], own - own[0]


def _distinct(values: np.ndarray) -> np.ndarray:
    """How often each distinct value occurs."""
    ordered = np.sort(values)
    return np.diff(np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])))


def _repetition(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: shares of repeated word triples and of the most frequent word (of enough words), share of repeated
    word pairs, and the square root of twice the words over the number of kinds (of some words)."""
    out = np.zeros((len(first) - 1, 4))
    pairs = words[:-1] * np.uint64(17) + words[1:]
    triples = words[:-2] * np.uint64(31) + pairs[1:] if len(words) > 2 else words[:0]
    for r, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        n = b - a
        if n >= SOME_WORDS:
            kinds = _distinct(words[a:b])
            out[r, 2:] = 1 - len(_distinct(pairs[a : b - 1])) / (n - 1), (2 * n) ** 0.5 / len(kinds)
            if n >= ENOUGH_WORDS:
                out[r, :2] = 1 - len(_distinct(triples[a : b - 2])) / (n - 2), kinds.max() / n
    return out


def statistics(data: np.ndarray, offsets: np.ndarray, hasher: WordHasher) -> np.ndarray:
    """One column per labeller for each text of a block; lengths are in characters, and word lengths of texts that are
    mostly of other scripts are put between the bounds, where labellers abstain."""
    words, starts, ends, first = hasher.words(data, offsets)
    n = np.maximum(np.diff(first), 1)
    begins = (data & 0xC0) != 0x80
    size = np.maximum(_segment(begins, offsets), 1)
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    letters = np.maximum(_segment(upper, offsets) + _segment(lower, offsets), 1)
    chars, marks, symbols, capitals, smalls = (_sums(x) for x in (begins, MARKS[data], SYMBOLS[data], upper, lower))
    length = chars[ends] - chars[starts]
    of_marks = marks[ends] - marks[starts]
    again = np.zeros(len(data), bool)
    again[1:] = MARKS[data[1:]] & (data[1:] == data[:-1])
    twice = _sums(again)
    doubled = (twice[ends] - twice[np.minimum(starts + 1, ends)]) > 0
    shouted = (capitals[ends] - capitals[starts] >= 3) & (smalls[ends] == smalls[starts])
    same = np.zeros(len(words), bool)
    same[1:] = words[1:] == words[:-1]
    same[first[:-1][first[:-1] < len(words)]] = False
    digits = _sums((data >= 48) & (data <= 57))
    lettered = digits[ends] == digits[starts]
    other = _segment(data >= OTHER_SCRIPT, offsets) / size > 0.2
    between = [sum(LABELLERS[k]) / 2 for k in ("long_words", "word_length")]
    content = np.maximum(size - _segment(MARKS[data] | (data <= 32), offsets), 1)
    return np.column_stack(
        [
            _segment(SYMBOLS[data], offsets) / size,
            _segment((symbols[ends] > symbols[starts]) & (of_marks < length), first) / n,
            _segment(of_marks == length, first) / n,
            np.where(content >= ENOUGH_CHARS, _segment(MARKS[data], offsets) / content, 0),
            np.where(letters > 20, _segment(upper, offsets) / letters, 0),
            _segment(shouted, first) / n,
            _segment(data == 33, offsets) / n,
            _segment(doubled, first) / n,
            np.where(n >= SOME_WORDS, _segment(same, first) / n, 0),
            _repetition(words, first),
            np.where(other, between[0], _segment((length > LONG_WORD) & lettered, first) / n),
            np.where(other, between[1], _segment(np.minimum(length, LONG_WORD), first) / n),
        ]
    )


def votes(stats: np.ndarray) -> np.ndarray:
    bad, good = (np.array([x[i] for x in LABELLERS.values()]) for i in (0, 1))
    return (stats <= good).astype(np.int8) - (stats >= bad)


def _patterns():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            data, offsets = raw_texts(batch.column("text"))
            for i, j, part, at in _parts(data, offsets):
                v = votes(statistics(part, at, hasher)).astype(np.int64) + 1
                pattern = v @ (3 ** np.arange(v.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, j - i), pa.array(pattern)], names=["key", "pattern"])

    return run


def features(data: np.ndarray, offsets: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """Hashed features of each text: pairs of byte shapes by frequency, and the level of each statistic."""
    out = np.zeros((len(offsets) - 1, DIM), np.float32)
    if len(data) > 1:
        shape = SHAPES[data]
        pairs = (mix(shape[:-1].astype(np.uint64) * np.uint64(256) + shape[1:]) & np.uint64(DIM - 1)).astype(np.int64)
        for r, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            if b - a > 1:
                out[r] = np.sqrt(np.bincount(pairs[a : b - 1], minlength=DIM) / (b - a - 1))
    bad = np.array([x[0] for x in LABELLERS.values()])
    levels = np.minimum((np.clip(stats / bad, 0, 4) * 4).astype(np.int64), 12)  # 4: as much as labellers object to
    slots = (mix((np.arange(stats.shape[1]) * 64 + levels).astype(np.uint64) + np.uint64(1 << 40)) & np.uint64(DIM - 1)).astype(np.int64)
    for r, row in enumerate(slots):
        out[r, row] += 1
    return out


def _sampled():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            data, offsets = raw_texts(batch.column("text"))
            for i, j, part, at in _parts(data, offsets):
                stats = statistics(part, at, hasher)
                rows = [x.astype(np.float16).tobytes() for x in features(part, at, stats)]
                pattern = (votes(stats).astype(np.int64) + 1) @ (3 ** np.arange(stats.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(rows, pa.binary())], names=["pattern", "x"])

    return run


def fit_votes(patterns: dict[int, int], labellers: int = len(LABELLERS), rounds: int = 300) -> tuple[dict[int, float], np.ndarray]:
    """(posterior of good per pattern, rates [class, labeller, vote + 1]) by expectation-maximisation.

    A pattern is the number whose base-3 digits are the votes + 1; classes are bad and good. Rates are free but for
    one vote of each kind added to each class, so that none is 0. The start tells the classes apart: two objections
    make a document bad, one leaves it open.
    """
    keys = np.array(sorted(patterns), np.int64)
    count = np.array([patterns[k] for k in keys], np.float64)
    votes_of = (keys[:, None] // 3 ** np.arange(labellers)) % 3
    post = np.array([0.95, 0.5, 0.05])[np.minimum((votes_of == 0).sum(1), 2)]
    for _ in range(rounds):
        weight = np.stack([count * (1 - post), count * post])
        share = (weight.sum(1) + 1) / (weight.sum() + 2)
        table = np.stack([[np.bincount(votes_of[:, j], w, 3) + 1 for j in range(labellers)] for w in weight])
        table /= table.sum(2, keepdims=True)
        log = np.log(share)[:, None] + np.log(table[:, np.arange(labellers), votes_of]).sum(2)
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        done = np.abs(new - post).max() < 1e-6
        post = new
        if done:
            break
    return dict(zip(keys.tolist(), post.tolist(), strict=True)), table


def fit_scorer(x: np.ndarray, y: np.ndarray, ridge: float = 1e-5, rounds: int = 600) -> np.ndarray:
    """Weights (bias last) of a logistic regression on soft labels, by accelerated gradient steps.

    Bad documents are rarer; their share of the loss is raised to at most a quarter."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    bad = float((1 - y).sum())
    weight = 1 + (1 - y) * (max(1.0, len(y) / 4 / max(bad, 1.0)) - 1)
    weight = (weight / weight.sum()).astype(np.float32)
    step = 4.0 / max(1e-9, float(weight @ (x**2).sum(1)))
    w = look = np.zeros(x.shape[1])
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ look.astype(np.float32), -40, 40)))
        new = look - step * (x.T @ ((p - y) * weight).astype(np.float32) + ridge * look)
        look = new + (t - 1) / (t + 2) * (new - w)
        w = new
    return w


def _scored(weights: np.ndarray):
    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = WordHasher()
        for text in texts:
            data, offsets = raw_texts(text)
            scores = [np.zeros(0)]
            for _, _, part, at in _parts(data, offsets):
                x = features(part, at, statistics(part, at, hasher))
                scores.append(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -40, 40))))
            yield pa.array(np.concatenate(scores), pa.float64())

    return score


def scored(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """``(doc, quality_score, quality_keep)``: each row of ``docs`` as a struct, its score (0 to 1) and the decision.

    Vote counts cover all documents; the scorer is fitted on about ``sample`` rows, drawn by a hash of the text so that
    copies count once. Cases: a null, empty or wordless text scores 0 and is not kept; repeated rows score alike;
    no column of ``docs`` can clash, as they travel in ``doc``; an empty table gives an empty result.
    """
    text = F.col(f"`{text_col}`").cast("string")
    keyed = docs.select(F.xxhash64(text).alias("key"), text.alias("text"))
    patterns = keyed.mapInArrow(_patterns(), "key long, pattern long")
    counted = patterns.groupBy("pattern").agg(F.count("*").alias("c")).collect()  # at most 3^labellers rows
    posterior, _ = fit_votes({r.pattern: r.c for r in counted}) if counted else ({}, None)
    size = sum(r.c for r in counted)
    # an even draw by hash: the share of the hash range that holds the sample
    bound = min((1 << 63) - 1, int(min(1.0, sample / max(size, 1)) * (1 << 64)) - (1 << 63))
    drawn = keyed.where(F.xxhash64("key") <= bound).dropDuplicates(["key"]).limit(2 * sample).select("text").mapInArrow(_sampled(), "pattern long, x binary").collect()
    weights = np.zeros(DIM + 1)
    if drawn:
        x = np.stack([np.frombuffer(r.x, np.float16) for r in drawn]).astype(np.float32)
        weights = fit_scorer(x, np.array([posterior.get(r.pattern, 0.5) for r in drawn]))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # the text alone goes to Python, as a column: Spark takes no lambdas in a function's argument
    rows = docs.select(whole.alias("doc"), F.explode(F.array(text)).alias("text"))
    known = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = rows.withColumn("score", _scored(weights)(F.col("text"))).withColumn("score", F.when(known, F.col("score")).otherwise(0.0))
    return rows.select("doc", F.col("score").alias("quality_score"), (F.col("score") >= threshold).alias("quality_keep"))


def quality_scores(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``quality_score`` and ``quality_keep`` of ``scored``; columns of these names are replaced."""
    kept = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in ("quality_score", "quality_keep")]
    return scored(docs, text_col, sample, threshold).select(*kept, "quality_score", "quality_keep")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score and whether it is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality_scores(docs).select("doc_id", "quality_score", "quality_keep")
