"""Language identification by string kernels.

The kernel of two texts is the blended spectrum of byte n-gram presence: for n = 2 and 3, the number of n-grams
both have, over the geometric mean of their numbers, averaged over n. N-grams are counted by hash, in 4,096 slots for n = 2
and 8,192 for n = 3: bytes of one script fill few of them, and n-grams that share a slot count as one. A bounded
sample, of a bounded number of languages, supplies Nystroem landmarks and the training rows; kernel ridge regression, one against the rest, gives weights on the landmarks.
Whole texts are scored in batches: presence matrix times landmark matrix, times weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import blocks, mix, raw_texts

SPECTRA = ((2, 1 << 12), (3, 1 << 13))
WIDTH = sum(size for _, size in SPECTRA)
#: Rows and landmarks a language; all rows and landmarks together; and languages that are learnt, the most frequent.
PER_LANGUAGE, LANDMARKS = 400, 32
TAUGHT_ROWS, ALL_LANDMARKS, MOST_LANGUAGES = 16_000, 1024, 256
ROWS = 256
UNKNOWN = "und"


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """0/1 matrix of the hashed n-grams of each text, A-Z lower-cased."""
    out = np.zeros((len(offsets) - 1, WIDTH), np.uint8)
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64)
    base = 0
    for n, size in SPECTRA:
        if len(low) >= n:
            grams = np.zeros(len(low) - n + 1, np.uint64)
            for i in range(n):
                grams = grams * np.uint64(256) + low[i : len(low) - n + 1 + i]
            slots = (mix(grams + np.uint64(n << 40)) & np.uint64(size - 1)).astype(np.int64) + base
            for r, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                if b - a >= n:
                    out[r, slots[a : b - n + 1]] = 1
        base += size
    return out


def normalised(rows: np.ndarray) -> np.ndarray:
    """Presence rows scaled so that a dot product of two is their blended kernel."""
    out, base = rows.astype(np.float32), 0
    for _, size in SPECTRA:
        part = out[:, base : base + size]
        part /= np.sqrt(np.maximum(part.sum(1, keepdims=True), 1) * len(SPECTRA))
        base += size
    return out


def _sampled():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_texts(batch.column("text"))
            for i, j, part, at in blocks(data, offsets):
                rows = pa.array([np.packbits(x).tobytes() for x in presence(part, at)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(i, j - i), batch.column("h").slice(i, j - i), rows], names=["lang", "h", "x"])

    return run


def fit(rows: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = 1e-3) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(classes, landmark rows, weights [landmark, class]) from presence rows and their languages."""
    classes = sorted(set(languages))
    y = np.array([classes.index(x) for x in languages])
    x = normalised(rows)
    landmarks = max(1, min(landmarks, ALL_LANDMARKS // len(classes)))
    chosen = np.concatenate([np.flatnonzero(y == c)[:landmarks] for c in range(len(classes))])
    marks = x[chosen]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    z = (x @ marks.T) @ root
    weight = 1.0 / np.bincount(y)[y]  # each language weighs the same
    target = np.where(y[:, None] == np.arange(len(classes)), 1.0, -1.0)
    gram = (z * weight[:, None]).T @ z + ridge * len(classes) * np.eye(z.shape[1])
    return classes, marks, root @ np.linalg.solve(gram, (z * weight[:, None]).T @ target)


def _predicted(classes: list[str], model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, weights = model.value
        names = np.array([*classes, UNKNOWN], dtype=object)
        for batch in batches:
            best, score = [], []
            data, offsets = raw_texts(batch.column("text"))
            for _, _, part, at in blocks(data, offsets):
                for lo in range(0, len(at) - 1, ROWS):
                    own = at[lo : lo + ROWS + 1]
                    f = (normalised(presence(part[own[0] : own[-1]], own - own[0])) @ marks.T) @ weights
                    best.append(f.argmax(1))
                    score.append(np.clip((f.max(1) + 1) / 2, 0, 1))
            best, score = (np.concatenate(x) if x else np.zeros(0, int) for x in (best, score))
            lettered = batch.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
            best, score = np.where(lettered, best, len(classes)), np.where(lettered, score, 0.0)
            kept = [batch.column(i) for i in range(batch.num_columns - 2)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(names[best], pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names[:-2], "lang_pred", "score"])

    return run


def identify_language(docs: DataFrame, teaches: Column, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> DataFrame:
    """``docs`` (its struct as ``doc``) with ``lang_pred`` and ``score``; learns from rows where ``teaches`` holds.

    The model is fitted on about ``per_language`` rows of each language (fewer where ``TAUGHT_ROWS`` in all would be
    exceeded), drawn by a hash of the text, of the ``MOST_LANGUAGES`` most frequent languages. Cases: a text with letters
    but shorter than two bytes has no n-gram, and equal scores go to the first language by name; a null text, or one without letters, is ``und`` with score 0, as is every text if no row teaches; null languages
    do not teach; one language alone is always predicted; repeated rows are predicted alike; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`").cast("string")
    lang = F.col(f"`{lang_col}`").cast("string")
    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    taught = docs.where(teaches & lang.isNotNull() & lettered)
    counts = taught.groupBy(lang.alias("lang")).count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    per_language = min(per_language, TAUGHT_ROWS // max(1, len(counts)))
    draw = F.shiftrightunsigned(F.xxhash64(text), 11) / F.lit(float(1 << 53))
    within = F.lit(False)
    for r in counts:
        within = within | ((lang == r["lang"]) & (draw < per_language / r["count"]))
    drawn = taught.where(within).select(lang.alias("lang"), F.xxhash64(text).alias("h"), text.alias("text")) if counts else None
    rows = drawn.dropDuplicates(["lang", "h"]).mapInArrow(_sampled(), "lang string, h long, x binary").collect() if counts else []
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    asked = docs.select(whole.alias("doc"), lettered.alias("lettered"), text.alias("text"))
    if not rows:
        return asked.select("doc", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    rows.sort(key=lambda r: (r.lang, r.h))
    x = np.unpackbits(np.frombuffer(b"".join(r.x for r in rows), np.uint8).reshape(len(rows), -1), axis=1)
    classes, marks, weights = fit(x, [r.lang for r in rows])
    model = spark.sparkContext.broadcast((marks, weights.astype(np.float32)))
    return asked.mapInArrow(_predicted(classes, model), f"doc {asked.schema['doc'].dataType.simpleString()}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Whether the CRC-32 of the id as text (a null id as empty) is divisible by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document; a fifth of them is held out of training."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify_language(docs, ~held_out(F.col("doc_id")))
    return out.select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "lang_pred", "score")
