"""Removal of byte strings that start in more than one place.

A blockwise suffix comparison over a difference cover. A difference cover is a sample of positions such that any
two equal strings of the wanted length hold a sampled position at the same offset; here the sample is drawn by
content - the smallest hash of ``SEED`` bytes in each window of ``LENGTH`` - which keeps a little over one
position in a hundred, where residues of a cover modulo 128 would keep one in nine. Sampled suffixes are dealt to
buckets by their first ``SEED`` bytes, and only buckets with two members matter. Inside a bucket ties are long;
they are resolved first by the precomputed rank (hash) of each sample's whole neighbourhood, so equal
neighbourhoods meet without their bytes, and only distinct ones are read again and sorted, one bucket at a time; what
neighbours in sorted order have in common, on either side, gives the repeated windows. Buckets too large for a task
are never gathered: joins halve the range of window starts instead. All windows that hold a sample overlap, so what is
repeated around it is one interval.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import checkpointed, release_shuffles
from .hashing import BASE, BYTE_TABLE, INVERSE, mix, powers, raw_texts

LENGTH, SEED = 200, 32
#: An anchor with more distinct neighbourhoods than this is compared by joins; up to so many are sorted in one task.
HOT = 20_000
BITS = 1 << 24
CHUNK = 1 << 22
BATCH = 20_000


class Sampler:
    """Samples of texts: the leftmost smallest seed hash of every window of ``length`` bytes."""

    def __init__(self, length: int = LENGTH, seed: int = SEED) -> None:
        self.length, self.seed, self.reach = length, seed, length - seed
        self._up = self._down = np.zeros(0, np.uint64)

    def _sums(self, data: np.ndarray) -> np.ndarray:
        if len(data) > len(self._up):
            self._up, self._down = powers(BASE, len(data) + 1), powers(INVERSE, len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_TABLE[data] * self._up[: len(data)], out=sums[1:])
        return sums

    def anchors(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(position, seed hash, neighbourhood hash, bytes to the left, bytes from the position on) of each sample.

        The neighbourhood is what windows around the sample can hold: ``length - seed`` bytes before it and
        ``length`` from it on, less where the text ends.
        """
        found = []
        for at in range(0, max(len(text) - self.length + 1, 0), CHUNK):
            lo, hi = max(0, at - self.reach), min(len(text), at + CHUNK + 2 * self.length)
            data = text[lo:hi]
            sums = self._sums(data)
            n = len(data) - self.seed + 1
            seeds = mix((sums[self.seed :] - sums[:-self.seed]) * self._down[:n])
            key = (seeds & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)
            width, least = 1, key
            count = self.reach + 1  # seeds in a window
            while width * 2 <= count:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < count:
                least = np.minimum(least[: len(least) - (count - width)], least[count - width :])
            starts = slice(at - lo, min(at - lo + CHUNK, len(least)))
            p = np.unique(least[starts] & np.uint64((1 << 24) - 1)).astype(np.int64)
            left = np.minimum(p + lo, self.reach)
            right = np.minimum(len(text) - lo - p, self.length)
            a, b = p - left, p + right
            around = mix((sums[b] - sums[a]) * self._down[a]) ^ mix((left * 1024 + right).astype(np.uint64))
            found.append((p + lo, seeds[p], around, left, right))
        if not found:
            return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
        out = [np.concatenate(x) for x in zip(*found, strict=True)]
        _, first = np.unique(out[0], return_index=True)
        return tuple(x[first] for x in out)


ANCHOR = "anchor long, around long, key long, pos long, l long, r long"


def _anchors(length: int, seed: int, bitmap=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(length, seed)
        bits = None if bitmap is None else np.unpackbits(np.frombuffer(bitmap.value, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            data, offsets = raw_texts(batch.column("text"))
            keys = batch.column("key").to_numpy()
            out, size = [], 0
            for r in range(len(keys)):
                p, seeds, around, left, right = sampler.anchors(data[offsets[r] : offsets[r + 1]])
                if bits is not None:
                    keep = bits[slots(seeds)]
                    p, seeds, around, left, right = (x[keep] for x in (p, seeds, around, left, right))
                if len(p):
                    out.append((seeds.view(np.int64), around.view(np.int64), np.full(len(p), keys[r]), p, left, right))
                    size += len(p)
                if size > 1 << 16 or r == len(keys) - 1:
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["anchor", "around", "key", "pos", "l", "r"])
                    out, size = [], 0

    return run


def slots(values: np.ndarray) -> np.ndarray:
    return ((values.view(np.uint64) >> np.uint64(20)) & np.uint64(BITS - 1)).astype(np.int64)


def bit_table(values: DataFrame) -> bytes:
    """A table of ``BITS`` bits (two megabytes at any scale) with those of all values of the one column set."""
    column = values.columns[0]
    slot = values.select(F.expr(f"shiftrightunsigned(`{column}`, 20) & {BITS - 1}").alias("slot"))
    words = slot.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    table = np.zeros(BITS // 64, np.int64)
    for word, bits in words.toLocalIterator():  # at most BITS / 64 rows
        table[word] = bits
    return table.tobytes()


def _neighbourhoods(length: int, seed: int):
    reach = length - seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_texts(batch.column("text"))
            out = []
            for r, wanted in enumerate(batch.column("wanted").to_pylist()):
                text = data[offsets[r] : offsets[r + 1]]
                for x in wanted:
                    p = x["pos"]
                    out.append((x["anchor"], x["around"], text[max(0, p - reach) : p][::-1].tobytes(), text[p : p + length].tobytes()))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            kinds = pa.int64(), pa.int64(), pa.binary(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["anchor", "around", "before", "after"])

    return run


def _padded(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in values])
    out = np.zeros((len(values), width), np.uint8)
    for i, x in enumerate(values):
        out[i, : len(x)] = np.frombuffer(x, np.uint8)
    return out, sizes


def sorted_suffixes(anchor: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): rows sorted by anchor, then bytes, and how many bytes each has in common with the one before it (-1 at
    another anchor)."""
    words = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    words[:, : rows.shape[1]] = rows
    words = words.view(">u8")
    order = np.lexsort([*words.T[::-1], anchor])
    differs = rows[order[1:]] != rows[order[:-1]]
    common = np.where(differs.any(1), differs.argmax(1), rows.shape[1])
    return order, np.where(anchor[order[1:]] == anchor[order[:-1]], common, -1)


def classes(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """Equal numbers for rows that have ``depth`` bytes in common, rising in sorted order."""
    out = np.zeros(len(order), np.int64)
    out[order[1:]] = np.cumsum(common < depth)
    return out


def repeated_windows(anchor: np.ndarray, before: list[bytes], after: list[bytes], length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct neighbourhoods of several anchors: the fewest and the most bytes before the anchor at which a
    window starts that another neighbourhood of the same anchor also has (most is -1 where there is none).

    The suffixes from the anchors on are sorted, and so are the reversed prefixes before them; what neighbours in these
    orders have in common tells which rows agree to any depth on either side, byte for byte."""
    reach = length - seed
    left, nl = _padded(before, reach)
    right, nr = _padded(after, length)
    behind, ahead = sorted_suffixes(anchor, left), sorted_suffixes(anchor, right)
    least, most = np.full(len(anchor), length), np.full(len(anchor), -1)
    for b in range(reach + 1):  # the window starts b bytes before the anchor
        valid = np.flatnonzero((nl >= b) & (nr >= length - b))
        if len(valid) > 1:
            key = classes(*behind, b)[valid] * len(anchor) + classes(*ahead, length - b)[valid]
            order = np.argsort(key)
            same = key[order[1:]] == key[order[:-1]]
            hit = np.zeros(len(valid), bool)
            hit[order[1:][same]] = True
            hit[order[:-1][same]] = True
            rows = valid[hit]
            least[rows] = np.minimum(least[rows], b)
            most[rows] = b
    return least, most


def hot_windows(around: DataFrame, length: int, seed: int) -> DataFrame:
    """``repeated_windows`` of anchors with very many neighbourhoods, by joins alone: no bucket is gathered in a task.

    Window starts are taken in ranges. All windows of a range share the bytes that each of them holds; rows are grouped by
    these, and a row alone in its group repeats nothing in the range. Rows with equal bytes wherever the range
    reaches repeat all of it, and one of them goes on as a partner for the others; groups of several kinds go on with
    both halves of the range. A range of one start has groups of one kind only, so halving ends.
    """
    reach = length - seed
    part = lambda c, n: F.substring(c, F.lit(1), n.cast("int"))
    digest = lambda *c: F.struct(F.xxhash64(*c), F.xxhash64(F.lit(1), *c))
    rows = around.withColumns({"lo": F.lit(0), "hi": F.lit(reach), "told": F.lit(False)})
    found = None
    while True:
        valid = (F.octet_length("before") >= F.col("lo")) & (F.octet_length("after") >= length - F.col("hi"))
        rows = rows.where(valid).withColumn("group", digest("anchor", "lo", "hi", part("before", F.col("lo")), part("after", length - F.col("hi"))))
        rows = checkpointed(rows.withColumn("kind", digest(part("before", F.col("hi")), part("after", length - F.col("lo")), F.least(F.octet_length("before"), F.col("hi")), F.least(F.octet_length("after"), length - F.col("lo")))))
        kinds = rows.groupBy("group", "kind").agg(F.count("*").alias("c"), F.min("around").alias("around"), F.bool_or("told").alias("known"))
        twins = rows.where("NOT told").join(kinds.where("c > 1").select("group", "kind"), ["group", "kind"], "left_semi")
        least = F.greatest(F.col("lo"), length - F.octet_length("after"))
        twins = checkpointed(twins.select("anchor", "around", least.alias("least"), F.least(F.col("hi"), F.octet_length("before")).alias("most")))
        found = twins if found is None else found.unionByName(twins)
        mixed = kinds.groupBy("group").agg(F.count("*").alias("k"), F.min("known").alias("done")).where("k > 1 AND NOT done").select("group")
        going = kinds.select("group", "kind", "around", (F.col("known") | (F.col("c") > 1)).alias("told")).join(mixed, "group", "left_semi")
        rows = rows.drop("told").join(going, ["group", "kind", "around"])
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("hi").alias("hi")))).alias("r")
        rows = checkpointed(rows.where("lo < hi").select("anchor", "around", "before", "after", "told", halves).select("anchor", "around", "before", "after", "told", "r.lo", "r.hi"))
        if rows.isEmpty():
            return found.where("least <= most").groupBy("anchor", "around").agg(F.min("least").cast("long").alias("least"), F.max("most").cast("long").alias("most"))


def _compared(length: int, seed: int):
    """Intervals of distinct neighbourhoods, bucket by bucket; rows come sorted by anchor."""

    def result(rows: pd.DataFrame) -> pd.DataFrame:
        least, most = repeated_windows(rows.anchor.to_numpy(), list(rows.before), list(rows.after), length, seed)
        out = pd.DataFrame({"anchor": rows.anchor.to_numpy(), "around": rows.around.to_numpy(), "least": least, "most": most})
        return out[out.most >= 0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for rows in batches:
            held = rows if held is None else pd.concat([held, rows], ignore_index=True)
            while len(held) > BATCH:
                last = held.anchor.iloc[min(len(held) - 1, BATCH)]
                whole = held.anchor.to_numpy() < last if (held.anchor.to_numpy() < last).any() else held.anchor.to_numpy() == last
                if held.anchor.iloc[-1] == last and not (held.anchor.to_numpy() < last).any():
                    break  # one bucket still growing
                yield result(held[whole].reset_index(drop=True))
                held = held[~whole].reset_index(drop=True)
        if held is not None and len(held):
            yield result(held)

    return run


def _kept():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = raw_texts(batch.column("text"))
            copied, marked = batch.column("copied").to_pylist(), batch.column("spans").to_pylist()
            sizes, shas = batch.column("n_bytes").to_pylist(), batch.column("sha").to_pylist()
            removed, runs, digests = [], [], []
            for r, spans in enumerate(marked):
                if copied[r]:
                    gone, n, sha = sizes[r], 1, hashlib.sha256(b"").hexdigest()
                elif not spans:
                    gone, n, sha = 0, 0, shas[r]
                else:
                    text = data[offsets[r] : offsets[r + 1]]
                    edge = np.zeros(len(text) + 1, np.int32)
                    s = np.array([(x["s"], x["e"]) for x in spans])
                    np.add.at(edge, s[:, 0], 1)
                    np.add.at(edge, s[:, 1], -1)
                    cover = np.cumsum(edge[:-1]) > 0
                    gone, n = int(cover.sum()), int(cover[0]) + int((cover[1:] & ~cover[:-1]).sum())
                    sha = hashlib.sha256(text[~cover].tobytes()).hexdigest()
                removed.append(gone)
                runs.append(n)
                digests.append(sha)
            new = [pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *new], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _with_text_where(bitmap):
    """Keeps the text only of rows whose key may have spans; the others travel without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(bitmap.value, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            hit = bits[slots(batch.column("key").to_numpy())]
            text = batch.column("text")
            kept = pa.compute.if_else(pa.array(hit), text, pa.scalar(None, text.type))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), kept], names=batch.schema.names)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of each row, once every byte covered by a string of
    ``length`` bytes that also starts elsewhere (in any row, or elsewhere in this one) is gone.

    Cases: null and empty texts have no bytes; texts shorter than ``length`` lose nothing; rows with the same text
    lose all of it if it is long enough; null and repeated ids are reported as they come; extra columns are
    ignored; an empty table gives an empty result. Equal neighbourhoods are recognised by 64-bit hashes within an anchor,
    equal texts by 128 bits, all other strings by their bytes or, of crowded anchors, 128 bits.
    """

    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text, F.octet_length(text)).alias("key"), F.xxhash64(F.lit(1), text).alias("more"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    long = texts.where(F.col("n_bytes") >= length).select("key", "text")

    every = long.mapInArrow(_anchors(length, seed), ANCHOR)
    sides = [f(c).alias(f"{n}_{c}") for c in ("around", "key", "pos") for n, f in (("a", F.min), ("z", F.max))]
    again = every.groupBy("anchor").agg(*sides).where("a_around <> z_around OR a_key <> z_key OR a_pos <> z_pos").select("anchor")
    again = checkpointed(again)
    bitmap = spark.sparkContext.broadcast(bit_table(again))
    places = long.mapInArrow(_anchors(length, seed, bitmap), ANCHOR).join(again, "anchor", "left_semi")
    places = checkpointed(places.groupBy("anchor", "around", "key", "pos").agg(F.first("l").alias("l"), F.first("r").alias("r")))

    kinds = places.groupBy("anchor", "around").agg(F.count("*").alias("c"), F.min("key").alias("key"))
    kinds = checkpointed(kinds)
    several = kinds.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1")
    crowded = checkpointed(several.where(F.col("k") > HOT).select("anchor"))
    sources = kinds.join(several.select("anchor"), "anchor", "left_semi").select("anchor", "around", "key")
    sources = places.join(sources, ["anchor", "around", "key"]).groupBy("anchor", "around", "key").agg(F.min("pos").alias("pos"))
    wanted = checkpointed(sources.groupBy("key").agg(F.collect_list(F.struct("anchor", "around", "pos")).alias("wanted")))
    marked = spark.sparkContext.broadcast(bit_table(wanted.select("key")))
    source_texts = long.mapInArrow(_with_text_where(marked), "key long, text string").where("text IS NOT NULL")
    source_texts = source_texts.join(wanted, "key").groupBy("key").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted"))
    around = source_texts.mapInArrow(_neighbourhoods(length, seed), "anchor long, around long, before binary, after binary")
    few = around.join(crowded, "anchor", "left_anti") if (some := not crowded.isEmpty()) else around
    found = few.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(_compared(length, seed), "anchor long, around long, least long, most long")
    found = checkpointed(found)
    if some:
        found = found.unionByName(hot_windows(around.join(crowded, "anchor", "left_semi"), length, seed))
    release_shuffles(spark)

    alike = kinds.where("c > 1").select("anchor", "around")
    whole = places.join(alike, ["anchor", "around"], "left_semi").select("key", (F.col("pos") - F.col("l")).alias("s"), (F.col("pos") + F.col("r")).alias("e"))
    part = places.join(found, ["anchor", "around"]).select("key", (F.col("pos") - F.col("most")).alias("s"), (F.col("pos") + length - F.col("least")).alias("e"))
    spans = checkpointed(whole.unionByName(part).groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("spans")))
    bitmap = spark.sparkContext.broadcast(bit_table(spans.select("key")))
    copies = texts.where(F.col("n_bytes") >= length).groupBy("key", "more").agg(F.count("*").alias("c")).where("c > 1")
    copies = copies.groupBy("key").agg(F.collect_set("more").alias("copied"))  # texts that share 64 bits: one, all but always
    rows = texts.select("doc_id", "key", "more", "n_bytes", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "text")
    rows = rows.mapInArrow(_with_text_where(bitmap), "doc_id long, key long, more long, n_bytes long, sha string, text string")
    rows = rows.join(spans.join(copies, "key", "full"), "key", "left")
    rows = rows.select("doc_id", "n_bytes", "sha", F.coalesce(F.array_contains("copied", F.col("more")), F.lit(False)).alias("copied"), "spans", "text")
    return rows.mapInArrow(_kept(), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all documents without repeated strings of 200 bytes."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
