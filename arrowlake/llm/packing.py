"""Packing token pieces into windows by Karmarkar-Karp multiway differencing.

Each document is tokenised where it lies and cut at multiples of the window: full pieces are windows of their own,
and the rest is cut into small pieces. Pieces (without their ids) are dealt by a hash of their row to blocks of a
bounded number of tokens. A block's pieces start as partial partitions of one filled window each; the two partitions
with the largest imbalance are merged, the fullest windows of one with the emptiest of the other, until one partition
of near-equal windows is left. Whenever a window exceeds the capacity, the block is packed again with one window
more.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import checkpointed
from .hashing import STEP, mix

WINDOW, CUT, BLOCK_WINDOWS = 2048, 256, 256
CACHED_WORDS, BLOCK = 400_000, 1 << 19
SPACE, LETTER, DIGIT, OTHER = range(4)
# The tokeniser's kinds of Latin-1 characters after lower-casing, and the endings that it splits off.
KIND = np.full(256, OTHER, np.uint8)
KIND[[*range(97, 123), 0xAA, 0xB5, 0xBA, *range(0xDF, 0xF7), *range(0xF8, 0x100)]] = LETTER
KIND[[*range(48, 58), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = DIGIT
KIND[[*range(9, 14), 32, 0x85, 0xA0]] = SPACE
ENDINGS = [b"s", b"t", b"m", b"d", b"re", b"ve", b"ll"]
PACKED = 4  # a word of up to so many times eight bytes is compared as integers
SHORT = 15  # a word of up to so many bytes and its size are two integers
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def load_tokenizer(name: str):
    """The tokeniser of a JSON file, or of a file name of the installed vocabularies."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if not os.path.exists(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    return Tokenizer.from_file(name)


def split_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the words that the tokeniser sees in lower-cased Latin-1 bytes that end in a line feed."""
    kind = KIND[data]
    begin = np.ones(len(data), bool)
    begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    mark = np.flatnonzero(begin[:-1] & (data[:-1] == ord("'")) & (kind[1:] == LETTER))
    after = np.stack([data[mark + 1], data[np.minimum(mark + 2, len(data) - 1)]])
    for ending in ENDINGS:
        hit = mark[np.all([after[i] == c for i, c in enumerate(ending)], axis=0)]
        begin[hit + 1] = False
        begin[hit + 1 + len(ending)] = True
    edges = np.append(np.flatnonzero(begin), len(data))
    word = kind[edges[:-1]] != SPACE
    return edges[:-1][word], edges[1:][word]


def every_eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as an integer; zeros follow the last."""
    padded = np.concatenate([data, np.zeros(8 * PACKED, np.uint8)])
    return np.ndarray(len(data) + 8 * (PACKED - 1) + 1, "<u8", padded.data, strides=(1,))


def number_words(data: np.ndarray, eights: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, example): words[i] equals words[example[which[i]]], and examples are distinct."""
    size = ends - starts
    parts, key = [], size.astype(np.uint64)
    for k in range(PACKED):
        at = np.arange(len(size)) if k == 0 else np.flatnonzero(size > 8 * k)
        value = eights[starts[at] + 8 * k] & MASKS[np.minimum(size[at] - 8 * k, 8)]
        key[at] = mix(key[at] * STEP + value)
        parts.append((at, value))
    raw, seen, long = data.tobytes(), {}, np.flatnonzero(size > 8 * PACKED)
    serial = np.array([seen.setdefault(raw[starts[i] : ends[i]], len(seen)) for i in long], np.uint64)
    key[long] = mix(key[long] * STEP + serial)
    order = np.argsort(key)
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    example = order[new]
    twin = example[which]
    same = np.array_equal(size, size[twin])
    for at, value in [*parts, (long, serial)] if same else []:  # equal keys are not taken for equal words
        whole = np.zeros(len(size), np.uint64)
        whole[at] = value
        same = same and np.array_equal(value, whole[twin[at]])
    if not same:
        words = [raw[a:b] for a, b in zip(starts, ends, strict=True)]
        first = {w: i for i, w in reversed(list(enumerate(words)))}
        example, which = np.unique([first[w] for w in words], return_inverse=True)
    return which, example


class ShortWords:
    """Places of words of at most ``SHORT`` bytes, as rows of a word's two integers and its place: each lies in the first
    free row from its hash on. A row whose second integer is 0 is free."""

    def __init__(self, slots: int = 1 << 16) -> None:
        self._rows, self._held = np.zeros((slots, 3), np.uint64), 0

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low * STEP + high) & np.uint64(len(self._rows) - 1)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of each word, -1 if it isn't held."""
        place, todo, at = np.full(len(low), -1, np.int64), np.arange(len(low)), self._slot(low, high)
        while len(todo):
            rows = np.take(self._rows, at, axis=0)
            here = (rows[:, 0] == low) & (rows[:, 1] == high) & (high != 0)
            place[todo[here]] = rows[here, 2].astype(np.int64)
            on = np.flatnonzero(~here & (rows[:, 1] != 0))
            todo, at, low, high = todo[on], (at[on] + 1) & (len(self._rows) - 1), low[on], high[on]
        return place

    def add(self, low: np.ndarray, high: np.ndarray, place: np.ndarray) -> None:
        """Distinct words that aren't held, and their places."""
        self._held += len(low)
        if 2 * self._held > len(self._rows):
            old = self._rows[self._rows[:, 1] != 0]
            self._rows = np.zeros((1 << (2 * self._held).bit_length(), 3), np.uint64)
            low, high, place = (np.concatenate([old[:, k], x.astype(np.uint64)]) for k, x in enumerate((low, high, place)))
        new = np.stack([low, high, place.astype(np.uint64)], axis=1)
        at = self._slot(low, high)
        while len(new):
            free = np.flatnonzero(self._rows[at, 1] == 0)
            self._rows[at[free]] = new[free]  # of several for one slot, the last stays
            left = np.flatnonzero((self._rows[at, 0] != new[:, 0]) | (self._rows[at, 1] != new[:, 1]))
            new, at = new[left], (at[left] + 1) & (len(self._rows) - 1)


class WordEncoder:
    """Ids of whole texts, remembering those of the words met so far.

    Texts of Latin-1 characters are lower-cased and split here by the tokeniser's rule, a block of texts at once, and
    only words not yet known go through its model. Other texts are cut at blanks, and the cuts not yet known go through
    it; a text that may hold a special token goes through it whole.
    """

    def __init__(self, tokenizer, most: int = CACHED_WORDS) -> None:
        from tokenizers import pre_tokenizers

        self._tokenizer, self._model, self._most = tokenizer, tokenizer.model, most
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # the byte-level form of each Latin-1 character, one or two characters, is looked up here
        self._forms = np.zeros((256, 2), "<u4")
        for c in set(range(256)) - {ord(" ")}:
            form = [ord(x) for part, _ in as_bytes.pre_tokenize_str(chr(c)) for x in part]
            self._forms[c, : len(form)] = form
        self._forms[ord(" "), 0] = ord(" ")  # stays, between words
        self._forget()

    def _forget(self) -> None:
        self._short, self._long = ShortWords(), {}
        self._cuts: dict[str, bytes] = {}
        self._ids, self._first = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _whole(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, words: list[bytes]) -> np.ndarray:
        """Places of words not known so far."""
        forms = self._forms[np.frombuffer(b" ".join(words), np.uint8)].reshape(-1)
        ids, ends, tokenize = array("I"), [], self._model.tokenize
        for word in forms[forms > 0].tobytes().decode("utf-32-le").split(" "):
            ids.extend([t.id for t in tokenize(word)])
            ends.append(len(ids))
        new = len(self._first) - 1 + np.arange(len(words))
        self._first = np.concatenate([self._first, len(self._ids) + np.array(ends, np.int64)])
        self._ids = np.concatenate([self._ids, np.frombuffer(ids, np.uint32)])
        return new

    def _block(self, texts: list[bytes]) -> list[bytes]:
        raw = b"\n".join(texts) + b"\n"
        data = np.frombuffer(raw, np.uint8)
        starts, ends = split_words(data)
        eights, size = every_eight(data), ends - starts
        low = eights[starts] & MASKS[np.minimum(size, 8)]
        high = eights[starts + 8] & MASKS[np.clip(size - 8, 0, 7)] | (size.astype(np.uint64) << np.uint64(56))
        high[size > SHORT] = 0  # never found
        place = self._short.find(low, high)
        rest = np.flatnonzero(place < 0)
        which, example = number_words(data, eights, starts[rest], ends[rest])
        if len(self._first) + len(example) > self._most and len(self._first) > 1:
            self._forget()
            rest = np.arange(len(size))
            which, example = number_words(data, eights, starts, ends)
        example = rest[example]
        words = [raw[a:b] for a, b in zip(starts[example].tolist(), ends[example].tolist(), strict=True)]
        found = np.array([self._long.get(w, -1) for w in words], np.int64)
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = self._learn([words[i] for i in new.tolist()])
            short = new[size[example[new]] <= SHORT]
            self._short.add(low[example[short]], high[example[short]], found[short])
            self._long.update((words[i], int(found[i])) for i in new[size[example[new]] > SHORT].tolist())
        place[rest] = found[which]
        n = self._first[place + 1] - self._first[place]
        stop = np.concatenate([[0], np.cumsum(n)])
        ids = self._ids[np.repeat(self._first[place] - stop[:-1], n) + np.arange(stop[-1])].tobytes()
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        cuts = 4 * np.concatenate([[0], stop[np.searchsorted(starts, text_ends)]])
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def _by_blanks(self, text: str) -> bytes:
        cuts = [c for c in re.split("[ \t\r\n]+", text) if c]
        unknown = [c for c in dict.fromkeys(cuts) if c not in self._cuts]
        if len(self._cuts) + len(unknown) > self._most:
            self._cuts.clear()
            unknown = list(dict.fromkeys(cuts))
        for c, e in zip(unknown, self._tokenizer.encode_batch(unknown, add_special_tokens=False), strict=True):
            self._cuts[c] = array("I", e.ids).tobytes()
        return b"".join([self._cuts[c] for c in cuts])

    def encode(self, texts: Iterable[str | None], block: int = BLOCK) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, in order; texts are taken a block at a time."""
        group: list[bytes | None] = []
        plain: list[bytes] = []
        size = 0

        def done() -> Iterator[bytes]:
            made = iter(self._block(plain) if plain else [])
            yield from (next(made) if ids is None else ids for ids in group)

        for text in texts:
            text = text or ""
            try:
                if "<|" in text:
                    group.append(self._whole(text))
                elif "\u0130" in text or "\u212a" in text:
                    group.append(self._by_blanks(text))
                else:
                    plain.append(text.lower().encode("latin-1"))
                    group.append(None)
            except UnicodeEncodeError:
                group.append(self._by_blanks(text))
            size += len(text)
            if size >= block:
                yield from done()
                group, plain, size = [], [], 0
        yield from done()


def _pieces(tokenizer: str, end_id: int, window: int, cut: int):
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(load_tokenizer(tokenizer))
        for batch in batches:
            rows = []
            for doc, tokens in zip(batch.column("doc_id").to_pylist(), encoder.encode(x.as_py() for x in batch.column("text")), strict=True):
                tokens += end
                n, at = len(tokens) // 4, 0
                while at < n:
                    length = window if n - at >= window else min(cut, n - at)
                    rows.append((doc, at, length, zlib.crc32(tokens[4 * at : 4 * (at + length)]), n))
                    at += length
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def differencing(sizes: np.ndarray, windows: int) -> list[list[int]]:
    """Karmarkar-Karp: the members of ``windows`` near-equal windows.

    A merge keeps only its order of windows; members are found by following the orders back from the last merge.
    """
    if not len(sizes):
        return [[] for _ in range(windows)]
    kind = np.int16 if sizes.max() < 1 << 14 else np.int64  # no sum is above twice the largest size
    heap = []
    for i, x in enumerate(sizes.tolist()):  # sums in rising order, over a common base
        sums = np.zeros(windows, kind)
        sums[-1] = x
        heap.append((-x, i, sums, i))
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        _, i, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heap[0]
        sums = a + b[::-1]
        order = sums.argsort(kind="stable")
        sums = sums[order]
        sums -= sums[0]
        merges.append((order.astype(np.int32), in_a, in_b))
        heapq.heapreplace(heap, (-int(sums[-1]), i, sums, len(sizes) + len(merges) - 1))
    place: list[np.ndarray | None] = [None] * (len(sizes) + len(merges))
    place[-1] = np.arange(windows)
    for at in range(len(merges) - 1, -1, -1):
        order, in_a, in_b = merges[at]
        own, place[len(sizes) + at] = place[len(sizes) + at], None
        place[in_a] = np.empty(windows, np.int64)
        place[in_a][order] = own
        place[in_b] = place[in_a][::-1]
    members: list[list[int]] = [[] for _ in range(windows)]
    for i in range(len(sizes)):
        members[place[i][-1]].append(i)
        place[i] = None
    return members


def _pack(window: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row").reset_index(drop=True)
        size = rows.length.to_numpy()
        whole = np.flatnonzero(size == window)
        rest = np.flatnonzero(size < window)
        count = -(-int(size[rest].sum()) // window)
        packed = differencing(size[rest], count) if count else []
        while any(size[rest[m]].sum() > window for m in packed):
            count += 1
            packed = differencing(size[rest], count)
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        packed = [rest[np.sort(m)] for m in packed if m]
        for w, at in enumerate(packed):
            sequence[at] = w
            offset[at] = np.cumsum(size[at]) - size[at]
        sequence[whole] = len(packed) + np.arange(len(whole))
        return rows.assign(sequence_id=rows.block * (1 << 32) + sequence, offset=offset).drop(columns=["block", "row"])

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, window: int = WINDOW, cut: int = CUT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its ids and then ``end_id``; each id lies in exactly one piece, and a sequence's pieces fill it
    from 0 without gaps. Cases: a null or empty text is ``end_id`` alone; a null id stays null; repeated rows are
    packed each, in any block; a very long text is cut over many blocks; extra columns are ignored; an empty table gives none.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = checkpointed(rows.mapInArrow(_pieces(tokenizer, end_id, window, cut), kind))
    total = pieces.agg(F.sum("length")).first()[0] or 0
    blocks = max(1, round(total / (window * BLOCK_WINDOWS)))
    numbered = pieces.withColumn("row", F.monotonically_increasing_id())  # fixed, as the pieces are written
    dealt = numbered.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(_pack(window), f"{kind}, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
