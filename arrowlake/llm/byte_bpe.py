"""Byte-level byte-pair encoding in two tiers, and decoding.

A text is split into pre-tokens. The distinct ones of a stretch of text go through a minimal perfect hash over the
vocabulary, in one vectorised look-up: a pre-token that is a vocabulary entry has its id at once. The others are
merged: the bytes of a pre-token form a linked list, every adjacent pair has the rank of its union, and a heap gives
the lowest rank (of equal ones the leftmost) until no pair is in the vocabulary.

Ids travel in pieces of bounded size, so that neither a row nor a worker holds all ids of a very long text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import BASE, BYTE_TABLE, INVERSE, mix, powers

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Characters of text taken at once, ids of a piece at most, pre-tokens remembered, keys a bucket, displacements tried at once,
#: bytes that a heap entry stands for.
STRETCH, PIECE_IDS, REMEMBERED, BUCKET_KEYS, TRIES, SPAN = 1 << 19, 1 << 16, 400_000, 4, 32, 64
NONE = (1 << 31) - 1

# Letters and numbers that Unicode 16.0 added, as (first, last) code points; older ones come from unicodedata.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _ranges(kind: str, new: list[tuple[int, int]], stop: int) -> str:
    """The characters of a general category below ``stop``, as the inside of a character class."""
    member = np.array([unicodedata.category(chr(c))[0] == kind for c in range(stop)] + [False])
    for first, last in new:
        member[first : min(last + 1, stop)] = True
    edges = np.flatnonzero(np.diff(member.astype(np.int8), prepend=0))
    return "".join(f"{chr(a)}-{chr(b - 1)}" for a, b in edges.reshape(-1, 2))


@functools.cache
def splitter(latin: bool) -> tuple[re.Pattern, re.Pattern]:
    """(pre-tokens, places where a text may be cut without changing them), for Latin-1 texts or for all."""
    stop = 256 if latin else 0x110000
    letter, number = _ranges("L", NEW_LETTERS, stop), _ranges("N", NEW_NUMBERS, stop)
    blank = BLANKS[:6] if latin else BLANKS
    # contractions, then runs of one kind behind at most one space, then blanks, the last of which stays with what follows
    tokens = rf" ?[{letter}]+|'(?:[stmd]|re|ve|ll)| ?(?:[{number}]+|[^{blank}{letter}{number}]+)|[{blank}]+(?![^{blank}])|[{blank}]+"
    kinds = rf"[^{blank}](?=[{blank}])|[{letter}](?=[^{blank}{letter}])|[{number}](?=[^{blank}{number}])|[^{blank}{letter}{number}'](?=[{letter}{number}])"
    return re.compile(tokens), re.compile(kinds)


def stretches(text: str, size: int = STRETCH) -> Iterator[list[str]]:
    """The pre-tokens of a text, a stretch of about ``size`` characters at a time; one pre-token is never cut."""
    try:
        text.encode("latin-1")
        tokens, edge = splitter(True)
    except UnicodeEncodeError:
        tokens, edge = splitter(False)
    at = 0
    while at < len(text):
        found = edge.search(text, at + size) if at + size < len(text) else None
        end = found.start() + 1 if found else len(text)
        yield tokens.findall(text, at, end)
        at = end


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary of a rank file, by id."""
    if not os.path.exists(path):
        import public_tokenizers

        path = public_tokenizers.path(path)
    with open(path, "rb") as lines:
        ranked = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    if sorted(ranked) != list(range(len(ranked))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranked[i] for i in range(len(ranked))]


def hashes(tokens: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each byte string."""
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    stop = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(tokens), np.uint8)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_TABLE[data] * powers(BASE, len(data)), out=sums[1:])
    return mix((sums[stop[1:]] - sums[stop[:-1]]) * powers(INVERSE, len(data) + 1)[stop[:-1]] + size.astype(np.uint64))


class PerfectHash:
    """A minimal perfect hash by displacement: n distinct keys fill n slots, and a look-up reads one displacement.

    Keys fall into buckets; large buckets first, each is moved by the smallest displacement that takes all its keys to
    free slots. A bucket of one key names its slot itself. The answer for a key outside the set is any slot, so a
    caller compares the slot's key.
    """

    def __init__(self, keys: np.ndarray) -> None:
        self.slots = len(keys)
        self.buckets = -(-self.slots // BUCKET_KEYS)
        self.moves = np.zeros(self.buckets, np.int64)
        bucket = (keys % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        first = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        free = np.ones(self.slots, bool)
        alone = []
        for b in np.argsort(first[:-1] - first[1:], kind="stable"):
            mine = keys[order[first[b] : first[b + 1]]]
            if len(mine) == 1:
                alone.append(b)
            elif len(mine):
                found = []
                for tried in range(0, 1 << 40, TRIES):
                    at = self._moved(mine, np.arange(tried, tried + TRIES)[:, None])
                    for t in np.flatnonzero(free[at].all(axis=1)):
                        if len(set(at[t].tolist())) == len(mine):
                            found = at[t]
                            break
                    if len(found):
                        break
                free[found] = False
                self.moves[b] = tried + t
        self.moves[alone] = -1 - np.flatnonzero(free)[: len(alone)]

    def _moved(self, keys: np.ndarray, move) -> np.ndarray:
        turned = mix(keys ^ (np.asarray(move).astype(np.uint64) * BASE))
        return (turned % np.uint64(self.slots)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key."""
        move = self.moves[(keys % np.uint64(self.buckets)).astype(np.int64)]
        return np.where(move < 0, -1 - move, self._moved(keys, np.maximum(move, 0)))


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token by merges of rising rank. Every heap entry stands for ``SPAN`` neighbouring bytes and
    their lowest rank, so that a pre-token of m bytes takes about 14 m bytes of memory."""
    n, get = len(piece), ranks.get
    after, before = range(1, n + 1), range(-1, n - 1)
    if n < 1 << 12:
        pair = [get(piece[i : i + 2], NONE) for i in range(n)]
        after, before = list(after), list(before)
    else:  # the same, in less memory
        pair = array("i", (get(piece[i : i + 2], NONE) for i in range(n)))
        after, before = array("i", after), array("i", before)
    pair[n - 1] = NONE
    heap = [min(pair[a : a + SPAN]) << 32 | a for a in range(0, n, SPAN)]
    heapq.heapify(heap)
    while (rank := heap[0] >> 32) < NONE:
        start = heap[0] & 0xFFFFFFFF
        try:
            i = pair.index(rank, start, start + SPAN)
        except ValueError:  # the lowest rank of these bytes has risen
            heapq.heapreplace(heap, min(pair[start : start + SPAN]) << 32 | start)
            continue
        j = after[i]
        k = after[i] = after[j]
        pair[j] = NONE
        if k < n:
            before[k] = i
            pair[i] = get(piece[i : after[k]], NONE)
        else:
            pair[i] = NONE
        p = before[i]
        if p >= 0:
            pair[p] = get(piece[p:k], NONE)
        heapq.heapreplace(heap, min(pair[start : start + SPAN]) << 32 | start)
        if 0 <= p < start and pair[p] < NONE:
            heapq.heappush(heap, pair[p] << 32 | p - p % SPAN)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Codec:
    """Encodes pre-tokens by one vocabulary."""

    def __init__(self, vocabulary: list[bytes]) -> None:
        self.vocabulary = vocabulary
        self._ranks = {token: i for i, token in enumerate(vocabulary)}
        keys = hashes(vocabulary)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two entries of the vocabulary share a hash")
        self._perfect = PerfectHash(keys)
        self._ids = np.empty(len(keys), np.int64)
        self._ids[self._perfect.find(keys)] = np.arange(len(keys))
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _learn(self, tokens: list[str]) -> None:
        raw = [t.encode() for t in tokens]
        whole = self._ids[self._perfect.find(hashes(raw))].tolist()
        for token, piece, i in zip(tokens, raw, whole, strict=True):
            ids = [i] if self.vocabulary[i] == piece else merged(piece, self._ranks)
            self._young[token] = array("i", ids).tobytes()

    def encode(self, tokens: list[str]) -> bytes:
        """The ids of some pre-tokens, 32 bits each. Those met lately are remembered, in two generations."""
        if len(self._young) > REMEMBERED:
            self._old, self._young = self._young, {}
        unknown = set(tokens).difference(self._young)
        for token in [t for t in unknown if t in self._old]:
            self._young[token] = self._old[token]
            unknown.remove(token)
        if unknown:
            self._learn(list(unknown))
        return b"".join(map(self._young.__getitem__, tokens))


@functools.lru_cache(2)
def codec(vocabulary: str) -> Codec:
    return Codec(read_ranks(vocabulary))


class Strings:
    """Byte strings by number, joined for an array of numbers at once."""

    def __init__(self, strings: list[bytes]) -> None:
        self._size = np.fromiter(map(len, strings), np.int64, len(strings))
        self._start = np.cumsum(self._size) - self._size
        self._data = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, numbers: np.ndarray) -> bytes:
        size = self._size[numbers]
        stop = np.cumsum(size)
        at = np.arange(stop[-1] if len(stop) else 0)
        return self._data[at + np.repeat(self._start[numbers] - stop + size, size)].tobytes()


@functools.lru_cache(2)
def entries(vocabulary: str) -> Strings:
    """The bytes of each id."""
    return Strings(codec(vocabulary).vocabulary)


@functools.lru_cache(2)
def decimals(n: int) -> Strings:
    """The numbers below n in print, each behind a comma."""
    return Strings([b",%d" % i for i in range(n)])


Batches = Iterator[pa.RecordBatch]
Step = Callable[[Batches], Batches]
PIECES = "doc_id long, piece int, last boolean, ids array<int>"


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])]).astype(np.int32)
    values = np.concatenate([r[3] for r in rows]) if rows else np.zeros(0, np.int32)
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
    kinds = [pa.int64(), pa.int32(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)] + [ids], names=["doc_id", "piece", "last", "ids"])


def encoding(vocabulary: str, most: int) -> Step:
    """From (doc_id, text) to pieces."""

    def run(batches: Batches) -> Batches:
        own = codec(vocabulary)
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                number, rest = 0, b""
                for tokens in stretches(text.as_py() or ""):
                    rest += own.encode(tokens)
                    while len(rest) > 4 * most:
                        rows.append((doc, number, False, np.frombuffer(rest[: 4 * most], np.int32)))
                        number, held, rest = number + 1, held + most, rest[4 * most :]
                        if held > 16 * most:
                            yield _piece_batch(rows)
                            rows, held = [], 0
                rows.append((doc, number, True, np.frombuffer(rest, np.int32)))
                held += len(rest) // 4
                if held > 16 * most:
                    yield _piece_batch(rows)
                    rows, held = [], 0
            yield _piece_batch(rows)

    return run


def decoding(vocabulary: str) -> Step:
    """Adds the bytes of each piece's ids."""

    def run(batches: Batches) -> Batches:
        table, none = entries(vocabulary), np.zeros(0, np.int32)
        for batch in batches:
            raw = [table.joined(x.values.to_numpy() if x.is_valid else none) for x in batch.column("ids")]
            yield batch.append_column("decoded", pa.array(raw, pa.binary()))

    return run


def digesting(vocabulary: str) -> Step:
    """From the adjacent pieces of each document, with their bytes, to one row."""

    def run(batches: Batches) -> Batches:
        table = decimals(len(codec(vocabulary).vocabulary))
        n, ids, raw = 0, hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            rows = []
            columns = [batch.column(c) for c in ("doc_id", "last", "ids", "decoded")]
            for doc, last, some, text in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2], columns[3], strict=True):
                if len(some):
                    printed = table.joined(some.values.to_numpy())
                    ids.update(printed if n else printed[1:])
                    n += len(some)
                raw.update(text.as_py())
                if last:
                    rows.append((doc, n, ids.hexdigest(), raw.hexdigest()))
                    n, ids, raw = 0, hashlib.sha256(), hashlib.sha256()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", most: int = PIECE_IDS) -> DataFrame:
    """Pieces of the documents' ids: ``doc_id, piece (from 0), last (of its document), ids array<int>``.

    A document's pieces are adjacent rows of one partition in rising order, of at most ``most`` ids each; nothing is
    shuffled. Cases: a null or empty text is one piece without ids; a null id stays null; repeated rows are encoded
    each; a very long text is read in stretches and gives many pieces; a single long pre-token takes about 14 bytes of
    memory a byte; extra columns are ignored; an empty table gives none. Merges of equal rank are taken from the left.
    """
    return _texts(docs, id_col, text_col).mapInArrow(encoding(vocabulary, most), PIECES)


def decode_pieces(pieces: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``pieces`` with ``decoded`` (binary): the bytes of each piece's ids, which joined in order are the document's.
    A piece may end within a character. Null ids give no bytes; an id outside the vocabulary is an error."""
    return pieces.mapInArrow(decoding(vocabulary), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", decoded binary")


def round_trips(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text", most: int = PIECE_IDS) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document: the pieces of ``encode_documents`` and
    ``decode_pieces``, digested in one pass of the same workers."""

    def run(batches: Batches) -> Batches:
        for step in (encoding(vocabulary, most), decoding(vocabulary), digesting(vocabulary)):
            batches = step(batches)
        return batches

    return _texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, with digests of both."""
    return round_trips(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
