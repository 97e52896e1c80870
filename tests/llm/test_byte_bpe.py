"""Byte-level encoding against the tiktoken library, and round trips."""

import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from arrowlake.llm import byte_bpe as B

PARTS = [
    " ", "  ", "\n", "\t", "'s", "'S", "'ll", "a", "B", "é", "ß", "Ж", "漢", "字", "1", "²", "٣", "_", "-", "!", "…", "\xa0", "　", " ", " ", "\x1c", "\x00", "\x85",
    "\U0001f600", "\U00013460", "́", "\U00010ee7", "\U0001ccf0", "x" * 70, "ab" * 50, "'", "''", "ﬁ", "०", "Ⅷ", "the", " of", "<|endoftext|>",
]


@pytest.fixture(scope="module")
def library():
    ranks = {token: i for i, token in enumerate(B.read_ranks(B.VOCABULARY))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_hash_is_perfect_and_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    assert sorted(B.PerfectHash(keys).find(keys).tolist()) == list(range(len(keys)))
    own = B.codec(B.VOCABULARY)
    assert own._ids[own._perfect.find(B.hashes(own.vocabulary))].tolist() == list(range(len(own.vocabulary)))
    assert own._perfect.find(B.hashes([b"no such entry", b""])).max() < len(own.vocabulary)


def test_classes_of_every_character(library):
    ids = {bytes([i]): i for i in range(256)}
    for pattern, kind, new in ((r"\p{L}", "L", B.NEW_LETTERS), (r"\p{N}", "N", B.NEW_NUMBERS)):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ids, special_tokens={})
        import re

        own = re.compile(f"[{B._ranges(kind, new, 0x110000)}]")
        for c in [*range(0xD800), *range(0xE000, 0x32000)]:
            assert bool(own.match(chr(c))) == bool(probe.encode_ordinary(chr(c))), hex(c)


def test_encoding_in_stretches_of_any_size(library):
    rng, own = random.Random(2), B.codec(B.VOCABULARY)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40)))
        for size in (1, 7, 1 << 19):
            got = b"".join(own.encode(t) for t in B.stretches(text, size))
            assert np.frombuffer(got, np.int32).tolist() == library.encode_ordinary(text)


def test_one_long_word(library):
    own, rng = B.codec(B.VOCABULARY), random.Random(3)
    for word in ["x" * 20_000, "".join(rng.choice("abcde") for _ in range(20_000))]:
        assert B.merged(word.encode(), own._ranks) == library.encode_ordinary(word)
    long = b"".join(rng.choice([b"ab", b"qzj"]) for _ in range(400_000))
    tracemalloc.start()
    B.merged(long, own._ranks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(long)


def test_documents(spark, library):
    rng = random.Random(4)
    texts = [None, "", "  ", "one", "one", "Ein Wort. " * 300_000, *("".join(rng.choice(PARTS) for _ in range(50)) for _ in range(60))]
    docs = spark.createDataFrame([(i // 2 if i % 7 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, ids int").repartition(3)
    want = sorted((repr(r.doc_id), len(x := library.encode_ordinary(r.text or "")), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in docs.collect())
    small = docs.where(F.length("text") < 10_000)
    pieces = B.encode_documents(small, most=5)
    assert pieces.where(F.size("ids") > 5).count() == 0
    assert B.decode_pieces(pieces).where("last").count() == small.count()
    joined = B.decode_pieces(pieces).groupBy("doc_id").agg(F.sum(F.octet_length("decoded")).alias("n"))
    assert {(r[0], r[1]) for r in joined.collect()} == {(r[0], r[1]) for r in small.groupBy("doc_id").agg(F.sum(F.octet_length("text"))).collect()}
    assert sorted((repr(r[0]), *r[1:]) for r in B.round_trips(docs).collect()) == want
    assert sorted((repr(r[0]), *r[1:]) for r in B.round_trips(docs, most=1000).collect()) == want
    assert B.round_trips(docs.limit(0)).count() == 0


def test_query_on_the_test_tables(spark, library):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r[1:]) for r in B.op13_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    for doc, text in rows:
        ids = library.encode_ordinary(text or "")
        assert got[doc] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
