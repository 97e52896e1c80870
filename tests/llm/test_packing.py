"""Differencing against its plain form, and ids of every Latin-1 character."""

import heapq

import numpy as np

from arrowlake.llm import packing


def plain(sizes, windows):
    heap = [(-int(x), i, [0] * (windows - 1) + [int(x)], {windows - 1: [i]}) for i, x in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, i, a, in_a), (_, _, b, in_b) = heapq.heappop(heap), heapq.heappop(heap)
        sums = [x + y for x, y in zip(a, b[::-1])]
        order = sorted(range(windows), key=sums.__getitem__)
        members = {k: in_a.get(w, []) + in_b.get(windows - 1 - w, []) for k, w in enumerate(order)}
        sums = [sums[w] - sums[order[0]] for w in order]
        heapq.heappush(heap, (-sums[-1], i, sums, members))
    return [sorted(heap[0][3].get(w, [])) for w in range(windows)]


def test_differencing_by_orders_is_the_plain_one():
    for seed, most, windows in ((1, 257, 13), (2, 40_000, 5), (3, 9, 30)):
        sizes = np.random.default_rng(seed).integers(1, most, 120)
        assert [sorted(m) for m in packing.differencing(sizes, windows)] == plain(sizes, windows)
    assert packing.differencing(np.zeros(0, np.int64), 2) == [[], []]


def test_words_of_every_latin_character():
    tokenizer = packing.load_tokenizer("word_bpe_49k.json")
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)} {chr(c)}" for c in range(256)] + ["".join(map(chr, range(1, 256))), "", None]
    found = list(packing.WordEncoder(tokenizer).encode(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_known_words_are_found_by_their_integers(monkeypatch):
    numbered = []
    plainly = packing.number_words
    monkeypatch.setattr(packing, "number_words", lambda data, *more: numbered.append(len(more[-1])) or plainly(data, *more))
    tokenizer = packing.load_tokenizer("word_bpe_49k.json")
    rng = np.random.default_rng(5)
    words = [bytes(rng.choice([0, 1, 97, 98, 233], n).astype(np.uint8)).decode("latin-1") for n in rng.integers(1, 40, 3000)]
    texts = [" ".join(words), "a" * 15 + " " + "a" * 16 + " " + "a" * 15 + "\0", "\0" * 8 + " " + "\0" * 16 + " " + "\0" * 7]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    encoder = packing.WordEncoder(tokenizer)
    assert list(encoder.encode(texts)) == want
    first = numbered.pop()
    assert list(encoder.encode(texts)) == want
    assert 0 < numbered.pop() < first / 2  # long words alone
    assert list(packing.WordEncoder(tokenizer, most=100).encode(texts * 2, block=1)) == want * 2  # forgets and learns anew


def test_short_words_that_share_a_slot(monkeypatch):
    monkeypatch.setattr(packing, "mix", lambda x: x % np.uint64(3))
    held = packing.ShortWords(4)
    low, high = np.arange(300, dtype=np.uint64), np.full(300, 1 << 56, np.uint64)
    for part in (slice(0, 1), slice(1, 120), slice(120, 200)):
        held.add(low[part], high[part], np.arange(300)[part])
    assert held.find(low, high).tolist() == [*range(200), *[-1] * 100]
    assert held.find(low[:1], np.zeros(1, np.uint64)).tolist() == [-1]
