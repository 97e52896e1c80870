"""The pipeline operators against brute force, and their behaviour on odd tables."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arrowlake.llm import fingerprints, html_extract, language_id, mixing, ngram_join, packing, quality, secret_scan, suffix_dedup, topk_search

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, schema=DOCS):
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def words(rng, n):
    return " ".join(rng.choice(["ab", "cd", "ef", "Gh", "ij", "kl", "mn", "op", "qr", "st"]) + str(rng.randint(0, 40)) for _ in range(n))


ODD = [None, "", "   \n", "one", "ONE", "a b c", "x" * 5000, "é ü ß 漢字 \U0001f600", "a b c d e f g h i j", "a b c d e f g h i j"]


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(0)
    vectors = rng.integers(-3, 4, (90, 5)) / 2
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(200, None), (201, [float("nan")] * 5), (202, [1.0, None]), (None, [1.0] * 5), (7, [0.5] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    out = topk_search.top_k_search(df, F.col("vec_id") % 20 == 0, k=6, query_block=2, shard_rows=7, merge_fan_in=3).toPandas()
    whole = [(i, np.floor(64 * np.array(v, float))) for i, v in rows if i is not None and i < 200]
    for q in range(0, 90, 20):
        best = sorted(((-int(whole[q][1] @ v), i) for i, v in whole if i != q))[:6]
        got = out[out.query_id == q].sort_values("rank")
        assert [(-s, c) for s, c in zip(got.score, got.candidate_id)] == best
    assert topk_search.top_k_search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def components(texts, k, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return set() if not w else {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}

    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((parent[i], parent[j]))
            parent = [a if p == b else p for p in parent]
    return [(len(s), p) for s, p in zip(sets, parent)]


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80)])
def test_jaccard_components_against_brute_force(spark, k, percent):
    rng = random.Random(k)
    texts = list(ODD)
    for _ in range(12):
        base = words(rng, rng.randint(8, 120)).split()
        for _ in range(rng.randint(1, 12)):
            edited = list(base)
            for _ in range(rng.randint(0, 4)):
                edited[rng.randrange(len(edited))] = "zz" + str(rng.randint(0, 9))
            texts.append(" ".join(edited))
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(table(spark, texts).withColumn("component", F.lit(1)), k, percent).collect()}
    assert [out[i] for i in range(len(texts))] == components(texts, k, percent)
    assert ngram_join.jaccard_components(table(spark, [])).count() == 0


def test_links_are_thinned_but_join_the_same_documents():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 1 << 62, 60, dtype=np.uint64))
    group = [np.sort(np.delete(base, rng.choice(60, 4, False))) for _ in range(20)]
    links = ngram_join.links_between(group, None, 80)
    assert 0 < len(links) < 20
    for i, j in links:
        assert 100 * len(np.intersect1d(group[i], group[j])) >= 80 * len(np.union1d(group[i], group[j]))


def test_language_of_held_out_texts(spark):
    rng = random.Random(1)
    alphabets = {"aa": "abcdef ", "bb": "uvwxyzé ", "cc": "klmno "}
    rows = [(i, "".join(rng.choice(alphabets[lang]) for _ in range(80)), lang) for i, lang in enumerate(list(alphabets) * 40)]
    rows += [(900, None, "aa"), (901, "123 !", "aa"), (902, "abcabc", None), (902, "abcabc", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(0))
    out = language_id.identify_language(df, ~language_id.held_out(F.col("doc_id"))).select("doc.doc_id", "doc.lang", "lang_pred", F.col("score")).toPandas()
    held = out[np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]) & (out.doc_id < 900)]
    assert len(held) and (held.lang == held.lang_pred).all() and out.score.between(0, 1).all()
    assert set(out[out.doc_id.isin([900, 901])].lang_pred) == {"und"}
    untaught = language_id.identify_language(df, F.lit(False))
    assert {r.lang_pred for r in untaught.collect()} == {"und"} and language_id.identify_language(df.limit(0), F.lit(True)).count() == 0


def test_fingerprints(spark):
    rng = random.Random(5)
    texts = [*ODD, *(words(rng, 200) for _ in range(6))]
    rows = sorted(fingerprints.fingerprint_edits(table(spark, texts)).collect())
    for i, r in enumerate(rows):
        t, n = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert rows[8].fingerprint == rows[9].fingerprint and rows[8].near_next == 1
    one = spark.createDataFrame([(1, words(rng, 300))], "doc_id long, text string")
    part = one.select(fingerprints.sketch(F.col("text")).alias("a"), fingerprints.sketch(F.array_join(F.slice(F.split("text", " "), 1, 100), " ")).alias("b"))
    assert part.select(fingerprints.containment(F.col("b"), F.col("a")).alias("c")).first().c > 0.9
    assert fingerprints.fingerprint_edits(table(spark, [])).count() == 0
    assert fingerprints.fingerprint_edits(table(spark, ["a b"])).first().near_next == 1


def test_next_row_over_many_buckets(spark):
    rng = random.Random(2)
    ids = rng.sample(range(10**6), 300)
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, text string").repartition(7)
    out = {r.id: r.next_text for r in fingerprints.with_next(df, "id", "text", ["text"], bucket_rows=3).collect()}
    ids.sort()
    assert out == {a: f"t{b}" for a, b in zip(ids, ids[1:] + ids[:1])}


def test_packing_is_a_gapless_round_trip(spark):
    rng = random.Random(9)
    texts = [*ODD, *(words(rng, rng.randint(1, 3000)) for _ in range(25)), "it's <|endoftext|> ok \x1c x"]
    out = packing.pack_documents(table(spark, texts).drop("lang")).toPandas()
    tokenizer = packing.load_tokenizer("word_bpe_49k.json")
    for doc, part in out.sort_values("start").groupby("doc_id"):
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        assert set(part.doc_tokens) == {len(ids)}
        assert part.start.tolist() == (part.length.cumsum() - part.length).tolist() and part.length.sum() == len(ids)
        assert part.ids_crc32.tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(part.start, part.length)]
    full = 0
    for _, part in out.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == (part.length.cumsum() - part.length).tolist() and part.length.sum() <= 2048
        full += 1
    assert full <= -(-out.length.sum() // 2048) + 2
    assert packing.pack_documents(table(spark, [])).count() == 0


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(4).integers(1, 256, 200)
    parts = packing.differencing(sizes, 13)
    assert sorted(i for m in parts for i in m) == list(range(200))
    sums = [sizes[m].sum() for m in parts]
    assert max(sums) - min(sums) <= 8


def test_secret_spans(spark):
    key = "AKIA" + "A1" * 8
    bare = "wJalrXUtnFEMIK7MDENG" * 2
    texts = [None, "", f"password: hunter2hunter2 é {key}", f"{bare} alone", f"{key} then {bare}", "secret=token:abcdefghij", "TOKEN = 'abc'", "f" * 32 + " " + "e" * 31, "http://x.example.com/y", f"é {bare} http://db.example.com/z"]
    df = table(spark, texts).withColumn("spans", F.lit("clash"))
    out = {r.doc_id: [(secret_scan.KINDS[s.kind], s.start, s.end) for s in r.secret_spans] for r in secret_scan.scan_secrets(df).collect()}
    assert out[0] == out[1] == out[3] == out[5] == out[6] == out[8] == []
    assert out[2] == [("assign", 0, 24), ("access", 27, 47)] and out[7] == [("hex", 0, 32)]
    assert out[4] == [("access", 0, 20), ("secret", 26, 66)]
    assert out[9] == [("secret", 2, 42), ("endpoint", 43, 66)]
    clean = {r.doc_id: r for r in secret_scan.redact(df).collect()}
    assert clean[2].text == "[secret] é [secret]" and clean[2].n_chars == 19 and clean[3].text == texts[3] and clean[0].text is None
    assert secret_scan.redact(df).columns == df.columns


def test_weak_parts_link_on_both_sides(spark):
    key, place, bare = "AKIA" + "A1" * 8, "http://db.example.com/z", "wJalrXUtnFEMIK7MDENG" * 2
    pairs = [(bare, key), (key, bare), (place, key), (key, place), (bare, place), (place, bare), (place, "password: hunter2hunter2"), ("password: hunter2hunter2", place)]
    gaps, ends = [1, 100, 190, 300], ["", " x" * 400 + " " + "f" * 32]
    texts = [f"{a}{' ' * gap}{b}{end}" for a, b in pairs for gap in gaps for end in ends] + [f"{key} secret={bare}"]
    strong = {"password": "assign", "AKIA": "access", "wJal": "secret", "http": "endpoint"}
    kind = lambda part: next(k for x, k in strong.items() if part.startswith(x))
    out = {r.doc_id: [(secret_scan.KINDS[s.kind], s.start, s.end) for s in r.secret_spans] for r in secret_scan.scan_secrets(table(spark, texts)).collect()}
    for i, ((a, b), gap, end) in enumerate(itertools.product(pairs, gaps, ends)):
        spans = [(kind(a), 0, len(a)), (kind(b), len(a) + gap, len(a) + gap + len(b))]
        near = len(a) + gap <= secret_scan.SCOPE
        wanted = [s for s in spans if near or s[0] in ("assign", "access")] + ([("hex", len(texts[i]) - 32, len(texts[i]))] if end else [])
        assert out[i] == wanted, (a, b, gap, end)
    assert out[len(texts) - 1] == [("access", 0, 20), ("assign", 21, 68)]


def test_repeats_against_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 400))) for _ in range(30)]
    texts = [rng.choice(base) + "".join(rng.choice("ab\n") for _ in range(rng.randint(0, 60))) + rng.choice(base)[rng.randint(0, 30) : 200] for _ in range(80)]
    texts += [None, "", "a" * 300, "ab" * 120, texts[0], texts[0]]
    length, seen = 40, {}
    data = [(t or "").encode() for t in texts]
    for i, b in enumerate(data):
        for p in range(len(b) - length + 1):
            seen.setdefault(b[p : p + length], []).append((i, p))
    gone = [np.zeros(len(b), bool) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + length] = True
    out = {r.doc_id: r for r in suffix_dedup.remove_repeats(table(spark, texts), length, 8).collect()}
    for i, (b, g) in enumerate(zip(data, gone)):
        runs = int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum())
        assert tuple(out[i])[1:] == (len(b), int(g.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~g].tobytes()).hexdigest())
    assert suffix_dedup.remove_repeats(table(spark, [])).count() == 0


def page(rng, i):
    ps = [" ".join(rng.choice(["lorem", "ipsum", "dolor,", "sit.", "amet"]) for _ in range(rng.randint(10, 60))) for _ in range(4)]
    body = "".join(f"<p>{p}</p>" for p in ps)
    html = f"<html><head><title>t</title><script>var x='<p>no</p>'</script></head><body><nav><ul><li><a href=/>home</a></li><li><a>news</a></li></ul></nav><div class='ad'>buy this now.</div><article><h1>Title {i} &eacute;</h1>{body}</article><footer>&copy; me</footer>"
    return html, "\n".join([f"Title {i} é", *ps])


def test_main_text(spark):
    rng = random.Random(6)
    pages = [page(rng, i) for i in range(60)]
    rows = [(i, f"u{i}", h) for i, (h, _) in enumerate(pages)] + [(100, "u", None), (101, None, ""), (102, "u", "<p>unclosed <b>text")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = {r.page_id: r.main for r in html_extract.extract_main_text(df).select("doc.page_id", F.col("text").alias("main")).collect()}
    assert [out[i] for i in range(60)] == [t for _, t in pages] and out[100] == out[101] == ""
    assert html_extract.extract_main_text(df.limit(0)).count() == 0


def test_decoding_is_consistent():
    p = html_extract.Page("<div><section><p>a</p></section></div>")
    kept = html_extract.decode(p, np.array([1.0, -3.0, -1.0, 2.0]))
    assert kept.tolist() == [True, False, False, False]
    kept = html_extract.decode(p, np.array([1.0, -1.0, -1.0, 5.0]))
    assert kept.all()


def test_quality_drops_junk_and_keeps_clean(spark):
    rng = random.Random(8)
    prose = lambda: " ".join(rng.choice(["the", "of", "and", "a", "in"]) + " " + words(rng, 1) for _ in range(80))
    good = [prose() for _ in range(200)]
    junk = [" | ".join(prose().split()) for _ in range(8)] + [" ".join(w + "###$$$" for w in prose().split()) for _ in range(8)] + [prose().upper().replace(" ", "!! ") for _ in range(8)] + ["again " * 200 for _ in range(6)]
    out = quality.quality_scores(table(spark, good + junk + [None, "", " "])).toPandas().sort_values("doc_id")
    assert out.quality_keep[:200].all() and not out.quality_keep[200:].any()
    assert quality.quality_scores(table(spark, [])).count() == 0


def test_raking_meets_the_marginals(spark):
    rng = random.Random(0)
    cells = spark.createDataFrame([(s, l, t, rng.randint(1, 1000)) for s in "ab" for l in "xyz" for t in range(4)], "source string, lang string, topic int, tokens long")
    targets = {d: mixing.tempered(cells, d, 0.5) for d in mixing.DIMENSIONS}
    out = mixing.rake(cells, targets, tolerance=1e-6).toPandas()
    for d, target in targets.items():
        wanted = target.toPandas().set_index(d).target.sort_index()
        assert np.allclose(out.groupby(d).weight.sum().sort_index(), wanted, rtol=1e-4)


def test_the_sample_meets_the_marginals_beside_a_hot_source(spark):
    rng = random.Random(12)
    kinds = [f"subject{x}" for x in "abcdefghij"]
    rows = []
    for i in range(900):
        source, lang = ("hot" if i % 3 else f"s{rng.randint(0, 4)}"), rng.choice(["en"] * 12 + ["de"] * 3 + ["es"])
        topic = rng.choice(kinds[:2] if source == "hot" else kinds)
        rows.append((i, " ".join([topic] * 3 + ["ab"] * rng.randint(1, 60)), lang, source, 0))
    rows += [(1000 + i, "ab cd", "es", "s0", 0) for i in range(3)]
    cells = mixing.mixed(spark.createDataFrame(rows, DOCS)).groupBy(*mixing.DIMENSIONS).agg(F.sum("tokens").alias("tokens"), F.sum(F.expr("tokens * probability")).alias("sampled")).toPandas()
    total, sampled = cells.tokens.sum(), cells.sampled.sum()
    assert (cells.sampled <= cells.tokens * (1 + 1e-9)).all() and 0.5 * total < sampled <= 0.8 * total
    for d in mixing.DIMENSIONS:
        held = cells.groupby(d).tokens.sum() / total / 0.8
        target = held**0.7 / (held**0.7).sum()
        low, high = 1.0, 100.0  # the factor at which the bounded targets sum to 1
        for _ in range(60):
            low, high = ((low + high) / 2, high) if np.minimum(held, (low + high) / 2 * target).sum() < 1 else (low, (low + high) / 2)
        assert np.allclose(cells.groupby(d).sampled.sum() / sampled, np.minimum(held, high * target), rtol=5e-3), d


def test_mixing_samples_by_the_same_decisions(spark):
    rng = random.Random(4)
    df = table(spark, [words(rng, rng.randint(1, 80)) for _ in range(300)] + [None, "", "a"]).withColumn("tokens", F.lit(1))
    one = mixing.mixed(df).select("doc.doc_id", "probability", "keep").toPandas().set_index("doc_id").sort_index()
    two = mixing.mixed(df.repartition(5)).select("doc.doc_id", "probability", "keep").toPandas().set_index("doc_id").sort_index()
    pd.testing.assert_series_equal(one.keep, two.keep)
    assert one.probability.between(0, 1).all() and 0.6 < one.keep.mean() < 0.95
    assert mixing.mixed(table(spark, [])).count() == 0


def test_near_duplicates_are_dropped_by_row(spark):
    rng = random.Random(13)
    a, b, c, d, e, f = (words(rng, 60) for _ in range(6))
    rows = [(None, a), (None, b), (None, a), (5, c), (5, d), (3, e), (9, e + " end"), (9, f), (20, None), (20, None), (20, ""), (4, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    left = [(r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_near_duplicates(spark, docs, "").collect()]
    wanted = [(None, a), (4, b), (5, c), (5, d), (3, e), (9, f), (20, None), (20, "")]
    assert sorted(map(str, left)) == sorted(map(str, wanted))


def test_pipeline_stages_keep_columns_and_clean_documents(spark):
    rng = random.Random(11)
    texts = [f"{words(rng, 60)}." for _ in range(60)]
    texts[10] = texts[3]
    texts[20] = texts[4] + " password: hunter2hunter2"
    docs = table(spark, texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    left = {r.doc_id: r.text for r in docs.collect()}
    assert 10 not in left and not any("hunter2" in t for t in left.values())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= len(left)
