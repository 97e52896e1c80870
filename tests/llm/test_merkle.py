"""The Merkle manifest against a recursive recomputation, and on odd tables."""

import hashlib
import random
import zlib

import duckdb
import pytest

from arrowlake.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string, root string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def build(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        levels.append(nodes)
    return levels


def climb(levels, i, now):
    passed = []
    for level in levels[:-1]:
        run = list(level[i // 8 * 8 : i // 8 * 8 + 8])
        passed += run[: i % 8] + run[i % 8 + 1 :]
        run[i % 8] = now
        now, i = h("".join(run)), i // 8
    return passed, now


def expected(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    trees = {}
    for doc, source, lang, n, text, *_ in rows:
        head = "".join(map(framed, (doc, source, lang, n)))
        other = text.translate(low) if text is not None and doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0 else text
        trees.setdefault(lang, []).append((doc is not None, doc or 0, h(head + framed(text)), h(head + framed(other)), doc))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    levels = {lang: build([x[2] for x in sorted(trees[lang], key=lambda x: x[:3])]) for lang in langs}
    top = build([levels[lang][-1][0] for lang in langs])
    out = []
    for g, lang in enumerate(langs):
        for i, (_, _, leaf, other, doc) in enumerate(sorted(trees[lang], key=lambda x: x[:3])):
            low_part, now = climb(levels[lang], i, other)
            high_part, now = climb(top, g, now)
            out.append((doc, leaf, levels[lang][-1][0], top[-1][0], h("".join(low_part + high_part)), now, now == top[-1][0]))
    return sorted(out, key=repr)


def manifest(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCS).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return sorted(map(tuple, merkle.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=repr)


@pytest.mark.parametrize("n,langs", [(1, 1), (8, 1), (9, 1), (65, 1), (300, 3), (40, 20)])
def test_against_recomputation(spark, tmp_path, n, langs):
    rng = random.Random(n)
    rows = [(i * 3, rng.choice(["a", None]), None if i % langs == 0 else f"l{i % langs}", rng.choice([7, None]), rng.choice(["Ab Ç", None, "", "X" * 40]), "clash") for i in range(n)]
    assert manifest(spark, tmp_path, rows) == expected(rows)


def test_repeated_and_null_ids(spark, tmp_path):
    rows = [(i % 4 or None, "s", "en", 1, "T" * (i % 3), "clash") for i in range(50)]
    assert manifest(spark, tmp_path, rows) == expected(rows)


def test_long_text_and_hot_language(spark, tmp_path):
    rows = [(i, "s", "en" if i % 20 else "", 1, f"Text {i}", "clash") for i in range(1500)] + [(9999, "s", "de", 1, "Wort " * 2_000_000, "clash")]
    assert manifest(spark, tmp_path, rows) == expected(rows)


def test_empty_table(spark, tmp_path):
    assert manifest(spark, tmp_path, []) == []


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    assert sorted(map(tuple, merkle.op12_merkle_manifest(spark, "/root/testdata/sf0.001").collect())) == sorted(con.execute(merkle.OP12_SQL).fetchall())
