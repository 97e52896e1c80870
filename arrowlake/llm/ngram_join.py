"""N-gram Jaccard join over a token-group matrix.

Documents with the same shingle set form one class. Classes are partitioned into groups of similar documents
(equal smallest shingle hash, split to a bounded size). The token-group matrix holds, for each token of the
members' prefixes, the groups it occurs in; two groups are candidates only if they share enough of these, since
sets of the wanted similarity must share some of their rarest tokens. For a candidate pair each document's
overlap with the other group's token union bounds its overlap with any member; groups are opened only for
documents that can still qualify, and then compared exactly as blocks. Only a spanning forest of the links
leaves a block, so neither copies nor near copies are expanded into pairs.

Token rarity comes from a table of ``BUCKETS`` counts over all documents: a fixed size at any scale, and any
order that all documents share gives exact results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.materialize import checkpointed, release_shuffles
from .hashing import WordHasher, blocks, mix, raw_texts, shingle_sets

BUCKETS = 1 << 20
SLICES = 16
BITS = 1 << 23
GROUP_DOCS, GROUP_TOKENS = 256, 200_000
NO_ID = -(1 << 63)


def shared_at_least(n):
    """How many prefix tokens a set of ``n`` must share with another to link: one, and one more for every 20 tokens."""
    return n // 20 + 1


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, list[bytes]]:
    """(sizes, 16-byte order-free fingerprint of each set)."""
    sizes = np.array([len(s) for s in sets], np.int64)
    full = sizes > 0
    sums = np.zeros((len(sets), 2), np.uint64)
    if full.any():
        values = np.concatenate([s for s in sets if len(s)])
        at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        sums[full, 0] = np.add.reduceat(mix(values), at)
        sums[full, 1] = np.add.reduceat(mix(values ^ np.uint64(0xA5A5A5A55A5A5A5A)), at)
    return sizes, [x.tobytes() for x in sums]


def _sets_of(batch: pa.RecordBatch, hasher: WordHasher, k: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    data, offsets = raw_texts(batch.column("text"))
    for i, j, part, at in blocks(data, offsets):
        words, _, _, first = hasher.words(part, at)
        yield i, j, shingle_sets(words, first, k)


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts = WordHasher(), np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for i, j, sets in _sets_of(batch, hasher, k):
                sizes, prints = fingerprints(sets)
                counts += np.bincount((np.concatenate(sets) & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS).astype(np.uint32)
                low = np.array([s[0] if len(s) else 0 for s in sets], np.uint64).view(np.int64)
                m = j - i
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, m), batch.column("key").slice(i, m), pa.array(sizes), pa.array(prints, pa.binary()), pa.array(low), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
                    names=["doc_id", "key", "n", "fp", "low", "slice", "counts"],
                )
        if counts.any():
            packed = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, SLICES)]
            none = [pa.nulls(SLICES, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(SLICES), pa.int32()), pa.array(packed, pa.binary())], names=["doc_id", "key", "n", "fp", "low", "slice", "counts"])

    return run


def _add_counts(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BUCKETS // SLICES, np.int64)
    for x in rows.counts:
        total += np.frombuffer(zlib.decompress(x), np.uint32)
    return pd.DataFrame({"slice": [rows.slice.iloc[0]], "counts": [np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()]})


def _prefixes(k: int, percent: int, rarity):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, count = WordHasher(), np.frombuffer(rarity.value, np.uint32)
        for batch in batches:
            for i, j, sets in _sets_of(batch, hasher, k):
                _, prints = fingerprints(sets)
                out = []
                for s in sets:
                    n = len(s)
                    order = np.argsort(count[(s & np.uint64(BUCKETS - 1)).astype(np.int64)], kind="stable")
                    out.append(s[order[: n + (-percent * n // 100) + shared_at_least(n) if n else 0]].view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)), pa.array(np.concatenate(out)))
                own = (batch.column(c).slice(i, j - i) for c in ("rep", "key"))
                yield pa.RecordBatch.from_arrays([*own, pa.array(prints, pa.binary()), lists], names=["rep", "key", "fp", "tokens"])

    return run


def token_slots(tokens: np.ndarray) -> np.ndarray:
    """Bit of each token in a table of ``BITS`` bits."""
    return (tokens.view(np.uint64) >> np.uint64(20)) & np.uint64(BITS - 1)


def _bit_table(tokens: DataFrame) -> bytes:
    """A table of ``BITS`` bits with those of all tokens set: one megabyte at any scale."""
    slots = tokens.select(F.expr(f"shiftrightunsigned(token, 20) & {BITS - 1}").alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    table = np.zeros(BITS // 64, np.int64)
    for word, bits in words.toLocalIterator():  # at most BITS / 64 rows
        table[word] = bits
    return table.tobytes()


def _marked_rows(bitmap):
    """Texts whose row's bit is set, so that only these are shuffled; other rows that share the bit fall out in the join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(bitmap.value, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            keep = pa.array(np.flatnonzero(bits[token_slots(batch.column("h").to_numpy()).astype(np.int64)]))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in ("rep", "key", "text")], names=["rep", "key", "text"])

    return run


def _marked_tokens(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(bitmap.value, np.uint8), bitorder="little").view(bool)
        for batch in batches:
            column = batch.column("tokens")
            tokens = column.flatten().to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
            keep = np.flatnonzero(bits[token_slots(tokens).astype(np.int64)])
            at = pa.array(rows[keep])
            yield pa.RecordBatch.from_arrays([pa.array(tokens[keep]), batch.column("g").take(at), batch.column("n").take(at)], names=["token", "g", "n"])

    return run


def _asked_sets(k: int):
    """The set of each asked document: once for its own group, and as a query for each group it may link with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            wanted, own, targets = (batch.column(c).to_pylist() for c in ("fp", "g", "targets"))
            for i, j, sets in _sets_of(batch, hasher, k):
                _, prints = fingerprints(sets)
                rows = []
                for r, (s, fp) in enumerate(zip(sets, prints, strict=True), i):
                    if fp == wanted[r]:
                        tokens = s.tobytes()
                        rows.append((own[r], False, fp, tokens))
                        rows += [(g, True, fp, tokens) for g in targets[r] or []]
                        if len(rows) > 512:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    kinds = pa.int64(), pa.bool_(), pa.binary(), pa.binary()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["g", "asks", "fp", "tokens"])


def _qualify(sets: list[np.ndarray], sizes: np.ndarray, others: np.ndarray, union: np.ndarray, percent: int) -> np.ndarray:
    """Rows whose overlap with the other group's token union allows a link with some member."""
    flat = np.concatenate(sets)
    hit = np.isin(flat, union)
    overlap = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    least = np.maximum(-(-percent * sizes // 100), others.min())
    return np.flatnonzero((overlap * (100 + percent) >= percent * (sizes + least)) & (others.max() * 100 >= percent * sizes))


def links_between(a: list[np.ndarray], b: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Links (row of a, row of b) of two groups, or within one, thinned to a forest that joins the same documents."""
    other = a if b is None else b
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in other])
    ub = np.unique(np.concatenate(other))
    rows = _qualify(a, na, nb, ub, percent)
    if not len(rows):
        return []
    ua = np.unique(np.concatenate([a[i] for i in rows]))
    cols = rows if b is None else _qualify(other, nb, na[rows], ua, percent)
    if not len(cols):
        return []
    common = np.intersect1d(ua, ub, assume_unique=True)
    inter = np.zeros((len(rows), len(cols)), np.float32)
    for lo in range(0, len(common), 1 << 13):
        part = common[lo : lo + (1 << 13)]
        left, right = (np.zeros((len(x), len(part)), np.float32) for x in (rows, cols))
        for m, group, picked in ((left, a, rows), (right, other, cols)):
            for r, i in enumerate(picked):
                m[r, np.searchsorted(part, np.intersect1d(group[i], part, assume_unique=True))] = 1
        inter += left @ right.T
    inter = inter.astype(np.int64)
    linked = inter * 100 >= percent * (na[rows][:, None] + nb[cols][None, :] - inter)
    if b is None:
        linked = np.triu(linked, 1)
    parent = list(range(len(a) + len(other)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in np.argwhere(linked):
        u, v = int(rows[i]), int(cols[j])
        x, y = root(u), root(v if b is None else len(a) + v)
        if x != y:
            parent[x] = y
            out.append((u, v))
    return out


def _open(percent: int):
    """Links within each group, and from its queries to it; rows come by group, members before queries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, members, queries, size, closed = None, [], [], 0, False

        def found(a: list, b: list | None) -> pd.DataFrame:
            links = links_between([s for _, s in a], None if b is None else [s for _, s in b], percent)
            ends = a if b is None else b
            return pd.DataFrame({"u": [a[i][0] for i, _ in links], "v": [ends[j][0] for _, j in links]})

        for rows in batches:
            for g, asks, fp, tokens in zip(rows.g, rows.asks, rows.fp, rows.tokens, strict=True):
                if g != group or size > GROUP_TOKENS:
                    if queries and members:
                        yield found(queries, members)
                    queries, size = [], 0
                if (g != group or asks) and not closed:
                    if len(members) > 1:
                        yield found(members, None)
                    closed = True
                if g != group:
                    group, members, closed = g, [], False
                    if asks:
                        closed = True
                (queries if asks else members).append((fp, np.frombuffer(tokens, np.uint64)))
                size += len(tokens) // 8 if asks else 0
        if not closed and len(members) > 1:
            yield found(members, None)
        if queries and members:
            yield found(queries, members)

    return run


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row: components of documents whose k-word shingle sets have a
    Jaccard similarity of at least ``percent`` per cent; ``component_id`` is the smallest id in the component.

    Cases: a text of fewer than ``k`` words is one shingle; a null or wordless text has none and links with
    nothing (its own id is its component); rows repeating an id or a text each get a row; a null id is
    reported as it came, with the smallest non-null id of its component; extra columns are ignored; an empty table
    gives an empty result. Links are exact, up to equal 64-bit hashes of different shingles.
    """
    return jaccard_rows(docs, k, percent, id_col, text_col).select("doc_id", "n_shingles", "component_id")


def jaccard_rows(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``jaccard_components`` with what tells rows and components apart where ids are null or repeated: ``key`` is the
    row's ``xxhash64`` of the text, ``component`` the component itself (null where a row has no shingles)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = checkpointed(texts.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(_signatures(k), "doc_id long, key long, n long, fp binary, low long, slice int, counts binary"))
    rows = signed.where("slice IS NULL").select("doc_id", "key", "n", "fp", "low")
    slices = signed.where("slice IS NOT NULL").select("slice", "counts").groupBy("slice").applyInPandas(_add_counts, "slice int, counts binary").collect()
    rarity = spark.sparkContext.broadcast(b"".join(bytes(x.counts) for x in sorted(slices)) or bytes(4 * BUCKETS))

    # a class is represented by its row of smallest id and text hash, so that neither null nor repeated ids are join keys
    own = F.coalesce("doc_id", F.lit(NO_ID)).alias("rep")
    classes = rows.where((F.col("n") > 0)).groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(F.struct(own, "key")).alias("rep"), F.min("n").alias("n"), F.min("low").alias("low"))
    classes = classes.select("fp", "least", "rep.rep", "rep.key", "n", "low")
    able = classes.where(F.col("n") * 100 >= (F.col("n") + 1) * percent)  # smaller sets only link with equal ones
    parts = able.groupBy("low").agg(F.greatest(F.ceil(F.count("*") / GROUP_DOCS), F.ceil(F.sum("n") / GROUP_TOKENS)).alias("parts"))
    nodes = able.join(parts, "low").select("fp", "rep", "key", "n", F.xxhash64("low", F.pmod(F.xxhash64("fp"), "parts")).alias("g"))
    nodes = checkpointed(nodes)

    keyed = texts.select(own, F.xxhash64("text").alias("key"), "text")
    prefixes = keyed.mapInArrow(_prefixes(k, percent, rarity), "rep long, key long, fp binary, tokens array<long>")
    prefixes = prefixes.groupBy("fp", "rep", "key").agg(F.first("tokens").alias("tokens"))  # equal rows meet once
    prefixes = prefixes.join(nodes, ["fp", "rep", "key"]).select("g", "n", "tokens")
    prefixes = checkpointed(prefixes)
    shared = prefixes.select("g", F.explode("tokens").alias("token")).groupBy("token").agg(F.min("g").alias("a"), F.max("g").alias("z"))
    shared = checkpointed(shared.where("a < z").select("token"))
    bitmap = spark.sparkContext.broadcast(_bit_table(shared))
    matrix = prefixes.mapInArrow(_marked_tokens(bitmap), "token long, g long, n long").join(shared, "token", "left_semi")
    matrix = checkpointed(matrix.groupBy("token", "g").agg(F.min("n").alias("least"), F.max("n").alias("most")))
    a, b = matrix.alias("a"), matrix.alias("b")
    fits = (F.col("a.most") * 100 >= F.col("b.least") * percent) & (F.col("b.most") * 100 >= F.col("a.least") * percent)
    pairs = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.g") < F.col("b.g")) & fits)
    pairs = pairs.groupBy(F.col("a.g").alias("ga"), F.col("b.g").alias("gb")).agg(F.count("*").alias("c"), F.min(F.least("a.least", "b.least")).alias("least"))
    pairs = pairs.where(F.col("c") >= F.floor(F.col("least") / 20) + 1).select("ga", "gb")
    weight = nodes.groupBy("g").agg(F.sum("n").alias("w"))
    pairs = pairs.join(weight.toDF("ga", "wa"), "ga").join(weight.toDF("gb", "wb"), "gb")
    lighter = F.col("wa") <= F.col("wb")  # the group that travels
    pairs = checkpointed(pairs.select(F.when(lighter, F.col("ga")).otherwise(F.col("gb")).alias("ga"), F.when(lighter, F.col("gb")).otherwise(F.col("ga")).alias("gb")))

    several = nodes.groupBy("g").agg(F.count("*").alias("c")).where("c > 1").select("g")
    wanted = pairs.select(F.col("ga").alias("g")).union(pairs.select("gb")).union(several).distinct()
    targets = pairs.groupBy(F.col("ga").alias("g")).agg(F.collect_list("gb").alias("targets"))
    asked = checkpointed(nodes.join(wanted, "g", "left_semi").join(targets, "g", "left").select("rep", "key", "fp", "g", "targets"))
    marked = spark.sparkContext.broadcast(_bit_table(asked.select(F.xxhash64("rep", "key").alias("token"))))
    opened = keyed.select("rep", "key", F.xxhash64("rep", "key").alias("h"), "text").mapInArrow(_marked_rows(marked), "rep long, key long, text string")
    opened = opened.groupBy("rep", "key").agg(F.first("text").alias("text")).join(asked, ["rep", "key"]).select("text", "fp", "g", "targets").mapInArrow(_asked_sets(k), "g long, asks boolean, fp binary, tokens binary")
    edges = opened.repartition("g").sortWithinPartitions("g", "asks").mapInPandas(_open(percent), "u binary, v binary")
    edges = checkpointed(edges)
    del prefixes, matrix, shared, asked, opened
    release_shuffles(spark)

    labels = connected_components(edges).withColumnRenamed("node", "fp")
    named = classes.select("fp", "least").join(labels, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = named.join(names, "component").select("fp", "component", "component_id")
    out = rows.join(ids, "fp", "left")
    component = F.when(F.col("n") > 0, F.col("component")).alias("component")
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), component, F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under 4-word shingles and a similarity of 0.85."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + 3], ' ') FOR i IN range(1, len(words) - 2)]) END AS sh FROM w
), n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
t AS (SELECT doc_id, unnest(sh) AS tok FROM s),
x AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM t a JOIN t b ON a.tok = b.tok AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM x JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n_shingles + b.n_shingles - c)),
r(u, v) AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT n.doc_id, n.n_shingles, least(n.doc_id, coalesce(min(r.v), n.doc_id)) AS component_id
FROM n LEFT JOIN r ON r.u = n.doc_id GROUP BY n.doc_id, n.n_shingles
"""
