"""A Merkle manifest of a table, and proofs that a recursive query climbs.

Rows are leaves. The leaves of a group, in order, form a tree of fan-out eight; the subroots of all groups, in order,
form the top tree. Every level is built by one grouped aggregate, an eighth of the one below, and stored: a node row
names its tree, level and place, its parent's tree, level and place, its digest and its children's digests. A Spark
recursive query then ascends from the leaves by the parent links, appending the siblings it passes and folding each
leaf's hash into the next level's.

Leaves of one run of eight share every sibling above the run, so they climb in one row with a hash each; a row holds at
most 8 hashes and 7 siblings a level.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.materialize import written
from .conversations import CRC, CRC_TABLE

FAN_OUT = 8
DIGEST = 32
#: The top tree's number; groups have numbers from 0.
TOP = -1


def digest(data: Column) -> Column:
    """SHA-256 of a string or of bytes, as 32 bytes."""
    return F.unhex(F.sha2(data, 256))


def in_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def framed(value: Column) -> Column:
    """A value in print: its length in UTF-8 bytes, a colon and itself, or ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return digest(F.concat(*map(framed, values)))


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``idx`` (from 0 by ``order`` within ``group``) and ``n`` (rows of the group).

    Rows are sorted by ranges, so that a group of any size is spread, and a range's rows take their numbers from the
    counts of the ranges before it. Equal rows are numbered in any order.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(n, *group, *order).sortWithinPartitions(*group, *order)
    placed = written(ranged.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))
    parts = placed.groupBy(*group, "part").agg(F.count("*").alias("rows"), F.min("row").alias("first"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        *[F.col(c).alias(f"g{i}") for i, c in enumerate(group)],
        F.col("part").alias("p"),
        (F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("rows").over(Window.partitionBy(*group)).alias("n"),
    )
    same = F.col("part") == F.col("p")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"g{i}"))
    return placed.join(starts, same).withColumn("idx", F.col("row") + F.col("shift")).drop("part", "row", "p", "shift", *[f"g{i}" for i in range(len(group))])


def _levels(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """Node rows of every level above ``nodes`` (``tree, idx, n, digest``), stored level by level."""
    out = []
    for level in range(1, depth + 1):
        run = F.array_sort(F.collect_list(F.struct("idx", "digest")))
        held = nodes.where("n > 1").groupBy("tree", F.expr(f"idx div {FAN_OUT}").alias("idx")).agg(F.first("n").alias("n"), run.alias("run"))
        children = F.aggregate("run", F.lit(b""), lambda a, x: F.concat(a, x["digest"]))
        made = held.select("tree", "idx", F.expr(f"(n + {FAN_OUT - 1}) div {FAN_OUT}").alias("n"), children.alias("children"))
        nodes = written(made.withColumn("digest", digest(in_hex(F.col("children")))).withColumn("level", F.lit(level)))
        out.append(nodes)
    return out


def _depth(most: int) -> int:
    depth = 0
    while most > 1:
        most, depth = -(-most // FAN_OUT), depth + 1
    return depth


@contextmanager
def _any_number_of_rows(spark: SparkSession):
    """Spark stops a recursive query at a million rows unless told that it may go on."""
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


CLIMB = """
WITH RECURSIVE climb(run, leaves, first, ptree, plevel, pidx, place, folded, siblings, subroot, root) AS (
  SELECT run, leaves, first, ptree, plevel, pidx, place, folded, CAST(X'' AS BINARY), subroot, root FROM {start}
  UNION ALL
  SELECT c.run, c.leaves, c.first, n.ptree, n.plevel, n.pidx, n.place,
    transform(c.folded, h -> unhex(sha2(lower(hex(concat(
      substring(n.children, 1, c.place * 32), h, substring(n.children, c.place * 32 + 33)))), 256))),
    concat(c.siblings, substring(n.children, 1, c.place * 32), substring(n.children, c.place * 32 + 33)),
    coalesce(c.subroot, CASE WHEN n.n = 1 THEN n.digest END), n.digest
  FROM climb c JOIN {nodes} n ON n.tree = c.ptree AND n.level = c.plevel AND n.idx = c.pidx
)
SELECT * FROM climb WHERE ptree IS NULL
"""


def manifest(rows: DataFrame, group: str, order: str, leaf: str, tampered: str) -> DataFrame:
    """One row a leaf with its proof: ``rows``' columns, ``subroot, root, siblings, folded_root`` (binary; ``siblings``
    are the 32-byte digests in the order of the proof).

    ``leaf`` and ``tampered`` are columns of digests: trees are built of the first, and the second is folded with the
    first's siblings. Groups come in the order of their value, null first; leaves ascend by ``order`` (null first), ties
    by digest. Cases: repeated rows are a leaf each; a group of one leaf has it as subroot, a table of one group has
    the subroot as root; an empty table gives no rows. No row grows with the table but by the siblings of a level.
    """
    spark = rows.sparkSession
    held = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("kept"), F.col(group).alias("by"), F.col(order).alias("at"), F.col(leaf).alias("digest"), F.col(tampered).alias("other"))
    leaves = numbered(held, ["by"], ["at", "digest"])
    groups = numbered(leaves.where("idx = 0").select(F.lit(0).alias("all"), "by"), ["all"], ["by"])
    groups = written(groups.select(F.col("by").alias("g"), F.col("idx").alias("tree"), F.col("n").alias("trees")))
    leaves = written(leaves.join(groups, F.col("by").eqNullSafe(F.col("g"))).select("kept", "tree", "trees", "idx", "n", "digest", "other"))

    most, trees = leaves.agg(F.max("n"), F.max("trees")).first()
    levels = _levels(leaves.select("tree", "idx", "n", "digest"), _depth(most or 0))
    single = leaves.where("n = 1").select("tree", "digest")
    subroots = single
    for nodes in levels:
        subroots = subroots.unionByName(nodes.where("n = 1").select("tree", "digest"))
    top = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(trees or 0).cast("long").alias("n"), "digest")
    above = _levels(top, _depth(trees or 0))

    empty = leaves.limit(0).select("tree", "idx", "n", F.col("digest").alias("children"), "digest", F.lit(0).alias("level"))
    stored = empty
    for nodes in levels + above:
        stored = stored.unionByName(nodes)
    many = F.lit((trees or 0) > 1)

    def linked(tree: Column, level: Column, idx: Column, n: Column) -> list[Column]:
        """The parent's tree, level and place of a node, and the node's place in its run; nulls for the root."""
        inner, outer = n > 1, (n == 1) & (tree != TOP) & many
        return [
            F.when(inner, tree).when(outer, F.lit(TOP)).cast("long").alias("ptree"),
            F.when(inner, level + 1).when(outer, F.lit(1)).cast("int").alias("plevel"),
            F.when(inner, F.expr(f"idx div {FAN_OUT}")).when(outer, F.expr(f"tree div {FAN_OUT}")).cast("long").alias("pidx"),
            F.when(inner, F.expr(f"idx % {FAN_OUT}")).when(outer, F.expr(f"tree % {FAN_OUT}")).cast("int").alias("place"),
        ]

    nodes = written(stored.select("tree", "level", "idx", "n", "children", "digest", *linked(F.col("tree"), F.col("level"), F.col("idx"), F.col("n"))))

    # the first step up, from the leaves of a run to its node, is taken within the run's row
    item = F.struct("idx", "kept", "digest", "other")
    runs = leaves.groupBy("tree", F.expr(f"idx div {FAN_OUT}").alias("idx"), "n").agg(F.array_sort(F.collect_list(item), lambda a, b: (a["idx"] - b["idx"]).cast("int")).alias("leaves"))
    first = F.aggregate("leaves", F.lit(b""), lambda a, x: F.concat(a, x["digest"]))
    runs = runs.withColumn("first", first)

    def around(i: Column) -> tuple[Column, Column]:
        return F.substring("first", F.lit(1), (i * DIGEST).cast("int")), F.substring("first", (i * DIGEST + DIGEST + 1).cast("int"), F.lit(FAN_OUT * DIGEST))

    def step(x: Column) -> Column:
        before, after = around(x["idx"] % FAN_OUT)
        return digest(in_hex(F.concat(before, x["other"], after)))

    climbed = runs.select(
        F.col("tree"), F.col("idx"), F.expr(f"(n + {FAN_OUT - 1}) div {FAN_OUT}").alias("n"), "leaves", "first", F.col("n").alias("n0"),
        F.when(F.col("n") > 1, F.transform("leaves", step)).otherwise(F.transform("leaves", lambda x: x["other"])).alias("folded"),
        F.when(F.col("n") > 1, digest(in_hex(F.col("first")))).otherwise(F.col("first")).alias("own"),
    )
    start = climbed.select(
        F.struct("tree", "idx").alias("run"), "leaves", "first", *linked(F.col("tree"), F.lit(1), F.col("idx"), F.col("n")), "folded",
        F.when(F.col("n") == 1, F.col("own")).alias("subroot"), F.col("own").alias("root"),
    )
    with _any_number_of_rows(spark):
        proofs = written(spark.sql(CLIMB.format(start="{start}", nodes="{nodes}"), start=start, nodes=nodes))
    each = proofs.select("first", "siblings", "subroot", "root", F.posexplode(F.arrays_zip("leaves", "folded")).alias("place", "leaf"))
    before, after = around(F.col("place"))
    return each.select("leaf.leaves.kept.*", "subroot", "root", F.concat(before, after, "siblings").alias("siblings"), F.col("leaf.folded").alias("folded_root"))


def tampered_text(docs: DataFrame) -> Column:
    """The text, A-Z lower-cased where 3 divides the CRC-32 of the id."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return F.when(hit, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents by language, with a proof of every leaf against tampered texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    slim = docs.select("doc_id", "lang", leaf_digest(*fields, F.col("text")).alias("leaf"), leaf_digest(*fields, tampered_text(docs)).alias("tampered"))
    out = manifest(slim, "lang", "doc_id", "leaf", "tampered")
    return out.select(
        "doc_id", in_hex(F.col("leaf")).alias("leaf"), in_hex(F.col("subroot")).alias("subroot"), in_hex(F.col("root")).alias("root"),
        F.sha2(in_hex(F.col("siblings")), 256).alias("proof_sha256"), in_hex(F.col("folded_root")).alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _framed(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


_FIELDS = " || ".join(map(_framed, ["doc_id", "source", "lang", "n_chars"]))
_STEP = "sha256(array_to_string(f.run[:c.idx % 8], '') || c.h || array_to_string(f.run[c.idx % 8 + 2:], '')), c.proof || array_to_string(f.run[:c.idx % 8], '') || array_to_string(f.run[c.idx % 8 + 2:], '')"
OP12_SQL = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
drawn AS (SELECT *, CASE WHEN {CRC.format("doc_id::VARCHAR")} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other FROM documents, crc),
hashed AS (SELECT doc_id, lang, sha256({_FIELDS} || {_framed("text")}) AS leaf, sha256({_FIELDS} || {_framed("other")}) AS tampered FROM drawn),
leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
nodes AS (
  SELECT tree, 0 AS level, idx, n, leaf AS d FROM leaves
  UNION ALL SELECT tree, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 8, n),
tops AS (
  SELECT 0 AS level, tree AS idx, count(*) OVER () AS n, d FROM nodes WHERE n = 1
  UNION ALL SELECT level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(d, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY level, idx // 8, n),
runs AS (SELECT tree, level, idx // 8 AS p, (any_value(n) + 7) // 8 AS n, list(d ORDER BY idx) AS run FROM nodes WHERE n > 1 GROUP BY tree, level, idx // 8),
top_runs AS (SELECT level, idx // 8 AS p, (any_value(n) + 7) // 8 AS n, list(d ORDER BY idx) AS run FROM tops WHERE n > 1 GROUP BY level, idx // 8),
climb AS (
  SELECT doc_id, leaf, tree, 0 AS level, idx, n, tampered AS h, '' AS proof FROM leaves
  UNION ALL SELECT c.doc_id, c.leaf, c.tree, c.level + 1, c.idx // 8, f.n, {_STEP}
  FROM climb c JOIN runs f ON f.tree = c.tree AND f.level = c.level AND f.p = c.idx // 8),
rest AS (
  SELECT doc_id, leaf, tree, 0 AS level, tree AS idx, (SELECT count(*) FROM nodes WHERE n = 1) AS n, h, proof FROM climb WHERE n = 1
  UNION ALL SELECT c.doc_id, c.leaf, c.tree, c.level + 1, c.idx // 8, f.n, {_STEP}
  FROM rest c JOIN top_runs f ON f.level = c.level AND f.p = c.idx // 8)
SELECT doc_id, leaf, s.d AS subroot, t.d AS root, sha256(proof) AS proof_sha256, h AS folded_root, h = t.d AS verified
FROM rest JOIN (SELECT tree, d FROM nodes WHERE n = 1) s USING (tree), (SELECT d FROM tops WHERE n = 1) t WHERE rest.n = 1
"""
