"""Exact top-k search by tiled matrix products.

Queries and candidates are dealt to blocks; each (query block, candidate shard) pair is one tile. A tile is
one matrix product, from which every query keeps its k best rows; the short lists are then merged in a tree:
first within a group of shards, then over all groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LONG_MAX, LONG_MIN = (1 << 63) - 1, -(1 << 63)
PAIR_SCHEMA = "query_id long, query_row long, candidate_id long, score long, shard long"
LARGEST = 1.7976931348623157e308


def scaled_components(vector: Column, scale: int = 64) -> Column:
    """``floor(scale * x)`` of every component as double, null for vectors that take no part."""
    usable = vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))

    def scaled(x: Column) -> Column:
        y = F.greatest(F.least(F.lit(scale) * x.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
        return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)  # beyond, every double is whole

    return F.when(usable, F.transform(vector, scaled))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > kth)
        level = np.flatnonzero(scores == kth)
        level = level[np.argsort(ids[level], kind="stable")[: k - len(above)]]
        keep = np.concatenate([above, level])
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))]


def _tile(k: int, rows: int):
    names = ["query_id", "query_row", "candidate_id", "score", "shard"]

    def tile(key: tuple, queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(candidates):
            width = max(1, queries.v.map(len).max(), candidates.cv.map(len).max())
            q, c = _matrix(queries.v, width), _matrix(candidates.cv, width)
            qid, qrow, cid, crow = (x.to_numpy() for x in (queries.id, queries.row, candidates.cid, candidates.crow))
            exact = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * width < 2.0**53
            if not exact:  # beyond doubles' integers: Python's own integers
                q, c = (np.array([[int(x) for x in row] for row in m], dtype=object) for m in (q, c))
            for i in range(0, len(q), rows):
                scores = q[i : i + rows] @ c.T
                if not exact:
                    scores = np.array([[min(max(x, LONG_MIN), LONG_MAX) for x in row] for row in scores], dtype=object)
                for j, row in enumerate(scores.astype(np.int64), i):
                    other = np.flatnonzero(crow != qrow[j])
                    best = other[_best(row[other], cid[other], k)]
                    out.append((np.full(len(best), qid[j]), np.full(len(best), qrow[j]), cid[best], row[best], np.full(len(best), key[1])))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
        return pd.DataFrame(dict(zip(names, columns, strict=True)))

    return tile


def top_k_search(
    vectors: DataFrame,
    queries: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    scale: int = 64,
    query_block: int = 32768,
    shard_rows: int = 65536,
    merge_fan_in: int = 32,
) -> DataFrame:
    """The ``k`` candidates of highest integer inner product for every query row: ``(query_id, rank, candidate_id, score,
    query_row)``.

    ``queries`` is a predicate on ``vectors`` naming the query rows; candidates are all rows but the query's own.
    Vectors become ``floor(scale * x)``. Ties go to the smaller id; ``rank`` runs from 1; a query with fewer
    candidates returns all. Cases: rows with a null id, or a null or non-finite vector, take no part; a shorter
    vector, and so an empty one, counts as padded with zeros; rows repeating an id are candidates and queries of their
    own, told apart by ``query_row``, and candidates of each other; scores outside a long saturate. Extra columns are
    ignored. An empty table gives an empty result.

    A tile holds at most ``query_block`` queries and ``shard_rows`` candidates on average, whatever the table's
    size, and rows are dealt by a hash of id and row position, so no key can fill a tile. Each query travels once a
    shard and each candidate once a query block, so both are as large as a task can hold.
    """
    row = F.monotonically_increasing_id().alias("row")  # fixed, as both sides read the same splits of the same table
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), scaled_components(F.col(vector_col), scale).alias("v"), queries.alias("asks"), row)
    rows = rows.where("id IS NOT NULL AND v IS NOT NULL").withColumn("deal", F.xxhash64("id", "row"))
    counts = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks, shards = max(1, -(-counts.q // query_block)), max(1, -(-counts.n // shard_rows), min(cores, counts.n // 2048))
    asked = rows.where("asks").withColumn("block", F.pmod("deal", F.lit(blocks)))
    asked = asked.select("id", "row", "v", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))
    # computed anew, as the two sides of a cogroup must not share attributes
    offered = rows.withColumn("shard", F.pmod("deal", F.lit(shards)))
    blocks_of = F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))
    offered = offered.select((F.col("id") + 0).alias("cid"), (F.col("row") + 0).alias("crow"), F.slice("v", 1, F.size("v")).alias("cv"), "shard", F.explode(blocks_of).alias("block"))
    partial = asked.groupBy("block", "shard").cogroup(offered.groupBy("block", "shard")).applyInPandas(_tile(k, 64), PAIR_SCHEMA)
    order = [F.desc("score"), F.asc("candidate_id")]
    while shards > merge_fan_in:  # a level of the tree: lists of a group of shards become one
        shards = -(-shards // merge_fan_in)
        partial = partial.withColumn("shard", F.pmod("shard", F.lit(shards)))
        w = Window.partitionBy("query_id", "query_row", "shard").orderBy(*order)
        partial = partial.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
    w = Window.partitionBy("query_id", "query_row").orderBy(*order)
    ranked = partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "candidate_id", "score", "query_row")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding whose id is divisible by 20 against all others."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found = top_k_search(vectors, F.col("vec_id") % 20 == 0)
    return found.select("query_id", "rank", F.col("candidate_id").alias("vec_id"), "score")


OP1_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CASE WHEN len(q.e) = 0 OR len(c.e) = 0 THEN 0 ELSE CAST(list_inner_product(q.e, c.e) AS BIGINT) END AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s
) t WHERE rank <= 20
"""
