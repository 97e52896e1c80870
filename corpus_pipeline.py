"""A corpus pipeline over ``documents``: each stage's output is written as Parquet and reread as the next one's input.

The quality classifier drops what it rejects, the Jaccard join keeps one document of each near-duplicate group
(five-word shingles, similarity 0.8), the secret scan redacts what it reports, mixing keeps the sampled documents,
and packing lays the rest out in training sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrowlake.llm.mixing import mixed
from arrowlake.llm.ngram_join import jaccard_rows
from arrowlake.llm.packing import pack_documents
from arrowlake.llm.quality import scored
from arrowlake.llm.secret_scan import redact
from arrowlake.plans.materialize import shared_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; null, empty and wordless texts go. Repeated rows fare alike, no
    column can clash, and an empty table gives an empty one."""
    return scored(docs).where("quality_keep").select("doc.*")


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest id (then of smallest text hash; null ids come last) of each near-duplicate group, and every
    wordless row; rows equal in id and text count once."""
    parts = jaccard_rows(docs, k=5, percent=80)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")).alias("first")
    chosen = parts.where("n_shingles > 0").groupBy("component").agg(first).select("first.doc_id", "first.key")
    chosen = chosen.union(parts.where("n_shingles = 0").select("doc_id", "key")).distinct()
    keyed = docs.withColumn("text key", F.xxhash64("text"))
    same = keyed["doc_id"].eqNullSafe(chosen["doc_id"]) & (keyed["text key"] == chosen["key"])
    return keyed.join(chosen, same, "left_semi").dropDuplicates(["doc_id", "text key"]).drop("text key")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark; null and empty texts and all other columns stay."""
    return redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to the target weights of sources, languages and topics; a null source or language is a value of
    its own, wordless texts cost nothing and stay, repeated rows fare alike, and an empty table gives an empty one."""
    return mixed(docs).where("keep").select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all remaining documents in sequences of at most 2048 tokens; a null or empty text is its end mark alone,
    null and repeated ids are packed as they come, and an empty table gives no pieces."""
    return pack_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Trained and sampled stages can't be written in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from ``documents`` of ``sf_dir``."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
