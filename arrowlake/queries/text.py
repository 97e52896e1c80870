"""Normalisation queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import corpus_math_labels, edit_similarity, graph_label, join_multi, keep_valid_triplets, normalize_label, normalize_relation
from ..registry import query


@query(
    "b1_normalize_label",
    "fx_edges",
    sql=r"""SELECT graph_id, arrow_id, lower(trim(src)) AS plain, regexp_replace(lower(src), '[^a-z0-9]', '', 'g') AS alnum,
  CASE WHEN lower(trim(dst)) IN ('o', '0') THEN 'no text' ELSE lower(trim(dst)) END AS marked,
  replace(regexp_replace(lower(replace(dst, '_', ' ')), '[^a-z0-9\s-]', '', 'g'), ' ', '') AS hyphenated FROM {fx_edges}""",
)
def labels(e: DataFrame) -> DataFrame:
    modes = {"plain": ("src", "lower_strip"), "alnum": ("src", "alnum_only"), "marked": ("dst", "fc"), "hyphenated": ("dst", "flowvqa")}
    return e.select("graph_id", "arrow_id", *[normalize_label(F.col(c), m).alias(n) for n, (c, m) in modes.items()])


@query(
    "b2_normalize_relation",
    "fx_edges",
    sql="""SELECT rel, relation, CAST(count(*) AS BIGINT) AS n FROM (SELECT rel,
  CASE WHEN lower(rel) IN ('connected_with', 'connected', 'connectedto', '', 'none') THEN 'connect' ELSE lower(rel) END AS relation FROM {fx_edges}) t GROUP BY ALL""",
)
def relations(e: DataFrame) -> DataFrame:
    return e.groupBy("rel", normalize_relation(F.col("rel")).alias("relation")).agg(F.count("*").alias("n"))


@query(
    "b3_graph_label",
    "fx_edges",
    sql=r"""SELECT graph_id, arrow_id, trim(regexp_replace(regexp_replace(replace(lower(concat(src, ' -- ', dst)), '_', ' '), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS label FROM {fx_edges}""",
)
def graph_labels(e: DataFrame) -> DataFrame:
    return e.select("graph_id", "arrow_id", graph_label(F.concat("src", F.lit(" -- "), "dst")).alias("label"))


@query("b5_join_multi", "fx_edges", sql="SELECT graph_id, string_agg(dst, ' || ' ORDER BY arrow_id) AS joined FROM {fx_edges} GROUP BY graph_id")
def joined(e: DataFrame) -> DataFrame:
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("arrow_id", "dst"))), lambda x: x.dst)
    return e.groupBy("graph_id").agg(ordered.alias("dst")).select("graph_id", join_multi(F.col("dst"), "None").alias("joined"))


@query("b6_keep_valid", "fx_walk", sql="SELECT * FROM {fx_walk} WHERE trim(src) <> '' AND trim(dst) <> '' AND lower(trim(dst)) <> 'pending'")
def valid(w: DataFrame) -> DataFrame:
    return keep_valid_triplets(w)


@query(
    "f1_edit_similarity",
    "fx_edges",
    "fx_pred",
    sql="""SELECT e.graph_id, e.arrow_id, CASE WHEN e.dst = '' AND p.dst = '' THEN 1.0 WHEN e.dst = '' OR p.dst = '' THEN 0.0
  ELSE 1 - CAST(levenshtein(e.dst, p.dst) AS DOUBLE) / greatest(length(e.dst), length(p.dst)) END AS similarity
FROM {fx_edges} e JOIN {fx_pred} p USING (graph_id, arrow_id)""",
)
def similarity(e: DataFrame, p: DataFrame) -> DataFrame:
    both = e.alias("e").join(p.alias("p"), ["graph_id", "arrow_id"])
    return both.select("graph_id", "arrow_id", edit_similarity(F.col("e.dst"), F.col("p.dst")).alias("similarity"))


@query("b4_math_labels", "fx_edges", sql="SELECT graph_id, concat('sqrt(', dst, ') <=q (', src, ')/(2) + alpha_n^', rel) AS label FROM {fx_edges}")
def math_labels(e: DataFrame) -> DataFrame:
    latex = F.concat(F.lit(r"$\sqrt{"), "dst", F.lit(r"} \leq \frac{"), "src", F.lit("}{2}$ \\\\\\\\ + \\alpha_{n}^{"), "rel", F.lit("}"))
    return corpus_math_labels(e.select("graph_id", latex.alias("label")))[0]


@query("b4_math_label_counts", "fx_edges", sql="SELECT graph_id, count(DISTINCT dst) AS labels FROM {fx_edges} GROUP BY graph_id")
def math_label_counts(e: DataFrame) -> DataFrame:
    return corpus_math_labels(e.select("graph_id", F.concat(F.lit(r"$\sqrt{"), "dst", F.lit("}$")).alias("label")))[1]
