"""Label repair queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import repair as r
from ..registry import query


@query(
    "f3_snap_to_vocab",
    "fx_pred",
    "fx_vocab",
    sql="""WITH q AS (SELECT DISTINCT graph_id, dst AS text FROM {fx_pred}),
c AS (SELECT q.graph_id, text, word, levenshtein(lower(text), lower(word)) AS dist FROM q JOIN {fx_vocab} v USING (graph_id)),
b AS (SELECT graph_id, text, arg_min(word, (dist, word)) AS word, min(dist) AS dist, list_sort(list(dist)) AS l FROM c WHERE dist <= 2 GROUP BY ALL)
SELECT p.graph_id, p.arrow_id, p.dst AS text, CASE WHEN b.dist > 0 AND (len(l) = 1 OR l[2] > l[1]) THEN b.word ELSE p.dst END AS snapped FROM {fx_pred} p LEFT JOIN b ON b.graph_id = p.graph_id AND b.text = p.dst""",
)
def snapped(p: DataFrame, v: DataFrame) -> DataFrame:
    return r.snap_to_vocab(p.select("graph_id", "arrow_id", F.col("dst").alias("text")), v)


@query(
    "f5_garbled_flag",
    "fx_pred",
    "fx_edges",
    sql="""WITH w AS (SELECT unnest(regexp_extract_all(lower(dst), '[a-z]{3,}')) AS word FROM {fx_edges}), f AS (SELECT word, count(*)::DOUBLE / (SELECT count(*) FROM w) AS freq FROM w GROUP BY word),
t AS (SELECT graph_id, arrow_id, unnest(regexp_extract_all(lower(dst), '[a-z]{3,}')) AS word FROM {fx_pred}),
g AS (SELECT graph_id, arrow_id, bool_or(coalesce(freq, 0) < 0.0001::DOUBLE) AS garbled FROM t LEFT JOIN f USING (word) GROUP BY ALL)
SELECT graph_id, arrow_id, coalesce(garbled, false) AS garbled FROM {fx_pred} LEFT JOIN g USING (graph_id, arrow_id)""",
)
def garbled(p: DataFrame, e: DataFrame) -> DataFrame:
    return r.garbled_flag(p, r.word_frequencies(e, "dst"), ["graph_id", "arrow_id"], "dst", 0.0001)


@query(
    "f6_vocab_union",
    "fx_edges",
    "fx_pred",
    sql="""SELECT DISTINCT graph_id, trim(word) AS word FROM (SELECT graph_id, dst || ' ' AS word, (partkey % 10) / 10.0::DOUBLE AS score FROM {fx_edges} UNION ALL SELECT graph_id, src, 0.5 FROM {fx_pred}) t WHERE score >= 0.5::DOUBLE AND trim(word) <> ''""",
)
def vocabulary(e: DataFrame, p: DataFrame) -> DataFrame:
    one = e.select("graph_id", F.concat("dst", F.lit(" ")).alias("word"), (F.col("partkey") % 10 / 10).alias("score"))
    return r.vocab_union([one, p.select("graph_id", F.col("src").alias("word"), F.lit(0.5).alias("score"))], 0.5)


@query(
    "f7_correction_stats",
    "fx_pred",
    "fx_edges",
    sql="""WITH p AS (SELECT p.graph_id, (p.src <> e.src)::BIGINT + (p.dst <> e.dst)::BIGINT AS c FROM {fx_pred} p JOIN {fx_edges} e USING (graph_id, arrow_id)),
i AS (SELECT graph_id, count(*) AS n, sum(c)::BIGINT AS c FROM p GROUP BY ALL), v AS (SELECT DISTINCT graph_id FROM {fx_edges} WHERE partkey % 5 = 0)
SELECT count(*) AS images, count(*) FILTER (c > 0) AS corrected, count(*) FILTER (graph_id NOT IN (SELECT graph_id FROM v)) AS no_vocab, sum(n)::BIGINT AS triplets, sum(c)::BIGINT AS fields_changed FROM i""",
)
def stats(p: DataFrame, e: DataFrame) -> DataFrame:
    after = e.join(p.select("graph_id", "arrow_id"), ["graph_id", "arrow_id"], "left_semi")
    return r.correction_stats(p, after, e.where("partkey % 5 = 0"), ["graph_id", "arrow_id"], ["src", "dst"])


@query(
    "f8_score_delta",
    "fx_pred",
    "fx_edges",
    sql="""WITH d AS (SELECT e.graph_id % 7 AS dataset, count(*) FILTER (p.dst = e.dst) AS h, count(*) FILTER (p.dst = e.dst OR p.dst LIKE '%x') AS h2, count(p.dst) AS p, count(*) AS g FROM {fx_edges} e LEFT JOIN {fx_pred} p USING (graph_id, arrow_id) GROUP BY ALL)
SELECT dataset, 2.0::DOUBLE * h / (p + g) AS before, 2.0::DOUBLE * h2 / (p + g) AS after, 2.0::DOUBLE * h2 / (p + g) - 2.0::DOUBLE * h / (p + g) AS delta FROM d""",
)
def delta(p: DataFrame, e: DataFrame) -> DataFrame:
    both = e.alias("e").join(p.alias("p"), ["graph_id", "arrow_id"], "left").select((F.col("graph_id") % 7).alias("dataset"), F.col("e.dst").alias("gold"), F.col("p.dst").alias("guess"))
    hit = F.col("guess") == F.col("gold")
    n = both.groupBy("dataset").agg(F.count_if(hit).alias("h"), F.count_if(hit | F.col("guess").endswith("x")).alias("h2"), F.count("guess").alias("p"), F.count("*").alias("g"))
    return r.score_delta(n.select("dataset", r.f1_of("h", "p", "g").alias("f1")), n.select("dataset", r.f1_of("h2", "p", "g").alias("f1")))
