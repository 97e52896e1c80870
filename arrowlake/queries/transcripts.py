"""Transcript parsing queries."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import transcripts as t
from ..registry import query


@query("h1_parse_arrow_answer", "fx_transcripts", sql="SELECT graph_id, arrow_id, src AS source, dst AS target, nullif(rel, 'connectedTo') AS condition FROM {fx_edges}")
def arrows(x: DataFrame) -> DataFrame:
    return x.select("graph_id", "arrow_id", F.explode(t.parse_arrow_answer(F.col("output"))).alias("a")).select("graph_id", "arrow_id", "a.*")


@query(
    "h2_parse_hier_answer",
    "fx_transcripts",
    sql="""SELECT graph_id, arrow_id, src AS source_node, 'None' AS source_location, dst AS target_node, 'None' AS target_location,
  CASE rel WHEN 'connectedTo' THEN 'None' ELSE rel END AS condition FROM {fx_edges}""",
)
def hierarchical(x: DataFrame) -> DataFrame:
    return x.select("graph_id", "arrow_id", t.parse_hier_answer(F.col("output")).alias("a")).select("graph_id", "arrow_id", "a.*")


@query(
    "h3_split_k_blocks",
    "fx_transcripts",
    sql="""SELECT graph_id, i AS block, CASE WHEN arrow_id IS NULL THEN '' ELSE concat('source_node: ', src, chr(10), 'target_node: ', dst, chr(10),
  'condition: ', CASE rel WHEN 'connectedTo' THEN 'None' ELSE rel END) END AS text
FROM (SELECT DISTINCT graph_id FROM {fx_edges}) g, (VALUES (1), (2), (3), (4)) k(i) LEFT JOIN {fx_edges} e ON e.graph_id = g.graph_id AND e.arrow_id = i""".replace("SELECT graph_id, i", "SELECT g.graph_id, i"),
)
def blocks(x: DataFrame) -> DataFrame:
    body = F.regexp_replace("output", "<think>look</think>", "")
    block = F.concat(F.lit("arrow_"), F.col("arrow_id").cast("string"), F.lit(":\n"), body)
    one = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("arrow_id", block.alias("b")))), lambda s: s.b), "\n\n")
    whole = x.groupBy("graph_id").agg(one.alias("output"))
    cut = whole.select("graph_id", F.posexplode(t.split_k_blocks(F.col("output"), 4)).alias("p", "text"))
    return cut.select("graph_id", (F.col("p") + 1).alias("block"), "text")


@query("h4_extract_triplets", "fx_edges", sql="SELECT graph_id, arrow_id, src, rel, dst FROM {fx_edges}")
def free_text(e: DataFrame) -> DataFrame:
    said = F.concat(F.lit("I see < "), "src", F.lit(", "), "rel", F.lit(" , "), "dst", F.lit("> and <, none, >."))
    return e.select("graph_id", "arrow_id", F.explode(t.extract_triplets(said)).alias("t")).select("graph_id", "arrow_id", "t.*")


@query("h5_parse_tool_calls", "fx_edges", sql="SELECT graph_id, arrow_id, 'find_node' AS name, dst AS asked, 'ok' AS rest FROM {fx_edges}")
def calls(e: DataFrame) -> DataFrame:
    body = F.to_json(F.struct(F.lit("find_node").alias("name"), F.struct(F.col("dst").alias("query")).alias("arguments")))
    said = F.concat(F.lit("ok <tool_call>"), body, F.lit("</tool_call><tool_call>{bad</tool_call>"))
    rows = e.select("graph_id", "arrow_id", F.explode(t.parse_tool_calls(said)).alias("c"), t.strip_tool_calls(said).alias("rest"))
    return rows.select("graph_id", "arrow_id", "c.name", F.get_json_object("c.arguments", "$.query").alias("asked"), "rest")


@query(
    "h6_parse_yes_no",
    "fx_qa",
    sql="""SELECT image_id, question_no, CASE WHEN lower(predicted) LIKE 'yes%' THEN 'yes' WHEN predicted = 'no' THEN 'no' END AS answer FROM {fx_qa}""",
)
def yes_no(q: DataFrame) -> DataFrame:
    return q.select("image_id", "question_no", t.parse_yes_no(F.col("predicted")).alias("answer"))


@query("h7_parse_int", "fx_qa", sql="SELECT image_id, question_no, TRY_CAST(nullif(regexp_extract(predicted, '-?[0-9]+'), '') AS BIGINT) AS number FROM {fx_qa}")
def numbers(q: DataFrame) -> DataFrame:
    return q.select("image_id", "question_no", t.parse_int(F.col("predicted")).alias("number"))


@query(
    "h8_gold_labels",
    "fx_qa",
    sql="""SELECT image_id, question_no, CASE WHEN question_no % 3 = 0 THEN concat(gt, '|', sub_task) WHEN question_no % 3 = 1 THEN sub_task ELSE gt END AS labels FROM {fx_qa}""",
)
def labels(q: DataFrame) -> DataFrame:
    at = F.col("question_no") % 3
    answers = [F.when(at == 0, F.col("gt")), F.when(at == 0, F.lit("")), F.when(at == 0, F.col("sub_task"))]
    gold = t.gold_labels(answers, F.when(at == 1, F.col("sub_task")).otherwise(""), F.col("gt"))
    return q.select("image_id", "question_no", F.array_join(gold, "|").alias("labels"))


@query(
    "h9_rewards",
    "fx_transcripts",
    sql="""SELECT graph_id, arrow_id, CASE WHEN arrow_id % 2 = 0 THEN 1::DOUBLE ELSE 0::DOUBLE END AS format, CASE WHEN arrow_id % 3 = 0 THEN 1::DOUBLE ELSE 0::DOUBLE END AS text FROM {fx_edges}""",
)
def rewards(x: DataFrame) -> DataFrame:
    answer = F.when(F.col("arrow_id") % 3 == 0, "Yes ").otherwise("no")
    said = F.when(F.col("arrow_id") % 2 == 0, F.concat(F.lit("<think>look</think>\n<answer>"), answer, F.lit("</answer>"))).otherwise(answer)
    return x.select("graph_id", "arrow_id", t.format_reward(said).alias("format"), t.text_reward(said, F.lit("yes")).alias("text"))
