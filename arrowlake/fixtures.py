"""Derived views that put the operators on the star-schema tables.

Each view is one SQL text for both engines, with ``{name}`` where another table or view is read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "fx_edges": """
SELECT l.l_orderkey AS graph_id,
  CAST(ROW_NUMBER() OVER (PARTITION BY l.l_orderkey ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey,
    l.l_shipdate, l.l_extendedprice, l.l_quantity, l.l_discount, l.l_tax, l.l_returnflag, l.l_linestatus) AS BIGINT) AS arrow_id,
  CONCAT('Supplier_', CAST(l.l_suppkey AS STRING)) AS src,
  CASE l.l_returnflag WHEN 'A' THEN 'Yes' WHEN 'R' THEN 'No' ELSE 'connectedTo' END AS rel,
  CONCAT(p.p_name, ' ', CAST(l.l_partkey AS STRING)) AS dst,
  l.l_partkey AS partkey, l.l_suppkey AS suppkey
FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey""",
    "fx_pred": """
SELECT graph_id, arrow_id, src, rel,
  CASE WHEN suppkey % 13 = 0 THEN CONCAT('wrong ', CAST(partkey AS STRING))
       WHEN suppkey % 7 = 0 THEN CONCAT(SUBSTRING(dst, 1, LENGTH(dst) - 1), 'x')
       ELSE dst END AS dst
FROM {fx_edges} WHERE partkey % 11 <> 0 AND graph_id % 17 <> 0""",
    "fx_walk": """
SELECT graph_id, edge_no, src, cond, dst FROM (
  SELECT user_id AS graph_id,
    CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS edge_no,
    CONCAT(event_type, ' ', CAST(EXTRACT(HOUR FROM ts) AS STRING)) AS src,
    CASE WHEN value > 100 THEN 'high' END AS cond,
    LEAD(CONCAT(event_type, ' ', CAST(EXTRACT(HOUR FROM ts) AS STRING)))
      OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst
  FROM {events}) t WHERE dst IS NOT NULL""",
    "fx_boxes": """
SELECT e.graph_id AS image_id, e.arrow_id AS box_id, CAST(e.partkey % 3 + 1 AS BIGINT) AS category_id,
  CAST(e.partkey % 60 AS DOUBLE) AS x1, CAST(e.suppkey % 40 AS DOUBLE) AS y1,
  CAST(e.partkey % 60 + 10 + e.suppkey % 20 AS DOUBLE) AS x2, CAST(e.suppkey % 40 + 12 AS DOUBLE) AS y2
FROM {fx_edges} e""",
    "fx_dets": """
SELECT image_id, box_id AS det_id, category_id,
  x1 + (box_id % 3) AS x1, y1 + 1 AS y1, x2 + (box_id % 3) AS x2, y2 + 1 AS y2,
  CAST((image_id * 7 + box_id * 3) % 100 AS DOUBLE) / 100 AS score
FROM {fx_boxes} WHERE (image_id + box_id) % 9 <> 0""",
    "fx_track_frames": """
SELECT CAST(user_id % 15 AS BIGINT) AS video_id, user_id AS track_id, CAST(user_id % 3 + 1 AS BIGINT) AS category_id,
  CAST(EXTRACT(DAY FROM ts) AS BIGINT) AS frame,
  CAST(MIN(event_id) % 50 AS DOUBLE) AS x, CAST(MAX(event_id) % 40 AS DOUBLE) AS y,
  CAST(20 + user_id % 10 AS DOUBLE) AS w, CAST(20 AS DOUBLE) AS h
FROM {events} GROUP BY user_id, EXTRACT(DAY FROM ts)""",
    "fx_pred_frames": """
SELECT video_id, track_id + 1000 AS track_id, category_id, frame, x + 2 AS x, y + 1 AS y, w, h,
  CAST(track_id % 10 AS DOUBLE) / 10 AS score
FROM {fx_track_frames} WHERE (frame + track_id) % 9 <> 0""",
    "fx_transcripts": """
SELECT graph_id, arrow_id,
  CONCAT('<think>look</think>source_node: ', src, CHR(10), 'target_node: ', dst, CHR(10), 'condition: ',
    CASE rel WHEN 'connectedTo' THEN 'None' ELSE rel END) AS output
FROM {fx_edges}""",
    "fx_vocab": "SELECT DISTINCT graph_id, dst AS word FROM {fx_edges}",
    "fx_qa": """
SELECT conv_id AS image_id, turn AS question_no,
  CASE turn % 6 WHEN 0 THEN 'Flowchart-isTrue-AtoB' WHEN 1 THEN 'Flowchart-isFalse-AtoB'
    WHEN 2 THEN 'Flowchart-isTrue-betweenAB' WHEN 3 THEN 'Flowchart-isFalse-betweenAB'
    WHEN 4 THEN 'Num_Nodes' ELSE 'Num_Arrows' END AS sub_task,
  CASE WHEN turn % 6 IN (0, 2) THEN 'yes' WHEN turn % 6 IN (1, 3) THEN 'no' ELSE CAST(conv_id % 7 AS STRING) END AS gt,
  CASE WHEN conv_id % 5 = 0 THEN 'unclear' WHEN turn % 6 IN (4, 5) THEN CONCAT('There are ', CAST(conv_id % 6 AS STRING))
    WHEN conv_id % 3 = 0 THEN 'Yes, it does.' ELSE 'no' END AS predicted
FROM {conversations}""",
    "fx_runs": """
SELECT CAST(l_orderkey % 100 AS BIGINT) AS model_id, CAST(l_suppkey % 9 AS BIGINT) AS dataset_id,
  CAST(l_linenumber * 8 AS BIGINT) AS bs, l_partkey AS step, l_tax + l_discount AS eval_loss FROM {lineitem}""",
}
SOURCES_SPARK = """
SELECT graph_id, CONCAT('graph TD', CHR(10), LISTAGG(CONCAT('S', suppkey, '["', src, '"] -->|"', rel, '"| P', partkey, '["', dst, '"]'), CHR(10))
  WITHIN GROUP (ORDER BY arrow_id)) AS text FROM {fx_edges} GROUP BY graph_id"""
SOURCES_DUCKDB = """
SELECT graph_id, CONCAT('graph TD', CHR(10), STRING_AGG(CONCAT('S', suppkey, '["', src, '"] -->|"', rel, '"| P', partkey, '["', dst, '"]'), CHR(10)
  ORDER BY arrow_id)) AS text FROM {fx_edges} GROUP BY graph_id"""

_NAMES = re.compile(r"\{(\w+)\}")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a table of the folder."""
    sql = SOURCES_SPARK if name == "fx_sources" else VIEWS.get(name)
    if sql is None:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(sql, **{x: view(spark, sf_dir, x) for x in _NAMES.findall(sql)})


def oracle(sql: str) -> str:
    """``sql`` for DuckDB, with the views it names in braces as common table expressions before its own."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for x in _NAMES.findall(text):
            if x == "fx_sources" or x in VIEWS:
                need(SOURCES_DUCKDB if x == "fx_sources" else VIEWS[x])
                if x not in wanted:
                    wanted.append(x)

    need(sql)
    bare = lambda text: _NAMES.sub(r"\1", text)
    ctes = ", ".join(f"{x} AS ({bare(SOURCES_DUCKDB if x == 'fx_sources' else VIEWS[x])})" for x in wanted)
    sql = bare(sql).strip()
    if not wanted:
        return sql
    if sql[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes}, {sql[14:]}"
    if sql[:4].upper() == "WITH":
        return f"WITH {ctes}, {sql[4:]}"
    return f"WITH {ctes} {sql}"
