"""The registered queries: every one of a sample matches its SQL on the small tables."""

import datetime
import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(k for k in entry.oracle_sql() if not k.startswith("op") and k != "pipeline")
#: All twins if ALL_TWINS is set; else a sixth of them, another one each day, and those of the headline queries.
TURN = datetime.date.today().toordinal() % 6
HEADLINE = {"d9_find_path", "d10_answer_tool_calls", "i1_triplet_scores", "c6_bpmn_flows", "k2_confirm_tracks_stream", "i18_teta_apart", "k3_hotstart_stream"}
SAMPLE = NAMES if os.environ.get("ALL_TWINS") else sorted({*NAMES[TURN::6]} | HEADLINE)


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for table in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{table}'")
    got = entry.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    cursor = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({entry.oracle_sql()[name]}) q")
    plain = lambda row: tuple(round(v, 9) if isinstance(v, float) else v for v in row)
    assert sorted(map(repr, map(plain, got.select(*columns).collect()))) == sorted(map(repr, map(plain, cursor.fetchall())))


def test_entry(spark):
    assert entry.entry(spark).count() == 1


def test_without_the_llm_folder():
    """The rest imports without the subpackage and the pipeline."""
    import subprocess

    code = "import sys; sys.modules['arrowlake.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__))


def test_with_a_module_missing():
    """What the subpackage imports and can't have takes no other query down."""
    import subprocess

    code = "import sys; sys.modules['arrowlake.llm.hashing'] = None; import __spark_entry__ as e; assert len(e.queries()) > 150 and 'op1_topk' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(entry.__file__))
