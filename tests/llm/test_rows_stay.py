"""Scoring and describing send texts alone to Python, whatever else the rows hold and however the texts are made."""

from arrowlake.llm import mixing, quality, secret_scan

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_only_texts_go_to_python(spark):
    texts = [f"Some plain words of the day number {i} and password: hunter{i}hunter2" for i in range(20)] + [None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    for make in (quality.scored, mixing.describe):
        plan = make(docs)._jdf.queryExecution().optimizedPlan().toString()
        assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
        out = make(secret_scan.redact(docs)).select("doc.*").collect()
        assert sorted(r.doc_id for r in out) == list(range(22)) and not any("hunter" in (r.text or "") for r in out)
