"""Parsing model transcripts with built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# First words that mean yes or no.
YES, NO = ["yes", "true", "correct", "right"], ["no", "false", "incorrect", "wrong"]


def without_thinking(output: Column) -> Column:
    return strip(F.regexp_replace(output, r"(?is)<think>.*?</think>", ""))


def field(output: Column, name: str, default: str) -> Column:
    """The single-line value after ``name:``; the default where it is missing or blank."""
    value = strip(F.regexp_extract(output, rf"(?im)^\s*{name}\s*:\s*(.*)$", 1))
    return F.when(value == "", default).otherwise(value)


def parse_arrow_answer(output: Column) -> Column:
    """Array of (source, target, condition) from the three named fields of an answer.

    Parts joined by ``||`` are taken apart; a single part serves all, missing nodes repeat the last one and missing
    conditions are null, as is a condition ``none``.
    """
    text = without_thinking(F.coalesce(output, F.lit("")))
    parts = lambda name, default: F.transform(F.split(field(text, name, default), r"\|\|"), strip)
    s, t, c = parts("source_node", "[UNKNOWN]"), parts("target_node", "[UNKNOWN]"), parts("condition", "None")
    n = F.greatest(F.size(s), F.size(t), F.size(c))
    node = lambda a, i: F.get(a, F.least(i, F.size(a) - 1))
    cond = lambda i: F.when(F.size(c) == 1, F.get(c, F.lit(0))).otherwise(F.get(c, i))
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.struct(node(s, i).alias("source"), node(t, i).alias("target"), F.when(F.lower(cond(i)) != "none", cond(i)).alias("condition")),
    )


def parse_hier_answer(output: Column) -> Column:
    """The five single-line fields of an answer with locations; ``None`` where missing."""
    text = without_thinking(F.coalesce(output, F.lit("")))
    names = ["source_node", "source_location", "target_node", "target_location", "condition"]
    return F.struct(*[field(text, n, "None").alias(n) for n in names])


def split_k_blocks(output: Column, n: Column | int) -> Column:
    """The ``n`` blocks after ``arrow_i:`` markers, in order; without a marker the whole text is the first."""
    n = F.lit(n) if isinstance(n, int) else n
    text = without_thinking(F.coalesce(output, F.lit("")))
    marker = r"(?i)arrow_\d+\s*:"
    blocks = F.split(text, marker)
    found = F.when(text.rlike(marker), F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0)))).otherwise(F.array(text))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(strip(F.get(found, i)), F.lit("")))


def extract_triplets(output: Column) -> Column:
    """All ``<a, relation, b>`` of a free text whose ends are not empty."""
    pattern = r"<\s*([^<>,]*?)\s*,\s*([^<>,]*?)\s*,\s*([^<>]*?)\s*>"
    whole = F.regexp_extract_all(output, F.lit(pattern), F.lit(0))
    part = lambda x, i: F.regexp_extract(x, pattern, i)
    rows = F.transform(whole, lambda x: F.struct(part(x, 1).alias("src"), part(x, 2).alias("rel"), part(x, 3).alias("dst")))
    return F.filter(rows, lambda r: (r["src"] != "") & (r["dst"] != ""))


def parse_tool_calls(output: Column) -> Column:
    """Array of (name, arguments as a JSON string) of the ``<tool_call>`` bodies that are JSON objects with a name."""
    bodies = F.regexp_extract_all(output, F.lit(r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"), F.lit(1))
    calls = F.transform(
        bodies,
        lambda b: F.struct(
            F.get_json_object(b, "$.name").alias("name"),
            F.coalesce(F.get_json_object(b, "$.arguments"), F.get_json_object(b, "$.parameters"), F.lit("{}")).alias("arguments"),
        ),
    )
    return F.filter(calls, lambda c: c["name"].isNotNull())


def strip_tool_calls(output: Column) -> Column:
    return strip(F.regexp_replace(output, r"(?s)<tool_call>.*?</tool_call>", ""))


def parse_yes_no(col: Column) -> Column:
    """yes or no by the first word, else by the only kind named in the first 60 characters, else null."""
    text = F.lower(strip(col))
    head = F.regexp_extract(text, "^[a-z]*", 0)
    chunk = F.substring(text, 1, 60)
    has = lambda words: chunk.rlike(r"\b(" + "|".join(words) + r")\b")
    return F.when(head.isin(*YES), "yes").when(head.isin(*NO), "no").when(has(YES) & ~has(NO), "yes").when(has(NO) & ~has(YES), "no")


def parse_int(col: Column) -> Column:
    """The first integer of a text, else null."""
    return F.regexp_extract(col, r"-?\d+", 0).try_cast("bigint")


def gold_labels(answers: list[Column], label: Column, gt: Column) -> Column:
    """The non-empty answers, else the label, else the ground truth, as an array."""
    given = F.filter(F.array(*answers), lambda x: F.coalesce(x, F.lit("")) != "")
    one = F.coalesce(F.when(label != "", label), F.when(gt != "", gt))
    return F.when(F.size(given) > 0, given).when(one.isNotNull(), F.array(one)).otherwise(F.array().cast("array<string>"))


def format_reward(completion: Column) -> Column:
    return completion.rlike(r"(?s)^\s*<think>.*?</think>\s*<answer>.*?</answer>\s*$").cast("double")


def text_reward(completion: Column, solution: Column) -> Column:
    answer = F.regexp_extract(completion, r"(?s)<answer>(.*?)</answer>", 1)
    given = F.when(answer != "", answer).otherwise(completion)
    return (F.lower(strip(given)) == F.lower(strip(solution))).cast("double")
