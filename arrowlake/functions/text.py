"""Label and relation normalisation, and edit similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Relations that mean a plain connection, by variant.
PLAIN_RELATIONS = {
    "default": ["connected_with", "connected", "connectedto", "", "none"],
    "flowlearn": ["connected_with", "connectedto", "", "none"],
    "flowvqa": ["connected_with", "connected", "", "none"],
}


def strip(col: Column) -> Column:
    """Without white space of any kind (Unicode's, and the separators 0x1C to 0x1F) at either end."""
    return F.regexp_replace(col, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def _lower_strip(col: Column) -> Column:
    return F.lower(strip(col))


def _alnum_only(col: Column) -> Column:
    return F.regexp_replace(F.lower(col), "[^a-z0-9]", "")


def _no_text(col: Column) -> Column:
    plain = _lower_strip(col)
    return F.when(plain.isin("o", "0"), "no text").otherwise(plain)


def _hyphenated(col: Column) -> Column:
    kept = F.regexp_replace(F.lower(F.replace(col, F.lit("_"), F.lit(" "))), r"[^a-z0-9\s\-]", "")
    return strip(F.replace(kept, F.lit(" "), F.lit("")))


#: Normalisers by name; callers may add their own Column functions.
LABEL_MODES: dict[str, Callable[[Column], Column]] = {"lower_strip": _lower_strip, "alnum_only": _alnum_only, "fc": _no_text, "flowvqa": _hyphenated}


def normalize_label(col: Column, mode: str = "lower_strip") -> Column:
    """A node label in comparable form; null is empty."""
    return LABEL_MODES[mode](F.coalesce(col, F.lit("")))


def normalize_relation(col: Column, mode: str = "default") -> Column:
    """A relation in comparable form; whatever means a plain connection, and null, is ``connect``."""
    raw = F.regexp_replace(col, "[\"']", "") if mode == "flowvqa" else col
    raw = _lower_strip(raw)
    return F.when(col.isNull() | raw.isin(*PLAIN_RELATIONS[mode]), "connect").otherwise(raw)


def graph_label(col: Column) -> Column:
    """A node's identity: lower case, anything but word characters as single spaces."""
    words = F.regexp_replace(F.replace(F.lower(F.coalesce(col, F.lit(""))), F.lit("_"), F.lit(" ")), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(words, r"(?U)\s+", " "))


def join_multi(col: Column, empty_as: str | None = None) -> Column:
    """Non-blank items of an array joined by `` || ``; an empty array as ``empty_as``."""
    kept = F.filter(F.transform(col, strip), lambda x: x.isNotNull() & (x != ""))
    joined = F.array_join(kept, " || ")
    return joined if empty_as is None else F.when(F.size(kept) > 0, joined).otherwise(empty_as)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty strings are alike, an empty and another one are not."""
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def similar_at_least(a: Column, b: Column, threshold: float) -> Column:
    """``edit_similarity(a, b) >= threshold``, settled by lengths before any distance is computed."""
    longer, shorter = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    near = (a == b) | ((shorter > 0) & (longer - shorter <= (1 - threshold) * longer + 1e-9) & (edit_similarity(a, b) >= threshold))
    return near


def keep_valid_triplets(df, src: str = "src", dst: str = "dst"):
    """Rows with both ends, of which the target is not pending."""
    return df.where((strip(F.col(src)) != "") & (strip(F.col(dst)) != "") & (F.lower(strip(F.col(dst))) != "pending"))


# LaTeX commands and what they are typed as, in the order in which they are replaced: an earlier one also takes
# the beginning of a longer name, as \le does in \leq.
MATH_SYMBOLS = {
    r"\cdot ": "·", r"\times": "×", r"\div": "÷", r"\pm": "±", r"\mp": "∓", r"\le": "<=", r"\leq": "<=", r"\ge": ">=", r"\geq": ">=", r"\ne": "!=", r"\neq": "!=", r"\lt": "<", r"\gt": ">",
    r"\approx": "≈", r"\equiv": "≡", r"\Delta": "Delta", r"\delta": "delta", r"\alpha": "alpha", r"\beta": "beta", r"\gamma": "gamma", r"\theta": "theta", r"\lambda": "lambda", r"\mu": "mu",
    r"\pi": "pi", r"\sigma": "sigma", r"\omega": "omega", r"\infty": "∞", r"\sum": "sum", r"\prod": "prod", r"\int": "integral", r"\lim": "lim", r"\sin": "sin", r"\cos": "cos", r"\tan": "tan",
    r"\log": "log", r"\ln": "ln", r"\exp": "exp",
}


def math_label(col: Column) -> Column:
    """A label's LaTeX as typed text: roots before fractions, braces of sub- and superscripts taken off, then symbols."""
    out = F.regexp_replace(F.coalesce(col, F.lit("")), r"\\sqrt\{([^{}]+)\}", r"sqrt($1)")
    out = F.regexp_replace(out, r"\\frac\{([^}]+)\}\{([^}]+)\}", r"($1)/($2)")
    for mark, pattern in (("^", r"\^\{([^{}]+)\}"), ("_", r"_\{([^{}]+)\}")):
        out = F.regexp_replace(out, pattern, f"{mark}$1")
    for symbol, typed in MATH_SYMBOLS.items():
        out = F.replace(out, F.lit(symbol), F.lit(typed))
    return F.trim(F.regexp_replace(F.regexp_replace(F.replace(out, F.lit("$"), F.lit("")), r"\\{2,}", " "), r"\s+", " "))


def corpus_math_labels(labels, label: str = "label"):
    """(``labels`` with ``math_label`` applied, number of distinct labels of each diagram)."""
    done = labels.withColumn(label, math_label(F.col(label)))
    return done, done.groupBy("graph_id").agg(F.count_distinct(label).alias("labels"))
