"""Secret scans with multipart credential linking.

Base spans (assignments, access identifiers, hex strings) are strong and always reported. Weak candidates -
bare 40-character secrets and endpoints, which are common in clean text - are reported only when complementary
parts of one credential lie in the same scope: an interval join of the sorted spans of a document, written as a
merge, asks for each weak part whether an identifier, a secret or an endpoint lies within ``SCOPE`` code points.
Everything is built-in column functions of one row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCOPE = 200
PART = 128

# The kinds in the order in which equal starts are listed, with their patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
BARE = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"""(?:https?|ftp|s3|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s"'<>]{4,}"""
KINDS = ["assign", "access", "hex", "secret", "endpoint"]
BASE_KINDS = 3


def bound(value: Column, body) -> Column:
    """``body(value)``, the value being worked out once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _parts(items: Column) -> Column:
    """``items`` cut into runs of ``PART``; no items are one empty run."""
    n = F.greatest(F.size(items) - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.floor(n / PART).cast("int")), lambda i: F.slice(items, i * PART + 1, F.lit(PART)))


def running(items: Column, state: dict[str, Column], step, emit, kind: str) -> Column:
    """``emit(state, item)`` of every item, in order, where ``step(state, item)`` renews the state after each.

    Results are gathered run by run: growing one array an item at a time would copy it as often as it has items.
    """
    names = list(state)
    begun = F.struct(*[v.alias(k) for k, v in state.items()], F.array().cast(f"array<array<{kind}>>").alias("out"))

    def one(acc: Column, x: Column) -> Column:
        new = step(acc, x)
        return F.struct(*[new[k].alias(k) for k in names], F.concat(acc["out"], F.array(emit(acc, x))).alias("out"))

    def run(acc: Column, part: Column) -> Column:
        begin = F.struct(*[acc[k].alias(k) for k in names], F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(part, begin, one, lambda a: F.struct(*[a[k].alias(k) for k in names], F.concat(acc["out"], F.array(a["out"])).alias("out")))

    return bound(items, lambda held: F.aggregate(_parts(held), begun, run, lambda acc: F.flatten(acc["out"])))


def _spans(text: Column, pattern: str, kind: int, valid=None) -> Column:
    """Array of (start, end, kind) of the leftmost non-overlapping matches, in code points, end exclusive.

    The text between matches comes from splitting at the same pattern, so that running lengths place each match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    placed = running(
        F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.size(found)).alias("b")),
        {"at": F.lit(0).cast("long")},
        lambda acc, x: {"at": (acc["at"] + F.length(x["b"]) + F.length(x["m"])).cast("long")},
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["b"])).alias("start"), (acc["at"] + F.length(x["b"]) + F.length(x["m"])).alias("end"), F.lit(kind).alias("kind"), x["m"].alias("m")
        ),
        "struct<start:bigint,end:bigint,kind:int,m:string>",
    )
    kept = F.filter(placed, valid) if valid is not None else placed
    bare = F.transform(kept, lambda s: F.struct(s["start"], s["end"], s["kind"]))
    return F.when(text.rlike(pattern), bare).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>"))


def candidate_spans(text: Column) -> Column:
    """All base spans and weak candidates of a text as (start, end, kind number); a null text has none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    long_value = lambda s: F.length(F.regexp_extract(s["m"], ASSIGN, 2)) >= 8
    long_name = lambda s: (s["end"] - s["start"]) >= 16
    return F.concat(
        _spans(text, ASSIGN, 0, long_value), _spans(text, ACCESS, 1, long_name), _spans(text, HEX, 2), _spans(text, BARE, 3), _spans(text, ENDPOINT, 4)
    )


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(x) for x in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def linked_spans(spans: Column, scope: int = SCOPE) -> Column:
    """The reported spans, sorted by start, then kind: base spans, and weak parts whose complement lies in scope.

    A merge of the sorted intervals, forwards and then backwards: each step knows where the nearest identifier,
    secret and endpoint lie on that side, and how far the base spans met so far reach: weak parts inside one are left
    out.
    """
    far = F.lit(-(10**15)).cast("long")
    kind = "struct<start:bigint,kind:int,end:bigint,ok:boolean,inside:boolean>"

    def merged(items: Column, sign: int) -> Column:
        def step(acc: Column, s: Column) -> dict[str, Column]:
            at = s["start"] * sign
            return {
                "name": F.when(s["kind"] == 1, at).otherwise(acc["name"]),
                "value": F.when(s["kind"].isin(0, 3), at).otherwise(acc["value"]),
                "place": F.when(s["kind"] == 4, at).otherwise(acc["place"]),
                "reach": F.when(s["kind"] < BASE_KINDS, F.greatest(acc["reach"], s["end"])).otherwise(acc["reach"]),
            }

        def emit(acc: Column, s: Column) -> Column:
            close = lambda x: (s["start"] * sign - x) <= scope
            linked = F.when(s["kind"] == 3, close(acc["name"]) | close(acc["place"])).otherwise(close(acc["name"]) | close(acc["value"]))
            inside = s["inside"] | (acc["reach"] >= s["end"]) if sign > 0 else s["inside"]
            return F.struct(s["start"], s["kind"], s["end"], (s["ok"] | linked).alias("ok"), inside.alias("inside"))

        return running(items, {"name": far, "value": far, "place": far, "reach": far}, step, emit, kind)

    listed = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"], F.lit(False).alias("ok"), F.lit(False).alias("inside"))))
    both = F.reverse(merged(F.reverse(merged(listed, 1)), -1))
    weak = F.exists(spans, lambda s: s["kind"] >= BASE_KINDS)
    chosen = F.filter(F.when(weak, both).otherwise(listed), lambda s: (s["kind"] < BASE_KINDS) | (s["ok"] & ~s["inside"]))
    return F.when(F.size(spans) > 0, F.transform(chosen, lambda s: F.struct(s["start"], s["kind"], s["end"]))).otherwise(
        F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    )


def scan_secrets(docs: DataFrame, text_col: str = "text", scope: int = SCOPE, out_col: str = "secret_spans") -> DataFrame:
    """``docs`` with ``out_col``: an array of (start, kind, end) sorted by start, then kind.

    Weak parts are kept only next to a complement: a bare secret within ``scope`` code points of an access
    identifier or an endpoint, an endpoint within ``scope`` of an access identifier, an assignment or a bare
    secret. A weak part inside a base span is not repeated. Cases: a null or empty text has no spans; repeated
    rows are scanned each; the columns of ``docs`` stay, but for one named like ``out_col``, which is replaced.
    A projection: nothing is shuffled, and each row stands alone.
    """
    found = docs.withColumn(out_col, candidate_spans(F.col(f"`{text_col}`")))
    return found.withColumn(out_col, linked_spans(F.col(f"`{out_col}`"), scope))


def _without(text: Column, spans: Column, mark: str) -> Column:
    """``text`` with each run of overlapping spans replaced by ``mark``; a run of cuts is taken from its own piece of text."""
    cuts = running(
        spans,
        {"at": F.lit(0).cast("long")},
        lambda acc, s: {"at": F.greatest(acc["at"], s["end"])},
        lambda acc, s: F.struct(acc["at"].alias("from"), s["start"].alias("to"), (s["start"] >= acc["at"]).alias("new"), F.greatest(acc["at"], s["end"]).alias("next")),
        "struct<from:bigint,to:bigint,new:boolean,next:bigint>",
    )
    after = lambda s, at, n: F.substring(s, (at + 1).cast("int"), n.cast("int"))

    def joined(part: Column) -> Column:
        begin, end = part[0]["from"], F.array_max(F.transform(part, lambda c: c["to"]))
        cut = lambda p: F.transform(part, lambda c: F.when(c["new"], F.concat(after(p, c["from"] - begin, c["to"] - c["from"]), F.lit(mark))).otherwise(""))
        return bound(after(text, begin, end - begin), lambda p: F.array_join(cut(p), ""))

    whole = bound(cuts, lambda c: F.concat(F.array_join(F.transform(_parts(c), joined), ""), after(text, F.element_at(c, -1)["next"], F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``mark`` (overlapping spans by one), and the count of
    code points in ``chars_col`` renewed where something was replaced. Same columns; texts without a span, and null
    texts, stay as they are; the row travels as a struct, so no column name can clash."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    text = F.col(f"doc.`{text_col}`")
    found = scan_secrets(rows.withColumn("text", text), out_col="spans")
    out = found.select("doc", F.size("spans").alias("n"), _without(F.col("text").cast("string"), F.col("spans"), mark).alias("clean"))
    columns = []
    for c in docs.columns:
        own = F.col(f"doc.`{c}`")
        if c == text_col:
            own = F.when(F.col("n") > 0, F.col("clean")).otherwise(own)
        elif c == chars_col:
            own = F.when(F.col("n") > 0, F.length("clean").cast("long")).otherwise(own)
        columns.append(own.alias(c))
    return out.select(*columns)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base spans, and the list of all spans."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "secret_spans")
    spans = F.col("secret_spans")
    number = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(_listed(F.filter(spans, lambda s: s["kind"] < BASE_KINDS)), 256).alias("base_sha256"),
        _listed(spans).alias("spans"),
    )


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
p(kind, no, pat) AS (VALUES
  ('assign', 0, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  ('access', 1, 'AKIA[A-Z0-9]+'),
  ('hex', 2, '[0-9a-f]{32,}'),
  ('secret', 3, '[A-Za-z0-9+/]+=*'),
  ('endpoint', 4, '(?:https?|ftp|s3|jdbc:[a-z]+|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\s"''<>]{4,}')),
m AS (
  SELECT r, kind, no, pat, regexp_extract_all(text, pat) AS ms, regexp_split_to_array(text, pat) AS bs FROM d, p WHERE regexp_matches(text, pat)
), i AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m),
a AS (
  SELECT r, kind, no, ms[i] AS t, CAST(sum(length(bs[i]) + length(ms[i])) OVER (PARTITION BY r, no ORDER BY i) AS BIGINT) AS fin, pat FROM i
), s AS (
  SELECT r, kind, no, fin - length(t) AS start, fin FROM a
  WHERE CASE no WHEN 0 THEN length(regexp_extract(t, pat, 2)) >= 8 WHEN 1 THEN length(t) >= 16
    WHEN 3 THEN length(t) = 40 AND NOT contains(t, '=') ELSE true END
), c AS (
  SELECT DISTINCT w.* FROM s w JOIN s o ON o.r = w.r AND o.no <> w.no AND abs(o.start - w.start) <= 200 AND w.no >= 3
    AND ((w.no = 3 AND o.no IN (1, 4)) OR (w.no = 4 AND o.no IN (0, 1, 3)))
  WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.r = w.r AND b.no < 3 AND b.start <= w.start AND b.fin >= w.fin)
), k AS (SELECT * FROM s WHERE no < 3 UNION ALL SELECT * FROM c),
g AS (
  SELECT r, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex,
    string_agg(concat(kind, ':', start, ':', fin), ',' ORDER BY start, no) FILTER (no < 3) AS base,
    string_agg(concat(kind, ':', start, ':', fin), ',' ORDER BY start, no) AS spans FROM k GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)
"""
