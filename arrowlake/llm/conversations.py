"""Conversation repair by weighted interval parsing.

A repaired conversation has role initials ``(s?(ua)+)?``. Four points lie along such a sequence: 0 at the start, 1 after
``s``, 2 after ``u`` and 3 after ``a``. A grammar in Chomsky normal form has a nonterminal ``N(p, q)`` for every way
from point p to point q: ``N(p, q) -> N(p, r) N(r, q)``, and ``N(p, q) -> row`` for each edit of a row that leads from p
to q. A span's cell holds the minimum (cost, audit) of each nonterminal; inserted rows enter by closing the cell of a
single row under insertion on both sides.

Any cut of a span serves: whatever its split point, ``N(p, q)`` ranges over the same sentences, as r may be any point.
So spans are combined bottom-up by their length, 1, 2, 4 and so on, each at its middle, and a conversation of any length
takes a linear number of cells. Edits of equal cost have audits none of which begins another (letters of the same rows
cost the same, and each insertion costs more), so the least concatenation is made of the least parts.

Rows of all conversations are sorted by ranges; a long conversation lies in several partitions, each of which yields one
cell, and the few cells are combined. The audit then travels before its conversation's rows and they are edited in order.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Cell = dict[tuple[int, int], tuple[int, str]]

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
POINTS = range(4)
BLANK = " \t\n\x0b\x0c\r"
#: Where a row of each initial leads.
MOVES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
PAIRS = [(p, q) for p in POINTS for q in POINTS if (q > 0 or p == 0) and (q > 1 or p <= q)]
#: The binary rules of each nonterminal.
RULES = {(p, q): [((p, r), (r, q)) for r in POINTS if (p, r) in PAIRS and (r, q) in PAIRS] for p, q in PAIRS}
#: Rows of a word whose cell is remembered; most conversations are made of few different ones.
WORD = 8


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of two adjoining spans."""
    out = {}
    for whole, rules in RULES.items():
        found = [(left[a][0] + right[b][0], a, b) for a, b in rules if a in left and b in right]
        if found:
            cost = min(c for c, _, _ in found)
            out[whole] = cost, min(left[a][1] + right[b][1] for c, a, b in found if c == cost)
    return out


def _least(*cells: Cell) -> Cell:
    return {k: min(c[k] for c in cells if k in c) for k in {k for c in cells for k in c}}


@functools.cache
def insertions() -> Cell:
    """The closure: any number of inserted rows, or none."""
    none: Cell = {(p, p): (0, "") for p in POINTS}
    one: Cell = {(p, q): (INSERT, "I") for kind in "ua" for p, q in MOVES[kind].items()}
    closed = _least(none, one)
    while (more := combined(closed, closed)) != closed:
        closed = more
    return closed


@functools.lru_cache(1 << 16)
def span(word: str) -> Cell:
    """The cell of a word of rows. A letter is a row: its initial (``o``: any other), in upper case if truncated, or
    ``x`` for a row that must go."""
    if len(word) > 1:
        half = len(word) // 2
        return combined(span(word[:half]), span(word[half:]))
    cells: list[Cell] = [{(p, p): (DELETE, "D") for p in POINTS}]
    if word != "x":
        more = TRUNCATED if word.isupper() else 0
        cells.append({(p, q): (KEEP + more, "K") for p, q in MOVES.get(word.lower(), {}).items()})
        cells.append({(p, q): (REROLE + more, "R") for kind in "ua" for p, q in MOVES[kind].items()})
    return combined(combined(insertions(), _least(*cells)), insertions())


class Parse:
    """The cell of a growing span: cells of rising length wait on a stack until an equally long one follows."""

    def __init__(self) -> None:
        self._word, self._stack = [], []

    def add(self, letter: str) -> None:
        self._word.append(letter)
        if len(self._word) == WORD:
            self._push()

    def _push(self) -> None:
        size, cell = len(self._word), span("".join(self._word))
        self._word = []
        while self._stack and self._stack[-1][0] <= size:
            before, left = self._stack.pop()
            size, cell = before + size, combined(left, cell)
        self._stack.append((size, cell))

    def cell(self) -> Cell:
        if self._word:
            self._push()
        cells = [c for _, c in self._stack]
        return functools.reduce(lambda right, left: combined(left, right), cells[-2::-1], cells[-1])


def marked(rows: DataFrame) -> DataFrame:
    """Turns with null roles and texts as one space, ``last`` (the last character that isn't blank; empty if none) and
    ``key`` (a digest of role and text)."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    out = rows.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit(" ")).alias("role"), text.alias("text"))
    size = F.octet_length("role").cast("string")
    return out.withColumn("last", F.substring(F.rtrim("text", F.lit(BLANK)), -1, 1)).withColumn("key", F.md5(F.concat(size, F.lit(":"), "role", "text")))


def faults(turns: DataFrame) -> DataFrame:
    """Distinct turns of ``marked`` rows with ``copies``, ``initial`` and ``fault`` (of the first copy: ``blank``,
    ``duplicate``, ``truncated`` or empty; further copies are blank or else duplicates)."""
    each = turns.groupBy("conv_id", "turn", "role", "key").agg(F.count("*").alias("copies"), F.max("last").alias("last"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = each.groupBy(F.col("conv_id").alias("conv"), F.col("key").alias("same")).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    both = each.join(seen, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("key") == F.col("same")), "left")
    later = F.col("first").isNotNull() & (place != F.col("first"))
    fault = F.when(F.col("last") == "", "blank").when(later, "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated").otherwise("")
    return both.select("conv_id", "turn", "role", "key", "copies", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


COUNTS = ["rows", "blank", "duplicate", "truncated", "illegal"]
FRAGMENT = (
    "conv_id long, part int, " + ", ".join(f"{c} long" for c in COUNTS) + ", first_initial string, last_initial string, "
    "first_turn long, last_turn long, turns long, costs array<long>, audits array<string>"
)
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _table(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], schema=kind)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of a conversation's turns in a sorted partition."""
    part, kind = TaskContext.get().partitionId(), _schema(FRAGMENT)
    open_, now = False, None

    def closed() -> tuple:
        cell = parse.cell()
        pairs = [cell.get(k, (None, None)) for k in PAIRS]
        return (now, part, *(count[c] for c in COUNTS), first, initial, first_turn, turn, turns, [c for c, _ in pairs], [a for _, a in pairs])

    for batch in batches:
        out = []
        for conv, at, own, fault, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault", "copies")), strict=True):
            if not open_ or conv != now:
                if open_:
                    out.append(closed())
                open_, now, parse, count, turns = True, conv, Parse(), dict.fromkeys(COUNTS, 0), 0
                first, initial, first_turn, turn = own, None, None, None
            if at is not None and at != turn:
                turns, turn = turns + 1, at
                first_turn = at if first_turn is None else first_turn
            letter = own if own in ("s", "u", "a") else "o"
            for i in range(copies):
                kind_of = fault if i == 0 or fault == "blank" else "duplicate"
                count["rows"] += 1
                if kind_of:
                    count[kind_of] += 1
                if initial is not None:
                    count["illegal"] += _illegal(initial, own)
                initial = own
                parse.add({"": letter, "truncated": letter.upper()}.get(kind_of, "x"))
        if out:
            yield _table(out, kind)
    if open_:
        yield _table([closed()], kind)


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its sorted fragments."""
    held, kind = None, _schema(REPORT)

    def report() -> tuple:
        cost, audit = min(held["cell"][k] for k in [(0, 0), (0, 3)] if k in held["cell"])
        gaps = 0 if held["first_turn"] is None else held["last_turn"] - held["first_turn"] + 1 - held["turns"]
        return held["conv_id"], gaps, *(held[c] for c in COUNTS[1:]), cost, audit

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            row["cell"] = {k: x for k, x in zip(PAIRS, zip(row.pop("costs"), row.pop("audits"), strict=True), strict=True) if x[0] is not None}
            if held is not None and held["conv_id"] == row["conv_id"]:
                for c in COUNTS:
                    held[c] += row[c]
                held["illegal"] += _illegal(held["last_initial"], row["first_initial"])
                held["turns"] += row["turns"] - (row["first_turn"] is not None and row["first_turn"] == held["last_turn"])
                held["cell"] = combined(held["cell"], row["cell"])
                held["last_initial"] = row["last_initial"]
                held["first_turn"] = row["first_turn"] if held["first_turn"] is None else held["first_turn"]
                held["last_turn"] = held["last_turn"] if row["last_turn"] is None else row["last_turn"]
            else:
                if held is not None:
                    out.append(report())
                held = row
        yield _table(out, kind)
    if held is not None:
        yield _table([report()], kind)


def reports(turns: DataFrame) -> DataFrame:
    """One row a conversation of ``marked`` turns: its faults, and the cost and audit of the cheapest edits."""
    spark = turns.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["conv_id", "turn", "role", "key"]
    sorted_ = faults(turns).repartitionByRange(n, *order).sortWithinPartitions(*order)
    fragments = sorted_.select("conv_id", "turn", "initial", "fault", "copies").mapInArrow(_fragments, FRAGMENT)
    return fragments.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_reports, REPORT)


REPAIRED = "conv_id long, position long, edit string, role string, text string"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows of sorted conversations, each led by a row that holds its audit."""
    kind = _schema(REPAIRED)
    conv, audit, at, point, position = None, "", 0, 0, 0

    def put(edit: str, role: str | None, text: str) -> None:
        nonlocal point, position
        if role is None:
            role = "assistant" if point == 2 else "user"
        point = MOVES[role[:1]][point]
        out.append((conv, position, edit, role, text))
        position += 1

    def inserted() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            put("I", None, "")
            at += 1

    out: list[tuple] = []
    for batch in batches:
        for own, head, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")), strict=True):
            if head is not None:
                inserted()
                conv, audit, at, point, position = own, head, 0, 0, 0
                continue
            inserted()
            edit = audit[at]
            at += 1
            if edit != "D":
                put(edit, role if edit == "K" else None, text)
        yield _table(out, kind)
        out = []
    inserted()
    yield _table(out, kind)


def edited(turns: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired rows: ``conv_id, position (from 0), edit (K, R or I), role, text``, those of a conversation adjacent
    and in order within a partition."""
    n = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    heads = found.select("conv_id", "audit", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("key", "string"), ("text", "string"))])
    rows = turns.select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "key", "text")
    both = heads.unionByName(rows).repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", "key")
    return both.select("conv_id", "audit", "role", "text").mapInArrow(_edited, REPAIRED)


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(reports, repaired rows) of conversations.

    A report is ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``; see ``edited`` for the rows.
    Cases: turns come in rising order, null turns first, ties by role and then by a digest of role and text; a null or
    empty role keeps no row (it can be given another), a null role or text is one space, a null id is a conversation of
    its own; repeated rows are duplicates; a conversation or text may be of any length, but a conversation's audit and
    each text lie in one row; extra columns are ignored; an empty table gives none.
    """
    turns = marked(rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")))
    found = reports(turns)
    return found, edited(turns, found)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    conv, total = None, None
    for batch in batches:
        out = []
        for own, position, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "position", "role", "text")), strict=True):
            if position == 0:
                if total is not None:
                    out.append((conv, total.hexdigest()))
                conv, total = own, hashlib.sha256()
            total.update((("\n" if position else "") + f"{role}:{text}").encode())
        yield _table(out, kind)
    if total is not None:
        yield _table([(conv, total.hexdigest())], kind)


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: a digest of each conversation's adjacent repaired rows, newline-joined."""
    return repaired.select("conv_id", "position", "role", "text").mapInArrow(_joined, "conv_id long, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, drawn by a hash of id and turn: rows dropped, emptied, stripped of sentence
    ends, repeated or given to the user. Null values are one space."""

    def plain(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    drawn = rows.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return drawn.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired; one that loses all rows has zeros and the digest of nothing."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    found, repaired = repair(damaged(rows))
    report = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    ids = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    digest = digests(repaired).withColumnRenamed("conv_id", "whose")
    out = ids.join(found.withColumnRenamed("conv_id", "conv"), F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    out = out.join(digest, F.col("conv_id").eqNullSafe(F.col("whose")), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *report, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


#: CRC-32 of the string ``{0}``, a byte at a time from a table ``crc(t)`` of 256 values.
CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"
CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8)), 4294967295)"

#: The same by a scan over the rows: the cheapest (cost, audit, output) that ends at each point after each row.
OP11_SQL = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
drawn AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM drawn WHERE fate <> 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last, left(role, 1) AS initial FROM damaged),
faulty AS (
  SELECT *, CASE WHEN last = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN last NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM ordered),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM faulty GROUP BY conv_id),
moves(p, q, initial) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (3, 2, 'u'), (2, 3, 'a')),
inserts(p, q, c, a, o) AS (VALUES (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 2, 5, 'I', chr(10) || 'user:'), (1, 2, 5, 'I', chr(10) || 'user:'),
  (3, 2, 5, 'I', chr(10) || 'user:'), (2, 3, 5, 'I', chr(10) || 'assistant:'), (0, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
edits AS (
  SELECT conv_id, i, p, p AS q, 2 AS c, 'D' AS a, '' AS o FROM faulty, range(4) points(p)
  UNION ALL SELECT conv_id, i, p, q, CASE WHEN fault = 't' THEN 5 ELSE 0 END, 'K', chr(10) || role || ':' || text FROM faulty JOIN moves USING (initial) WHERE fault IN ('', 't')
  UNION ALL SELECT conv_id, i, p, q, CASE WHEN fault = 't' THEN 6 ELSE 1 END, 'R', chr(10) || CASE q WHEN 2 THEN 'user:' ELSE 'assistant:' END || text FROM faulty, moves WHERE q > 1 AND fault IN ('', 't')),
best AS (
  SELECT conv_id, 0::BIGINT AS i, q::BIGINT AS q, {{'c': c::BIGINT, 'a': a, 'o': o}} AS s FROM counted, inserts WHERE p = 0
  UNION ALL
  SELECT b.conv_id, b.i + 1, x.q::BIGINT, min({{'c': (b.s.c + e.c + x.c)::BIGINT, 'a': b.s.a || e.a || x.a, 'o': b.s.o || e.o || x.o}})
  FROM best b JOIN edits e ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND e.i = b.i + 1 AND e.p = b.q JOIN inserts x ON x.p = e.q GROUP BY ALL),
done AS (SELECT b.conv_id, min(s) AS s FROM best b JOIN counted c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = c.n WHERE q IN (0, 3) GROUP BY b.conv_id)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(s.c, 0) AS cost, coalesce(s.a, '') AS audit, sha256(coalesce(substr(s.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
