"""Conversation repair against exhaustive search and a plain chart parser, and on odd tables."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from arrowlake.llm import conversations as C

ROWS = "conv_id long, turn long, role string, text string"


def letters(rows):
    """(initial, must go, truncated) of ordered (turn, role, text) rows."""
    out, seen = [], set()
    for _, role, text in rows:
        bare = text.rstrip(C.BLANK)
        out.append((role[:1], not bare or (role, text) in seen, bool(bare) and bare[-1] not in ".!?"))
        seen.add((role, text))
    return out


def cheapest(rows):
    """The least (cost, audit) over all edit sequences, by a search over positions of the output."""
    best = {(0, ""): (0, "")}  # (state of the output) -> (cost, audit)
    states = {"": "", "s": "s", "u": "u", "a": "a"}

    def grown(found):
        while True:
            more = dict(found)
            for q, (c, a) in found.items():
                for kind, sources in {"u": ("", "s", "a"), "a": ("u",)}.items():
                    if q in sources:
                        new = (c + 5, a + "I")
                        more[kind] = min(more.get(kind, new), new)
            if more == found:
                return found
            found = more

    found = grown({"": best[(0, "")]})
    for initial, gone, cut in letters(rows):
        after = {}
        for q, (c, a) in found.items():
            moves = [(q, 2, "D")]
            if not gone:
                for kind, sources in {"s": ("",), "u": ("", "s", "a"), "a": ("u",)}.items():
                    if q in sources and initial == kind:
                        moves.append((kind, 5 * cut, "K"))
                    if q in sources and kind != "s":
                        moves.append((kind, 1 + 5 * cut, "R"))
            for to, cost, letter in moves:
                new = (c + cost, a + letter)
                after[states[to]] = min(after.get(to, new), new)
        found = grown(after)
    return min(found[q] for q in ("", "a") if q in found)


def exhaustive(rows, most=2):
    """The same by trying every audit with up to ``most`` insertions."""
    marks, best = letters(rows), None
    for n in range(most + 1):
        for places in itertools.combinations_with_replacement(range(len(rows) + 1), n):
            for edits in itertools.product("KRD", repeat=len(rows)):
                audit, cost, outs, ok = "", 0, [""], True
                for i in range(len(rows) + 1):
                    for _ in range(places.count(i)):
                        audit, cost, outs = audit + "I", cost + 5, [o + k for o in outs for k in "ua"]
                    if i == len(rows):
                        break
                    initial, gone, cut = marks[i]
                    ok &= edits[i] == "D" or not gone
                    audit += edits[i]
                    cost += {"K": 0, "R": 1, "D": 2}[edits[i]] + 5 * (cut and edits[i] != "D")
                    if edits[i] != "D":
                        outs = [o + k for o in outs for k in ((initial or "?") if edits[i] == "K" else "ua")]
                if ok and any(re.fullmatch("(s?(ua)+)?", o) for o in outs):
                    best = min(best or (cost, audit), (cost, audit))
    return best


def chart(word):
    """A full chart: every span, every split point."""
    cells = {(i, i + 1): C.span(x) for i, x in enumerate(word)}
    for size in range(2, len(word) + 1):
        for i in range(len(word) - size + 1):
            cells[i, i + size] = C._least(*[C.combined(cells[i, m], cells[m, i + size]) for m in range(i + 1, i + size)])
    return cells[0, len(word)]


def test_spans_by_length_equal_the_full_chart():
    rng = random.Random(5)
    for _ in range(60):
        word = "".join(rng.choice("suaoxSUAO") for _ in range(rng.randint(1, 22)))
        parse = C.Parse()
        for x in word:
            parse.add(x)
        assert parse.cell() == chart(word)


def test_against_exhaustive_search():
    rng = random.Random(6)
    for _ in range(120):
        rows = [(i, rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["Yes.", "no", "", "What?", f"t{i}."])) for i in range(rng.randint(1, 4))]
        assert cheapest(rows) == exhaustive(rows)


def tables(spark, rows):
    found, repaired = C.repair(spark.createDataFrame(rows, ROWS).withColumn("cost", F.lit("clash")))
    return {r.conv_id: r for r in found.collect()}, repaired.collect(), {r.conv_id: r.repaired_sha256 for r in C.digests(repaired).collect()}


def test_repair_against_a_scan(spark):
    rng = random.Random(7)
    rows = []
    for conv in range(60):
        for turn in range(rng.choice([1, 2, 5, 30])):
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool"]), rng.choice(["Yes.", "cut", " \t", "Why?", f"{turn}!", "x" * 50 + "."])))
    found, repaired, digests = tables(spark, rows)
    for conv in range(60):
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: r[0])
        cost, audit = cheapest(own)
        assert (found[conv].cost, found[conv].audit) == (cost, audit)
        marks = letters(own)
        assert found[conv].blank == sum(not t.rstrip(C.BLANK) for _, _, t in own)
        assert found[conv].illegal == sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        mine = sorted((r for r in repaired if r.conv_id == conv), key=lambda r: r.position)
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in mine))
        assert [r.edit for r in mine] == [x for x in audit if x != "D"]
        assert [r.text for r in mine if r.edit != "I"] == [t for (_, _, t), e in zip(own, audit.replace("I", "")) if e != "D"]
        joined = "\n".join(f"{r.role}:{r.text}" for r in mine)
        assert digests.get(conv, hashlib.sha256(b"").hexdigest()) == hashlib.sha256(joined.encode()).hexdigest()


def test_odd_rows(spark):
    long = "word " * 400_000 + "end."
    rows = [
        (None, 3, "user", "Hi."), (None, 4, "assistant", "Yes."),
        (1, None, "user", "Hi."), (1, 0, "assistant", long), (1, 0, "assistant", long), (1, 7, None, None),
        (2, 5, "", "No role."), (3, 1, "user", " \n"),
        *[(4, t, "useful", f"{t}.") for t in range(300)],
    ]
    found, repaired, digests = tables(spark, rows)
    assert found[None].audit == "KK" and found[None].gaps == 0
    assert found[1].asDict() | {"conv_id": 1} == {"conv_id": 1, "gaps": 6, "blank": 1, "duplicate": 1, "truncated": 0, "illegal": 2, "cost": 4, "audit": "KKDD"}
    assert found[2].audit == "D" and found[2].cost == 2
    assert found[3].blank == 1 and found[3].audit == "D" and 3 not in digests
    assert found[4].illegal == 299 and found[4].cost == 150 and found[4].audit == "KR" * 150
    assert [r.text for r in repaired if r.conv_id == 1 and r.position == 1] == [long]
    empty, rows, digests = tables(spark, [])
    assert not empty and not rows and not digests


def test_one_conversation_over_many_partitions(spark):
    rng = random.Random(8)
    rows = [(9, t, rng.choice(["user", "assistant"]), rng.choice([f"{t}.", "cut", "So?"])) for t in range(3000)]
    found, _, digests = tables(spark, rows)
    assert (found[9].cost, found[9].audit) == cheapest([r[1:] for r in rows]) and len(digests) == 1


def test_query_equals_sql_with_nulls(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, *range(9)]), rng.choice([None, "system", "user", "assistant", ""]), rng.choice([None, "", "Hi.", "no", "Eh?"])) for _ in range(300)]
    spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(C.OP11_SQL).fetchall()
    got = C.op11_conversation_repair(spark, str(tmp_path)).collect()
    # rows of equal turn may be ordered either way where roles and texts differ: the twin sorts by text, so compare what no order changes
    key = lambda r: -1 if r[0] is None else r[0]
    assert [r[:5] for r in sorted(map(tuple, got), key=key)] == [r[:5] for r in sorted(want, key=key)]


@pytest.mark.parametrize("sf", ["0.001"])
def test_query_on_the_test_tables(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    assert sorted(map(tuple, C.op11_conversation_repair(spark, folder).collect())) == sorted(con.execute(C.OP11_SQL).fetchall())
