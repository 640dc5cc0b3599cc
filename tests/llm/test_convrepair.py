"""Conversation repair against enumeration of all edits, and its defined cases."""

import hashlib
import itertools
import random
import re

import pytest

from quantalake.llm.convrepair import crossings, damage, digests, joined, repair, search

GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def edits(symbols, inserts):
    """All (cost, audit) of a row of symbols, with up to ``inserts`` turns in each gap."""
    fill = [c for n in range(inserts + 1) for c in itertools.product("ua", repeat=n)]

    def options(c):
        own, cut = c.lower(), 5 * c.isupper()
        stay = [] if own == "x" else [("K", own, cut), ("R", "u", 1 + cut), ("R", "a", 1 + cut)]
        return [("D", "", 2), *stay]

    for gaps in itertools.product(fill, repeat=len(symbols) + 1):
        for own in itertools.product(*map(options, symbols)):
            roles, audit, cost = "".join(gaps[0]), "I" * len(gaps[0]), 5 * len(gaps[0])
            for (letter, role, c), gap in zip(own, gaps[1:], strict=True):
                roles, audit, cost = roles + role + "".join(gap), audit + letter + "I" * len(gap), cost + c + 5 * len(gap)
            if GRAMMAR.match(roles):
                yield cost, audit


def test_search_is_cheapest():
    for n, inserts in ((0, 2), (1, 2), (2, 1), (3, 1)):
        for symbols in map("".join, itertools.product("suaoxSUA", repeat=n)):
            if n < 3 or hash(symbols) % 8 == 0:
                assert min(search(symbols).values()) == min(edits(symbols, inserts)), symbols


def test_pieces_join_to_the_whole():
    rng = random.Random(1)
    for _ in range(200):
        symbols = "".join(rng.choice("suaoxUA") for _ in range(rng.randrange(30)))
        best, a = {0: (0, "")}, 0
        while a < len(symbols):
            b = a + rng.randrange(1, 8)
            best, a = joined(best, crossings(symbols[a:b])), b
        assert min(best[q] for q in (0, 3) if q in best) == min(search(symbols).values())


def by_hand(rows):
    """The report and repaired rows of one conversation's (turn, role, text), already in order."""
    seen, symbols, counts, illegal = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0
    for n, (_, role, text) in enumerate(rows):
        left = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        own = role[:1] if role[:1] in ("s", "u", "a") else "o"
        symbols += "x" if fault in ("blank", "duplicate") else own.upper() if fault else own
        illegal += n > 0 and rows[n - 1][1][:1] + role[:1] not in ("su", "ua", "au")
    cost, audit = min(search(symbols).values())
    out, i, q = [], 0, ""
    for e in audit:
        goes = "assistant" if q == "u" else "user"
        if e == "I":
            out.append((goes, ""))
        elif e != "D":
            out.append((rows[i][1] if e == "K" else goes, rows[i][2]))
        i += e != "I"
        q = out[-1][0][:1] if out else ""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit), out


SCHEMA = "conv_id long, turn long, role string, text string, k int, audit string, b int"


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    rows = {c: [(t, rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["Yes.", "no", " ", "", "What?", "a b\n", "é!", "ok. "])) for t in sorted(rng.sample(range(12), rng.randrange(1, 9)))] for c in range(60)}
    rows[100] = [(t, "user" if t % 2 == 0 else "assistant", f"turn {t}." if t % 11 else "cut") for t in range(3000) if t % 701]
    rows[101] = [(0, "user", "x" * 300_000 + "."), (1, "assistant", "y" * 300_000)]
    rows[None] = [(None, "user", "one."), (5, "assistant", "two."), (9, "assistant", "two.")]
    flat = [(c, *r, 7, "KK", 1) for c, own in rows.items() for r in own]
    rng.shuffle(flat)
    return rows, spark.createDataFrame(flat, SCHEMA)


def test_repair(table):
    rows, df = table
    report, repaired = repair(df)
    got = {r[0]: tuple(r)[1:] for r in report.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit").collect()}
    texts = {}
    for r in repaired.collect():
        texts.setdefault(r.conv_id, []).append((r.place, r.role, r.text))
    hashes = {r.conv_id: r.repaired_sha256 for r in digests(repaired).collect()}
    assert set(got) == set(rows)
    for c, own in rows.items():
        want, left = by_hand(own)
        assert got[c] == want, c
        assert [(n, *x) for n, x in enumerate(left)] == sorted(texts.get(c, []))
        assert GRAMMAR.match("".join(r[:1] for r, _ in left))
        if left:
            assert hashes[c] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
    assert not set(hashes) - {c for c in rows if by_hand(rows[c])[1]}


def test_repeated_rows_and_nulls(spark):
    """Equal rows are copies; nulls are one space; a row that stands there no times leaves its conversation."""
    rows = [(1, 0, "user", "a.", 2000), (1, 1, "assistant", "b.", 1), (2, 0, "user", "gone.", 0), (3, None, None, None, 1), (3, None, "user", None, 2)]
    report, repaired = repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies int"), copies_col="copies")
    got = {r.conv_id: r for r in report.collect()}
    assert (got[1].duplicate, got[1].cost, got[1].illegal, got[1].audit) == (1999, 3998, 1999, "K" + "D" * 1999 + "K")
    assert (got[2].gaps, got[2].cost, got[2].audit) == (0, 0, "")
    assert (got[3].blank, got[3].duplicate, got[3].gaps, got[3].audit, got[3].illegal) == (3, 0, 0, "DDD", 2)
    assert sorted((r.conv_id, r.place, r.role, r.text) for r in repaired.collect()) == [(1, 0, "user", "a."), (1, 1, "assistant", "b.")]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    report, repaired = repair(empty)
    assert report.count() == 0 and repaired.count() == 0 and digests(repaired).count() == 0


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(30) for t in range(5)] + [(None, None, None, None)]
    got = {(r.conv_id, r.turn): (r.role, r.text, r.copies) for r in damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        how, role, text = zlib.crc32(key.encode()) % 20, role or " ", text or " "
        want = ("user" if how == 4 else role, "" if how == 1 else "One Two Three" if how == 2 and c is not None else text, 0 if how == 0 else 2 if how == 3 else 1)
        assert got[c, t] == want


def test_sql(spark):
    """Odd tables: the SQL gives the query's rows."""
    import duckdb

    from quantalake.llm.queries import QUERIES, SQL

    rng = random.Random(9)
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, *range(9)]), rng.choice([None, "user", "assistant", "system", "Ubuntu", ""]), rng.choice([None, "", "a.", "b", "c?", "\t", "d!\n"])) for _ in range(300)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").createOrReplaceTempView("odd_conversations")
    con = duckdb.connect()
    con.register("conversations", spark.table("odd_conversations").toArrow())

    class Reader:
        read = type("R", (), {"parquet": staticmethod(lambda path: spark.table("odd_conversations"))})

    df = QUERIES["op11_conversation_repair"](Reader, "x")
    out = con.execute(SQL["op11_conversation_repair"])
    names = [c[0] for c in out.description]
    assert sorted(map(repr, out.fetchall())) == sorted(repr(tuple(r[c] for c in names)) for r in df.collect())
