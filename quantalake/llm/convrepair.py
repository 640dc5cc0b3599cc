"""Repair of the structure of conversations: the cheapest edits after which roles alternate.

A conversation is read as a lattice of nodes (turn index, grammar state). Dijkstra's search walks it without building
it: the priority of a node is (cost, audit), the audit being the initials of the edits so far, and the first popped end
node whose state accepts is the answer. At one node, audits of equal cost are never prefixes of each other (they differ
in inserted turns otherwise, which cost), so the smaller one stays the smaller one whatever follows.

The search needs a symbol a row, no text. A conversation is cut into blocks of turns; a long block is searched from
every state to every state where it lies, and what the blocks cost is put together by conversation.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantalake.llm.common import few, stored, tidy
from quantalake.llm.linedup import WHITE

#: The cost of edits, and what a truncated turn adds unless it is deleted.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: The grammar (s?(ua)+)? by states: start, after s, after u, after a. What initial leads where.
NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
ACCEPTS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
#: Turns of a block, and symbols of a piece of one; pieces of up to SHORT symbols are searched where they are joined.
BLOCK, PIECE, SHORT = 1024, 1024, 64
#: Symbols of rows: a turn to delete, else the initial of its role (other: o), in upper case if it's truncated.
GONE, OTHER = "x", "o"


def search(symbols: str, entry: int = 0, ends: tuple[int, ...] = ACCEPTS, first: bool = True) -> dict[int, tuple[int, str]]:
    """Dijkstra's search from state ``entry``: (cost, audit) by end state, of the first one popped that is among
    ``ends``, or of all that can be reached."""
    heap, seen, found = [(0, "", 0, entry)], set(), {}
    while heap:
        cost, audit, i, q = heapq.heappop(heap)
        if (i, q) in seen:
            continue
        seen.add((i, q))
        if i == len(symbols) and q in ends:
            found[q] = (cost, audit)
            if first or len(found) == len(ends):
                break
        made = [s for s in NEXT[q] if s in ROLES]
        for s in made:
            heapq.heappush(heap, (cost + INSERT, audit + "I", i, NEXT[q][s]))
        if i < len(symbols):
            own, cut = symbols[i].lower(), TRUNCATED * symbols[i].isupper()
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, q))
            if own != GONE:
                if own in NEXT[q]:
                    heapq.heappush(heap, (cost + KEEP + cut, audit + "K", i + 1, NEXT[q][own]))
                for s in made:
                    if s != own:
                        heapq.heappush(heap, (cost + REROLE + cut, audit + "R", i + 1, NEXT[q][s]))
    return found


@lru_cache(1 << 14)
def _short(symbols: str) -> tuple[int, str]:
    return min(search(symbols).values())


def crossings(symbols: str) -> list[dict[int, tuple[int, str]]]:
    """The cheapest way from every state to every state."""
    return [search(symbols, q, (0, 1, 2, 3), False) for q in range(4)]


def joined(best: dict[int, tuple[int, str]], cross: list[dict[int, tuple[int, str]]]) -> dict[int, tuple[int, str]]:
    """What the best ways so far cost after one more piece, by state."""
    out: dict[int, tuple[int, str]] = {}
    for p, (cost, audit) in best.items():
        for q, (more, tail) in cross[p].items():
            way = (cost + more, audit + tail)
            if q not in out or way < out[q]:
                out[q] = way
    return out


_PIECES = "b long, piece long, symbols string, cross array<struct<p:int,q:int,cost:long,audit:string>>, blank long, duplicate long, truncated long, illegal long, head string, tail string, low long, high long, turns long"
_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _kind(ddl: str, ident) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    return to_arrow_schema(StructType([StructField("k", ident), *StructType.fromDDL(ddl).fields]))


def _long(x: int | None) -> int | None:
    return None if x is None else (x + (1 << 63)) % (1 << 64) - (1 << 63)


class _Piece:
    """Symbols and counts of consecutive rows of a block."""

    def __init__(self, k, b, piece: int = 0, last_turn=None) -> None:
        self.k, self.b, self.piece = k, b, piece
        self.symbols, self.head, self.tail, self.illegal = [], None, None, 0
        self.blank = self.duplicate = self.truncated = self.turns = 0
        self.low = self.high = None
        self.last = last_turn

    def add(self, turn, initial: str, fault: str, n: int) -> int:
        """Add up to as many of ``n`` equal rows as there is room for; returns how many are left."""
        take = min(n, PIECE - len(self.symbols))
        again = {"blank": "blank", "duplicate": "duplicate"}.get(fault, "duplicate")
        if turn is not None and turn != self.last:
            self.turns, self.last = self.turns + 1, turn
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.head is None:
            self.head = initial
        elif self.tail + initial not in LEGAL:
            self.illegal += 1
        self.tail = initial
        self.illegal += (take - 1) * (initial + initial not in LEGAL)
        own = initial if initial in ("s", "u", "a") else OTHER
        self.symbols.append({"": own, "truncated": own.upper()}.get(fault, GONE))
        self.symbols += [GONE] * (take - 1)
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        setattr(self, again, getattr(self, again) + take - 1)
        return n - take

    def row(self) -> tuple:
        symbols = "".join(self.symbols)
        cross = None
        if len(symbols) > SHORT:
            cross = [{"p": p, "q": q, "cost": c, "audit": a} for p, ways in enumerate(crossings(symbols)) for q, (c, a) in ways.items()]
        return (self.k, self.b, self.piece, symbols, cross, self.blank, self.duplicate, self.truncated, self.illegal, self.head, self.tail, self.low, self.high, self.turns)


def _pieces(ident) -> Callable:
    kind = _kind(_PIECES, ident)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out = None, []
        for batch in few(batches, 4096):
            for k, b, turn, initial, fault, n in zip(*(batch[c].to_pylist() for c in ("k", "b", "t", "i", "fault", "n")), strict=True):
                if own is None or own.k != k or own.b != b:
                    if own is not None:
                        out.append(own.row())
                    own = _Piece(k, b)
                while n:
                    if len(own.symbols) == PIECE:
                        out.append(own.row())
                        own = _Piece(k, b, own.piece + 1, own.last)
                    left = own.add(turn, initial, fault, n)
                    fault, n = ("blank" if fault == "blank" else "duplicate"), left
            if out:
                yield _batch(out, kind)
                out = []
        if own is not None:
            yield _batch([own.row()], kind)

    return tidy(run)


def _batch(rows: list[tuple], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)


def _whole(ident) -> Callable:
    kind = _kind(_REPORT, ident)

    class Conversation:
        def __init__(self, k) -> None:
            self.k, self.pieces, self.best, self.kept = k, 0, {0: (0, "")}, None
            self.counts, self.tail, self.low, self.high, self.turns = [0, 0, 0, 0], None, None, None, 0

        def fold(self) -> None:
            """Take the piece that waited into ``best``."""
            if self.kept is not None:
                symbols, cross = self.kept
                ways = crossings(symbols) if cross is None else [{x["q"]: (x["cost"], x["audit"]) for x in cross if x["p"] == p} for p in range(4)]
                self.best, self.kept = joined(self.best, ways), None

        def add(self, r: dict) -> None:
            self.fold()
            self.kept, self.pieces = (r["symbols"], r["cross"]), self.pieces + 1
            self.counts = [a + r[c] for a, c in zip(self.counts, ("blank", "duplicate", "truncated", "illegal"), strict=True)]
            if r["head"] is not None:
                if self.tail is not None and self.tail + r["head"] not in LEGAL:
                    self.counts[3] += 1
                self.tail = r["tail"]
            if r["low"] is not None:
                self.low, self.high = r["low"] if self.low is None else self.low, r["high"]
            self.turns += r["turns"]

        def row(self) -> tuple:
            if self.pieces == 1 and self.kept[1] is None:
                cost, audit = _short(self.kept[0])
            else:
                self.fold()
                cost, audit = min(self.best[q] for q in ACCEPTS if q in self.best)
            gaps = 0 if self.low is None else _long(self.high - self.low + 1 - self.turns)
            return (self.k, gaps, *self.counts, cost, audit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out = None, []
        for batch in few(batches, 4096):
            for r in batch.to_pylist():
                if own is None or own.k != r["k"]:
                    if own is not None:
                        out.append(own.row())
                    own = Conversation(r["k"])
                own.add(r)
            if out:
                yield _batch(out, kind)
                out = []
        if own is not None:
            yield _batch([own.row()], kind)

    return tidy(run)


def _applied(ident) -> Callable:
    kind = _kind("place long, role string, text string", ident)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, q, place, out, held = "", 0, 0, 0, [], 0

        def made() -> None:
            """Inserted turns that come next."""
            nonlocal at, q, place
            while at < len(audit) and audit[at] == "I":
                s = next(s for s in NEXT[q] if s in ROLES)
                out.append((k, place, ROLES[s], ""))
                at, q, place = at + 1, NEXT[q][s], place + 1

        k = None
        for batch in few(batches, 256):
            for k_, edits, role, text, n in zip(*(batch[c].to_pylist() for c in ("k", "audit", "role", "text", "n")), strict=True):
                if edits is not None:  # a new conversation
                    k, audit, at, q, place = k_, edits, 0, 0, 0
                    made()
                    continue
                for _ in range(n):
                    edit = audit[at]
                    at += 1
                    if edit != "D":
                        own = ROLES[next(s for s in NEXT[q] if s in ROLES)] if edit == "R" else role
                        out.append((k, place, own, text))
                        held += len(text)
                        q, place = NEXT[q][own[:1]], place + 1
                    made()
                if held > 4 << 20:
                    yield _batch(out, kind)
                    out, held = [], 0
            if out:
                yield _batch(out, kind)
                out, held = [], 0

    return tidy(run)


def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def repair(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The cheapest edits that make each conversation's role initials (s?(ua)+)?, and what they leave.

    Returns (report, repaired). report: id_col, gaps, blank, duplicate, truncated, illegal, cost (long), audit: a row a
    conversation. repaired: id_col, place (long, from 0), role, text; a conversation's rows lie in one partition, one
    after the other by place.

    A row's first fault counts: blank (nothing but ASCII white space), duplicate (role and text seen earlier in the
    conversation), truncated (its last visible character isn't one of . ! ?). Keep costs 0, Rerole to user or assistant
    1, Delete 2 (blank and duplicate rows must go), Insert of an empty user or assistant turn 5; truncated rows that
    stay add 5. The audit has the initials of the cheapest edits, the smallest in ASCII among equals. gaps: highest -
    lowest turn + 1 - distinct turns (nulls ignored; 0 without turns). illegal: neighbours whose initials aren't su, ua
    or au.

    ``copies_col``: how often a row stands there, one copy after the other (0: the conversation is known, the row
    isn't there).

    Defined cases: rows are taken by turn, nulls first, then by a hash of role and text; a null role or text is one
    space; a null id is a conversation; one without rows has zeros and an empty audit; very long conversations are
    searched in blocks of 1024 turns; other columns are ignored; an empty table gives none. Equal roles and texts are
    told by 128 bits of hash.

    Plan: rows are told apart by hashes, equal ones counted before the shuffle, and dealt over tasks by (conversation,
    block), so one that holds a third of all rows is searched by many tasks. Only what its blocks cost meets in one, as
    a stream. Texts are shuffled once, to be edited as a stream in order. An audit is one value, with a letter a row.
    """
    ident = turns.schema[id_col].dataType
    n = F.lit(1) if copies_col is None else F.col(f"`{copies_col}`")
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (role_col, text_col))
    rows = turns.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{turn_col}`").cast("long").alias("t"), role.alias("role"), text.alias("text"), n.cast("long").alias("n"))
    rows = rows.withColumn("h", F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))))
    seen = F.rtrim("text", F.lit(WHITE))
    look = F.when(seen == "", "blank").when(F.right(seen, F.lit(1)).isin(".", "!", "?"), "").otherwise("truncated")
    known = rows.select("k", "t", "h", _initial(F.col("role")).alias("i"), look.alias("look"), "n")
    known = stored(known.groupBy("k", "t", "h").agg(F.first("i").alias("i"), F.first("look").alias("look"), F.sum("n").alias("n")), "turns")
    earliest = known.where("n > 0 and look <> 'blank'").groupBy("k", "h").agg(F.min(F.struct(F.col("t").isNotNull().alias("some"), "t")).alias("e"))
    earliest = earliest.select(F.col("k").alias("k1"), F.col("h").alias("h1"), F.col("e.t").alias("t1"))
    same = F.col("k").eqNullSafe(F.col("k1")) & (F.col("h") == F.col("h1")) & F.col("t").eqNullSafe(F.col("t1"))
    fault = F.when(F.col("look") == "blank", "blank").when(F.col("h1").isNull(), "duplicate").otherwise(F.col("look"))
    marked = known.join(earliest, same, "left").select("k", F.floor(F.col("t") / BLOCK).cast("long").alias("b"), "t", "h", "i", fault.alias("fault"), "n")
    pieces = marked.repartition("k", "b").sortWithinPartitions("k", "b", "t", "h").drop("h").mapInArrow(_pieces(ident), _ddl(turns, id_col, _PIECES))
    report = pieces.repartition("k").sortWithinPartitions("k", "b", "piece").mapInArrow(_whole(ident), _ddl(turns, id_col, _REPORT))
    report = stored(report, "audits")
    none = lambda kind: F.lit(None).cast(kind)
    edits = report.select("k", "audit", none("long").alias("t"), none("binary").alias("h"), none("string").alias("role"), none("string").alias("text"), none("long").alias("n"))
    told = rows.where("n > 0").select("k", none("string").alias("audit"), "t", "h", "role", "text", "n")
    stream = edits.unionByName(told).repartition("k").sortWithinPartitions("k", F.col("audit").isNull(), "t", "h").drop("t", "h")
    repaired = stream.mapInArrow(_applied(ident), _ddl(turns, id_col, "place long, role string, text string"))
    return report.withColumnRenamed("k", id_col), repaired.withColumnRenamed("k", id_col)


def _ddl(turns: DataFrame, id_col: str, rest: str) -> str:
    return f"k {turns.schema[id_col].dataType.simpleString()}, {rest}"


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies of the rows of ``turns``, damaged by the crc32 of ``conv_id:turn`` modulo
    20: 0 drops the row, 1 empties its text, 2 removes its . ! and ?, 3 repeats it, 4 makes it the user's. Nulls of
    role and text are one space, as are those in what is hashed."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20))
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), how.alias("how"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("how") == 0, 0).when(F.col("how") == 3, 2).otherwise(1).alias("copies"),
    )


def digests(repaired: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """id_col and repaired_sha256: the hash of each conversation's ``role:text`` lines, read as a stream from where
    ``repair`` left them."""
    kind = _kind("repaired_sha256 string", repaired.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, state, out = None, None, []
        for batch in few(batches, 256):
            for own, place, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place == 0:
                    if state is not None:
                        out.append((k, state.hexdigest()))
                    k, state = own, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if out:
                yield _batch(out, kind)
                out = []
        if state is not None:
            yield _batch([(k, state.hexdigest())], kind)

    return repaired.select(id_col, "place", "role", "text").mapInArrow(tidy(run), _ddl(repaired, id_col, "repaired_sha256 string")).withColumnRenamed("k", id_col)
