"""Product codes of vectors: a codebook a part by Lloyd's rounds, with heaps that skip what can't have changed.

A part's slack is its distance to the second nearest entry less that to the nearest. While an entry and its rivals move,
slack shrinks by no more than they move together, so a part needs a new look only when the movement since its last look
has used its slack up. Each block of vectors keeps a heap an entry of its parts, by slack plus the movement that the
entry had seen before; a round pops what lies below the movement seen by now, compares these parts with all entries
again, and pushes them to the heap of what is nearest. Entries, movements and sums are integers or bounded sums of their
roots, so codes are those of plain rounds over all parts.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quantalake.llm.common import discard, stored, tidy

#: Vectors of a block, and of a comparison with all entries.
BLOCK, CHUNK = 1 << 14, 1 << 12
#: Components beyond this have squares whose sums could leave 64 bits.
LARGEST = 1 << 24
#: Distances are roots of whole numbers below 2**53; their errors are far below this.
MARGIN = 1e-3


def components(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, as integers (rounded down, below zero too)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each row (the lowest index among equals), its squared distance, and that of the next one
    (infinite if there's none). Exact: whole numbers in doubles, or in 64 bits where doubles don't hold them."""
    near, first, second = np.empty(len(x), np.int64), np.empty(len(x)), np.full(len(x), np.inf)
    small = x.shape[1] * 4.0 * max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)) ** 2 < 2.0**53
    e = entries.astype(np.float64)
    norms = (e * e).sum(1)
    for a in range(0, len(x), CHUNK if small else 64):
        own = x[a : a + (CHUNK if small else 64)]
        if small:
            f = own.astype(np.float64)
            d = norms - 2.0 * (f @ e.T) + (f * f).sum(1)[:, None]
        else:
            d = ((own.astype(np.int64)[:, None, :] - entries[None]) ** 2).sum(2)
        rows, at = np.arange(len(own)), slice(a, a + len(own))
        near[at] = d.argmin(1)
        first[at] = d[rows, near[at]]
        if d.shape[1] > 1:
            d[rows, near[at]] = np.iinfo(np.int64).max if d.dtype == np.int64 else np.inf
            second[at] = d.min(1)
    return near, first, second


class Heaps:
    """A heap an entry of (slack + movement seen, row), as arrays: each heap lies in one piece, in heap order."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> None:
        self.keys, self.rows, self.ends = keys, rows, np.cumsum(sizes)
        self.sizes, self.open = sizes, {}

    @classmethod
    def of(cls, keys: np.ndarray, near: np.ndarray, entries: int) -> Heaps:
        order = np.lexsort((keys, near))  # ascending keys are a heap
        return cls(keys[order], order.astype(np.int32), np.bincount(near, minlength=entries))

    def heap(self, entry: int) -> list:
        if entry not in self.open:
            a, b = self.ends[entry] - self.sizes[entry], self.ends[entry]
            self.open[entry] = list(zip(self.keys[a:b].tolist(), self.rows[a:b].tolist(), strict=True))
        return self.open[entry]

    def pop(self, seen: np.ndarray) -> np.ndarray:
        """Rows whose slack the movement ``seen`` by their entry may have used up."""
        out, used = [], np.flatnonzero(self.sizes)
        tops = self.keys[self.ends[used] - self.sizes[used]]
        for entry in used[tops < seen[used] + MARGIN].tolist():
            heap, limit = self.heap(entry), seen[entry] + MARGIN
            while heap and heap[0][0] < limit:
                out.append(heapq.heappop(heap)[1])
        return np.array(sorted(out), np.int64)

    def push(self, keys: np.ndarray, rows: np.ndarray, near: np.ndarray) -> None:
        for key, row, entry in zip(keys.tolist(), rows.tolist(), near.tolist(), strict=True):
            heapq.heappush(self.heap(entry), (key, row))

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, rows, sizes = [], [], self.sizes.copy()
        for entry in range(len(sizes)):
            if entry in self.open:
                own = self.open[entry]
                sizes[entry] = len(own)
                keys.append(np.array([k for k, _ in own], np.float64))
                rows.append(np.array([r for _, r in own], np.int32))
            else:
                a, b = self.ends[entry] - sizes[entry], self.ends[entry]
                keys.append(self.keys[a:b])
                rows.append(self.rows[a:b])
        return np.concatenate(keys), np.concatenate(rows), sizes


class Books:
    """The codebooks on the driver: a few thousand entries, with the sums of their parts and the movement seen."""

    def __init__(self, first: np.ndarray, parts: int) -> None:
        self.parts, self.entries = parts, len(first)
        self.books = [np.ascontiguousarray(b) for b in np.split(first.astype(np.int64), parts, axis=1)]
        self.counts = np.zeros((parts, self.entries), np.int64)
        self.sums = [np.zeros_like(b) for b in self.books]
        self.seen = np.zeros((parts, self.entries))

    def move(self, deltas: list) -> None:
        """Add what changed (part, entry, count, sums) and move each used entry to the floor of its parts' mean."""
        for part, entry, count, *sums in deltas:
            self.counts[part, entry] += count
            self.sums[part][entry] += np.array(sums, np.int64)
        for p in range(self.parts):
            used, book = self.counts[p] > 0, self.books[p].copy()
            book[used] = self.sums[p][used] // self.counts[p][used][:, None]
            drift = np.sqrt(((book - self.books[p]).astype(np.float64) ** 2).sum(1))
            top = np.sort(drift)[::-1]
            rival = np.full(self.entries, top[0])
            rival[drift.argmax()] = top[1] if self.entries > 1 else 0.0
            self.seen[p] += drift + rival
            self.books[p] = book

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()


_STATE = "parts binary, width int, near binary, keys binary, heap_rows binary, sizes binary, part int, entry int, n long, sums array<long>"


def _state_schema(df: DataFrame, id_col: str, label_col: str) -> StructType:
    ident, label = (df.schema[c].dataType.simpleString() for c in (id_col, label_col))
    return StructType.fromDDL(f"ids array<{ident}>, labels array<{label}>, {_STATE}")


class _Sums:
    """Sums over the blocks of a task."""

    def __init__(self, books: Books) -> None:
        self.books, self.counts, self.sums = books, np.zeros_like(books.counts), [np.zeros_like(b) for b in books.books]

    def add(self, p: int, near: np.ndarray, x: np.ndarray, sign: int) -> None:
        self.counts[p] += sign * np.bincount(near, minlength=self.books.entries)
        for c in range(x.shape[1]):  # whole numbers far below 2**53
            self.sums[p][:, c] += sign * np.bincount(near, weights=x[:, c], minlength=self.books.entries).astype(np.int64)

    def rows(self) -> list[dict]:
        changed = [(p, e) for p in range(self.books.parts) for e in np.flatnonzero((self.counts[p] != 0) | (self.sums[p] != 0).any(1)).tolist()]
        return [{"part": p, "entry": e, "n": int(self.counts[p][e]), "sums": self.sums[p][e].tolist()} for p, e in changed]


def _pack(x: np.ndarray, near: list, heaps: list[Heaps]) -> dict:
    kind = next(k for k in (np.int16, np.int32, np.int64) if np.abs(x).max(initial=0) <= np.iinfo(k).max)
    arrays = [h.arrays() for h in heaps]
    blob = lambda k: b"".join(a[k].tobytes() for a in arrays)
    return {"parts": x.astype(kind).tobytes(), "width": np.dtype(kind).itemsize, "near": np.stack(near).astype(np.int32).tobytes(), "keys": blob(0), "heap_rows": blob(1), "sizes": blob(2)}


def _vectors(row: dict) -> np.ndarray:
    return np.frombuffer(row["parts"], {2: np.int16, 4: np.int32, 8: np.int64}[row["width"]]).reshape(len(row["ids"]), -1)


def _begin(books: Books, schema: pa.Schema) -> Callable:
    """Blocks of vectors, every part compared with all entries."""

    def block(ids: list, labels: list, x: np.ndarray, sums: _Sums) -> dict:
        near, heaps = [], []
        for p, own in enumerate(np.split(x, books.parts, axis=1)):
            at, first, second = nearest(own, books.books[p])
            sums.add(p, at, own, 1)
            near.append(at)
            heaps.append(Heaps.of(np.sqrt(second) - np.sqrt(first) + books.seen[p][at], at, books.entries))
        return {"ids": ids, "labels": labels, **_pack(x, near, heaps)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held, n = _Sums(books), [], 0

        def made() -> pa.RecordBatch:
            ids, labels = (sum((b[c].to_pylist() for b in held), []) for c in ("i", "l"))
            x = np.concatenate([np.asarray(b["v"].flatten()).reshape(b.num_rows, -1) for b in held])
            return pa.RecordBatch.from_pylist([block(ids, labels, x, sums)], schema)

        for batch in batches:
            while batch.num_rows:
                own, batch = batch.slice(0, BLOCK - n), batch.slice(min(batch.num_rows, BLOCK - n))
                held.append(own)
                n += own.num_rows
                if n == BLOCK:
                    yield made()
                    held, n = [], 0
        if held:
            yield made()
        yield pa.RecordBatch.from_pylist(sums.rows(), schema)

    return tidy(run)


def _looked_again(row: dict, books: Books, sums: _Sums | None) -> tuple[np.ndarray, np.ndarray, list[Heaps]]:
    """The block's vectors and the nearest entries of its parts, after the parts whose slack is used up were compared
    with all entries again."""
    x = _vectors(row)
    near = np.frombuffer(row["near"], np.int32).reshape(books.parts, -1).copy()
    keys, rows = np.frombuffer(row["keys"]).reshape(books.parts, -1), np.frombuffer(row["heap_rows"], np.int32).reshape(books.parts, -1)
    sizes, heaps = np.frombuffer(row["sizes"], np.int64).reshape(books.parts, -1), []
    for p, own in enumerate(np.split(x, books.parts, axis=1)):
        heap = Heaps(keys[p], rows[p], sizes[p])
        popped = heap.pop(books.seen[p])
        if len(popped):
            parts = own[popped]
            at, first, second = nearest(parts, books.books[p])
            heap.push(np.sqrt(second) - np.sqrt(first) + books.seen[p][at], popped, at)
            moved = at != near[p][popped]
            if sums is not None and moved.any():
                sums.add(p, near[p][popped][moved], parts[moved], -1)
                sums.add(p, at[moved], parts[moved], 1)
            near[p][popped] = at
        heaps.append(heap)
    return x, near, heaps


def _round(books: Books, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums(books)
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                x, near, heaps = _looked_again(row, books, sums)
                yield pa.RecordBatch.from_pylist([{"ids": row["ids"], "labels": row["labels"], **_pack(x, list(near), heaps)}], schema)
        yield pa.RecordBatch.from_pylist(sums.rows(), schema)

    return tidy(run)


def _end(books: Books, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                x, near, _ = _looked_again(row, books, None)
                error = np.zeros(len(x), np.int64)
                for p, own in enumerate(np.split(x, books.parts, axis=1)):
                    error += ((own.astype(np.int64) - books.books[p][near[p]]) ** 2).sum(1)
                digits = max(2, len(f"{books.entries - 1:x}"))
                codes = ["".join(f"{e:0{digits}x}" for e in own) for own in near.T.tolist()]
                columns = [pa.array(row["ids"], schema.types[0]), pa.array(row["labels"], schema.types[1]), pa.array(codes), pa.array(error)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return tidy(run)


def vector_codes(df: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Books | None]:
    """A code a vector, from a codebook a part.

    Returns (codes, books). codes: id_col, label_col, code (the indexes of the nearest entries in the order of the parts,
    two hex digits each or as many as ``entries`` needs), error (long: squared distances summed over parts). books:
    the final entries in ``books.books[part][entry]``, ``books.digest()`` their hash; None if no vector has a code.

    Components become floor(scale * x). The codebooks start as the parts of the vectors with the ``entries`` smallest
    ids. A round assigns every part to its nearest entry (squared Euclidean distance, the lower index among equals) and
    moves each entry to the componentwise floor of its parts' mean; an entry without parts stays. After the rounds
    parts are assigned once more.

    Defined cases: vectors that are null or hold a null, NaN or infinite component are dropped; the smallest kept id
    (nulls last, equal ids by components) gives the length of vectors: those of another length, all if ``parts`` don't
    divide it, and those with a component beyond 2**24 after scaling have a null code and error and take no part;
    repeated ids and vectors each have a code; fewer vectors than ``entries`` give as many entries; other columns are
    ignored; an empty table gives none.

    Plan: one pass over blocks a round, without a shuffle; a task adds up what its blocks moved, a row an entry of a
    part, and the sums of all tasks (at most parts x entries rows) come to the driver, which moves the entries. Blocks
    are stored each round, so a lost executor repeats a round's block, not the rounds before.
    """
    vector = F.col(f"`{vector_col}`")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = df.where(F.coalesce(fine, F.lit(False))).select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{label_col}`").alias("l"), components(vector, scale).alias("v"))
    out = StructType.fromDDL(f"i {df.schema[id_col].dataType.simpleString()}, l {df.schema[label_col].dataType.simpleString()}, code string, error long")
    by_id = [F.col("i").asc_nulls_last(), "v"]
    head = kept.orderBy(*by_id).select(F.size("v").alias("n")).first()
    length = head.n if head is not None and head.n % parts == 0 else -1
    usable = (F.size("v") == length) & F.forall("v", lambda x: F.abs(x) <= LARGEST)
    none = kept.where(~usable).select("i", "l", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    good = kept.where(usable)
    first = good.orderBy(*by_id).limit(entries).select("v").collect()
    if not first:
        return none.toDF(id_col, label_col, "code", "error"), None
    books = Books(np.array([r.v for r in first], np.int64).reshape(len(first), length), parts)
    kind = _state_schema(df, id_col, label_col)
    schema, state = to_arrow_schema(kind), None
    for _ in range(rounds):
        step = good.mapInArrow(_begin(books, schema), kind) if state is None else state.where("parts is not null").mapInArrow(_round(books, schema), kind)
        before, state = state, stored(step, "codes")
        moved = state.where("part is not null").groupBy("part", "entry").agg(F.sum("n"), *[F.sum(F.col("sums")[c]) for c in range(length // parts)])
        books.move(moved.collect())
        if before is not None:
            discard(before)
    if state is None:
        state = good.mapInArrow(_begin(books, schema), kind)
    codes = state.where("parts is not null").mapInArrow(_end(books, to_arrow_schema(out)), out)
    return codes.unionByName(none).toDF(id_col, label_col, "code", "error"), books


def label_errors(codes: DataFrame, label_col: str = "label") -> DataFrame:
    """``codes`` with label_error: the error summed over equal labels, nulls together."""
    total = codes.groupBy(F.col(f"`{label_col}`").alias("l")).agg(F.sum("error").alias("label_error"))
    return codes.join(total, F.col(f"`{label_col}`").eqNullSafe(F.col("l")), "left").drop("l")
