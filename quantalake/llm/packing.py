"""Packing documents into sequences of fixed length: patterns of few documents, fitted by non-negative least squares.

The histogram of piece lengths has at most ``seq_len`` entries, whatever the corpus; the fit works on it alone. The
lengths are put in ``BINS`` bins, patterns of one to ``PARTS`` bins that fill a sequence are enumerated, and repeat
counts are fitted so that the patterns use up the histogram. Rounded down, each pattern takes documents of its bins,
the last one as long as still fits. What is left is packed best-fit, longest first, into the space left and into new
sequences. Both steps work on runs (so many sequences of the same lengths), so they too cost the same at every size.
Pieces then get their places by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantalake.llm.common import release, stored, tidy
from quantalake.llm.tokens import Encoder, blocks, kind_of

BINS, PARTS = 128, 4


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 600) -> np.ndarray:
    """x >= 0 that makes |a x - b| least, by an active set: the best column comes in, columns below zero go out."""
    x, inside = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    least = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(steps):
        gain = a.T @ (b - a @ x)
        gain[inside] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= least:
            break
        inside[best] = True
        while inside.any():
            cols = np.flatnonzero(inside)
            z = np.linalg.lstsq(a[:, cols], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[cols] = z
                break
            low = z <= 0
            part = float((x[cols][low] / (x[cols][low] - z[low] + 1e-300)).min())
            x[cols] += part * (z - x[cols])
            out = cols[low & (x[cols] <= 1e-9 * max(1.0, x.max()))]
            x[out], inside[out] = 0, False
            if not len(out):  # rounding: the smallest goes
                worst = cols[low][int(np.argmin(x[cols][low]))]
                x[worst], inside[worst] = 0, False
    return x


def patterns(bins: int, parts: int, present: set[int]) -> list[tuple[int, ...]]:
    """Descending bin numbers, one to ``parts`` of them, that sum to ``bins``; of bins that have documents."""
    found, have = [], sorted(present, reverse=True)

    def extend(head: tuple[int, ...], left: int) -> None:
        if left == 0:
            found.append(head)
        elif len(head) < parts:
            for b in have:
                if b <= left and (not head or b <= head[-1]) and b * (parts - len(head)) >= left:
                    extend((*head, b), left - b)

    extend((), bins)
    return found


def plan(histogram: dict[int, int], seq_len: int, bins: int = BINS, parts: int = PARTS) -> list[tuple[tuple[int, ...], int]]:
    """Runs: (lengths that share a sequence, number of such sequences). They use up the histogram exactly."""
    count = np.zeros(seq_len + 1, np.int64)
    for length, n in histogram.items():
        count[length] += n
    runs: list[tuple[tuple[int, ...], int]] = []
    if count[seq_len]:
        runs.append(((seq_len,), int(count[seq_len])))
        count[seq_len] = 0
    bins = min(bins, seq_len)
    top = np.array([b * seq_len // bins for b in range(bins + 1)])
    of = np.searchsorted(top, np.arange(seq_len + 1))
    by_bin = np.bincount(of, count, minlength=bins + 1)
    todo = patterns(bins, parts, {b for b in range(1, bins + 1) if by_bin[b]})
    if todo:
        a = np.zeros((bins + 1, len(todo)))
        for k, pattern in enumerate(todo):
            for b in pattern:
                a[b, k] += 1
        fitted = nnls(a, by_bin)
        for k in np.argsort(-fitted, kind="stable"):
            if fitted[k] >= 1:
                _realise(todo[k], int(fitted[k]), count, top, seq_len, runs)
    return _best_fit(runs, count, seq_len)


def _realise(pattern: tuple[int, ...], repeats: int, count: np.ndarray, top: np.ndarray, seq_len: int, runs: list) -> None:
    while repeats > 0:
        lengths: list[int] = []
        for k, b in enumerate(pattern):
            high = seq_len - sum(lengths) if k == len(pattern) - 1 else int(top[b])
            low = int(top[b - 1])
            free = count[low + 1 : high + 1].copy()
            for x in lengths:
                if low < x <= high:
                    free[x - low - 1] -= 1
            there = np.flatnonzero(free > 0)
            if not len(there):
                return
            lengths.append(low + 1 + int(there[-1]))
        n = min(repeats, *(int(count[x]) // lengths.count(x) for x in lengths))
        for x in lengths:
            count[x] -= n
        runs.append((tuple(lengths), n))
        repeats -= n


def _best_fit(runs: list, count: np.ndarray, seq_len: int) -> list[tuple[tuple[int, ...], int]]:
    space: dict[int, list] = {}
    for lengths, n in runs:
        space.setdefault(seq_len - sum(lengths), []).append((lengths, n))
    for length in range(seq_len, 0, -1):
        left = int(count[length])
        while left:
            fits = min((s for s in space if s >= length), default=None)
            if fits is None:
                each = seq_len // length
                if left >= each:
                    full, left = divmod(left, each)
                    space.setdefault(seq_len - each * length, []).append(((length,) * each, full))
                if left:
                    space.setdefault(seq_len - left * length, []).append(((length,) * left, 1))
                    left = 0
                break
            lengths, n = space[fits].pop()
            if not space[fits]:
                del space[fits]
            take = min(n, left)
            if n > take:
                space.setdefault(fits, []).append((lengths, n - take))
            space.setdefault(fits - length, []).append(((*lengths, length), take))
            left -= take
    return [run for same in space.values() for run in same]


def token_pieces(docs: DataFrame, tokenizer_path: str, seq_len: int, end_id: int, id_col: str, text_col: str, keep_ids: bool) -> DataFrame:
    """The ids of each text and ``end_id``, cut into pieces of at most ``seq_len``."""
    kind = kind_of(tokenizer_path)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = Encoder(tokenizer_path, kind), int(end_id).to_bytes(4, "little")
        for block in (part for whole in batches for part in blocks(whole, 1)):
            row, piece, length, crc, flat = array("i"), array("i"), array("q"), array("q"), []
            for n, ids in enumerate(own.encode(block[1])):
                ids = ids.tobytes() + end
                for k, at in enumerate(range(0, len(ids), 4 * seq_len)):
                    part = ids[at : at + 4 * seq_len]
                    row.append(n)
                    piece.append(k)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        flat.append(part)
            own_piece, own_length = np.frombuffer(piece, np.int32), np.frombuffer(length, np.int64)
            columns = [block[0].take(pa.array(np.frombuffer(row, np.int32))), pa.array(own_piece), pa.array(own_piece.astype(np.int64) * seq_len), pa.array(own_length), pa.array(np.frombuffer(crc, np.int64))]
            if keep_ids:
                offsets = np.concatenate([[0], np.cumsum(own_length)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(flat), "<i4"))))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])
            release()

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("t")).mapInArrow(tidy(cut), schema)


def pack(docs: DataFrame, tokenizer_path: str, seq_len: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pack all documents into as few sequences of at most ``seq_len`` ids as the fit finds.

    Returns a row a piece: doc_id, piece (from 0), start, length, ids_crc32, sequence_id, offset, and ``ids`` on
    request; ``sequences`` puts the ids of a sequence together. Only longer documents are cut.

    Defined cases: a null or empty text is the end id alone; null and repeated document ids are packed like others;
    other columns are ignored; an empty table gives no rows.

    The driver gets the histogram (at most ``seq_len`` rows) and sends back the runs, of which there are a few
    thousand at most. Ranks among pieces of equal length come from counts by (length, slot) and a window within the
    slot, so one very frequent length is spread over as many tasks as there are slots.
    """
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, tokenizer_path, seq_len, end_id, id_col, text_col, keep_ids), "pieces")
    slots = int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    pieces = pieces.withColumn("slot", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slots)).cast("int"))
    by_slot = stored(pieces.groupBy("length", "slot").agg(F.count("*").alias("n")), "slots")
    histogram = {r.length: r.n for r in by_slot.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # seq_len rows at most
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = by_slot.select("length", "slot", before.alias("base"))
    nth = F.row_number().over(Window.partitionBy("length", "slot").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("nth", nth).join(bases, ["length", "slot"]).withColumn("rank", F.col("base") + F.col("nth")).drop("slot", "nth", "base")

    keys, starts, firsts, offsets = _places(plan(histogram, seq_len))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("length", "rank"))
            at = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            columns = {n: batch.column(n) for n in batch.schema.names if n != "rank"}
            columns |= {"sequence_id": pa.array(firsts[at] + rank - starts[at]), "offset": pa.array(offsets[at])}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    names = [c for c in ranked.columns if c != "rank"] + ["sequence_id", "offset"]
    kinds = dict(ranked.dtypes) | {"sequence_id": "bigint", "offset": "bigint"}
    placed = ranked.mapInArrow(tidy(place), ", ".join(f"{n} {kinds[n]}" for n in names))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids)


def _places(runs: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Sorted keys (length, first rank) of the intervals of ranks, and first rank, first sequence and offset of each."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, n in runs:
        offset = 0
        for x in lengths:
            start = used.get(x, 0)
            rows.append(((x << 48) + start, start, sequence, offset))
            used[x] = start + n
            offset += x
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return tuple(table[:, k].copy() for k in range(4))


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and the ids of its pieces in their order; ``pieces`` comes from ``pack(..., keep_ids=True)``."""
    own = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(own, lambda x: x["ids"])).alias("ids"))
