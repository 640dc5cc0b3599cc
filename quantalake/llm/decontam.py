"""Benchmark decontamination by greedy string tiling.

1. Seeds: each item's runs of ``tile`` words, by Karp-Rabin hash. An item keeps its rarest ones: the most frequent go,
   as long as the words under them are too few to cover the item. So a text that covers it has one of those kept, and a
   phrase that many items share makes no pairs by itself.
2. Texts send the seeds that a bitmap of the kept ones lets through, and a join by hash finds the items. Pairs whose
   seeds can't reach the coverage end here.
3. Both texts of the pairs that are left are compared word by word: the longest common run is marked in both, what
   others lose to it is cut off or split, and so on until no unmarked run of ``tile`` words is left. The share of the
   item's words that are marked is its coverage; passages in another order still add up.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantalake.llm.common import OWN, WordHashes, blobs, few, stored, tidy, window_hashes

TILE, COVERAGE = 5, 0.6
#: The bitmap of seeds has about BITS bits a seed, and at most 2**MOST_BITS (4 MB) whatever the benchmark's size; one
#: that is too full lets more through to the join, nothing else.
BITS, MOST_BITS = 16, 25
#: Matching places of two texts that are expanded at a time.
PLACES = 1 << 19
_MARKS = b".,;:!?()[]{}\"'"


def tokens(text: bytes | None) -> list[bytes]:
    """Words at ASCII white space, A-Z in lower case, without marks at their ends; words of marks alone go."""
    return [w for x in (text or b"").lower().split() if (w := x.strip(_MARKS))]


def common_runs(text: np.ndarray, item: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(place in text, place in item, words) of the longest common runs of two arrays of numbers, on each diagonal.

    Runs of ``least`` are found by hash and compared; a part of the text at a time, so that repetitive texts take memory
    for their runs only.
    """
    a, b = window_hashes(text.astype(np.uint64), least), window_hashes(item.astype(np.uint64), least)
    order = np.argsort(b, kind="stable")
    ordered = b[order]
    low, n = np.searchsorted(ordered, a, "left"), np.searchsorted(ordered, a, "right")
    n -= low
    some = np.flatnonzero(n)
    before = np.concatenate([[0], np.cumsum(n[some])])
    parts, at = [np.zeros((0, 3), np.int64)], 0
    while at < len(some):
        end = max(at + 1, int(np.searchsorted(before, before[at] + PLACES, "right")) - 1)
        own = some[at:end]
        i = np.repeat(own, n[own])
        j = order[np.repeat(low[own] - (before[at:end] - before[at]), n[own]) + np.arange(len(i))]
        same = np.ones(len(i), bool)
        for k in range(least):
            same &= text[i + k] == item[j + k]
        i, j = i[same], j[same]
        by = np.lexsort((i, i - j))
        i, d = i[by], (i - j)[by]
        starts = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1)])[: len(i)])
        ends = np.append(starts[1:], len(i))[: len(starts)] - 1
        parts.append(np.stack([d[starts], i[starts], i[ends]], axis=1))
        at = end
    runs = np.concatenate(parts)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    new = np.flatnonzero(np.concatenate([[True], (runs[1:, 0] != runs[:-1, 0]) | (runs[1:, 1] != runs[:-1, 2] + 1)])[: len(runs)])
    ends = np.append(new[1:], len(runs))[: len(new)] - 1
    first = runs[new, 1]
    return zip(first.tolist(), (first - runs[new, 0]).tolist(), (runs[ends, 2] - first + least).tolist(), strict=True)


def tiles(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of two arrays of word numbers: (place in text, place in item, words) of each tile, in the order in
    which they are marked: the longest, of equal ones the first in the text, of these the first in the item."""
    least = min(least, len(item))
    if not least or len(text) < least:
        return []
    heap = [(-n, x, y) for x, y, n in common_runs(text, item, least)]
    heapq.heapify(heap)
    in_text, in_item, found = np.zeros(len(text), bool), np.zeros(len(item), bool), []
    while heap:
        n, x, y = heapq.heappop(heap)
        n = -n
        free = ~(in_text[x : x + n] | in_item[y : y + n])
        if free.all():
            in_text[x : x + n] = in_item[y : y + n] = True
            found.append((x, y, n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if e - s >= least:
                heapq.heappush(heap, (s - e, x + s, y + s))
    return found


def kept_seeds(counts: np.ndarray, places: np.ndarray, n: int, size: int, coverage: float) -> tuple[np.ndarray, int]:
    """Which seeds of an item of ``n`` words it keeps, and how many words lie under the others: the most frequent ones
    go, as many as leave these words below ``coverage``."""
    order = np.lexsort((places, -counts))

    def under(m: int) -> int:
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, places[order[:m]], 1)
        np.add.at(edge, places[order[:m]] + size, -1)
        return int(np.count_nonzero(np.cumsum(edge[:-1])))

    low, high = 0, len(order)  # ``low`` may go, ``high`` may not
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if under(middle) / n < coverage else (low, middle)
    kept = np.ones(len(order), bool)
    kept[order[:low]] = False
    return kept, under(low)


def _text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a text."""
    return [F.xxhash64(text).alias(f"{OWN}a"), F.xxhash64(F.lit(1), text).alias(f"{OWN}b")]


_A, _B = f"{OWN}a", f"{OWN}b"
_NAMES = ["k", "i", "n", "size", "place", "h"]


def _seeds(items: DataFrame, tile: int) -> DataFrame:
    """k, i (a hash of the text), n (words), size (words of a seed), place and h of each seed of items k, i, t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in few(batches, 64):
            for row, text in enumerate(blobs(batch[2])):
                own = words.of(tokens(text))
                if len(own):
                    size = min(tile, len(own))
                    h = window_hashes(own, size)
                    same = pa.array(np.full(len(h), row, np.int32))
                    columns = [batch[0].take(same), batch[1].take(same), *(pa.array(np.full(len(h), x, np.int32)) for x in (len(own), size)), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(h.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=_NAMES)

    return items.mapInArrow(tidy(run), "k long, i long, n int, size int, place int, h long")


def _chosen(seeds: DataFrame, coverage: float) -> DataFrame:
    """The seeds that items keep, with ``free``: the words under the others."""

    def choose(table: pa.Table) -> pa.Table:
        count, place = (table[c].to_numpy() for c in ("count", "place"))
        kept, free = kept_seeds(count, place, table["n"][0].as_py(), table["size"][0].as_py(), coverage)
        own = table.filter(pa.array(kept)).select(_NAMES)
        return own.append_column("free", pa.array(np.full(len(own), free, np.int32)))

    counts = seeds.groupBy("h").agg(F.count("*").alias("count"))
    return seeds.join(counts, "h").groupBy("k", "i").applyInArrow(choose, "k long, i long, n int, size int, place int, h long, free int")


def _bitmap(seeds: DataFrame, total: int) -> np.ndarray:
    """A bit for each hash, by its low bits. Its size has a bound, and so has what the driver gets."""
    bits = min(1 << MOST_BITS, max(1 << 10, 1 << (BITS * total).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits >> 3, np.uint8)
        for batch in batches:
            at = batch[0].to_numpy().view(np.uint64) & np.uint64(bits - 1)
            np.bitwise_or.at(own, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(bits >> 3, np.uint8)
    for row in seeds.select("h").coalesce(8).mapInArrow(tidy(run), "bits binary").toLocalIterator():
        out |= np.frombuffer(row.bits, np.uint8)
    return out


def _probes(own: DataFrame, bitmap: np.ndarray, sizes: list[int]) -> DataFrame:
    """The text's key and the hash of each of its seeds that the bitmap has; rows: key, t."""
    low = np.uint64(8 * len(bitmap) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in few(batches):
            row, found = [], []
            for r, text in enumerate(blobs(batch[2])):
                own = words.of(tokens(text))
                for size in sizes:
                    h = window_hashes(own, size)
                    at = h & low
                    h = h[(bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & np.uint8(1)) > 0]
                    if len(h):
                        h = np.unique(h)
                        row.append(np.full(len(h), r, np.int32))
                        found.append(h)
            if found:
                same = pa.array(np.concatenate(row))
                yield pa.RecordBatch.from_arrays([batch[0].take(same), batch[1].take(same), pa.array(np.concatenate(found).view(np.int64))], names=[_A, _B, "h"])

    return own.mapInArrow(tidy(run), f"{_A} long, {_B} long, h long")


def _found(docs: DataFrame, benchmark: DataFrame, coverage: float, tile: int, text: Column, item_col: str) -> DataFrame:
    """A row a text and item: the text's key, item_id, coverage, item_words, tiles."""
    schema = f"{_A} long, {_B} long, item_id long, coverage double, item_words int, tiles array<struct<doc_word:int,item_word:int,words:int>>"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.list_(pa.struct([(n, pa.int32()) for n in ("doc_word", "item_word", "words")]))]
    names = [_A, _B, "item_id", "coverage", "item_words", "tiles"]
    said = F.col("text").cast("string")
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("k"), F.xxhash64(said).alias("i"), said.alias("t")).where("t is not null").distinct()
    seeds = stored(_chosen(stored(_seeds(items, tile), "seeds"), coverage), "chosen")
    sizes = {r["size"]: r.n for r in seeds.groupBy("size").agg(F.count("*").alias("n")).collect()}  # ``tile`` rows at most
    own = docs.select(*_text_key(text), text.alias("t")).where("t is not null")
    if not sizes:
        return docs.sparkSession.createDataFrame([], schema)
    probes = _probes(own, _bitmap(seeds, sum(sizes.values())), sorted(sizes))
    hits = probes.join(seeds, "h").groupBy(_A, _B, "k", "i").agg(F.array_sort(F.collect_set("place")).alias("p"), *[F.first(c).alias(c) for c in ("n", "size", "free")])
    words = F.aggregate(F.transform("p", lambda x, at: F.least("size", F.coalesce(F.get("p", at + 1), F.col("n")) - x)), F.lit(0), lambda s, x: s + x)
    pairs = stored(hits.where((words + F.col("free")) / F.col("n") >= coverage).select(_A, _B, "k", "i"), "pairs")

    # a text comes before its items, and equal texts are one; it moves once, however many items it has
    texts = own.join(pairs.select(_A, _B).distinct(), [_A, _B], "left_semi").dropDuplicates([_A, _B])
    wanted = pairs.join(items.withColumnRenamed("k", "k2"), F.col("k").eqNullSafe(F.col("k2")) & (pairs["i"] == items["i"]))
    both = texts.select(_A, _B, F.lit(None).cast("long").alias("k"), F.lit(0).alias("kind"), "t").unionByName(wanted.select(_A, _B, "k", F.lit(1).alias("kind"), "t"))
    ordered = both.repartition(_A, _B).sortWithinPartitions(_A, _B, "kind", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = {}
        text = np.zeros(0, np.int64)
        for batch in few(batches):
            out: list[list] = [[], [], [], [], [], []]
            for a, b, k, kind, t in zip(*(batch[c].to_pylist() for c in range(4)), blobs(batch[4]), strict=True):
                if kind == 0:
                    numbers = {}
                    words = tokens(t)
                    text = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
                    continue
                item = np.array([numbers.get(w, -1) for w in tokens(t)], np.int64)  # words that the text lacks match nothing
                found = tiles(text, item, tile)
                share = sum(x[2] for x in found) / len(item)
                if share >= coverage:
                    row = (a, b, k, share, len(item), [{"doc_word": x, "item_word": y, "words": m} for x, y, m in found])
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    return stored(ordered.mapInArrow(tidy(run), schema), "leaks")


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The pairs of a document and a benchmark item whose words its tiles cover to ``coverage`` or more.

    Returns doc_id, item_id, coverage, item_words, tiles (array of struct(doc_word, item_word, words)). The benchmark's
    text column has the name ``text``. ``coverage`` is above 0.

    Defined cases: null and empty texts match nothing, nor does an item without words; an item shorter than ``tile``
    words must be there whole; repeated items with equal text are one; repeated rows of documents give repeated pairs;
    null ids are carried along; other columns are ignored; either table may be empty.

    Documents are read three times and never shuffled, but for the texts of pairs that may reach the coverage; equal
    texts (by two 64-bit hashes) are compared once.
    """
    text = F.col(f"`{text_col}`").cast("string")
    found = _found(docs, benchmark, coverage, tile, text, item_col)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *_text_key(text))
    return own.join(found, [_A, _B]).drop(_A, _B)


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, tile: int = TILE, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that cover no benchmark item (see ``leaks``), with all their columns; null texts stay."""
    text = F.col(f"`{text_col}`").cast("string")
    found = _found(docs, benchmark, coverage, tile, text, item_col).select(_A, _B).distinct()
    key = F.struct(*_text_key(text))
    marked = docs.withColumn(f"{OWN}key", key)
    return marked.join(found, (F.col(f"{OWN}key.{_A}") == found[_A]) & (F.col(f"{OWN}key.{_B}") == found[_B]), "left_anti").drop(f"{OWN}key")
