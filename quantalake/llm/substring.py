"""Removal of passages that occur twice: fixed-block anchors, extended to whole repeats.

A repeat of ``window`` words holds, wherever it starts, one whole block of its text's grid of non-overlapping blocks of
``block`` = (window + 1) // 2 words. So the blocks of all texts are the index, and every rolling run of ``block`` words
of all texts probes it. A run is an anchor if the index has it and it occurs twice; anchors are told apart by 32 bits
and their bucket, so there may be too many, never too few. Around anchors, the runs of ``window`` words are compared
over all texts by two independent hashes (96 bits, of words' 64-bit hashes); those that start at more than one place
are the exact repeats, and the words that they cover form the maximal ones.

Documents are dealt over batches of a few megabytes. A batch sends each distinct run once, as packed hashes with two
bits (in the index; more than once in the batch), to the bucket of the hash; so a passage that a third of all texts
share is one entry a batch. A bucket answers each batch with the hashes that are repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantalake.llm.common import WordHashes, blobs, mix, release, stored, window_hashes

#: Rows with one id and text that are worked one by one.
COPIES = 8
#: Bytes of text of a batch, of a bucket, and of a task's batches.
BATCH_BYTES, BUCKET_BYTES, TASK_BYTES = 4 << 20, 8 << 20, 32 << 20
_LOW, _OTHER = np.uint64(0xFFFFFFFF), np.uint64(0xD1342543DE82EF95)


#: Entries of packs: the lower half of an anchor's hash; a window's hash, which gives its bucket, and half of another.
SHORT, LONG = np.dtype("<u4"), np.dtype([("a", "<u8"), ("b", "<u4")])


def _buckets(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash, from its upper half: buckets are ranges, so sorted hashes stay together."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _short(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and lower half: what packs of anchors tell of a hash."""
    return (_buckets(hashes, buckets) << np.uint64(32)) | (hashes & _LOW)


def _long(words: np.ndarray, window: int) -> np.ndarray:
    """Both hashes of each run of ``window`` words."""
    out = np.empty(max(0, len(words) - window + 1), LONG)
    out["a"], out["b"] = window_hashes(words, window), window_hashes(mix(words ^ _OTHER), window) & _LOW
    return out


def _order(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What puts equal entries together, and where each run of equal ones begins in that order."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.ascontiguousarray(x["a"]) if x.dtype == LONG else x
    order = np.argsort(first)
    new = np.concatenate([[True], first[order[1:]] != first[order[:-1]]])
    if x.dtype == LONG:
        other = x["b"][order]
        if ((other[1:] != other[:-1]) & ~new[1:]).any():  # windows that share the first hash only
            order = np.lexsort((x["b"], x["a"]))
            first, other = x["a"][order], x["b"][order]
            new = np.concatenate([[True], (first[1:] != first[:-1]) | (other[1:] != other[:-1])])
    return order, np.flatnonzero(new)


def _runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Where each run of equal values begins and ends."""
    if not len(x):
        return []
    cuts = [*np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])).tolist(), len(x)]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


_PACK = "bucket long, batch long, one binary, many binary, index_one binary, index_many binary"
_PACK_NAMES = ["bucket", "batch", "one", "many", "index_one", "index_many"]
_PACK_KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
_REPLY = "batch long, bucket long, found binary"


def _packs(batch: int, hashes: np.ndarray, indexed: np.ndarray | None, buckets: int) -> pa.Table:
    """The distinct hashes of a batch by bucket, in four classes: found once or more in the batch, in the index or not.

    ``hashes``: 64 bits, of which packs get the lower half; or LONG.
    """
    order, starts = _order(hashes)
    values = hashes[order[starts]]  # sorted, but for the second hash
    several = np.diff(np.append(starts, len(order))) > 1
    inside = np.logical_or.reduceat(indexed[order], starts) if indexed is not None and len(starts) else np.zeros(len(values), bool)
    long = hashes.dtype == LONG
    bucket = _buckets(values["a"] if long else values, buckets)
    packed = values if long else (values & _LOW).astype(SHORT)
    rows = []
    for a, b in _runs(bucket):
        own, s, x = packed[a:b], several[a:b], inside[a:b]
        rows.append((int(bucket[a]), batch, own[~s & ~x].tobytes(), own[s & ~x].tobytes(), own[~s & x].tobytes(), own[s & x].tobytes()))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, _PACK_KINDS, strict=True)], names=_PACK_NAMES)


def _repeated(packs: pa.Table, kind: np.dtype, need_index: bool) -> pa.Table:
    """For each batch, the entries of its pack that occur at two places, and in the index if that is asked for."""
    values, flags, owners = [], [], []
    batches = packs["batch"].to_pylist()
    for flag, name in enumerate(_PACK_NAMES[2:]):  # flag: 1 for many, 2 for index
        for k, data in enumerate(packs[name].to_pylist()):
            own = np.frombuffer(data, kind)
            values.append(own)
            flags.append(np.full(len(own), flag, np.uint8))
            owners.append(np.full(len(own), k, np.int32))
    value, flag, owner = np.concatenate(values), np.concatenate(flags), np.concatenate(owners)
    order, starts = _order(value)
    bits = np.bitwise_or.reduceat(flag[order], starts)
    sizes = np.diff(np.append(starts, len(order)))
    good = (sizes > 1) | (bits & 1 > 0)
    if need_index:
        good &= bits & 2 > 0
    hit = order[np.repeat(good, sizes)]
    hit = hit[np.argsort(owner[hit], kind="stable")]
    own = owner[hit]
    runs = _runs(own)
    found = [value[hit[a:b]].tobytes() for a, b in runs]
    bucket = packs["bucket"][0].as_py()
    release()
    return pa.table([pa.array([batches[own[a]] for a, _ in runs], pa.int64()), pa.array([bucket] * len(runs), pa.int64()), pa.array(found, pa.binary())], names=["batch", "bucket", "found"])


def _within(hashes: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which hashes are in ``found`` (sorted)."""
    if not len(found) or not len(hashes):
        return np.zeros(len(hashes), bool)
    at = np.searchsorted(found, hashes)
    at[at == len(found)] = 0
    return found[at] == hashes


def _within_long(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same of LONG entries, sought in ``a`` (sorted) and ``b``: each among the few that share its first hash."""
    if not len(a) or not len(hashes):
        return np.zeros(len(hashes), bool)
    first, second = (np.ascontiguousarray(hashes[c]) for c in ("a", "b"))
    low, high = (np.searchsorted(a, first, side) for side in ("left", "right"))
    out = np.zeros(len(hashes), bool)
    for k in range(int((high - low).max())):
        at = np.minimum(low + k, len(a) - 1)
        out |= (low + k < high) & (b[at] == second)
    return out


def _anchors(replies: pa.Table) -> np.ndarray:
    own = [np.frombuffer(x, SHORT).astype(np.uint64) | np.uint64(b << 32) for b, x in zip(replies["bucket"].to_pylist(), replies["found"].to_pylist(), strict=True)]
    return np.sort(np.concatenate(own)) if own else np.zeros(0, np.uint64)


def _repeats(replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of the repeated windows, by the first."""
    own = np.concatenate([np.zeros(0, LONG), *[np.frombuffer(x, LONG) for x in replies["found"].to_pylist()]])
    a, b = (np.ascontiguousarray(own[c]) for c in ("a", "b"))
    order = np.argsort(a)
    return a[order], b[order]


def _texts(docs: pa.Table) -> Iterator[list[bytes]]:
    for chunk in docs["t"].chunks:
        for text in blobs(chunk):
            yield text.split() if text else []


def substring_dedup(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word that a run of ``window`` words covers which also starts at another place of any text.

    Returns doc_id, n_words, n_removed (long), kept_text (the other words, joined by a space) and removed (array of
    struct(first, last): the ranges of removed words, from 0).

    Defined cases: words are split at ASCII white space, unchanged; a null or empty text, and one of white space only,
    has no words and an empty kept_text; runs are judged on the input; repeated rows repeat each other; null and
    repeated ids are fine, as ids are only carried along; other columns are ignored; an empty table gives no rows.

    Rows are dealt by their id and text, so copies with ids of their own are spread over batches, which tasks hold
    whole. Of rows that are equal in both more than COPIES times two go that way, for others to be compared with; all of
    them have the same result, which needs no comparison: every run of theirs starts elsewhere too.
    """
    ident, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")
    own = docs.select(ident.alias("d"), text.alias("t"), F.xxhash64(text).alias("h1"), F.hash(text).alias("h2"))
    equal = stored(own.groupBy("d", "h1", "h2").agg(F.count("*").alias("n"), F.sum(F.octet_length("t")).alias("bytes")), "equal")
    hot = equal.where(F.col("n") > COPIES).select(F.col("d").alias("d1"), F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    size = equal.agg(F.sum("bytes")).first()[0] or 0
    if hot.isEmpty():
        return _dedup(own.select("d", "t"), window, size)
    same = F.col("d").eqNullSafe(F.col("d1")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    few, many = own.join(hot, same, "left_anti").select("d", "t"), own.join(hot, same, "left_semi")
    two = many.groupBy("d", "h1", "h2").agg(F.first("t").alias("t"))
    two = two.select("d", "t", F.explode(F.array(F.lit(1), F.lit(2)))).select(F.lit(True).alias("two"), "d", "t")
    found = _dedup(few.select(F.lit(False).alias("two"), "d", "t").unionByName(two), window, size).where("not two").drop("two")
    words = F.filter(F.split(F.coalesce("t", F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")
    n = F.size("w").cast("long")
    covered = F.array(F.struct(F.lit(0).cast("long").alias("first"), (n - 1).alias("last")))
    alike = many.select(F.col("d").alias("doc_id"), words.alias("w")).select(
        "doc_id",
        n.alias("n_words"),
        F.when(n >= window, n).otherwise(0).alias("n_removed"),
        F.when(n >= window, "").otherwise(F.array_join("w", " ")).alias("kept_text"),
        F.when(n >= window, covered).otherwise(F.array().cast("array<struct<first:bigint,last:bigint>>")).alias("removed"),
    )
    return found.unionByName(alike)


def _dedup(docs: DataFrame, window: int, size: int) -> DataFrame:
    """The result of rows d and t, with column ``two`` if they have it."""
    spark = docs.sparkSession
    block, marked = (window + 1) // 2, "two" in docs.columns
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    batches = max(partitions, -(-size // BATCH_BYTES))
    buckets = max(partitions, -(-size // BUCKET_BYTES))
    dealt = docs.select(F.pmod(F.xxhash64("d", "t"), F.lit(batches)).alias("batch"), *docs.columns)

    def probe(table: pa.Table) -> pa.Table:
        words, hashes, indexed = WordHashes(), [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
        for own in _texts(table):
            if len(own) >= window:
                rolling = window_hashes(words.of(own), block)
                hashes.append(rolling)
                indexed.append(np.arange(len(rolling)) % block == 0)
        out = _packs(table["batch"][0].as_py(), np.concatenate(hashes), np.concatenate(indexed), buckets)
        release()
        return out

    def extend(table: pa.Table, replies: pa.Table) -> pa.Table:
        words, hashes, anchors = WordHashes(), [np.zeros(0, LONG)], _anchors(replies)
        for own in _texts(table) if len(anchors) else ():
            if len(own) >= window:
                h = words.of(own)
                hit = _within(_short(window_hashes(h, block), buckets), anchors)
                if hit.any():
                    before = np.concatenate([[0], np.cumsum(hit)])
                    span = window - block + 1  # a window has so many rolling runs
                    hashes.append(_long(h, window)[before[span:] > before[:-span]])
        out = _packs(table["batch"][0].as_py(), np.concatenate(hashes), None, buckets)
        release()
        return out

    def remove(table: pa.Table, replies: pa.Table) -> pa.Table:
        words, (first, second) = WordHashes(), _repeats(replies)
        total, gone, kept, spans = [], [], [], []
        for own in _texts(table):
            h = words.of(own) if len(own) >= window and len(first) else None
            hit = _within(window_hashes(h, window), first) if h is not None else None
            if hit is not None and hit.any():
                hit = _within_long(_long(h, window), first, second)
            total.append(len(own))
            if hit is None or not hit.any():
                gone.append(0)
                kept.append(b" ".join(own))
                spans.append([])
                continue
            edge = np.zeros(len(own) + 1, np.int64)
            edge[: len(hit)] += hit
            edge[window : window + len(hit)] -= hit
            covered = np.cumsum(edge[:-1]) > 0
            gone.append(int(covered.sum()))
            kept.append(b" ".join([w for w, c in zip(own, covered.tolist(), strict=True) if not c]))
            step = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
            spans.append([{"first": int(a), "last": int(b) - 1} for a, b in zip(step[::2], step[1::2], strict=True)])
        columns = [table["d"], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))]
        release()
        return pa.table(([table["two"]] if marked else []) + columns, names=["two"] * marked + ["doc_id", "n_words", "n_removed", "kept_text", "removed"])

    by_batch = dealt.repartition(max(partitions, -(-size // TASK_BYTES)), "batch").groupBy("batch")
    probes = by_batch.applyInArrow(probe, _PACK)
    anchors = probes.groupBy("bucket").applyInArrow(lambda t: _repeated(t, SHORT, True), _REPLY)
    windows = by_batch.cogroup(anchors.groupBy("batch")).applyInArrow(extend, _PACK)
    repeats = windows.groupBy("bucket").applyInArrow(lambda t: _repeated(t, LONG, False), _REPLY)
    return by_batch.cogroup(repeats.groupBy("batch")).applyInArrow(remove, "two boolean, " * marked + "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<first:long,last:long>>")
