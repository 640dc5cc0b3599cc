"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the ``k`` smallest distinct 64-bit hashes of a text's shingles (five words, unchanged; fewer words are one
shingle). Sketches merge: the ``k`` smallest of two sketches' hashes are the sketch of both texts' shingles. So a long
text is sketched a part at a time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantalake.llm.common import WordHashes, blobs, few, shingles, tidy

K = 128
#: Shingles of a long text that are hashed at a time, and bytes of text of a range of documents.
PART, RANGE_BYTES = 1 << 16, 32 << 20
#: Ranges at most: so many heads come to the driver, whatever the size of the table.
RANGES = 1 << 15
_SIGN = 1 << 63


def sketch(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of sorted distinct hashes."""
    return hashes[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the shingles of both."""
    return np.union1d(a, b)[:k]


def text_sketch(words: np.ndarray, k: int = K, size: int = 5, part: int = PART) -> np.ndarray:
    """The sketch of a text by the hashes of its words: those of its parts of ``part`` shingles, merged."""
    out = sketch(shingles(words[: part + size - 1], size), k)
    for a in range(part, len(words) - size + 1, part):
        out = merge(out, sketch(shingles(words[a : a + part + size - 1], size), k), k)
    return out


def to_text(s: np.ndarray) -> str:
    return base64.b64encode(s.astype(">u8").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), ">u8").astype(np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated Jaccard similarity: the share of the union's sketch that is in both. Two empty sketches: 1."""
    union = np.union1d(a, b)[:k]
    return float(np.isin(union, np.intersect1d(a, b, True), True).mean()) if len(union) else 1.0


def distinct(s: np.ndarray, k: int = K) -> float:
    """The estimated number of distinct shingles: exact below ``k``."""
    return float(len(s)) if len(s) < k else (k - 1) * 2.0**64 / (float(s[k - 1]) + 1.0)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """The estimated share of a's shingles that b has."""
    n = distinct(a, k)
    return min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / n) if n else 1.0


def _chars(b: bytes) -> int:
    return len(b) - int(np.count_nonzero((np.frombuffer(b, np.uint8) & 0xC0) == 0x80)) if b else 0


def _cut(b: bytes, chars: int) -> int:
    """The number of bytes of the first ``chars`` code points."""
    if len(b) <= chars:
        return len(b)
    starts = np.flatnonzero((np.frombuffer(b, np.uint8) & 0xC0) != 0x80)
    return int(starts[chars]) if chars < len(starts) else len(b)


def edited(text: bytes, after: bytes) -> tuple[int, bytes]:
    """n_chars, and the text with its last floor(n/2) code points replaced by as many of ``after``, from its start."""
    n = _chars(text)
    half = n // 2
    return n, text[: _cut(text, n - half)] + after[: _cut(after, half)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprint each text and its edited text (see ``edited``; the next document by descending id, last to first).

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (base64 of the sorted hashes), near_edited,
    near_next (estimated resemblance to the edited text and to the next document's text), distinct_shingles and
    contained_next (estimates).

    Defined cases: a null text is empty; null ids come last; rows with one id are ordered by a hash of their text, so
    repeated rows follow each other; a table of one row follows itself; an empty table gives no rows.

    The text moves once. Spark's range partitioning cuts the keys (ids and hashes of texts) into ranges of about
    RANGE_BYTES of text, RANGES at most (larger ones stream through their tasks just as well); where they begin comes
    to the driver, 17 bytes a range. Each range is read by one task in
    order, and its first row is also sent to the range before it. One id with very many texts spans ranges; only rows
    with equal text and id stay together, and they stream through their task.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), F.xxhash64(text).alias("tie"), text.alias("t"))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    wanted = min(RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES)))
    keys = rows.select(F.col("d").isNull().alias("no_id"), F.bitwise_not("d").alias("down"), "tie")
    first = F.min(F.struct("no_id", "down", "tie")).alias("h")
    found = keys.repartitionByRange(wanted, "no_id", "down", "tie").groupBy(F.spark_partition_id().alias("p")).agg(first).collect()  # a row a range
    heads = sorted((r.h.no_id, r.h.down or 0, r.h.tie) for r in found)
    if not heads:
        return rows.limit(0).selectExpr(*_NAMED_EMPTY)
    begins = np.sort(_places(*(np.array(x) for x in zip(*heads, strict=True))))

    @F.arrow_udf("int")
    def range_of(d: pa.Array, tie: pa.Array) -> pa.Array:
        down = ~pc.fill_null(d, -1).to_numpy(zero_copy_only=False)
        own = _places(d.is_null().to_numpy(zero_copy_only=False), down, tie.to_numpy(zero_copy_only=False))
        return pa.array((np.searchsorted(begins, own, "right") - 1).astype(np.int32))

    rows = rows.withColumn("range", range_of("d", "tie"))
    # the first range follows the last
    to = [(None if no_id else ~down, tie, k - 1 if k else len(heads) - 1) for k, (no_id, down, tie) in enumerate(heads)]
    begin = spark.createDataFrame(to, "hd long, ht long, to int")
    tails = rows.drop("range").join(F.broadcast(begin), F.col("d").eqNullSafe(F.col("hd")) & (F.col("tie") == F.col("ht")))
    both = rows.select("range", F.lit(0).alias("tail"), "d", "tie", "t").unionByName(tails.select(F.col("to").alias("range"), F.lit(1).alias("tail"), "d", "tie", "t"))
    ordered = both.repartitionById(len(heads), "range").sortWithinPartitions("range", "tail", F.col("d").desc_nulls_last(), "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        held = None  # the row whose next one isn't known yet: (range, id, text, sketch)
        for batch in few(batches):
            out = []
            for r, tail, d, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2].to_pylist(), blobs(batch[4]), strict=True):
                if tail and held is None:
                    continue  # a repeated row of the next range's first
                own = text_sketch(words.of(text.split()), k)
                if held is not None:
                    out.append(_row(held, text, own, words, k))
                held = None if tail else (r, d, text, own)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(_TYPES)], names=_NAMES)

    return ordered.mapInArrow(tidy(run), _SCHEMA)


def _places(no_id: np.ndarray, down: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Keys as strings of 17 bytes that sort as they do."""
    out = np.zeros(len(tie), [("no_id", "u1"), ("down", ">u8"), ("tie", ">u8")])
    out["no_id"] = no_id
    for name, x in (("down", down), ("tie", tie)):
        out[name] = x.astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN)
    return out.view("S17")


def _row(held: tuple, after: bytes, after_sketch: np.ndarray, words: WordHashes, k: int) -> tuple:
    _, d, text, own = held
    n, other = edited(text, after)
    other_sketch = text_sketch(words.of(other.split()), k)
    return d, n, hashlib.sha256(other).hexdigest(), to_text(own), to_text(other_sketch), resemblance(own, other_sketch, k), resemblance(own, after_sketch, k), distinct(own, k), containment(own, after_sketch, k)


_FIELDS = [("doc_id", "long"), ("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double"), ("distinct_shingles", "double"), ("contained_next", "double")]
_NAMES = [n for n, _ in _FIELDS]
_SCHEMA = ", ".join(f"{n} {t}" for n, t in _FIELDS)
_TYPES = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t] for _, t in _FIELDS]
_NAMED_EMPTY = [f"cast(null as {t}) as {n}" for n, t in _FIELDS]
