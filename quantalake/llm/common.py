"""Helpers shared by the training-data operators.

Words are split exactly at the bytes 0x20 and 0x09-0x0D, which is what ``bytes.split()`` does, and ``bytes.lower()``
changes A-Z alone; so the operators work on UTF-8 bytes and never depend on the Unicode tables of the interpreter.
"""

from __future__ import annotations

import ctypes

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantalake.sources.scratch import discard, scratch, stored  # noqa: F401 (operators have them from here)

#: The prefix of working columns; a column of the input that has it is not supported.
OWN = "__ql_"
CACHE_WORDS = 1 << 17
CACHE_WORD_BYTES = 64


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unprefixed(df: DataFrame) -> DataFrame:
    """``df``; an error if it has columns with the prefix of working ones."""
    if own := [c for c in df.columns if c.lower().startswith(OWN)]:
        raise ValueError(f"columns may not begin with {OWN}: {', '.join(own)}")
    return df


def with_outputs(df: DataFrame, outputs: dict) -> DataFrame:
    """All columns of ``df`` but working ones, with ``outputs`` in place of columns of the same name."""
    taken = {name.lower() for name in outputs}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken and not c.startswith(OWN)]
    return df.select(*kept, *[col.alias(name) for name, col in outputs.items()])


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a fixed number of short words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHE_WORD_BYTES:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit generator (splitmix64): it spreads sums and products over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` word hashes: a polynomial in an odd base modulo 2**64, mixed.

    Prefix sums give each window as (P[i+size] - P[i]) * base**-i, so the cost doesn't depend on ``size``.
    """
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(h))
    prefix = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h) * up[: len(h)], out=prefix[1:])
    return mix((prefix[size:] - prefix[:n]) * down[:n])


_BASE = 0x9E3779B97F4A7C15
_cached_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _cached_powers
    if len(_cached_powers[0]) < n:
        size = 1 << int(n).bit_length()
        both = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        _cached_powers = (both[0], both[1])
        if size > 1 << 22:  # a very long text: don't keep its tables
            full, _cached_powers = _cached_powers, (np.ones(1, np.uint64), np.ones(1, np.uint64))
            return full
    return _cached_powers


def shingles(h: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; a shorter text is one run; no words give none."""
    if not len(h):
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(h, min(size, len(h))))


def blobs(column) -> list:
    """The values of an Arrow string or binary column as bytes (None for null), without decoding."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def few(batches, rows: int = 512):
    """Slices of batches, so that a task holds few texts as Python objects at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def release() -> None:
    """Give memory that is no longer used back to the system: idle workers wait for later stages."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def tidy(run):
    """``run`` over batches, with ``release`` at its end, however it ends."""

    def own(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return own
