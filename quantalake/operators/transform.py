"""Fourier and cosine transforms: of arrays, a row a series, and of series with a row a value, however long.

A long series is seen as a matrix with about as many rows as columns, read row by row. Its columns are transformed,
turned by the angle of their place, dealt out again by row, and transformed along the rows: two shuffles, and no task
holds more than a bundle of columns or rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantalake.operators.density import dct as _dct
from quantalake.operators.density import idct as _idct


def _power_of_two(x: Column, out: Column) -> Column:
    return F.when(F.assert_true(F.bit_count(F.size(x)) == 1, F.lit("the length must be a power of two")).isNull(), out)


def _real(f):
    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(np.array(x, float)) for x in column.to_pylist()], pa.list_(pa.float64()))

    return run


def _complex(f):
    @F.arrow_udf("struct<re:array<double>,im:array<double>>")
    def run(re: pa.Array, im: pa.Array) -> pa.Array:
        out = [None if a is None or b is None else f(np.array(a, float) + 1j * np.array(b, float)) for a, b in zip(re.to_pylist(), im.to_pylist(), strict=True)]
        kind = pa.struct([("re", pa.list_(pa.float64())), ("im", pa.list_(pa.float64()))])
        return pa.array([None if v is None else {"re": v.real, "im": v.imag} for v in out], kind)

    return run


def fft(re: Column, im: Column) -> Column:
    """struct(re, im): sums of x_j exp(-2 pi i j k / n). Lengths must be powers of two."""
    return _power_of_two(re, _complex(np.fft.fft)(re, im))


def ifft(re: Column, im: Column) -> Column:
    """The inverse of ``fft``, with 1/n."""
    return _power_of_two(re, _complex(np.fft.ifft)(re, im))


def dct(x: Column) -> Column:
    """DCT-II with a factor of 2."""
    return _power_of_two(x, _real(_dct)(x))


def idct(x: Column) -> Column:
    """DCT-III, so that ``idct(dct(x))`` is 2 n x."""
    return _power_of_two(x, _real(_idct)(x))


def dct_complex(re: Column, im: Column) -> Column:
    """``dct`` of the real parts."""
    return F.when(im.isNotNull(), dct(re))


def idct_complex(re: Column, im: Column) -> Column:
    return F.when(im.isNotNull(), idct(re))


def series(df: DataFrame, by: list[str], idx: str, x: str, out: str = "x") -> DataFrame:
    """``by`` and the values of each series as an array in the order of ``idx``: a transform needs its series whole."""
    own = F.array_sort(F.collect_list(F.struct(F.col(idx), F.col(x))))
    return df.groupBy(*by).agg(F.transform(own, lambda s: s[x]).alias(out))


#: Values that a task transforms at a time.
BUNDLE = 1 << 20


def _steps(df: DataFrame, by: list[str], n: int, inverse: bool) -> DataFrame:
    """``by``, k, re, im from ``by``, __j, __re, __im."""
    rows = 1 << (int(math.log2(n)) + 1) // 2
    columns, kinds = n // rows, {f.name: f.dataType.simpleString() for f in df.schema.fields}
    sign = 1 if inverse else -1
    schema = "".join(f"`{b}` {kinds[b]}, " for b in by) + "__j long, __re double, __im double"
    transform = (lambda m, axis: np.fft.ifft(m, axis=axis)) if inverse else (lambda m, axis: np.fft.fft(m, axis=axis))

    def step(place, along: int, across: int, out):
        """A function of a bundle: ``place`` gives a value's row and column in the bundle's matrix, whose columns of
        length ``along`` are transformed; ``out`` makes places and values of (row, column, matrix)."""
        wide = max(1, min(across, BUNDLE // along))

        def run(table: pa.Table) -> pa.Table:
            j = table["__j"].to_numpy()
            at, column = place(j)
            first = int(column.min()) // wide * wide
            m = np.zeros((along, min(wide, across - first)), complex)
            m[at, column - first] = table["__re"].to_numpy() + 1j * table["__im"].to_numpy()
            k = np.arange(along)[:, None]
            c = np.arange(first, first + m.shape[1])[None, :]
            places, values = out(k, c, transform(m, 0))
            same = [table[b].take(pa.array(np.zeros(values.size, int))) for b in by]
            return pa.table([*same, pa.array(np.broadcast_to(places, values.shape).ravel()), pa.array(values.real.ravel()), pa.array(values.imag.ravel())], names=[*by, "__j", "__re", "__im"])

        return wide, run

    # columns of the matrix; what comes out is place k * columns + c, turned
    wide, first = step(lambda j: (j // columns, j % columns), rows, columns, lambda k, c, v: (k * columns + c, v * np.exp(sign * 2j * np.pi * ((k * c) % n) / n)))
    own = df.groupBy(*by, F.floor((F.col("__j") % columns) / wide).alias("__bundle")).applyInArrow(first, schema)
    # rows of the matrix; row k, place c is frequency k + rows * c
    wide, second = step(lambda j: (j % columns, j // columns), columns, rows, lambda k, c, v: (c + rows * k, v))
    own = own.groupBy(*by, F.floor(F.floor(F.col("__j") / columns) / wide).alias("__bundle")).applyInArrow(second, schema)
    return own.select(*by, F.col("__j").alias("k"), F.col("__re").alias("re"), F.col("__im").alias("im"))


def _long(df: DataFrame, by: list[str], place: Column, re: Column, im: Column, n: int, inverse: bool = False) -> DataFrame:
    if n < 1 or n & (n - 1):
        raise ValueError("the length must be a power of two")
    fits = F.assert_true((place >= 0) & (place < n), F.lit("a place is outside the length")).isNull()
    return _steps(df.select(*by, F.when(fits, place.cast("long")).alias("__j"), re.cast("double").alias("__re"), im.cast("double").alias("__im")), by, n, inverse)


def fft_long(df: DataFrame, by: list[str], idx: str, re: str, n: int, im: str | None = None) -> DataFrame:
    """``by``, k, re, im: the transform of each series of length ``n``, a power of two, with a row a value; ``idx`` is
    the 0-based place. Places without a row are zero, so shorter series are padded; a place that is there twice is an
    error of the caller. Null values are an error."""
    return _long(df, by, F.col(idx), F.col(re), F.col(im) if im else F.lit(0.0), n)


def ifft_long(df: DataFrame, by: list[str], idx: str, re: str, im: str, n: int) -> DataFrame:
    """The inverse of ``fft_long``, with 1/n."""
    return _long(df, by, F.col(idx), F.col(re), F.col(im), n, True)


def dct_long(df: DataFrame, by: list[str], idx: str, x: str, n: int) -> DataFrame:
    """``by``, k, v: ``dct`` of long series: the values at even places, and after them those at odd places backwards,
    are transformed, and turned by a quarter of their angle."""
    i = F.col(idx)
    place = F.when(i % 2 == 0, F.floor(i / 2)).otherwise(n - 1 - F.floor(i / 2))
    angle = F.col("k") * (math.pi / (2 * n))
    return _long(df, by, place, F.col(x), F.lit(0.0), n).select(*by, "k", (2 * (F.col("re") * F.cos(angle) + F.col("im") * F.sin(angle))).alias("v"))


def idct_long(df: DataFrame, by: list[str], idx: str, x: str, n: int) -> DataFrame:
    """``by``, k, v: ``idct`` of long series, so that it gives 2 n times what ``dct_long`` was given."""
    i, own = F.col(idx).cast("long"), F.col(x).cast("double")
    # a value counts at its place, and at the place as far from the end; both halves of a complex number
    halves = F.array(F.struct(i.alias("j"), own.alias("a"), F.lit(0.0).alias("b")), F.struct((n - i).alias("j"), F.lit(0.0).alias("a"), (-own).alias("b")))
    each = df.select(*by, F.explode(halves).alias("e")).select(*by, "e.*").where(F.col("j") < n)
    joined = each.groupBy(*by, "j").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    angle = F.col("j") * (math.pi / (2 * n))
    re, im = F.col("a") * F.cos(angle) - F.col("b") * F.sin(angle), F.col("a") * F.sin(angle) + F.col("b") * F.cos(angle)
    back = _long(joined, by, F.col("j"), re / 2, im / 2, n, True)
    k = F.col("k")
    return back.select(*by, F.when(k < (n + 1) // 2, 2 * k).otherwise(2 * (n - 1 - k) + 1).alias("k"), (2 * n * F.col("re")).alias("v"))
