"""Histograms and kernel density estimates."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantalake.operators.ranks import next_power_of_two

EPSILON = 2.220446049250313e-16


def _joined(df: DataFrame, own: DataFrame, by: list[str]) -> DataFrame:
    return df.join(own, by) if by else df.crossJoin(F.broadcast(own))  # a single row


def histogram_range(bins: int, low: Column, high: Column) -> tuple[Column, Column]:
    """The range that a histogram covers: half a bin wider than the sample at each end; a tenth of the value for a
    constant, and (-1, 1) for zeros."""
    if bins < 1:
        raise ValueError("at least one bin is needed")
    d = F.lit(0.0) if bins == 1 else (high - low) / ((bins - 1) * 2)
    same, tenth = low == high, F.abs(low) / 10
    zero = same & (F.abs(low) < 1e-300)
    return F.when(zero, F.lit(-1.0)).when(same, low - tenth).otherwise(low - d), F.when(zero, F.lit(1.0)).when(same, high + tenth).otherwise(high + d)


def _bin(x: Column, bins: int, low: Column, high: Column) -> Column:
    width = (high - low) / bins * (1 + EPSILON)
    number = ((x - low) / width).cast("int")
    return F.when((number >= 0) & (number < bins), number).when(x.isNotNull(), F.raise_error(F.lit("a value is outside the histogram")).cast("int"))


def _counts(df: DataFrame, by: list[str], x: str, bins: int, limits: DataFrame) -> DataFrame:
    """``by``, bin, lo, n for every bin; ``limits`` has ``by``, __lo and __hi. Groups mustn't have the names of these."""
    low, high = F.col("__lo"), F.col("__hi")
    counted = _joined(df.where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("__x")), limits, by)
    counted = counted.withColumn("bin", _bin(F.col("__x"), bins, low, high)).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    all_bins = limits.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = all_bins.join(counted, [*by, "bin"], "left")
    return out.select(*by, "bin", (low + (high - low) / bins * F.col("bin")).alias("lo"), F.coalesce("n", F.lit(0)).alias("n"))


def histogram(df: DataFrame, by: list[str], x: str, bins: int) -> DataFrame:
    """``by``, bin, lo (its lower end) and n, over the range of each group's sample."""
    own = df.groupBy(*by).agg(F.min(F.col(x).cast("double")).alias("__a"), F.max(F.col(x).cast("double")).alias("__b")).where("__a is not null")
    low, high = histogram_range(bins, F.col("__a"), F.col("__b"))
    return _counts(df, by, x, bins, own.select(*by, low.alias("__lo"), high.alias("__hi")))


def histogram_fixed(df: DataFrame, by: list[str], x: str, bins: int, low: float, high: float) -> DataFrame:
    """The same over a given range; a value outside is an error."""
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    return _counts(df, by, x, bins, groups.select(*by, F.lit(float(low)).alias("__lo"), F.lit(float(high)).alias("__hi")))


# Botev, Grotowski, Kroese 2010: the bandwidth is a fixed point, by the cosine transform of a histogram.


def dct(x: np.ndarray) -> np.ndarray:
    """DCT-II with a factor of 2, by a transform of the reordered input."""
    n = len(x)
    v = np.concatenate([x[::2], x[1::2][::-1]]) if n > 1 else x
    return 2 * (np.fft.fft(v) * np.exp(-1j * np.pi * np.arange(n) / (2 * n))).real


def idct(x: np.ndarray) -> np.ndarray:
    """DCT-III, x_0 + 2 sum of x_k cos(pi k (2 i + 1) / (2 n)): ``idct(dct(x))`` is 2 n x."""
    n = len(x)
    k = np.arange(1, n)
    spectrum = x.astype(complex)
    spectrum[1:] = (x[1:] - 1j * x[1:][::-1]) * np.exp(1j * np.pi * k / (2 * n))
    v = np.fft.ifft(spectrum).real * n
    out, half = np.empty(n), (n + 1) // 2
    out[::2], out[1::2] = v[:half], v[half:][::-1]
    return out


def ridders(f: Callable[[float], float], a: float, b: float, tolerance: float, steps: int = 100) -> float | None:
    """A root of f between a and b by Ridders' rule; None if the ends don't bracket one."""
    fa, fb = f(a), f(b)
    if fa == 0:
        return a
    if fb == 0:
        return b
    if not fa * fb < 0:
        return None
    for _ in range(steps):
        if abs(b - a) < tolerance:
            break
        m = (a + b) / 2
        fm = f(m)
        if fm == 0:
            return m
        new = m + (m - a) * math.copysign(1, fa - fb) * fm / math.sqrt(fm * fm - fa * fb)
        fn = f(new)
        if fn == 0:
            return new
        if fm * fn < 0:
            a, fa, b, fb = m, fm, new, fn
        elif fa * fn < 0:
            b, fb = new, fn
        else:
            a, fa = new, fn
        if fa * fb >= 0:
            break
    return (a + b) / 2


def botev(counts: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Mesh and density from the counts of bins, as many as a power of two."""
    n, size, r = len(counts), float(counts.sum()), high - low
    a = dct(counts / size / (counts / size).sum())
    squares, k = (a[1:] / 2) ** 2, np.arange(1, n, dtype=float) ** 2

    def functional(q: float, t: float) -> float:
        return 2 * math.pi ** (2 * q) * float((k**q * squares * np.exp(-k * math.pi**2 * t)).sum())

    def gap(t: float) -> float:
        h = functional(7, t)
        for s in range(6, 1, -1):
            odd = math.prod(range(1, 2 * s, 2)) / math.sqrt(2 * math.pi)
            h = functional(s, (2 * (1 + 0.5 ** (s + 0.5)) / 3 * odd / size / h) ** (2 / (3 + 2 * s))) if h > 0 else h
        return t - (size * 2 * math.sqrt(math.pi) * h) ** -0.4 if h > 0 else -math.inf

    t = ridders(gap, 0.0, 0.1, 1e-14)
    if t is None:
        t = 0.28 * size**-0.4
    density = idct(a * np.exp(-(np.arange(n) ** 2) * math.pi**2 * t / 2)) / (2 * r)
    return low + r / (n - 1) * np.arange(n), density


def kde(df: DataFrame, by: list[str], x: str, points: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """``by``, i, x, density: Botev's estimate at a power of two of points, over the sample's range and a tenth more at
    both ends, or from ``low`` to ``high``.

    Spark bins the values; a task gets the counts of a group only. The mesh spans the range with n - 1 steps, and the
    density is that of n bins, so that it integrates to n / (n - 1).
    """
    if points <= 1:
        raise ValueError("at least two points are needed")
    n = next_power_of_two(points)
    if low is None:
        own = df.groupBy(*by).agg(F.min(F.col(x).cast("double")).alias("__a"), F.max(F.col(x).cast("double")).alias("__b"), F.count(x).alias("__n")).where("__n > 0")
        wide = F.when((F.col("__n") <= 1) | (F.col("__a") == F.col("__b")), F.lit(1.0)).otherwise(F.col("__b") - F.col("__a"))
        limits = own.select(*by, (F.col("__a") - wide / 10).alias("__lo"), (F.col("__b") + wide / 10).alias("__hi"))
    else:
        groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
        limits = groups.select(*by, F.lit(float(low)).alias("__lo"), F.lit(float(high)).alias("__hi"))
    counted = _joined(_counts(df, by, x, n, limits), limits, by)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    names = [*by, "i", "x", "density"]

    def solve(table: pa.Table) -> pa.Table:
        order = np.argsort(table["bin"].to_numpy())
        mesh, density = botev(table["n"].to_numpy()[order].astype(float), table["__lo"][0].as_py(), table["__hi"][0].as_py())
        return pa.table([*[table[b].take(pa.array(np.zeros(n, int))) for b in by], pa.array(np.arange(n), pa.int32()), pa.array(mesh), pa.array(density)], names=names)

    return counted.withColumn("__all", F.lit(0)).groupBy(*(by or ["__all"])).applyInArrow(solve, "".join(f"{b} {kinds[b]}, " for b in by) + "i int, x double, density double")


# Simple kernels


def epanechnikov_bandwidth(n: Column) -> Column:
    return F.pow(80 / (n * 2 / math.sqrt(math.pi)), 0.2)


def gaussian_bandwidth(n: Column) -> Column:
    return F.pow(4 / (n * 3), 0.2)


def bandwidth(rule: Callable[[Column], Column], x: str) -> Column:
    """The aggregate deviation * rule(n)."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0)) * rule(F.count(x))


def epanechnikov_kernel(f: Column, h: Column, p: Column, v: Column) -> Column:
    u = (v - p) / (h * 0.75)
    return F.when(F.abs(u) <= 1, f * (1 - u * u)).otherwise(F.lit(0.0))


def gaussian_kernel(f: Column, h: Column, p: Column, v: Column) -> Column:
    u = (v - p) / h
    return F.exp(-0.5 * u * u) * f * (1 / math.sqrt(2 * math.pi))


def choose_points(low: Column, high: Column, n: int, h: Column) -> Column:
    """An array of n points from low - h to high + h."""
    step = (high - low + 2 * h) / (n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low - h + step * i)


def estimate_pdf(df: DataFrame, by: list[str], x: str, kernel: Callable, points: DataFrame) -> DataFrame:
    """``by``, i, x, density: the mean kernel at given points; ``points`` has ``by``, h, n and points (an array)."""
    return _estimated(df, by, x, kernel, points.select(*by, F.col("h").alias("__h"), F.col("n").alias("__n"), F.col("points").alias("__points")))


def _estimated(df: DataFrame, by: list[str], x: str, kernel: Callable, points: DataFrame) -> DataFrame:
    own = _joined(df.where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("__v")), points, by)
    own = own.select(*by, "__v", "__h", "__n", F.posexplode("__points").alias("__i", "__p"))
    f = 1 / (F.col("__h") * F.col("__n"))
    out = own.groupBy(*by, "__i").agg(F.max("__p").alias("x"), F.sum(kernel(f, F.col("__h"), F.col("__p"), F.col("__v"))).alias("density"))
    return out.withColumnRenamed("__i", "i").select(*by, "i", "x", "density")


def simple_pdf(df: DataFrame, by: list[str], x: str, rule: Callable, kernel: Callable, padding: float, n: int) -> DataFrame:
    """Bandwidth by ``rule``, points padded by so many bandwidths. A group needs two values."""
    own = df.groupBy(*by).agg(F.min(F.col(x).cast("double")).alias("__a"), F.max(F.col(x).cast("double")).alias("__b"), F.count(x).alias("__n"), bandwidth(rule, x).alias("__h")).where("__n > 1")
    points = own.select(*by, "__h", "__n", choose_points(F.col("__a"), F.col("__b"), n, padding * F.col("__h")).alias("__points"))
    return _estimated(df, by, x, kernel, points)


def epanechnikov_pdf(df: DataFrame, by: list[str], x: str, n: int) -> DataFrame:
    """The density at ``n`` points, as ``simple_pdf`` has it for this kernel, in work of rows + points.

    A value counts at the points of a window, where the kernel is a polynomial of the distance; so the density follows
    from how many values the window has, their sum and that of their squares. A value comes in at the first point of its
    window and goes out behind the last one: what comes and goes is summed by point, and run over the points.
    """
    own = df.where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("__v"))
    sizes = own.groupBy(*by).agg(F.min("__v").alias("__a"), F.max("__v").alias("__z"), F.count("__v").alias("__n"), bandwidth(epanechnikov_bandwidth, "__v").alias("__h")).where("__n > 1")
    h = F.col("__h")
    sizes = sizes.select(*by, "__n", "__h", (F.col("__a") - h).alias("__low"), ((F.col("__z") - F.col("__a") + 2 * h) / (n - 1)).alias("__step"))
    joined = _joined(own, sizes, by)
    place, reach = (F.col("__v") - F.col("__low")) / F.col("__step"), 0.75 * h / F.col("__step")
    first = F.greatest(F.ceil(place - reach), F.lit(0)).cast("int")
    last = F.least(F.floor(place + reach), F.lit(n - 1)).cast("int")
    u = (F.col("__v") - F.col("__low")) / (0.75 * h)
    ends = F.array(F.struct(first.alias("i"), F.lit(1.0).alias("sign")), F.struct((last + 1).alias("i"), F.lit(-1.0).alias("sign")))
    moved = joined.where(first <= last).select(*by, u.alias("__u"), F.explode(ends).alias("__e"))
    sign = F.col("__e.sign")
    sums = moved.groupBy(*by, F.col("__e.i").alias("i")).agg(F.sum(sign).alias("__0"), F.sum(sign * F.col("__u")).alias("__1"), F.sum(sign * F.col("__u") * F.col("__u")).alias("__2"))
    points = sizes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(sums, [*by, "i"], "left")
    so_far = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # a row a point
    run = {c: F.sum(F.coalesce(c, F.lit(0.0))).over(so_far) for c in ("__0", "__1", "__2")}
    out = points.select(*by, "i", (F.col("__low") + F.col("__step") * F.col("i")).alias("x"), "__n", "__h", "__step", *[c.alias(k) for k, c in run.items()])
    p = F.col("i") * F.col("__step") / (0.75 * h)
    inside = F.col("__0") - (F.col("__2") - 2 * p * F.col("__1") + p * p * F.col("__0"))
    return out.select(*by, "i", "x", F.when(F.col("__0") > 0, F.greatest(F.lit(0.0), inside) / (h * F.col("__n"))).otherwise(0.0).alias("density"))


def gaussian_pdf(df: DataFrame, by: list[str], x: str, n: int) -> DataFrame:
    return simple_pdf(df, by, x, gaussian_bandwidth, gaussian_kernel, 3, n)
