"""Aggregates of a sample: expressions for ``agg``, so they work in any grouping, cube, rollup or stream.

Nulls are skipped, as Spark's aggregates do. Where the plain formula divides by zero the result is that of IEEE doubles.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantalake.functions import ieee
from quantalake.functions.ieee import col

X = Column | str


def sample_range(x: X) -> Column:
    """max - min; null for an empty sample."""
    return F.max(col(x)) - F.min(col(x))


def expectation(f: Callable[[Column], Column], x: X) -> Column:
    """The mean of f(x); NaN for an empty sample."""
    return F.coalesce(F.avg(f(col(x))), F.lit(ieee.NAN))


def mean(x: X) -> Column:
    """NaN for an empty sample."""
    return expectation(lambda v: v, x)


def running_mean(x: X) -> Column:
    """The mean, and 0 for an empty sample."""
    return F.coalesce(F.avg(col(x)), F.lit(0.0))


def weighted_mean(x: X, w: X) -> Column:
    """sum(x w) / sum(w); 0 where the weights sum to 0."""
    total = F.sum(F.when(col(x).isNotNull(), col(w)))
    return F.when(F.coalesce(total, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.sum(col(x) * col(w)) / F.when(total != 0, total))


def harmonic_mean(x: X) -> Column:
    """n / sum(1/x): 0 if a value is 0."""
    return ieee.divide(F.count(col(x)).cast("double"), F.sum(ieee.divide(F.lit(1.0), col(x))))


def geometric_mean(x: X) -> Column:
    """exp(mean(log x)): 0 if a value is 0, NaN if one is below."""
    x = col(x)
    return F.when(F.min(x) < 0, F.lit(ieee.NAN)).when(F.min(x) == 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.ln(F.when(x > 0, x)))))


def variance(x: X) -> Column:
    """Of the sample itself (over n); 0 for one value or none."""
    return F.coalesce(F.var_pop(col(x)), F.lit(0.0))


def variance_unbiased(x: X) -> Column:
    """Over n - 1; 0 for one value or none."""
    return F.coalesce(F.var_samp(col(x)), F.lit(0.0))


def mean_variance(x: X) -> Column:
    return F.struct(mean(x).alias("mean"), variance(x).alias("variance"))


def mean_variance_unbiased(x: X) -> Column:
    return F.struct(mean(x).alias("mean"), variance_unbiased(x).alias("variance"))


def std_dev(x: X) -> Column:
    """The root of the unbiased variance."""
    return F.coalesce(F.stddev_samp(col(x)), F.lit(0.0))


def std_err_mean(x: X) -> Column:
    return ieee.divide(std_dev(x), F.sqrt(F.count(col(x)).cast("double")))


fast_variance, fast_variance_unbiased = variance, variance_unbiased  # Spark's are one-pass


def fast_std_dev(x: X) -> Column:
    """The root of the variance over n."""
    return F.coalesce(F.stddev_pop(col(x)), F.lit(0.0))


def skewness(x: X) -> Column:
    """Third standardised moment over n; NaN without variance."""
    return F.coalesce(F.skewness(col(x)), F.lit(ieee.NAN))


def kurtosis(x: X) -> Column:
    """Fourth standardised moment over n, less 3; NaN without variance."""
    return F.coalesce(F.kurtosis(col(x)), F.lit(ieee.NAN))


def covariance(x: X, y: X) -> Column:
    """Over n; 0 for an empty sample."""
    return F.coalesce(F.covar_pop(col(x), col(y)), F.lit(0.0))


def correlation(x: X, y: X) -> Column:
    """Pearson's; 0 for an empty sample, NaN without variance."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(F.count(x) == 0, F.lit(0.0)).when(F.coalesce(spread, F.lit(0.0)) == 0, F.lit(ieee.NAN)).otherwise(F.covar_pop(x, y) / F.when(spread != 0, spread))


def sum_squares_about(m: X | float, x: X) -> Column:
    """The sum of (x - m)**2."""
    return F.coalesce(F.sum((col(x) - col(m)) * (col(x) - col(m))), F.lit(0.0))


def _rounded_once(parts: pa.Array) -> pa.Array:
    """The double nearest to the sum of (high 2**28 + low) 2**exponent, over the few exponents of a group."""
    out = []
    for own in parts.to_pylist():
        least = min((p["e"] for p in own), default=0)
        total = sum(((p["high"] << 28) + p["low"]) << (p["e"] - least) for p in own)
        try:
            out.append(float(total << least) if least >= 0 else total / (1 << -least))
        except OverflowError:
            out.append(math.inf if total > 0 else -math.inf)
    return pa.array(out, pa.float64())


def exact_sums(df: DataFrame, by: list[str], x: str, out: str = "total") -> DataFrame:
    """``by`` and the sum of x, rounded once; a group without values has no row. A sum with values that aren't finite is
    what doubles make of them; one beyond doubles is infinite.

    A double is a whole number times a power of two. Whole numbers are added up by group and exponent, in two halves, so
    sums of up to 2**35 rows fit; that is an aggregate like any other, with partial sums before its shuffle. Only the
    exponents of a group (some twenty, two thousand at most) are put together at the end.
    """
    own = df.where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("__v"))
    v, finite = F.col("__v"), ~F.isnan("__v") & (F.abs("__v") < float("inf"))
    # about the binary exponent: m has 53 to 55 bits, and none behind the point
    e = F.when(finite, F.when(v == 0, 0).otherwise(F.floor(F.log2(F.abs(v))).cast("int") - 53))
    half = F.floor(-F.col("__e") / 2)
    m = (v * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), -F.col("__e") - half)).cast("long")
    own = own.withColumn("__e", e).withColumn("__m", F.when(F.col("__e").isNotNull(), m))
    low, high = F.col("__m").bitwiseAND((1 << 28) - 1), F.shiftright("__m", 28)
    parts = own.groupBy(*by, "__e").agg(F.sum(low).alias("__low"), F.sum(high).alias("__high"), F.sum(F.when(F.col("__e").isNull(), v)).alias("__odd"))
    known = F.when(F.col("__e").isNotNull(), F.struct(F.col("__e").alias("e"), F.col("__low").alias("low"), F.col("__high").alias("high")))
    gathered = parts.groupBy(*by).agg(F.collect_list(known).alias("__parts"), F.sum("__odd").alias("__odd"))
    total = F.arrow_udf(_rounded_once, "double")
    return gathered.select(*by, F.when(F.col("__odd").isNotNull(), F.col("__odd")).when(F.size("__parts") > 0, total("__parts")).alias(out)).where(F.col(out).isNotNull())


def with_mean(df: DataFrame, by: list[str], x: str, name: str, w: str | None = None) -> DataFrame:
    """``df`` with the (weighted) mean of its group: an aggregate, joined back, so that no group is gathered."""
    own = df.groupBy(*by).agg((weighted_mean(x, w) if w else F.avg(x)).alias(name))
    if not by:
        return df.crossJoin(F.broadcast(own))  # a single row
    return df.join(own, by)


def central_moments(df: DataFrame, by: list[str], x: str, orders: list[int]) -> DataFrame:
    """``by`` and m0, m1, ... for ``orders``: means of (x - mean)**k, in two passes; order 0 is 1, order 1 is 0."""
    if any(k < 0 for k in orders):
        raise ValueError("orders must not be negative")

    def moment(k: int) -> Column:
        if k < 2:
            return F.when(F.count(x) > 0, F.lit(float(1 - k)))
        power = d = F.col(x) - F.col("__m")
        for _ in range(k - 1):
            power = power * d
        return F.avg(power)

    return with_mean(df, by, x, "__m").groupBy(*by).agg(*[moment(k).alias(f"m{k}") for k in orders])


def weighted_variance(df: DataFrame, by: list[str], x: str, w: str) -> DataFrame:
    """``by`` and variance: sum(w (x - weighted mean)**2) / sum(w); 0 for one value or none."""
    d = F.col(x) - F.col("__m")
    own = ieee.divide(F.sum(F.col(w) * d * d), F.sum(F.when(F.col(x).isNotNull(), F.col(w))))
    return with_mean(df, by, x, "__m", w).groupBy(*by).agg(F.when(F.count(x) > 1, own).otherwise(F.lit(0.0)).alias("variance"))


def standardize(df: DataFrame, by: list[str], x: str, out: str = "z") -> DataFrame:
    """``df`` with (x - mean) / deviation of its group; null where the group has one value or no variance."""
    own = df.groupBy(*by).agg(F.avg(x).alias("__m"), F.stddev_samp(x).alias("__s"))
    joined = df.join(own, by) if by else df.crossJoin(F.broadcast(own))  # a single row
    return joined.withColumn(out, F.when(F.col("__s") > 0, (F.col(x) - F.col("__m")) / F.when(F.col("__s") > 0, F.col("__s")))).drop("__m", "__s")


def pair(left: DataFrame, right: DataFrame, idx: str, x: str, y: str) -> DataFrame:
    """(idx, x, y) of two samples by position; an error if a position is in one of them only."""
    a, b = left.select(F.col(idx), F.col(x).alias("x"), F.lit(True).alias("__a")), right.select(F.col(idx), F.col(y).alias("y"), F.lit(True).alias("__b"))
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    joined = a.join(b, idx, "full")
    return joined.select(idx, ieee.require(both, F.col("x"), "samples differ in length").alias("x"), ieee.require(both, F.col("y"), "samples differ in length").alias("y"))


# Power sums: a partial state that merges by adding.


def powers(k: int, x: X) -> list[Column]:
    """The aggregates p0, ..., pk: the sums of x**0, ..., x**k."""
    if k < 2:
        raise ValueError("at least two powers are needed")
    x, out, power = col(x).cast("double"), [F.count(col(x)).cast("double").alias("p0")], None
    for i in range(1, k + 1):
        power = x if power is None else power * x
        out.append(F.sum(power).alias(f"p{i}"))
    return out


def merge_powers(k: int) -> list[Column]:
    """The aggregates that add up stored power sums."""
    return [F.sum(f"p{i}").alias(f"p{i}") for i in range(k + 1)]


class Powers:
    """What power-sum columns p0, ..., pk tell of a sample; ``order`` is k."""

    def __init__(self, order: int):
        self.order = order
        self.count, self.sum = F.col("p0").cast("long"), F.col("p1")
        self.mean = F.when(F.col("p0") == 0, F.lit(0.0)).otherwise(ieee.divide(F.col("p1"), F.col("p0")))

    def central_moment(self, k: int) -> Column:
        """By the binomial expansion about the mean."""
        if not 0 <= k <= self.order:
            raise ValueError(f"order {k} isn't among the powers")
        if k == 0:
            return F.lit(1.0)
        total = None
        for i in range(k + 1):
            term = math.comb(k, i) * F.col(f"p{i}")
            for _ in range(k - i):
                term = term * -self.mean
            total = term if total is None else total + term
        return ieee.divide(total, F.col("p0"))

    def moments(self, df: DataFrame) -> DataFrame:
        """``df`` with mean, variance, variance_unbiased, std_dev, skewness and kurtosis: each is computed once, from
        those before. Skewness needs order 3 and kurtosis order 4."""
        n, own = F.col("p0"), df.withColumn("mean", self.mean)
        mean, sums = F.col("mean"), {2: None, 3: None, 4: None}
        for k in sums:
            if k <= self.order:  # by Horner's rule in -mean
                total = F.col("p0")
                for i in range(1, k + 1):
                    total = total * -mean + math.comb(k, i) * F.col(f"p{i}")
                own = own.withColumn(f"__m{k}", ieee.divide(total, n))
        m2 = F.col("__m2")
        out = own.withColumns({"variance": m2, "variance_unbiased": F.when(n > 1, m2 * n / F.when(n > 1, n - 1)).otherwise(F.lit(0.0)), "std_dev": F.sqrt(F.greatest(m2, F.lit(0.0)))})
        if self.order > 2:
            out = out.withColumn("skewness", ieee.divide("__m3", F.pow(m2, F.lit(1.5))))
        if self.order > 3:
            out = out.withColumn("kurtosis", ieee.divide("__m4", m2 * m2) - 3)
        return out.drop("__m2", "__m3", "__m4")

    @property
    def variance(self) -> Column:
        return self.central_moment(2)

    @property
    def std_dev(self) -> Column:
        return F.sqrt(F.greatest(self.variance, F.lit(0.0)))

    @property
    def variance_unbiased(self) -> Column:
        n = F.col("p0")
        return F.when(n > 1, self.variance * n / F.when(n > 1, n - 1)).otherwise(F.lit(0.0))

    @property
    def skewness(self) -> Column:
        return ieee.divide(self.central_moment(3), F.pow(self.variance, 1.5))

    @property
    def kurtosis(self) -> Column:
        return ieee.divide(self.central_moment(4), self.variance * self.variance) - 3
