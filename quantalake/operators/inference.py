"""Confidence levels, p-values, estimates with errors, and confidence intervals for counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quantalake.functions import special
from quantalake.functions.distributions import Normal
from quantalake.functions.ieee import col


@dataclass(frozen=True)
class CL:
    """A confidence level, kept as its significance 1 - level; larger levels are larger."""

    significance: float

    def __post_init__(self):
        if not 0 <= self.significance <= 1:
            raise ValueError(f"a confidence level must be in [0,1]: {1 - self.significance}")

    @staticmethod
    def of(level: float) -> CL:
        return CL(1 - level)

    level = property(lambda s: 1 - s.significance)

    def __lt__(self, other: CL) -> bool:
        return self.significance > other.significance


CL90, CL95, CL99 = CL(0.10), CL(0.05), CL(0.01)


@dataclass(frozen=True, order=True)
class PValue:
    value: float

    def __post_init__(self):
        if not 0 <= self.value <= 1:
            raise ValueError(f"a p-value must be in [0,1]: {self.value}")


def n_sigma(n: float) -> PValue:
    """The two-tailed p-value of n standard deviations."""
    if n <= 0:
        raise ValueError("n must be positive")
    return PValue(float(2 * Normal().host("sf", n)))


def n_sigma_1(n: float) -> PValue:
    """The one-tailed one."""
    if n <= 0:
        raise ValueError("n must be positive")
    return PValue(float(Normal().host("sf", n)))


def get_n_sigma(p: Column | str) -> Column:
    """Standard deviations of a two-tailed p-value."""
    return Normal().isf(col(p) / 2)


def get_n_sigma_1(p: Column | str) -> Column:
    return Normal().isf(col(p))


def normal_error(point: Column, sigma: Column) -> Column:
    """struct(point, sigma)"""
    return F.struct(point.alias("point"), sigma.alias("sigma"))


def from_errors(point: Column, below: Column, above: Column, cl: CL) -> Column:
    """struct(point, ldx, udx, alpha): distances to the ends of the interval."""
    return F.struct(point.alias("point"), below.alias("ldx"), above.alias("udx"), F.lit(cl.significance).alias("alpha"))


def from_interval(point: Column, low: Column, high: Column, cl: CL) -> Column:
    return from_errors(point, point - low, high - point, cl)


def interval(estimate: Column) -> Column:
    """struct(lo, hi)"""
    return F.struct((estimate["point"] - estimate["ldx"]).alias("lo"), (estimate["point"] + estimate["udx"]).alias("hi"))


def asymmetric_errors(estimate: Column) -> Column:
    return F.struct(estimate["ldx"].alias("ldx"), estimate["udx"].alias("udx"))


def scale(factor: float, estimate: Column, normal: bool = False) -> Column:
    """The estimate times a number; a negative one swaps the errors."""
    a = F.lit(float(factor))
    if normal:
        return normal_error(a * estimate["point"], F.abs(a) * estimate["sigma"])
    low, high = ("udx", "ldx") if factor < 0 else ("ldx", "udx")
    return F.struct((a * estimate["point"]).alias("point"), (F.abs(a) * estimate[low]).alias("ldx"), (F.abs(a) * estimate[high]).alias("udx"), estimate["alpha"].alias("alpha"))


def upper_limit(limit: Column, cl: CL) -> Column:
    return F.struct(limit.alias("limit"), F.lit(cl.significance).alias("alpha"))


lower_limit = upper_limit


def _need(condition: Column, out: Column, message: str) -> Column:
    return F.when(F.assert_true(condition, F.lit(message)).isNull(), out)


def poisson_normal_ci(n: Column | str) -> Column:
    """struct(point, sigma): n and its root."""
    n = col(n).cast("double")
    return _need(n >= 0, normal_error(n, F.sqrt(F.abs(n))), "the count must not be negative")


def poisson_ci(cl: CL, n: Column | str) -> Column:
    """The exact interval of a Poisson mean: halves of chi-squared quantiles with 2n and 2n + 2 degrees of freedom."""
    n, a = col(n).cast("double"), cl.significance / 2
    low = F.when(n == 0, F.lit(0.0)).otherwise(special.column(special.gamma_p_inverse, F.greatest(n, F.lit(0.5)), F.lit(a)))
    high = special.column(special.gamma_p_inverse, F.abs(n) + 1, F.lit(1 - a))
    return _need(n >= 0, from_interval(n, low, high, cl), "the count must not be negative")


def naive_binomial_ci(n: Column | str, k: Column | str) -> Column:
    """struct(point, sigma): the share k/n and its normal error."""
    n, k = col(n).cast("double"), col(k).cast("double")
    p = k / F.when(n > 0, n)
    return _need((n > 0) & (k >= 0) & (k <= n), normal_error(p, F.sqrt(F.abs(p * (1 - p)) / F.when(n > 0, n))), "0 <= k <= n and n > 0 are needed")


def binomial_ci(cl: CL, n: Column | str, k: Column | str) -> Column:
    """The exact (Clopper-Pearson) interval of a share. It ends at 0 for k = 0, and at 1 for k = n."""
    n, k, a = col(n).cast("double"), col(k).cast("double"), cl.significance / 2
    one = F.lit(1.0)
    low = F.when(k == 0, F.lit(0.0)).otherwise(special.column(special.beta_i_inverse, F.greatest(k, one), F.greatest(n - k + 1, one), F.lit(a)))
    high = F.when(k == n, F.lit(1.0)).otherwise(special.column(special.beta_i_inverse, F.greatest(k + 1, one), F.greatest(n - k, one), F.lit(1 - a)))
    return _need((n > 0) & (k >= 0) & (k <= n), from_interval(k / F.when(n > 0, n), low, high, cl), "0 <= k <= n and n > 0 are needed")
