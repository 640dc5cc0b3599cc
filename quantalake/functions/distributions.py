"""Probability distributions over columns.

Each family has ``cdf``, ``sf``, ``pdf`` (continuous) or ``pmf`` (discrete), ``logpdf`` or ``logpmf``, and, if it is
continuous, ``ppf`` and ``isf``, which take a column, a column's name or a number and return a column; ``host(name, x)``
gives the same on NumPy arrays. ``mean``, ``variance``, ``std`` and ``entropy`` (in nats) are numbers, or None where
they don't exist. ``sample(seed, *keys)`` is a column of variates: uniform numbers come from a hash of the keys, so that
they don't depend on partitions. ``fit`` of some families aggregates parameters from a column.

Choices where sources differ: the density off the support is 0 and its logarithm -inf; the complementary quantile of 0
is the upper end; entropies are in nats; location and scale move mean, variance and entropy as they should.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quantalake.functions import ieee, special
from quantalake.functions.backend import Arrays, Columns

LOG_2PI = math.log(2 * math.pi)


def uniform(seed: int, *keys: Column | str) -> Column:
    """A number in (0, 1) that the seed and the keys decide: the same in every partitioning."""
    bits = F.xxhash64(F.lit(seed), *[F.col(k) if isinstance(k, str) else k for k in keys])
    return (F.shiftrightunsigned(bits, 11).cast("double") + 0.5) * (2.0**-53)


def _positive(**values: float) -> None:
    for name, v in values.items():
        if not (v > 0 and math.isfinite(v)):
            raise ValueError(f"{name} must be positive: {v}")


def _not_negative(**values: float) -> None:
    for name, v in values.items():
        if not (v >= 0 and math.isfinite(v)):
            raise ValueError(f"{name} must not be negative: {v}")


class Distribution:
    discrete: ClassVar[bool] = False
    FUNCTIONS: ClassVar[tuple[str, ...]] = ("cdf", "sf", "pdf", "logpdf", "ppf", "isf")
    #: The functions that need special functions: they run as one Arrow function, the others as expressions.
    ARROW: ClassVar[tuple[str, ...]] = ()

    def __getattr__(self, name: str):
        names = {"pmf": "pdf", "logpmf": "logpdf"}
        if name in self.FUNCTIONS or name in names:
            name = names.get(name, name)
            own = getattr(type(self), "_" + name)
            return lambda x: special.column(partial(self.host, name), Columns.value(x)) if name in self.ARROW else own(self, Columns, Columns.value(x))
        raise AttributeError(name)

    def host(self, name: str, x):
        with np.errstate(all="ignore"):
            return getattr(self, "_" + {"pmf": "pdf", "logpmf": "logpdf"}.get(name, name))(Arrays, np.asarray(x, float))

    def _sf(self, m, x):
        return 1 - self._cdf(m, x)

    def _pdf(self, m, x):
        return m.exp(self._logpdf(m, x))

    def _logpdf(self, m, x):
        return m.log(self._pdf(m, x))

    def _isf(self, m, p):
        return self._ppf(m, 1 - p)

    mean: float | None = None
    variance: float | None = None
    entropy: float | None = None

    @property
    def std(self) -> float | None:
        return None if self.variance is None else math.sqrt(self.variance)

    def sample(self, seed: int, *keys: Column | str) -> Column:
        """Variates that the seed and the keys decide."""
        return self.variate(uniform(seed, *keys))

    def variate(self, u: Column | str) -> Column:
        """The variate that each number in (0, 1) gives: those of uniform numbers are a sample."""
        return self.ppf(u)

    def json(self) -> dict:
        return {"family": type(self).__name__} | {k: v.json() if isinstance(v, Distribution) else v for k, v in asdict_flat(self).items()}


def asdict_flat(d) -> dict:
    return {k: getattr(d, k) for k in d.__dataclass_fields__}


def find_root(cdf, density, p: Column | str, low: float, high: float) -> Column:
    """The x from ``low`` to ``high`` at which a rising ``cdf`` reaches each p, for a distribution of one's own.

    ``cdf`` and ``density`` are functions of NumPy arrays. Newton steps, and halving where they leave the interval.
    """
    solve = lambda q: special._solve(lambda x, _: cdf(x), lambda x, _: density(x), q, float(low), float(high))
    return special.column(solve, ieee.col(p))


def moments(make, *parameters: Column | str) -> Column:
    """struct(mean, variance, entropy) of the distribution that ``make`` gives for a row's parameters: for fitted ones, a
    row a group. Null where parameters are null or no distribution's, and for moments that don't exist."""
    kind = pa.struct([(n, pa.float64()) for n in ("mean", "variance", "entropy")])

    def one(*values: float) -> dict | None:
        try:
            own = make(*values)
        except (ValueError, TypeError, OverflowError):
            return None
        return {n: getattr(own, n) for n in ("mean", "variance", "entropy")}

    @F.arrow_udf("struct<mean:double,variance:double,entropy:double>")
    def run(own: pa.Array) -> pa.Array:
        return pa.array([one(*v.values()) for v in own.to_pylist()], kind)

    return run(F.struct(*[ieee.col(x).cast("double").alias(f"p{n}") for n, x in enumerate(parameters)]))


def sum_probabilities(own: Discrete, low: Column | str, high: Column | str) -> Column:
    """The probability of the outcomes from ``low`` to ``high``, both included; at most 1."""
    low, high = F.ceil(ieee.col(low)).cast("double"), F.floor(ieee.col(high)).cast("double")
    return F.when(low > high, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), own.cdf(high) - own.cdf(low - 1))))


def from_json(value: dict) -> Distribution:
    """The distribution that ``json()`` describes; parameters are checked again."""
    own = {k: from_json(v) if isinstance(v, dict) else v for k, v in value.items() if k != "family"}
    return FAMILIES[value["family"]](**own)


@dataclass(frozen=True)
class Normal(Distribution):
    ARROW = ("ppf", "isf")
    mu: float = 0.0
    sigma: float = 1.0

    def __post_init__(self):
        _positive(sigma=self.sigma)

    def _cdf(self, m, x):
        return 0.5 * m.erfc((self.mu - x) / (self.sigma * math.sqrt(2)))

    def _sf(self, m, x):
        return 0.5 * m.erfc((x - self.mu) / (self.sigma * math.sqrt(2)))

    def _logpdf(self, m, x):
        z = (x - self.mu) / self.sigma
        return -0.5 * z * z - math.log(self.sigma) - 0.5 * LOG_2PI

    def _ppf(self, m, p):
        return m.probability(p, self.mu - self.sigma * math.sqrt(2) * m.erfc_inverse(2 * p))

    def _isf(self, m, p):
        return m.probability(p, self.mu + self.sigma * math.sqrt(2) * m.erfc_inverse(2 * p))

    mean = property(lambda s: s.mu)
    variance = property(lambda s: s.sigma**2)
    entropy = property(lambda s: 0.5 * (LOG_2PI + 1) + math.log(s.sigma))

    @staticmethod
    def fit(x: Column | str) -> Column:
        """struct(mu, sigma), the maximum-likelihood ones; null for one value or none, and for a constant."""
        x = ieee.col(x)
        return F.when((F.count(x) > 1) & (F.var_pop(x) > 0), F.struct(F.avg(x).alias("mu"), F.stddev_pop(x).alias("sigma")))


@dataclass(frozen=True)
class Lognormal(Distribution):
    ARROW = ("cdf", "sf", "ppf", "isf")
    mu: float = 0.0
    sigma: float = 1.0

    def __post_init__(self):
        _positive(sigma=self.sigma)
        if self.mu + self.sigma**2 / 2 > 709:
            raise ValueError("the mean is too large for a double")

    @staticmethod
    def from_mean_std(mean: float, std: float) -> Lognormal:
        _positive(mean=mean, std=std)
        r = math.log1p((std / mean) ** 2)
        return Lognormal(math.log(mean) - r / 2, math.sqrt(r))

    def _log(self, m, x):
        return (m.log(m.where(x > 0, x, 1.0)) - self.mu) / self.sigma

    def _cdf(self, m, x):
        return m.where(x > 0, Normal()._cdf(m, self._log(m, x)), 0.0)

    def _sf(self, m, x):
        return m.where(x > 0, Normal()._sf(m, self._log(m, x)), 1.0)

    def _logpdf(self, m, x):
        z = self._log(m, x)
        return m.where(x > 0, -0.5 * z * z - math.log(self.sigma) - 0.5 * LOG_2PI - m.log(m.where(x > 0, x, 1.0)), -math.inf)

    def _ppf(self, m, p):
        return m.exp(self.mu + self.sigma * Normal()._ppf(m, p))

    def _isf(self, m, p):
        return m.exp(self.mu + self.sigma * Normal()._isf(m, p))

    mean = property(lambda s: math.exp(s.mu + s.sigma**2 / 2))
    variance = property(lambda s: math.expm1(s.sigma**2) * math.exp(2 * s.mu + s.sigma**2))
    entropy = property(lambda s: s.mu + 0.5 * (LOG_2PI + 1) + math.log(s.sigma))

    @staticmethod
    def fit(x: Column | str) -> Column:
        """struct(mu, sigma) of the logarithms, as for the normal distribution."""
        return Normal.fit(ieee.ln(ieee.col(x)))


@dataclass(frozen=True)
class Exponential(Distribution):
    rate: float

    def __post_init__(self):
        _positive(rate=self.rate)

    def _cdf(self, m, x):
        return m.where(x <= 0, 0.0, -m.expm1(-self.rate * x))

    def _sf(self, m, x):
        return m.where(x <= 0, 1.0, m.exp(-self.rate * x))

    def _logpdf(self, m, x):
        return m.where(x < 0, -math.inf, math.log(self.rate) - self.rate * x)

    def _ppf(self, m, p):
        return m.probability(p, -m.log1p(-p) / self.rate)

    def _isf(self, m, p):
        return m.probability(p, -m.log(p) / self.rate)

    mean = property(lambda s: 1 / s.rate)
    variance = property(lambda s: 1 / s.rate**2)
    entropy = property(lambda s: 1 - math.log(s.rate))

    @staticmethod
    def fit(x: Column | str) -> Column:
        """struct(rate), one over the mean; null unless the mean is positive."""
        x = ieee.col(x)
        return F.when(F.avg(x) > 0, F.struct((1 / F.when(F.avg(x) > 0, F.avg(x))).alias("rate")))


@dataclass(frozen=True)
class Gamma(Distribution):
    ARROW = ("cdf", "sf", "ppf", "isf")
    shape: float
    scale: float = 1.0

    def __post_init__(self):
        _positive(shape=self.shape, scale=self.scale)

    def _cdf(self, m, x):
        return m.gamma_p(self.shape, m.where(x > 0, x / self.scale, 0.0))

    def _sf(self, m, x):
        return m.gamma_q(self.shape, m.where(x > 0, x / self.scale, 0.0))

    def _logpdf(self, m, x):
        k, z = self.shape, m.where(x > 0, x / self.scale, 1.0)
        at_zero = math.inf if k < 1 else -math.log(self.scale) if k == 1 else -math.inf
        own = (k - 1) * m.log(z) - z - float(special.lgamma(k)) - math.log(self.scale)
        return m.where(x > 0, own, m.where(x == 0, at_zero, -math.inf))

    def _ppf(self, m, p):
        return m.probability(p, self.scale * m.gamma_p_inverse(self.shape, p))

    mean = property(lambda s: s.shape * s.scale)
    variance = property(lambda s: s.shape * s.scale**2)
    entropy = property(lambda s: s.shape + math.log(s.scale) + float(special.lgamma(s.shape)) + (1 - s.shape) * float(special.digamma(s.shape)))


@dataclass(frozen=True)
class ImproperGamma(Gamma):
    """A gamma distribution whose parameters may be 0: then all of it lies at 0, and it has no entropy."""

    def __post_init__(self):
        _not_negative(shape=self.shape, scale=self.scale)

    point = property(lambda s: s.shape == 0 or s.scale == 0)

    def _cdf(self, m, x):
        return m.where(x >= 0, 1.0, 0.0) if self.point else super()._cdf(m, x)

    def _sf(self, m, x):
        return m.where(x >= 0, 0.0, 1.0) if self.point else super()._sf(m, x)

    def _logpdf(self, m, x):
        return m.where(x == x, -math.inf, math.nan) if self.point else super()._logpdf(m, x)

    def _ppf(self, m, p):
        return m.probability(p, 0.0 * p) if self.point else super()._ppf(m, p)

    entropy = property(lambda s: None if s.point else Gamma.entropy.fget(s))


@dataclass(frozen=True)
class Beta(Distribution):
    ARROW = ("cdf", "sf", "ppf", "isf")
    alpha: float
    beta: float

    def __post_init__(self):
        _positive(alpha=self.alpha, beta=self.beta)

    def _cdf(self, m, x):
        return m.beta_i(self.alpha, self.beta, m.where(x <= 0, 0.0, m.where(x >= 1, 1.0, x)))

    def _sf(self, m, x):
        return m.beta_i(self.beta, self.alpha, m.where(x <= 0, 1.0, m.where(x >= 1, 0.0, 1 - x)))

    def _logpdf(self, m, x):
        inside = (x > 0) & (x < 1)
        z = m.where(inside, x, 0.5)
        own = (self.alpha - 1) * m.log(z) + (self.beta - 1) * m.log1p(-z) - float(special.log_beta(self.alpha, self.beta))
        return m.where(inside, own, -math.inf)

    def _ppf(self, m, p):
        return m.probability(p, m.beta_i_inverse(self.alpha, self.beta, p))

    mean = property(lambda s: s.alpha / (s.alpha + s.beta))
    variance = property(lambda s: s.alpha * s.beta / ((s.alpha + s.beta) ** 2 * (s.alpha + s.beta + 1)))

    @property
    def entropy(self) -> float:
        a, b, psi = self.alpha, self.beta, special.digamma
        return float(special.log_beta(a, b) - (a - 1) * psi(a) - (b - 1) * psi(b) + (a + b - 2) * psi(a + b))


@dataclass(frozen=True)
class ImproperBeta(Beta):
    """A beta distribution whose parameters may be 0, as for an improper prior: without alpha all of it lies at 0,
    without beta at 1, and without both half at each. It has no entropy then."""

    def __post_init__(self):
        _not_negative(alpha=self.alpha, beta=self.beta)

    point = property(lambda s: s.alpha == 0 or s.beta == 0)
    #: The probability at 0.
    at_zero = property(lambda s: 0.5 if s.alpha == s.beta else float(s.alpha == 0))

    def _cdf(self, m, x):
        return m.where(x >= 1, 1.0, m.where(x >= 0, self.at_zero, 0.0)) if self.point else super()._cdf(m, x)

    def _sf(self, m, x):
        return m.where(x >= 1, 0.0, m.where(x >= 0, 1 - self.at_zero, 1.0)) if self.point else super()._sf(m, x)

    def _logpdf(self, m, x):
        return m.where(x == x, -math.inf, math.nan) if self.point else super()._logpdf(m, x)

    def _ppf(self, m, p):
        return m.probability(p, m.where(p <= self.at_zero, 0.0, 1.0)) if self.point else super()._ppf(m, p)

    mean = property(lambda s: 1 - s.at_zero if s.point else Beta.mean.fget(s))
    variance = property(lambda s: s.at_zero * (1 - s.at_zero) if s.point else Beta.variance.fget(s))
    entropy = property(lambda s: None if s.point else Beta.entropy.fget(s))


@dataclass(frozen=True)
class ChiSquared(Distribution):
    ARROW = ("cdf", "sf", "ppf", "isf")
    df: int

    def __post_init__(self):
        _positive(df=self.df)

    _own = property(lambda s: Gamma(s.df / 2, 2.0))

    def _cdf(self, m, x):
        return self._own._cdf(m, x)

    def _sf(self, m, x):
        return self._own._sf(m, x)

    def _logpdf(self, m, x):
        return self._own._logpdf(m, x)

    def _ppf(self, m, p):
        return self._own._ppf(m, p)

    mean = property(lambda s: float(s.df))
    variance = property(lambda s: 2.0 * s.df)
    entropy = property(lambda s: s._own.entropy)


@dataclass(frozen=True)
class StudentT(Distribution):
    ARROW = ("cdf", "sf", "ppf", "isf")
    df: float

    def __post_init__(self):
        _positive(df=self.df)

    def _tail(self, m, x):
        far = x * x >= self.df
        outer = 0.5 * m.beta_i(self.df / 2, 0.5, self.df / (self.df + m.where(far, x * x, self.df)))
        inner = m.where(far, 0.0, x * x)
        return m.where(far, outer, 0.5 - 0.5 * m.beta_i(0.5, self.df / 2, inner / (self.df + inner)))

    def _cdf(self, m, x):
        tail = self._tail(m, x)
        return m.where(x <= 0, tail, 1 - tail)

    def _sf(self, m, x):
        tail = self._tail(m, x)
        return m.where(x >= 0, tail, 1 - tail)

    def _logpdf(self, m, x):
        n = self.df
        return -(n + 1) / 2 * m.log1p(x * x / n) - 0.5 * math.log(n) - float(special.log_beta(n / 2, 0.5))

    def _ppf(self, m, p):
        y = m.beta_i_inverse(self.df / 2, 0.5, m.where(p < 0.5, 2 * p, 2 * (1 - p)))
        x = m.sqrt(self.df * m.divide(1 - y, y))
        return m.probability(p, m.where(p < 0.5, -x, x))

    mean = property(lambda s: 0.0 if s.df > 1 else None)
    variance = property(lambda s: s.df / (s.df - 2) if s.df > 2 else None)

    @property
    def entropy(self) -> float:
        n, psi = self.df, special.digamma
        return float((n + 1) / 2 * (psi((n + 1) / 2) - psi(n / 2)) + 0.5 * math.log(n) + special.log_beta(n / 2, 0.5))


def student_unstandardized(df: float, mu: float, sigma: float) -> LinearTransform:
    return LinearTransform(mu, sigma, StudentT(df))


@dataclass(frozen=True)
class FisherF(Distribution):
    ARROW = ("cdf", "sf", "ppf", "isf")
    df1: float
    df2: float

    def __post_init__(self):
        _positive(df1=self.df1, df2=self.df2)

    def _share(self, m, x):
        z = m.where(x > 0, x, 0.0)
        return self.df1 * z / (self.df1 * z + self.df2)

    def _cdf(self, m, x):
        return m.where(x > 0, m.beta_i(self.df1 / 2, self.df2 / 2, self._share(m, x)), 0.0)

    def _sf(self, m, x):
        z = m.where(x > 0, x, 0.0)
        return m.where(x > 0, m.beta_i(self.df2 / 2, self.df1 / 2, self.df2 / (self.df1 * z + self.df2)), 1.0)

    def _logpdf(self, m, x):
        a, b, z = self.df1, self.df2, m.where(x > 0, x, 1.0)
        own = a / 2 * math.log(a) + b / 2 * math.log(b) + (a / 2 - 1) * m.log(z) - (a + b) / 2 * m.log(b + a * z) - float(special.log_beta(a / 2, b / 2))
        return m.where(x > 0, own, -math.inf)

    def _ppf(self, m, p):
        y = m.beta_i_inverse(self.df1 / 2, self.df2 / 2, p)
        return m.probability(p, m.divide(self.df2 * y, self.df1 * (1 - y)))

    mean = property(lambda s: s.df2 / (s.df2 - 2) if s.df2 > 2 else None)

    @property
    def variance(self) -> float | None:
        a, b = self.df1, self.df2
        return 2 * b * b * (a + b - 2) / (a * (b - 2) ** 2 * (b - 4)) if b > 4 else None

    @property
    def entropy(self) -> float:
        a, b, psi = self.df1 / 2, self.df2 / 2, special.digamma
        return float(special.log_beta(a, b) - (a - 1) * (psi(a) - psi(b)) + (a + b) * (psi(a + b) - psi(b)) + math.log(b / a))


@dataclass(frozen=True)
class Cauchy(Distribution):
    median: float = 0.0
    scale: float = 1.0

    def __post_init__(self):
        _positive(scale=self.scale)

    def _cdf(self, m, x):
        return 0.5 + m.atan((x - self.median) / self.scale) / math.pi

    def _sf(self, m, x):
        return 0.5 - m.atan((x - self.median) / self.scale) / math.pi

    def _logpdf(self, m, x):
        z = (x - self.median) / self.scale
        return -math.log(math.pi * self.scale) - m.log1p(z * z)

    def _ppf(self, m, p):
        own = self.median + self.scale * m.tan(math.pi * (p - 0.5))
        return m.probability(p, m.where(p == 0, -math.inf, m.where(p == 1, math.inf, own)))

    entropy = property(lambda s: math.log(4 * math.pi * s.scale))


@dataclass(frozen=True)
class Laplace(Distribution):
    location: float = 0.0
    scale: float = 1.0

    def __post_init__(self):
        _positive(scale=self.scale)

    def _cdf(self, m, x):
        z = (x - self.location) / self.scale
        return m.where(z <= 0, 0.5 * m.exp(-m.abs(z)), 1 - 0.5 * m.exp(-m.abs(z)))

    def _sf(self, m, x):
        z = (x - self.location) / self.scale
        return m.where(z <= 0, 1 - 0.5 * m.exp(-m.abs(z)), 0.5 * m.exp(-m.abs(z)))

    def _logpdf(self, m, x):
        return -m.abs(x - self.location) / self.scale - math.log(2 * self.scale)

    def _ppf(self, m, p):
        own = m.where(p < 0.5, m.log(2 * p), -m.log(2 - 2 * p))
        return m.probability(p, self.location + self.scale * own)

    mean = property(lambda s: s.location)
    variance = property(lambda s: 2 * s.scale**2)
    entropy = property(lambda s: 1 + math.log(2 * s.scale))


@dataclass(frozen=True)
class Uniform(Distribution):
    a: float = 0.0
    b: float = 1.0

    def __post_init__(self):
        if self.a == self.b or not (math.isfinite(self.a) and math.isfinite(self.b)):
            raise ValueError("the ends must differ")
        low, high = min(self.a, self.b), max(self.a, self.b)
        object.__setattr__(self, "a", low)
        object.__setattr__(self, "b", high)

    def _cdf(self, m, x):
        return m.where(x < self.a, 0.0, m.where(x > self.b, 1.0, (x - self.a) / (self.b - self.a)))

    def _pdf(self, m, x):
        return m.where((x >= self.a) & (x <= self.b), 1 / (self.b - self.a), 0.0)

    def _ppf(self, m, p):
        return m.probability(p, self.a + (self.b - self.a) * p)

    mean = property(lambda s: (s.a + s.b) / 2)
    variance = property(lambda s: (s.b - s.a) ** 2 / 12)
    entropy = property(lambda s: math.log(s.b - s.a))


@dataclass(frozen=True)
class Weibull(Distribution):
    shape: float = 1.0
    scale: float = 1.0

    def __post_init__(self):
        _positive(shape=self.shape, scale=self.scale)

    @staticmethod
    def from_mean_std(mean: float, std: float) -> Weibull:
        """By the approximation shape = (std/mean)**-1.086, for ratios from 0.033 to 1.45."""
        if not 0.033 <= std / mean <= 1.45:
            raise ValueError(f"std/mean is outside [0.033, 1.45]: {std / mean}")
        k = (std / mean) ** -1.086
        return Weibull(k, mean / math.gamma(1 + 1 / k))

    def _z(self, m, x):
        return m.power(m.where(x > 0, x / self.scale, 0.0), self.shape)

    def _cdf(self, m, x):
        return m.where(x > 0, -m.expm1(-self._z(m, x)), 0.0)

    def _sf(self, m, x):
        return m.where(x > 0, m.exp(-self._z(m, x)), 1.0)

    def _logpdf(self, m, x):
        z = m.where(x > 0, x / self.scale, 1.0)
        own = (self.shape - 1) * m.log(z) + math.log(self.shape / self.scale) - m.power(z, self.shape)
        at_zero = math.inf if self.shape < 1 else math.log(self.shape / self.scale) if self.shape == 1 else -math.inf
        return m.where(x > 0, own, m.where(x == 0, at_zero, -math.inf))

    def _ppf(self, m, p):
        return m.probability(p, self.scale * m.power(-m.log1p(-p), 1 / self.shape))

    def _isf(self, m, p):
        return m.probability(p, self.scale * m.power(-m.log(p), 1 / self.shape))

    mean = property(lambda s: s.scale * math.gamma(1 + 1 / s.shape))
    variance = property(lambda s: s.scale**2 * (math.gamma(1 + 2 / s.shape) - math.gamma(1 + 1 / s.shape) ** 2))
    entropy = property(lambda s: special.EULER * (1 - 1 / s.shape) + math.log(s.scale / s.shape) + 1)

    @staticmethod
    def fit(x: Column | str) -> Column:
        """struct(shape, scale) from mean and unbiased deviation; null outside the range of the approximation."""
        x = ieee.col(x)
        ratio = F.when((F.count(x) > 1) & (F.avg(x) > 0), F.coalesce(F.stddev_samp(x), F.lit(0.0)) / F.when(F.avg(x) > 0, F.avg(x)))
        k = F.pow(F.when((ratio >= 0.033) & (ratio <= 1.45), ratio), -1.086)
        scale = F.avg(x) / F.exp(special.column(special.lgamma, 1 + 1 / k))
        return F.when(k.isNotNull(), F.struct(k.alias("shape"), scale.alias("scale")))


class Discrete(Distribution):
    discrete = True
    FUNCTIONS = ("cdf", "sf", "pdf", "logpdf")

    def _whole(self, m, x):
        return (m.floor(x) == x) & (x >= self.low)

    low: ClassVar[float] = 0.0

    def support(self, mass: float = 1e-16) -> np.ndarray:
        """Outcomes that hold all but ``mass`` of the probability, for sums on the host."""
        top = self.low + 64
        while self.host("sf", top) > mass:
            top *= 2
        return np.arange(self.low, top + 1)

    @property
    def entropy(self) -> float:
        p = self.host("pmf", self.support())
        p = p[p > 0]
        return float(-(p * np.log(p)).sum())


@dataclass(frozen=True)
class Binomial(Discrete):
    ARROW = ("cdf", "sf", "pdf", "logpdf")
    n: int
    p: float

    def __post_init__(self):
        if self.n < 0 or not 0 <= self.p <= 1:
            raise ValueError("n must not be negative, and p from 0 to 1")

    def _cdf(self, m, x):
        k = m.floor(x)
        inside = m.where(k < 0, 0.0, m.where(k >= self.n, 0.0, k))
        return m.number(x, m.where(k < 0, 0.0, m.where(k >= self.n, 1.0, m.beta_i(self.n - inside, inside + 1, 1 - self.p))))

    def _sf(self, m, x):
        k = m.floor(x)
        inside = m.where(k < 0, 0.0, m.where(k >= self.n, 0.0, k))
        return m.number(x, m.where(k < 0, 1.0, m.where(k >= self.n, 0.0, m.beta_i(inside + 1, self.n - inside, self.p))))

    def _logpdf(self, m, x):
        ok = self._whole(m, x) & (x <= self.n)
        if self.p in (0, 1):
            return m.where(ok & (x == self.n * self.p), 0.0, -math.inf)
        k = m.where(ok, x, 0.0)
        own = float(special.lgamma(self.n + 1)) - m.lgamma(k + 1) - m.lgamma(self.n - k + 1) + k * math.log(self.p) + (self.n - k) * math.log1p(-self.p)
        return m.where(ok, own, -math.inf)

    def support(self, mass: float = 0) -> np.ndarray:
        return np.arange(self.n + 1.0)

    mean = property(lambda s: s.n * s.p)
    variance = property(lambda s: s.n * s.p * (1 - s.p))


@dataclass(frozen=True)
class Poisson(Discrete):
    ARROW = ("cdf", "sf", "pdf", "logpdf")
    rate: float

    def __post_init__(self):
        if not (self.rate >= 0 and math.isfinite(self.rate)):
            raise ValueError("the rate must not be negative")

    def _cdf(self, m, x):
        k = m.floor(m.where(x < 0, 0.0, x))
        return m.number(x, m.where(x < 0, 0.0, m.gamma_q(k + 1, self.rate)))

    def _sf(self, m, x):
        k = m.floor(m.where(x < 0, 0.0, x))
        return m.number(x, m.where(x < 0, 1.0, m.gamma_p(k + 1, self.rate)))

    def _logpdf(self, m, x):
        ok = self._whole(m, x)
        if self.rate == 0:
            return m.where(ok & (x == 0), 0.0, -math.inf)
        k = m.where(ok, x, 0.0)
        return m.where(ok, k * math.log(self.rate) - self.rate - m.lgamma(k + 1), -math.inf)

    def variate(self, u: Column | str) -> Column:
        """Inverse transform within Arrow batches: the least k whose cumulative probability reaches the uniform."""
        table = np.cumsum(self.host("pmf", self.support()))
        return special.column(lambda u: np.searchsorted(table, u), ieee.col(u)).cast("long")

    mean = property(lambda s: s.rate)
    variance = property(lambda s: s.rate)


@dataclass(frozen=True)
class Geometric(Discrete):
    """The number of trials up to the first success: 1, 2, ..."""

    p: float
    low = 1.0

    def __post_init__(self):
        if not 0 < self.p <= 1:
            raise ValueError("p must be above 0, and at most 1")

    def _shift(self, m, x):
        return x - (self.low - 1)

    def _cdf(self, m, x):
        k = m.floor(self._shift(m, m.where(x < self.low, self.low, x)))
        some = 1.0 if self.p == 1 else -m.expm1(k * math.log1p(-self.p))
        return m.number(x, m.where(x < self.low, 0.0, some))

    def _sf(self, m, x):
        k = m.floor(self._shift(m, m.where(x < self.low, self.low, x)))
        some = 0.0 if self.p == 1 else m.exp(k * math.log1p(-self.p))
        return m.number(x, m.where(x < self.low, 1.0, some))

    def _logpdf(self, m, x):
        ok = self._whole(m, x)
        if self.p == 1:
            return m.where(ok & (x == self.low), 0.0, -math.inf)
        k = self._shift(m, m.where(ok, x, self.low))
        return m.where(ok, math.log(self.p) + (k - 1) * math.log1p(-self.p), -math.inf)

    def variate(self, u: Column | str) -> Column:
        if self.p == 1:
            return F.lit(int(self.low)).cast("long")
        return (F.floor(F.ln(ieee.col(u)) / math.log1p(-self.p)) + int(self.low)).cast("long")

    mean = property(lambda s: 1 / s.p + s.low - 1)
    variance = property(lambda s: (1 - s.p) / s.p**2)
    entropy = property(lambda s: 0.0 if s.p == 1 else -(s.p * math.log(s.p) + (1 - s.p) * math.log1p(-s.p)) / s.p)


@dataclass(frozen=True)
class Geometric0(Geometric):
    """The number of failures before the first success: 0, 1, ..."""

    low = 0.0


@dataclass(frozen=True)
class NegativeBinomial(Discrete):
    """Failures before the r-th success; r needn't be whole."""

    ARROW = ("cdf", "sf", "pdf", "logpdf")
    r: float
    p: float

    def __post_init__(self):
        _positive(r=self.r)
        if not 0 < self.p <= 1:
            raise ValueError("p must be above 0, and at most 1")

    def _cdf(self, m, x):
        k = m.floor(m.where(x < 0, 0.0, x))
        return m.number(x, m.where(x < 0, 0.0, m.beta_i(self.r, k + 1, self.p)))

    def _sf(self, m, x):
        k = m.floor(m.where(x < 0, 0.0, x))
        return m.number(x, m.where(x < 0, 1.0, m.beta_i(k + 1, self.r, 1 - self.p)))

    def _logpdf(self, m, x):
        ok = self._whole(m, x)
        if self.p == 1:
            return m.where(ok & (x == 0), 0.0, -math.inf)
        k = m.where(ok, x, 0.0)
        own = m.lgamma(k + self.r) - m.lgamma(k + 1) - float(special.lgamma(self.r)) + self.r * math.log(self.p) + k * math.log1p(-self.p)
        return m.where(ok, own, -math.inf)

    mean = property(lambda s: s.r * (1 - s.p) / s.p)
    variance = property(lambda s: s.r * (1 - s.p) / s.p**2)


@dataclass(frozen=True)
class Hypergeometric(Discrete):
    """Marked ones among k drawn from l, of which m are marked."""

    ARROW = ("cdf", "sf", "pdf", "logpdf")
    m: int
    l: int  # noqa: E741
    k: int

    def __post_init__(self):
        if not (self.l > 0 and 0 <= self.m <= self.l and 0 < self.k <= self.l):
            raise ValueError("l must be positive, m from 0 to l, k from 1 to l")

    first = property(lambda s: max(0, s.m + s.k - s.l))
    last = property(lambda s: min(s.m, s.k))

    def support(self, mass: float = 0) -> np.ndarray:
        return np.arange(self.first, self.last + 1.0)

    def _masses(self) -> np.ndarray:
        return np.array([math.comb(self.m, i) * math.comb(self.l - self.m, self.k - i) / math.comb(self.l, self.k) for i in range(self.first, self.last + 1)])

    def _cdf(self, m, x):
        sums, first, last = np.cumsum(self._masses()), self.first, self.last
        at = lambda v: np.where(v < first, 0.0, np.where(v >= last, 1.0, sums[np.clip(np.floor(v), first, last).astype(int) - first]))
        return m.number(x, m.call(at, m.where(m.isnan(x), 0.0, x)))

    def _sf(self, m, x):
        sums, first, last = np.append(np.cumsum(self._masses()[::-1])[::-1][1:], 0), self.first, self.last
        at = lambda v: np.where(v < first, 1.0, np.where(v >= last, 0.0, sums[np.clip(np.floor(v), first, last).astype(int) - first]))
        return m.number(x, m.call(at, m.where(m.isnan(x), 0.0, x)))

    def _pdf(self, m, x):
        own, first, last = self._masses(), self.first, self.last
        at = lambda v: np.where((v >= first) & (v <= last) & (np.floor(v) == v), own[np.clip(np.nan_to_num(np.floor(v)), first, last).astype(int) - first], 0.0)
        return m.call(at, x)

    mean = property(lambda s: s.k * s.m / s.l)
    variance = property(lambda s: 0.0 if s.l == 1 else s.k * s.m / s.l * (1 - s.m / s.l) * (s.l - s.k) / (s.l - 1))


@dataclass(frozen=True)
class DiscreteUniform(Discrete):
    a: int
    b: int

    def __post_init__(self):
        low, high = min(self.a, self.b), max(self.a, self.b)
        object.__setattr__(self, "a", low)
        object.__setattr__(self, "b", high)

    @staticmethod
    def to(n: int) -> DiscreteUniform:
        """1, ..., n"""
        if n < 1:
            raise ValueError("n must be positive")
        return DiscreteUniform(1, n)

    size = property(lambda s: s.b - s.a + 1)

    def _cdf(self, m, x):
        return m.where(x < self.a, 0.0, m.where(x >= self.b, 1.0, (m.floor(m.where((x >= self.a) & (x < self.b), x, float(self.a))) - self.a + 1) / self.size))

    def _pdf(self, m, x):
        return m.where((x >= self.a) & (x <= self.b) & (m.floor(x) == x), 1.0 / self.size, 0.0)

    def support(self, mass: float = 0) -> np.ndarray:
        return np.arange(self.a, self.b + 1.0)

    def variate(self, u: Column | str) -> Column:
        return (F.floor(ieee.col(u) * self.size) + self.a).cast("long")

    mean = property(lambda s: (s.a + s.b) / 2)
    variance = property(lambda s: (s.size**2 - 1) / 12)
    entropy = property(lambda s: math.log(s.size))


@dataclass(frozen=True)
class LinearTransform(Distribution):
    """location + scale * X, for a continuous X."""

    location: float
    scale: float
    base: Distribution

    def __post_init__(self):
        _positive(scale=self.scale)

    ARROW = property(lambda s: s.base.ARROW)

    @staticmethod
    def around(point: float, factor: float, base: Distribution) -> LinearTransform:
        """``base`` stretched by ``factor`` around ``point``, which stays where it is."""
        return LinearTransform(point * (1 - factor), factor, base)

    @property
    def fixed_point(self) -> float:
        return self.location / (1 - self.scale) if self.scale != 1 else math.nan

    def _in(self, x):
        return (x - self.location) / self.scale

    def _cdf(self, m, x):
        return self.base._cdf(m, self._in(x))

    def _sf(self, m, x):
        return self.base._sf(m, self._in(x))

    def _logpdf(self, m, x):
        return self.base._logpdf(m, self._in(x)) - math.log(self.scale)

    def _ppf(self, m, p):
        return self.location + self.scale * self.base._ppf(m, p)

    def _isf(self, m, p):
        return self.location + self.scale * self.base._isf(m, p)

    mean = property(lambda s: None if s.base.mean is None else s.location + s.scale * s.base.mean)
    variance = property(lambda s: None if s.base.variance is None else s.scale**2 * s.base.variance)
    entropy = property(lambda s: None if s.base.entropy is None else s.base.entropy + math.log(s.scale))


FAMILIES = {c.__name__: c for c in (Normal, Lognormal, Exponential, Gamma, ImproperGamma, Beta, ImproperBeta, ChiSquared, StudentT, FisherF, Cauchy, Laplace, Uniform, Weibull, Binomial, Poisson, Geometric, Geometric0, NegativeBinomial, Hypergeometric, DiscreteUniform, LinearTransform)}
__all__ = [*FAMILIES, "FAMILIES", "Distribution", "find_root", "from_json", "student_unstandardized", "sum_probabilities", "uniform"]
