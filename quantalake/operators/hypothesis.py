"""Hypothesis tests of all groups at once.

A test takes a long table: ``by`` columns, a value, and a column that tells the samples apart. Aggregates reduce each
group to a row; an Arrow function turns that into a p-value. Tests return ``by``, the test value ``stat``, the p-value
``p`` and, where there are some, degrees of freedom; where a sample is too small for the test they are null.

``position`` is DIFFER, A_GREATER or B_GREATER: the alternative.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantalake.functions import ieee, special
from quantalake.functions.distributions import Normal
from quantalake.operators.quantiles import MEDIAN_UNBIASED, median
from quantalake.operators.ranks import apart, running, value_ranks, values, with_ranks

DIFFER, A_GREATER, B_GREATER = "differ", "a_greater", "b_greater"
#: Values up to which Kolmogorov-Smirnov probabilities are exact, and terms up to which those of runs are all summed.
KS_EXACT, RUNS_TERMS = 2000, 1 << 22


def significant(p: Column | str, alpha: float) -> Column:
    """Whether a p-value is at most the level."""
    return ieee.col(p) <= alpha


def test_result(stat: Column | str, p: Column | str, family: str, *parameters: Column | str | float) -> Column:
    """struct(value, p, distribution): what a test says, and how its value is distributed if nothing differs."""
    own = F.struct(F.lit(family).alias("family"), F.array(*[ieee.col(x).cast("double") for x in parameters]).alias("parameters"))
    return F.struct(ieee.col(stat).cast("double").alias("value"), ieee.col(p).cast("double").alias("p"), own.alias("distribution"))


def _t_tail(t, df):
    """P(T >= |t|)"""
    return 0.5 * special.beta_i(df / 2, 0.5, df / (df + t * t))


def t_significance(position: str, df: Column, t: Column) -> Column:
    tail = special.column(_t_tail, t, df)
    if position == DIFFER:
        return 2 * tail
    up = t if position == A_GREATER else -t
    return F.when(up >= 0, tail).otherwise(1 - tail)


def _two(df: DataFrame, by: list[str], is_a: Column, x: str) -> DataFrame:
    a, b = F.when(is_a, F.col(x)), F.when(~is_a, F.col(x))
    stats = {"n1": F.count(a), "n2": F.count(b), "m1": F.avg(a), "m2": F.avg(b), "v1": F.var_samp(a), "v2": F.var_samp(b)}
    return df.groupBy(*by).agg(*[c.cast("double").alias(k) for k, c in stats.items()])


def _t_row(own: DataFrame, by: list[str], position: str, ok: Column, t: Column, df: Column) -> DataFrame:
    own = own.select(*by, F.when(ok, t).alias("stat"), F.when(ok, df).alias("df"))
    return own.select(*by, "stat", "df", t_significance(position, F.col("df"), F.col("stat")).alias("p"))


def student_t_test(df: DataFrame, by: list[str], is_a: Column, x: str, position: str = DIFFER) -> DataFrame:
    """Two samples of equal variance."""
    own, (n1, n2, v1, v2) = _two(df, by, is_a, x), (F.col(c) for c in ("n1", "n2", "v1", "v2"))
    free = n1 + n2 - 2
    pooled = ((n1 - 1) * v1 + (n2 - 1) * v2) / F.when(free > 0, free)
    t = ieee.divide(F.col("m1") - F.col("m2"), F.sqrt(pooled * (1 / n1 + 1 / n2)))
    return _t_row(own, by, position, (n1 > 1) & (n2 > 1), t, free)


def welch_t_test(df: DataFrame, by: list[str], is_a: Column, x: str, position: str = DIFFER) -> DataFrame:
    """Two samples of any variances."""
    own = _two(df, by, is_a, x)
    s1, s2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    t = ieee.divide(F.col("m1") - F.col("m2"), F.sqrt(s1 + s2))
    ok = (F.col("n1") > 1) & (F.col("n2") > 1)
    free = ieee.divide((s1 + s2) * (s1 + s2), s1 * s1 / F.when(ok, F.col("n1") - 1) + s2 * s2 / F.when(ok, F.col("n2") - 1))
    return _t_row(own, by, position, ok, F.when(ok, t), F.when(ok, free))


def paired_t_test(df: DataFrame, by: list[str], x: str, y: str, position: str = DIFFER) -> DataFrame:
    d = F.col(x) - F.col(y)
    own = df.groupBy(*by).agg(F.count(d).cast("double").alias("__n"), F.avg(d).alias("__m"), F.var_samp(d).alias("__v"))
    n = F.col("__n")
    ok = n > 1
    t = ieee.divide(F.col("__m"), F.sqrt(F.col("__v") / n))
    return _t_row(own, by, position, ok, F.when(ok, t), n - 1)


# Ranks of two samples


@apart
def rank_sums(df: DataFrame, by: list[str], is_a: Column, x: str) -> DataFrame:
    """``by``, n1, n2 and the sums w1, w2 of the ranks of both samples."""
    own = value_ranks(df, by, x, F.count(F.when(is_a, 1)).alias("na"))
    nb = F.col("n") - F.col("na")
    return own.groupBy(*by).agg(F.sum("na").alias("n1"), F.sum(nb).alias("n2"), F.sum(F.col("na") * F.col("rank")).alias("w1"), F.sum(nb * F.col("rank")).alias("w2"))


@apart
def mann_whitney_u(df: DataFrame, by: list[str], is_a: Column, x: str) -> DataFrame:
    """``by``, n1, n2, u1, u2."""
    own = rank_sums(df, by, is_a, x)
    u = lambda k: F.col(f"w{k}") - F.col(f"n{k}") * (F.col(f"n{k}") + 1) / 2
    return own.select(*by, "n1", "n2", u(1).alias("u1"), u(2).alias("u2"))


@lru_cache(maxsize=4096)
def _u_counts(m: int, n: int) -> tuple[int, ...]:
    """How many arrangements of m and n have U = 0, 1, ..., m n: coefficients of the Gaussian binomial."""
    counts = [1]
    for i in range(1, m + 1):  # times (1 - q**(n+i)), over (1 - q**i)
        wide = counts + [0] * (n + i)
        for k in range(len(wide) - 1, n + i - 1, -1):
            wide[k] -= wide[k - n - i]
        for k in range(i, len(wide)):
            wide[k] += wide[k - i]
        counts = wide[: i * n + 1]
    return tuple(counts)


@lru_cache(maxsize=4096)
def mann_whitney_critical(m: int, n: int, p: float) -> int | None:
    """The largest U whose cumulative probability is below p; None where there can't be any."""
    if m < 1 or n < 1:
        return None
    limit = comb(m + n, n) * p
    if limit <= 1:
        return None
    total, at = 0, -1
    for u, c in enumerate(_u_counts(m, n)):
        total += c
        if total >= limit:
            break
        at = u
    return at if at >= 0 else None


def _or_null(f: Callable, *columns: Column | str) -> Column:
    """A whole number by row from a cached function of whole numbers; null where it has none."""
    each = lambda *own: np.array([np.nan if (c := f(*map(int, row))) is None else c for row in zip(*own, strict=True)], float)
    found = special.column(each, *[ieee.col(c).cast("double") for c in columns])
    return F.when(~F.isnan(found), found.cast("long"))


def mann_whitney_critical_value(m: Column | str, n: Column | str, p: float) -> Column:
    """``mann_whitney_critical`` of columns of sample sizes."""
    return _or_null(lambda a, b: mann_whitney_critical(a, b, p), m, n)


def _u_significant(position: str, p: float) -> Callable:
    z = Normal()

    def each(n1: float, n2: float, u1: float, u2: float) -> float:
        if n1 > 20 or n2 > 20:
            mean, sigma = n1 * n2 / 2, np.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
            score = (mean - u1) / sigma
            if position == DIFFER:
                return float(abs(score) > abs(float(z.host("ppf", p / 2))))
            return float((score if position == B_GREATER else -score) > abs(float(z.host("ppf", p))))
        critical = mann_whitney_critical(int(n1), int(n2), p)
        if critical is None:
            return np.nan
        low = min(u1, u2) if position == DIFFER else u2 if position == A_GREATER else u1
        return float(low <= critical)

    return lambda *own: np.array([each(*row) for row in zip(*own, strict=True)], float).reshape(len(own[0]))


@apart
def mann_whitney_test(df: DataFrame, by: list[str], is_a: Column, x: str, p: float, position: str = DIFFER) -> DataFrame:
    """``by``, n1, n2, u1, u2 and significant: exact up to 20 values a sample, else by the normal approximation.

    The exact test compares both tails at p, the approximation at p/2. Null where no U can be significant.
    """
    own = mann_whitney_u(df, by, is_a, x)
    said = special.column(_u_significant(position, p), *[F.col(c).cast("double") for c in ("n1", "n2", "u1", "u2")])
    return own.withColumn("significant", F.when(~F.isnan(said), said == 1))


# Signed ranks


@apart
def signed_ranks(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """``by``, n (pairs that differ), t_plus, and t_minus, which isn't positive."""
    own = df.withColumn("__d", (F.col(x) - F.col(y)).cast("double"))
    groups = own.groupBy(*by).agg(F.count("__d").alias("all"))
    ranks = value_ranks(own.where("__d <> 0").withColumn("__a", F.abs("__d")), by, "__a", F.count(F.when(F.col("__d") > 0, 1)).alias("up"))
    sums = ranks.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(F.col("up") * F.col("rank")).alias("t_plus"), (-F.sum((F.col("n") - F.col("up")) * F.col("rank"))).alias("t_minus"))
    joined = groups.join(sums, by, "left") if by else groups.crossJoin(F.broadcast(sums))  # a single row
    return joined.select(*by, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("t_plus", F.lit(0.0)).alias("t_plus"), (F.coalesce("t_minus", F.lit(0.0)) + 0.0).alias("t_minus"))


@lru_cache(maxsize=1024)
def signed_rank_sums(n: int) -> tuple[int, ...]:
    """How many sets of ranks 1..n have a sum of at most 0, 1, ..., n(n+1)/2."""
    if not 1 <= n <= 1023:
        raise ValueError(f"n must be from 1 to 1023: {n}")
    counts = [1]
    for r in range(1, n + 1):
        wide = counts + [0] * r
        for k in range(len(counts)):
            wide[k + r] += counts[k]
        counts = wide
    total, out = 0, []
    for c in counts:
        total += c
        out.append(total)
    return tuple(out)


def _signed_normal(n: int) -> tuple[float, float]:
    return n * (n + 1) / 4, float(np.sqrt(n * (n + 1) * (2 * n + 1) / 24))


@lru_cache(maxsize=4096)
def signed_rank_critical(n: int, p: float) -> int | None:
    """The largest T that is significant at p: exact below 100 pairs."""
    if n < 100:
        limit = p * 2**n
        at = next((k for k, c in enumerate(signed_rank_sums(n)) if c > limit), None)
        return at - 1 if at else None
    mean, sigma = _signed_normal(n)
    return round(mean + sigma * float(Normal().host("ppf", p)))


@lru_cache(maxsize=65536)
def signed_rank_significance(n: int, t: float) -> float:
    """P(T <= t)"""
    if n < 100:
        sums = signed_rank_sums(n)
        return sums[min(int(t), len(sums) - 1)] / 2**n
    mean, sigma = _signed_normal(n)
    return float(Normal().host("cdf", (t - mean) / sigma))


def signed_rank_critical_value(n: Column | str, p: float) -> Column:
    """``signed_rank_critical`` of a column of numbers of pairs; null without any."""
    return _or_null(lambda k: signed_rank_critical(k, p) if k > 0 else None, n)


def _signed_p(position: str) -> Callable:
    def each(n: float, plus: float, minus: float) -> float:
        if n < 1:
            return np.nan
        own = {DIFFER: min(plus, abs(minus)), A_GREATER: abs(minus), B_GREATER: plus}[position]
        p = signed_rank_significance(int(n), own)
        return min(1.0, 2 * p) if position == DIFFER else p

    return lambda *own: np.array([each(*row) for row in zip(*own, strict=True)], float)


@apart
def wilcoxon_signed_rank_test(df: DataFrame, by: list[str], x: str, y: str, position: str = DIFFER, p: float | None = None) -> DataFrame:
    """``by``, n, t_plus, t_minus, p and, with a level ``p``, significant by the critical value.

    Both are null for a group whose pairs are all equal.
    """
    own = signed_ranks(df, by, x, y)
    found = special.column(_signed_p(position), *[F.col(c).cast("double") for c in ("n", "t_plus", "t_minus")])
    out = own.withColumn("p", F.when(~F.isnan(found), found))
    if p is not None:
        level = p / 2 if position == DIFFER else p
        critical = special.column(lambda n: np.array([np.nan if k < 1 or (c := signed_rank_critical(int(k), level)) is None else c for k in n], float), F.col("n").cast("double"))
        t = {DIFFER: F.least("t_plus", F.abs("t_minus")), A_GREATER: F.abs("t_minus"), B_GREATER: F.col("t_plus")}[position]
        out = out.withColumn("significant", F.when(~F.isnan(critical), t <= critical))
    return out


# Several samples


@apart
def kruskal_rank(df: DataFrame, by: list[str], sample: str, x: str) -> DataFrame:
    """``by``, sample, rank and n: the ranks among all values of the group, and how often the sample has each."""
    return with_ranks(df, by, x, "__r").groupBy(*by, sample, F.col("__r").alias("rank")).agg(F.count("*").alias("n"))


@apart
def kruskal_wallis(df: DataFrame, by: list[str], sample: str, x: str) -> DataFrame:
    """``by``, stat (ties are accounted for), k samples, df, p; p is null where a sample has fewer than 5 values."""
    own = values(df.where(F.col(sample).isNotNull()), [*by, sample], x)
    ranks = value_ranks(df.where(F.col(sample).isNotNull()), by, x).select(*by, x, "rank")
    joined = own.join(ranks, [*by, x])
    each = joined.groupBy(*by, sample).agg(F.sum("n").alias("__size"), F.sum(F.col("n") * F.col("rank")).alias("__s"), F.sum(F.col("n") * F.col("rank") * F.col("rank")).alias("__q"))
    total = each.groupBy(*by).agg(F.count("*").alias("__k"), F.min("__size").alias("__least"), F.sum("__size").alias("__size"), F.sum(F.col("__s") * F.col("__s") / F.col("__size")).alias("__b"), F.sum("__q").alias("__q"))
    mean = (F.col("__size") + 1) / 2
    middle = F.col("__size") * mean * mean
    stat = (F.col("__size") - 1) * ieee.divide(F.col("__b") - middle, F.col("__q") - middle)
    own = total.select(*by, stat.alias("stat"), F.col("__k").alias("k"), (F.col("__k") - 1).alias("df"), "__least")
    p = special.column(special.gamma_q, F.greatest(F.col("df"), F.lit(1)) / 2, F.greatest("stat", F.lit(0.0)) / 2)
    return own.select(*by, "stat", "k", "df", F.when((F.col("__least") > 4) & (F.col("df") > 0), p).alias("p"))


def f_tail(stat: Column, df1: Column, df2: Column) -> Column:
    """P(F >= stat)"""
    return special.column(lambda s, a, b: special.beta_i(b / 2, a / 2, b / (b + a * np.maximum(s, 0))), stat, df1, df2)


def trimmed(df: DataFrame, by: list[str], x: str, share: float) -> DataFrame:
    """(by, x, n): the values that are left when ceil(share n) are cut from both ends of each group."""
    if not 0 <= share < 0.5:
        raise ValueError("the share must be in [0, 0.5)")
    own = running(values(df, by, x), by, x, {"before": "n"})
    joined = own.join(own.groupBy(*by).agg(F.sum("n").alias("__size")), by)
    cut = F.ceil(F.lit(share) * F.col("__size"))
    left = F.least(F.col("before") + F.col("n"), F.col("__size") - cut) - F.greatest(F.col("before"), cut)
    return joined.withColumn("n", left).where("n > 0").select(*by, x, "n")


def levene_test(df: DataFrame, by: list[str], sample: str, x: str, center: str = "mean", share: float = 0.1) -> DataFrame:
    """``by``, stat, df1, df2, p: equal variances by the analysis of absolute deviations.

    ``center``: mean, median (median-unbiased) or trimmed (then the values cut off are left out altogether). Null with
    one sample, or where the deviations don't vary.
    """
    keys = [*by, sample]
    if center == "trimmed":
        own = trimmed(df, keys, x, share)
        centres = own.groupBy(*keys).agg((F.sum(F.col("n") * F.col(x)) / F.sum("n")).alias("__c"))
    else:
        own = values(df, keys, x)
        centres = own.groupBy(*keys).agg((F.sum(F.col("n") * F.col(x)) / F.sum("n")).alias("__c")) if center == "mean" else median(df, keys, x, MEDIAN_UNBIASED).withColumnRenamed("median", "__c")
    z = F.abs(F.col(x) - F.col("__c"))
    deviations = own.join(centres, keys).select(*keys, z.alias("__z"), "n")
    means = deviations.groupBy(*keys).agg((F.sum(F.col("n") * F.col("__z")) / F.sum("n")).alias("__m"))
    d = F.col("__z") - F.col("__m")
    each = deviations.join(means, keys).groupBy(*keys).agg(F.sum("n").alias("__n"), F.max("__m").alias("__m"), F.sum(F.col("n") * d * d).alias("__inside"))
    total = each.groupBy(*by).agg(F.count("*").alias("__k"), F.sum("__n").alias("__n"), F.sum("__inside").alias("__inside"), F.sum(F.col("__n") * F.col("__m")).alias("__s"), F.sum(F.col("__n") * F.col("__m") * F.col("__m")).alias("__q"))
    between = F.col("__q") - F.col("__s") * F.col("__s") / F.col("__n")
    ok = (F.col("__k") > 1) & (F.col("__inside") > 1e-24 * F.col("__q")) & (F.col("__n") > F.col("__k"))  # not rounding alone
    stat = F.when(ok, (F.col("__n") - F.col("__k")) * between / (F.when(ok, F.col("__k") - 1) * F.when(ok, F.col("__inside"))))
    out = total.select(*by, stat.alias("stat"), (F.col("__k") - 1).alias("df1"), (F.col("__n") - F.col("__k")).alias("df2"))
    return out.select(*by, "stat", "df1", "df2", f_tail(F.col("stat"), F.col("df1"), F.col("df2")).alias("p"))


def bartlett_test(df: DataFrame, by: list[str], sample: str, x: str) -> DataFrame:
    """``by``, stat, df, p: equal variances of normal samples. Null with one sample, one value, or no variance."""
    each = df.groupBy(*by, sample).agg(F.count(x).cast("double").alias("__n"), F.var_samp(x).alias("__v"))
    n, v = F.col("__n"), F.col("__v")
    ok = (n > 1) & (v > 0)
    total = each.groupBy(*by).agg(
        F.count("*").alias("__k"), F.sum("__n").alias("__n"), F.min(F.when(ok, 1).otherwise(0)).alias("__ok"), F.sum(F.when(ok, (n - 1) * v)).alias("__pooled"),
        F.sum(F.when(ok, (n - 1) * F.ln(F.when(v > 0, v)))).alias("__logs"), F.sum(1 / F.when(ok, n - 1)).alias("__inverse"),
    )
    k, free = F.col("__k"), F.col("__n") - F.col("__k")
    ok = (F.col("__ok") == 1) & (k > 1)
    top = free * F.ln(F.when(ok, F.col("__pooled") / F.when(free > 0, free))) - F.col("__logs")
    stat = F.greatest(F.lit(0.0), top / (1 + (F.col("__inverse") - 1 / F.when(free > 0, free)) / (3 * F.when(ok, k - 1))))
    out = total.select(*by, F.when(ok, stat).alias("stat"), (k - 1).alias("df"))
    return out.select(*by, "stat", "df", special.column(special.gamma_q, F.greatest(F.col("df"), F.lit(1)) / 2, F.col("stat") / 2).alias("p"))


# Kolmogorov-Smirnov


@apart
def ks_d(df: DataFrame, by: list[str], x: str, cdf: Callable[[Column], Column]) -> DataFrame:
    """``by``, n, d: the largest distance of the empirical distribution function from a given one."""
    own = running(values(df, by, x), by, x, {"before": "n"})
    sizes = own.groupBy(*by).agg(F.sum("n").alias("size"))
    own = own.join(sizes, by) if by else own.crossJoin(F.broadcast(sizes))  # a single row
    own = own.withColumn("f", cdf(F.col(x)))
    far = F.greatest(F.abs(F.col("f") - F.col("before") / F.col("size")), F.abs(F.col("f") - (F.col("before") + F.col("n")) / F.col("size")))
    return own.groupBy(*by).agg(F.max("size").alias("n"), F.max(far).alias("d"))


@lru_cache(maxsize=65536)
def ks_probability(n: int, d: float) -> float:
    """P(D < d) for n values: by powers of a matrix (Marsaglia, Tsang, Wang 2003), and 1 where that differs from it by
    less than 1e-15; by the limit and three terms of its correction (Pelz, Good 1976) for n above KS_EXACT, where they
    agree to 2e-8."""
    if d <= 0 or n < 1:
        return 0.0
    if d >= 1:
        return 1.0
    s = d * d * n
    if n > KS_EXACT:
        return ks_limit(n, d)
    if s > 18:
        return 1.0
    k = int(n * d) + 1
    size, h = 2 * k - 1, k - n * d
    own = np.tril(np.ones((size, size)), 1)
    powers = h ** np.arange(1, size + 1)
    own[:, 0] -= powers
    own[-1, :] -= powers[::-1]
    if 2 * h > 1:
        own[-1, 0] += (2 * h - 1) ** size
    factorial = np.cumprod(np.arange(1.0, size + 1))
    gap = np.subtract.outer(np.arange(size), np.arange(size)) + 1
    own = np.where(gap > 0, own / factorial[np.clip(gap, 1, None) - 1], own)
    # a number is m 10**e: the matrix is scaled whenever its middle grows too large
    out, exponent, base, base_exponent, left = np.eye(size), 0, own, 0, n
    while left:
        if left & 1:
            out, exponent = out @ base, exponent + base_exponent
        base, base_exponent = base @ base, 2 * base_exponent
        if base[k - 1, k - 1] > 1e140:
            base, base_exponent = base * 1e-140, base_exponent + 140
        if out[k - 1, k - 1] > 1e140:
            out, exponent = out * 1e-140, exponent + 140
        left >>= 1
    value = out[k - 1, k - 1]
    for i in range(1, n + 1):
        value = value * i / n
        if value < 1e-140:
            value, exponent = value * 1e140, exponent - 140
    return float(value * 10.0**exponent)


def ks_probability_of(n: Column | str, d: Column | str) -> Column:
    """``ks_probability`` of columns."""
    each = lambda sizes, x: np.array([ks_probability(int(a), float(b)) for a, b in zip(sizes, x, strict=True)], float)
    return special.column(each, ieee.col(n).cast("double"), ieee.col(d))


def ks_limit(n: int, d: float) -> float:
    """Kolmogorov's limit at z = d sqrt(n) and the terms in n**-1/2, 1/n and n**-3/2."""
    z, pi2 = d * math.sqrt(n), math.pi**2
    if z < 0.04:
        return 0.0
    if z > 6:
        return 1.0
    z2 = z * z
    odd = (2.0 * np.arange(1, int(16 * z) + 4) - 1) ** 2
    even = np.arange(1.0, int(16 * z) + 4) ** 2
    e, f = np.exp(-odd * pi2 / (8 * z2)), np.exp(-even * pi2 / (2 * z2))
    a = pi2 * odd / 4
    terms = (
        (e / z).sum(),
        ((a - z2) * e).sum() / (6 * z**4),
        ((6 * z**6 + 2 * z**4 + (2 * z**4 - 5 * z2) * a + (1 - 2 * z2) * a * a) * e).sum() / (72 * z**7) - pi2 * (even * f).sum() / (36 * z**3),
        ((-30 * z**6 - 90 * z**8 + (135 * z**4 - 96 * z**6) * a + (212 * z**4 - 60 * z2) * a**2 + (5 - 30 * z2) * a**3) * e).sum() / (6480 * z**10)
        + pi2 * (even * (3 * z2 - pi2 * even) * f).sum() / (216 * z**6),
    )
    total = math.sqrt(2 * math.pi) * sum(float(t) * n ** (-k / 2) for k, t in enumerate(terms))
    return min(1.0, max(0.0, total))


def ks_test(df: DataFrame, by: list[str], x: str, cdf: Callable[[Column], Column]) -> DataFrame:
    """``by``, n, d, p."""
    own = ks_d(df, by, x, cdf)
    p = special.column(lambda n, d: np.array([1 - ks_probability(int(a), float(b)) for a, b in zip(n, d, strict=True)], float), F.col("n").cast("double"), F.col("d"))
    return own.withColumn("p", p)


def ks_two_d(df: DataFrame, by: list[str], is_a: Column, x: str) -> DataFrame:
    """``by``, n1, n2, d: the largest distance of two empirical distribution functions, after each distinct value."""
    own = values(df, by, x, F.count(F.when(is_a, 1)).alias("na"))
    own = running(own.withColumn("nb", F.col("n") - F.col("na")), by, x, {"a": "na", "b": "nb"})
    sizes = own.groupBy(*by).agg(F.sum("na").alias("n1"), F.sum("nb").alias("n2"))
    own = own.join(sizes, by) if by else own.crossJoin(F.broadcast(sizes))  # a single row
    far = F.abs(ieee.divide(F.col("a") + F.col("na"), F.col("n1")) - ieee.divide(F.col("b") + F.col("nb"), F.col("n2")))
    empty = (F.col("n1") == 0) | (F.col("n2") == 0)
    return own.groupBy(*by).agg(F.max("n1").alias("n1"), F.max("n2").alias("n2"), F.max(F.when(empty, F.lit(0.0)).otherwise(far)).alias("d"))


def ks_two_test(df: DataFrame, by: list[str], is_a: Column, x: str) -> DataFrame:
    """``by``, n1, n2, stat (the distance scaled by sample sizes) and p."""
    own = ks_two_d(df, by, is_a, x)
    n1, n2 = F.col("n1"), F.col("n2")
    ok = (n1 > 0) & (n2 > 0)
    en = F.sqrt(n1 * n2 / F.when(ok, n1 + n2))
    own = own.withColumn("stat", F.when(ok, F.col("d") * (en + 0.12 + 0.11 / en)))
    z = F.col("stat")
    # the two series of Kolmogorov's distribution, for small and large z
    y, x2 = F.exp(-(math.pi**2 / 8) / F.when(z > 0, z * z)), F.exp(-2 * z * z)
    low = 4 / math.sqrt(math.pi) * F.sqrt(-F.ln(F.when(y > 0, y))) * (y + F.pow(y, 9) + F.pow(y, 25) + F.pow(y, 49))
    high = 1 - 2 * (x2 - F.pow(x2, 4) + F.pow(x2, 9))
    below = F.when(z == 0, F.lit(0.0)).when(z < 1.18, F.coalesce(low, F.lit(0.0))).otherwise(high)
    return own.select(*by, "n1", "n2", "stat", (1 - below).alias("p"))


# Chi-squared and runs


def chi2_test(df: DataFrame, by: list[str], observed: str, expected: str, fitted: int = 0, sigma: str | None = None, over_sigma: bool = False) -> DataFrame:
    """``by``, stat, df, p of bins with observed and expected counts; ``fitted`` parameters come from the data.

    With ``sigma``, the deviation of each observed value, terms are (o - e)**2 / sigma**2, or over sigma itself with
    ``over_sigma``. p is null without a degree of freedom.
    """
    if fitted < 0:
        raise ValueError("the number of fitted parameters must not be negative")
    d = F.col(observed) - F.col(expected)
    under = F.col(expected) if sigma is None else F.col(sigma) if over_sigma else F.col(sigma) * F.col(sigma)
    own = df.groupBy(*by).agg(F.sum(ieee.divide(d * d, under)).alias("stat"), (F.count("*") - 1 - fitted).alias("df"))
    p = special.column(special.gamma_q, F.greatest(F.col("df"), F.lit(1)) / 2, F.col("stat") / 2)
    return own.withColumn("p", F.when(F.col("df") > 0, p))


@lru_cache(maxsize=65536)
def runs_probability(runs: int, a: int, b: int) -> float:
    """P(at most so many runs of a and b things in random order).

    Ways for 2k and 2k + 1 runs come from those for one k less by a ratio, in logarithms, and are divided by their sum.
    Beyond RUNS_TERMS terms only those within 60 deviations of the mean are summed: the others are below 1e-300.
    """
    if not a or not b:
        return 1.0 if runs >= 1 else 0.0
    most, mean = min(a, b), 1 + 2 * a * b / (a + b)
    first = 1
    if most > RUNS_TERMS:
        wide = 60 * math.sqrt(max(1.0, (mean - 1) * (mean - 2) / (a + b - 1)))
        first, most = max(1, int((mean - wide) / 2)), min(most, int((mean + wide) / 2) + 2)
    k = np.arange(first, most + 1, dtype=float)
    step = (a - k) / k * ((b - k) / k)
    with np.errstate(divide="ignore"):
        logs = np.concatenate([[0.0], np.cumsum(np.log(step[:-1]))])
    even = 2 * np.exp(logs - logs.max())  # 2k runs
    odd = even / 2 * ((a - k) / k + (b - k) / k)  # 2k + 1 runs
    return float(min(1.0, (even[2 * k <= runs].sum() + odd[2 * k + 1 <= runs].sum()) / (even.sum() + odd.sum())))


def runs_test(df: DataFrame, by: list[str], idx: str, flag: str) -> DataFrame:
    """``by``, runs, n_true, n_false, p (at most so many runs). ``idx`` is the 0-based place without gaps."""
    own = df.select(*by, F.col(idx).alias("__i"), F.col(flag).alias("__f"))
    before = own.select(*by, (F.col("__i") + 1).alias("__i"), F.col("__f").alias("__b"))
    joined = own.join(before, [*by, "__i"], "left")
    out = joined.groupBy(*by).agg(F.count(F.when(F.col("__b").isNull() | (F.col("__f") != F.col("__b")), 1)).alias("runs"), F.count(F.when(F.col("__f"), 1)).alias("n_true"), F.count(F.when(~F.col("__f"), 1)).alias("n_false"))
    p = special.column(lambda *v: np.array([runs_probability(*map(int, row)) for row in zip(*v, strict=True)], float), *[F.col(c).cast("double") for c in ("runs", "n_true", "n_false")])
    return out.withColumn("p", p)


