"""Special functions, distributions and aggregates against known values and properties."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quantalake.functions import aggregates as A
from quantalake.functions import distributions as D
from quantalake.functions import special


def test_known_values():
    # fixed values of published tables
    assert D.FisherF(1, 3).host("cdf", 3.0) == pytest.approx(0.81830988618379067, rel=1e-12)
    assert D.StudentT(0.3).host("cdf", 3.34) == pytest.approx(0.757146, rel=1e-5)
    assert D.Gamma(150, 1 / 150).host("pdf", 1.0) == pytest.approx(4.883311418525483, rel=1e-9)
    assert special.digamma(1.0) == pytest.approx(-special.EULER, rel=1e-12)
    assert special.beta_i(2.0, 3.0, 0.4) == pytest.approx(0.5248, rel=1e-12)
    assert special.gamma_p(1.0, 2.0) == pytest.approx(1 - math.exp(-2), rel=1e-13)


CONTINUOUS = [
    D.Normal(1, 2), D.Lognormal(0.3, 0.5), D.Exponential(2), D.Gamma(3.5, 0.7), D.Gamma(0.4, 2), D.Beta(2, 3.3), D.ChiSquared(5), D.StudentT(4.3), D.FisherF(5, 9), D.Cauchy(1, 2),
    D.Laplace(1, 0.5), D.Uniform(2, -1), D.Weibull(1.7, 2), D.LinearTransform(1, 2, D.StudentT(7)),
]
DISCRETE = [D.Binomial(20, 0.3), D.Poisson(3.3), D.Geometric(0.3), D.Geometric0(0.3), D.NegativeBinomial(3.5, 0.4), D.Hypergeometric(7, 20, 9), D.DiscreteUniform.to(6)]


@pytest.mark.parametrize("d", CONTINUOUS, ids=lambda d: type(d).__name__)
@settings(max_examples=40, deadline=None)
@given(p=st.floats(1e-6, 1 - 1e-6))
def test_continuous(d, p):
    x = d.host("ppf", p)
    assert d.host("cdf", x) == pytest.approx(p, abs=1e-10)
    assert d.host("cdf", x) + d.host("sf", x) == pytest.approx(1, abs=1e-14)
    assert d.host("pdf", x) >= 0
    assert d.host("cdf", x + 0.1) >= d.host("cdf", x)
    with pytest.raises(ValueError):
        d.host("ppf", 1 + p)


@pytest.mark.parametrize("d", DISCRETE, ids=lambda d: type(d).__name__)
def test_discrete(d):
    k = d.support()
    mass = d.host("pmf", k)
    assert mass.sum() == pytest.approx(1, abs=1e-12)
    assert np.allclose(np.cumsum(mass), d.host("cdf", k), atol=3e-10)
    assert np.allclose(d.host("cdf", k + 0.5), d.host("cdf", k))
    assert (mass * k).sum() == pytest.approx(d.mean, rel=1e-9)
    assert (mass * k * k).sum() - d.mean**2 == pytest.approx(d.variance, rel=1e-8)


def test_exact_binomial():
    p = Fraction(3, 10)
    for k in range(21):
        exact = math.comb(20, k) * p**k * (1 - p) ** (20 - k)
        assert D.Binomial(20, 0.3).host("pmf", k) == pytest.approx(float(exact), rel=1e-12)


@pytest.mark.parametrize("d", CONTINUOUS + DISCRETE, ids=lambda d: type(d).__name__)
def test_json_and_columns(spark, d):
    assert D.from_json(d.json()) == d
    x = [0.5, 1.0, 2.0, 3.0]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(d.cdf("x").alias("c"), (d.pmf if d.discrete else d.pdf)("x").alias("p")).collect()
    assert np.allclose([r.c for r in got], d.host("cdf", x), atol=1e-12)
    assert np.allclose([r.p for r in got], d.host("pmf" if d.discrete else "pdf", x), atol=1e-12)


def test_bad_parameters():
    for bad in (lambda: D.Normal(0, 0), lambda: D.Exponential(-1), lambda: D.Binomial(-1, 0.5), lambda: D.Geometric(0), lambda: D.Uniform(1, 1), lambda: D.Weibull.from_mean_std(1, 2)):
        with pytest.raises(ValueError):
            bad()


def _agg(spark, rows, *columns):
    return spark.createDataFrame([(float(v),) for v in rows], "x double").agg(*columns).first()


def test_aggregates_at_the_edges(spark):
    none = _agg(spark, [], A.mean("x").alias("m"), A.running_mean("x").alias("r"), A.variance("x").alias("v"), A.variance_unbiased("x").alias("u"), A.correlation("x", "x").alias("c"), A.covariance("x", "x").alias("k"))
    assert math.isnan(none.m) and (none.r, none.v, none.u, none.c, none.k) == (0, 0, 0, 0, 0)
    one = _agg(spark, [3], A.variance_unbiased("x").alias("u"), A.std_dev("x").alias("s"), A.correlation("x", "x").alias("c"), A.skewness("x").alias("w"))
    assert (one.u, one.s) == (0, 0) and math.isnan(one.c) and math.isnan(one.w)
    zero = _agg(spark, [0, 2], A.harmonic_mean("x").alias("h"), A.geometric_mean("x").alias("g"))
    assert (zero.h, zero.g) == (0, 0)
    assert math.isnan(_agg(spark, [-1, 2], A.geometric_mean("x").alias("g")).g)
    assert _agg(spark, [1, 100, 101, 102, 103], A.skewness("x").alias("w")).w == pytest.approx(-1.497681449918257)
    rng = random.Random(5)
    wild = [(k % 3, rng.choice([1e300, -1e300, 1e16, -1e16, 1.0, 1e-9]) * rng.random()) for k in range(3000)]
    wild = [(g, v) for g, v in wild for v in (v, -v)] + [(0, 1.0), (1, 0.1), (1, None), (2, 1e-30)]
    got = {r.g: r.total for r in A.exact_sums(spark.createDataFrame(wild, "g int, x double").repartition(5), ["g"], "x").collect()}
    assert got == {0: 1.0, 1: 0.1, 2: 1e-30}
    assert A.exact_sums(spark.createDataFrame([(1e16,), (1.0,), (-1e16,)], "x double"), [], "x").first().total == 1.0
    assert A.exact_sums(spark.createDataFrame([(None,)], "x double"), [], "x").count() == 0
    w = spark.createDataFrame([(1.0, 0.0), (2.0, 0.0)], "x double, w double").agg(A.weighted_mean("x", "w").alias("m")).first()
    assert w.m == 0


def test_pair_needs_equal_lengths(spark):
    a, b = spark.range(3).selectExpr("id idx", "id * 1.0 x"), spark.range(2).selectExpr("id idx", "id * 1.0 y")
    with pytest.raises(Exception, match="length"):
        A.pair(a, b, "idx", "x", "y").collect()


def test_standardize_without_variance(spark):
    got = A.standardize(spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 5.0)], "g int, x double"), ["g"], "x")
    assert [r.z for r in got.collect()] == [None] * 3


def test_powers_merge(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("g"), F.col("id").cast("double").alias("x"))
    p = A.Powers(4)
    merged = df.groupBy("g").agg(*A.powers(4, "x")).agg(*A.merge_powers(4)).select(p.mean.alias("m"), p.variance.alias("v"), p.kurtosis.alias("k")).first()
    direct = df.agg(F.avg("x").alias("m"), F.var_pop("x").alias("v"), F.kurtosis("x").alias("k")).first()
    assert tuple(merged) == pytest.approx(tuple(direct), rel=1e-9)
    with pytest.raises(ValueError):
        A.powers(1, "x")
    with pytest.raises(ValueError):
        p.central_moment(5)


def test_improper_distributions(spark):
    from quantalake.functions.distributions import Beta, Gamma, ImproperBeta, ImproperGamma

    x = np.array([-1.0, 0.2, 0.7, 1.0, 3.0])
    for proper, own in ((Gamma(2.5, 1.3), ImproperGamma(2.5, 1.3)), (Beta(2.0, 3.0), ImproperBeta(2.0, 3.0))):
        for name in ("cdf", "sf", "logpdf"):
            assert np.array_equal(proper.host(name, x), own.host(name, x))
        assert own.entropy == proper.entropy and own.host("ppf", 0.3) == proper.host("ppf", 0.3)
    for own, cdf in ((ImproperGamma(0, 1), [0, 1, 1, 1, 1]), (ImproperGamma(2, 0), [0, 1, 1, 1, 1]), (ImproperBeta(0, 2), [0, 1, 1, 1, 1]), (ImproperBeta(2, 0), [0, 0, 0, 1, 1]), (ImproperBeta(0, 0), [0, 0.5, 0.5, 1, 1])):
        assert own.host("cdf", x).tolist() == cdf and own.host("sf", x).tolist() == [1 - c for c in cdf]
        assert own.entropy is None and (own.host("pdf", x) == 0).all()
    row = spark.range(1).select(ImproperBeta(0, 0).cdf(F.lit(0.5)).alias("c"), ImproperGamma(0, 1).ppf(F.lit(0.5)).alias("q")).first()
    assert (row.c, row.q) == (0.5, 0)
    assert ImproperBeta(0, 0).mean == 0.5 and ImproperBeta(0, 0).variance == 0.25 and ImproperGamma(0, 1).mean == 0
    for bad in (lambda: ImproperGamma(-1, 1), lambda: ImproperBeta(1, -1), lambda: Gamma(0, 1)):
        with pytest.raises(ValueError):
            bad()


def test_roots_and_sums(spark):
    from quantalake.functions.distributions import Binomial, find_root, sum_probabilities

    df = spark.createDataFrame([(0.1,), (0.5,), (0.999,), (None,)], "p double")
    got = df.select("p", find_root(lambda x: 1 - np.exp(-x * x), lambda x: 2 * x * np.exp(-x * x), "p", 0, 10).alias("x")).collect()
    for r in got:
        assert r.x is None if r.p is None else r.x == pytest.approx(math.sqrt(-math.log(1 - r.p)))
    own = Binomial(9, 0.3)
    ends = spark.createDataFrame([(0, 9), (2, 4), (5, 4), (-3, 0), (8, 100)], "a int, b int")
    for r in ends.select("a", "b", sum_probabilities(own, "a", "b").alias("s")).collect():
        assert r.s == pytest.approx(sum(float(own.host("pmf", k)) for k in range(max(0, r.a), min(9, r.b) + 1)), abs=1e-12)


def test_power_moments(spark):
    x = np.random.default_rng(6).normal(3, 2, 200)
    d = x - x.mean()
    rows = spark.createDataFrame([(float(v),) for v in x], "x double").agg(*A.powers(4, "x"))
    r = A.Powers(4).moments(rows).first()
    want = (x.mean(), x.var(), x.var(ddof=1), x.std(), (d**3).mean() / x.std() ** 3, (d**4).mean() / x.var() ** 2 - 3)
    assert (r.mean, r.variance, r.variance_unbiased, r.std_dev, r.skewness, r.kurtosis) == pytest.approx(want)
    assert "kurtosis" not in A.Powers(3).moments(rows).columns and A.Powers(4).order == 4
    one = rows.select(A.Powers(4).central_moment(3).alias("m"), A.Powers(4).skewness.alias("s"), A.Powers(4).kurtosis.alias("k")).first()
    assert (one.m, one.s, one.k) == pytest.approx(((d**3).mean(), r.skewness, r.kurtosis))


def test_error_functions():
    """Within an ulp or so of the C library's, and as columns in plans without Python."""
    x = np.concatenate([np.linspace(-7, 27, 20_001), [0.0, -0.0, 5e-324, 0.46875, -0.46875, 4.0, -4.0, 30.0, -30.0, math.inf, -math.inf, math.nan]])
    got, want = special.erfc(x), np.array([math.erfc(v) for v in x])
    fine = want > 1e-300
    assert (np.abs(got[fine] / want[fine] - 1) < 2e-15).all()
    assert ((got == want) | fine | (want < 1e-300) | np.isnan(want)).all() and np.isnan(got[-1])
    got, want = special.erf(x[:-1]), np.array([math.erf(v) for v in x[:-1]])
    assert (np.abs(got - want) <= 1e-15 * np.abs(want)).all()


def test_normal_columns_are_expressions(spark):
    own = D.Normal(1, 2)
    x = [1.0, 1.3, -40.0, 55.0, 0.0, math.inf, -math.inf]
    df = spark.createDataFrame([(v,) for v in x], "x double").select("x", own.cdf("x").alias("p"), own.sf("x").alias("q"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowConverters", "")
    for r in df.collect():
        assert r.p == pytest.approx(0.5 * math.erfc((1 - r.x) / (2 * math.sqrt(2))), rel=1e-14, abs=1e-307)
        assert r.q == pytest.approx(0.5 * math.erfc((r.x - 1) / (2 * math.sqrt(2))), rel=1e-14, abs=1e-307)
