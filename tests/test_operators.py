"""Operators against published values, brute force and properties."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantalake.functions.distributions import Normal
from quantalake.operators import correlation as C
from quantalake.operators import density as G
from quantalake.operators import hypothesis as T
from quantalake.operators import inference as I  # noqa: E741
from quantalake.operators import matrix as M
from quantalake.operators import quantiles as Q
from quantalake.operators import ranks as R
from quantalake.operators import resampling as K
from quantalake.operators import transform as X
from quantalake.plans import registry


def sample(spark, rows):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(rows)], "idx long, x double")


def groups(spark, *samples):
    return spark.createDataFrame([(n, float(v)) for n, s in enumerate(samples) for v in s], "s int, x double")


# Published results of six estimators on one sample
QUANTILES = {
    Q.CADPW: [0, 0.5, 2.5, 8.25, 10],
    Q.HAZEN: [0, 1, 5, 9, 10],
    Q.SPSS: [0, 0.75, 5, 9.25, 10],
    Q.S: [0, 1.375, 5, 8.625, 10],
    Q.MEDIAN_UNBIASED: [0, 0.9166666666666667, 5, 9.083333333333334, 10],
    Q.NORMAL_UNBIASED: [0, 0.9375, 5, 9.0625, 10],
}


def test_quantiles(spark):
    df = sample(spark, [0, 1, 2.5, 7.5, 9, 10])
    for param, want in QUANTILES.items():
        assert Q.quantiles(df, [], "x", [0, 1, 2, 3, 4], 4, param).first().quantiles == pytest.approx(want, abs=1e-12)
    assert Q.midspread(sample(spark, [1, 1, 2, 2, 3]), [], "x", 4, Q.MEDIAN_UNBIASED).first().midspread == pytest.approx(4 / 3)
    for k, q in ((-1, 4), (5, 4), (0, 1)):
        with pytest.raises(ValueError):
            Q.quantile(df, [], "x", k, q)
    with pytest.raises(Exception, match="NaN"):
        Q.median(sample(spark, [1, math.nan]), [], "x").collect()
    assert Q.median(sample(spark, []), [], "x").count() == 0


def test_ranks(spark):
    rng = random.Random(1)
    rows = [rng.randrange(20) for _ in range(300)]
    got = {r.idx: r.rank for r in R.with_ranks(sample(spark, rows), [], "x").collect()}
    for i, v in enumerate(rows):
        assert got[i] == sum(x < v for x in rows) + (rows.count(v) + 1) / 2
    assert [R.next_power_of_two(n) for n in (-3, 0, 1, 2, 3, 1000)] == [0, 0, 1, 2, 4, 1024]
    assert R.within(1, 1.0, np.nextafter(1.0, 2)) and not R.within(1, 1.0, 1.1)


def test_ranges(spark, monkeypatch):
    """The same ranks, quantiles and distances when a table is cut into many ranges; one value holds a third of rows."""
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 2]), float(rng.choice([7, rng.randrange(300), rng.randrange(300)])), rng.random() < 0.5) for _ in range(900)]
    df = spark.createDataFrame([*rows, (3, None, True)], "g int, x double, a boolean")

    def results() -> list:
        every = [
            Q.quantiles(df, ["g"], "x", [0, 1, 5, 9, 10], 10, Q.MEDIAN_UNBIASED), Q.quantiles(df, [], "x", [1, 2], 3), Q.mad(df, ["g"], "x"), R.with_ranks(df.where("x is not null"), ["g"], "x"),
            T.rank_sums(df, ["g"], F.col("a"), "x"), T.ks_two_d(df, ["g"], F.col("a"), "x"), T.trimmed(df, ["g"], "x", 0.1), T.kruskal_rank(df.where("x is not null"), ["g"], "a", "x"),
        ]
        return [sorted(map(tuple, d.collect()), key=repr) for d in every]

    whole = results()
    monkeypatch.setattr(R, "ROWS", 60)
    assert len(R.cut_points(df, "x")) > 8
    assert results() == whole
    points = [1.0, 3.0, 3.5, 9.0]
    got = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 3.0, 3.2, 9.0, 10.0)], "v double").select(R.range_of(F.col("v"), points).alias("r")).collect()
    assert [r.r for r in got] == [0, 0, 1, 1, 2, 3, 4]


def test_kendall_in_stripes(spark, monkeypatch):
    """Groups beyond a task's points are cut again and again; half of the points share a value of x."""
    rng = np.random.default_rng(3)
    x, y = np.where(rng.random(700) < 0.5, 5.0, rng.integers(0, 90, 700)), rng.integers(0, 60, 700).astype(float)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(2, 1.0, 2.0), (2, 2.0, 1.0)], "g int, x double, y double")
    whole = {r.g: r.tau for r in C.kendall(df, ["g"], "x", "y").collect()}
    sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    assert whole[1] == pytest.approx((sx * sy).sum() / math.sqrt(float((sx != 0).sum()) * float((sy != 0).sum()))) and whole[2] == -1
    monkeypatch.setattr(C, "POINTS", 200)
    monkeypatch.setattr(C, "STRIPES", 16)
    assert {r.g: r.tau for r in C.kendall(df, ["g"], "x", "y").collect()} == pytest.approx(whole)


def test_kendall(spark):
    rng = random.Random(2)
    for n in (1, 2, 7, 200):
        xy = [(rng.randrange(n), rng.randrange(n)) for _ in range(n)]
        got = C.kendall(spark.createDataFrame([(1, float(a), float(b)) for a, b in xy], "g int, x double, y double"), ["g"], "x", "y").first().tau
        s = nx = ny = 0
        for i in range(n):
            for j in range(i):
                a, b = np.sign(xy[i][0] - xy[j][0]), np.sign(xy[i][1] - xy[j][1])
                s, nx, ny = s + a * b, nx + (a != 0), ny + (b != 0)
        if nx * ny == 0:
            assert math.isnan(got)
        else:
            assert got == pytest.approx(s / math.sqrt(nx * ny), abs=1e-12)


def test_autocorrelation(spark):
    x = np.sin(np.arange(30.0)) + np.arange(30) % 3
    got = sorted((r.lag, r.r, r.lo, r.hi) for r in C.autocorrelation(sample(spark, x), [], "idx", "x").collect())
    d = x - x.mean()
    c = np.array([(d[: 30 - k] * d[k:]).sum() / 30 for k in range(29)])
    assert [g[0] for g in got] == list(range(29))
    assert np.allclose([g[1] for g in got], c / c[0])
    assert got[0][2:] == (1.0, 1.0)
    assert got[3][3] == pytest.approx(-1 / 30 + 1.96 * math.sqrt((1 + 2 * ((c / c[0])[:4] ** 2).sum()) / 30))


A_TRIO = ([9.95, 11.2, 10.4, 9.1, 12.3, 10.05], [8.0, 12.5, 10.0, 14.1, 6.2, 11.0], [10.1, 10.3, 9.9, 10.2, 10.0, 10.1])


def test_variance_tests(spark):
    df = groups(spark, *A_TRIO)
    n, v = [len(s) for s in A_TRIO], [np.var(s, ddof=1) for s in A_TRIO]
    free, k = sum(n) - 3, 3
    pooled = sum((a - 1) * b for a, b in zip(n, v, strict=True)) / free
    want = (free * math.log(pooled) - sum((a - 1) * math.log(b) for a, b in zip(n, v, strict=True))) / (1 + (sum(1 / (a - 1) for a in n) - 1 / free) / (3 * (k - 1)))
    assert T.bartlett_test(df, [], "s", "x").first().stat == pytest.approx(want)
    z = [np.abs(np.array(s) - np.mean(s)) for s in A_TRIO]
    grand = np.concatenate(z).mean()
    want = (sum(n) - k) / (k - 1) * sum(len(s) * (s.mean() - grand) ** 2 for s in z) / sum(((s - s.mean()) ** 2).sum() for s in z)
    assert T.levene_test(df, [], "s", "x").first().stat == pytest.approx(want)
    assert T.bartlett_test(groups(spark, [1, 2]), [], "s", "x").first().stat is None
    assert T.levene_test(groups(spark, [1, 1], [2, 2]), [], "s", "x").first().stat is None


def test_critical_values():
    # published tables
    assert [T.mann_whitney_critical(2, n, 0.025) for n in range(1, 21)] == [None] * 7 + [0, 0, 0, 0, 1, 1, 1, 1, 1, 2, 2, 2, 2]
    assert [T.mann_whitney_critical(6, n, 0.05) for n in range(1, 21)] == [None, 0, 2, 3, 5, 7, 8, 10, 12, 14, 16, 17, 19, 21, 23, 25, 26, 28, 30, 32]
    assert [T.mann_whitney_critical(20, n, 0.025) for n in range(1, 21)] == [None, 2, 8, 14, 20, 27, 34, 41, 48, 55, 62, 69, 76, 83, 90, 98, 105, 112, 119, 127]
    assert [T.signed_rank_critical(n, 0.05) for n in range(1, 28)] == [None] * 4 + [0, 2, 3, 5, 8, 10, 13, 17, 21, 25, 30, 35, 41, 47, 53, 60, 67, 75, 83, 91, 100, 110, 119]
    assert [T.signed_rank_critical(n, 0.01) for n in range(1, 28)] == [None] * 6 + [0, 1, 3, 5, 7, 9, 12, 15, 19, 23, 27, 32, 37, 43, 49, 55, 62, 69, 76, 84, 92]
    assert round(T.signed_rank_significance(16, 35), 4) == 0.0467 and round(T.signed_rank_significance(16, 36), 4) == 0.0523
    with pytest.raises(ValueError):
        T.signed_rank_sums(0)
    assert T.mann_whitney_critical(1, 20, 0.025) is None


def test_rank_tests(spark):
    rng = random.Random(3)
    a, b = [rng.randrange(12) for _ in range(15)], [rng.randrange(12) + 1 for _ in range(18)]
    df = groups(spark, a, b)
    got = T.mann_whitney_u(df, [], F.col("s") == 0, "x").first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert (got.u1, got.u2) == (u, len(a) * len(b) - u)
    pairs = spark.createDataFrame([(1, float(x), float(y)) for x, y in zip(a, b[:15], strict=True)] + [(2, 1.0, 1.0)], "g int, x double, y double")
    got = {r.g: r for r in T.signed_ranks(pairs, ["g"], "x", "y").collect()}
    d = [x - y for x, y in zip(a, b[:15], strict=True) if x != y]
    rank = lambda v: sum(abs(w) < abs(v) for w in d) + (sum(abs(w) == abs(v) for w in d) + 1) / 2
    assert (got[1].n, got[1].t_plus, got[1].t_minus) == (len(d), sum(rank(v) for v in d if v > 0), -sum(rank(v) for v in d if v < 0))
    assert (got[2].n, got[2].t_plus, got[2].t_minus) == (0, 0, 0)
    got = {r.g: r for r in T.wilcoxon_signed_rank_test(pairs, ["g"], "x", "y", p=0.05).collect()}
    assert got[1].p is not None and (got[2].n, got[2].p, got[2].significant) == (0, None, None)  # all pairs are equal


def test_t_tests(spark):
    a, b = [1.1, 2.3, 2.9, 4.2, 5.0], [2.0, 3.1, 4.4, 5.9, 7.2]
    df = groups(spark, a, b)
    got = T.student_t_test(df, [], F.col("s") == 0, "x").first()
    pooled = (4 * np.var(a, ddof=1) + 4 * np.var(b, ddof=1)) / 8
    assert (got.stat, got.df) == pytest.approx(((np.mean(a) - np.mean(b)) / math.sqrt(pooled * 0.4), 8))
    ups = [T.student_t_test(df, [], F.col("s") == 0, "x", w).first().p for w in (T.A_GREATER, T.B_GREATER)]
    assert sum(ups) == pytest.approx(1) and got.p == pytest.approx(2 * min(ups))
    assert T.welch_t_test(groups(spark, [1], [2, 3]), [], F.col("s") == 0, "x").first().p is None


def test_ks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=50)
    cdf = Normal().host("cdf", np.sort(x))
    i = np.arange(50)
    want = max(np.abs(cdf - i / 50).max(), np.abs(cdf - (i + 1) / 50).max())
    assert T.ks_test(sample(spark, x), [], "x", Normal().cdf).first().d == pytest.approx(want, abs=1e-12)
    a, b = rng.integers(0, 9, 20), rng.integers(1, 10, 25)
    want = max(abs((a <= v).mean() - (b <= v).mean()) for v in range(11))
    assert T.ks_two_d(groups(spark, a, b), [], F.col("s") == 0, "x").first().d == pytest.approx(want)
    # published: Marsaglia, Tsang, Wang
    assert T.ks_probability(10, 0.274) == pytest.approx(0.6284796154565043, rel=1e-12)
    assert T.ks_probability(5, 0.0) == 0


def test_large_samples():
    """Tests of samples beyond exact counting, against their limits; and both ways where they meet."""
    for z in (0.3, 0.6, 1.0, 1.8):
        assert T.ks_probability(2000, z / math.sqrt(2000)) == pytest.approx(T.ks_limit(2000, z / math.sqrt(2000)), abs=2e-8)
        limit = 1 - 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 200))
        assert T.ks_probability(10**9, z / math.sqrt(1e9)) == pytest.approx(limit, abs=2e-5)
    assert T.ks_probability(10**6, 0.5) == 1 and T.ks_probability(10**6, 1e-6) == 0 and T.ks_probability(3, 1.5) == 1

    def brute(r: int, a: int, b: int) -> float:
        ways = lambda k: 2 * math.comb(a - 1, k // 2 - 1) * math.comb(b - 1, k // 2 - 1) if k % 2 == 0 else math.comb(a - 1, k // 2) * math.comb(b - 1, k // 2 - 1) + math.comb(a - 1, k // 2 - 1) * math.comb(b - 1, k // 2)
        return sum(ways(k) for k in range(2, r + 1)) / math.comb(a + b, a)

    for a, b in ((1, 1), (2, 9), (30, 31), (500, 700)):
        for r in {2, 3, a, a + b // 2, 2 * min(a, b) + 1}:
            assert T.runs_probability(r, a, b) == pytest.approx(brute(r, a, b), rel=1e-10)
    for n in (10**6, 10**9):
        sd = math.sqrt(n / 2)
        for z in (-2.0, 0.0, 1.0):
            assert T.runs_probability(int(n + 1 + z * sd), n, n) == pytest.approx(float(Normal().host("cdf", z)), abs=1e-3)
    assert T.runs_probability(1, 0, 5) == 1


def test_records_of_tests(spark):
    df = spark.createDataFrame([(2.5, 0.03, 9.0), (0.1, 0.9, 9.0)], "stat double, p double, df double")
    got = df.select(T.test_result("stat", "p", "StudentT", "df").alias("t"), T.significant("p", 0.05).alias("s"), T.significant(F.col("p"), 0.03).alias("at")).collect()
    assert (got[0].t.value, got[0].t.p, got[0].t.distribution.family, got[0].t.distribution.parameters) == (2.5, 0.03, "StudentT", [9.0])
    assert [r.s for r in got] == [True, False] and got[0]["at"]


def test_paired_with_large_means(spark):
    """Differences that are small beside their mean."""
    rng = np.random.default_rng(9)
    d = 1e8 + rng.normal(size=50)
    df = spark.createDataFrame([(float(v), 0.0) for v in d], "x double, y double")
    assert T.paired_t_test(df, [], "x", "y").first().stat == pytest.approx(d.mean() / math.sqrt(d.var(ddof=1) / 50), rel=1e-6)


def test_names_that_operators_use(spark):
    """Groups may have the names of working columns."""
    rng = random.Random(4)
    rows = [(*[k % 2] * 7, float(rng.randrange(9)), float(rng.randrange(9)), k // 2, rng.random() < 0.5) for k in range(40)]
    df = spark.createDataFrame(rows, "a int, b int, n int, i int, d int, s int, rank int, v double, w double, k int, f boolean")
    for by in (["a", "b", "n"], ["d", "s", "rank"], ["i"]):
        for out in (C.kendall(df, by, "v", "w"), C.spearman(df, by, "v", "w"), Q.median(df, by, "v"), T.paired_t_test(df, by, "v", "w"), T.runs_test(df, by, "k", "f")):
            assert out.count() == 2
    assert G.histogram(df, ["a", "b"], "v", 3).count() == 6 and G.gaussian_pdf(df, ["a", "b", "n"], "v", 4).count() == 8


def test_runs(spark):
    flags = [True, True, False, True, False, False]
    df = spark.createDataFrame(list(enumerate(flags)), "idx long, f boolean")
    got = T.runs_test(df, [], "idx", "f").first()
    assert (got.runs, got.n_true, got.n_false) == (4, 3, 3)
    from itertools import permutations

    every = set(permutations(flags))
    few = [p for p in every if 1 + sum(x != y for x, y in zip(p, p[1:], strict=False)) <= 4]
    assert got.p == pytest.approx(len(few) / len(every))


def test_intervals(spark):
    one = spark.range(1)
    e = one.select(I.binomial_ci(I.CL95, F.lit(10), F.lit(10)).alias("e")).select(I.interval(F.col("e")).alias("i")).first().i
    assert e.hi == pytest.approx(1) and e.lo == pytest.approx(0.025 ** (1 / 10))
    e = one.select(I.poisson_ci(I.CL95, F.lit(0)).alias("e")).select(I.interval(F.col("e")).alias("i")).first().i
    assert e.lo == 0 and e.hi == pytest.approx(-math.log(0.025))
    point, sigma, low = F.lit(3.0), F.lit(0.5), F.lit(2.0)
    e = one.select(I.normal_error(point, sigma).alias("n"), I.from_interval(point, low, F.lit(7.0), I.CL90).alias("e"), I.upper_limit(point, I.CL99).alias("u"), I.lower_limit(low, I.CL95).alias("l"))
    e = e.select("n", "u", "l", I.asymmetric_errors(F.col("e")).alias("a"), I.scale(-3, F.col("n"), normal=True).alias("m")).first()
    assert (e.n.point, e.n.sigma, e.a.ldx, e.a.udx, e.u.limit, e.l.limit, e.m.point, e.m.sigma) == (3, 0.5, 1, 4, 3, 2, -9, 1.5)
    assert (e.u.alpha, e.l.alpha) == pytest.approx((0.01, 0.05))
    assert I.n_sigma_1(2.0).value == pytest.approx(I.n_sigma(2.0).value / 2) == pytest.approx(0.022750131948179)
    assert one.select(I.get_n_sigma_1(F.lit(0.022750131948179)).alias("z")).first().z == pytest.approx(2)
    with pytest.raises(Exception):  # noqa: B017
        one.select(I.naive_binomial_ci(F.lit(3), F.lit(5))).collect()
    assert I.CL90 < I.CL95 and I.CL.of(0.9).significance == pytest.approx(0.1)
    assert I.n_sigma(1.0).value == pytest.approx(0.31731050786291415)
    for bad in (lambda: I.CL(1.5), lambda: I.PValue(-1), lambda: I.n_sigma(0)):
        with pytest.raises(ValueError):
            bad()


def test_density(spark):
    x = np.random.default_rng(5).normal(size=200)
    got = G.kde(sample(spark, x), [], "x", 4096).orderBy("i").toPandas()
    assert np.trapezoid(got.density, got.x) == pytest.approx(1, abs=1e-3)
    n = G.histogram(sample(spark, x), [], "x", 10).orderBy("bin").toPandas()
    assert n.n.sum() == 200 and len(n) == 10
    assert [r.n for r in G.histogram(sample(spark, [3, 3]), [], "x", 2).orderBy("bin").collect()] in ([2, 0], [0, 2])
    with pytest.raises(Exception, match="outside"):
        G.histogram_fixed(sample(spark, [5]), [], "x", 4, 0, 1).collect()
    with pytest.raises(ValueError):
        G.kde(sample(spark, x), [], "x", 1)


def test_transforms(spark):
    v = [1.0, 2.0, -1.0, 0.5]
    row = spark.createDataFrame([(v,)], "v array<double>")
    back = row.select(X.idct(X.dct(F.col("v"))).alias("b")).first().b
    assert back == pytest.approx([8 * t for t in v])
    two = spark.createDataFrame([(v, [9.0] * 4)], "re array<double>, im array<double>")
    got = two.select(X.idct_complex(X.dct_complex(F.col("re"), F.col("im")), F.col("im")).alias("b"), X.dct_complex(F.col("re"), F.lit(None)).alias("n")).first()
    assert got.b == pytest.approx([8 * t for t in v]) and got.n is None
    with pytest.raises(Exception, match="power of two"):
        spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>").select(X.dct(F.col("v"))).collect()


def test_matrix_and_regression(spark):
    a = M.from_lists(spark, [[1, 2], [3, 4]])
    assert {(r.i, r.j): r.v for r in M.power(a, 3).collect()} == {(0, 0): 37, (0, 1): 54, (1, 0): 81, (1, 1): 118}
    assert M.center(M.identity(spark, 3)).first().v == 1
    entries = lambda m: {(r.i, r.j): r.v for r in m.collect()}
    assert entries(M.from_vector(spark, 2, 2, [1, 2, 3, 4])) == entries(a)
    assert {r.i: r.row for r in M.to_rows(a).collect()} == {0: [1, 2], 1: [3, 4]} and {r.j: r.column for r in M.to_columns(a).collect()} == {0: [1, 3], 1: [2, 4]}
    assert entries(M.from_rows(M.to_rows(a), "i", "row")) == entries(M.from_columns(M.to_columns(a), "j", "column")) == entries(a)
    vector = spark.createDataFrame([(0, 1.0), (1, -1.0)], "i long, v double")
    assert {r.i: r.v for r in M.multiply_vector(a, vector).collect()} == {0: -1, 1: -1}
    assert entries(M.diagonal(vector, "i", "v", 2)) == {(0, 0): 1, (0, 1): 0, (1, 0): 0, (1, 1): -1}
    with pytest.raises(Exception, match="dimensions"):
        M.multiply_vector(a, vector.where("i = 0")).collect()
    with pytest.raises(ValueError):
        M.from_vector(spark, 2, 2, [1])
    with pytest.raises(Exception, match="no such entry"):
        M.at(a, 5, 5).collect()
    with pytest.raises(ValueError):
        M.from_lists(spark, [[1], [2, 3]])
    df = spark.createDataFrame([(0.0, 4.0, 1000.0), (1.0, 2.0, 1001.0), (2.0, 1.0, 1002.0), (3.0, 1.0, 1003.0)], "a double, b double, y double")
    got = M.ols_regress(df, [], ["a", "b"], "y").first()
    assert got.coefficients == pytest.approx([1, 0, 1000], abs=1e-9) and got.r2 == pytest.approx(1)
    with pytest.raises(Exception, match="fewer rows"):
        M.ols(df.limit(1), [], ["a", "b"], "y").collect()
    assert M.balance(3, 10) == [4, 3, 3]


def test_resampling(spark):
    x = [1.0, 4.0, 2.0, 8.0, 5.0]
    df = sample(spark, x).withColumn("g", F.lit(1))
    for name, f in (("mean", np.mean), ("variance", np.var), ("variance_unbiased", lambda v: np.var(v, ddof=1)), ("std_dev", lambda v: np.std(v, ddof=1))):
        got = {r.idx: r.value for r in K.jackknife(df, ["g"], "x", name).collect()}
        assert [got[i] for i in range(5)] == pytest.approx([f(x[:i] + x[i + 1 :]) for i in range(5)])
    assert K.jackknife(sample(spark, [1]), [], "x", "mean").first().value is None
    once, again = (K.resample(df.repartition(n), ["g"], "idx", "x", {"m": "mean"}, 30, 1).orderBy("rep").collect() for n in (1, 3))
    assert once == again and len({r.m for r in once}) > 5
    assert len(set(K.split_seeds(1, 5))) == 5


def test_jackknife_by(spark):
    rng = random.Random(7)
    rows = [(g, k, float(rng.randrange(50))) for g, n in ((1, 1), (2, 2), (3, 37)) for k in range(n)]
    df = spark.createDataFrame(rows, "g int, k int, x double")
    for estimator, merge, brute in ((F.max, F.max, max), (F.count, F.sum, len), (F.sum, F.sum, sum), (F.max, None, max)):
        got = {(r.g, r.k): r.value for r in K.jackknife_by(df, ["g"], "k", "x", estimator, merge).collect()}
        want = {(g, k): brute(rest) for g, k, _ in rows if (rest := [v for h, j, v in rows if h == g and j != k])}
        assert got == want
    only = df.where("g = 3")
    got = {r.k: r.value for r in K.jackknife_by(only, [], "k", "x", F.max, F.max).collect()}
    assert got == {k: max(v for g, j, v in rows if g == 3 and j != k) for k in range(37)}


def test_one_value_bootstrap(spark):
    df = sample(spark, [7.0]).withColumn("g", F.lit(1))
    reps = K.resample(df, ["g"], "idx", "x", {"mean": "mean"}, 20, 1)
    got = K.bootstrap_bca(df, reps, ["g"], "x", "mean", 20, I.CL95).first()
    assert (got.point, got.lo, got.hi) == (7, 7, 7)


def _folder(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")


def test_wilcoxon_query_has_all_groups(spark, tmp_path):
    """Small groups by all signs of the ranks; a large one by the normal approximation."""
    rng, rows = random.Random(5), []
    for g, n in ((1, 3), (2, 7), (3, 9), (4, 130)):
        rows += [(k, g, float(k + 1 if rng.random() < 0.85 else -k - 1), 0.0) for k in range(n)]  # differences without ties
    rows += [(0, 5, 0.0, 0.0), (1, 5, 0.0, 0.0)]
    import datetime

    dated = [(*r, datetime.datetime(2020, 1, 1 + r[0] % 28)) for r in rows]  # one year, so that each supplier is a group
    _folder(spark, tmp_path, "lineitem", dated, "l_orderkey long, l_suppkey long, l_quantity double, l_discount double, l_shipdate timestamp")
    got = {r.g: r for r in registry.queries()["wilcoxon_test"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert got[5].n == 0 and got[5].p is None and got[5].significant is None
    for g in (1, 2, 3):
        d = [x for _, k, x, _ in rows if k == g]
        n, plus, minus = len(d), sum(x for x in d if x > 0), -sum(x for x in d if x < 0)
        below = sum(sum(s) <= min(plus, minus) for s in itertools.product(*[(0, k + 1) for k in range(n)])) / 2**n
        assert (got[g].n, got[g].t_plus, -got[g].t_minus) == (n, plus, minus)
        assert got[g].p == pytest.approx(min(1, 2 * below), abs=1e-6)
        lowest = [t for t in range(n * (n + 1) // 2 + 1) if sum(sum(s) <= t for s in itertools.product(*[(0, k + 1) for k in range(n)])) / 2**n <= 0.025]
        assert got[g].significant == (min(plus, minus) <= lowest[-1] if lowest else None)
    assert got[4].n == 130 and got[4].significant is True


def test_mannwhitney_query_has_all_groups(spark, tmp_path):
    """Small groups by all arrangements of the ranks; a large one by the normal approximation."""
    rng, rows = random.Random(6), []
    for g, n1, n2 in ((1, 1, 1), (2, 4, 5), (3, 3, 6), (4, 30, 40), (5, 0, 4)):
        rows += [(len(rows) + k, g, 1000.0 * x, "BUILDING" if k < n1 else "OTHER") for k, x in enumerate(rng.sample(range(n1 + n2), n1 + n2) if g != 3 else range(n1 + n2))]
    _folder(spark, tmp_path, "customer", rows, "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string")
    got = {r.g: r for r in registry.queries()["mannwhitney_test"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    for g in (1, 2, 3):
        own = [(x, s == "BUILDING") for _, k, x, s in rows if k == g]
        n1, n2 = sum(a for _, a in own), sum(not a for _, a in own)
        u1 = sum(x > y for x, a in own for y, b in own if a and not b)
        us = [sum(c) - n1 * (n1 - 1) // 2 for c in itertools.combinations(range(n1 + n2), n1)]
        lowest = [t for t in range(n1 * n2 + 1) if sum(u <= t for u in us) / len(us) < 0.2]
        assert (got[g].n1, got[g].n2, got[g].u1, got[g].u2) == (n1, n2, u1, n1 * n2 - u1)
        assert got[g].significant == (min(u1, n1 * n2 - u1) <= lowest[-1] if lowest else None)
    assert got[3].significant is True and got[4].significant is not None and got[5].significant is None


def test_block_draws_are_multinomial():
    """Blocks of a replicate sum up to n, in proportion to their sizes, and counts within a block are even."""
    from quantalake.operators import resampling as K

    n, reps = 3 * K.BLOCK + 1000, 3000
    each = np.array([K.block_draws(5, 77, n, b, reps) for b in range(4)])
    assert (each.sum(0) == n).all()
    for b, size in enumerate([K.BLOCK] * 3 + [1000]):
        p = size / n
        assert abs(each[b].mean() - n * p) < 5 * (n * p * (1 - p) / reps) ** 0.5
        assert abs(each[b].var() / (n * p * (1 - p)) - 1) < 0.15
    assert abs(np.corrcoef(each[0], each[1])[0, 1] + (K.BLOCK / n) / (1 - K.BLOCK / n)) < 0.1
    counts = np.concatenate([w for _, w in K.block_counts(5, 77, n, 3, 200)])
    assert (counts.sum(1) == K.block_draws(5, 77, n, 3, 200)).all()
    assert abs(counts.sum(0) - counts.sum() / 1000).max() < 6 * (counts.sum() / 1000) ** 0.5
    assert (K.block_draws(5, 77, 10, 0, 5) == 10).all()


def test_resample_moments(spark):
    """Against the same counts applied by hand; every replicate has n draws, in whatever partitions rows lie."""
    from quantalake.operators import resampling as K

    rng = np.random.default_rng(2)
    x = {1: rng.normal(size=K.BLOCK * 2 + 37), 2: rng.normal(size=5) + 1e6, 3: np.array([4.0])}
    rows = [(g, int(i), float(v)) for g, own in x.items() for i, v in enumerate(own)]
    df = spark.createDataFrame(rows, "n int, size long, rep double")  # names that working columns could have
    got = {(r[0], r["rep"]): r for r in K.resample_moments(df.repartition(5), ["n"], "size", "rep", 7, 3).collect()}
    again = {(r[0], r["rep"]): r for r in K.resample_moments(df.coalesce(1), ["n"], "size", "rep", 7, 3).collect()}
    keys = {r.n: r.h for r in df.select("n").distinct().selectExpr("n", "xxhash64(n) AS h").collect()}
    assert len(got) == 21
    for g, own in x.items():
        blocks = [np.concatenate([w for _, w in K.block_counts(3, keys[g] % (1 << 63), len(own), b, 7)]) for b in range(-(-len(own) // K.BLOCK))]
        for k, w in enumerate(np.concatenate(blocks, 1)):
            r, sample = got[g, k], np.repeat(own, w)
            assert r.draws == len(own) == len(sample)
            assert r.mean == pytest.approx(sample.mean(), abs=1e-9) and r.variance == pytest.approx(sample.var(), abs=1e-9)
            assert again[g, k].mean == pytest.approx(r.mean, abs=1e-12)
            if len(own) > 1:
                assert r.std_dev == pytest.approx(sample.std(ddof=1), abs=1e-9)
    whole = K.resample(df.where("n = 1").drop("n"), [], "size", "rep", {"m": "mean"}, 50, 9)
    assert abs(whole.agg({"m": "avg"}).first()[0] - x[1].mean()) < 5 * x[1].std() / (len(x[1]) * 50) ** 0.5


def test_bca_counts_equal_replicates_as_equal(spark):
    """Replicates that draw the whole sample equal its mean, in whatever order they are summed."""
    from quantalake.operators import resampling as K
    from quantalake.operators.inference import CL90

    x = [0.1, 0.2, 0.3, 0.7, 1.1]
    df = spark.createDataFrame([(1, float(v)) for v in x], "g int, x double")
    point = sum(x) / 5
    reps = spark.createDataFrame([(1, k, point + e) for k, e in enumerate([-1e-16, 1e-16, 0.0, -2e-16, -0.2, 0.2, 0.1, -0.1, 0.3, -0.3])], "g int, rep int, mean double")
    exact = spark.createDataFrame([(1, k, point + e) for k, e in enumerate([0.0, 0.0, 0.0, 0.0, -0.2, 0.2, 0.1, -0.1, 0.3, -0.3])], "g int, rep int, mean double")
    a, b = (K.bootstrap_bca(df, r, ["g"], "x", "mean", 10, CL90).first() for r in (reps, exact))
    assert a.lo == pytest.approx(b.lo, abs=1e-12) and a.hi == pytest.approx(b.hi, abs=1e-12)


def test_tall_qr(spark):
    """Many partitions, groups of few and many rows, a badly conditioned matrix, and dependent columns."""
    rng = np.random.default_rng(6)
    rows = [(1, *map(float, v)) for v in rng.normal(size=(5000, 3)) * [1, 1e3, 1e-3] + [5, 0, 1]]
    near = rng.normal(size=(3000, 1))
    rows += [(2, *map(float, v)) for v in np.hstack([near, near + 1e-7 * rng.normal(size=near.shape), rng.normal(size=near.shape)])]
    rows += [(3, *map(float, v)) for v in rng.normal(size=(3, 3))] + [(4, 1.0, 2.0, 3.0), (4, 0.5, None, 1.0)]
    rows += [(5, float(k), 2.0 * k, 1.0) for k in range(30)]
    df = spark.createDataFrame([(g, k, *v) for k, (g, *v) in enumerate(rows)], "n long, i long, a double, b double, c double").repartition(7)
    q, r = M.qr_tall(df, ["n"], ["a", "b", "c"])
    factors = {}
    for x in r.collect():
        factors.setdefault(x.n, np.zeros((3, 3)))[x.i, x.j] = x.v
    own = {x.i: x for x in q.collect()}
    for g in (1, 2, 3):
        keys = [k for k, x in enumerate(rows) if x[0] == g]
        a, qq = np.array([rows[k][1:] for k in keys]), np.array([[own[k].a, own[k].b, own[k].c] for k in keys])
        assert np.abs(np.tril(factors[g], -1)).max() == 0 and (np.diag(factors[g]) >= 0).all()
        assert np.abs(qq.T @ qq - np.eye(3)).max() < 1e-12
        assert np.abs(qq @ factors[g] - a).max() < 1e-11 * np.abs(a).max()
    assert np.isnan(own[len(rows) - 1].b)
    whole = M.triangular(df.where("n = 1"), [], ["a", "b", "c"]).first()
    assert np.allclose(np.array(whole.r).reshape(3, 3), factors[1], rtol=1e-9) and whole.n == 5000
    assert {x.n for x in M.triangular(df.where("n = 9"), ["n"], ["a", "b", "c"]).collect()} == set()


def test_ill_conditioned_least_squares(spark):
    """Predictors with a condition of 1e7: normal equations would lose all digits."""
    rng = np.random.default_rng(7)
    a = rng.normal(size=20_000)
    b = a + 1e-7 * rng.normal(size=20_000)
    df = spark.createDataFrame([(float(x), float(y), float(2 * x + 3 * y + 4)) for x, y in zip(a, b, strict=True)], "a double, b double, y double").repartition(6)
    got = M.ols_regress(df, [], ["a", "b"], "y").first()
    assert np.allclose(got.coefficients, [2, 3, 4], atol=1e-6) and got.r2 == pytest.approx(1)
    assert np.allclose(M.ols(df.withColumn("y", F.expr("2 * a + 3 * b")), [], ["a", "b"], "y").first().coefficients, [2, 3], atol=1e-6)
    constant = M.ols_regress(df.withColumn("y", F.lit(7.0)), [], ["a"], "y").first()
    assert constant.coefficients == pytest.approx([0, 7], abs=1e-9) and constant.r2 == 1
    dependent = M.ols_regress(df.withColumn("b", F.col("a") * 2), [], ["a", "b"], "y").first()
    assert np.isnan(dependent.coefficients).all() and dependent.r2 is None


@pytest.mark.parametrize("n", [1, 2, 8, 64, 2048])
def test_long_transforms(spark, n, monkeypatch):
    """Against arrays, in bundles of several sizes; shorter series are padded; groups by names of working columns."""
    from quantalake.operators import transform as X

    monkeypatch.setattr(X, "BUNDLE", 64)
    rng = np.random.default_rng(n)
    series = {g: rng.normal(size=max(1, n - 3 * g)) + 1j * rng.normal(size=max(1, n - 3 * g)) for g in (0, 1)}
    rows = [(g, i, float(v.real), float(v.imag)) for g, own in series.items() for i, v in enumerate(own)]
    df = spark.createDataFrame(rows, "rows int, j long, a double, b double").repartition(3)
    for call, f in ((lambda: X.fft_long(df, ["rows"], "j", "a", n, "b"), np.fft.fft), (lambda: X.ifft_long(df, ["rows"], "j", "a", "b", n), np.fft.ifft)):
        got = {(r.rows, r.k): complex(r.re, r.im) for r in call().collect()}
        assert len(got) == 2 * n
        for g, own in series.items():
            want = f(own, n)
            assert max(abs(got[g, k] - want[k]) for k in range(n)) < 1e-9 * max(1, np.abs(want).max())
    got = {(r.rows, r.k): r.v for r in X.dct_long(df, ["rows"], "j", "a", n).collect()}
    back = {(r.rows, r.k): r.v for r in X.idct_long(X.dct_long(df, ["rows"], "j", "a", n), ["rows"], "k", "v", n).collect()}
    for g, own in series.items():
        x = np.zeros(n)
        x[: len(own)] = own.real
        want = [2 * sum(x * np.cos(np.pi * k * (2 * np.arange(n) + 1) / (2 * n))) for k in range(n)]
        assert max(abs(got[g, k] - want[k]) for k in range(n)) < 1e-8
        assert max(abs(back[g, k] - 2 * n * x[k]) for k in range(n)) < 1e-8 * n


def test_long_transforms_refuse(spark):
    from quantalake.operators import transform as X

    df = spark.createDataFrame([(0, 1.0), (9, 2.0)], "i long, x double")
    with pytest.raises(ValueError, match="power"):
        X.fft_long(df, [], "i", "x", 12)
    with pytest.raises(Exception, match="outside"):
        X.fft_long(df, [], "i", "x", 8).collect()


@pytest.mark.parametrize("most", [None, 0, 3, 40])
def test_autocovariance_by_blocks(spark, most, monkeypatch):
    """Blocks of four values: all lags, few lags, series shorter than a block and of one value."""
    from quantalake.operators import correlation as C

    monkeypatch.setattr(C, "SHORTEST", 4)
    monkeypatch.setattr(C, "BLOCKS", 9)
    rng = np.random.default_rng(4)
    series = {g: rng.normal(size=n) + 7 for g, n in enumerate([1, 2, 3, 4, 5, 9, 37, 100])}
    df = spark.createDataFrame([(g, i, float(v)) for g, own in series.items() for i, v in enumerate(own)], "n int, lag long, c double").repartition(3)
    got = {}
    for r in C.autocovariance(df, ["n"], "lag", "c", most).toDF("g", "k", "v").collect():
        got[r.g, r.k] = r.v
    want = {}
    for g, own in series.items():
        d = own - own.mean()
        for k in range(0, min(len(own) - 2, len(own) if most is None else most) + 1):
            want[g, k] = (d[: len(d) - k] * d[k:]).sum() / len(d)
    assert set(got) == set(want)
    assert max(abs(got[k] - want[k]) for k in want) < 1e-10


def test_exact_sums_of_any_doubles(spark):
    """Cancellation, subnormal and huge values, zeros, values that aren't finite, and groups named as working columns."""
    from quantalake.functions.aggregates import exact_sums

    rng = random.Random(8)
    groups = {
        1: [1e308, 1.0, -1e308, 1e-300, 5e-324, -5e-324],
        2: [rng.uniform(-1, 1) * 2.0 ** rng.randrange(-1070, 1000) for _ in range(3000)],
        3: [0.1] * 10 + [-0.0, 0.0],
        4: [1e308, 1e308],
        5: [math.inf, 1.0],
        6: [math.inf, -math.inf],
        7: [-(2.0**53), 1.0, 1.0, 2.0**53 - 1, 5e-324],
        8: [5e-324] * 3,
        9: [2.0**k * (1 - 2.0**-53) for k in range(-1020, 1020, 7)],
    }
    rows = [(g, v) for g, own in groups.items() for v in own] + [(10, None)]
    got = {r.low: r.total for r in exact_sums(spark.createDataFrame(rows, "low int, x double").repartition(5), ["low"], "x").collect()}
    want = {g: math.fsum(v) for g, v in groups.items() if g not in (4, 5, 6)} | {4: math.inf, 5: math.inf}
    assert {g: v for g, v in got.items() if g != 6} == want and math.isnan(got[6])
    assert exact_sums(spark.createDataFrame(rows, "low int, x double").where("low = 3"), [], "x").first().total == math.fsum(groups[3])


def test_densities_by_running_moments(spark):
    """Against the kernel at each point; ties, a group of equal values apart."""
    from quantalake.operators import density as G

    rng = np.random.default_rng(9)
    groups = {1: rng.normal(size=500), 2: np.round(rng.normal(size=300), 1) * 1e3, 3: np.array([1.0, 2.0])}
    df = spark.createDataFrame([(g, float(v)) for g, own in groups.items() for v in own] + [(4, 1.0), (1, None)], "g int, x double")
    for n in (2, 17, 400):
        got = {(r.g, r.i): r for r in G.epanechnikov_pdf(df, ["g"], "x", n).collect()}
        want = {(r.g, r.i): r for r in G.simple_pdf(df, ["g"], "x", G.epanechnikov_bandwidth, G.epanechnikov_kernel, 1, n).collect()}
        assert set(got) == set(want)
        for k, r in want.items():
            assert got[k].x == pytest.approx(r.x, abs=1e-9 * max(1, abs(r.x)))
            assert got[k].density == pytest.approx(r.density, rel=1e-8, abs=1e-9 / np.ptp(groups[k[0]]))


def test_orders_of_ones_own(spark):
    from quantalake.operators import ranks as R

    words = ["b", "AA", "a", "c", "B", None, "ccc", "A"]
    df = spark.createDataFrame([(k % 2, k, w) for k, w in enumerate(words)], "g int, k int, w string")
    compare = lambda a, b: (a.lower() > b.lower()) - (a.lower() < b.lower())
    got = {r.k: r.rank for r in R.ranks_by(df, [], "w", compare).collect()}
    assert got == {2: 1.5, 7: 1.5, 1: 3, 0: 4.5, 4: 4.5, 3: 6, 6: 7}
    assert {r.k: r.rank for r in R.ranks_by(df, ["g"], "w", F.length("w")).collect()} == {0: 2, 2: 2, 4: 2, 6: 4, 1: 3, 3: 1.5, 7: 1.5}
    with pytest.raises(ValueError, match="more than 2"):
        R.custom_order(df, "w", compare, 2)


def test_groups_named_as_working_columns(spark):
    from quantalake.operators import hypothesis as T
    from quantalake.functions.distributions import Normal

    rng = np.random.default_rng(10)
    rows = [(g, k % 2 == 0, float(v), float(w)) for g in (1, 2) for k, (v, w) in enumerate(rng.normal(size=(9, 2)))]
    for name in ("n", "size", "rank", "na", "before", "all", "up", "__n"):
        df = spark.createDataFrame(rows, f"{name} int, a boolean, x double, y double")
        plain = spark.createDataFrame(rows, "g int, a boolean, x double, y double")
        for call in (
            lambda d, g: T.mann_whitney_u(d, [g], F.col("a"), "x"),
            lambda d, g: T.rank_sums(d, [g], F.col("a"), "x"),
            lambda d, g: T.signed_ranks(d, [g], "x", "y"),
            lambda d, g: T.ks_d(d, [g], "x", Normal(0, 1).cdf),
        ):
            want = sorted(map(tuple, call(plain, "g").collect()))
            if name in call(plain, "g").columns:
                with pytest.raises(ValueError, match="name of a result"):
                    call(df, name)
            else:
                assert sorted(map(tuple, call(df, name).collect())) == want


def test_numpy_estimators(spark):
    from quantalake.operators import resampling as K

    x = [3.0, 1.0, 2.0, 10.0, None]
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate(x)], "g int, idx long, x double")
    median = K.numpy_estimator(lambda v: np.median(v) if len(v) else np.nan)
    draws = spark.createDataFrame([(1, 0, i) for i in (0, 0, 1, 3, 4)] + [(1, 1, i) for i in (2, 2, 2, 2, 2)], "g int, rep int, idx long")
    got = {r.rep: r for r in K.resample(df, ["g"], "idx", "x", {"m": median, "most": F.max}, 2, 0, draws).collect()}
    assert (got[0].m, got[0].most, got[1].m) == (3.0, 10.0, 2.0)
    assert {r.idx: r.value for r in K.jackknife_by(df.where("x is not null"), ["g"], "idx", "x", median).collect()} == {0: 2.0, 1: 3.0, 2: 3.0, 3: 2.0}


def test_draws_are_not_broadcast(spark):
    """Spark sees a row a group where draws are replicates x rows: they neither meet in the driver nor in one task."""
    df = spark.createDataFrame([(g, i) for g, n in (("a", 30), ("b", 9)) for i in range(n)], "g string, idx long")
    rows = K.resample_rows(df, ["g"], "idx", 40, 3)
    found = [line for line in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]
    assert found and all("ShuffledHashJoin" in line for line in found)
    assert {(r.g, r.rep): r["count"] for r in rows.groupBy("g", "rep").count().collect()} == {(g, rep): n for g, n in (("a", 30), ("b", 9)) for rep in range(40)}
    sizes = df.groupBy("g").count()
    assert K.replicated(sizes, ["g"], 40).withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 1


def test_qr_of_rows(spark):
    """Equal and dependent columns, nulls, and a group with too few rows; R is that of ``qr`` where columns don't depend."""
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=(40, 3)), "b": np.column_stack([rng.normal(size=9), np.full(9, 7.0), np.ones(9)]), "c": np.ones((4, 3)), "d": rng.normal(size=(2, 3))}
    rows = [(g, *map(float, v)) for g, m in groups.items() for v in m] + [("a", None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double").repartition(3)
    found = {}
    for r in M.qr_rows(df, ["g"], ["x", "y", "z"]).collect():
        found.setdefault(r.g, []).append(r)
    assert {g: len(own) for g, own in found.items()} == {"a": 40, "b": 9, "c": 4}
    for own in found.values():
        a, q, r = np.array([x[1:4] for x in own]), np.array([x.q for x in own]), np.array(own[0].r).reshape(3, 3)
        assert np.abs(q @ r - a).max() < 1e-12 and np.abs(q.T @ q - np.eye(3)).max() < 1e-12
        assert (np.diag(r) >= 0).all() and np.abs(np.tril(r, -1)).max() < 1e-14
    cells = M.from_rows(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(groups["a"])], "i long, v array<double>"), "i", "v").withColumn("g", F.lit("a"))
    want = {(r.i, r.j): r.v for r in M.qr(cells, ["g"]).where("part = 'r'").collect()}
    assert found["a"][0].r == pytest.approx([want[i, j] for i in range(3) for j in range(3)], abs=1e-12)


def test_jackknife_trimmed(spark):
    """Against each sample by hand: groups around the sizes where one more value is cut, ties, nulls, one row, no value."""
    rng = random.Random(11)
    sizes = {0: 1, 1: 2, 2: 9, 3: 10, 4: 11, 5: 12, 6: 20, 7: 21, 8: 22, 9: 57, 10: 121}
    rows = [(g, k, rng.choice([None, 1.0, float(rng.randrange(9)), rng.random() * 9])) for g, n in sizes.items() for k in range(n)] + [(11, k, None) for k in range(3)] + [(12, 0, 4.0), (12, 1, None)]
    df = spark.createDataFrame(rows, "g int, k int, x double")
    for parts in (10, 3):
        for own, by in ((df, ["g"]), (df.where("g = 9"), [])):
            got = {(r.g if by else 9, r.k): r.value for r in K.jackknife_trimmed(own, by, "k", "x", parts).collect()}
            want = {}
            for g, k, _ in rows:
                rest = sorted(v for h, j, v in rows if h == g and j != k and v is not None)
                if (by or g == 9) and sum(h == g for h, _, _ in rows) > 1:
                    cut = len(rest) // parts
                    want[g, k] = pytest.approx(float(np.mean(rest[cut : len(rest) - cut])), rel=1e-12) if rest else None
            assert got == want
    with pytest.raises(ValueError):
        K.jackknife_trimmed(df, ["g"], "k", "x", 2)
    ends = sample(spark, [-math.inf, 1e-320, 3.0, *[0.1] * 6, 1.0, -1.0, math.inf])
    assert [r.value for r in K.jackknife_trimmed(ends, [], "idx", "x").orderBy("idx").collect()][2] == pytest.approx(0.6 / 9)


def test_jackknife_trimmed_is_not_quadratic(spark):
    """The plan of the query has no join of a group's rows with its rows."""
    plan = registry.queries()["jackknife_trimmed"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "NOT (" not in plan and "arrow_udf" not in plan.lower() and plan.count("Join Inner") <= 4
