"""Queries of distributions: functions of columns of the tables, moments of fitted parameters, fits and variates."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quantalake.functions import distributions as D
from quantalake.operators.quantiles import MEDIAN_UNBIASED, fit_laplace
from quantalake.plans.common import LINES, ORDERS, PARTS, beta_i, digamma, gamma_p, lines, orders, parts, phi, r, r_scaled, sr
from quantalake.plans.summaries import quantile_sql
from quantalake.sources.tables import load

QUERIES, SQL = {}, {}
PI = repr(math.pi)
#: An order's price as an argument from -4 to 8.5, its price within a thousand as a probability, and a whole or half
#: number from -2 to 18.
X, U, K = "o_totalprice / 40000 - 4", "(o_totalprice % 1000 + 0.5) / 1001", "floor(o_totalprice / 25000) - 2 + (o_orderkey % 2) / 2"
POINTS = f"points AS (SELECT o_orderkey AS i, {X} AS x, {U} AS u FROM orders)"
WHOLE = f"points AS (SELECT o_orderkey AS i, {K} AS x FROM orders)"
#: A number in (0, 1) from a hash of the key of an order.
HASHED = "hashed AS (SELECT o_orderkey AS i, (('0x' || substr(md5(o_orderkey::VARCHAR), 1, 13))::BIGINT + 0.5::DOUBLE) / pow(2::DOUBLE, 52) AS u FROM orders)"


def _normal_pdf(z: str) -> str:
    return f"(exp(-({z}) * ({z}) / 2) / sqrt(2 * {PI}))"


def _positive(x: str, value: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN {value} ELSE 0.0 END)"


def _t_cdf(x: str, n: str) -> str:
    inner = beta_i("0.5", f"({n} / 2)", f"({x} * {x} / ({n} + {x} * {x}))", 1500)
    return f"(0.5 + 0.5 * sign({x}) * {inner})"


#: Continuous: the distribution, its cdf, its density in SQL.
CONTINUOUS = {
    "normal": (D.Normal(1, 2), phi("((x - 1) / 2)"), f"{_normal_pdf('((x - 1) / 2)')} / 2"),
    "lognormal": (D.Lognormal(0.3, 0.6), _positive("x", phi("((ln(greatest(x, 1e-300)) - 0.3) / 0.6)")), _positive("x", _normal_pdf("((ln(greatest(x, 1e-300)) - 0.3) / 0.6)") + " / (0.6 * x)")),
    "exponential": (D.Exponential(0.7), _positive("x", "1 - exp(-0.7 * x)"), "(CASE WHEN x >= 0 THEN 0.7 * exp(-0.7 * x) ELSE 0.0 END)"),
    "gamma": (D.Gamma(2.5, 1.3), gamma_p("2.5", "(x / 1.3)"), _positive("x", "exp(1.5 * ln(greatest(x, 1e-300) / 1.3) - x / 1.3 - lgamma(2.5)) / 1.3")),
    "beta": (D.Beta(2.2, 3.1), f"(CASE WHEN x > 0.5 THEN 1 - {beta_i('3.1', '2.2', '(1 - x)')} ELSE {beta_i('2.2', '3.1', 'x')} END)", "(CASE WHEN x > 0 AND x < 1 THEN exp(1.2 * ln(greatest(x, 1e-300)) + 2.1 * ln(greatest(1 - x, 1e-300)) + lgamma(5.3) - lgamma(2.2) - lgamma(3.1)) ELSE 0.0 END)"),
    "chi_squared": (D.ChiSquared(5), gamma_p("2.5", "(x / 2)"), _positive("x", "exp(1.5 * ln(greatest(x, 1e-300) / 2) - x / 2 - lgamma(2.5)) / 2")),
    "student_t": (D.StudentT(4.5), _t_cdf("x", "4.5"), f"exp(lgamma(2.75) - lgamma(2.25) - 2.75 * ln(1 + x * x / 4.5)) / sqrt(4.5 * {PI})"),
    "student_t_shifted": (D.student_unstandardized(4.5, 1, 2), _t_cdf("((x - 1) / 2)", "4.5"), f"exp(lgamma(2.75) - lgamma(2.25) - 2.75 * ln(1 + (x - 1) * (x - 1) / 18)) / sqrt(4.5 * {PI}) / 2"),
    "fisher_f": (D.FisherF(5, 8), beta_i("2.5", "4.0", "(CASE WHEN x > 0 THEN 5 * x / (5 * x + 8) ELSE 0 END)", 1500), _positive("x", "exp(2.5 * ln(5) + 4 * ln(8) + 1.5 * ln(greatest(x, 1e-300)) - 6.5 * ln(8 + 5 * greatest(x, 0)) + lgamma(6.5) - lgamma(2.5) - lgamma(4.0))")),
    "cauchy": (D.Cauchy(0.5, 1.5), f"0.5 + atan((x - 0.5) / 1.5) / {PI}", f"1 / ({PI} * 1.5 * (1 + pow((x - 0.5) / 1.5, 2)))"),
    "laplace": (D.Laplace(1, 1.2), "(CASE WHEN x <= 1 THEN 0.5 * exp((x - 1) / 1.2) ELSE 1 - 0.5 * exp((1 - x) / 1.2) END)", "exp(-abs(x - 1) / 1.2) / 2.4"),
    "uniform": (D.Uniform(-1, 4), "greatest(0.0, least(1.0, (x + 1) / 5))", "(CASE WHEN x BETWEEN -1 AND 4 THEN 0.2 ELSE 0.0 END)"),
    "weibull": (D.Weibull(1.7, 2), _positive("x", "1 - exp(-pow(greatest(x, 0) / 2, 1.7))"), _positive("x", "1.7 / 2 * pow(greatest(x, 0) / 2, 0.7) * exp(-pow(greatest(x, 0) / 2, 1.7))")),
    "linear_transform": (D.LinearTransform.around(1, 2, D.Normal(1, 1)), phi("((x - 1) / 2)"), f"{_normal_pdf('((x - 1) / 2)')} / 2"),
}

CHOOSE = "exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"
#: Discrete: the distribution, its mass at a whole x of the support, and the first and last outcome.
DISCRETE = {
    "binomial": (D.Binomial(9, 0.3), "exp(lgamma(10) - lgamma(k + 1) - lgamma(10 - k) + k * ln(0.3) + (9 - k) * ln(0.7))", 0, 9),
    "poisson": (D.Poisson(2.6), "exp(k * ln(2.6) - 2.6 - lgamma(k + 1))", 0, 60),
    "geometric": (D.Geometric(0.35), "0.35 * pow(0.65, k - 1)", 1, 60),
    "geometric0": (D.Geometric0(0.35), "0.35 * pow(0.65, k)", 0, 60),
    "negative_binomial": (D.NegativeBinomial(2.5, 0.45), "exp(lgamma(k + 2.5) - lgamma(k + 1) - lgamma(2.5) + 2.5 * ln(0.45) + k * ln(0.55))", 0, 60),
    "hypergeometric": (D.Hypergeometric(7, 20, 9), "exp(lgamma(8) - lgamma(k + 1) - lgamma(8 - k) + lgamma(14) - lgamma(10 - k) - lgamma(5 + k) - lgamma(21) + lgamma(10) + lgamma(12))", 0, 7),
    "discrete_uniform": (D.DiscreteUniform(2, 8), "1 / 7.0", 2, 8),
}


def _orders(spark, d, **columns: str):
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("i"), *[F.expr(e).alias(n) for n, e in columns.items()])


def _continuous(name: str, own: D.Distribution, cdf: str, pdf: str) -> None:
    def run(spark, d):
        g = _orders(spark, d, x=X, u=U).select("i", "x", "u", own.ppf("u").alias("q"), own.isf("u").alias("t"))
        columns = {"cdf": own.cdf("x"), "sf": own.sf("x"), "pdf": own.pdf("x"), "log_pdf": F.exp(own.logpdf("x")), "quantile_back": own.cdf("q"), "upper_back": own.sf("t")}
        return g.select("i", *[r_scaled(c, 5).alias(n) for n, c in columns.items()])

    QUERIES[f"dist_{name}"] = run
    parts = {"cdf": cdf, "sf": f"1 - ({cdf})", "pdf": pdf, "log_pdf": pdf, "quantile_back": "u", "upper_back": "u"}
    SQL[f"dist_{name}"] = f"WITH {POINTS} SELECT i, {', '.join(f'{sr(c, 5)} AS {n}' for n, c in parts.items())} FROM points"


def normal_prices(spark, d):
    """How likely a lower price is than that of each line item, by a normal distribution: arithmetic in Spark alone."""
    own = lines(spark, d)
    return own.select("orderkey", "line", r(D.Normal(50, 25).cdf("x"), 9).alias("cdf"), r(D.Normal(50, 25).sf("x"), 9).alias("sf"))


QUERIES["normal_prices"] = normal_prices
SQL["normal_prices"] = f"WITH {LINES} SELECT orderkey, line, {sr(phi('((x - 50) / 25)'), 9)} AS cdf, {sr('1 - ' + phi('((x - 50) / 25)'), 9)} AS sf FROM li"


def _discrete(name: str, own: D.Discrete, mass: str, first: int, last: int) -> None:
    def run(spark, d):
        g = _orders(spark, d, x=K)
        return g.select("i", r(own.cdf("x")).alias("cdf"), r(own.sf("x")).alias("sf"), r(own.pmf("x")).alias("pmf"))

    QUERIES[f"dist_{name}"] = run
    SQL[f"dist_{name}"] = f"""WITH {WHOLE}, m AS (SELECT k::DOUBLE AS k, ({mass})::DOUBLE AS p FROM (SELECT v::DOUBLE AS k FROM range({first}, {last + 1}) t(v))),
e AS (SELECT x, coalesce(sum(p) FILTER (WHERE k <= x), 0) AS c, coalesce(sum(p) FILTER (WHERE k = x), 0) AS p FROM (SELECT DISTINCT x FROM points), m GROUP BY x)
SELECT i, {sr('c')} AS cdf, {sr('1 - c')} AS sf, {sr('p')} AS pmf FROM points JOIN e USING (x)"""


for _name, (_own, _cdf, _pdf) in CONTINUOUS.items():
    _continuous(_name, _own, _cdf, _pdf)
for _name, (_own, _mass, _first, _last) in DISCRETE.items():
    _discrete(_name, _own, _mass, _first, _last)


def _beta_prime_entropy(a: str, b: str) -> str:
    return f"lgamma({a}) + lgamma({b}) - lgamma({a} + {b}) - ({a} - 1) * ({digamma(a)} - {digamma(b)}) + ({a} + {b}) * ({digamma(f'({a} + {b})')} - {digamma(b)})"


#: What families are fitted with, by brand: m and s, the geometric mean and the deviation of prices, and y, the mean size.
STATS = {"m": "exp(avg(ln(x)))", "s": "stddev_samp(x)", "y": "avg(y)"}
#: Families: how they are made, their parameters a, b, c from m, s and y, and mean, variance and entropy in SQL.
MOMENTS = {
    "normal": (D.Normal, ["m", "s"], "a", "b * b", f"0.5 * ln(2 * {PI} * exp(1) * b * b)"),
    "lognormal": (D.Lognormal, ["m / 10", "s / 10"], "exp(a + b * b / 2)", "(exp(b * b) - 1) * exp(2 * a + b * b)", f"a + 0.5 * ln(2 * {PI} * exp(1) * b * b)"),
    "exponential": (D.Exponential, ["1 / m"], "1 / a", "1 / (a * a)", "1 - ln(a)"),
    "gamma": (D.Gamma, ["1 + y / 20", "m / 5"], "a * b", "a * b * b", f"a + ln(b) + lgamma(a) + (1 - a) * {digamma('a')}"),
    "beta": (D.Beta, ["1 + y / 20", "1 + m / 5"], "a / (a + b)", "a * b / ((a + b) * (a + b) * (a + b + 1))", f"lgamma(a) + lgamma(b) - lgamma(a + b) - (a - 1) * {digamma('a')} - (b - 1) * {digamma('b')} + (a + b - 2) * {digamma('(a + b)')}"),
    "chi_squared": (D.ChiSquared, ["floor(y)"], "a", "2 * a", f"a / 2 + ln(2) + lgamma(a / 2) + (1 - a / 2) * {digamma('(a / 2)')}"),
    "student_t": (D.StudentT, ["2.5 + y / 10"], "0", "a / (a - 2)", f"(a + 1) / 2 * ({digamma('((a + 1) / 2)')} - {digamma('(a / 2)')}) + 0.5 * ln(a) + lgamma(a / 2) + lgamma(0.5) - lgamma((a + 1) / 2)"),
    "fisher_f": (D.FisherF, ["floor(y)", "5 + floor(m / 2)"], "b / (b - 2)", "2 * b * b * (a + b - 2) / (a * (b - 2) * (b - 2) * (b - 4))", f"{_beta_prime_entropy('(a / 2)', '(b / 2)')} + ln(b / a)"),
    "cauchy": (D.Cauchy, ["m", "s"], "NULL", "NULL", f"ln(4 * {PI} * b)"),
    "laplace": (D.Laplace, ["m", "s"], "a", "2 * b * b", "1 + ln(2 * b)"),
    "uniform": (D.Uniform, ["m - s", "m + s"], "(a + b) / 2", "(b - a) * (b - a) / 12", "ln(b - a)"),
    "weibull": (D.Weibull, ["1 + y / 20", "m"], "b * exp(lgamma(1 + 1 / a))", "b * b * (exp(lgamma(1 + 2 / a)) - exp(2 * lgamma(1 + 1 / a)))", "0.5772156649015329 * (1 - 1 / a) + ln(b / a) + 1"),
    "linear_transform": (lambda a, b: D.LinearTransform.around(a, b, D.Normal(a, 1)), ["m", "s"], "a", "b * b", f"0.5 * ln(2 * {PI} * exp(1) * b * b)"),
}
#: Discrete families: parameters, the mass at k in SQL, and how many outcomes from the first one hold nearly all of it.
MASSES = {
    "binomial": (lambda n, p: D.Binomial(int(n), p), ["floor(y)", "y / 60"], "exp(lgamma(a + 1) - lgamma(k + 1) - lgamma(a - k + 1) + k * ln(b) + (a - k) * ln(1 - b))", "k <= a", 0),
    "poisson": (D.Poisson, ["m / 4"], "exp(k * ln(a) - a - lgamma(k + 1))", "true", 0),
    "geometric": (D.Geometric, ["y / 60"], "a * pow(1 - a, k - 1)", "true", 1),
    "geometric0": (D.Geometric0, ["y / 60"], "a * pow(1 - a, k)", "true", 0),
    "negative_binomial": (D.NegativeBinomial, ["s", "y / 60"], "exp(lgamma(k + a) - lgamma(k + 1) - lgamma(a) + a * ln(b) + k * ln(1 - b))", "true", 0),
    "hypergeometric": (lambda m, l, k: D.Hypergeometric(int(m), int(l), int(k)), ["floor(y / 2)", "floor(y)", "floor(y / 3)"], "exp(lgamma(a + 1) - lgamma(k + 1) - lgamma(a - k + 1) + lgamma(b - a + 1) - lgamma(c - k + 1) - lgamma(b - a - c + k + 1) - lgamma(b + 1) + lgamma(c + 1) + lgamma(b - c + 1))", "k <= a AND k <= c AND k >= a + c - b", 0),
    "discrete_uniform": (lambda a, b: D.DiscreteUniform(int(a), int(b)), ["floor(m)", "floor(m + y)"], "1 / (b - a + 1)", "k BETWEEN a AND b", 0),
}


def dist_moments(spark, d):
    """Mean, variance and entropy of every family with parameters from each brand's prices and sizes."""
    own = parts(spark, d).groupBy("g").agg(*[F.expr(e).alias(n) for n, e in STATS.items()])
    made = {n: x[:2] for n, x in {**MOMENTS, **MASSES}.items()}
    each = [F.struct(F.lit(n).alias("family"), D.moments(make, *map(F.expr, given)).alias("m")) for n, (make, given) in made.items()]
    flat = own.select("g", F.explode(F.array(*each)).alias("e"))
    return flat.select("g", "e.family", *[r(f"e.m.{n}", 5).alias(n) for n in ("mean", "variance", "entropy")])


def _given(given: list[str]) -> str:
    return ", ".join(f"({e})::DOUBLE AS {n}" for n, e in zip("abc", given, strict=False))


QUERIES["dist_moments"] = dist_moments
SQL["dist_moments"] = f"WITH {PARTS}, st AS (SELECT g, {', '.join(f'{e} AS {n}' for n, e in STATS.items())} FROM pa GROUP BY g) " + " UNION ALL ".join(
    [f"SELECT g, '{n}' AS family, {sr(m, 5)} AS mean, {sr(v, 5)} AS variance, {sr(e, 5)} AS entropy FROM (SELECT g, {_given(x)} FROM st)" for n, (_, x, m, v, e) in MOMENTS.items()]
    + [
        f"SELECT g, '{n}', {sr('sum(k * p)', 5)}, {sr('sum(k * k * p) - pow(sum(k * p), 2)', 5)}, {sr('-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END)', 5)} FROM (SELECT g, k, ({mass})::DOUBLE AS p FROM (SELECT g, {_given(x)} FROM st), (SELECT v::DOUBLE AS k FROM range({low}, 400) t(v)) WHERE {where}) GROUP BY g"
        for n, (_, x, mass, where, low) in MASSES.items()
    ]
)


def _fit(name: str, family, fields: list[str], sql: str) -> None:
    def run(spark, d):
        own = lines(spark, d).groupBy("g", "s").agg(family.fit("x").alias("f"))
        return own.select("g", "s", *[r(F.col(f"f.{n}")).alias(n) for n in fields])

    QUERIES[f"fit_{name}"] = run
    SQL[f"fit_{name}"] = f"WITH {LINES} SELECT g, s, {sql} FROM li GROUP BY g, s"


_fit("normal", D.Normal, ["mu", "sigma"], f"{sr('avg(x)')} AS mu, {sr('stddev_pop(x)')} AS sigma")
_fit("lognormal", D.Lognormal, ["mu", "sigma"], f"{sr('avg(ln(x))')} AS mu, {sr('stddev_pop(ln(x))')} AS sigma")
_fit("exponential", D.Exponential, ["rate"], f"{sr('1 / avg(x)')} AS rate")
_fit("weibull", D.Weibull, ["shape", "scale"], f"{sr('pow(stddev_samp(x) / avg(x), -1.086)')} AS shape, {sr('avg(x) / exp(lgamma(1 + 1 / pow(stddev_samp(x) / avg(x), -1.086)))')} AS scale")


def fit_laplace_query(spark, d):
    own = fit_laplace(orders(spark, d), ["g"], "x")
    return own.select("g", r("location").alias("location"), r("scale").alias("scale"))


QUERIES["fit_laplace"] = fit_laplace_query
SQL["fit_laplace"] = f"WITH {ORDERS}, m AS ({quantile_sql('ord', 'g', 'x', 1, 2, MEDIAN_UNBIASED)}) SELECT g, {sr('max(v)')} AS location, {sr('avg(abs(x - v))')} AS scale FROM ord JOIN m USING (g) GROUP BY g"


#: The variate that u gives, in SQL, where that is a formula; those of Poisson count cumulated masses.
INVERSES = {
    "exponential": "-ln(1 - u) / 0.7",
    "cauchy": f"0.5 + 1.5 * tan({PI} * (u - 0.5))",
    "laplace": "(CASE WHEN u < 0.5 THEN 1 + 1.2 * ln(2 * u) ELSE 1 - 1.2 * ln(2 * (1 - u)) END)",
    "uniform": "5 * u - 1",
    "weibull": "2 * pow(-ln(1 - u), 1 / 1.7)",
    "geometric": "floor(ln(u) / ln(1 - 0.35)) + 1",
    "geometric0": "floor(ln(u) / ln(1 - 0.35))",
    "discrete_uniform": "floor(u * 7) + 2",
    "poisson": "(SELECT count(*) FROM (SELECT sum(p) OVER (ORDER BY k) AS c FROM masses) WHERE c < u)",
}


def _sample(name: str, own: D.Distribution) -> None:
    """A variate an order, from a hash of its key: its value, and for continuous families its probability again."""

    def run(spark, d):
        u = (F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / 2.0**52
        own_rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("i"), u.alias("u")).withColumn("v", own.variate("u"))
        columns = {"v": r(F.col("v").cast("double"), 5)} if name in INVERSES else {}
        if not own.discrete:
            columns["back"] = r(own.cdf("v"), 5)
        return own_rows.select("i", *[c.alias(n) for n, c in columns.items()])

    QUERIES[f"sample_{name}"] = run
    columns = [f"{sr(INVERSES[n], 5)} AS v" for n in INVERSES if n == name] + [f"{sr('u', 5)} AS back"] * (not own.discrete)
    masses = ", masses AS (SELECT k, (exp(k * ln(2.6) - 2.6 - lgamma(k + 1)))::DOUBLE AS p FROM (SELECT v::DOUBLE AS k FROM range(0, 61) t(v)))" if name == "poisson" else ""
    SQL[f"sample_{name}"] = f"WITH {HASHED}{masses} SELECT i, {', '.join(columns)} FROM hashed"


for _name, _x in {**CONTINUOUS, **{k: v for k, v in DISCRETE.items() if k in ("poisson", "geometric", "geometric0", "discrete_uniform")}}.items():
    _sample(_name, _x[0])
