"""Queries of descriptive aggregates, power sums, quantiles and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantalake.functions import aggregates as A
from quantalake.operators import quantiles as Q
from quantalake.operators import ranks as R
from quantalake.plans.common import CUSTOMERS, LINES, ORDERS, PARTS, customers, lines, orders, parts, r, ranks, rounded, sr
from quantalake.sources.tables import load

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


M = "avg(x) OVER (PARTITION BY g, s)"
POWERS = "count(x)::DOUBLE AS p0, sum(x) AS p1, sum(x*x) AS p2, sum(x*x*x) AS p3, sum(x*x*x*x) AS p4"
SKEW = "(avg(d*d*d) / pow(avg(d*d), 1.5))"


@query(f"""WITH {LINES}, c AS (SELECT g, s, x, x - {M} AS d FROM li)
SELECT g, s, count(*) AS n, {sr('avg(x)')} AS mean, {sr('var_pop(x)')} AS var_pop, {sr('coalesce(var_samp(x), 0)')} AS var_samp,
{sr('coalesce(stddev_samp(x), 0)')} AS sd, {sr('coalesce(stddev_samp(x), 0) / sqrt(count(*))')} AS se, {sr(SKEW)} AS skewness, {sr('kurtosis_pop(x)')} AS kurtosis,
{sr('max(x) - min(x)')} AS span FROM c GROUP BY g, s""")
def summary_stats(spark, d):
    return lines(spark, d).groupBy("g", "s").agg(
        F.count("x").alias("n"), r(A.mean("x")).alias("mean"), r(A.variance("x")).alias("var_pop"), r(A.variance_unbiased("x")).alias("var_samp"), r(A.std_dev("x")).alias("sd"),
        r(A.std_err_mean("x")).alias("se"), r(A.skewness("x")).alias("skewness"), r(A.kurtosis("x")).alias("kurtosis"), r(A.sample_range("x")).alias("span"),
    )


@query(f"WITH {LINES} SELECT g, s, {sr('max(x) - min(x)')} AS span, min(x) AS lo, max(x) AS hi FROM li GROUP BY g, s")
def range_stats(spark, d):
    own = lines(spark, d).groupBy("g", "s").agg(r(A.sample_range("x")).alias("span"), R.min_max("x").alias("m"))
    return own.select("g", "s", "span", F.col("m.min").alias("lo"), F.col("m.max").alias("hi"))


@query(f"WITH {LINES} SELECT g, s, {sr('avg(x)')} AS mean, {sr('avg(x)')} AS running_mean, {sr('avg(x*x)')} AS square_mean FROM li GROUP BY g, s")
def mean_family(spark, d):
    return lines(spark, d).groupBy("g", "s").agg(r(A.mean("x")).alias("mean"), r(A.running_mean("x")).alias("running_mean"), r(A.expectation(R.square, "x")).alias("square_mean"))


@query(f"WITH {LINES} SELECT g, s, {sr('sum(x*q)/sum(q)')} AS weighted_mean FROM li GROUP BY g, s")
def weighted_mean(spark, d):
    return lines(spark, d).groupBy("g", "s").agg(r(A.weighted_mean("x", "q")).alias("weighted_mean"))


@query(f"WITH {LINES} SELECT g, s, {sr('count(x)/sum(1/x)')} AS harmonic_mean FROM li GROUP BY g, s")
def harmonic_mean(spark, d):
    return lines(spark, d).groupBy("g", "s").agg(r(A.harmonic_mean("x")).alias("harmonic_mean"))


@query(f"WITH {LINES} SELECT g, s, {sr('exp(avg(ln(x)))')} AS geometric_mean FROM li GROUP BY g, s")
def geometric_mean(spark, d):
    return lines(spark, d).groupBy("g", "s").agg(r(A.geometric_mean("x")).alias("geometric_mean"))


@query(f"""WITH {LINES}, c AS (SELECT g, s, q / 10 - avg(q / 10) OVER (PARTITION BY g, s) AS d FROM li)
SELECT g, s, 1.0::DOUBLE AS m0, 0.0::DOUBLE AS m1, {sr('avg(d*d)')} AS m2, {sr('avg(d*d*d)')} AS m3, {sr('avg(d*d*d*d)')} AS m4 FROM c GROUP BY g, s""")
def central_moments(spark, d):
    own = A.central_moments(lines(spark, d).withColumn("y", F.col("q") / 10), ["g", "s"], "y", [0, 1, 2, 3, 4])
    return rounded(own, "m2", "m3", "m4")


@query(f"WITH {LINES}, c AS (SELECT g, s, x, x - {M} AS d FROM li) SELECT g, s, {sr(SKEW)} AS skewness, {sr('kurtosis_pop(x)')} AS kurtosis FROM c GROUP BY g, s")
def skew_kurt(spark, d):
    return lines(spark, d).groupBy("g", "s").agg(r(A.skewness("x")).alias("skewness"), r(A.kurtosis("x")).alias("kurtosis"))


@query(f"""WITH {LINES} SELECT g, s, {sr('var_pop(x)')} AS variance, {sr('coalesce(var_samp(x),0)')} AS variance_unbiased, {sr('coalesce(stddev_samp(x),0)')} AS std_dev,
{sr('stddev_pop(x)')} AS fast_std_dev, {sr('coalesce(stddev_samp(x),0)/sqrt(count(x))')} AS std_err, {sr('var_pop(x)')} AS fast_variance, {sr('avg(x)')} AS mean FROM li GROUP BY g, s""")
def variance_family(spark, d):
    own = lines(spark, d).groupBy("g", "s").agg(A.mean_variance("x").alias("mv"), A.mean_variance_unbiased("x").alias("mu"), A.std_dev("x").alias("std_dev"), A.fast_std_dev("x").alias("fast_std_dev"), A.std_err_mean("x").alias("std_err"), A.fast_variance("x").alias("fast_variance"))
    return rounded(own.select("g", "s", F.col("mv.variance").alias("variance"), F.col("mu.variance").alias("variance_unbiased"), "std_dev", "fast_std_dev", "std_err", "fast_variance", F.col("mu.mean").alias("mean")), "variance", "variance_unbiased", "std_dev", "fast_std_dev", "std_err", "fast_variance", "mean")


@query(f"""WITH {LINES}, m AS (SELECT g, s, sum(x*q)/sum(q) AS m FROM li GROUP BY g, s)
SELECT g, s, {sr('sum(q*(x-m)*(x-m))/sum(q)')} AS variance FROM li JOIN m USING (g, s) GROUP BY g, s""")
def weighted_variance(spark, d):
    return rounded(A.weighted_variance(lines(spark, d), ["g", "s"], "x", "q"), "variance")


@query(f"WITH {LINES} SELECT g, s, {sr('covar_pop(x, q)')} AS covariance FROM li GROUP BY g, s")
def covariance(spark, d):
    return lines(spark, d).groupBy("g", "s").agg(r(A.covariance("x", "q")).alias("covariance"))


@query(f"WITH {LINES} SELECT g, s, {sr('corr(x, q)')} AS correlation FROM li GROUP BY g, s")
def correlation(spark, d):
    return lines(spark, d).groupBy("g", "s").agg(r(A.correlation("x", "q")).alias("correlation"))


@query(f"WITH {ORDERS} SELECT {sr('covar_pop(x, c_acctbal / 1000)')} AS covariance2, {sr('corr(x, c_acctbal)')} AS correlation2, count(*) AS n FROM ord JOIN customer ON k = c_custkey")
def pair_join(spark, d):
    left = load(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("y"))
    right = orders(spark, d).join(left, F.col("k") == F.col("c_custkey"), "left_semi")
    both = A.pair(right, left.join(right, F.col("c_custkey") == F.col("k"), "left_semi").withColumnRenamed("c_custkey", "k"), "k", "x", "y")
    return both.agg(r(A.covariance("x", "y")).alias("covariance2"), r(A.correlation("x", "y")).alias("correlation2"), F.count("*").alias("n"))


@query(f"WITH {ORDERS} SELECT g, k, {sr('(x - avg(x) OVER (PARTITION BY g)) / stddev_samp(x) OVER (PARTITION BY g)')} AS z FROM ord")
def standardize(spark, d):
    return A.standardize(orders(spark, d), ["g"], "x").select("g", "k", r("z").alias("z"))


@query(f"WITH {CUSTOMERS} SELECT g, {sr('fsum(x)')} AS total, {sr('sum((x - 1) * (x - 1))')} AS squares FROM cu GROUP BY g")
def exact_sum(spark, d):
    own = customers(spark, d)
    squares = own.groupBy("g").agg(r(A.sum_squares_about(1.0, "x")).alias("squares"))
    return rounded(A.exact_sums(own, ["g"], "x"), "total").join(squares, "g")


@query(f"WITH {LINES} SELECT g, s, {sr('fsum(x)')} AS total FROM li GROUP BY g, s")
def exact_sum_lines(spark, d):
    """Exact sums of all line items' prices."""
    return rounded(A.exact_sums(lines(spark, d), ["g", "s"], "x"), "total")


@query(f"WITH {LINES} SELECT g, s, count(x)::DOUBLE AS p0, {sr('sum(x)', 4)} AS p1, {sr('sum(x*x)', 3)} AS p2 FROM li GROUP BY g, s")
def powers_state(spark, d):
    own = lines(spark, d).groupBy("g", "s").agg(*A.powers(2, "x"))
    return own.select("g", "s", "p0", r("p1", 4).alias("p1"), r("p2", 3).alias("p2"))


@query(f"""WITH {LINES}, c AS (SELECT g, s, x, x - {M} AS d FROM li)
SELECT g, s, count(*) AS n, {sr('avg(x)', 4)} AS mean, {sr('var_pop(x)', 4)} AS variance, {sr('var_samp(x)', 4)} AS variance_unbiased, {sr('stddev_pop(x)', 4)} AS std_dev,
{sr(SKEW, 4)} AS skewness, {sr('kurtosis_pop(x)', 4)} AS kurtosis FROM c GROUP BY g, s""")
def powers_moments(spark, d):
    own = A.Powers(4).moments(lines(spark, d).groupBy("g", "s").agg(*A.powers(4, "x")))
    names = ["mean", "variance", "variance_unbiased", "std_dev", "skewness", "kurtosis"]
    return own.select("g", "s", A.Powers(4).count.alias("n"), *[r(c, 4).alias(c) for c in names])


@query(f"WITH {LINES} SELECT g, s, count(*) AS n, {sr('avg(x)', 4)} AS mean, {sr('var_pop(x)', 4)} AS variance FROM li GROUP BY ROLLUP (g, s)")
def powers_rollup_merge(spark, d):
    fine = lines(spark, d).groupBy("g", "s", "line").agg(*A.powers(2, "x"))
    p = A.Powers(2)
    return fine.rollup("g", "s").agg(*A.merge_powers(2)).select("g", "s", p.count.alias("n"), r(p.mean, 4).alias("mean"), r(p.variance, 4).alias("variance"))


# Quantiles

PARAMS = {"quantile_r4": Q.CADPW, "quantile_r5": Q.HAZEN, "quantile_r6": Q.SPSS, "quantile_r7": Q.S, "quantile_r8": Q.MEDIAN_UNBIASED, "quantile_r9": Q.NORMAL_UNBIASED}


def quantile_sql(rel: str, by: str, x: str, k: int, q: int, p: Q.ContParam) -> str:
    """A SELECT of ``by`` and v by sorted lists."""
    h = f"({p.alpha!r} + {k / q!r} * (len(l) + 1 - {p.alpha!r} - {p.beta!r}))"
    item = lambda i: f"l[(least(greatest({i}, 0), len(l) - 1) + 1)::BIGINT]"
    whole = f"trunc({h})"
    value = f"(1 - ({h} - {whole})) * {item(whole + ' - 1')} + ({h} - {whole}) * {item(whole)}"
    return f"SELECT {by}, {value} AS v FROM (SELECT {by}, list_sort(list({x})) AS l FROM {rel} GROUP BY {by})"


def _quantile(name: str, param: Q.ContParam) -> None:
    def run(spark, d):
        return rounded(Q.quantile(lines(spark, d), ["g", "s"], "x", 1, 4, param), "quantile", digits=9)

    QUERIES[name] = run
    SQL[name] = f"WITH {LINES} SELECT g, s, {sr('v', 9)} AS quantile FROM ({quantile_sql('li', 'g, s', 'x', 1, 4, param)})"


for _name, _param in PARAMS.items():
    _quantile(_name, _param)


@query(f"WITH {ORDERS} SELECT g, {sr('quantile_cont(x, 0.1)', 9)} AS q10, {sr('quantile_cont(x, 0.5)', 9)} AS q50, {sr('quantile_cont(x, 0.9)', 9)} AS q90 FROM ord GROUP BY g")
def quantiles_multi(spark, d):
    own = Q.quantiles(orders(spark, d), ["g"], "x", [1, 5, 9], 10)
    return own.select("g", *[r(F.col("quantiles")[i], 9).alias(n) for i, n in enumerate(("q10", "q50", "q90"))])


@query(f"WITH {ORDERS} SELECT g, {sr('quantile_cont(x, 0.75)', 9)} AS quantile FROM ord GROUP BY g")
def weighted_avg_quantile(spark, d):
    return rounded(Q.weighted_avg(orders(spark, d), ["g"], "x", 3, 4), "quantile", digits=9)


@query(f"WITH {PARTS} SELECT g, {sr('median(x)', 9)} AS median FROM pa GROUP BY g")
def median_grp(spark, d):
    return rounded(Q.median(parts(spark, d), ["g"], "x"), "median", digits=9)


@query(f"WITH {PARTS} SELECT g, {sr('b.v - a.v', 9)} AS midspread FROM ({quantile_sql('pa', 'g', 'x', 1, 4, Q.MEDIAN_UNBIASED)}) a JOIN ({quantile_sql('pa', 'g', 'x', 3, 4, Q.MEDIAN_UNBIASED)}) b USING (g)")
def midspread_iqr(spark, d):
    return rounded(Q.midspread(parts(spark, d), ["g"], "x", 4, Q.MEDIAN_UNBIASED), "midspread", digits=9)


@query(f"WITH {PARTS} SELECT g, {sr('mad(x)', 9)} AS mad FROM pa GROUP BY g")
def mad_grp(spark, d):
    return rounded(Q.mad(parts(spark, d), ["g"], "x"), "mad", digits=9)


# Ranks


@query(f"WITH {PARTS} SELECT g, k, {ranks('pa', 'g', 'y')} AS rank FROM pa")
def rank_avg(spark, d):
    return R.with_ranks(parts(spark, d), ["g"], "y").select("g", "k", "rank")


#: Types of parts from small to special; the last three are as good as each other.
SIZES = ["SMALL", "MEDIUM", "LARGE", "STANDARD", "ECONOMY", "PROMO"]


def by_size(a: str, b: str) -> int:
    """A comparison of two types."""
    place = lambda t: min(SIZES.index(t), 3)
    return place(a) - place(b)


@query("""WITH k AS (SELECT p_partkey AS k, p_brand AS g, CASE p_type WHEN 'SMALL' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'LARGE' THEN 2 ELSE 3 END AS o FROM part)
SELECT k, rank() OVER (PARTITION BY g ORDER BY o) + (count(*) OVER (PARTITION BY g, o) - 1) / 2.0 AS rank FROM k""")
def rank_custom(spark, d):
    """Ranks of types within brands by a comparison of one's own, with ties where it finds two equal."""
    from quantalake.operators.ranks import ranks_by

    own = load(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("g"), "p_type")
    return ranks_by(own, ["g"], "p_type", by_size).select("k", "rank")


@query(f"WITH {ORDERS} SELECT g, k, x, nth FROM (SELECT g, k, x, row_number() OVER (PARTITION BY g ORDER BY x)::INTEGER AS nth FROM ord) WHERE nth <= 5")
def partial_sort_topk(spark, d):
    return R.top_k(orders(spark, d), ["g"], "x", 5).select("g", "k", "x", "nth")


@query(f"WITH {CUSTOMERS} SELECT g, min(x) AS lo, max(x) AS hi FROM cu GROUP BY g")
def minmax(spark, d):
    return customers(spark, d).groupBy("g").agg(R.min_max("x").alias("m")).select("g", F.col("m.min").alias("lo"), F.col("m.max").alias("hi"))


@query(f"WITH {ORDERS} SELECT g, k, row_number() OVER (PARTITION BY g ORDER BY k) - 1 AS idx FROM ord")
def indexed(spark, d):
    return R.indexed(orders(spark, d).select("g", "k"), ["g"], "k").select("g", "k", "idx")


@query(f"WITH {CUSTOMERS} SELECT g, {sr('sum(x) FILTER (WHERE a)')} AS inside, {sr('sum(x) FILTER (WHERE NOT a)')} AS outside FROM cu GROUP BY g")
def split_by_tags(spark, d):
    inside, outside = R.split_by_tag(F.col("a"), F.col("x"))
    return customers(spark, d).groupBy("g").agg(r(inside).alias("inside"), r(outside).alias("outside"))
