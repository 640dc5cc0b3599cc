"""What the query modules share: samples of the tables, rounding, and pieces of SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantalake.sources.tables import load


def r(x: Column | str, digits: int = 6) -> Column:
    """Rounded, so that sums in another order give the same; without a negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, digits) + F.lit(0.0)


def r_scaled(x: Column | str, digits: int = 6) -> Column:
    """Rounded as ``sr`` does it: scaled, to a whole number, and back. ``r`` rounds the shortest decimal instead, so that
    they differ where a value lies on a tie. Values have to be the same to the last bit."""
    scale = 10.0**digits
    return r((F.col(x) if isinstance(x, str) else x) * scale, 0) / scale


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: r(n, digits) for n in names})


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items: groups g and s, price x in thousands, quantity q, discount w."""
    return load(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("g"), F.col("l_linestatus").alias("s"), (F.col("l_extendedprice") / 1000).alias("x"), F.col("l_quantity").alias("q"), F.col("l_discount").alias("w"),
        F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"),
    )


def orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders: group g, price x in thousands, key k, month m."""
    return load(spark, d, "orders").select(F.col("o_orderpriority").alias("g"), (F.col("o_totalprice") / 1000).alias("x"), F.col("o_orderkey").alias("k"), F.date_trunc("month", "o_orderdate").cast("date").alias("m"))


def customers(spark: SparkSession, d: str) -> DataFrame:
    """Customers: group g (nation), balance x in thousands, key k, segment s, and whether it's BUILDING (a)."""
    return load(spark, d, "customer").select(F.col("c_nationkey").alias("g"), (F.col("c_acctbal") / 1000).alias("x"), F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("s"), (F.col("c_mktsegment") == "BUILDING").alias("a"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts: group g (brand), price x in hundreds, size y, key k."""
    return load(spark, d, "part").select(F.col("p_brand").alias("g"), (F.col("p_retailprice") / 100).alias("x"), F.col("p_size").cast("double").alias("y"), F.col("p_partkey").alias("k"))


#: The same in SQL, for a WITH clause.
LINES = "li AS (SELECT l_returnflag AS g, l_linestatus AS s, l_extendedprice / 1000 AS x, l_quantity AS q, l_discount AS w, l_orderkey AS orderkey, l_linenumber AS line FROM lineitem)"
ORDERS = "ord AS (SELECT o_orderpriority AS g, o_totalprice / 1000 AS x, o_orderkey AS k, date_trunc('month', o_orderdate)::DATE AS m FROM orders)"
CUSTOMERS = "cu AS (SELECT c_nationkey AS g, c_acctbal / 1000 AS x, c_custkey AS k, c_mktsegment AS s, c_mktsegment = 'BUILDING' AS a FROM customer)"
PARTS = "pa AS (SELECT p_brand AS g, p_retailprice / 100 AS x, p_size::DOUBLE AS y, p_partkey AS k FROM part)"


def sr(x: str, digits: int = 6) -> str:
    return f"(round(({x})::DOUBLE, {digits}) + 0.0)"


def gamma_p(a: str, x: str, terms: int = 400) -> str:
    """The regularised lower incomplete gamma function by its series."""
    return f"(CASE WHEN {x} <= 0 THEN 0.0 ELSE list_sum([exp(({a} + i_) * ln({x}) - ({x}) - lgamma({a} + i_ + 1)) FOR i_ IN range(0, {terms})]) END)"


def beta_i(a: str, b: str, x: str, terms: int = 600) -> str:
    """The regularised incomplete beta function by its series."""
    return (
        f"(CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} >= 1 THEN 1.0 ELSE list_sum([exp(({a} + i_) * ln({x}) + ({b}) * ln(1 - ({x})) + lgamma({a} + {b} + i_)"
        f" - lgamma({a} + i_ + 1) - lgamma({b})) FOR i_ IN range(0, {terms})]) END)"
    )


def phi(z: str) -> str:
    """The standard normal distribution function."""
    return f"(0.5 + 0.5 * sign({z}) * {gamma_p('0.5', f'(({z}) * ({z}) / 2)')})"


def digamma(x: str) -> str:
    """By a central difference of lgamma."""
    return f"((lgamma(({x}) + 1e-4) - lgamma(({x}) - 1e-4)) / 2e-4)"


def ranks(rel: str, by: str, x: str) -> str:
    """The average rank of x within ``by``, as an expression over a relation."""
    part = f"PARTITION BY {by} " if by else ""
    return f"(rank() OVER ({part}ORDER BY {x}) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}{x}) - 1) / 2.0)"


#: Counts by recursion, for a WITH RECURSIVE clause. ``cum_u``: how many arrangements of m and n have at most u (below),
#: of all (ways). ``cum_t``: the share of the sets of ranks 1..n whose sum is at most t. The first elements are added or
#: not, one after the other.
SUBSETS = """subsets(k, size, total, ways) AS (SELECT 0, 0, 0, 1::HUGEINT UNION ALL
SELECT k + 1, size + t, total + t * (k + 1), sum(ways)::HUGEINT FROM subsets, (VALUES (0), (1)) c(t) WHERE k < 40 AND size + t <= 20 GROUP BY ALL),
cum_u AS (SELECT size AS m, k - size AS n, total - size * (size + 1) // 2 AS u, sum(ways) OVER (PARTITION BY k, size ORDER BY total) AS below, sum(ways) OVER (PARTITION BY k, size) AS ways
FROM subsets WHERE size >= 1 AND k - size BETWEEN 1 AND 20)"""
SIGNS = """signs(k, total, ways) AS (SELECT 0, 0, 1::HUGEINT UNION ALL
SELECT k + 1, total + t * (k + 1), sum(ways)::HUGEINT FROM signs, (VALUES (0), (1)) c(t) WHERE k < 99 GROUP BY ALL),
cum_t AS (SELECT k AS n, total AS t, sum(ways) OVER (PARTITION BY k ORDER BY total) / pow(2::DOUBLE, k) AS p FROM signs WHERE k > 0)"""


def ks_sql(rel: str, key: str) -> str:
    """CTEs for ks_p (key, p): P(D < d) of a relation with key, n and d, by a row vector times a matrix, n times."""
    return f"""sized AS (SELECT {key}, n, d, floor(n * d)::INTEGER + 1 AS k, floor(n * d) + 1 - n * d AS h FROM {rel}),
mat AS (SELECT {key}, n, k, [[CASE WHEN i - j + 1 < 0 THEN 0.0::DOUBLE ELSE
(1.0::DOUBLE - CASE WHEN j = 1 THEN pow(h, i) ELSE 0.0 END - CASE WHEN i = 2 * k - 1 THEN pow(h, 2 * k - j) ELSE 0.0 END + CASE WHEN i = 2 * k - 1 AND j = 1 AND h > 0.5 THEN pow(2 * h - 1, i) ELSE 0.0 END)
/ gamma((i - j + 2)::DOUBLE) END FOR i IN range(1, 2 * k)] FOR j IN range(1, 2 * k)] AS cols FROM sized),
steps({key}, i, v) AS (SELECT {key}, 0, [CASE WHEN j = k THEN 1.0::DOUBLE ELSE 0.0 END FOR j IN range(1, 2 * k)] FROM mat UNION ALL
SELECT s.{key}, s.i + 1, [list_dot_product(s.v, c) * ((s.i + 1) / m.n::DOUBLE) FOR c IN m.cols] FROM steps s JOIN mat m ON m.{key} = s.{key} WHERE s.i < m.n),
ks_p AS (SELECT s.{key}, s.v[m.k] AS p FROM steps s JOIN mat m ON m.{key} = s.{key} WHERE s.i = m.n)"""
