"""Queries of correlation, confidence intervals and hypothesis tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantalake.functions.distributions import Normal
from quantalake.operators import correlation as C
from quantalake.operators import hypothesis as T
from quantalake.operators import inference as I  # noqa: E741
from quantalake.plans.common import CUSTOMERS, LINES, ORDERS, PARTS, SIGNS, SUBSETS, beta_i, customers, gamma_p, ks_sql, lines, orders, parts, phi, r, ranks, rounded, sr
from quantalake.plans.summaries import quantile_sql
from quantalake.operators.quantiles import MEDIAN_UNBIASED
from quantalake.sources.tables import load

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {LINES} SELECT g, s, {sr('corr(x, q)')} AS r FROM li GROUP BY g, s")
def pearson(spark, d):
    return rounded(C.pearson(lines(spark, d), ["g", "s"], "x", "q"), "r")


@query(f"WITH {PARTS}, k AS (SELECT g, {ranks('pa', 'g', 'x')} AS a, {ranks('pa', 'g', 'y')} AS b FROM pa) SELECT g, {sr('corr(a, b)')} AS r FROM k GROUP BY g")
def spearman(spark, d):
    return rounded(C.spearman(parts(spark, d), ["g"], "x", "y"), "r")


def _embeddings(spark, d):
    """The label's mean vectors, as a matrix: a row a label."""
    own = load(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("j", "v"))
    return own.groupBy("label", "j").agg(F.avg(F.col("v").cast("double")).alias("v")).select(F.col("label").alias("i"), "j", "v")


EMBEDDINGS = """m AS (SELECT label AS i, j, avg(v) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(0, len(embedding)))::INTEGER AS j FROM embeddings) GROUP BY ALL)"""


@query(f"WITH {EMBEDDINGS} SELECT a.i AS i, b.i AS j, {sr('corr(a.v, b.v)')} AS v FROM m a JOIN m b ON a.j = b.j GROUP BY a.i, b.i")
def pearson_matrix(spark, d):
    return rounded(C.pearson_matrix(_embeddings(spark, d)), "v")


@query(f"WITH {EMBEDDINGS}, k AS (SELECT i, j, {ranks('m', 'i', 'v')} AS v FROM m) SELECT a.i AS i, b.i AS j, {sr('corr(a.v, b.v)')} AS v FROM k a JOIN k b ON a.j = b.j GROUP BY a.i, b.i")
def spearman_matrix(spark, d):
    return rounded(C.spearman_matrix(_embeddings(spark, d)), "v")


@query(f"""WITH {PARTS}, p AS (SELECT a.g AS g, sum(sign((a.x - b.x) * (a.y - b.y))) AS s, count(*) AS n,
count(*) FILTER (WHERE a.x <> b.x) AS nx, count(*) FILTER (WHERE a.y <> b.y) AS ny FROM pa a JOIN pa b ON a.g = b.g AND a.k < b.k GROUP BY a.g)
SELECT g, {sr('s / (sqrt(nx) * sqrt(ny))')} AS tau FROM p""")
def kendall(spark, d):
    return rounded(C.kendall(parts(spark, d), ["g"], "x", "y"), "tau")


def _series(spark, d):
    """Mean order prices by month, for each priority, in the order of months."""
    own = orders(spark, d).groupBy("g", "m").agg(F.avg("x").alias("x"))
    from quantalake.operators.ranks import indexed

    return indexed(own, ["g"], "m")


SERIES = f"{ORDERS}, se AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY m) - 1 AS i, x - avg(x) OVER (PARTITION BY g) AS e, count(*) OVER (PARTITION BY g) AS n FROM (SELECT g, m, avg(x) AS x FROM ord GROUP BY g, m))"
COV = "SELECT a.g AS g, b.i - a.i AS lag, sum(a.e * b.e) / max(a.n) AS c, max(a.n) AS n FROM se a JOIN se b ON a.g = b.g AND b.i BETWEEN a.i AND a.i + a.n - 2 GROUP BY a.g, b.i - a.i"


@query(f"WITH {SERIES} SELECT g, lag, {sr('c')} AS c FROM ({COV})")
def autocovariance(spark, d):
    return rounded(C.autocovariance(_series(spark, d), ["g"], "idx", "x"), "c")


@query(f"""WITH {SERIES}, c AS ({COV}), r AS (SELECT g, lag, n, c / first_value(c) OVER (PARTITION BY g ORDER BY lag) AS r FROM c),
w AS (SELECT *, 1.96 * sqrt((1 + 2 * sum(r * r) OVER (PARTITION BY g ORDER BY lag)) / n) AS e FROM r)
SELECT g, lag, {sr('r')} AS r, {sr('CASE WHEN lag = 0 THEN 1 ELSE -1 / n - e END')} AS lo, {sr('CASE WHEN lag = 0 THEN 1 ELSE -1 / n + e END')} AS hi FROM w""")
def autocorrelation(spark, d):
    return rounded(C.autocorrelation(_series(spark, d), ["g"], "idx", "x"), "r", "lo", "hi")


#: The series of all orders' prices, by key.
PRICES = f"{ORDERS}, ps AS (SELECT row_number() OVER (ORDER BY k) - 1 AS i, x - avg(x) OVER () AS e, count(*) OVER () AS n FROM ord)"


def prices(spark, d):
    from quantalake.operators.ranks import indexed

    return indexed(orders(spark, d).select("k", "x"), [], "k").select("idx", "x")


@query(f"WITH {PRICES} SELECT b.i - a.i AS lag, {sr('sum(a.e * b.e) / max(a.n)', 2)} AS c FROM ps a JOIN ps b ON b.i BETWEEN a.i AND a.i + a.n - 2 GROUP BY b.i - a.i")
def autocovariance_long(spark, d):
    """All lags of one long series, by blocks."""
    return rounded(C.autocovariance(prices(spark, d), [], "idx", "x"), "c", digits=2)


# Confidence intervals: the ends are compared by the probabilities that they leave outside.


@query(f"""WITH {ORDERS}, z AS (SELECT k, abs(x - avg(x) OVER w) / stddev_samp(x) OVER w AS z FROM ord WINDOW w AS (PARTITION BY g))
SELECT k, {sr('z')} AS z, {sr(f'2 * (1 - {phi("z")})', 5)} AS two, {sr(f'1 - {phi("z")}', 5)} AS one, {sr('z', 5)} AS back, {sr('z', 5)} AS back_one FROM z""")
def n_sigma(spark, d):
    """How many deviations an order's price is from its priority's mean, as probabilities and back."""
    own = orders(spark, d)
    stats = own.groupBy("g").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    own = own.join(stats, "g").select("k", (F.abs(F.col("x") - F.col("mean")) / F.col("sd")).alias("z"))
    p = Normal().sf("z")
    own = own.select("k", "z", (2 * p).alias("two"), p.alias("one"))
    return own.select("k", r("z").alias("z"), r("two", 5).alias("two"), r("one", 5).alias("one"), r(I.get_n_sigma("two"), 5).alias("back"), r(I.get_n_sigma_1("one"), 5).alias("back_one"))


LABELS = "la AS (SELECT lang AS g, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS k FROM labels JOIN documents USING (doc_id) GROUP BY lang)"


def _labels(spark, d):
    own = load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return own.groupBy(F.col("lang").alias("g")).agg(F.count("*").alias("n"), F.count(F.when(F.col("toxic") == 1, 1)).alias("k"))


@query(f"WITH {LABELS} SELECT g, k, k::DOUBLE AS point, {sr('CASE WHEN k = 0 THEN 0 ELSE 0.025 END')} AS low_tail, 0.025::DOUBLE AS high_tail, k <= 0 AS zero FROM la")
def poisson_ci(spark, d):
    from quantalake.functions.distributions import Columns
    own = _labels(spark, d).withColumn("e", I.poisson_ci(I.CL95, "k"))
    own = own.withColumn("i", I.interval(F.col("e"))).select("g", "k", "e", F.col("i.lo").alias("lo"), F.col("i.hi").alias("hi"))
    low = F.when(F.col("k") == 0, F.lit(0.0)).otherwise(Columns.gamma_p(F.greatest(F.col("k"), F.lit(1)), F.col("lo")))
    return own.select("g", "k", F.col("e.point").alias("point"), r(low).alias("low_tail"), r(Columns.gamma_q(F.col("k") + 1, F.col("hi"))).alias("high_tail"), (F.col("lo") <= 0).alias("zero"))


@query(f"WITH {LABELS} SELECT g, k::DOUBLE AS point, {sr('sqrt(k)')} AS sigma FROM la")
def poisson_normal_ci(spark, d):
    own = _labels(spark, d).withColumn("e", I.poisson_normal_ci("k"))
    return own.select("g", F.col("e.point").alias("point"), r("e.sigma").alias("sigma"))


@query(f"WITH {LABELS} SELECT g, {sr('k / n')} AS point, {sr('sqrt(k / n * (1 - k / n) / n)')} AS sigma FROM la")
def naive_binomial_ci(spark, d):
    own = _labels(spark, d).withColumn("e", I.naive_binomial_ci("n", "k"))
    return own.select("g", r("e.point").alias("point"), r("e.sigma").alias("sigma"))


@query(f"WITH {LABELS} SELECT g, k, n, {sr('k / n')} AS point, {sr('CASE WHEN k = 0 THEN 0 ELSE 0.05 END')} AS low_tail, {sr('CASE WHEN k = n THEN 0 ELSE 0.05 END')} AS high_tail FROM la")
def binomial_ci(spark, d):
    from quantalake.functions.distributions import Columns
    own = _labels(spark, d).withColumn("e", I.binomial_ci(I.CL90, "n", "k"))
    own = own.withColumn("i", I.interval(F.col("e")))
    one = F.lit(1.0)
    low = F.when(F.col("k") == 0, 0.0).otherwise(Columns.beta_i(F.greatest(F.col("k"), one), F.greatest(F.col("n") - F.col("k") + 1, one), F.col("i.lo")))
    high = F.when(F.col("k") == F.col("n"), 0.0).otherwise(1 - Columns.beta_i(F.greatest(F.col("k") + 1, one), F.greatest(F.col("n") - F.col("k"), one), F.col("i.hi")))
    return own.select("g", "k", "n", r("e.point").alias("point"), r(low).alias("low_tail"), r(high).alias("high_tail"))


@query(f"WITH {CUSTOMERS}, e AS (SELECT g, avg(x) AS m, 0.5 AS dn, 2.0 AS up FROM cu GROUP BY g) SELECT g, {sr('-2 * m')} AS point, {sr('2 * up')} AS ldx, {sr('2 * dn')} AS udx, {sr('-2 * m - 2 * up')} AS lo, {sr('-2 * m + 2 * dn')} AS hi FROM e")
def estimate_scale(spark, d):
    own = customers(spark, d).groupBy("g").agg(F.avg("x").alias("m"))
    own = own.withColumn("e", I.scale(-2, I.from_interval(F.col("m"), F.col("m") - 0.5, F.col("m") + 2, I.CL95))).withColumn("i", I.interval(F.col("e")))
    return own.select("g", r("e.point").alias("point"), r("e.ldx").alias("ldx"), r("e.udx").alias("udx"), r("i.lo").alias("lo"), r("i.hi").alias("hi"))


# Tests

TWO = f"WITH {CUSTOMERS}, t AS (SELECT g, count(x) FILTER (WHERE a) AS n1, count(x) FILTER (WHERE NOT a) AS n2, avg(x) FILTER (WHERE a) AS m1, avg(x) FILTER (WHERE NOT a) AS m2, var_samp(x) FILTER (WHERE a) AS v1, var_samp(x) FILTER (WHERE NOT a) AS v2 FROM cu GROUP BY g)"


def t_two(t: str, df: str) -> str:
    return "(1 - " + beta_i("0.5", f"({df} / 2)", f"({t} * {t} / ({df} + {t} * {t}))", 4000) + ")"


@query(f"""{TWO}, s AS (SELECT g, n1 + n2 - 2.0 AS df, CASE WHEN n1 > 1 AND n2 > 1 THEN (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) END AS t FROM t)
SELECT g, {sr('t')} AS stat, CASE WHEN t IS NOT NULL THEN df::DOUBLE END AS df, {sr(t_two('t', 'df'))} AS p FROM s""")
def ttest_student(spark, d):
    return rounded(T.student_t_test(customers(spark, d), ["g"], F.col("a"), "x"), "stat", "p")


WELCH = f"""{TWO}, s AS (SELECT g, CASE WHEN n1 > 1 AND n2 > 1 THEN (m1 - m2) / sqrt(v1 / n1 + v2 / n2) END AS t,
CASE WHEN n1 > 1 AND n2 > 1 THEN pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) END AS df FROM t)"""


@query(f"{WELCH} SELECT g, {sr('t')} AS stat, {sr('df')} AS df, {sr('CASE WHEN t >= 0 THEN 0.5 * ' + t_two('t', 'df') + ' ELSE 1 - 0.5 * ' + t_two('t', 'df') + ' END')} AS p FROM s")
def ttest_welch(spark, d):
    return rounded(T.welch_t_test(customers(spark, d), ["g"], F.col("a"), "x", T.A_GREATER), "stat", "df", "p")


PAIRS = "pr AS (SELECT l_suppkey AS g, l_orderkey AS k, l_quantity AS a, l_discount * 500 AS b FROM lineitem)"


def _pairs(spark, d):
    return load(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_quantity").alias("a"), (F.col("l_discount") * 500).alias("b"))


@query(f"""WITH {PAIRS}, s AS (SELECT g, count(*) AS n, sum(a - b) AS s, sum((a - b) * (a - b)) AS q FROM pr GROUP BY g), t AS (SELECT g, CASE WHEN n > 1 THEN n - 1.0 END AS df, CASE WHEN n > 1 THEN s / sqrt((n * q - s * s) / (n - 1)) END AS t FROM s)
SELECT g, {sr('t', 5)} AS stat, df::DOUBLE AS df, {sr(t_two('t', 'df'), 5)} AS p FROM t""")
def ttest_paired(spark, d):
    return rounded(T.paired_t_test(_pairs(spark, d), ["g"], "a", "b"), "stat", "p", digits=5)


RANKSUM = f"WITH {CUSTOMERS}, k AS (SELECT g, a, {ranks('cu', 'g', 'x')} AS r FROM cu), w AS (SELECT g, count(*) FILTER (WHERE a) AS n1, count(*) FILTER (WHERE NOT a) AS n2, coalesce(sum(r) FILTER (WHERE a), 0) AS w1, coalesce(sum(r) FILTER (WHERE NOT a), 0) AS w2 FROM k GROUP BY g), u AS (SELECT *, w1 - n1 * (n1 + 1) / 2 AS u1, w2 - n2 * (n2 + 1) / 2 AS u2 FROM w)"


@query(f"{RANKSUM} SELECT g, n1, n2, w1, w2 FROM w")
def wilcoxon_rank_sums(spark, d):
    return T.rank_sums(customers(spark, d), ["g"], F.col("a"), "x")


@query(f"{RANKSUM} SELECT g, n1, n2, u1, u2 FROM u")
def mannwhitney_u(spark, d):
    return T.mann_whitney_u(customers(spark, d), ["g"], F.col("a"), "x")


#: Each BUILDING customer stands in four groups, against one other segment of its nation each.
RIVALS = """cp AS (SELECT c_nationkey AS g, s, c_mktsegment = 'BUILDING' AS a, c_acctbal / 1000 AS x FROM customer, (SELECT DISTINCT c_mktsegment AS s FROM customer WHERE c_mktsegment <> 'BUILDING') WHERE c_mktsegment IN ('BUILDING', s))"""
RIVAL_SUMS = f"WITH RECURSIVE {RIVALS}, k AS (SELECT g, s, a, {ranks('cp', 'g, s', 'x')} AS r FROM cp), w AS (SELECT g, s, count(*) FILTER (WHERE a) AS n1, count(*) FILTER (WHERE NOT a) AS n2, coalesce(sum(r) FILTER (WHERE a), 0) AS w1, coalesce(sum(r) FILTER (WHERE NOT a), 0) AS w2 FROM k GROUP BY g, s), u AS (SELECT *, w1 - n1 * (n1 + 1) / 2 AS u1, w2 - n2 * (n2 + 1) / 2 AS u2 FROM w)"


def _rivals(spark, d):
    own = customers(spark, d)
    others = [r.s for r in own.select("s").distinct().collect() if r.s != "BUILDING"]  # a row a segment
    each = F.when(F.col("a"), F.array(*map(F.lit, sorted(others)))).otherwise(F.array("s"))
    return own.select("g", F.explode(each).alias("s"), "a", "x")


@query(f"""{RIVAL_SUMS}, {SUBSETS}, lim AS (SELECT m, n, max(u) FILTER (WHERE below < 0.2::DOUBLE * ways) AS crit FROM cum_u GROUP BY m, n)
SELECT g, s, n1, n2, u1, u2, CASE WHEN n1 > 20 OR n2 > 20 THEN 2 * (1 - {phi('abs(n1 * n2 / 2 - u1) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12)')}) < 0.2 ELSE least(u1, u2) <= crit END AS significant
FROM u LEFT JOIN lim ON m = n1 AND n = n2""")
def mannwhitney_test(spark, d):
    """Pairs of segments of a nation: exact for small ones, by the normal approximation for others."""
    return T.mann_whitney_test(_rivals(spark, d), ["g", "s"], F.col("a"), "x", 0.2)


@query(f"""{RIVAL_SUMS}, {SUBSETS}, lim AS (SELECT m, n, max(u) FILTER (WHERE below < 0.025::DOUBLE * ways) AS crit FROM cum_u GROUP BY m, n)
SELECT g, s, n1, n2, crit::BIGINT AS crit FROM w LEFT JOIN lim ON m = n1 AND n = n2 WHERE n1 <= 20 AND n2 <= 20""")
def mannwhitney_crit(spark, d):
    """The critical values for the sizes of segments; those of published tables are in the tests."""
    own = _rivals(spark, d).groupBy("g", "s").agg(F.count_if("a").alias("n1"), F.count_if(~F.col("a")).alias("n2")).where("n1 <= 20 and n2 <= 20")
    return own.withColumn("crit", T.mann_whitney_critical_value("n1", "n2", 0.025))


SIGNED = f"WITH {PAIRS}, dd AS (SELECT g, round(a - b, 6) AS d FROM pr WHERE round(a - b, 6) <> 0), k AS (SELECT g, d, {ranks('dd', 'g', 'abs(d)')} AS r FROM dd), t AS (SELECT g, count(*) AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS t_plus, (0 - coalesce(sum(r) FILTER (WHERE d < 0), 0)) + 0.0 AS t_minus FROM k GROUP BY g)"


def _differences(spark, d):
    return _pairs(spark, d).select("g", F.round(F.col("a") - F.col("b"), 6).alias("a"), F.lit(0.0).alias("b"))


@query(f"{SIGNED} SELECT g, n, t_plus::DOUBLE AS t_plus, t_minus::DOUBLE AS t_minus FROM t")
def wilcoxon_signed_rank(spark, d):
    return T.signed_ranks(_differences(spark, d), ["g"], "a", "b")


#: Half of the suppliers by year, half as a whole, so that there are few and many pairs.
SPANS = "pr AS (SELECT l_suppkey AS g, CASE WHEN l_suppkey % 2 = 0 THEN year(l_shipdate) ELSE 0 END AS y, round(l_quantity - l_discount * 500, 6) AS d FROM lineitem)"
SPAN_SUMS = f"""WITH RECURSIVE {SPANS}, dd AS (SELECT * FROM pr WHERE d <> 0), k AS (SELECT g, y, d, {ranks('dd', 'g, y', 'abs(d)')} AS r FROM dd),
t AS (SELECT g, y, count(*) AS n, coalesce(sum(r) FILTER (WHERE d > 0), 0) AS t_plus, (0 - coalesce(sum(r) FILTER (WHERE d < 0), 0)) + 0.0 AS t_minus FROM k GROUP BY g, y), {SIGNS}"""


def _spans(spark, d):
    year = F.when(F.col("l_suppkey") % 2 == 0, F.year("l_shipdate")).otherwise(0).cast("long")
    return load(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), year.alias("y"), F.round(F.col("l_quantity") - F.col("l_discount") * 500, 6).alias("a"), F.lit(0.0).alias("b"))


@query(f"""{SPAN_SUMS}, lim AS (SELECT n, max(t) FILTER (WHERE p <= 0.025::DOUBLE) AS crit FROM cum_t GROUP BY n),
every AS (SELECT DISTINCT pr.g, pr.y, coalesce(n, 0) AS n, coalesce(t_plus, 0) AS t_plus, coalesce(t_minus, 0) AS t_minus, least(t_plus, -t_minus) AS low FROM pr LEFT JOIN t ON pr.g = t.g AND pr.y = t.y)
SELECT g, y, e.n, t_plus::DOUBLE AS t_plus, t_minus::DOUBLE AS t_minus,
{sr('least(1, 2 * CASE WHEN e.n < 100 THEN c.p ELSE ' + phi('((low - e.n * (e.n + 1) / 4) / sqrt(e.n * (e.n + 1) * (2 * e.n + 1) / 24))') + ' END)')} AS p,
CASE WHEN e.n < 100 THEN low <= crit ELSE low <= round(e.n * (e.n + 1) / 4 - 1.959963984540054::DOUBLE * sqrt(e.n * (e.n + 1) * (2 * e.n + 1) / 24)) END AS significant
FROM every e LEFT JOIN cum_t c ON c.n = e.n AND c.t = floor(low) LEFT JOIN lim ON lim.n = e.n""")
def wilcoxon_test(spark, d):
    """Exact for few pairs, by the normal approximation for many; null where no pair differs."""
    return rounded(T.wilcoxon_signed_rank_test(_spans(spark, d), ["g", "y"], "a", "b", p=0.05), "p")


@query(f"""{SPAN_SUMS}, lim AS (SELECT n, max(t) FILTER (WHERE p <= 0.05::DOUBLE) AS crit FROM cum_t GROUP BY n)
SELECT g, y, t.n, CASE WHEN t.n < 100 THEN crit ELSE round(t.n * (t.n + 1) / 4 - 1.6448536269514722::DOUBLE * sqrt(t.n * (t.n + 1) * (2 * t.n + 1) / 24)) END::BIGINT AS crit FROM t LEFT JOIN lim ON lim.n = t.n""")
def wilcoxon_crit(spark, d):
    """The critical values for the numbers of pairs that differ; those of published tables are in the tests."""
    own = _spans(spark, d).where("a <> b").groupBy("g", "y").agg(F.count("*").alias("n"))
    return own.withColumn("crit", T.signed_rank_critical_value("n", 0.05))



@query(f"WITH {CUSTOMERS}, k AS (SELECT g, s, {ranks('cu', 'g', 'x')} AS r FROM cu) SELECT g, s, r::DOUBLE AS rank, count(*) AS n FROM k GROUP BY g, s, r")
def kruskal_rank(spark, d):
    return T.kruskal_rank(customers(spark, d), ["g"], "s", "x")


@query(f"""WITH {CUSTOMERS}, k AS (SELECT g, s, {ranks('cu', 'g', 'x')} AS r FROM cu), e AS (SELECT g, s, count(*) AS n, avg(r) AS m, sum(r * r) AS q FROM k GROUP BY g, s),
t AS (SELECT g, sum(n) AS nn, count(*) AS k, min(n) AS least, sum(n * m * m) AS b, sum(q) AS q FROM e GROUP BY g),
h AS (SELECT *, (nn - 1) * (b - nn * pow((nn + 1) / 2, 2)) / (q - nn * pow((nn + 1) / 2, 2)) AS h FROM t)
SELECT g, {sr('h')} AS stat, k, k - 1 AS df, CASE WHEN least > 4 THEN {sr('1 - ' + gamma_p('((k - 1) / 2)', '(h / 2)'))} END AS p FROM h""")
def kruskal_wallis(spark, d):
    return rounded(T.kruskal_wallis(customers(spark, d), ["g"], "s", "x"), "stat", "p")


LEVENE = """z AS (SELECT g, s, abs(x - c) AS z FROM base JOIN ce USING (g, s)), e AS (SELECT g, s, count(*) AS n, avg(z) AS m, var_pop(z) * count(*) AS w FROM z GROUP BY g, s),
t AS (SELECT g, count(*) AS k, sum(n) AS n, sum(w) AS w, sum(n * m * m) - pow(sum(n * m), 2) / sum(n) AS b, sum(n * m * m) AS q FROM e GROUP BY g),
f AS (SELECT g, k - 1 AS df1, (n - k)::BIGINT AS df2, CASE WHEN k > 1 AND n > k AND w > 1e-24 * q THEN (n - k) * b / ((k - 1) * w) END AS stat FROM t)"""
LEVENE_OUT = f"SELECT g, {sr('stat')} AS stat, df1, df2, {sr('1 - ' + beta_i('(df1 / 2)', '(df2 / 2)', '(df1 * stat / (df1 * stat + df2))', 3000))} AS p FROM f"


@query(f"WITH {CUSTOMERS}, base AS (SELECT g, s, x FROM cu), ce AS (SELECT g, s, avg(x) AS c FROM cu GROUP BY g, s), {LEVENE} {LEVENE_OUT}")
def levene_mean(spark, d):
    return rounded(T.levene_test(customers(spark, d), ["g"], "s", "x", "mean"), "stat", "p")


@query(f"WITH {CUSTOMERS}, base AS (SELECT g, s, x FROM cu), ce AS (SELECT g, s, v AS c FROM ({quantile_sql('cu', 'g, s', 'x', 1, 2, MEDIAN_UNBIASED)})), {LEVENE} {LEVENE_OUT}")
def levene_median(spark, d):
    return rounded(T.levene_test(customers(spark, d), ["g"], "s", "x", "median"), "stat", "p")


@query(f"""WITH {CUSTOMERS}, o AS (SELECT g, s, x, row_number() OVER (PARTITION BY g, s ORDER BY x) AS i, count(*) OVER (PARTITION BY g, s) AS n FROM cu),
base AS (SELECT g, s, x FROM o WHERE i > ceil(0.1 * n) AND i <= n - ceil(0.1 * n)), ce AS (SELECT g, s, avg(x) AS c FROM base GROUP BY g, s), {LEVENE} {LEVENE_OUT}""")
def levene_trimmed(spark, d):
    return rounded(T.levene_test(customers(spark, d), ["g"], "s", "x", "trimmed", 0.1), "stat", "p")


@query(f"""WITH {CUSTOMERS}, e AS (SELECT g, s, count(*) AS n, var_samp(x) AS v FROM cu GROUP BY g, s), t AS (SELECT g, count(*) AS k, sum(n) AS n, sum((n - 1) * v) AS pv, sum((n - 1) * CASE WHEN v > 0 THEN ln(v) END) AS l, sum(1 / (n - 1)) AS i, min(n) > 1 AND min(v) > 0 AND count(*) > 1 AS ok FROM e GROUP BY g),
b AS (SELECT g, k - 1 AS df, CASE WHEN ok THEN greatest(0, ((n - k) * ln(pv / (n - k)) - l) / (1 + (i - 1 / (n - k)) / (3 * (k - 1)))) END AS stat FROM t)
SELECT g, {sr('stat')} AS stat, df, {sr('1 - ' + gamma_p('(df / 2)', '(stat / 2)'))} AS p FROM b""")
def bartlett(spark, d):
    return rounded(T.bartlett_test(customers(spark, d), ["g"], "s", "x"), "stat", "p")


KS = f"WITH {CUSTOMERS}, o AS (SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY x) AS i, count(*) OVER (PARTITION BY g) AS n FROM cu), e AS (SELECT g, x, min(i) - 1 AS lo, max(i) AS hi, max(n) AS n FROM o GROUP BY g, x)"


@query(f"""{KS.replace("WITH ", "WITH RECURSIVE ", 1)}, f AS (SELECT *, CASE WHEN x < -1 THEN 0.0 WHEN x > 10 THEN 1.0 ELSE (x + 1) / 11 END AS f FROM e),
dd AS (SELECT g, max(n) AS n, max(greatest(abs(f - lo / n), abs(f - hi / n)))::DOUBLE AS d FROM f GROUP BY g), {ks_sql('dd', 'g')}
SELECT g, n, {sr('d')} AS d, {sr('1 - p')} AS p FROM dd JOIN ks_p USING (g)""")
def ks_one(spark, d):
    from quantalake.functions.distributions import Uniform

    return rounded(T.ks_test(customers(spark, d), ["g"], "x", Uniform(-1, 10).cdf), "d", "p")


@query(f"""WITH RECURSIVE {PARTS}, sizes AS (SELECT g, count(*) AS n, 0.4::DOUBLE / sqrt(count(*)) + avg(y) / 1000 AS d FROM pa GROUP BY g), {ks_sql('sizes', 'g')}
SELECT g, n, {sr('d')} AS d, {sr('p')} AS p FROM sizes JOIN ks_p USING (g)""")
def ks_prob(spark, d):
    """P(D < d) for the number of parts of each brand; published values are in the tests."""
    own = parts(spark, d).groupBy("g").agg(F.count("*").alias("n"), (0.4 / F.sqrt(F.count("*")) + F.avg("y") / 1000).alias("d"))
    return own.select("g", "n", r("d").alias("d"), r(T.ks_probability_of("n", "d")).alias("p"))



def _choose(n: str, k: str) -> str:
    """Combinations, 0 outside 0..n."""
    return f"(CASE WHEN {k} < 0 OR {k} > {n} THEN 0.0 ELSE exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1)) END)"


def _both(k: str, m: str) -> str:
    return f"{_choose('(n_true - 1.0::DOUBLE)', k)} * {_choose('(n_false - 1.0::DOUBLE)', m)}"


#: The ways to have r runs, with h = r // 2.
WAYS = f"CASE WHEN n_true = 0 OR n_false = 0 THEN 0.0 WHEN r % 2 = 0 THEN 2 * {_both('(h - 1)', '(h - 1)')} ELSE {_both('h', '(h - 1)')} + {_both('(h - 1)', 'h')} END"


@query(f"""WITH {CUSTOMERS}, c AS (SELECT g, x, count(*) FILTER (WHERE a) AS na, count(*) FILTER (WHERE NOT a) AS nb FROM cu GROUP BY g, x),
s AS (SELECT g, sum(na) OVER w / sum(na) OVER (PARTITION BY g) - sum(nb) OVER w / sum(nb) OVER (PARTITION BY g) AS d, sum(na) OVER (PARTITION BY g) AS n1, sum(nb) OVER (PARTITION BY g) AS n2 FROM c WINDOW w AS (PARTITION BY g ORDER BY x)),
m AS (SELECT g, max(n1)::BIGINT AS n1, max(n2)::BIGINT AS n2, max(abs(d)) AS d, sqrt(max(n1) * max(n2) / (max(n1) + max(n2))) AS en FROM s GROUP BY g), z AS (SELECT *, CASE WHEN n1 > 0 AND n2 > 0 THEN d * (en + 0.12 + 0.11 / en) END AS z FROM m)
SELECT g, n1, n2, {sr('z')} AS stat, {sr('CASE WHEN z < 1.18 THEN 1 - sqrt(2 * pi()) / z * (exp(-pi() * pi() / (8 * z * z)) + exp(-9 * pi() * pi() / (8 * z * z)) + exp(-25 * pi() * pi() / (8 * z * z)) + exp(-49 * pi() * pi() / (8 * z * z))) ELSE 2 * (exp(-2*z*z) - exp(-8*z*z) + exp(-18*z*z)) END')} AS p FROM z""")
def ks_two(spark, d):
    return rounded(T.ks_two_test(customers(spark, d), ["g"], F.col("a"), "x"), "stat", "p")


BINS = f"WITH {LINES}, b AS (SELECT g, s, line, count(*) AS o FROM li GROUP BY g, s, line), e AS (SELECT g, s, o, sum(o) OVER (PARTITION BY g, s) / count(*) OVER (PARTITION BY g, s) AS e FROM b)"


def _bins(spark, d):
    own = lines(spark, d).groupBy("g", "s", "line").agg(F.count("*").alias("o"))
    return own.join(own.groupBy("g", "s").agg((F.sum("o") / F.count("*")).alias("e")), ["g", "s"])


@query(f"{BINS}, t AS (SELECT g, s, sum((o - e) * (o - e) / e) AS stat, count(*) - 1 AS df FROM e GROUP BY g, s) SELECT g, s, {sr('stat', 5)} AS stat, df, CASE WHEN df > 0 THEN {sr('1 - ' + gamma_p('(df / 2)', '(stat / 2)', 6000), 5)} END AS p FROM t")
def chi2(spark, d):
    return rounded(T.chi2_test(_bins(spark, d), ["g", "s"], "o", "e"), "stat", "p", digits=5)


@query(f"{BINS}, t AS (SELECT g, s, sum((o - e) * (o - e) / (10 * e)) AS stat, count(*) - 2 AS df FROM e GROUP BY g, s) SELECT g, s, {sr('stat', 5)} AS stat, df, CASE WHEN df > 0 THEN {sr('1 - ' + gamma_p('(df / 2)', '(stat / 2)', 3000), 5)} END AS p FROM t")
def chi2_cont(spark, d):
    own = _bins(spark, d).withColumn("sigma", F.sqrt(10 * F.col("e")))
    return rounded(T.chi2_test(own, ["g", "s"], "o", "e", 1, "sigma"), "stat", "p", digits=5)


@query(f"""WITH {CUSTOMERS}, o AS (SELECT g, k, a, lag(a) OVER (PARTITION BY g ORDER BY k) AS b FROM cu),
c AS (SELECT g, count(*) FILTER (WHERE b IS NULL OR a <> b) AS runs, count(*) FILTER (WHERE a) AS n_true, count(*) FILTER (WHERE NOT a) AS n_false FROM o GROUP BY g),
w AS (SELECT *, r, r // 2 AS h, {WAYS} AS ways FROM c, LATERAL (SELECT unnest(range(2, n_true + n_false + 1)) AS r)),
p AS (SELECT g, sum(ways) FILTER (WHERE r <= runs) / sum(ways) AS p FROM w GROUP BY g)
SELECT g, runs, n_true, n_false, CASE WHEN n_true = 0 OR n_false = 0 THEN 1.0 ELSE {sr('coalesce(p, 0)')} END AS p FROM c LEFT JOIN p USING (g)""")
def runs(spark, d):
    from quantalake.operators.ranks import indexed

    return rounded(T.runs_test(indexed(customers(spark, d).select("g", "k", "a"), ["g"], "k"), ["g"], "idx", "a"), "p")


@query(f"""{TWO}, s AS (SELECT g, n1 + n2 - 2.0 AS df, CASE WHEN n1 > 1 AND n2 > 1 THEN (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) END AS t FROM t),
p AS (SELECT *, {t_two('t', 'df')} AS p FROM s)
SELECT g, {sr('t')} AS value, {sr('p')} AS p, 'StudentT' AS family, CASE WHEN t IS NOT NULL THEN df::DOUBLE END AS parameter, p <= 0.05 AS significant FROM p""")
def ttest_result(spark, d):
    """The record of a test, and whether it is significant."""
    own = T.student_t_test(customers(spark, d), ["g"], F.col("a"), "x")
    own = own.select("g", T.test_result("stat", "p", "StudentT", "df").alias("t"), T.significant("p", 0.05).alias("significant"))
    return own.select("g", r("t.value").alias("value"), r("t.p").alias("p"), F.col("t.distribution.family").alias("family"), F.col("t.distribution.parameters")[0].alias("parameter"), "significant")
