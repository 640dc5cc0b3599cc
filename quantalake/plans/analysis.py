"""Queries of densities, transforms, matrices, regression, resampling and streams."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quantalake.operators import density as G
from quantalake.operators import matrix as M
from quantalake.operators import resampling as K
from quantalake.operators import transform as X
from quantalake.operators.inference import CL90
from quantalake.operators.ranks import indexed
from quantalake.operators.quantiles import MEDIAN_UNBIASED
from quantalake.plans.common import CUSTOMERS, LINES, ORDERS, PARTS, customers, lines, orders, parts, phi, r, rounded, sr
from quantalake.plans.inference import EMBEDDINGS, _embeddings, prices
from quantalake.plans.summaries import quantile_sql
from quantalake.sources.scratch import scratch, stored
from quantalake.sources.tables import load

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


BINNED = """b AS (SELECT g, lo, hi, i AS bin FROM lim, range(0, 20) t(i)), c AS (SELECT o.g, trunc((x - lo) / ((hi - lo) / 20 * (1 + 2.220446049250313e-16::DOUBLE)))::INTEGER AS bin, count(*) AS n FROM base o JOIN lim USING (g) GROUP BY ALL)
SELECT b.g, b.bin::INTEGER AS bin, (round(lo + (hi - lo) / 20 * b.bin, 6) + 0.0)::DOUBLE AS lo, coalesce(n, 0) AS n FROM b LEFT JOIN c ON b.g = c.g AND b.bin = c.bin"""


@query(f"WITH {ORDERS}, base AS (SELECT g, x FROM ord), r AS (SELECT g, min(x) AS a, max(x) AS z FROM ord GROUP BY g), lim AS (SELECT g, a - (z - a) / 38 AS lo, z + (z - a) / 38 AS hi FROM r), {BINNED}")
def histogram(spark, d):
    return rounded(G.histogram(orders(spark, d), ["g"], "x", 20), "lo")


@query(f"WITH {CUSTOMERS}, base AS (SELECT g, x FROM cu), lim AS (SELECT DISTINCT g, -2.0::DOUBLE AS lo, 12.0::DOUBLE AS hi FROM cu), {BINNED}")
def histogram_fixed(spark, d):
    return rounded(G.histogram_fixed(customers(spark, d), ["g"], "x", 20, -2, 12), "lo")


def _functional(q: int, t: str) -> str:
    """The norm of the q-th derivative at bandwidth t, from squared cosine coefficients sq."""
    return f"2 * pow(pi(), {2 * q}) * list_sum([pow(i * i, {q}) * sq[i] * exp(-i * i * pi() * pi() * {t}) FOR i IN range(1, 128)])"


def _botev_step() -> str:
    """One halving of the interval that holds the fixed point: h of its middle m."""
    out = f"SELECT *, {_functional(7, 'm')} AS h FROM (SELECT *, (lo + hi) / 2 AS m FROM root WHERE it < 50)"
    for s in range(6, 1, -1):
        factor = 2 * (1 + 0.5 ** (s + 0.5)) / 3 * math.prod(range(1, 2 * s, 2)) / math.sqrt(2 * math.pi)
        out = f"SELECT * EXCLUDE (h, t), {_functional(s, 't')} AS h FROM (SELECT *, pow({factor!r}::DOUBLE / size / h, {2 / (3 + 2 * s)!r}::DOUBLE) AS t FROM ({out}))"
    return out


@query(f"""WITH RECURSIVE {ORDERS}, lim AS (SELECT g, count(*) AS size, min(x) - (max(x) - min(x)) / 10 AS a, max(x) + (max(x) - min(x)) / 10 AS z FROM ord GROUP BY g),
bn AS (SELECT o.g, trunc((x - a) / ((z - a) / 128 * (1 + 2.220446049250313e-16::DOUBLE)))::INTEGER AS j, count(*) AS n FROM ord o JOIN lim USING (g) GROUP BY ALL),
fr AS (SELECT g, i, 2 * sum(n / size::DOUBLE * cos(pi() * i * (2 * j + 1) / 256)) AS c FROM bn JOIN lim USING (g), range(0, 128) r(i) GROUP BY g, i), co AS (SELECT g, list(c ORDER BY i) AS c FROM fr GROUP BY g),
root(g, size, sq, lo, hi, it) AS (SELECT g, size, [pow(c[i + 1] / 2, 2) FOR i IN range(1, 128)], 0.0::DOUBLE, 0.1::DOUBLE, 0 FROM co JOIN lim USING (g) UNION ALL
SELECT g, size, sq, CASE WHEN m < pow(size * 2 * sqrt(pi()) * h, -0.4) THEN m ELSE lo END, CASE WHEN m < pow(size * 2 * sqrt(pi()) * h, -0.4) THEN hi ELSE m END, it + 1 FROM ({_botev_step()})), bw AS (SELECT g, lo AS t FROM root WHERE it = 50)
SELECT g, i::INTEGER AS i, {sr('a + (z - a) / 127 * i')} AS x, {sr('(c[1] + 2 * list_sum([c[k + 1] * exp(-k * k * pi() * pi() * t / 2) * cos(pi() * k * (2 * i + 1) / 256) FOR k IN range(1, 128)])) / (2 * (z - a))', 9)} AS density
FROM lim JOIN co USING (g) JOIN bw USING (g), range(0, 128) r(i)""")
def kde_botev(spark, d):
    own = G.kde(orders(spark, d), ["g"], "x", 100)
    return own.select("g", "i", r("x").alias("x"), r("density", 9).alias("density"))


def _simple_sql(bandwidth: str, padding: int, kernel: str) -> str:
    return f"""WITH {CUSTOMERS}, s AS (SELECT g, min(x) AS a, max(x) AS z, count(*) AS n, stddev_samp(x) * pow({bandwidth}, 0.2) AS h FROM cu GROUP BY g HAVING count(*) > 1),
p AS (SELECT g, n, h, i, a - {padding} * h + (z - a + 2 * {padding} * h) / 15 * i AS p FROM s, range(0, 16) t(i))
SELECT p.g, p.i::INTEGER AS i, {sr('max(p.p)')} AS x, {sr(f'sum({kernel})')} AS density FROM p JOIN cu ON cu.g = p.g GROUP BY p.g, p.i"""


@query(_simple_sql("4 / (n * 3)".replace("n", "count(*)"), 3, "exp(-0.5 * pow((cu.x - p.p) / p.h, 2)) / (p.h * p.n) / sqrt(2 * pi())"))
def kde_gaussian_simple(spark, d):
    return rounded(G.gaussian_pdf(customers(spark, d), ["g"], "x", 16), "x", "density")


@query(_simple_sql("80 / (count(*) * 2 / sqrt(pi()))", 1, "CASE WHEN abs((cu.x - p.p) / (0.75 * p.h)) <= 1 THEN (1 - pow((cu.x - p.p) / (0.75 * p.h), 2)) / (p.h * p.n) ELSE 0 END"))
def kde_epanechnikov_simple(spark, d):
    return rounded(G.epanechnikov_pdf(customers(spark, d), ["g"], "x", 16), "x", "density")


#: At 1000 points, of the values within a window of each only.
MANY = f"""WITH {LINES}, s AS (SELECT g, min(x) AS a, max(x) AS z, count(*) AS n, stddev_samp(x) * pow(80 / (count(*) * 2 / sqrt(pi())), 0.2) AS h FROM li GROUP BY g),
p AS (SELECT g, n, h, i, a - h + (z - a + 2 * h) / 999 * i AS p FROM s, range(0, 1000) t(i))"""


@query(f"{MANY} SELECT p.g, p.i::INTEGER AS i, {sr('max(p.p)')} AS x, {sr('coalesce(sum(1 - pow((li.x - p.p) / (0.75 * p.h), 2)) / max(p.h * p.n), 0)', 8)} AS density FROM p LEFT JOIN li ON li.g = p.g AND li.x BETWEEN p.p - 0.75 * p.h AND p.p + 0.75 * p.h GROUP BY p.g, p.i")
def kde_epanechnikov_lines(spark, d):
    """The density of prices of all line items at 1000 points a return flag."""
    own = G.epanechnikov_pdf(lines(spark, d), ["g"], "x", 1000)
    return own.select("g", "i", r("x").alias("x"), r("density", 8).alias("density"))


# Transforms of the mean embedding of each label, and of its neighbour as the imaginary part

VECTORS = f"{EMBEDDINGS}, ve AS (SELECT i, j, v, v * (j + 1) / 8.0 AS w, count(*) OVER (PARTITION BY i) AS n FROM m)"


def _vectors(spark, d):
    own = _embeddings(spark, d).withColumn("w", F.col("v") * (F.col("j") + 1) / 8)
    return own.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v", "w"))).alias("s")).select("i", F.transform("s", lambda e: e["v"]).alias("re"), F.transform("s", lambda e: e["w"]).alias("im"))


@query(f"""WITH {VECTORS} SELECT a.i AS i, k.j AS k, {sr('sum(a.v * cos(2 * pi() * a.j * k.j / a.n) + a.w * sin(2 * pi() * a.j * k.j / a.n))', 5)} AS re,
{sr('sum(a.w * cos(2 * pi() * a.j * k.j / a.n) - a.v * sin(2 * pi() * a.j * k.j / a.n))', 5)} AS im FROM ve a JOIN ve k ON a.i = k.i GROUP BY a.i, k.j""")
def fft(spark, d):
    own = _vectors(spark, d).select("i", X.fft(F.col("re"), F.col("im")).alias("f"))
    own = own.select("i", F.posexplode(F.arrays_zip("f.re", "f.im")).alias("k", "e"))
    return own.select("i", "k", r(F.col("e.re"), 5).alias("re"), r(F.col("e.im"), 5).alias("im"))


@query(f"WITH {VECTORS} SELECT i, j AS k, {sr('v')} AS re, {sr('w')} AS im FROM ve")
def ifft_roundtrip(spark, d):
    own = _vectors(spark, d).select("i", X.fft(F.col("re"), F.col("im")).alias("f")).select("i", X.ifft(F.col("f.re"), F.col("f.im")).alias("f"))
    own = own.select("i", F.posexplode(F.arrays_zip("f.re", "f.im")).alias("k", "e"))
    return own.select("i", "k", r(F.col("e.re")).alias("re"), r(F.col("e.im")).alias("im"))


@query(f"WITH {VECTORS} SELECT a.i AS i, k.j AS k, {sr('2 * sum(a.v * cos(pi() * k.j * (2 * a.j + 1) / (2 * a.n)))', 5)} AS v FROM ve a JOIN ve k ON a.i = k.i GROUP BY a.i, k.j")
def dct(spark, d):
    own = _vectors(spark, d).select("i", F.posexplode(X.dct(F.col("re"))).alias("k", "v"))
    return rounded(own, "v", digits=5)


@query(f"WITH {VECTORS} SELECT i, j AS k, {sr('2 * n * v', 5)} AS v FROM ve")
def idct_roundtrip(spark, d):
    own = _vectors(spark, d).select("i", F.posexplode(X.idct(X.dct_complex(F.col("re"), F.col("im")))).alias("k", "v"))
    return rounded(own, "v", digits=5)


#: Prices of all orders by key, as one series that is padded to n, a power of two.
PADDED = f"{ORDERS}, pd AS (SELECT row_number() OVER (ORDER BY k) - 1 AS j, x FROM ord), sz AS (SELECT pow(2, ceil(log2(count(*))))::BIGINT AS n FROM ord), fr AS (SELECT unnest(range(0, n)) AS k, n FROM sz)"


def _padded(spark, d):
    own = prices(spark, d)
    return own, 1 << max(0, own.count() - 1).bit_length()


@query(f"WITH {PADDED} SELECT k, {sr('sum(x * cos(2 * pi() * ((j * k) % n) / n))', 3)} AS re, {sr('-sum(x * sin(2 * pi() * ((j * k) % n) / n))', 3)} AS im FROM pd, fr GROUP BY k")
def fft_long(spark, d):
    """The transform of one long series, a row a frequency."""
    own, n = _padded(spark, d)
    return rounded(X.fft_long(own, [], "idx", "x", n), "re", "im", digits=3)


@query(f"WITH {PADDED} SELECT f.k AS k, {sr('coalesce(x, 0)')} AS x FROM fr f LEFT JOIN pd ON j = f.k")
def ifft_long(spark, d):
    own, n = _padded(spark, d)
    back = X.ifft_long(X.fft_long(own, [], "idx", "x", n), [], "k", "re", "im", n)
    return back.select("k", r("re").alias("x"))


@query(f"WITH {PADDED} SELECT k, {sr('2 * sum(x * cos(pi() * ((k * (2 * j + 1)) % (4 * n)) / (2 * n)))', 3)} AS v FROM pd, fr GROUP BY k")
def dct_long(spark, d):
    own, n = _padded(spark, d)
    return rounded(X.dct_long(own, [], "idx", "x", n), "v", digits=3)


@query(f"WITH {PADDED} SELECT f.k AS k, {sr('coalesce(x, 0)')} AS x FROM fr f LEFT JOIN pd ON j = f.k")
def idct_long(spark, d):
    own, n = _padded(spark, d)
    back = X.idct_long(X.dct_long(own, [], "idx", "x", n), [], "k", "v", n)
    return back.select("k", r(F.col("v") / (2 * n)).alias("x"))


# Matrices: the mean embeddings, a row a label


@query(f"WITH {EMBEDDINGS} SELECT a.i AS i, b.i AS j, {sr('sum(a.v * b.v)')} AS v FROM m a JOIN m b ON a.j = b.j GROUP BY a.i, b.i")
def matmul(spark, d):
    m = _embeddings(spark, d)
    return rounded(M.multiply(m, M.transpose(m)), "v")


@query(f"WITH {EMBEDDINGS} SELECT j AS i, i AS j, {sr('v')} AS v FROM m")
def transpose(spark, d):
    return rounded(M.transpose(_embeddings(spark, d)), "v")


@query(f"WITH {EMBEDDINGS}, g AS (SELECT a.i AS i, b.i AS j, sum(a.v * b.v) AS v FROM m a JOIN m b ON a.j = b.j GROUP BY a.i, b.i), h AS (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM g a JOIN g b ON a.j = b.i GROUP BY a.i, b.j) SELECT a.i AS i, b.j AS j, {sr('sum(a.v * b.v)', 4)} AS v FROM h a JOIN g b ON a.j = b.i GROUP BY a.i, b.j")
def matrix_power(spark, d):
    m = _embeddings(spark, d)
    return rounded(M.power(M.multiply(m, M.transpose(m)), 3), "v", digits=4)


@query(f"WITH {EMBEDDINGS} SELECT {sr('sqrt(sum(v * v))')} AS norm, false AS nan, max(i)::BIGINT + 1 AS rows, max(j)::BIGINT + 1 AS columns, {sr('sum(v) FILTER (WHERE i = 1)')} AS row_sum, {sr('sum(v) FILTER (WHERE j = 2)')} AS column_sum FROM m")
def matrix_access(spark, d):
    m = _embeddings(spark, d)
    a = m.agg(r(M.norm()).alias("norm"), M.has_nan().alias("nan"))
    b = M.dimension(m).select(F.col("rows").cast("long").alias("rows"), F.col("columns").cast("long").alias("columns"))
    return a.crossJoin(b).crossJoin(M.row(m, 1).agg(r(F.sum("v")).alias("row_sum"))).crossJoin(M.column(m, 2).agg(r(F.sum("v")).alias("column_sum")))  # single rows


@query("""WITH b AS (SELECT c_nationkey AS i, round(sum(c_acctbal), 2) AS v FROM customer GROUP BY 1), n AS (SELECT count(*) AS n FROM nation)
SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END::DOUBLE AS identity, (least(i, j) * 10 + greatest(i, j))::DOUBLE AS symmetric, (CASE WHEN i = j THEN v ELSE 0.0 END)::DOUBLE AS diagonal
FROM (SELECT unnest(range(0, n)) AS i FROM n) JOIN (SELECT unnest(range(0, n)) AS j FROM n) ON true JOIN b USING (i)""")
def matrix_generate(spark, d):
    """Matrices with a row a nation: the identity, a symmetric one, and balances on the diagonal."""
    n = load(spark, d, "nation").count()
    balances = load(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("v"))
    own = M.diagonal(balances, "c_nationkey", "v", n).withColumnRenamed("v", "diagonal")
    same = M.identity(spark, n).withColumnRenamed("v", "identity")
    both = same.join(M.generate_symmetric(spark, n, lambda i, j: i * 10 + j).withColumnRenamed("v", "symmetric"), ["i", "j"])
    return both.join(own, ["i", "j"])


@query("SELECT l_suppkey AS g, true AS product, true AS orthogonal FROM lineitem GROUP BY l_suppkey HAVING count(*) >= 3")
def qr_check(spark, d):
    """A = Q R, with orthonormal columns of Q, for a matrix of price, quantity and 1 for each supplier."""
    names = ["x", "l_quantity", "one"]
    a = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("g"), (F.col("l_extendedprice") / 1e4).alias("x"), "l_quantity", F.lit(1.0).alias("one"))
    q, rr = (lambda m: F.col("q")[m]), (lambda m, j: F.col("r")[3 * m + j])
    off = F.greatest(*[F.abs(q(0) * rr(0, j) + q(1) * rr(1, j) + q(2) * rr(2, j) - F.col(c)) for j, c in enumerate(names)])
    gram = [F.abs(F.sum(q(m) * q(j)) - float(m == j)) for m in range(3) for j in range(m, 3)]
    return M.qr_rows(a, ["g"], names).groupBy("g").agg((F.max(off) < 1e-9).alias("product"), (F.greatest(*gram) < 1e-7).alias("orthogonal"))


#: R of the matrix (1, x, q, w) of line items, as the Cholesky factor of its Gram matrix, by column.
CHOLESKY = f"""{LINES}, s AS (SELECT g, count(*)::DOUBLE AS n, avg(x) AS mx, avg(q) AS mq, avg(w) AS mw FROM li GROUP BY g),
c AS (SELECT li.g, sum((x - mx) * (x - mx)) AS xx, sum((x - mx) * (q - mq)) AS xq, sum((x - mx) * (w - mw)) AS xw, sum((q - mq) * (q - mq)) AS qq, sum((q - mq) * (w - mw)) AS qw, sum((w - mw) * (w - mw)) AS ww FROM li JOIN s USING (g) GROUP BY li.g),
r1 AS (SELECT *, sqrt(n) AS r00, sqrt(n) * mx AS r01, sqrt(n) * mq AS r02, sqrt(n) * mw AS r03, sqrt(xx) AS r11, xq / sqrt(xx) AS r12, xw / sqrt(xx) AS r13 FROM s JOIN c USING (g)),
r2 AS (SELECT *, sqrt(qq - r12 * r12) AS r22, (qw - r12 * r13) / sqrt(qq - r12 * r12) AS r23 FROM r1), r3 AS (SELECT *, sqrt(ww - r13 * r13 - r23 * r23) AS r33 FROM r2)"""


def _with_one(spark, d):
    return lines(spark, d).select("g", "orderkey", "line", F.lit(1.0).alias("one"), "x", "q", "w")


@query(f"WITH {CHOLESKY}, e AS (SELECT g, unnest([r00, r01, r02, r03, 0, r11, r12, r13, 0, 0, r22, r23, 0, 0, 0, r33]) AS v, unnest(range(0, 16)) AS place FROM r3) SELECT g, place // 4 AS i, place % 4 AS j, {sr('v', 5)} AS v FROM e")
def qr_lines(spark, d):
    """R of one matrix a return flag, with a row a line item."""
    return rounded(M.qr_tall(_with_one(spark, d), ["g"], ["one", "x", "q", "w"])[1], "v", digits=5)


@query(f"""WITH {CHOLESKY}, q AS (SELECT orderkey, line, 1 / r00 AS one, (x - r01 / r00) / r11 AS x1, q, w, r00, r02, r03, r12, r13, r22, r23, r33 FROM li JOIN r3 USING (g))
SELECT orderkey, line, {sr('one', 8)} AS one, {sr('x1', 8)} AS x, {sr('(q - r02 * one - r12 * x1) / r22', 8)} AS q, {sr('(w - r03 * one - r13 * x1 - r23 * ((q - r02 * one - r12 * x1) / r22)) / r33', 8)} AS w FROM q""")
def qr_lines_q(spark, d):
    """The rows of Q, a row a line item."""
    q, _ = M.qr_tall(_with_one(spark, d), ["g"], ["one", "x", "q", "w"])
    return rounded(q.drop("g"), "one", "x", "q", "w", digits=8)


# Regression


@query(f"WITH {LINES} SELECT g, s, {sr('sum(x * q) / sum(q * q)')} AS slope FROM li GROUP BY g, s")
def ols(spark, d):
    own = M.ols(lines(spark, d), ["g", "s"], ["q"], "x")
    return own.select("g", "s", r(F.col("coefficients")[0]).alias("slope"))


@query(f"WITH {LINES} SELECT g, s, {sr('regr_slope(x, q)')} AS slope, {sr('regr_intercept(x, q)')} AS intercept, {sr('regr_r2(x, q)')} AS r2 FROM li GROUP BY g, s")
def r_square(spark, d):
    own = M.ols_regress(lines(spark, d), ["g", "s"], ["q"], "x")
    return own.select("g", "s", r(F.col("coefficients")[0]).alias("slope"), r(F.col("coefficients")[1]).alias("intercept"), r("r2").alias("r2"))


@query(f"""WITH {LINES}, c AS (SELECT g, s, covar_pop(q, q) AS aa, covar_pop(q, w) AS ab, covar_pop(w, w) AS bb, covar_pop(q, x) AS ay, covar_pop(w, x) AS by_, avg(q) AS ma, avg(w) AS mb, avg(x) AS my FROM li GROUP BY g, s),
k AS (SELECT g, s, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS a, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS b, ma, mb, my FROM c)
SELECT g, s, {sr('a')} AS a, {sr('b')} AS b, {sr('my - a * ma - b * mb')} AS intercept FROM k""")
def ols_multi(spark, d):
    own = M.ols_regress(lines(spark, d), ["g", "s"], ["q", "w"], "x")
    return own.select("g", "s", *[r(F.col("coefficients")[i]).alias(n) for i, n in enumerate(("a", "b", "intercept"))])


# Resampling


def _jackknife(name: str, estimator: str, sql: str) -> None:
    def run(spark, d):
        return K.jackknife(customers(spark, d), ["g"], "x", estimator).select("g", "k", r("value", 9 if estimator == "mean" else 6).alias("value"))

    QUERIES[name] = run
    s1, s2, n = "(sum(x) OVER w - x)", "(sum(x * x) OVER w - x * x)", "(count(*) OVER w - 1)"
    SQL[name] = f"WITH {CUSTOMERS} SELECT g, k, {sr(sql.format(s1=s1, s2=s2, n=n), 9 if estimator == 'mean' else 6)} AS value FROM cu WINDOW w AS (PARTITION BY g)"


_jackknife("jackknife_mean", "mean", "{s1} / {n}")
_jackknife("jackknife_var", "variance", "({s2} - {s1} * {s1} / {n}) / {n}")
_jackknife("jackknife_var_unb", "variance_unbiased", "({s2} - {s1} * {s1} / {n}) / ({n} - 1)")
_jackknife("jackknife_sd", "std_dev", "sqrt(({s2} - {s1} * {s1} / {n}) / ({n} - 1))")


@query(f"WITH {CUSTOMERS} SELECT a.g AS g, a.s AS s, a.k AS k, max(b.x) AS value FROM cu a JOIN cu b ON a.g = b.g AND a.s = b.s AND a.k <> b.k GROUP BY a.g, a.s, a.k")
def jackknife_function(spark, d):
    """The largest value, each row left out in turn."""
    return K.jackknife_by(customers(spark, d), ["g", "s"], "k", "x", F.max, F.max)


def _indexed_customers(spark, d):
    return indexed(customers(spark, d).select("g", "k", "x"), ["g"], "k").select("g", "idx", "x")


@query(f"WITH {CUSTOMERS} SELECT g, 200::BIGINT AS replicates, count(*)::BIGINT AS least_draws, count(*)::BIGINT AS most_draws, true AS inside, true AS near FROM cu GROUP BY g")
def resample(spark, d):
    """200 replicates a group: each draws as many as the group has, means stay within it, and their mean is near its."""
    own = stored(_indexed_customers(spark, d), "indexed")
    reps = K.resample_moments(own, ["g"], "idx", "x", 200, 3)
    sample = own.groupBy("g").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"), F.count("*").alias("n"))
    joined = reps.join(sample, "g")
    inside = F.min((F.col("mean") >= F.col("a") - 1e-9) & (F.col("mean") <= F.col("b") + 1e-9))
    near = F.abs(F.avg("mean") - F.max("m")) <= 5 * F.max(F.col("sd") / F.sqrt("n")) / 200**0.5 + 1e-12
    return joined.groupBy("g").agg(F.count("*").alias("replicates"), F.min("draws").alias("least_draws"), F.max("draws").alias("most_draws"), inside.alias("inside"), near.alias("near"))


@query(f"""WITH {LINES}, t AS (SELECT g, avg(x) AS m, stddev_pop(x) / sqrt(count(*)) AS se FROM li GROUP BY g) SELECT g, {sr('m')} AS point, true AS low, true AS high FROM t""")
def bootstrap_lines(spark, d):
    """Intervals of the mean price of all line items, from 400 exact resamples: their ends are where the normal limit has
    them, to three quarters of a standard error."""
    own = stored(indexed(lines(spark, d).withColumn("k", F.col("orderkey") * 16 + F.col("line")), ["g"], "k").select("g", "idx", "x"), "indexed")
    found = K.bootstrap_bca(own, K.resample(own, ["g"], "idx", "x", {"mean": "mean"}, 400, 21), ["g"], "x", "mean", 400, CL90)
    se = own.groupBy("g").agg((F.stddev_pop("x") / F.sqrt(F.count("*"))).alias("se"))
    near = lambda c, sign: F.abs(F.col(c) - F.col("point") - sign * 1.6448536269514722 * F.col("se")) < 0.75 * F.col("se")
    return found.join(se, "g").select("g", r("point").alias("point"), near("lo", -1).alias("low"), near("hi", 1).alias("high"))


@query(f"WITH {LINES} SELECT g, s, 40::BIGINT AS replicates, true AS near FROM li GROUP BY g, s")
def resample_poisson(spark, d):
    """Replicates of large samples by weights: means are near the sample's."""
    own = lines(spark, d)
    reps = K.resample_poisson(own, ["g", "s"], ["orderkey", "line"], "x", 40, 9)
    sample = own.groupBy("g", "s").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"), F.count("*").alias("n"))
    return reps.join(sample, ["g", "s"]).groupBy("g", "s").agg(F.count("*").alias("replicates"), (F.max(F.abs(F.col("mean") - F.col("m")) / (F.col("sd") / F.sqrt("n"))) < 6).alias("near"))


# Bootstrap intervals of a given design of draws, which SQL can follow

#: A step of a multiplicative generator over a mixed number of the replicate and the draw.
PLACE = "({rep} * 7919 + {k} * 104729 + {rep} * {k} * 31 + {k} * {k} * 17 + 12345) * 48271 % 2147483647"


def _draws(own, replicates: int, first: int = 0):
    """Groups g, rep and idx: draws that look random enough, from whole numbers alone."""
    reps = K.replicated(own.groupBy("g").agg(F.count("*").alias("n")), ["g"], replicates)
    draws = reps.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return draws.select("g", "rep", (F.expr(PLACE.format(rep=f"(rep + {first})", k="k")) % F.col("n")).alias("idx"))


def _drawn(rel: str, replicates: int) -> str:
    """CTEs: ix (rel with the place i), sz (its sizes) and dr (the rows that are drawn, with rep)."""
    return f"""ix AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY k) - 1 AS i FROM {rel}), sz AS (SELECT g, count(*) AS n FROM {rel} GROUP BY g),
dr AS (SELECT ix.*, rep FROM (SELECT g, rep, ({PLACE.format(rep='rep', k='j')}) % n AS i FROM (SELECT g, n, rep, unnest(range(0, n)) AS j FROM sz, range(0, {replicates}) r(rep))) d JOIN ix ON ix.g = d.g AND ix.i = d.i)"""


@query(f"""WITH {CUSTOMERS}, ix AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY k) - 1 AS i FROM cu), sz AS (SELECT g, count(*) AS n FROM cu GROUP BY g),
pl AS (SELECT g, rep, ({PLACE.format(rep='rep', k='j')}) % n AS a, ({PLACE.format(rep='(rep + 50)', k='j')}) % n AS b FROM (SELECT g, n, rep, unnest(range(0, n)) AS j FROM sz, range(0, 50) r(rep)))
SELECT pl.g AS g, rep::INTEGER AS rep, {sr('avg(one.x)', 12)} AS one, {sr('avg(two.x)', 12)} AS two FROM pl JOIN ix one ON one.g = pl.g AND one.i = pl.a JOIN ix two ON two.g = pl.g AND two.i = pl.b GROUP BY pl.g, rep""")
def resample_each(spark, d):
    """50 replicates a group, with draws of its own for each estimator."""
    own = stored(_indexed_customers(spark, d), "indexed")
    draws = {"one": _draws(own, 50), "two": _draws(own, 50, 50)}
    return rounded(K.resample_each(own, ["g"], "idx", "x", {"one": "mean", "two": "mean"}, 50, 5, draws), "one", "two", digits=12)


BCA = f"""{_drawn('cu', 200)}, re AS (SELECT g, rep, avg(x) AS v FROM dr GROUP BY g, rep), pt AS (SELECT g, avg(x) AS point, count(*) AS n, 1e-9::DOUBLE * stddev_pop(x) AS tie FROM cu GROUP BY g),
jk AS (SELECT g, (sum(x) OVER w - x) / (count(*) OVER w - 1) AS j FROM cu WINDOW w AS (PARTITION BY g)), jd AS (SELECT g, avg(j) OVER (PARTITION BY g) - j AS d FROM jk),
js AS (SELECT g, sum(d * d * d) / (6 * pow(sum(d * d), 1.5)) AS accel FROM jd GROUP BY g),
be AS (SELECT g, count(*) FILTER (WHERE v < point - tie) / 200.0::DOUBLE AS below FROM re JOIN pt USING (g) GROUP BY g),
zz(b, lo, hi, i) AS (SELECT DISTINCT below, -9.0::DOUBLE, 9.0::DOUBLE, 0 FROM be WHERE below > 0 AND below < 1 UNION ALL
SELECT b, CASE WHEN {phi('((lo + hi) / 2)')} < b THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {phi('((lo + hi) / 2)')} < b THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM zz WHERE i < 60),
sh AS (SELECT g, lo AS bias, accel, lo - 1.6448536269514722::DOUBLE AS b1, lo + 1.6448536269514722::DOUBLE AS b2 FROM be JOIN zz ON b = below AND i = 60 JOIN js USING (g)),
pl AS (SELECT g, least(199, greatest(0, round_even(200 * {phi('(bias + b1 / (1 - accel * b1))')}, 0))) AS a, least(199, greatest(0, round_even(200 * {phi('(bias + b2 / (1 - accel * b2))')}, 0))) AS z FROM sh),
od AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v) - 1 AS nth FROM re)"""


@query(f"WITH RECURSIVE {CUSTOMERS}, {BCA} SELECT pt.g AS g, {sr('point')} AS point, {sr('coalesce(a.v, point)')} AS lo, {sr('coalesce(z.v, point)')} AS hi FROM pt LEFT JOIN pl ON pl.g = pt.g AND pt.n > 1 LEFT JOIN od a ON a.g = pt.g AND a.nth = pl.a LEFT JOIN od z ON z.g = pt.g AND z.nth = pl.z")
def bootstrap_bca(spark, d):
    own = stored(_indexed_customers(spark, d), "indexed")
    reps = K.resample(own, ["g"], "idx", "x", {"mean": "mean"}, 200, 11, _draws(own, 200))
    return rounded(K.bootstrap_bca(own, reps, ["g"], "x", "mean", 200, CL90), "point", "lo", "hi")


@query(f"WITH {CUSTOMERS}, {_drawn('cu', 200)}, re AS (SELECT g, rep, coalesce(stddev_samp(x), 0) AS v FROM dr GROUP BY g, rep), od AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v) - 1 AS nth FROM re), pt AS (SELECT g, coalesce(stddev_samp(x), 0) AS point FROM cu GROUP BY g) SELECT g, {sr('point')} AS point, {sr('a.v')} AS lo, {sr('z.v')} AS hi FROM pt JOIN od a USING (g) JOIN od z USING (g) WHERE a.nth = 10 AND z.nth = 190")
def bootstrap_basic(spark, d):
    own = stored(_indexed_customers(spark, d), "indexed")
    reps = K.resample(own, ["g"], "idx", "x", {"std_dev": "std_dev"}, 200, 13, _draws(own, 200))
    return rounded(K.basic_bootstrap(reps, own.groupBy("g").agg(K.estimate("std_dev", "x").alias("std_dev")), ["g"], "std_dev", 200, CL90), "point", "lo", "hi")


@query(f"""WITH {PARTS}, {_drawn('pa', 50)}, f AS (SELECT g, -1 AS rep, regr_slope(x, y) AS a, regr_intercept(x, y) AS b, regr_r2(x, y) AS c FROM pa GROUP BY g UNION ALL SELECT g, rep, regr_slope(x, y), regr_intercept(x, y), regr_r2(x, y) FROM dr GROUP BY g, rep),
v AS (SELECT g, rep, unnest(['coefficient0', 'coefficient1', 'r2']) AS name, unnest([a, b, c]) AS v FROM f), o AS (SELECT *, row_number() OVER (PARTITION BY g, name, rep < 0 ORDER BY v) - 1 AS nth FROM v)
SELECT g, name, round(max(v) FILTER (WHERE rep < 0), 5) + 0.0 AS point, round(max(v) FILTER (WHERE rep >= 0 AND nth = 2), 5) + 0.0 AS lo, round(max(v) FILTER (WHERE rep >= 0 AND nth = 47), 5) + 0.0 AS hi FROM o GROUP BY g, name""")
def bootstrap_regress(spark, d):
    own = stored(indexed(parts(spark, d), ["g"], "k").select("g", "idx", "x", "y"), "indexed")
    return rounded(K.bootstrap_regress(own, ["g"], "idx", ["y"], "x", 50, CL90, 17, draws=_draws(own, 50)), "point", "lo", "hi", digits=5)


def trimmed(x):
    """The mean without the lowest and the highest tenth."""
    import numpy as np

    k = len(x) // 10
    return float(np.sort(x)[k : len(x) - k].mean()) if len(x) else float("nan")


@query(f"WITH {CUSTOMERS}, {_drawn('cu', 40)}, o AS (SELECT g, rep, x, row_number() OVER (PARTITION BY g, rep ORDER BY x) - 1 AS nth, count(*) OVER (PARTITION BY g, rep) AS n FROM dr) SELECT g, rep, {sr('avg(x) FILTER (WHERE nth >= n // 10 AND nth < n - n // 10)', 12)} AS trimmed, {sr('avg(x)', 12)} AS mean FROM o GROUP BY g, rep")
def resample_trimmed(spark, d):
    """An estimator in NumPy beside one of Spark's, on given draws."""
    own = stored(_indexed_customers(spark, d), "indexed")
    reps = K.resample(own, ["g"], "idx", "x", {"trimmed": K.numpy_estimator(trimmed), "mean": F.avg}, 40, 19, _draws(own, 40))
    return rounded(reps, "trimmed", "mean", digits=12)


@query(f"WITH {CUSTOMERS}, lo AS (SELECT a.g AS g, a.k AS k, b.x AS x, row_number() OVER (PARTITION BY a.g, a.k ORDER BY b.x) - 1 AS nth, count(*) OVER (PARTITION BY a.g, a.k) AS n FROM cu a JOIN cu b ON a.g = b.g AND a.k <> b.k) SELECT g, k, {sr('avg(x) FILTER (WHERE nth >= n // 10 AND nth < n - n // 10)', 9)} AS value FROM lo GROUP BY g, k")
def jackknife_trimmed(spark, d):
    """The trimmed mean, each row left out in turn."""
    return rounded(K.jackknife_trimmed(customers(spark, d), ["g"], "k", "x", 10), "value", digits=9)


# Streams: a bounded run over the table's files, into a table of the shared folder


def _events(spark, d):
    """A stream of the table's files, by the folder's listing: a table is a file or a folder of its own."""
    schema = load(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")


def _run(stream, name: str, mode: str):
    """The rows that a stream has given when all files are read: its last state (complete), or all of them (append)."""
    path = scratch(stream.sparkSession, name)
    write = lambda df, _: df.write.mode("overwrite" if mode == "complete" else "append").parquet(path)
    out = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start()
    out.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


@query(f"SELECT event_type AS g, count(value)::DOUBLE AS p0, {sr('sum(value)', 3)} AS p1, {sr('var_pop(value)', 3)} AS variance FROM events GROUP BY event_type")
def stream_powers(spark, d):
    from quantalake.functions.aggregates import Powers
    from quantalake.streaming.powers import summed_stream

    own = _run(summed_stream(_events(spark, d).withColumnRenamed("event_type", "g"), ["g"], "value", 2), "stream_powers", "complete")
    return own.select("g", "p0", r("p1", 3).alias("p1"), r(Powers(2).variance, 3).alias("variance"))


EVENT_QUARTILES = [f"({quantile_sql('events', 'event_type', 'value', k, 4, MEDIAN_UNBIASED)})" for k in (1, 2, 3)]


@query(f"SELECT a.event_type AS g, {sr('a.v')} AS q1, {sr('b.v')} AS q2, {sr('c.v')} AS q3 FROM {EVENT_QUARTILES[0]} a JOIN {EVENT_QUARTILES[1]} b USING (event_type) JOIN {EVENT_QUARTILES[2]} c USING (event_type)")
def stream_quantiles(spark, d):
    """Quartiles of a stream, from the counts of values that it keeps."""
    from quantalake.streaming.values import count_values, stream_quantiles as read

    path = scratch(spark, "counts")
    count_values(_events(spark, d), ["event_type"], "value", path).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start().awaitTermination()
    own = read(spark, path, ["event_type"], "value", [1, 2, 3], 4, MEDIAN_UNBIASED)
    return own.select(F.col("event_type").alias("g"), *[r(F.col("quantiles")[k]).alias(f"q{k + 1}") for k in range(3)])


@query(f"SELECT event_type AS g, date_trunc('day', ts)::TIMESTAMP AS start, count(value)::DOUBLE AS p0, {sr('sum(value)', 3)} AS p1 FROM events GROUP BY ALL")
def windowed_powers(spark, d):
    from quantalake.streaming.powers import windowed_powers as run

    own = run(load(spark, d, "events").withColumnRenamed("event_type", "g"), "ts", ["g"], "value", 2, "1 day", "1 hour")
    return own.select("g", "start", "p0", r("p1", 3).alias("p1"))


@query(f"""WITH h AS (SELECT event_type AS g, date_trunc('hour', ts)::TIMESTAMP AS hr, count(value)::DOUBLE AS p0, sum(value) AS p1 FROM events GROUP BY ALL),
w AS (SELECT g, unnest(generate_series(hr - INTERVAL 23 HOUR, hr, INTERVAL 1 HOUR)) AS start, p0, p1 FROM h) SELECT g, start, sum(p0) AS p0, {sr('sum(p1)', 3)} AS p1 FROM w GROUP BY g, start""")
def sliding_powers(spark, d):
    """Windows of a day that begin every hour, from panes of an hour."""
    from quantalake.streaming.powers import sliding_powers as run

    own = run(load(spark, d, "events").withColumnRenamed("event_type", "g"), "ts", ["g"], "value", 2, "1 day", "1 hour", "1 hour")
    return own.select("g", "start", "p0", r("p1", 3).alias("p1"))


#: The instant whose UTC clock shows a time without zone, whatever the session's zone is.
INSTANT = "timestamp_micros(CAST((unix_date(to_date(ts)) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + extract(SECOND FROM ts)) * 1000000 AS BIGINT))"


@query(f"""WITH w AS (SELECT event_type AS g, date_trunc('day', ts)::TIMESTAMP AS start, count(value)::DOUBLE AS p0, {sr('sum(value)', 3)} AS p1 FROM events GROUP BY ALL)
SELECT g, epoch(start)::BIGINT AS start_s, p0, p1 FROM w, (SELECT max(ts) AS last FROM events) WHERE start + INTERVAL 1 DAY <= last - INTERVAL 1 HOUR""")
def stream_windows(spark, d):
    """Daily windows of a stream, as they end: those that the watermark has passed."""
    from quantalake.streaming.powers import windowed_powers as run

    events = _events(spark, d).withColumnRenamed("event_type", "g").withColumn("ts", F.expr(INSTANT))
    own = _run(run(events, "ts", ["g"], "value", 2, "1 day", "1 hour"), "stream_windows", "append")
    return own.select("g", F.unix_seconds("start").alias("start_s"), "p0", r("p1", 3).alias("p1"))


@query(f"""WITH o AS (SELECT user_id AS g, ts, value, CASE WHEN ts < lag(ts) OVER w + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY g ORDER BY ts) AS nth FROM o) SELECT g, min(ts)::TIMESTAMP AS start, count(value)::DOUBLE AS p0, {sr('sum(value)', 3)} AS p1 FROM s GROUP BY g, nth""")
def session_powers(spark, d):
    """Sessions of users with gaps below an hour."""
    from quantalake.streaming.powers import session_powers as run

    own = run(load(spark, d, "events").withColumnRenamed("user_id", "g"), "ts", ["g"], "value", 2, "1 hour", "1 hour")
    return own.select("g", "start", "p0", r("p1", 3).alias("p1"))
