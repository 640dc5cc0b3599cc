"""Matrices in coordinates (i, j, v), and least squares.

Entries that aren't there aren't zeros: matrices are dense, with a row of the table for each entry.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantalake.functions import ieee
from quantalake.sources.scratch import stored


def from_rows(df: DataFrame, i: str, values: str) -> DataFrame:
    """A matrix from a row number and an array."""
    return df.select(F.col(i).cast("long").alias("i"), F.posexplode(values).alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def from_columns(df: DataFrame, j: str, values: str) -> DataFrame:
    return transpose(from_rows(df, j, values))


def from_lists(spark: SparkSession, rows: list[list[float]]) -> DataFrame:
    """A small matrix from Python lists of equal lengths."""
    if not rows or not rows[0] or len({len(r) for r in rows}) > 1:
        raise ValueError("rows must be there and equally long")
    return spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(rows) for j, v in enumerate(r)], "i long, j long, v double")


def from_vector(spark: SparkSession, rows: int, columns: int, values: list[float]) -> DataFrame:
    if rows * columns != len(values):
        raise ValueError("the number of values doesn't fit")
    return from_lists(spark, [values[r * columns : (r + 1) * columns] for r in range(rows)])


def to_rows(a: DataFrame) -> DataFrame:
    """i and the array of the row's values."""
    return a.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"]).alias("row"))


def to_columns(a: DataFrame) -> DataFrame:
    return to_rows(transpose(a)).withColumnsRenamed({"i": "j", "row": "column"})


def generate(spark: SparkSession, rows: int, columns: int, f: Callable[[Column, Column], Column]) -> DataFrame:
    own = spark.range(rows * columns).select(F.floor(F.col("id") / columns).alias("i"), (F.col("id") % columns).alias("j"))
    return own.select("i", "j", f(F.col("i"), F.col("j")).cast("double").alias("v"))


def generate_symmetric(spark: SparkSession, n: int, f: Callable[[Column, Column], Column]) -> DataFrame:
    """f is asked for i <= j only."""
    return generate(spark, n, n, lambda i, j: f(F.least(i, j), F.greatest(i, j)))


def identity(spark: SparkSession, n: int) -> DataFrame:
    return generate(spark, n, n, lambda i, j: F.when(i == j, 1.0).otherwise(0.0))


def diagonal(df: DataFrame, i: str, v: str, n: int) -> DataFrame:
    own = df.select(F.col(i).cast("long").alias("i"), F.col(v).cast("double").alias("d"))
    return own.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).select("i", "j", F.when(F.col("i") == F.col("j"), F.col("d")).otherwise(0.0).alias("v"))


def dimension(a: DataFrame) -> DataFrame:
    """A row: rows, columns."""
    return a.agg((F.max("i") + 1).alias("rows"), (F.max("j") + 1).alias("columns"))


def row(a: DataFrame, i: int) -> DataFrame:
    return a.where(F.col("i") == i)


def column(a: DataFrame, j: int) -> DataFrame:
    return a.where(F.col("j") == j)


def center(a: DataFrame) -> DataFrame:
    """The entry at half the rows and half the columns."""
    d = dimension(a)
    return a.join(F.broadcast(d), (F.col("i") == F.floor(F.col("rows") / 2)) & (F.col("j") == F.floor(F.col("columns") / 2))).select("i", "j", "v")  # a single row


def at(a: DataFrame, i: int, j: int) -> DataFrame:
    """The entry at (i, j); an error if there is none."""
    found = a.where((F.col("i") == i) & (F.col("j") == j)).agg(F.max("v").alias("v"))
    return found.select(ieee.require(F.col("v").isNotNull(), F.col("v"), "no such entry").alias("v"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def multiply_vector(a: DataFrame, x: DataFrame) -> DataFrame:
    """(i, v) of a matrix times a vector (i, v). An error if the vector has other places than the matrix has columns."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), x.select(F.col("i").alias("k"), F.col("v").alias("y"))
    joined = left.join(right, "k", "full")
    product = ieee.require(F.col("x").isNotNull() & F.col("y").isNotNull(), F.col("x") * F.col("y"), "dimensions don't fit")
    return joined.groupBy("i").agg(F.sum(product).alias("v"))


def power(a: DataFrame, n: int) -> DataFrame:
    """a to the n-th, n >= 1, by squaring."""
    if n < 1:
        raise ValueError("the power must be positive")
    out = None
    while n:
        if n & 1:
            out = a if out is None else multiply(out, a)
        n >>= 1
        a = multiply(a, a) if n else a
    return out


def map_values(a: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return a.withColumn("v", f(F.col("v")))


def norm(v: str = "v") -> Column:
    """The aggregate root of the sum of squares."""
    return F.sqrt(F.sum(F.col(v) * F.col(v)))


def has_nan(v: str = "v") -> Column:
    return F.max(F.isnan(v))


def _gram_schmidt(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q, n = a.astype(float).copy(), a.shape[1]
    r = np.zeros((n, n))
    for k in range(n):
        r[k, k] = np.sqrt(q[:, k] @ q[:, k])
        with np.errstate(all="ignore"):
            q[:, k] = q[:, k] / r[k, k]
        r[k, k + 1 :] = q[:, k] @ q[:, k + 1 :]
        q[:, k + 1 :] -= np.outer(q[:, k], r[k, k + 1 :])
    return q, r


def qr(a: DataFrame, by: list[str]) -> DataFrame:
    """``by``, part (q or r), i, j, v of many small matrices, one a group, each in a task; a column of zeros gives NaN.
    For a matrix with more rows than a task holds there is ``qr_tall``."""
    kinds = {f.name: f.dataType.simpleString() for f in a.schema.fields}

    def solve(table: pa.Table) -> pa.Table:
        i, j, v = (table[c].to_numpy() for c in ("i", "j", "v"))
        dense = np.zeros((i.max() + 1, j.max() + 1))
        dense[i, j] = v
        parts = []
        for name, m in zip("qr", _gram_schmidt(dense), strict=True):
            rows, columns = np.indices(m.shape)
            parts.append(pa.table([*[table[b].take(pa.array(np.zeros(m.size, int))) for b in by], pa.array([name] * m.size), pa.array(rows.ravel()), pa.array(columns.ravel()), pa.array(m.ravel())], names=[*by, "part", "i", "j", "v"]))
        return pa.concat_tables(parts)

    return a.groupBy(*by).applyInArrow(solve, "".join(f"{b} {kinds[b]}, " for b in by) + "part string, i long, j long, v double")


def qr_rows(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """``by``, ``columns``, q (array: the row of Q) and r (array: the group's R, row by row, diagonal not negative) of many
    small matrices, one a group, each in a task: rows are shuffled once, by group, and come back with their part of Q, so
    neither their order nor a key of theirs matters.

    By Householder's reflections: columns of Q are orthonormal also where those of the matrix are dependent. Rows with a
    null are left out, and groups with fewer rows than columns.
    """
    kinds, k = {f.name: f.dataType.simpleString() for f in df.schema.fields}, len(columns)
    own = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))
    names = [*by, *columns, "q", "r"]

    def solve(table: pa.Table) -> pa.Table:
        n = table.num_rows
        if n < k:
            table, n = table.slice(0, 0), 0
        q, r = np.linalg.qr(np.column_stack([table[c].to_numpy() for c in columns])) if n else (np.zeros((0, k)), np.zeros((k, k)))
        sign = np.where(np.diag(r) < 0, -1.0, 1.0)
        lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, n * size + 1, size), pa.int32()), pa.array(flat.ravel())) for size, flat in ((k, q * sign), (k * k, np.tile(r * sign[:, None], (n, 1))))]
        return pa.table([*[table[c] for c in [*by, *columns]], *lists], names=names)

    schema = "".join(f"`{b}` {kinds[b]}, " for b in by) + "".join(f"`{c}` double, " for c in columns) + "q array<double>, r array<double>"
    return own.groupBy(*by).applyInArrow(solve, schema)


# Tall matrices: a table with a column for each column of the matrix, in as many partitions as it needs

#: Rows of a group that are gathered before they are reduced, rows of all groups that a task holds, and how many factors
#: of a group are merged at a time.
GATHER, HELD, MERGE = 1024, 1 << 18, 64
#: A column whose part that is new has less than this share of its length depends on those before it.
DEPENDENT = 1e-13


def _reduced(m: np.ndarray) -> np.ndarray:
    """The factor R of some rows, with diagonal elements that aren't negative; the rows themselves while they are few."""
    if len(m) <= m.shape[1]:
        return m
    r = np.linalg.qr(m, "r")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def _full(m: np.ndarray) -> np.ndarray:
    """R as a square matrix, also of fewer rows than columns."""
    k = m.shape[1]
    return _reduced(np.vstack([m, np.zeros((k + 1, k))])) + 0.0


def triangular(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """``by``, r (array: the square factor R of A = Q R, row by row, diagonal not negative) and n, the rows of A.

    A group's rows may lie in any number of partitions. Each task reduces what it has of a group, 1024 rows at a time,
    to one small factor by Householder's reflections; factors are merged in a tree, MERGE at a time. So digits are lost
    by the condition of A alone, not by its square, and a group with most of the rows is spread over tasks. Rows with
    a null are left out.
    """
    return _triangular(df, by, columns).withColumnsRenamed({"__r": "r", "__n": "n"})


def _triangular(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    kinds, k = {f.name: f.dataType.simpleString() for f in df.schema.fields}, len(columns)
    schema = "".join(f"`{b}` {kinds[b]}, " for b in by) + "__task long, __n long, __r array<double>"
    own = df.select(*by, F.spark_partition_id().cast("long").alias("__task"), *[F.col(c).cast("double").alias(f"__c{n}") for n, c in enumerate(columns)]).where(" AND ".join(f"__c{n} IS NOT NULL" for n in range(k)))
    names = [*by, "__task", "__n", "__r"]

    def rows(found: dict) -> pa.Table:
        keys = list(found)
        columns = [pa.array([key[n] for key in keys], t) for n, t in enumerate(found.types)]
        return pa.table([*columns, pa.array([n for n, _ in found.values()], pa.int64()), pa.array([_reduced(m).ravel().tolist() for _, m in found.values()], pa.list_(pa.float64()))], names=names)

    class Found(dict):
        types: list

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found()
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            found.types = [batch.schema.field(n).type for n in range(len(by) + 1)]
            m = np.column_stack([batch.column(len(by) + 1 + n).to_numpy() for n in range(k)])
            keys = list(zip(*(batch.column(n).to_pylist() for n in range(len(by) + 1)), strict=True))
            places: dict = {}
            for at, key in enumerate(keys) if by else ():
                places.setdefault(key, []).append(at)
            for key, at in places.items() if by else ((keys[0], slice(None)),):
                part = m[at]
                for a in range(0, len(part), GATHER):
                    n, r = found.get(key, (0, np.zeros((0, k))))
                    piece = part[a : a + GATHER]
                    joined = np.vstack([r, piece])
                    held += len(piece)
                    found[key] = (n + len(piece), _reduced(joined) if len(joined) >= GATHER else joined)
            if held > HELD:
                yield from rows(found).to_batches()
                found, held = Found(), 0
        if found:
            yield from rows(found).to_batches()

    def merge(table: pa.Table) -> pa.Table:
        m = np.array(table["__r"].combine_chunks().flatten().to_pylist()).reshape(-1, k)
        while len(m) > GATHER:
            m = np.vstack([_reduced(m[a : a + GATHER]) for a in range(0, len(m), GATHER)])
        same = [table[c].take(pa.array([0])) for c in [*by, "__task"]]
        return pa.table([*same, pa.array([sum(table["__n"].to_pylist())], pa.int64()), pa.array([_reduced(m).ravel().tolist()], pa.list_(pa.float64()))], names=names)

    parts = own.mapInArrow(reduce, schema)
    for _ in range(2):  # up to MERGE factors a task, then the rest: 64 x 64 tasks, or 64 rows of them
        parts = parts.withColumn("__task", F.floor(F.col("__task") / MERGE).cast("long")).groupBy(*by, "__task").applyInArrow(merge, schema)
    last = parts.withColumn("__task", F.lit(0).cast("long")).groupBy(*by, "__task").applyInArrow(merge, schema)

    @F.arrow_udf("array<double>")
    def square(column: pa.Array) -> pa.Array:
        return pa.array([_full(np.array(r, float).reshape(-1, k)).ravel().tolist() for r in column.to_pylist()], pa.list_(pa.float64()))

    return last.select(*by, square("__r").alias("__r"), "__n")


def qr_tall(df: DataFrame, by: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(q, r) of one tall matrix a group. q: ``df`` with the columns of the matrix replaced by those of Q; r: ``by``, i,
    j, v. Rows with a null are left out; a matrix with dependent columns gives NaN.

    Rows of Q solve q R = a, column by column. They are orthonormal but for the condition of A; so Q is factored once
    more, and both factors are multiplied: two passes over the rows, where they lie.
    """
    k = len(columns)
    kept = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))

    def solved(rows: DataFrame, factor: DataFrame) -> DataFrame:
        own = factor.select(*by, F.col("__r").alias("__f"))
        out = rows.join(own, by) if by else rows.crossJoin(F.broadcast(own))  # a single row
        for j, c in enumerate(columns):
            above = sum((F.col(f"__q{m}") * F.col("__f")[m * k + j] for m in range(j)), F.lit(0.0))
            on = F.col("__f")[j * k + j]
            size = F.sqrt(sum((F.col("__f")[m * k + j] * F.col("__f")[m * k + j] for m in range(j + 1)), F.lit(0.0)))
            out = out.withColumn(f"__q{j}", F.when(on <= DEPENDENT * size, F.lit(float("nan"))).otherwise((F.col(c).cast("double") - above) / on))
        return out.select(*[c for c in df.columns if c not in columns], *[F.col(f"__q{j}").alias(c) for j, c in enumerate(columns)])

    first = stored(_triangular(kept, by, columns), "factors")
    rough = solved(kept, first)
    second = stored(_triangular(rough, by, columns), "factors")
    last = second.select(*by, F.col("__r").alias("__second"))
    pair = last.join(first, by) if by else last.crossJoin(F.broadcast(first))  # a single row
    cells = pair.select(*by, "__second", "__r", F.explode(F.sequence(F.lit(0), F.lit(k * k - 1))).alias("__at"))
    i, j = F.floor(F.col("__at") / k), F.col("__at") % k
    value = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(0.0), lambda acc, m: acc + F.get("__second", (i * k + m).cast("int")) * F.get("__r", (m * k + j).cast("int")))
    return solved(rough, second), cells.select(*by, i.cast("long").alias("i"), j.cast("long").alias("j"), value.alias("v"))


# Least squares: a long table with a column for each predictor


def _solved(k: int, constant: bool):
    """Coefficients and r2 from the factor of (predictors, response); with ``constant``, the first column is one, and its
    coefficient comes last."""
    kind = pa.struct([("coefficients", pa.list_(pa.float64())), ("r2", pa.float64())])

    def one(m: np.ndarray) -> dict:
        r, z, rest = m[:k, :k], m[:k, k], m[k, k] ** 2
        size = np.sqrt((r * r).sum(0))
        dependent = (np.diag(r) <= DEPENDENT * size).any()
        own = np.full(k, np.nan) if dependent else np.linalg.solve(r / size, z) / size
        total = (m[1:, k] ** 2).sum() if constant else np.nan
        if total <= (1e-13 * np.abs(m[:, k]).max(initial=0)) ** 2:
            r2 = 1.0  # a constant response
        else:
            r2 = min(1.0, max(0.0, 1 - rest / total))
        return {"coefficients": [*own[1:], own[0]] if constant else own.tolist(), "r2": None if dependent else float(r2)}

    @F.arrow_udf("struct<coefficients:array<double>,r2:double>")
    def run(column: pa.Array) -> pa.Array:
        with np.errstate(all="ignore"):
            return pa.array([one(np.array(r, float).reshape(k + 1, k + 1)) for r in column.to_pylist()], kind)

    return run


def _fitted(df: DataFrame, by: list[str], predictors: list[str], response: str, constant: bool) -> DataFrame:
    if not predictors:
        raise ValueError("there must be a predictor")
    names = ["__one"] * constant + predictors + [response]
    own = _triangular(df.withColumn("__one", F.lit(1.0)) if constant else df, by, names)
    k = len(names) - 1
    enough = F.assert_true(F.col("__n") >= k, F.lit("fewer rows than columns")).isNull()
    return own.select(*by, F.when(enough, _solved(k, constant)("__r")).alias("__f"))


def ols(df: DataFrame, by: list[str], predictors: list[str], response: str) -> DataFrame:
    """``by`` and coefficients (array, a number a predictor), from the factor of (predictors, response): one pass.

    A group with fewer rows than predictors is an error; dependent predictors give NaN; rows with a null are left out.
    """
    return _fitted(df, by, predictors, response, False).select(*by, F.col("__f.coefficients").alias("coefficients"))


def ols_regress(df: DataFrame, by: list[str], predictors: list[str], response: str) -> DataFrame:
    """``by``, coefficients (the intercept is the last one) and r2, in one pass: below the row of the constant, the last
    column of the factor has the response's sum of squares about its mean, and its last element what isn't explained.
    A constant response has an r2 of 1."""
    return _fitted(df, by, predictors, response, True).select(*by, "__f.coefficients", "__f.r2")


def r_square(df: DataFrame, by: list[str], predictors: list[str], response: str, fitted: DataFrame) -> DataFrame:
    """``fitted`` (``by``, coefficients) with r2: 0 for a fit worse than the mean; for a constant response, 1 if the
    fit is perfect and else 0."""
    keys = df.groupBy(*by).agg(F.avg(response).alias("__m"))
    own = keys.join(fitted, by) if by else keys.crossJoin(F.broadcast(fitted))  # a single row
    joined = df.join(own, by) if by else df.crossJoin(F.broadcast(own))  # a single row
    predicted = None
    for n, p in enumerate(predictors):
        term = F.col("coefficients")[n] * F.col(p)
        predicted = term if predicted is None else predicted + term
    e, d = F.col(response) - predicted, F.col(response) - F.col("__m")
    sums = joined.groupBy(*by).agg(F.sum(e * e).alias("r"), F.sum(d * d).alias("t"))
    own = fitted.join(sums, by) if by else fitted.crossJoin(F.broadcast(sums))  # a single row
    r2 = 1 - F.col("r") / F.when(F.col("t") != 0, F.col("t"))
    value = F.when(F.col("t") == 0, F.when(F.col("r") == 0, 1.0).otherwise(0.0)).when((r2 >= 0) & (r2 <= 1), r2).otherwise(0.0)
    return own.select(*by, "coefficients", value.alias("r2"))


def balance(parts: int, items: int) -> list[int]:
    """Items dealt over parts as evenly as can be."""
    q, r = divmod(items, parts)
    return [q + (n < r) for n in range(parts)]


def interval_places(n: int, significance: float, clamped: bool) -> tuple[int, int]:
    """The places in n sorted replicates of the ends of a percentile interval: halves round to even."""
    c = n * significance / 2
    low, high = round(c), math.trunc(n - c)
    return (min(max(low, 0), n - 1), min(max(high, 0), n - 1)) if clamped else (low, high)
