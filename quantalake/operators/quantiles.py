"""Continuous quantiles of all groups at once, by selection.

The estimators differ in two parameters: with p = k/q and h = alpha + p (n + 1 - alpha - beta), the quantile lies between
the floor(h)-th and the next value, in the proportion of the fraction of h. Rows are counted by group and range of
values (see ``ranks``); only those in the ranges that hold the wanted places are then put in order. So no group is
gathered or sorted in one task, and most rows are never shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantalake.operators.ranks import cut_points, numbers, range_of


class ContParam(NamedTuple):
    alpha: float
    beta: float


CADPW, HAZEN, SPSS, S = ContParam(0, 1), ContParam(0.5, 0.5), ContParam(0, 0), ContParam(1, 1)
MEDIAN_UNBIASED, NORMAL_UNBIASED = ContParam(1 / 3, 1 / 3), ContParam(3 / 8, 3 / 8)


def _checked(k: int, q: int) -> None:
    if q < 2:
        raise ValueError("there must be at least two quantiles")
    if not 0 <= k <= q:
        raise ValueError(f"k must be from 0 to {q}: {k}")


def quantiles(df: DataFrame, by: list[str], x: str, ks: list[int], q: int, param: ContParam = S, times: str | None = None) -> DataFrame:
    """``by`` and an array ``quantiles``: the k-th q-quantiles for ``ks``, in their order. ``times``: a column that says how
    often a row's value stands there, for samples that are kept as counts.

    Nulls are left out; NaN is an error; a group without values has no row.
    """
    for k in ks:
        _checked(k, q)
    points = cut_points(df, x)
    own, every = numbers(df, x).select(*by, F.col(x).alias("__x"), (F.lit(1) if times is None else F.col(times)).cast("long").alias("__t")), Window.partitionBy(*by)
    places = []  # of each quantile: two places and what part of the second
    for k in ks:
        h = F.lit(param.alpha) + F.lit(k / q) * (F.col("__size") + 1 - param.alpha - param.beta)
        whole = h.cast("long")  # towards zero
        places.append((*(F.least(F.greatest(i, F.lit(0)), F.col("__size") - 1) for i in (whole - 1, whole)), h - whole))
    held = lambda i: (F.col("__from") <= i) & (i < F.col("__from") + F.col("__n"))
    if points:
        own = own.withColumn("__range", range_of(F.col("__x"), points))
        ranges = own.groupBy(*by, "__range").agg(F.sum("__t").alias("__n"))  # a row a group and range
        placed = ranges.select("*", (F.sum("__n").over(every.orderBy("__range")) - F.col("__n")).alias("__from"), F.sum("__n").over(every).alias("__size"))
        wanted = placed.where(F.exists(F.array(*[i for low, high, _ in places for i in (low, high)]), held))
        chosen = own.join(wanted.withColumnRenamed("__from", "__before").drop("__n"), [*by, "__range"])
        counted = chosen.groupBy(*by, "__range", "__before", "__size", "__x").agg(F.sum("__t").alias("__n"))
        within = F.sum("__n").over(Window.partitionBy(*by, "__range").orderBy("__x")) - F.col("__n")
        ranked = counted.withColumn("__from", F.col("__before") + within)
    elif times is not None:
        counted = own.groupBy(*by, "__x").agg(F.sum("__t").alias("__n")).where("__n > 0")
        ranked = counted.select("*", (F.sum("__n").over(every.orderBy("__x")) - F.col("__n")).alias("__from"), F.sum("__n").over(every).alias("__size"))
    else:  # at most ROWS rows
        ranked = own.select("*", F.lit(1).alias("__n"), F.row_number().over(every.orderBy("__x")).alias("__to"), F.count("*").over(every).alias("__size")).withColumn("__from", F.col("__to") - 1)
    out = [F.sum(F.when(held(low), (1 - part) * F.col("__x")).otherwise(0.0) + F.when(held(high), part * F.col("__x")).otherwise(0.0)) for low, high, part in places]
    return ranked.groupBy(*by).agg(F.array(*out).cast("array<double>").alias("quantiles"), F.count("*").alias("__n")).where("__n > 0").drop("__n")


def quantile(df: DataFrame, by: list[str], x: str, k: int, q: int, param: ContParam = S) -> DataFrame:
    """``by`` and ``quantile``."""
    return quantiles(df, by, x, [k], q, param).select(*by, F.col("quantiles")[0].alias("quantile"))


continuous_by = quantile


def weighted_avg(df: DataFrame, by: list[str], x: str, k: int, q: int) -> DataFrame:
    """The weighted average of the neighbours of n k/q: the estimator ``S``."""
    return quantile(df, by, x, k, q, S)


def median(df: DataFrame, by: list[str], x: str, param: ContParam = S) -> DataFrame:
    return quantile(df, by, x, 1, 2, param).withColumnRenamed("quantile", "median")


def midspread(df: DataFrame, by: list[str], x: str, k: int, param: ContParam = S) -> DataFrame:
    """The distance between the first and last but one of k-quantiles: for 4, the interquartile range."""
    if k < 1:
        raise ValueError("k must be positive")
    own = quantiles(df, by, x, [1, k - 1], k, param)
    return own.select(*by, (F.col("quantiles")[1] - F.col("quantiles")[0]).alias("midspread"))


def mad(df: DataFrame, by: list[str], x: str, param: ContParam = S) -> DataFrame:
    """The median absolute deviation from the median, not scaled."""
    centre = median(df, by, x, param)
    joined = df.join(centre, by) if by else df.crossJoin(F.broadcast(centre))  # a single row
    return median(joined.withColumn("__d", F.abs(F.col(x) - F.col("median"))), by, "__d", param).withColumnRenamed("median", "mad")


def fit_laplace(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """``by``, location (the median) and scale (the mean absolute deviation from it) of a Laplace distribution."""
    centre = median(df, by, x, MEDIAN_UNBIASED)
    joined = df.join(centre, by) if by else df.crossJoin(F.broadcast(centre))  # a single row
    return joined.groupBy(*by).agg(F.max("median").alias("location"), F.avg(F.abs(F.col(x) - F.col("median"))).alias("scale"))
