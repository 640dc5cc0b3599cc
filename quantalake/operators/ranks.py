"""Ranks, order values and cumulative counts that no single task has to compute for a whole group.

A sample is first summed by distinct value. Tables of more than ROWS rows are cut into ranges of about as many, at
approximate quantiles of the whole column; running sums within a (group, range) and of the ranges' totals within a group
give running sums over the group. So a group with a third of all rows is spread over as many tasks as there are ranges.
Smaller tables are one range.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cmp_to_key, wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a range, and the most ranges: beyond RANGES * ROWS rows, ranges grow (their sorts spill).
ROWS, RANGES = 1 << 20, 10_000


def _number(df: DataFrame, x: str) -> Column:
    """A column of numbers, dates or times as doubles."""
    return (F.unix_date(x) if isinstance(df.schema[x].dataType, T.DateType) else F.col(x)).cast("double")


def cut_points(df: DataFrame, x: str, rows: int | None = None) -> list[float]:
    """Approximate quantiles that cut a column into ranges of about ``rows`` (ROWS) rows: none for a smaller table, and
    never more than RANGES - 1, which is all that comes to the driver."""
    n = df.agg(F.count(x)).first()[0]
    ranges = min(RANGES, -(-n // (rows or ROWS)))
    if ranges < 2:
        return []
    own = df.agg(F.percentile_approx(_number(df, x), [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
    return sorted({v for v in own or [] if v == v})


def range_of(x: Column, points: list[float] | Column, most: int | None = None) -> Column:
    """How many of the rising ``points`` are below x, by halving; ``most``: their largest number, for a column of them."""
    most = len(points) if isinstance(points, list) else most
    if not most:
        return F.lit(0)
    array = F.array(*[F.lit(float(p)) for p in points]) if isinstance(points, list) else points
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(most.bit_length()))])
    value = x.cast("double")
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(array, at + step - 1) < value, at + step).otherwise(at))


def running(df: DataFrame, by: list[str], x: str, sums: dict[str, str], points: list[float] | None = None) -> DataFrame:
    """``df`` with running sums, before each row, in the order of ``x`` within ``by``.

    ``sums``: new column -> column that is summed. ``x`` must be unique within a group (sum by distinct value first).
    """
    points = cut_points(df, x) if points is None else points
    if not points:  # at most ROWS rows
        whole = Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
        return df.select("*", *[F.coalesce(F.sum(c).over(whole), F.lit(0)).alias(n) for n, c in sums.items()])
    cut = df.withColumn("__range", range_of(_number(df, x), points))
    totals = cut.groupBy(*by, "__range").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    bases = totals.select(*by, "__range", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums])
    within = Window.partitionBy(*by, "__range").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    own = cut.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"__w_{n}") for n, c in sums.items()])
    out = own.join(bases, [*by, "__range"])
    return out.withColumns({n: F.col(f"__w_{n}") + F.col(f"__b_{n}") for n in sums}).drop("__range", *[f"__{k}_{n}" for n in sums for k in "wb"])


def numbers(df: DataFrame, x: str) -> DataFrame:
    """The rows with a value, as a double; NaN is an error."""
    value = F.col(x).cast("double")
    return df.where(F.col(x).isNotNull()).withColumn(x, F.when(F.isnan(value), F.raise_error(F.lit("the sample has NaN")).cast("double")).otherwise(value + 0.0))


def values(df: DataFrame, by: list[str], x: str, *counts: Column) -> DataFrame:
    """``by``, x, n (rows of that value) and further aggregates; nulls are left out, NaN is an error."""
    return numbers(df, x).groupBy(*by, x).agg(F.count("*").alias("n"), *counts)


def value_ranks(df: DataFrame, by: list[str], x: str, *counts: Column) -> DataFrame:
    """``values`` with the 1-based ``rank`` of each value, averaged over ties."""
    own = running(values(df, by, x, *counts), by, x, {"before": "n"}, cut_points(df, x))
    return own.withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)


def with_ranks(df: DataFrame, by: list[str], x: str, out: str = "rank") -> DataFrame:
    """``df`` with the average rank of each row's value within ``by``."""
    points = cut_points(df, x)
    if not points:  # at most ROWS rows: peers are counted where they are sorted
        order = Window.partitionBy(*by).orderBy("__v")
        peers = Window.partitionBy(*by, "__v")
        own = numbers(df.withColumn("__v", F.col(x)), "__v")
        return own.withColumn(out, F.rank().over(order) + (F.count("*").over(peers) - 1) / 2).drop("__v")
    own = running(values(df, by, x), by, x, {"__before": "n"}, points)
    own = own.select(*by, F.col(x).alias("__v"), (F.col("__before") + (F.col("n") + 1) / 2).alias(out))
    return df.withColumn("__v", F.col(x).cast("double") + 0.0).join(own, [*by, "__v"]).drop("__v")


def apart(f: Callable) -> Callable:
    """A function of (df, by, ...) that gives group columns names of their own while it works, so that those of its
    working columns (n, rank, size) are free for groups. An error if a group has the name of a column that it returns."""

    @wraps(f)
    def run(df: DataFrame, by: list[str], *args, **options) -> DataFrame:
        names = {b: f"__by_{n}" for n, b in enumerate(by)}
        out = f(df.withColumnsRenamed(names), list(names.values()), *args, **options)
        if taken := [b for b in by if b in set(out.columns) - set(names.values())]:
            raise ValueError(f"a group has the name of a result: {', '.join(taken)}")
        return out.withColumnsRenamed({own: b for b, own in names.items()})

    return run


def custom_order(df: DataFrame, x: str, compare: Callable[[object, object], int], most: int = 100_000) -> DataFrame:
    """(x, place): a number a distinct value that rises as ``compare`` (negative, zero or positive for two values, as
    ``functools.cmp_to_key`` takes it) has it; values that compare equal share one. For ranks, sorts and equivalences
    of one's own: join it, and use the place. An error beyond ``most`` distinct values, as they are sorted on the
    driver; orders of more values need a key that a column expression gives."""
    found = [r[0] for r in df.select(x).where(F.col(x).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} distinct values")
    rows, place = [], -1
    for v in sorted(found, key=cmp_to_key(compare)):
        place += not rows or compare(rows[-1][0], v) != 0
        rows.append((v, place))
    kind = T.StructType([T.StructField(x, df.schema[x].dataType), T.StructField("place", T.LongType())])
    return df.sparkSession.createDataFrame(rows, kind)


def ranks_by(df: DataFrame, by: list[str], x: str, key: Column | Callable[[object, object], int], out: str = "rank") -> DataFrame:
    """``df`` with the average rank of each row in an order of one's own: by a key (a number, or a date or time, that
    rises with the order; equal keys are ties), or by a comparison of two values. Nulls of ``x`` are left out."""
    if isinstance(key, Column):
        return with_ranks(df.where(F.col(x).isNotNull()).withColumn("__key", key), by, "__key", out).drop("__key")
    places = custom_order(df, x, key)
    small = places.select(F.col(x).alias("__own"), F.col("place").alias("__key"))
    joined = df.join(F.broadcast(small), F.col(x) == F.col("__own")).drop("__own")  # at most 100,000 distinct values
    return with_ranks(joined, by, "__key", out).drop("__key")


def top_k(df: DataFrame, by: list[str], x: str, k: int) -> DataFrame:
    """The k smallest rows of each group, with their 1-based ``nth``; one bounded list a task and group."""
    w = Window.partitionBy(*by).orderBy(x)
    return df.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)


def indexed(df: DataFrame, by: list[str], order: str, out: str = "idx") -> DataFrame:
    """``df`` with the 0-based place in the order of ``order``, which must be unique within a group."""
    return running(df.withColumn("__one", F.lit(1)), by, order, {out: "__one"}).drop("__one")


def split_by_tag(tag: Column, value: Column) -> tuple[Column, Column]:
    """The sums of a value over rows with the tag and without."""
    return F.sum(F.when(tag, value)), F.sum(F.when(~tag, value))


def min_max(x: str) -> Column:
    return F.struct(F.min(x).alias("min"), F.max(x).alias("max"))


def next_power_of_two(n: int) -> int:
    """The least power of two that isn't below n; 0 for n <= 0."""
    return 0 if n <= 0 else 1 << (n - 1).bit_length()


def within(ulps: int, a: float, b: float) -> bool:
    """Whether two doubles are at most so many representable numbers apart."""
    import numpy as np

    x, y = (int(np.float64(v).view(np.int64)) for v in (a, b))
    x, y = (v if v >= 0 else -(v & 0x7FFFFFFFFFFFFFFF) for v in (x, y))
    return abs(x - y) <= ulps


def square(x: Column) -> Column:
    return x * x
