"""Arithmetic of IEEE doubles where Spark raises or gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def col(x: Column | str | float) -> Column:
    """A column by its name, a column as it is, or a literal."""
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def divide(a: Column | float, b: Column | float) -> Column:
    """a / b with NaN for 0/0 and signed infinity for others over 0; null if either is null."""
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.coalesce(F.try_divide(a, b), a * F.pow(F.abs(b), F.lit(-1.0)))


def ln(x: Column | float) -> Column:
    """log with -inf at 0 and NaN below."""
    x = col(x).cast("double")
    return F.when(x > 0, F.ln(F.when(x > 0, x))).when(x == 0, F.lit(-INF)).when(x < 0, F.lit(NAN)).when(F.isnan(x), F.lit(NAN))


def sqrt(x: Column | float) -> Column:
    x = col(x).cast("double")
    return F.when(x >= 0, F.sqrt(F.when(x >= 0, x))).when(x.isNotNull(), F.lit(NAN))


def require(condition: Column, value: Column, message: str) -> Column:
    """``value`` where the condition holds; an error elsewhere."""
    return F.when(condition, value).otherwise(F.raise_error(F.lit(message)).cast("double"))
