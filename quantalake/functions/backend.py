"""The same formulas over columns and over NumPy arrays.

A distribution writes each function once, in terms of a backend: ``Columns`` builds Catalyst expressions (special
functions go through Arrow), ``Arrays`` computes at once on the driver or within a task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from quantalake.functions import ieee, special


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


class Columns:
    @staticmethod
    def value(x) -> Column:
        return (F.col(x) if isinstance(x, str) else _c(x)).cast("double")

    @staticmethod
    def where(condition, a, b) -> Column:
        return F.when(condition, _c(a)).otherwise(_c(b)) if isinstance(condition, Column) else _c(a if condition else b)

    exp = staticmethod(lambda x: F.exp(_c(x)))
    log = staticmethod(lambda x: ieee.ln(_c(x)))
    expm1 = staticmethod(lambda x: F.expm1(_c(x)))
    sqrt = staticmethod(lambda x: ieee.sqrt(_c(x)))
    floor = staticmethod(lambda x: F.when(F.abs(_c(x)) < 1e15, F.floor(_c(x)).cast("double")).otherwise(_c(x)))
    abs = staticmethod(lambda x: F.abs(_c(x)))
    atan = staticmethod(lambda x: F.atan(_c(x)))
    tan = staticmethod(lambda x: F.tan(_c(x)))
    power = staticmethod(lambda x, y: F.pow(_c(x), _c(y)))
    divide = staticmethod(lambda a, b: ieee.divide(_c(a), _c(b)))
    isnan = staticmethod(lambda x: F.isnan(_c(x)))

    @staticmethod
    def log1p(x) -> Column:
        x = _c(x)
        return F.when(x > -1, F.log1p(F.when(x > -1, x))).when(x == -1, F.lit(-ieee.INF)).otherwise(F.lit(ieee.NAN))

    lgamma = staticmethod(lambda x: special.column(special.lgamma, x))
    gamma_p = staticmethod(lambda a, x: special.column(special.gamma_p, a, x))
    gamma_q = staticmethod(lambda a, x: special.column(special.gamma_q, a, x))
    gamma_p_inverse = staticmethod(lambda a, p: special.column(special.gamma_p_inverse, a, p))
    beta_i = staticmethod(lambda a, b, x: special.column(special.beta_i, a, b, x))
    beta_i_inverse = staticmethod(lambda a, b, p: special.column(special.beta_i_inverse, a, b, p))
    erfc = staticmethod(lambda x: special.erfc_by(Columns, _c(x)))
    erfc_inverse = staticmethod(lambda p: special.column(special.erfc_inverse, p))

    @staticmethod
    def probability(p, value) -> Column:
        p = _c(p)
        return F.when((p >= 0) & (p <= 1), value).when(p.isNotNull(), F.raise_error(F.lit("a probability must be in [0,1]")).cast("double"))

    @staticmethod
    def number(x, value) -> Column:
        return F.when(~F.isnan(_c(x)), value).when(_c(x).isNotNull(), F.raise_error(F.lit("NaN is not an outcome")).cast("double"))

    @staticmethod
    def call(f, *args) -> Column:
        return special.column(f, *args)


class Arrays:
    @staticmethod
    def value(x):
        return np.asarray(x, float)

    @staticmethod
    def where(condition, a, b):
        return np.where(condition, a, b)

    exp, expm1, floor, abs, atan, tan, power, isnan = np.exp, np.expm1, np.floor, np.abs, np.arctan, np.tan, np.power, np.isnan
    log, log1p, sqrt, divide = np.log, np.log1p, np.sqrt, np.divide
    lgamma, gamma_p, gamma_q, gamma_p_inverse = special.lgamma, special.gamma_p, special.gamma_q, special.gamma_p_inverse
    beta_i, beta_i_inverse, erfc, erfc_inverse = special.beta_i, special.beta_i_inverse, special.erfc, special.erfc_inverse

    @staticmethod
    def probability(p, value):
        if not np.all((np.asarray(p) >= 0) & (np.asarray(p) <= 1)):
            raise ValueError("a probability must be in [0,1]")
        return value

    @staticmethod
    def number(x, value):
        if np.isnan(x).any():
            raise ValueError("NaN is not an outcome")
        return value

    @staticmethod
    def call(f, *args):
        return f(*args)
