"""Special functions on NumPy arrays, and as column functions (Arrow batches)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY, STEPS = 1e-300, 400
EULER = 0.5772156649015329

def _lgamma(x: float) -> float:
    return math.lgamma(x) if x > 0 or x != math.floor(x) else math.inf


_lgamma_all = np.vectorize(_lgamma, otypes=[float])


def lgamma(x):
    return _lgamma_all(x)


#: Cody's rational approximations (1969) of erf to 15/32, of erfc to 4, and of erfc beyond, by falling
#: powers; numerators and denominators.
NEAR = (
    [1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3],
    [1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3],
)
MIDDLE = (
    [2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3],
    [1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3],
)
FAR = (
    [1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4],
    [1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3],
)


def _ratio(parts: tuple[list[float], list[float]], x):
    up, down = parts
    a, b = up[0], down[0]
    for c, d in zip(up[1:], down[1:], strict=True):
        a, b = a * x + c, b * x + d
    return a / b


def erfc_by(m, x):
    """erfc of a column or an array, by a backend's where, exp, floor and abs: arithmetic alone."""
    y = m.abs(x)
    near = 1 - x * _ratio(NEAR, x * x)
    # exp(-y**2) without the rounding of the square: y is cut behind the fourth binary place
    y = m.where(y < 27.3, y, 27.3)  # beyond, it is zero
    cut = m.floor(y * 16) / 16
    falls = m.exp(-(cut * cut)) * m.exp(-((y - cut) * (y + cut)))
    inverse = 1 / m.where(y > 0.1, y * y, 1.0)
    far = falls * (0.5641895835477563 - inverse * _ratio(FAR, inverse)) / m.where(y > 0.1, y, 1.0)  # 1 / sqrt(pi)
    above = m.where(y <= 4, falls * _ratio(MIDDLE, y), far)
    return m.where(m.abs(x) <= 0.46875, near, m.where(x > 0, above, 2 - above))


class _Arrays:
    where, exp, floor, abs = np.where, np.exp, np.floor, np.abs


def erfc(x):
    x = np.asarray(x, float)
    with np.errstate(all="ignore"):
        return np.where(np.isnan(x), np.nan, erfc_by(_Arrays, x))


def erf(x):
    x = np.asarray(x, float)
    with np.errstate(all="ignore"):
        return np.where(np.abs(x) <= 0.46875, x * _ratio(NEAR, x * x), 1 - erfc(x))


def digamma(x):
    """Recurrence up to 8, then the asymptotic series; reflection for negative x."""
    x = np.asarray(x, float)
    out, y = np.zeros_like(x), x.copy()
    low = y <= 0
    y = np.where(low, 1 - y, y)
    for _ in range(8):
        small = y < 8
        out = np.where(small, out - 1 / y, out)
        y = np.where(small, y + 1, y)
    s = 1 / (y * y)
    out = out + np.log(y) - 0.5 / y - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s * (1 / 132)))))
    with np.errstate(all="ignore"):
        return np.where(low, out - math.pi / np.tan(math.pi * x), out)


def _gamma_both(a, x):
    """Lower and upper regularised incomplete gamma: series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    lower, upper = np.zeros(a.shape), np.ones(a.shape)
    nan, top = np.isnan(x) | np.isnan(a) | (a < 0), np.isposinf(x)
    inside = (x > 0) & ~top & ~nan & (a > 0)
    with np.errstate(all="ignore"):
        head = np.exp(a * np.log(np.where(inside, x, 1)) - x - lgamma(np.where(a > 0, a, 1)))
    s = inside & (x < a + 1)
    if s.any():
        term = 1 / a[s]
        total, n = term.copy(), a[s].copy()
        for _ in range(20 * STEPS):
            n += 1
            term = term * x[s] / n
            total += term
            if (np.abs(term) < 1e-17 * np.abs(total)).all():
                break
        lower[s] = np.minimum(1, total * head[s])
        upper[s] = 1 - lower[s]
    c = inside & ~s
    if c.any():
        b = x[c] + 1 - a[c]
        f = np.full(b.shape, 1 / TINY)
        d = 1 / b
        h = d.copy()
        for i in range(1, 20 * STEPS):
            an = -i * (i - a[c])
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < TINY, TINY, d)
            f = b + an / f
            f = np.where(np.abs(f) < TINY, TINY, f)
            step = d * f
            h = h * step
            if (np.abs(step - 1) < 5e-16).all():
                break
        upper[c] = np.clip(h * head[c], 0, 1)
        lower[c] = 1 - upper[c]
    whole = (top | ((a == 0) & (x >= 0))) & ~nan
    lower, upper = np.where(whole, 1.0, lower), np.where(whole, 0.0, upper)
    return np.where(nan, np.nan, lower), np.where(nan, np.nan, upper)


def gamma_p(a, x):
    return _gamma_both(a, x)[0]


def gamma_q(a, x):
    return _gamma_both(a, x)[1]


def log_beta(a, b):
    return lgamma(a) + lgamma(b) - lgamma(np.asarray(a, float) + b)


def _log_beta_wide(a, b):
    """log B(a, b), without cancellation where one argument is large."""
    small, large = np.minimum(a, b), np.maximum(a, b)
    plain = log_beta(a, b)
    with np.errstate(all="ignore"):
        wide = np.where(large > 1e4, lgamma(small) - small * np.log(large) + small * (1 - small) / (2 * large), plain)
    return np.where((large > 1e4) & (small * small < 1e-3 * large), wide, plain)


def beta_i(a, b, x):
    """Regularised incomplete beta by Lentz's continued fraction, on the side where it converges fast."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    nan = np.isnan(a) | np.isnan(b) | np.isnan(x) | (a < 0) | (b < 0)
    inside = (x > 0) & (x < 1) & ~nan & (a > 0) & (b > 0)
    out = np.where(x >= 1, 1.0, 0.0)
    if inside.any():
        p, q, z = a[inside], b[inside], x[inside]
        turn = z > (p + 1) / (p + q + 2)
        p, q, z = np.where(turn, q, p), np.where(turn, p, q), np.where(turn, 1 - z, z)
        other = np.where(turn, x[inside], 1 - x[inside])
        head = np.exp(p * np.log(z) + q * np.log(other) - _log_beta_wide(p, q)) / p
        c = np.ones(p.shape)
        d = 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < TINY, TINY, d)
        h = d.copy()
        for m in range(1, 20 * STEPS):
            for up in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + up * d
                d = 1 / np.where(np.abs(d) < TINY, TINY, d)
                c = 1 + up / c
                c = np.where(np.abs(c) < TINY, TINY, c)
                h = h * d * c
            if (np.abs(d * c - 1) < 5e-16).all():
                break
        part = np.clip(head * h, 0, 1)
        out[inside] = np.where(turn, 1 - part, part)
    return np.where(nan, np.nan, out)


def _solve(f: Callable, density: Callable, p, low, high, steps: int = 1200):
    """The x from low to high where the rising f reaches p: Newton steps, or halving where one leaves the bracket.

    Halving is geometric where the bracket spans orders of magnitude. Elements that have settled are left alone.
    """
    p, low, high = (np.array(v, float).ravel() for v in np.broadcast_arrays(p, low, high))
    x, todo, last = _halve(low, high), np.arange(len(p)), np.full(len(p), np.inf)
    for _ in range(steps):
        if not len(todo):
            break
        own = x[todo]
        error = f(own, todo) - p[todo]
        low[todo], high[todo] = np.where(error < 0, own, low[todo]), np.where(error >= 0, own, high[todo])
        with np.errstate(all="ignore"):
            new = own - error / density(own, todo)
        half = _halve(low[todo], high[todo])
        good = (new > low[todo]) & (new < high[todo]) & (np.abs(new - own) < 0.5 * last[todo])
        new = np.where(good, new, half)
        last[todo] = np.abs(new - own)
        x[todo] = new
        settled = (error == 0) | (np.abs(new - own) <= 4e-16 * np.abs(own)) | (half <= low[todo]) | (half >= high[todo])
        x[todo[error == 0]] = own[error == 0]
        todo = todo[~settled]
    return x


def _halve(low, high):
    with np.errstate(all="ignore"):
        mid = low + (high - low) / 2
        mid = np.where((low > 0) & (high > 4 * low), np.sqrt(low) * np.sqrt(high), mid)
        return np.where((low == 0) & (high < 1e-2), high * 1e-3, mid)


def gamma_p_inverse(a, p):
    a, p = np.broadcast_arrays(np.asarray(a, float), np.asarray(p, float))
    inside = (p > 0) & (p < 1)
    q = np.where(inside, p, 0.5)
    high = np.maximum(a, 1.0)
    while (short := gamma_p(a, high) < q).any():
        high = np.where(short, 2 * high, high)
    k = a.ravel()
    x = _solve(lambda x, n: gamma_p(k[n], x), lambda x, n: np.exp((k[n] - 1) * np.log(x) - x - lgamma(k[n])), q, 0.0, high).reshape(a.shape)
    return np.where(inside, x, np.where(p == 0, 0.0, np.where(p == 1, np.inf, np.nan)))


def beta_i_inverse(a, b, p):
    a, b, p = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, p)))
    inside = (p > 0) & (p < 1)
    c, d = a.ravel(), b.ravel()
    slope = lambda x, n: np.exp((c[n] - 1) * np.log(x) + (d[n] - 1) * np.log1p(-x) - _log_beta_wide(c[n], d[n]))
    x = _solve(lambda x, n: beta_i(c[n], d[n], x), slope, np.where(inside, p, 0.5), 0.0, 1.0).reshape(a.shape)
    return np.where(inside, x, np.where(p == 0, 0.0, np.where(p == 1, 1.0, np.nan)))


def erfc_inverse(p):
    """The x with erfc(x) = p, 0 <= p <= 2."""
    p = np.asarray(p, float)
    inside = (p > 0) & (p < 2)
    small = np.where(inside, np.where(p > 1, 2 - p, p), 0.5)  # the tail with a positive x
    x = _solve(lambda x, n: -erfc(x), lambda x, n: 2 / math.sqrt(math.pi) * np.exp(-x * x), -small, 0.0, 27.3).reshape(p.shape)
    return np.where(inside, np.where(p > 1, -x, x), np.where(p == 0, np.inf, np.where(p == 2, -np.inf, np.nan)))


def choose(n: int, k: int) -> float:
    return float(math.comb(n, k)) if 0 <= k <= n else 0.0


def column(f: Callable, *args: Column | float) -> Column:
    """``f`` of columns of doubles, a batch at a time; where an argument is null so is the result."""

    @F.pandas_udf("double")
    def run(*own: pd.Series) -> pd.Series:
        values = [x.to_numpy(float, na_value=np.nan) for x in own]
        with np.errstate(all="ignore"):
            out = np.asarray(f(*values), float)
        missing = np.logical_or.reduce([x.isna().to_numpy() & ~np.isnan(v) if x.dtype == object else np.zeros(len(x), bool) for x, v in zip(own, values, strict=True)])
        return pd.Series(np.where(missing, np.nan, out))

    columns = [x if isinstance(x, Column) else F.lit(float(x)) for x in args]
    known = columns[0].isNotNull()
    for x in columns[1:]:
        known &= x.isNotNull()
    return F.when(known, run(*[F.coalesce(x.cast("double"), F.lit(0.0)) for x in columns]))
