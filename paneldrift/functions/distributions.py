"""Distribution functions for the last, k-row step of a test.

The scans, sums and ranks behind a statistic are Spark aggregates; only the handful of finished
statistics passes through these Arrow-batched functions. ``normal_quantile`` is needed per row and is
therefore a plain column expression.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import col

# Ship the helpers with the function, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- Fixed values: coefficients of the published rational approximation AS 241 (double precision) ---

CENTRE_TOP = (
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
    4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3,
)
CENTRE_BOTTOM = (
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3,
)
MIDDLE_TOP = (
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
    1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4,
)
MIDDLE_BOTTOM = (
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9,
)
TAIL_TOP = (
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
    2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7,
)
TAIL_BOTTOM = (
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15,
)

# --- End of fixed values ---


def _horner(x: Column, coefficients) -> Column:
    value = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        value = value * x + F.lit(c)
    return value


def normal_quantile(p: str | Column) -> Column:
    """Standard normal quantile, null outside (0, 1)."""
    p = col(p)
    q = p - 0.5
    near = F.lit(0.180625) - q * q
    centre = q * _horner(near, CENTRE_TOP) / _horner(near, CENTRE_BOTTOM)
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    middle = _horner(r - 1.6, MIDDLE_TOP) / _horner(r - 1.6, MIDDLE_BOTTOM)
    tail = _horner(r - 5.0, TAIL_TOP) / _horner(r - 5.0, TAIL_BOTTOM)
    outer = F.when(r <= 5.0, middle).otherwise(tail)
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, centre).otherwise(F.signum(q) * outer))


# Panels that double in length, so that a steep or nearly singular start is resolved, with Gauss-Legendre nodes in each.
PANELS, NODES = 12, 20
#: Rows that are worked on at a time; each takes PANELS x NODES numbers.
ROWS = 4096


def _panels() -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights on (0, 1)."""
    x, w = np.polynomial.legendre.leggauss(NODES)
    edges = (2.0 ** np.arange(PANELS + 1) - 1) / (2.0**PANELS - 1)
    size = np.diff(edges)[:, None]
    return (edges[:-1, None] + size * (x + 1) / 2).ravel(), (size * w / 2).ravel()


def falling_integral(g, reach: np.ndarray) -> np.ndarray:
    """Integral of exp(g(s)) over s > 0 for each row, g falling from 0.

    ``reach`` is a first guess of where the integrand has fallen by exp(-45); it is doubled until that holds.
    """
    reach = reach.copy()
    for _ in range(200):
        near = g(reach[:, None])[:, 0] > -45.0
        if not near.any():
            break
        reach[near] *= 2.0
    else:
        raise ArithmeticError("the integrand does not fall")
    nodes, weights = _panels()
    return reach * (np.exp(g(reach[:, None] * nodes)) @ weights)


def stirling_rest(z: np.ndarray) -> np.ndarray:
    """log gamma(z) minus (z - 1/2) log z - z + log(2 pi) / 2, to full precision for z > 0."""
    z = np.asarray(z, float)
    rest = np.zeros_like(z)
    while (low := z < 12.0).any():  # gamma(z) = gamma(z + 1) / z
        up = z + 1.0
        step = (z - 0.5) * np.log1p(1.0 / z) + np.log(up) - 1.0 - np.log(z)
        rest = np.where(low, rest + step, rest)
        z = np.where(low, up, z)
    return rest + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + 1 / (1188 * z**9)


def log_gamma(z: np.ndarray) -> np.ndarray:
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + stirling_rest(z)


def log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two numbers of any size: the large parts of the gamma functions are taken off each other first."""
    big, small = np.maximum(a, b), np.minimum(a, b)
    ahead = (big - 0.5) * np.log1p(small / big) + small * np.log(big + small) - small
    return log_gamma(small) - (ahead + stirling_rest(big + small) - stirling_rest(big))


def beta_ratio(a, b, x, y) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b); y = 1 - x is given too, since either may be tiny.

    The shorter side of the mean is integrated in the logarithm of its variable, by a fixed rule whatever a and b are.
    """
    a, b, x, y = (np.array(v, float) for v in np.broadcast_arrays(a, b, x, y))
    other = x * b > y * a
    a, b, x, y = np.where(other, b, a), np.where(other, a, b), np.where(other, y, x), np.where(other, x, y)
    out = np.zeros(len(x))
    some = np.flatnonzero(x > 0)
    a, b, x, y = a[some], b[some], x[some], y[some]

    def g(s):
        return -a[:, None] * s + (b[:, None] - 1) * np.log1p(-x[:, None] * np.expm1(-s) / y[:, None])

    def log_of(value, complement):
        return np.where(value < 0.5, np.log(value), np.log1p(-np.where(value < 0.5, 0.0, complement)))

    front = a * log_of(x, y) + (b - 1) * log_of(y, x) - log_beta(a, b)
    out[some] = np.exp(front) * falling_integral(g, 45.0 / a) if len(some) else 0.0
    return np.clip(np.where(other, 1.0 - out, out), 0.0, 1.0)


def gamma_upper(a, x) -> np.ndarray:
    """Regularised upper incomplete gamma function Q(a, x), from the side of x that lies away from a."""
    a, x = (np.array(v, float) for v in np.broadcast_arrays(a, x))
    out = np.where(x > 0, 0.0, 1.0)
    some = np.flatnonzero((x > 0) & np.isfinite(x))
    a, x = a[some], x[some]
    above = x >= a
    sign = np.where(above, 1.0, -1.0)

    def g(s):
        return sign[:, None] * a[:, None] * s - x[:, None] * np.expm1(sign[:, None] * s)

    off = (x - a) / a
    front = a * (np.log1p(off) - off) + 0.5 * np.log(a) - 0.5 * math.log(2 * math.pi) - stirling_rest(a)
    if len(some):
        part = np.exp(front) * falling_integral(g, np.where(above, np.log1p(45.0 / x), 45.0 / a))
        out[some] = np.where(above, part, 1.0 - part)
    return np.clip(out, 0.0, 1.0)


def _erf(x: np.ndarray) -> np.ndarray:
    return np.frompyfunc(math.erf, 1, 1)(x).astype(float)


def range_upper(q: float, k: float, df: float) -> float:
    """Upper tail of the studentized range of k means with df degrees of freedom.

    The density of the deviation is taken relative to its peak and divided by its own sum, so no large logarithms are
    subtracted, however many degrees of freedom there are.
    """
    if q <= 0.0:
        return 1.0
    z, wz = np.polynomial.legendre.leggauss(160)
    z, wz = 8.0 * z, 8.0 * wz
    spread = 1.0 / math.sqrt(2.0 * df)
    s, ws = np.polynomial.legendre.leggauss(120)
    low, high = max(1e-8, 1.0 - 10.0 * spread), 1.0 + 10.0 * spread
    off = low - 1.0 + (high - low) * (s + 1.0) / 2.0
    log_density = (df - 1.0) * np.log1p(off) - df * (off + off * off / 2.0)
    weight = ws * np.exp(log_density - log_density.max())
    phi = np.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi)

    def under(x):
        return 0.5 * (1.0 + _erf(x / math.sqrt(2.0)))

    inner = (wz * k * phi) @ (under(z)[:, None] - under(z[:, None] - q * (1.0 + off))) ** (k - 1.0)
    return float(min(1.0, max(0.0, 1.0 - weight @ inner / weight.sum())))


def range_point(p: float, k: float, df: float) -> float:
    """Quantile p of the studentized range, by false position in a bracket that shrinks from both ends."""

    def over(q: float) -> float:
        return range_upper(q, k, df) - (1.0 - p)

    low, high = 0.0, 8.0
    at_low, at_high = p, over(high)
    while at_high > 0.0:
        low, at_low, high = high, at_high, 2.0 * high
        at_high = over(high)
    while high - low > 1e-13 * high and at_high != 0.0:
        mid = high - at_high * (high - low) / (at_high - at_low)
        if not low < mid < high:
            break
        at_mid = over(mid)
        if at_mid > 0.0:
            low, at_low, at_high = mid, at_mid, at_high / 2.0  # an end that stays counts half, so the other end moves as well
        else:
            high, at_high, at_low = mid, at_mid, at_low / 2.0
    return low if abs(at_low) < abs(at_high) else high


def _known(fn, *columns) -> pd.Series:
    """``fn`` of whole arrays, over the rows without a missing argument, ROWS at a time."""
    values = [np.asarray(c, float) for c in columns]
    out = np.full(len(values[0]), np.nan)
    rows = np.flatnonzero(~np.isnan(values).any(axis=0))
    for i in range(0, len(rows), ROWS):
        some = rows[i : i + ROWS]
        out[some] = fn(*(v[some] for v in values))
    return pd.Series(out)


def _once(fn, *columns) -> pd.Series:
    """``fn`` of single numbers, once for equal arguments."""
    table = pd.DataFrame({i: np.asarray(c, float) for i, c in enumerate(columns)})
    distinct = table.dropna().drop_duplicates()
    distinct["out"] = [fn(*row) for row in distinct.itertuples(index=False)]
    return table.merge(distinct, how="left")["out"].astype("float64")


def _erfc(x: np.ndarray) -> np.ndarray:
    return np.frompyfunc(math.erfc, 1, 1)(x).astype(float)


def two_sided_t(t: np.ndarray, n: np.ndarray) -> np.ndarray:
    square, out = t * t, np.zeros(len(t))
    some = np.isfinite(square)
    square, n = square[some], n[some]
    out[some] = beta_ratio(n / 2, 0.5, n / (n + square), square / (n + square))
    return out


def upper_f(f: np.ndarray, n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    out = np.zeros(len(f))
    some = np.isfinite(f)
    f, n1, n2 = np.maximum(f[some], 0.0), n1[some], n2[some]
    out[some] = beta_ratio(n2 / 2, n1 / 2, n2 / (n2 + n1 * f), n1 * f / (n2 + n1 * f))
    return out


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided normal p-value."""
    return _known(lambda v: _erfc(np.abs(v) / math.sqrt(2.0)), z)


@F.pandas_udf(T.DoubleType())
def normal_upper(z: pd.Series) -> pd.Series:
    """Upper tail of the normal distribution."""
    return _known(lambda v: _erfc(v / math.sqrt(2.0)) / 2.0, z)


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided Student p-value."""
    return _known(two_sided_t, t, df)


@F.pandas_udf(T.DoubleType())
def fisher_p(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """Upper tail of the F distribution."""
    return _known(upper_f, f, df1, df2)


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of the chi-squared distribution."""
    return _known(lambda v, n: gamma_upper(n / 2.0, v / 2.0), x, df)


@F.pandas_udf(T.DoubleType())
def range_p(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of the studentized range."""
    return _once(range_upper, q, k, df)


@F.pandas_udf(T.DoubleType())
def range_quantile(p: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    return _once(range_point, p, k, df)
