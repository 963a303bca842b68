"""Student's t distribution for fit summaries.

Spark SQL has no t distribution.  These vectorised UDFs run on fit results
only: one row per fitted line, never on the measurements.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ship these functions with the query: executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: Terms of the continued fraction, far beyond the most that any argument needs.
MOST_TERMS = 100_000


def _beta_fraction(a: float, b: float, x: float, y: float) -> float:
    """Continued fraction of the incomplete beta function (Didonato and Morris, 1992).

    ``y`` is 1 - x, given beside it: computed from x it would lose its digits near x = 1.
    """
    tiny = 1e-300
    value = previous = ratio = 0.0
    for m in range(MOST_TERMS):
        place = a + 2 * m
        part = m + (a + m) * (a * y - b * x + 1.0 + m * (1.0 + y)) / (place + 1.0)
        if m == 0:
            value = previous = part or tiny
            continue
        inner = m * (b - m) * x / (place - 1.0)
        part += inner
        top = (a + m - 1.0) * (a + b + m - 1.0) * x / (place - 1.0) * inner
        ratio = part + top * ratio
        ratio = 1.0 / (ratio or tiny)
        previous = part + top / previous
        previous = previous or tiny
        value *= previous * ratio
        if abs(previous * ratio - 1.0) < 1e-15:
            return 1.0 / value
    raise ArithmeticError(f"no convergence for a = {a}, b = {b}, x = {x}")


def _log_half_step(a: float) -> float:
    """log(gamma(a + 1/2) / gamma(a)); for large a by its series, which does not cancel."""
    if a < 50.0:
        return math.lgamma(a + 0.5) - math.lgamma(a)
    return 0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a**3) - 1 / (640 * a**5)


def _tail(a: float, x: float, y: float) -> float:
    """Incomplete beta function of a and 1/2 at x = 1 - y."""
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    log_x = math.log(x) if x < 0.5 else math.log1p(-y)
    front = math.exp(_log_half_step(a) + a * log_x) * math.sqrt(y / math.pi)
    if y > 1.5 / (a + 2.5):
        return front * _beta_fraction(a, 0.5, x, y)
    return 1.0 - front * _beta_fraction(0.5, a, y, x)


def two_sided_tail(t: float, df: float) -> float:
    """P(|T| > |t|) with ``df`` degrees of freedom."""
    if not df > 0 or math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0
    square = t * t
    if math.isinf(square):
        return 0.0
    return _tail(df / 2.0, df / (df + square), square / (df + square))


def critical_value(df: float, level: float) -> float:
    """The t with P(|T| <= t) = ``level``, by bisection on the tail."""
    if not df > 0:
        return math.nan
    low, high = 0.0, 1.0
    while two_sided_tail(high, df) > 1.0 - level:
        high *= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if middle in (low, high):
            break
        if two_sided_tail(middle, df) > 1.0 - level:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0


def _each(function, first: pd.Series, second: pd.Series) -> pd.Series:
    """Row by row; an undefined result is NULL."""
    def one(a, b):
        found = function(float(a), float(b)) if pd.notna(a) and pd.notna(b) else None
        return None if found is None or math.isnan(found) else found

    return pd.Series([one(a, b) for a, b in zip(first, second)], dtype=object)


@F.pandas_udf(T.DoubleType())
def t_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(two_sided_tail, t, df)


@F.pandas_udf(T.DoubleType())
def t_critical(df: pd.Series, level: pd.Series) -> pd.Series:
    return _each(critical_value, df, level)
