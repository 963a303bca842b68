"""Missing-value rules.

NULL and NaN both count as missing.  Unless an operator says otherwise, one
missing input makes an aggregate missing ("strict"), whereas Spark's own
aggregates skip NULL.  Infinite values are ordinary values.

Arguments are column names or SQL expressions.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFINITY = "double('Infinity')"


def known(value: str) -> str:
    """SQL text: the value as a double, NaN turned into NULL."""
    return f"nanvl(double({value}), double(null))"


def nan_to_null(value: str) -> Column:
    """A numeric column with NaN turned into NULL."""
    return F.expr(known(value))


def is_missing(value: str) -> Column:
    """True for NULL and for NaN (numeric columns)."""
    return F.expr(f"{known(value)} is null")


def is_finite(value: str) -> Column:
    """True for an ordinary number: not NULL, not NaN, not infinite."""
    return F.expr(f"coalesce(abs(double({value})) < {INFINITY}, false)")


def _strict(aggregate: str, value: str) -> Column:
    v = known(value)
    return F.expr(f"case when count({v}) = count(1) then {aggregate}({v}) end")


def strict_avg(value: str) -> Column:
    """Mean; missing when any input row is missing."""
    return _strict("avg", value)


def strict_stddev(value: str) -> Column:
    """Sample standard deviation; missing when any input is, or for one row."""
    return _strict("stddev_samp", value)


def strict_variance(value: str) -> Column:
    """Sample variance; missing when any input is, or for one row."""
    return _strict("var_samp", value)


def ieee_div(a: str, b: str) -> Column:
    """Floating-point division: x/0 is an infinity, 0/0 is NaN, NULL stays NULL.

    Spark's ``/`` raises on a zero divisor in ANSI mode and ``try_divide``
    gives NULL, so the zero cases are spelled out.
    """
    return F.expr(f"""
        case when ({a}) is null or ({b}) is null then double(null)
             when ({b}) <> 0 then try_divide(double({a}), double({b}))
             when ({a}) = 0 or isnan({a}) then double('NaN')
             when ({a}) > 0 then {INFINITY} else -{INFINITY} end""")


def ieee_ln(value: str) -> Column:
    """Natural logarithm: minus infinity for 0, NaN below; Spark's own gives NULL for both."""
    return F.expr(f"""
        case when ({value}) = 0 then -{INFINITY} when ({value}) < 0 then double('NaN')
             else ln({value}) end""")


def drop_incomplete(df: DataFrame, subset: Iterable[str] | None = None) -> DataFrame:
    """Keep rows with no missing value in ``subset`` (default: all columns).

    Written as a conjunction of simple predicates rather than ``na.drop`` so
    that each part can travel through joins and aggregates down to the scan.
    """
    schema = df.schema
    names = list(subset) if subset is not None else schema.names
    fractional = (T.DoubleType, T.FloatType)
    tests = [f"`{n}` is not null" for n in names] + [
        f"not isnan(`{n}`)" for n in names
        if isinstance(schema[n].dataType, fractional)
    ]
    return df.where(" and ".join(tests))
