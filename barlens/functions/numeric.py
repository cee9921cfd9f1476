"""Numeric contract shared by every query and its SQL oracle.

T-SQL, Spark and DuckDB disagree on the result types of AVG and of decimal
division, so each output states its type:

* average of a decimal: exact decimal sum, cast to double, one division;
* average of an integer column (T-SQL truncates): ``sum div count``;
* ratios: operands cast to double first, zero denominators become NULL;
* sums of prices: DECIMAL(38,4).

All of these are JVM-side expressions that stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_double(x) -> Column:
    return _c(x).cast("double")


def exact_avg(x, window=None) -> Column:
    """AVG of a decimal: exact sum, cast to double, divided by the non-null count."""
    s, n = F.sum(_c(x)), F.count(_c(x))
    if window is not None:
        s, n = s.over(window), n.over(window)
    return s.cast("double") / F.nullif(n, F.lit(0))


def int_avg(x, window=None) -> Column:
    """AVG of an integer column with T-SQL truncation: ``sum div count``."""
    s, n = F.sum(_c(x)), F.count(_c(x))
    if window is not None:
        s, n = s.over(window), n.over(window)
    return F.call_function("div", s, F.nullif(n, F.lit(0)))


def safe_div(num, den) -> Column:
    """Double division; a zero denominator gives NULL instead of an error."""
    return to_double(num) / F.nullif(to_double(den), F.lit(0.0))


def pct_change(cur, prev, scale: float = 100.0) -> Column:
    """(cur - prev) / prev * scale, with the difference taken exactly before the cast."""
    diff = _c(cur) - _c(prev)
    q = to_double(diff) / F.nullif(to_double(prev), F.lit(0.0))
    return q * F.lit(scale) if scale != 1.0 else q
