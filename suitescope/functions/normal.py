"""The normal distribution as Column expressions, without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rational approximation of erf by Abramowitz and Stegun, 7.1.26.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    t = 1.0 / (1.0 + ERF_P * F.abs(x))
    series = F.lit(0.0)
    for a in reversed(ERF_A):
        series = (series + F.lit(a)) * t
    y = 1.0 - series * F.exp(-x * x)
    return F.when(x >= 0, y).otherwise(-y)


def phi(x: Column) -> Column:
    """P(Z <= x)."""
    return 0.5 * (1.0 + erf(x / F.sqrt(F.lit(2.0))))


def erf_sql(x: str) -> str:
    """The same as text, in SQL that DuckDB runs too."""
    t = f"(1.0::DOUBLE / (1.0::DOUBLE + {ERF_P}::DOUBLE * abs({x})))"
    series = "0.0::DOUBLE"
    for a in reversed(ERF_A):
        series = f"(({series} + ({a})::DOUBLE) * {t})"
    y = f"(1.0::DOUBLE - {series} * exp(-({x}) * ({x})))"
    return f"(CASE WHEN ({x}) >= 0 THEN {y} ELSE -{y} END)"
