"""Statistics with defined results on degenerate input (ANSI arithmetic raises otherwise)."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are set; null where either is constant."""
    ok = x.isNotNull() & y.isNotNull()
    x, y = F.when(ok, x), F.when(ok, y)
    return F.covar_pop(x, y) / F.nullif(F.sqrt(F.var_pop(x) * F.var_pop(y)), F.lit(0.0))


def average_rank(value: str, by: list[str]) -> Column:
    """Rank from 1 within by; ties share the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0

