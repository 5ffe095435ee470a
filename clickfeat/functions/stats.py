"""Aggregate expressions that Spark lacks in the needed form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_skewness(c: str | Column) -> Column:
    """Bias-corrected sample skewness (the pandas ``skew`` definition).

    ``F.skewness`` is the population moment ratio g1; the adjusted form is
    ``g1 * sqrt(n(n-1)) / (n-2)``. Fewer than three values give NULL and a
    constant group gives 0. Built from partial-aggregatable moments, so a hot
    key is combined map-side like any other sum.
    """
    c = F.col(c) if isinstance(c, str) else c
    x = c.cast("double")
    n = F.count(x).cast("double")
    g1 = F.skewness(x)
    m2 = F.var_pop(x)
    return (
        F.when(n < 3, F.lit(None).cast("double"))
        .when(m2 == 0, F.lit(0.0))
        .otherwise(g1 * F.sqrt(n * (n - 1)) / (n - 2))
    )
