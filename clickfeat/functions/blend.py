"""Row-wise means of score columns (B1-B4) with IEEE-like zero handling.

Spark's ``ln(0)`` is NULL and ``1/0`` raises under ANSI, while the blended
scores are read back with nine decimals, so exact zeros do occur. A zero in
any input makes the geometric and the harmonic mean 0, as IEEE arithmetic
gives (``exp(-inf) = 0``, ``n / inf = 0``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cols(cs: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def _any_zero(cols: list[Column]) -> Column:
    cond = cols[0] == 0
    for c in cols[1:]:
        cond = cond | (c == 0)
    return cond


def _any_null(cols: list[Column]) -> Column:
    cond = cols[0].isNull()
    for c in cols[1:]:
        cond = cond | c.isNull()
    return cond


def _null() -> Column:
    return F.lit(None).cast("double")


def arithmetic_mean(cs: Sequence[str | Column]) -> Column:
    cols = _cols(cs)
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total / F.lit(float(len(cols)))


def geometric_mean(cs: Sequence[str | Column]) -> Column:
    cols = _cols(cs)
    logs = F.log(cols[0])
    for c in cols[1:]:
        logs = logs + F.log(c)
    mean_log = logs / F.lit(float(len(cols)))
    return F.when(_any_null(cols), _null()).when(_any_zero(cols), F.lit(0.0)).otherwise(F.exp(mean_log))


def harmonic_mean(cs: Sequence[str | Column]) -> Column:
    cols = _cols(cs)
    recip = F.try_divide(F.lit(1.0), cols[0])
    for c in cols[1:]:
        recip = recip + F.try_divide(F.lit(1.0), c)
    safe = F.try_divide(F.lit(float(len(cols))), recip)
    return F.when(_any_null(cols), _null()).when(_any_zero(cols), F.lit(0.0)).otherwise(safe)


def weighted_mean(cs: Sequence[str | Column], weights: Sequence[float]) -> Column:
    if len(cs) != len(weights):
        raise ValueError("one weight per score column")
    cols = _cols(cs)
    total = cols[0] * F.lit(float(weights[0]))
    for c, w in zip(cols[1:], weights[1:]):
        total = total + c * F.lit(float(w))
    return total / F.lit(float(sum(weights)))


# The weights of the final blend (5 : 3 : 2).
FINAL_BLEND_WEIGHTS = (5.0, 3.0, 2.0)
