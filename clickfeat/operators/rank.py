"""Sort, top-k, head and percentage of total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sort_desc(df: DataFrame, by: str, ties: Sequence[str] = ()) -> DataFrame:
    """Descending sort (a range-partitioned global sort), ties ascending."""
    return df.orderBy(F.col(by).desc(), *[F.col(t).asc() for t in ties])


def top_k(df: DataFrame, by: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    """The ``k`` largest rows; planned as TakeOrderedAndProject
    (a per-partition top-k, then a merge of at most k rows per task)."""
    return sort_desc(df, by, ties).limit(k)


def head(df: DataFrame, n: int, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """The first ``n`` rows in load order."""
    return df.orderBy(*order).limit(n)


def percent_of_total(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """P10: ``100 * x / sum(x)``; the total is a scalar subquery, not a
    single-partition window."""
    total = df.select(F.sum(F.col(col))).scalar()
    return df.withColumn(out or f"{col}_pct", F.lit(100.0) * F.col(col) / total)
