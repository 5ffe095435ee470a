"""Train / validation / test splits (F1-F3) as labels or filters.

Sizes that depend on the data (rows of the train log, the first row of a
day) enter as scalar subqueries, so no driver-side count is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN, VALID, TEST = "train", "valid", "test"


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def positional_split(
    df: DataFrame,
    val_size: int | Column,
    n_train: int | Column | None = None,
    src: str = "src",
    row_id: str = "row_id",
    out: str = "split",
) -> DataFrame:
    """test = appended rows (``src = 1``); validation = the last
    ``val_size`` train rows by load position; train = the rest.

    ``row_id`` is the dense load position inside the train log; ``n_train``
    is the end of the train positions (default ``max(row_id) + 1`` of the
    train rows, as a scalar subquery).
    """
    if n_train is None:
        n_train = df.filter(F.col(src) == 0).select(F.max(row_id) + 1).scalar()
    cut = _lit(n_train) - _lit(val_size)
    label = (
        F.when(F.col(src) == 1, F.lit(TEST))
        .when(F.col(row_id) >= cut, F.lit(VALID))
        .otherwise(F.lit(TRAIN))
    )
    return df.withColumn(out, label)


def day_split(
    df: DataFrame, valid_from: int, test_from: int | None = None, day: str = "day", out: str = "split"
) -> DataFrame:
    """days before ``valid_from`` train, from ``valid_from`` validation,
    from ``test_from`` test. A filter on ``day`` prunes partitions when the
    table is stored by day."""
    d = F.col(day)
    label = F.when(d >= F.lit(valid_from), F.lit(VALID)).otherwise(F.lit(TRAIN))
    if test_from is not None:
        label = F.when(d >= F.lit(test_from), F.lit(TEST)).otherwise(label)
    return df.withColumn(out, label)


def take(df: DataFrame, label: str, col: str = "split") -> DataFrame:
    """The rows of one split (a pushed-down equality filter)."""
    return df.filter(F.col(col) == F.lit(label))


def is_in(col: str, values: Sequence) -> Column:
    """membership test."""
    return F.col(col).isin(*values)
