"""Time projections (P1-P5). All are JVM expressions; none needs a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ORDER_TIME

DOMAIN = "domain"  # metadata of a column: how many values it can have, by what it is computed from


def _bounded(c: Column, name: str, values: int) -> Column:
    return c.cast("int").alias(name, metadata={DOMAIN: values})


_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"

# The hour groups of the `in_test_hh` feature (the hours most
# and least frequent in the test log).
MOST_FREQUENT_TEST_HOURS = (4, 5, 9, 10, 13, 14)
LEAST_FREQUENT_TEST_HOURS = (6, 11, 15)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_click_time(c: str | Column, fmt: str | None = None) -> Column:
    """Text -> TIMESTAMP_NTZ (click logs carry no zone)."""
    c = _col(c)
    return F.to_timestamp_ntz(c, F.lit(fmt)) if fmt else F.to_timestamp_ntz(c)


def as_ntz(c: str | Column) -> Column:
    return _col(c).cast("timestamp_ntz")


def epoch_micros(c: str | Column = ORDER_TIME) -> Column:
    """Microseconds since 1970-01-01, independent of the session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH_NTZ}, CAST({_sql(c)} AS TIMESTAMP_NTZ))")


def epoch_seconds(c: str | Column = ORDER_TIME) -> Column:
    """P5: whole seconds since the epoch, floored (``astype(int64) // 10**9``)."""
    return F.floor(epoch_micros(c) / F.lit(1_000_000)).cast("long")


def hour(c: str | Column = ORDER_TIME) -> Column:
    """0-23."""
    return _bounded(F.hour(as_ntz(c)), "hour", 24)


def day(c: str | Column = ORDER_TIME) -> Column:
    """Day of month 1-31."""
    return _bounded(F.dayofmonth(as_ntz(c)), "day", 31)


def wday(c: str | Column = ORDER_TIME) -> Column:
    """Day of week with Monday = 0 (``F.dayofweek`` would give Monday = 2)."""
    return _bounded(F.weekday(as_ntz(c)), "wday", 7)


def in_test_hh(h: str | Column = "hour") -> Column:
    """1 for the most frequent test hours, 2 for the least frequent, else 3."""
    h = _col(h)
    group = F.when(h.isin(*MOST_FREQUENT_TEST_HOURS), F.lit(1)).when(h.isin(*LEAST_FREQUENT_TEST_HOURS), F.lit(2)).otherwise(F.lit(3))
    return _bounded(group, "in_test_hh", 3)


def add_time_parts(df, time_col: str = ORDER_TIME, parts=("hour", "day", "wday")):
    """Add the requested calendar parts as integer columns."""
    makers = {"hour": hour, "day": day, "wday": wday}
    return df.withColumns({p: makers[p](time_col) for p in parts})


def _sql(c: str | Column) -> str:
    if isinstance(c, str):
        return f"`{c}`"
    raise TypeError("epoch_micros takes a column name")
