"""Prefix sums over a whole table in its order, without a single-task window.

The table is range-partitioned by the order and written with each row's place in
its task. Sums within a task are a window per task; what lies before a task
follows from the tasks' totals, one row per task, which the driver adds up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.sinks import materialize


def running_before(df: DataFrame, order: Sequence[str], out: str, amount: str | None = None) -> DataFrame:
    """Adds the sum of ``amount`` (the number of rows when None) over all rows before this one.

    Rows that agree in all of ``order`` follow one another in some fixed order.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("__part", F.shiftright("__at", 33)), "placed")
    total: Column = F.count(F.lit(1)) if amount is None else F.sum(amount)
    totals = placed.groupBy("__part").agg(total.alias("n"))
    kind = totals.schema["n"].dataType
    before, rows = (0.0 if isinstance(kind, DoubleType) else 0), []
    for r in totals.orderBy("__part").collect():  # a row per task
        rows.append((r["__part"], before))
        before += r.n or 0
    starts = df.sparkSession.createDataFrame(rows, f"__part long, __before {kind.simpleString()}")
    if amount is None:
        own = F.col("__at") - F.shiftleft("__part", 33)
    else:
        w = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
        own = F.coalesce(F.sum(amount).over(w), F.lit(0))
    return placed.join(F.broadcast(starts), "__part").withColumn(out, F.col("__before") + own).drop("__at", "__part", "__before")
