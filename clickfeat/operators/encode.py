"""Dictionary encoding of a categorical column to dense integer codes.

Codes are the 0-based rank of the value in ascending order. ``dense_codes`` makes
the dictionary a table of any size: values are range-partitioned and numbered by
prefix sums. ``dictionary_encode`` replaces a column by its codes: a dictionary
of up to ``LITERALS`` values becomes part of the expression, a larger one is
joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import running_before

LITERALS = 200


def dense_codes(df: DataFrame, col: str, code: str = "code") -> DataFrame:
    """(col, code): every distinct value but NULL with its rank."""
    return running_before(df.select(col).filter(F.col(col).isNotNull()).distinct(), [col], code)


def dictionary_encode(df: DataFrame, col: str, out: str | None = None, fit_on: DataFrame | None = None) -> DataFrame:
    """Replace (or add as ``out``) ``col`` by its integer code; NULL stays NULL, a value that ``fit_on`` lacks gets the next free code."""
    known = (df if fit_on is None else fit_on).select(col).filter(F.col(col).isNotNull()).distinct()
    values = [r[0] for r in known.orderBy(col).limit(LITERALS + 1).collect()]
    if len(values) <= LITERALS:
        place = F.array_position(F.array(*map(F.lit, values)), F.col(col)) - 1 if values else F.lit(-1)
        n = len(values)
    else:
        table = dense_codes(known, col, "__code").withColumnRenamed(col, "__value")
        n = table.count()
        df = df.join(table, F.col(col) == F.col("__value"), "left")
        place = F.coalesce("__code", F.lit(-1))
    code = F.when(F.col(col).isNotNull(), F.when(place >= 0, place).otherwise(F.lit(n))).cast("int")
    return df.withColumn(out or col, code).drop("__value", "__code")
