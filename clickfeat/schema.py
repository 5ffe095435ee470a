"""Declared schemas of the click log, the test log and score files.

Never inferred: every scan names its types.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Base columns of a click, in file order.
CATEGORICALS = ("app", "device", "os", "channel")

TRAIN_SCHEMA = T.StructType(
    [
        T.StructField("ip", T.LongType(), False),
        T.StructField("app", T.IntegerType(), False),
        T.StructField("device", T.IntegerType(), False),
        T.StructField("os", T.IntegerType(), False),
        T.StructField("channel", T.IntegerType(), False),
        T.StructField("click_time", T.TimestampNTZType(), False),
        T.StructField("attributed_time", T.TimestampNTZType(), True),
        T.StructField("is_attributed", T.IntegerType(), True),
    ]
)

TEST_SCHEMA = T.StructType(
    [
        T.StructField("click_id", T.LongType(), True),
        T.StructField("ip", T.LongType(), False),
        T.StructField("app", T.IntegerType(), False),
        T.StructField("device", T.IntegerType(), False),
        T.StructField("os", T.IntegerType(), False),
        T.StructField("channel", T.IntegerType(), False),
        T.StructField("click_time", T.TimestampNTZType(), False),
    ]
)

SCORE_SCHEMA = T.StructType(
    [
        T.StructField("click_id", T.LongType(), True),
        T.StructField("is_attributed", T.DoubleType(), True),
    ]
)

# Columns the reference reads from each file (its column pruning at scan).
TRAIN_COLUMNS = ("ip", "app", "device", "os", "channel", "click_time", "is_attributed")
TEST_COLUMNS = ("click_id", "ip", "app", "device", "os", "channel", "click_time")

# The six columns that identify a click across test and test supplement.
CLICK_IDENTITY = ("ip", "app", "device", "os", "channel", "click_time")

# Default total order of a click log: time first, load position to break ties.
ORDER_TIME = "click_time"
ORDER_TIE = "row_id"
