"""The ``clicks`` view over the driver's ``events`` table.

``events`` stands in for the click log in tests and queries: user -> ip,
event type -> app, derived device / os / channel, and a value threshold as
the conversion label. ``event_id`` is unique, dense and in time order, so it
serves as both ``click_id`` and the load position ``row_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeparts import day, hour, wday


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def clicks_from_events(events: DataFrame) -> DataFrame:
    k = F.get_json_object(F.col("props"), "$.k").cast("int")
    ts = F.col("ts").cast("timestamp_ntz")
    return events.select(
        F.col("event_id").alias("click_id"),
        ts.alias("click_time"),
        F.col("user_id").alias("ip"),
        F.col("event_type").alias("app"),
        (F.col("event_id") % 3).cast("int").alias("device"),
        (k % 7).alias("os"),
        (k % 10).alias("channel"),
        (F.col("value") >= 100).cast("int").alias("is_attributed"),
        hour("ts").alias("hour"),
        day("ts").alias("day"),
        wday("ts").alias("wday"),
        F.col("event_id").alias("row_id"),
    )


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clicks_from_events(table(spark, sf_dir, "events"))


# DuckDB text of the same view, used by the oracle SQL of every query.
CLICKS_DUCKDB = """
clicks AS (
  SELECT event_id AS click_id, ts AS click_time, user_id AS ip, event_type AS app,
         CAST(event_id % 3 AS INT) AS device,
         CAST(props->>'$.k' AS INT) % 7 AS os,
         CAST(props->>'$.k' AS INT) % 10 AS channel,
         CAST(value >= 100 AS INT) AS is_attributed,
         CAST(hour(ts) AS INT) AS "hour", CAST(day(ts) AS INT) AS "day",
         CAST(isodow(ts) - 1 AS INT) AS wday,
         event_id AS row_id
  FROM events
)"""
