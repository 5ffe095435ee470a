"""File scans (S1-S4) and the append of two logs.

``row_id``: the click log has no id column and its load order is
semantic. A dense, exact load position is assigned without sorting the
table: rows of one file split are read in order by one task, so
``position in split = monotonically_increasing_id - min(id of the split)``;
a small per-split table (one row per split, bounded by the file listing)
gives each split's offset by prefix sums in the order of file and split start
(``operators.prefix``: no task sees all splits) and is joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import SCORE_SCHEMA

CSV_TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    columns: Sequence[str] | None = None,
    time_format: str = CSV_TIME_FORMAT,
) -> DataFrame:
    """Header CSV with declared types, pruned to ``columns``."""
    reader = (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "FAILFAST")
        .option("timestampNTZFormat", time_format)
    )
    df = reader.csv(path if isinstance(path, str) else list(path))
    return df.select(*columns) if columns else df


def with_row_id(df: DataFrame, name: str = "row_id", partition_by: Sequence[str] = ()) -> DataFrame:
    """Add the dense 0-based load position of each row of a file scan.

    ``df`` must be a plain file scan (optionally projected): the position is
    derived from the scan's file splits. The scan is written once with its
    split and its place in the split, and both the offsets and the rows come
    from that table: splits that differ between two scans can lose no row. A
    row without an offset fails the job. ``partition_by``: columns by which the
    written table is stored, for pruning.
    """
    from ..operators.prefix import running_before
    from .sinks import materialize

    meta = df.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__mid"),
    )
    meta = materialize(meta, "scan", partition_by=partition_by)
    splits = meta.groupBy("__file", "__start").agg(
        F.count(F.lit(1)).alias("__rows"), F.min("__mid").alias("__mid0")
    )
    splits = running_before(splits, ["__file", "__start"], "__offset", "__rows")
    place = F.col("__offset") + F.col("__mid") - F.col("__mid0")
    lost = F.raise_error(F.lit("a row of the scan has no load position")).cast("long")
    # One row per file split; the planner broadcasts it only if its measured size allows.
    return (
        meta.join(splits.select("__file", "__start", "__mid0", "__offset"), ["__file", "__start"], "left")
        .withColumn(name, F.when(place.isNotNull(), place.cast("long")).otherwise(lost))
        .drop("__file", "__start", "__mid", "__mid0", "__offset")
    )


def capped(df: DataFrame, n: int, order: str = "row_id") -> DataFrame:
    """The first ``n`` rows in load order (a debug slice, by design)."""
    return df.filter(F.col(order) < F.lit(n))


def row_range(df: DataFrame, frm, to, pandas_skiprows: bool = True, row_id: str = "row_id") -> DataFrame:
    """S3: ``skiprows=range(1, frm), nrows=to - frm`` as a filter on ``row_id``.

    With ``pandas_skiprows`` the original's off-by-one is kept: ``frm >= 1``
    yields positions ``[frm - 1, to - 1)`` and ``frm = 0`` yields ``[0, to)``.
    Otherwise the range is the half-open ``[frm, to)``. ``frm`` / ``to`` may
    be ints or scalar-subquery columns; ``to = None`` reads to the end. The filter is pushed to the scan.
    """
    f = frm if isinstance(frm, Column) else F.lit(frm)
    t = to if isinstance(to, Column) else F.lit(2**62 if to is None else to)
    if pandas_skiprows:
        shift = F.when(f >= 1, F.lit(1)).otherwise(F.lit(0))
        lo, hi = f - shift, t - shift
    else:
        lo, hi = f, t
    rid = F.col(row_id)
    return df.filter((rid >= lo) & (rid < hi))


def read_scores(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``click_id,is_attributed`` score file with a declared schema."""
    return spark.read.schema(SCORE_SCHEMA).option("header", True).option("mode", "FAILFAST").csv(path if isinstance(path, str) else list(path))


def append_logs(train: DataFrame, test: DataFrame, src: str = "src", row_id: str | None = None) -> DataFrame:
    """Train rows then test rows, columns matched by name, missing as NULL.

    ``src`` is 0 for train and 1 for test. With ``row_id`` (the per-log load
    position) the test positions are moved after the train ones, so
    ``row_id`` stays one load order over the appended table; the end of the
    train positions (``max + 1``, right after a row range too) enters as a
    scalar subquery.
    """
    t = test.withColumn(src, F.lit(1))
    if row_id:
        end = train.select(F.coalesce(F.max(row_id) + 1, F.lit(0))).scalar()
        t = t.withColumn(row_id, F.col(row_id) + end)
    return train.withColumn(src, F.lit(0)).unionByName(t, allowMissingColumns=True)
