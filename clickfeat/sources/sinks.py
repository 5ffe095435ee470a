"""Score sinks (S6, S7) and materialised tables; the stage store (S5) is in ``store``.

Everything is written by the executors in parallel; nothing passes through
the driver. Paths on a cluster are shared folders (the checkpoint folder or
a table location), never a machine-local directory.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .store import cached_table, fingerprint, input_identity  # noqa: F401


def quoted(name: str) -> str:
    """A column name as a reference: dots and backticks in it count as part of the name."""
    return "`" + name.replace("`", "``") + "`"


def format_fixed(col: str, decimals: int = 9):
    """``%.{decimals}f`` text; NULL stays an empty field (``format_string``
    alone would write the text ``null``)."""
    c = F.col(col)
    return F.when(c.isNotNull(), F.format_string(f"%.{decimals}f", c.cast("double")))


def write_scores_csv(scores: DataFrame, path: str, decimals: int | None = 9, compression: str | None = None,
                     score: str = "is_attributed", mode: str = "overwrite") -> None:
    """S6 (``decimals=9``) / S7 (``decimals=None, compression='gzip'``).

    A header CSV ``click_id,is_attributed`` written as part files by the
    executors.
    """
    out = scores.select("click_id", format_fixed(score, decimals).alias(score) if decimals is not None else F.col(score))
    w = out.write.mode(mode).option("header", True).option("emptyValue", "").option("nullValue", "")
    if compression:
        w = w.option("compression", compression)
    w.csv(path)


_written: list[str] = []  # tables that this process has materialised


def materialize(df: DataFrame, name: str, folder: str | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    A lineage cut that computes the plan once (``DataFrame.checkpoint`` on an
    unpersisted plan computes it twice) and survives executor loss: later
    stages restart from the files, not from the source tables. With
    ``partition_by`` (e.g. ``day``) filters on those columns prune folders.
    """
    spark = df.sparkSession
    base = (folder or checkpoint_dir(spark)).rstrip("/")
    path = f"{base}/tables/{name}-{uuid.uuid4().hex}"
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    _written.append(path)
    return spark.read.parquet(path).select(*[quoted(c) for c in df.columns])


def clear_tables(spark: SparkSession) -> int:
    """Removes the tables that this process has materialised, once no result depends on them; returns their number."""
    n = len(_written)
    while _written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n
