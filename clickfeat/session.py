"""Spark session settings shared by the library, the tests and the bench.

On a cluster the session already exists; ``configure`` only fills in the
settings the library relies on (UTC wall clock, AQE with skew-join
splitting) and never overrides what the cluster set, in particular
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the operators assume. AQE turns a sort-merge join into a broadcast
# join only after the small side has been materialised and measured, and
# splits skewed partitions of the big side of a join.
LIBRARY_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A join on keys that contain the partitioning keys of one side reuses
    # that partitioning and shuffles only the other side. The row table is
    # partitioned by a window family's keys only when no key of the family
    # is hot (each group is bounded), see operators/ordered.py.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in LIBRARY_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    Uses ``spark.checkpoint.dir`` as the cluster names it. Only when it is
    unset (a laptop or a test) is a private folder created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not conf_dir:
        if sc.master.startswith("local"):
            conf_dir = tempfile.mkdtemp(prefix="clickfeat-ckpt-")
        else:
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "clickfeat") -> SparkSession:
    """A local session for tests and the bench (UI off, no extra servers)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("CLICKFEAT_DRIVER_MEMORY", "8g"))
    )
    for key, value in LIBRARY_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark
