"""Score test logs as they arrive in a folder (Structured Streaming).

The original scores one test file at a time. Here every newly arrived click
file is one micro-batch: the file source tracks which files were processed
in the checkpoint, and each batch runs the given batch scoring function
(features + model) and writes ``out_dir/batch=<id>``. A replayed batch
overwrites its own folder, so the sink is idempotent after executor or
driver loss.

Features keep their batch meaning (over the whole arrived file, which is
what the original computes); there is no cross-file state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..schema import TEST_SCHEMA
from ..session import checkpoint_dir


def score_arriving_logs(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    score: Callable[[DataFrame], DataFrame],
    schema: T.StructType = TEST_SCHEMA,
    checkpoint: str | None = None,
    files_per_batch: int = 1,
    available_now: bool = True,
) -> StreamingQuery:
    """Start the stream; ``score`` maps one batch of clicks to a score table."""
    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/streams/score-{hashlib.sha256(f'{in_dir}|{out_dir}'.encode()).hexdigest()[:16]}"
    clicks = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("mode", "FAILFAST")
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(in_dir)
    )

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch={batch_id}")

    writer = clicks.writeStream.foreachBatch(run_batch).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
