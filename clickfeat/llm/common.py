"""Shared Spark pieces of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import materialize, quoted

NO_ID = 2**63 - 1  # stands for a null id inside an operator; larger than any other


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def key_of(col: str) -> Column:
    return F.coalesce(F.col(quoted(col)).cast("long"), F.lit(NO_ID))


def id_of(col: str = "key") -> Column:
    """The id back from a key: null where it stood for null."""
    return F.when(F.col(col) != NO_ID, F.col(col))


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, text) with the text as UTF-8 bytes; other columns of the input, whatever their names, are left out."""
    return docs.select(key_of(id_col).alias("key"), F.col(quoted(text_col)).cast("binary").alias("text"))


def remainder(col: str, m: int) -> Column:
    """crc32 of the id as text, modulo m: the folds of the labelled data (null id: fold of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(m))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every end of an edge of ``edges(a, b)``; component is the smallest id reachable.

    Alternating large and small stars: each round links every node to the
    smallest neighbour seen, by aggregation and joins whose hot keys Spark can
    split. A round's edges are written to the shared folder, so the lineage
    stays short and a lost executor costs one round at most. No edge ever
    reaches the driver, only a count and a checksum.
    """
    edge = [F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")]
    now = materialize(edges.filter("a <> b").select(*edge).distinct(), "edges")
    state = _checksum(now)
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "stars")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(low, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        now = materialize(rest.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        if (new := _checksum(now)) == state:
            break
        state = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
