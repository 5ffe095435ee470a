"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before it kept; what it returns is written as Parquet in the shared folder and
read again as the next stage's ``docs``. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickfeat.llm import decontaminate, packing, pii, simhash, toxicity
from clickfeat.llm.queries import toxicity_model
from clickfeat.sources.sinks import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a calibrated toxicity below the threshold."""
    whole = docs.select(F.struct("*").alias("row"), "text")
    scored = toxicity_model(spark, docs, sf_dir).score(whole, keep="row")
    return scored.filter(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each SimHash component, the one with the smallest id.

    Rows of one id with unrelated texts are told apart; of equal rows one stays.
    """
    return simhash.first_rows(docs, shingle=3, max_bits=2)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that share no template window with the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every span of personal data by its kind; ``n_chars`` follows the new text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in clean.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences of 2048 words."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None  # a fitted model and sequential packing: tested against brute force instead


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
