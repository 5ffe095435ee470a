"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hard_negatives, language_id, licences, merkle, mixing_lm, oracle, packing, pii, simhash, sparse_suffix, suffix_trees, toxicity, vector_links
from .common import documents, remainder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = oracle.SQL


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Fitted on labelled documents outside the held-out quarter."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(remainder("doc_id", 4) != 2)
    some = F.broadcast(toxicity.bounded_labels(labels).withColumnRenamed("doc_id", "_id"))
    known = docs.select("doc_id", "text").join(some, F.col("doc_id") == F.col("_id"))
    return toxicity.fit(known)


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 words; exact copies (same lower-cased words) are the duplicate clusters."""
    return packing.pack(documents(spark, sf_dir))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = toxicity_model(spark, docs, sf_dir).score(docs, keep="doc_id")
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).alias("predicted"))


@query
def op6_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(documents(spark, sf_dir))


@query
def op8_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query
def op9_benchmark_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and classes of benchmark items that share a template window with agreeing slots."""
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op4_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_trees.deduplicate(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op10_sparse_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that also stand in a document with a smaller id."""
    return sparse_suffix.repeats(documents(spark, sf_dir))


@query
def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op5_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(remainder("doc_id", 3) != 1))
    return model.predict(docs).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = remainder("doc_id", 5) == 1
    out = mixing_lm.model_scores(documents(spark, sf_dir), ~fold)
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots, digest of its proof, and whether the proof holds for the copy that somebody may have changed."""
    out = merkle.manifest(documents(spark, sf_dir), tampered=remainder("doc_id", 3) == 0)
    out = merkle.folded(out).withColumn("proof_sha256", merkle.proof_digest(F.col("path")))
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query
def op12_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the licence phrases and labels of the covered templates; score is the largest covered share of a template."""
    out = licences.scan(documents(spark, sf_dir))
    word, base, found = F.col("places.word"), F.array_distinct("places.label"), F.col("spans.label")
    join = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(word).alias("first_word"), F.array_max(word).alias("last_word"),
        join(base).alias("base_labels"), join(F.concat(base, found)).alias("labels"), F.coalesce(F.array_max("spans.coverage"), F.lit(0.0)).alias("score"))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; the labels of every seventh are moved by one."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(hard_negatives.rows_of(vectors, label=label), F.col("vec_id") % 100 == 0)
