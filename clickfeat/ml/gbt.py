"""Boosted-tree training, early stopping on validation AUC, scoring, importance (M1-M5, M7-M9).

All data-parallel on ``pyspark.ml`` and DataFrames:

* M1: predictors -> vector by declared encodings (``encode``): codes, out-of-fold
  rates, numbers with null flags.
* M2: class weight through ``weightCol``.
* M4 / M7: ``boost.Booster`` grows a forest tree by tree and goes on where it
  stopped; ``fit`` is Spark's own ``GBTClassifier`` for a fixed number of rounds.
* M5: AUC of every tree prefix on the validation rows (``staged``), one pass per
  block of prefixes; growth ends when ``patience`` rounds bring no gain.
* M8: probability with the first ``k`` trees: ``1 / (1 + exp(-2 * margin))``, all
  trees as flat arrays in one pass (``forest``).
* M9: per-feature split count and gain share of the first ``k`` trees.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from . import boost, staged
from .encode import Encoder, Encoding
from .forest import Forest, margin_column, nodes_of, probability, table_nodes


@dataclass(frozen=True)
class TrainParams:
    """M3: training parameters (defaults merged with per-script overrides)."""

    step_size: float = 0.1
    max_depth: int = 3
    min_instances_per_node: int = 100
    max_bins: int = 100
    subsampling_rate: float = 0.7
    feature_subset: str = "0.9"
    min_info_gain: float = 0.0
    pos_weight: float = 200.0
    rounds: int = 1000
    patience: int = 30
    seed: int = 42


# Effective parameters of the three scripts.
PARAMS = {
    "kernel1": TrainParams(step_size=0.10, max_depth=3, min_instances_per_node=100, max_bins=100, rounds=1000, patience=30),
    "kernel2": TrainParams(step_size=0.02, max_depth=5, min_instances_per_node=100, max_bins=128, rounds=2000, patience=30),
    "kernel3": TrainParams(step_size=0.05, max_depth=3, min_instances_per_node=100, max_bins=100, rounds=1000, patience=30),
}


def with_weight(df: DataFrame, label: str, pos_weight: float, out: str = "weight") -> DataFrame:
    """M2: weight ``pos_weight`` on positive rows, 1 elsewhere."""
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(float(pos_weight))).otherwise(F.lit(1.0)))


@dataclass
class FeatureMatrix:
    """M1: fitted encodings and the layout of the vector."""

    encoder: Encoder
    features: str = "features"

    @property
    def names(self) -> list[str]:
        return self.encoder.names

    def transform(self, df: DataFrame, train: Column | bool = False) -> DataFrame:
        return self.encoder.transform(df, train, self.features)


def feature_matrix(train: DataFrame, predictors: Sequence[str], categorical: Sequence[str], label: str, max_bins: int,
                   features: str = "features", rates: Sequence[str] = (), fold: str | Column | None = None) -> FeatureMatrix:
    """M1: fit the encodings on train rows only.

    ``rates``: the categoricals that are encoded by their out-of-fold rate; the
    others are nominal and may have up to ``max_bins - 1`` values. ``fold``
    names a row's fold, by default from its load position, else from its predictors.
    """
    if fold is None:
        fold = "row_id" if "row_id" in train.columns else F.xxhash64(*predictors)
    encoder = Encoder.fit(train, Encoding.of(predictors, categorical, rates), label, fold)
    for c, n in encoder.sizes.items():
        if n > max_bins - 1:  # one bin is kept for unseen values
            raise ValueError(f"{c} has {n} values, more than {max_bins - 1}: encode it as a rate")
    return FeatureMatrix(encoder, features)


def fit(train: DataFrame, params: TrainParams, rounds: int | None = None, label: str = "is_attributed",
        features: str = "features", weight: str = "weight") -> GBTClassificationModel:
    """M4 / M7: fit exactly ``rounds`` trees."""
    checkpoint_dir(train.sparkSession)
    gbt = GBTClassifier(
        featuresCol=features, labelCol=label, weightCol=weight, maxIter=rounds or params.rounds,
        stepSize=params.step_size, maxDepth=params.max_depth, minInstancesPerNode=params.min_instances_per_node,
        maxBins=params.max_bins, subsamplingRate=params.subsampling_rate,
        featureSubsetStrategy=params.feature_subset, minInfoGain=params.min_info_gain, seed=params.seed,
        lossType="logistic", cacheNodeIds=True, checkpointInterval=10,
    )
    data = with_weight(train, label, params.pos_weight, weight).select(features, label, weight)
    data = data.withColumn(label, F.col(label).cast("double"))
    return gbt.fit(data)


Model = GBTClassificationModel | boost.Booster | Forest


def forest_of(model: Model) -> Forest:
    if isinstance(model, Forest):
        return model
    return model.forest() if isinstance(model, boost.Booster) else Forest.of_nodes(nodes_of(model), list(model.treeWeights))


def staged_auc(model: Model, valid: DataFrame, label: str = "is_attributed", features: str = "features",
               block: int = staged.BLOCK, patience: int | None = None) -> DataFrame:
    """M5: ``(iteration, auc, auc_low, auc_high, exact)`` for tree prefixes 1..n on the validation rows."""
    return staged.staged_auc(forest_of(model), valid, label, features, block, patience)


def fit_early_stopped(train: DataFrame, valid: DataFrame, params: TrainParams, rounds: int | None = None,
                      label: str = "is_attributed", features: str = "features",
                      block: int = boost.BLOCK) -> tuple[boost.Booster, DataFrame, int]:
    """M4 + M5: growth that ends after ``patience`` rounds without gain; ``(booster, staged AUC, best iteration)``."""
    return boost.early_stopped(
        boost.Booster.start(train, params, label, features),
        lambda forest: staged_auc(forest, valid, label, features, patience=params.patience),
        lambda table: best_iteration(table, params.patience),
        rounds or params.rounds, params.patience, block,
    )


def best_iteration(staged: DataFrame, patience: int | None = None) -> int:
    """First prefix with the best AUC, scanning as early stopping does."""
    rows = sorted(staged.collect(), key=lambda r: r["iteration"])  # one row per tree: bounded by rounds
    best, best_it = -1.0, 1
    for r in rows:
        if patience is not None and r["iteration"] - best_it > patience:
            break
        if r["auc"] > best:
            best, best_it = r["auc"], r["iteration"]
    return best_it


def score(model: Model, df: DataFrame, k: int | None = None, features: str = "features",
          out: str = "is_attributed", by_trees: bool = False) -> DataFrame:
    """M8: probability of class 1 using the first ``k`` trees (all when None)."""
    if isinstance(model, GBTClassificationModel) and not by_trees and (k is None or k >= len(model.treeWeights)):
        m = model.copy()
        m.setFeaturesCol(features)
        m.setProbabilityCol("__p").setRawPredictionCol("__raw").setPredictionCol("__pred")
        return m.transform(df).withColumn(out, vector_to_array("__p")[1]).drop("__p", "__raw", "__pred")
    return df.withColumn(out, probability(margin_column(forest_of(model), features, k)))


def importance(model: GBTClassificationModel | boost.Booster, names: Sequence[str], k: int | None = None) -> DataFrame:
    """M9: ``(feature, split, gain)`` with gain in percent of the total, by gain desc; inner nodes of the trees ``< k``."""
    if isinstance(model, boost.Booster):
        gains = model.gains
    else:
        gains = [g for i, tree in enumerate(model.trees) for g in table_nodes(tree, i)[1]]
    rows = boost.gain_table(gains, names, len(gains) + 1 if k is None else k)
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(rows, "feature string, split long, gain double").orderBy(F.desc("gain"), "feature")
