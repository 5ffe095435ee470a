"""Train on the train split, pick the tree prefix on validation, score test (E1-E3 flows)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.splits import TEST, TRAIN, VALID, take
from ..sources.sinks import materialize
from . import boost, gbt


@dataclass
class TrainResult:
    model: boost.Booster
    matrix: gbt.FeatureMatrix
    best_iteration: int
    staged: DataFrame  # (iteration, auc)
    scores: DataFrame  # (click_id, is_attributed) on test rows
    importance: DataFrame  # (feature, split, gain%)


def validate_and_score(features: DataFrame, predictors: Sequence[str], categorical: Sequence[str],
                       params: gbt.TrainParams, rounds: int | None = None, split: str = "split",
                       label: str = "is_attributed", block: int = boost.BLOCK,
                       keep: Sequence[str] = ("click_id",), rates: Sequence[str] = (), written: bool = False) -> TrainResult:
    """Validate mode: fit on train, early-stop on validation AUC, score test with the best prefix.

    The feature table is written once to the shared folder: the three
    splits and the fits read it instead of recomputing the feature plan.
    ``written``: it is a written table already.
    """
    features = features if written else materialize(features, "features")
    train, valid, test = (take(features, s, split) for s in (TRAIN, VALID, TEST))
    fm = gbt.feature_matrix(train, predictors, categorical, label, params.max_bins, rates=rates)
    # Every pass over the validation rows reads their vectors, not the joins that encode them.
    valid = materialize(fm.transform(valid).select(label, fm.features), "valid")
    model, staged, k = gbt.fit_early_stopped(fm.transform(train, train=True), valid, params, rounds, label, block=block)
    carried = [c for c in keep if c in test.columns]  # validate-only runs have no test log
    scores = gbt.score(model, fm.transform(test), k).select(*carried, "is_attributed")
    imp = gbt.importance(model, fm.names, k)
    return TrainResult(model, fm, k, staged, scores, imp)


def refit_and_score(features: DataFrame, predictors: Sequence[str], categorical: Sequence[str],
                    params: gbt.TrainParams, rounds: int, split: str = "split",
                    label: str = "is_attributed", rates: Sequence[str] = (), written: bool = False) -> DataFrame:
    """M7 (``--test N``): fit exactly ``rounds`` trees on all labelled rows, score test with all of them."""
    features = features if written else materialize(features, "features")
    labelled = features.filter(F.col(split) != F.lit(TEST))
    test = take(features, TEST, split)
    fm = gbt.feature_matrix(labelled, predictors, categorical, label, params.max_bins, rates=rates)
    model = boost.Booster.start(fm.transform(labelled, train=True), params, label, fm.features).grow(rounds)
    return gbt.score(model, fm.transform(test)).select("click_id", "is_attributed")
