"""End-to-end jobs of the original scripts (E1-E4), CSV in, score CSV out.

* ``kernel1``: 30 features over train + test supplement, positional
  validation, early-stopped fit, score the supplement, average scores per
  click identity and attach them to the test log.
* ``kernel2``: 18 features over train + test, positional validation, score test.
* ``kernel3``: 35 features; ``rounds=None`` validates (day split, staged AUC,
  importance), ``rounds=N`` refits N trees on train days and scores test.
* ``blend_files``: arithmetic / geometric / harmonic / weighted means of score files.

Row ranges and debug caps act on the dense load position ``row_id``.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.blend import FINAL_BLEND_WEIGHTS
from ..functions.timeparts import add_time_parts
from ..ml import gbt
from ..ml.train import refit_and_score, validate_and_score
from ..operators.scores import align_scores, blend, submission
from ..operators.splits import TEST, day_split, positional_split
from ..schema import CLICK_IDENTITY, TEST_COLUMNS, TEST_SCHEMA, TRAIN_COLUMNS, TRAIN_SCHEMA
from ..sources.files import append_logs, capped, read_csv, read_scores, row_range, with_row_id
from ..sources.sinks import write_scores_csv
from ..sources.store import cached_table, fingerprint, input_identity
from . import kernels as KS
from .specs import build_features

DEBUG_ROWS = 100_000
WINDOW = 100_000_000  # fixed value: rows that kernel 2 reads by default


def load_log(spark: SparkSession, path: str, test: bool = False, debug: bool = False) -> DataFrame:
    """S1 + dense ``row_id`` + hour / day / weekday. The parsed text is written
    once, by day, to the shared folder, with each row's split and place in it;
    the load positions follow from that table, so they are fixed, and every
    later scan reads typed parquet."""
    schema, cols = (TEST_SCHEMA, TEST_COLUMNS) if test else (TRAIN_SCHEMA, TRAIN_COLUMNS)
    df = with_row_id(add_time_parts(read_csv(spark, path, schema, cols)), partition_by=("day",))
    return capped(df, DEBUG_ROWS) if debug else df


@dataclass
class FlowResult:
    submission: DataFrame
    best_iteration: int | None = None
    staged: DataFrame | None = None
    importance: DataFrame | None = None

    @property
    def validation_auc(self) -> float | None:
        """AUC of the best iteration on the validation rows."""
        if self.staged is None:
            return None
        return self.staged.filter(F.col("iteration") == self.best_iteration).first().auc


def _params(name: str, rounds: int | None, overrides: dict | None) -> gbt.TrainParams:
    p = gbt.PARAMS[name]
    if rounds is not None:
        p = replace(p, rounds=rounds)
    return replace(p, **(overrides or {}))


def kernel1(spark: SparkSession, train_path: str, supplement_path: str, test_path: str, out_path: str | None = None,
            frm: int = 0, to: int | None = None, val_size: int = 5_000_000, debug: bool = False,
            rounds: int | None = None, params: dict | None = None) -> FlowResult:
    train = load_log(spark, train_path)
    if frm or to is not None:
        train = row_range(train, frm, to)
    supp = load_log(spark, supplement_path, test=True, debug=debug)
    feats = build_features(append_logs(train, supp, row_id="row_id"), KS.KERNEL1)
    feats = positional_split(feats, val_size)
    p = _params("kernel1", rounds, params)
    res = validate_and_score(feats, KS.predictors("kernel1"), KS.CATEGORICAL_1, p, keep=CLICK_IDENTITY, rates=KS.RATES)
    test = load_log(spark, test_path, test=True, debug=debug).select("click_id", *CLICK_IDENTITY)
    sub = submission(test, res.scores)
    if out_path:
        write_scores_csv(sub, out_path, decimals=9)
    return FlowResult(sub, res.best_iteration, res.staged, res.importance)


def kernel2(spark: SparkSession, train_path: str, test_path: str, out_path: str | None = None,
            frm: int | None = None, to: int | None = None, val_size: int = 2_500_000, debug: bool = False,
            rounds: int | None = None, params: dict | None = None, window: int = WINDOW) -> FlowResult:
    """``frm`` and ``to`` left out: the original's default window, ``WINDOW`` rows that end ``val_size`` rows before the log's end."""
    train = load_log(spark, train_path)
    if frm is None and to is None:
        frm = max(0, train.count() - (window + val_size))
        to = frm + window
    train = row_range(train, frm or 0, to)
    test = load_log(spark, test_path, test=True, debug=debug)
    feats = build_features(append_logs(train, test, row_id="row_id"), KS.KERNEL2)
    feats = positional_split(feats, val_size)
    p = _params("kernel2", rounds, params)
    res = validate_and_score(feats, KS.predictors("kernel2"), KS.CATEGORICAL_2, p, rates=KS.RATES)
    if out_path:
        write_scores_csv(res.scores, out_path, decimals=9)
    return FlowResult(res.scores, res.best_iteration, res.staged, res.importance)


def kernel3(spark: SparkSession, train_path: str, test_path: str | None = None, out_path: str | None = None,
            rounds: int | None = None, first_day: int | None = 7, valid_day: int = 9, refit_first_day: int = 8,
            params: dict | None = None, frm: int = 0, to: int | None = None, debug: bool = False) -> FlowResult:
    """Validate (``rounds=None``): train on ``first_day`` .. ``valid_day - 1``,
    early-stop on ``valid_day`` onwards, return staged AUC and importance.
    Test (``rounds=N``): refit N trees on ``refit_first_day`` onwards plus the
    test log's features, score test, write a gzip CSV."""
    p = _params("kernel3", None, params)
    mode = ("validate", first_day) if rounds is None else ("refit", refit_first_day)
    inputs = input_identity(spark, train_path, *([test_path] if rounds is not None else []))
    key = fingerprint(("kernel3", KS.KERNEL3, mode, frm, to, debug), inputs)

    def features() -> DataFrame:
        train = load_log(spark, train_path, debug=debug)
        if frm or to is not None:
            train = row_range(train, frm, to)
        if rounds is None:
            return build_features(train if first_day is None else train.filter(F.col("day") >= first_day), KS.KERNEL3)
        test = load_log(spark, test_path, test=True, debug=debug)
        return build_features(append_logs(train.filter(F.col("day") >= refit_first_day), test, row_id="row_id"), KS.KERNEL3)

    feats = cached_table(spark, "kernel3", key, features)  # a second run reads what the first has written
    if rounds is None:
        res = validate_and_score(day_split(feats, valid_from=valid_day), KS.predictors("kernel3"), KS.CATEGORICAL_3, p, rates=KS.RATES, written=True)
        return FlowResult(res.scores, res.best_iteration, res.staged, res.importance)
    feats = feats.withColumn("split", F.when(F.col("src") == 1, F.lit(TEST)).otherwise(F.lit("train")))
    sub = refit_and_score(feats, KS.predictors("kernel3"), KS.CATEGORICAL_3, p, rounds, rates=KS.RATES, written=True)
    if out_path:
        write_scores_csv(sub, out_path, decimals=None, compression="gzip")
    return FlowResult(sub)


def blend_files(spark: SparkSession, paths: list[str], out_mean: str | None = None, out_final: str | None = None,
                weights: list[float] | None = None) -> dict[str, DataFrame]:
    """Align any number of score files on click_id and blend them.

    The weighted blend needs a weight per file; three files have the final blend's weights by default.
    """
    if weights is None and len(paths) == len(FINAL_BLEND_WEIGHTS):
        weights = list(FINAL_BLEND_WEIGHTS)
    if out_final and weights is None:
        raise ValueError("a weighted blend of other than three files needs weights")
    names = [f"s{i}" for i in range(len(paths))]
    aligned = align_scores([read_scores(spark, p) for p in paths], names)
    out = {how: blend(aligned, names, how, weights if how == "weighted" else None)
           for how in ("arithmetic", "geometric", "harmonic", *(["weighted"] if weights else []))}
    if out_mean:
        write_scores_csv(out["arithmetic"], out_mean, decimals=9)
    if out_final:
        write_scores_csv(out["weighted"], out_final, decimals=9)
    return out
