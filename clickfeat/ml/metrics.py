"""Model metrics (M6): exact AUC, per group, without a single-task sort.

AUC with ties counted half is ``sum_s pos(s) * (neg_below(s) + neg(s) / 2) / (P * N)``
over distinct scores ``s``. Distinct ``(group, score)`` rows with their counts
(partial aggregate) get ``neg_below`` as a prefix sum in the order of group and
score (``operators.prefix``: range-partitioned, so tasks follow the number of
distinct scores, and neither a group nor all scores meet in one task). The sum
runs on from group to group; what lies before a group's first score is taken
off again in the group's own aggregate.
"""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import running_before

_G = "__group"


def auc_by_group(df: DataFrame, score: str, label: str, group: str | None = None, out: str = "auc") -> DataFrame:
    """One row per group (or one row when ``group`` is None) with its exact AUC."""
    g = F.col(group) if group else F.lit(0)
    data = df.select(g.alias(_G), F.col(score).cast("double").alias("__s"), F.col(label).cast("double").alias("__y"))
    d = data.groupBy(_G, "__s").agg(F.sum("__y").alias("__pos"), F.sum(F.lit(1.0) - F.col("__y")).alias("__neg"))
    d = running_before(d, [_G, "__s"], "__below", "__neg")
    pairs = F.sum(F.col("__pos") * (F.col("__below") + F.lit(0.5) * F.col("__neg"))) - F.min("__below") * F.sum("__pos")
    res = d.groupBy(_G).agg((pairs / (F.sum("__pos") * F.sum("__neg"))).alias(out))
    return res.withColumnRenamed(_G, group) if group else res.select(out)


def auc(df: DataFrame, score: str, label: str = "is_attributed", weight: str | None = None) -> float:
    """M6 as a number. Unweighted: ``auc_by_group``; weighted: the built-in
    evaluator (``numBins=0``, a distributed sort by score)."""
    if weight is None:
        return float(auc_by_group(df, score, label).first()[0])
    data = df.select(F.col(score).cast("double").alias("__s"), F.col(label).cast("double").alias("__y"),
                     F.col(weight).cast("double").alias("__w"))
    ev = BinaryClassificationEvaluator(rawPredictionCol="__s", labelCol="__y", metricName="areaUnderROC",
                                       numBins=0, weightCol="__w")
    return float(ev.evaluate(data))
