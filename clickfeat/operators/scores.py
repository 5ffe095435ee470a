"""Score tables: de-duplicate, attach to a test log, align and blend.

A score table is ``(click_id, is_attributed)``. Alignment is an inner join on
``click_id``: the same result as the positional alignment of files written
in the same order, and safe when they are not. Both sides are large; the
planner uses a sort-merge join with AQE skew splitting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blend as B
from ..schema import CLICK_IDENTITY

SCORE = "is_attributed"


def dedupe_scores(scored: DataFrame, keys: Sequence[str] = CLICK_IDENTITY, score: str = SCORE) -> DataFrame:
    """Mean score per click identity (duplicate clicks collapse to one)."""
    return scored.groupBy(*keys).agg(F.avg(F.col(score).cast("double")).alias(score))


def attach_scores(test: DataFrame, scores: DataFrame, keys: Sequence[str] = CLICK_IDENTITY) -> DataFrame:
    """Left join of de-duplicated scores onto the test log (unmatched -> NULL)."""
    return test.join(scores, on=list(keys), how="left")


def submission(
    test: DataFrame, scored_supplement: DataFrame, keys: Sequence[str] = CLICK_IDENTITY, score: str = SCORE
) -> DataFrame:
    """De-duplicate supplement scores, attach to test, keep ``click_id, score``."""
    attached = attach_scores(test, dedupe_scores(scored_supplement, keys, score), keys)
    return attached.select("click_id", score)


def align_scores(tables: Sequence[DataFrame], names: Sequence[str], score: str = SCORE, key: str = "click_id") -> DataFrame:
    """One row per ``click_id`` present in every table, one column per table."""
    if len(tables) != len(names):
        raise ValueError("one name per score table")
    out = tables[0].select(key, F.col(score).alias(names[0]))
    for t, n in zip(tables[1:], names[1:]):
        out = out.join(t.select(key, F.col(score).alias(n)), on=key, how="inner")
    return out


BLENDS = ("arithmetic", "geometric", "harmonic", "weighted")


def blend(aligned: DataFrame, cols: Sequence[str], how: str, weights: Sequence[float] | None = None,
          out: str = SCORE, key: str = "click_id") -> DataFrame:
    """``arithmetic`` / ``geometric`` / ``harmonic`` / ``weighted`` mean."""
    if how == "arithmetic":
        e = B.arithmetic_mean(cols)
    elif how == "geometric":
        e = B.geometric_mean(cols)
    elif how == "harmonic":
        e = B.harmonic_mean(cols)
    elif how == "weighted":
        e = B.weighted_mean(cols, weights or B.FINAL_BLEND_WEIGHTS)
    else:
        raise ValueError(how)
    return aligned.select(key, e.alias(out))
