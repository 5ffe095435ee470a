"""AUC of every tree prefix on validation rows (M5): mergeable sketches first, exact counts where they decide.

One pass over the validation rows per block of prefixes: each task adds up, for
every prefix, positives and negatives by cell of the score (``CELLS`` equal
cells of the probability, the same for all tasks, so the sketches merge by
addition). What is shuffled is bounded by prefixes and cells, whatever the
rows. The cells give a lower and an upper bound of each AUC: pairs in one cell
count nothing, or fully.

Early stopping asks which prefix is better than all before it. Where the
bounds answer that, they do. Prefixes whose bounds overlap with those of
another that may be the best get their exact AUC (ties half) from the rows'
own scores, in one more pass for them alone. So the best prefix is that of
exact AUCs for all.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from .forest import Forest
from .metrics import auc_by_group

CELLS = 1 << 13
BLOCK = 50
SCHEMA = "iteration int, auc double, auc_low double, auc_high double, exact boolean"


def _rows(valid: DataFrame, label: str, features: str) -> DataFrame:
    x = F.col(features).cast("array<double>") if isinstance(valid.schema[features].dataType, ArrayType) else vector_to_array(features)
    return valid.select(F.col(label).cast("boolean").alias("y"), x.alias("x"))


def _batch(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = b.column(1)
    return b.column(0).to_numpy(zero_copy_only=False).astype(bool), x.flatten().to_numpy().reshape(len(x), -1)


def cell_of(margin: np.ndarray, cells: int) -> np.ndarray:
    """The score's cell; never falls as the margin grows."""
    p = 1 / (1 + np.exp(-2 * np.clip(margin, -300, 300)))
    return np.minimum((p * cells).astype(np.int64), cells - 1)


def sketches(forest: Forest, rows: DataFrame, start: int, stop: int, cells: int) -> DataFrame:
    """(k, cell, pos, neg) of the prefixes of start+1 .. stop trees; no cell without a row."""

    def run(batches):
        n = stop - start
        seen = np.zeros((2, n * cells), np.int64)
        for b in batches:
            y, x = _batch(b)
            if len(y):
                at = cell_of(forest.margins(x, start, stop), cells) + np.arange(n) * cells
                for side, some in enumerate((at[y], at[~y])):
                    seen[side] += np.bincount(some.ravel(), minlength=n * cells)
        met = np.flatnonzero(seen.any(0))
        for i in range(0, len(met), 50_000):
            m = met[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array((m // cells + start + 1).astype(np.int32)), pa.array((m % cells).astype(np.int32)), pa.array(seen[0, m]), pa.array(seen[1, m])], ["k", "cell", "pos", "neg"])

    parts = rows.mapInArrow(run, "k int, cell int, pos long, neg long")
    return parts.groupBy("k", "cell").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def bounds(cells: DataFrame) -> DataFrame:
    """(k, low, mid, high): bounds of each prefix's AUC, and its value with ties within a cell counted half."""
    w = Window.partitionBy("k").orderBy("cell")
    c = cells.withColumn("below", (F.sum("neg").over(w) - F.col("neg")).cast("double"))
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    pairs = F.sum(pos) * F.sum(neg)
    at = lambda share: F.sum(pos * (F.col("below") + share * neg)) / pairs
    return c.groupBy("k").agg(at(F.lit(0.0)).alias("low"), at(F.lit(0.5)).alias("mid"), at(F.lit(1.0)).alias("high"))


def exact(forest: Forest, rows: DataFrame, prefixes: Sequence[int]) -> dict[int, float]:
    """Exact AUC of some prefixes, from all rows' margins."""
    wanted = sorted(prefixes)

    def run(batches):
        for b in batches:
            y, x = _batch(b)
            have, m = 0, np.zeros(len(y))
            for k in wanted if len(y) else ():
                m, have = m + forest.between(x, have, k), k
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), k, np.int32)), pa.array(y.astype(float)), pa.array(m)], ["k", "y", "m"])

    scored = rows.mapInArrow(run, "k int, y double, m double")
    return {r.k: r.auc for r in auc_by_group(scored, "m", "y", group="k").collect()}  # one row per prefix


def undecided(low: Sequence[float], high: Sequence[float], known: Sequence[bool]) -> set[int]:
    """Places whose exact value is needed to tell each place that beats all before it.

    A place matters if it may beat all before it. Of two that matter and whose
    bounds overlap, both are needed, unless they are known already.
    """
    floor, matter = -np.inf, []
    for i, (a, b) in enumerate(zip(low, high, strict=True)):
        if b > floor:
            matter.append(i)
        floor = max(floor, a)
    need = set()
    for n, i in enumerate(matter):
        for j in matter[:n]:
            if low[i] <= high[j] and low[j] <= high[i]:
                need |= {i, j}
    return {i for i in need if not known[i]}


def staged_auc(forest: Forest, valid: DataFrame, label: str = "is_attributed", features: str = "features", block: int = BLOCK, patience: int | None = None, cells: int = CELLS) -> DataFrame:
    """(iteration, auc, auc_low, auc_high, exact) of the prefixes 1 .. n, in order.

    ``auc`` is exact where ``exact`` is true, which holds for each prefix that
    the choice of the best depends on. With ``patience``, no further blocks are
    looked at once that many prefixes have brought no gain.
    """
    rows = _rows(valid, label, features)
    out: list[list] = []
    for start in range(0, len(forest), block):
        stop = min(len(forest), start + block)
        found = sorted(bounds(sketches(forest, rows, start, stop, cells)).collect(), key=lambda r: r.k)  # a row per prefix
        out += [[r.k, r.mid, r.low, r.high, r.low == r.high] for r in found]
        need = undecided([r[2] for r in out], [r[3] for r in out], [r[4] for r in out])
        if need:
            for k, v in exact(forest, rows, [out[i][0] for i in need]).items():
                out[k - 1][1:] = [v, v, v, True]
        best = max(range(len(out)), key=lambda i: (out[i][1], -i), default=0)
        if patience is not None and len(out) - (best + 1) >= patience:
            break
    return valid.sparkSession.createDataFrame([tuple(r) for r in out], SCHEMA)
