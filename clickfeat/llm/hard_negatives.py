"""Hard-negative mining by a vertical scan of columnar vectors with branch and bound (BOND).

Vectors lie in blocks, each held by dimension. An anchor reads the dimensions
of a block in the order of its own descending magnitudes. After every few of
them, what the remaining ones can still add to a row's score is bounded by the
anchor's weights and the columns' minima and maxima; rows that can't reach the
result any more leave the candidate bitmap, and the next dimensions are read
for the rest alone. Rows still there after the last dimension have exact scores.

Two scans. The first finds each anchor's positives, the best rows of its own
label; a row leaves once as many others as are wanted are surely better. The
second finds, for each positive, the best rows of other labels within a window
of scores that follows from the positive's score; a row leaves once it can't be
in the window, or once enough others are surely in it and better.

The anchors are a stated set, compared with all rows in blocks: both are cut by
a hash of the id into blocks of about ``BLOCK`` rows and ``ANCHORS`` anchors,
and each pair of blocks is one bounded group. A group returns its own best rows
alone; Spark merges them by a window whose groups are pre-pruned before the
shuffle. Nothing is broadcast or brought to the driver but two counts.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component, take no part; of rows with one id that with the least
(label, vector) stays; shorter vectors are filled with zeros; scores are exact
whatever the components' size, and one beyond the range of a long counts as its
nearest bound; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import materialize, quoted

POSITIVES = 5
NEGATIVES = 10
SCALE = 256
BLOCK = 16_384
ANCHORS = 4_096
FIRST_STEP = 4  # dimensions read before the first pruning; each step reads twice as many
_LONG = 2**63 - 1


def rows_of(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", label: Column | None = None) -> DataFrame:
    """(vec_id, label, vector): the rows that take part, one per id; ``label`` may replace the label column."""
    x = F.col("vector")
    lab = F.col(quoted(label_col)) if label is None else label
    rows = vectors.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), lab.cast("long").alias("label"), F.col(quoted(vector_col)).cast("array<double>").alias("vector"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull())
    rows = rows.filter(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(math.inf))))
    least = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r"))
    return least.select("vec_id", "r.label", "r.vector")


def integers(vectors: list[list[float]], scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of all vectors by column, (dimensions, rows); exact Python integers where a score could leave 64 bits."""
    dims = max(map(len, vectors), default=0)
    x = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    with np.errstate(over="ignore"):
        big = np.floor(x * scale)
    most = float(np.abs(big).max(initial=0))
    if most * most * max(dims, 1) < 2.0**62:
        return np.ascontiguousarray(big.T.astype(np.int64))
    whole = lambda v: int(v) * scale if abs(v) > 2.0**52 else math.floor(v * scale)
    out = np.empty((dims, len(vectors)), object)
    for i, row in enumerate(x):
        for j, v in enumerate(row.tolist()):
            out[j, i] = whole(v)
    return out


class Bounds:
    """What the dimensions from each point of an anchor's reading order on can add: least and most."""

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.order = np.argsort(-np.abs(anchor), kind="stable")
        q = anchor[self.order]
        a, b = q * low[self.order], q * high[self.order]
        zero = np.zeros(1, a.dtype)
        self.least = np.concatenate([np.cumsum(np.minimum(a, b)[::-1])[::-1], zero])
        self.most = np.concatenate([np.cumsum(np.maximum(a, b)[::-1])[::-1], zero])


def _kth(values: np.ndarray, k: int):
    """The k-th largest value, None where there are fewer."""
    if len(values) < k:
        return None
    return np.partition(values, len(values) - k)[len(values) - k]


def in_range(scores: np.ndarray) -> np.ndarray:
    """Scores as longs: those beyond the range at its bounds."""
    return np.clip(scores, -_LONG - 1, _LONG).astype(np.int64) if scores.dtype == object else scores


def vertical(columns: np.ndarray, at: np.ndarray, anchor: np.ndarray, bounds: Bounds, prune) -> tuple[np.ndarray, np.ndarray]:
    """Rows left of ``at`` (positions in the columns) and their exact scores.

    ``prune(least, most)`` says which rows stay, from the bounds of their scores.
    """
    scores = np.zeros(len(at), columns.dtype)
    done, step, dims = 0, FIRST_STEP, len(bounds.order)
    while done < dims and len(at):
        for d in bounds.order[done : done + step]:
            scores = scores + anchor[d] * columns[d][at]
        done, step = min(done + step, dims), step * 2
        stay = prune(in_range(scores + bounds.least[done]), in_range(scores + bounds.most[done]))
        if not stay.all():
            at, scores = at[stay], scores[stay]
    return at, in_range(scores)


def best(k: int):
    """Keeps what may be among the k best: rows stay while fewer than k others are surely better."""

    def prune(least, most):
        bar = _kth(least, k)
        return np.ones(len(least), bool) if bar is None else most >= bar

    return prune


def within(windows: list[tuple[int, int]], k: int):
    """Keeps what may be among the k best of any window (lowest and highest score)."""

    def prune(least, most):
        stay = np.zeros(len(least), bool)
        for low, high in windows:
            may = (most >= low) & (least <= high)
            bar = _kth(least[(least >= low) & (most <= high)], k)
            stay |= may if bar is None else may & (most >= bar)
        return stay

    return prune


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k rows of highest score, the smaller id first among equals."""
    return np.lexsort((ids, ~scores))[:k]  # ~ turns the order round and can't overflow


class Block:
    """Rows of one block by dimension, those of one label side by side."""

    def __init__(self, table: pa.Table):
        ids, labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
        order = np.lexsort((ids, labels))
        self.ids, self.labels = ids[order], labels[order]
        vectors = table.column("vector").to_pylist()
        self.columns = integers([vectors[i] for i in order.tolist()])
        self.low, self.high = self.columns.min(axis=1, initial=0), self.columns.max(axis=1, initial=0)

    def own(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, side="right"))

    def with_anchor(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, Bounds]:
        """Columns and anchor of equal length and of a type that holds every score, and the bounds."""
        columns, low, high, dims = self.columns, self.low, self.high, max(len(self.columns), len(anchor))
        if len(anchor) < dims:
            anchor = np.concatenate([anchor, np.zeros(dims - len(anchor), anchor.dtype)])
        if len(columns) < dims:
            columns = np.concatenate([columns, np.zeros((dims - len(columns), columns.shape[1]), columns.dtype)])
            low, high = columns.min(axis=1, initial=0), columns.max(axis=1, initial=0)
        widest = max((abs(int(v)) for v in (*low, *high)), default=0) * max((abs(int(v)) for v in anchor), default=0) * dims
        if columns.dtype != object and (anchor.dtype == object or widest >= 2**62):
            columns, low, high = columns.astype(object), low.astype(object), high.astype(object)
        if columns.dtype == object:
            anchor = anchor.astype(object)
        return columns, anchor, Bounds(anchor, low, high)


def _positives(k: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        block = Block(rows) if rows.num_rows else None
        for a, label, vector in zip(*(anchors.column(c).to_pylist() for c in ("vec_id", "label", "vector")), strict=True) if block else ():
            start, end = block.own(label)
            at = np.arange(start, end)
            at = at[block.ids[at] != a]
            columns, q, bounds = block.with_anchor(integers([vector])[:, 0])
            at, scores = vertical(columns, at, q, bounds, best(k))
            for i in _first(block.ids[at], scores, k).tolist():
                out.append((a, int(block.ids[at[i]]), int(scores[i])))
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("anchor_id", "positive_id", "positive_score"), cols, strict=True)})

    return run


def _negatives(k: int, low: int, high: int, unit: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[tuple] = []
        block = Block(rows) if rows.num_rows else None
        for a, label, vector, found in zip(*(anchors.column(c).to_pylist() for c in ("vec_id", "label", "vector", "positives")), strict=True) if block else ():
            # unit * negative lies between low * positive and high * positive: the whole scores for which this holds
            windows = [(-(-low * p["positive_score"] // unit), high * p["positive_score"] // unit) for p in found]
            open_ = sorted({w for w in windows if w[0] <= w[1]})
            if not open_:
                continue
            start, end = block.own(label)
            at = np.concatenate([np.arange(start), np.arange(end, len(block.ids))])
            columns, q, bounds = block.with_anchor(integers([vector])[:, 0])
            at, scores = vertical(columns, at, q, bounds, within(open_, k))
            ids = block.ids[at]
            for w in open_:
                here = np.flatnonzero((scores >= w[0]) & (scores <= w[1]))
                top = here[_first(ids[here], scores[here], k)].tolist()
                for p, own in zip(found, windows, strict=True):
                    if own == w:
                        out += [(a, p["positive_id"], p["positive_score"], int(ids[i]), int(scores[i])) for i in top]
        cols = list(zip(*out, strict=True)) or [()] * 5
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"), cols, strict=True)})

    return run


def _grid(rows: DataFrame, anchors: DataFrame, blocks: int, parts: int, run, schema: str) -> DataFrame:
    """Every block of rows with every block of anchors, a bounded group each."""
    place = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")
    left = rows.withColumn("block", place(blocks, 1)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = anchors.withColumn("part", place(parts, 2)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(run, schema)


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 30, high: int = 90, unit: int = 100, block: int = BLOCK, part: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows``: as ``rows_of`` gives them; ``anchors``: a condition on ``vec_id``.
    A negative of a positive has another label than the anchor and a score with
    ``low * positive_score <= unit * score <= high * positive_score``.
    """
    rows = materialize(rows, "vectors")
    some = rows.filter(anchors)
    n, m = rows.count(), some.count()
    blocks, parts = max(1, -(-n // block)), max(1, -(-m // part))
    near = _grid(rows, some, blocks, parts, _positives(positives), "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    near = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))
    asked = materialize(some.join(near, "vec_id"), "anchors")
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    far = _grid(rows, asked, blocks, parts, _negatives(negatives, low, high, unit), schema)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return far.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
