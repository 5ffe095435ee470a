"""Regression trees grown level by level from histograms of binned rows (M4, M7).

The features are cut into bins once, by the rules of Spark's own trees: a
number's thresholds lie midway between its values, or where too many of them
are, at even strides of weight over a sample of ``max(max_bins ** 2, 10000)``
rows; a nominal's categories are its bins, ordered in each node by their mean
target. Rows are kept as blocks of bin codes, one byte a feature, so that a
pass reads a tenth of the vectors' bytes and bins nothing again.

A level takes one pass (the least half of the rows below the root): each task adds up rows, weight and weighted target by
node, feature and bin, and the sums, whose size is bounded by nodes, features
and bins, meet in the driver, which chooses the splits. Gain, leaf values and
the conditions on a split are those of Spark's regression trees with variance
as impurity.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import materialize
from .forest import Node

BLOCKS = "part int, block int, x binary, y binary, m binary"
MERGED = 32  # histograms that the driver adds up at once; more of them are merged before


@dataclass(frozen=True)
class Bins:
    """Thresholds of the numbers and sizes of the nominals, by feature."""

    thresholds: tuple[np.ndarray, ...]
    categories: tuple[int, ...]  # 0: a number

    @property
    def sizes(self) -> np.ndarray:
        return np.array([c or len(t) + 1 for t, c in zip(self.thresholds, self.categories, strict=True)])

    @property
    def kind(self) -> type:
        return np.uint8 if self.sizes.max(initial=1) <= 256 else np.uint16

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(features, rows) of bins; a missing number (NaN) is in the last one, which goes right."""
        out = np.empty((x.shape[1], len(x)), self.kind)
        for f, (t, c) in enumerate(zip(self.thresholds, self.categories, strict=True)):
            out[f] = x[:, f] if c else np.searchsorted(t, x[:, f])
        return out

    @classmethod
    def of(cls, rows: DataFrame, params, features: str = "features") -> Bins:
        """From the written ``rows(features, y)``; a bounded sample of them gives the thresholds."""
        n = rows.count()
        if not n:
            raise ValueError("no rows to fit trees on")
        attrs = rows.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
        arity = {a["idx"]: int(a.get("num_vals") or len(a.get("vals", ()))) for a in attrs.get("nominal", [])} | {a["idx"]: 2 for a in attrs.get("binary", [])}
        need = max(params.max_bins**2, 10_000)  # rows that Spark's own trees look at
        some = rows if n <= need else rows.sample(need / n, params.seed)
        got = some.select(vector_to_array(features).alias("x"), "y").toArrow()
        x = got["x"].combine_chunks().flatten().to_numpy().reshape(len(got), -1)
        weight = np.where(got["y"].to_numpy() > 0, float(params.pos_weight), 1.0)
        most = min(params.max_bins, n) - 1
        width = x.shape[1]
        for f, size in arity.items():
            if size > params.max_bins:
                raise ValueError(f"feature {f} has {size} categories, more than {params.max_bins} bins")
        return cls(tuple(np.zeros(0) if f in arity else thresholds(x[:, f], weight, most) for f in range(width)), tuple(arity.get(f, 0) for f in range(width)))


def thresholds(values: np.ndarray, weight: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` thresholds of a number: midway between its values, or at even strides of weight."""
    known = ~np.isnan(values)
    distinct, place = np.unique(values[known], return_inverse=True)
    middle = (distinct[:-1] + distinct[1:]) / 2
    if len(middle) <= most:
        return middle
    count = np.cumsum(np.bincount(place, weight[known]))
    stride = count[-1] / (most + 1)
    target, out = stride, []
    for i in range(1, len(count)):
        if abs(count[i - 1] - target) < abs(count[i] - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


def subset_size(strategy: str, n: int) -> int:
    """Features that a node looks at, as ``featureSubsetStrategy`` names them for a single tree."""
    named = {"all": n, "auto": n, "sqrt": math.ceil(math.sqrt(n)), "log2": max(1, math.ceil(math.log2(n))), "onethird": math.ceil(n / 3)}
    if strategy in named:
        return named[strategy]
    return min(n, int(strategy)) if strategy.isdigit() else math.ceil(float(strategy) * n)


def blocks(rows: DataFrame, bins: Bins, features: str = "features") -> DataFrame:
    """``rows(features, y)`` as written blocks of bin codes, labels and margins (zero)."""

    def pack(batches):
        part = TaskContext.get().partitionId()
        for i, b in enumerate(batches):
            if b.num_rows:
                y = b.column(1).to_numpy().astype(np.int8)
                order = np.argsort(-y, kind="stable")  # the rows with label 1 come first
                x, y = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)[order], y[order]
                data = [[part], [i], [bins.codes(x).tobytes()], [y.tobytes()], [np.zeros(len(y)).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(data, (pa.int32(), pa.int32(), *[pa.binary()] * 3), strict=True)], ["part", "block", "x", "y", "m"])

    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return materialize(rows.select(vector_to_array(features).alias("x"), "y").mapInArrow(pack, BLOCKS).repartition(tasks, "part", "block"), "blocks")


@dataclass
class Tree:
    """A tree on bins; ``left`` of a leaf is -1. ``goes[i]``: the bins that go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    goes: list[np.ndarray | None] = field(default_factory=lambda: [None])
    left: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, goes: np.ndarray, gain: float, values: Sequence[float]) -> list[int]:
        """Makes two leaves of one; returns them. The right child follows the left one."""
        at = len(self.left)
        self.feature[node], self.goes[node], self.left[node], self.gain[node] = feature, goes, at, gain
        for v in values:
            for column, new in ((self.feature, -1), (self.goes, None), (self.left, -1), (self.value, float(v)), (self.gain, 0.0)):
                column.append(new)
        return [at, at + 1]

    def each(self, x: np.ndarray, leaf: Callable[[int], float], node: int = 0):
        """What ``leaf`` says of the leaf that each row of the codes ``x`` falls into."""
        at = self.left[node]
        if at < 0:
            return leaf(node)
        return np.where(self.goes[node].take(x[self.feature[node]]), self.each(x, leaf, at), self.each(x, leaf, at + 1))

    def nodes(self, number: int, bins: Bins) -> tuple[list[Node], list[tuple[int, int, float]]]:
        """Its nodes on the features' own values, as tree ``number``, and (number, feature, gain) of its splits."""
        nodes, gains = [], []
        for i, (f, goes, at, value, gain) in enumerate(zip(self.feature, self.goes, self.left, self.value, self.gain, strict=True)):
            if at < 0:
                nodes.append(Node(number, i, value))
                continue
            if bins.categories[f]:
                nodes.append(Node(number, i, value, f, at, at + 1, 0.0, tuple(float(c) for c in np.flatnonzero(goes))))
            else:
                nodes.append(Node(number, i, value, f, at, at + 1, float(bins.thresholds[f][goes.sum() - 1])))
            gains.append((number, f, gain))
        return nodes, gains


def margins(x: np.ndarray, m: np.ndarray, trees: Sequence[tuple[Tree, float]]) -> np.ndarray:
    """Margins after some more trees, added one by one."""
    for tree, weight in trees:
        m = m + tree.each(x, lambda i: tree.value[i] * weight)  # noqa: B023
    return m


def _block(bins: Bins, x, y, m) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y = np.frombuffer(y.as_buffer(), np.int8)
    return np.frombuffer(x.as_buffer(), bins.kind).reshape(-1, len(y)), y, np.frombuffer(m.as_buffer(), float)


def stored(rows: DataFrame, bins: Bins, trees: Sequence[tuple[Tree, float]]) -> DataFrame:
    """The blocks with the margins after some more trees, written anew."""

    def run(batches):
        for b in batches:
            new = [margins(*_block(bins, x, y, m)[::2], trees).tobytes() for x, y, m in zip(*b.columns[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(new, pa.binary())], ["part", "block", "x", "y", "m"])

    return materialize(rows.mapInArrow(run, BLOCKS), "blocks")


def _histograms(rows: DataFrame, bins: Bins, params, trees: Sequence[tuple[Tree, float]], number: int, tree: Tree, open_: Sequence[int]) -> np.ndarray:
    """(3, open leaves, features, bins): rows, weight and weighted target of the rows drawn for tree ``number``."""
    first, rate, seed, heavy = number == 0, params.subsampling_rate, params.seed + number, float(params.pos_weight)
    width, most = len(bins.categories), int(bins.sizes.max())
    shape = (3, len(open_), width, most)

    def run(batches):
        out, size = np.zeros(shape), len(open_) * most
        slot = {node: i * most for i, node in enumerate(open_)}
        for b in batches:
            for part, block, *data in zip(*b.columns, strict=True):
                x, y, m = _block(bins, *data)
                if rate < 1:
                    drawn = np.flatnonzero(np.random.default_rng((seed, part.as_py(), block.as_py())).random(len(y)) < rate)
                    x, y, m = x.take(drawn, axis=1), y.take(drawn), m.take(drawn)
                at = np.broadcast_to(tree.each(x, lambda i: slot.get(i, -1)), len(y))
                if tree.left[0] >= 0:
                    mine = np.flatnonzero(at >= 0)
                    x, y, m, at = x.take(mine, axis=1), y.take(mine), m.take(mine), at.take(mine)
                target = y.astype(float)
                if not first:
                    target = 4.0 * target / (1.0 + np.exp(2.0 * target * margins(x, m, trees)))
                ones = int((y > 0).sum())
                target[:ones] *= heavy
                base = at.astype(np.intp)
                for f in range(width):
                    at = base + x[f]
                    pos, neg = (np.bincount(v, minlength=size).reshape(-1, most) for v in (at[:ones], at[ones:]))
                    out[0, :, f] += pos + neg
                    out[1, :, f] += heavy * pos + neg
                    out[2, :, f] += np.bincount(at, target, size).reshape(-1, most)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["part", "data"])

    def merge(table: pa.Table) -> pa.Table:
        return pa.table({"part": table["part"].slice(0, 1), "data": pa.array([added(table.sort_by("part")["data"]).tobytes()], pa.binary())})

    def added(some) -> np.ndarray:
        total = np.zeros(shape)
        for data in some:
            total += np.frombuffer(data.as_buffer(), float).reshape(shape)
        return total

    parts = rows.mapInArrow(run, "part int, data binary")
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    if tasks > MERGED:
        parts = parts.groupBy(F.pmod("part", F.lit(int(tasks**0.5))).alias("g")).applyInArrow(merge, "part int, data binary")
    return added(parts.toArrow().sort_by("part")["data"])  # a histogram per task


def best_split(counts: np.ndarray, bins: Bins, params, looked_at: np.ndarray):
    """(gain, feature, bins that go left, means of both sides) of a node's best split; None without a valid one."""
    n, w, s = counts
    best = None
    for f in looked_at:
        size = bins.sizes[f]
        order = np.arange(size)
        if bins.categories[f]:
            mean = np.divide(s[f, :size], w[f, :size], out=np.full(size, np.inf), where=w[f, :size] > 0)
            order = np.argsort(mean, kind="stable")
        left_n, left_w, left_s = (np.cumsum(v[f, order])[:-1] for v in (n, w, s))
        total_n, total_w, total_s = (v[f, :size].sum() for v in (n, w, s))
        right_n, right_w, right_s = total_n - left_n, total_w - left_w, total_s - left_s
        ok = np.flatnonzero((left_n >= max(1, params.min_instances_per_node)) & (right_n >= max(1, params.min_instances_per_node)))
        if not len(ok):
            continue
        gain = (left_s[ok] ** 2 / left_w[ok] + right_s[ok] ** 2 / right_w[ok] - total_s**2 / total_w) / total_w
        i = int(np.argmax(gain))
        least = max(params.min_info_gain, 1e-12 * (total_s / total_w) ** 2)  # below it, the sums' own rounding
        if gain[i] > 0 and gain[i] >= least and (best is None or gain[i] > best[0]):
            k = ok[i]
            goes = np.zeros(int(bins.sizes.max()), bool)
            goes[order[: k + 1]] = True
            best = float(gain[i]), int(f), goes, (left_s[k] / left_w[k], right_s[k] / right_w[k])
    return best


def grow_tree(rows: DataFrame, bins: Bins, params, trees: Sequence[tuple[Tree, float]], number: int) -> Tree:
    """Tree ``number`` of a forest, on the gradient at the margins of ``rows`` after ``trees``.

    Of two siblings only the one with fewer rows is added up; the other has the rest of their parent's sums.
    """
    tree, width = Tree(), len(bins.categories)
    counts = {0: _histograms(rows, bins, params, trees, number, tree, [0])[:, 0]}
    w, s = counts[0][1:, 0].sum(1)
    tree.value[0] = float(s / w) if w else 0.0
    for level in range(params.max_depth):
        split = []  # parent, smaller child, its sibling
        for node in counts:
            draw = np.random.default_rng((params.seed + number, node, width))
            looked_at = np.sort(draw.choice(width, subset_size(params.feature_subset, width), replace=False))
            found = best_split(counts[node], bins, params, looked_at)
            if found:
                gain, f, goes, values = found
                n = counts[node][0, f]
                pair = tree.split(node, f, goes, gain, values)
                split.append((node, *(pair if 2 * n[goes].sum() <= n.sum() else pair[::-1])))
        if not split or level + 1 == params.max_depth:
            break
        few = _histograms(rows, bins, params, trees, number, tree, [a for _, a, _ in split])
        after = {a: few[:, i] for i, (_, a, _) in enumerate(split)} | {b: counts[node] - few[:, i] for i, (node, _, b) in enumerate(split)}
        counts = dict(sorted(after.items()))
    return tree
