"""Boosted trees as flat arrays: margins after any number of trees in one pass (M5, M8).

All nodes of all trees lie one after the other in a few arrays (feature,
threshold or set of categories, children, value). They are bounded by trees
and depth, not by the data, and go to the tasks once. A batch of rows walks
all trees of a block together, one level at a time, so neither the plan nor
the rows grow with the number of trees, and nothing is written in between.

A row goes left where its value is at most the threshold, or its category is
in the node's left set; a missing number (NaN) goes right.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TREES = 128  # trees walked together


@dataclass(frozen=True)
class Node:
    """One node of a tree as a table has it: a leaf has no children."""

    tree: int
    id: int
    value: float
    feature: int = -1
    left: int = -1
    right: int = -1
    threshold: float = 0.0
    categories: tuple[float, ...] | None = None  # those that go left; None: a number


@dataclass(frozen=True)
class Forest:
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray  # of leaves, times the tree's weight
    nominal: np.ndarray  # row of ``sets``, -1 for numbers
    sets: np.ndarray  # categories that go left
    depth: int

    @classmethod
    def of_nodes(cls, nodes: Sequence[Node], weights: Sequence[float]) -> Forest:
        nodes = sorted(nodes, key=lambda n: (n.tree, n.id))
        at = {(n.tree, n.id): i for i, n in enumerate(nodes)}
        inner = [n for n in nodes if n.left >= 0]
        widest = int(max((c for n in inner for c in n.categories or ()), default=0)) + 1
        sets, nominal = [], np.full(len(nodes), -1, np.int32)
        depth = np.zeros(len(nodes), np.int64)
        for i, n in enumerate(nodes):
            if n.left >= 0:
                depth[[at[n.tree, n.left], at[n.tree, n.right]]] = depth[i] + 1
                if n.categories is not None:
                    nominal[i] = len(sets)
                    sets.append(np.isin(np.arange(widest), n.categories))
        child = lambda side: np.array([at[n.tree, getattr(n, side)] if n.left >= 0 else i for i, n in enumerate(nodes)], np.int32)
        return cls(
            np.array([at[t, 0] for t in range(len(weights))], np.int32),
            np.array([max(n.feature, 0) for n in nodes], np.int32),
            np.array([n.threshold for n in nodes], float), child("left"), child("right"),
            np.array([n.value * weights[n.tree] for n in nodes], float),
            nominal, np.array(sets, bool).reshape(len(sets), widest), int(depth.max(initial=0)),
        )

    @classmethod
    def of(cls, model: GBTClassificationModel) -> Forest:
        """From the model's own node table; the nodes of all trees are bounded by rounds and depth."""
        return cls.of_nodes(nodes_of(model), list(model.treeWeights))

    def __len__(self) -> int:
        return len(self.roots)

    def values(self, x: np.ndarray, start: int, stop: int) -> np.ndarray:
        """What each of the trees start .. stop-1 adds to the margin of each row of ``x``."""
        rows = np.arange(len(x))[:, None]
        node = np.broadcast_to(self.roots[start:stop], (len(x), stop - start))
        for _ in range(self.depth):
            v = x[rows, self.feature[node]]
            left = v <= self.threshold[node]
            if len(self.sets):
                kind = self.nominal[node]
                code = np.where((v >= 0) & (v < self.sets.shape[1]), v, 0).astype(np.int64)
                known = (v >= 0) & (v < self.sets.shape[1])
                left = np.where(kind >= 0, self.sets[kind, code] & known, left)
            node = np.where(left, self.left[node], self.right[node])
        return self.value[node]

    def between(self, x: np.ndarray, start: int, stop: int) -> np.ndarray:
        """What the trees start .. stop-1 add to each row's margin together."""
        total = np.zeros(len(x))
        for a in range(start, stop, TREES):
            total += self.values(x, a, min(stop, a + TREES)).sum(1)
        return total

    def margins(self, x: np.ndarray, start: int, stop: int) -> np.ndarray:
        """(rows, stop - start): the margins after start+1 .. stop trees."""
        out = self.values(x, start, stop)
        out[:, 0] += self.between(x, 0, start)
        return np.cumsum(out, axis=1)


def nodes_of(model: GBTClassificationModel) -> list[Node]:
    """All nodes of a fitted model."""
    return [n for i, tree in enumerate(model.trees) for n in table_nodes(tree, i)[0]]


def table_nodes(tree, number: int) -> tuple[list[Node], list[tuple[int, int, float]]]:
    """The nodes of a single tree, as tree ``number`` of a forest, and (number, feature, gain) of its splits."""
    nodes, gains, todo, last = [], [], [(tree._call_java("rootNode"), 0)], 0
    while todo:  # at most 2 ** (depth + 1) nodes
        node, at = todo.pop()
        if node.getClass().getSimpleName() == "LeafNode":
            nodes.append(Node(number, at, node.prediction()))
            continue
        split, left, right = node.split(), last + 1, last + 2
        last += 2
        if split.getClass().getSimpleName() == "ContinuousSplit":
            nodes.append(Node(number, at, node.prediction(), split.featureIndex(), left, right, split.threshold()))
        else:
            nodes.append(Node(number, at, node.prediction(), split.featureIndex(), left, right, 0.0, tuple(split.leftCategories())))
        gains.append((number, split.featureIndex(), node.gain()))
        todo += [(node.leftChild(), left), (node.rightChild(), right)]
    return nodes, gains


def matrix(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()) if len(series) else np.zeros((0, 1))


def margin_column(forest: Forest, features: str | Column, k: int | None = None) -> Column:
    """The margin after the first ``k`` trees (all when None) as a column; ``features``: a vector column or an array."""
    k = len(forest) if k is None else min(k, len(forest))

    @F.pandas_udf("double")
    def margin(x: pd.Series) -> pd.Series:
        return pd.Series(forest.between(matrix(x), 0, k))

    return margin(vector_to_array(features) if isinstance(features, str) else features)


def probability(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))


def score_array(df: DataFrame, forest: Forest, columns: Sequence[str], out: str, k: int | None = None) -> DataFrame:
    """Adds the probability by the first ``k`` trees over plain columns (a null number counts as missing, NaN)."""
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns])
    return df.withColumn(out, probability(margin_column(forest, x, k)))
