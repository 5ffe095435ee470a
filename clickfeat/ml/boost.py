"""Gradient boosting that goes on where it stopped (M4, M5, M7).

Trees are fitted one by one on the gradient of the logistic loss, as
``GBTClassifier`` does: labels -1 and 1, the first tree on the labels with
weight 1, each later one on ``4 y / (1 + exp(2 y m))`` at the margin ``m`` with
the step size as its weight. A tree is grown from histograms of rows that are
binned once (``trees``), with the subsampling, feature subsets, row weights and
conditions that Spark's own trees take. Margins are written with the training
rows' blocks every few trees; the trees since then are evaluated on the bins.
So a larger budget adds trees and fits none again: a forest grown in steps is
the forest grown at once, tree by tree.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import materialize
from . import trees as T
from .forest import Forest, Node

BLOCK = 25
HELD = 8  # trees that are evaluated in each pass, at most; then their margins are stored


@dataclass
class Booster:
    """Training rows with their margins at the last block's end, and the trees so far."""

    rows: DataFrame  # blocks of bin codes, y (-1 or 1), m
    bins: T.Bins
    params: object
    nodes: list[Node] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    gains: list[tuple[int, int, float]] = field(default_factory=list)  # tree, feature, gain of every split
    held: list[tuple[T.Tree, float]] = field(default_factory=list)  # trees since the stored margins
    fitted: int = 0  # trees ever fitted

    @classmethod
    def start(cls, train: DataFrame, params, label: str = "is_attributed", features: str = "features") -> Booster:
        y = F.when(F.col(label) == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
        rows = materialize(train.select(F.col(features).alias("features"), y.alias("y")), "boost")
        bins = T.Bins.of(rows, params)
        return cls(T.blocks(rows, bins), bins, params)

    def __len__(self) -> int:
        return len(self.weights)

    def forest(self, k: int | None = None) -> Forest:
        k = len(self) if k is None else k
        return Forest.of_nodes([n for n in self.nodes if n.tree < k], self.weights[:k])

    def grow(self, upto: int) -> Booster:
        """Adds trees until there are ``upto``."""
        while len(self) < upto:
            if len(self.held) >= min(BLOCK, HELD):
                self.rows, self.held = T.stored(self.rows, self.bins, self.held), []
            i = len(self)
            self._add(T.grow_tree(self.rows, self.bins, self.params, self.held, i), 1.0 if i == 0 else self.params.step_size)
        return self

    def _add(self, tree: T.Tree, weight: float) -> None:
        nodes, gains = tree.nodes(len(self), self.bins)
        self.nodes += nodes
        self.gains += gains
        self.weights.append(weight)
        self.held.append((tree, weight))
        self.fitted += 1


def early_stopped(booster: Booster, staged: Callable[[Forest], DataFrame], best: Callable[[DataFrame], int], rounds: int, patience: int, block: int = BLOCK) -> tuple[Booster, DataFrame, int]:
    """Grows block by block until ``patience`` rounds have brought no gain or ``rounds`` is reached.

    ``staged`` gives (iteration, auc) of a forest's prefixes, ``best`` the best
    of them. No tree is fitted twice; at most one block goes beyond what the
    patience needs.
    """
    while True:
        booster.grow(min(rounds, len(booster) + block))
        table = staged(booster.forest())
        k = best(table)
        if len(booster) >= rounds or len(booster) - k >= patience:
            return booster, table, k


def gain_table(gains: Sequence[tuple[int, int, float]], names: Sequence[str], k: int) -> list[tuple[str, int, float]]:
    """(feature, splits, gain in percent) of the first ``k`` trees; one row per feature."""
    splits, gain = [0] * len(names), [0.0] * len(names)
    for tree, feature, g in gains:
        if tree < k:  # trees are numbered from 0
            splits[feature] += 1
            gain[feature] += g
    total = sum(gain) or 1.0
    return sorted(((n, s, 100.0 * g / total) for n, s, g in zip(names, splits, gain, strict=True)), key=lambda r: (-r[2], r[0]))
