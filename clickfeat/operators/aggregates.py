"""Per-key aggregates joined back to every row.

Plan shape. Every aggregate is a hash group-by with a partial (map-side)
aggregate before the exchange, so a key that holds a third of all rows is
combined inside each map task and reaches the exchange as one row per task.
Exact distinct counts are planned by Spark as a two-level aggregate over
``(keys, value)``, which spreads a hot key over many reducers by value.

All aggregates that share a key set are fused into one group-by and one join.
The join back is a left equi-join (row count and NULL keys preserved):

* an aggregate whose keys are all calendar parts, as their columns' metadata say
  (set where the parts are computed), has a proven size bound and is broadcast;
* any other aggregate is left to the planner: the static estimate of an
  aggregate is bounded by its input, and AQE re-plans to a broadcast join
  only after measuring the materialised aggregate; otherwise it stays a
  sort-merge join whose skewed partitions AQE splits.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.stats import sample_skewness
from ..functions.timeparts import DOMAIN

KINDS = ("count", "nonnull", "nunique", "mean", "var", "skew", "max", "min", "sum")

BROADCAST_ROW_LIMIT = 100_000


@dataclass(frozen=True)
class Agg:
    """One aggregate feature: ``kind`` of ``value`` per ``keys``, named ``name``."""

    kind: str
    keys: tuple[str, ...]
    value: str | None = None
    name: str | None = None

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown aggregate kind {self.kind!r}")
        object.__setattr__(self, "keys", tuple(self.keys))
        if self.kind != "count" and self.value is None:
            raise ValueError(f"{self.kind} needs a value column")
        if self.name is None:
            object.__setattr__(self, "name", default_name(self))

    @property
    def signature(self) -> tuple:
        """Identity of the computation, independent of the output name."""
        return (self.kind, tuple(sorted(self.keys)), self.value if self.kind != "count" else None)


def default_name(a: Agg) -> str:
    if a.kind == "count":
        return K.count_name(a.keys)
    if a.kind == "nunique":
        return K.countuniq_name(a.keys, a.value)
    if a.kind == "mean":
        return K.mean_name(a.keys, a.value)
    if a.kind == "var":
        return K.var_name(a.keys, a.value)
    return "{}_by_{}_{}".format("_".join(a.keys), a.value, a.kind)


def agg_expr(a: Agg) -> Column:
    """The aggregate expression of one feature (unaliased)."""
    if a.kind == "count":
        return F.count(F.lit(1))
    v = F.col(a.value)
    if a.kind == "nonnull":
        return F.count(v)
    if a.kind == "nunique":
        return F.count_distinct(v)
    if a.kind == "mean":
        return F.avg(v.cast("double"))
    if a.kind == "var":
        return F.var_samp(v.cast("double"))
    if a.kind == "skew":
        return sample_skewness(v)
    if a.kind == "max":
        return F.max(v)
    if a.kind == "min":
        return F.min(v)
    return F.sum(v)


@dataclass
class GroupPlan:
    """Aggregates fused per key set, with duplicate computations aliased."""

    groups: dict[tuple[str, ...], list[Agg]] = field(default_factory=dict)
    aliases: dict[str, str] = field(default_factory=dict)  # extra name -> computed name

    @classmethod
    def build(cls, aggs: Iterable[Agg]) -> "GroupPlan":
        plan = cls()
        seen: dict[tuple, str] = {}
        for a in aggs:
            if a.signature in seen:
                if seen[a.signature] != a.name:
                    plan.aliases[a.name] = seen[a.signature]
                continue
            seen[a.signature] = a.name
            key = tuple(sorted(a.keys))
            plan.groups.setdefault(key, []).append(a)
        return plan


def bound_of(df: DataFrame, keys: Sequence[str]) -> float:
    """How many groups ``keys`` can have, from the columns' metadata (NULL is a value too); infinite where none says."""
    bound = 1.0
    for k in keys:
        bound *= df.schema[k].metadata.get(DOMAIN, float("inf")) + 1
    return bound


def group_table(df: DataFrame, keys: Sequence[str], aggs: Sequence[Agg]) -> DataFrame:
    """One row per key with every fused aggregate as a column."""
    return df.groupBy(*keys).agg(*[agg_expr(a).alias(a.name) for a in aggs])


def join_back(df: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left equi-join of a per-key table, broadcast only with a proven bound."""
    if bound_of(df, keys) <= BROADCAST_ROW_LIMIT:
        table = F.broadcast(table)
    return df.join(table, on=list(keys), how="left")


def add_group_features(df: DataFrame, aggs: Iterable[Agg], source: DataFrame | None = None) -> DataFrame:
    """Attach every aggregate in ``aggs`` to each row of ``df``.

    ``source`` is the table the aggregates are computed over (default ``df``),
    e.g. train rows only while the features are attached to all rows.
    """
    from .lattice import group_tables

    plan = GroupPlan.build(aggs)
    out = df
    for keys, table in group_tables(df if source is None else source, plan.groups).items():
        out = join_back(out, table, keys)
    if plan.aliases:
        out = out.withColumns({alias: F.col(target) for alias, target in plan.aliases.items()})
    return out


def global_max(df: DataFrame, col: str) -> DataFrame:
    """The maximum of one feature (one row)."""
    return df.agg(F.max(col).alias(f"max_{col}"))
