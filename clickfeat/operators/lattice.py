"""Aggregates of many key sets from one pass over the log.

Count, non-null count, distinct count, mean and variance of ``value`` per
``keys`` are the same over the log and over its distinct tuples with the number
of times each occurs: a count becomes a sum of these numbers, a mean a weighted
mean, and a distinct count stays as it is. So the log is read once, for the
tuples of all columns that any aggregate needs; they are written, and every key
set is aggregated from them, all of its aggregates in one group-by. The table
has no more rows than the log, only the columns in question, and what the log's
own plan computes (parsed text, time parts) is not computed again.

Tuples are dealt by all of their columns, so a key with a third of the log's
rows is spread by its values, and partial sums leave one row a task of it.

Sums that a variance needs are exact decimals: no cancellation, whatever the
number of rows. Columns must compare exactly (whole numbers, text, dates);
aggregates of other columns and kinds are left to ``group_table``, and so are
fewer than ``FEWEST`` key sets, for which a table of tuples does not pay.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.sinks import materialize
from .aggregates import Agg, group_table

N = "__n"
FEWEST = 3
KINDS = ("count", "nonnull", "nunique", "mean", "var")
_EXACT = (T.IntegralType, T.StringType, T.DateType, T.BooleanType)
_SUM = "decimal(38,0)"


def fits(df: DataFrame, a: Agg) -> bool:
    """Whether the aggregate follows from counted tuples."""
    types = {f.name: f.dataType for f in df.schema}
    cols = [*a.keys, *([a.value] if a.value else [])]
    number = {"mean": T.IntegralType, "var": (T.ByteType, T.ShortType, T.IntegerType)}.get(a.kind)
    whole = number is None or isinstance(types.get(a.value), number)
    return a.kind in KINDS and whole and all(isinstance(types.get(c), _EXACT) for c in cols)


def tuples(df: DataFrame, aggs: Sequence[Agg]) -> DataFrame:
    """The distinct tuples of all columns that ``aggs`` need, and how often each occurs; written once."""
    cols = sorted({c for a in aggs for c in [*a.keys, *([a.value] if a.value else [])]})
    return materialize(df.groupBy(*cols).agg(F.count(F.lit(1)).alias(N)), "tuples")


def weighted(a: Agg) -> Column:
    """``agg_expr`` over counted tuples."""
    n = F.col(N)
    if a.kind == "count":
        return F.sum(n)
    v = F.col(a.value)
    if a.kind == "nunique":
        return F.count_distinct(v)
    known = F.coalesce(F.sum(F.when(v.isNotNull(), n)), F.lit(0).cast("long"))
    if a.kind == "nonnull":
        return known
    if a.kind == "mean":
        return F.when(known > 0, F.sum(n * v.cast("double")) / known)
    x = v.cast("decimal(19,0)")
    one = (n.cast("decimal(19,0)") * x).cast(_SUM)
    s, q = F.sum(one), F.sum((one * x).cast(_SUM))
    exact = F.try_subtract(F.try_multiply(known.cast("decimal(19,0)"), q), F.try_multiply(s, s)).cast("double")
    rounded = known * q.cast("double") - s.cast("double") * s.cast("double")  # beyond 38 digits
    return F.when(known > 1, F.coalesce(exact, rounded) / (known.cast("double") * (known - 1)))


def group_tables(df: DataFrame, groups: Mapping[tuple[str, ...], Sequence[Agg]]) -> dict[tuple[str, ...], DataFrame]:
    """One row per key with every aggregate as a column, for each key set."""
    mine = {keys: [a for a in aggs if fits(df, a)] for keys, aggs in groups.items()}
    if sum(map(bool, mine.values())) < FEWEST:
        return {keys: group_table(df, keys, aggs) for keys, aggs in groups.items()}
    table = tuples(df, [a for aggs in mine.values() for a in aggs])
    out = {}
    for keys, aggs in groups.items():
        rest = [a for a in aggs if a not in mine[keys]]
        if not mine[keys]:
            out[keys] = group_table(df, keys, rest)
            continue
        out[keys] = table.groupBy(*keys).agg(*[weighted(a).alias(a.name) for a in mine[keys]])
        if rest:
            names = {k: f"__k{i}" for i, k in enumerate(keys)}
            other = group_table(df, keys, rest).withColumnsRenamed(names)
            same = [F.col(x).eqNullSafe(F.col(k)) for k, x in names.items()]
            out[keys] = out[keys].join(other, same).drop(*names.values())
    return out
