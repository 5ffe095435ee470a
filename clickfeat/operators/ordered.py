"""Ordered per-key features (W1-W5): next / previous value and running count.

Order. A click log has no stable row order in Spark, so every ordered feature
orders by ``(time, tie)`` where ``tie`` is the dense load position
``row_id``; ties in time are broken by load order.

Skew. A window puts a whole partition-by group into one task and AQE cannot
split it. A key that holds a third of all rows (``device``, the keyless
shift) would then run in one task. The two-level form used here:

1. Hot keys, those with more than ``T`` rows, are found for all key sets at
   once, and each is cut along the full order ``(time, tie)`` into buckets of
   at most ``2 T`` rows (``hotkeys``). ``T >= N / max_heavy_keys`` bounds the
   tables that rows are looked up in. The window partitions by
   ``(keys, bucket)``; every other key has the single bucket 0.
2. Per hot ``(key, bucket)``: first value, last value and row count, from the
   narrow source columns (at most ``2 * max_heavy_keys`` rows, a hash aggregate
   with partial sums). A window over this small table gives, per bucket, the
   first value of the next non-empty bucket, the last value of the previous one
   and the rows before it.
3. These carries are broadcast and used where ``lead`` or ``lag`` meets the edge
   of a bucket, and added to the running count. The rows are read once and
   shuffled once.

Rows whose key has a NULL part get NULL outputs; they are cut like any others,
so they don't gather in one task either.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import all_not_null
from ..functions.timeparts import epoch_micros, epoch_seconds
from ..schema import ORDER_TIE, ORDER_TIME
from .hotkeys import BUCKET, HOT, HotKeys, HotStats, cuts, hot_stats, slots_for

_T = "__t"  # epoch micros of the order time
_B = BUCKET
_BEFORE = "__before"  # rows of the key before this bucket

MICROS = 1_000_000
DAY_SECONDS = 86_400
# Fixed value: the "no later click" sentinel of the whole-second next-click gap.
NEXT_CLICK_SENTINEL = 3_000_000_000
FAMILY_ROWS = 100_000  # rows of a task that runs all windows of a family: each of them sorts them, and a task holds these sorts together


@dataclass(frozen=True)
class Order:
    time: str = ORDER_TIME
    tie: str = ORDER_TIE


@dataclass(frozen=True)
class SkewSplit:
    """When and how finely hot keys are split.

    ``heavy_rows``: rows above which a key is cut into time buckets. When
    None it is ``max(min_heavy_rows, ceil(N / max_heavy_keys))`` with N the
    row count (one metadata-cheap count), which bounds the number of heavy
    keys by ``max_heavy_keys``. ``enabled=False`` gives the plain window.
    """

    enabled: bool = True
    heavy_rows: int | None = None
    min_heavy_rows: int = 1_000_000
    max_heavy_keys: int = 100_000
    n_rows: int | None = None

    def resolve(self, df: DataFrame) -> "SkewSplit":
        if not self.enabled or self.n_rows is not None:
            return self
        n = df.count()
        t = max(self.min_heavy_rows, math.ceil(n / self.max_heavy_keys)) if self.heavy_rows is None else self.heavy_rows
        return replace(self, heavy_rows=t, n_rows=n)

    def may_have_heavy(self) -> bool:
        return self.enabled and (self.n_rows is None or self.n_rows > self.heavy_rows)


@dataclass(frozen=True)
class Req:
    """One ordered request: ``lead`` / ``lag`` of ``value`` or ``rownum``.

    ``monotone``: the value never falls along the row order (as the time itself).
    """

    kind: str
    out: str
    value: str | None = None  # None means the order time in epoch micros
    monotone: bool = False

    def __post_init__(self):
        if self.kind not in ("lead", "lag", "rownum"):
            raise ValueError(self.kind)


def _value_col(req: Req) -> str:
    return _T if req.value is None else req.value


def ordered_values(
    df: DataFrame,
    keys: Sequence[str],
    reqs: Sequence[Req],
    order: Order = Order(),
    skew: SkewSplit = SkewSplit(),
) -> DataFrame:
    """Add raw ``lead`` / ``lag`` values and 0-based running counts per key.

    Rows whose key has a NULL part get NULL outputs (pandas drops such keys).
    """
    return ordered_family(df, keys, [(keys, reqs)], order, skew)


def find_hot(df: DataFrame, key_sets: Sequence[Sequence[str]], order: Order = Order(), skew: SkewSplit = SkewSplit()) -> dict[tuple[str, ...], HotKeys]:
    """The key sets that have hot keys, with their cuts; all sets share the passes over ``df``."""
    skew = skew.resolve(df) if skew.enabled else skew
    if not skew.may_have_heavy():
        return {}
    base = df.withColumn(_T, epoch_micros(order.time))
    stats: HotStats = hot_stats(base, key_sets, _T, order.tie, skew.heavy_rows, slots_for(skew.n_rows, skew.heavy_rows))
    return cuts(base, stats, _T, order.tie)


def ordered_family(
    df: DataFrame,
    family_keys: Sequence[str],
    groups: Sequence[tuple[Sequence[str], Sequence[Req]]],
    order: Order = Order(),
    skew: SkewSplit = SkewSplit(),
    hot: dict[tuple[str, ...], HotKeys] | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Ordered requests of several key sets that all contain ``family_keys``.

    Without hot keys the rows are shuffled once, hash-partitioned by
    ``family_keys``: a hash partitioning on a subset of a window's keys
    satisfies that window, so every group's window runs on the same partitions
    with only a sort in between. With hot keys each group is partitioned by its
    own keys (and buckets where it has hot keys itself): finer windows under a
    cut key would carry state per bucket for every finer key.

    ``hot``: the result of ``find_hot`` for all key sets in question, found here
    when left out. ``source``: a cheap plan with the same rows and the columns
    that the requests read, for the carries; ``df`` itself when left out.
    """
    fam = list(family_keys)
    for gkeys, _ in groups:
        if not set(fam) <= set(gkeys):
            raise ValueError(f"{list(gkeys)} does not contain the family keys {fam}")
    if hot is None:
        hot = find_hot(df, list(dict.fromkeys(_hot_name(k) for k in [fam, *[g for g, _ in groups]])), order, skew)
    source = (df if source is None else source).withColumn(_T, epoch_micros(order.time))
    out = df.withColumn(_T, epoch_micros(order.time))
    if _hot_name(fam) not in hot:
        out = _plain_family(out, fam, groups, order, skew.n_rows)
    else:
        for gkeys, reqs in groups:
            found = hot.get(_hot_name(gkeys))
            out = _split(out, list(gkeys), reqs, order, found, source) if found else _plain_family(out, list(gkeys), [(gkeys, reqs)], order)
    for gkeys, reqs in groups:
        out = _null_keys(out, gkeys, reqs)
    return out.drop(_T)


def _hot_name(keys: Sequence[str]) -> tuple[str, ...]:
    return tuple(sorted(keys))


def family_tasks(df: DataFrame, rows: int | None) -> list[int]:
    """The number of a family's tasks, where it has to be asked for: then it does not follow the shuffled, compressed bytes.

    No less than the session's own number, as a join would deal the rows anew then instead of following the family.
    """
    conf = df.sparkSession.conf
    usual = int(conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None) or conf.get("spark.sql.shuffle.partitions"))
    return [] if rows is None or rows <= FAMILY_ROWS else [max(usual, math.ceil(rows / FAMILY_ROWS))]


def _plain_family(df, fam, groups, order, rows=None):
    out = df.repartition(*family_tasks(df, rows), *fam) if fam and len(groups) > 1 else df
    for gkeys, reqs in groups:
        w = Window.partitionBy(*gkeys).orderBy(F.col(_T), F.col(order.tie))
        exprs = {}
        for r in reqs:
            if r.kind == "rownum":
                exprs[r.out] = (F.row_number().over(w) - 1).cast("long")
            else:
                exprs[r.out] = (F.lead if r.kind == "lead" else F.lag)(_value_col(r)).over(w)
        out = out.withColumns(exprs)
    return out


def _split(df: DataFrame, keys: list[str], reqs: Sequence[Req], order: Order, hot: HotKeys, source: DataFrame) -> DataFrame:
    """Windows of one key set by (keys, bucket); edges of buckets take the carries."""
    values, carry = _carries(source, keys, reqs, order, hot)
    out = hot.bucketed(df, _T, order.tie).drop(HOT)
    w = Window.partitionBy(*keys, _B).orderBy(F.col(_T), F.col(order.tie))
    raw, final = {}, {}
    for i, r in enumerate(reqs):
        if r.kind == "rownum":
            raw[f"__r{i}"] = F.row_number().over(w) - 1
            final[r.out] = (F.col(f"__r{i}") + F.coalesce(F.col(_BEFORE), F.lit(0))).cast("long")
        else:
            move = F.lead if r.kind == "lead" else F.lag
            raw[f"__r{i}"], raw[f"__{r.kind}_edge"] = move(_value_col(r)).over(w), move(F.lit(1)).over(w).isNull()
            over = F.col(f"__{'next' if r.kind == 'lead' else 'prev'}{values.index(_value_col(r))}")
            final[r.out] = F.when(F.col(f"__{r.kind}_edge"), over).otherwise(F.col(f"__r{i}"))
    out = out.withColumns(raw).join(F.broadcast(carry), [*keys, _B], "left").withColumns(final)
    return out.drop(*raw, _BEFORE, _B, *[f"__{side}{i}" for i in range(len(values)) for side in ("next", "prev")])


def _carries(source: DataFrame, keys: list[str], reqs: Sequence[Req], order: Order, hot: HotKeys) -> tuple[list[str], DataFrame]:
    """Values needed at edges and, per hot key and bucket, the rows before it and the values just before and after it."""
    reqs = [r for r in reqs if r.kind != "rownum"]
    values = list(dict.fromkeys(_value_col(r) for r in reqs))
    rising = {_T, *(_value_col(r) for r in reqs if r.monotone)}
    rows = source.select(*dict.fromkeys([*keys, _T, order.tie, *values]))
    rows = hot.bucketed(rows, _T, order.tie).filter(F.col(HOT))
    if keys:
        rows = rows.filter(all_not_null(keys))
    # One number for the whole order, so that the aggregate below is a hash aggregate.
    place = F.col(_T).cast("decimal(19,0)") * F.lit(10**18).cast("decimal(19,0)") + F.col(order.tie).cast("decimal(19,0)")
    aggs = [F.count(F.lit(1)).alias("__here")]
    for i, v in enumerate(values):
        first, last = (F.min(v), F.max(v)) if v in rising else (F.min_by(v, place), F.max_by(v, place))
        aggs += [first.alias(f"__first{i}"), last.alias(f"__last{i}")]
    summary = rows.groupBy(*keys, _B).agg(*aggs)
    w = Window.partitionBy(*keys).orderBy(_B)
    carry = [(F.sum("__here").over(w) - F.col("__here")).alias(_BEFORE)]
    for i, _ in enumerate(values):
        carry += [F.lead(f"__first{i}").over(w).alias(f"__next{i}"), F.lag(f"__last{i}").over(w).alias(f"__prev{i}")]
    return values, summary.select(*keys, _B, *carry)


def _null_keys(df: DataFrame, keys: Sequence[str], reqs: Sequence[Req]) -> DataFrame:
    if not keys:
        return df
    ok = all_not_null(keys)
    return df.withColumns({r.out: F.when(ok, F.col(r.out)) for r in reqs})


# ---------------------------------------------------------------------------
# Feature forms on top of the raw values.


def floor_div(x: Column, d: int) -> Column:
    """Exact floor division of a long (``div`` truncates toward zero)."""
    return ((x - F.pmod(x, F.lit(d))) / F.lit(d)).cast("long")


def seconds_part(diff_micros: Column, wrap: str | None = "day") -> Column:
    """``Timedelta.seconds``: whole seconds, wrapped into 0-86399 by default."""
    secs = floor_div(diff_micros, MICROS)
    return F.pmod(secs, F.lit(DAY_SECONDS)) if wrap == "day" else secs


@dataclass(frozen=True)
class GapSpec:
    """W1 (``direction='next'``) or W2 (``'prev'``) click gap over ``keys``."""

    keys: tuple[str, ...]
    direction: str = "next"
    name: str | None = None
    wrap: str | None = "day"
    dtype: str = "float"


def add_click_gaps(
    df: DataFrame, specs: Sequence[GapSpec], order: Order = Order(), skew: SkewSplit = SkewSplit()
) -> DataFrame:
    """Seconds to the next / from the previous click of the same key.

    Requests that share a key set share one window (one shuffle).
    """
    from ..functions.keys import next_click_name, prev_click_name

    by_keys: dict[tuple[str, ...], list[GapSpec]] = {}
    for s in specs:
        by_keys.setdefault(tuple(s.keys), []).append(s)
    hot = find_hot(df, [_hot_name(k) for k in by_keys], order, skew)
    out = df
    for keys, group in by_keys.items():
        reqs, finals = [], {}
        for i, s in enumerate(group):
            name = s.name or (next_click_name(keys) if s.direction == "next" else prev_click_name(keys))
            raw = f"__raw{i}"
            reqs.append(Req("lead" if s.direction == "next" else "lag", raw))
            t = epoch_micros(order.time)
            diff = (F.col(raw) - t) if s.direction == "next" else (t - F.col(raw))
            finals[name] = seconds_part(diff, s.wrap).cast(s.dtype)
        out = ordered_family(out, keys, [(keys, reqs)], order, skew, hot, df)
        out = out.withColumns(finals).drop(*[r.out for r in reqs])
    return out


def add_cumcount(
    df: DataFrame, keys: Sequence[str], name: str, order: Order = Order(), skew: SkewSplit = SkewSplit()
) -> DataFrame:
    """0-based position of the row within its key."""
    return ordered_values(df, keys, [Req("rownum", name)], order, skew)


def add_next_click_sentinel(
    df: DataFrame,
    keys: Sequence[str] = ("ip", "app", "device", "os"),
    name: str = "nextClick",
    order: Order = Order(),
    skew: SkewSplit = SkewSplit(),
    hash_buckets: int | None = None,
) -> DataFrame:
    """Whole seconds to the next click of the key, sentinel minus now when last.

    ``hash_buckets`` reproduces the hashed composite key (P6), where
    different keys may share a slot.
    """
    from ..functions.keys import composite_key_bucket

    keys = list(keys)
    tmp = df.withColumn("__epoch", epoch_seconds(order.time))
    if hash_buckets:
        tmp = tmp.withColumn("__hkey", composite_key_bucket(keys, hash_buckets))
        keys = ["__hkey"]
    tmp = ordered_values(tmp, keys, [Req("lead", "__next_epoch", "__epoch", monotone=True)], order, skew)
    value = F.coalesce(F.col("__next_epoch"), F.lit(NEXT_CLICK_SENTINEL).cast("long")) - F.col("__epoch")
    return tmp.withColumn(name, value.cast("long")).drop("__epoch", "__next_epoch", "__hkey")


def add_global_shift(
    df: DataFrame, value: str, name: str | None = None, order: Order = Order(), skew: SkewSplit = SkewSplit(),
    dtype: str = "double", hot: dict[tuple[str, ...], HotKeys] | None = None, source: DataFrame | None = None,
) -> DataFrame:
    """The value of ``value`` on the previous row of the whole table.

    Keyless: the table is cut into buckets of bounded size along the row order,
    each bucket's window is a task's work, and the one row before a bucket
    comes with the broadcast carries. ``source`` has the order columns and
    ``value`` by a narrower plan. The result is a double, as a shifted column
    with a missing first value is in the original.
    """
    name = name or f"{value}_shift"
    out = ordered_family(df, [], [([], [Req("lag", name, value)])], order, skew, hot, source)
    return out.withColumn(name, F.col(name).cast(dtype))
