"""Feature specifications and their composition into one DataFrame plan.

A feature set is a list of specs. ``build_features`` normalises it:

* duplicate computations are computed once and aliased (Q7);
* ordered (window) features are grouped into families by key prefix: one
  hash shuffle on the family keys serves every window whose keys contain
  them (kernel 1: 12 window key sets -> 2 shuffles of the row table);
* aggregates of all key sets come from one table of counted tuples, for which the
  source is read once, and are joined back once per key set;
  joins whose keys contain a family's keys follow that family and reuse its
  partitioning (only the aggregate side is shuffled);
* a keyless feature (the global shift) of a window feature runs first, straight after
  the one window that it reads, while the rows have little but the source columns;
* hot keys of all window key sets are looked for together, in the source columns; where there may be
  some, the source is written once, and all passes read that table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.timeparts import in_test_hh
from ..operators import ordered as W
from ..operators.aggregates import Agg, GroupPlan, join_back
from ..operators.lattice import group_tables
from ..sources.sinks import materialize


@dataclass(frozen=True)
class Gap:
    """W1 / W2."""

    keys: tuple[str, ...]
    direction: str = "next"
    name: str | None = None

    @property
    def out(self) -> str:
        if self.name:
            return self.name
        return K.next_click_name(self.keys) if self.direction == "next" else K.prev_click_name(self.keys)


@dataclass(frozen=True)
class CumCount:
    """W3; ``value`` only shapes the default name."""

    keys: tuple[str, ...]
    value: str
    name: str | None = None

    @property
    def out(self) -> str:
        return self.name or K.cumcount_name(self.keys, self.value)


@dataclass(frozen=True)
class NextClick:
    """W4."""

    keys: tuple[str, ...] = ("ip", "app", "device", "os")
    name: str = "nextClick"
    hash_buckets: int | None = None

    @property
    def out(self) -> str:
        return self.name


@dataclass(frozen=True)
class Shift:
    """W5 over the whole table."""

    value: str
    name: str | None = None

    @property
    def out(self) -> str:
        return self.name or f"{self.value}_shift"


@dataclass(frozen=True)
class InTestHH:
    """P4."""

    name: str = "in_test_hh"
    hour: str = "hour"

    @property
    def out(self) -> str:
        return self.name


Spec = Agg | Gap | CumCount | NextClick | Shift | InTestHH


def spec_name(s: Spec) -> str:
    return s.name if isinstance(s, Agg) else s.out


def _canon(keys: Sequence[str]) -> tuple[str, ...]:
    return tuple(sorted(keys))


def build_features(
    df: DataFrame,
    specs: Sequence[Spec],
    order: W.Order = W.Order(),
    skew: W.SkewSplit = W.SkewSplit(),
) -> DataFrame:
    """Attach every feature in ``specs`` to each row of ``df``."""
    out = df
    for s in specs:
        if isinstance(s, InTestHH):
            out = out.withColumn(s.out, in_test_hh(s.hour))

    aggs = [s for s in specs if isinstance(s, Agg)]
    plan = GroupPlan.build(aggs)
    windows: dict[tuple[str, ...], list] = {}
    aliases = dict(plan.aliases)
    seen_windows: dict[tuple, str] = {}
    for s in specs:
        if isinstance(s, (Gap, CumCount, NextClick)):
            sig = (type(s).__name__, _canon(s.keys), getattr(s, "direction", None), getattr(s, "hash_buckets", None))
            if sig in seen_windows:
                aliases[s.out] = seen_windows[sig]
                continue
            seen_windows[sig] = s.out
            windows.setdefault(_canon(s.keys), []).append(s)

    shifts = [s for s in specs if isinstance(s, Shift)]
    src = out
    hot: dict = {}
    if windows or shifts:
        skew = skew.resolve(src) if skew.enabled else skew
        if skew.may_have_heavy():  # a dozen passes read the rows then
            src = out = materialize(src, "source")
        hot = W.find_hot(src, [*windows, *([()] if shifts else [])], order, skew)

    made = {m.out: (keys, m) for keys, members in windows.items() for m in members}
    for s in [s for s in shifts if s.value in made]:
        keys, spec = made[s.value]
        if spec in windows[keys]:
            out = _apply_family(out, keys, [(keys, [spec])], order, skew, hot, src)
            windows[keys].remove(spec)
        # the shift's edges come from this window alone, over the source columns
        narrow = _apply_family(src, keys, [(keys, [spec])], order, skew, hot, src)
        out = W.add_global_shift(out, s.value, s.out, order, skew, hot=hot, source=narrow)

    pending = group_tables(src, plan.groups)
    for fam, members in window_families([k for k, m in windows.items() if m], lambda fam: fam in hot).items():
        out = _apply_family(out, fam, [(keys, windows[keys]) for keys in members], order, skew, hot, src)
        # joins whose keys contain the family keys come right after it: the
        # rows are already hash-partitioned by the family keys, so only the
        # aggregate side is shuffled (partial-key co-partitioning)
        for keys in [k for k in pending if set(fam) <= set(k)]:
            out = join_back(out, pending.pop(keys), keys)
    for keys in join_order(list(pending)):
        out = join_back(out, pending[keys], keys)

    for s in [s for s in shifts if s.value not in made]:  # of a column or an aggregate
        out = W.add_global_shift(out, s.value, s.out, order, skew, hot=hot, source=src if s.value in src.columns else None)
    if aliases:
        out = out.withColumns({alias: F.col(target) for alias, target in aliases.items()})
    return out


def join_order(key_sets: Sequence[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """Order join-back key sets so each set is followed by its supersets.

    A sort-merge join leaves the rows hash-partitioned by its keys (unless
    AQE split a skewed partition, which drops that partitioning), so the
    superset joins that follow shuffle only their aggregate side.
    """
    rest = sorted(key_sets, key=lambda k: (len(k), k))
    order: list[tuple[str, ...]] = []
    while rest:
        base = rest.pop(0)
        order.append(base)
        sup = [k for k in rest if set(base) <= set(k)]
        order.extend(sup)
        rest = [k for k in rest if k not in sup]
    return order


def window_families(key_sets: Sequence[tuple[str, ...]], is_hot=lambda fam: False) -> dict[tuple[str, ...], list[tuple[str, ...]]]:
    """Group window key sets so each family shares one shuffle.

    Smallest sets first; a set joins the first family whose keys it
    contains, otherwise it starts a family of its own. (ip), (ip, os, device)
    and (ip, channel) share the family (ip); (device, hour) joins (device).
    A family whose keys have hot keys takes no other set: it is cut into
    time buckets, and finer windows under it would carry per-bucket state
    for every finer key; they are better partitioned by their own keys.
    """
    fams: dict[tuple[str, ...], list[tuple[str, ...]]] = {}
    for ks in sorted(key_sets, key=lambda k: (len(k), k)):
        for fam in fams:
            if set(fam) <= set(ks) and not is_hot(fam):
                fams[fam].append(ks)
                break
        else:
            fams[ks] = [ks]
    return fams


def _apply_family(df: DataFrame, fam: tuple[str, ...], members: list, order: W.Order, skew: W.SkewSplit,
                  hot: dict, src: DataFrame) -> DataFrame:
    """All window specs of a family: one shuffle, one window per key set."""
    groups, finals, drops = [], {}, []
    tmp = df
    needs_epoch = False
    n = 0
    for keys, specs in members:
        reqs = []
        for g in (s for s in specs if isinstance(s, Gap)):
            raw = f"__o{n}"
            n += 1
            reqs.append(W.Req("lead" if g.direction == "next" else "lag", raw))
            t = W.epoch_micros(order.time)
            diff = (F.col(raw) - t) if g.direction == "next" else (t - F.col(raw))
            finals[g.out] = W.seconds_part(diff, "day").cast("float")
            drops.append(raw)
        for c in (s for s in specs if isinstance(s, CumCount)):
            reqs.append(W.Req("rownum", c.out))
        for s in (s for s in specs if isinstance(s, NextClick) and not s.hash_buckets):
            raw = f"__o{n}"
            n += 1
            needs_epoch = True
            reqs.append(W.Req("lead", raw, "__epoch", monotone=True))
            nxt = F.coalesce(F.col(raw), F.lit(W.NEXT_CLICK_SENTINEL).cast("long"))
            finals[s.out] = (nxt - F.col("__epoch")).cast("long")
            drops.append(raw)
        if reqs:
            groups.append((keys, reqs))
    if needs_epoch:
        tmp, src = (x.withColumn("__epoch", W.epoch_seconds(order.time)) for x in (tmp, src))
        drops.append("__epoch")
    if groups:
        tmp = W.ordered_family(tmp, fam, groups, order, skew, hot, src)
        tmp = tmp.withColumns(finals).drop(*drops)
    for keys, specs in members:
        for s in specs:
            if isinstance(s, NextClick) and s.hash_buckets:
                tmp = W.add_next_click_sentinel(tmp, s.keys, s.out, order, skew, s.hash_buckets)
    return tmp


def feature_names(specs: Sequence[Spec]) -> list[str]:
    return [spec_name(s) for s in specs]
