"""Hot keys of several key sets at once, and cuts that split each into buckets of bounded size.

Finding them takes two passes for key sets of which none contains another. The first
counts rows in a number of hash slots per key set (counters, combined in the
map tasks); a key with more than ``T`` rows can only lie in a slot with more
than ``T``. The second counts the keys of those slots exactly. Key sets that contain others
come after these, and only where these have hot keys: a hot key of ``(ip, os)`` lies in a hot key of ``(ip)``.

A hot key is then cut along the row order ``(time, tie)`` by a histogram that
is refined where it has to be: its range is divided into a few cells per ``T``
rows, and every cell with more than ``T`` rows becomes a node of its own, with
cells over the range that its rows really span, by time or, where all of its
rows share one time, by the tie. Neighbouring cells are joined up to ``T`` rows.
So every bucket has at most ``2 T`` rows, whatever the bursts, and equal times
are cut as well (rows that agree in time *and* tie can't be told apart; the tie
is unique in this library).

Sizes. ``T >= N / max_heavy_keys`` (see ``SkewSplit``), so a key set has at most
``max_heavy_keys`` hot keys and, per level, ``8 * max_heavy_keys`` cells; the
tables that rows are looked up in are broadcast within this bound. They leave out what a
row that isn't found gets anyway, the first bucket: of a key with little more than ``T`` rows hardly a cell stays. Keys are
known by a 64-bit hash of their values; two keys with one hash would share
their cuts, which changes no result, as windows go by the keys themselves.
Nothing is collected but the number of hot sets and of cells left to refine.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import materialize

BUCKET = "__bucket"
HOT = "__hot"
SLOTS = 1 << 16  # counters per key set in the first pass, at least
CELLS = 2  # cells per bucket's worth of rows


@dataclass(frozen=True)
class HotStats:
    """Hot keys of several key sets: ``table(h, s, n, t0, t1, r0, r1)``, ``s`` the place in ``sets``."""

    sets: tuple[tuple[str, ...], ...]
    hot: frozenset[tuple[str, ...]]
    table: DataFrame | None
    rows: int  # T


@dataclass(frozen=True)
class HotKeys:
    """The hot keys of one key set and the levels that lead a row to its bucket."""

    keys: tuple[str, ...]
    hash: Column
    roots: DataFrame
    levels: tuple[DataFrame, ...]  # (node, cell, at), and all but the last also say where a refined cell goes on

    def bucketed(self, df: DataFrame, time: str, tie: str) -> DataFrame:
        """Adds the bucket (0 for keys that aren't hot, and the first one of those that are) and whether the key is hot.

        Broadcast joins alone: the rows stay where they are.
        """
        df = df.withColumn("__h", self.hash).join(F.broadcast(self.roots), "__h", "left")
        df = df.withColumn(HOT, F.col("__node").isNotNull())
        found = []
        for j, level in enumerate(self.levels):
            df = df.withColumn("__cell", _cell(time, tie)).drop("__dim", "__lo", "__width")
            df = df.join(F.broadcast(level.withColumnRenamed("__at", f"__at{j}")), ["__node", "__cell"], "left")
            df = df.drop("__node", "__cell").withColumnRenamed("__child", "__node")  # none in the last level
            found.append(f"__at{j}")
        df = df.withColumn(BUCKET, F.coalesce(*found, F.lit(0).cast("long")))
        return df.drop("__h", "__node", "__dim", "__lo", "__width", *found)


def _hash(index: int, keys: Sequence[str]) -> Column:
    return F.xxhash64(F.lit(index), *[F.col(k) for k in keys])


def _cell(time: str, tie: str) -> Column:
    x = F.when(F.col("__dim") == 0, F.col(time)).otherwise(F.col(tie).cast("long"))
    return _div(x - F.col("__lo"), F.col("__width"))


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of longs."""
    return F.call_function("div", a, b)


def _nodes(span_of: DataFrame, rows: int) -> DataFrame:
    """Adds dimension, lowest value and cell width of a node over rows ``n`` that span ``t0..t1`` and ``r0..r1``."""
    by_tie = F.col("t0") == F.col("t1")
    span = F.when(by_tie, F.col("r1") - F.col("r0")).otherwise(F.col("t1") - F.col("t0")) + 1
    cells = F.ceil(F.col("n") / F.lit(rows)) * CELLS
    return span_of.withColumns({
        "__dim": by_tie.cast("int"),
        "__lo": F.when(by_tie, F.col("r0")).otherwise(F.col("t0")),
        "__width": _div(span + cells - 1, cells.cast("long")),
    })


def slots_for(n: int, rows: int) -> int:
    """Counters for a table of ``n`` rows: so many that an average one holds an eighth of ``rows`` at most, so that slots without a hot key are told apart."""
    return max(SLOTS, 1 << (8 * n // max(rows, 1)).bit_length())


def waves(key_sets: Sequence[tuple[str, ...]]) -> list[list[int]]:
    """The places of the key sets in turns: each after all sets that it contains (the empty one holds back none)."""
    left, out = list(range(len(key_sets))), []
    while left:
        out.append([i for i in left if not any(key_sets[j] and set(key_sets[j]) < set(key_sets[i]) for j in left)])
        left = [i for i in left if i not in out[-1]]
    return out


def hot_stats(df: DataFrame, key_sets: Sequence[Sequence[str]], time: str, tie: str, rows: int, slots: int = SLOTS) -> HotStats:
    """The keys with more than ``rows`` rows, of all key sets, in two passes over the key columns for each of ``waves``."""
    sets = tuple(tuple(k) for k in key_sets)
    hot, cold, table = set(), set(), None
    for wave in waves(sets):
        some = [i for i in wave if not any(k < set(sets[i]) for k in map(set, cold))]
        found = _hot_keys(df, sets, some, time, tie, rows, slots) if some else None
        if found is not None:
            hot |= {sets[r.s] for r in found.select("s").distinct().collect()}  # at most one row per key set
            table = found if table is None else table.union(found)
        cold |= {sets[i] for i in wave if sets[i]} - hot
    return HotStats(sets, frozenset(hot), table if hot else None, rows)


def _hot_keys(df: DataFrame, sets, some: list[int], time: str, tie: str, rows: int, slots: int) -> DataFrame | None:
    hashes = [_hash(i, sets[i]) for i in some]
    places = [F.pmod(h, F.lit(slots)) + F.lit(i * slots) for i, h in zip(some, hashes, strict=True)]
    counted = df.select(F.explode(F.array(*places)).alias("slot")).groupBy("slot").agg(F.count("*").alias("n"))
    heavy = materialize(counted.filter(F.col("n") > rows).select("slot"), "slots")
    if heavy.isEmpty():
        return None
    pairs = F.explode(F.array(*[F.struct(s.alias("slot"), h.alias("h")) for s, h in zip(places, hashes, strict=True)]))
    seen = df.select(F.col(time).alias("t"), F.col(tie).cast("long").alias("r"), pairs.alias("p"))
    seen = seen.select("t", "r", "p.slot", "p.h").join(F.broadcast(heavy), "slot")
    spans = [F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.min("r").alias("r0"), F.max("r").alias("r1")]
    table = seen.groupBy("h", _div(F.col("slot"), F.lit(slots)).cast("int").alias("s")).agg(*spans)
    return materialize(table.filter(F.col("n") > rows), "hot")


def cuts(df: DataFrame, stats: HotStats, time: str, tie: str) -> dict[tuple[str, ...], HotKeys]:
    """Buckets of at most ``2 * stats.rows`` rows for the hot keys of every hot key set."""
    if not stats.hot:
        return {}
    rows, index = stats.rows, [i for i, k in enumerate(stats.sets) if k in stats.hot]
    roots = _nodes(stats.table.withColumnsRenamed({"h": "__h"}), rows).select("__h", "s", F.col("__h").alias("__node"), "__dim", "__lo", "__width")
    roots = materialize(roots, "roots")
    walk = df.select(F.col(time).alias("t"), F.col(tie).cast("long").alias("r"), F.explode(F.array(*[_hash(i, stats.sets[i]) for i in index])).alias("__h"))
    walk = walk.join(F.broadcast(roots), "__h")
    spans = [F.count("*").alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.min("r").alias("r0"), F.max("r").alias("r1")]
    more = (F.col("n") > rows) & ((F.col("t1") > F.col("t0")) | (F.col("r1") > F.col("r0")))
    levels, leaves, deep = [], None, []
    while True:
        walk = walk.withColumn("__cell", _cell("t", "r"))
        cells = walk.groupBy("__h", "s", "__node", "__cell").agg(*spans)
        cells = cells.withColumn("__child", F.when(more, F.monotonically_increasing_id()))
        cells = materialize(_nodes(cells, rows), "cells")
        leaf = cells.filter("__child is null").select("__h", "s", "t0", "r0", "n", F.lit(len(levels)).alias("level"), "__node", "__cell")
        leaves = leaf if leaves is None else leaves.union(leaf)
        left = cells.filter("__child is not null").select("s", "__node", "__cell", "__child", "__dim", "__lo", "__width")
        levels.append(left)
        deep.append({r.s for r in left.select("s").distinct().collect()})  # at most one row per key set
        if not deep[-1]:
            break
        walk = walk.drop("__dim", "__lo", "__width").join(F.broadcast(left.drop("s")), ["__node", "__cell"])
        walk = walk.drop("__node", "__cell").withColumnRenamed("__child", "__node")
    order = Window.partitionBy("__h").orderBy("t0", "r0")
    at = _div(F.sum("n").over(order) - F.col("n"), F.lit(rows).cast("long"))
    leaves = leaves.select("level", "s", "__node", "__cell", at.alias("__at")).filter("__at > 0")  # the others are in the first bucket, found or not
    leaves = materialize(leaves, "buckets")
    out = {}
    for i in index:
        mine = []
        for j, left in enumerate(levels):
            level = leaves.filter((F.col("level") == j) & (F.col("s") == i)).select("__node", "__cell", "__at")
            if i not in deep[j]:
                mine.append(level)
                break
            mine.append(level.unionByName(left.filter(F.col("s") == i).drop("s"), allowMissingColumns=True))
        out[stats.sets[i]] = HotKeys(stats.sets[i], _hash(i, stats.sets[i]), roots.filter(F.col("s") == i).drop("s"), tuple(mine))
    return out
