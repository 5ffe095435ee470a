"""Merkle manifest of a data set, with proofs by checkpoint and recompute.

Every row is a leaf; every tree (a group of rows, such as a language) has its
leaves in order, and ``FAN`` consecutive nodes become one node of the level
above. Only every ``STRIDE``-th level is written. An aligned subtree of
``FAN ** STRIDE`` stored nodes is the unit of work: building keeps its top
node alone, and proof extraction regenerates the levels in between from its
stored nodes, emits the siblings of each and drops them again. What is above
a subtree reaches it as one row: the path from its top to the root.

Scale: leaves are placed by a range partitioning on (tree, order) and
per-partition counts, so a tree with a third of all rows is spread over many
tasks, and no group has more than ``FAN ** STRIDE`` rows. The driver sees one
number, the size of the largest tree. All of it is Spark SQL functions.

Defined results: null fields are hashed as ``-``; null ids come first, then
by size; rows of one id are ordered by leaf, equal rows stand side by side,
each with a leaf of its own; an empty table has no rows and no root; columns
beyond the named ones are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import materialize, quoted

FAN = 8
STRIDE = 3
SUBTREE = FAN**STRIDE
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<slot:int,siblings:array<string>>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """One input of a leaf: ``-`` for null, else its UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def digest(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ""), 256)


def level_above(nodes: Column) -> Column:
    """Hashes of the runs of a subtree's level; a tree that fits in one subtree stays as it is once one node is left."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    up = F.transform(runs, lambda i: digest(F.slice(nodes, i * FAN + 1, F.lit(FAN))))
    return F.when((F.col("n") <= SUBTREE) & (F.size(nodes) == 1), nodes).otherwise(up)


@dataclass
class Forest:
    """Stored levels (tree, n, pos, hash and, on the lowest, the leaves' other columns), lowest first, and (tree, hash) roots."""

    stored: list[DataFrame]
    roots: DataFrame


def numbered(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``pos``, the place in the node's tree, and ``n``, the nodes of that tree.

    A range partitioning on (tree, order) and the running number of each row in
    its task; where a task's share of a tree begins follows from the counts of
    the tasks before it, at most one row per task and tree.
    """
    cols = [c for c in nodes.columns if c != "tree"]
    key = ["tree", *order, "tie"]
    rows = materialize(nodes.withColumn("tie", F.monotonically_increasing_id()), "nodes")
    rows = rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("at", F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("part", F.shiftright("at", 33)), "placed")
    whole = Window.partitionBy("tree")
    share = rows.groupBy("tree", "part").agg(F.count("*").alias("here"), F.min("at").alias("first"))
    share = share.select("tree", "part", "first", (F.sum("here").over(whole.orderBy("part")) - F.col("here")).alias("before"), F.sum("here").over(whole).alias("n"))
    return rows.join(share, ["tree", "part"]).select("tree", "n", (F.col("before") + F.col("at") - F.col("first")).alias("pos"), *cols)


def subtrees(nodes: DataFrame, *keep: str) -> DataFrame:
    """One row (tree, n, block, nodes) per aligned subtree of a stored level, its nodes in order."""
    block = F.expr(f"pos div {SUBTREE}").alias("block")
    return nodes.groupBy("tree", "n", block).agg(F.sort_array(F.collect_list(F.struct("pos", "hash", *keep))).alias("nodes"))


def build(leaves: DataFrame, order: Sequence[str]) -> Forest:
    """The forest over ``leaves(tree, hash, ...)``; levels between the stored ones are dropped at once."""
    now = materialize(numbered(leaves, order), "level")
    stored, roots = [], None
    most = now.agg(F.max("n")).first()[0] or 0
    while True:
        stored.append(now)
        here = subtrees(now).withColumn("level", F.col("nodes.hash"))
        for _ in range(STRIDE):
            here = here.withColumn("level", level_above(F.col("level")))
        here = here.select("tree", F.ceil(F.col("n") / SUBTREE).alias("n"), F.col("block").alias("pos"), F.col("level")[0].alias("hash"))
        here = materialize(here, "level")
        done = here.filter("n = 1").select("tree", "hash")
        roots = done if roots is None else roots.union(done)
        most = -(-most // SUBTREE)
        if most <= 1:
            return Forest(stored, roots)
        now = here.filter("n > 1")


def paths(forest: Forest, roots: DataFrame) -> DataFrame:
    """Nodes of the lowest level with the path from each to the root; ``roots(tree, path, ...)`` has the path above each tree's own root.

    (tree, pos, every other column of the nodes and of ``roots``, path). Goes
    down the stored levels: each subtree gets the one path above its top,
    regenerates its inner levels and hands every run its siblings.
    """
    extra = [c for c in roots.columns if c not in ("tree", "path")]
    above = None
    for k, nodes in reversed(list(enumerate(forest.stored))):
        keep = [c for c in nodes.columns if c not in ("tree", "n", "pos", "hash")]
        blocks = subtrees(nodes, *keep)
        tops = blocks.filter(F.col("n") <= SUBTREE).join(roots, "tree")
        if above is not None:
            up = above.withColumnRenamed("pos", "block")
            tops = tops.unionByName(blocks.filter(F.col("n") > SUBTREE).join(up.select("tree", "block", "path", *extra), ["tree", "block"]))
        above = _descend(tops, extra).select("tree", *extra, "node.*", "path")
        if k:
            above = materialize(above, "paths")
    return above


def _descend(tops: DataFrame, extra: list[str]) -> DataFrame:
    """One row (tree, extra, node, path) per node of each subtree: from its top down, one level of runs at a time."""
    level = tops.withColumn("level0", F.col("nodes.hash"))
    for j in range(1, STRIDE):
        level = level.withColumn(f"level{j}", level_above(F.col(f"level{j - 1}")))
    for j in reversed(range(STRIDE)):
        run, i, width = F.col(f"level{j}"), F.col("i"), FAN**j
        level = level.withColumn("i", F.explode(F.sequence(F.lit(0), F.size(run) - 1)))
        others = F.concat(F.slice(run, F.lit(1), i), F.slice(run, i + 2, F.lit(FAN)))
        step = F.when(F.col("n") > width, F.array(F.struct(i.alias("slot"), others.alias("siblings")))).otherwise(F.array())
        below = {f"level{m}": F.slice(f"level{m}", i * (FAN ** (j - m)) + 1, F.lit(FAN ** (j - m))) for m in range(j)}
        level = level.withColumns(below | {"nodes": F.slice("nodes", i * width + 1, F.lit(width)), "path": F.concat(step.cast(_PATH), F.col("path"))})
        level = level.select("tree", "n", *extra, *below, "nodes", "path")
    return level.select("tree", *extra, F.col("nodes")[0].alias("node"), "path")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, by: str = "lang", id_col: str = "doc_id", tampered: Column | None = None) -> DataFrame:
    """(id, leaf, claimed, subroot, root, path): every row's leaf, roots and proof.

    ``path`` lists, from the leaf up, the own place in each run of ``FAN`` and
    the siblings there. ``claimed`` is the leaf of the row as somebody else
    holds it: where ``tampered`` is true, with its text's capitals lower-cased.
    """
    own = {c: F.col(quoted(c)) for c in fields}
    changed = own | {"text": F.translate(own["text"], _UPPER, _LOWER)} if "text" in own else own
    tree = F.coalesce(F.concat(F.lit("v"), own[by].cast("string")), F.lit("n"))
    hashed = leaf(list(own.values()))
    claimed = F.when(tampered, leaf(list(changed.values()))) if tampered is not None else F.lit(None).cast("string")
    rows = docs.select(tree.alias("tree"), F.col(quoted(id_col)).alias("id"), hashed.alias("hash"), claimed.alias("claimed"))
    trees = build(rows, ["id", "hash"])
    whole = build(trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash"), ["name"])
    start = whole.roots.select("tree", F.col("hash").alias("root"), F.array().cast(_PATH).alias("path"))
    tops = paths(whole, start).select(F.col("name").alias("tree"), F.col("hash").alias("subroot"), "root", "path")
    out = paths(trees, materialize(tops, "paths"))
    return out.select("id", F.col("hash").alias("leaf"), F.coalesce("claimed", "hash").alias("claimed"), "subroot", "root", "path")


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda s: s["siblings"])), ""), 256)


def folded(rows: DataFrame, node: str = "claimed", out: str = "folded_root") -> DataFrame:
    """Adds the root that column ``node`` and the row's path give."""
    step = lambda h, s: digest(F.concat(F.slice(s["siblings"], F.lit(1), s["slot"]), F.array(h), F.slice(s["siblings"], s["slot"] + 1, F.lit(FAN))))
    return rows.withColumn(out, F.aggregate("path", F.col(node), step))
