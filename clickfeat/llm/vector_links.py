"""Embedding near-duplicates with NN-descent.

1. Vectors are normalised in double precision; equal ones become one class
   with a multiplicity, so copies are never expanded into pairs.
2. The first neighbour graph comes from ``TABLES`` random projections: vectors
   are sorted by the signs of their projections and compared within
   overlapping blocks of bounded size, so that a hot region fills no task.
3. Rounds of descent: each vector's neighbours, forward and reverse, are
   compared with one another (neighbours of neighbours) and improve one
   another's lists. A list is saturated if all of its ``K`` entries reach the
   threshold; it may then grow to twice that length. Rounds end when the graph
   no longer improves.
4. The threshold edges give components. A list still saturated at twice the length
   may hold its own component alone. So the blocks of a component with such a list
   get a ball each (centre and largest angle); every vector of another component
   that is near enough to the ball to have a link there is compared with the whole
   block. This finds all links of these components to others, however many
   neighbours of its own a vector has.
5. In each component, cut into blocks of
   at most about ``BLOCK`` vectors, block pairs are compared by a matrix product, which
   counts every vector's links exactly, also where lists were saturated. No
   pair is emitted.
6. An audit compares the counts of vectors chosen by a hash with a comparison against
   all vectors. It begins with ``AUDIT`` vectors and doubles until ``AUDIT_GROUPS``
   distinct components have a true link in it (at most ``MAX_AUDIT`` vectors). Below
   ``RECALL`` another set of projections and rounds follows; after ``PASSES`` of
   them the job fails.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components have no links and are their own component; vectors of different
length never link; rows that repeat an id keep one row each and share that
id's component; null ids count as the largest id and stay null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import materialize
from .common import NO_ID, connected_components, id_of, key_of

THRESHOLD = 0.9
K = 6
TABLES = 6
PLANES = 16
WINDOW = 64
ROUNDS = 5
BLOCK = 1024
AUDIT = 128
AUDIT_GROUPS = 32
MAX_AUDIT = 1 << 13
BALLS = 1 << 13  # balls that are broadcast at once
RECALL = 0.97
PASSES = 8
EDGES = "u long, v long, s double"


def normalised(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(key, x): every row; x is null where the vector can't be compared."""

    def run(batches):
        for b in batches:
            out = []
            for v in b.column(1).to_pylist():
                x = np.array(v, np.float64) if v and None not in v else None
                big = np.abs(x).max() if x is not None else 0.0
                if x is None or not np.isfinite(big) or big == 0:
                    out.append(None)
                else:
                    x = x / big  # so that squares neither overflow nor vanish
                    out.append((x / np.sqrt((x * x).sum()) + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["key", "x"])

    return rows.select(key_of(id_col).alias("key"), F.col(f"`{vector_col}`").alias("x")).mapInArrow(run, "key long, x binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def _edge_batch(u, v, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(u, np.int64)), pa.array(np.asarray(v, np.int64)), pa.array(np.asarray(s, np.float64))], ["u", "v", "s"])


def _best(keys: np.ndarray, x: np.ndarray, k: int, threshold: float):
    """The k nearest of each vector among the others here, and a link of each to the smallest key at the threshold."""
    s = x @ x.T
    np.fill_diagonal(s, -2.0)
    n = len(keys)
    k = min(k, n - 1)
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    rows = np.repeat(np.arange(n), k)
    u, v, w = keys[rows], keys[near.ravel()], s[rows, near.ravel()]
    low = np.where(s >= threshold, keys[None, :], NO_ID).argmin(1)
    linked = s[np.arange(n), low] >= threshold
    return np.concatenate((u, keys[linked])), np.concatenate((v, keys[low[linked]])), np.concatenate((w, s[linked, low[linked]]))


def _projected(points: DataFrame, table: int, threshold: float) -> DataFrame:
    """Edges among neighbours in the order of one random projection. points: (key, x)."""

    def code(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            codes, ties = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            data = b.column(1).to_pylist()
            dims = np.array([len(x) // 8 for x in data])
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if d not in planes:
                    planes[d] = np.random.default_rng((table, int(d))).standard_normal((d, PLANES + 1))
                p = _matrix([data[i] for i in at]) @ planes[d]
                codes[at] = (p[:, :PLANES] > 0) @ (1 << np.arange(PLANES)[::-1])
                ties[at] = p[:, PLANES]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dims), pa.array(codes), pa.array(ties)], ["key", "x", "d", "code", "tie"])

    def compare(batches):
        tail: list[tuple] = []
        for b in batches:
            rows = tail + list(zip(b.column(2).to_pylist(), b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            at = 0
            while len(rows) - at >= WINDOW:
                yield from block(rows[at : at + WINDOW])
                at += WINDOW // 2
            tail = rows[at:]
        yield from block(tail)

    def block(rows) -> Iterator[pa.RecordBatch]:
        for d in {r[0] for r in rows}:
            same = [r for r in rows if r[0] == d]
            if len(same) > 1:
                yield _edge_batch(*_best(np.array([r[1] for r in same], np.int64), _matrix([r[2] for r in same]), K, threshold))

    coded = points.mapInArrow(code, "key long, x binary, d long, code long, tie double")
    dealt = coded.repartitionByRange("d", "code", "tie").sortWithinPartitions("d", "code", "tie", "key")
    return dealt.mapInArrow(compare, EDGES)


def _nearest(edges: DataFrame, threshold: float) -> DataFrame:
    """The K best edges of each vector; saturated lists are twice as long."""
    best = edges.groupBy("u", "v").agg(F.max("s").alias("s"))
    rank = best.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))).filter(F.col("r") <= 2 * K)
    return rank.filter((F.col("r") <= K) | (F.col("s") >= threshold)).drop("r")


def _grouped(batches, key: int) -> Iterator[list[tuple]]:
    """Rows of batches sorted by the column ``key``, as one list per value."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if held and held[-1][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _descend(graph: DataFrame, points: DataFrame, threshold: float) -> DataFrame:
    """Edges found by comparing each vector's neighbours, itself included, with one another."""
    back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "s")
    back = back.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))).filter(F.col("r") <= K).drop("r")
    own = points.select(F.col("key").alias("u"), F.col("key").alias("v"))
    sets = graph.select("u", "v").union(back.select("u", "v")).union(own).distinct()
    sets = sets.join(points.select(F.col("key").alias("v"), "x"), "v").select("u", "v", "x")

    def run(batches):
        for rows in _grouped(batches, 0):
            if len(rows) > 1:
                yield _edge_batch(*_best(np.array([r[1] for r in rows], np.int64), _matrix([r[2] for r in rows]), 3, threshold))

    return sets.repartition("u").sortWithinPartitions("u").mapInArrow(run, EDGES)


def neighbour_graph(points: DataFrame, first_table: int, threshold: float, old: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(graph, links): the descended graph, and all edges at the threshold met on the way."""
    edges = None if old is None else old
    for t in range(first_table, first_table + TABLES):
        found = _projected(points, t, threshold)
        edges = found if edges is None else edges.union(found)
    edges = materialize(edges, "edges")
    links = edges.filter(F.col("s") >= threshold)
    graph = materialize(_nearest(edges, threshold), "graph")
    quality = graph.agg(F.sum("s")).first()[0] or 0.0
    for _ in range(ROUNDS):
        found = materialize(_descend(graph, points, threshold), "found")
        links = links.union(found.filter(F.col("s") >= threshold))
        graph = materialize(_nearest(graph.union(found), threshold), "graph")
        now = graph.agg(F.sum("s")).first()[0] or 0.0
        if now - quality <= 1e-3 * abs(quality):
            break
        quality = now
    return graph, links


def _blocks(comps: DataFrame) -> DataFrame:
    """(id, component, parts, b): the members of components, with their block and the number of blocks."""
    size = comps.groupBy("component").agg(F.count("*").alias("size"))
    parts = F.ceil(F.col("size") / BLOCK).cast("int")
    return comps.join(size, "component").select("id", "component", parts.alias("parts"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("b"))


def foreign_links(points: DataFrame, comps: DataFrame, graph: DataFrame, threshold: float) -> DataFrame | None:
    """Links between components, one of which has a saturated list: for each vector and block of another component its best; None without such lists."""
    spark = points.sparkSession
    full = graph.filter(F.col("s") >= threshold).groupBy("u").agg(F.count("*").alias("n")).filter(F.col("n") >= 2 * K).select(F.col("u").alias("id"))
    dense = materialize(comps.join(full, "id", "left_semi").select("component").distinct(), "dense")
    vectors = points.withColumnRenamed("key", "id")
    members = materialize(_blocks(comps).join(dense, "component").join(vectors, "id").select("component", "b", "id", "x"), "members")

    def ball(batches):
        for rows in _grouped(_tasks(batches), 0):
            x = _matrix([r[2] for r in rows])
            centre = x.mean(0)
            size = np.sqrt((centre * centre).sum())
            centre = centre / size if size > 1e-9 else x[0]
            reach = np.arccos(np.clip((x @ centre).min(), -1, 1)) + np.arccos(threshold) + 1e-6
            yield pa.RecordBatch.from_arrays([pa.array([rows[0][0][0]]), pa.array([rows[0][0][1]]), pa.array([centre.tobytes()], pa.binary()), pa.array([float(np.cos(min(reach, np.pi)))])], ["component", "b", "c", "least"])

    def _tasks(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([tuple(t.values()) for t in b.column(0).to_pylist()], pa.list_(pa.int64())), *b.columns[1:]], ["t", *b.schema.names[1:]])

    task = F.struct(F.col("component"), F.col("b").cast("long").alias("b")).alias("task")
    balls = materialize(members.select(task, "id", "x").repartition("task").sortWithinPartitions("task").mapInArrow(ball, "component long, b long, c binary, least double"), "balls")
    others = materialize(vectors.join(comps, "id", "left").select("id", "x", F.coalesce("component", "id").alias("component")), "vectors")

    def near(sent):
        def run(batches):
            by_size: dict[int, list] = {}
            for r in sent.value:
                by_size.setdefault(len(r[2]), []).append(r)
            table = {d: (_matrix([r[2] for r in rs]), np.array([r[3] for r in rs]), np.array([r[0] for r in rs]), np.array([r[1] for r in rs])) for d, rs in by_size.items()}
            for b in batches:
                data = b.column(1).to_pylist()
                keys, own = b.column(0).to_numpy(), b.column(2).to_numpy()
                for d in {len(x) for x in data} & set(table):
                    centres, least, component, block = table[d]
                    at = np.array([i for i, x in enumerate(data) if len(x) == d])
                    for i in range(0, len(at), 256):
                        some = at[i : i + 256]
                        hit = _matrix([data[j] for j in some]) @ centres.T >= least[None, :]
                        hit &= own[some][:, None] != component[None, :]
                        p, c = np.nonzero(hit)
                        if len(p):
                            yield pa.RecordBatch.from_arrays([pa.array(component[c]), pa.array(block[c]), pa.array(keys[some[p]]), pa.array([data[j] for j in some[p]], pa.binary())], ["component", "b", "id", "x"])

        return run

    def compare(batches):
        now, keys, x = None, None, None
        for b in _tasks(batches):
            rows = list(zip(*[c.to_pylist() for c in b.columns], strict=True))
            at = 0
            while at < len(rows):
                end = at
                while end < len(rows) and rows[end][:2] == rows[at][:2]:
                    end += 1
                run, at = rows[at:end], end
                ids, vectors = np.array([r[2] for r in run]), _matrix([r[3] for r in run])
                if run[0][1] == 0:  # the block's members come first
                    new = run[0][0] != now
                    now, keys = run[0][0], ids if new else np.concatenate((keys, ids))
                    x = vectors if new else np.vstack((x, vectors))
                    continue
                s = vectors @ x.T
                best = s.argmax(1)
                top = s[np.arange(len(ids)), best]
                hit = top >= threshold
                if hit.any():
                    yield _edge_batch(ids[hit], keys[best[hit]], top[hit])

    found, chunk = None, []
    total, seen = balls.count(), 0
    for r in balls.toLocalIterator():
        chunk.append((r["component"], r["b"], bytes(r["c"]), r["least"]))
        seen += 1
        if len(chunk) < BALLS and seen < total:
            continue
        asked = materialize(others.mapInArrow(near(spark.sparkContext.broadcast(chunk)), "component long, b long, id long, x binary"), "candidates")
        hit = asked.select("component", "b").distinct()
        both = members.withColumn("b", F.col("b").cast("long")).join(hit, ["component", "b"], "left_semi").withColumn("side", F.lit(0)).unionByName(asked.withColumn("side", F.lit(1)))
        rows = both.select(task, "side", "id", "x").repartition("task").sortWithinPartitions("task", "side")
        links = materialize(rows.mapInArrow(compare, EDGES), "links")
        found = links if found is None else found.union(links)
        chunk = []
    return found


def _count_links(classes: DataFrame, comps: DataFrame, threshold: float) -> DataFrame:
    """(rep, n): linked vectors of other classes, counted block by block in each component."""
    rows = _blocks(comps).join(classes, F.col("id") == F.col("rep"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o")
    pairs = rows.select("component", "id", "m", "x", "b", other).select("component", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "id", "m", "x")
    pairs = pairs.withColumn("task", F.struct("component", "i", "j")).drop("component")

    def run(batches):
        def parts(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([tuple(t.values()) for t in b.column(6).to_pylist()], pa.list_(pa.int64())), *b.columns[:6]], ["t", *b.schema.names[:6]])

        for rows in _grouped(parts(batches), 0):
            _, i, j, b, key, m, x = (np.array(c) if n < 6 else list(c) for n, c in enumerate(zip(*rows, strict=True)))
            x = _matrix(x)
            left, right = b == i[0], b == j[0]
            near = x[left] @ x[right].T >= threshold
            if i[0] == j[0]:
                np.fill_diagonal(near, False)
                keys, n = key[left], near @ m[right]
            else:
                keys, n = np.concatenate((key[left], key[right])), np.concatenate((near @ m[right], m[left] @ near))
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["rep", "n"])

    counted = pairs.repartition("task").sortWithinPartitions("task").mapInArrow(run, "rep long, n long")
    return counted.groupBy("rep").agg(F.sum("n").alias("n"))


def audit(classes: DataFrame, counted: DataFrame, comps: DataFrame, threshold: float, sample: int = AUDIT) -> float:
    """The share of the links of some vectors (smallest hash of id) that were found.

    The sample doubles until vectors of ``AUDIT_GROUPS`` components have true links, up to ``MAX_AUDIT`` vectors.
    """
    while True:
        share, groups, asked = _audit(classes, counted, comps, threshold, sample)
        if groups >= AUDIT_GROUPS or asked < sample or sample >= MAX_AUDIT:
            return share
        sample *= 4 if not groups else 2


def _audit(classes: DataFrame, counted: DataFrame, comps: DataFrame, threshold: float, sample: int) -> tuple[float, int, int]:
    """(share of the links found, components with a true link, vectors asked)."""
    named = comps.withColumnRenamed("id", "rep")
    asked = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample).join(counted, "rep", "left").join(named, "rep", "left")
    asked = asked.select("rep", "x", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "rep").alias("component")).collect()
    if not asked:
        return 1.0, 0, 0
    sent = classes.sparkSession.sparkContext.broadcast([(r["rep"], bytes(r["x"])) for r in asked])

    def run(batches):
        total = np.zeros(len(sent.value), np.int64)
        for b in batches:
            data = b.column(2).to_pylist()
            keys, m = b.column(0).to_numpy(), b.column(1).to_numpy()
            for d in {len(x) for x in data}:
                at = np.array([i for i, x in enumerate(data) if len(x) == d])
                q = [i for i, (_, x) in enumerate(sent.value) if len(x) == d]
                if q:
                    near = _matrix([sent.value[i][1] for i in q]) @ _matrix([data[i] for i in at]).T >= threshold
                    near &= np.array([sent.value[i][0] for i in q])[:, None] != keys[at][None, :]
                    total[q] += near @ m[at]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["q", "n"])

    true = {r["q"]: r["n"] for r in classes.select("rep", "m", "x").mapInArrow(run, "q long, n long").groupBy("q").agg(F.sum("n").alias("n")).collect()}
    there = sum(true.values())
    share = sum(min(true[i], r["n"]) for i, r in enumerate(asked)) / there if there else 1.0
    return share, len({r["component"] for i, r in enumerate(asked) if true[i]}), len(asked)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row."""
    rows = materialize(normalised(vectors, id_col, vector_col), "vectors")
    usable = rows.filter(F.col("x").isNotNull())
    classes = materialize(usable.groupBy("x").agg(F.min("key").alias("rep"), F.count("*").alias("m")).select("rep", "m", "x"), "classes")
    points = classes.select(F.col("rep").alias("key"), "x")
    graph = links = None
    for turn in range(PASSES):
        graph, more = neighbour_graph(points, turn * TABLES, threshold, graph)
        links = more if links is None else links.union(more)
        pairs = materialize(links.select(F.col("u").alias("a"), F.col("v").alias("b")).distinct(), "pairs")
        comps = materialize(connected_components(pairs), "components")
        foreign = foreign_links(points, comps, graph, threshold)
        if foreign is not None and not foreign.isEmpty():
            links = links.union(foreign)
            pairs = materialize(pairs.union(foreign.select(F.col("u").alias("a"), F.col("v").alias("b"))).distinct(), "pairs")
            comps = materialize(connected_components(pairs), "components")
        counted = materialize(_count_links(classes, comps, threshold), "counts")
        if (share := audit(classes, counted, comps, threshold)) >= RECALL:
            break
    else:
        raise RuntimeError(f"only {share:.3f} of the audited links were found")
    classes = classes.join(counted, "rep", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    classes = materialize(classes.select("x", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "classes")
    out = rows.join(classes, "x", "left").select(
        id_of().alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "key").alias("key"),
    )
    return out.select("vec_id", "n_links", id_of().alias("component_id"), F.col("vec_id").eqNullSafe(id_of()).alias("kept"))
