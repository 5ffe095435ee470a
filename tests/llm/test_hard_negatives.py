"""Hard-negative mining against brute force, the bounds, and hard rows."""

import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clickfeat.llm import hard_negatives as hn
from clickfeat.llm.queries import QUERIES

DIR = "/root/testdata/sf0.01"


def whole(x):
    return int(x) * 256 if abs(x) > 2.0**52 else math.floor(256 * x)


def brute(rows, anchor, positives=5, negatives=10):
    """rows: (id, label, vector), one per id."""
    q = {i: (label, [whole(x) for x in v]) for i, label, v in rows}
    out = set()
    for a in filter(anchor, q):
        score = {i: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(q[a][1], v, strict=False)))) for i, (_, v) in q.items() if i != a}
        first = lambda ids, k: sorted(ids, key=lambda i: (-score[i], i))[:k]
        for p in first([i for i in score if q[i][0] == q[a][0]], positives):
            fit = [i for i in score if q[i][0] != q[a][0] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out |= {(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(first(fit, negatives))}
    return out


def test_query(spark):
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").collect()
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in rows]
    got = QUERIES["op11_hard_negatives"](spark, DIR)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert {tuple(r) for r in got.collect()} == brute(rows, lambda i: i % 100 == 0)


@pytest.mark.parametrize("block,part", [(1 << 14, 1 << 12), (7, 3)])
def test_hard_rows(spark, block, part):
    rng = np.random.default_rng(5)
    vectors = [(i, i % 3, rng.normal(size=8).tolist()) for i in range(60)]
    vectors += [(i, i % 3, [0.5] * 8) for i in range(60, 90)]  # ties
    vectors += [(90, 1, [1e300, -1e300]), (91, 1, [2.5e150] * 9), (92, 0, []), (93, 2, [-1e-320] * 8), (94, 0, [1e308] * 3)]
    bad = [(95, None, [1.0] * 8), (96, 1, None), (97, 1, [None, 1.0]), (98, 1, [math.nan]), (99, 1, [math.inf]), (None, 1, [1.0] * 8)]
    docs = spark.createDataFrame([*vectors, *vectors[:20], (5, 2, [9.0] * 8), *bad], "vec_id long, label int, embedding array<double>").repartition(3)
    docs = docs.withColumns({c: F.lit("x") for c in ("vector", "block", "part", "rank", "a.b", "r`s")})
    rows = hn.rows_of(docs)
    assert rows.count() == len(vectors)
    least = {5: min((vectors[5][1], vectors[5][2]), (2, [9.0] * 8))}
    want = brute([(i, *least.get(i, (label, v))) for i, label, v in vectors], lambda i: i % 10 == 0 or i > 89)
    got = hn.mine(rows, (F.col("vec_id") % 10 == 0) | (F.col("vec_id") > 89), block=block, part=part)
    assert {tuple(r) for r in got.collect()} == want
    assert hn.mine(hn.rows_of(docs.limit(0)), F.col("vec_id") % 10 == 0).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 40), st.integers(1, 30), st.integers(1, 6))
def test_bounds_never_lose_a_row(seed, n, dims, k):
    rng = np.random.default_rng(seed)
    columns = rng.integers(-9, 10, (dims, n))
    anchor = rng.integers(-9, 10, dims)
    exact = anchor @ columns
    bounds = hn.Bounds(anchor, columns.min(axis=1), columns.max(axis=1))
    at, scores = hn.vertical(columns, np.arange(n), anchor, bounds, hn.best(k))
    assert (scores == exact[at]).all()
    assert set(np.flatnonzero(exact >= np.sort(exact)[::-1][min(k, n) - 1])) <= set(at.tolist())  # ties of the last one stay too
    low, high = sorted(rng.integers(-200, 200, 2).tolist())
    at, scores = hn.vertical(columns, np.arange(n), anchor, bounds, hn.within([(low, high)], k))
    inside = np.flatnonzero((exact >= low) & (exact <= high))
    bar = np.sort(exact[inside])[::-1][: k][-1] if len(inside) else 0
    assert set(inside[exact[inside] >= bar].tolist()) <= set(at.tolist())


def test_rows_leave_early():
    """On vectors with falling magnitudes most rows are gone before the last dimensions are read."""
    rng = np.random.default_rng(1)
    columns = (rng.normal(size=(64, 4000)) * (200 * 0.8 ** np.arange(64))[:, None]).astype(int)
    read = []

    def prune(least, most, keep=hn.best(10)):
        read.append(len(least))
        return keep(least, most)

    bounds = hn.Bounds(columns[:, 0], columns.min(axis=1), columns.max(axis=1))
    at, _ = hn.vertical(columns, np.arange(4000), columns[:, 0], bounds, prune)
    assert read[-1] < 400 and len(at) < 100


def test_block_without_rows():
    table = pa.table({"vec_id": pa.array([], pa.int64()), "label": pa.array([], pa.int64()), "vector": pa.array([], pa.list_(pa.float64()))})
    assert hn._positives(5)(table, table).num_rows == 0
