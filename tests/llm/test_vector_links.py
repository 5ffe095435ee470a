import numpy as np
import pytest

from clickfeat.llm import vector_links


def _near(x, cosine, rng):
    y = rng.standard_normal(x.shape)
    y -= (y @ x) * x
    return cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y)


def test_dense_groups_that_touch_are_one_component(spark):
    # Pairs of tight groups of 40, their cosine just above the threshold: every list is full of the own group.
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for pair in range(20):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        first = len(rows)
        for centre in (a, _near(a, 0.907, rng)):
            for _ in range(40):
                want[len(rows)] = first
                rows.append(_near(centre, 0.99999, rng))
    rows += list(rng.standard_normal((3000, 64)))
    x = np.array([v / np.linalg.norm(v) for v in rows])
    links = (x @ x.T >= 0.9).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in vector_links.near_duplicates(df).collect()}
    assert all(got[i].component_id == first for i, first in want.items())
    assert all(got[i].n_links == links[i] for i in range(len(rows)))


def test_too_low_an_audit_fails(spark, monkeypatch):
    monkeypatch.setattr(vector_links, "audit", lambda *a, **k: 0.5)
    monkeypatch.setattr(vector_links, "PASSES", 1)
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99, 0.01])], "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError):
        vector_links.near_duplicates(df).count()
