"""The registered queries on a small table, against brute force or held-out accuracy."""

import brute
import numpy as np
import pytest

from clickfeat.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()}


def rows(spark, name):
    return QUERIES[name](spark, DIR).collect()


def test_simhash(spark, texts):
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows(spark, "op8_simhash_ball")} == brute.simhash(list(texts.items()))


def test_suffix_trees(spark, texts):
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows(spark, "op4_suffix_trees")} == brute.repeated_words(list(texts.items()), 13)


def test_sparse_suffix(spark, texts):
    want = {i: x[1] for i, x in brute.repeated_words(list(texts.items()), 50).items() if x[1]}
    got = {}
    for r in rows(spark, "op10_sparse_suffix"):
        got[r.doc_id] = got.get(r.doc_id, 0) + r.n_words
    assert got == want


def test_pii_base(spark, texts):
    for r in rows(spark, "op6_pii_bootstrap"):
        n, sha, _ = brute.pii(texts[r.doc_id])
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) == (n, sha)


def test_language_accuracy(spark):
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows(spark, "op5_language_centroids") if r.held_out]
    assert np.mean([true[r.doc_id] == r.lang_pred for r in held]) > 0.95


def test_vectors_against_all_pairs(spark):
    got = spark.read.parquet(f"{DIR}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in got], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    want = {r.vec_id: int(n) - 1 for r, n in zip(got, near.sum(1), strict=True)}
    assert {r.vec_id: r.n_links for r in rows(spark, "op1_nn_descent")} == want


def test_pipeline(spark, texts):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, DIR).collect()
    kept = {r.doc_id for r in out}
    comp = brute.simhash(list(texts.items()))
    assert kept and kept <= set(texts)
    assert len({comp[i][1] for i in kept}) == len(kept)  # one document of each group at most
    assert all(r.bin_words <= 2048 for r in out)
