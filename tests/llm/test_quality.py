"""Whole queries whose results SQL can't give: packing's rules and the toxicity model's held-out quality."""

import brute

from clickfeat.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


def test_packing_holds_every_word_once_without_conflicts(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    low = lambda t: " ".join(brute.words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")))
    rows = QUERIES["op2_best_fit_packing"](spark, DIR).collect()
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start_word, r.n_words))
        bins.setdefault(r.bin_id, []).append(r)
    for i, doc in docs.items():
        at = 0
        for start, n in sorted(pieces.get(i, [])):
            assert start == at
            at += n
        assert at == len(brute.words(doc.text))
    for some in bins.values():
        assert sum(r.n_words for r in some) == some[0].bin_words <= 2048
        assert len({docs[r.doc_id].source for r in some}) == len(some)
        assert len({low(docs[r.doc_id].text) for r in some}) == len(some)
        assert sorted(r.slot for r in some) == list(range(len(some)))
    assert sum(len(some) > 1 for some in bins.values()) > 5


def test_toxicity_of_held_out_documents(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = QUERIES["op3_toxicity"](spark, LARGER).collect()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    toxic = [r for r in held if labels[r.doc_id] == 1]
    clean = [r for r in held if labels[r.doc_id] == 0]
    assert len(toxic) >= 10
    assert sum(r.predicted for r in toxic) >= 0.6 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
