"""Every operator on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import brute
import pytest
from pyspark.sql import functions as F

from clickfeat.llm import decontaminate, language_id, mixing_lm, packing, pii, simhash, sparse_suffix, suffix_trees, toxicity, vector_links

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
COPY = "the same short text twice over again mail a.b@c.de now"
ROWS = [
    (1, COPY, "en", "s1"), (2, COPY, "en", None), (3, None, None, "s1"), (4, "", "de", "s1"), (5, LONG, "en", "s2"),
    (None, "text without an id " + PASSAGE, "en", "s1"), (7, "x " + PASSAGE + " y", "de", "s2"), (8, PASSAGE, "de", "s2"), (8, PASSAGE, "de", "s2"),
]
#: Names that the operators use themselves.
CLASH = ("key", "row", "h", "th", "t", "score", "features", "fp", "rep", "piece", "lower", "text_", "_id", "_hit", "x", "size", "cluster")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASH}).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def unique_rows():
    return [(i if i is not None else 2**63 - 1, t) for i, t, *_ in dict.fromkeys(ROWS)]


def test_simhash(docs, empty):
    null = lambda i: None if i == 2**63 - 1 else i
    want = {null(i): (f, null(c)) for i, (f, c) in brute.simhash(unique_rows()).items()}
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(ROWS)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out} == want
    assert simhash.near_duplicates(empty).count() == 0
    with pytest.raises(ValueError):
        simhash.near_duplicates(docs, max_bits=3)


@pytest.mark.parametrize("module,width", [(suffix_trees, 13), (sparse_suffix, 50)])
@pytest.mark.parametrize("group_rows", [1, 4000])
def test_substrings(docs, empty, module, width, group_rows):
    want = brute.repeated_words(unique_rows(), width)
    out = module.deduplicate(docs, group_rows=group_rows).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("s")).collect()
    assert len(out) == len(ROWS)
    assert {2**63 - 1 if r.doc_id is None else r.doc_id: (r.n_words, r.n_removed, r.s) for r in out} == want
    assert module.deduplicate(empty).count() == 0


def test_spans(docs):
    out = {(r.doc_id, r.start_word, r.n_words, r.first_doc_id) for r in sparse_suffix.repeats(docs).collect()}
    assert out == {(8, 0, 60, 7), (None, 4, 60, 7)}


def test_pii(docs, empty):
    out = pii.detect(docs).collect()
    assert len(out) == len(ROWS)
    texts = {r[0]: r[1] for r in ROWS}
    for r in out:
        n, sha, listed = brute.pii(texts[r.doc_id])
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256, r.spans) == (n, sha, listed)
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    assert {r.text for r in clean.filter("doc_id in (1, 2)").collect()} == {COPY.replace("a.b@c.de", "<EMAIL>")}
    assert clean.filter("text is null").count() == 1
    assert pii.detect(empty).count() == 0 and pii.redact(empty).count() == 0


def test_pii_discovers_by_context(spark):
    known = [f"reach me at contact: user{i}@host{i}.example.com today" for i in range(6)]
    rows = [(i, t) for i, t in enumerate([*known, "reach me at contact: user_77(at)host9001 today", "plain 4711 number"])]
    out = {r.doc_id: r.spans for r in pii.detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[7] == ""
    start = rows[6][1].index("user_77")
    assert out[6] == f"email:{start}:{start + len('user_77(at)host9001')}"


def test_pii_base_patterns(spark):
    texts = ["a@b.c_d@e.f.g, 1.2.3.4.5.6.7.8 999.1.1.1 004.0255.3.1", "4111 1111 1111 1111 and 4111-1111-1111-1112 x" + "9" * 5000, "+1 (555) 123-4567, +12 +1-2 ü+49.30.123456é \U0001f600 me@x.yz", "%" * 3000 + "@ a" * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.detect(df).collect():
        n, sha, _ = brute.pii(texts[r.doc_id])
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) == (n, sha)


def test_packing(docs, empty):
    out = packing.pack(docs, capacity=256, group_words=20_000).collect()
    words = sum(len(brute.words(r[1])) for r in ROWS)
    assert sum(r.n_words for r in out) == words
    bins = {}
    for r in out:
        bins.setdefault(r.bin_id, []).append(r)
    source = {r[0]: r[3] for r in ROWS}
    for rows in bins.values():
        assert sum(r.n_words for r in rows) == rows[0].bin_words <= 256
        assert len({source[r.doc_id] for r in rows}) == len(rows)
        assert not {1, 2} <= {r.doc_id for r in rows}
    assert packing.pack(empty).count() == 0


def test_packing_is_best_fit():
    import numpy as np

    rng = np.random.default_rng(1)
    sizes, src, clu = rng.integers(1, 60, 300), rng.integers(0, 9, 300), rng.integers(-1, 40, 300)
    got = packing.pack_group(sizes, src, clu, 100)
    bins = []  # plain best fit; of bins with equal room the one that got it last
    for turn, i in enumerate(np.argsort(-sizes, kind="stable")):
        fit = [(b[0], -b[3], k) for k, b in enumerate(bins) if b[0] >= sizes[i] and src[i] not in b[1] and (clu[i] == -1 or clu[i] not in b[2])]
        if fit:
            b = bins[min(fit)[2]]
        else:
            bins.append(b := [100, set(), set(), 0])
        b[0] -= sizes[i]
        b[3] = turn
        b[1].add(src[i])
        b[2].add(clu[i])
    room = sorted(b[0] for b in bins)
    assert sorted(100 - np.bincount(got, sizes).astype(int)) == room
    for k in range(got.max() + 1):
        at = got == k
        assert len(set(src[at])) == at.sum() and len(set(clu[at][clu[at] >= 0])) == (clu[at] >= 0).sum()


def test_decontamination(spark, docs, empty):
    asked = "A train leaves Boston at 14 and drives 120 km while another train leaves Denver at 15 and waits for 30 minutes"
    bench = spark.createDataFrame([(1, asked), (2, None), (3, ""), (4, "short item of six plain words")], "item_id long, text string")
    texts = [
        (1, "so " + asked), (2, asked.replace("Boston", "Paris").replace("Denver", "Oslo").replace("14", "9").replace("120", "77")),
        (3, asked.replace("train", "plane").replace("leaves", "quits").replace("and", "or")), (4, "this has a short item of six plain words in it"), (5, None),
    ]
    out = {(r.doc_id, r.item_id): r.exact for r in decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()}
    assert set(out) == {(1, 1), (2, 1), (4, 4)} and out[1, 1]
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(ROWS)
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_language(spark, docs, empty):
    rows = [(i, ("the quick house and river " if i % 2 else "der schnelle fluss und haus ") * (1 + i % 3), "en" if i % 2 else "de") for i in range(60)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    out = {r.doc_id: r for r in model.predict(spark.createDataFrame([(1, "and the river"), (2, "und der fluss"), (3, None), (4, "12 !"), (5, "")], "doc_id long, text string")).collect()}
    assert [out[i].lang_pred for i in range(1, 6)] == ["en", "de", "und", "und", "und"]
    assert all(0 <= r.score <= 1 for r in out.values())
    assert model.predict(docs).count() == len(ROWS) and model.predict(empty).count() == 0
    assert {r.lang_pred for r in language_id.fit(empty).predict(docs).collect()} == {"und"}


def test_toxicity_without_labels(docs, empty):
    model = toxicity.fit(docs.withColumn("toxic", F.lit(None).cast("int")))
    assert {r.score for r in model.score(docs.select("doc_id", "text"), keep="doc_id").collect()} == {0.0}
    assert model.score(empty.select("doc_id", "text"), keep="doc_id").count() == 0


def test_language_model(docs, empty):
    out = mixing_lm.model_scores(docs, F.col("doc_id").isNotNull()).collect()
    assert len(out) == len(ROWS)
    assert all(r.score < 0 and r.base_score < 0 for r in out)
    assert {r.n_tokens for r in out if r.doc_id in (3, 4)} == {1}
    assert mixing_lm.model_scores(empty, F.lit(True)).count() == 0
    assert all(r.n_known == 0 for r in mixing_lm.model_scores(docs, F.lit(False)).collect())


def test_vectors(spark):
    nan, v = float("nan"), [1.0, 0.0, 0.0]
    rows = [(1, v), (2, [2.0, 0.0, 0.0]), (3, None), (4, [0.0, 0.0, 0.0]), (5, [nan, 1.0, 0.0]), (6, [0.0, 1.0, 0.0]), (7, [0.1, 1.0, 0.0]), (8, []), (9, [1.0, 0.0]), (None, [1e300, 1e299, 0.0]), (11, [None, 1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit(1)).withColumn("key", F.lit("k"))
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_links.near_duplicates(df).collect()}
    assert out[1] == (2, 1, True) and out[2] == (2, 1, False) and out[None][:2] == (2, 1)
    assert out[6] == (1, 6, True) and out[7] == (1, 6, False)
    assert all(out[i] == (0, i, True) for i in (3, 4, 5, 8, 9, 11))
    assert vector_links.near_duplicates(df.limit(0)).count() == 0
