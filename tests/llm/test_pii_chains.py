import pytest

from clickfeat.llm import pii


def test_chains_of_any_length_are_followed(spark):
    # Each step's instances stand once after the pattern of the step before, and five times after one of their own.
    names = "abcdefgh"
    rows = [f"seen a: user{i}@host{i}.example.com" for i in range(4)] * 5
    for k in range(7):
        ids = [f"id{k}-{i}-5500 here" for i in range(4)]
        rows += [f"seen {names[k]}: {v}" for v in ids] + [f"seen {names[k + 1]}: {v}" for v in ids] * 5
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = pii.detect(docs).collect()
    assert all(r.spans for r in out)
    with pytest.raises(RuntimeError):
        spans = pii.materialize(pii._base(pii.find_spans(docs, "doc_id", "text")).select("key", "th", "base", "token"), "spans")
        pii.discover(docs, spans, rounds=3)


def test_words_before_a_token_may_hold_digits_and_be_long(spark):
    long = "x" * 80
    rows = [f"at room 12 user{i}@host{i}.example.com, t{i}: {long} mail{i}@host{i}.example.com" for i in range(5)]
    rows += ["\tgo to room 12 AB4455667 now", f"1 {long} CD9988776", "12", " 4455", ""]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = {r.doc_id: r.spans for r in pii.detect(docs).collect()}
    for i, value in ((5, "AB4455667"), (6, "CD9988776")):
        start = rows[i].index(value)
        assert out[i] == f"email:{start}:{start + len(value)}"
    assert out[7] == out[8] == out[9] == ""
