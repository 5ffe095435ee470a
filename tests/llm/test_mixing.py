import numpy as np
import pytest

from clickfeat.llm import mixing_lm
from clickfeat.llm.mixing_lm import GATES, INPUTS, Code, pieces, symbols
from clickfeat.llm.words import words_of

TEXT = " ".join(f"w{i * i % 23} rare{i}" for i in range(200)).encode()


@pytest.fixture(scope="module")
def code():
    h = np.sort(words_of([b" ".join(b"w%d" % i for i in range(23))]).hash())
    return Code.of(Code(h, [5] * len(h), 3, 9, [1] * 256).state())


def test_pieces_go_on_with_the_contexts_of_their_text(code):
    texts = [b"w1 w2", TEXT, b"", TEXT[:40], None, TEXT]
    _, _, sym, contexts, _ = symbols(texts, np.ones(6, bool), code)
    for size in (1, 30, 57, 100, 1000):
        past, got = mixing_lm.NO_PAST, []
        for _, part, ended, on in pieces(range(6), texts, size):
            _, _, s, c, past = symbols(part, ended, code, past if on else mixing_lm.NO_PAST)
            got.append((s, *c))
        for whole, parts in zip((sym, *contexts), zip(*got, strict=True), strict=True):
            np.testing.assert_array_equal(whole, np.concatenate(parts))


def test_short_texts_adapt_and_every_decision_counts():
    # Only decisions outside every fourth place tell that the weight's sign is wrong.
    n = 600
    x = np.zeros((INPUTS, n), np.float32)
    x[0, np.arange(n) % 4 != 0] = 2.0
    weights, gate = np.full((GATES, INPUTS), -0.5), np.zeros(n, np.int64)
    bit = np.ones(n, np.uint8)
    start = n * 0.25 + n * 0.75 * np.log2(1 + np.exp(1.0))
    bits, own = mixing_lm._adapt(weights, x, gate, bit, np.array([n]), 0.05)
    assert bits[0] < 0.8 * start
    assert own[0, 0] > 0 and own[1, 0] == np.float32(-0.5)
    # A following piece goes on with the weights; another text of the run does not.
    both, _ = mixing_lm._adapt(weights, np.hstack((x, x)), np.zeros(2 * n, np.int64), np.ones(2 * n, np.uint8), np.array([n, n]), 0.05, own)
    assert both[0] < bits[0] and both[1] == pytest.approx(bits[0])


def test_starting_weights_are_those_of_all_texts(spark):
    # One text with more copies than any sample holds, and others: all of them decide.
    texts = ["a b a b c"] * 1100 + [f"x{i % 7} y{i % 5} x{i % 7} z{i % 3}" for i in range(1100)]
    rows = spark.createDataFrame([(bytearray(t.encode()),) for t in texts], "text binary").repartition(4)
    seen = []
    newton = mixing_lm._newton

    def watched(sums, plain):
        seen.append((sums, newton(sums, plain)))
        return seen[-1][1]

    mixing_lm._newton = watched
    try:
        model = mixing_lm.fit(rows)
    finally:
        mixing_lm._newton = newton
    sums, weights = seen[0]
    assert np.array_equal(model.weights, weights)
    got = sums(weights)
    # Every decision of every row is in the sums: with no weights at all, each costs one bit.
    code = Code.of(model.code.state())
    raw = [t.encode() for t in texts]
    _, _, sym, contexts, _ = symbols(raw, np.ones(len(raw), bool), code)
    assert sums(np.zeros((GATES, INPUTS)))[:, 0].sum() == pytest.approx(len(mixing_lm.decisions(code, sym, contexts)[2]) * np.log(2))
    # The weights are the best ones: no small change of them costs less.
    away = weights - mixing_lm._plain_weights()
    cost = got[:, 0].sum() + mixing_lm.RIDGE / 2 * (away * away).sum()
    for move in (0.05, -0.05):
        w = weights + move
        assert sums(w)[:, 0].sum() + mixing_lm.RIDGE / 2 * ((away + move) ** 2).sum() > cost * (1 - mixing_lm.FIT_GAIN)


def test_the_code_is_broadcast_once_and_tables_do_not_stay(spark, monkeypatch):
    """Every broadcast lies on the disk of the driver and of each executor."""
    from pyspark.sql import functions as F

    sent, ended = [], []
    sc = type(spark.sparkContext)
    plain = sc.broadcast

    def broadcast(self, value):
        b = plain(self, value)
        sent.append(value)
        destroy = b.destroy
        b.destroy = lambda *a: (ended.append(len(sent)), destroy(*a))
        return b

    monkeypatch.setattr(sc, "broadcast", broadcast)
    docs = spark.createDataFrame([(i, f"some words and the word number {i % 5} again") for i in range(20)], "doc_id long, text string")
    assert mixing_lm.model_scores(docs, F.col("doc_id") % 5 != 1).count() == 20
    holds_code = lambda v: isinstance(v, dict) and "hashes" in v or isinstance(v, tuple) and any(map(holds_code, v))
    assert sum(map(holds_code, sent)) == 1
    assert len(ended) == len(sent) - 1  # all but the code's


def test_few_tasks_send_their_counts_once(spark, code, monkeypatch):
    """What counting gathers follows its tasks: a second level is for many of them, and the sums are the same."""
    kind = type(spark.range(1).groupBy("id"))
    plain, calls = kind.applyInArrow, []
    monkeypatch.setattr(kind, "applyInArrow", lambda self, *a: calls.append(1) or plain(self, *a))
    rows = spark.createDataFrame([(bytearray(f"w{i % 23} w{i % 5} rare{i}".encode()),) for i in range(300)], "text binary").repartition(4)
    sent = spark.sparkContext.broadcast(code.state())
    few = mixing_lm._tables(rows, sent, 3000)
    assert len(calls) == 1
    monkeypatch.setattr(mixing_lm, "TWO_LEVELS", 1)
    for a, b in zip(few, mixing_lm._tables(rows, sent, 4 * mixing_lm.COUNTED), strict=True):
        np.testing.assert_array_equal(a, b)
    assert len(calls) == 3 and sum(int(t.sum()) for t in few) > 0


def test_places_are_gate_and_cells():
    rng = np.random.default_rng(1)
    ready = [(rng.integers(-1000, 1001, 50) * 4 + rng.integers(0, 4, 50)).astype(np.int16) for _ in range(mixing_lm.ORDERS)]
    got = sum(mixing_lm._places(ready))
    want = mixing_lm._gate(np.zeros(50), np.arange(50), 1, ready[1] & np.int16(3), ready[2] & np.int16(3)).astype(np.int64)
    for v in ready:
        want = want * mixing_lm.LEVELS + mixing_lm._CELL[(v >> 2) + 1000]
    np.testing.assert_array_equal(got, want * 2)
    assert mixing_lm.CELLS // 2 == 16 * mixing_lm.LEVELS**mixing_lm.ORDERS * 2  # bytes use the upper half of the gates


def _sample(code):
    texts = [b"w1 w2", TEXT, b"", TEXT[:40], b"w3 w3 \xff\xfe new", TEXT[::-1], b"w5 w7 " * 400]
    _, text, sym, contexts, _ = symbols(texts, np.ones(len(texts), bool), code)
    return len(texts), text, sym, contexts


def _ready(seed):
    rng = np.random.default_rng(seed)
    return [(rng.integers(-300, 301, n) * 4 + rng.integers(0, 4, n)).astype(np.int16) for n in mixing_lm.SIZES]


def test_counts_by_groups_are_those_of_single_decisions(code):
    _, _, sym, contexts = _sample(code)
    _, slots, bit = mixing_lm.decisions(code, sym, contexts)
    want = np.zeros(2 * sum(mixing_lm.SIZES), np.int32)
    for own, at in zip(mixing_lm._views(want), slots, strict=True):
        np.add.at(own, 2 * at.astype(np.int64) + bit, 1)
    counts = mixing_lm._Counts(code)
    counts.add(sym, contexts)
    np.testing.assert_array_equal(counts.slots(), want)
    assert 2 * len(mixing_lm.groups(code, sym, contexts)[1]) < len(bit)  # what is looked up and counted


def test_cells_by_groups_are_those_of_single_decisions(code):
    _, _, sym, contexts = _sample(code)
    owner, slots, bit = mixing_lm.decisions(code, sym, contexts)
    ready = _ready(2)
    at = np.where(sym >= code.first_byte, mixing_lm.CELLS // 2, 0)[owner] + bit
    for t, x in zip(mixing_lm._places(ready), slots, strict=True):
        at = at + t[x]
    cells = mixing_lm._Cells(code, ready)
    cells.add(sym, contexts)
    met, n = cells.cells()
    want = np.unique(at, return_counts=True)
    o = np.argsort(met)
    np.testing.assert_array_equal(met[o], want[0])
    np.testing.assert_array_equal(n[o], want[1])


def test_texts_held_together_score_as_alone(code):
    k, text, sym, contexts = _sample(code)
    ready, weights = _ready(3), mixing_lm._plain_weights()
    owner, slots, bit = mixing_lm.decisions(code, sym, contexts)
    got = [t[x] for t, x in zip(ready, slots, strict=True)]
    x = np.vstack([(v >> 2).astype(np.float32) / np.float32(mixing_lm.STEP) for v in got] + [np.full(len(bit), 0.3, np.float32)])
    gate = mixing_lm._gate(sym, owner, code.first_byte, got[1] & 3, got[2] & 3)
    alone = []
    for i in range(k):
        of = text[owner] == i
        alone += mixing_lm._adapt(weights, x[:, of], gate[of], bit[of], np.array([of.sum()]), mixing_lm.RATE)[0].tolist()
    scorer = mixing_lm._Scorer(code, ready, weights)
    for i in range(k):
        of = text == i
        scorer.add(np.zeros(of.sum(), int), sym[of], [c[of] for c in contexts], 1, False)
    np.testing.assert_array_equal(scorer.bits(), alone)
    # Pieces of a text go on with its weights, whatever is held beside them.
    part = text == 1
    s, c = sym[part], [c[part] for c in contexts]
    half = len(s) // 2
    scorer.add(np.zeros(half, int), s[:half], [v[:half] for v in c], 1, False)
    first = scorer.bits()
    scorer.add(np.zeros(len(s) - half, int), s[half:], [v[half:] for v in c], 1, True)
    assert first[0] + scorer.bits()[0] < first[0] + _fresh(scorer, s[half:], [v[half:] for v in c])


def _fresh(scorer, sym, contexts):
    scorer.add(np.zeros(len(sym), int), sym, contexts, 1, False)
    return scorer.bits()[0]
