"""Language-model scoring by online logistic context mixing.

A text is a sequence of words (ASCII capitals lowered) and one end. Each symbol
is written as bits along a Huffman code of the ``VOCABULARY`` most frequent
training tokens (seen twice or more), the end and an escape; an escaped word follows byte by byte,
with a blank as its end, along a Huffman code of the training bytes. Both codes
are prefix codes, so the product of the bits' probabilities is a probability
of the text.

Each bit is predicted from several hashed contexts: for words, the node of the
code alone, with the last word, and with the last two words; for bytes, the
node with the last one, two and three bytes. The slots of a few successive nodes
stand side by side, found by one hash of the first of them; such a group is what the passes
look up and count, its decisions follow from its place in the code. A context's prediction comes from
the counts of zeros and ones that all training texts left in its slot. The
predictions are mixed in the logistic domain. The weights are chosen by a
gate: kind of symbol, and how often the longer contexts were seen. Starting
weights are fitted on all training texts, each row counting once. The texts are in two halves
by a hash, so that equal ones are in the same, and each half is predicted from the
other's counts alone: no text and no copy of it speaks for itself.
One pass adds up all decisions by gate, bit and the cell of their predictions (``LEVELS`` a context), and Newton steps run on
that table, whose size does not depend on the input; while a text is scored the weights follow its bits by a gradient
step after each ``BLOCK`` of decisions, from all of the block's decisions.

Counts are summed over all training texts by shuffles of compressed slabs, in
two levels where many tasks count, so that none gathers from all others; the number
of these tasks follows the texts' bytes, as each sends a whole model. The model has a fixed
number of slots and is broadcast. The base score needs the count of every
token: frequent ones, bounded in number, are broadcast; the others are joined.

Defined results: null text is empty text (one end token); a text beyond
``PIECE`` bytes is handled in pieces cut between words, each of which goes on with
the weights and the last two words of the one before; without training
texts all counts are zero; repeated rows count as often as they occur.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import materialize
from .words import LOWER, Lookup, U, chunks, mix, words_of

VOCABULARY = 1 << 17  # tokens with a code of their own
FREQUENT = 1 << 19  # tokens whose counts are broadcast
SIZES = (1 << 19, 1 << 22, 1 << 22)  # slots of the contexts' tables; the first is indexed directly, the others by hash
DIRECT = 1 << 18  # in the first table, slots of bytes follow those of the token code's nodes
ORDERS = 3
SLAB = 1 << 15
FIT_GAIN = 1e-3  # the fit of starting weights ends when a step promises less than this share of the cost
FIT_STEPS = 100
LEVELS = 31  # cells of a stretched prediction, half a unit wide, the outer ones open
RIDGE = 1.0  # pull of a gate's weights to the plain ones, in decisions
BLOCK = 64  # decisions between two steps of a text's weights, at its beginning
EARLY = 32  # blocks of that size; the weights have found their place then, and the blocks after them are longer
LATER = 256
RATE = 0.05
PIECE = 1 << 17  # bytes of text handled at once
SPAN = 1 << 15  # decisions whose inputs are made at once
HELD = 1 << 22  # decisions whose predictions are held, so that the weights of many texts take their steps together
TOGETHER = 512  # texts from which on no more are held: a round's arrays should stay in a core's cache
TOKEN, BYTE, END = 0, 1, 2
NO_PAST = U(7), U(7)  # stand for the two tokens before a text
N_SLABS = sum(SIZES) // SLAB
COUNTED = 48 << 20  # bytes of words for each counting task
TWO_LEVELS = 4  # counting tasks from which on their models are added up in two levels
GROUP = 4  # decisions of a path whose slots are neighbours
FIRST = 1 << GROUP + 1  # marks the first decision of a path
STEP = 16  # of a stretched prediction, as it is stored
GATES = 32
INPUTS = ORDERS + 1
ROW = "row long, doc_id long, learned boolean, n_bytes long, n_tokens long, top_known long, top_score double, bits double, rest_h array<long>, rest_n array<int>"


def huffman(weights: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A prefix code: offsets of the symbols' paths, nodes and bits of the paths. Equal weights merge in order."""
    n = len(weights)
    heap = [(max(int(w), 1), i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    parent, side = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.uint8)
    node = n
    while len(heap) > 1:
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i], parent[j], side[j] = node, node, 1
        heapq.heappush(heap, (a + b, node))
        node += 1
    root = node - 1
    paths, bits, offsets = [], [], [0]
    for i in range(n):
        p, s = [], []
        while i != root:
            p.append(parent[i] - n)
            s.append(side[i])
            i = parent[i]
        paths += p[::-1]
        bits += s[::-1]
        offsets.append(len(paths))
    return np.array(offsets, np.int64), np.array(paths, np.int64), np.array(bits, np.uint8)


class Code:
    """The code of tokens and bytes. ``hashes`` are sorted; symbol i is hashes[i], then come end and escape."""

    def __init__(self, hashes, counts, ends, escapes, byte_counts):
        n = len(hashes)
        self.hashes, self.end, self.escape = hashes, n, n + 1
        o, p, b = huffman([*counts, ends, escapes])
        q, r, s = huffman(byte_counts)
        # One list of paths: byte symbols come after the token symbols, with nodes of their own.
        self.first_byte = n + 2
        self.offsets = np.concatenate((o, q[1:] + o[-1]))
        self.nodes = np.concatenate((p, r)).astype(np.uint32)
        bits = np.concatenate((b, s))
        # Paths are cut into groups of GROUP decisions, whose slots are neighbours: the place of a decision in
        # its group follows from the bits since the group's first node.
        size = np.diff(self.offsets)
        depth = _ranges(np.zeros(len(size), np.int64), size)
        place = np.ones(len(bits), np.uint8)
        for d in range(1, GROUP):
            at = np.flatnonzero(depth % GROUP == d)
            place[at] = 2 * place[at - 1] + bits[at - 1]
        self.steps = (depth == 0) * np.uint8(FIRST) + place * np.uint8(2) + bits
        n_groups = -(-size // GROUP)
        self.group_offsets = np.concatenate(([0], np.cumsum(n_groups)))
        self.group_nodes = self.nodes[depth % GROUP == 0] * np.uint32(0x9E3779B1)

    def state(self):
        return {k: _sent(v) if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()}

    @classmethod
    def of(cls, state):
        """A task's code, with the table that finds its words, and its groups as rows."""
        self = cls.__new__(cls)
        self.__dict__ = {k: _got(v) if isinstance(v, tuple) else v for k, v in state.items()}
        self.words = Lookup(self.hashes)
        # A row a group: twice the place plus the bit, and the node, of its decisions; zeros follow where it has fewer
        # than GROUP. No decision has place 0.
        step = self.steps & np.uint8(FIRST - 1)
        begin = np.flatnonzero(step >> np.uint8(1) == 1)
        at = begin.astype(np.int32)[:, None] + np.arange(GROUP, dtype=np.int32)
        inside = at < np.append(begin[1:], len(step))[:, None]
        at[~inside] = 0
        self.group_steps = np.where(inside, step[at], np.uint8(0))
        self.group_path = np.where(inside, self.nodes[at], np.uint32(0))
        self.group_has = inside
        self.group_shift = (self.group_steps >> np.uint8(1) & np.uint8(7)) * np.uint8(8)  # ``_Cells``, ``_Scorer``: of the places, in words of eight bytes
        self.group_last = self.group_steps.max(1)  # a group's path as one number: the step of its last decision
        self.group_count = np.diff(self.group_offsets)
        self.word_groups = int(self.group_offsets[self.first_byte])
        self.byte_groups = len(begin) - self.word_groups
        return self


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start .. start+size-1 of each range, one after the other."""
    return np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())


def pieces(ids: list, texts: list[bytes | None], size: int):
    """Runs of (ids, texts, is last piece of its text, the first goes on with the last text of the run before).

    A text beyond ``size`` bytes is cut between words; each of its pieces but the first begins a run.
    """
    run: list[tuple] = []
    n, on = 0, False
    for i, t in zip(ids, texts, strict=True):
        parts = [t] if len(t or b"") <= size else _cut(t, size)
        for j, part in enumerate(parts):
            if run and (j or n + len(part or b"") > size):
                yield _run(run, on)
                run, n, on = [], 0, j > 0
            run.append((i, part, j == len(parts) - 1))
            n += len(part or b"")
    if run:
        yield _run(run, on)


def _run(run: list[tuple], on: bool) -> tuple:
    ids, texts, last = zip(*run, strict=True)
    return list(ids), list(texts), np.array(last), on


def _cut(text: bytes, size: int) -> list[bytes]:
    parts, held, n = [], [], 0
    for w in text.split():
        if held and n + len(w) > size:
            parts.append(b" ".join(held))
            held, n = [], 0
        held.append(w)
        n += len(w) + 1
    return [*parts, b" ".join(held)]


def symbols(texts: list[bytes | None], ended: np.ndarray, code: Code, past=NO_PAST):
    """(words, text of each symbol, symbol, context hashes of each symbol for each order, the last text's last two tokens).

    past: the last token, and the one before it, that the first text goes on from.
    """
    words = words_of(texts, fold=LOWER)
    h = words.hashes = words.hash()
    k, n = len(texts), len(h)
    per = np.diff(words.first)
    # Tokens: every text's words and, in its last piece, its end.
    size = per + ended
    text = np.repeat(np.arange(k), size)
    m = len(text)
    is_end = np.zeros(m, bool)
    is_end[(np.cumsum(size) - 1)[ended]] = True
    token = np.full(m, U(END + 1))
    token[~is_end] = h
    found = code.words.find(h)
    sym = np.full(m, code.end)
    sym[~is_end] = np.where(found < 0, code.escape, found)
    first = np.ones(m, bool)
    first[1:] = text[1:] != text[:-1]
    second = first.copy()
    second[1:] |= first[:-1]
    start = np.full(2, U(7))
    last = np.where(first, U(7), np.concatenate((start[:1], token))[:m])
    before = np.where(second, U(7), np.concatenate((start, token))[:m])
    if m:
        last[0], before[0] = past
    if m > 1 and text[1] == text[0]:
        before[1] = past[0]
    ends_with = past
    if m:
        ends_with = (token[-1], last[-1])
    one = mix(last + U(11))
    two = mix(one + before * U(0x9E3779B97F4A7C15) + U(13))
    # Bytes of the escaped words, each followed by a blank.
    escaped = np.flatnonzero(sym == code.escape)
    word = escaped - (np.cumsum(ended) - ended)[text[escaped]]  # its number among the words: ends come between
    size = words.ends[word] - words.starts[word] + 1
    data = words.data[_ranges(words.starts[word], size)].astype(np.uint32)
    data[np.cumsum(size) - 1] = 32
    place = _ranges(np.zeros(len(size), np.int64), size)
    earlier = []
    for i in (1, 2, 3):
        b = np.zeros(len(data), np.uint32)
        b[i:] = data[:-i]
        b[place < i] = 0
        earlier.append(b)
    # The symbols in order: an escaped word's bytes follow its escape.
    extra = np.zeros(m, np.int64)
    extra[escaped] = size
    at = np.arange(m) + np.cumsum(extra) - extra
    at_bytes = np.repeat(at[escaped] + 1, size) + place
    total = m + len(data)

    def woven(a, b, kind):
        out = np.empty(total, kind)
        out[at], out[at_bytes] = a, b
        return out

    two_bytes = earlier[0] + (earlier[1] << np.uint32(8))
    contexts = (
        woven(0, DIRECT + earlier[0] * 256, np.uint32),
        woven(one >> U(32), two_bytes * np.uint32(0x85EBCA6B) + np.uint32(1), np.uint32),
        woven(two >> U(32), (two_bytes + (earlier[2] << np.uint32(16))) * np.uint32(0xC2B2AE35) + np.uint32(2), np.uint32),
    )
    return words, woven(text, np.repeat(text[escaped], size), np.int32), woven(sym, data + code.first_byte, np.int32), contexts, ends_with


def groups(code: Code, sym: np.ndarray, contexts):
    """(symbol number, group of the code, row of ``_first_rows``, first slot of each hashed order) of every group of decisions."""
    sym = sym.astype(np.int64)
    begin, size = code.group_offsets.take(sym), code.group_count.take(sym)
    owner = np.repeat(np.arange(len(sym)), size)
    begin -= np.cumsum(size) - size
    at = begin.take(owner)
    at += np.arange(len(at))
    row = (((np.maximum(contexts[0], np.uint32(DIRECT)) - np.uint32(DIRECT)) >> np.uint32(8)) * np.int64(code.byte_groups)).take(owner)
    row += at
    node = code.group_nodes.take(at)
    slots = []
    for c in contexts[1:]:
        x = c.take(owner)
        x += node
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0x297A2D39)
        x >>= np.uint32(10)
        x &= np.uint32(0xFFFFFFFF - (2**GROUP - 1))
        slots.append(x.astype(np.int64))
    return owner, at, row, slots


def decisions(code: Code, sym: np.ndarray, contexts):
    """(symbol number, slots of each order, bit) of every binary decision: one by one what the passes count and look up by groups."""
    owner, at, _, firsts = groups(code, sym, contexts)
    steps = code.group_steps.take(at, axis=0).reshape(-1)
    real = np.flatnonzero(steps)
    of, step = real // GROUP, steps.take(real)
    owner = owner.take(of)
    slots = [contexts[0].take(owner) + code.group_path.take(at, axis=0).reshape(-1).take(real)]
    return owner, slots + [x.take(of) + (step >> np.uint8(1)) for x in firsts], step & np.uint8(1)


def _first_rows(code: Code, table: np.ndarray) -> np.ndarray:
    """What the first order's ``table`` holds for the decisions of each group, a row a group: the words' groups, then the bytes' after each byte."""
    words, letters = np.split(code.group_path.astype(np.int64), [code.word_groups])
    after = DIRECT + 256 * np.arange(256)[:, None, None]
    return np.concatenate((table.take(words), table.take(letters + after).reshape(-1, GROUP)))


def _like_first_rows(code: Code, of_groups: np.ndarray) -> np.ndarray:
    """A row for each of ``_first_rows``, from one for each group."""
    words, letters = np.split(of_groups, [code.word_groups])
    return np.concatenate((words, np.tile(letters, (256, 1))))


class _Counts:
    """Zeros and ones of every slot, counted by groups: a group's path adds one at its end, and what ends below a decision is summed up at last."""

    def __init__(self, code: Code):
        self.code = code
        self.total = np.zeros(2 * sum(SIZES), np.int32)
        self.symbols, self.pairs = np.zeros(len(code.offsets) - 1, np.int32), np.zeros(1 << 16, np.int32)

    def add(self, sym: np.ndarray, contexts) -> None:
        code, one = self.code, np.int32(1)
        _, at, _, slots = groups(code, sym, contexts)
        last = code.group_last.take(at)
        for own, x in zip(_views(self.total)[1:], slots, strict=True):
            x <<= 1
            x += last
            np.add.at(own, x, one)
        # The first order's contexts are the kind of symbol and the byte before: the symbols' numbers are all it needs.
        letter = np.flatnonzero(sym >= code.first_byte)
        np.add.at(self.symbols, sym.astype(np.int64), one)
        np.add.at(self.pairs, (contexts[0].take(letter).astype(np.int64) - DIRECT) + (sym.take(letter) - code.first_byte), one)

    def slots(self) -> np.ndarray:
        """Counts of all slots, those of zeros and of ones beside each other; for use once."""
        code = self.code
        first, *hashed = _views(self.total)
        for own in hashed:
            t = own.reshape(-1, 2 << GROUP)
            for step in range((1 << GROUP) - 1, 1, -1):
                t[:, step] += t[:, 2 * step] + t[:, 2 * step + 1]
        size = np.diff(code.offsets)
        z = code.offsets[code.first_byte]
        at = code.nodes.astype(np.int64) * 2 + (code.steps & np.uint8(1))
        np.add.at(first, at[:z], np.repeat(self.symbols[: code.first_byte], size[: code.first_byte]))
        after = 2 * (DIRECT + 256 * np.arange(256))[:, None]
        np.add.at(first, (after + at[z:]).reshape(-1), np.repeat(self.pairs.reshape(256, 256), size[code.first_byte :], axis=1).reshape(-1))
        return self.total


def _tables(rows: DataFrame, sent: Broadcast, n_bytes: int) -> list[np.ndarray]:
    """Zeros and ones of every slot, one array (slots, 2) per order. sent: the code's state, which all passes share; n_bytes: about the words' bytes."""

    def count(batches):
        counts = _Counts(Code.of(sent.value))
        for b in batches:
            past = NO_PAST
            for _, texts, ended, on in pieces(range(b.num_rows), b.column(0).to_pylist(), PIECE):
                _, _, sym, contexts, past = symbols(texts, ended, counts.code, past if on else NO_PAST)
                counts.add(sym, contexts)
        total = counts.slots()
        data = [_pack(x) for x in total.reshape(N_SLABS, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(N_SLABS, dtype=np.int32)), pa.array(data, pa.binary())], ["slab", "data"])

    def add_up(table: pa.Table) -> pa.Table:
        total = np.zeros(SLAB * 2, np.int64)
        for x in table["data"]:
            total += _unpack(x.as_py())
        return pa.table({"slab": table["slab"].slice(0, 1).cast(pa.int32()), "data": pa.array([_pack(total)], pa.binary())})

    tasks = max(1, min(rows.rdd.getNumPartitions(), -(-n_bytes // COUNTED)))  # each task sends a whole model
    parts = rows.select("text").coalesce(tasks).mapInArrow(count, "slab int, data binary").withColumn("part", F.spark_partition_id())
    level = parts
    if tasks >= TWO_LEVELS:  # with few tasks a first level would only send their models once more
        some = F.pmod("part", F.lit(int(tasks**0.5)))
        level = level.groupBy("slab", some.alias("g")).applyInArrow(add_up, "slab int, data binary")
    level = level.groupBy("slab").applyInArrow(add_up, "slab int, data binary")
    out = np.zeros((N_SLABS, SLAB * 2), np.uint32)
    for r in level.collect():  # the model itself, of fixed size
        out[r["slab"]] = _fitting(_unpack(bytes(r["data"])).reshape(-1, 2)).reshape(-1)
    return [v.reshape(-1, 2) for v in _views(out.reshape(-1))]


def _fitting(counts: np.ndarray) -> np.ndarray:
    """Counts (slots, 2) as 32-bit numbers; both of a slot are divided alike where one is too large."""
    most = counts.max(1)
    over = np.flatnonzero(most >= 2**32)
    if len(over):
        counts = counts.copy()
        counts[over] //= (most[over] >> 32)[:, None] + 1
    return counts.astype(np.uint32)


def _views(flat: np.ndarray) -> list[np.ndarray]:
    """The orders' parts of one array with two numbers per slot."""
    cut = np.cumsum([0, *(2 * x for x in SIZES)])
    return [flat[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)]


def _pack(counts: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(counts, np.int64).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, SLAB * 2 * 8, codec="zstd", asbytes=True), np.int64)


def _sent(a: np.ndarray) -> tuple:
    """An array as it is broadcast: compressed, as workers read broadcasts from files on their disk."""
    raw = np.ascontiguousarray(a).tobytes()
    return a.shape, a.dtype.str, len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def _got(sent: tuple) -> np.ndarray:
    shape, kind, size, data = sent
    return np.frombuffer(pa.decompress(data, size, codec="zstd", asbytes=True), kind).reshape(shape)


def _ready(tables: list[np.ndarray]) -> list[np.ndarray]:
    """What scoring needs of the counts, a number per slot: the stretched prediction in steps, times four, plus the level of the count."""
    out = [np.empty(len(t), np.int16) for t in tables]
    for t, to in zip(tables, out, strict=True):
        for a in range(0, len(t), SLAB):  # the driver holds no second copy in wider numbers
            part = t[a : a + SLAB]
            n = part.sum(1, dtype=np.int64)
            steps = np.clip(np.round(_stretch(part[:, 1], n) * STEP), -1000, 1000).astype(np.int16)
            to[a : a + SLAB] = steps * np.int16(4) + _level(n)
    return out


def _stretch(ones: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.log((ones + 0.4) / (n - ones + 0.4))


def _level(n: np.ndarray) -> np.ndarray:
    return np.minimum(3, np.log2(n + 1) / 1.5).astype(np.uint8)


def _gate(sym, owner, first_byte, level1, level2):
    """The weight set: words or bytes, and how often the two longer contexts were seen."""
    return _gate_of(np.where(sym >= first_byte, np.int16(16), np.int16(0)).take(owner), level1, level2)


def _gate_of(kind, level1, level2):
    """kind: 0 for decisions of words, 16 for those of bytes."""
    return kind + level1 * np.int16(4) + level2


def _adapt(weights, x, gate, bit, sizes, rate, own=None):
    """The bits (log2) of each text, and the last text's weights. Every text has weights of its own, which follow its bits after each block.

    x: a column of inputs per decision; sizes: decisions of each text; own: the weights that the first text goes on with.
    """
    sign = np.float32(1) - np.float32(2) * bit
    return _Blocks(sizes).adapt(weights, lambda at: (x.take(at, axis=1), gate.take(at), sign.take(at)), rate, own)


class _Blocks:
    """The decisions of several texts in blocks: all first blocks are a round, then all second ones, and so on."""

    def __init__(self, sizes: np.ndarray):
        k = len(sizes)
        # A round is a run of rows. Texts with more rounds come first, so that those with a block in a round are the first ones.
        long = np.maximum(sizes - EARLY * BLOCK, 0)
        rounds = -(-(sizes - long) // BLOCK) + -(-long // LATER)
        rank = np.empty(k, np.int64)
        rank[np.argsort(-rounds, kind="stable")] = np.arange(k)
        doc = np.repeat(np.arange(k), rounds)
        number = _ranges(np.zeros(k, np.int64), rounds)
        order = np.lexsort((rank[doc], number))
        doc, number = doc[order], number[order]
        before = np.minimum(number, EARLY) * BLOCK + np.maximum(number - EARLY, 0) * LATER
        self.begin = (np.cumsum(sizes) - sizes)[doc] + before
        self.size = np.minimum(sizes[doc] - before, np.where(number < EARLY, BLOCK, LATER))
        self.rank, self.doc, self.texts = rank, doc, np.bincount(number)

    def spans(self):
        """Runs of whole rounds with about ``SPAN`` decisions: (texts of each round, blocks before the run, blocks up to its end)."""
        last = np.cumsum(self.texts)
        of = np.concatenate(([0], np.cumsum(self.size)))[last - self.texts] // SPAN
        for at in np.split(np.arange(len(last)), np.flatnonzero(np.diff(of)) + 1):
            if len(at):
                yield self.texts[at], last[at[0]] - self.texts[at[0]], last[at[-1]]

    def adapt(self, weights, inputs, rate, own=None):
        """``_adapt``. inputs: of the numbers of decisions, their inputs, gates, and signs (1 for a zero, -1 for a one)."""
        k, rank = len(self.rank), self.rank
        w = np.tile(weights.astype(np.float32).T, (1, k))
        if own is not None:
            w[:, rank[0] * GATES : (rank[0] + 1) * GATES] = own.T
        costs = np.zeros(len(self.size))
        moves = np.empty((INPUTS, k * GATES))
        for texts, first, last in self.spans():
            size = self.size[first:last]
            x, gate, sign = inputs(_ranges(self.begin[first:last], size))
            gate = np.repeat(rank[self.doc[first:last]] * GATES, size) + gate
            ends = np.cumsum(size)
            cost = np.empty(len(sign), np.float32)
            a = 0
            for j, z in zip(texts.tolist(), ends[np.cumsum(texts) - 1].tolist(), strict=True):
                g, s, of = gate[a:z], sign[a:z], x[:, a:z]
                m = j * GATES
                parts = w.take(g, axis=1)
                parts *= of
                mixed = np.add.reduce(parts, axis=0)
                np.minimum(mixed, np.float32(11.5), out=mixed)
                np.maximum(mixed, np.float32(-11.5), out=mixed)
                mixed *= s
                odds = np.exp(mixed, out=cost[a:z])
                error = odds / (odds + np.float32(1))
                error *= s  # the bit's probability less the bit
                pace = rate / np.sqrt(np.maximum(np.bincount(g, minlength=m), 1))
                np.multiply(of, error, out=parts)
                move = moves[:, :m]
                for i in range(INPUTS):
                    move[i] = np.bincount(g, parts[i], minlength=m)
                move *= pace
                w[:, :m] -= move
                a = z
            np.log1p(cost, out=cost)
            costs[first:last] = np.add.reduceat(cost, ends - size, dtype=np.float64)
        return np.bincount(self.doc, costs, minlength=k) / np.log(2), w[:, rank[-1] * GATES : (rank[-1] + 1) * GATES].T.copy()


class _Scorer:
    """Scores texts by the counts that ``_ready`` made. Runs of texts are held, as predictions of two bytes each, so that
    the weights of many texts take their steps together: ``add`` until it is ``full``, then ``bits``."""

    def __init__(self, code: Code, ready: list[np.ndarray], weights: np.ndarray):
        self.code, self.weights = code, weights
        # A group's slots as four words: places 0 to 3, of first and second decisions, 4 to 7, of third ones, and 8 to 15.
        self.tables = [v.view("<i8").reshape(-1, 4) for v in ready[1:]]
        # The first order's predictions, with the bit and, twice, whether it is of a byte, in place of the level.
        is_byte = np.repeat(np.array([0, 2], np.int16), [code.word_groups, code.byte_groups])
        self.first = _first_rows(code, ready[0]) & np.int16(-4) | _like_first_rows(code, (code.group_steps & np.int16(1)) | is_byte[:, None])
        self.path = np.diff(code.offsets)
        self.held, self.sizes, self.own, self.last = [], [], None, None

    def full(self) -> bool:
        return sum(v.shape[1] for v in self.held) > HELD or sum(map(len, self.sizes)) > TOGETHER

    def add(self, text: np.ndarray, sym: np.ndarray, contexts, k: int, on: bool) -> None:
        """The symbols of ``k`` texts; text: each symbol's. on: the first text goes on with the last one of the ``bits`` before."""
        if not self.held:
            self.own = self.last if on else None
        code = self.code
        _, at, row, slots = groups(code, sym, contexts)
        real = np.flatnonzero(code.group_has.take(at, axis=0))
        shift = code.group_shift.take(at, axis=0)
        beyond = shift[:, GROUP - 1] >= 32  # places 12 to 15
        shift = shift * np.uint8(2) & np.uint8(63)
        by = [16, *(shift[:, d].astype(np.int64) for d in range(1, GROUP))]
        out = np.empty((ORDERS, len(real)), np.int16)
        self.first.take(row, axis=0).reshape(-1).take(real, out=out[0], mode="clip")
        four = np.empty((len(at), GROUP), np.int16)
        for i, (t, x) in enumerate(zip(self.tables, slots, strict=True), 1):
            words = t.take(x >> 4, axis=0, mode="clip")
            for d, word in enumerate((words[:, 0], words[:, 0], words[:, 1], np.where(beyond, words[:, 3], words[:, 2]))):
                four[:, d] = word >> by[d]
            four.reshape(-1).take(real, out=out[i], mode="clip")
        self.held.append(out)
        self.sizes.append(np.bincount(text, self.path.take(sym), minlength=k).astype(np.int64))

    def bits(self) -> np.ndarray:
        """The bits of each text since the last call."""
        sizes, self.sizes = np.concatenate(self.sizes), []
        held, z = np.empty((ORDERS, sizes.sum()), np.int16), sizes.sum()
        while self.held:  # not twice in memory
            v = self.held.pop()
            held[:, z - v.shape[1] : z] = v
            z -= v.shape[1]

        def inputs(at):
            got = [v.take(at) for v in held]
            x = np.empty((INPUTS, len(at)), np.float32)
            for i, v in enumerate(got):
                np.multiply(v >> np.int16(2), np.float32(1 / STEP), out=x[i], casting="unsafe")
            x[ORDERS] = 0.3
            gate = _gate_of((got[0] & np.int16(2)) << np.int16(3), got[1] & np.int16(3), got[2] & np.int16(3))
            return x, gate, np.float32(1) - np.float32(2) * (got[0] & np.int16(1))

        bits, self.last = _Blocks(sizes).adapt(self.weights, inputs, RATE, self.own)
        return bits


def _plain_weights() -> np.ndarray:
    w = np.zeros((GATES, INPUTS))
    for g in range(GATES):
        one, two = (g % 16) // 4, g % 4
        w[g, :ORDERS] = (1, 0, 0) if not one and not two else (0.6, 0.4, 0) if not two else (0.3, 0.3, 0.4)
    return w


_CELL = np.clip((np.arange(-1000, 1001) + 4 + 8 * (LEVELS // 2)) // 8, 0, LEVELS - 1).astype(np.int32)  # by prediction in steps
CELLS = GATES * LEVELS**ORDERS * 2


def _places(ready: list[np.ndarray]) -> list[np.ndarray]:
    """What each slot adds to the place of a decision among the ``CELLS``: its cell, and its share of ``_gate``. ``_Cells`` counts these places."""
    out = []
    for i, v in enumerate(ready):
        gate = (v & np.int16(3)).astype(np.int32) * (0, 4, 1)[i]
        out.append((gate * np.int32(LEVELS**ORDERS) + _CELL.take((v >> np.int16(2)) + np.int16(1000)) * np.int32(LEVELS ** (ORDERS - 1 - i))) * np.int32(2))
    return out


class _Cells:
    """Counts the decisions of every cell. A hashed order's slot holds level and cell in one byte, so that the slots of a
    group are two words: places 0 to 7 in the first, 8 to 15, all of fourth decisions, in the other."""

    SPARE = 1 << 21  # numbers of (byte or word, cell, bit) and of two such bytes; beyond them are counts where a group has fewer decisions than ``GROUP``

    def __init__(self, code: Code, ready: list[np.ndarray]):
        self.code = code
        first, *tables = [(v & np.int16(3)).astype(np.uint8) * np.uint8(32) + _CELL.take((v >> np.int16(2)) + np.int16(1000)).astype(np.uint8) for v in ready]
        self.tables = [t.view("<u8").reshape(-1, 2) for t in tables]
        is_byte = np.repeat(np.array([0, 64], np.int32), [code.word_groups, code.byte_groups])
        steps = _like_first_rows(code, code.group_steps)
        number = (_first_rows(code, first) & np.uint8(31)) * np.int32(2) + (steps & np.uint8(1)) + _like_first_rows(code, is_byte[:, None])
        self.first = np.where(steps > 0, number << np.int32(14), np.int32(self.SPARE))
        self.n = np.zeros(self.SPARE + (1 << 14), np.int64)

    def add(self, sym: np.ndarray, contexts) -> None:
        _, at, row, slots = groups(self.code, sym, contexts)
        shift, number = self.code.group_shift.take(at, axis=0), self.first.take(row, axis=0)
        one, two = (t.take(x >> 4, axis=0, mode="clip") for t, x in zip(self.tables, slots, strict=True))
        for d in range(GROUP):
            by, word = shift[:, d].astype(U), d // (GROUP - 1)
            at = one[:, word] >> by
            at &= U(127)
            at <<= U(7)
            at |= (two[:, word] >> by) & U(127)
            np.add.at(self.n, at.view(np.int64) + number[:, d], 1)

    def cells(self) -> tuple[np.ndarray, np.ndarray]:
        """The cells met, as places among the ``CELLS``, and their counts."""
        met = np.flatnonzero(self.n[: self.SPARE])
        level = [met >> 5 & 3, met >> 12 & 3]
        cell = [met >> 15 & 31, met >> 7 & 31, met & 31]
        at = _gate_of(16 * (met >> 20), level[1], level[0]).astype(np.int64)
        for v in cell:
            at = at * LEVELS + v
        return at * 2 + (met >> 14 & 1), self.n[met]


def _curvature(w, n, x, gate, bit) -> np.ndarray:
    """For each gate the sums over ``n`` decisions a row: cost (nats), gradient of the likelihood, curvature; a row of 1 + INPUTS + INPUTS**2."""
    mixed = np.clip((w[gate] * x).sum(1), -30, 30)
    p = 1 / (1 + np.exp(-mixed))
    out = np.empty((GATES, 1 + INPUTS + INPUTS * INPUTS))
    out[:, 0] = np.bincount(gate, n * np.logaddexp(0, np.where(bit, -mixed, mixed)), minlength=GATES)
    error, spread = n * (bit - p), n * p * (1 - p)
    for i in range(INPUTS):
        out[:, 1 + i] = np.bincount(gate, error * x[:, i], minlength=GATES)
        of = spread * x[:, i]
        for j in range(i, INPUTS):
            v = np.bincount(gate, of * x[:, j], minlength=GATES)
            out[:, 1 + INPUTS + i * INPUTS + j] = out[:, 1 + INPUTS + j * INPUTS + i] = v
    return out


def _decision_table(rows: DataFrame, code_sent: Broadcast, tables: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """All decisions of ``rows(text)``, as ``tables`` predict them, by cell: (n, inputs at the cell's middle, gate, bit). At most ``CELLS`` rows."""
    sent = rows.sparkSession.sparkContext.broadcast([_sent(x) for x in _ready(tables)])
    tasks = min(rows.rdd.getNumPartitions(), 2 * rows.sparkSession.sparkContext.defaultParallelism)  # each task unpacks the model and sends a table

    def run(batches):
        counts = _Cells(Code.of(code_sent.value), [_got(x) for x in sent.value])
        for b in batches:
            past = NO_PAST
            for _, texts, ended, on in pieces(range(b.num_rows), b.column(0).to_pylist(), PIECE):
                _, _, sym, contexts, past = symbols(texts, ended, counts.code, past if on else NO_PAST)
                counts.add(sym, contexts)
        met, n = counts.cells()
        for i in range(0, len(met), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(met[i : i + 100_000].astype(np.int32)), pa.array(n[i : i + 100_000])], ["at", "n"])

    parts = rows.select("text").coalesce(max(1, tasks)).mapInArrow(run, "at int, n long")
    table = parts.groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # at most CELLS rows
    sent.destroy()  # a broadcast lies on the disk of the driver and of every executor
    at, n = table["at"].to_numpy(np.int64), table["n"].to_numpy(np.float64)
    level = [at // (2 * LEVELS**i) % LEVELS for i in reversed(range(ORDERS))]
    x = np.column_stack([(v - LEVELS // 2) * (8 / STEP) for v in level] + [np.full(len(n), 0.3)])
    return n, x, at // (2 * LEVELS**ORDERS), (at & 1).astype(np.float64)


def _halves(rows: DataFrame) -> list[DataFrame]:
    """Two halves of the rows; equal texts are in the same one."""
    half = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(2))
    return [rows.filter(half == i) for i in range(2)]


def _start_weights(rows: DataFrame, code, tables: list[list[np.ndarray]]) -> np.ndarray:
    """Starting weights: each gate's logistic regression over all decisions of ``rows(text)``, each half's from the counts of the other."""
    parts = [_decision_table(half, code, other) for half, other in zip(_halves(rows), reversed(tables), strict=True)]
    n, x, gate, bit = (np.concatenate(p) for p in zip(*parts, strict=True))
    return _newton(lambda w: _curvature(w, n, x, gate, bit), _plain_weights())


def _newton(sums, plain: np.ndarray) -> np.ndarray:
    """The weights of least cost. sums(w): ``_curvature`` over all decisions; a gate's step that raises its cost is halved."""
    best, cost, step = plain, None, np.zeros_like(plain)
    for _ in range(FIT_STEPS):
        w = best + step
        got = sums(w)
        away = w - plain
        now = got[:, 0] + RIDGE / 2 * (away * away).sum(1)
        ahead = np.ones(GATES, bool) if cost is None else now <= cost
        if cost is None:
            cost, grad, curve = now.copy(), got[:, 1 : 1 + INPUTS].copy(), got[:, 1 + INPUTS :].copy()
        best = np.where(ahead[:, None], w, best)
        cost[ahead], grad[ahead], curve[ahead] = now[ahead], (got[:, 1 : 1 + INPUTS] - RIDGE * away)[ahead], got[ahead, 1 + INPUTS :]
        full = np.linalg.solve(curve.reshape(GATES, INPUTS, INPUTS) + RIDGE * np.eye(INPUTS), grad[:, :, None])[:, :, 0]
        step = np.where(ahead[:, None], full, step / 2)
        if (grad * step).sum() / 2 <= FIT_GAIN * cost.sum():
            return best
    raise RuntimeError("starting weights did not settle")


def _token_counts(rows: DataFrame) -> DataFrame:
    """(kind, h, n): training tokens by hash, bytes by value, and texts."""

    def run(batches):
        letters, texts_seen = np.zeros(256, np.int64), 0
        for b in batches:
            for _, texts in chunks(range(b.num_rows), b.column(0).to_pylist(), 4 << 20):
                hashes = []
                for _, some in chunks(range(len(texts)), texts, PIECE):
                    words = words_of(some, fold=LOWER)
                    letters += np.bincount(words.data, minlength=256)
                    hashes.append(words.hash())
                texts_seen += len(texts)
                h, n = np.unique(np.concatenate(hashes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), TOKEN, np.int32)), pa.array(h.view(np.int64)), pa.array(n)], ["kind", "h", "n"])
        kinds = np.array([BYTE] * 256 + [END], np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.arange(257)), pa.array(np.append(letters, texts_seen))], ["kind", "h", "n"])

    return rows.select("text").mapInArrow(run, "kind int, h long, n long").groupBy("kind", "h").agg(F.sum("n").alias("n"))


class Model:
    """``sent``: the code's state as it was broadcast."""

    def __init__(self, counts, total, distinct, frequent, code, tables, weights, sent):
        self.counts, self.total, self.distinct, self.frequent = counts, total, distinct, frequent
        self.code, self.tables, self.weights, self.sent = code, tables, weights, sent


def fit(rows: DataFrame) -> Model:
    """Learn from all of ``rows(text)``, texts as bytes."""
    counts = materialize(_token_counts(rows), "counts")
    sizes = {r["kind"]: r for r in counts.filter(f"kind <> {BYTE}").groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    letters = {r["h"]: r["n"] for r in counts.filter(f"kind = {BYTE}").collect()}
    ends = sizes[END]["n"] if END in sizes else 0
    words = sizes[TOKEN]["n"] if TOKEN in sizes else 0
    distinct = (sizes[TOKEN]["v"] if TOKEN in sizes else 0) + (ends > 0)
    tokens = counts.filter(f"kind = {TOKEN}").select("h", F.col("n").alias("c"))
    # The smallest count that at most FREQUENT tokens reach; a row per distinct count.
    least, have = 1, 0
    for r in tokens.groupBy("c").agg(F.count("*").alias("v")).orderBy(F.desc("c")).toLocalIterator():
        have += r["v"]
        if have > FREQUENT:
            least = r["c"] + 1
            break
    top = tokens.filter(F.col("c") >= least).toPandas()
    h, c = top["h"].to_numpy(np.int64).view(U), top["c"].to_numpy(np.int64)
    o = np.argsort(h)
    frequent = (h[o], c[o])
    best = np.lexsort((h, -c))[:VOCABULARY]
    best = best[c[best] > 1]  # words seen once stand for unseen ones: the escape and the byte code learn from them
    best = best[np.argsort(h[best])]
    byte_counts = np.array([letters.get(b, 0) for b in range(256)])
    byte_counts[32] = max(byte_counts[32], words - int(c[best].sum()))
    code = Code(h[best], c[best].tolist(), ends, words - int(c[best].sum()), byte_counts.tolist())
    sent = rows.sparkSession.sparkContext.broadcast(code.state())
    halves = [_tables(half, sent, int(sum(letters.values())) // 2) for half in _halves(rows)]
    weights = _start_weights(rows, sent, halves)
    # Both counts of a slot are shrunk alike where their sum would leave 32 bits.
    tables = [np.concatenate([_fitting(a[i : i + SLAB].astype(np.int64) + b[i : i + SLAB]) for i in range(0, len(a), SLAB)]) for a, b in zip(*halves, strict=True)]
    del halves
    return Model(tokens, words + ends, distinct, (frequent, ends), code, _ready(tables), weights, sent)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Scores of ``docs(doc_id, learned, text)``, one row each:

    (doc_id, learned, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte).
    """
    code_sent = model.sent
    frequent, ends = model.frequent
    sent = docs.sparkSession.sparkContext.broadcast((([_sent(x) for x in frequent], ends), [_sent(x) for x in model.tables], model.weights))
    floor = model.total + 0.5 * (model.distinct + 1)

    def run(batches):
        (seen, ends), tables, weights = sent.value
        (hashes, counts), code = [_got(x) for x in seen], Code.of(code_sent.value)
        scorer = _Scorer(code, [_got(x) for x in tables], weights)
        frequent = Lookup(hashes)
        logs = np.log10((counts + 0.5) / floor)
        end_log = np.log10((ends + 0.5) / floor)

        def scored(held):
            bits = np.split(scorer.bits(), np.cumsum([len(columns[0]) for columns in held])[:-1])
            for columns, x in zip(held, bits, strict=True):
                yield pa.RecordBatch.from_arrays([*columns[:-2], pa.array(x), *columns[-2:]], ["row", "doc_id", "learned", "n_bytes", "n_tokens", "top_known", "top_score", "bits", "rest_h", "rest_n"])

        for b in batches:
            past, held = NO_PAST, []
            texts = b.column(3).to_pylist()
            by_size = sorted(range(len(texts)), key=lambda i: len(texts[i] or b""))  # noqa: B023  # texts of one length have as many blocks
            for at, texts, ended, on in pieces(by_size, [texts[i] for i in by_size], PIECE):
                if held and (on or scorer.full()):
                    yield from scored(held)
                    held = []
                words, text, sym, contexts, past = symbols(texts, ended, code, past if on else NO_PAST)
                k = len(texts)
                scorer.add(text, sym, contexts, k, on)
                # The base score of frequent words and of the end; the other words with their number.
                h = words.hashes
                of = np.repeat(np.arange(k), np.diff(words.first))
                place = frequent.find(h)
                top = place >= 0
                base = np.bincount(of[top], logs[place[top]], minlength=k) + end_log * ended
                known = np.bincount(of[top], minlength=k) + ((ends > 0) & ended)
                o = np.lexsort((h[~top], of[~top]))
                rest_of, rest_h = of[~top][o], h[~top][o]
                head = np.ones(len(o), bool)
                head[1:] = (rest_h[1:] != rest_h[:-1]) | (rest_of[1:] != rest_of[:-1])
                head = np.flatnonzero(head)
                times = np.diff(np.append(head, len(o)))
                cut = np.searchsorted(rest_of[head], np.arange(k + 1)).astype(np.int32)
                size = np.fromiter((len(t or b"") for t in texts), np.int64, k)
                lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(v)) for v in (rest_h[head].view(np.int64), times.astype(np.int32))]
                ids = [b.column(i).take(pa.array(at)) for i in range(3)]
                held.append([*ids, pa.array(size), pa.array(np.diff(words.first) + ended), pa.array(known.astype(np.int64)), pa.array(base), *lists])
            if held:
                yield from scored(held)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "learned", "text")
    scored = materialize(rows.mapInArrow(run, ROW), "scored")  # from here on, ``row`` is a column of a written table
    sent.destroy()
    rest = scored.filter(F.size("rest_h") > 0).select("row", F.explode(F.arrays_zip("rest_h", "rest_n")).alias("x")).select("row", F.col("x.rest_h").alias("h"), F.col("x.rest_n").alias("k"))
    rest = rest.join(model.counts, "h", "left").select("row", F.when(F.col("c") > 0, F.col("k")).otherwise(0).cast("long").alias("top_known"), (F.col("k") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(floor))).alias("top_score"))
    parts = scored.drop("rest_h", "rest_n").unionByName(rest, allowMissingColumns=True).groupBy("row")
    out = parts.agg(F.max("doc_id").alias("doc_id"), F.max("learned").alias("learned"), *[F.sum(c).alias(c) for c in ("n_bytes", "n_tokens", "top_known", "top_score", "bits")])
    return out.select(
        "doc_id", "learned", "n_bytes", "n_tokens", F.col("top_known").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        F.col("top_score").alias("base_score"), (-F.col("bits") * float(np.log10(2))).alias("score"),
        F.when(F.col("n_bytes") > 0, F.col("bits") / F.col("n_bytes")).alias("bits_per_byte"),
    )


def model_scores(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` of all rows of ``docs``, by a model of those where the column ``learn`` holds."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), learn.alias("learned"), text.alias("text"))
    return score(rows, fit(rows.filter("learned").select("text")))
