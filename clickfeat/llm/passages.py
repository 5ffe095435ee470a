"""Candidate search for passages that repeat across documents, shared by the two substring operators.

A passage of ``width`` words is a window. In each window the run of ``gram``
words with the smallest hash is its anchor: equal windows have equal anchors,
and neighbouring windows mostly share one. So it suffices to look at windows
whose anchor's words stand in two documents or more.

1. All anchors of all documents are counted by hash (count, smallest and
   largest id), pre-aggregated in the tasks.
2. The hashes seen in two documents or more fill a bitmap of bounded size,
   built by aggregation. If there are too many for it, it lets more anchors
   pass; results do not depend on it.
3. Documents are read again; each anchor that passes gives one segment, the
   words of all windows that have it as their anchor.

An anchor with more than ``group_rows`` occurrences would fill one task. Its
segments are combined first where they are equal, by an aggregation that starts
in the tasks; the windows of the distinct segments are then keyed by all of
their words (a 128-bit hash), and what is found is joined back to the segments'
occurrences, one row for each document and segment.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import materialize
from .common import id_of, key_of
from .words import U, chunks, gram_hash, member, mix, words_of

GROUP_ROWS = 4_000  # occurrences of an anchor that one task takes together
BATCH_BYTES = 1 << 21  # of segments that a worker judges at once, if they are several groups
SLICE = 1_000
HOT_ANCHORS = 1 << 20  # bound on the number of anchors that are handled apart
MAX_BITS = 28  # the bitmap has at most 2**28 bits, 32 MB

SPACES = r"[\x20\x09-\x0D]+"  # between the words of a segment
COUNT_SCHEMA = "h long, lo long, hi long, n long"
SEGMENT_SCHEMA = "h long, key long, th long, pos int, anchor int, seg binary"
HOT_SCHEMA = "key long, th long, pos array<int>, seg binary"
WINDOW_SCHEMA = "w1 long, w2 long, s1 long, s2 long, key long, at int"
FOUND_SCHEMA = "key long, th long, pos array<int>, mask long, lo long"


@dataclass(frozen=True)
class Shape:
    width: int
    gram: int

    def anchors(self, words):
        """(anchor position, anchor hash, first and last start of its windows), all as word numbers of the batch."""
        none = (np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))
        h = words.hash()
        if len(h) < self.width:
            return h, none
        order = gram_hash(h, self.gram)
        per = self.width - self.gram + 1
        low = np.lib.stride_tricks.sliding_window_view(order, per)
        starts = np.arange(len(low))
        doc_end = np.repeat(words.first[1:], np.diff(words.first))[starts]
        ok = starts + self.width <= doc_end
        starts = starts[ok]
        if not len(starts):
            return h, none
        best = np.empty(len(starts), np.int64)
        for i in range(0, len(starts), 1 << 16):
            best[i : i + (1 << 16)] = low[starts[i : i + (1 << 16)]].argmin(1)
        best += starts
        new = np.concatenate(([True], best[1:] != best[:-1]))
        head = np.flatnonzero(new)
        tail = np.concatenate((head[1:], [len(starts)])) - 1
        return h, (best[head], order[best[head]], starts[head], starts[tail])


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.col(f"`{text_col}`").cast("binary")
    return docs.select(key_of(id_col).alias("key"), F.xxhash64(text).alias("th"), text.alias("text"))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _counted(rows: DataFrame, shape: Shape) -> DataFrame:
    def run(batches):
        for b in batches:
            for ids, texts in chunks(b.column(0).to_pylist(), b.column(2).to_pylist()):
                words = words_of(texts)
                _, (at, h, _, _) = shape.anchors(words)
                if not len(at):
                    continue
                doc = np.array(ids, np.int64)[np.searchsorted(words.first, at, "right") - 1]
                o = np.argsort(h, kind="stable")
                h, doc = h[o], doc[o]
                head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
                n = np.diff(np.concatenate((head, [len(h)])))
                yield pa.RecordBatch.from_arrays([_signed(h[head]), pa.array(np.minimum.reduceat(doc, head)), pa.array(np.maximum.reduceat(doc, head)), pa.array(n)], ["h", "lo", "hi", "n"])

    counts = rows.mapInArrow(run, COUNT_SCHEMA).groupBy("h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    return counts.filter("lo < hi").select("h", "n")


def bitmap(repeated: DataFrame, n: int, per: int = 16) -> tuple[int, np.ndarray]:
    """A bitmap over the leading bits of the ``n`` hashes, with ``per`` bits or more for each while its bound allows: (number of bits, bytes)."""
    bits = min(MAX_BITS, max(16, (per * n).bit_length()))
    slot = F.shiftrightunsigned("h", 64 - bits)
    cells = repeated.groupBy(F.shiftright(slot, 6).alias("cell")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int)))").alias("bits"))
    got = cells.toPandas()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[got["cell"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    return bits, out.view(np.uint8)


def passes(sketch: tuple[int, np.ndarray], h: np.ndarray) -> np.ndarray:
    bits, cells = sketch
    slot = h >> U(64 - bits)
    return (cells[(slot >> U(3)).astype(np.int64)] >> (slot & U(7)).astype(np.uint8)) & 1 != 0


def _emit(rows: DataFrame, shape: Shape, sketch, hot: np.ndarray, apart: bool) -> DataFrame:
    """Segments of the anchors that pass and are not hot; or, ``apart``, those of the hot ones."""
    sent = rows.sparkSession.sparkContext.broadcast((sketch, hot))

    def run(batches):
        sketch, hot = sent.value
        for b in batches:
            keys, hashes = b.column(0).to_pylist(), b.column(1).to_pylist()
            for ids, texts in chunks(range(b.num_rows), b.column(2).to_pylist()):
                words = words_of(texts)
                h, (at, a, lo, hi) = shape.anchors(words)
                if not len(at):
                    continue
                is_hot = member(hot, a)
                use = np.flatnonzero(is_hot if apart else passes(sketch, a) & ~is_hot)
                if not len(use):
                    continue
                at, a, lo, hi = at[use], a[use], lo[use], hi[use]
                doc = np.searchsorted(words.first, at, "right") - 1
                row = np.array(ids)[doc]
                key, th = np.array(keys, np.int64)[row], np.array(hashes, np.int64)[row]
                first = words.first[doc]
                raw = words.data.tobytes()
                seg = [raw[x:y] for x, y in zip(words.starts[lo].tolist(), words.ends[hi + shape.width - 1].tolist(), strict=True)]
                pos = (lo - first).astype(np.int32)
                if apart:
                    places: dict[tuple, list] = {}  # equal segments of a document are one row
                    for i, p, x in zip(row.tolist(), pos.tolist(), seg, strict=True):
                        places.setdefault((i, x), []).append(p)
                    own = [i for i, _ in places]
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in own], pa.int64()), pa.array([hashes[i] for i in own], pa.int64()), pa.array(list(places.values()), pa.list_(pa.int32())), pa.array([x for _, x in places], pa.binary())], ["key", "th", "pos", "seg"])
                else:
                    yield pa.RecordBatch.from_arrays([_signed(a), pa.array(key), pa.array(th), pa.array(pos), pa.array((at - lo).astype(np.int32)), pa.array(seg, pa.binary())], ["h", "key", "th", "pos", "anchor", "seg"])

    return rows.mapInArrow(run, HOT_SCHEMA if apart else SEGMENT_SCHEMA)


def _judge_hot(occurrences: DataFrame, shape: Shape) -> DataFrame:
    """The repeated windows of the hot anchors' segments."""
    segments = occurrences.groupBy("seg").agg(F.min("key").alias("key"))
    segments = materialize(segments.select("seg", "key", F.xxhash64("seg").alias("s1"), F.xxhash64(F.lit(1), "seg").alias("s2")), "segments")

    def cut(batches):
        for b in batches:
            for at, texts in chunks(range(b.num_rows), b.column(0).to_pylist()):
                words = words_of(texts)
                h = words.hash()
                of = np.repeat(np.arange(len(texts)), np.diff(words.first) - shape.width + 1)
                start = np.arange(len(of)) + of * (shape.width - 1)  # windows do not run on into the next segment
                w1, w2 = gram_hash(h, shape.width)[start], gram_hash(mix(h ^ U(0x5DEECE66D)), shape.width)[start]
                own = [b.column(i).to_numpy()[np.array(at)[of]] for i in (2, 3, 1)]
                yield pa.RecordBatch.from_arrays([_signed(w1), _signed(w2), *map(pa.array, own), pa.array((start - words.first[of]).astype(np.int32))], ["w1", "w2", "s1", "s2", "key", "at"])

    windows = materialize(segments.mapInArrow(cut, WINDOW_SCHEMA), "windows")
    nodes = windows.groupBy("w1", "w2").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).filter("lo < hi").select("w1", "w2", "lo")
    lower = windows.join(materialize(nodes, "nodes"), ["w1", "w2"]).filter("key > lo")
    lower = lower.groupBy("s1", "s2").agg(F.collect_list(F.struct("at", "lo")).alias("lower"))
    per = F.size(F.split(F.col("seg").cast("string"), SPACES)) - shape.width + 1
    verdict = materialize(segments.select("s1", "s2", F.col("key").alias("first"), per.alias("per")).join(lower, ["s1", "s2"], "left"), "verdict")
    met = occurrences.select("key", "th", "pos", F.xxhash64("seg").alias("s1"), F.xxhash64(F.lit(1), "seg").alias("s2")).join(verdict, ["s1", "s2"])
    # Any window has the segment's own smallest key at most, and a smaller one where it stands in another segment too.
    rest = F.expr("if(first < key, shiftleft(1L, per) - 1, 0L)")
    more = F.expr("aggregate(coalesce(lower, array()), 0L, (m, x) -> if(x.lo < key, m | shiftleft(1L, x.at), m))")
    low = F.least("first", F.expr("array_min(transform(lower, x -> x.lo))"))
    return met.select("key", "th", "pos", rest.bitwiseOR(more).alias("mask"), low.alias("lo")).filter("mask <> 0")


def _judged(segments: DataFrame, judge, shape: Shape, batch_bytes: int) -> DataFrame:
    """Deals segments by anchor and hands ``judge`` whole groups, about ``batch_bytes`` at a time: word arrays take some 30 bytes for each."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def done(parts):
            t = pa.Table.from_batches(parts).combine_chunks()
            mask, lo = judge(t["h"].to_numpy(), t["key"].to_numpy(), t["anchor"].to_numpy(), t["seg"].to_pylist(), shape)
            use = np.flatnonzero(mask)
            key, th, pos = (t[c].to_numpy()[use] for c in ("key", "th", "pos"))
            one = pa.ListArray.from_arrays(pa.array(np.arange(len(use) + 1, dtype=np.int32)), pa.array(pos))
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(th), one, pa.array(mask[use]), pa.array(lo[use])], ["key", "th", "pos", "mask", "lo"])

        for b in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
            held.append(b)
            size += b.nbytes
            if size >= batch_bytes:
                h = b.column(0).to_numpy()
                cut = int(np.searchsorted(h, h[-1]))  # the last group may go on in the next batch
                if cut:
                    yield done([*held[:-1], b.slice(0, cut)])
                    held, size = [b.slice(cut)], b.slice(cut).nbytes
        if held:
            yield done(held)

    return segments.repartition("h").sortWithinPartitions("h").mapInArrow(run, FOUND_SCHEMA)


def repeated(rows: DataFrame, shape: Shape, judge, group_rows: int = GROUP_ROWS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(key, th, pos, mask, lo): windows that also start in a document of smaller key.

    Bit i of ``mask`` stands for the windows that start i words after the words ``pos``;
    ``lo`` is the smallest key that has one of them.
    """
    anchors = materialize(_counted(rows, shape), "anchors")
    n, total = anchors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    limit = max(group_rows, total // HOT_ANCHORS)
    hot = np.sort(anchors.filter(F.col("n") > limit).select("h").toPandas()["h"].to_numpy(np.int64).view(U))
    sketch = bitmap(anchors, n)
    found = _judged(_emit(rows, shape, sketch, hot, False), judge, shape, batch_bytes)
    if len(hot):
        found = found.union(_judge_hot(materialize(_emit(rows, shape, sketch, hot, True), "occurrences"), shape))
    return found


def _cover(n: int, starts: np.ndarray, masks: np.ndarray, width: int) -> np.ndarray:
    """Which of ``n`` words are covered by a window."""
    bit = np.arange(63)
    at, off = np.nonzero((masks[:, None] >> bit) & 1)
    begin = np.unique(starts[at] + off)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, begin, 1)
    np.add.at(step, np.minimum(begin + width, n), -1)
    return np.cumsum(step)[:n] > 0


def by_document(found: DataFrame) -> DataFrame:
    return found.groupBy("key", "th").agg(F.collect_list(F.struct("pos", "mask", "lo")).alias("at"))


def _lists(column: pa.Array):
    """Per row of a list of (pos, mask, lo): None, or three arrays with an entry for each position."""
    offsets = column.offsets.to_numpy()
    pos, mask, lo = (column.values.field(i) for i in range(3))
    cut = pos.offsets.to_numpy()
    per = np.diff(cut)
    parts = pos.values.to_numpy(zero_copy_only=False), *(np.repeat(x.to_numpy(zero_copy_only=False), per) for x in (mask, lo))
    for i, ok in enumerate(column.is_valid().to_pylist()):
        a, z = cut[offsets[i]], cut[offsets[i + 1]]
        yield (parts[0][a:z], parts[1][a - cut[0] : z - cut[0]], parts[2][a - cut[0] : z - cut[0]]) if ok and z > a else None


def remove(docs: DataFrame, found: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words not covered by a found window, joined by one space."""

    def run(batches):
        for b in batches:
            out = []
            for text, at in zip(b.column(1).to_pylist(), _lists(b.column(2)), strict=True):
                words = (text or b"").split()
                if at is None:
                    out.append((len(words), 0, b" ".join(words)))
                    continue
                gone = _cover(len(words), at[0].astype(np.int64), at[1], width)
                kept = [words[i] for i in np.flatnonzero(~gone)]
                out.append((len(words), len(words) - len(kept), b" ".join(kept)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    rows = texts_of(docs, id_col, text_col).join(materialize(by_document(found), "found"), ["key", "th"], "left")
    return rows.select(id_of().alias("doc_id"), "text", "at").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary")


def spans(found: DataFrame, width: int) -> DataFrame:
    """(doc_id, start_word, n_words, first_doc_id): the covered runs of words; first_doc_id is the smallest id that shares a window of the run."""

    def run(batches):
        for b in batches:
            rows = []
            for i, at in zip(b.column(0).to_pylist(), _lists(b.column(1)), strict=True):
                bit = np.arange(63)
                j, off = np.nonzero((at[1][:, None] >> bit) & 1)
                begin, lo = at[0][j].astype(np.int64) + off, at[2][j]
                o = np.argsort(begin, kind="stable")
                begin, lo = begin[o], lo[o]
                head = np.flatnonzero(np.concatenate(([True], begin[1:] > begin[:-1] + width)))
                last = np.concatenate((head[1:], [len(begin)])) - 1
                low = np.minimum.reduceat(lo, head)
                rows += [(i, int(begin[x]), int(begin[y] + width - begin[x]), int(z)) for x, y, z in zip(head, last, low, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["key", "start_word", "n_words", "first"])

    out = by_document(found).select("key", "at").mapInArrow(run, "key long, start_word long, n_words long, first long")
    return out.select(id_of().alias("doc_id"), "start_word", "n_words", id_of("first").alias("first_doc_id"))
