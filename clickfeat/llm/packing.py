"""Conflict-constrained best-fit packing of documents into training sequences.

A sequence (bin) holds at most ``capacity`` words, at most one piece of each
source and at most one piece of each duplicate cluster. Documents longer than
a bin are cut into pieces of ``capacity`` words and a rest; nothing is dropped.

The pieces are dealt by a hash of id and piece over groups of about
``group_words`` words, so that a group fits one task whatever the number of
documents, and a hot source or cluster is spread over all groups. Within a
group pieces go, longest first, to the open bin with the least room that
suffices and with no conflict. Bins stand in order of their room and carry a
bitmap of sources and one of clusters; the successor search walks on from the
first bin with enough room until it meets a compatible one, which so is the
tightest.

Defined results: a document without words gives no piece; a null source is a
source of its own; a null cluster never conflicts; repeated rows are packed
as often as they occur; a null id stays null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
GROUP_WORDS = 500_000
WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, piece int, start_word long, n_words long, bin_id string, slot int, bin_words long"


def pack_group(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece. ``clusters`` -1 conflicts with nothing."""
    n = len(sizes)
    _, src = np.unique(sources, return_inverse=True)
    codes, clu, many = np.unique(clusters, return_inverse=True, return_counts=True)
    shared = (many > 1) & (codes != -1)  # a cluster with one piece here can't conflict
    bit = np.where(shared, np.cumsum(shared) - 1, -1)[clu]
    out = np.empty(n, np.int64)
    # The bins in order of their room: room, bin number; the bitmaps by bin number.
    room = np.empty(n, np.int64)
    number = np.empty(n, np.int64)
    has_source = np.zeros((max(1, (src.max(initial=0) >> 6) + 1), n), np.uint64)
    has_cluster = np.zeros((max(1, (int(shared.sum()) + 63) >> 6), n), np.uint64)
    used = bins = 0
    for i in np.argsort(-sizes, kind="stable"):
        size, s, c = sizes[i], src[i], bit[i]
        s_row, s_bit = has_source[s >> 6], np.uint64(1) << np.uint64(s & 63)
        at, step, found = int(np.searchsorted(room[:used], size)), 16, -1
        while at < used:  # successors in order of room, in growing strides
            near = number[at : min(at + step, used)]
            clash = (s_row[near] & s_bit) != 0
            if c >= 0:
                clash |= (has_cluster[c >> 6][near] >> np.uint64(c & 63)) & np.uint64(1) != 0
            if not clash.all():
                found = at + int(np.argmin(clash))
                break
            at += step
            step *= 4
        if found < 0:
            b, left = bins, capacity - size
            bins += 1
        else:
            b, left = number[found], room[found] - size
            room[found : used - 1] = room[found + 1 : used].copy()
            number[found : used - 1] = number[found + 1 : used].copy()
            used -= 1
        out[i] = b
        s_row[b] |= s_bit
        if c >= 0:
            has_cluster[c >> 6][b] |= np.uint64(1) << np.uint64(c & 63)
        if left > 0:
            to = int(np.searchsorted(room[:used], left))
            room[to + 1 : used + 1] = room[to:used].copy()
            number[to + 1 : used + 1] = number[to:used].copy()
            room[to], number[to] = left, b
            used += 1
    return out


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")


def same_words(text: str = "text") -> Column:
    """The exact duplicate cluster of a text: a hash of its lower-cased words."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(F.col(f"`{text}`")), r"[\x20\x09-\x0D]+", " ")))


def pack(docs: DataFrame, cluster: Column | None = None, size: Column | None = None, capacity: int = CAPACITY, group_words: int = GROUP_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per piece: doc_id, piece, start_word, n_words, bin_id, slot (place in the bin), bin_words (the bin's fill)."""
    cluster = same_words(text_col) if cluster is None else cluster
    size = word_count(text_col) if size is None else size
    docs = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.xxhash64(F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("\0"))).alias("source"),
        F.coalesce(cluster.cast("long"), F.lit(-1)).alias("cluster"),
        size.cast("long").alias("size"),
    )
    pieces = docs.filter("size > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {capacity}"))).alias("piece"))
    pieces = pieces.select(
        "doc_id", "source", "cluster", F.col("piece").cast("int").alias("piece"),
        (F.col("piece") * capacity).alias("start_word"), F.least(F.lit(capacity), F.col("size") - F.col("piece") * capacity).alias("n_words"),
    )
    # No cache: the sizes are counted twice, in the JVM, which is cheaper than to keep them.
    total = docs.agg(F.sum("size")).first()[0] or 0
    groups = max(1, -(-total // group_words))
    # Rows that agree in all columns are dealt to the same group and still packed as often as they occur.
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "source"), F.lit(groups)).cast("long"))

    def run(table: pa.Table) -> pa.Table:
        t = table.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("source", "ascending"), ("cluster", "ascending")])
        words = t["n_words"].to_numpy()
        bins = pack_group(words, t["source"].to_numpy(), t["cluster"].to_numpy(), capacity)
        order = np.argsort(bins, kind="stable")
        sorted_bins = bins[order]
        head = np.searchsorted(sorted_bins, sorted_bins)
        slot = np.empty(len(bins), np.int32)
        slot[order] = np.arange(len(bins)) - head
        fill = np.bincount(bins, weights=words).astype(np.int64)[bins]
        names = np.char.add(f"{t['grp'][0].as_py()}-", bins.astype(str))
        cols = [t["doc_id"].combine_chunks(), t["piece"].combine_chunks(), t["start_word"].combine_chunks(), t["n_words"].combine_chunks(), pa.array(names.tolist(), pa.string()), pa.array(slot), pa.array(fill)]
        return pa.Table.from_arrays(cols, ["doc_id", "piece", "start_word", "n_words", "bin_id", "slot", "bin_words"])

    return dealt.groupBy("grp").applyInArrow(run, SCHEMA)
