"""Substring deduplication with sparse suffix arrays.

Only suffixes at content-selected positions are kept: the minimiser of each
window of ``WIDTH`` words (see ``passages``), about one word in twenty. The
suffixes of a group (equal minimiser words) are sorted by the words to the
right of the anchor and, in a second array, by the words to its left, and
neighbours are compared. A match found at an anchor is then extended: for
every split of the width into l words on the left and the rest on the right,
suffixes whose neighbours agree on at least that much on both sides form a
class, and a window is a repeat if its class holds a smaller id.

Defined results: as for ``suffix_trees``; documents without a repeat give no
row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .passages import GROUP_ROWS, Shape, remove, repeated, spans, texts_of
from .words import U, words_of

WIDTH = 50
GRAM = 12


def _sorted_side(h: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each suffix in the sorted array, and the words that neighbours there have in common (-1 across groups)."""
    order = np.lexsort([*side.T[::-1], h])
    ordered = side[order]
    common = np.cumprod(ordered[1:] == ordered[:-1], axis=1).sum(axis=1)
    common[h[order][1:] != h[order][:-1]] = -1
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place, common


def judge(h, key, anchor, segments, shape: Shape):
    words = words_of(segments)
    symbols = np.concatenate((words.hash(), [U(0)]))
    n = len(segments)
    size = np.diff(words.first)
    at = words.first[:-1] + anchor
    windows = size - shape.width + 1
    right_at = at[:, None] + np.arange(shape.width)
    right = symbols[np.where(right_at < words.first[1:][:, None], right_at, -1)]
    reach = shape.width - shape.gram
    left_at = at[:, None] - 1 - np.arange(reach)
    left = symbols[np.where(left_at >= words.first[:-1][:, None], left_at, -1)]
    r_place, r_common = _sorted_side(h, right)
    l_place, l_common = _sorted_side(h, left)
    mask = np.zeros(n, np.int64)
    lo = np.full(n, np.iinfo(np.int64).max)
    for l in range(reach + 1):
        rows = np.flatnonzero((anchor >= l) & (anchor - l < windows))  # those with a window that starts l words before the anchor
        if not len(rows):
            continue
        right_class = np.concatenate(([0], np.cumsum(r_common < shape.width - l)))[r_place[rows]]
        left_class = np.concatenate(([0], np.cumsum(l_common < l)))[l_place[rows]]
        _, group = np.unique(right_class * n + left_class, return_inverse=True)
        low = np.full(group.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, group, key[rows])
        low = low[group]
        hit = low < key[rows]
        mask[rows[hit]] |= np.int64(1) << (anchor[rows[hit]] - l).astype(np.int64)
        lo[rows[hit]] = np.minimum(lo[rows[hit]], low[hit])
    return mask, lo


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, start_word, n_words, first_doc_id): the passages of ``width`` words or more that a smaller id has too."""
    return spans(repeated(texts_of(docs, id_col, text_col), Shape(width, gram), judge, group_rows), width)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every text without these passages."""
    return remove(docs, repeated(texts_of(docs, id_col, text_col), Shape(width, gram), judge, group_rows), width, id_col, text_col)
