"""Substring deduplication with prefix-partitioned suffix trees.

Suffixes that start at candidate windows (see ``passages``) are split by
variable-length prefixes into groups that fit a task: the prefix is the anchor
of ``GRAM`` words, and all words of the window where that anchor has too many
occurrences. Suffixes are cut at the window's width, as deeper nodes decide
nothing more. In each group the subtree is built from the sorted suffixes and
their longest common prefixes: a node of depth d is a maximal run of suffixes
whose neighbours share d words or more. The nodes at the full width are the
repeats; a window is removed if its node holds a smaller id.

Defined results: null text has no words; a text shorter than a window keeps
all; rows with equal id are one document, told apart by a hash of the text; a
null id counts as larger than any other; words are compared byte by byte.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .passages import GROUP_ROWS, Shape, remove, repeated, texts_of
from .words import words_of

WIDTH = 13
GRAM = 4


def deep_nodes(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes (rows of word symbols), and where in it each deepest node starts."""
    order = np.lexsort(suffixes.T[::-1])
    ordered = suffixes[order]
    common = np.cumprod(ordered[1:] == ordered[:-1], axis=1).sum(axis=1)
    return order, np.flatnonzero(np.concatenate(([True], common < suffixes.shape[1])))


def judge(h, key, anchor, segments, shape: Shape):
    """Masks of the windows of each segment whose node holds a smaller key, and that key."""
    words = words_of(segments)
    symbols = words.hash()
    per = np.diff(words.first) - shape.width + 1
    row = np.repeat(np.arange(len(segments)), per)
    offset = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    start = words.first[row] + offset
    order, nodes = deep_nodes(symbols[start[:, None] + np.arange(shape.width)])
    keys = key[row][order]
    lowest = np.minimum.reduceat(keys, nodes)
    low = np.empty(len(keys), np.int64)
    low[order] = np.repeat(lowest, np.diff(np.concatenate((nodes, [len(keys)]))))
    hit = low < key[row]
    mask = np.zeros(len(segments), np.int64)
    np.bitwise_or.at(mask, row[hit], np.int64(1) << offset[hit])
    lo = np.full(len(segments), np.iinfo(np.int64).max)
    np.minimum.at(lo, row[hit], low[hit])
    return mask, lo


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every text without the windows that a smaller id has too."""
    shape = Shape(width, gram)
    found = repeated(texts_of(docs, id_col, text_col), shape, judge, group_rows)
    return remove(docs, found, width, id_col, text_col)
