"""Word arrays: tokenise and hash many texts at once with numpy, inside Spark tasks.

Words are runs of bytes outside a separator class (by default the ASCII white
space ``\\x20 \\x09-\\x0D``). Every word gets a 64-bit polynomial hash of its
bytes, so that the operators shuffle numbers instead of strings.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD_BASE = 0xD1342543DE82EF95
_WORD_INVERSE = pow(_WORD_BASE, -1, 1 << 64)


class _Cache(dict):
    """A cache that is sent to the workers empty."""

    def __reduce__(self):
        return _Cache, ()


_POWERS = _Cache()


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        p = np.full(max(n, 1 << 16), base, U)
        p[0] = 1
        have = _POWERS[base] = np.cumprod(p, dtype=U)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of a 64-bit hash over all its bits."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


@dataclass
class Words:
    """Words of several texts in order; text ``i`` owns words ``first[i]:first[i+1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    sums: np.ndarray

    def hash(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """Hashes of the words, or of other byte ranges of the data."""
        s = self.starts if starts is None else starts
        e = self.ends if ends is None else ends
        return mix((self.sums[e] - self.sums[s]) * powers(_INVERSE, len(self.data) + 1)[s])

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def words_of(texts: list[bytes | None], separators: np.ndarray = SPACE, fold: np.ndarray = SAME) -> Words:
    """Tokenise texts (None: no words). ``fold`` maps bytes before hashing."""
    sep = bytes([int(np.flatnonzero(separators)[0])])
    raw = sep.join(t or b"" for t in texts) + sep
    raw = raw.translate(fold.tobytes())
    data = np.frombuffer(raw, np.uint8)
    gap = np.frombuffer(b"\1" + raw.translate(separators.tobytes()), bool)
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    lens = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, len(texts))
    first = np.searchsorted(starts, np.concatenate(([0], np.cumsum(lens))))
    sums = np.zeros(len(data) + 1, U)
    np.add(data, U(1), out=sums[1:])
    sums[1:] *= powers(_BASE, len(data))
    np.cumsum(sums[1:], out=sums[1:])
    return Words(data, starts, ends, first, sums)


def chunks(ids: Iterable, texts: Iterable[bytes | None], size: int = CHUNK_BYTES) -> Iterator[tuple[list, list]]:
    """Cut rows into runs of about ``size`` bytes of text; a longer text is a run of its own."""
    a: list = []
    b: list = []
    n = 0
    for i, t in zip(ids, texts, strict=True):
        if a and n + len(t or b"") > size:
            yield a, b
            a, b, n = [], [], 0
        a.append(i)
        b.append(t)
        n += len(t or b"")
    if a:
        yield a, b


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words, from the words' hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    sums = np.zeros(len(h) + 1, U)
    np.cumsum(h * powers(_WORD_BASE, len(h)), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(_WORD_INVERSE, len(h) + 1)[:n])


def member(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of ``h`` are in the sorted array ``keys``; a small bitmap answers most of them."""
    if not len(keys):
        return np.zeros(len(h), bool)
    bits = max(16, int(len(keys) * 16 - 1).bit_length())
    seen = np.zeros(1 << bits, bool)
    shift = U(64 - bits)
    seen[(keys >> shift).astype(np.int64)] = True
    out = seen[(h >> shift).astype(np.int64)]
    at = np.flatnonzero(out)
    pos = np.searchsorted(keys, h[at])
    out[at] = keys[np.minimum(pos, len(keys) - 1)] == h[at]
    return out


class Lookup:
    """Positions in a sorted array of well-mixed hashes: a table by leading bits gives where to begin, a few steps the rest."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(8, int(4 * len(keys)).bit_length())
        self.shift = U(64 - bits)
        self.begin = np.empty(1 << bits, np.int32)
        for a in range(0, 1 << bits, 1 << 16):
            part = self.begin[a : a + (1 << 16)]
            part[:] = np.searchsorted(keys, np.arange(a, a + len(part), dtype=U) << self.shift)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The position of each of ``h`` in the keys, -1 where it is none."""
        out = np.full(len(h), -1)
        if not len(self.keys):
            return out
        at = self.begin.take((h >> self.shift).view(np.int64)).astype(np.int64)
        left, all_h = np.arange(len(h)), h
        while len(left):
            key = self.keys.take(at, mode="clip")
            hit = np.flatnonzero(key == h)
            out[left.take(hit)] = at.take(hit)
            on = np.flatnonzero((key < h) & (at < len(self.keys) - 1))
            left, at = left.take(on), at.take(on) + 1
            h = all_h.take(left)
        return out
