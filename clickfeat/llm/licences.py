"""Licence scans with a generalised suffix automaton.

One automaton over the words of all templates knows every run of words that
stands in any of them. Texts are streamed through it: at each word it gives the
length of the longest run ending there that some template has (the matching
statistics). Runs of ``MIN_WORDS`` or more that can't be extended are placed in
the templates where they stand, and chained in the order of both text and
template, with at most ``GAP`` words between two; a chain that covers
``COVERAGE`` of a template is a licence span.

Words whose ``MIN_WORDS``-gram stands in no template can't be part of such a
run; they are passed over by a hash table before the automaton is asked. The
templates are a parameter, so the automaton, which every task gets, is bounded
by them. Rows are scanned where they are: nothing is shuffled, and no row is
compared with another.

Defined results: a null text counts as empty and has no words, places or
spans; rows, their ids and ties stay as they are; an empty table gives no
rows; other columns, whatever their names, are left out.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_of, keyed_text
from .licence_texts import PHRASES, TEMPLATES
from .words import LOWER, Lookup, chunks, gram_hash, words_of

MIN_WORDS = 3
GAP = 10
COVERAGE = 0.75

SEPARATORS = np.zeros(256, bool)
SEPARATORS[0x00:0x30] = SEPARATORS[0x3A:0x61] = SEPARATORS[0x7B:0x80] = True

_PLACES = "array<struct<label:string,word:long>>"
_SPANS = "array<struct<label:string,template:int,start_word:long,end_word:long,covered:int,coverage:double>>"


@dataclass
class Automaton:
    """Suffix automaton of several word sequences; state 0 has the empty run.

    ``ends[s]``: (template, end) of every place of the runs of state ``s``.
    """

    go: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    ends: list[list[tuple[int, int]]] = field(default_factory=lambda: [[]])

    @classmethod
    def of(cls, sequences: Sequence[Sequence[int]]) -> Automaton:
        a = cls()
        for k, seq in enumerate(sequences):
            at = 0
            for i, word in enumerate(seq):
                at = a._extend(at, word)
                a.ends[at].append((k, i + 1))
        for s in sorted(range(1, len(a.link)), key=lambda s: -a.length[s]):  # a state's runs also end where longer ones do
            a.ends[a.link[s]] += a.ends[s]
        return a

    def _state(self, length: int, link: int, go: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.go.append(go)
        self.ends.append([])
        return len(self.go) - 1

    def _extend(self, last: int, word: int) -> int:
        """The state of the run at ``last`` with ``word`` after it, made where it is missing."""
        known = self.go[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new = self._state(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and word not in self.go[at]:
            self.go[at][word] = new
            at = self.link[at]
        if at >= 0:
            other = self.go[at][word]
            self.link[new] = other if self.length[other] == self.length[at] + 1 else self._split(at, word, other)
        return new

    def _split(self, at: int, word: int, other: int) -> int:
        """Takes the shorter runs out of state ``other`` into a state of their own."""
        short = self._state(self.length[at] + 1, self.link[other], dict(self.go[other]))
        self.link[other] = short
        while at >= 0 and self.go[at].get(word) == other:
            self.go[at][word] = short
            at = self.link[at]
        return short

    def stream(self, words: Iterable[int]) -> Iterable[tuple[int, int]]:
        """Matching statistics: for each word the state and length of the longest known run that ends there."""
        s = n = 0
        go, link, length = self.go, self.link, self.length
        for word in words:
            while s and word not in go[s]:
                s = link[s]
                n = length[s]
            to = go[s].get(word)
            s, n = (0, 0) if to is None else (to, n + 1)
            yield s, n


def chain(runs: list[tuple[int, int, int]], gap: int = GAP) -> list[tuple[int, int, int]]:
    """Best chains (start, end, covered) among ``runs(end, end in the template, length)``, disjoint in the text.

    Runs come in order of their end. A run follows another that ends before it
    in text and template, with at most ``gap`` words left out in either; words
    in which they overlap count once. The chain that covers most stands first,
    the earlier one of equals.
    """
    best: list[tuple[int, int]] = []  # covered, start
    low = 0
    longest = max((n for *_, n in runs), default=0)
    for i, (e, t, n) in enumerate(runs):
        while runs[low][0] < e - longest - gap:
            low += 1
        cover, start = n, e - n
        for j in range(low, i):
            pe, pt, _ = runs[j]
            if pe < e and pt < t and e - n - pe <= gap and t - n - pt <= gap:
                more = best[j][0] + min(n, e - pe, t - pt)
                if more > cover:
                    cover, start = more, best[j][1]
        best.append((cover, start))
    taken: list[tuple[int, int, int]] = []
    for cover, start, end in sorted(((c, s, r[0]) for (c, s), r in zip(best, runs, strict=True)), key=lambda x: (-x[0], x[2], x[1])):
        at = bisect.bisect_left(taken, (start,))
        if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
            taken.insert(at, (start, end, cover))
    return taken


class Scanner:
    """Templates and phrases as word numbers, with the automaton and the table of their short runs."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: dict[str, str]):
        self.labels = [label for label, _ in templates]
        texts = [t.encode() for _, t in templates] + [p.encode() for p in phrases.values()]
        w = words_of(texts, SEPARATORS, LOWER)
        h = w.hash()
        self.names, where = np.unique(h, return_inverse=True)
        seqs = [where[a:b].tolist() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        self.sizes = [len(s) for s in seqs[: len(templates)]]
        self.automaton = Automaton.of(seqs[: len(templates)])
        self.grams = np.unique(np.concatenate([gram_hash(h[a:b], MIN_WORDS) for a, b in zip(w.first[: len(templates)], w.first[1:], strict=False)] or [np.zeros(0, np.uint64)]))
        self.phrases = [(label, s, [w.text(i) for i in range(a, b)]) for label, s, a, b in zip(phrases, seqs[len(templates) :], w.first[len(templates) :], w.first[len(templates) + 1 :], strict=False)]

    def __call__(self, texts: list[bytes | None]) -> tuple[list[int], list[list], list[list]]:
        """Per text: words, phrase places, licence spans."""
        w = words_of(texts, SEPARATORS, LOWER)
        h = w.hash()
        ids = Lookup(self.names).find(h)
        n = len(texts)
        doc = np.repeat(np.arange(n), np.diff(w.first))
        places: list[list] = [[] for _ in range(n)]
        for label, seq, raw in self.phrases:
            last = len(ids) - len(seq) + 1
            hit = np.ones(max(last, 0), bool)
            for j, word in enumerate(seq):
                hit &= ids[j : j + len(hit)] == word
            at = np.flatnonzero(hit)
            for i in at[doc[at] == doc[at + len(seq) - 1]].tolist():
                if all(w.text(i + j) == r for j, r in enumerate(raw)):
                    places[doc[i]].append({"label": label, "word": i - int(w.first[doc[i]])})
        spans: list[list] = [[] for _ in range(n)]
        grams = gram_hash(h, MIN_WORDS)
        known = np.flatnonzero(Lookup(self.grams).find(grams) >= 0)
        known = known[doc[known] == doc[known + MIN_WORDS - 1]]
        if len(known):
            cut = np.flatnonzero((np.diff(known) > 1) | (np.diff(doc[known]) > 0)) + 1
            runs: dict[tuple[int, int], list] = {}
            for a, b in zip(known[np.r_[0, cut]].tolist(), (known[np.r_[cut - 1, len(known) - 1]] + MIN_WORDS).tolist(), strict=True):
                self._runs(ids[a:b].tolist(), a - int(w.first[doc[a]]), int(doc[a]), runs)
            for (d, k), found in runs.items():
                for start, end, cover in chain(found):
                    if (share := cover / self.sizes[k]) >= COVERAGE:
                        spans[d].append({"label": self.labels[k], "template": k, "start_word": start, "end_word": end, "covered": cover, "coverage": share})
        for s in spans:
            s.sort(key=lambda x: (x["start_word"], x["end_word"], x["template"]))
        for p in places:
            p.sort(key=lambda x: (x["word"], x["label"]))
        return np.diff(w.first).tolist(), places, spans

    def _runs(self, words: list[int], offset: int, doc: int, out: dict[tuple[int, int], list]) -> None:
        """Adds the runs in one stretch that can't be extended to the right, by text and template."""
        state, length = 0, 0
        for i, (s, n) in enumerate([*self.automaton.stream(words), (0, 0)]):
            if n <= length and length >= MIN_WORDS:
                for k, t in self.automaton.ends[state]:
                    out.setdefault((doc, k), []).append((offset + i, t, length))
            state, length = s, n


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """(doc_id, n_words, places, spans): every place of the phrases and every covered template span of each text.

    Words are counted from 0; ``end_word`` is exclusive, ``template`` the place
    in ``templates``, ``covered`` the template words that the text has there.
    """

    def run(batches):
        look = Scanner(templates, phrases)
        for b in batches:
            for keys, texts in chunks(b.column(0).to_pylist(), (t.as_py() for t in b.column(1))):
                n, places, spans = look(texts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(n, pa.int64()),
                     pa.array(places, pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))),
                     pa.array(spans, pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("covered", pa.int32()), ("coverage", pa.float64())])))],
                    ["key", "n_words", "places", "spans"])

    out = keyed_text(docs, id_col, text_col).mapInArrow(run, f"key long, n_words long, places {_PLACES}, spans {_SPANS}")
    return out.select(id_of().alias("doc_id"), "n_words", "places", "spans")
