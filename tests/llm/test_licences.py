"""Licence scans: the automaton, chains and whole results against plain versions."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clickfeat.llm import licences
from clickfeat.llm.licence_texts import PHRASES, TEMPLATES
from clickfeat.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def longest(seq, templates, i):
    """Length of the longest run ending after seq[i] that stands in a template."""
    n, held = 0, [" " + " ".join(map(str, t)) + " " for t in templates]
    while n <= i and any(" " + " ".join(map(str, seq[i - n : i + 1])) + " " in t for t in held):
        n += 1
    return n


def brute(text, templates=TEMPLATES, phrases=PHRASES):
    """(words, base places, best covered share per template)."""
    w = words(text)
    base = sorted((i, label) for label, p in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    temps = [words(t) for _, t in templates]
    ms = [longest(w, temps, i) for i in range(len(w))] + [0]
    share = {}
    for k, t in enumerate(temps):
        runs = []
        for i in range(len(w)):
            n = ms[i]
            if n >= licences.MIN_WORDS and ms[i + 1] <= n:
                runs += [(i + 1, j + n, n) for j in range(len(t) - n + 1) if t[j : j + n] == w[i + 1 - n : i + 1]]
        best = []
        for i, (e, x, n) in enumerate(runs):
            best.append(max([n] + [best[j] + min(n, e - a, x - b) for j, (a, b, _) in enumerate(runs[:i]) if a < e and b < x and e - n - a <= licences.GAP and x - n - b <= licences.GAP]))
        share[k] = max(best, default=0) / len(t)
    return len(w), base, share


def expect(text):
    n, base, share = brute(text)
    found = {k: s for k, s in share.items() if s >= licences.COVERAGE}
    labels = {x for _, x in base}
    at = [i for i, _ in base]
    return (n, len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {TEMPLATES[k][0] for k in found})), max(found.values(), default=0.0))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=9), min_size=1, max_size=4), st.lists(st.integers(0, 4), max_size=25))
def test_matching_statistics(templates, text):
    a = licences.Automaton.of(templates)
    for i, (s, n) in enumerate(a.stream(text)):
        assert n == longest(text, templates, i)
        if n:
            run = text[i + 1 - n : i + 1]
            assert sorted(a.ends[s]) == sorted((k, j + n) for k, t in enumerate(templates) for j in range(len(t) - n + 1) if t[j : j + n] == run)


def test_chain_skips_and_repeats():
    assert licences.chain([]) == []
    # two runs of a template with one strange word between them, and a second whole copy
    assert licences.chain([(4, 4, 4), (9, 8, 4), (20, 8, 8)]) == [(0, 9, 8), (12, 20, 8)]
    # the same template words again don't count twice
    assert licences.chain([(5, 5, 5), (12, 5, 5)]) == [(0, 5, 5), (7, 12, 5)]


MIT = next(t for label, t in TEMPLATES if label == "mit" and len(t) > 100)
TEXTS = {
    1: "Released under the MIT License.", 2: None, 3: "", 4: "Lizenz: MIT-license, mit LICENSE; General/Public license ümlaut",
    5: MIT.replace("person", "kind person").replace("merge, ", ""), 6: MIT + " filler words here and there " + MIT, 7: "the software is provided " * 400,
    8: "Licensed under CC BY-NC 4.0. " * 3, 9: " ".join(MIT.split()[:20]), 10: "MIT License" * 3, 11: "mit", 12: "license mit license mit license",
}


def test_hard_texts(spark):
    rows = [*TEXTS.items(), (1, TEXTS[1]), (None, TEXTS[8])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = docs.withColumns({c: F.lit("x") for c in ("key", "places", "spans", "a.b", "_id", "n`w")})
    got = licences.scan(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = TEXTS[8] if r.doc_id is None else TEXTS[r.doc_id]
        n, base, share = brute(text)
        assert r.n_words == n and [(p.word, p.label) for p in r.places] == base
        best = {}
        for s in r.spans:
            assert s.coverage == s.covered / len(words(TEMPLATES[s.template][1])) and 0 <= s.start_word < s.end_word <= n
            best[s.template] = max(best.get(s.template, 0), s.coverage)
        assert best == {k: x for k, x in share.items() if x >= licences.COVERAGE}
    spans = {r.doc_id: r.spans for r in got if r.doc_id is not None}
    assert len([s for s in spans[6] if s.coverage == 1 and s.label == "mit"]) == 2
    assert [s.label for s in spans[8]] == ["cc-by-nc"] * 3
    assert spans[9] == []
    assert licences.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("folder", [DIR])
def test_query(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_licence_scan"](spark, folder).collect()}
    short = {i: t for i, t in texts.items() if len(t or "") < 4000}
    assert {i: got[i] for i in short} == {i: expect(t) for i, t in short.items()}
    assert set(got) == set(texts)
    assert any(g[5] for g in got.values())
