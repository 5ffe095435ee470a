"""Benchmark decontamination against a plain version, and classes of items."""

import re

from clickfeat.llm import decontaminate as d
from clickfeat.llm.queries import QUERIES

DIR = "/root/testdata/sf0.001"
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
UNITS = {u.encode() for u in d.UNITS.split()}


def codes(word):
    """(plain code, named code) of a word: placeholders as numbers, others as lower-cased text."""
    low = word.lower()
    if word[:1].isdigit():
        return 1, 1
    if low in UNITS:
        return 3, 3
    name = word[:1].isupper() or (word[:1] == b"\xc3" and 0x80 <= (word[1:2] or b"\0")[0] <= 0x9E)
    return low, 2 if name else low


def windows(text, widths, whole):
    """{(variant, template): {(pattern, values)}} of a text."""
    out = {}
    w = WORD.findall((text or "").encode())
    for width in widths:
        if whole and width < d.WINDOW and len(w) != width:
            continue
        for i in range(len(w) - width + 1):
            part = w[i : i + width]
            both = [codes(x) for x in part]
            for variant in range(3):
                t = [c[variant] if variant < 2 else x.lower() for c, x in zip(both, part, strict=True)]
                slots = [j for j, c in enumerate(t) if isinstance(c, int)]
                plain = sum(isinstance(c[0], int) for c in both)
                if variant == 2 and width >= d.SHORTEST and plain * 2 <= width:
                    continue
                if variant < 2 and (width < d.SHORTEST or len(slots) * 2 > width):
                    continue
                values = tuple(part[j].lower() for j in slots)
                out.setdefault((variant, tuple(t)), set()).add((tuple(values.index(v) for v in values), values))
    return out


def brute(docs, items):
    asked = {i: windows(t, range(1, d.WINDOW + 1), True) for i, t in items}
    classes = {}
    for i, found in asked.items():
        for h, ways in found.items():
            for pattern, values in ways:
                c = classes.setdefault((h, pattern), [i, set()])
                c[0] = min(c[0], i)
                c[1].add(values)
    widths = {len(h[1]) for h, _ in classes}
    out = {}
    for i, t in docs:
        for h, ways in windows(t, widths, False).items():
            for pattern, values in ways:
                if (h, pattern) in classes:
                    item, own = classes[h, pattern]
                    n, exact = out.get((i, item), (set(), False))
                    out[i, item] = (n | {h}, exact or values in own)
    return {k: (len(n), exact) for k, (n, exact) in out.items()}


def test_query_against_plain_version(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id): (r.n_windows, r.exact) for r in QUERIES["op9_benchmark_templates"](spark, DIR).collect()}
    assert got == brute(docs, items) and got


ASKED = "Anna buys {} kg of apples and {} kg of pears and pays {} euros for all of them at the old market hall"


def test_many_items_of_one_template_make_no_pairs(spark):
    items = [(i, ASKED.format(i, i + 1, 3 * i)) for i in range(10, 40)] + [(5, ASKED.format(7, 7, 9)), (99, None)]
    docs = [(i, "so " + ASKED.format(i, i + 2, 5)) for i in range(100, 160)] + [(1, ASKED.format(4, 4, 8)), (2, ASKED.format(12, 13, 36)), (3, ASKED.replace("apples", "grapes").format(1, 2, 3)), (3, ASKED.format(1, 2, 3)), (4, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    got = {(r.doc_id, r.item_id): (r.n_windows, r.exact) for r in rows}
    assert got == brute(docs, items)
    assert {i for i, _ in got} == {*range(100, 160), 1, 2, 3}
    assert got[2, 10][1] and not got[100, 10][1]
    assert len(rows) < 3 * 64
    of = {}
    for r in d.members(bench).collect():
        of.setdefault(r.item_id, set()).add(r.member_id)
    assert set(range(10, 40)) <= of[10] and all(k == min(v) for k, v in of.items())
