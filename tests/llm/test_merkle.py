"""The Merkle manifest against a plain tree: heights, ragged runs, hard rows, tampering."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from clickfeat.llm import merkle
from clickfeat.llm.queries import QUERIES

FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def path(levels, i):
    out = []
    for nodes in levels[:-1]:
        start = i - i % 8
        out.append((i - start, nodes[start:i] + nodes[i + 1 : start + 8]))
        i //= 8
    return out


def fold(node, steps):
    for k, s in steps:
        node = sha("".join([*s[:k], node, *s[k:]]))
    return node


def brute(rows, lower=lambda row: False):
    """Sorted (id, leaf, claimed, subroot, root, path)."""
    names = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    of = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in names}
    trees = {x: tree([leaf(r) for r in of[x]]) for x in names}
    top = tree([trees[x][-1][0] for x in names])
    out = []
    for k, x in enumerate(names):
        up = path(top, k)
        for i, r in enumerate(of[x]):
            low = None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
            claimed = leaf((*r[:4], low)) if lower(r) else leaf(r)
            out.append((r[0], leaf(r), claimed, trees[x][-1][0], top[-1][0], path(trees[x], i) + up))
    return sorted(out, key=str)


def collect(df):
    return sorted(((r.id, r.leaf, r.claimed, r.subroot, r.root, [(s.slot, s.siblings) for s in r.path]) for r in df.collect()), key=str)


def test_heights(spark):
    """Trees of every kind of size around a run, a stored level and beyond it."""
    rows, i = [], 0
    for lang, n in {None: 1, "a": 2, "b": 8, "c": 9, "d": 64, "e": 65, "f": 512, "g": 513, "h": 577, "ü": 1, "z": 4200, **{f"one{k}": 1 for k in range(70)}}.items():
        for _ in range(n):
            i += 1
            rows.append((i * 7919 % 100_003, f"s{i % 3}", lang, i, f"Text Ü {i}"))
    random.Random(3).shuffle(rows)
    docs = spark.createDataFrame(rows, FIELDS).repartition(5)
    got = merkle.folded(merkle.manifest(docs, tampered=F.col("doc_id") % 3 == 0))
    want = brute(rows, lambda r: r[0] % 3 == 0)
    assert collect(got) == want
    assert all(r.folded_root == fold(r.claimed, [(s.slot, s.siblings) for s in r.path]) for r in got.collect())


def test_hard_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "", 0, ""), (None, "s", "en", 3, "AbC"), (None, "s", "en", 3, "x"), (4, "s", "en", 5, "A" * 200_000), (4, "s", "en", 5, "other")]
    rows += [(9, "s", "en", 1, "COPY")] * 700
    docs = spark.createDataFrame(rows, FIELDS).repartition(4).withColumns({c: F.lit("x") for c in ("tree", "hash", "n", "pos", "path", "part", "tie", "a.b", "c`d")})
    want = brute(rows, lambda r: True)
    got = merkle.manifest(docs, tampered=F.lit(True))
    assert collect(got) == want
    ok = merkle.folded(got).filter("folded_root = root").groupBy("id").count().collect()
    assert {r.id: r["count"] for r in ok} == {1: 1, 2: 1, None: 1, 4: 1}
    assert merkle.manifest(docs.limit(0)).count() == 0
    assert collect(merkle.manifest(docs.limit(1)))[0][5] == []  # a lone leaf is subroot and root


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001"])
def test_query(spark, folder):
    got = QUERIES["op13_merkle_manifest"](spark, folder).collect()
    assert len({r.doc_id for r in got}) == 200 and len({r.root for r in got}) == 1
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    import zlib

    for r in got:
        tampered = zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in docs[r.doc_id] or "")
        assert r.verified == (not tampered)
