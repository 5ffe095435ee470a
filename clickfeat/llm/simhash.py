"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all fingerprints within half the radius; two
fingerprints within the radius share at least one of them. A shuffle on these
variants brings them together. A variant meets at most as many distinct
fingerprints as its ball has members (65 for radius 2), so no group is large,
and exact copies share one fingerprint and never form pairs.

Defined results: null and empty texts have the fingerprint zero and link like
any other; a text with fewer words than a shingle is one shingle; repeated
rows keep one row each; a null id counts as the largest id and stays null.
``first_rows`` tells rows of one id apart by a hash of their text: of each group
the row with the smallest id stays, of those the one with the smallest hash,
and of rows that agree in both any one.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import materialize, quoted
from .common import connected_components, id_of, key_of, keyed_text

SHINGLE = 3
MAX_BITS = 2
SEED = 42

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANE = np.arange(8, dtype=np.int64) * 256


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint: a bit is set where over half of the shingles' hashes have it."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    hash64 = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [hash64(joined, SEED)]
    else:
        hashes = [hash64(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=False)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        lanes = np.array(hashes[i : i + (1 << 16)], np.uint64).view(np.uint8).reshape(-1, 8)
        seen = np.bincount((lanes + _LANE).ravel(), minlength=2048).reshape(8, 256)
        counts += (seen @ _BYTE_BITS).ravel()
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp): one row per row of ``docs``."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, shingle) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["key", "fp"])

    return keyed_text(docs, id_col, text_col).mapInArrow(run, "key long, fp long")


def _text_hash(text_col: str):
    return F.xxhash64(F.col(quoted(text_col)).cast("binary"))


def ball(radius: int) -> list[int]:
    """Masks of all ways to change at most ``radius`` of 64 bits, as signed longs."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in itertools.combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) links that connect all distinct fingerprints ``prints(fp, rep)`` at ``max_bits`` or fewer differing bits.

    All members of a variant's ball are within ``max_bits`` of one another, so
    a link from each to the one with the smallest id keeps every connection.
    """
    if max_bits % 2:
        raise ValueError("half the radius must be whole: max_bits has to be even")
    masks = F.array(*[F.lit(m).cast("long") for m in ball(max_bits // 2)])
    near = prints.select("fp", "rep", F.explode(masks).alias("mask"))
    near = near.select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp", "rep")
    met = near.withColumn("hub", F.min(F.struct("rep", "fp")).over(Window.partitionBy("variant")))
    met = met.filter(F.col("rep") != F.col("hub.rep"))
    met = met.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("hub.fp"))) <= max_bits)
    return met.select(F.col("rep").alias("a"), F.col("hub.rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id): the component of each document, named by its smallest id."""
    prints = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("key").alias("rep")), "distinct")
    found = connected_components(links(distinct, max_bits)).withColumnRenamed("id", "rep")
    distinct = distinct.join(found, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component"))
    distinct = materialize(distinct, "labels")
    out = prints.join(distinct, "fp")
    return out.select(id_of().alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), id_of("component").alias("component_id"))


def first_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The input rows and columns, one row of each group of near duplicates.

    Groups are those of linked fingerprints, not of ids, so texts that share
    nothing but an id are not drawn together.
    """

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, shingle) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))], ["key", "th", "fp"])

    texts = docs.select(key_of(id_col).alias("key"), _text_hash(text_col).alias("th"), F.col(quoted(text_col)).cast("binary").alias("text"))
    prints = materialize(texts.mapInArrow(run, "key long, th long, fp long").groupBy("fp", "key", "th").agg(F.count("*").alias("n")), "fingerprints")
    distinct = prints.select("fp").distinct()
    found = connected_components(links(distinct.withColumn("rep", F.col("fp")), max_bits)).withColumnRenamed("id", "fp")
    grouped = prints.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    grouped = materialize(grouped.select("component", "key", "th", "n"), "groups")
    # Written, so that the join below has a shuffle of its own on either side and Spark can split a large component.
    first = materialize(grouped.groupBy("component").agg(F.min(F.struct("key", "th")).alias("first")), "first")
    placed = grouped.join(first, "component").withColumn("stays", F.struct("key", "th") == F.col("first"))
    gone = materialize(placed.filter("not stays").select("key", "th").distinct(), "copies")
    again = materialize(placed.filter("stays and n > 1").select("key", "th").distinct(), "again")
    rows = docs.select(F.struct("*").alias("row"), key_of(id_col).alias("key"), _text_hash(text_col).alias("th"))
    rows = rows.join(gone, ["key", "th"], "left_anti")
    if again.isEmpty():
        return rows.select("row.*")
    once = rows.join(again, ["key", "th"], "left_anti").select("row")
    one = rows.join(again, ["key", "th"], "left_semi").groupBy("key", "th").agg(F.first("row").alias("row")).select("row")
    return once.union(one).select("row.*")
