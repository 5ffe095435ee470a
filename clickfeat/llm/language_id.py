"""Language identification by nearest centroids of TF-IDF n-gram vectors.

Every text becomes a vector of hashed byte n-grams (one to three bytes, ASCII
letters in lower case, other ASCII characters as a blank): log term frequency
times inverse document frequency, normalised. The document frequencies come
from all training documents. Each language has several centroids, found by
spherical k-means over at most ``SAMPLE`` of its training documents (those
with the smallest hash of id). A text gets the language of the centroid with
the largest cosine, which is its score. It is marked as rejected if it is
farther from that centroid than ``DEVIATIONS`` standard deviations of the
centroid's own training documents.

Defined results: null text, or text without a letter, is ``und`` with score 0;
without training rows every text is ``und``; null languages are not learned;
equal cosines go to the language that sorts first; repeated rows and extra
columns change nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sinks import materialize
from .words import LOWER, chunks

SAMPLE = 2_000
CENTROIDS = 3
DIMS = 4096
ROUNDS = 4
DEVIATIONS = 4.0
UNDETERMINED = "und"
LETTER = r"\p{L}"

_KEEP = LOWER.copy()
for _c in range(128):
    if not chr(_c).isalpha():
        _KEEP[_c] = 32


def counts(texts: list[bytes | None]) -> np.ndarray:
    """Counts of the hashed n-grams, one row of ``DIMS`` per text."""
    k = len(texts)
    raw = b"  " + b"  ".join(t or b"" for t in texts) + b"  "  # two blanks: no n-gram spans two texts
    data = _KEEP[np.frombuffer(raw, np.uint8)]
    lens = np.fromiter((len(t or b"") + 2 for t in texts), np.int64, k)
    owner = np.repeat(np.arange(k, dtype=np.int64) * DIMS, lens)
    owner = np.concatenate((owner, np.full(len(data) - len(owner), (k - 1) * DIMS if k else 0)))
    wide = data.astype(np.uint32)
    blank = data == 32
    bins = []
    for n in (1, 2, 3):
        code = wide.copy() if n == 1 else sum(wide[i : len(wide) - n + 1 + i] << np.uint32(8 * (n - 1 - i)) for i in range(n))
        bad = blank.copy() if n == 1 else blank[:-1] & blank[1:]
        if n == 3:
            bad = bad[:-1] | bad[1:]
        slot = ((code + np.uint32(n << 24)) * np.uint32(2654435761)) >> np.uint32(20)
        ok = ~bad
        bins.append(owner[: len(code)][ok] + slot[ok])
    return np.bincount(np.concatenate(bins), minlength=k * DIMS)[: k * DIMS].reshape(k, DIMS) if k else np.zeros((0, DIMS))


def vectors(texts: list[bytes | None], idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts(texts)).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _batches(texts):
    """Runs of texts of bounded size, both in bytes and in vectors."""
    for at, part in chunks(range(len(texts)), texts):
        for i in range(0, len(at), 256):
            yield at[i : i + 256], part[i : i + 256]


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, centroids: np.ndarray, owner: np.ndarray, floor: np.ndarray):
        self.langs, self.idf, self.centroids, self.owner, self.floor = langs, idf, centroids, owner, floor

    def predict(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, lang_pred, score, rejected) for each row."""
        sent = docs.sparkSession.sparkContext.broadcast((self.langs, self.idf, self.centroids, self.owner, self.floor))
        text = F.col(f"`{text_col}`").cast("string")
        rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.when(text.rlike(LETTER), text).cast("binary").alias("text"))

        def run(batches):
            langs, idf, centroids, owner, floor = sent.value
            for b in batches:
                texts = b.column(1).to_pylist()
                lang, score, far = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
                for at, part in _batches(texts) if langs else ():
                    close = vectors(part, idf).astype(np.float64) @ centroids.T
                    best = close.argmax(1)
                    for j, i in enumerate(at):
                        if part[j] is not None:
                            lang[i], score[i], far[i] = langs[owner[best[j]]], min(1.0, max(0.0, close[j, best[j]])), close[j, best[j]] < floor[best[j]]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(far)], ["doc_id", "lang_pred", "score", "rejected"])

        return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def _frequencies(rows: DataFrame) -> np.ndarray:
    """Inverse document frequencies over all training texts: one row per slot and task is gathered."""

    def run(batches):
        total, n = np.zeros(DIMS, np.int64), 0
        for b in batches:
            for _, part in _batches(b.column(0).to_pylist()):
                total += (counts(part) > 0).sum(0)
                n += len(part)
        slots = np.concatenate((np.flatnonzero(total), [-1]))
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(np.concatenate((total[total > 0], [n])))], ["slot", "n"])

    got = {r["slot"]: r["n"] for r in rows.mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()}
    n = got.pop(-1, 0)
    df = np.zeros(DIMS)
    df[list(got)] = list(got.values())
    return np.log((n + 1) / (df + 1)).astype(np.float32) + np.float32(1)


_SUMS = "c int, sum binary, n double, s double, q double"


def _add_up(parts: pa.Table) -> pa.Table:
    """One row from the tasks' sums of one centroid."""
    total = np.zeros(DIMS)
    for x in parts["sum"]:
        total += np.frombuffer(x.as_py(), np.float64)
    return pa.table({"c": parts["c"][:1], "sum": pa.array([total.tobytes()], pa.binary()), **{k: pa.array([float(np.sum(parts[k].to_numpy()))]) for k in ("n", "s", "q")}})


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE, k: int = CENTROIDS) -> Model:
    """Learn from all rows with a language and a letter; the centroids from ``sample`` rows a language."""
    rows = labelled.select(F.xxhash64(F.col(f"`{id_col}`").cast("string")).alias("o"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(LETTER))
    idf = _frequencies(rows.select(F.col("text").cast("binary")))
    # The sample's rows are chosen from narrow columns; then their texts are read.
    first = Window.partitionBy("lang").orderBy("o", "th")
    chosen = rows.select("o", "lang", F.xxhash64("text").alias("th")).distinct().withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= sample)
    chosen = materialize(chosen, "chosen")
    texts = rows.withColumn("th", F.xxhash64("text")).join(F.broadcast(chosen), ["o", "lang", "th"])
    texts = materialize(texts.dropDuplicates(["o", "lang", "th"]).select("lang", "rank", F.col("text").cast("binary").alias("text")), "sample")
    langs = sorted(r[0] for r in chosen.select("lang").distinct().collect())
    seeds = {(r["lang"], r["rank"] - 1): bytes(r["text"]) for r in texts.filter(F.col("rank") <= k).collect()}
    owner, start = [], []
    for i, lang in enumerate(langs):
        for c in range(k):
            if (lang, c) in seeds:
                owner.append(i)
                start.append(vectors([seeds[lang, c]], idf)[0])
    centroids, owner = np.array(start, np.float64).reshape(len(owner), DIMS), np.array(owner, np.int64)
    number = {lang: i for i, lang in enumerate(langs)}
    floor = np.zeros(len(owner))
    for _ in range(ROUNDS if langs else 0):
        sent = labelled.sparkSession.sparkContext.broadcast((centroids, owner, idf, number))

        def run(batches):
            centroids, owner, idf, number = sent.value
            sums, stats = np.zeros_like(centroids), np.zeros((len(owner), 3))
            for b in batches:
                own = np.array([number[x] for x in b.column(0).to_pylist()])
                for at, part in _batches(b.column(1).to_pylist()):
                    x = vectors(part, idf).astype(np.float64)
                    close = x @ centroids.T
                    close[own[at][:, None] != owner[None, :]] = -1
                    best = close.argmax(1)
                    near = close[np.arange(len(best)), best]
                    np.add.at(sums, best, x)
                    np.add.at(stats, best, np.column_stack((np.ones(len(best)), near, near * near)))
            met = np.flatnonzero(stats[:, 0])
            cols = [pa.array(met.astype(np.int32)), pa.array([sums[i].tobytes() for i in met], pa.binary()), *[pa.array(stats[met, i]) for i in range(3)]]
            yield pa.RecordBatch.from_arrays(cols, ["c", "sum", "n", "s", "q"])

        parts = texts.select("lang", "text").mapInArrow(run, _SUMS).groupBy("c").applyInArrow(_add_up, _SUMS).collect()  # a row per centroid
        sums, stats = np.zeros_like(centroids), np.zeros((len(owner), 3))
        for r in parts:
            sums[r["c"]] += np.frombuffer(r["sum"], np.float64)
            stats[r["c"]] += (r["n"], r["s"], r["q"])
        n = np.maximum(stats[:, 0], 1)
        mean = stats[:, 1] / n
        floor = mean - DEVIATIONS * np.sqrt(np.maximum(stats[:, 2] / n - mean**2, 0))
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(size > 0, sums / np.maximum(size, 1e-12), centroids)
    return Model(langs, idf, centroids, owner, floor)
