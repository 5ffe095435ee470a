"""Toxicity: boosted trees over dense features of the whole text, with isotonic calibration.

The labelled sample (at most ``SAMPLE`` rows, by hash of the id, equal texts
once) is cut into three folds by a hash of the id. The first gives the lexicon:
hashed words and word beginnings that stand in toxic documents significantly
more often. The second fits the trees on the features below, the third the
isotonic curve from the trees' margin to a probability. So no part is fitted
on rows that an earlier part has seen. Scores use the text alone.

Features: length; density, sum and maximum weight of lexicon words and of
lexicon beginnings; hits next to a word of the second person; hits after
letter look-alikes are undone; capitals; words all in capitals; exclamation
and question marks; runs of punctuation; number of hits.

Defined results: null and empty texts have all features zero and get a score
like any other; without labels of both classes the score is the share of
label 1 (0 without labels); rows with null labels are not used; repeated rows
and extra columns change nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.sinks import materialize
from .words import LOWER, SPACE, U, chunks, member, mix, words_of

SAMPLE = 40_000  # bound of the labelled rows that are fitted on
LEXICON = 4_000  # bound of the lexicon's entries, the most significant first
SIGNIFICANCE = 24.0  # least G2 of an entry
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.3
NAMES = ("t_len", "t_word_rate", "t_word_max", "t_word_sum", "t_begin_rate", "t_begin_max", "t_second", "t_masked_rate", "t_masked_max", "t_caps", "t_shout", "t_marks", "t_runs", "t_hits")

# Words of the second person in the languages of the corpus.
SECOND_PERSON = "you your yours yourself ur u du dich dir dein deine deiner ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros su"
# Letter look-alikes.
MASKS = {b"0": b"o", b"1": b"i", b"3": b"e", b"4": b"a", b"5": b"s", b"7": b"t", b"8": b"b", b"@": b"a", b"$": b"s", b"!": b"i", b"|": b"l"}

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_NOT_LETTER = ~_LETTER
_MASK = np.zeros(256, bool)
_MASK[[k[0] for k in MASKS] + [ord(c) for c in "*.-_"]] = True
_UNMASK = bytes.maketrans(b"".join(MASKS), b"".join(MASKS.values()))
_SECOND = np.sort(words_of([SECOND_PERSON.encode()], _NOT_LETTER, LOWER).hash())


def _terms(words) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The words' hashes, and for each length of beginnings (positions of longer words, hashes)."""
    size = words.ends - words.starts
    begins = []
    for n in BEGINNINGS:
        at = np.flatnonzero(size > n)
        begins.append((at, mix(words.hash(words.starts[at], words.starts[at] + n) + U(n))))
    return words.hash(), begins


def _maximum(size: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros(size)
    np.maximum.at(out, at, values)
    return out


def features(texts: list[bytes | None], keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """One row of ``NAMES`` per text. The lexicon: sorted hashes and their weights."""
    k = len(texts)
    words = words_of(texts, _NOT_LETTER, LOWER)
    doc = np.repeat(np.arange(k), np.diff(words.first))
    n = np.diff(words.first)
    h, begins = _terms(words)
    weigh = lambda hs: weights[np.searchsorted(keys, hs)]
    hit = member(keys, h)
    w_at, w = np.flatnonzero(hit), weigh(h[hit])
    b_at, b = [], []
    for at, hs in begins:
        found = member(keys, hs)
        b_at.append(at[found])
        b.append(weigh(hs[found]))
    b_at, b = np.concatenate(b_at), np.concatenate(b)
    second = np.concatenate(([0], np.cumsum(member(_SECOND, h))))
    near = np.unique(np.concatenate((w_at, b_at)))
    lo = np.maximum(near - 5, words.first[:-1][doc[near]])
    hi = np.minimum(near + 6, words.first[1:][doc[near]])
    close = second[hi] > second[lo]

    # The original bytes: marks and capitals, and tokens with look-alikes.
    raw = words_of(texts, SPACE)
    data = raw.data
    owner = np.repeat(np.arange(k), np.diff(raw.first))
    length = np.fromiter((len(t or b"") + 1 for t in texts), np.int64, k)
    cut = np.concatenate(([0], np.cumsum(length)))
    count = lambda flag: np.diff(np.concatenate(([0], np.cumsum(flag)))[cut])
    upper = (data >= 65) & (data <= 90)
    letter = _LETTER[data]
    mark = (data == 33) | (data == 63)
    other = _NOT_LETTER[data] & ~SPACE[data] & ~((data >= 48) & (data <= 57))
    runs = other[1:] & other[:-1]
    sums = lambda flag: np.concatenate(([0], np.cumsum(flag)))
    span = raw.ends - raw.starts
    in_word = lambda flag: sums(flag)[raw.ends] - sums(flag)[raw.starts]
    letters = in_word(letter)
    shout = (letters >= 3) & (in_word(upper) == letters)
    odd = np.flatnonzero((letters >= 2) & (span <= 40) & (in_word(_MASK[data]) > 0))
    m_doc, m_w = [], []
    if len(keys) and len(odd):
        plain = [raw.text(i) for i in odd]
        shapes = [p.strip(b".-_!?,;:").translate(_UNMASK) for p in plain]
        dropped = [p.strip(b".-_!?,;:").translate(_UNMASK, b"*.-_") for p in plain]
        for forms in (shapes, dropped):
            # Only tokens that the look-alikes changed; ordinary words were counted above.
            alive = [j for j, (f, p) in enumerate(zip(forms, plain, strict=True)) if f.isalpha() and f.lower() != p.strip(b".-_!?,;:").lower()]
            fw = words_of([forms[j] for j in alive], _NOT_LETTER, LOWER)
            if not len(fw.starts):
                continue
            src = np.array(alive)[np.repeat(np.arange(len(alive)), np.diff(fw.first))]
            fh, fb = _terms(fw)
            for at, hs in ((np.arange(len(fh)), fh), *fb):
                found = member(keys, hs)
                m_doc.append(owner[odd[src[at[found]]]])
                m_w.append(weigh(hs[found]))
    m_doc = np.concatenate(m_doc) if m_doc else np.zeros(0, np.int64)
    m_w = np.concatenate(m_w) if m_w else np.zeros(0)

    per = np.maximum(n, 1)
    some = lambda at, weight=None: np.bincount(at, weight, minlength=k)[:k]
    hits = some(doc[w_at])
    cols = [
        np.log1p(n), hits / per, _maximum(k, doc[w_at], w), np.log1p(some(doc[w_at], w)),
        some(doc[b_at]) / per, _maximum(k, doc[b_at], b), some(doc[near], close.astype(float)) / np.maximum(some(doc[near]), 1),
        some(m_doc) / per, _maximum(k, m_doc, m_w), count(upper) / np.maximum(count(letter), 1),
        some(owner, shout.astype(float)) / per, count(mark) / per, count(np.concatenate((runs, [False]))) / per, np.log1p(some(doc[near])),
    ]
    return np.column_stack(cols)


def _learn_lexicon(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and weights (log odds) of the terms that mark label 1, from ``sample(text, label)``."""

    def run(batches):
        for b in batches:
            labels = np.array(b.column(1).to_pylist(), np.int64)
            for ids, texts in chunks(range(b.num_rows), b.column(0).to_pylist()):
                words = words_of(texts, _NOT_LETTER, LOWER)
                doc = np.repeat(np.arange(len(texts)), np.diff(words.first))
                h, begins = _terms(words)
                term = np.concatenate([h, *[x[1] for x in begins]])
                of = np.concatenate([doc, *[doc[x[0]] for x in begins]])
                o = np.lexsort((of, term))
                term, of = term[o], of[o]
                new = np.ones(len(o), bool)
                new[1:] = (term[1:] != term[:-1]) | (of[1:] != of[:-1])  # each term once a text
                term, of = term[new], of[new]
                positive = labels[np.array(ids)][of]
                terms, at = np.unique(term, return_inverse=True)
                pos = np.bincount(at, positive, minlength=len(terms)).astype(np.int64)
                both = np.bincount(at, minlength=len(terms))
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(pos), pa.array(both - pos)], ["h", "pos", "neg"])

    n1, n0 = (int(x or 0) for x in sample.agg(F.sum("label"), F.sum(1 - F.col("label"))).first())
    if not n1 or not n0:
        return np.zeros(0, U), np.zeros(0)
    counts = sample.select("text", "label").mapInArrow(run, "h long, pos long, neg long").groupBy("h").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    base, part = n1 / (n1 + n0), F.col("pos") / (F.col("pos") + F.col("neg"))
    xlogy = lambda x, y: F.when(x > 0, x * F.log(y)).otherwise(0.0)
    g2 = 2 * (xlogy(F.col("pos"), part / base) + xlogy(F.col("neg"), (1 - part) / (1 - base)))
    weight = F.log((F.col("pos") + 0.5) / (n1 + 1)) - F.log((F.col("neg") + 0.5) / (n0 + 1))
    best = counts.filter(part > base).select("h", g2.alias("g2"), weight.alias("w")).filter(F.col("g2") >= SIGNIFICANCE)
    rows = best.orderBy(F.desc("g2"), "h").limit(LEXICON).collect()
    keys = np.array([r["h"] for r in rows], np.int64).view(U)
    order = np.argsort(keys)
    return keys[order], np.array([r["w"] for r in rows], float)[order]


def _with_features(df: DataFrame, text_col: str, keys: np.ndarray, weights: np.ndarray) -> DataFrame:
    """Adds the columns ``NAMES`` (of the binary column ``text_col``), then drops ``text_col``."""
    sent = df.sparkSession.sparkContext.broadcast((keys, weights))
    names = [c for c in df.columns if c != text_col]
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(n, T.DoubleType()) for n in NAMES])

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            parts = [features(t, *sent.value) for _, t in chunks(range(len(texts)), texts)]
            x = np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))
            cols = [b.column(b.schema.get_field_index(c)) for c in names] + [pa.array(x[:, i]) for i in range(len(NAMES))]
            yield pa.RecordBatch.from_arrays(cols, [*names, *NAMES])

    return df.mapInArrow(run, schema)


class Model:
    """A fitted scorer. ``trees`` or ``curve`` may be None; then ``base`` or the trees' own probability is the score."""

    def __init__(self, keys, weights, trees, curve, base):
        self.keys, self.weights, self.trees, self.curve, self.base = keys, weights, trees, curve, base

    def score(self, df: DataFrame, text_col: str = "text", keep: str = "row") -> DataFrame:
        """(keep, score) for each row of ``df``; ``keep`` is one column, which may be a struct of all."""
        df = df.select(F.col(keep), F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("t_text"))
        if self.trees is None:
            return df.select(keep, F.lit(self.base).alias("score"))
        df = _assembled(_with_features(df, "t_text", self.keys, self.weights), [keep])
        df = _margin(self.trees.transform(df), [keep])
        if self.curve is None:
            return df.select(keep, (1 / (1 + F.exp(-2 * F.col("margin")))).alias("score"))
        return self.curve.transform(df).select(keep, F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score")).alias("score"))


def _assembled(df: DataFrame, keep: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(NAMES), outputCol="t_features").transform(df).select(*keep, "t_features")


def _margin(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, (vector_to_array("rawPrediction")[1]).alias("margin"))


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", trees: int = 20, depth: int = 4, seed: int = 7) -> Model:
    """Fit on ``labelled`` rows, a bounded sample (see ``bounded_labels``)."""
    rows = labelled.select(F.xxhash64(F.col(f"`{id_col}`"), F.lit(seed)).alias("o"), F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")).alias("text"), F.col(f"`{label_col}`").cast("int").alias("label"))
    rows = rows.filter("label in (0, 1)").withColumn("th", F.xxhash64("text")).groupBy("th").agg(F.min_by(F.struct("o", "text", "label"), "o").alias("x")).select("x.*")
    rows = materialize(rows.withColumn("fold", F.pmod("o", F.lit(10))), "labelled")
    base = float(rows.agg(F.avg("label")).first()[0] or 0.0)
    keys, weights = _learn_lexicon(rows.filter("fold < 5"))
    dense = _assembled(_with_features(rows.filter("fold >= 5"), "text", keys, weights), ["label", "fold"])
    dense = materialize(dense, "dense").withColumn("label", F.col("label").cast("double"))
    on, tune = dense.filter("fold < 8"), dense.filter("fold >= 8")
    if on.select("label").distinct().count() < 2:
        return Model(keys, weights, None, None, base)
    gbt = GBTClassifier(featuresCol="t_features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed, maxBins=64)
    fitted = gbt.fit(on.coalesce(8))
    if tune.select("label").distinct().count() < 2:
        return Model(keys, weights, fitted, None, base)
    curve = IsotonicRegression(featuresCol="margin", labelCol="label", predictionCol="score").fit(_margin(fitted.transform(tune), ["label"]))
    return Model(keys, weights, fitted, curve, base)


def bounded_labels(labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", label_col: str = "toxic", seed: int = 7) -> DataFrame:
    """At most ``sample`` labelled ids, those with the smallest hash; small enough to broadcast by construction.

    An id with both labels says nothing and is left out; null ids and labels are, too.
    """
    some = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias(label_col), F.max(label_col).alias("most"))
    some = some.filter(F.col(label_col) == F.col("most")).select(id_col, label_col)
    return some.orderBy(F.xxhash64(id_col, F.lit(seed)), id_col).limit(sample)
