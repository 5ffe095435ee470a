"""Benchmark decontamination by template canonicalisation.

Benchmark items and documents are cut into windows of ``WINDOW`` words (an
item shorter than that is one window of its own length). Numbers and units
become typed placeholders in one template; a second template also replaces
names (capitalised words). A document window whose template hash joins a
benchmark window's is a hit if its slots agree: the same value in the item
stands for the same value in the document and different values for different
ones. So a question asked again with other numbers or names is caught, and an
unrelated text that shares only the shape is not. A template needs words
other than placeholders in at least half of its places. A third, literal variant
stands where the first template is dropped by that bound; it has no placeholders,
so that exact copies are always found. An item shorter than ``SHORTEST`` words has this variant alone: its few words
say too little once some are replaced, and it is found wherever they stand.

Whether slots agree depends on which of them are equal, not on their values, so
a window's key is its template with this pattern. Items that share a key form a
class, named by the smallest item id in it; a document's window meets one class
at most, so a template that many items and many documents have makes no pairs
of them. ``members`` lists the items of each class.

The windows of the benchmark are a stated set. A bitmap of their hashes, of
bounded size, is sent to the tasks, which emit the windows that pass; the hash
join decides.

Defined results: null or empty texts and items give no row; repeated rows
count once per document and class; a null doc_id stays null and rows with null
item_id are reported as such.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import materialize, quoted
from .common import id_of, key_of, keyed_text
from .passages import bitmap, passes
from .words import LOWER, U, Words, chunks, gram_hash, member, mix, words_of

WINDOW = 13
SHORTEST = 6  # words of the shortest template
LITERAL = 2  # the variant without placeholders
SCHEMA = "key long, h long, pattern binary, slots array<binary>, width int"

# Unit words.
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons pound pounds ounce ounces ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years dollar dollars euro euros cent cents usd eur percent degree degrees celsius fahrenheit volt volts watt watts newton newtons joule joules hz khz mhz ghz kb mb gb tb"

SEPARATORS = np.ones(256, bool)
SEPARATORS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
NUMBER, NAME, UNIT = mix(np.array([1, 2, 3], U))
_UNIT_HASHES = np.sort(words_of([UNITS.encode()], SEPARATORS, LOWER).hash())


def _templates(texts: list) -> tuple[Words, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The words with their case, the text of each word, and for both templates and the literal words (codes, is placeholder)."""
    raw = words_of(texts, SEPARATORS)
    low = words_of(texts, SEPARATORS, LOWER)
    text_of = np.repeat(np.arange(len(texts)), np.diff(raw.first))
    if not len(raw.starts):
        return raw, text_of, [(np.zeros(0, U), np.zeros(0, bool))] * 3
    h = low.hash()
    head, after = raw.data[raw.starts], raw.data[np.minimum(raw.starts + 1, len(raw.data) - 1)]
    number = (head >= 48) & (head <= 57)
    name = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (after >= 0x80) & (after <= 0x9E))
    unit = member(_UNIT_HASHES, h) & ~number
    plain = np.where(number, NUMBER, np.where(unit, UNIT, h))
    named = np.where(name & ~number & ~unit, NAME, plain)
    return raw, text_of, [(plain, number | unit), (named, number | unit | name), (h, np.zeros(len(h), bool))]


def _windows(texts: list, widths: list[int], whole: bool, sketch):
    """(text, hash, pattern, slots, width) of the windows. ``whole``: texts shorter than the largest width are one window.

    The pattern has, for each slot, the place of the first one of its value.
    """
    words, text_of, templates = _templates(texts)
    replaced = np.concatenate(([0], np.cumsum(templates[0][1])))
    for variant, (codes, slot) in enumerate(templates):
        filled = np.concatenate(([0], np.cumsum(slot)))
        for width in widths:
            if width < SHORTEST and variant != LITERAL:
                continue
            h = gram_hash(codes, width)
            if not len(h):
                continue
            h = mix(h + U(3 * width + variant + 1))
            ok = text_of[: len(h)] == text_of[width - 1 :]
            if variant != LITERAL:
                ok &= (filled[width:] - filled[:-width]) * 2 <= width
            elif width >= SHORTEST:
                ok &= (replaced[width:] - replaced[:-width]) * 2 > width
            if whole and width < WINDOW:
                size = np.diff(words.first)[text_of[: len(h)]]
                ok &= size == width
            if sketch is not None:
                ok &= passes(sketch, h)
            for i in np.flatnonzero(ok):
                values = [words.text(j).lower() for j in i + np.flatnonzero(slot[i : i + width])]
                yield int(text_of[i]), int(h[i].astype(np.int64)), bytes(values.index(v) for v in values), values, width


def _emit(rows: DataFrame, widths: list[int], whole: bool, sketch) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        for b in batches:
            for ids, texts in chunks(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = list(_windows(texts, widths, whole, sent.value))
                for i in range(0, len(found), 10_000):
                    part = found[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([ids[x[0]] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int64()), pa.array([x[2] for x in part], pa.binary()), pa.array([x[3] for x in part], pa.list_(pa.binary())), pa.array([x[4] for x in part], pa.int32())], ["key", "h", "pattern", "slots", "width"])

    return rows.mapInArrow(run, SCHEMA)


def _asked(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """The benchmark's windows, each with the smallest item of its class."""
    items = benchmark.select(key_of(item_col).alias("key"), F.col(quoted(item_text)).cast("binary").alias("text"))
    asked = materialize(_emit(items, list(range(1, WINDOW + 1)), True, None), "windows")
    return materialize(asked.join(asked.groupBy("h", "pattern").agg(F.min("key").alias("item")), ["h", "pattern"]), "asked")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, exact): one row for each document and class of items that share a window.

    ``item_id`` is the smallest item of the class; ``exact`` tells whether some
    window has all of an item's own values.
    """
    asked = _asked(benchmark, item_col, item_text)
    n = asked.select("h").distinct().count()
    widths = [r[0] for r in asked.select("width").distinct().collect()]  # short windows are asked for only by short items
    hits = _emit(keyed_text(docs, id_col, text_col), widths, False, bitmap(asked, n, 512))
    classes = asked.select("h", "pattern", "item").distinct()
    values = asked.select("h", "pattern", "slots").distinct().withColumn("same", F.lit(True))
    met = hits.join(classes, ["h", "pattern"]).join(values, ["h", "pattern", "slots"], "left")
    out = met.groupBy("key", "item").agg(F.count_distinct("h").alias("n_windows"), F.coalesce(F.max("same"), F.lit(False)).alias("exact"))
    return out.select(id_of().alias("doc_id"), id_of("item").alias("item_id"), "n_windows", "exact")


def members(benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, member_id): the items of each class that ``contaminated`` names by ``item_id``."""
    rows = _asked(benchmark, item_col, item_text).select("item", "key").distinct()
    return rows.select(id_of("item").alias("item_id"), id_of().alias("member_id"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that share no window with the benchmark. Repeated ids stay or go together."""
    hit = materialize(contaminated(docs, benchmark).select("doc_id").distinct(), "hits")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(hit, F.col("id").eqNullSafe(F.col("doc_id")), "left_anti").select("row.*")
