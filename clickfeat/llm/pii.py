"""Personal data: base patterns and bootstrapped contextual extraction, in Spark SQL functions alone.

Base spans come from one regular expression per kind, each written so that it
takes linear time (possessive quantifiers, and matches that start only where
a run starts). Positions follow from the lengths of the pieces between the
matches.

Bootstrapping: every base span is a seed entity. The words before an entity
(one word, and two) are lexical patterns. Pattern and instance form a graph;
in each round

* a pattern's confidence for a kind is the share of all occurrences of its
  words in the corpus that are followed by a known instance of the kind, if at
  least ``MIN_SUPPORT`` distinct known instances have it;
* an identifier-like token (with a digit or ``@``) that follows patterns of high
  confidence becomes an instance with the score 1 - product(1 - confidence),
  and is accepted from ``MIN_SCORE`` on; all of its occurrences are then found.

Rounds end when nothing new is accepted; ``ROUNDS`` is a bound against endless
runs, beyond which the job fails.

Defined results: null text is empty text; a null id stays null; repeated rows
are reported as often as they occur; a document is told from another of the
same id by a hash of its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import materialize, quoted
from .common import id_of, key_of

KINDS = ("email", "ip", "card", "phone")
MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.8
MIN_SCORE = 0.8
ROUNDS = 500
SMALL_PATTERNS = 200_000  # rows of a pattern table that may be broadcast

_SP = r"\x20\x09-\x0D"
_REGEX = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "token": rf"(?<![^{_SP}])[^{_SP}0-9@]*+[0-9@][^{_SP}]*+",
}
_NEEDS = {"email": "contains(t, '@')", "phone": "contains(t, '+')"}
_SPAN = "struct<s:int,e:int,v:string,l:string>"
_DIGITS = "regexp_replace(x.v, '[^0-9]', '')"
_LUHN = f"""aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + case
    when i % 2 = 1 then int(substring({_DIGITS}, -i, 1))
    when int(substring({_DIGITS}, -i, 1)) > 4 then int(substring({_DIGITS}, -i, 1)) * 2 - 9
    else int(substring({_DIGITS}, -i, 1)) * 2 end) % 10 = 0"""
_VALID = {
    "ip": "forall(split(x.v, '[.]'), p -> length(regexp_replace(p, '^0+', '')) <= 3 and coalesce(try_cast(right(p, 3) as int), 0) <= 255)",
    "card": f"case when length({_DIGITS}) between 12 and 19 then {_LUHN} else false end",
    "phone": f"length({_DIGITS}) between 9 and 15",
}


def _literal(regex: str) -> str:
    return "'" + regex.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _spans(kind: str) -> str:
    """SQL for the spans of a kind, from its matches ``m_kind`` in the text ``t``."""
    none = f"cast(array() as array<{_SPAN}>)"
    pieces = f"split(t, {_literal(_REGEX[kind])}, -1)"
    rows = f"zip_with(m_{kind}, slice({pieces}, 1, size(m_{kind})), (m, p) -> named_struct('m', m, 'g', length(p), 'l', right(p, 64)))"
    size = "aggregate({}, 0, (a, y) -> a + y.g + length(y.m))".format
    span = "named_struct('s', st, 'e', st + length(x.m), 'v', x.m, 'l', x.l)"
    in_block = f"transform(k, (x, i) -> {_let(f'w + {size('slice(k, 1, i)')} + x.g', 'st', span)})"
    each = f"flatten(transform(bl, (k, b) -> {_let('aggregate(slice(bs, 1, b), 0, (a, y) -> a + y)', 'w', in_block)}))"
    # Running sums over blocks of 128 matches, so that a text with very many matches takes no quadratic time.
    blocks = "transform(sequence(0, (size(r) - 1) div 128), b -> slice(r, b * 128 + 1, 128))"
    summed = _let(f"transform(bl, k -> {size('k')})", "bs", each)
    spans = f"if(size(m_{kind}) = 0, {none}, {_let(rows, 'r', _let(blocks, 'bl', summed))})"
    if kind == "token":
        return _with_words(spans)
    return f"filter({spans}, x -> {_VALID[kind]})" if kind in _VALID else spans


def _with_words(spans: str) -> str:
    """SQL for tokens with the one or two words before them as ``l``: each token is a word of the text with a digit or ``@``."""
    words = f"filter(split(t, '[{_SP}]+'), x -> x <> '')".replace("\\", "\\\\")
    places = "filter(transform(w, (x, i) -> if(x rlike '[0-9@]', i, -1)), i -> i >= 0)"
    left = "concat(coalesce(concat(get(w, i - 2), ' '), ''), coalesce(concat(get(w, i - 1), ' '), ''))"
    each = f"zip_with({spans}, {places}, (x, i) -> named_struct('s', x.s, 'e', x.e, 'v', x.v, 'l', {left}))"
    return f"if(size(m_token) = 0, cast(array() as array<{_SPAN}>), {_let(words, 'w', each)})"


def find_spans(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = (), tokens: bool = True) -> DataFrame:
    """(key, th, one array of spans per kind, tokens): every row's base spans and identifier-like tokens."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    df = docs.select(*[F.col(f"`{c}`") for c in keep], key_of(id_col).alias("key"), text.alias("t"))
    kinds = [*KINDS, *(["token"] if tokens else [])]
    found = {k: f"regexp_extract_all(t, {_literal(_REGEX[k])}, 0)" for k in kinds}
    found = {k: f"case when {_NEEDS[k]} then {v} else cast(array() as array<string>) end" if k in _NEEDS else v for k, v in found.items()}
    df = df.select("*", F.xxhash64("t").alias("th"), *[F.expr(v).alias(f"m_{k}") for k, v in found.items()])
    return df.select(*keep, "key", "th", "t", *[F.expr(_spans(k)).alias(k) for k in kinds])


def _base(df: DataFrame) -> DataFrame:
    """Adds ``base``: the spans of all kinds, by start and then kind."""
    each = [f"transform({k}, x -> named_struct('s', x.s, 'k', {i}, 'e', x.e, 'v', x.v))" for i, k in enumerate(KINDS)]
    return df.withColumn("base", F.expr(f"array_sort(concat({', '.join(each)}))"))


def _tokens(rows: DataFrame) -> DataFrame:
    """Identifier-like tokens: (key, th, s, e, v, kind, pattern). kind: that of the base span that starts in it, else null.

    Tokens inside a base span that starts before them are left out.
    """
    t = rows.filter("size(token) > 0").select("key", "th", "base", F.explode("token").alias("x"))
    t = t.withColumn("own", F.expr("filter(base, b -> b.s >= x.s and b.s < x.e)"))
    t = t.filter("not exists(base, b -> b.s < x.s and b.e > x.s)")
    plain = F.expr("regexp_replace(x.v, '[.,;:!?)\"\\']+$', '')")
    left = F.lower("x.l")
    t = t.select(
        "key", "th", F.col("x.s").alias("s"),
        F.when(F.size("own") > 0, F.expr("own[0].k")).alias("kind"),
        F.when(F.size("own") > 0, F.expr("own[0].v")).otherwise(plain).alias("v"),
        F.regexp_extract(left, rf"([^{_SP}]++)[{_SP}]++$", 1).alias("l1"),
        F.regexp_extract(left, rf"(?:^|[{_SP}])([^{_SP}]++[{_SP}]++[^{_SP}]++)[{_SP}]++$", 1).alias("l2"),
    )
    t = t.filter("length(v) > 0").withColumn("l2", F.regexp_replace("l2", rf"[{_SP}]+", " "))
    return t.select("key", "th", "s", (F.col("s") + F.length("v")).alias("e"), "v", "kind", F.explode(F.array_distinct(F.array("l1", "l2"))).alias("pattern"))


def _totals(docs: DataFrame, text_col: str, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often the words of each pattern occur in all texts."""
    words = F.split(F.trim(F.lower(F.col(f"`{text_col}`").cast("string"))), rf"[{_SP}]+")
    seen = docs.select(words.alias("w")).select(F.explode(F.expr("concat(w, zip_with(w, slice(w, 2, size(w)), (a, b) -> concat(a, ' ', b)))")).alias("pattern"))
    if patterns.count() <= SMALL_PATTERNS:
        patterns = F.broadcast(patterns)
    return seen.join(patterns, "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("total"))


def discover(docs: DataFrame, rows: DataFrame, text_col: str = "text", min_support: int = MIN_SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """(key, th, extra): the spans that bootstrapping adds to the base spans in ``rows``."""
    spark = docs.sparkSession
    tokens = materialize(_tokens(rows), "tokens")
    edges = tokens.filter("pattern <> ''").groupBy("kind", "v", "pattern").agg(F.count("*").alias("n"))
    edges = materialize(edges, "graph")
    common = edges.groupBy("pattern").agg(F.count_distinct("v").alias("d")).filter(F.col("d") >= min_support).select("pattern")
    totals = materialize(_totals(docs, text_col, materialize(common, "patterns")), "totals")
    edges = materialize(edges.join(totals, "pattern", "left_semi"), "graph")
    shaped = "length(v) >= 6 and (contains(v, '@') or length(regexp_replace(v, '[^0-9]', '')) >= 4)"
    unknown = edges.filter(f"kind is null and {shaped}").select("v", "pattern", "n")
    known = edges.filter("kind is not null")
    accepted = spark.createDataFrame([], "kind int, v string")
    for _ in range(rounds):
        now = known.select("kind", "v", "pattern", "n").union(accepted.join(unknown, "v").select("kind", "v", "pattern", "n"))
        scored = now.groupBy("kind", "pattern").agg(F.sum("n").alias("n"), F.count_distinct("v").alias("d"))
        scored = scored.filter(F.col("d") >= min_support).join(totals, "pattern")
        scored = scored.withColumn("conf", F.least(F.lit(1.0), F.col("n") / F.col("total"))).filter(F.col("conf") >= MIN_CONFIDENCE)
        found = unknown.join(scored.select("kind", "pattern", "conf"), "pattern").groupBy("v", "kind")
        found = found.agg((1 - F.product(1 - F.least("conf", F.lit(0.999)))).alias("score")).filter(F.col("score") >= MIN_SCORE)
        best = found.groupBy("v").agg(F.max(F.struct("score", -F.col("kind"))).alias("b"))
        fresh = best.select((-F.col("b.col2")).cast("int").alias("kind"), "v")
        fresh = materialize(fresh.join(accepted, "v", "left_anti").select("kind", "v"), "accepted")
        if fresh.isEmpty():
            break
        accepted = materialize(accepted.union(fresh), "accepted")
    else:
        raise RuntimeError(f"instances were still found after {rounds} rounds")
    spans = tokens.filter("kind is null").drop("kind", "pattern").distinct().join(accepted, "v")
    spans = spans.groupBy("key", "th").agg(F.collect_list(F.struct("s", F.col("kind").alias("k"), "e", "v")).alias("extra"))
    return materialize(spans, "extra")


_NAME = "element_at(array('email', 'ip', 'card', 'phone'), x.k + 1)"


def _listed(spans: str) -> str:
    return f"concat_ws(',', transform({spans}, x -> concat_ws(':', {_NAME}, x.s, x.e)))"


def _with_extra(rows: DataFrame, extra: DataFrame) -> DataFrame:
    """Adds ``spans``: base and discovered ones, by start and then kind."""
    joined = rows.join(extra, ["key", "th"], "left")
    return joined.withColumn("spans", F.expr("array_sort(array_distinct(concat(base, coalesce(extra, slice(base, 1, 0)))))"))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (base and discovered spans as kind:start:end)."""
    rows = materialize(_base(find_spans(docs, id_col, text_col)).select("key", "th", "base", "token"), "spans")
    out = _with_extra(rows.drop("token"), discover(docs, rows, text_col))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select(id_of().alias("doc_id"), *counts, F.sha2(F.expr(_listed("base")), 256).alias("base_sha256"), F.expr(_listed("spans")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows and columns, with every span replaced by its kind, as ``<EMAIL>``."""
    rows = materialize(_base(find_spans(docs, id_col, text_col)).select("key", "th", "base", "token"), "spans")
    extra = discover(docs, rows, text_col)
    packed = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    found = _base(find_spans(packed, id_col, text_col, keep=("row",), tokens=False)).select("row", "key", "th", "t", "base")
    found = _with_extra(found, extra)
    step = f"case when x.s >= a.pos then named_struct('pos', x.e, 'out', concat(a.out, substring(t, a.pos + 1, x.s - a.pos), '<', upper({_NAME}), '>')) else named_struct('pos', greatest(a.pos, x.e), 'out', a.out) end"
    clean = F.expr(f"if(size(spans) = 0, t, aggregate(spans, named_struct('pos', 0, 'out', ''), (a, x) -> {step}, a -> concat(a.out, substring(t, a.pos + 1))))")
    clean = F.when(F.col(f"row.{quoted(text_col)}").isNotNull(), clean)
    return found.select(*[clean.alias(c) if c == text_col else F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns])
