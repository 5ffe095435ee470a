"""Registered queries: one per operator of the inventory, over the given tables.

Every query reads ``events`` through the ``clicks`` view (the click log of
the tests) and runs over the whole table. Each has an oracle in DuckDB SQL
unless its result is not expressible there (hashing, model training).
Floating aggregates are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordered as W
from ..operators.aggregates import Agg
from ..sources.clicks import CLICKS_DUCKDB, clicks
from . import oracle as O
from .specs import CumCount, Gap, InTestHH, NextClick, Shift, build_features

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

ROUND = 6
FORCED_SPLIT = W.SkewSplit(heavy_rows=400)  # cuts every key above 400 rows at sf0.01


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def _round_features(df: DataFrame, specs: Sequence, cols: Sequence[str]) -> DataFrame:
    rounded = {s.name for s in specs if isinstance(s, Agg) and s.kind in O.ROUNDED_KINDS}
    return df.select(*[F.round(F.col(c), ROUND).alias(c) if c in rounded else F.col(c) for c in cols])


def feature_query(name: str, specs: Sequence, skew: W.SkewSplit = W.SkewSplit(), lead=("click_id",)):
    """Register clicks -> features(specs) -> (click_id, features...)."""
    cols = O.output_columns(specs, lead)
    sql = O.features_sql(f"WITH_{name}", specs, cols)
    sql = sql.replace(f"WITH_{name}", CLICKS_DUCKDB.strip() + ",\nbase AS (SELECT * FROM clicks)", 1)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = build_features(clicks(spark, sf_dir), specs, skew=skew)
        return _round_features(df, specs, cols)

    register(name, sql)(run)
    return run


# --- J1 + P2 + W1 + A1: the flagship slice ---------------------------------
FLAGSHIP = [
    Gap(("ip", "os", "device")),
    Agg("count", ("ip", "app")),
    Agg("nunique", ("ip",), "channel"),
]
feature_query("j1_flagship_features", FLAGSHIP, lead=("click_id", "hour"))

# --- aggregates joined back (A1-A6, J1) --------------------------------------
feature_query("a1_group_count", [Agg("count", ("ip", "day", "hour")), Agg("count", ("ip", "app")), Agg("count", ("ip", "app", "os"))])
feature_query(
    "a2_group_nonnull",
    [
        Agg("nonnull", ("ip", "day", "hour"), "channel", "ip_tcount"),
        Agg("nonnull", ("ip", "app"), "channel", "ip_app_count"),
        Agg("nonnull", ("ip", "app", "os"), "channel", "ip_app_os_count"),
        Agg("nonnull", ("app",), "channel", "app_count"),
        Agg("nonnull", ("os", "app"), "channel", "os_app_count"),
    ],
)
feature_query(
    "a3_group_nunique",
    [
        Agg("nunique", ("ip",), "channel"),
        Agg("nunique", ("ip", "device", "os"), "app"),
        Agg("nunique", ("ip", "day"), "hour"),
        Agg("nunique", ("app",), "channel"),
        Agg("nunique", ("wday", "hour"), "app", "wday_hour_unique_app"),
        Agg("nunique", ("os", "device", "app", "channel"), "hour"),
    ],
)
feature_query(
    "a4_group_mean",
    [Agg("mean", ("ip", "app", "channel"), "hour"), Agg("mean", ("os", "device", "app", "channel"), "hour"), Agg("mean", ("ip", "app"), "hour")],
)
feature_query(
    "a5_group_var",
    [Agg("var", ("ip", "day", "channel"), "hour"), Agg("var", ("ip", "app", "os"), "hour"), Agg("var", ("ip", "app", "channel"), "day")],
)
feature_query("a6_group_skew", [Agg("skew", ("ip", "app"), "hour"), Agg("skew", ("ip",), "hour"), Agg("skew", ("app", "device"), "os")])

# --- ordered features (W1-W5), plain and with hot keys split ----------------
W1 = [
    Gap(("ip", "app", "device", "os", "channel")),
    Gap(("ip", "os", "device")),
    Gap(("ip", "os", "device", "app")),
    Gap(("device",)),
    Gap(("device", "channel")),
    Gap(("app", "device", "channel")),
    Gap(("device", "hour")),
]
W2 = [Gap(("ip", "channel"), direction="prev"), Gap(("ip", "os"), direction="prev"), Gap(("device",), direction="prev")]
W3 = [CumCount(("ip",), "os"), CumCount(("ip", "device", "os"), "app"), CumCount(("device",), "app")]
W4 = [NextClick(("ip", "app", "device", "os"), "nextClick")]
W5 = [NextClick(("ip", "app", "device", "os"), "nextClick"), Shift("nextClick", "nextClick_shift")]
feature_query("w1_next_click", W1)
feature_query("w2_prev_click", W2)
feature_query("w3_cumcount", W3)
feature_query("w4_next_click_sentinel", W4)
feature_query("w5_global_shift", W5)
feature_query("w1_next_click_split", W1, skew=FORCED_SPLIT)
feature_query("w2_prev_click_split", W2, skew=FORCED_SPLIT)
feature_query("w3_cumcount_split", W3, skew=FORCED_SPLIT)
feature_query("w5_global_shift_split", W5, skew=FORCED_SPLIT)

# --- P4 as a feature ----------------------------------------------------------
feature_query("p4_in_test_hh", [InTestHH("in_test_hh"), Agg("nunique", ("ip", "wday"), "in_test_hh", "ip_wday_unique_in_test_hh")])


# --- projections (P2, P3, P5, P6) ---------------------------------------------
def _with_clicks(sql: str) -> str:
    return "WITH " + CLICKS_DUCKDB.strip() + ",\n" + sql


@register(
    "p2_p5_time_parts",
    _with_clicks(
        "t AS (SELECT 1 AS one)\n"
        "SELECT click_id, CAST(hour(click_time) AS INT) AS hour, CAST(day(click_time) AS INT) AS day,"
        " CAST(isodow(click_time) - 1 AS INT) AS wday, epoch_us(click_time) // 1000000 AS epoch_s FROM clicks"
    ),
)
def q_time_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import timeparts as P

    return clicks(spark, sf_dir).select(
        "click_id",
        P.hour("click_time").alias("hour"),
        P.day("click_time").alias("day"),
        P.wday("click_time").alias("wday"),
        P.epoch_seconds("click_time").alias("epoch_s"),
    )


_BUCKET_SQL = "(CAST('0x' || substr(md5(concat_ws('_', ip, app, device, os)), 1, 15) AS BIGINT) % 67108864)"


@register("p6_composite_key_bucket", _with_clicks(f"x AS (SELECT 1)\nSELECT click_id, {_BUCKET_SQL} AS category FROM clicks"))
def q_key_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.keys import composite_key_bucket

    return clicks(spark, sf_dir).select("click_id", composite_key_bucket(["ip", "app", "device", "os"]).alias("category"))


_SECONDS = "(epoch_us(click_time) // 1000000)"


def _hashed_sql(buckets: int) -> str:
    return _with_clicks(
        f"b AS (SELECT *, {_BUCKET_SQL} % {buckets} AS h FROM clicks)\n"
        f"SELECT click_id, CAST(COALESCE(lead({_SECONDS}) OVER (PARTITION BY h ORDER BY click_time, row_id), {W.NEXT_CLICK_SENTINEL}) - {_SECONDS} AS BIGINT) AS nextClick FROM b"
    )


@register("w4_next_click_hashed_key", _hashed_sql(2**26))
def q_next_click_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4 over the hashed composite key."""
    return build_features(clicks(spark, sf_dir), [NextClick(("ip", "app", "device", "os"), "nextClick", 2**26)]).select("click_id", "nextClick")


@register("w4_next_click_hashed_collisions", _hashed_sql(2**6))
def q_next_click_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As above with so few slots that most keys share one."""
    return build_features(clicks(spark, sf_dir), [NextClick(("ip", "app", "device", "os"), "nextClick", 2**6)]).select("click_id", "nextClick")


# --- ordered features where times tie and keys are NULL ------------------------
_TIED_BASE = (
    "base AS (SELECT * REPLACE (date_trunc('day', click_time) AS click_time, CASE WHEN row_id % 5 <> 0 THEN ip END AS ip,"
    " CASE WHEN row_id % 7 <> 3 THEN device END AS device) FROM clicks)"
)


def _tied_sql() -> str:
    cols, null = [], "CASE WHEN {ok} THEN {x} END AS {name}"
    for keys, kind, name in _TIED:
        w = f"PARTITION BY {', '.join(keys)} ORDER BY click_time, row_id"
        x = {
            "next": f"CAST(((epoch_us(lead(click_time) OVER ({w})) - epoch_us(click_time)) // 1000000) % 86400 AS FLOAT)",
            "prev": f"CAST(((epoch_us(click_time) - epoch_us(lag(click_time) OVER ({w}))) // 1000000) % 86400 AS FLOAT)",
            "place": f"CAST(row_number() OVER ({w}) - 1 AS DOUBLE)",
            "after": f"CAST(lead(row_id) OVER ({w}) AS DOUBLE)",
        }[kind]
        cols.append(null.format(ok=" AND ".join(f"{k} IS NOT NULL" for k in keys), x=x, name=name))
    return _with_clicks(f"{_TIED_BASE}\nSELECT click_id, {', '.join(cols)} FROM base")


_TIED = [
    (("ip",), "next", "ip_next"), (("device",), "prev", "device_prev"), (("device",), "place", "device_place"),
    (("ip", "device"), "place", "ip_device_place"), (("device",), "after", "device_after"), (("ip", "os"), "next", "ip_os_next"),
]


def _tied(spark: SparkSession, sf_dir: str, skew: W.SkewSplit) -> DataFrame:
    df = clicks(spark, sf_dir).withColumns({
        "click_time": F.date_trunc("day", F.col("click_time")).cast("timestamp_ntz"),
        "ip": F.when(F.col("row_id") % 5 != 0, F.col("ip")),
        "device": F.when(F.col("row_id") % 7 != 3, F.col("device")),
    })
    hot = W.find_hot(df, sorted({tuple(sorted(keys)) for keys, *_ in _TIED}), skew=skew)
    out = df
    for keys, kind, name in _TIED:
        req = W.Req({"next": "lead", "prev": "lag", "place": "rownum", "after": "lead"}[kind], name, "row_id" if kind == "after" else None)
        out = W.ordered_family(out, keys, [(keys, [req])], skew=skew, hot=hot, source=df)
        t = W.epoch_micros("click_time")
        gap = {"next": F.col(name) - t, "prev": t - F.col(name)}.get(kind)
        out = out.withColumn(name, F.col(name).cast("double") if gap is None else W.seconds_part(gap).cast("float"))
    return out.select("click_id", *[name for *_, name in _TIED])


@register("w1_w3_tied_times_null_keys", _tied_sql())
def q_tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tied(spark, sf_dir, W.SkewSplit())


@register("w1_w3_tied_times_null_keys_split", _tied_sql())
def q_tied_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's clicks share one time and NULL keys hold a fifth of the rows: cut by load position."""
    return _tied(spark, sf_dir, W.SkewSplit(heavy_rows=50))


# --- splits, row range, append (S3, F1, F2, U1) ------------------------------
TRAIN_LOG_SQL = "SELECT click_time, ip, app, device, os, channel, is_attributed, row_id FROM clicks WHERE day <= 25"
TEST_LOG_SQL = "SELECT click_id, click_time, ip, app, device, os, channel, row_id FROM clicks WHERE day > 25"


def _train_test(spark: SparkSession, sf_dir: str):
    c = clicks(spark, sf_dir)
    train = c.filter(F.col("day") <= 25).select("click_time", "ip", "app", "device", "os", "channel", "is_attributed", "row_id")
    test = c.filter(F.col("day") > 25).select("click_id", "click_time", "ip", "app", "device", "os", "channel", "row_id")
    return train, test


@register(
    "s3_row_range",
    _with_clicks(
        "lo AS (SELECT min(row_id) AS frm FROM clicks WHERE day >= 8), n AS (SELECT count(*) AS cnt FROM clicks)\n"
        "SELECT click_id, ip FROM clicks, lo, n WHERE row_id >= frm - (CASE WHEN frm >= 1 THEN 1 ELSE 0 END)"
        " AND row_id < cnt - (CASE WHEN frm >= 1 THEN 1 ELSE 0 END)"
    ),
)
def q_row_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows from the start of day 8 to the end, with the pandas skiprows offsets."""
    from ..sources.files import row_range

    c = clicks(spark, sf_dir)
    frm = c.filter(F.col("day") >= 8).select(F.min("row_id")).scalar()
    to = c.select(F.count(F.lit(1))).scalar()
    return row_range(c, frm, to).select("click_id", "ip")


@register(
    "f2_day_split",
    _with_clicks(
        "x AS (SELECT 1)\nSELECT click_id, CASE WHEN day >= 26 THEN 'test' WHEN day >= 22 THEN 'valid' ELSE 'train' END AS split FROM clicks"
    ),
)
def q_day_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.splits import day_split

    return day_split(clicks(spark, sf_dir), valid_from=22, test_from=26).select("click_id", "split")


@register(
    "u1_append_logs",
    _with_clicks(
        f"tr AS ({TRAIN_LOG_SQL}), te AS ({TEST_LOG_SQL}),\n"
        "u AS (SELECT * FROM (SELECT *, 0 AS src FROM tr) UNION ALL BY NAME (SELECT *, 1 AS src FROM te))\n"
        "SELECT * REPLACE (CAST(click_id AS DOUBLE) AS click_id, CAST(is_attributed AS DOUBLE) AS is_attributed) FROM u"
    ),
)
def q_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns missing on one side are NaN-filled floats in the original's
    appended frame; they are doubles here too."""
    from ..sources.files import append_logs

    train, test = _train_test(spark, sf_dir)
    out = append_logs(train, test)
    return out.withColumns({"click_id": F.col("click_id").cast("double"), "is_attributed": F.col("is_attributed").cast("double")})


VAL_SIZE = 1000  # validation rows taken from the end of the train log


@register(
    "f1_positional_split",
    _with_clicks(
        f"tr AS ({TRAIN_LOG_SQL}), te AS ({TEST_LOG_SQL}),\n"
        "u AS (SELECT * FROM (SELECT *, 0 AS src FROM tr) UNION ALL BY NAME (SELECT *, 1 AS src FROM te)),\n"
        "n AS (SELECT count(*) AS n_train FROM u WHERE src = 0)\n"
        f"SELECT src, row_id, CASE WHEN src = 1 THEN 'test' WHEN row_id >= n_train - {VAL_SIZE} THEN 'valid' ELSE 'train' END AS split FROM u, n"
    ),
)
def q_positional_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.splits import positional_split
    from ..sources.files import append_logs

    train, test = _train_test(spark, sf_dir)
    return positional_split(append_logs(train, test), VAL_SIZE).select("src", "row_id", "split")


# --- sort, top-k, share (T1, T2, P10) ----------------------------------------
@register(
    "t1_sort_ip_clicks_desc",
    _with_clicks("g AS (SELECT ip, count(*) AS clicks FROM clicks GROUP BY ip)\nSELECT ip, clicks FROM g ORDER BY clicks DESC, ip"),
)
def q_sort_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.rank import sort_desc

    g = clicks(spark, sf_dir).groupBy("ip").agg(F.count(F.lit(1)).alias("clicks"))
    return sort_desc(g, "clicks", ties=["ip"])


@register(
    "t2_top_ip_app",
    _with_clicks(
        "g AS (SELECT ip, app, count(*) AS clicks FROM clicks GROUP BY ip, app)\n"
        "SELECT ip, app, clicks FROM g ORDER BY clicks DESC, ip, app LIMIT 100"
    ),
)
def q_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.rank import top_k

    g = clicks(spark, sf_dir).groupBy("ip", "app").agg(F.count(F.lit(1)).alias("clicks"))
    return top_k(g, "clicks", 100, ties=["ip", "app"])


@register(
    "p10_app_click_share",
    _with_clicks(
        "g AS (SELECT app, count(*) AS clicks FROM clicks GROUP BY app)\n"
        "SELECT app, clicks, ROUND(100.0 * clicks / (SELECT sum(clicks) FROM g), 6) AS clicks_pct FROM g"
    ),
)
def q_percent_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.rank import percent_of_total

    g = clicks(spark, sf_dir).groupBy("app").agg(F.count(F.lit(1)).alias("clicks"))
    out = percent_of_total(g, "clicks", "clicks_pct")
    return out.withColumn("clicks_pct", F.round("clicks_pct", ROUND))


# --- scores: de-duplicate, attach, align, blend (A7, J2, J3, B1-B5, M6) -------
# Deterministic score columns standing in for model output.
S1 = "CAST(click_id % 101 AS DOUBLE) / 100"
S2 = "CAST(click_id % 53 AS DOUBLE) / 52"
S3 = "CAST(hour AS DOUBLE) / 23"
SIX = "ip, app, device, os, channel, click_time"
BLEND_ROUND = 9


def _score_tables(spark: SparkSession, sf_dir: str):
    c = clicks(spark, sf_dir)
    return [c.select("click_id", F.expr(s).cast("double").alias("is_attributed")) for s in (S1, S2, S3)]


def _blend_sql(expr: str) -> str:
    return _with_clicks(
        f"a AS (SELECT click_id, {S1} AS s1, {S2} AS s2, {S3} AS s3 FROM clicks)\n"
        f"SELECT click_id, ROUND({expr}, {BLEND_ROUND}) AS is_attributed FROM a"
    )


@register(
    "j3_align_score_tables",
    _with_clicks(f"x AS (SELECT 1)\nSELECT click_id, {S1} AS s1, {S2} AS s2, {S3} AS s3 FROM clicks"),
)
def q_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.scores import align_scores

    return align_scores(_score_tables(spark, sf_dir), ["s1", "s2", "s3"])


def _blend_query(name: str, how: str, sql_expr: str):
    @register(name, _blend_sql(sql_expr))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from ..operators.scores import align_scores, blend

        aligned = align_scores(_score_tables(spark, sf_dir), ["s1", "s2", "s3"])
        out = blend(aligned, ["s1", "s2", "s3"], how)
        return out.withColumn("is_attributed", F.round("is_attributed", BLEND_ROUND))

    return run


_blend_query("b1_arithmetic_blend", "arithmetic", "(s1 + s2 + s3) / 3")
_blend_query(
    "b2_geometric_blend",
    "geometric",
    "CASE WHEN s1 = 0 OR s2 = 0 OR s3 = 0 THEN 0.0 ELSE exp((ln(s1) + ln(s2) + ln(s3)) / 3) END",
)
_blend_query(
    "b3_harmonic_blend",
    "harmonic",
    "CASE WHEN s1 = 0 OR s2 = 0 OR s3 = 0 THEN 0.0 ELSE 3 / (1 / s1 + 1 / s2 + 1 / s3) END",
)
_blend_query("b4_weighted_blend", "weighted", "(5 * s1 + 3 * s2 + 2 * s3) / 10")


def _supplement_and_test(spark: SparkSession, sf_dir: str):
    """The scored supplement is the whole log; the test log is its last days."""
    c = clicks(spark, sf_dir)
    scored = c.select("ip", "app", "device", "os", "channel", "click_time", F.expr(S1).cast("double").alias("is_attributed"))
    test = c.filter(F.col("day") > 25).select("click_id", "ip", "app", "device", "os", "channel", "click_time")
    return scored, test


@register(
    "a7_dedupe_scores",
    _with_clicks(
        f"s AS (SELECT {SIX}, {S1} AS is_attributed FROM clicks)\n"
        f"SELECT {SIX}, ROUND(AVG(is_attributed), {BLEND_ROUND}) AS is_attributed FROM s GROUP BY {SIX}"
    ),
)
def q_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.scores import dedupe_scores

    scored, _ = _supplement_and_test(spark, sf_dir)
    return dedupe_scores(scored).withColumn("is_attributed", F.round("is_attributed", BLEND_ROUND))


_DEDUP_SQL = (
    f"s AS (SELECT {SIX}, {S1} AS is_attributed FROM clicks),\n"
    f"d AS (SELECT {SIX}, AVG(is_attributed) AS is_attributed FROM s GROUP BY {SIX}),\n"
    f"t AS (SELECT click_id, {SIX} FROM clicks WHERE day > 25)\n"
)


@register(
    "j2_attach_scores",
    _with_clicks(_DEDUP_SQL + f"SELECT click_id, {SIX}, ROUND(d.is_attributed, {BLEND_ROUND}) AS is_attributed FROM t LEFT JOIN d USING ({SIX})"),
)
def q_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.scores import attach_scores, dedupe_scores

    scored, test = _supplement_and_test(spark, sf_dir)
    out = attach_scores(test, dedupe_scores(scored))
    return out.withColumn("is_attributed", F.round("is_attributed", BLEND_ROUND))


@register(
    "b5_submission",
    _with_clicks(_DEDUP_SQL + f"SELECT click_id, ROUND(d.is_attributed, {BLEND_ROUND}) AS is_attributed FROM t LEFT JOIN d USING ({SIX})"),
)
def q_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.scores import submission

    scored, test = _supplement_and_test(spark, sf_dir)
    return submission(test, scored).withColumn("is_attributed", F.round("is_attributed", BLEND_ROUND))


@register(
    "m6_auc",
    _with_clicks(
        f"s AS (SELECT {S1} AS score, is_attributed AS label FROM clicks),\n"
        "g AS (SELECT score, SUM(label) AS pos, SUM(1 - label) AS neg FROM s GROUP BY score),\n"
        "c AS (SELECT pos, neg, COALESCE(SUM(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)\n"
        f"SELECT ROUND(SUM(pos * (below + 0.5 * neg)) / (SUM(pos) * SUM(neg)), {BLEND_ROUND}) AS auc FROM c"
    ),
)
def q_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..ml.metrics import auc_by_group

    c = clicks(spark, sf_dir).select(F.expr(S1).cast("double").alias("score"), "is_attributed")
    return auc_by_group(c, "score", "is_attributed").select(F.round("auc", BLEND_ROUND).alias("auc"))


# --- the three feature sets, composed (kernels 1-3) ---------------------------
def _coded_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.encode import dictionary_encode

    return dictionary_encode(clicks(spark, sf_dir), "app")


CODED_BASE_SQL = "base AS (SELECT * REPLACE (CAST(dense_rank() OVER (ORDER BY app) - 1 AS INT) AS app) FROM clicks)"


def kernel_query(name: str, specs: Sequence, skew: W.SkewSplit = W.SkewSplit()):
    cols = O.output_columns(specs)
    sql = O.features_sql("__BASE__", specs, cols).replace("__BASE__", CLICKS_DUCKDB.strip() + ",\n" + CODED_BASE_SQL, 1)

    @register(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _round_features(build_features(_coded_clicks(spark, sf_dir), specs, skew=skew), specs, cols)

    return run


def _kernels():
    from .kernels import KERNEL1, KERNEL2, KERNEL3

    kernel_query("kernel1_features", KERNEL1)
    kernel_query("kernel2_features", KERNEL2)
    kernel_query("kernel3_features", KERNEL3)
    # The plans of a log with hot keys: every key above 60 rows is cut (at sf0.01 all devices, most ips and some finer keys).
    hot = W.SkewSplit(heavy_rows=60)
    kernel_query("kernel1_features_split", KERNEL1, hot)
    kernel_query("kernel2_features_split", KERNEL2, hot)
    kernel_query("kernel3_features_split", KERNEL3, hot)


_kernels()


# --- model operators (M1-M9), rows-only checks --------------------------------
# The registered model queries train on kernel-1 features of the whole clicks
# table with kernel 1's own parameters, its round budget and patience included.
# One fit serves the four of them: its tables lie in the fingerprinted store,
# keyed by features, parameters and the input files.
def _ml_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.splits import day_split
    from .kernels import KERNEL1

    feats = build_features(_coded_clicks(spark, sf_dir), KERNEL1)
    return day_split(feats, valid_from=22, test_from=26)


def _ml_stored(spark: SparkSession, sf_dir: str, part: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """A part of the models' work in the store, under what all of them are computed from."""
    from ..ml import gbt
    from ..sources.sinks import cached_table, fingerprint, input_identity
    from .kernels import CATEGORICAL_1, KERNEL1, RATES, predictors

    spec = (KERNEL1, gbt.PARAMS["kernel1"], predictors("kernel1"), CATEGORICAL_1, RATES)
    key = fingerprint(spec, input_identity(spark, f"{sf_dir}/events.parquet"))
    return cached_table(spark, f"model-{part}", key, compute)


def _ml_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written feature table, which the early-stopped fit and the refit share."""
    return _ml_stored(spark, sf_dir, "features", lambda: _ml_features(spark, sf_dir))


def _ml_table(spark: SparkSession, sf_dir: str, part: str) -> DataFrame:
    """``staged``, ``scores`` or ``importance`` of the early-stopped fit."""
    from ..ml import gbt
    from ..ml.train import validate_and_score
    from .kernels import CATEGORICAL_1, RATES, predictors

    fitted = []

    def table(name: str) -> DataFrame:
        def compute() -> DataFrame:
            if not fitted:
                fitted.append(validate_and_score(_ml_rows(spark, sf_dir), predictors("kernel1"), CATEGORICAL_1, gbt.PARAMS["kernel1"], rates=RATES, written=True))
            return getattr(fitted[0], name)

        return _ml_stored(spark, sf_dir, name, compute)

    return {name: table(name) for name in ("staged", "scores", "importance")}[part]


@register("m4_m5_staged_validation_auc")
def q_staged_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ml_table(spark, sf_dir, "staged")


@register("m8_score_test_best_prefix")
def q_score_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ml_table(spark, sf_dir, "scores")


@register("m9_feature_importance")
def q_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ml_table(spark, sf_dir, "importance")


@register("m7_fixed_round_refit_score")
def q_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..ml import gbt
    from ..ml.train import refit_and_score
    from .kernels import CATEGORICAL_1, RATES, predictors

    k = gbt.best_iteration(_ml_table(spark, sf_dir, "staged"), gbt.PARAMS["kernel1"].patience)
    return refit_and_score(_ml_rows(spark, sf_dir), predictors("kernel1"), CATEGORICAL_1, gbt.PARAMS["kernel1"], rounds=k, rates=RATES, written=True)


# --- model inputs and evaluation over the whole table (M1, M2, M5, M8) -----------
_M1_SQL = _with_clicks(
    "t AS (SELECT *, day < 22 AS train, row_id % 5 AS fold FROM clicks),\n"
    "c AS (SELECT *, lead(epoch_us(click_time)) OVER (PARTITION BY ip, os ORDER BY click_time, row_id) - epoch_us(click_time) AS gap FROM t),\n"
    "codes AS (SELECT hour, row_number() OVER (ORDER BY hour) - 1 AS code FROM (SELECT DISTINCT hour FROM c WHERE train)),\n"
    "o AS (SELECT SUM(is_attributed) AS s, COUNT(*) AS n FROM c WHERE train),\n"
    "of AS (SELECT fold, SUM(is_attributed) AS s, COUNT(*) AS n FROM c WHERE train GROUP BY fold),\n"
    "k AS (SELECT ip, SUM(is_attributed) AS s, COUNT(*) AS n FROM c WHERE train GROUP BY ip),\n"
    "kf AS (SELECT ip, fold, SUM(is_attributed) AS s, COUNT(*) AS n FROM c WHERE train GROUP BY ip, fold)\n"
    "SELECT click_id, CAST(COALESCE(code, (SELECT COUNT(*) FROM codes)) AS DOUBLE) AS hour__code,"
    " ROUND(CASE WHEN train THEN (COALESCE(k.s, 0) - COALESCE(kf.s, 0) + 20.0 * (o.s - of.s) / (o.n - of.n)) / (COALESCE(k.n, 0) - COALESCE(kf.n, 0) + 20.0)"
    " ELSE (COALESCE(k.s, 0) + 20.0 * o.s / o.n) / (COALESCE(k.n, 0) + 20.0) END, 9) AS ip__rate,"
    " COALESCE(CAST(gap AS DOUBLE), -1.0) AS gap__num, CAST(gap IS NULL AS DOUBLE) AS gap__null, CAST(device AS DOUBLE) AS device__num\n"
    "FROM c LEFT JOIN codes USING (hour) LEFT JOIN k USING (ip) LEFT JOIN kf USING (ip, fold) JOIN of USING (fold), o"
)


@register("m1_encoded_predictors", _M1_SQL)
def q_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, out-of-fold rates of a category with more values than a tree has bins, and numbers with a null flag."""
    from ..ml.encode import Encoder, Encoding

    df = clicks(spark, sf_dir).withColumn("train", F.col("day") < 22)
    df = W.ordered_values(df, ["ip", "os"], [W.Req("lead", "next_t")]).withColumn("gap", F.col("next_t") - W.epoch_micros("click_time"))
    encoder = Encoder.fit(df.filter("train"), Encoding(("hour",), ("ip",), ("gap", "device")), "is_attributed")
    out = encoder.columns(df, F.col("train")).withColumn("ip__rate", F.round("ip__rate", 9))
    return out.select("click_id", "hour__code", "ip__rate", "gap__num", "gap__null", "device__num")


@register("m2_class_weight", _with_clicks("x AS (SELECT 1)\nSELECT click_id, CASE WHEN is_attributed = 1 THEN 200.0 ELSE 1.0 END::DOUBLE AS weight FROM clicks"))
def q_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..ml import gbt

    return gbt.with_weight(clicks(spark, sf_dir), "is_attributed", gbt.PARAMS["kernel1"].pos_weight).select("click_id", "weight")


# A small stored forest over plain columns: (tree, id, value, feature, left, right, threshold, categories that go left).
FOREST_COLUMNS = ("hour", "os", "channel", "device", "ip")
FOREST_NODES = (
    (0, 0, 0.0, 0, 1, 2, 11.0, None), (0, 1, 0.0, 1, 3, 4, 2.0, None), (0, 2, 0.0, 2, 5, 6, 0.0, (1.0, 3.0, 7.0)),
    (0, 3, -0.5), (0, 4, 0.125), (0, 5, 0.25), (0, 6, -0.25),
    (1, 0, 0.0, 4, 1, 2, 75.0, None), (1, 1, 0.5), (1, 2, 0.0, 3, 3, 4, 0.0, (0.0, 2.0)), (1, 3, -0.75), (1, 4, 0.25),
    (2, 0, 0.0, 2, 1, 2, 4.5, None), (2, 1, 0.0, 4, 3, 4, 20.0, None), (2, 2, -0.125), (2, 3, 1.0), (2, 4, 0.0),
    (3, 0, 0.0, 1, 1, 2, 0.0, (0.0, 5.0)), (3, 1, -1.0), (3, 2, 0.375),
)
FOREST_WEIGHTS = (1.0, 0.5, 0.5, 0.25)


def _forest():
    from ..ml.forest import Forest, Node

    return Forest.of_nodes([Node(*n) for n in FOREST_NODES], FOREST_WEIGHTS)


def _tree_sql(tree: int, node: int = 0) -> str:
    n = next(n for n in FOREST_NODES if n[:2] == (tree, node))
    if len(n) == 3:
        return f"{n[2]}::DOUBLE"
    column = FOREST_COLUMNS[n[3]]
    test = f"{column} <= {n[6]}" if n[7] is None else f"{column} IN ({', '.join(str(int(c)) for c in n[7])})"
    return f"CASE WHEN {test} THEN {_tree_sql(tree, n[4])} ELSE {_tree_sql(tree, n[5])} END"


def _margin_sql(k: int) -> str:
    return " + ".join(f"{FOREST_WEIGHTS[t]} * ({_tree_sql(t)})" for t in range(k))


@register("m8_score_stored_forest", _with_clicks(
    f"m AS (SELECT click_id, {_margin_sql(3)} AS m3, {_margin_sql(4)} AS m4 FROM clicks)\n"
    "SELECT click_id, ROUND(1 / (1 + exp(-2 * m3)), 12) AS first_three, ROUND(1 / (1 + exp(-2 * m4)), 12) AS whole FROM m"
))
def q_stored_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: the probability by a prefix and by all trees of a stored forest."""
    from ..ml.forest import score_array

    df = score_array(clicks(spark, sf_dir), _forest(), FOREST_COLUMNS, "first_three", 3)
    df = score_array(df, _forest(), FOREST_COLUMNS, "whole")
    return df.select("click_id", F.round("first_three", 12).alias("first_three"), F.round("whole", 12).alias("whole"))


def _staged_sql() -> str:
    parts = [f"SELECT {k} AS iteration, {_margin_sql(k)} AS m, is_attributed AS y FROM clicks" for k in range(1, len(FOREST_WEIGHTS) + 1)]
    return _with_clicks(
        f"s AS ({' UNION ALL '.join(parts)}),\n"
        "g AS (SELECT iteration, m, SUM(y)::DOUBLE AS p, SUM(1 - y)::DOUBLE AS q FROM s GROUP BY iteration, m),\n"
        "b AS (SELECT *, SUM(q) OVER (PARTITION BY iteration ORDER BY m) - q AS below FROM g),\n"
        "a AS (SELECT iteration, SUM(p * (below + q / 2)) / (SUM(p) * SUM(q)) AS auc FROM b GROUP BY iteration)\n"
        "SELECT iteration, ROUND(auc, 9) AS auc, auc = (SELECT MAX(auc) FROM a) AS best FROM a"
    )


@register("m5_staged_auc_stored_forest", _staged_sql())
def q_staged_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5: the AUC of every prefix of a stored forest and the best one."""
    from ..ml import gbt, staged

    df = clicks(spark, sf_dir).select("is_attributed", F.array(*[F.col(c).cast("double") for c in FOREST_COLUMNS]).alias("features"))
    table = staged.staged_auc(_forest(), df)
    return table.select("iteration", F.round("auc", 9).alias("auc"), (F.col("iteration") == gbt.best_iteration(table)).alias("best"))


# --- files: what is written is read again (P1, S1, S4, S6, S7) -------------------
def _shared(spark: SparkSession, name: str) -> str:
    import uuid

    from ..session import checkpoint_dir

    return f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


@register("s1_csv_scan_row_id", _with_clicks("x AS (SELECT 1)\nSELECT row_id, ip, length(app)::INTEGER AS app, device, os, channel, date_trunc('second', click_time)::TIMESTAMP AS click_time, is_attributed FROM clicks"))
def q_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log as CSV, read with declared types; load positions by file and place in it."""
    from ..schema import TRAIN_COLUMNS, TRAIN_SCHEMA
    from ..sources.files import read_csv, with_row_id

    path = _shared(spark, "log-csv")
    log = clicks(spark, sf_dir).withColumns({"app": F.length("app"), "attributed_time": F.lit(None).cast("string"), "click_time": F.date_format("click_time", "yyyy-MM-dd HH:mm:ss")})
    log.orderBy("row_id").select(*TRAIN_SCHEMA.names).write.option("header", True).csv(path)
    return with_row_id(read_csv(spark, path, TRAIN_SCHEMA, TRAIN_COLUMNS)).select("row_id", *TRAIN_COLUMNS)


@register("p1_parse_click_time", _with_clicks("x AS (SELECT 1)\nSELECT click_id, date_trunc('second', click_time)::TIMESTAMP AS parsed FROM clicks"))
def q_parse_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.timeparts import parse_click_time

    text = clicks(spark, sf_dir).select("click_id", F.date_format("click_time", "yyyy-MM-dd HH:mm:ss").alias("text"))
    return text.select("click_id", parse_click_time("text").alias("parsed"))


_SCORES_SQL = "x AS (SELECT 1)\nSELECT click_id, CASE WHEN row_id % 11 <> 4 THEN {score} END AS is_attributed FROM clicks"


def _written_scores(spark: SparkSession, sf_dir: str, divisor: float, **how) -> DataFrame:
    from ..sources.files import read_scores
    from ..sources.sinks import write_scores_csv

    path = _shared(spark, "scores-csv")
    scores = clicks(spark, sf_dir).select("click_id", F.when(F.col("row_id") % 11 != 4, (F.col("row_id") % 997) / F.lit(divisor)).alias("is_attributed"))
    write_scores_csv(scores, path, **how)
    return read_scores(spark, path)


@register("s4_s6_scores_nine_decimals", _with_clicks(_SCORES_SQL.format(score="ROUND((row_id % 997) / 1000003.0::DOUBLE, 9)")))
def q_scores_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S6 then S4: nine decimals in the file, missing scores as empty fields."""
    return _written_scores(spark, sf_dir, 1000003.0)


@register("s4_s7_scores_gzip", _with_clicks(_SCORES_SQL.format(score="(row_id % 997) / 997.0::DOUBLE")))
def q_scores_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 then S4: gzip files with all digits."""
    return _written_scores(spark, sf_dir, 997.0, decimals=None, compression="gzip")


# --- remaining inventory items over the whole table (A8, T3, S2, P7) ----------
@register(
    "a8_global_max_feature",
    _with_clicks(
        "g AS (SELECT ip, app, count(*) AS n FROM clicks GROUP BY ip, app),\n"
        "f AS (SELECT c.*, g.n AS ip_appcount FROM clicks c LEFT JOIN g USING (ip, app))\n"
        "SELECT max(ip_appcount) AS max_ip_appcount FROM f"
    ),
)
def q_global_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.aggregates import add_group_features, global_max

    feats = add_group_features(clicks(spark, sf_dir), [Agg("count", ("ip", "app"))])
    return global_max(feats, "ip_appcount")


@register("t3_head_load_order", _with_clicks("x AS (SELECT 1)\nSELECT click_id, ip, app, click_time FROM clicks ORDER BY row_id LIMIT 5"))
def q_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.rank import head

    return head(clicks(spark, sf_dir), 5).select("click_id", "ip", "app", "click_time")


DEBUG_ROWS = 100_000  # fixed value: the debug slice size of the original


@register("s2_capped_scan", _with_clicks(f"x AS (SELECT 1)\nSELECT click_id, ip FROM clicks WHERE row_id < {DEBUG_ROWS}"))
def q_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import capped

    return capped(clicks(spark, sf_dir), DEBUG_ROWS).select("click_id", "ip")


@register(
    "p7_wrap_unsigned",
    _with_clicks(
        "g AS (SELECT ip, day, hour, count(channel) AS ip_tcount FROM clicks GROUP BY ip, day, hour)\n"
        "SELECT click_id, CAST(((ip % 256) + 256) % 256 AS BIGINT) AS ip_u8,"
        " CAST(((g.ip_tcount % 65536) + 65536) % 65536 AS BIGINT) AS ip_tcount_u16"
        " FROM clicks LEFT JOIN g USING (ip, day, hour)"
    ),
)
def q_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unsigned narrowing casts of the original, as explicit wraps."""
    from ..functions.keys import wrap_unsigned
    from ..operators.aggregates import add_group_features

    feats = add_group_features(clicks(spark, sf_dir), [Agg("nonnull", ("ip", "day", "hour"), "channel", "ip_tcount")])
    return feats.select("click_id", wrap_unsigned("ip", 8).alias("ip_u8"), wrap_unsigned("ip_tcount", 16).alias("ip_tcount_u16"))


# --- variants whose inputs can fail: a cap below the row count, a width that the data
# exceed, repeated click identities and test rows without a score ----------------------
SMALL_CAP = 1_000


@register("s2_capped_scan_small", _with_clicks(f"x AS (SELECT 1)\nSELECT click_id, ip FROM clicks WHERE row_id < {SMALL_CAP}"))
def q_capped_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.files import capped

    return capped(clicks(spark, sf_dir), SMALL_CAP).select("click_id", "ip")


@register("p7_wrap_unsigned_narrow", _with_clicks("x AS (SELECT 1)\nSELECT click_id, CAST(((ip % 64) + 64) % 64 AS BIGINT) AS ip_u6, CAST(row_id % 256 AS BIGINT) AS row_u8 FROM clicks"))
def q_wrap_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.keys import wrap_unsigned

    return clicks(spark, sf_dir).select("click_id", wrap_unsigned("ip", 6).alias("ip_u6"), wrap_unsigned("row_id", 8).alias("row_u8"))


_COARSE_SQL = (
    "cc AS (SELECT * REPLACE (CAST(date_trunc('month', click_time) AS TIMESTAMP) AS click_time) FROM clicks),\n"
    f"s AS (SELECT {SIX}, {S1} AS is_attributed FROM cc WHERE day <= 20),\n"
    f"d AS (SELECT {SIX}, AVG(is_attributed) AS is_attributed FROM s GROUP BY {SIX}),\n"
    f"t AS (SELECT click_id, {SIX} FROM cc WHERE day > 15)\n"
)


def _coarse(spark: SparkSession, sf_dir: str):
    """Clicks timed by the month: identities repeat; scores of days 1-20, a test log of the days from 16."""
    c = clicks(spark, sf_dir).withColumn("click_time", F.date_trunc("month", "click_time").cast("timestamp_ntz"))
    cols = [x.strip() for x in SIX.split(",")]
    scored = c.filter("day <= 20").select(*cols, F.expr(S1).cast("double").alias("is_attributed"))
    return scored, c.filter("day > 15").select("click_id", *cols)


@register("a7_dedupe_scores_repeated", _with_clicks(_COARSE_SQL + f"SELECT {SIX}, ROUND(is_attributed, {BLEND_ROUND}) AS is_attributed FROM d"))
def q_dedupe_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.scores import dedupe_scores

    return dedupe_scores(_coarse(spark, sf_dir)[0]).withColumn("is_attributed", F.round("is_attributed", BLEND_ROUND))


@register("j2_b5_submission_unmatched", _with_clicks(_COARSE_SQL + f"SELECT click_id, ROUND(d.is_attributed, {BLEND_ROUND}) AS is_attributed FROM t LEFT JOIN d USING ({SIX})"))
def q_submission_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.scores import submission

    scored, test = _coarse(spark, sf_dir)
    return submission(test, scored).withColumn("is_attributed", F.round("is_attributed", BLEND_ROUND))
