"""The literal fixture: expected values computed independently with pandas."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from clickfeat.functions.timeparts import add_time_parts, in_test_hh
from clickfeat.operators.aggregates import Agg, add_group_features
from clickfeat.operators.ordered import GapSpec, SkewSplit, add_click_gaps, add_cumcount, add_global_shift, add_next_click_sentinel

ROWS = [
    (0, "2017-11-07 10:00:00", 1, "a", 1, 1, 7),
    (1, "2017-11-07 10:00:05", 1, "a", 1, 1, 7),
    (2, "2017-11-07 10:00:05", 1, "b", 1, 1, 8),
    (3, "2017-11-07 11:00:05", 2, "a", 2, 1, 7),
    (4, "2017-11-08 10:00:10", 1, "a", 1, 1, 9),
    (5, "2017-11-08 12:00:00", 2, "a", 2, 1, 7),
    (6, "2017-11-08 13:30:00", 1, "a", 1, 1, 7),
    (7, "2017-11-09 00:00:00", 3, "c", 3, 2, 9),
]
N = None
EXPECTED = {
    "hour": [10, 10, 10, 11, 10, 12, 13, 0],
    "wday": [1, 1, 1, 1, 2, 2, 2, 3],
    "w1": [5, 0, 5, 3595, 12590, N, N, N],
    "w2": [N, 5, 0, N, 5, 3595, 12590, N],
    "w3": [0, 1, 2, 0, 3, 1, 4, 0],
    "a1": [4, 4, 1, 2, 4, 2, 4, 1],
    "a3": [3, 3, 3, 1, 3, 1, 3, 1],
    "a4": [10.75, 10.75, 10.0, 11.5, 10.75, 11.5, 10.75, 0.0],
    "a5": [2.25, 2.25, N, 0.5, 2.25, 0.5, 2.25, N],
    "a6": [2.0, 2.0, N, N, 2.0, N, 2.0, N],
    "w4": [5, 86405, 1489951195, 89995, 12590, 1489857600, 1489852200, 1489814400],
    "w5": [N, 5, 86405, 1489951195, 89995, 12590, 1489857600, 1489852200],
    "p4": [1, 1, 1, 2, 1, 3, 1, 3],
}


@pytest.fixture(scope="module")
def fixture_df(spark):
    rows = [(i, dt.datetime.fromisoformat(t), ip, app, d, o, c, i) for i, t, ip, app, d, o, c in ROWS]
    df = spark.createDataFrame(
        rows, "click_id long, click_time timestamp_ntz, ip long, app string, device int, os int, channel int, row_id long"
    )
    return add_time_parts(df)


SKEWS = [SkewSplit(enabled=False), SkewSplit(heavy_rows=1), SkewSplit(heavy_rows=2), SkewSplit()]


@pytest.mark.parametrize("skew", SKEWS, ids=["plain", "split1", "split2", "default"])
def test_literal_fixture(fixture_df, skew):
    df = add_click_gaps(
        fixture_df,
        [GapSpec(("ip", "os", "device"), "next", "w1"), GapSpec(("ip", "os", "device"), "prev", "w2")],
        skew=skew,
    )
    df = add_cumcount(df, ["ip"], "w3", skew=skew)
    df = add_group_features(
        df,
        [
            Agg("count", ("ip", "app"), name="a1"),
            Agg("nunique", ("ip",), "channel", "a3"),
            Agg("mean", ("ip", "app"), "hour", "a4"),
            Agg("var", ("ip", "app"), "hour", "a5"),
            Agg("skew", ("ip", "app"), "hour", "a6"),
        ],
    )
    df = add_next_click_sentinel(df, ["ip", "app", "device", "os"], "w4", skew=skew)
    df = add_global_shift(df, "w4", "w5", skew=skew)
    df = df.withColumn("p4", in_test_hh("hour"))
    got = {r["click_id"]: r for r in df.collect()}
    for col, values in EXPECTED.items():
        actual = [got[i][col] for i in range(8)]
        if col in ("a4", "a5", "a6"):
            actual = [None if v is None else round(v, 9) for v in actual]
        assert actual == values, col


def test_gap_dtype_is_float(fixture_df):
    df = add_click_gaps(fixture_df, [GapSpec(("ip",), "next", "g")])
    assert dict(df.dtypes)["g"] == "float"


def test_null_key_gives_null_feature(spark):
    rows = [(0, dt.datetime(2020, 1, 1, 0, 0, 0), None, 0), (1, dt.datetime(2020, 1, 1, 0, 0, 1), None, 1),
            (2, dt.datetime(2020, 1, 1, 0, 0, 2), 5, 2)]
    df = spark.createDataFrame(rows, "click_id long, click_time timestamp_ntz, ip long, row_id long")
    out = add_click_gaps(df, [GapSpec(("ip",), "next", "g")])
    out = add_cumcount(out, ["ip"], "c")
    out = add_group_features(out, [Agg("count", ("ip",), name="n")])
    got = {r["click_id"]: (r["g"], r["c"], r["n"]) for r in out.collect()}
    assert got[0] == (None, None, None) and got[1] == (None, None, None)
    assert got[2] == (None, 0, 1)
