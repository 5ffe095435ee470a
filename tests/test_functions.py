import datetime as dt

import pytest
from pyspark.sql import functions as F

from clickfeat.functions import blend as B
from clickfeat.functions.keys import composite_key_bucket, wrap_unsigned
from clickfeat.functions.timeparts import epoch_seconds, wday
from clickfeat.operators.ordered import seconds_part


def _one(spark, expr, schema, row):
    return spark.createDataFrame([row], schema).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "a,b,c,am,gm,hm,wm",
    [
        (0.1, 0.2, 0.3, 0.2, 0.1817120593, 0.1636363636, 0.17),
        (0.0, 0.5, 0.2, 0.7 / 3, 0.0, 0.0, 0.19),
    ],
)
def test_blend_cases(spark, a, b, c, am, gm, hm, wm):
    df = spark.createDataFrame([(a, b, c)], "a double, b double, c double")
    r = df.select(
        B.arithmetic_mean(["a", "b", "c"]).alias("am"),
        B.geometric_mean(["a", "b", "c"]).alias("gm"),
        B.harmonic_mean(["a", "b", "c"]).alias("hm"),
        B.weighted_mean(["a", "b", "c"], B.FINAL_BLEND_WEIGHTS).alias("wm"),
    ).first()
    assert r["am"] == pytest.approx(am, abs=1e-10)
    assert r["gm"] == pytest.approx(gm, abs=1e-10)
    assert r["hm"] == pytest.approx(hm, abs=1e-10)
    assert r["wm"] == pytest.approx(wm, abs=1e-10)
    assert r["hm"] <= r["gm"] <= r["am"]


def test_blend_null_dominates_zero(spark):
    df = spark.createDataFrame([(None, 0.0, 0.5)], "a double, b double, c double")
    r = df.select(B.geometric_mean(["a", "b", "c"]).alias("g"), B.harmonic_mean(["a", "b", "c"]).alias("h")).first()
    assert r["g"] is None and r["h"] is None


def test_seconds_part_wraps_like_timedelta_seconds(spark):
    df = spark.createDataFrame([(86_405_000_000,), (-86_406_000_000,), (-1,), (999_999,)], "d long")
    got = [r[0] for r in df.select(seconds_part(F.col("d"))).collect()]
    assert got == [5, 86394, 86399, 0]


def test_weekday_monday_zero_and_epoch(spark):
    df = spark.createDataFrame([(dt.datetime(2017, 11, 6, 0, 0, 1, 500000),)], "click_time timestamp_ntz")
    r = df.select(wday().alias("w"), epoch_seconds().alias("e")).first()
    assert r["w"] == 0  # 2017-11-06 was a Monday
    assert r["e"] == 1509926401


def test_wrap_unsigned_and_bucket(spark):
    df = spark.createDataFrame([(70000, 300)], "a long, b long")
    r = df.select(wrap_unsigned("a", 16).alias("a"), wrap_unsigned("b", 8).alias("b"),
                  composite_key_bucket(["a", "b"], 2**26).alias("h")).first()
    assert (r["a"], r["b"]) == (4464, 44)
    assert 0 <= r["h"] < 2**26


def test_calendar_bounds_are_declared_on_the_columns(spark, tmp_path):
    """The bound follows the column, not its name, through selects, joins and files."""
    from clickfeat.functions.timeparts import add_time_parts, in_test_hh
    from clickfeat.operators.aggregates import bound_of

    df = spark.createDataFrame([(dt.datetime(2017, 11, 7, 4), 1)], "click_time timestamp_ntz, ip long")
    df = add_time_parts(df).withColumn("in_test_hh", in_test_hh("hour"))
    assert bound_of(df, ["hour", "wday"]) == 25 * 8 and bound_of(df, ["day", "in_test_hh"]) == 32 * 4
    assert bound_of(df, ["hour", "ip"]) == float("inf")
    df.write.parquet(str(tmp_path / "t"))
    again = spark.read.parquet(str(tmp_path / "t")).join(df.groupBy("ip").count(), "ip")
    assert bound_of(again, ["hour", "wday"]) == 25 * 8
    assert bound_of(df.withColumn("day", F.to_date("click_time")), ["day"]) == float("inf")
