"""The two-level (hot keys cut into time buckets) form equals the plain window."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from clickfeat.operators.ordered import Req, SkewSplit, ordered_values
from clickfeat.sources.clicks import clicks
from paths import SF01

REQS = [Req("lead", "nxt"), Req("lag", "prv"), Req("rownum", "rn"), Req("lag", "prev_os", "os"), Req("lead", "next_ch", "channel")]


@pytest.fixture(scope="module")
def base(spark):
    return clicks(spark, SF01).cache()


@pytest.mark.parametrize("keys", [["device"], ["device", "hour"], ["ip"], []], ids=["device", "device_hour", "ip", "global"])
@pytest.mark.parametrize("heavy", [3, 50, 700])
def test_split_equals_plain(base, keys, heavy):
    plain = ordered_values(base, keys, REQS, skew=SkewSplit(enabled=False))
    split = ordered_values(base, keys, REQS, skew=SkewSplit(heavy_rows=heavy))
    cols = ["click_id", "nxt", "prv", "rn", "prev_os", "next_ch"]
    diff = plain.select(cols).exceptAll(split.select(cols)).count() + split.select(cols).exceptAll(plain.select(cols)).count()
    assert diff == 0
    assert split.count() == base.count()


def test_keyless_split_plan_partitions_by_bucket(base):
    out = ordered_values(base, [], [Req("lag", "prv")], skew=SkewSplit(heavy_rows=1000)).select("click_id", "prv")
    plan = out._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    windows = [line for line in lines if "Window [" in line and "lag(1" in line]
    assert windows and all("__bucket" in line for line in windows)
    # the only single-partition step is the window over the per-bucket summary
    # (one row per bucket), which directly follows that exchange
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            above = [x for x in lines[:i] if "Window [" in x][-1]
            assert "__here" in above or "__first" in above or "__last" in above
    assert "Union" not in plan  # the rows are read once


def test_properties(base):
    """W3 max + 1 = A1 per key; W1 of a row = W2 of its successor."""
    from clickfeat.operators.aggregates import Agg, add_group_features
    from clickfeat.operators.ordered import GapSpec, add_click_gaps, add_cumcount

    df = add_cumcount(base, ["ip", "os"], "cc")
    df = add_group_features(df, [Agg("count", ("ip", "os"), name="n")])
    bad = df.groupBy("ip", "os").agg((F.max("cc") + 1 - F.max("n")).alias("d")).filter("d != 0").count()
    assert bad == 0
    g = add_click_gaps(base, [GapSpec(("ip",), "next", "nx"), GapSpec(("ip",), "prev", "pv")])
    g = add_cumcount(g, ["ip"], "pos")
    a = g.select("ip", "pos", "nx")
    b = g.select("ip", (F.col("pos") - 1).alias("pos"), "pv")
    j = a.join(b, ["ip", "pos"])
    assert j.filter(~F.col("nx").eqNullSafe(F.col("pv"))).count() == 0


@pytest.mark.parametrize("heavy", [None, 40, 900])
def test_family_equals_separate_windows(base, heavy):
    """Windows sharing one shuffle on a key prefix equal one window per key set."""
    from clickfeat.operators.ordered import ordered_family

    groups = [
        (["device"], [Req("lead", "a"), Req("rownum", "b")]),
        (["device", "hour"], [Req("lag", "c"), Req("lead", "d", "os")]),
        (["device", "channel", "app"], [Req("rownum", "e"), Req("lead", "f")]),
    ]
    skew = SkewSplit(enabled=False) if heavy is None else SkewSplit(heavy_rows=heavy)
    fam = ordered_family(base, ["device"], groups, skew=skew)
    sep = base
    for keys, reqs in groups:
        sep = ordered_values(sep, keys, reqs, skew=SkewSplit(enabled=False))
    cols = ["click_id", "a", "b", "c", "d", "e", "f"]
    assert fam.select(cols).exceptAll(sep.select(cols)).count() == 0
    assert fam.count() == base.count()


def test_family_plan_shuffles_once(base):
    from clickfeat.plans.specs import Gap, build_features

    specs = [Gap(("ip",)), Gap(("ip", "os")), Gap(("ip", "os", "device")), Gap(("ip", "channel"), "prev")]
    out = build_features(base, specs, skew=SkewSplit(enabled=False))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


T0 = dt.datetime(2017, 11, 7)
BURST = [(T0 + dt.timedelta(microseconds=i), 1) for i in range(1900)] + [(T0 + dt.timedelta(minutes=15 * i + 1), 1) for i in range(100)]
SHAPES = {
    "burst": BURST,
    "one time": [(T0, 1)] * 2000,
    "few times": [(T0 + dt.timedelta(seconds=i % 3), 1) for i in range(2000)],
    "ties in a burst": [(T0 + dt.timedelta(microseconds=i // 400), 1) for i in range(1600)] + [(T0 + dt.timedelta(days=i), 1) for i in range(300)],
    "powers": [(T0 + dt.timedelta(microseconds=2 ** (i % 40)), 1) for i in range(2000)],
    "null key": [(T0 + dt.timedelta(seconds=i % 7), None) for i in range(2000)],
    "two hot and cold": [(T0 + dt.timedelta(seconds=i % 50), i % 2 if i < 1800 else i) for i in range(2000)],
    "before 1970": [(dt.datetime(1950, 1, 1) + dt.timedelta(hours=i // 5), 1) for i in range(2000)],
}


@pytest.mark.parametrize("shape", SHAPES)
def test_buckets_are_bounded_and_ordered(spark, shape):
    """Bursts, ties and NULL keys: at most 2 T rows per bucket, in the row order; results equal the plain window."""
    import random

    from clickfeat.operators import ordered as W

    rows = [(i, t, k, i) for i, (t, k) in enumerate(SHAPES[shape])]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "click_id long, click_time timestamp_ntz, k long, row_id long").withColumn("os", (F.col("row_id") * 7 % 13).cast("int"))
    df = df.withColumn("os", F.when(F.col("os") != 3, F.col("os")))
    heavy = 100
    hot = W.find_hot(df, [("k",)], skew=SkewSplit(heavy_rows=heavy))[("k",)]
    out = hot.bucketed(df.withColumn(W._T, W.epoch_micros("click_time")), W._T, "row_id").filter(W.HOT)
    sizes = [r["count"] for r in out.groupBy("k", W.BUCKET).count().collect()]
    assert max(sizes) <= 2 * heavy and sum(sizes) >= 1800 and len(sizes) <= 2 * sum(sizes) / heavy + 2
    placed = sorted(((r.k or 0, r.click_time, r.row_id), r[W.BUCKET]) for r in out.collect())
    assert all(a[0][0] != b[0][0] or a[1] <= b[1] for a, b in zip(placed, placed[1:], strict=False))
    plain = ordered_values(df, ["k"], REQS[:4], skew=SkewSplit(enabled=False))
    split = ordered_values(df, ["k"], REQS[:4], skew=SkewSplit(heavy_rows=heavy))
    cols = ["click_id", "nxt", "prv", "rn", "prev_os"]
    assert plain.select(cols).exceptAll(split.select(cols)).count() == 0
    assert split.count() == len(rows)


def test_hot_keys_of_all_sets_are_exact(base):
    """The two counting passes find exactly the keys above the bound, whatever else shares their slots."""
    from clickfeat.operators import hotkeys as H
    from clickfeat.operators import ordered as W

    rows = base.withColumn(W._T, W.epoch_micros("click_time"))
    sets = [("device",), ("ip",), ("ip", "os"), ("device", "hour"), ()]
    for bound in (20, 140, 3000, 10_000):
        stats = H.hot_stats(rows, sets, W._T, "row_id", bound, 4 if bound == 140 else H.SLOTS)  # 4 slots: all keys share them
        want = {s: rows.groupBy(*s).count().filter(F.col("count") > bound).count() for s in sets}
        assert {s for s in sets if want[s]} == set(stats.hot)
        if stats.table is not None:
            assert {sets[r.s]: r["count"] for r in stats.table.groupBy("s").count().collect()} == {s: n for s, n in want.items() if n}


def test_counters_follow_the_hot_keys_there_can_be():
    from clickfeat.operators.hotkeys import SLOTS, slots_for

    assert slots_for(10**6, 10**6) == SLOTS
    for n in (10**9, 10**11, 10**13):
        rows = max(10**6, n // 100_000)
        assert n / slots_for(n, rows) <= rows / 8 and slots_for(n, rows) <= 1 << 20


def test_hot_family_takes_no_supersets():
    from clickfeat.plans.specs import window_families

    sets = [("device",), ("device", "hour"), ("ip", "os", "device"), ("ip",), ("ip", "os")]
    assert window_families(sets) == {("device",): [("device",), ("device", "hour"), ("ip", "os", "device")],
                                     ("ip",): [("ip",), ("ip", "os")]}
    fams = window_families(sets, is_hot=lambda fam: fam == ("device",))
    assert fams[("device",)] == [("device",)]
    assert fams[("device", "hour")] == [("device", "hour")]
    assert fams[("ip",)] == [("ip",), ("ip", "os"), ("ip", "os", "device")]


def test_a_familys_tasks_follow_its_rows(spark, monkeypatch):
    """The shuffle of a family is not coalesced beyond ``FAMILY_ROWS`` rows, however few bytes they take, and the joins follow it."""
    from clickfeat.operators import ordered
    from clickfeat.operators.aggregates import Agg
    from clickfeat.plans.specs import Gap, build_features

    rows = spark.range(4000).select(
        F.col("id").alias("click_id"), F.col("id").alias("row_id"), (F.col("id") % 400).cast("int").alias("ip"), (F.col("id") % 3).cast("int").alias("os"),
        F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("click_time"))
    specs = [Gap(("ip",)), Gap(("ip", "os")), Agg("count", ("ip", "os"))]
    want = {r.click_id: r for r in build_features(rows, specs).collect()}
    monkeypatch.setattr(ordered, "FAMILY_ROWS", 100)
    out = build_features(rows, specs)
    assert {r.click_id: r for r in out.collect()} == want
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    per_task = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(per_task) == 4000 and len(per_task) > usual and max(per_task) < 400


def test_the_source_is_written_once_where_keys_may_be_hot(spark, tmp_path):
    """A dozen passes over the rows read the written table, none the log."""
    from clickfeat.plans.specs import Agg, CumCount, Gap, build_features

    log = str(tmp_path / "log")
    rows = [(i, T0 + dt.timedelta(seconds=i // 3), i % 4 or None, i % 3, i) for i in range(400)]
    spark.createDataFrame(rows, "click_id long, click_time timestamp_ntz, ip long, os int, row_id long").write.parquet(log)
    df = spark.read.parquet(log)
    specs = [Gap(("ip",)), Gap(("ip", "os"), "prev"), CumCount(("ip",), "os"), Agg("count", ("ip", "os"))]
    split = build_features(df, specs, skew=SkewSplit(heavy_rows=20))
    assert not any(log in f for f in split.inputFiles())
    plain = build_features(df, specs, skew=SkewSplit(enabled=False))
    assert any(log in f for f in plain.inputFiles())
    assert sorted(map(str, split.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_lookups_leave_out_the_first_bucket(spark):
    """Of many keys with a little more than T rows, each keeps a row or two, not all of its cells."""
    from clickfeat.operators import ordered as W

    df = spark.range(200 * 67).selectExpr("id AS row_id", "timestamp_ntz '2017-11-07' + make_dt_interval(0, 0, 0, id) AS click_time", "id % 200 AS k")
    hot = W.find_hot(df, [("k",)], skew=SkewSplit(heavy_rows=60))[("k",)]
    assert sum(level.count() for level in hot.levels) <= 2 * 200
    sizes = hot.bucketed(df.withColumn(W._T, W.epoch_micros("click_time")), W._T, "row_id").groupBy("k", W.BUCKET).count()
    assert sizes.agg(F.sum("count")).first()[0] == 200 * 67 and sizes.count() >= 200


def test_key_sets_are_searched_only_where_the_sets_they_contain_are_hot(spark, monkeypatch):
    from clickfeat.operators import hotkeys as H
    from clickfeat.operators import ordered as W

    df = spark.range(3000).selectExpr("id AS row_id", "timestamp_ntz '2017-11-07' + make_dt_interval(0, 0, 0, id) AS click_time", "id % 3 AS a", "id % 500 AS b", "id % 2 AS c")
    searched = []
    plain = H._hash
    monkeypatch.setattr(H, "_hash", lambda i, keys: searched.append(tuple(keys)) or plain(i, keys))
    sets = [("a", "b", "c"), ("a",), ("b", "c"), ("a", "c"), ("b",), ()]
    hot = W.find_hot(df, sets, skew=SkewSplit(heavy_rows=100))
    assert set(hot) == {("a",), ("a", "c"), ()}
    assert not {("a", "b", "c"), ("b", "c")} & set(searched)
