"""Aggregates over counted tuples against group-bys of the log itself."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from paths import SF01
from pyspark.sql import functions as F

from clickfeat.operators import lattice as L
from clickfeat.operators.aggregates import Agg, GroupPlan, group_table
from clickfeat.plans import catalog as C
from clickfeat.plans.kernels import KERNEL1, KERNEL3
from clickfeat.sources.clicks import clicks


def rows(df):
    """Rows with floats to 12 digits, by column name."""
    cols = sorted(df.columns)
    return sorted((tuple(float(f"{r[c]:.12g}") if isinstance(r[c], float) else r[c] for c in cols) for r in df.collect()), key=str)


def check(df, aggs):
    groups = GroupPlan.build(aggs).groups
    got = L.group_tables(df, groups)
    assert list(got) == list(groups)
    for keys, some in groups.items():
        assert rows(got[keys]) == rows(group_table(df, keys, some))


@pytest.mark.parametrize("specs", [KERNEL1, KERNEL3], ids=["kernel1", "kernel3"])
def test_feature_sets(spark, specs):
    df = C._coded_clicks(spark, SF01).withColumn("in_test_hh", (F.col("hour") % 3).cast("int"))
    check(df, [s for s in specs if isinstance(s, Agg)])


ROW = st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.one_of(st.none(), st.sampled_from("abc")), st.one_of(st.none(), st.integers(-(2**31), 2**31 - 1)))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(ROW, max_size=30))
def test_nulls_and_extreme_values(spark, data):
    df = spark.createDataFrame(data, "k int, s string, v int").withColumn("d", F.col("v") * 0.5)
    check(df, [
        Agg("count", ("k",)), Agg("count", ("k", "s")), Agg("nonnull", ("k",), "v"), Agg("nunique", ("k",), "s"), Agg("nunique", ("s",), "k"),
        Agg("nunique", ("k",), "k", "self"), Agg("mean", ("k", "s"), "v"), Agg("var", ("s",), "v"), Agg("mean", ("k",), "d"), Agg("skew", ("k",), "v"), Agg("max", ("s",), "v"),
    ])


def test_variance_has_no_cancellation(spark):
    df = spark.range(50_000).select((F.col("id") % 2).cast("int").alias("k"), (F.lit(2_000_000_000) + F.col("id") % 3).cast("int").alias("v"))
    a = Agg("var", ("k",), "v")
    got = {r.k: r.k_by_v_var for r in L.tuples(df, [a]).groupBy("k").agg(L.weighted(a).alias("k_by_v_var")).collect()}
    x = [i % 3 for i in range(0, 50_000, 2)]
    mean = sum(x) / len(x)
    assert got[0] == pytest.approx(sum((v - mean) ** 2 for v in x) / (len(x) - 1), rel=1e-9)


def test_the_log_is_scanned_twice_at_most(spark):
    """Once by the plan of the rows, once for the tuples, for all of kernel 1's key sets."""
    from clickfeat.plans.specs import build_features

    log = clicks(spark, SF01)
    out = build_features(C._coded_clicks(spark, SF01), KERNEL1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert len([s for s in KERNEL1 if isinstance(s, Agg)]) > 15
    assert plan.count("get_json_object") <= 2  # only the log's own scan parses its text
    assert log.count() == out.count()


def test_empty_table(spark):
    df = spark.createDataFrame([], "k int, s string, v int")
    check(df, [Agg("count", ("k",)), Agg("nunique", ("k",), "s"), Agg("mean", ("s",), "v"), Agg("var", ("s",), "v"), Agg("count", ("k", "s"))])
