import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clickfeat.ml import boost, gbt, staged
from clickfeat.ml.encode import Encoder, Encoding
from clickfeat.ml.forest import margin_column
from clickfeat.ml.metrics import auc, auc_by_group
from clickfeat.operators.encode import dense_codes
from clickfeat.operators.prefix import running_before


@pytest.fixture(scope="module")
def planted(spark):
    df = spark.range(3000).select(
        F.col("id").alias("click_id"),
        F.rand(7).alias("x1"),
        F.rand(8).alias("x2"),
        (F.col("id") % 4).cast("int").alias("cat"),
    )
    y = ((F.col("x1") > 0.75) & (F.rand(9) > 0.1)) | (F.rand(10) > 0.97)
    return df.withColumn("is_attributed", y.cast("int")).cache()


@pytest.fixture(scope="module")
def trained(planted):
    params = gbt.TrainParams(step_size=0.2, max_depth=3, min_instances_per_node=20, max_bins=32, rounds=12, pos_weight=5.0)
    fm = gbt.feature_matrix(planted, ["x1", "x2", "cat"], ["cat"], "is_attributed", params.max_bins)
    data = fm.transform(planted).cache()
    model = gbt.fit(data, params)
    return fm, data, model


def test_planted_signal_auc(trained):
    fm, data, model = trained
    table = {r["iteration"]: r["auc"] for r in gbt.staged_auc(model, data, block=5).collect()}
    assert len(table) == 12
    assert table[12] > 0.8
    best = gbt.best_iteration(gbt.staged_auc(model, data, block=5))
    assert table[best] == max(table.values())


def test_prefix_margin_equals_model_probability(trained):
    fm, data, model = trained
    a = gbt.score(model, data).select("click_id", F.col("is_attributed").alias("a"))
    b = gbt.score(model, data, by_trees=True).select("click_id", F.col("is_attributed").alias("b"))
    worst = a.join(b, "click_id").select(F.max(F.abs(F.col("a") - F.col("b")))).first()[0]
    assert worst < 1e-12


def test_auc_invariant_under_monotone_map(planted, spark):
    s = planted.withColumn("s", F.col("x1") * 3 + 1)
    assert auc(s, "x1") == pytest.approx(auc(s, "s"), abs=1e-12)


def test_importance_sums_to_100(trained):
    fm, data, model = trained
    imp = gbt.importance(model, fm.names)
    rows = imp.collect()
    assert {r["feature"] for r in rows} == {"x1", "x2", "cat"}
    assert sum(r["gain"] for r in rows) == pytest.approx(100.0)
    assert rows[0]["feature"] == "x1"


def test_best_iteration_patience(spark):
    table = spark.createDataFrame([(1, 0.6), (2, 0.7), (3, 0.7), (4, 0.65), (5, 0.8)], "iteration int, auc double")
    assert gbt.best_iteration(table) == 5
    assert gbt.best_iteration(table, patience=2) == 2


def test_two_level_auc_equals_evaluator(planted, spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    from clickfeat.ml.metrics import auc_by_group

    s = planted.withColumn("s", F.round(F.col("x1") * 20) / 20)  # many ties
    ev = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", numBins=0).evaluate(
        s.withColumn("y", F.col("is_attributed").cast("double")))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 7, 64):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = auc_by_group(s, "s", "is_attributed").first()[0]
            assert got == pytest.approx(ev, abs=1e-12)
            per = {r["cat"]: r["auc"] for r in auc_by_group(s, "s", "is_attributed", group="cat").collect()}
            for c in range(4):
                assert per[c] == pytest.approx(auc_by_group(s.filter(F.col("cat") == c), "s", "is_attributed").first()[0], abs=1e-12)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert auc_by_group(s.limit(0), "s", "is_attributed").first() is None


def test_longer_fit_begins_with_the_same_trees(trained):
    fm, data, model = trained
    params = gbt.TrainParams(step_size=0.2, max_depth=3, min_instances_per_node=20, max_bins=32, rounds=12, pos_weight=5.0)
    short = gbt.fit(data, params, rounds=5)
    assert [t.toDebugString.split("\n", 1)[1] for t in short.trees] == [t.toDebugString.split("\n", 1)[1] for t in model.trees[:5]]


@pytest.fixture(scope="module")
def params():
    return gbt.TrainParams(step_size=0.2, max_depth=3, min_instances_per_node=20, max_bins=32, rounds=12, patience=2, pos_weight=5.0)


def test_a_forest_grown_in_steps_is_the_forest_grown_at_once(trained, params, monkeypatch):
    fm, data, _ = trained
    monkeypatch.setattr(boost, "BLOCK", 3)  # margins are stored twice on the way
    whole = boost.Booster.start(data, params).grow(8)
    steps = boost.Booster.start(data, params)
    for n in (1, 4, 5, 8):
        steps.grow(n)
    assert steps.nodes == whole.nodes and steps.weights == whole.weights == [1.0] + [0.2] * 7
    assert steps.fitted == 8
    assert gbt.staged_auc(whole, data).collect()[-1].auc > 0.8


def test_early_stopping_fits_no_tree_twice(trained, params):
    fm, data, _ = trained
    valid = data.filter("click_id % 2 = 0")
    booster, staged, best = gbt.fit_early_stopped(data, valid, params, rounds=16, block=4)
    whole = boost.Booster.start(data, params).grow(len(booster))
    assert best == gbt.best_iteration(gbt.staged_auc(whole, valid), 2)
    assert booster.fitted == len(booster) <= best + 2 + 4
    assert len(booster) == 16 or len(booster) - best >= 2
    table = gbt.importance(booster, fm.names, best).collect()
    assert sum(r.gain for r in table) == pytest.approx(100.0) and table[0].feature == "x1"


def test_flat_forest_equals_the_models_trees(trained, spark):
    """Margins of all rows, missing values and unseen categories included, for every prefix."""
    from pyspark.ml.linalg import Vectors

    fm, data, model = trained
    forest = gbt.forest_of(model)
    x = np.array([r.features.toArray() for r in data.select("features").collect()])
    x = np.vstack([x, [[np.nan] * x.shape[1]], [[99.0, *[0.5] * (x.shape[1] - 1)]]])
    got = forest.margins(x, 0, len(forest))
    rows = range(0, len(x), 37)
    for k, (tree, w) in enumerate(zip(model.trees, model.treeWeights, strict=True)):
        want = np.array([tree.predict(Vectors.dense(x[i])) * w for i in rows])
        step = got[list(rows), k] - (got[list(rows), k - 1] if k else 0)
        assert step == pytest.approx(want, abs=1e-9)
    assert forest.between(x, 3, 9) == pytest.approx(got[:, 8] - got[:, 2])


def test_staged_auc_bounds_and_exact_values(trained):
    """Coarse cells: the bounds hold, and the prefix that is chosen is the best by exact AUC."""
    fm, data, model = trained
    exact = {r.k: r.auc for r in auc_by_group(data.select(F.col("is_attributed").alias("y"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), margin_column(gbt.forest_of(model), "features", k).alias("m")) for k in range(1, 13)])).alias("p")).select("y", "p.k", "p.m"), "m", "y", group="k").collect()}
    first = max(exact, key=lambda k: (exact[k], -k))
    for cells in (2, 5, 64, 1 << 13):
        table = staged.staged_auc(gbt.forest_of(model), data, block=5, cells=cells)
        rows = table.collect()
        assert [r.iteration for r in rows] == list(range(1, 13))
        for r in rows:
            assert r.auc_low - 1e-12 <= exact[r.iteration] <= r.auc_high + 1e-12
            assert not r.exact or r.auc == pytest.approx(exact[r.iteration], abs=1e-12)
        assert gbt.best_iteration(table) == first


@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=12))
def test_undecided_places_settle_the_best(data):
    """With the exact values of the places asked for and any values in the bounds elsewhere, the first best place is found."""
    value = [v for v, _, _ in data]
    low, high = [v - a for v, a, _ in data], [v + b for v, _, b in data]
    known = [a == b for a, b in zip(low, high, strict=True)]
    need = staged.undecided(low, high, known)
    for guess in (low, high, [(a + b) / 2 for a, b in zip(low, high, strict=True)]):
        seen = [v if i in need or known[i] else g for i, (v, g) in enumerate(zip(value, guess, strict=True))]
        assert seen.index(max(seen)) == value.index(max(value))


def test_rates_leave_out_their_own_fold_and_flags_mark_nulls(spark):
    rows = [(i, "a" if i % 3 else None, "s" if i < 8 else "t", None if i % 4 == 0 else -1.0, int(i % 2)) for i in range(20)]
    df = spark.createDataFrame(rows, "row_id long, c string, d string, x double, y int")
    e = Encoder.fit(df, Encoding(("d",), ("c",), ("x", "row_id")), "y", folds=5, smoothing=2.0)
    assert e.flags == ("x",) and e.names == ["d", "c", "x", "row_id", "x__null"]
    got = {r.row_id: r for r in e.columns(df, True).collect()}
    full = {r.row_id: r for r in e.columns(df.union(spark.createDataFrame([(99, "new", None, 1.0, 0)], df.schema))).collect()}
    for i, c, d, x, y in rows:
        own = [(b, v) for j, b, _, _, v in rows if j % 5 != i % 5]
        same = [v for b, v in own if b == c]
        prior = sum(v for _, v in own) / len(own)
        assert got[i].c__rate == pytest.approx((sum(same) + 2 * prior) / (len(same) + 2))
        every = [v for _, b, _, _, v in rows if b == c]
        assert full[i].c__rate == pytest.approx((sum(every) + 2 * 0.5) / (len(every) + 2))
        assert (got[i].x__num, got[i].x__null, got[i].d__code) == (-1.0, float(x is None), float(d == "t"))
    assert full[99].c__rate == pytest.approx(0.5) and full[99].d__code == 2.0
    with pytest.raises(ValueError):
        gbt.feature_matrix(df, ["row_id"], ["row_id"], "y", max_bins=10)


def test_dense_codes_are_ranks(spark):
    df = spark.range(500).select(F.concat(F.lit("k"), (F.col("id") * 7919 % 203).cast("string")).alias("v")).union(spark.createDataFrame([(None,)], "v string"))
    got = {r.v: r.code for r in dense_codes(df, "v").collect()}
    assert got == {v: i for i, v in enumerate(sorted({f"k{i * 7919 % 203}" for i in range(500)}))}


def test_prefix_sums_need_no_single_task(spark):
    df = spark.range(10_000).select((F.col("id") * 7919 % 10_007).alias("o"), (F.col("id") % 5).alias("n")).repartition(7)
    out = running_before(df, ["o"], "before", "n")
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    total = 0
    for r in out.orderBy("o").collect():
        assert r.before == total
        total += r.n


@pytest.mark.parametrize("literals", [3, 200])
def test_dictionary_codes_are_ranks_by_expression_or_join(spark, monkeypatch, literals):
    from clickfeat.operators import encode

    monkeypatch.setattr(encode, "LITERALS", literals)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["b", "a", None, "ä", "c", "a", "B"])], "i int, v string")
    want = {0: 2, 1: 1, 2: None, 3: 4, 4: 3, 5: 1, 6: 0}
    assert {r.i: r.v for r in encode.dictionary_encode(df, "v").collect()} == want
    some = encode.dictionary_encode(df, "v", "code", fit_on=df.filter("v in ('a', 'B', 'c', 'b')")).collect()
    assert {r.i: r.code for r in some} == {0: 2, 1: 1, 2: None, 3: 4, 4: 3, 5: 1, 6: 0}
    assert encode.dictionary_encode(df.filter("v is null"), "v").collect()[0].v is None


def test_a_tree_takes_one_pass_a_level_and_is_sparks_own(planted, spark, monkeypatch):
    """With all rows and features, the trees of ``GBTClassifier``; and no more than a job a level for each."""
    params = gbt.TrainParams(step_size=0.2, max_depth=3, min_instances_per_node=20, max_bins=16, rounds=6, pos_weight=5.0, subsampling_rate=1.0, feature_subset="all")
    fm = gbt.feature_matrix(planted, ["x1", "x2", "cat"], ["cat"], "is_attributed", params.max_bins)
    data = fm.transform(planted).cache()
    booster = boost.Booster.start(data, params)
    sc = spark.sparkContext
    sc.setJobGroup("six-trees", "six trees")
    booster.grow(6)
    jobs = len(sc.statusTracker().getJobIdsForGroup("six-trees"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 6 * params.max_depth
    model = gbt.fit(data, params)
    x = np.array([r.features.toArray() for r in data.select("features").collect()])
    got, want = booster.forest().margins(x, 0, 6), gbt.forest_of(model).margins(x, 0, 6)
    assert got == pytest.approx(want, abs=1e-6)
    assert sorted((t, f) for t, f, _ in booster.gains) == sorted((t, f) for i, tree in enumerate(model.trees) for t, f, _ in gbt.table_nodes(tree, i)[1])
    assert sum(g for *_, g in booster.gains) == pytest.approx(sum(g for i, tree in enumerate(model.trees) for *_, g in gbt.table_nodes(tree, i)[1]), rel=1e-6)
