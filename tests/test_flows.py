"""End-to-end jobs on CSV logs written from the sf0.001 clicks."""

import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from clickfeat.operators.encode import dictionary_encode
from clickfeat.plans import flows
from clickfeat.sources.clicks import clicks
from paths import SF001

SMALL = {"min_instances_per_node": 10}


def _csv(df, path):
    df.coalesce(1).write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    return path


@pytest.fixture(scope="module")
def logs(spark):
    root = tempfile.mkdtemp(prefix="clickfeat-flows-")
    c = dictionary_encode(clicks(spark, SF001), "app").withColumn("click_time", F.date_trunc("second", "click_time").cast("timestamp_ntz"))
    c = c.orderBy("row_id")
    train = c.filter("day <= 25").select("ip", "app", "device", "os", "channel", "click_time",
                                         F.lit(None).cast("timestamp_ntz").alias("attributed_time"), "is_attributed")
    supp = c.filter("day > 25").select("click_id", "ip", "app", "device", "os", "channel", "click_time")
    test = supp.filter(F.col("click_id") % 2 == 0)
    return {
        "train": _csv(train, f"{root}/train"),
        "supp": _csv(supp, f"{root}/supp"),
        "test": _csv(test, f"{root}/test"),
        "root": root,
        "n_test": test.count(),
    }


def test_kernel1_flow(spark, logs):
    out = f"{logs['root']}/sub1"
    res = flows.kernel1(spark, logs["train"], logs["supp"], logs["test"], out, val_size=150, rounds=8, params=SMALL)
    sub = spark.read.option("header", True).csv(out)
    assert sub.count() == logs["n_test"]
    assert res.best_iteration >= 1
    vals = [float(r["is_attributed"]) for r in sub.collect() if r["is_attributed"] is not None]
    assert vals and all(0.0 <= v <= 1.0 for v in vals)
    assert abs(sum(r["gain"] for r in res.importance.collect()) - 100.0) < 1e-6


def test_kernel2_and_blend(spark, logs):
    out2 = f"{logs['root']}/sub2"
    flows.kernel2(spark, logs["train"], logs["supp"], out2, val_size=150, rounds=6, params=SMALL)
    out1 = f"{logs['root']}/sub1b"
    flows.kernel1(spark, logs["train"], logs["supp"], logs["supp"], out1, val_size=150, rounds=6, params=SMALL)
    res = flows.blend_files(spark, [out1, out2, out2], f"{logs['root']}/am", f"{logs['root']}/final")
    am = {r["click_id"]: r["is_attributed"] for r in res["arithmetic"].collect()}
    gm = {r["click_id"]: r["is_attributed"] for r in res["geometric"].collect()}
    hm = {r["click_id"]: r["is_attributed"] for r in res["harmonic"].collect()}
    assert am and all(hm[k] <= gm[k] + 1e-12 and gm[k] <= am[k] + 1e-12 for k in am)
    assert glob.glob(f"{logs['root']}/final/part-*.csv")


def test_kernel3_validate_and_refit(spark, logs, monkeypatch):
    res = flows.kernel3(spark, logs["train"], first_day=None, valid_day=20, params={**SMALL, "rounds": 6})
    assert res.staged.count() >= 1 and 0.0 < res.validation_auc < 1.0
    # a second run reads the features that the first has written
    with monkeypatch.context() as m:
        m.setattr(flows, "build_features", None)
        again = flows.kernel3(spark, logs["train"], first_day=None, valid_day=20, params={**SMALL, "rounds": 6})
    assert again.validation_auc == res.validation_auc
    out = f"{logs['root']}/sub3"
    sub = flows.kernel3(spark, logs["train"], logs["supp"], out, rounds=5, refit_first_day=1, params=SMALL).submission
    assert sub.count() == spark.read.option("header", True).csv(logs["supp"]).count()
    assert glob.glob(f"{out}/part-*.csv.gz")


def test_row_range_without_end_reads_to_the_end(spark):
    from clickfeat.sources.files import row_range

    df = spark.range(10).withColumnRenamed("id", "row_id")
    assert [r[0] for r in row_range(df, 4, None).orderBy("row_id").collect()] == list(range(3, 10))


def test_two_files_blend_and_malformed_scores_fail(spark, tmp_path):
    import pytest

    from clickfeat.plans import flows

    paths = []
    for i, v in enumerate((0.2, 0.4)):
        p = tmp_path / f"s{i}.csv"
        p.write_text(f"click_id,is_attributed\n1,{v}\n")
        paths.append(str(p))
    out = flows.blend_files(spark, paths, weights=[1.0, 3.0])
    assert abs(out["weighted"].first()["is_attributed"] - 0.35) < 1e-12
    assert set(flows.blend_files(spark, paths)) == {"arithmetic", "geometric", "harmonic"}
    bad = tmp_path / "bad.csv"
    bad.write_text("click_id,is_attributed\n1,oops\n")
    with pytest.raises(Exception):
        flows.blend_files(spark, [paths[0], str(bad)])["arithmetic"].collect()


def test_wide_string_category_is_encoded_beside_its_source(spark):
    from pyspark.sql import functions as F

    from clickfeat.ml.gbt import feature_matrix

    df = spark.range(600).select(F.concat(F.lit("k"), (F.col("id") % 150).cast("string")).alias("app"), (F.col("id") % 2).cast("double").alias("y"))
    out = feature_matrix(df, ["app"], ["app"], "y", max_bins=100, rates=["app"]).transform(df)
    assert out.schema["app"].dataType.simpleString() == "string"
    assert out.select("features").count() == 600


def test_load_positions_survive_other_splits(spark, tmp_path):
    from clickfeat.sources.files import with_row_id

    spark.range(5000).selectExpr("id as click_id", "cast(id % 7 as double) as is_attributed").coalesce(1).write.option("header", True).csv(str(tmp_path / "log"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        df = with_row_id(spark.read.schema("click_id long, is_attributed double").option("header", True).csv(str(tmp_path / "log")))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
        assert df.filter("row_id <> click_id").count() == 0
        assert df.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_kernel2_default_window(spark, logs, monkeypatch):
    """The window ends ``val_size`` rows before the log's end; a first row given reads from there on."""
    seen = []
    monkeypatch.setattr(flows, "row_range", lambda df, frm, to: seen.append((frm, to)) or df.limit(0))
    monkeypatch.setattr(flows, "append_logs", lambda *a, **k: 1 / 0)
    n = flows.load_log(spark, logs["train"]).count()
    import pytest

    for kw in ({"window": 200, "val_size": 150}, {"val_size": 150}, {"frm": 7}):
        with pytest.raises(ZeroDivisionError):
            flows.kernel2(spark, logs["train"], logs["supp"], **kw)
    assert seen == [(n - 350, n - 150), (0, flows.WINDOW), (7, None)]
