import datetime as dt
import glob
import os
import tempfile

from pyspark.sql import functions as F

from clickfeat.schema import TRAIN_COLUMNS, TRAIN_SCHEMA
from clickfeat.sources.files import append_logs, read_csv, read_scores, row_range, with_row_id
from clickfeat.sources.sinks import cached_table, write_scores_csv


def _write_train_csv(folder, n_files=3, rows=40):
    k = 0
    for f in range(n_files):
        with open(os.path.join(folder, f"part{f}.csv"), "w") as fh:
            fh.write("ip,app,device,os,channel,click_time,attributed_time,is_attributed\n")
            for _ in range(rows):
                t = dt.datetime(2017, 11, 7) + dt.timedelta(seconds=k)
                fh.write(f"{k % 7},{k % 5},1,{k % 3},{k % 11},{t:%Y-%m-%d %H:%M:%S},,{int(k % 13 == 0)}\n")
                k += 1
    return k


def test_csv_scan_and_dense_row_id(spark):
    folder = tempfile.mkdtemp(prefix="clickfeat-csv-")
    n = _write_train_csv(folder)
    df = with_row_id(read_csv(spark, folder, TRAIN_SCHEMA, TRAIN_COLUMNS))
    rows = df.select("row_id", "click_time").collect()
    ids = sorted(r["row_id"] for r in rows)
    assert ids == list(range(n))
    # load order of the files (names sort in write order) equals time order here
    by_id = sorted(rows, key=lambda r: r["row_id"])
    assert [r["click_time"] for r in by_id] == sorted(r["click_time"] for r in rows)


def test_row_range_pandas_offsets(spark):
    df = spark.range(20).withColumnRenamed("id", "row_id")
    assert [r[0] for r in row_range(df, 0, 5).collect()] == [0, 1, 2, 3, 4]
    assert [r[0] for r in row_range(df, 3, 6).collect()] == [2, 3, 4]
    assert [r[0] for r in row_range(df, 3, 6, pandas_skiprows=False).collect()] == [3, 4, 5]


def test_append_by_name(spark):
    tr = spark.createDataFrame([(1, 0)], "ip long, is_attributed int")
    te = spark.createDataFrame([(2, 9)], "ip long, click_id long")
    out = {r["src"]: r for r in append_logs(tr, te).collect()}
    assert out[0]["click_id"] is None and out[1]["is_attributed"] is None


def test_score_sink_nine_decimals_and_nulls(spark):
    folder = tempfile.mkdtemp(prefix="clickfeat-out-")
    scores = spark.createDataFrame([(1, 0.5), (2, None), (3, 1e-10)], "click_id long, is_attributed double")
    write_scores_csv(scores.coalesce(1), folder + "/sub")
    text = open(glob.glob(folder + "/sub/part-*.csv")[0]).read().splitlines()
    assert text[0] == "click_id,is_attributed"
    assert sorted(text[1:]) == ["1,0.500000000", "2,", "3,0.000000000"]
    back = {r["click_id"]: r["is_attributed"] for r in read_scores(spark, folder + "/sub").collect()}
    assert back == {1: 0.5, 2: None, 3: 0.0}
    write_scores_csv(scores, folder + "/gz", decimals=None, compression="gzip")
    assert glob.glob(folder + "/gz/part-*.csv.gz")


def test_feature_cache_computes_once(spark):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(5)

    folder = tempfile.mkdtemp(prefix="clickfeat-cache-")
    a = cached_table(spark, "t", "k1", compute, folder)
    b = cached_table(spark, "t", "k1", compute, folder)
    assert a.count() == b.count() == 5 and len(calls) == 1


def test_row_id_dense_across_many_splits_of_one_file(spark):
    """Large files are read as many byte-range splits; positions stay dense and in file order."""
    folder = tempfile.mkdtemp(prefix="clickfeat-big-")
    n = 3000
    with open(os.path.join(folder, "big.csv"), "w") as fh:
        fh.write("ip,app,device,os,channel,click_time,attributed_time,is_attributed\n")
        for k in range(n):
            t = dt.datetime(2017, 11, 7) + dt.timedelta(seconds=k)
            fh.write(f"{k},{k % 5},1,{k % 3},{k % 11},{t:%Y-%m-%d %H:%M:%S},,0\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        scan = read_csv(spark, folder, TRAIN_SCHEMA, TRAIN_COLUMNS)
        assert scan.rdd.getNumPartitions() > 10
        got = with_row_id(scan).select("row_id", "ip").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(r["row_id"] for r in got) == list(range(n))
    assert all(r["row_id"] == r["ip"] for r in got)  # ip was written as the line number


def test_input_identity_follows_the_files(spark, tmp_path):
    from clickfeat.sources.sinks import input_identity

    path = str(tmp_path / "t")
    spark.range(5).coalesce(1).write.parquet(path)
    before = input_identity(spark, path)
    assert before == input_identity(spark, path) and len(before) >= 1
    spark.range(9).coalesce(1).write.mode("append").parquet(path)
    assert input_identity(spark, path) != before


def test_store_keys_code_and_half_written_tables(spark, tmp_path, monkeypatch):
    import pytest

    from clickfeat.sources import store

    folder = str(tmp_path)
    key = store.fingerprint("spec", ["a"])
    assert key == store.fingerprint("spec", ["a"]) != store.fingerprint("spec", ["b"])
    monkeypatch.setattr(store, "code_version", lambda: "other code")
    assert store.fingerprint("spec", ["a"]) != key
    monkeypatch.undo()
    # a table that was never published is not read, nor one without a success mark
    spark.range(3).write.parquet(f"{folder}/features/_writing-dead")
    os.makedirs(f"{folder}/features/t-{key}")
    assert cached_table(spark, "t", key, lambda: spark.range(7), folder).count() == 7

    def broken():
        return spark.range(5).selectExpr("raise_error('lost') as x")

    with pytest.raises(Exception):
        cached_table(spark, "u", key, broken, folder)
    assert cached_table(spark, "u", key, lambda: spark.range(2), folder).count() == 2
    # of two writers the first wins, the other's files are gone
    spark.range(9).write.parquet(f"{folder}/features/_writing-late")
    store._publish(spark, f"{folder}/features/_writing-late", f"{folder}/features/t-{key}")
    assert spark.read.parquet(f"{folder}/features/t-{key}").count() == 7
    assert not glob.glob(f"{folder}/features/**/_writing-late", recursive=True)
    # marked results stay, released ones and dead writes go
    dead = store.sweep(spark, 0.0, folder)
    assert "_writing-dead" in dead and all(x.startswith("_writing-") for x in dead)
    assert cached_table(spark, "t", key, broken, folder).count() == 7
    assert store.release(spark, folder) == 2
    assert store.sweep(spark, 3600.0, folder) == []
    assert {x.split("-")[0] for x in store.sweep(spark, 0.0, folder)} == {"t", "u"}
    assert not glob.glob(f"{folder}/features/[tu]-*")


def test_cleared_tables_are_gone(spark, tmp_path):
    from clickfeat.sources.sinks import _written, clear_tables, materialize

    kept = list(_written)
    _written.clear()
    materialize(spark.range(3), "x", str(tmp_path))
    assert glob.glob(f"{tmp_path}/tables/x-*") and clear_tables(spark) == 1
    assert not glob.glob(f"{tmp_path}/tables/x-*")
    _written.extend(kept)


def test_offsets_of_ten_thousand_splits(spark):
    from clickfeat.operators.prefix import running_before

    splits = spark.range(10_000).selectExpr("concat('f', lpad(cast(id div 100 as string), 4, '0')) as f", "(id % 100) * 64 as s", "id % 7 as n").repartition(9)
    out = running_before(splits, ["f", "s"], "offset", "n")
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    at = 0
    for r in out.orderBy("f", "s").collect():
        assert r.offset == at
        at += r.n
