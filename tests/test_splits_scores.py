from pyspark.sql import functions as F

from clickfeat.operators.aggregates import Agg, add_group_features
from clickfeat.operators.scores import align_scores, dedupe_scores, submission
from clickfeat.operators.splits import day_split, positional_split
from clickfeat.sources.clicks import clicks
from paths import SF001


def test_positional_split(spark):
    df = spark.createDataFrame([(0, i) for i in range(10)] + [(1, i) for i in range(3)], "src int, row_id long")
    got = {(r["src"], r["row_id"]): r["split"] for r in positional_split(df, 4).collect()}
    assert [got[(0, i)] for i in range(10)] == ["train"] * 6 + ["valid"] * 4
    assert {got[(1, i)] for i in range(3)} == {"test"}


def test_day_split(spark):
    df = spark.createDataFrame([(d,) for d in (20, 21, 22, 25, 26)], "day int")
    assert [r["split"] for r in day_split(df, 22, 26).orderBy("day").collect()] == ["train", "train", "valid", "valid", "test"]


def test_left_join_keeps_rows_and_counts_sum(spark):
    c = clicks(spark, SF001)
    out = add_group_features(c, [Agg("count", ("ip", "app"), name="n")])
    assert out.count() == c.count()
    per_key = out.groupBy("ip", "app").agg(F.first("n").alias("n"))
    assert per_key.agg(F.sum("n")).first()[0] == c.count()


def test_dedupe_attach_and_align(spark):
    six = "ip long, app int, device int, os int, channel int, click_time string"
    scored = spark.createDataFrame([(1, 1, 1, 1, 1, "t", 0.2), (1, 1, 1, 1, 1, "t", 0.4), (2, 1, 1, 1, 1, "t", 0.9)],
                                   six + ", is_attributed double")
    test = spark.createDataFrame([(10, 1, 1, 1, 1, 1, "t"), (11, 3, 1, 1, 1, 1, "t")], "click_id long, " + six)
    assert dedupe_scores(scored).count() == 2
    sub = {r["click_id"]: r["is_attributed"] for r in submission(test, scored).collect()}
    assert abs(sub[10] - 0.3) < 1e-12 and sub[11] is None
    a = spark.createDataFrame([(1, 0.1), (2, 0.2)], "click_id long, is_attributed double")
    b = spark.createDataFrame([(2, 0.5), (1, 0.6)], "click_id long, is_attributed double")
    got = {r["click_id"]: (r["x"], r["y"]) for r in align_scores([a, b], ["x", "y"]).collect()}
    assert got == {1: (0.1, 0.6), 2: (0.2, 0.5)}
