import os
import tempfile

from pyspark.sql import functions as F

from clickfeat.operators.aggregates import Agg, add_group_features
from clickfeat.streaming.score_files import score_arriving_logs


def test_each_arriving_file_is_scored(spark):
    root = tempfile.mkdtemp(prefix="clickfeat-stream-")
    src = os.path.join(root, "in")
    os.makedirs(src)
    for f in range(2):
        with open(os.path.join(src, f"test{f}.csv"), "w") as fh:
            fh.write("click_id,ip,app,device,os,channel,click_time\n")
            for i in range(5):
                fh.write(f"{f * 10 + i},{i % 2},1,1,1,1,2017-11-10 0{i}:00:00\n")

    def score(batch):
        feats = add_group_features(batch, [Agg("count", ("ip",), name="n")])
        return feats.select("click_id", (F.col("n") / 10.0).alias("is_attributed"))

    q = score_arriving_logs(spark, src, os.path.join(root, "out"), score, checkpoint=os.path.join(root, "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(root, "out"))
    assert out.count() == 10
    assert out.select("batch").distinct().count() == 2
    got = {r["click_id"]: r["is_attributed"] for r in out.collect()}
    assert got[0] == 0.3 and got[1] == 0.2
