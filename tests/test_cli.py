import glob
import os
import tempfile

from clickfeat.__main__ import main


def test_blend_command(spark):
    root = tempfile.mkdtemp(prefix="clickfeat-cli-")
    paths = []
    for i, scores in enumerate([(0.1, 0.4), (0.2, 0.5), (0.3, 0.6)]):
        path = os.path.join(root, f"s{i}.csv")
        with open(path, "w") as fh:
            fh.write("click_id,is_attributed\n")
            for cid, v in enumerate(scores):
                fh.write(f"{cid},{v}\n")
        paths.append(path)
    main(["blend", "--scores", *paths, "--out-mean", f"{root}/am", "--out-final", f"{root}/final"])
    rows = {}
    for f in glob.glob(f"{root}/final/part-*.csv"):
        for line in open(f).read().splitlines()[1:]:
            cid, v = line.split(",")
            rows[int(cid)] = v
    assert rows == {0: "0.170000000", 1: "0.470000000"}
