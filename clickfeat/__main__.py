"""Command line for the end-to-end jobs.

    python -m clickfeat kernel1 --train T --supplement S --test X --out O
    python -m clickfeat kernel3 --train T --test X --out O --rounds 300
    python -m clickfeat blend --scores A B C --out-mean M --out-final F

On a cluster, a driver script submitted with spark-submit calls
``clickfeat.__main__.main([...])`` and the submitted session is used.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .plans import flows
from .session import checkpoint_dir, configure
from .sources.sinks import clear_tables
from .sources.store import release


def _session() -> SparkSession:
    """The session spark-submit configured (plain ``python`` gives local mode)."""
    spark = configure(SparkSession.builder.appName("clickfeat").getOrCreate())
    checkpoint_dir(spark)  # a shared folder on a cluster; fails early if unset there
    return spark


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="clickfeat")
    sub = ap.add_subparsers(dest="job", required=True)
    k1 = sub.add_parser("kernel1", help="30 features over train + supplement, score supplement, attach to test")
    k1.add_argument("--train", required=True)
    k1.add_argument("--supplement", required=True)
    k1.add_argument("--test", required=True)
    k1.add_argument("--out", required=True)
    k1.add_argument("--frm", type=int, default=0)
    k1.add_argument("--to", type=int, default=None)
    k1.add_argument("--val-size", type=int, default=5_000_000)
    k1.add_argument("--debug", action="store_true")
    k2 = sub.add_parser("kernel2", help="18 features over train + test, score test")
    k2.add_argument("--train", required=True)
    k2.add_argument("--test", required=True)
    k2.add_argument("--out", required=True)
    k2.add_argument("--frm", type=int, default=None)
    k2.add_argument("--to", type=int, default=None)
    k2.add_argument("--val-size", type=int, default=2_500_000)
    k2.add_argument("--debug", action="store_true")
    k3 = sub.add_parser("kernel3", help="35 features; validate, or refit N rounds with --rounds N")
    k3.add_argument("--train", required=True)
    k3.add_argument("--test")
    k3.add_argument("--out")
    k3.add_argument("--rounds", type=int, default=None)
    k3.add_argument("--frm", type=int, default=0)
    k3.add_argument("--to", type=int, default=None)
    k3.add_argument("--debug", action="store_true")
    bl = sub.add_parser("blend", help="blend score files")
    bl.add_argument("--scores", nargs="+", required=True)
    bl.add_argument("--weights", nargs="+", type=float)
    bl.add_argument("--out-mean")
    bl.add_argument("--out-final")
    a = ap.parse_args(argv)

    spark = _session()
    if a.job == "kernel1":
        r = flows.kernel1(spark, a.train, a.supplement, a.test, a.out, a.frm, a.to, a.val_size, a.debug)
        print(json.dumps({"best_iteration": r.best_iteration, "validation_auc": r.validation_auc}))
    elif a.job == "kernel2":
        r = flows.kernel2(spark, a.train, a.test, a.out, a.frm, a.to, a.val_size, a.debug)
        print(json.dumps({"best_iteration": r.best_iteration, "validation_auc": r.validation_auc}))
    elif a.job == "kernel3":
        r = flows.kernel3(spark, a.train, a.test, a.out, a.rounds, frm=a.frm, to=a.to, debug=a.debug)
        if r.best_iteration is not None:
            print(json.dumps({"best_iteration": r.best_iteration, "validation_auc": r.validation_auc}))
            r.importance.show(100, truncate=False)
    else:
        flows.blend_files(spark, a.scores, a.out_mean, a.out_final, a.weights)
    clear_tables(spark)
    release(spark)


if __name__ == "__main__":
    main()
