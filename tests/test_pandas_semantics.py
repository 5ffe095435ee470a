"""Random click tables: Spark operators agree with pandas semantics.

pandas is the execution model of the original scripts; the expectations
here use its group-by idioms directly (shift, Timedelta.seconds, nunique,
var, skew, cumcount) on rows sorted by the order key (time, load position).
"""

import datetime as dt

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from clickfeat.operators.aggregates import Agg, add_group_features
from clickfeat.operators.ordered import GapSpec, SkewSplit, add_click_gaps, add_cumcount

T0 = dt.datetime(2017, 11, 6)

rows_strategy = st.lists(
    st.tuples(
        st.integers(0, 3),  # ip
        st.integers(0, 2),  # app
        st.integers(0, 200_000),  # seconds after T0 (collisions on purpose)
        st.integers(0, 23),  # hour-like value
    ),
    min_size=1,
    max_size=60,
)


def _expected(pdf: pd.DataFrame) -> pd.DataFrame:
    p = pdf.sort_values(["click_time", "row_id"]).copy()
    g = p.groupby(["ip", "app"])
    p["nxt"] = (g["click_time"].shift(-1) - p["click_time"]).dt.seconds
    p["prv"] = (p["click_time"] - g["click_time"].shift(1)).dt.seconds
    p["cc"] = g.cumcount()
    p["n"] = g["ip"].transform("size")
    p["u"] = g["v"].transform("nunique")
    p["var"] = g["v"].transform("var")
    p["skw"] = g["v"].transform(lambda s: s.skew())
    return p.set_index("row_id")


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_strategy, heavy=st.sampled_from([None, 2, 5]))
def test_random_tables_match_pandas(spark, rows, heavy):
    data = [(i, ip, app, T0 + dt.timedelta(seconds=s), v) for i, (ip, app, s, v) in enumerate(rows)]
    pdf = pd.DataFrame(data, columns=["row_id", "ip", "app", "click_time", "v"])
    df = spark.createDataFrame(data, "row_id long, ip long, app int, click_time timestamp_ntz, v int")
    skew = SkewSplit(enabled=False) if heavy is None else SkewSplit(heavy_rows=heavy)
    keys = ("ip", "app")
    out = add_click_gaps(df, [GapSpec(keys, "next", "nxt"), GapSpec(keys, "prev", "prv")], skew=skew)
    out = add_cumcount(out, list(keys), "cc", skew=skew)
    out = add_group_features(
        out,
        [Agg("count", keys, name="n"), Agg("nunique", keys, "v", "u"), Agg("var", keys, "v", "var"),
         Agg("skew", keys, "v", "skw")],
    )
    got = out.toPandas().set_index("row_id").sort_index()
    exp = _expected(pdf).sort_index()
    for col in ["nxt", "prv", "cc", "n", "u"]:
        a = got[col].astype("float64").to_numpy()
        b = exp[col].astype("float64").to_numpy()
        assert np.array_equal(np.nan_to_num(a, nan=-1), np.nan_to_num(b, nan=-1)), col
    for col in ["var", "skw"]:
        a = got[col].astype("float64").to_numpy()
        b = exp[col].astype("float64").to_numpy()
        assert np.allclose(np.nan_to_num(a, nan=-7), np.nan_to_num(b, nan=-7), atol=1e-9), col
