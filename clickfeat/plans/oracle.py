"""DuckDB text for feature specs, used as the independent oracle of the queries.

Each spec becomes plain window / group-by SQL that DuckDB evaluates on the
same parquet tables; nothing here runs on Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..operators.aggregates import Agg
from .specs import CumCount, Gap, InTestHH, NextClick, Shift, spec_name

ORDER = "click_time, row_id"


def _q(c: str) -> str:
    return f'"{c}"'


def _keys(keys: Sequence[str]) -> str:
    return ", ".join(_q(k) for k in keys)


def window_sql(s) -> str:
    w = f"PARTITION BY {_keys(s.keys)} ORDER BY {ORDER}"
    if isinstance(s, Gap):
        if s.direction == "next":
            diff = f"epoch_us(lead(click_time) OVER ({w})) - epoch_us(click_time)"
        else:
            diff = f"epoch_us(click_time) - epoch_us(lag(click_time) OVER ({w}))"
        return f"CAST((({diff}) // 1000000) % 86400 AS FLOAT)"
    if isinstance(s, CumCount):
        return f"CAST(row_number() OVER ({w}) - 1 AS BIGINT)"
    if isinstance(s, NextClick):
        e = "(epoch_us(click_time) // 1000000)"
        return f"CAST(COALESCE(lead({e}) OVER ({w}), 3000000000) - {e} AS BIGINT)"
    raise TypeError(s)


def agg_sql(a: Agg) -> str:
    v = _q(a.value) if a.value else None
    if a.kind == "count":
        return "COUNT(*)"
    if a.kind == "nonnull":
        return f"COUNT({v})"
    if a.kind == "nunique":
        return f"COUNT(DISTINCT {v})"
    if a.kind == "mean":
        return f"AVG(CAST({v} AS DOUBLE))"
    if a.kind == "var":
        return f"VAR_SAMP(CAST({v} AS DOUBLE))"
    if a.kind == "skew":
        x = f"CAST({v} AS DOUBLE)"
        return (
            f"CASE WHEN COUNT({x}) < 3 THEN NULL WHEN VAR_POP({x}) = 0 THEN 0.0 "
            f"ELSE SKEWNESS({x}) END"
        )
    return f"{a.kind.upper()}({v})"


ROUNDED_KINDS = ("mean", "var", "skew")


def features_sql(base_cte: str, specs: Sequence, out_cols: Sequence[str], round_to: int = 6) -> str:
    """SQL selecting ``out_cols`` after attaching every spec to ``base``.

    ``base_cte`` defines a CTE named ``base``.
    """
    proj = []
    for s in specs:
        if isinstance(s, InTestHH):
            proj.append(
                f"CASE WHEN {_q(s.hour)} IN (4,5,9,10,13,14) THEN 1 WHEN {_q(s.hour)} IN (6,11,15) THEN 2 ELSE 3 END AS {_q(s.out)}"
            )
    wins = [f"{window_sql(s)} AS {_q(s.out)}" for s in specs if isinstance(s, (Gap, CumCount, NextClick))]
    ctes = [base_cte, f"b1 AS (SELECT *{''.join(', ' + p for p in proj)} FROM base)"]
    ctes.append(f"b2 AS (SELECT *{''.join(', ' + w for w in wins)} FROM b1)")
    joins, cur = [], "b2"
    aggs = [s for s in specs if isinstance(s, Agg)]
    for i, a in enumerate(aggs):
        t = f"g{i}"
        joins.append(
            f"{t} AS (SELECT {_keys(a.keys)}, {agg_sql(a)} AS {_q(a.name)} FROM b1 GROUP BY {_keys(a.keys)})"
        )
    ctes.extend(joins)
    frm = cur
    for i, a in enumerate(aggs):
        frm += f" LEFT JOIN g{i} USING ({_keys(a.keys)})"
    ctes.append(f"b3 AS (SELECT * FROM {frm})")
    shifts = [s for s in specs if isinstance(s, Shift)]
    sh = "".join(f", CAST(lag({_q(s.value)}) OVER (ORDER BY {ORDER}) AS DOUBLE) AS {_q(s.out)}" for s in shifts)
    ctes.append(f"b4 AS (SELECT *{sh} FROM b3)")
    kinds = {a.name: a.kind for a in aggs}
    sel = []
    for c in out_cols:
        if kinds.get(c) in ROUNDED_KINDS:
            sel.append(f"ROUND({_q(c)}, {round_to}) AS {_q(c)}")
        else:
            sel.append(_q(c))
    return "WITH " + ",\n".join(ctes) + f"\nSELECT {', '.join(sel)} FROM b4"


def output_columns(specs: Sequence, lead: Sequence[str] = ("click_id",)) -> list[str]:
    return list(lead) + [spec_name(s) for s in specs]
