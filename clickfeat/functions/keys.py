"""Key helpers (P6, P7) and feature naming rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def composite_key_bucket(cols: Sequence[str], buckets: int = 2**26) -> Column:
    """``"a_b_c"`` text key hashed into ``buckets`` slots.

    Deterministic (the first 60 bits of the text's MD5, which any engine has),
    unlike a per-process salted string hash. Different keys can share a slot, as
    in the original; exact multi-column keys are the default everywhere else.
    """
    text = F.concat_ws("_", *[F.col(c).cast("string") for c in cols])
    number = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    return F.pmod(number, F.lit(buckets)).cast("long")


def wrap_unsigned(c: str | Column, bits: int) -> Column:
    """Reproduce an unsigned narrowing cast, which wraps modulo 2**bits.

    A plain Spark cast raises CAST_OVERFLOW under ANSI; this never does.
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.pmod(c.cast("long"), F.lit(2**bits)).cast("long")


def all_not_null(cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return cond


# Naming rules of the derived features (fixed formats).
def count_name(keys: Sequence[str]) -> str:
    return "{}count".format("_".join(keys))


def countuniq_name(keys: Sequence[str], value: str) -> str:
    return "{}_by_{}_countuniq".format("_".join(keys), value)


def cumcount_name(keys: Sequence[str], value: str) -> str:
    return "{}_by_{}_cumcount".format("_".join(keys), value)


def mean_name(keys: Sequence[str], value: str) -> str:
    return "{}_by_{}_mean".format("_".join(keys), value)


def var_name(keys: Sequence[str], value: str) -> str:
    return "{}_by_{}_var".format("_".join(keys), value)


def next_click_name(keys: Sequence[str]) -> str:
    return "{}_nextClick".format("_".join(keys))


def prev_click_name(keys: Sequence[str]) -> str:
    return "{}_prevClick".format("_".join(keys))
