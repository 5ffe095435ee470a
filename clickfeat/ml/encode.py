"""M1: predictors as numbers, by declared encodings.

* codes: dense codes of a nominal predictor's values (``dense_codes``, a table,
  not a driver dictionary), one more code for unseen values and NULL;
* rates: the smoothed label rate of a predictor's value, out of fold: a train
  row's rate leaves out its own fold, any other row's takes all train rows.
  NULL is a value of its own; an unseen value has the overall rate;
* numbers: the value, ``MISSING`` where it is NULL, and beside each number that
  is NULL in some train row a flag that says so.

Which predictor is encoded how is a parameter and does not follow the data's
size. Everything fitted is a table with one row per value, joined to the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.encode import dense_codes
from ..sources.sinks import materialize

MISSING = -1.0
SMOOTHING = 20.0  # rows of the overall rate that every value's rate holds, so that rare values do not carry their label
FOLDS = 5


@dataclass(frozen=True)
class Encoding:
    codes: tuple[str, ...] = ()
    rates: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()

    @classmethod
    def of(cls, predictors: Sequence[str], categorical: Sequence[str], rates: Sequence[str] = ()) -> Encoding:
        cats = [p for p in predictors if p in set(categorical)]
        return cls(tuple(c for c in cats if c not in set(rates)), tuple(c for c in cats if c in set(rates)), tuple(p for p in predictors if p not in set(cats)))


def _fold(fold: str | Column, folds: int) -> Column:
    f = F.col(fold) if isinstance(fold, str) else fold
    return F.pmod(f.cast("long"), F.lit(folds)).cast("int")


@dataclass
class Encoder:
    """Fitted tables of an encoding; ``names``: the predictor or flag of every slot of the vector."""

    encoding: Encoding
    fold: str | Column
    folds: int
    smoothing: float
    dictionaries: dict[str, DataFrame] = field(default_factory=dict)  # value, code
    sizes: dict[str, int] = field(default_factory=dict)
    sums: dict[str, DataFrame] = field(default_factory=dict)  # value, s, n, own (s and n by fold)
    overall: list[tuple[float, int]] = field(default_factory=list)  # label sum and rows by fold
    flags: tuple[str, ...] = ()

    @classmethod
    def fit(cls, train: DataFrame, encoding: Encoding, label: str, fold: str | Column = "row_id", folds: int = FOLDS, smoothing: float = SMOOTHING) -> Encoder:
        self = cls(encoding, fold, folds, smoothing)
        for c in encoding.codes:
            table = materialize(dense_codes(train, c), "codes")
            self.dictionaries[c], self.sizes[c] = table, table.count()
        rows = train.withColumns({"__y": F.col(label).cast("double"), "__f": _fold(fold, folds) if encoding.rates else F.lit(0)})
        part = lambda f: F.struct(F.coalesce(F.sum(F.when(F.col("__f") == f, F.col("__y"))), F.lit(0.0)).alias("s"), F.count(F.when(F.col("__f") == f, F.col("__y"))).alias("n"))
        one = rows.agg(F.array(*[part(f) for f in range(folds)]).alias("own"), *[F.count(F.when(F.col(c).isNull(), 1)).alias(f"null{i}") for i, c in enumerate(encoding.numbers)]).first()
        self.overall = [(p["s"], p["n"]) for p in one["own"]]
        self.flags = tuple(c for i, c in enumerate(encoding.numbers) if one[f"null{i}"])
        for c in encoding.rates:
            table = rows.groupBy(F.col(c).alias("value")).agg(F.coalesce(F.sum("__y"), F.lit(0.0)).alias("s"), F.count("__y").alias("n"), F.array(*[part(f) for f in range(folds)]).alias("own"))
            self.sums[c] = materialize(table, "rates")
        return self

    @property
    def names(self) -> list[str]:
        e = self.encoding
        return [*e.codes, *e.rates, *e.numbers, *[f"{c}__null" for c in self.flags]]

    def columns(self, df: DataFrame, train: Column | bool = False) -> DataFrame:
        """Adds ``c__code``, ``c__rate``, ``c__num`` and ``c__null``; ``train``: rows whose rates leave out their fold."""
        train = F.lit(train) if isinstance(train, bool) else train
        for c, table in self.dictionaries.items():
            size = self.sizes[c]
            df = df.join(table.withColumnsRenamed({c: "__value", "code": "__code"}), F.col(c) == F.col("__value"), "left")
            nominal = {"ml_attr": {"type": "nominal", "num_vals": size + 1}}
            df = df.withColumn(f"{c}__code", F.coalesce("__code", F.lit(size)).cast("double").alias(f"{c}__code", metadata=nominal)).drop("__value", "__code")
        s, n = sum(p[0] for p in self.overall), sum(p[1] for p in self.overall)
        rate = lambda s, n: s / n if n else 0.0
        f = _fold(self.fold, self.folds) if self.sums else None
        for c, table in self.sums.items():
            df = df.join(table.withColumnRenamed("value", "__value"), F.col(c).eqNullSafe(F.col("__value")), "left")
            own = F.element_at("own", f + 1)
            prior = F.when(train, F.element_at(F.array(*[F.lit(rate(s - a, n - b)) for a, b in self.overall]), f + 1)).otherwise(F.lit(rate(s, n)))
            ys = F.coalesce("s", F.lit(0.0)) - F.when(train, F.coalesce(own["s"], F.lit(0.0))).otherwise(F.lit(0.0))
            rows = F.coalesce("n", F.lit(0)) - F.when(train, F.coalesce(own["n"], F.lit(0))).otherwise(F.lit(0))
            df = df.withColumn(f"{c}__rate", (ys + F.lit(self.smoothing) * prior) / (rows + F.lit(self.smoothing))).drop("__value", "s", "n", "own")
        df = df.withColumns({f"{c}__num": F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in self.encoding.numbers})
        return df.withColumns({f"{c}__null": F.col(c).isNull().cast("double") for c in self.flags})

    def transform(self, df: DataFrame, train: Column | bool = False, features: str = "features") -> DataFrame:
        e = self.encoding
        inputs = [*[f"{c}__code" for c in e.codes], *[f"{c}__rate" for c in e.rates], *[f"{c}__num" for c in e.numbers], *[f"{c}__null" for c in self.flags]]
        return VectorAssembler(inputCols=inputs, outputCol=features, handleInvalid="keep").transform(self.columns(df, train)).drop(*inputs)
