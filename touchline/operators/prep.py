"""Preprocessing as Spark ML stages: exact imputation, population scaling, selection.

The built-in Imputer has an approximate median and the built-in scaler divides by the
sample deviation; these stages compute exact fills and population moments with plain
aggregations and apply them as column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.plans.ordering import column_levels, exact_quantiles, narrow_scans

STRATEGIES = ("mean", "median", "most_frequent", "constant")


class _Columns(Params):
    columns = Param(Params._dummy(), "columns", "feature columns", TypeConverters.toListString)

    def _cols(self) -> list[str]:
        return self.getOrDefault(self.columns)


def _unpivot(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in cols])))


class ExactImputer(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Fill NULLs by mean, exact median, most frequent value (smallest on ties) or a constant."""

    strategy = Param(Params._dummy(), "strategy", "fill strategy", TypeConverters.toString)
    fillValue = Param(Params._dummy(), "fillValue", "constant fill", TypeConverters.toFloat)
    indicators = Param(Params._dummy(), "indicators", "add missing flags", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None, strategy: str = "median", fillValue: float = 0.0,
                 indicators: bool = False):
        super().__init__()
        self._setDefault(strategy="median", fillValue=0.0, indicators=False)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> ExactImputerModel:
        cols, how = self._cols(), self.getOrDefault(self.strategy)
        if how not in STRATEGIES:
            raise ValueError(f"strategy must be one of {STRATEGIES}")
        levels = column_levels(df, cols)
        kept = [c for c in cols if levels.counts[c]]  # columns without any value are dropped
        gaps = [c for c in kept if levels.counts[c] < levels.rows]
        if how == "constant":
            fills = {c: self.getOrDefault(self.fillValue) for c in kept}
        elif how == "mean":
            row = df.agg(*[F.avg(c).alias(c) for c in kept]).first()
            fills = {c: row[c] for c in kept}
        elif how == "median":
            fills = {c: levels.quantile(c, 0.5) for c in levels.few}
            fills |= {c: v[0] for c, v in exact_quantiles(df, {c: [0.5] for c in kept if c not in fills}).items()}
        else:
            counts = _unpivot(df, kept).filter("value IS NOT NULL").groupBy("name", "value").agg(F.count("*").alias("n"))
            top = counts.groupBy("name").agg(F.max_by("value", F.struct("n", -F.col("value"))).alias("fill")).collect()
            fills = {r["name"]: r["fill"] for r in top}  # one row per column
        return ExactImputerModel(
            columns=kept, fills=[float(fills[c]) for c in kept],
            flagged=gaps if self.getOrDefault(self.indicators) else [], dropped=[c for c in cols if c not in kept])


class ExactImputerModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    fills = Param(Params._dummy(), "fills", "fill per column", TypeConverters.toListFloat)
    flagged = Param(Params._dummy(), "flagged", "columns with a missing flag", TypeConverters.toListString)
    dropped = Param(Params._dummy(), "dropped", "columns without values", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None, fills: list[float] | None = None,
                 flagged: list[str] | None = None, dropped: list[str] | None = None):
        super().__init__()
        self._setDefault(flagged=[], dropped=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        flags = {f"{c}_missing": F.col(c).isNull().cast("double") for c in self.getOrDefault(self.flagged)}
        filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in zip(self._cols(), self.getOrDefault(self.fills))}
        out = df.withColumns(flags) if flags else df
        return out.withColumns(filled).drop(*self.getOrDefault(self.dropped))


class PopulationScaler(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """(x - mean) / population deviation; a zero deviation divides by 1."""

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> PopulationScalerModel:
        cols = self._cols()
        row = narrow_scans(df, {c: [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")] for c in cols})
        return PopulationScalerModel(columns=cols, means=[float(row[f"m_{c}"]) for c in cols],
                                     stds=[float(row[f"s_{c}"]) or 1.0 for c in cols])


class PopulationScalerModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    means = Param(Params._dummy(), "means", "mean per column", TypeConverters.toListFloat)
    stds = Param(Params._dummy(), "stds", "divisor per column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None, means: list[float] | None = None, stds: list[float] | None = None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _moments(self):
        return zip(self._cols(), self.getOrDefault(self.means), self.getOrDefault(self.stds))

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in self._moments()})

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * F.lit(s) + F.lit(m) for c, m, s in self._moments()})


def variance_select(df: DataFrame, cols: Sequence[str], threshold: float = 0.0) -> list[str]:
    """Columns whose population variance exceeds the threshold."""
    row = df.agg(*[F.var_pop(c).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] is not None and row[c] > threshold]


def custom_select(cols: Sequence[str], wanted: Sequence[str]) -> list[str]:
    return [c for c in cols if c in set(wanted)]


def feature_pipeline(cols: Sequence[str], *, strategy: str = "median", vector: str | None = "features") -> Pipeline:
    """Impute, scale and (unless ``vector`` is None) assemble; fit it on training rows only."""
    stages = [ExactImputer(columns=list(cols), strategy=strategy), PopulationScaler(columns=list(cols))]
    if vector:
        stages.append(VectorAssembler(inputCols=list(cols), outputCol=vector))
    return Pipeline(stages=stages)
