"""Preprocessing steps as pyspark.ml stages.

Fitted statistics are one number per column, so transforms are plain column
expressions inside whole-stage codegen: no join, no broadcast. Every stage works
in place on named double columns; vectors appear only at the learner boundary.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.feature import PCA, MaxAbsScaler, MinMaxScaler, RobustScaler, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import finite, ln_positive
from ..schema import LOG_COLUMNS
from .quantiles import exact_medians


class _Columns(Params):
    cols = Param(Params._dummy(), "cols", "columns to work on", TypeConverters.toListString)

    def getCols(self) -> list[str]:
        return self.getOrDefault(self.cols)


class _Fitted(_Columns):
    values = Param(Params._dummy(), "values", "fitted value per column", TypeConverters.toListFloat)

    def getValues(self) -> list[float]:
        return self.getOrDefault(self.values)


class MedianImputer(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Fills NULL and NaN with the exact median of the present values."""

    @keyword_only
    def __init__(self, *, cols: Sequence[str] = ()):
        super().__init__()
        self._set(cols=list(cols))

    def _fit(self, dataset: DataFrame) -> "MedianImputerModel":
        med = exact_medians(dataset, {c: F.nanvl(F.col(c), F.lit(None).cast("double"))
                                      for c in self.getCols()})
        empty = [c for c, v in med.items() if v is None]
        if empty:
            raise ValueError(f"columns without any value: {empty}")
        return MedianImputerModel(cols=self.getCols(), values=[float(med[c]) for c in self.getCols()])


class MedianImputerModel(Model, _Fitted, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, cols: Sequence[str] = (), values: Sequence[float] = ()):
        super().__init__()
        self._set(cols=list(cols), values=list(values))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({
            c: F.when(F.col(c).isNull() | F.isnan(c), F.lit(v)).otherwise(F.col(c))
            for c, v in zip(self.getCols(), self.getValues())})


class PopulationScaler(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Centres and divides by the population standard deviation; a constant column only centres."""

    @keyword_only
    def __init__(self, *, cols: Sequence[str] = ()):
        super().__init__()
        self._set(cols=list(cols))

    def _fit(self, dataset: DataFrame) -> "PopulationScalerModel":
        cols = self.getCols()
        row = dataset.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                          *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
        return PopulationScalerModel(
            cols=cols, values=[float(row[f"m{i}"]) for i in range(len(cols))],
            spreads=[float(row[f"s{i}"]) or 1.0 for i in range(len(cols))])


class PopulationScalerModel(Model, _Fitted, DefaultParamsReadable, DefaultParamsWritable):
    spreads = Param(Params._dummy(), "spreads", "divisor per column", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, cols: Sequence[str] = (), values: Sequence[float] = (),
                 spreads: Sequence[float] = ()):
        super().__init__()
        self._set(cols=list(cols), values=list(values), spreads=list(spreads))

    def getSpreads(self) -> list[float]:
        return self.getOrDefault(self.spreads)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({
            c: (F.col(c) - F.lit(m)) / F.lit(s)
            for c, m, s in zip(self.getCols(), self.getValues(), self.getSpreads())})


class ShiftLog(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """log(x - min + eps), with the minimum over the finite training values.

    Columns that were dropped before are skipped.
    """

    eps = Param(Params._dummy(), "eps", "offset above the minimum", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, cols: Sequence[str] = (), eps: float = 0.1):
        super().__init__()
        self._set(cols=list(cols), eps=eps)

    def _fit(self, dataset: DataFrame) -> "ShiftLogModel":
        cols = [c for c in self.getCols() if c in dataset.columns]
        if not cols:
            return ShiftLogModel(cols=[], values=[])
        row = dataset.agg(*[F.min(F.when(finite(c), F.col(c))).alias(f"d{i}")
                            for i, c in enumerate(cols)]).first()
        eps = self.getOrDefault(self.eps)
        return ShiftLogModel(cols=cols, values=[eps - row[f"d{i}"] for i in range(len(cols))])


class ShiftLogModel(Model, _Fitted, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the fitted shift and takes the log; NULL where that is not a finite positive number."""

    @keyword_only
    def __init__(self, *, cols: Sequence[str] = (), values: Sequence[float] = ()):
        super().__init__()
        self._set(cols=list(cols), values=list(values))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumns({
            c: F.when(finite(c), ln_positive(F.col(c) + F.lit(v)))
            for c, v in zip(self.getCols(), self.getValues())})


class LogColumns(Transformer, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Natural log of the listed columns that are present; NULL for non-positive values."""

    @keyword_only
    def __init__(self, *, cols: Sequence[str] = tuple(LOG_COLUMNS)):
        super().__init__()
        self._set(cols=list(cols))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        here = [c for c in self.getCols() if c in dataset.columns]
        return dataset.withColumns({c: ln_positive(c) for c in here}) if here else dataset


class ColumnFunction(Transformer, _Columns):
    """A user function Column -> Column applied to each listed column that is present.

    The function is code, so this stage is not written with a saved pipeline.
    """

    def __init__(self, f: Callable[[Column], Column], cols: Sequence[str]):
        super().__init__()
        self.f = f
        self._set(cols=list(cols))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        here = [c for c in self.getCols() if c in dataset.columns]
        return dataset.withColumns({c: self.f(F.col(c)) for c in here}) if here else dataset


def select_features(df: DataFrame, features: Sequence[str], *keep: str) -> DataFrame:
    """The feature columns present in the frame as doubles, and the columns to keep."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in features if c in df.columns])


def feature_list(df: DataFrame, *targets: str) -> list[str]:
    """Every column that is not a target, label or id."""
    return [c for c in df.columns if c not in set(targets)]


def assembler(cols: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error")


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Adds the vector of the named columns; any missing value is an error."""
    return assembler(cols, out).transform(df)


def scaler_stages(cols: Sequence[str], scaler: str = "standard", out: str = "features") -> list:
    """Stages that scale `cols` and assemble them: standard, minmax, robust, maxabs or none."""
    if scaler == "standard":
        return [PopulationScaler(cols=list(cols)), assembler(cols, out)]
    if scaler == "none":
        return [assembler(cols, out)]
    kinds = {"minmax": MinMaxScaler, "maxabs": MaxAbsScaler,
             "robust": lambda **kw: RobustScaler(withCentering=True, **kw)}
    raw = f"{out}_raw"
    return [assembler(cols, raw), kinds[scaler](inputCol=raw, outputCol=out)]


def pca(k: int, input_col: str = "features", out: str = "pca") -> PCA:
    """k principal components; scale first, the projection itself does not centre."""
    return PCA(k=k, inputCol=input_col, outputCol=out)


def explained_variance(model, spark) -> DataFrame:
    """(component, ratio, cumulative) from a fitted PCA; one row per component."""
    ratios = [float(v) for v in model.explainedVariance]
    rows, total = [], 0.0
    for i, v in enumerate(ratios):
        total += v
        rows.append((i + 1, v, total))
    return spark.createDataFrame(rows, "component int, ratio double, cumulative double")


class FoldSafe:
    """Median and scale statistics of every training set of a fold plan.

    Training set f is all rows with fold != f. All k sets are measured in the same
    passes by conditional aggregates, so no row is copied k times.
    """

    def __init__(self, medians: Mapping, means: Mapping, spreads: Mapping, cols, fold, folds):
        self.medians, self.means, self.spreads = medians, means, spreads
        self.cols, self.fold, self.folds = list(cols), fold, list(folds)

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str], fold: str, k: int, scale: bool = True) -> "FoldSafe":
        """Without `scale` columns are neither centred nor divided, and only the medians are measured."""
        folds = range(k)
        value = {c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in cols}
        med = exact_medians(df, {f"{c}@{f}": F.when(F.col(fold) != f, value[c])
                                 for c in cols for f in folds})
        if not scale:
            every = [(c, f) for c in cols for f in folds]
            return cls({(c, f): med[f"{c}@{f}"] for c, f in every}, dict.fromkeys(every, 0.0), dict.fromkeys(every, 1.0),
                       cols, fold, folds)
        aggs = []
        for c in cols:
            for f in folds:
                filled = F.when(F.col(fold) != f, F.coalesce(value[c], F.lit(med[f"{c}@{f}"])))
                aggs += [F.avg(filled).alias(f"m_{c}@{f}"), F.stddev_pop(filled).alias(f"s_{c}@{f}")]
        row = df.agg(*aggs).first()
        pick = lambda prefix: {(c, f): row[f"{prefix}_{c}@{f}"] for c in cols for f in folds}
        return cls({(c, f): med[f"{c}@{f}"] for c in cols for f in folds}, pick("m"), pick("s"),
                   cols, fold, folds)

    def _by_fold(self, stats: Mapping, c: str) -> Column:
        out = F.lit(None).cast("double")
        for f in self.folds:
            out = F.when(F.col(self.fold) == f, F.lit(stats[c, f])).otherwise(out)
        return out

    def held_out(self, df: DataFrame) -> DataFrame:
        """Every row transformed with the statistics of the training set that excludes it."""
        exprs = {}
        for c in self.cols:
            x = F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")), self._by_fold(self.medians, c))
            spread = self._by_fold(self.spreads, c)
            exprs[c] = (x - self._by_fold(self.means, c)) / F.when(spread == 0, F.lit(1.0)).otherwise(spread)
        return df.withColumns(exprs)

    def frame(self, df: DataFrame, f: int) -> DataFrame:
        """All rows transformed with training set f; rows with fold == f are its test rows."""
        return df.withColumns({
            c: (F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")), F.lit(self.medians[c, f]))
                - F.lit(self.means[c, f])) / F.lit(self.spreads[c, f] or 1.0)
            for c in self.cols})


def class_weights(df: DataFrame, label: str, mode: str | Mapping[int, float] | float = "balanced",
                  out: str = "weight") -> DataFrame:
    """Adds the weight every learner shares.

    balanced: n / (2 n_c). A mapping gives weights per class. A number weighs the
    positives against 1 for the rest.
    """
    y = F.col(label) == 1
    if mode == "balanced":
        row = df.agg(F.count_if(y).alias("p"), F.count_if(~y).alias("n")).first()
        total = row["p"] + row["n"]
        pos, neg = total / (2.0 * row["p"]), total / (2.0 * row["n"])
    elif isinstance(mode, Mapping):
        pos, neg = float(mode[1]), float(mode[0])
    else:
        pos, neg = float(mode), 1.0
    return df.withColumn(out, F.when(y, F.lit(pos)).otherwise(F.lit(neg)))


class ClassWeights(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Weighs the positives with a number against 1; rows without a label, as in scoring, weigh 1."""

    label = Param(Params._dummy(), "label", "label column", TypeConverters.toString)
    weight = Param(Params._dummy(), "weight", "weight of the positives", TypeConverters.toFloat)
    out = Param(Params._dummy(), "out", "weight column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, label: str = "label", weight: float = 1.0, out: str = "weight"):
        super().__init__()
        self._set(label=label, weight=weight, out=out)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        label, weight, out = (self.getOrDefault(p) for p in (self.label, self.weight, self.out))
        if label not in dataset.columns:
            return dataset.withColumn(out, F.lit(1.0))
        return class_weights(dataset, label, weight, out)
