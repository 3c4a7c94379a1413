"""One surface for all fits: an Estimator that takes a table of cells and gives a Model, both of which can be saved and loaded.

    model = BooleanFactorization(method="asso", k=3, rowCol="user", colCol="item", options={"tau": 0.5}).fit(table)
    model.transform(cells)                     # the cells with `prediction`
    model.evaluate(cells, ["F1"], task="prediction")
    model.rounds({"train": table, "test": held_out}, ["F1"])   # a log row for each pattern, part and metric
    model.write().save(path); BooleanFactorizationModel.load(path)

A fit can start from a model (`setInitialModel`, also of a path): patterns or factors go on from there."""

from __future__ import annotations

import inspect
import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, functions as F

from ..operators import algebra, metrics
from ..operators.matrix import BoolMatrix
from . import continuous, greedy

#: Fits of patterns: (matrix, k, options) to a Fit.
GREEDY = {
    "asso": lambda x, k, o: greedy.asso(x, k, **o),
    "asso_transposed": lambda x, k, o: greedy.transposed(greedy.asso, x, k, **o),
    "grecond": lambda x, k, o: greedy.grecond(x, k, **o),
    "grecond_plus": lambda x, k, o: greedy.grecond_plus(x, k, **o),
    "hyper": lambda x, k, o: greedy.hyper(x, k=k, **o),
    "panda": lambda x, k, o: greedy.panda(x, k, **o),
    "mebf": lambda x, k, o: greedy.mebf(x, k, **o),
}
#: Fits that change a given model's patterns.
REFINING = {"asso_iter": lambda x, k, o, fit: greedy.asso_iter(x, fit, **o), "hyper_plus": lambda x, k, o, fit: greedy.hyper_plus(x, fit, k, **o)}
#: Fits of real factors, which start anew or from given ones.
CONTINUOUS = {"nmf": continuous.nmf, "penalty": continuous.penalty, "elbmf": continuous.elbmf, "faststep": continuous.faststep}
METHODS = (*GREEDY, *REFINING, *CONTINUOUS)


class _Columns(Params):
    rowCol = Param(Params._dummy(), "rowCol", "column of row ids", typeConverter=TypeConverters.toString)
    colCol = Param(Params._dummy(), "colCol", "column of column ids", typeConverter=TypeConverters.toString)
    valueCol = Param(Params._dummy(), "valueCol", "column that is above 0 for ones; none: every row is a one", typeConverter=TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "column of predictions", typeConverter=TypeConverters.toString)
    threshold = Param(Params._dummy(), "threshold", "above it, a real factor's value belongs to the pattern", typeConverter=TypeConverters.toFloat)

    def _matrix(self, dataset: DataFrame | BoolMatrix) -> BoolMatrix:
        if isinstance(dataset, BoolMatrix):
            return dataset
        value = self.getOrDefault("valueCol")
        return BoolMatrix.of(dataset, self.getOrDefault("rowCol"), self.getOrDefault("colCol"), value or None)


class BooleanFactorization(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """k patterns (rows x columns) of a Boolean matrix by any of METHODS. options: the method's own arguments."""

    method = Param(Params._dummy(), "method", f"one of {', '.join(METHODS)}", typeConverter=TypeConverters.toString)
    k = Param(Params._dummy(), "k", "number of patterns; 0: until all is covered", typeConverter=TypeConverters.toInt)
    options = Param(Params._dummy(), "options", "arguments of the method, as JSON", typeConverter=lambda v: v if isinstance(v, str) else json.dumps(v, sort_keys=True))

    @keyword_only
    def __init__(self, *, method="asso", k=0, options=None, rowCol="i", colCol="j", valueCol="", predictionCol="prediction", threshold=0.5):
        super().__init__()
        self.initial = None
        self._setDefault(method="asso", k=0, options="{}", rowCol="i", colCol="j", valueCol="", predictionCol="prediction", threshold=0.5)
        self._set(**{n: v for n, v in self._input_kwargs.items() if v is not None})

    def setInitialModel(self, model: BooleanFactorizationModel | str) -> BooleanFactorization:
        """The model, or the folder of one, that the fit goes on from."""
        self.initial = BooleanFactorizationModel.load(model) if isinstance(model, str) else model
        return self

    def _fit(self, dataset: DataFrame | BoolMatrix) -> BooleanFactorizationModel:
        x, method, k = self._matrix(dataset), self.getOrDefault("method"), self.getOrDefault("k")
        o = json.loads(self.getOrDefault("options"))
        if method in CONTINUOUS:
            fit = CONTINUOUS[method]
            if self.initial is not None:
                if self.initial.real is None or "u" not in inspect.signature(fit).parameters:
                    raise ValueError(f"{method} cannot start from this model")
                o |= dict(zip(("u", "v"), self.initial.real, strict=True))
                k = self.initial.k
            u, v, errors = fit(x, k, **o)
            made = [continuous.boolean(s, key, k, self.getOrDefault("threshold")) for s, key in ((u, "i"), (v, "j"))]
            model = BooleanFactorizationModel(*made, k, [{"round": n, "error": float(e)} for n, e in enumerate(errors)], (u, v))
        else:
            if method in REFINING:
                if self.initial is None:
                    raise ValueError(f"{method} starts from a model")
                fit = REFINING[method](x, k or self.initial.k, o, greedy.Fit(self.initial.u, self.initial.v, self.initial.k, list(self.initial.log)))
            elif method in GREEDY:
                fit = GREEDY[method](x, k or None, o)
            else:
                raise ValueError(f"unknown method: {method}")
            none = [s.select(key).limit(0).withColumn("f", F.lit(0)) for s, key in ((x.rows, "i"), (x.cols, "j"))]
            model = BooleanFactorizationModel(*(none if fit.u is None else (fit.u, fit.v)), fit.k, fit.log)
        return self._copyValues(model)


class BooleanFactorizationModel(Model, _Columns, MLReadable, MLWritable):
    """u (i, f), v (j, f), k, the fit's log, and the real factors if the method has some."""

    def __init__(self, u: DataFrame, v: DataFrame, k: int, log: list | None = None, real: tuple[DataFrame, DataFrame] | None = None):
        super().__init__()
        self.u, self.v, self.k, self.log, self.real = u, v, k, log or [], real
        self._setDefault(rowCol="i", colCol="j", valueCol="", predictionCol="prediction", threshold=0.5)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        row, col = self.getOrDefault("rowCol"), self.getOrDefault("colCol")
        cells = dataset.select(F.col(row).alias("i"), F.col(col).alias("j")).distinct()
        told = algebra.predicted(cells, self.u, self.v).select(F.col("i").alias("__i"), F.col("j").alias("__j"), F.col("hit").cast("int").alias(self.getOrDefault("predictionCol")))
        return dataset.join(told, dataset[row].eqNullSafe(F.col("__i")) & dataset[col].eqNullSafe(F.col("__j")), "left").drop("__i", "__j")

    def counts(self, dataset: DataFrame | BoolMatrix, task: str = "reconstruction", upto: int | None = None) -> DataFrame:
        """p, q, tp, n: over all cells of the matrix, or (prediction) over those that it stores; of the first patterns, if so asked."""
        x = self._matrix(dataset)
        u, v = (self.u, self.v) if upto is None else (s.filter(F.col("f") < upto) for s in (self.u, self.v))
        if task == "prediction":
            return metrics.stored_counts(x.cells, u, v)
        if task != "reconstruction":
            raise ValueError(f"unknown task: {task}")
        return metrics.factor_counts(x.ones, u, v, x.m * x.n)

    def evaluate(self, dataset: DataFrame | BoolMatrix, names=("Recall", "Precision", "Accuracy", "F1"), task: str = "reconstruction") -> DataFrame:
        return metrics.metrics(self.counts(dataset, task), names)

    def rounds(self, parts: dict[str, DataFrame | BoolMatrix], names=("F1",), task: str = "reconstruction", df_name: str = "updates") -> DataFrame:
        """df_name, step, split, metric, value, ts: how good the first 1, 2, .. patterns are on each part."""
        out = None
        for n in range(1, self.k + 1):
            for part, data in parts.items():
                one = metrics.log_rows(df_name, n, part, metrics.metrics(self.counts(data, task, n), names))
                out = one if out is None else out.unionByName(one)
        return out

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: BooleanFactorizationModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        plain = json.loads(json.dumps(m.log, default=str))
        DefaultParamsWriter.saveMetadata(m, path, self.sc, extraMetadata={"k": m.k, "log": plain, "real": m.real is not None})
        for name, df in (("u", m.u), ("v", m.v), *(zip(("real_u", "real_v"), m.real) if m.real else ())):
            df.write.parquet(f"{path}/{name}")


class _Reader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> BooleanFactorizationModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession, self.cls.__module__ + "." + self.cls.__name__)
        read = lambda name: self.sparkSession.read.parquet(f"{path}/{name}")
        model = self.cls(read("u"), read("v"), meta["k"], meta["log"], (read("real_u"), read("real_v")) if meta["real"] else None)
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        return model
