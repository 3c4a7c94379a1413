"""Quality of a prediction. Everything follows from four counts, so neither the inverse nor the m x n grid is ever made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import ratio
from . import algebra

NAMES = ("TP", "FP", "TN", "FN", "TPR", "TNR", "FPR", "FNR", "PPV", "ACC", "ERR", "F1", "RMSE", "MAE")
ALIASES = {"Recall": "TPR", "Precision": "PPV", "Accuracy": "ACC", "recall_score": "TPR", "precision_score": "PPV", "accuracy_score": "ACC", "f1_score": "F1"}


def formulas(p: Column, q: Column, tp: Column, n: Column) -> dict[str, Column]:
    """All metrics from: ones of the truth, ones of the prediction, ones of both, cells."""
    fp, fn, tn = q - tp, p - tp, n - p - q + tp
    tpr, tnr, ppv, err = ratio(tp, p), ratio(tn, n - p), ratio(tp, q), ratio(fp + fn, n)
    return {
        "TP": tp, "FP": fp, "TN": tn, "FN": fn, "TPR": tpr, "TNR": tnr, "FPR": 1.0 - tnr, "FNR": 1.0 - tpr, "PPV": ppv,
        "ACC": 1.0 - err, "ERR": err, "F1": ratio(2 * tpr * ppv, tpr + ppv), "RMSE": F.sqrt(err), "MAE": err,
    }


def metrics(counts: DataFrame, names=NAMES) -> DataFrame:
    """The named metrics beside the other columns of counts (p, q, tp, n)."""
    made = formulas(*(F.col(c) for c in ("p", "q", "tp", "n")))
    unknown = [x for x in names if ALIASES.get(x, x) not in made]
    if unknown:
        raise ValueError(f"unknown metrics: {unknown}")
    rest = [c for c in counts.columns if c not in ("p", "q", "tp", "n")]
    return counts.select(*rest, *[made[ALIASES.get(x, x)].alias(x) for x in names])


def counts(truth: DataFrame, prediction: DataFrame, n_cells: int | Column, by: str | None = None, keys: DataFrame | None = None) -> DataFrame:
    """p, q, tp and n; by: for each row ('i') or column ('j') of keys. n_cells: cells of the whole or of each key."""
    marked = truth.select("i", "j", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(prediction.select("i", "j", F.lit(0).alias("a"), F.lit(1).alias("b")))
    cells = marked.groupBy("i", "j").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in (("p", F.col("a")), ("q", F.col("b")), ("tp", F.col("a") * F.col("b")))]
    n = n_cells if isinstance(n_cells, Column) else F.lit(n_cells)
    if by is None:
        return cells.agg(*sums).withColumn("n", n.cast("bigint"))
    out = keys.join(cells.groupBy(by).agg(*sums), by, "left")
    return out.select(by, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("p", "q", "tp")], n.cast("bigint").alias("n"))


def factor_counts(ones: DataFrame, u: DataFrame, v: DataFrame, n_cells: int) -> DataFrame:
    """The same for the product of u and v, which is not made: predicted cells are counted over pairs of distinct masks."""
    groups = [algebra.masks(s, k).groupBy("mask").count().withColumnsRenamed({"mask": f"__{k}", "count": f"__n{k}"}) for s, k in ((u, "i"), (v, "j"))]
    pairs = algebra.hit_pairs(groups[0], "__i", groups[1], "__j")
    q = pairs.agg(F.coalesce(F.sum(F.col("__ni") * F.col("__nj")), F.lit(0)).alias("q"))
    both = algebra.predicted(ones, u, v).agg(F.count(F.lit(1)).alias("p"), F.coalesce(F.sum(F.col("hit").cast("bigint")), F.lit(0)).alias("tp"))
    return both.crossJoin(q).withColumn("n", F.lit(n_cells).cast("bigint"))


def stored_counts(cells: DataFrame, u: DataFrame, v: DataFrame) -> DataFrame:
    """For the task of prediction: only stored cells count, ones and known zeros."""
    hit = F.col("hit").cast("bigint")
    return algebra.predicted(cells, u, v).agg(
        F.coalesce(F.sum("x"), F.lit(0)).cast("bigint").alias("p"), F.coalesce(F.sum(hit), F.lit(0)).alias("q"), F.coalesce(F.sum(hit * F.col("x")), F.lit(0)).alias("tp"), F.count(F.lit(1)).alias("n")
    )


def real_errors(truth: DataFrame, prediction: DataFrame, n_cells: int) -> DataFrame:
    """RMSE and MAE of a real prediction (i, j, x) over all cells."""
    d = F.coalesce(F.col("a.x"), F.lit(0)) - F.coalesce(F.col("b.x"), F.lit(0))
    joined = truth.alias("a").join(prediction.alias("b"), (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j")), "full")
    return joined.agg(F.sqrt(F.sum(d * d) / n_cells).alias("RMSE"), (F.sum(F.abs(d)) / n_cells).alias("MAE"))


def description_length(counted: DataFrame, model_size: Column | int, w_model=1.0, w_fp=1.0, w_fn=1.0) -> DataFrame:
    size = model_size if isinstance(model_size, Column) else F.lit(model_size)
    return counted.select((w_model * size + w_fp * (F.col("q") - F.col("tp")) + w_fn * (F.col("p") - F.col("tp"))).cast("double").alias("description_length"))


def weighted_error(w_fp: float, w_fn: float | None = None) -> Column:
    return (w_fp * (F.col("q") - F.col("tp")) + (1 - w_fp if w_fn is None else w_fn) * (F.col("p") - F.col("tp"))).cast("double")


def coverage_score(w_fp: float, w_fn: float | None = None) -> Column:
    return ((1 - w_fp if w_fn is None else w_fn) * F.col("tp") - w_fp * (F.col("q") - F.col("tp"))).cast("double")


def weighted_score(scores: DataFrame) -> DataFrame:
    """Sum of w * s."""
    return scores.agg(F.sum(F.col("w") * F.col("s")).alias("score"))


def harmonic_score(scores: DataFrame) -> DataFrame:
    """Harmonic mean of s; 0 if any is 0."""
    safe = F.when(F.min("s") == 0, 0.0).otherwise(F.count(F.lit(1)) / F.sum(F.try_divide(F.lit(1.0), F.col("s"))))
    return scores.agg(safe.alias("score"))


def log_rows(df_name: str, step: int, split: str, row: DataFrame) -> DataFrame:
    """One row a metric: df_name, step, split, metric, value, ts."""
    cols = row.columns
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in cols]))
    return row.select(pairs.alias("m")).select(F.lit(df_name).alias("df_name"), F.lit(step).alias("step"), F.lit(split).alias("split"), "m.metric", "m.value", F.current_timestamp().alias("ts"))
