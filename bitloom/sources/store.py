"""Saving matrices, models and logs, and finding them again."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.matrix import BoolMatrix


def save_matrix(matrix: BoolMatrix, path: str, overwrite: bool = False) -> None:
    mode = "overwrite" if overwrite else "errorifexists"
    for name, df in (("cells", matrix.cells), ("rows", matrix.rows), ("cols", matrix.cols)):
        df.write.mode(mode).parquet(f"{path}/{name}")


def load_matrix(spark: SparkSession, path: str) -> BoolMatrix:
    return BoolMatrix(*(spark.read.parquet(f"{path}/{name}") for name in ("cells", "rows", "cols")))


def save_model(root: str, name: str, u: DataFrame, v: DataFrame, params: dict, registry: str = "registry") -> str:
    """Writes the factors below root/name/<time> and adds a row to the registry; returns the path."""
    spark = u.sparkSession
    stamp = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyyMMdd-HHmmssSSS").alias("t")).first()["t"]
    path = f"{root}/{name}/{stamp}"
    u.write.parquet(f"{path}/u")
    v.write.parquet(f"{path}/v")
    row = spark.range(1).select(F.lit(name).alias("name"), F.lit(path).alias("path"), F.current_timestamp().alias("created"), F.lit(json.dumps(params, sort_keys=True, default=str)).alias("params"))
    row.write.mode("append").parquet(f"{root}/{registry}")
    return path


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/u"), spark.read.parquet(f"{path}/v")


def models(spark: SparkSession, root: str, name: str | None = None, start=None, end=None, registry: str = "registry") -> DataFrame:
    """Saved models by name and time range."""
    out = spark.read.parquet(f"{root}/{registry}")
    for condition in ([F.col("name") == name] if name else []) + ([F.col("created") >= F.lit(start)] if start else []) + ([F.col("created") < F.lit(end)] if end else []):
        out = out.filter(condition)
    return out.orderBy("created")


def log_table(logs: DataFrame, df_name: str):
    """One model's log (df_name, step, split, metric, value, ts) as a small pandas table: steps by (split, metric)."""
    return logs.filter(F.col("df_name") == df_name).toPandas().pivot_table(index="step", columns=["split", "metric"], values="value")


def log_to_html(logs: DataFrame, df_name: str, path: str) -> None:
    with open(path, "w") as f:
        f.write(log_table(logs, df_name).to_html(float_format="%.4f"))


def log_to_latex(logs: DataFrame, df_name: str, path: str) -> None:
    """A tabular, written by hand so that nothing beyond pandas is needed."""
    table = log_table(logs, df_name)
    escape = lambda s: str(s).replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    head = " & ".join(["step", *(escape(f"{s} {m}") for s, m in table.columns)])
    lines = [" & ".join([str(i), *(f"{x:.4f}" for x in row)]) for i, row in zip(table.index, table.to_numpy(), strict=True)]
    body = " \\\\\n".join([head, *lines])
    with open(path, "w") as f:
        f.write(f"\\begin{{tabular}}{{l{'r' * len(table.columns)}}}\n{body} \\\\\n\\end{{tabular}}\n")
