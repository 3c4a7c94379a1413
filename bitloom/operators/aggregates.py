"""Sums, means and medians of a matrix along its axes, and samples of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import digest
from .matrix import BoolMatrix


def axis_sums(matrix: BoolMatrix) -> DataFrame:
    """axis ('row' or 'col'), id (string), n: ones by row and by column; empty rows and columns have 0."""
    ones = matrix.ones
    rows = matrix.rows.join(ones.groupBy("i").count(), "i", "left").select(F.lit("row").alias("axis"), F.col("i").cast("string").alias("id"), F.coalesce("count", F.lit(0)).alias("n"))
    cols = matrix.cols.join(ones.groupBy("j").count(), "j", "left").select(F.lit("col").alias("axis"), F.col("j").cast("string").alias("id"), F.coalesce("count", F.lit(0)).alias("n"))
    return rows.unionByName(cols)


def summary(matrix: BoolMatrix) -> DataFrame:
    """For each axis: how many, and least, median, mean and largest sum."""
    return axis_sums(matrix).groupBy("axis").agg(
        F.count(F.lit(1)).alias("num"), F.min("n").alias("least"), F.median("n").alias("median"), F.avg("n").alias("mean"), F.max("n").alias("most")
    )


def sampled_ids(ids: DataFrame, col: str, size: int, seed) -> DataFrame:
    """size ids at random: those of the smallest hashes."""
    return ids.select(col).distinct().orderBy(digest(seed, F.col(col)), col).limit(size)


def sample(matrix: BoolMatrix, n_rows: int | None = None, n_cols: int | None = None, seed=0) -> BoolMatrix:
    rows = None if n_rows is None else sampled_ids(matrix.rows, "i", n_rows, f"{seed}:i")
    cols = None if n_cols is None else sampled_ids(matrix.cols, "j", n_cols, f"{seed}:j")
    return matrix.keep(rows, cols)


def histogram(side: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bucket, n: counts of a factor's values in equal bins (0 below low, bins + 1 from high on)."""
    return side.groupBy(F.width_bucket(F.col(value).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
