"""Train, validation and test parts, and negative samples, by hash order.

Negatives are drawn, not picked from the m x n grid: draw t takes a row and a column, each by a hash of (seed, t): uniformly, or in
proportion to their ones (a row is where the drawn one falls among all ones laid end to end). Draws that hit a one or a cell
drawn before do not count, which is sampling without replacement with those weights; draws go on until enough cells are found.
The sample is the first cells in the order of draws, whatever the batches. Work follows the sample and the numbers of rows and
columns; only where next to all draws are wasted, as nearly all cells are ones or drawn, the rest comes from the grid.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import digest, fine_uniform
from .lineage import cut
from .matrix import BoolMatrix, cumulated, factorized, located


def sizes(n: int, train=None, val=None, test=None) -> tuple[int, int, int]:
    """Numbers of cells: below 1 a share (rounded up), None for val and test 0, for train what is left."""

    def number(x):
        if x is None:
            return 0
        if not 0 <= x < max(n, 1):
            raise ValueError(f"a size of {x} is not within [0, {n})")
        return math.ceil(x * n) if x < 1 else int(x)

    v, t = number(val), number(test)
    k = n - v - t if train is None else number(train)
    if k < 0 or k + v + t > n:
        raise ValueError(f"{k} + {v} + {t} cells of {n}")
    return k, v, t


def shuffled(cells: DataFrame, seed) -> DataFrame:
    """The cells with `rank`: their place in a random order, 0 on."""
    keyed = cells.withColumn("__key", F.struct(digest(seed, F.col("i"), F.col("j")).alias("h"), "i", "j"))
    ranks = factorized(keyed, "__key", "rank").select("__key.i", "__key.j", "rank")
    return cells.join(ranks, ["i", "j"])


def ratio_split(matrix: BoolMatrix, train=None, val=None, test=None, seed=0) -> DataFrame:
    """The ones with `part`: train, val or test; cells beyond the sizes are left out."""
    ones = matrix.ones
    k, v, t = sizes(ones.count(), train, val, test)
    part = F.when(F.col("rank") < k, "train").when(F.col("rank") < k + v, "val").when(F.col("rank") < k + v + t, "test")
    return shuffled(ones, seed).select("i", "j", part.alias("part")).filter("part IS NOT NULL")


def fold_bounds(n: int, folds: int) -> list[int]:
    """Where each of the folds ends; the first n % folds are one larger."""
    ends, at = [], 0
    for k in range(folds):
        at += n // folds + (k < n % folds)
        ends.append(at)
    return ends


def cross_validation(matrix: BoolMatrix, folds: int, test=None, seed=0) -> DataFrame:
    """The ones with `fold`: 0 to folds - 1, or -1 for the test part, which is the end of the order."""
    ones = matrix.ones
    n = ones.count()
    kept = n - sizes(n, None, None, test)[2]
    ends = fold_bounds(kept, folds)
    fold = F.coalesce(*[F.when(F.col("rank") < e, k) for k, e in enumerate(ends)], F.lit(-1))
    return shuffled(ones, seed).select("i", "j", fold.alias("fold"))


def fold_parts(folded: DataFrame, current: int) -> DataFrame:
    """`part` for one fold as validation."""
    return folded.withColumn("part", F.when(F.col("fold") == -1, "test").when(F.col("fold") == current, "val").otherwise("train"))


#: Below this share of draws that find a new cell, what is missing comes from the grid.
FRUITFUL = 0.02


class Draws:
    """Finds the cell (i, j) of each draw t."""

    def __init__(self, matrix: BoolMatrix, kind: str, seed):
        self.matrix, self.seed, self.popular = matrix, seed, kind == "popularity"
        if kind not in ("uniform", "popularity"):
            raise ValueError(f"unknown kind of sample: {kind}")
        self.ones = matrix.ones.count()
        if self.popular:
            self.counts = [matrix.ones.groupBy(key).agg(F.count(F.lit(1)).alias("w")) for key in ("i", "j")]
            self.sides = [cut(cumulated(c, key, "w")) for c, key in zip(self.counts, ("i", "j"))]
            self.sizes = [s.count() for s in self.sides]
        else:
            self.sides = [cut(factorized(matrix.rows, "i", "__i")), cut(factorized(matrix.cols, "j", "__j"))]
            self.sizes = [matrix.m, matrix.n]

    @property
    def available(self) -> int:
        return self.sizes[0] * self.sizes[1] - self.ones

    def zeros(self, start: int, end: int) -> DataFrame:
        """t, i, j of the draws from start on that hit no one."""
        t = self.matrix.cells.sparkSession.range(start, end).select(F.col("id").alias("t"))
        for key, side, size in zip(("i", "j"), self.sides, self.sizes):
            u = fine_uniform(f"{self.seed}:{key}", F.col("t"))
            if self.popular:
                t = located(t.withColumn("__at", F.floor(u * F.lit(float(self.ones)))), "__at", side, max(1, self.ones // max(size, 1))).drop("__at")
            else:
                t = t.withColumn(f"__{key}", F.floor(u * F.lit(float(size)))).join(side, f"__{key}").drop(f"__{key}")
        return t.join(self.matrix.ones, ["i", "j"], "left_anti")

    def rest(self, found: DataFrame) -> DataFrame:
        """t, i, j of all zeros that are not found, in the order in which draws would find them (exponential keys)."""
        u = fine_uniform(f"{self.seed}:rest", F.col("i"), F.col("j"))
        rows, cols = self.counts if self.popular else (self.matrix.rows.withColumn("w", F.lit(1)), self.matrix.cols.withColumn("w", F.lit(1)))
        grid = rows.withColumnRenamed("w", "__r").crossJoin(cols.withColumnRenamed("w", "__c")).join(self.matrix.ones, ["i", "j"], "left_anti").join(found, ["i", "j"], "left_anti")
        return grid.select((-F.ln(1.0 - u) / (F.col("__r") * F.col("__c"))).alias("t"), "i", "j")


def negative_sample(matrix: BoolMatrix, size: int, kind: str = "uniform", seed=0) -> DataFrame:
    """size zeros without replacement, as rows (i, j, x = 0). popularity: with weights row sum x column sum; rows and columns without
    ones are then never drawn. More than there are is an error."""
    draws = Draws(matrix, kind, seed)
    if not 0 <= size <= draws.available:
        raise ValueError(f"{size} of {draws.available} zeros")
    share = draws.available / max(draws.sizes[0] * draws.sizes[1], 1)
    found, have, done = None, 0, 0
    batch = int(size / max(share, 0.01) * 1.2) + 100
    while have < size:
        new = draws.zeros(done, done + batch)
        both = new if found is None else found.unionByName(new)
        found = cut(both.groupBy("i", "j").agg(F.min("t").alias("t")))
        before, have, done = have, found.count(), done + batch
        if have < size and have - before < FRUITFUL * batch:
            more = draws.rest(found).orderBy("t", "i", "j").limit(size - have)
            return found.select("i", "j").unionByName(more.select("i", "j")).withColumn("x", F.lit(0))
        batch *= 2
    if found is None:
        found = draws.zeros(0, 0)
    return found.orderBy("t").limit(size).select("i", "j", F.lit(0).alias("x"))


def negative_parts(matrix: BoolMatrix, train=None, val=None, test=None, kind: str = "uniform", seed=0) -> DataFrame:
    """Sampled zeros as (i, j, x = 0, part). Sizes are numbers, or shares of all zeros (None: train what is left, others none). Which part
    a zero goes to is random, so popular ones do not gather in the first part."""
    k, v, t = sizes(matrix.m * matrix.n - matrix.ones.count(), train, val, test)
    sample = cut(negative_sample(matrix, k + v + t, kind, seed))
    part = F.when(F.col("rank") < k, "train").when(F.col("rank") < k + v, "val").otherwise("test")
    return shuffled(sample, f"{seed}:part").select("i", "j", F.lit(0).alias("x"), part.alias("part"))


def negative_folds(matrix: BoolMatrix, folds: int, train_val: int, test: int = 0, kind: str = "uniform", seed=0) -> DataFrame:
    """Sampled zeros as (i, j, x = 0, fold): train_val of them in folds 0 on, test of them in fold -1."""
    sample = cut(negative_sample(matrix, train_val + test, kind, seed))
    fold = F.coalesce(*[F.when(F.col("rank") < e, k) for k, e in enumerate(fold_bounds(train_val, folds))], F.lit(-1))
    return shuffled(sample, f"{seed}:part").select("i", "j", F.lit(0).alias("x"), fold.alias("fold"))


def appended(positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """Ones and known zeros of all parts (or folds), as one table of (i, j, x) and the part."""
    part = "part" if "part" in positives.columns else "fold"
    return positives.select("i", "j", F.lit(1).alias("x"), part).unionByName(negatives.select("i", "j", "x", part))


def matrices(matrix: BoolMatrix, split: DataFrame) -> dict[str, BoolMatrix]:
    """The parts of a split (i, j, x, part) as matrices of the same dimensions."""
    return {p: BoolMatrix(split.filter(F.col("part") == p).select("i", "j", "x"), matrix.rows, matrix.cols) for p in ("train", "val", "test")}


def no_split(matrix: BoolMatrix, negatives: DataFrame | None = None) -> dict[str, BoolMatrix]:
    """The whole matrix, with sampled zeros if there are any, as all three parts."""
    whole = matrix if negatives is None else with_negatives(matrix, negatives)
    return dict.fromkeys(("train", "val", "test"), whole)


def with_negatives(matrix: BoolMatrix, negatives: DataFrame) -> BoolMatrix:
    """Known zeros replaced by these."""
    cells = matrix.cells.filter("x = 1").unionByName(negatives.select("i", "j", "x"))
    return BoolMatrix(cells, matrix.rows, matrix.cols)
