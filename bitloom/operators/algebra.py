"""Boolean and real algebra on coordinate tables (i, j) or (i, j, x). U holds (i, f[, x]), V holds (j, f[, x])."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .lineage import cut

CELL = ["i", "j"]
#: Rows and columns that meet under one key of a tiled product, and its tasks at most.
ROWS, COLS, TASKS = 2048, 65_536, 2000


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cell by cell product (i, j, x)."""
    return a.alias("a").join(b.alias("b"), CELL).select("i", "j", (F.col("a.x") * F.col("b.x")).alias("x"))


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Boolean product of two relations: cells of both."""
    return a.select(*CELL).join(b.select(*CELL), CELL, "left_semi")


def either(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*CELL).union(b.select(*CELL)).distinct()


def add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("i", "j", "x").unionByName(b.select("i", "j", "x")).groupBy(*CELL).agg(F.sum("x").alias("x"))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return add(a, b.withColumn("x", -F.col("x")))


def scaled(a: DataFrame, factor: float) -> DataFrame:
    return a.withColumn("x", F.col("x") * F.lit(factor))


def power(a: DataFrame, exponent: float) -> DataFrame:
    return a.withColumn("x", F.pow("x", F.lit(float(exponent))))


def invert(a: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """The zero cells; metrics use counts instead of this."""
    return rows.crossJoin(cols).join(a.select(*CELL), CELL, "left_anti")


def dot(u: DataFrame, v: DataFrame, key: str = "i") -> DataFrame:
    """One row: the inner product of two vectors (key, x), and whether any product is not 0."""
    total = F.coalesce(F.sum(F.col("a.x") * F.col("b.x")), F.lit(0))
    return u.alias("a").join(v.alias("b"), key).agg(total.alias("x"), (total > 0).alias("nonzero"))


def matmul(u: DataFrame, v: DataFrame) -> DataFrame:
    """Real product: U(i, f, x) and V(j, f, x) to (i, j, x)."""
    return u.alias("a").join(v.alias("b"), "f").groupBy(*CELL).agg(F.sum(F.col("a.x") * F.col("b.x")).alias("x"))


def bool_matmul(u: DataFrame, v: DataFrame) -> DataFrame:
    return u.select("i", "f").join(v.select("j", "f"), "f").select(*CELL).distinct()


def masks(side: DataFrame, key: str) -> DataFrame:
    """(key, mask): the factors of each id as a sorted array, for any number of factors."""
    return side.groupBy(key).agg(F.array_sort(F.collect_set(F.col("f").cast("int"))).alias("mask"))


def predicted(cells: DataFrame, u: DataFrame, v: DataFrame) -> DataFrame:
    """cells with `hit`: whether the Boolean product of u and v has a one there. Only the given cells are looked at."""
    left, right = masks(u, "i").withColumnRenamed("mask", "__u"), masks(v, "j").withColumnRenamed("mask", "__v")
    hit = F.coalesce(mask_hit(F.col("__u"), F.col("__v")), F.lit(False))
    return cells.join(left, "i", "left").join(right, "j", "left").withColumn("hit", hit).drop("__u", "__v")


def residual(ones: DataFrame, prediction: DataFrame) -> DataFrame:
    return ones.select(*CELL).join(prediction.select(*CELL), CELL, "left_anti")


def above(side: DataFrame, threshold: float | DataFrame) -> DataFrame:
    """Real factors to Boolean ones: x above a number, or above a threshold (f, t) of each factor."""
    if isinstance(threshold, DataFrame):
        return side.join(threshold, "f").filter(F.col("x") > F.col("t")).drop("t")
    return side.filter(F.col("x") > F.lit(float(threshold)))


def threshold_prediction(u: DataFrame, v: DataFrame, at_u, at_v) -> DataFrame:
    return bool_matmul(above(u, at_u), above(v, at_v))


def to_interval(side: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """x rescaled to [low, high]; a constant x becomes low."""
    ends = side.agg(F.min("x").alias("__a"), F.max("x").alias("__b"))
    part = F.coalesce(F.try_divide(F.col("x") - F.col("__a"), F.col("__b") - F.col("__a")), F.lit(0.0))
    return side.crossJoin(F.broadcast(ends)).withColumn("x", F.lit(low) + part * F.lit(high - low)).drop("__a", "__b")


def unique_mapping(side: DataFrame, by: str | None = None) -> DataFrame:
    """x replaced by its rank among the distinct values, over their number; by: within each value of that column. Ranks are
    taken over the distinct values only."""
    from .matrix import factorized

    if by is None:
        ranks = factorized(side, "x", "__r")
        whole = ranks.agg(F.count(F.lit(1)).alias("__n"))
        return side.join(ranks, "x").crossJoin(F.broadcast(whole)).withColumn("x", F.col("__r") / F.col("__n")).drop("__r", "__n")
    ranks = factorized(side.select(F.struct(by, "x").alias("__v")), "__v", "__r").select(F.col(f"__v.{by}").alias(by), F.col("__v.x").alias("x"), "__r")
    ends = ranks.groupBy(by).agg(F.min("__r").alias("__a"), F.count(F.lit(1)).alias("__n"))
    return side.join(ranks, [by, "x"]).join(ends, by).withColumn("x", (F.col("__r") - F.col("__a")) / F.col("__n")).drop("__r", "__a", "__n")


def transpose(a: DataFrame) -> DataFrame:
    return a.withColumnsRenamed({"i": "j", "j": "i"})


def nth_stored(a: DataFrame, positions: list[int]) -> DataFrame:
    """The cells stored at the given positions in (i, j) order."""
    from .matrix import factorized

    at = factorized(a.select(F.struct("i", "j").alias("cell")), "cell").filter(F.col("ord").isin(positions)).select("ord", "cell.i", "cell.j")
    return at.join(a, CELL)


def positions(vector: DataFrame, key: str, value: str = "x") -> DataFrame:
    """The keys at which a Boolean vector is true."""
    return vector.filter(F.col(value) > 0).select(key)


def mask_hit(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def hit_pairs(a: DataFrame, mask_a: str, b: DataFrame, mask_b: str) -> DataFrame:
    """The pairs of rows of a and b whose masks share a factor, each once. Masks meet by their factors, as in an inverted index; a pair
    counts where it meets first, so nothing has to be made distinct, and neither side has to fit into memory."""
    left, right = a.withColumn("__f", F.explode(mask_a)), b.withColumn("__f", F.explode(mask_b))
    return left.join(right, "__f").filter(F.col("__f") == F.array_min(F.array_intersect(mask_a, mask_b))).drop("__f")


def mask_pairs(u: DataFrame, v: DataFrame) -> DataFrame:
    """mi, ni, mj, nj: the pairs of distinct masks of u and v that share a factor, and the numbers of ids that have them. The cells of the
    product are those of these pairs, each of one pair."""
    counted = lambda side, key: masks(side, key).groupBy(F.col("mask").alias(f"m{key}")).agg(F.count(F.lit(1)).alias(f"n{key}"))
    return hit_pairs(counted(u, "i"), "mi", counted(v, "j"), "mj")


def tiled_matmul(u: DataFrame, v: DataFrame, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    """The cells of `bool_matmul`, of a product with many ones and few distinct masks: each cell is made once, so that none is shuffled.

    Ids meet by pairs of masks, in tiles of about rows x cols ids; the columns of a tile are one array. What is shuffled is each row
    once for every tile of columns and each column once for every tile of rows."""
    tiles = lambda n, most: F.ceil(F.col(n) / F.lit(most)).cast("int")
    pairs = cut(mask_pairs(u, v).select(F.monotonically_increasing_id().alias("pair"), "mi", "mj", tiles("ni", rows).alias("__r"), tiles("nj", cols).alias("__c")))
    n = pairs.agg(F.sum(F.col("__r").cast("bigint") * F.col("__c"))).first()[0] or 1
    key, tasks = ["pair", "a", "b"], min(2 * n, TASKS)
    of = lambda key, of: F.pmod(F.xxhash64(key), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = masks(u, "i").withColumnRenamed("mask", "mi").join(pairs, "mi").select("pair", of("i", "__r").alias("a"), every("__c").alias("b"), "i")
    right = masks(v, "j").withColumnRenamed("mask", "mj").join(pairs, "mj").groupBy("pair", "__r", of("j", "__c").alias("b")).agg(F.collect_list("j").alias("j"))
    right = right.select("pair", every("__r").alias("a"), "b", "j")
    met = left.repartition(tasks, *key).join(right.repartition(tasks, *key), key)
    return met.select("i", F.explode("j").alias("j"))
