"""Several matrices that share dimensions. Cells are (mat, i, j, x); the catalog says which factor a matrix's rows and columns
are: [[row factor, column factor], ...]. The catalog is schema, a few pairs on the driver; all data stays in DataFrames."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, functions as F


def factor_list(factors: list[list[int]]) -> list[int]:
    return sorted({f for pair in factors for f in pair})


def matrices_of(factors: list[list[int]]) -> dict[int, list[int]]:
    return {f: [k for k, pair in enumerate(factors) if f in pair] for f in factor_list(factors)}


def sides(factors: list[list[int]]) -> tuple[list[int], list[int]]:
    """Row factors and column factors, so that every matrix goes from one side to the other."""
    side: dict[int, int] = {}
    for seed in [f for pair in factors for f in pair]:
        if seed in side:
            continue
        side[seed] = 0
        queue = deque([seed])
        while queue:
            f = queue.popleft()
            for other in [y for a, b in factors for x, y in ((a, b), (b, a)) if x == f]:
                if other not in side:
                    side[other] = 1 - side[f]
                    queue.append(other)
                elif side[other] == side[f]:
                    raise ValueError("the factors cannot be dealt to two sides")
    return [f for f in factor_list(factors) if side[f] == 0], [f for f in factor_list(factors) if side[f] == 1]


def starts(dims: DataFrame, factors: list[list[int]]) -> DataFrame:
    """fid, side ('row' or 'col'), start: offset of each factor within its side. dims: fid, ord (one row an id)."""
    from pyspark.sql import Window

    rows, _ = sides(factors)
    sizes = dims.groupBy("fid").agg(F.count(F.lit(1)).alias("size"))  # one row a factor
    side = F.when(F.col("fid").isin(rows), "row").otherwise("col")
    before = Window.partitionBy("side").orderBy("fid").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("fid", "size", side.alias("side")).withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))


def placed(factors: list[list[int]]) -> list[tuple[int, int, int, bool]]:
    """(mat, row factor, column factor, turned): a matrix is turned if its rows are a column factor."""
    rows, _ = sides(factors)
    return [(k, a, b, False) if a in rows else (k, b, a, True) for k, (a, b) in enumerate(factors)]


def _catalog(spark, factors) -> DataFrame:
    return F.broadcast(spark.createDataFrame(placed(factors), "mat int, rf int, cf int, turned boolean"))


def concat(cells: DataFrame, dims: DataFrame, factors: list[list[int]]) -> DataFrame:
    """All matrices as one (i, j, x): each cell moved by the starts of its factors."""
    catalog, at = _catalog(cells.sparkSession, factors), F.broadcast(starts(dims, factors))
    joined = cells.join(catalog, "mat").join(at.select(F.col("fid").alias("rf"), F.col("start").alias("ri")), "rf").join(at.select(F.col("fid").alias("cf"), F.col("start").alias("cj")), "cf")
    i, j = F.when(F.col("turned"), F.col("j")).otherwise(F.col("i")), F.when(F.col("turned"), F.col("i")).otherwise(F.col("j"))
    return joined.select((i + F.col("ri")).alias("i"), (j + F.col("cj")).alias("j"), "x")


def split(whole: DataFrame, dims: DataFrame, factors: list[list[int]]) -> DataFrame:
    """The matrices (mat, i, j, x) back from one; cells of pairs of factors that no matrix has are left out."""
    at = F.broadcast(starts(dims, factors))
    r = at.filter("side = 'row'").select(F.col("fid").alias("rf"), F.col("start").alias("ri"), (F.col("start") + F.col("size")).alias("re"))
    c = at.filter("side = 'col'").select(F.col("fid").alias("cf"), F.col("start").alias("cj"), (F.col("start") + F.col("size")).alias("ce"))
    joined = whole.join(r, (whole["i"] >= r["ri"]) & (whole["i"] < r["re"])).join(c, (whole["j"] >= c["cj"]) & (whole["j"] < c["ce"]))
    joined = joined.join(_catalog(whole.sparkSession, factors), ["rf", "cf"])
    i, j = F.col("i") - F.col("ri"), F.col("j") - F.col("cj")
    return joined.select("mat", F.when(F.col("turned"), j).otherwise(i).alias("i"), F.when(F.col("turned"), i).otherwise(j).alias("j"), "x")


def concat_sides(parts: DataFrame, dims: DataFrame, factors: list[list[int]]) -> DataFrame:
    """Factor tables (fid, i, f) of one side as one (side, i, f)."""
    return parts.join(F.broadcast(starts(dims, factors)), "fid").select("side", (F.col("i") + F.col("start")).alias("i"), "f")


def split_sides(whole: DataFrame, dims: DataFrame, factors: list[list[int]]) -> DataFrame:
    """(side, i, f) back to (fid, i, f)."""
    at = F.broadcast(starts(dims, factors))
    hit = (whole["side"] == at["side"]) & (whole["i"] >= at["start"]) & (whole["i"] < at["start"] + at["size"])
    return whole.join(at, hit).select("fid", (whole["i"] - at["start"]).alias("i"), "f")


def concat_dims(dims: DataFrame, factors: list[list[int]]) -> DataFrame:
    """side, ord, id, alias: the dimension tables (fid, ord, id, alias) of each side, one after the other."""
    return dims.join(F.broadcast(starts(dims, factors)), "fid").select("side", (F.col("ord") + F.col("start")).alias("ord"), "id", "alias")


def dummy_dims(sizes: DataFrame) -> DataFrame:
    """fid, ord, id, alias for each of fid's `size` ids."""
    return sizes.select("fid", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1)).alias("ord")).select("fid", "ord", F.col("ord").alias("id"), F.col("ord").cast("string").alias("alias"))


def sample_dimension(cells: DataFrame, dims: DataFrame, factors: list[list[int]], fid: int, size: int, seed=0) -> tuple[DataFrame, DataFrame]:
    """Keeps `size` random ids of one factor, in every matrix that has it; ids keep their positions."""
    from ..functions.scalar import digest

    kept = dims.filter(F.col("fid") == fid).orderBy(digest(seed, F.col("id")), "id").limit(size).select(F.col("ord").alias("__k"))
    rows = [k for k, (a, _) in enumerate(factors) if a == fid]
    cols = [k for k, (_, b) in enumerate(factors) if b == fid]
    kept = F.broadcast(kept) if size <= 1_000_000 else kept
    free = cells.filter(~F.col("mat").isin(rows + cols)) if rows + cols else cells
    out = free
    if rows:
        out = out.unionByName(cells.filter(F.col("mat").isin(rows)).join(kept, F.col("i") == F.col("__k"), "left_semi"))
    if cols:
        out = out.unionByName(cells.filter(F.col("mat").isin(cols)).join(kept, F.col("j") == F.col("__k"), "left_semi"))
    left = dims.filter(F.col("fid") != fid).unionByName(dims.filter(F.col("fid") == fid).join(kept, F.col("ord") == F.col("__k"), "left_semi"))
    return out, left


def cover(cells: DataFrame, predicted: DataFrame, weights: DataFrame) -> DataFrame:
    """mat, f, score: for each matrix and pattern, (1 - w) x ones covered - w x others covered; weights: mat, w.
    predicted: (mat, f, i, j)."""
    joined = predicted.join(cells.filter("x = 1").withColumn("__one", F.lit(1)), ["mat", "i", "j"], "left").join(F.broadcast(weights), "mat")
    one = F.coalesce(F.col("__one"), F.lit(0))
    return joined.groupBy("mat", "f").agg(F.sum((1 - F.col("w")) * one - F.col("w") * (1 - one)).alias("score"))
