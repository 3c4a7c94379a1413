"""Raw tables to matrices: delimited text, ids, attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.matrix import BoolMatrix, factorized


def delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t", encoding: str = "UTF-8", header: bool = False) -> DataFrame:
    """Text with any separator, also of several characters."""
    return spark.read.schema(schema).option("sep", sep).option("encoding", encoding).option("header", header).csv(path)


def with_times(df: DataFrame, col: str, kind: str = "epoch", fmt: str | None = None) -> DataFrame:
    """A timestamp column from epoch seconds or from text."""
    return df.withColumn(col, F.timestamp_seconds(F.col(col)) if kind == "epoch" else F.to_timestamp(F.col(col).cast("string"), fmt))


def wide(df: DataFrame) -> BoolMatrix:
    """A table of numeric columns, one row a matrix row, as a matrix: row ids by `row`, which the table must have."""
    names = [c for c in df.columns if c != "row"]
    cells = df.select("row", F.explode(F.array(*[F.struct(F.lit(k).alias("j"), F.col(c).alias("x")) for k, c in enumerate(names)])).alias("c"))
    return BoolMatrix.of(cells.select("row", "c.j", "c.x").filter("x > 0"), "row", "j", rows=df.select(F.col("row").alias("i")), cols=df.sparkSession.range(len(names)).select(F.col("id").cast("int").alias("j")))


def ratings_matrix(ratings: DataFrame, titles: DataFrame | None = None, threshold: float = 0.5, user="uid", item="iid", value="rating") -> BoolMatrix:
    """Users by items, a one where the rating is above the threshold; with titles, items are those that have one."""
    kept = ratings.dropDuplicates([user, item])
    cols = kept.select(F.col(item).alias("j")).distinct()
    if titles is not None:
        cols = titles.select(F.col(item).alias("j")).distinct()
        kept = kept.join(cols, F.col(item) == F.col("j"), "left_semi")
    ones = kept.filter(F.col(value) > F.lit(float(threshold)))
    return BoolMatrix.of(ones, user, item, rows=kept.select(F.col(user).alias("i")).distinct(), cols=cols)


def with_positions(matrix: BoolMatrix) -> tuple[BoolMatrix, DataFrame, DataFrame]:
    """Ids replaced by positions in id order; also the two dimension tables (id, ord)."""
    rows, cols = factorized(matrix.rows, "i"), factorized(matrix.cols, "j")
    cells = matrix.cells.join(rows, "i").withColumnRenamed("ord", "oi").join(cols, "j").select(F.col("oi").alias("i"), F.col("ord").alias("j"), "x")
    dims = rows.withColumnRenamed("i", "id"), cols.withColumnRenamed("j", "id")
    return BoolMatrix(cells, rows.select(F.col("ord").alias("i")), cols.select(F.col("ord").alias("j"))), *dims


def one_hot(df: DataFrame, key: str, parts: dict) -> BoolMatrix:
    """A row for each key, a column for each value of each part; parts: prefix -> column expression."""
    named = F.array(*[F.concat(F.lit(f"{p}_"), c.cast("string")) for p, c in parts.items()])
    cells = df.select(F.col(key).alias("i"), F.explode(named).alias("j")).filter("j IS NOT NULL")
    return BoolMatrix.of(cells, "i", "j", rows=df.select(F.col(key).alias("i")).distinct())


def parsed_list(col):
    """A list that is written as text, like ['a', 'b'], as an array."""
    return F.from_json(F.regexp_replace(col, "'", '"'), "array<string>")


def merged_lists(*cols):
    """The union of several list columns."""
    return F.array_distinct(F.flatten(F.array(*[F.coalesce(c, F.array().cast("array<string>")) for c in cols])))


def attribute_matrix(df: DataFrame, item: str, values, shared: DataFrame | None = None) -> BoolMatrix:
    """Attributes by items from a list column; shared: only items whose id another matrix has (as j)."""
    cells = df.select(F.explode(values).alias("i"), F.col(item).alias("j")).distinct()
    cols = df.select(F.col(item).alias("j")).distinct()
    if shared is not None:
        cells, cols = cells.join(shared, "j", "left_semi"), shared.select("j").distinct()
    return BoolMatrix.of(cells, "i", "j", cols=cols)


#: User x item, user x profile, genre x item, cast x item, by the numbers of their dimensions: user, item, profile, genre, cast.
FOUR = [[0, 1], [0, 2], [3, 1], [4, 1]]


def combined(ratings: BoolMatrix, profiles: BoolMatrix, *attributes: BoolMatrix) -> tuple[DataFrame, DataFrame, list]:
    """A ratings matrix with one of its users' profiles and any number of its items' attributes, as cells (mat, i, j, x) by positions, dims
    (fid, ord, id) and factors. Users and items are those of the ratings; ids become strings."""
    text = lambda df, c: df.select(F.col(c).cast("string").alias("id"))
    user, item = text(ratings.rows, "i"), text(ratings.cols, "j")
    dims = [factorized(t, "id") for t in (user, item, text(profiles.cols, "j"), *(text(a.rows, "i") for a in attributes))]
    factors = [[0, 1], [0, 2], *([3 + n, 1] for n in range(len(attributes)))]
    cells, said = None, None
    for mat, (matrix, (a, b)) in enumerate(zip((ratings, profiles, *attributes), factors, strict=True)):
        left, right = (dims[f].select(F.col("id").alias(f"__{c}"), F.col("ord").alias(f"__o{c}")) for f, c in ((a, "i"), (b, "j")))
        placed = matrix.cells.join(left, F.col("i").cast("string") == F.col("__i")).join(right, F.col("j").cast("string") == F.col("__j"))
        placed = placed.select(F.lit(mat).alias("mat"), F.col("__oi").alias("i"), F.col("__oj").alias("j"), "x")
        cells = placed if cells is None else cells.unionByName(placed)
    for fid, dim in enumerate(dims):
        one = dim.select(F.lit(fid).alias("fid"), "ord", "id")
        said = one if said is None else said.unionByName(one)
    return cells, said, factors
