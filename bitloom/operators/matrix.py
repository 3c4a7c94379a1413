"""The Boolean matrix: a relation (i, j, x) with the dimensions it lives in.

Rows with x = 1 are ones, rows with x = 0 are known zeros (negative samples), cells without a row are unknown. Shapes come from
the dimension tables, so empty rows and columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window, functions as F

from .lineage import cut


@dataclass(frozen=True)
class BoolMatrix:
    cells: DataFrame
    rows: DataFrame
    cols: DataFrame
    _sizes: dict = field(default_factory=dict, compare=False, repr=False)

    @classmethod
    def of(cls, df: DataFrame, row: str, col: str, value: str | None = None, rows: DataFrame | None = None, cols: DataFrame | None = None) -> BoolMatrix:
        """From any table: equal cells are one; value (above 0) says which are ones, without it all are."""
        x = F.lit(1) if value is None else (F.col(value) > 0).cast("int")
        cells = df.filter(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(F.col(row).alias("i"), F.col(col).alias("j")).agg(F.max(x).alias("x"))
        return cls(cells, cells.select("i").distinct() if rows is None else rows, cells.select("j").distinct() if cols is None else cols)

    @property
    def ones(self) -> DataFrame:
        return self.cells.filter("x = 1").select("i", "j")

    @property
    def m(self) -> int:
        return self._sizes.setdefault("m", self.rows.count()) if "m" not in self._sizes else self._sizes["m"]

    @property
    def n(self) -> int:
        return self._sizes.setdefault("n", self.cols.count()) if "n" not in self._sizes else self._sizes["n"]

    @property
    def T(self) -> BoolMatrix:
        return BoolMatrix(
            self.cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "x"), self.cols.select(F.col("j").alias("i")), self.rows.select(F.col("i").alias("j"))
        )

    def keep(self, rows: DataFrame | None = None, cols: DataFrame | None = None) -> BoolMatrix:
        """The part within the given row and column ids."""
        out = self
        if rows is not None:
            out = replace(out, cells=out.cells.join(rows, "i", "left_semi"), rows=out.rows.join(rows, "i", "left_semi"), _sizes={})
        if cols is not None:
            out = replace(out, cells=out.cells.join(cols, "j", "left_semi"), cols=out.cols.join(cols, "j", "left_semi"), _sizes={})
        return out

    def grid(self) -> DataFrame:
        """All m x n positions; only for what no algebra avoids."""
        return self.rows.crossJoin(self.cols)


def factorized(ids: DataFrame, col: str, name: str = "ord") -> DataFrame:
    """Distinct ids with their positions 0, 1, ... in order. Ids are sorted by ranges; a position is the number of ids in
    earlier ranges plus the place within its own, so no task sees more than its range."""
    spread = ids.select(col).filter(F.col(col).isNotNull()).distinct().sort(col).withColumn("__at", F.monotonically_increasing_id())
    spread = cut(spread)
    part = F.shiftright("__at", 33)
    sizes = spread.groupBy(part.alias("__part")).count()  # one row a range
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    placed = spread.withColumn("__part", part).join(F.broadcast(sizes), "__part")
    return placed.select(col, (F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).cast("bigint").alias(name))


def cumulated(weights: DataFrame, key: str, weight: str) -> DataFrame:
    """Each key with `start` and `end`, its share of the weights laid end to end in the order of the keys. Sorted by ranges, as in
    `factorized`: sums within a range, after what earlier ranges hold."""
    spread = cut(weights.select(key, weight).sort(key).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = spread.groupBy("__part").agg(F.sum(weight).alias("__w"))  # one row a range
    sizes = sizes.select("__part", F.coalesce(F.sum("__w").over(before), F.lit(0)).alias("__before"))
    within = F.sum(weight).over(Window.partitionBy("__part").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    placed = spread.withColumn("__end", within).join(F.broadcast(sizes), "__part")
    return placed.select(key, (F.col("__before") + F.col("__end") - F.col(weight)).alias("start"), (F.col("__before") + F.col("__end")).alias("end"))


def located(points: DataFrame, at: str, spans: DataFrame, width: int) -> DataFrame:
    """points with the span (start, end) that each lies in. Both meet in buckets of this width, so it is a join on equal keys; a long
    span is in as many buckets as it covers."""
    whole = lambda c: F.floor(c / F.lit(width))
    spread = spans.withColumn("__bucket", F.explode(F.sequence(whole(F.col("start")), whole(F.col("end") - 1))))
    found = points.withColumn("__bucket", whole(F.col(at))).join(spread, "__bucket")
    return found.filter((F.col(at) >= F.col("start")) & (F.col(at) < F.col("end"))).drop("__bucket", "start", "end")


def sort_order(dim: DataFrame, by: str = "ord", name: str = "ord") -> DataFrame:
    """Closes the gaps of an order column."""
    ranks = factorized(dim.select(F.col(by).alias("__o")), "__o", "__new")
    out = dim.join(ranks, dim[by] == F.col("__o")).drop("__o")
    return out.drop(name).withColumnRenamed("__new", name)


def sort_factor(matrix: BoolMatrix, row_order: DataFrame) -> BoolMatrix:
    """Row ids replaced by their position in row_order (i, ord)."""
    cells = matrix.cells.join(row_order, "i").select(F.col("ord").alias("i"), "j", "x")
    rows = matrix.rows.join(row_order, "i").select(F.col("ord").alias("i"))
    return BoolMatrix(cells, rows, matrix.cols)
