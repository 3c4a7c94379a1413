"""Sums over all m x n cells without a row per cell.

Models that are nonlinear in the product of two factors have to visit every cell. Rows and columns are dealt to blocks of about SIDE ids,
by hash; each pair of blocks gets its part of both factors and of the ones, makes its cells as one dense array in a task of its
own, and hands on sums: k numbers a row or column, or a single one. What is shuffled is each factor once for every block of the
other side, and the ones once; memory is that of one pair of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .matrix import BoolMatrix

SIDE = 1024
TASKS = 2000


def on_blocks(x: BoolMatrix, u: DataFrame, v: DataFrame, body: Callable, schema: str, side: int = SIDE) -> DataFrame:
    """The rows that body makes of each pair of blocks. u: i and number columns, v: j and number columns (any of each).

    body(i, j, u, v, ones) gets the ids of the block's rows and columns (Arrow arrays), their numbers (arrays, in the order of the columns)
    and a Boolean array that says where the ones are; it returns an Arrow table of the schema."""
    rows, cols = max(1, math.ceil(x.m / side)), max(1, math.ceil(x.n / side))
    a, b = [c for c in u.columns if c != "i"], [c for c in v.columns if c != "j"]
    place = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    numbers = lambda names: F.array(*[F.col(c).cast("double") for c in names])
    no_i, no_j, no_numbers = (F.lit(None).cast(t) for t in (x.rows.schema["i"].dataType, x.cols.schema["j"].dataType, "array<double>"))
    left = u.select(place("i", rows).alias("__a"), every(cols).alias("__b"), "i", no_j.alias("j"), numbers(a).alias("__x"))
    right = v.select(every(rows).alias("__a"), place("j", cols).alias("__b"), no_i.alias("i"), "j", numbers(b).alias("__x"))
    ones = x.ones.select(place("i", rows).alias("__a"), place("j", cols).alias("__b"), "i", "j", no_numbers.alias("__x"))

    def run(table: pa.Table) -> pa.Table:
        i, j, numbers = (table.column(c).combine_chunks() for c in ("i", "j", "__x"))
        is_row, is_col = (pc.is_null(c).to_numpy(zero_copy_only=False) for c in (j, i))
        row_ids, col_ids = i.filter(pa.array(is_row)), j.filter(pa.array(is_col))
        dense = lambda at, n: numbers.filter(pa.array(at)).flatten().to_numpy().reshape(-1, n)
        cell = pa.array(~is_row & ~is_col)
        at = [pc.index_in(c.filter(cell), value_set=ids).fill_null(-1).to_numpy(zero_copy_only=False) for c, ids in ((i, row_ids), (j, col_ids))]
        known = (at[0] >= 0) & (at[1] >= 0)
        hit = np.zeros((len(row_ids), len(col_ids)), bool)
        hit[at[0][known], at[1][known]] = True
        return body(row_ids, col_ids, dense(is_row, len(a)), dense(is_col, len(b)), hit)

    dealt = left.unionByName(right).unionByName(ones).repartition(min(rows * cols, TASKS), "__a", "__b")
    return dealt.groupBy("__a", "__b").applyInArrow(run, schema)


def sums_of(key: str, ids: pa.Array, sums: dict[str, np.ndarray]) -> pa.Table:
    return pa.table([ids, *[pa.array(s) for s in sums.values()]], names=[key, *sums])


def sigmoid_of(z: np.ndarray) -> np.ndarray:
    """Stable on both sides of 0."""
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0, e) / (1.0 + e)
