"""Columns of a matrix of few rows as bits, so that all pairs of columns meet as dense products.

The columns are dealt to blocks of SIDE; a block is one row of a table, which holds a bit for every cell of its columns. Every two
blocks meet once, and what they make follows from products of arrays of bits: nothing is joined or aggregated for each row that two columns
have in common. It is for matrices of up to WIDE rows whose columns share many of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .lineage import cut
from .matrix import factorized

SIDE, WIDE = 1024, 2048
#: Rows of a block that are handed on at once, and blocks of a partition at most where one side is kept together.
STRIP, HELD = 64, 32
#: Pairs of ones of a row below which they are joined in any case.
FEW = 5_000_000


def pays(ones: DataFrame) -> bool:
    """Whether dense products of all pairs of columns cost less than a join of the pairs of ones of each row."""
    count = lambda key: ones.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("n"))
    wide, pairs = count("i").agg(F.count(F.lit(1)), F.sum(F.col("n") * F.col("n"))).first()
    if wide > WIDE or (pairs or 0) < FEW:
        return False
    n = ones.select("j").distinct().count()
    return n * n * (10 + wide / 20) < pairs * 300  # nanoseconds, as measured


def packed(cells: DataFrame, planes: int = 1) -> tuple[DataFrame, int]:
    """block, ids, bits: the columns j of up to SIDE each, and planes x columns x rows bits; and the number of rows. cells: i, j and, for
    more than one plane, which of them a cell is in."""
    order = cut(factorized(cells, "i", "__at"))
    wide = order.count()
    code = F.col("__at") * F.lit(planes) + (F.col("plane") if planes > 1 else F.lit(0))
    columns = cells.join(order, "i").groupBy("j").agg(F.collect_list(code.cast("int")).alias("code"))
    parts = max(1, math.ceil(cells.select("j").distinct().count() / SIDE))
    kind = cells.schema["j"].dataType.simpleString()

    def made(ids: list, codes: list, number: int) -> pa.RecordBatch:
        ids = pa.concat_arrays(ids)
        at = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        code = np.concatenate(codes)
        bits = np.zeros((planes, len(codes), wide), bool)
        bits[code % planes, at, code // planes] = True
        rows = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), rows, pa.array([np.packbits(bits, axis=2).tobytes()], pa.binary())], names=["block", "ids", "bits"])

    def run(batches):
        from pyspark import TaskContext

        number, ids, codes = TaskContext.get().partitionId() << 32, [], []
        for batch in batches:
            for at in range(0, batch.num_rows, SIDE // 4):
                part = batch.slice(at, SIDE // 4)
                ids.append(part.column("j"))
                codes += [c.values.to_numpy() for c in part.column("code")]
                if len(codes) >= SIDE:
                    yield made(ids, codes, number)
                    number, ids, codes = number + 1, [], []
        if codes:
            yield made(ids, codes, number)

    blocks = columns.repartition(parts, "j").mapInArrow(run, f"block bigint, ids array<{kind}>, bits binary")
    return cut(blocks), wide


def unpacked(bits: bytes, n: int, wide: int) -> np.ndarray:
    """Planes x n x wide, as numbers whose products are exact."""
    return np.unpackbits(np.frombuffer(bits, np.uint8).reshape(-1, n, -(-wide // 8)), axis=2, count=wide).astype(np.float32)


def met(blocks: DataFrame, left: int, right: int) -> DataFrame:
    """Every two blocks, as a_ and b_; partitions of the left side meet each partition of the right side in a task."""
    side = lambda name, n: blocks.coalesce(n).select(*[F.col(c).alias(f"{name}_{c}") for c in blocks.columns])
    return side("a", left).crossJoin(side("b", right).hint("shuffle_replicate_nl"))


def shares(ones: DataFrame) -> DataFrame:
    """p, q, c: the share of p's ones that q has too, over the columns; pairs without any are left out."""
    blocks, wide = packed(ones)
    n = blocks.rdd.getNumPartitions()
    kind = ones.schema["j"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                p, q = (batch.column(f"{s}_ids")[at].values for s in "ab")
                a, b = (unpacked(batch.column(f"{s}_bits")[at].as_buffer(), len(i), wide)[0] for s, i in (("a", p), ("b", q)))
                size = a.sum(axis=1, dtype=np.float64)
                for first in range(0, len(p), STRIP):
                    common = a[first : first + STRIP] @ b.T
                    x, y = np.nonzero(common)
                    c = common[x, y].astype(np.float64) / size[first + x]
                    yield pa.RecordBatch.from_arrays([p.take(pa.array(first + x)), q.take(pa.array(y)), pa.array(c)], names=["p", "q", "c"])

    few = min(n, 48)
    return met(blocks, few, few).mapInArrow(run, f"p {kind}, q {kind}, c double")


def cover_gains(cells: DataFrame, tau: float, w_fp, w_fn) -> DataFrame:
    """p, gain, rows: of each column p, as the candidate of all columns that have more than tau of its ones, what the cover grows by if
    every row that gains takes it, and how many rows do. cells: i, j and plane: 0 an uncovered one, 1 a covered one, 2 covered, besides."""
    blocks, wide = packed(cells, 3)
    n = blocks.rdd.getNumPartitions()
    kind = cells.schema["j"].dataType.simpleString()

    def partial(batches):
        block = None
        for batch in batches:
            for at in range(batch.num_rows):
                if block != batch.column("a_block")[at].as_py():
                    if block is not None:
                        yield handed(block, ids, sums)
                    block, ids = batch.column("a_block")[at].as_py(), batch.column("a_ids").slice(at, 1)
                    planes = unpacked(batch.column("a_bits")[at].as_buffer(), len(ids[0]), wide)
                    a, sums = planes[0] + planes[1], np.zeros((len(ids[0]), 2 * wide + 1), np.int64)
                    size = a.sum(axis=1, dtype=np.float64)[:, None]
                b = unpacked(batch.column("b_bits")[at].as_buffer(), len(batch.column("b_ids")[at]), wide)
                common = a @ (b[0] + b[1]).T
                taken = ((common > 0) & (common / np.maximum(size, 1) > tau)).astype(np.float32)
                sums += np.hstack([taken @ b[0], taken @ b[2], taken.sum(axis=1, keepdims=True)]).astype(np.int64)  # at most SIDE each: exact
        if block is not None:
            yield handed(block, ids, sums)

    def handed(block, ids, sums):
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), ids, pa.array([sums.astype("<i4").tobytes()], pa.binary())], names=["block", "ids", "sums"])

    def whole(table: pa.Table) -> pa.Table:
        ids = table.column("ids").combine_chunks()[0].values
        total = sum(np.frombuffer(s.as_buffer(), "<i4").reshape(len(ids), -1).astype(np.int64) for s in table.column("sums"))
        gain = (w_fp + w_fn) * total[:, :wide] + w_fp * total[:, wide:-1] - w_fp * total[:, -1:]
        rows = (gain > 0).sum(axis=1)
        out = pa.table([ids, pa.array(np.maximum(gain, 0).sum(axis=1)), pa.array(rows)], names=["p", "gain", "rows"])
        return out.filter(pa.array(rows > 0))

    number = "bigint" if isinstance(w_fp + w_fn, int) else "double"
    summed = met(blocks, min(n, 512), min(n, max(4, -(-n // HELD)))).mapInArrow(partial, f"block bigint, ids array<{kind}>, sums binary")
    return summed.repartition(min(n, 512), "block").groupBy("block").applyInArrow(whole, f"p {kind}, gain {number}, rows bigint")
