"""Centroid clustering with a Walsh-Hadamard progressive search.

Vectors become integers, floor(SCALE * x). Their exact integer Walsh-Hadamard transform keeps distances: the squared differences
of all coefficients sum to `size` times the squared distance. Coefficients are taken coarse to fine (by their number of sign
changes), 1, 1, 2, 4, ... at a time: each step adds the squared differences of a vector's remaining centroids. The sum so far only
grows, so a centroid whose sum exceeds the whole distance of the best one so far is strictly worse and goes; the others finish
all coefficients, and of equals the smallest number wins. What is computed is exact, whatever the order of rows or batches.

Each round is one pass over the vectors: tasks assign their rows and add them up per centroid, Spark adds those sums, and k rows of
sums (k is a parameter) reach the driver, which holds the k centroids. The last assignment is written once, as ids and
distances; no vector is shuffled or written.

Defined results: rows whose vector is null, of another size, or has a null or non-finite component take no part; a null vec_id takes
part, but starts a centroid only after all others; rows of equal vec_id start centroids in the order of their vectors; repeated
rows keep their own output row; fewer vectors than k make fewer centroids; an empty table gives an empty table; other columns
are ignored; integers beyond 2^31 are refused with an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import converted, written
from .vectors import finite, largest, matrix, scaled

SCALE, SIZE, K, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Up to here all sums of squares fit into 64 bits, for 64 components; larger values are counted in Python's integers.
SMALL = 1 << 21


def sequency(size: int) -> np.ndarray:
    """Where the transform's butterflies leave the coefficient of 0, 1, ... sign changes: the reversed bits of its Gray code."""
    bits = size.bit_length() - 1
    return np.array([int(format(k ^ (k >> 1), f"0{bits}b")[::-1], 2) for k in range(size)])


def transformed(v: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, coarse to fine. The number of columns is a power of two."""
    n, size = v.shape
    step, out = 1, v
    while step < size:
        pair = out.reshape(n, size // (2 * step), 2, step)
        out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, size)
        step *= 2
    return out[:, sequency(size)]


def nearest(v: np.ndarray, centroids: np.ndarray, counted: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and the squared distance. counted: gets the number of pairs alive at each step."""
    (n, size), k = v.shape, len(centroids)
    if max(largest(v), largest(centroids)) > SMALL:
        v, centroids = v.astype(object), centroids.astype(object)
    a, c = transformed(v), transformed(centroids)
    row, to = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    so_far = np.zeros(n * k, a.dtype)
    least = None  # the least whole distance known of each row
    done = 0
    while done < size:
        upto = max(1, 2 * done)
        d = a[row, done:upto] - c[to, done:upto]
        so_far, done = so_far + (d * d).sum(axis=1), upto
        if counted is not None:
            counted.append(len(row))
        if done < size:
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            lead = to[first_of_least(so_far, row, first)]
            d = a - c[lead]
            whole = (d * d).sum(axis=1)
            least = whole if least is None else np.minimum(least, whole)
            stays = (so_far <= least[row]).astype(bool)
            row, to, so_far = row[stays], to[stays], so_far[stays]
    best = first_of_least(so_far, row, np.flatnonzero(np.r_[True, row[1:] != row[:-1]]))
    return to[best], so_far[best] // size


def first_of_least(values: np.ndarray, row: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row, whose pairs stand together from `first` on, the place of its least value; of equals the first."""
    least = np.minimum.reduceat(values, first)
    hit = np.flatnonzero(values == np.repeat(least, np.diff(np.r_[first, len(values)])))
    return hit[np.unique(row[hit], return_index=True)[1]]


def kept(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, v: the vectors that take part, as integers."""
    return vectors.filter(F.size("embedding") == size).filter(finite(F.col("embedding"))).select("vec_id", scaled(F.col("embedding"), scale).alias("v"))


def sums(rows: DataFrame, centroids: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """(centroid, rows, their sum) of each centroid that has rows."""
    size = centroids.shape[1]

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = matrix(batch.column("v"), size)
        if not len(v):
            return pa.RecordBatch.from_pydict({"cluster": pa.array([], pa.int32()), "n": pa.array([], pa.int64()), "s": pa.array([], pa.list_(pa.int64()))})
        cluster, _ = nearest(v, centroids)
        order = np.argsort(cluster, kind="stable")
        numbers, first, n = np.unique(cluster[order], return_index=True, return_counts=True)
        totals = np.add.reduceat(v[order], first, axis=0)
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(n, pa.int64()), pa.array(list(totals), pa.list_(pa.int64()))], names=["cluster", "n", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from converted(batches, made)

    parts = rows.select("v").mapInArrow(run, "cluster int, n bigint, s array<bigint>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("s", F.lit(d))).alias(f"s{d}") for d in range(size)])
    return [(r["cluster"], r["n"], list(r[2:])) for r in total.collect()]  # at most one row a centroid


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance."""
    size = centroids.shape[1]

    def made(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = matrix(batch.column("v"), size)
        cluster, distance = nearest(v, centroids) if len(v) else ([], [])
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from converted(batches, made)

    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance bigint")


def starts(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of smallest hash."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return np.array([r["v"] for r in rows.orderBy(key.asc_nulls_last(), "v").limit(k).select("v").collect()], np.int64)


def fitted(rows: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """The centroids after the rounds; a row of `kept` is a vector."""
    centroids = starts(rows, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        for cluster, n, total in sums(rows, centroids):
            centroids[cluster] = [s // n for s in total]
    return centroids


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, for each vector that takes part."""
    if size < 1 or size & (size - 1):
        raise ValueError(f"the transform needs a power of two components, not {size}")
    spark, rows = vectors.sparkSession, kept(vectors, size, scale)
    centroids = fitted(rows, k, rounds, seed)
    if not len(centroids):
        return assigned(rows, np.zeros((0, size), np.int64)).selectExpr("*", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256").limit(0)
    found = written(assigned(rows, centroids), "clusters")
    inertia = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # at most k
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    said = [(c, d, sum(inertia.values()), digest(centroids[c])) for c, d in inertia.items()]
    return found.join(F.broadcast(spark.createDataFrame(said, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle() -> str:
    """The rounds unrolled, distances by inner products of doubles, which are exact at this size."""
    square = "list_dot_product({a}, {a})"
    out = [
        f"k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, v) - 1 AS INTEGER) AS c, v AS m FROM (SELECT v, sha256('{SEED}:' || vec_id) AS h FROM k ORDER BY h, v LIMIT {K}))",
    ]
    for n in range(ROUNDS + 1):
        d = f"{square.format(a='v')} - 2 * list_dot_product(v, m) + {square.format(a='m')}"
        out.append(f"a{n} AS MATERIALIZED (SELECT r, arg_min(c, {{'d': d, 'c': c}}) AS c, min(d) AS d FROM (SELECT r, c, {d} AS d FROM k, c{n}) GROUP BY r)")
        if n < ROUNDS:
            new = f"SELECT c, list(m ORDER BY p) AS m FROM (SELECT c, p, CAST(CAST(sum(x) AS BIGINT) // count(*) - CAST(CAST(sum(x) AS BIGINT) % count(*) < 0 AS BIGINT) AS DOUBLE) AS m FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM k JOIN a{n} USING (r)) GROUP BY c, p) GROUP BY c"
            out.append(f"c{n + 1} AS MATERIALIZED (SELECT c, coalesce(n.m, o.m) AS m FROM c{n} o LEFT JOIN ({new}) n USING (c))")
    text = "array_to_string(list_transform(m, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')"
    return f"WITH {', '.join(out)} SELECT vec_id, c AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256({text}) AS centroid_sha256 FROM a{ROUNDS} JOIN k USING (r) JOIN c{ROUNDS} USING (c)"


ORACLE = oracle()
