"""Products whose cells outnumber the ids by far."""

import random

import pytest

from bitloom.operators import algebra
from bitloom.plans import catalog
from bitloom.sources import generators

D = "/root/testdata/sf0.001"


def sides(spark, m, n, k, seed, p=0.4):
    r = random.Random(seed)
    u, v = ([(x, f) for x in range(size) for f in range(k) if r.random() < p] for size in (m, n))
    return u, v, spark.createDataFrame(u, "i bigint, f int"), spark.createDataFrame(v, "j bigint, f int")


@pytest.mark.parametrize("rows, cols", [(3, 4), (7, 1), (2048, 65_536)])
def test_tiled_product(spark, rows, cols):
    a, b, u, v = sides(spark, 37, 23, 4, 1)
    got = [tuple(r) for r in algebra.tiled_matmul(u, v, rows, cols).collect()]
    want = {(i, j) for i, f in a for j, g in b if f == g}
    assert len(got) == len(want) and set(got) == want
    assert algebra.tiled_matmul(u.filter("f < 0"), v).count() == 0


def cells_shuffled(df):
    return any("Exchange" in line and "hashpartitioning(i#" in line and "j#" in line for line in df._jdf.queryExecution().executedPlan().toString().splitlines())


def test_synthetic_shuffles_no_cells(spark):
    assert not cells_shuffled(catalog.gen_synthetic(spark, D))


def test_blocks_shuffle_no_cells(spark):
    assert not cells_shuffled(catalog.gen_blocks(spark, D))


def test_block_diagonal_shuffles_no_cells(spark):
    assert not cells_shuffled(catalog.gen_block_diagonal(spark, D))
    x = generators.matrix(*generators.block_diagonal(spark, 40, 30, 3, (0.25, 0.5)), 40, 30).ones
    want = {(i, j) for (a, b), (c, d) in zip(generators.block_bounds(40, 3, 0.25), generators.block_bounds(30, 3, 0.5)) for i in range(a, b) for j in range(c, d)}
    assert sorted(map(tuple, x.collect())) == sorted(want)


def test_shuffled_product_moves_ids_only(spark):
    _, _, u, v = sides(spark, 31, 17, 3, 2)
    x, got = generators.matrix(u, v, 31, 17), generators.shuffle_product(u, v, 31, 17, 4)
    assert sorted(map(tuple, got.ones.collect())) == sorted(map(tuple, generators.shuffle_matrix(x, 4).ones.collect())) and (got.m, got.n) == (31, 17)
    assert not cells_shuffled(catalog.gen_shuffle(spark, D))


def large(spark):
    """Sides of 5,000,000 ids each, a product of 25,000,000,000,000 cells; the second factor has every other row."""
    u, v = (spark.range(5_000_000).selectExpr(f"id AS {k}", "0 AS f") for k in "ij")
    return u.unionByName(u.filter("i % 2 = 0").selectExpr("i", "1 AS f")), v.unionByName(v.selectExpr("j", "1 AS f"))


def test_density_of_a_product_that_cannot_be_made(spark):
    u, v = large(spark)
    assert generators.product_density(u, v, 10_000_000, 5_000_000).first()[0] == 0.5
    a, b, u, v = sides(spark, 20, 15, 3, 3)
    assert generators.product_density(u, v, 20, 15).first()[0] == len({(i, j) for i, f in a for j, g in b if f == g}) / 300


def test_overlap_of_a_product_that_cannot_be_made(spark):
    assert generators.overlap(*large(spark), 5_000_000, 5_000_000).first()[0] == 0.5
    a, b, u, v = sides(spark, 20, 15, 3, 5)
    met = [(i, j) for i, f in a for j, g in b if f == g]
    assert generators.overlap(u, v, 20, 15).first()[0] == sum(met.count(c) > 1 for c in set(met)) / 300


def test_noise_hashes_the_grid_in_arrays(spark):
    """The cells are those of the same noise by Spark's md5, of which no exchange is left."""
    _, _, u, v = sides(spark, 123, 31, 3, 6)
    got, want = (x.ones for x in (generators.noisy_product(u, v, 123, 31, 0.4, 0.05, 9), generators.add_noise(generators.matrix(u, v, 123, 31), 0.4, 0.05, 9)))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert generators.noisy_product(u, v, 123, 31, 0.0, 0.0).ones.count() == algebra.bool_matmul(u, v).count()
    assert not cells_shuffled(catalog.gen_noise(spark, D))


def test_heads_are_md5():
    import hashlib

    import numpy as np

    from bitloom.functions.md5 import Keys, limit

    for rows in ([7], [10, 99], [123456789012345678]):
        cols = np.array([0, 5, 10, 4321, 98765432109876543])
        got = Keys("9:neg", cols).heads(np.array(rows))
        want = [[int(hashlib.md5(f"9:neg:{i}:{j}".encode()).hexdigest()[:8], 16) for j in cols] for i in rows]
        assert got.tolist() == want and Keys("9:neg", cols).heads(np.array(rows), np.array([3, 1])).tolist() == [[w[3], w[1]] for w in want]
    assert [int(limit(p)) for p in (0.0, 0.5, 1.0)] == [0, 2**31, 2**32]
    with pytest.raises(ValueError, match="55"):
        Keys("9" * 60, cols).heads(np.array([1]))
