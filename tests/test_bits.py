"""All pairs of columns as products of bits."""

import random

import pytest

from bitloom.operators import bits
from bitloom.operators.matrix import BoolMatrix
from bitloom.plans import greedy


def matrix(spark, m, n, seed, p=0.5):
    r = random.Random(seed)
    return BoolMatrix.of(spark.createDataFrame([(i, f"c{j}") for i in range(m) for j in range(n) if r.random() < p], "a int, b string"), "a", "b")


@pytest.mark.parametrize("side", [4, 1024])
def test_associations(spark, monkeypatch, side):
    monkeypatch.setattr(bits, "SIDE", side)
    x = matrix(spark, 13, 21, 1)
    for by in "ij":
        got, want = (sorted(map(tuple, greedy.associations(x, by, dense=d).collect())) for d in (True, False))
        assert got == want and len(want) > 100


@pytest.mark.parametrize("side", [4, 1024])
def test_fit_of_several_rounds(spark, monkeypatch, side):
    monkeypatch.setattr(bits, "SIDE", side)
    x = matrix(spark, 11, 18, 2)
    a, b = (greedy.asso(x, 3, 0.5, 4, 6, dense=d) for d in (True, False))
    for s in "uv":
        assert sorted(map(tuple, getattr(a, s).collect())) == sorted(map(tuple, getattr(b, s).collect()))
    assert a.log == b.log and a.k == 3


def test_many_columns_in_common_rows_are_not_joined(spark):
    """7,000,000 pairs of ones in 28 rows: products of bits. As many rows as columns, or few pairs: a join."""
    dense = spark.range(500).selectExpr("id AS j", "explode(sequence(0, 27)) AS i")
    assert bits.pays(dense) and not bits.pays(dense.filter("j < 50")) and not bits.pays(dense.selectExpr("j", "j * 100 + i AS i"))
    x = BoolMatrix.of(dense, "i", "j")
    assert "MapInArrow" in greedy.associations(x)._jdf.queryExecution().optimizedPlan().toString()
    assert greedy.associations(x).filter("c = 1").count() == 250_000
