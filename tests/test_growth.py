"""Patterns that grow by many lines."""

import numpy as np
import pytest

from bitloom.operators.matrix import BoolMatrix
from bitloom.plans import greedy


def grown(cells, rows, cols, w_fp, w_fn):
    """One line after the other, on the whole matrix."""
    value, rows, cols = np.where(cells, w_fn, -w_fp), set(rows), set(cols)
    while True:
        best = max([(value[i, sorted(cols)].sum(), 1, -i) for i in range(len(value)) if i not in rows] + [(value[sorted(rows), j].sum(), 0, -j) for j in range(value.shape[1]) if j not in cols], default=(0,))
        if best[0] <= 0:
            return rows, cols
        (rows if best[1] else cols).add(-best[2])


@pytest.mark.parametrize("w_fp, w_fn", [(2, 8), (3, 4)])
def test_all_lines_of_a_matrix_are_fetched_once(spark, monkeypatch, w_fp, w_fn):
    """More lines than 200 are added, and all gains are found once."""
    cells = np.random.default_rng(4).random((420, 9)) < np.where(np.arange(420) < 330, 0.75, 0.1)[:, None]
    calls, best = [], greedy._best_lines
    monkeypatch.setattr(greedy, "_best_lines", lambda *a: (calls.append(1), best(*a))[1])
    ids = {k: spark.range(n).selectExpr(f"id AS {k}") for k, n in (("i", 420), ("j", 9))}
    x = BoolMatrix(spark.createDataFrame([(int(i), int(j), 1) for i, j in np.argwhere(cells)], "i bigint, j bigint, x int"), ids["i"], ids["j"])
    rows, cols, added = greedy.expanded(x, greedy.Fit(), ids["i"].filter("i < 3"), ids["j"].filter("j < 2"), w_fp, w_fn)
    want = grown(cells, range(3), range(2), w_fp, w_fn)
    assert ({r["i"] for r in rows.collect()}, {r["j"] for r in cols.collect()}) == want and len(added) > 200 and len(calls) == 1


def test_fetched_lines_are_bounded():
    assert greedy.fetched(90_000, 120) == {"row": 90_000, "col": 120} and greedy.fetched(120, 90_000) == {"row": 120, "col": 90_000}
    for m, n in ((10**9, 3), (3, 10**9), (10**6, 10**6), (1, 1)):
        got = greedy.fetched(m, n)
        assert 1 <= got["row"] * got["col"] <= greedy.CELLS and max(got.values()) <= greedy.LINES
