"""Blocked grids, drawn negatives, threshold search, lazy covers, bounded concepts, best sets and merges against brute force."""

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from bitloom.operators import algebra, blocks, metrics, splits
from bitloom.operators.matrix import BoolMatrix, cumulated, located
from bitloom.plans import continuous, greedy
from bitloom.plans import threshold_search as ts


def named(spark, m, n, ones):
    """Rows are numbers, columns are names; all are in the dimensions."""
    cells = spark.createDataFrame([(i, f"c{j:03}", 1) for i, j in ones], "i bigint, j string, x int")
    return BoolMatrix(cells, spark.range(m).withColumnRenamed("id", "i"), spark.createDataFrame([(f"c{j:03}",) for j in range(n)], "j string"))


def dense(m, n, share, seed):
    r = random.Random(seed)
    return np.array([[r.random() < share for _ in range(n)] for _ in range(m)])


def ones_of(x):
    return [(int(i), int(j)) for i, j in zip(*np.nonzero(x))]


def sides(spark, a, b):
    k = a.shape[1]
    u = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(a)], ", ".join(["i bigint", *[f"f{f} double" for f in range(k)]]))
    v = spark.createDataFrame([(f"c{j:03}", *map(float, r)) for j, r in enumerate(b)], ", ".join(["j string", *[f"f{f} double" for f in range(k)]]))
    return u, v


@pytest.fixture(scope="module")
def small(spark):
    x, r = dense(11, 7, 0.4, 1), np.random.default_rng(2)
    a, b = r.random((11, 2)), r.random((7, 2))
    return x, a, b, named(spark, 11, 7, ones_of(x)), *sides(spark, a, b)


def array(df, key, names):
    return np.array([[r[c] for c in names] for r in df.orderBy(key).collect()])


@pytest.mark.parametrize("side", [3, 1024])
def test_blocked_steps(small, side):
    x, a, b, m, u, v = small
    y = a @ b.T
    s = 1 / (1 + np.exp(-5 * (y - 0.5)))
    d = s * (1 - s)
    assert np.isclose(continuous.link_error(m, u, v, 5.0, side), ((x - s) ** 2).sum() / 2)
    for key, mine, across, w in (("i", a, b, lambda z: z), ("j", b, a, lambda z: z.T)):
        top, low = 5 * w(x * d) @ across + 6 * mine**2, 5 * w(s * d) @ across + 4 * mine**3 + 2 * mine
        got = continuous.pnlpf_step(m, *((u, v) if key == "i" else (v, u)), key, 2, 2.0, 5.0, side)
        assert np.allclose(array(got, key, ["f0", "f1"]), mine * top / low)
    z = np.where(x, -1, 1) * (y - 0.6)
    assert np.isclose(continuous.faststep_value(m, u, v, 0.6, side), np.log1p(np.exp(z)).sum())
    slope = np.where(x, -1, 1) / (1 + np.exp(-z))
    gu, gv = continuous.faststep_gradient(m, u, v, 2, 0.6, 1, side)
    assert np.allclose(array(gu, "i", ["g"])[:, 0], slope @ b[:, 1]) and np.allclose(array(gv, "j", ["g"])[:, 0], slope.T @ a[:, 1])
    got = continuous.faststep_steps(m, u, v, 2, 0.6, 1, gu, gv, [0.5, 0.01], 0.1, side)
    for alpha, value in zip((0.5, 0.01), got):
        p, q = a.copy(), b.copy()
        p[:, 1], q[:, 1] = np.maximum(a[:, 1] - alpha * (slope @ b[:, 1]), 0.1), np.maximum(b[:, 1] - alpha * (slope.T @ a[:, 1]), 0.1)
        assert np.isclose(value, np.log1p(np.exp(np.where(x, -1, 1) * (p @ q.T - 0.6))).sum())


def test_no_row_per_cell(small):
    x, _, _, m, u, v = small
    plan = continuous.faststep_loss(m, u, v, 0.6)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    rows = blocks.on_blocks(m, u, v, lambda i, j, a, b, ones: continuous.pa.table({"n": [len(i) * len(j)], "h": [int(ones.sum())]}), "n bigint, h bigint", 3).collect()
    assert len(rows) == 12 and sum(r["n"] for r in rows) == 77 and sum(r["h"] for r in rows) == x.sum()  # 4 x 3 blocks


def test_no_ids(spark):
    m = named(spark, 3, 2, [])
    u, v = sides(spark, np.ones((3, 1)), np.ones((2, 1)))
    assert np.isclose(continuous.faststep_value(m, u, v, 1.0), 6 * np.log(2)) and array(continuous.pnlpf_step(m, u, v, "i", 1, 1.0, 1.0), "i", ["f0"]).shape == (3, 1)


# ---- negatives ---------------------------------------------------------------------------------------------------------


def drawn(x, kind, seed, size):
    """The first cells that draws find, one draw after the other."""
    m, n = x.shape
    fine = lambda *key: int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:13], 16) / 2.0**52
    lots = {"i": np.repeat(np.arange(m), x.sum(axis=1)), "j": np.repeat(np.arange(n), x.sum(axis=0))}
    found, t = {}, 0
    while len(found) < size:
        u, w = fine(f"{seed}:i", t), fine(f"{seed}:j", t)
        cell = (int(u * m), int(w * n)) if kind == "uniform" else (int(lots["i"][int(u * x.sum())]), int(lots["j"][int(w * x.sum())]))
        if not x[cell]:
            found.setdefault(cell, t)
        t += 1
    return set(found)


@pytest.mark.parametrize("kind", ["uniform", "popularity"])
def test_draws(spark, kind):
    x = dense(13, 9, 0.3, 3)
    x[4] = False
    got = [(r["i"], int(r["j"][1:]), r["x"]) for r in splits.negative_sample(named(spark, 13, 9, ones_of(x)), 30, kind, 7).collect()]
    assert {g[:2] for g in got} == drawn(x, kind, 7, 30) and len(got) == 30 and {g[2] for g in got} == {0}
    if kind == "popularity":
        assert 4 not in {g[0] for g in got}


@pytest.mark.parametrize("kind", ["uniform", "popularity"])
def test_all_zeros(spark, kind, monkeypatch):
    monkeypatch.setattr(splits, "FRUITFUL", 0.5)  # the rest comes from the grid
    x = dense(6, 5, 0.5, 4)
    x[:, 0] = True
    zeros = {(int(i), int(j)) for i, j in zip(*np.nonzero(~x)) if x[i].any() and x[:, j].any() or kind == "uniform"}
    m = named(spark, 6, 5, ones_of(x))
    assert {(r["i"], int(r["j"][1:])) for r in splits.negative_sample(m, len(zeros), kind).collect()} == zeros
    with pytest.raises(ValueError):
        splits.negative_sample(m, len(zeros) + 1, kind)
    assert splits.negative_sample(m, 0, kind).count() == 0


def test_large_grid(spark):
    """A million rows and columns: nothing may grow with their product."""
    n = 1_000_000
    rows, cols = spark.range(n).withColumnRenamed("id", "i"), spark.range(n).withColumnRenamed("id", "j")
    cells = spark.range(20_000).select((F.col("id") * 37 % n).alias("i"), (F.pmod(F.xxhash64("id"), F.lit(n))).alias("j"), F.lit(1).alias("x"))
    m = BoolMatrix(cells, rows, cols)
    for kind in ("uniform", "popularity"):
        got = splits.negative_sample(m, 5000, kind, 1)
        assert got.select("i", "j").distinct().count() == 5000 and got.join(cells, ["i", "j"]).count() == 0


def test_spans(spark):
    w = [(k, 1 + k % 5 + 40 * (k == 6)) for k in range(20)]
    s = cumulated(spark.createDataFrame(w, "k int, w int"), "k", "w")
    ends = list(itertools.accumulate(b for _, b in w))
    assert sorted(map(tuple, s.select("k", "start", "end").collect())) == [(k, e - b, e) for (k, b), e in zip(w, ends)]
    got = located(spark.range(ends[-1]), "id", s, 3).collect()
    assert sorted((r["id"], r["k"]) for r in got) == list(enumerate(k for k, b in w for _ in range(b)))


def test_negative_parts(spark):
    x = dense(12, 10, 0.3, 5)
    m = named(spark, 12, 10, ones_of(x))
    got = splits.negative_parts(m, 9, 4, 6, "popularity", 3)
    assert Counter(r["part"] for r in got.collect()) == {"train": 9, "val": 4, "test": 6} and got.select("i", "j").distinct().count() == 19
    whole = splits.appended(splits.ratio_split(m, None, 0.2, 0.2, 1), got)
    parts = splits.matrices(m, whole)
    assert sum(p.ones.count() for p in parts.values()) == x.sum() and parts["train"].cells.filter("x = 0").count() == 9 and parts["val"].m == 12
    folds = Counter(r["fold"] for r in splits.negative_folds(m, 3, 10, 4, "uniform", 3).collect())
    assert folds == {0: 4, 1: 3, 2: 3, -1: 4}
    assert all(p.cells.count() == x.sum() + 19 for p in splits.no_split(m, got).values()) and splits.no_split(m)["val"] is m


# ---- thresholds --------------------------------------------------------------------------------------------------------


def counted(x, a, b, us, vs):
    hit = ((a > us).astype(int) @ (b > vs).astype(int).T) > 0
    return int(x.sum()), int(hit.sum()), int((hit & x).sum()), x.size


def f1(p, q, tp, n):
    return 2 * tp / (p + q) if tp else 0.0


def test_threshold_search(spark, small):
    x, a, b, m, u, v = small
    at_u, at_v = [0.1, 0.55, a[3, 0], 2.0], [b[2, 1], 0.3, 0.8]
    for r in ts.grid_counts(m, u, v, 2, at_u, at_v, 4).collect():
        assert tuple(r)[2:] == counted(x, a, b, r["at_u"], r["at_v"])
    trials = ts.random_trials(spark, u, v, 2, 12, True, 3)
    assert trials != ts.random_trials(spark, u, v, 2, 12, True, 4)
    for r in ts.trial_counts(m, u, v, 2, trials, 4).collect():
        assert tuple(r)[1:] == counted(x, a, b, *map(np.array, trials[r["trial"]]))
    grid = ts.simple_threshold(m, u, v, 2, n_grid=6)
    best = max(f1(*counted(x, a, b, s, t)) for s in ts.steps(a.min(), a.max(), 6) for t in ts.steps(b.min(), b.max(), 6))
    assert np.isclose(grid.score, best) and np.isclose(f1(*counted(x, a, b, np.array(grid.us), np.array(grid.vs))), best)
    swept = ts.simple_threshold(m, u, v, 2, columnwise=True, n_grid=6)
    assert swept.score >= grid.score and np.isclose(swept.score, f1(*counted(x, a, b, np.array(swept.us), np.array(swept.vs))))
    tried = ts.simple_threshold(m, u, v, 2, "ACC", columnwise=True, randomize=True, n_trials=12, seed=3)
    acc = lambda p, q, tp, n: 1 - (p + q - 2 * tp) / n
    assert np.isclose(tried.score, max(acc(*counted(x, a, b, *map(np.array, t))) for t in trials))


def test_sweep_steps(small):
    """Each step finds the best single threshold."""
    x, a, b, m, u, v = small
    log = ts.sweep(m, u, v, 2, [0.5, 0.5], [0.4, 0.6], rounds=1).log
    us, vs, held = np.array([0.5, 0.5]), np.array([0.4, 0.6]), -1.0
    for s in log:
        at, values = (us, a[:, s["f"]]) if s["side"] == "u" else (vs, b[:, s["f"]])
        tried = []
        for t in [*values, values.min() - 1]:
            old, at[s["f"]] = at[s["f"]], t
            tried.append((f1(*counted(x, a, b, us, vs)), t))
            at[s["f"]] = old
        if max(tried)[0] > held + 1e-12:
            held, at[s["f"]] = max(tried)
        assert np.isclose(s["score"], held) and np.isclose(s["t"], at[s["f"]])


# ---- covers ------------------------------------------------------------------------------------------------------------


def test_lazy_cover(spark, monkeypatch):
    x = dense(14, 8, 0.5, 6)
    x[:9, :3] = True
    m = named(spark, 14, 8, ones_of(x))
    monkeypatch.setattr(greedy, "SCORED", 2)
    fit = greedy.hyper(m, 0.5)
    sets = [{j} for j in range(8)] + [set(c) for n in range(2, 9) for c in itertools.combinations(range(8), n) if x[:, list(c)].all(axis=1).mean() >= 0.5]
    open_, names = x.copy(), []
    name = lambda s: "+".join(f"c{j:03}" for j in sorted(s))
    while open_.any():
        tried = []
        for s in sets:
            cols = sorted(s)
            rows = [i for i in range(14) if x[i, cols].all() and open_[i, cols].any()]
            if rows:
                tried.append(((len(rows) + len(cols)) / open_[np.ix_(rows, cols)].sum(), name(s), rows, cols))
        _, best, rows, cols = min(tried, key=lambda t: t[:2])
        open_[np.ix_(rows, cols)] = False
        names.append(best)
    assert [r["c"] for r in fit.log] == names
    assert all(r["scored"] < fit.log[0]["scored"] for r in fit.log[1:]) and sum(r["idle"] for r in fit.log) > 0


def test_bounded_concepts(spark):
    x = dense(16, 9, 0.45, 8)
    x[:6, :4] = True
    m = named(spark, 16, 9, ones_of(x))
    fit = greedy.grecond(m, counted=True)
    open_, scores = x.copy(), []
    while open_.any():
        rows, cols, score = list(range(16)), [], 0
        while True:
            tried = []
            for j in range(9):
                if j not in cols and open_[rows, j].any():
                    inside = [i for i in rows if x[i, j]]
                    closure = [c for c in range(9) if x[inside, c].all()]
                    tried.append((-open_[np.ix_(inside, closure)].sum(), j, inside, closure))
            if not tried or -min(tried)[0] <= score:
                break
            best = min(tried)
            score, rows, cols = -best[0], best[2], best[3]
        open_[np.ix_(rows, cols)] = False
        scores.append(score)
    assert [r["score"] for r in fit.log] == scores
    wide = dense(60, 40, 0.4, 9)
    log = greedy.grecond(named(spark, 60, 40, ones_of(wide)), 1, counted=True).log
    assert log[0]["pairs"] < log[0]["of"] / 2


def test_best_set():
    r = np.random.default_rng(3)
    for _ in range(40):
        member, gain = r.random((7, 6)) < 0.35, r.integers(-6, 7, 7)
        score = lambda s: int(gain[member[:, list(s)].any(axis=1)].sum()) if s else 0  # noqa: B023,E731
        number = lambda s: sum(1 << (5 - f) for f in s)
        every = [s for n in range(7) for s in itertools.combinations(range(6), n)]
        assert greedy.best_set(gain, member) == (list(min(every, key=lambda s: (-score(s), number(s)))), max(map(score, every)))


def test_best_sets_of_many_patterns(spark):
    """30 patterns that are ten different ones three times: brute force over the ten."""
    r = random.Random(4)
    x = dense(12, 10, 0.5, 10)
    cols = [sorted(r.sample(range(10), 3)) for _ in range(10)]
    fit = greedy.Fit(None, spark.createDataFrame([(f"c{j:03}", f) for f in range(30) for j in cols[f % 10]], "j string, f int"), 30)
    got = {row["i"]: row for row in greedy.best_sets(named(spark, 12, 10, ones_of(x)), fit, 4, 6).collect()}
    for i in range(12):
        value = lambda s: sum(6 if x[i, j] else -4 for j in set().union(*(cols[f] for f in s)))  # noqa: B023,E731
        best = max(value(s) for n in range(11) for s in itertools.combinations(range(10), n))
        assert got[i]["score"] == best == value({f % 10 for f in got[i]["factors"]})
    choice = greedy.asso_opt(named(spark, 12, 10, ones_of(x)), fit, 4, 6)
    assert {(c["i"], c["f"]) for c in greedy.rows_of_choice(choice, 30).collect()} == {(i, f) for i, row in got.items() for f in row["factors"]}


def test_merges_keep_their_counts(spark):
    x = dense(12, 10, 0.4, 11)
    r = random.Random(5)
    tiles = [(sorted(r.sample(range(12), 3)), sorted(r.sample(range(10), 3))) for _ in range(6)]
    u = spark.createDataFrame([(i, f) for f, (rows, _) in enumerate(tiles) for i in rows], "i bigint, f int")
    v = spark.createDataFrame([(f"c{j:03}", f) for f, (_, cols) in enumerate(tiles) for j in cols], "j string, f int")
    fit = greedy.hyper_plus(named(spark, 12, 10, ones_of(x)), greedy.Fit(u, v, 6), 2)
    held, new = {f: (set(a), set(b)) for f, (a, b) in enumerate(tiles)}, 6
    for said in fit.log:
        covered = {(i, j) for a, b in held.values() for i in a for j in b}
        tried = []
        for a, b in itertools.combinations(sorted(held), 2):
            rows, cols = held[a][0] | held[b][0], held[a][1] | held[b][1]
            saved = sum(map(len, (*held[a], *held[b]))) - len(rows) - len(cols)
            fresh = len({(i, j) for i in rows for j in cols} - covered)
            tried.append((-(saved / fresh if fresh else float("inf")), a, b))
        _, a, b = min(tried)
        assert said["merged"] == (a, b) and np.isclose(said["savings"], -min(tried)[0])
        held[new] = tuple(p | q for p, q in zip(held.pop(a), held.pop(b)))
        new += 1
    assert fit.log[0]["counted"] == 15 and all(s["counted"] == len(held) + 4 - n - 1 for n, s in enumerate(fit.log[1:], 1))  # only the new pattern's pairs


def test_rows_of_many_ones(spark):
    x = dense(9, 60, 0.1, 12)
    x[3] = True
    m = named(spark, 9, 60, ones_of(x))
    key = greedy.row_pairs(m.ones, 16).groupBy("i", "a", "b").count()
    assert key.agg(F.max("count")).first()[0] <= 4 * 16 * 16  # against 3600 pairs of the full row
    assert sorted(map(tuple, greedy.associations(m, tile=16).collect())) == sorted(map(tuple, greedy.associations(m).collect()))


def test_many_patterns(spark):
    """70 patterns: pairs of masks meet by their factors, each pair once."""
    r = random.Random(6)
    a, b = dense(15, 70, 0.06, 13), dense(12, 70, 0.06, 14)
    x = dense(15, 12, 0.4, 15)
    u = spark.createDataFrame([(i, f) for i, f in ones_of(a)], "i bigint, f int")
    v = spark.createDataFrame([(f"c{j:03}", f) for j, f in ones_of(b)], "j string, f int")
    hit = (a.astype(int) @ b.T.astype(int)) > 0
    got = metrics.factor_counts(named(spark, 15, 12, ones_of(x)).ones, u, v, 180).first()
    assert tuple(got[c] for c in ("p", "q", "tp", "n")) == (x.sum(), hit.sum(), (hit & x).sum(), 180) and r
    pairs = algebra.hit_pairs(algebra.masks(u, "i"), "mask", algebra.masks(v, "j").withColumnRenamed("mask", "other"), "other").select("i", "j").collect()
    assert sorted((p["i"], int(p["j"][1:])) for p in pairs) == ones_of(hit)


def test_iterations_end_by_themselves(spark):
    x = dense(10, 8, 0.5, 16)
    m = named(spark, 10, 8, ones_of(x))
    fit = greedy.asso(m, 2, 0.5, 1, 1)
    done = greedy.asso_iter(m, fit, 1, 1)
    assert not any("converged" in s for s in done.log) and greedy.asso_iter(m, fit, 1, 1, max_rounds=0).log[-1] == {"converged": False, "rounds": 0}
