import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from bitloom.functions.scalar import sigmoid, uniform
from bitloom.operators import aggregates, algebra, collective, metrics, splits
from bitloom.operators.matrix import BoolMatrix, factorized
from bitloom.plans import catalog, continuous, greedy
from bitloom.plans.stopping import limited, line_search, stop_reason
from bitloom.sources import generators, readers, store

D = "/root/testdata/sf0.001"
SLOW = {"split_ratio", "split_cv_fold", "collective_cover", "collective_sample"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in catalog.ORACLE_SQL if n not in SLOW])
def test_against_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, D)
    names = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    key = lambda r: tuple(str(v) for v in r)
    got = sorted(map(tuple, df.select(*names).collect()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want, key=key)):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y, abs_tol=2e-6)) for x, y in zip(a, b)), (a, b)


def matrix(spark, m, n, cells, zeros=()):
    df = spark.createDataFrame([(i, j, 1) for i, j in cells] + [(i, j, 0) for i, j in zeros], "i int, j int, x int")
    dim = lambda k, c: spark.range(k).select(F.col("id").cast("int").alias(c))
    return BoolMatrix(df, dim(m, "i"), dim(n, "j"))


def block(spark):
    return matrix(spark, 4, 5, [(r, c) for r in (0, 1) for c in (0, 1, 2)] + [(r, c) for r in (2, 3) for c in (2, 3, 4)])


def test_exact_methods_cover_blocks(spark):
    x = block(spark)
    for fit in (greedy.grecond(x), greedy.hyper(x, 0.4), greedy.asso(x, 2, 0.6, 1, 1), greedy.panda(x, 2), greedy.transposed(greedy.grecond, x), greedy.grecond_plus(x, 3)):
        t = fit.counts(x)
        assert (t["q"], t["tp"]) == (t["p"], t["p"]) and fit.k == 2
    assert greedy.mebf(x, 3, 0.5).counts(x)["tp"] == 12


def test_more_than_63_patterns(spark):
    """Pattern 64 is not pattern 0."""
    x = matrix(spark, 70, 70, [(i, i) for i in range(70)])
    u, v = (spark.createDataFrame([(i, i) for i in range(70)], f"{c} int, f int") for c in "ij")
    fit = greedy.Fit(u, v, 70)
    assert fit.counts(x) == {"p": 70, "q": 70, "tp": 70, "n": 4900}
    hit = algebra.predicted(matrix(spark, 70, 70, [(i, j) for i in (0, 1, 6, 64, 69) for j in range(70)]).ones, u, v)
    assert {(r["i"], r["j"]) for r in hit.filter("hit").collect()} == {(i, i) for i in (0, 1, 6, 64, 69)}
    part = greedy.Fit(u.filter("i < 69"), v.filter("j < 69"), 69)
    assert [(r["i"], r["j"]) for r in greedy.cells(x, part).filter("NOT hit").collect()] == [(69, 69)]


def test_lines_stay_in_spark(spark, monkeypatch):
    """Neither the middle line nor the order of items is found on the driver or in one array."""
    x = matrix(spark, 6, 9, [(i, j) for i in range(6) for j in range(9) if (i < 3) == (j < 4) or (i + 2 * j) % 7 == 0])
    left = greedy.cells(x, greedy.Fit())
    for axis, key in ((0, "j"), (1, "i")):
        sums = sorted((-r["count"], r[key]) for r in x.ones.groupBy(key).count().collect())
        n, line = sums[len(sums) // 2]
        middle = greedy.median_line(left, axis)
        assert [tuple(r) for r in middle.collect()] == [(line, -n)]
        assert "collect_list" not in middle._jdf.queryExecution().toString()
    kind, most = type(x.ones), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: most.append(len(out := collect(df))) or out)
    fit = greedy.panda(x, 2)
    monkeypatch.undo()
    assert fit.k == 2 and max(most) == 1
    assert sorted(map(tuple, fit.u.collect())) == [(i, int(i > 2)) for i in range(6)] and sorted(map(tuple, fit.v.collect())) == [(j, int(j > 3)) for j in range(9)]


def test_fits_run_to_their_end(spark):
    import inspect

    for fit in (greedy.expanded, greedy.grecond_plus):
        assert inspect.signature(fit).parameters["most"].default is None
    errors = continuous.nmf(block(spark), 2, max_iter=1000, converged=0.05)[2]
    n = len(errors) - 1
    assert n < 1000 and n % 10 == 0 and errors[-11] ** 0.5 - errors[-1] ** 0.5 < 0.05 * errors[0] ** 0.5


def test_expansion_in_batches(spark):
    """Whether few or many lines are fetched at once, the lines picked are those of one by one."""
    import random

    r = random.Random(5)
    ones = {(i, j) for i in range(14) for j in range(11) if r.random() < (0.7 if (i < 8) == (j < 6) else 0.25)}
    x = matrix(spark, 14, 11, sorted(ones))
    fit = greedy.Fit(spark.createDataFrame([(0, 0), (9, 0)], "i int, f int"), spark.createDataFrame([(1, 0), (7, 0)], "j int, f int"), 1)
    covered = {(i, j) for i in (0, 9) for j in (1, 7)}
    rows, cols, want = {1, 2}, {0, 3}, []
    value = lambda i, j: 0 if (i, j) in covered else 8 if (i, j) in ones else -2
    while True:
        open_ = lambda cells: any((c in ones) and c not in covered for c in cells)
        gains = [(sum(value(i, j) for j in cols), 1, -i, ("row", i)) for i in range(14) if i not in rows and open_([(i, j) for j in cols])]
        gains += [(sum(value(i, j) for i in rows), 0, -j, ("col", j)) for j in range(11) if j not in cols and open_([(i, j) for i in rows])]
        best = max(gains, default=(0,))
        if best[0] <= 0:
            break
        want.append(best[3])
        (rows if best[3][0] == "row" else cols).add(best[3][1])
    of = lambda ids, c: spark.createDataFrame([(v,) for v in ids], f"{c} int")
    for lines in (3, 200):
        got = greedy.expanded(x, fit, of([1, 2], "i"), of([0, 3], "j"), 2, 8, None, lines)
        assert got[2] == want and {v for (v,) in got[0].collect()} == rows and {v for (v,) in got[1].collect()} == cols
    assert len(want) > 6 and greedy.expanded(x, fit, of([1, 2], "i"), of([0, 3], "j"), 2, 8, 2)[2] == want[:2]


def test_itemsets_of_any_size(spark):
    x = matrix(spark, 3, 5, [(i, j) for i in range(3) for j in range(5)])
    assert greedy.itemsets(x, 0.5).select("c").distinct().count() == 31 and greedy.itemsets(x, 0.5, 2).select("c").distinct().count() == 15
    assert greedy.hyper(x, 0.5).k == 1


def test_opt_and_iter(spark):
    x = block(spark)
    fit = greedy.asso(x, 2, 0.6, 1, 1)
    u = greedy.rows_of_choice(greedy.asso_opt(x, fit), 2)
    assert algebra.bool_matmul(u, fit.v).count() == 12
    broken = greedy.Fit(fit.u.filter("i > 0"), fit.v, 2)
    assert greedy.asso_iter(x, broken, 1, 1).counts(x)["tp"] == 12
    assert greedy.hyper_plus(x, fit, 1, seed=3).v.select("f").distinct().count() == 1
    assert greedy.hyper_plus(x, fit, 1, beta=0.0).v.select("f").distinct().count() == 2


def test_empty_rows_stay(spark):
    x = matrix(spark, 3, 3, [(0, 0), (2, 2)])
    assert sorted((r["axis"], r["id"], r["n"]) for r in aggregates.axis_sums(x).collect()) == [(a, str(k), int(k != 1)) for a in ("col", "row") for k in range(3)]
    assert x.T.m == 3 and algebra.invert(x.ones, x.rows, x.cols).count() == 7


def test_known_zeros(spark):
    x = matrix(spark, 2, 3, [(0, 0), (1, 2)], [(0, 1)])
    one = greedy.Fit(spark.createDataFrame([(0, 0)], "i int, f int"), spark.createDataFrame([(0, 0), (1, 0)], "j int, f int"), 1)
    got = metrics.stored_counts(x.cells, one.u, one.v).first().asDict()
    assert got == {"p": 2, "q": 2, "tp": 1, "n": 3}


def test_metric_edges(spark):
    of = lambda *c: metrics.metrics(spark.createDataFrame([c], "p long, q long, tp long, n long"), ("Recall", "TNR", "FPR", "FNR", "Precision", "F1", "ERR")).first()
    assert tuple(of(4, 4, 4, 4)) == (1.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0)
    assert tuple(of(0, 0, 0, 4)) == (0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        metrics.metrics(spark.createDataFrame([(1, 1, 1, 1)], "p long, q long, tp long, n long"), ("nonsense",))


@settings(max_examples=8, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 4), st.integers(0, 4)), min_size=1), st.sets(st.tuples(st.integers(0, 4), st.integers(0, 2))), st.sets(st.tuples(st.integers(0, 4), st.integers(0, 2))))
def test_products_and_gains(spark, cells, us, vs):
    """Product, counts and gains against numpy."""
    x = matrix(spark, 5, 5, cells)
    u, v = spark.createDataFrame(sorted(us), "i int, f int"), spark.createDataFrame(sorted(vs), "j int, f int")
    a = np.zeros((5, 5), int)
    b, c = np.zeros((5, 3), int), np.zeros((5, 3), int)
    for at, ones in ((a, cells), (b, us), (c, vs)):
        for p in ones:
            at[p] = 1
    y = (b @ c.T > 0).astype(int)
    assert {tuple(r) for r in algebra.bool_matmul(u, v).collect()} == {(i, j) for i in range(5) for j in range(5) if y[i, j]}
    assert metrics.factor_counts(x.ones, u, v, 25).first().asDict() == {"p": a.sum(), "q": y.sum(), "tp": (a * y).sum(), "n": 25}
    cover = lambda p: 6 * (a * p).sum(axis=1) - 4 * ((1 - a) * p).sum(axis=1)
    for r in greedy.gains(x, v.select(F.col("f").alias("p"), "j"), greedy.Fit(u, v, 3), 4, 6).collect():
        new = y.copy()
        new[r["i"]] |= c[:, r["p"]]
        assert r["gain"] == (cover(new) - cover(y))[r["i"]] > 0


def test_splits(spark):
    x = matrix(spark, 10, 10, [(i, j) for i in range(10) for j in range(10) if (i * 7 + j * j) % 4])
    n = x.ones.count()
    parts = {r["part"]: r["count"] for r in splits.ratio_split(x, None, 0.1, 0.2, 1).groupBy("part").count().collect()}
    assert parts == {"train": n - math.ceil(0.1 * n) - math.ceil(0.2 * n), "val": math.ceil(0.1 * n), "test": math.ceil(0.2 * n)}
    folds = {r["fold"]: r["count"] for r in splits.cross_validation(x, 3, 0.2, 1).groupBy("fold").count().collect()}
    assert folds[-1] == math.ceil(0.2 * n) and sum(folds.values()) == n and folds[0] - folds[2] in (0, 1)
    for kind in ("uniform", "popularity"):
        neg = splits.negative_sample(x, 7, kind, 3)
        assert neg.count() == 7 and neg.join(x.ones, ["i", "j"]).count() == 0
    for bad in ((None, -1, None), (None, 0.6, 0.6), (1000, None, None)):
        with pytest.raises(ValueError):
            splits.sizes(100, *bad)


def test_generators(spark):
    assert generators.block_bounds(10, 2, 0.0) == [(0, 5), (5, 10)] and generators.block_bounds(7, 1, 0.0) == [(0, 7)]
    with pytest.raises(ValueError):
        generators.block_bounds(10, 2, 1.0)
    u, v = generators.block_diagonal(spark, 12, 9, 3)
    x = generators.matrix(u, v, 12, 9)
    assert greedy.grecond(x).counts(x)["tp"] == x.ones.count() == 36
    assert generators.overlap_kind(((0, 2), (0, 2)), ((0, 5), (0, 5))) == 2 and generators.overlap_kind(((0, 2), (0, 2)), ((1, 5), (1, 5))) == 1 and generators.overlap_kind(((0, 2), (0, 2)), ((2, 5), (0, 5))) == 0
    assert generators.blocks(spark, 40, 30, 3, False, seed=2)[0].select("f").distinct().count() == 3
    p = generators.permutation(x.rows, "i", 4)
    assert p.join(generators.reverse(p, "i").toDF("new", "back"), "new").filter("i <> back").count() == 0
    assert generators.shuffle_matrix(x, 1).ones.count() == 36 and generators.density(x).first()[0] == 36 / 108


def test_collective(spark):
    assert collective.sides([[0, 1], [2, 1], [3, 1]]) == ([0, 2, 3], [1]) and collective.factor_list([[0, 1], [0, 2]]) == [0, 1, 2]
    assert collective.matrices_of([[0, 1], [2, 1]]) == {0: [0], 1: [0, 1], 2: [1]}
    with pytest.raises(ValueError):
        collective.sides([[0, 1], [1, 2], [2, 0]])
    factors = [[0, 1], [1, 2]]  # the second is turned
    dims = collective.dummy_dims(spark.createDataFrame([(0, 2), (1, 3), (2, 2)], "fid int, size bigint"))
    cells = spark.createDataFrame([(0, 1, 2, 1), (1, 2, 1, 1), (1, 0, 0, 1)], "mat int, i bigint, j bigint, x int")
    back = collective.split(collective.concat(cells, dims, factors), dims, factors)
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in cells.collect()}
    parts = spark.createDataFrame([(2, 1, 0), (0, 0, 1)], "fid int, i bigint, f int")
    assert {tuple(r) for r in collective.split_sides(collective.concat_sides(parts, dims, factors), dims, factors).collect()} == {(2, 1, 0), (0, 0, 1)}
    assert collective.concat_dims(dims, factors).count() == 7


def test_positions(spark):
    ids = spark.createDataFrame([(c,) for c in "zebra"] + [("b",), (None,)], "c string").repartition(3)
    assert {r["c"]: r["ord"] for r in factorized(ids, "c").collect()} == {c: k for k, c in enumerate("aberz")}


def test_readers(spark, tmp_path):
    (tmp_path / "r.dat").write_text("1::10::5::0\n2::10::3::60\n")
    r = readers.with_times(readers.delimited(spark, str(tmp_path / "r.dat"), "uid int, iid int, rating int, ts long", "::"), "ts")
    assert [x["ts"].minute for x in r.orderBy("uid").collect()] == [0, 1]
    assert {tuple(x) for x in readers.ratings_matrix(r, threshold=4).ones.collect()} == {(1, 10)} and readers.ratings_matrix(r, threshold=4).m == 2
    lists = spark.createDataFrame([(1, "['a', 'b']"), (2, "['b']")], "id int, g string").withColumn("g", readers.parsed_list(F.col("g")))
    x = readers.attribute_matrix(lists, "id", readers.merged_lists(F.col("g"), F.array(F.lit("c"))), spark.createDataFrame([(1,), (3,)], "j int"))
    assert {tuple(c) for c in x.ones.collect()} == {("a", 1), ("b", 1), ("c", 1)} and x.n == 2
    w = readers.wide(spark.createDataFrame([(0, 1.0, 0.0), (1, 0.0, 0.0)], "row int, a double, b double"))
    assert (w.m, w.n, w.ones.count()) == (2, 2, 1)


def test_store(spark, tmp_path):
    x = block(spark)
    store.save_matrix(x, f"{tmp_path}/x")
    assert store.load_matrix(spark, f"{tmp_path}/x").ones.count() == 12
    fit = greedy.grecond(x)
    path = store.save_model(str(tmp_path), "grecond", fit.u, fit.v, {"k": 2})
    assert store.models(spark, str(tmp_path), "grecond").first()["path"] == path and store.load_model(spark, path)[0].count() == fit.u.count()
    log = metrics.log_rows("updates", 0, "train", metrics.metrics(metrics.factor_counts(x.ones, fit.u, fit.v, 20), ("Recall", "F1")))
    store.log_to_html(log, "updates", f"{tmp_path}/l.html")
    store.log_to_latex(log, "updates", f"{tmp_path}/l.tex")
    assert "Recall" in (tmp_path / "l.html").read_text() and "train F1" in (tmp_path / "l.tex").read_text()


def test_losses_fall(spark):
    x = block(spark)
    for kw in ({}, {"loss": "kl"}, {"solver": "cd"}, {"method": "nndsvd"}):
        errors = continuous.nmf(x, 2, max_iter=3, **kw)[2]
        assert all(b <= a + 1e-9 for a, b in zip(errors, errors[1:]))
    u, v, errors = continuous.elbmf(x, 2, max_iter=4)
    assert {r["x"] for r in continuous.long(u, "i", 2).collect()} <= {0.0, 1.0} and errors[-1] <= errors[0]


def test_nonlinear(spark):
    x = block(spark)
    u, v, _ = continuous.nmf(x, 2, max_iter=5)
    f, g = (lambda at: continuous.threshold_value(x, u, v, 2, at, 5.0)), continuous.threshold_gradient(x, u, v, 2, [0.4, 0.5], 5.0)
    for d in (0, 1):
        step = [0.4 + 1e-5 * (d == 0), 0.5 + 1e-5 * (d == 1)]
        assert abs((f(step) - f([0.4, 0.5])) / 1e-5 - g[d]) < 1e-2
    values = continuous.faststep(x, 1, tau=1.0, max_round=1, max_iter=2)[2]
    assert values[-1] <= values[0]
    assert len(continuous.penalty(x, 2, max_iter=2, tol=0.0)[2]) == 2 and len(continuous.penalty(x, 2, u, v, max_iter=1, link=5.0)[2]) == 1


def test_driver_numbers(spark):
    f, df = (lambda p: (p[0] - 3) ** 2), (lambda p: [2 * (p[0] - 3)])
    alpha, value = line_search(f, df, [0.0], [6.0])
    assert value == f([6 * alpha]) < 1.0 and limited(5.0, [0.0], [1.0], [-1.0], [2.0]) == 2.0 and limited(5.0, [0.0], [-1.0], [-1.0], [2.0]) == 1.0
    assert stop_reason(error=0, tol=0) == "error" and stop_reason(n_iter=3, max_iter=3) == "iterations" and stop_reason(diff=0.1, min_diff=1) == "difference" and stop_reason(n_factor=2, k=2) == "factors" and stop_reason() is None
    x = spark.createDataFrame([(-800.0,), (800.0,)], "x double").select(sigmoid(F.col("x")).alias("s"), uniform(1, F.col("x")).alias("u")).collect()
    assert [r["s"] for r in x] == [0.0, 1.0] and all(0 <= r["u"] < 1 for r in x)


def test_line_search_out_of_rounds():
    """The value is that of the step returned, even if the rounds run out."""
    f, df = (lambda p: (p[0] - 3) ** 2), (lambda p: [2 * (p[0] - 3)])
    for rounds in range(4):
        alpha, value = line_search(f, df, [0.0], [60.0], max_iter=rounds)
        assert value == f([60 * alpha])


def test_rounds_leave_no_checkpoints(spark):
    """A fit keeps its last factors only, whatever the number of its rounds."""
    import glob

    x = block(spark)
    folder = spark.sparkContext.getCheckpointDir()
    kept = lambda: len(glob.glob(folder.removeprefix("file:") + "/rdd-*"))
    counts = []
    for rounds in (1, 6):
        before = kept()
        u, v, errors = continuous.nmf(x, 2, max_iter=rounds)
        counts.append(kept() - before)
        assert len(errors) == rounds + 1 and u.count() and v.count()
    assert counts == [2, 2]


def test_stream(spark, tmp_path):
    from bitloom.streaming.cells import maintained

    source, out = tmp_path / "in", tmp_path / "out"
    batch = lambda rows: spark.createDataFrame(rows, "u int, k string, t string").selectExpr("u", "k", "to_timestamp(t) AS ts").coalesce(1).write.mode("append").parquet(str(source))
    batch([(1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 00:01:00")])
    for more in ([], [(1, "a", "2024-01-01 00:02:00"), (2, "b", "2024-01-01 00:03:00")]):
        if more:
            batch(more)
        events = spark.readStream.schema("u int, k string, ts timestamp").parquet(str(source))
        q = maintained(events, F.col("u"), F.col("k"), "ts", str(out), str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert {(r["i"], r["j"]) for r in spark.read.parquet(str(out)).collect()} == {(1, "a"), (2, "b")} and spark.read.parquet(str(out)).count() == 2
