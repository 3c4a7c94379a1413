"""The common surface of all fits, starts and the combined loader."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from bitloom.operators.matrix import BoolMatrix
from bitloom.plans import continuous, greedy
from bitloom.plans.estimators import BooleanFactorization, BooleanFactorizationModel
from bitloom.sources import readers

from .test_library import block, matrix


def pairs(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


@pytest.fixture(scope="module")
def table(spark):
    rows = [(r, c) for r in (0, 1) for c in (0, 1, 2)] + [(r, c) for r in (2, 3) for c in (2, 3, 4)]
    return spark.createDataFrame([(f"u{r}", f"c{c}", 1) for r, c in rows] + [("u0", "c4", 0), ("u3", "c0", 0)], "user string, item string, seen int")


def test_patterns(spark, table, tmp_path):
    est = BooleanFactorization(method="grecond", rowCol="user", colCol="item", valueCol="seen", k=2)
    est.write().save(str(tmp_path / "est"))
    model = BooleanFactorization.load(str(tmp_path / "est")).fit(table)
    assert model.k == 2 and [r["score"] for r in model.log] == [6, 6] and model.getOrDefault("rowCol") == "user"
    told = model.transform(table.withColumn("hit", F.lit("kept")))
    assert pairs(told, "user", "item", "prediction") == sorted((r["user"], r["item"], r["seen"]) for r in table.collect()) and told.columns == ["user", "item", "seen", "hit", "prediction"]
    assert model.evaluate(table, ["F1", "Accuracy"]).first().asDict() == {"F1": 1.0, "Accuracy": 1.0}
    assert model.evaluate(table, ["TN", "TP"], "prediction").first().asDict() == {"TN": 2, "TP": 12}
    log = model.rounds({"all": table}, ["Recall"])
    assert pairs(log, "step", "split", "metric", "value") == [(1, "all", "Recall", 0.5), (2, "all", "Recall", 1.0)]
    model.write().save(str(tmp_path / "model"))
    again = BooleanFactorizationModel.load(str(tmp_path / "model"))
    assert pairs(again.u, "i", "f") == pairs(model.u, "i", "f") and pairs(again.v, "j", "f") == pairs(model.v, "j", "f") and (again.k, again.log, again.uid) == (2, model.log, model.uid)
    assert pairs(again.transform(table), "user", "item", "prediction") == pairs(told, "user", "item", "prediction")
    with pytest.raises(ValueError):
        model.evaluate(table, ["F1"], "other")


def test_refining(spark, table, tmp_path):
    common = {"rowCol": "user", "colCol": "item", "valueCol": "seen"}
    first = Pipeline(stages=[BooleanFactorization(method="asso", k=2, options={"tau": 0.6}, **common)]).fit(table).stages[0]
    first.write().save(str(tmp_path / "first"))
    refined = BooleanFactorization(method="asso_iter", **common).setInitialModel(str(tmp_path / "first")).fit(table)
    assert refined.k == 2 and refined.evaluate(table, ["F1"]).first()["F1"] == 1.0
    merged = BooleanFactorization(method="hyper_plus", k=1, **common).setInitialModel(first).fit(table)
    assert len(pairs(merged.u, "i", "f")) == 4 and len(pairs(merged.v, "j", "f")) == 5
    with pytest.raises(ValueError):
        BooleanFactorization(method="asso_iter", **common).fit(table)
    with pytest.raises(ValueError):
        BooleanFactorization(method="penalty", k=2, **common).setInitialModel(first).fit(table)
    with pytest.raises(ValueError):
        BooleanFactorization(method="magic", **common).fit(table)


def test_real_factors(spark, tmp_path):
    x = block(spark)
    model = BooleanFactorization(method="nmf", k=2, options={"max_iter": 4, "seed": 3}, threshold=0.4).fit(x)
    errors = [r["error"] for r in model.log]
    assert errors == sorted(errors, reverse=True) and len(errors) == 5
    model.write().save(str(tmp_path / "nmf"))
    again = BooleanFactorizationModel.load(str(tmp_path / "nmf"))
    on = BooleanFactorization(method="nmf", k=2, options={"max_iter": 2}, threshold=0.4).setInitialModel(again).fit(x)
    assert np.isclose(on.log[0]["error"], errors[-1]) and on.log[-1]["error"] < errors[-1]  # goes on where the other ended
    pulled = BooleanFactorization(method="elbmf", k=2, options={"max_iter": 2}).setInitialModel(again).fit(x)
    assert pulled.k == 2 and pulled.real is not None
    assert pairs(model.u, "i", "f") == pairs(continuous.boolean(model.real[0], "i", 2, 0.4), "i", "f")


@pytest.mark.parametrize("method", ["nndsvd", "nndsvda", "nndsvdar"])
def test_starts(spark, method):
    u, v = continuous.start(block(spark), 2, method)
    values = np.array([[r["f0"], r["f1"]] for r in u.collect()])
    low, high = np.sort(values[:, 1])[:2], np.sort(values[:, 1])[2:]  # the second pattern has the rows of one tile or of the other
    assert len(values) == 4 and v.count() == 5 and np.allclose(values[:, 0], values[0, 0]) and np.allclose(high, 0.5**0.5)
    assert {"nndsvd": (np.abs(low) < 1e-6).all(), "nndsvda": np.allclose(low, 12 / 20), "nndsvdar": ((low > 0) & (low < 0.06)).all()}[method]


def test_mappings(spark):
    u = spark.createDataFrame([(0, 0.2, 0.9), (1, 0.5, 0.2), (2, 0.2, 0.7)], "i int, f0 double, f1 double")
    v = spark.createDataFrame([(0, 3.0, 3.0)], "j int, f0 double, f1 double")
    whole, one = continuous.normalized(u, v, 2, "matrixwise-mapping")
    assert pairs(whole, "i", "f0", "f1") == [(0, 0.0, 0.75), (1, 0.25, 0.0), (2, 0.0, 0.5)] and pairs(one, "f0", "f1") == [(0.0, 0.0)]
    by = continuous.normalized(u, v, 2, "columnwise-mapping")[0]
    assert np.allclose(np.array(pairs(by, "i", "f0", "f1"), float), [(0, 0, 2 / 3), (1, 0.5, 0), (2, 0, 1 / 3)])


def test_combined(spark):
    ratings = matrix(spark, 3, 2, [(0, 0), (2, 1)])
    profiles = BoolMatrix.of(spark.createDataFrame([(0, "old"), (2, "new"), (9, "old")], "i int, j string"), "i", "j")
    kinds = BoolMatrix.of(spark.createDataFrame([("fun", 0), ("sad", 0), ("fun", 7)], "i string, j int"), "i", "j")
    cells, dims, factors = readers.combined(ratings, profiles, kinds)
    assert factors == [[0, 1], [0, 2], [3, 1]] == readers.FOUR[:3]
    assert pairs(cells, "mat", "i", "j", "x") == [(0, 0, 0, 1), (0, 2, 1, 1), (1, 0, 1, 1), (1, 2, 0, 1), (2, 0, 0, 1), (2, 1, 0, 1)]  # users and items of the ratings
    assert pairs(dims, "fid", "ord", "id") == [(0, 0, "0"), (0, 1, "1"), (0, 2, "2"), (1, 0, "0"), (1, 1, "1"), (2, 0, "new"), (2, 1, "old"), (3, 0, "fun"), (3, 1, "sad")]


def test_best_lines_of_a_fit(spark):
    """A model's patterns are the fit's own."""
    x = block(spark)
    fit, model = greedy.hyper(x, 0.4), BooleanFactorization(method="hyper", options={"min_support": 0.4}).fit(x)
    assert pairs(fit.u, "i", "f") == pairs(model.u, "i", "f") and [r["scored"] for r in model.log] == [r["scored"] for r in fit.log]
