"""Fitted models as SQL: the same predictions as the models, in Spark and in DuckDB; the logistic optimum."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from loanpanel.operators import model as M
from loanpanel.operators import scoring_sql as S


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"a": rng.normal(size=600), "b": rng.integers(0, 40, 600) * 1e4, "c": rng.normal(size=600) * 1e-3})
    pdf["y"] = ((pdf.a + pdf.b / 2e5 + rng.normal(size=600) * 0.5) > 1).astype(int)
    pdf["id"] = np.arange(600)
    return pdf


@pytest.fixture(scope="module")
def data(spark, frame):
    return spark.createDataFrame(frame).repartition(4).cache()


FITS = {"logistic": M.fit_logistic, "boosted": lambda d, f, y: M.fit_boosted(d, f, y, max_iter=12),
        "forest": lambda d, f, y: M.fit_forest(d, f, y, num_trees=15)}


@pytest.mark.parametrize("kind", FITS)
def test_predictions_equal_the_model(spark, data, frame, kind):
    features = ["a", "b", "c"]
    model = FITS[kind](data, features, "y")
    want = {r["id"]: r["Y_hat"] for r in M.predict(model, data, features).collect()}
    got = S.predict_by_sql(model, data, features)
    assert {r["id"]: r["Y_hat"] for r in got.collect()} == want and set(want.values()) == {0, 1}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "UDF" not in plan
    con = duckdb.connect()
    con.register("t", frame)
    sql = S.prediction_sql(model, features, quote='"')
    assert dict(con.execute(f"select id, {sql} from t").fetchall()) == want


@pytest.mark.parametrize("kind", FITS)
def test_rows_without_a_feature_have_no_prediction(spark, data, kind):
    model = FITS[kind](data, ["a", "b", "c"], "y")
    odd = spark.createDataFrame([(1, None, 2e4, 0.0), (2, float("nan"), 2e4, 0.0), (3, 0.5, 2e4, 0.0)], "id int, a double, `b` double, c double")
    assert [r["id"] for r in S.predict_by_sql(model, odd, ["a", "b", "c"]).collect()] == [3]
    assert S.predict_by_sql(model, odd.limit(0), ["a", "b", "c"]).count() == 0
    # a dotted and a quoted name
    named = odd.toDF("id", "a", "b.x", "c`d")
    assert [r["id"] for r in S.predict_by_sql(model, named, ["a", "b.x", "c`d"]).collect()] == [3]


def test_logistic_fit_is_at_its_optimum(spark, data, frame):
    model = FITS["logistic"](data, ["a", "b", "c"], "y")
    x, y, w = frame[["a", "b", "c"]].to_numpy(), frame["y"].to_numpy(), model.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ w + model.intercept)))
    gradient = x.T @ (p - y) + w                # C = 1: the penalty's gradient is the weights
    scale = np.abs(x).T @ np.abs(p - y) + np.abs(w)
    assert np.abs(gradient / scale).max() < 1e-3 and abs((p - y).sum()) / len(y) < 1e-3


def test_unknown_models_are_refused():
    with pytest.raises(ValueError):
        S.margin_sql(object(), ["a"])


@pytest.mark.parametrize("kind", FITS)
def test_the_training_summary_stays_off_the_tasks(spark, data, kind, monkeypatch):
    model = FITS[kind](data, ["a", "b", "c"], "y")
    want = {r["id"]: r["prediction"] for r in model.transform(M._assembled(data, ["a", "b", "c"])).collect()} if kind == "boosted" else None
    seen, transform = [], type(model).transform
    monkeypatch.setattr(type(model), "transform", lambda self, df: seen.append(getattr(self, "hasSummary", False)) or transform(self, df))
    got = {r["id"]: r["Y_hat"] for r in M.predict(model, data, ["a", "b", "c"]).collect()}
    assert seen == [False] and len(got) == 600 and (want is None or got == want)
