"""Linear models against direct numpy solves; invariants of the random operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vatlens.operators import bootstrap
from vatlens.plans import linear, models, split

RNG = np.random.default_rng(7)
N = 240
X = RNG.normal(size=(N, 3)) * [1.0, 5.0, 0.2] + [0.0, 10.0, -1.0]
Y = 2.0 + X @ np.array([1.5, -0.3, 4.0]) + RNG.normal(scale=0.5, size=N)
ROWS = [(i, *map(float, X[i]), float(Y[i])) for i in range(N)]
SCHEMA = "id long, a double, b double, c double, y double"


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def _ridge_numpy(Xs, y, alpha):
    xm, ym = Xs.mean(0), y.mean()
    A = (Xs - xm).T @ (Xs - xm) + alpha * np.eye(Xs.shape[1])
    w = np.linalg.solve(A, (Xs - xm).T @ (y - ym))
    return w, ym - xm @ w


def test_ols_matches_numpy(data):
    m = linear.fit_linear(data, ["a", "b", "c"], "y")
    b, w = m.raw_coefficients()
    A = np.column_stack([np.ones(N), X])
    ref = np.linalg.lstsq(A, Y, rcond=None)[0]
    assert b == pytest.approx(ref[0], abs=1e-9) and w == pytest.approx(list(ref[1:]), abs=1e-9)


def test_ridge_path_matches_direct_solves(data):
    folds = split.block_folds(data, ["id"], 5)
    path = linear.ridge_path(folds, ["a", "b", "c"], "y", "fold")
    Xs = (X - X.mean(0)) / X.std(0)
    fold_of = np.repeat(np.arange(5), N // 5)
    for r in path:
        scores = []
        for k in range(5):
            tr, te = fold_of != k, fold_of == k
            w, b = _ridge_numpy(Xs[tr], Y[tr], r["alpha"])
            pred = b + Xs[te] @ w
            sse = ((Y[te] - pred) ** 2).sum()
            sst = ((Y[te] - Y[te].mean()) ** 2).sum()
            scores.append(1 - sse / sst)
        assert r["mean_r2"] == pytest.approx(np.mean(scores), abs=1e-10)
    m = linear.fit_ridge_cv(folds, ["a", "b", "c"], "y", "fold")
    assert m.alpha == linear.best_alpha(path)


def test_missing_feature_scores_as_median(spark, data):
    m = linear.fit_linear(data, ["a", "b"], "y")
    df = spark.createDataFrame([(None, None)], "a double, z double")
    p = m.transform(df).first()["prediction"]
    assert p == pytest.approx(m.intercept + sum(w * (0 if s == 0 else (med - mu) / s) for w, med, mu, s
                              in zip(m.coef, m.medians, m.means, m.stds)))


def test_cross_validate_per_fold(data):
    f = split.hash_folds(data, "id", 5)
    cv = linear.cross_validate(f, ["a", "b", "c"], "y", "fold").collect()
    assert len(cv) == 5 and sum(r["n"] for r in cv) == N
    assert all(r["r2"] > 0.9 for r in cv)


def test_hash_folds_partition_rows(data):
    f = split.hash_folds(data, "id", 5)
    assert f.filter(F.col("fold").isNull()).count() == 0
    assert f.select("fold").distinct().count() == 5
    s = split.hash_split(data, "id")
    assert s.filter(F.col("split") == "test").count() + s.filter(F.col("split") == "train").count() == N


def test_permutation_importance_constant_feature_zero(spark, data):
    d = data.withColumn("k", F.lit(1.0))
    m = linear.fit_linear(d, ["a", "k"], "y")
    imp = {r["feature"]: r["importance_mean"] for r in
           models.permutation_importance(m, d, ["a", "k"], "y", "id", repeats=3).collect()}
    assert imp["k"] == pytest.approx(0.0, abs=1e-12) and imp["a"] > 0


def test_bootstrap_ci_contains_mean(spark):
    df = spark.createDataFrame([(i, float(i % 10), "g" + str(i % 2)) for i in range(400)],
                               "id long, v double, g string")
    for r in bootstrap.bootstrap_mean_ci(df, "v", by=["g"], key="id", replicates=200).collect():
        assert r["ci_lo"] <= r["mean"] <= r["ci_hi"] and r["ci_hi"] - r["ci_lo"] < 1.5


def test_trees_beat_linear_on_nonlinear(spark):
    rows = [(i, float(x), float(np.sin(x) * 3 + 0.01 * i % 1)) for i, x in enumerate(np.linspace(-6, 6, 300))]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    lin = linear.fit_linear(df, ["x"], "y")
    gbt = models.fit_tree(df, ["x"], "y", "gbt")
    from vatlens.operators.summary import regression_metrics
    r_lin = regression_metrics(lin.transform(df), "y", "prediction").first()["r2"]
    r_gbt = regression_metrics(gbt.transform(df), "y", "prediction").first()["r2"]
    assert r_gbt > r_lin
    assert gbt.transform(df).count() == 300


def test_rows_of_a_design_are_dealt_out(spark, monkeypatch):
    from vatlens.plans import design
    monkeypatch.setattr(design, "APART", 50)
    df = spark.range(0, 100, 1, 1).selectExpr("id", "double(id) as a", "double(id * id) as y")
    per = design.Design(df, ["a"], "y", key="id").df.groupBy(F.spark_partition_id()).count().collect()
    assert len(per) == spark.sparkContext.defaultParallelism and sum(r["count"] for r in per) == 100
