"""Non-linear models, model comparison and permutation importance.

* Trees (``trees.py``) and support-vector regression (``svr.py``) are this library's own, grown
  and solved from sums that tasks add up.
* ``fit_rff`` is kernel regression with squared loss: ``sqrt(2/D) cos(W z + b)`` (Rahimi & Recht 2007)
  as Column expressions, then MLlib ``LinearRegression`` (normal equations, distributed Gram).
* A comparison reads one table (``design.Design``) for all folds and models.
* Permutation importance permutes the row index by a keyed bijection, so a row's partner is
  computed and one equi-join serves every feature and repeat - no collect, no global window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vatlens.operators import ordered, summary
from vatlens.plans import linear, svr, trees
from vatlens.plans.design import Design, predict_linear
from vatlens.plans.split import hash_bucket
from vatlens.session import materialize


def fit_tree(df: DataFrame, features: Sequence[str], target: str, kind: str = "rf", seed: int = 42,
             num_trees: int | None = None, max_depth: int | None = None, key: str | None = None):
    """L4 (``kind='rf'``: 300 trees, all features per split, no depth limit) / L5 (``'gbt'``: 100 x 0.1, depth 3)."""
    if kind == "rf":
        return trees.fit_forest(df, features, target, num_trees or 300, seed, max_depth, key)
    if kind == "gbt":
        return trees.fit_boosted(df, features, target, num_trees or 100, max_depth or 3)
    raise ValueError(kind)


@dataclass
class RffModel:
    """Impute -> scale -> random Fourier features -> ridge (MLlib normal equations)."""

    prep: linear.LinearModel
    W: list
    b: list
    model: object
    alpha: float

    def _features(self) -> Column:
        d = len(self.prep.features)
        D = len(self.b)
        zs = [self.prep.scaled(i) for i in range(d)]
        comps = []
        for j in range(D):
            e = F.lit(self.b[j])
            for i in range(d):
                e = e + F.lit(self.W[j][i]) * zs[i]
            comps.append(F.lit(math.sqrt(2.0 / D)) * F.cos(e))
        return array_to_vector(F.array(*comps))

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        missing = [f for f in self.prep.features if f not in df.columns]
        if missing:
            df = df.withColumns({f: F.lit(None).cast("double") for f in missing})
        x = df.withColumn("_vl_rff", self._features())
        out = self.model.transform(x)
        if name != "prediction":
            out = out.withColumnRenamed("prediction", name)
        return out.drop("_vl_rff")


def fit_rff(df: DataFrame, features: Sequence[str], target: str, components: int = 100,
            gamma: float | None = None, alpha: float = 1.0, seed: int = 42) -> RffModel:
    """RBF kernel regression by random Fourier features + ridge."""
    features = list(features)
    medians, means, stds = linear.prep_statistics(df, features, target)
    prep = linear.LinearModel(features, target, medians, means, stds, [0.0] * len(features), 0.0)
    d = len(features)
    g = gamma if gamma is not None else 1.0 / max(d, 1)   # 'scale' on standardised data
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, math.sqrt(2.0 * g), size=(components, d)).tolist()
    b = rng.uniform(0.0, 2.0 * math.pi, size=components).tolist()
    m = RffModel(prep, W, b, None, alpha)
    x = df.filter(F.col(target).isNotNull()).withColumn("_vl_rff", m._features())
    st = x.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(target).alias("sy")).first()
    n, sy = st["n"], st["sy"] or 1.0
    # ||y - Zw||^2 + alpha ||w||^2 with MLlib's normal-equation solver, which
    # scales the penalty by the label's std: regParam = alpha / n * std_pop(y)
    lr = LinearRegression(featuresCol="_vl_rff", labelCol=target, solver="normal",
                          elasticNetParam=0.0, regParam=alpha / max(n, 1) * sy,
                          standardization=False)
    m.model = lr.fit(x)
    return m


# ---------------------------------------------------------------- L9, L14, T3, T4
MODEL_NAMES = ["LinearRegression", "RidgeCV", "RandomForestRegressor", "GradientBoostingRegressor", "SVR"]


def _predictions(design: Design, models: Sequence[str], seed: int, num_trees: int, alpha: float = 0.0) -> DataFrame:
    """``model, fit, y, p`` for the rows on which each fit of each model is scored. Models that are small are
    applied together in one pass; the forest's rows come from where its trees were grown."""
    small: dict = {}
    if {"LinearRegression", "Ridge", "RidgeCV"} & set(models):
        cells = design.moments()
    for name in models:
        if name in ("LinearRegression", "Ridge", "RidgeCV"):
            for f in design.fits:
                m = linear.model_of_moments(design.features, design.target, design.medians(f), cells[f],
                                            linear.RIDGE_ALPHAS if name == "RidgeCV" else None,
                                            alpha if name == "Ridge" else 0.0)
                b, w = m.raw_coefficients()
                small[name, f] = (predict_linear, {"medians": m.medians, "coef": w, "intercept": b})
        elif name == "GradientBoostingRegressor":
            small.update({(name, f): (trees.predict_boosted, m) for f, m in trees.boosted(design).items()})
        elif name == "SVR":
            small.update({(name, f): (svr.predict_kernel, m) for f, m in svr.fit_kernels(design, seed=seed).items()})
        elif name != "RandomForestRegressor":
            raise ValueError(name)
    out = design.predictions(small) if small else None
    if "RandomForestRegressor" in models:
        forest = trees.forest_predictions(design, num_trees, seed)
        out = forest if out is None else out.unionByName(forest)
    return out


def cross_validate(df: DataFrame, features: Sequence[str], target: str, fold: str, models: Sequence[str] = tuple(MODEL_NAMES),
                   seed: int = 42, num_trees: int = 300, alpha: float = 0.0, key: str | None = None) -> DataFrame:
    """L9 for any model: ``model, fold, n, r2, mae, rmse`` on each held-out fold, the whole pipeline refitted
    on the others. Rows without a fold or a target are left out."""
    ks = sorted(r[0] for r in df.where(F.col(fold).isNotNull()).select(fold).distinct().collect())
    # fold values, however they are numbered, as 0 .. k-1
    number = F.array_position(F.array(*[F.lit(k) for k in ks]), F.col(fold)).cast("int") - 1
    x = df.where(F.col(fold).isNotNull()).withColumn("_vl_fold", number)
    if "RidgeCV" in models and not key:
        raise ValueError("the search inside a fit needs the column that identifies a row")
    if key:
        x = x.withColumn("_vl_inner", hash_bucket(key, 5, seed="in"))
    design = Design(x, features, target, "_vl_fold", len(ks), inner="_vl_inner" if key else None, key=key, fits=range(len(ks)))
    per = summary.regression_metrics(_predictions(design, models, seed, num_trees, alpha), "y", "p", group_by=["model", "fit"])
    value = F.array(*[F.lit(k) for k in ks])[F.col("fit")]
    return per.select("model", value.alias("fold"), "n", "r2", "mae", "rmse")


def leaderboard(train: DataFrame, test: DataFrame, features: Sequence[str], target: str,
                key: str, models: Sequence[str] = tuple(MODEL_NAMES), k: int = 5,
                seed: int = 42, num_trees: int = 300, cv: bool = True) -> DataFrame:
    """L14 + T3: per model the k-fold CV R² (mean, population std) on the training rows and test
    R² / MAE / RMSE; sorted by test R² descending. All k + 1 fits of a model are grown or solved together."""
    tr = train.withColumn("_vl_fold", hash_bucket(key, k, seed="cv")).withColumn("_vl_inner", hash_bucket(key, k, seed="in"))
    design = Design(tr, features, target, "_vl_fold", k, test, "_vl_inner", key, None if cv else [k])
    per = summary.regression_metrics(_predictions(design, models, seed, num_trees), "y", "p", group_by=["model", "fit"])
    held, whole = F.col("fit") < k, F.col("fit") == k
    return per.groupBy("model").agg(
        F.avg(F.when(held, F.col("r2"))).alias("cv_r2_mean"), F.stddev_pop(F.when(held, F.col("r2"))).alias("cv_r2_std"),
        *[F.max(F.when(whole, F.col(c))).alias(f"test_{c}") for c in ("r2", "mae", "rmse")]).orderBy(F.desc("test_r2"), "model")


def best_model(board: DataFrame) -> DataFrame:
    """T4: the model with the highest test R² (``max_by``)."""
    return board.agg(F.max_by("model", "test_r2").alias("best_model"),
                     F.max("test_r2").alias("best_test_r2"))


# ---------------------------------------------------------------- L16
#: Rounds of the keyed bijection, and how often a place outside the rows is sent on.
ROUNDS, WALK = 4, 64


def partner(i: Column, repeat: Column, n: int, seed: int) -> Column:
    """The place that row ``i`` of 0 .. n-1 takes its value from: a bijection for every repeat and seed.

    ``i`` is a pair (i div b, i mod b) with a b >= n; each round adds an MD5 of one half to the other, modulo
    its size, which can be undone. Places from n on are sent through again until one of a row comes out; there
    are fewer than a of them, about the root of n, so ``WALK`` times suffice (always up to 4,096 rows, beyond
    that but for a chance below 64 to the power -64).
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = -(-n // a)

    def added(half: Column, other: Column, size: int, turn: int) -> Column:
        text = F.concat_ws(":", other.cast("string"), repeat.cast("string"), F.lit(str(seed)), F.lit(str(turn)))
        word = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")
        return F.pmod(half + word, F.lit(size))

    def even(turn: int):
        return lambda p: F.struct(added(p["l"], p["r"], a, turn).alias("l"), p["r"].alias("r"))

    def odd(turn: int):
        return lambda p: F.struct(p["l"].alias("l"), added(p["r"], p["l"], b, turn).alias("r"))

    def once(x: Column) -> Column:
        # a lambda variable per half keeps the expression linear in the rounds
        pair = F.array(F.struct(F.floor(x / F.lit(b)).cast("bigint").alias("l"), F.pmod(x, F.lit(b)).cast("bigint").alias("r")))
        for turn in range(ROUNDS):
            pair = F.transform(pair, even(turn) if turn % 2 == 0 else odd(turn))
        return F.transform(pair, lambda p: p["l"] * F.lit(b) + p["r"])[0]

    first = once(i.cast("bigint"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), first, lambda x, _: F.when(x < n, x).otherwise(once(x)))


def permutation_importance(model, df: DataFrame, features: Sequence[str], target: str, key: str,
                           repeats: int = 10, seed: int = 42) -> DataFrame:
    """Mean / std drop of R² when one feature is permuted among the rows.

    The rows get one fixed index, in the order of the MD5 of ``key:rows:seed``. In repeat r row i takes its
    feature value from row ``partner(i, r)``: one join of the rows, once per repeat, with the indexed rows. The
    feature is exploded after the join, all frames are scored in one pass and reduced per (feature, r).
    """
    features = list(features)
    base = summary.regression_metrics(model.transform(df, "_vl_p"), target, "_vl_p").first()
    cols = list(dict.fromkeys([target, *features]))
    text = F.concat_ws(":", F.col(key).cast("string"), F.lit("rows"), F.lit(str(seed)))
    place = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    rows = materialize(ordered.with_row_index(df.select(*dict.fromkeys([key, *cols]), place.alias("_vl_h")), ["_vl_h", key],
                                              name="_vl_i").drop("_vl_h"))
    n = rows.count()
    a = rows.select("_vl_i", *cols, F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("_vl_r"))
    a = a.withColumn("_vl_j", partner(F.col("_vl_i"), F.col("_vl_r"), n, seed))
    b = rows.select(F.col("_vl_i").alias("_vl_j"), *[F.col(f).alias(f"_vl_d{j}") for j, f in enumerate(features)])
    pairs = a.join(b, "_vl_j")
    frames = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.struct(*[(F.col(f"_vl_d{j}") if g == f else F.col(g)).alias(g) for g in cols])
                 .alias("row")) for j, f in enumerate(features)]))
    u = pairs.select("_vl_r", frames.alias("_vl_s")).select("_vl_r", F.col("_vl_s.feature").alias("_vl_feat"),
                                                            *[F.col(f"_vl_s.row.`{g}`").alias(g) for g in cols])
    per = summary.regression_metrics(model.transform(u, "_vl_p"), target, "_vl_p", group_by=["_vl_feat", "_vl_r"])
    per = per.withColumn("drop", F.lit(base["r2"]) - F.col("r2"))
    return (per.groupBy(F.col("_vl_feat").alias("feature"))
            .agg(F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std"),
                 F.count(F.lit(1)).cast("long").alias("repeats"))
            .orderBy(F.desc("importance_mean"), "feature"))
