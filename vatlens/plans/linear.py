"""Linear regression pipeline: median impute -> z-score -> OLS / ridge.

Fitting never moves rows: every fit reduces the data to *moments* with one
``groupBy(fold).agg(...)`` of ``count``, ``avg`` and ``covar_pop`` /
``var_pop`` (numerically stable, map-side combined; d features give
(d+1)(d+2)/2 co-moments per fold). The driver then merges fold moments
(Chan's parallel formula) and solves the d x d systems with numpy - k x d^2
numbers, bounded by the model size, never by the row count.

Scoring is a Column expression ``b + sum(w_i * (coalesce(x_i, median_i) -
mean_i) / std_i)`` that stays inside whole-stage codegen.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vatlens.operators.cleaning import to_number
from vatlens.operators.quantiles import exact_quantiles, quantile_row

# The alpha grid of the ridge search, 13 values from 1e-3 to 1e3.
RIDGE_ALPHAS = [float(a) for a in np.logspace(-3, 3, 13)]


@dataclass
class LinearModel:
    """A fitted impute -> scale -> linear model; small and JSON-serialisable."""

    features: list[str]
    target: str
    medians: list[float | None]
    means: list[float]
    stds: list[float]
    coef: list[float]              # on standardised features
    intercept: float
    alpha: float = 0.0
    n: int = 0
    algo: str = "ols"
    cv: list[dict] = field(default_factory=list)
    zstats: dict = field(default_factory=dict)   # raw column -> training mean and std (z-scores)

    # ------------------------------------------------------------ scoring
    def scaled(self, i: int, types: dict | None = None) -> Column:
        f = self.features[i]
        x = to_number(F.col(f), types[f]) if types else F.col(f).cast("double")
        if self.medians[i] is not None:
            x = F.coalesce(x, F.lit(self.medians[i]))
        s = self.stds[i]
        if not s:
            return F.lit(0.0)
        return (x - F.lit(self.means[i])) / F.lit(s)

    def prediction(self, types: dict | None = None) -> Column:
        """``types`` (column -> source type) makes text that is no number a missing value."""
        e = F.lit(self.intercept)
        for i, w in enumerate(self.coef):
            if w:
                e = e + F.lit(w) * self.scaled(i, types)
        return e

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """Add the prediction column (missing features count as all-null)."""
        missing = [f for f in self.features if f not in df.columns]
        if missing:
            df = df.withColumns({f: F.lit(None).cast("double") for f in missing})
        return df.withColumn(name, self.prediction({f.name: f.dataType for f in df.schema.fields}))

    def raw_coefficients(self) -> tuple[float, list[float]]:
        """Coefficients on the original feature scale (after imputation)."""
        w = [c / s if s else 0.0 for c, s in zip(self.coef, self.stds)]
        b = self.intercept - sum(wi * m for wi, m in zip(w, self.means))
        return b, w

    def coefficients_frame(self, spark: SparkSession) -> DataFrame:
        """One row per term: scaled and raw coefficient, impute/scale statistics."""
        b_raw, w_raw = self.raw_coefficients()
        rows = [("intercept", -1, None, None, None, float(self.intercept), float(b_raw))]
        for i, f in enumerate(self.features):
            rows.append((f, i, self.medians[i], self.means[i], self.stds[i],
                         float(self.coef[i]), float(w_raw[i])))
        return spark.createDataFrame(
            rows, "term string, position int, median double, mean double, std double, "
                  "coef double, coef_raw double")

    # ------------------------------------------------------------ persistence
    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(s: str) -> "LinearModel":
        return LinearModel(**json.loads(s))


# ---------------------------------------------------------------- moments
def _moment_aggs(cols: list[str]) -> list[Column]:
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]
    for i, a in enumerate(cols):
        for j in range(i, len(cols)):
            b = cols[j]
            aggs.append((F.var_pop(a) if i == j else F.covar_pop(a, b)).alias(f"c{i}_{j}"))
    return aggs


def _to_moments(row, p: int) -> tuple[int, np.ndarray, np.ndarray]:
    n = int(row["n"])
    mean = np.array([row[f"m{i}"] or 0.0 for i in range(p)], dtype=float)
    cov = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            v = row[f"c{i}_{j}"]
            cov[i, j] = cov[j, i] = 0.0 if v is None else v
    return n, mean, cov * n  # co-moment matrix M = n * cov_pop


def _merge(a, b):
    """Chan et al.: combine (n, mean, co-moment) of two disjoint sets."""
    na, ma, Ma = a
    nb, mb, Mb = b
    if na == 0:
        return b
    if nb == 0:
        return a
    n = na + nb
    d = mb - ma
    return n, ma + d * (nb / n), Ma + Mb + np.outer(d, d) * (na * nb / n)


def _solve(n, mean, M, p_feat, alpha):
    """Ridge (alpha>0) / OLS on centred data: (Mxx + alpha I) w = Mxy; returns (w, b)."""
    Mxx = M[:p_feat, :p_feat]
    Mxy = M[:p_feat, p_feat]
    A = Mxx + alpha * np.eye(p_feat)
    try:
        w = np.linalg.solve(A, Mxy)
    except np.linalg.LinAlgError:
        w = np.linalg.lstsq(A, Mxy, rcond=None)[0]
    b = mean[p_feat] - mean[:p_feat] @ w
    return w, b


def _holdout_r2(hold, w, b, p_feat):
    """R² of the fitted (w, b) on a fold, from that fold's moments only."""
    n, mean, M = hold
    if n < 2:
        return None
    v = np.append(-w, 1.0)               # residual e = y - b - z.w = v . [z, y] - b
    e_mean = v @ mean - b
    sse = v @ M @ v + n * e_mean ** 2
    sst = M[p_feat, p_feat]
    if sst == 0:
        return 1.0 if sse == 0 else 0.0
    return float(1.0 - sse / sst)


# ---------------------------------------------------------------- fitting
def prep_statistics(df: DataFrame, features: list[str],
                    target: str | None = None) -> tuple[list, list, list]:
    """L1: medians and mean / population std of the median-imputed features.

    Per feature the exact median (distributed quantile) and one aggregate of
    the row count and count / mean / var_pop of the present values. The
    imputed column's moments follow exactly (merge with ``n - k`` copies of
    the median), so there is no pass over the imputed values. An all-null column keeps median None and std 0: its coefficient is
    0 and it is reported (sklearn's imputer drops it silently). With
    ``target`` only labelled rows count (the rows the model is fitted on).
    """
    src = df.filter(to_number(F.col(target), df.schema[target].dataType).isNotNull()) if target else df
    x = {f: to_number(F.col(f), src.schema[f].dataType) for f in features}
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(features):
        aggs += [F.count(x[f]).alias(f"k{i}"), F.avg(x[f]).alias(f"m{i}"),
                 F.var_pop(x[f]).alias(f"v{i}")]
    r = src.agg(*aggs).first()
    q = quantile_row(src.select(*[x[f].alias(f"_x{i}") for i, f in enumerate(features)]),
                     [f"_x{i}" for i in range(len(features))], [0.5])
    n = r["n"]
    medians, means, stds = [], [], []
    for i in range(len(features)):
        med, k, m, v = q.get((f"_x{i}", 0.5)), r[f"k{i}"], r[f"m{i}"], r[f"v{i}"]
        medians.append(med)
        if not k:
            means.append(0.0)
            stds.append(0.0)
            continue
        mean = (k * m + (n - k) * med) / n
        m2 = (v or 0.0) * k + k * (m - mean) ** 2 + (n - k) * (med - mean) ** 2
        means.append(float(mean))
        stds.append(float(np.sqrt(max(m2, 0.0) / n)))
    return medians, means, stds


def _medians(df: DataFrame, features: list[str], target: str) -> list:
    y = to_number(F.col(target), df.schema[target].dataType)
    x = df.filter(y.isNotNull()).select(
        *[to_number(F.col(f), df.schema[f].dataType).alias(f"_x{i}") for i, f in enumerate(features)])
    q = quantile_row(x, [f"_x{i}" for i in range(len(features))], [0.5])
    return [q.get((f"_x{i}", 0.5)) for i in range(len(features))]


def _raw_design(df: DataFrame, features, target, medians, fold: str | None = None) -> DataFrame:
    """Median-imputed, unscaled features + target (+ fold) of the labelled rows."""
    cols = []
    for i, f in enumerate(features):
        x = to_number(F.col(f), df.schema[f].dataType)
        if medians[i] is not None:
            x = F.coalesce(x, F.lit(medians[i]))
        cols.append(x.alias(f"_z{i}"))
    y = to_number(F.col(target), df.schema[target].dataType).alias("_y")
    sel = df.select(*([F.col(fold).alias("_fold")] if fold else []), *cols, y)
    return sel.filter(F.col("_y").isNotNull())


def fold_moments(design: DataFrame, p: int, by_fold: bool) -> dict:
    """One aggregate: moments of [x_0..x_{p-1}, y] per fold (or overall under key None)."""
    cols = [f"_z{i}" for i in range(p)] + ["_y"]
    aggs = _moment_aggs(cols)
    if by_fold:
        rows = design.groupBy("_fold").agg(*aggs).collect()
        return {r["_fold"]: _to_moments(r, p + 1) for r in rows}
    return {None: _to_moments(design.agg(*aggs).first(), p + 1)}


def _scale(mom, means, stds):
    """Moments of z = (x - mean) / std (z = 0 where std is 0); y unchanged."""
    n, m, M = mom
    s = np.array([1.0 / sd if sd else 0.0 for sd in stds] + [1.0])
    mu = np.array(list(means) + [0.0])
    return n, s * (m - mu), M * np.outer(s, s)


def _fit_moments(df: DataFrame, features, target, fold: str | None):
    """Two passes: medians, then (per-fold) moments; scaling is applied analytically."""
    medians = _medians(df, features, target)
    p = len(features)
    mom = fold_moments(_raw_design(df, features, target, medians, fold), p, fold is not None)
    total = (0, np.zeros(p + 1), np.zeros((p + 1, p + 1)))
    for v in mom.values():
        total = _merge(total, v)
    n = total[0]
    if n == 0:
        raise ValueError("no labelled rows to fit")
    means = [float(v) for v in total[1][:p]]
    stds = [float(np.sqrt(max(total[2][i, i], 0.0) / n)) for i in range(p)]
    scaled = {k: _scale(v, means, stds) for k, v in mom.items()}
    return medians, means, stds, scaled, _scale(total, means, stds)


def _model(features, target, medians, means, stds, total, alpha, algo=None) -> LinearModel:
    n, mean, M = total
    w, b = _solve(n, mean, M, len(features), alpha)
    return LinearModel(features, target, medians, means, stds, [float(v) for v in w], float(b),
                       alpha=alpha, n=n, algo=algo or ("ols" if alpha == 0 else "ridge"))


def fit_linear(df: DataFrame, features: list[str], target: str, alpha: float = 0.0) -> LinearModel:
    """L2 (alpha=0) / ridge with a fixed alpha: impute -> scale -> solve. Two passes."""
    medians, means, stds, _, total = _fit_moments(df, features, target, None)
    return _model(features, target, medians, means, stds, total, alpha)


def _path(mom: dict, p: int, alphas) -> list[dict]:
    keys = sorted(k for k in mom if k is not None)
    out = []
    for a in alphas:
        scores = []
        for k in keys:
            train = (0, np.zeros(p + 1), np.zeros((p + 1, p + 1)))
            for o in keys:
                if o != k:
                    train = _merge(train, mom[o])
            if train[0] == 0:
                continue
            w, b = _solve(*train, p, a)
            r2 = _holdout_r2(mom[k], w, b, p)
            scores.append(r2 if r2 is not None else float("nan"))
        arr = np.array(scores, dtype=float)
        out.append({"alpha": float(a), "mean_r2": float(np.mean(arr)) if len(arr) else None,
                    "std_r2": float(np.std(arr)) if len(arr) else None, "folds": len(arr),
                    "fold_r2": [float(s) for s in scores]})
    return out


def ridge_path(df: DataFrame, features: list[str], target: str, fold: str,
               alphas: list[float] = RIDGE_ALPHAS) -> list[dict]:
    """L3: mean holdout R² per alpha over the folds in column ``fold``.

    Impute/scale statistics are fitted on all rows first (the pipeline order
    of the reference), then every (alpha, fold) is solved from the k fold
    moments: no pass over the data per alpha or per fold.
    """
    _, _, _, mom, _ = _fit_moments(df, features, target, fold)
    return _path(mom, len(features), alphas)


def best_alpha(path: list[dict]) -> float:
    """Highest mean R²; ties go to the first (smallest) alpha."""
    best, best_s = None, -np.inf
    for r in path:
        s = r["mean_r2"]
        if s is not None and not np.isnan(s) and s > best_s:
            best, best_s = r["alpha"], s
    return best if best is not None else path[0]["alpha"]


def fit_ridge_cv(df: DataFrame, features: list[str], target: str, fold: str,
                 alphas: list[float] = RIDGE_ALPHAS) -> LinearModel:
    """L3: choose alpha by fold CV, refit on all rows with it - two passes in total."""
    medians, means, stds, mom, total = _fit_moments(df, features, target, fold)
    path = _path(mom, len(features), alphas)
    a = best_alpha(path)
    m = _model(features, target, medians, means, stds, total, a, "ridge_cv")
    m.cv = [{k: v for k, v in r.items() if k != "fold_r2"} for r in path]
    return m


def path_frame(spark: SparkSession, path: list[dict]) -> DataFrame:
    return spark.createDataFrame([(r["alpha"], r["mean_r2"], r["std_r2"], r["folds"]) for r in path],
                                 "alpha double, mean_r2 double, std_r2 double, folds int")


def model_of_moments(features: list[str], target: str, medians: list, cells: dict, alphas=None, alpha: float = 0.0) -> LinearModel:
    """A fit from the moments of its imputed rows, one entry per inner fold. With ``alphas`` the best of them over
    the inner folds is taken (L3), else ``alpha``."""
    p = len(features)
    total = (0, np.zeros(p + 1), np.zeros((p + 1, p + 1)))
    for m in cells.values():
        total = _merge(total, m)
    n = total[0]
    means = [float(v) for v in total[1][:p]]
    stds = [float(np.sqrt(max(total[2][i, i], 0.0) / n)) for i in range(p)]
    path = []
    if alphas is not None:
        path = _path({i: _scale(m, means, stds) for i, m in cells.items()}, p, alphas)
        alpha = best_alpha(path)
    out = _model(features, target, medians, means, stds, _scale(total, means, stds), alpha, "ridge_cv" if path else None)
    out.cv = [{k: v for k, v in r.items() if k != "fold_r2"} for r in path]
    return out


# ---------------------------------------------------------------- L9
def cross_validate(df: DataFrame, features: list[str], target: str, fold: str,
                   alpha: float = 0.0) -> DataFrame:
    """Refit the *whole* pipeline per fold (impute / scale statistics from the training folds only) and score
    R² on the held-out fold: ``fold, n, r2, mae, rmse``. One pass gives the moments of every training set, one
    pass the predictions of every held-out fold; no row is copied (``design.Design``)."""
    from vatlens.plans.models import cross_validate as of_models
    kind = "LinearRegression" if not alpha else "Ridge"
    return of_models(df, features, target, fold, models=[kind], alpha=alpha).drop("model")
