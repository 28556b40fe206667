"""End-to-end commands: train, predict, benchmark.

Each is one lazy plan up to its writes; the only driver work is the model
fit (moments, see ``linear``) and one-row statistics.

Choices where the reference is inconsistent (see README):
* the input is never overwritten; raw and clean versions are snapshots;
* ``stats="batch"`` refits the z-score on every scored batch (the reference),
  ``stats="model"`` reuses the training statistics;
* ``output="processed"`` writes the surviving processed rows (CLI),
  ``output="input"`` every raw row with a NULL score where a row was dropped
  (dashboard).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vatlens.operators import cleaning, summary
from vatlens.plans import linear, split
from vatlens.plans.preprocess import FeatureSpec, derived_columns, preprocess
from vatlens.sources import feature_schema, files


def train(spark: SparkSession, raw: DataFrame, spec: FeatureSpec, target: str, out: str,
          folds: int = 5, alphas=linear.RIDGE_ALPHAS, snapshot: bool = True) -> linear.LinearModel:
    """Validate target -> snapshot raw/clean -> preprocess -> RidgeCV -> save model + schema.

    RidgeCV's folds are contiguous blocks in row order (``spec.order_by``).
    """
    raw = cleaning.strip_column_names(raw)
    if target not in raw.columns:
        raise ValueError(f"no column {target!r} to train on; columns are {raw.columns}")
    clean = preprocess(raw, spec, strict=True)
    if snapshot:
        files.snapshot(raw, clean, f"{out}/data")
        clean = spark.read.parquet(f"{out}/data/clean")   # cut lineage: fit reads the snapshot
    features = [c for c in clean.columns if c != target and c not in spec.partition_by]
    numeric = set(cleaning.numeric_columns(clean))
    features = [c for c in features if c in numeric]
    fold = split.block_folds(clean, spec.order_by, folds, spec.partition_by or None)
    model = linear.fit_ridge_cv(fold, features, target, "fold", alphas)
    model.zstats = summary.zscore_stats(clean, [c for c in spec.zscores if c in clean.columns])
    feature_schema.save_linear_model(spark, model, f"{out}/model")
    rec = feature_schema.feature_schema_record(spark, clean, target, features, algo=model.algo,
                                               rows=model.n)
    feature_schema.write_feature_schema(rec, f"{out}/schema")
    return model


def training_r2(model: linear.LinearModel, clean: DataFrame) -> DataFrame:
    """R² / MAE / RMSE on the training rows."""
    return summary.regression_metrics(model.transform(clean), model.target, "prediction")


def numeric_inputs(raw: DataFrame, spec: FeatureSpec, model: linear.LinearModel) -> DataFrame:
    """Align a batch: NaN is missing, and what the derivations and the model read is a
    number (text that is none becomes missing). Row order columns stay as they are."""
    raw = cleaning.nan_to_null(cleaning.strip_column_names(raw))
    keep = {*spec.order_by, *spec.partition_by}
    wanted = [c for c in raw.columns if c in spec.inputs() | set(model.features) and c not in keep]
    return raw.withColumns({c: cleaning.to_number(F.col(c), raw.schema[c].dataType) for c in wanted}) \
        if wanted else raw


def predict(spark: SparkSession, raw: DataFrame, model: linear.LinearModel, spec: FeatureSpec,
            output: str = "processed", stats: str = "batch", row_id: str | None = None,
            name: str = "prediction") -> DataFrame:
    """Drop incomplete rows -> align to numbers -> derive -> score.

    A row is incomplete if a cell is missing in the input; a cell that is there but
    no number counts as missing for the model, which fills in its median.
    ``output="input"`` keeps every raw row (J1 without a join: incomplete rows come
    back with NULL derived columns and a NULL score; needs no row id).
    """
    zstats = None
    if stats == "model":
        lost = [s for s, o in spec.zscores.items() if o in model.features and s not in model.zstats]
        if lost:
            raise ValueError(f"the model has no training statistics of {lost}; train it again")
        zstats = {s: model.zstats[s] for s in spec.zscores if s in model.zstats}
    raw = cleaning.nan_to_null(cleaning.strip_column_names(raw))
    complete = F.lit(True)
    for c in raw.columns:
        complete = complete & F.col(f"`{c}`").isNotNull()
    x = preprocess(numeric_inputs(raw.filter(complete), spec, model), spec, strict=False,
                   drop_missing=False, zscore_stats=zstats)
    scored = model.transform(x, name)
    if output == "processed":
        return scored
    rest = numeric_inputs(raw.filter(~complete), spec, model)
    return scored.unionByName(rest, allowMissingColumns=True)


def benchmark(raw: DataFrame, model: linear.LinearModel, spec: FeatureSpec,
              stats: str = "batch") -> DataFrame:
    """Score labelled rows, keep those with a numeric target, R² / MAE / RMSE."""
    x = predict(raw.sparkSession, raw, model, spec, "processed", stats)
    x = cleaning.valid_target(x, model.target)
    return summary.regression_metrics(x, model.target, "prediction")


def score_with_python_model(df: DataFrame, features: list[str],
                            predict_fn: Callable[[pd.DataFrame], "pd.Series"],
                            name: str = "prediction", batch_size: int = 5000) -> DataFrame:
    """Score with a model Spark cannot express (a fitted Python object).

    Arrow batches of at most ``batch_size`` rows go through ``mapInPandas``;
    order and partitioning are kept, every partition scores in parallel.
    """
    schema = T.StructType(df.schema.fields + [T.StructField(name, T.DoubleType())])

    def run(batches):
        for arrived in batches:
            for at in range(0, len(arrived), batch_size):
                pdf = arrived.iloc[at:at + batch_size].copy()
                pdf[name] = pd.Series(predict_fn(pdf[features]), index=pdf.index).astype("float64")
                yield pdf

    return df.mapInPandas(run, schema)


def processed_columns(spec: FeatureSpec, raw_columns: list[str]) -> list[str]:
    return [*raw_columns, *derived_columns(spec)]
