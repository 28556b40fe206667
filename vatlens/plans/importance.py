"""Feature importance (L15, L16) and feature zipping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def zip_importances(spark: SparkSession, features: Sequence[str], values: Sequence[float],
                    kind: str = "coefficient") -> DataFrame:
    """J4 + T5: pair names with importances, sorted descending, with a rank."""
    arr = spark.createDataFrame([(list(features), [float(v) for v in values])],
                                "features array<string>, vals array<double>")
    z = arr.select(F.explode(F.arrays_zip("features", "vals")).alias("p"))
    z = z.select(F.col("p.features").alias("feature"), F.col("p.vals").alias("importance"))
    w = Window.orderBy(F.desc("importance"), F.asc("feature"))
    return z.withColumn("rank", F.row_number().over(w)).withColumn("kind", F.lit(kind))


def coefficient_importance(spark: SparkSession, model) -> DataFrame:
    """Coefficients on the standardised features (linear) as importances."""
    return zip_importances(spark, model.features, model.coef, "coefficient")


def tree_importance(spark: SparkSession, features: Sequence[str], tree_model) -> DataFrame:
    """Mean over the trees of each tree's shares of gain."""
    return zip_importances(spark, features, tree_model.importances(), "tree")
