"""Feature schema documents (S3, S4) and model persistence.

The schema is one JSON document ``{target, features[], dtypes{}, trained_rows,
trained_cols[, algo]}`` written and read through Spark (so it lives on the
same shared file system as the data), never through local files.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_TYPE = T.StructType([
    T.StructField("target", T.StringType()),
    T.StructField("features", T.ArrayType(T.StringType())),
    T.StructField("dtypes", T.MapType(T.StringType(), T.StringType())),
    T.StructField("trained_rows", T.LongType()),
    T.StructField("trained_cols", T.IntegerType()),
    T.StructField("algo", T.StringType()),
])


def feature_schema_record(spark: SparkSession, df: DataFrame, target: str,
                          features: list[str], algo: str | None = None,
                          rows: int | None = None) -> DataFrame:
    """The schema of a training frame as a one-row DataFrame (one count job)."""
    types = dict(df.dtypes)
    n = rows if rows is not None else df.count()
    return spark.createDataFrame(
        [(target, list(features), {c: types.get(c, "double") for c in features}, int(n),
          len(df.columns), algo)], SCHEMA_TYPE)


def write_feature_schema(record: DataFrame, path: str) -> None:
    record.coalesce(1).write.mode("overwrite").json(path)


def load_feature_schema(spark: SparkSession, path: str) -> dict:
    """S3: read a schema document (written by S4 or a single JSON file); error if missing."""
    try:
        df = spark.read.schema(SCHEMA_TYPE).option("multiLine", True).json(path)
        row = df.first()
    except Exception as e:  # noqa: BLE001 - Spark raises AnalysisException for a missing path
        raise FileNotFoundError(f"no feature schema at {path}; training writes one") from e
    if row is None:
        raise FileNotFoundError(f"the feature schema at {path} is empty")
    return row.asDict(recursive=True)


def save_linear_model(spark: SparkSession, model, path: str) -> None:
    """A fitted linear pipeline is a small JSON document."""
    spark.createDataFrame([(model.to_json(),)], "model string").coalesce(1) \
         .write.mode("overwrite").json(path)


def load_linear_model(spark: SparkSession, path: str):
    from vatlens.plans.linear import LinearModel
    row = spark.read.schema("model string").json(path).first()
    if row is None:
        raise FileNotFoundError(path)
    return LinearModel.from_json(row["model"])


def coefficient_table(spark: SparkSession, model) -> DataFrame:
    """The coefficient table of a linear model, e.g. to write as Parquet."""
    return model.coefficients_frame(spark).withColumn("algo", F.lit(model.algo)) \
                .withColumn("alpha", F.lit(float(model.alpha)))


def schema_json(record: dict) -> str:
    return json.dumps(record, indent=2, default=str)
