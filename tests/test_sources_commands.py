"""Sources, persistence and the end-to-end commands on a small CSV fixture."""

import os

import pytest
from pyspark.sql import functions as F

from test_golden import COLS, RAW
from vatlens.plans import commands
from vatlens.plans.preprocess import FEATURES, TARGET, bioprocess_spec
from vatlens.sources import feature_schema, files


def _write_csv(path, header, rows):
    with open(path, "w") as f:
        f.write(",".join(header) + "\n")
        for r in rows:
            f.write(",".join("" if v is None else str(v) for v in r) + "\n")


def test_read_csv_tokens_and_inference(spark, tmp_path):
    p = str(tmp_path / "t.csv")
    _write_csv(p, [" a ", "b", "c"], [(1, "NA", "x"), (2, "2.5", "N/A"), ("", "nan", "y")])
    df = files.read_csv(spark, p)
    assert df.columns == ["a", "b", "c"]
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string"}
    rows = df.orderBy(F.col("a").asc_nulls_last()).collect()
    assert [tuple(r) for r in rows] == [(1, None, "x"), (2, 2.5, None), (None, None, "y")]
    typed = files.read_csv(spark, p, schema="a double, b double")
    assert dict(typed.dtypes)["a"] == "double"


def test_schema_and_model_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.5), (3.0, 6.1)], "x double, y double")
    from vatlens.plans import linear
    m = linear.fit_linear(df, ["x"], "y")
    feature_schema.save_linear_model(spark, m, str(tmp_path / "model"))
    m2 = feature_schema.load_linear_model(spark, str(tmp_path / "model"))
    assert m2.coef == m.coef and m2.intercept == m.intercept
    rec = feature_schema.feature_schema_record(spark, df, "y", ["x"], algo="ols")
    feature_schema.write_feature_schema(rec, str(tmp_path / "schema"))
    s = feature_schema.load_feature_schema(spark, str(tmp_path / "schema"))
    assert s["features"] == ["x"] and s["trained_rows"] == 3 and s["dtypes"] == {"x": "double"}
    with pytest.raises(FileNotFoundError):
        feature_schema.load_feature_schema(spark, str(tmp_path / "nope"))


def test_train_predict_benchmark(spark, tmp_path):
    rows = []
    for rep in range(6):   # 66 rows, time keeps increasing
        for r in RAW:
            rows.append((r[0] + 11 * rep, *[v * (1 + 0.01 * rep) for v in r[1:]]))
    p = str(tmp_path / "train.csv")
    _write_csv(p, [f"{c} " for c in COLS], rows)
    raw = files.read_csv(spark, p)
    out = str(tmp_path / "out")
    model = commands.train(spark, raw, bioprocess_spec(), TARGET, out)
    # the first row's missing difference is imputed (median), not dropped
    assert model.features == FEATURES and model.n == 66
    assert os.path.isdir(out + "/data/raw") and os.path.isdir(out + "/data/clean")
    s = feature_schema.load_feature_schema(spark, out + "/schema")
    assert s["features"] == FEATURES and s["trained_rows"] == 66
    loaded = feature_schema.load_linear_model(spark, out + "/model")
    scored = commands.predict(spark, raw, loaded, bioprocess_spec(), output="processed")
    assert scored.filter(F.col("prediction").isNull()).count() == 0
    every = commands.predict(spark, raw.withColumn("pH", F.when(F.col("Time_hours") == 5, None)
                                                   .otherwise(F.col("pH"))),
                             loaded, bioprocess_spec(), output="input")
    assert every.count() == 66 and every.filter(F.col("prediction").isNull()).count() == 1
    m = commands.benchmark(raw, loaded, bioprocess_spec()).first()
    assert m["n"] == 66 and m["r2"] > 0.9          # target-derived features leak (as in the reference)
    tr = commands.training_r2(loaded, spark.read.parquet(out + "/data/clean")).first()
    assert tr["r2"] > 0.9


def test_python_model_scoring(spark):
    df = spark.createDataFrame([(float(i),) for i in range(50)], "x double").repartition(3)
    out = commands.score_with_python_model(df, ["x"], lambda pdf: pdf["x"] * 2.0, batch_size=7)
    assert out.filter(F.col("prediction") != F.col("x") * 2).count() == 0 and out.count() == 50
