"""CLI commands end to end on a small CSV; EDA report tables."""

import json

import pytest
from pyspark.sql import functions as F

from test_golden import COLS, RAW
from test_sources_commands import _write_csv
from vatlens import cli
from vatlens.operators import history
from vatlens.plans.eda import eda_report, missing_by_bucket


def test_cli_train_predict_benchmark_clean(spark, tmp_path, capsys):
    rows = [(r[0] + 11 * k, *[v * (1 + 0.01 * k) for v in r[1:]]) for k in range(6) for r in RAW]
    data = str(tmp_path / "d.csv")
    _write_csv(data, COLS, rows)
    out = str(tmp_path / "m")
    cli.main(["train", "--data", data, "--target", "Product_Titer_gL", "--out", out])
    info = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert info["trained_rows"] == 66
    pred = str(tmp_path / "p")
    cli.main(["predict", "--model", out, "--input", data, "--output", pred])
    got = spark.read.parquet(pred)
    assert got.count() == 66 and "Pred_Product_Titer_gL" in got.columns
    cli.main(["benchmark", "--model", out, "--data", data])
    m = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert m["n"] == 66 and m["r2"] > 0.9
    runs = str(tmp_path / "runs")
    cli.main(["predict", "--model", out, "--input", data, "--output", pred, "--history", runs, "--user", "ann"])
    cli.main(["predict", "--model", out, "--input", data, "--output", pred + "csv", "--csv", "--history", runs, "--user", "ann"])
    cli.main(["benchmark", "--model", out, "--data", data, "--history", runs, "--user", "ann"])
    records = history.history_summary(history.read_runs(spark, runs)).orderBy("id").collect()
    assert [r["mode"] for r in records] == ["Predict", "Predict", "Benchmark"]
    assert records[0]["summary"] == records[1]["summary"] and records[0]["summary"].endswith("Rows: 66")
    assert records[2]["summary"].startswith("R²: ")
    assert history.history_page(history.read_runs(spark, runs), "ann").count() == 3
    cl = str(tmp_path / "c")
    cli.main(["clean", "--data", data, "--out", cl, "--csv"])
    assert spark.read.option("header", True).csv(cl).count() == 66


def test_eda_report(spark):
    rows = [(i, None if i % 9 == 0 else float(i % 60), "m" if i % 2 else "f", i % 3 == 0,
             None if i % 11 == 0 else ("S" if i % 4 else "C")) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, Age double, Sex string, Survived boolean, Embarked string") \
              .withColumn("Survived", F.col("Survived").cast("int"))
    rep = eda_report(df, "Age", "Sex", hue="Survived", value="Survived", fill_median=["Age"],
                     fill_mode=["Embarked"], order_by=["id"], key="id")
    assert {r["column_name"]: r["n_missing"] for r in rep["missing_counts"].collect()}["Age"] == 45
    assert rep["histogram"].agg(F.sum("n")).first()[0] == 400      # filled before the charts
    assert rep["violin_quartiles"].count() == 4 and rep["count_by_two"].count() == 4
    prof = missing_by_bucket(df, ["Age"], ["id"], buckets=4).orderBy("row_bucket").collect()
    assert [r["n"] for r in prof] == [100] * 4
    assert sum(r["Age"] * r["n"] for r in prof) == pytest.approx(45)
