"""FIXTURES section 7 edge cases not covered elsewhere."""

import pytest
from pyspark.sql import functions as F

from vatlens.operators import alerts, cleaning, ordered, summary
from vatlens.plans import linear
from vatlens.plans.preprocess import bioprocess_spec, preprocess


def test_empty_batch_never_triggers(spark):
    scored = spark.createDataFrame([], "username string, s double")
    rules = spark.createDataFrame([("ann", True, 5.0, "above")],
                                  "username string, email_enabled boolean, titer_threshold double, condition string")
    a = alerts.batch_alerts(scored, rules, "s", [])
    assert a.count() == 0 and alerts.alert_records(a).count() == 0
    st = summary.batch_stats(scored, "s").first()
    assert st["n"] == 0 and st["mean"] is None


def test_all_null_feature_gets_zero_coefficient(spark):
    df = spark.createDataFrame([(float(i), None, 2.0 * i + 1) for i in range(20)],
                               "x double, dead double, y double")
    m = linear.fit_linear(df, ["x", "dead"], "y")
    assert m.coef[1] == 0.0 and m.medians[1] is None
    assert m.raw_coefficients()[1][0] == pytest.approx(2.0)
    coefs = {r["term"]: r for r in m.coefficients_frame(spark).collect()}
    assert "dead" in coefs and coefs["dead"]["coef"] == 0.0      # reported, not dropped


def test_all_null_and_constant_columns(spark):
    df = spark.createDataFrame([(None, 3.0, 1.0), (None, 3.0, 2.0)], "n double, c double, x double")
    d = {r["column_name"]: r for r in summary.describe(df, ["n", "c", "x"]).collect()}
    assert d["n"]["count"] == 0 and d["n"]["p50"] is None and d["c"]["std"] == 0.0
    z = summary.zscore(df, ["n", "c"]).collect()
    assert all(r["n_z"] is None and r["c_z"] == 0.0 for r in z)
    corr = {(r["col_a"], r["col_b"]): r["corr"] for r in summary.corr_matrix(df, ["n", "c", "x"]).collect()}
    assert corr[("n", "x")] is None and corr[("c", "x")] is None


def test_zero_viability(spark):
    rows = [(0, 37.0, 7.0, 80.0, 5.0, 300.0, 0.0, 0.0), (1, 37.0, 7.0, 80.0, 5.0, 300.0, 0.0, 0.5),
            (2, 37.0, 7.0, 80.0, 5.0, 300.0, 99.0, 1.5)]
    schema = ("Time_hours long, Temperature_C double, pH double, Dissolved_Oxygen_percent double, "
              "Glucose_gL double, Agitation_RPM double, Cell_Viability_percent double, Product_Titer_gL double")
    out = {r["Time_hours"]: r for r in preprocess(spark.createDataFrame(rows, schema), bioprocess_spec()).collect()}
    assert out[0]["Specific_Productivity"] is None and out[1]["Specific_Productivity"] is None
    assert out[2]["Specific_Productivity"] == pytest.approx(1.5 / 99.0)
    assert out[2]["High_Titer_Flag"] == 1 and out[0]["Low_Viability_Flag"] == 1
    assert all(r["Agitation_Normalized"] == 0.0 for r in out.values())   # constant column


def test_two_rows_and_unordered_input(spark):
    df = spark.createDataFrame([(2, 5.0), (1, 3.0)], "t long, v double").repartition(2)
    out = {r["t"]: r["v_diff"] for r in ordered.diff(df, ["v"], ["t"]).collect()}
    assert out == {1: None, 2: 2.0}


def test_missing_target_column_is_lenient_then_strict(spark):
    df = spark.createDataFrame([(0, 98.5)], "Time_hours long, Cell_Viability_percent double")
    out = preprocess(df, bioprocess_spec(), strict=False)
    assert "Low_Viability_Flag" in out.columns and "Specific_Productivity" not in out.columns
    with pytest.raises(ValueError):
        preprocess(df, bioprocess_spec(), strict=True)
    assert cleaning.align_columns(out, ["Product_Titer_gL"]).first()[0] is None
    assert F is not None
