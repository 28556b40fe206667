"""Edge cases of the cleaning operators (FIXTURES section 7)."""

import math

import pytest
from pyspark.sql import functions as F

from vatlens.operators import cleaning


def test_to_number_text_forms(spark):
    vals = ["abc", "1e3", " 5 ", "", "NaN", "inf", "1d", "0x10", "2.5f", "-3", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in df.select(cleaning.to_number(F.col("s"))).collect()]
    assert got[0] is None and got[1] == 1000.0 and got[2] == 5.0 and got[3] is None
    assert got[4] is None and got[5] == math.inf   # NaN is a missing value
    assert got[6] is None and got[7] is None and got[8] is None and got[9] == -3.0 and got[10] is None


def test_to_number_bool(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    t = df.schema["b"].dataType
    assert [r[0] for r in df.select(cleaning.to_number(F.col("b"), t)).collect()] == [1.0, 0.0, None]


def test_median_and_mode(spark):
    df = spark.createDataFrame([(1.0, "S"), (2.0, "C"), (3.0, "S"), (10.0, "C"), (None, "Q"), (None, None)],
                               "x double, c string")
    m = cleaning.fill_median(df, ["x"]).collect()
    assert [r["x"] for r in m][-2:] == [2.5, 2.5]
    mo = cleaning.fill_mode(df, ["c"]).collect()
    assert mo[-1]["c"] == "C"   # tie S/C -> smallest


def test_flags_strict_and_null(spark):
    df = spark.createDataFrame([(1.0,), (1.0000001,), (None,)], "x double")
    assert [r[0] for r in df.select(cleaning.flag("x", ">", 1)).collect()] == [0, 1, 0]


def test_safe_ratio_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (1.0, -0.0), (3.0, 2.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in df.select(cleaning.safe_ratio("a", "b")).collect()] == [None, None, None, 1.5, None]


def test_dropna_nan_and_null(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, "c"), (2.0, None)], "x double, s string")
    assert cleaning.drop_incomplete(df).count() == 1


def test_align_and_report(spark):
    df = spark.createDataFrame([(" 1 ", 2, "x", 9.0)], "a string, b int, extra string, y double")
    out = cleaning.align_columns(df, ["b", "a", "missing"])
    assert out.columns == ["b", "a", "missing"]
    assert out.first() == (2.0, 1.0, None)
    rep = {(r["kind"], r["column_name"]) for r in
           cleaning.alignment_report(spark, df.columns, ["b", "a", "missing"], target="y").collect()}
    assert ("missing", "missing") in rep and ("extra_dropped", "extra") in rep
    assert ("extra_dropped", "y") not in rep


def test_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3), (2, 3), (2, 4)], "a int, b int")
    r = cleaning.duplicate_count(df).first()
    assert (r["n_rows"], r["n_distinct"], r["n_duplicates"]) == (5, 3, 2)
    assert cleaning.drop_duplicates(df).count() == 3


def test_missing_counts_and_mask(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), "x"), (None, None)], "x double, s string")
    got = {r["column_name"]: r["n_missing"] for r in cleaning.missing_counts(df).collect()}
    assert got == {"x": 2, "s": 2}
    m = cleaning.missing_mask(df, ["x", "s"]).collect()
    assert [tuple(r) for r in m] == [(0, 1), (1, 0), (1, 1)]   # NaN is missing here as in the counts


def test_cutoff_split_nulls_to_complement(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "t int")
    a, b = cleaning.split_by_cutoff(df, "t", 3)
    assert a.count() == 1 and b.count() == 2


def test_pending_and_filters(spark):
    df = spark.createDataFrame([("a", True), ("b", False), ("c", None)], "u string, approved boolean")
    assert sorted(r["u"] for r in cleaning.pending(df).collect()) == ["b", "c"]
    assert cleaning.filter_equals(df, u="a").count() == 1


def test_valid_target(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), (" 2 ",)], "y string")
    assert sorted(r["y"] for r in cleaning.valid_target(df, "y").collect()) == [1.5, 2.0]


def test_empty_table(spark):
    df = spark.createDataFrame([], "x double")
    assert cleaning.fill_median(df, ["x"]).count() == 0
    assert cleaning.missing_counts(df).first()["n_missing"] == 0


def test_mode_distributed_path(spark, monkeypatch):
    import vatlens.operators.quantiles as Q
    monkeypatch.setattr(Q, "MAP_LIMIT", 0)          # force the distributed counts
    df = spark.createDataFrame([("S",), ("C",), ("S",), ("C",), ("Q",), (None,)], "c string")
    assert cleaning.fill_mode(df, ["c"]).collect()[-1]["c"] == "C"
