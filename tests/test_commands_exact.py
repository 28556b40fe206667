"""Commands: batch and model statistics, keep-all output, bad cells, keyed versions, NaN and constants."""

import math

import pytest
from pyspark.sql import functions as F

from vatlens.functions import scalar
from vatlens.operators import bootstrap, cleaning, distribution, keyed, ordered, summary
from vatlens.plans import commands, models
from vatlens.plans.preprocess import FeatureSpec

SPEC = FeatureSpec(order_by=["t"], diffs={"a": "a_diff"}, ratios={"ratio": ("y", "b")}, zscores={"z": "z_norm"},
                   flags={"high": ("a", ">", 5.0)}, target="y")


def rows(n=60):
    return [(i, float((i * 7) % 11), float(1 + i % 5), 100.0 + (i * 13) % 29, float((i * 3) % 17)) for i in range(n)]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(rows(), "t int, a double, b double, z double, y double")


@pytest.fixture(scope="module")
def model(spark, raw, tmp_path_factory):
    return commands.train(spark, raw, SPEC, "y", str(tmp_path_factory.mktemp("model")))


def scores(df):
    return {r.t: r.prediction for r in df.select("t", "prediction").collect()}


def test_model_and_batch_statistics_agree_on_training_data(spark, raw, model):
    one = scores(commands.predict(spark, raw, model, SPEC, stats="model"))
    two = scores(commands.predict(spark, raw, model, SPEC, stats="batch"))
    assert one.keys() == two.keys() and all(abs(one[t] - two[t]) < 1e-9 for t in one)
    part = scores(commands.predict(spark, raw.filter("t < 10"), model, SPEC, stats="model"))
    assert all(abs(part[t] - one[t]) < 1e-9 for t in part)   # a small batch scores as it did in training


def test_keep_all_equals_processed_on_complete_rows(spark, raw, model):
    holes = raw.withColumns({"z": F.when(F.col("t") == 7, F.lit(900.0)).otherwise(F.col("z")),
                             "a": F.when(F.col("t").isin(7, 20), F.lit(None).cast("double")).otherwise(F.col("a")),
                             "b": F.when(F.col("t") == 30, F.lit(math.nan)).otherwise(F.col("b"))})
    kept = scores(commands.predict(spark, holes, model, SPEC, output="input"))
    done = scores(commands.predict(spark, holes, model, SPEC, output="processed"))
    assert len(kept) == 60 and len(done) == 57 and {t for t, p in kept.items() if p is None} == {7, 20, 30}
    assert all(kept[t] == done[t] for t in done)


def test_bad_text_scores_as_missing(spark, raw, model):
    text = raw.withColumn("b", F.when(F.col("t") == 5, F.lit("n/a")).otherwise(F.col("b").cast("string")))
    out = scores(commands.predict(spark, text, model, SPEC))
    good = scores(commands.predict(spark, raw, model, SPEC))
    assert len(out) == 60 and out[5] is not None and all(abs(out[t] - good[t]) < 1e-9 for t in out if t != 5)
    tree = models.fit_tree(raw, ["a", "b"], "y", "rf", num_trees=3)
    assert tree.transform(text).filter("prediction is null").count() == 0


def test_last_write_wins(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (3, "z", 5), (3, "q", 4)], "k int, v string, version int")
    assert sorted(map(tuple, keyed.upsert(old, new, ["k"], version=["version"]).collect())) == \
        [(1, "y"), (2, "b"), (3, "z")]
    assert sorted(map(tuple, keyed.update_by_key(old, new, ["k"], ["v"], version=["version"]).collect())) == \
        [(1, "y"), (2, "b")]


def test_nan_constants_and_null_classes(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", 1.0, 1), ("a", nan, 2), ("b", 3.0, None), (None, 2.0, 4), ("b", 3.0, 5)],
                               "g string, v double, i int")
    assert summary.regression_metrics(df.withColumn("p", F.lit(2.0)), "v", "p").first()["n"] == 4
    assert {r["g"] for r in distribution.histogram(df, "v", 2, by=["g"]).collect()} == {"a", "b"}
    assert sum(r["n"] for r in distribution.histogram(df, "v", 2).collect()) == 4
    k = distribution.kde(df, "v", by=["g"], grid=5).collect()
    assert all(r["density"] is None for r in k if r["g"] == "b") and len(k) > 0
    assert [r["i"] for r in cleaning.fill_median(df, ["i"]).orderBy("v").collect()].count(3.0) == 1
    assert cleaning.missing_mask(df, ["v"]).agg(F.sum("v_missing")).first()[0] == 1
    text = spark.createDataFrame([("NaN",), ("1d",), ("2",)], "y string")
    assert [r["y"] for r in cleaning.valid_target(text, "y").collect()] == [2.0]
    assert summary.violators(df, "v", 0.5, "off").first()["n_violators"] == 0


def test_format_fixed_of_large_numbers(spark):
    out = spark.createDataFrame([(1e17,), (2.5,), (-1234.567,), (None,), (9e15,)], "x double") \
        .select(scalar.format_fixed("x", 2).alias("s")).collect()
    assert [r["s"] for r in out] == ["100000000000000000.00", "2.50", "-1234.57", None, "9000000000000000.00"]


def test_bootstrap_needs_a_key_and_is_about_right(spark):
    df = spark.createDataFrame([(f"r{i}", float(i % 5 == 0)) for i in range(1000)], "id string, v double")
    with pytest.raises(ValueError):
        bootstrap.bootstrap_mean_ci(df, "v")
    r = bootstrap.bootstrap_mean_ci(df, "v", key="id", replicates=300).first()
    assert 0.16 < r["ci_lo"] < 0.19 and 0.21 < r["ci_hi"] < 0.24


def test_permutation_takes_text_keys(spark, raw):
    from vatlens.plans import linear
    x = raw.withColumn("id", F.concat(F.lit("row"), F.col("t")))
    m = linear.fit_linear(x, ["a", "b"], "y")
    out = models.permutation_importance(m, x, ["a", "b"], "y", "id", repeats=3).collect()
    assert {r["feature"] for r in out} == {"a", "b"} and all(r["repeats"] == 3 for r in out)


def test_cut_points_from_a_sample_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(ordered, "CUT_SAMPLE", 3)
    monkeypatch.setattr(ordered, "LEAST_ROWS", 20)
    df = spark.range(3000).select((F.col("id") % 7).alias("k"), (F.col("id") * 37 % 3001).alias("x"))
    out = ordered.with_row_index(df, ["x"], name="i").collect()
    order = sorted(r["x"] for r in out)
    assert all(order[r["i"]] == r["x"] for r in out)
