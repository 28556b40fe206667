"""Statistics and distribution operators: edge cases and known values."""

import math

import pytest
from pyspark.sql import functions as F

from vatlens.operators import distribution, summary


def test_describe_quartiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    r = summary.describe(df, ["x"]).first()
    assert (r["p25"], r["p50"], r["p75"]) == (1.75, 2.5, 4.75)
    assert r["count"] == 4 and r["std"] == pytest.approx(4.08248290463863)


def test_corr_constant_column_is_null(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.0), (3.0, 5.0, 6.1)], "a double, c double, b double")
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in summary.corr_matrix(df).collect()}
    assert got[("a", "c")] is None and got[("c", "c")] is None and got[("a", "a")] == 1.0
    assert got[("a", "b")] == pytest.approx(got[("b", "a")]) and got[("a", "b")] > 0.99


def test_zscore_constant_and_population(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (3.0, 3.0)], "x double, c double")
    rows = summary.zscore(df, ["x", "c"]).orderBy("x").collect()
    assert [r["c_z"] for r in rows] == [0.0, 0.0, 0.0]
    assert rows[0]["x_z"] == pytest.approx(-1.0 / math.sqrt(2.0 / 3.0))


def test_regression_metrics_edges(spark):
    perfect = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert summary.regression_metrics(perfect, "y", "p").first()["r2"] == 1.0
    const_bad = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "y double, p double")
    assert summary.regression_metrics(const_bad, "y", "p").first()["r2"] == 0.0
    one = spark.createDataFrame([(1.0, 2.0)], "y double, p double")
    r = summary.regression_metrics(one, "y", "p").first()
    assert r["r2"] is None and r["mae"] == 1.0 and r["rmse"] == 1.0
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.0)], "y double, p double")
    r = summary.regression_metrics(df, "y", "p").first()
    assert r["r2"] == pytest.approx(1 - 1.25 / 2.0) and r["mae"] == pytest.approx(0.5)


def test_histogram_max_in_last_bin_and_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,)], "v double")
    h = distribution.histogram(df, "v", bins=5).orderBy("bin").collect()
    assert [r["n"] for r in h] == [2, 0, 0, 0, 1]
    assert h[-1]["bin_hi"] == 10.0
    const = spark.createDataFrame([(2.0,), (2.0,)], "v double")
    assert sum(r["n"] for r in distribution.histogram(const, "v", bins=3).collect()) == 2


def test_auto_bins_matches_numpy(spark):
    np = pytest.importorskip("numpy")
    vals = [float(x) for x in np.random.default_rng(1).gamma(2.0, 3.0, 1000)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    assert distribution.auto_bins(df, "v") == len(np.histogram_bin_edges(vals, bins="auto")) - 1
    ties = spark.createDataFrame([(i % 3,) for i in range(1000)], "v long")
    assert distribution.auto_bins(ties, "v") == len(np.histogram_bin_edges([i % 3 for i in range(1000)], bins="auto")) - 1


def test_kde_integrates_to_one(spark):
    df = spark.createDataFrame([(float(i % 17) + 0.1 * i,) for i in range(300)], "v double")
    k = distribution.kde(df, "v", grid=200).orderBy("point").collect()
    step = k[1]["x"] - k[0]["x"]
    area = sum(r["density"] for r in k) * step
    assert 0.8 < area <= 1.0
    kb = distribution.kde(df, "v", grid=200, bins=512).orderBy("point").collect()
    assert max(abs(a["density"] - b["density"]) for a, b in zip(k, kb)) < 1e-3


def test_box_summary(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    r = distribution.box_summary(df, "v").first()
    assert (r["q1"], r["median"], r["q3"]) == (2.0, 3.0, 4.0)
    assert r["whisker_hi"] == 4.0 and r["n_outliers"] == 1
    assert distribution.box_outliers(df, "v").first()["v"] == 100.0


def test_violators_and_stats(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (6.0,), (None,)], "s double")
    v = summary.violators(df, "s", 5.0, "above").first()
    assert (v["n"], v["n_violators"]) == (3, 1)
    b = summary.violators(df, "s", 5.0, "below").first()
    assert b["n_violators"] == 1
    st = summary.batch_stats(df, "s").first()
    assert st["n"] == 3 and st["min"] == 1.0 and st["max"] == 6.0


def test_quantile_cutoff_truncates(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "t double")
    assert summary.quantile_cutoff(df, "t", 0.8).first()["cutoff"] == 7


def test_group_mean_drops_null_key(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), (None, 5.0)], "k string, v double")
    assert [tuple(r) for r in summary.group_mean(df, "k", ["v"]).collect()] == [("a", 2.0)]


def test_pair_points_and_long_series(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0)], "t int, a double, b double, c double")
    assert distribution.pair_points(df, ["a", "b", "c"]).count() == 6
    assert distribution.long_series(df, "t", ["a", "b"]).count() == 2
    assert F is not None


def test_histogram_matches_numpy_on_edges(spark):
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(3)
    vals = list(np.round(rng.normal(10, 3, 3000), 2)) + [float(x) for x in np.linspace(0.1, 19.7, 31)]
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    for bins in (7, 30, 31):
        h = distribution.histogram(df, "v", bins=bins).orderBy("bin").collect()
        counts, edges = np.histogram(vals, bins=bins)
        assert [r["n"] for r in h] == list(counts)
        assert [r["bin_lo"] for r in h] == list(edges[:-1]) and h[-1]["bin_hi"] == edges[-1]


def test_kde_matches_direct_sum(spark):
    np = pytest.importorskip("numpy")
    vals = np.random.default_rng(5).gamma(3.0, 2.0, 500)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    k = distribution.kde(df, "v", grid=50).orderBy("point").collect()
    bw = vals.std(ddof=1) * len(vals) ** (-0.2)
    xs = np.linspace(vals.min(), vals.max(), 50)
    ref = np.exp(-0.5 * ((xs[:, None] - vals[None, :]) / bw) ** 2).sum(1) / (len(vals) * bw * np.sqrt(2 * np.pi))
    assert [r["density"] for r in k] == pytest.approx(list(ref), rel=1e-5)   # values are binned first


def test_describe_approx_close_to_exact(spark):
    df = spark.createDataFrame([(float(i % 97) + i / 1000.0,) for i in range(2000)], "x double")
    ex = summary.describe(df, ["x"]).first()
    ap = summary.describe(df, ["x"], approx=True).first()
    assert ex["count"] == ap["count"] == 2000 and ex["mean"] == pytest.approx(ap["mean"])
    for q in ("p25", "p50", "p75"):
        assert abs(ex[q] - ap[q]) < 0.2


def test_wide_correlations_equal_the_narrow_ones(spark, monkeypatch):
    import numpy as np
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        v = [float(x) for x in rng.normal(size=7) * [1, 1e4, 1e-3, 1, 1, 1, 1] + [0, 1e8, 0, 5, 0, 0, 0]]
        v[3] = 7.25                                                    # constant
        v[4] = None if i % 3 else v[0]                                 # mostly missing
        v[5] = float("nan") if i % 5 == 0 else (0.1 if i % 3 == 0 else v[5])   # constant where v[4] is there
        v[6] = None                                                    # nothing
        rows.append((*v,))
    df = spark.createDataFrame(rows, ", ".join(f"c{i} double" for i in range(7))).repartition(5)
    narrow = {(r["col_a"], r["col_b"]): r["corr"] for r in summary.corr_matrix(df).collect()}
    monkeypatch.setattr(summary, "FAN_IN", 2)
    for block, held in ((3, summary.PASS_BYTES), (2, 500)):
        monkeypatch.setattr(summary, "PASS_BYTES", held)
        wide = {(r["col_a"], r["col_b"]): r["corr"] for r in summary.corr_blocks(df, df.columns, block).collect()}
        assert wide.keys() == narrow.keys()
        for k, v in narrow.items():
            assert (wide[k] is None) == (v is None), k
            assert v is None or abs(wide[k] - v) < 1e-9, k


def test_two_thousand_columns(spark):
    df = spark.range(200).select(*[(F.sin(F.col("id") * (i + 1)) + F.col("id") % (i % 7 + 2)).alias(f"c{i}") for i in range(2000)])
    got = summary.corr_matrix(spark.createDataFrame(df.toPandas()))
    assert got.count() == 4_000_000
    assert got.where("corr > 1.0000001 or corr < -1.0000001").count() == 0


def test_pixel_trend_keeps_the_drawn_range(spark):
    rows = [(i, float((i * 37) % 101) if i % 11 else None, float(i % 3)) for i in range(2000)]
    df = spark.createDataFrame(rows, "t long, a double, b double").repartition(4)
    got = distribution.pixel_trend(df, "t", ["a", "b"], "t", pixels=50)
    assert got.count() == 2 * 50 * 4
    for c in ("a", "b"):
        for p in range(0, 50, 7):
            here = [(i, r) for i, *v in rows for r in [v["ab".index(c)]] if r is not None and min(int(i / 1999 * 50), 49) == p]
            point = {r["role"]: (r["time"], r["value"]) for r in got.where((F.col("metric") == c) & (F.col("pixel") == p)).collect()}
            assert point["first"] == here[0] and point["last"] == here[-1]
            assert point["lowest"] == min(here, key=lambda x: (x[1], x[0])) and point["highest"] == min(here, key=lambda x: (-x[1], x[0]))
    assert distribution.pixel_trend(df.limit(0), "t", ["a"], "t").count() == 0


def test_class_sample_is_exact_and_independent_of_partitions(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 50 == 0, "rare").when(F.col("id") % 7 == 0, None).otherwise("hot").alias("c"))
    one = sorted(r["id"] for r in distribution.class_sample(df.repartition(1), ["c"], "id", 150).collect())
    many = distribution.class_sample(df.repartition(13), ["c"], "id", 150)
    assert sorted(r["id"] for r in many.collect()) == one
    assert {r["c"]: r["count"] for r in many.groupBy("c").count().collect()} == {"rare": 100, "hot": 150, None: 150}


def test_bootstrap_rows_are_dealt_out(spark, monkeypatch):
    from vatlens.operators import bootstrap
    df = spark.range(0, 400, 1, 1).union(spark.range(0)).selectExpr("id", "double(id % 7) as v")
    want = bootstrap.bootstrap_mean_ci(df, "v", key="id", replicates=20).first()
    dealt, apart = [], bootstrap.apart
    monkeypatch.setattr(bootstrap, "APART", 100)
    monkeypatch.setattr(bootstrap, "apart", lambda x, rows: dealt.append(rows) or apart(x, rows))
    got = bootstrap.bootstrap_mean_ci(df, "v", key="id", replicates=20).first()
    assert dealt == [400] and all(abs(a - b) < 1e-9 for a, b in zip(want, got))


def test_digests_are_those_of_hashlib():
    import hashlib

    from vatlens.operators import bootstrap
    assert bootstrap.md5(b"12:0:42").digest() == hashlib.md5(b"12:0:42").digest()
