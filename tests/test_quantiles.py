"""Distributed exact quantiles equal Spark's ``percentile`` (linear interpolation)."""

import pytest
from pyspark.sql import functions as F

from vatlens.operators.quantiles import exact_quantiles, quantile_row
from conftest import SF01

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


@pytest.mark.parametrize("buckets,method", [(1, "distributed"), (3, "distributed"), (300, "distributed"),
                                            (16, "distributed"), (None, "percentile"), (None, "auto")])
def test_matches_percentile(spark, buckets, method):
    li = spark.read.parquet(f"{SF01}/lineitem.parquet")
    cols = ["l_quantity", "l_extendedprice", "l_tax"]
    got = {(r["column_name"], r["prob"]): r["value"]
           for r in exact_quantiles(li, cols, PROBS, buckets=buckets, method=method).collect()}
    exp = li.agg(*[F.percentile(F.col(c), F.array(*[F.lit(p) for p in PROBS])).alias(c)
                   for c in cols]).first()
    for c in cols:
        for i, p in enumerate(PROBS):
            assert got[(c, p)] == pytest.approx(exp[c][i], abs=1e-9)


def test_grouped_with_hot_group(spark):
    # one group holds 90 % of the rows
    rows = [("hot" if i % 10 else "cold", float((i * 7919) % 1000)) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["prob"]): r["value"]
           for r in exact_quantiles(df, ["v"], PROBS, by=["g"], method="distributed").collect()}
    got2 = {(r["g"], r["prob"]): r["value"]
            for r in exact_quantiles(df, ["v"], PROBS, by=["g"], method="percentile").collect()}
    assert got == got2
    exp = {r["g"]: r["q"] for r in df.groupBy("g").agg(
        F.percentile("v", F.array(*[F.lit(p) for p in PROBS])).alias("q")).collect()}
    for g in ("hot", "cold"):
        for i, p in enumerate(PROBS):
            assert got[(g, p)] == pytest.approx(exp[g][i])


@pytest.mark.parametrize("method", ["distributed", "percentile"])
def test_edges(spark, method, monkeypatch):
    import vatlens.operators.quantiles as Q
    monkeypatch.setattr(Q, "MAP_LIMIT", 0 if method == "distributed" else 10**9)
    df = spark.createDataFrame([(None, 5.0), (None, 5.0), (None, None)], "a double, b double")
    q = quantile_row(df, ["a", "b"], [0.5])
    assert ("a", 0.5) not in q and q[("b", 0.5)] == 5.0
    one = spark.createDataFrame([(3.0,)], "x double")
    assert quantile_row(one, ["x"], [0.0, 0.5, 1.0]) == {("x", 0.0): 3.0, ("x", 0.5): 3.0, ("x", 1.0): 3.0}


def test_only_values_near_the_wanted_ranks_are_ranked(spark, monkeypatch):
    from vatlens.operators import quantiles
    monkeypatch.setattr(quantiles, "WHOLE", 100)
    df = spark.range(40_000).selectExpr("if(id % 2 = 0, 'a', null) as g", "double(id * 7919 % 40009) as v") \
        .unionByName(spark.createDataFrame([("few", float(i)) for i in range(5)], "g string, v double"))
    long = df.select("g", F.lit("v").alias("column_name"), F.col("v").alias("_v"))
    assert quantiles._near(long, ["g", "column_name"], [0.25, 0.5, 0.75]).count() < 1_000
    want = {(r["g"], p): q for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, PROBS))).alias("q")).collect()
            for p, q in zip(PROBS, r["q"])}
    for margin in (5e-4, 0.0):  # without a margin ranks are missed, and every value is ranked
        monkeypatch.setattr(quantiles, "MARGIN", margin)
        got = {(r["g"], r["prob"]): r["value"] for r in exact_quantiles(df, ["v"], PROBS, ["g"], method="distributed").collect()}
        assert got == pytest.approx(want)
