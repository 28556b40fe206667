"""Bucketed ordered operators equal the single-partition window."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from vatlens.operators import ordered
from conftest import SF01


@pytest.fixture(scope="module")
def events(spark):
    e = spark.read.parquet(f"{SF01}/events.parquet")
    # nulls in the value and duplicate leading keys
    return e.withColumn("value", F.when(F.col("event_id") % 13 == 0, None).otherwise(F.col("value"))) \
            .withColumn("ts2", F.date_trunc("hour", "ts"))


@pytest.mark.parametrize("buckets", [1, 2, 8, 64, 700])
def test_global_lag_matches_window(events, buckets):
    got = ordered.diff(events, ["value"], ["ts", "event_id"], buckets=buckets).select("event_id", "value_diff")
    w = Window.orderBy("ts", "event_id")
    exp = events.select("event_id", (F.col("value") - F.lag("value").over(w)).alias("value_diff"))
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


@pytest.mark.parametrize("buckets", [2, 16])
def test_run_lag_with_tied_leading_key(events, buckets):
    order = ["ts2", "event_id"]
    got = ordered.diff(events, ["value"], order, ["user_id"], buckets=buckets).select("event_id", "value_diff")
    w = Window.partitionBy("user_id").orderBy(*order)
    exp = events.select("event_id", (F.col("value") - F.lag("value").over(w)).alias("value_diff"))
    assert got.exceptAll(exp).count() == 0


@pytest.mark.parametrize("buckets", [1, 8])
def test_row_index_and_size(events, buckets):
    got = ordered.with_row_index(events, ["ts", "event_id"], ["user_id"], name="i", size_name="n",
                                 buckets=buckets).select("event_id", "i", "n")
    exp = events.select("event_id",
                        (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("i"),
                        F.count(F.lit(1)).over(Window.partitionBy("user_id")).alias("n"))
    assert got.exceptAll(exp).count() == 0


def test_block_folds_sizes(spark):
    for n in [1, 2, 5, 23, 100]:
        df = spark.range(n).withColumnRenamed("id", "t")
        f = ordered.contiguous_folds(df, ["t"], 5)
        sizes = sorted(r["count"] for r in f.groupBy("fold").count().collect())
        q, r = divmod(n, 5)
        assert sorted(sizes) == sorted([q + 1] * r + [q] * (5 - r) if q else [1] * r)
        # contiguous: fold never decreases with t
        rows = f.orderBy("t").collect()
        assert all(a["fold"] <= b["fold"] for a, b in zip(rows, rows[1:]))


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "t long, v double")
    assert ordered.diff(df, ["v"], ["t"]).count() == 0
    one = spark.createDataFrame([(1, 2.0)], "t long, v double")
    assert ordered.diff(one, ["v"], ["t"]).first()["v_diff"] is None


def test_hot_run_is_split_into_pieces(spark):
    """One run holds a third of the rows: it spans many order buckets (window
    partitions), and the result still equals the single-partition window."""
    n = 3000
    rows = [(i, 0 if i % 3 == 0 else 1 + i % 50, float((i * 37) % 101)) for i in range(n)]
    df = spark.createDataFrame(rows, "t long, run long, v double")
    b = ordered.with_order_bucket(df, ["t"], buckets=16)
    pieces = b.filter("run = 0").select("_vl_sub").distinct().count()
    assert pieces >= 8
    got = ordered.diff(df, ["v"], ["t"], ["run"], buckets=16).select("t", "v_diff")
    exp = df.select("t", (F.col("v") - F.lag("v").over(Window.partitionBy("run").orderBy("t"))).alias("v_diff"))
    assert got.exceptAll(exp).count() == 0 and exp.exceptAll(got).count() == 0


ORDERS = {
    "tied": (["const", "event_id"], None), "tied twice": (["const", "hour", "event_id"], None),
    "text": (["event_type", "name"], None), "decimal": (["dec", "event_id"], None),
    "nulls": (["maybe", "event_id"], None), "run": (["const", "event_id"], ["event_type"]),
    "text run": (["name"], ["event_type"])}


@pytest.fixture(scope="module")
def keyed_events(events):
    return events.withColumns({
        "const": F.lit("2024-01-01").cast("timestamp_ntz"), "hour": F.hour("ts"), "dec": (F.col("event_id") % 50).cast("decimal(20,3)") / 7,
        "name": F.concat(F.lit("é"), F.lpad(F.col("event_id").cast("string"), 7, "0")),
        "maybe": F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 5)})


@pytest.mark.parametrize("buckets", [3, 24, 600])
@pytest.mark.parametrize("kind", list(ORDERS))
def test_splitters_over_the_whole_order(keyed_events, kind, buckets):
    order, run = ORDERS[kind]
    sub = ordered.with_order_bucket(keyed_events, order, buckets)
    sizes = [r["count"] for r in sub.groupBy(ordered._SUB).count().collect()]
    assert len(sizes) > buckets / 2 and max(sizes) < max(6 * sum(sizes) / buckets, 80)   # no piece holds a tie whole
    got = ordered.diff(keyed_events, ["value"], order, run, buckets=buckets).select("event_id", "value_diff")
    w = Window.partitionBy(*(run or [])).orderBy(*order)
    exp = keyed_events.select("event_id", (F.col("value") - F.lag("value").over(w)).alias("value_diff"))
    assert got.exceptAll(exp).count() == 0


@pytest.mark.parametrize("kind", ["tied", "text"])
def test_folds_over_the_whole_order(keyed_events, kind):
    order, _ = ORDERS[kind]
    got = ordered.contiguous_folds(keyed_events, order, 5, buckets=16).select("event_id", "fold")
    exp = keyed_events.select("event_id", (F.ntile(5).over(Window.orderBy(*order)) - 1).alias("fold"))
    assert got.exceptAll(exp).count() == 0


def test_hot_table_of_one_timestamp_is_split_by_default(keyed_events):
    sub = ordered.with_order_bucket(keyed_events, ["const", "event_id"])
    assert sub.select(ordered._SUB).distinct().count() > 4
