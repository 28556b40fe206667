"""Run history, keyed changes and alert rules."""

import pytest
from pyspark.sql import functions as F

from vatlens.functions import scalar
from vatlens.operators import alerts, history, keyed

RUNS = [
    (1, "ann", "2024-01-01 10:00:00", '{"file":"a.csv","rows":3,"mode":"Predict"}', '{"mean_pred":2.345,"count":3}', "m/x\\r.joblib"),
    (2, "ann", "2024-01-01 10:00:00", '{"file":"b.csv","rows":3}', '{"R2":0.91234,"MAE":0.1,"RMSE":0.2}', "r.joblib"),
    (3, "bob", "2024-01-02 09:00:00", '{"file":"c.csv"}', '{}', "C:\\m\\z.joblib"),
]


@pytest.fixture()
def runs(spark):
    return spark.createDataFrame(RUNS, "id long, username string, timestamp string, inputs string, "
                                       "results string, model_name string") \
                .withColumn("timestamp", F.to_timestamp("timestamp"))


def test_page_order_tie_break(runs):
    p = history.history_page(runs, "ann", 1, page_size=1).collect()
    assert [r["id"] for r in p] == [2]
    assert [r["id"] for r in history.history_page(runs, "ann", 2, page_size=1).collect()] == [1]


def test_page_counts(runs):
    got = {r["username"]: r["n_pages"] for r in history.page_counts(runs).collect()}
    assert got == {"ann": 1, "bob": 1}


def test_summary_text(runs):
    got = {r["id"]: (r["summary"], r["mode"], r["model"]) for r in history.history_summary(runs).collect()}
    assert got[1] == ("Mean: 2.35 | Rows: 3", "Predict", "r.joblib")
    assert got[2] == ("R²: 0.912 | RMSE: 0.200", "N/A", "r.joblib")
    assert got[3] == ("", "N/A", "z.joblib")


def test_lookup_and_export(runs):
    assert history.lookup_run(runs, 3, "ann").count() == 0
    assert history.lookup_run(runs, 3, "bob").count() == 1
    assert history.export_history(runs, "ann", limit=1).count() == 1
    assert history.export_history(runs, "ann", limit=None).count() == 2
    prof = history.run_profile(runs).filter("id = 1").first()["profile"]
    assert '"mode":"Predict"' in prof


def test_keyed_changes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(tuple(r) for r in keyed.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "B"), (3, "C")]
    assert sorted(tuple(r) for r in keyed.insert_absent(old, new, ["k"]).collect()) == [(1, "a"), (2, "b"), (3, "C")]
    ch = spark.createDataFrame([(1, None)], "k int, v string")
    assert sorted(tuple(r) for r in keyed.update_by_key(old, ch, ["k"], ["v"]).collect()) == [(1, None), (2, "b")]
    assert keyed.delete_by_key(old, new, ["k"]).count() == 1
    assert keyed.delete_where(old, F.col("v") == "a").count() == 1


def test_alert_defaults_and_triggers(spark):
    scored = spark.createDataFrame([("ann", 6.0), ("ann", 7.0), ("bob", 6.0), ("cy", 1.0), ("dee", 5.0)],
                                   "username string, s double")
    rules = spark.createDataFrame([("ann", True, 5.0, "above"), ("cy", True, 2.0, "below"),
                                   ("dee", False, 1.0, "above")],
                                  "username string, email_enabled boolean, titer_threshold double, condition string")
    a = {r["username"]: r for r in alerts.batch_alerts(scored, rules, "s", []).collect()}
    assert a["ann"]["triggered"] and a["ann"]["n_violators"] == 2
    assert not a["bob"]["triggered"] and a["bob"]["threshold"] == 5.0   # no rule: defaults, disabled
    assert a["cy"]["triggered"]                                          # below
    assert not a["dee"]["triggered"]                                     # disabled
    rec = alerts.alert_records(alerts.batch_alerts(scored, rules, "s", [])).collect()
    assert sorted(r["username"] for r in rec) == ["ann", "cy"]
    assert "ABOVE 5.00" in [r for r in rec if r["username"] == "ann"][0]["message"]


def test_equal_to_threshold_is_not_beyond(spark):
    scored = spark.createDataFrame([("ann", 5.0)], "username string, s double")
    rules = spark.createDataFrame([("ann", True, 5.0, "above")],
                                  "username string, email_enabled boolean, titer_threshold double, condition string")
    assert not alerts.batch_alerts(scored, rules, "s", []).first()["triggered"]


def test_scalars(spark):
    df = spark.createDataFrame([("a/b\\c.txt", 1234567, 2.675, -0.005)], "p string, n long, x double, y double")
    r = df.select(scalar.basename("p"), scalar.thousands("n"), scalar.format_fixed("x", 2),
                  scalar.format_fixed("y", 2)).first()
    assert r[0] == "c.txt" and r[1] == "1,234,567" and r[2] in ("2.68", "2.67") and r[3] in ("-0.01", "-0.00")
    g = spark.range(1).select(scalar.log_grid(-3, 3, 13).alias("g")).first()["g"]
    assert len(g) == 13 and g[0] == pytest.approx(1e-3) and g[-1] == pytest.approx(1e3)
