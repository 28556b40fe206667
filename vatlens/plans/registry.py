"""Driver queries: one callable per operator, each reading the given tables.

Every callable takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole tables. Doubles are rounded to 6 places (``_r6``) only at the very
end, for the comparison with the DuckDB oracle in ``vatlens.plans.oracle``;
column names are aliased identically on both sides.

Recipes: ``ev`` is ``events`` plus ``k`` = the number in ``props``. The test
tables hold no nulls, so null-handling queries inject them the same way in
both engines (value NULL when ``event_id % 7 = 0``, k NULL when
``event_id % 11 = 0``); no row is filtered out by that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vatlens.operators import cleaning, distribution, ordered, summary
from vatlens.plans.preprocess import FeatureSpec, preprocess

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ev(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", "ts", "user_id", "event_type", "value",
                    F.get_json_object("props", "$.k").cast("double").alias("k"))


def ev_nulls(spark: SparkSession, d: str) -> DataFrame:
    e = ev(spark, d)
    return e.withColumns({
        "value": F.when(F.col("event_id") % 7 == 0, F.lit(None).cast("double")).otherwise(F.col("value")),
        "k": F.when(F.col("event_id") % 11 == 0, F.lit(None).cast("double")).otherwise(F.col("k")),
    })


def r6(c):
    """``floor(x * 1e6 + 0.5) / 1e6``: the same IEEE steps as the oracle's ``R``.

    (``round`` rounds the shortest decimal string in Spark but the binary
    value in DuckDB, so exact ties such as 65.99 / 32 would differ.)
    """
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) < F.lit(1e12),
                  F.floor(c * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)).otherwise(c) + F.lit(0.0)


def _r6(df: DataFrame) -> DataFrame:
    """Round doubles to 6 places (and fold -0.0) for the oracle comparison."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(r6(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


ORDER = ["ts", "event_id"]
RUN = ["user_id"]


def ev_spec() -> FeatureSpec:
    return FeatureSpec(
        order_by=ORDER, partition_by=RUN,
        diffs={"value": "value_diff", "k": "k_diff"},
        ratios={"ratio": ("value", "k")},
        zscores={"value": "value_z"},
        flags={"high_flag": ("value", ">", 100.0), "low_flag": ("k", "<", 50.0)},
    )


# ------------------------------------------------------------------ ingest / cleaning
@query("clean_dropna")
def q_clean_dropna(spark, d):
    return _r6(cleaning.drop_incomplete(ev_nulls(spark, d)).drop("ts"))


ALIGN_FEATURES = ["o_orderkey", "o_totalprice", "o_orderpriority", "missing_col"]


@query("align_schema")
def q_align_schema(spark, d):
    return _r6(cleaning.align_columns(table(spark, d, "orders"), ALIGN_FEATURES))


@query("alignment_report")
def q_alignment_report(spark, d):
    o = table(spark, d, "orders")
    return cleaning.alignment_report(spark, o.columns, ALIGN_FEATURES, target="o_totalprice")


@query("diff_by_run")
def q_diff_by_run(spark, d):
    x = ordered.diff(ev(spark, d), ["value", "k"], ORDER, RUN)
    return _r6(x.select("event_id", "user_id", "value_diff", "k_diff"))


@query("diff_global")
def q_diff_global(spark, d):
    x = ordered.diff(ev(spark, d), ["value"], ORDER)
    return _r6(x.select("event_id", "value_diff"))


@query("diff_after_dropna")
def q_diff_after_dropna(spark, d):
    x = ordered.diff(cleaning.drop_incomplete(ev_nulls(spark, d)), ["value", "k"], ORDER, RUN)
    return _r6(x.select("event_id", "user_id", "value_diff", "k_diff"))


@query("ratio_safe")
def q_ratio_safe(spark, d):
    li = table(spark, d, "lineitem")
    return _r6(li.select("l_orderkey", "l_linenumber",
                         cleaning.safe_ratio("l_extendedprice", "l_discount").alias("ratio")))


@query("threshold_flags")
def q_threshold_flags(spark, d):
    e = ev(spark, d)
    return e.select("event_id", cleaning.flag("value", ">", 100.0).alias("high_flag"),
                    cleaning.flag("k", "<", 50.0).alias("low_flag"))


@query("zscore_pop")
def q_zscore_pop(spark, d):
    return _r6(summary.zscore(ev(spark, d), {"value": "value_z"}).select("event_id", "value_z"))


@query("zscore_by_run")
def q_zscore_by_run(spark, d):
    z = summary.zscore(ev(spark, d), {"value": "value_z"}, partition_by=RUN)
    return _r6(z.select("event_id", "user_id", "value_z"))


@query("preprocess_full")
def q_preprocess_full(spark, d):
    x = preprocess(ev(spark, d), ev_spec(), strict=True)
    return _r6(x.select("event_id", "user_id", "value", "k", "value_diff", "k_diff", "ratio",
                        "value_z", "high_flag", "low_flag"))


@query("fill_median")
def q_fill_median(spark, d):
    x = cleaning.fill_median(ev_nulls(spark, d), ["value", "k"])
    return _r6(x.select("event_id", "value", "k"))


@query("fill_mode")
def q_fill_mode(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("o_orderpriority")).alias("o_orderpriority"))
    return cleaning.fill_mode(o, ["o_orderpriority"])


@query("dedupe")
def q_dedupe(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return cleaning.drop_duplicates(li)


@query("duplicate_count")
def q_duplicate_count(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return cleaning.duplicate_count(li)


@query("missing_counts")
def q_missing_counts(spark, d):
    return cleaning.missing_counts(ev_nulls(spark, d))


@query("missing_mask")
def q_missing_mask(spark, d):
    return cleaning.missing_mask(ev_nulls(spark, d), ["value", "k", "event_type"],
                                 keep=["event_id"])


@query("valid_target")
def q_valid_target(spark, d):
    o = table(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("n/a"))
        .otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"))
    return _r6(cleaning.valid_target(o, "o_totalprice"))


@query("time_split_counts")
def q_time_split_counts(spark, d):
    e = ev(spark, d).withColumn(
        "t", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)"))
    cut = summary.quantile_cutoff(e, "t", 0.8).first()["cutoff"]
    before, after = cleaning.split_by_cutoff(e, "t", cut)
    b = before.agg(F.count(F.lit(1)).cast("long").alias("n"), F.avg("value").alias("mean_value")) \
        .withColumn("side", F.lit("train"))
    a = after.agg(F.count(F.lit(1)).cast("long").alias("n"), F.avg("value").alias("mean_value")) \
        .withColumn("side", F.lit("test"))
    return _r6(b.unionByName(a).withColumn("cutoff", F.lit(cut).cast("long")))


@query("quantile_cutoff")
def q_quantile_cutoff(spark, d):
    e = ev(spark, d).withColumn(
        "t", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)"))
    return summary.quantile_cutoff(e, "t", 0.8)


# ------------------------------------------------------------------ describe
LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def li_num(spark, d):
    li = table(spark, d, "lineitem")
    # -0.0 occurs in discount/tax; fold it to 0.0 once
    return li.withColumns({c: F.col(c) + F.lit(0.0) for c in ("l_discount", "l_tax")})


@query("describe_numeric")
def q_describe_numeric(spark, d):
    return _r6(summary.describe(li_num(spark, d), LI_NUM))


@query("kpi_means")
def q_kpi_means(spark, d):
    return _r6(summary.kpi_means(ev(spark, d), ["value", "k", "not_there"]))


@query("group_mean")
def q_group_mean(spark, d):
    return _r6(summary.group_mean(ev(spark, d), "event_type", ["value", "k"]))


@query("group_count2")
def q_group_count2(spark, d):
    return summary.count_by(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("corr_matrix")
def q_corr_matrix(spark, d):
    return _r6(summary.corr_matrix(li_num(spark, d), LI_NUM))


@query("hist_fixed")
def q_hist_fixed(spark, d):
    return _r6(distribution.histogram(ev(spark, d), "value", bins=30))


@query("hist_auto")
def q_hist_auto(spark, d):
    return _r6(distribution.histogram_auto(ev(spark, d), "value"))


@query("hist_by_class")
def q_hist_by_class(spark, d):
    return _r6(distribution.histogram(ev(spark, d), "value", bins=20, by=["event_type"]))


@query("kde_curve")
def q_kde_curve(spark, d):
    return _r6(distribution.kde(ev(spark, d), "value", grid=200))


@query("kde_by_class")
def q_kde_by_class(spark, d):
    return _r6(distribution.kde(ev(spark, d), "value", by=["event_type"], grid=200))


@query("box_summary")
def q_box_summary(spark, d):
    return _r6(distribution.box_summary(table(spark, d, "lineitem"), "l_extendedprice",
                                        by=["l_returnflag"]))


@query("box_outliers")
def q_box_outliers(spark, d):
    o = table(spark, d, "orders")
    return _r6(distribution.box_outliers(o, "o_totalprice", by=["o_orderpriority"],
                                         keep=["o_orderkey"]))


@query("unpivot_trend")
def q_unpivot_trend(spark, d):
    x = distribution.long_series(ev(spark, d), "event_id", ["value", "k"])
    return _r6(x)


@query("trend_mean")
def q_trend_mean(spark, d):
    e = ev(spark, d).withColumn("day", F.to_date("ts"))
    g = e.groupBy("day").agg(F.avg("value").alias("mean_value"),
                             F.count(F.lit(1)).cast("long").alias("n"))
    return _r6(g.withColumn("day", F.col("day").cast("string")))


@query("bar_mean")
def q_bar_mean(spark, d):
    return _r6(summary.group_mean(ev(spark, d), "event_type", ["value"]))


@query("pair_points")
def q_pair_points(spark, d):
    p = table(spark, d, "part")
    return _r6(distribution.pair_points(p, ["p_size", "p_retailprice", "p_partkey"],
                                        keep=["p_partkey"]).withColumnRenamed("p_partkey", "id"))


# ------------------------------------------------------------------ models (linear)
from vatlens.plans import linear, split  # noqa: E402

PART_X1 = ["p_partkey"]
PART_X2 = ["p_size", "p_partkey"]
PART_Y = "p_retailprice"


def _part(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")


def _rk(df: DataFrame, digits: int = 4) -> DataFrame:
    """Coarser rounding for values computed along different float paths."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c, s = F.col(f.name), float(10 ** digits)
            out.append((F.when(F.abs(c) < F.lit(1e12), F.floor(c * F.lit(s) + F.lit(0.5)) / F.lit(s))
                        .otherwise(c) + F.lit(0.0)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


@query("ols_fit")
def q_ols_fit(spark, d):
    m = linear.fit_linear(_part(spark, d), PART_X1, PART_Y)
    return _rk(m.coefficients_frame(spark).select("term", "coef_raw"))


@query("ols_score")
def q_ols_score(spark, d):
    p = _part(spark, d)
    m = linear.fit_linear(p, PART_X1, PART_Y)
    return _rk(m.transform(p).select("p_partkey", "prediction"))


@query("ols_metrics")
def q_ols_metrics(spark, d):
    p = _part(spark, d)
    m = linear.fit_linear(p, PART_X1, PART_Y)
    return _rk(summary.regression_metrics(m.transform(p), PART_Y, "prediction"))


def _part_blocks(spark, d):
    return split.block_folds(_part(spark, d), ["p_partkey"], 5)


@query("ridge_path")
def q_ridge_path(spark, d):
    path = linear.ridge_path(_part_blocks(spark, d), PART_X2, PART_Y, "fold")
    return _rk(linear.path_frame(spark, path).select("alpha", "mean_r2"))


@query("ridge_cv_select")
def q_ridge_cv_select(spark, d):
    m = linear.fit_ridge_cv(_part_blocks(spark, d), PART_X2, PART_Y, "fold")
    c = m.coefficients_frame(spark).select("term", "coef").withColumn("alpha", F.lit(m.alpha))
    return _rk(c)


@query("importance_coef")
def q_importance_coef(spark, d):
    from vatlens.plans import importance
    m = linear.fit_ridge_cv(_part_blocks(spark, d), PART_X2, PART_Y, "fold")
    return _rk(importance.coefficient_importance(spark, m))


@query("residual_hist")
def q_residual_hist(spark, d):
    p = _part(spark, d)
    m = linear.fit_linear(p, PART_X1, PART_Y)
    r = distribution.residuals(m.transform(p), PART_Y, "prediction")
    return _rk(distribution.histogram(r, "residual", bins=20), 3)


@query("actual_vs_pred")
def q_actual_vs_pred(spark, d):
    p = _part(spark, d)
    m = linear.fit_linear(p, PART_X1, PART_Y)
    pts, lim = distribution.actual_vs_predicted(m.transform(p), PART_Y, "prediction")
    return _rk(distribution.attach(pts, lim, []))


@query("hash_split")
def q_hash_split(spark, d):
    return split.hash_split(table(spark, d, "orders").select("o_orderkey"), "o_orderkey")


@query("fold_sizes")
def q_fold_sizes(spark, d):
    f = split.hash_folds(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5)
    return summary.count_by(f, ["fold"])


@query("block_folds")
def q_block_folds(spark, d):
    return split.block_folds(ev(spark, d).select("event_id", "ts"), ORDER, 5).select("event_id", "fold")


@query("cv_scores_two_features")
def q_cv_scores_two_features(spark, d):
    p = split.hash_folds(_part(spark, d), "p_partkey", 5)
    return _rk(linear.cross_validate(p, PART_X2, PART_Y, "fold").select("fold", "n", "r2", "mae", "rmse"))


@query("cv_scores")
def q_cv_scores(spark, d):
    p = split.hash_folds(_part(spark, d), "p_partkey", 5)
    return _rk(linear.cross_validate(p, PART_X1, PART_Y, "fold").select("fold", "n", "r2"))


EV_FEATURES = ["k", "value_diff", "k_diff", "ratio", "value_z", "high_flag", "low_flag"]


@query("flagship")
def q_flagship(spark, d):
    """Preprocess -> fit on every derived feature (ridge, CV folds in time order) -> score -> metrics per batch."""
    from vatlens.session import materialize
    x = materialize(preprocess(ev(spark, d), ev_spec(), strict=True))   # folds and fit read the result
    folds = materialize(split.block_folds(x, ORDER, 5).select("event_type", "fold", "value", *EV_FEATURES))
    m = linear.fit_ridge_cv(folds, EV_FEATURES, "value", "fold")
    return _rk(summary.regression_metrics(m.transform(folds), "value", "prediction", group_by=["event_type"]))


@query("flagship_two_features")
def q_flagship_two_features(spark, d):
    """The same on two features, for which SQL has the solution in closed form."""
    from vatlens.session import materialize
    x = preprocess(ev(spark, d), ev_spec(), strict=True)
    feats = ["k", "k_diff"]
    folds = materialize(split.block_folds(x, ORDER, 5).select("event_type", "fold", "value", *feats))
    m = linear.fit_ridge_cv(folds, feats, "value", "fold")
    scored = m.transform(folds)
    return _rk(summary.regression_metrics(scored, "value", "prediction", group_by=["event_type"]))


# ------------------------------------------------------------------ run history
from vatlens.functions import scalar  # noqa: E402
from vatlens.operators import alerts, history, keyed  # noqa: E402

HIST_USER = "user_8"


def runs(spark, d):
    """Run log derived from events: one run per event (benchmark when value > 250)."""
    e = ev(spark, d)
    bench = F.col("value") > 250
    silent = (F.col("event_type") == "signup") & (F.col("value") < 20)
    inputs = F.to_json(F.struct(
        F.concat(F.lit("batch_"), F.col("event_type"), F.lit(".csv")).alias("file"),
        F.col("k").cast("int").alias("rows"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("string"))
         .when(bench, F.lit("Benchmark")).otherwise(F.lit("Predict")).alias("mode")))
    results = F.to_json(F.struct(
        F.when(bench, F.col("value") / 490).alias("R2"),
        F.when(bench, F.col("value") / 7).alias("MAE"),
        F.when(bench, F.sqrt("value")).alias("RMSE"),
        F.when(~bench & ~silent, F.col("value")).alias("mean_pred"),
        F.when(~bench & ~silent, F.col("k").cast("int")).alias("count")))
    model = F.concat(F.lit("models\\"), F.col("event_type"), F.lit("/ridge_v"),
                     (F.col("user_id") % 3).cast("string"), F.lit(".joblib"))
    return e.select(F.col("event_id").alias("id"),
                    F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("username"),
                    F.col("ts").alias("timestamp"), inputs.alias("inputs"), results.alias("results"),
                    model.alias("model_name"))


@query("history_page")
def q_history_page(spark, d):
    p = history.history_page(runs(spark, d), HIST_USER, page=2)
    return p.select("id", "username", scalar.basename("model_name").alias("model"),
                    scalar.json_field("inputs", "mode", "N/A").alias("mode"))


@query("history_pages_total")
def q_history_pages_total(spark, d):
    return history.page_counts(runs(spark, d))


@query("history_summary")
def q_history_summary(spark, d):
    return history.history_summary(runs(spark, d)).drop("timestamp")


@query("history_export")
def q_history_export(spark, d):
    x = history.export_history(runs(spark, d), HIST_USER, limit=history.EXPORT_LIMIT)
    return x.select("id", "username", scalar.date_part("timestamp").alias("day"))


@query("run_profile")
def q_run_profile(spark, d):
    p = history.run_profile(runs(spark, d))
    return p.select("id", F.get_json_object("profile", "$.username").alias("username"),
                    F.get_json_object("profile", "$.inputs.file").alias("file"),
                    F.get_json_object("profile", "$.model_name").alias("model_name"))


@query("lookup_run")
def q_lookup_run(spark, d):
    r = runs(spark, d)
    first = history.history_page(r, HIST_USER, page=1).select("id").first()
    rid = first["id"] if first else -1
    return history.lookup_run(r, rid, HIST_USER).select("id", "username")


# ------------------------------------------------------------------ keyed changes
def _orders_old_new(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate")
    old = o.filter(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")).drop("o_orderdate")
    new = (o.filter(F.col("o_orderdate") >= F.lit("1994-01-01").cast("timestamp_ntz"))
           .select("o_orderkey", (F.col("o_totalprice") + F.lit(1.0)).alias("o_totalprice"),
                   F.lit("U").alias("o_orderstatus")))
    return old, new


@query("upsert_latest")
def q_upsert_latest(spark, d):
    old, new = _orders_old_new(spark, d)
    return _r6(keyed.upsert(old, new, ["o_orderkey"]))


@query("upsert_versions")
def q_upsert_versions(spark, d):
    """M2 with several new rows of a key: the last line of the order wins."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    new = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"),
                                             F.col("l_extendedprice").alias("price"), "l_linenumber")
    return _r6(keyed.upsert(o, new, ["o_orderkey"], version=["l_linenumber"]))


@query("update_versions")
def q_update_versions(spark, d):
    """M3 with several changes of a key: the last line of the order holds."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    ch = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"),
                                            F.col("l_returnflag").alias("o_orderstatus"), "l_linenumber")
    return keyed.update_by_key(o, ch, ["o_orderkey"], ["o_orderstatus"], version=["l_linenumber"])


@query("insert_absent")
def q_insert_absent(spark, d):
    old, new = _orders_old_new(spark, d)
    return _r6(keyed.insert_absent(old, new, ["o_orderkey"]))


@query("update_by_key")
def q_update_by_key(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    ch = (table(spark, d, "lineitem").filter(F.col("l_returnflag") == "R")
          .select(F.col("l_orderkey").alias("o_orderkey")).distinct()
          .withColumn("o_orderstatus", F.lit("R")))
    return keyed.update_by_key(o, ch, ["o_orderkey"], ["o_orderstatus"])


@query("delete_by_key")
def q_delete_by_key(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    doomed = (table(spark, d, "customer").filter(F.col("c_mktsegment") == "AUTOMOBILE")
              .select(F.col("c_custkey").alias("o_custkey")))
    return keyed.delete_by_key(o, doomed, ["o_custkey"]).select("o_orderkey")


@query("cascade_delete")
def q_cascade_delete(spark, d):
    c = table(spark, d, "customer")
    o = table(spark, d, "orders")
    li = table(spark, d, "lineitem")
    doomed_c = c.filter(F.col("c_acctbal") < 0).select("c_custkey")
    doomed_o = o.join(doomed_c, o["o_custkey"] == doomed_c["c_custkey"], "left_semi").select("o_orderkey")
    nxt = keyed.cascade_delete(doomed_o, "o_orderkey", {"lineitem": (li, "l_orderkey")})
    nxt.update(keyed.cascade_delete(doomed_c, "c_custkey",
                                    {"orders": (o, "o_custkey"), "customer": (c, "c_custkey")}))
    parts = [t.agg(F.count(F.lit(1)).cast("long").alias("n_rows")).withColumn("table_name", F.lit(n))
             for n, t in nxt.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------ alerts
def rules(spark, d):
    c = table(spark, d, "customer")
    # customers of one segment have no rule of their own
    return c.filter(F.col("c_mktsegment") != "MACHINERY").select(
        F.concat(F.lit("user_"), F.col("c_custkey").cast("string")).alias("username"),
        (F.col("c_mktsegment") != "HOUSEHOLD").alias("email_enabled"),
        (F.floor(F.abs("c_acctbal")) / F.lit(20.0)).alias("titer_threshold"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE"), F.lit("below"))
         .otherwise(F.lit("above")).alias("condition"))


def scored_batches(spark, d):
    e = ev(spark, d)
    return e.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("username"),
                    "user_id", F.col("value").alias("score"),
                    F.concat(F.lit("runs\\"), F.col("user_id").cast("string"),
                             F.lit("/model_ridge.joblib")).alias("model_path"))


@query("run_stats")
def q_run_stats(spark, d):
    return _r6(summary.batch_stats(ev(spark, d), "value", ["user_id"]))


@query("violators")
def q_violators(spark, d):
    j = alerts.with_rule(scored_batches(spark, d), rules(spark, d))
    v = summary.violators(j, "score", "threshold", "condition", batch=["username"])
    return _r6(v)


@query("alert_trigger")
def q_alert_trigger(spark, d):
    a = alerts.batch_alerts(scored_batches(spark, d), rules(spark, d), "score", ["username"])
    return _r6(a.select("username", "email_enabled", "threshold", "condition", "n", "mean",
                        "triggered"))


@query("alert_report")
def q_alert_report(spark, d):
    a = alerts.batch_alerts(scored_batches(spark, d), rules(spark, d), "score", ["username"],
                            model="model_path")
    r = alerts.alert_records(a)
    return _r6(r.select("username", "n", "n_violators", "pct_violators", "mean", "min", "max",
                        "model", "message"))


@query("attach_scores")
def q_attach_scores(spark, d):
    """Score the complete rows, keep every raw row (NULL score where dropped)."""
    raw = ev_nulls(spark, d)
    complete = cleaning.drop_incomplete(raw)
    m = linear.fit_linear(complete, ["k"], "value")
    ok = F.lit(True)
    for c in raw.columns:
        ok = ok & F.col(c).isNotNull()
    out = raw.select("event_id", F.when(ok, m.prediction()).alias("prediction"))
    return _rk(out)


# ------------------------------------------------------------------ random / iterative (rows-only)
from vatlens.operators import bootstrap  # noqa: E402
from vatlens.plans import importance, models  # noqa: E402


@query("bootstrap_ci")
def q_bootstrap_ci(spark, d):
    return _r6(bootstrap.bootstrap_mean_ci(ev(spark, d), "value", by=["event_type"],
                                           key="event_id", replicates=1000))


@query("trend_ci")
def q_trend_ci(spark, d):
    e = ev(spark, d)
    out = bootstrap.trend_with_ci(e, F.to_date("ts").cast("string"), "value", key="event_id",
                                  replicates=1000)
    return _r6(out)


def _part_split(spark, d):
    p = split.hash_split(_part(spark, d), "p_partkey")
    return p.filter(F.col("split") == "train"), p.filter(F.col("split") == "test")


@query("rf_score")
def q_rf_score(spark, d):
    tr, te = _part_split(spark, d)
    m = models.fit_tree(tr, PART_X2, PART_Y, "rf", num_trees=300, key="p_partkey")
    return _r6(summary.regression_metrics(m.transform(te), PART_Y, "prediction"))


@query("gbt_score")
def q_gbt_score(spark, d):
    tr, te = _part_split(spark, d)
    m = models.fit_tree(tr, PART_X2, PART_Y, "gbt")
    return _r6(summary.regression_metrics(m.transform(te), PART_Y, "prediction"))


@query("rff_score")
def q_rff_score(spark, d):
    tr, te = _part_split(spark, d)
    m = models.fit_rff(tr, PART_X2, PART_Y)
    return _r6(summary.regression_metrics(m.transform(te), PART_Y, "prediction"))


@query("svr_score")
def q_svr_score(spark, d):
    tr, te = _part_split(spark, d)
    m = models.svr.fit_svr(tr, PART_X2, PART_Y)
    scored = summary.regression_metrics(m.transform(te), PART_Y, "prediction")
    return _r6(scored.withColumn("gap_below_tolerance", F.lit(m.params["gap"] < models.svr.TOLERANCE)))


@query("cv_models")
def q_cv_models(spark, d):
    """L9 for every kind of model, two features: R² of each held-out fold."""
    p = split.hash_folds(_part(spark, d), "p_partkey", 5)
    return _r6(models.cross_validate(p, PART_X2, PART_Y, "fold", key="p_partkey").select("model", "fold", "n", "r2"))


@query("tree_importance")
def q_tree_importance(spark, d):
    """Importances of a forest and of boosted trees."""
    tr, _ = _part_split(spark, d)
    out = None
    for kind, trees in (("rf", 100), ("gbt", 100)):
        m = models.fit_tree(tr, PART_X2, PART_Y, kind, num_trees=trees, key="p_partkey")
        one = importance.tree_importance(spark, PART_X2, m).withColumn("model", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return _r6(out)


@query("model_leaderboard")
def q_model_leaderboard(spark, d):
    tr, te = _part_split(spark, d)
    return _r6(models.leaderboard(tr, te, PART_X2, PART_Y, "p_partkey"))


@query("best_model")
def q_best_model(spark, d):
    tr, te = _part_split(spark, d)
    board = models.leaderboard(tr, te, PART_X2, PART_Y, "p_partkey")
    return _r6(models.best_model(board))


@query("perm_importance")
def q_perm_importance(spark, d):
    tr, te = _part_split(spark, d)
    m = linear.fit_ridge_cv(split.hash_folds(tr, "p_partkey", seed="cv"), PART_X2, PART_Y, "fold")
    return _r6(models.permutation_importance(m, te, PART_X2, PART_Y, "p_partkey", repeats=10))


@query("refit_without_time")
def q_refit_without_time(spark, d):
    """Drop the time-like feature (p_partkey here), refit ridge, score the test rows."""
    tr, te = _part_split(spark, d)
    m = linear.fit_ridge_cv(split.hash_folds(tr, "p_partkey", seed="cv"), ["p_size"], PART_Y, "fold")
    return _rk(summary.regression_metrics(m.transform(te), PART_Y, "prediction"))


@query("time_split_eval")
def q_time_split_eval(spark, d):
    """Train on keys up to the 0.8 quantile, test on the rest (OLS)."""
    p = _part(spark, d)
    tr, te, cut = split.time_split(p, "p_partkey", 0.8)
    m = linear.fit_linear(tr, PART_X1, PART_Y)
    return _rk(summary.regression_metrics(m.transform(te), PART_Y, "prediction")
               .withColumn("cutoff", F.lit(cut).cast("long")))


# ------------------------------------------------------------------ more inventory rows
@query("cv_summary")
def q_cv_summary(spark, d):
    """Mean and population std of the fold R² of ``cv_scores``."""
    p = split.hash_folds(_part(spark, d), "p_partkey", 5)
    cv = linear.cross_validate(p, PART_X1, PART_Y, "fold")
    return _rk(summary.score_summary(cv, "r2"))


@query("history_table")
def q_history_table(spark, d):
    """P22 + E3: the history table with display labels."""
    h = history.history_summary(runs(spark, d))
    return cleaning.relabel(h, {"id": "ID", "model": "Model", "summary": "Summary", "mode": "Mode"})


@query("trend_buckets")
def q_trend_buckets(spark, d):
    """A21 at scale: mean per (hour, metric) instead of every point."""
    e = ev(spark, d)
    t = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm")
    return _r6(distribution.bucket_trend(e, t, ["value", "k"]))


BATCHES = ["click", "error", "purchase", "signup", "view"]


@query("batch_union")
def q_batch_union(spark, d):
    """Per-batch results concatenated (every batch scored separately)."""
    e = ev(spark, d)
    out = None
    for b in BATCHES:
        s = summary.batch_stats(e.filter(F.col("event_type") == b), "value").withColumn("batch", F.lit(b))
        out = s if out is None else out.unionByName(s)
    return _r6(out)


def _np_model(pdf):
    import numpy as np
    return 2.0 * pdf["value"].to_numpy() + np.log1p(pdf["k"].to_numpy())


@query("python_model_score")
def q_python_model_score(spark, d):
    """A Python model scored in Arrow batches (mapInPandas)."""
    from vatlens.plans import commands
    e = ev(spark, d).select("event_id", "value", "k")
    out = commands.score_with_python_model(e, ["value", "k"], _np_model, batch_size=5000)
    return _rk(out.select("event_id", "prediction"))


@query("benchmark_metrics")
def q_benchmark_metrics(spark, d):
    """Fit on the training split, benchmark on labelled test rows (non-numeric target dropped)."""
    tr, te = _part_split(spark, d)
    m = linear.fit_linear(tr, PART_X1, PART_Y)
    te = te.withColumn(PART_Y, F.when(F.col("p_size") == 1, F.lit("n/a"))
                       .otherwise(F.col(PART_Y).cast("string")))
    te = cleaning.valid_target(te, PART_Y)
    return _rk(summary.regression_metrics(m.transform(te), PART_Y, "prediction"))


@query("train_metrics")
def q_train_metrics(spark, d):
    """R² / MAE / RMSE on the training rows."""
    tr, _ = _part_split(spark, d)
    m = linear.fit_linear(tr, PART_X1, PART_Y)
    return _rk(summary.regression_metrics(m.transform(tr), PART_Y, "prediction"))


@query("shape_dtypes")
def q_shape_dtypes(spark, d):
    """Column names and types with the table's row count."""
    e = table(spark, d, "events")
    n = e.count()
    return cleaning.dtypes_frame(spark, e).withColumn("n_rows", F.lit(n).cast("long"))


@query("feature_schema_rows")
def q_feature_schema_rows(spark, d):
    """The feature schema of the preprocessed events, one row per feature."""
    from vatlens.sources import feature_schema
    x = preprocess(ev(spark, d), ev_spec(), strict=True)
    feats = ["k", "value_diff", "k_diff", "ratio", "value_z", "high_flag", "low_flag"]
    rec = feature_schema.feature_schema_record(spark, x, "value", feats)
    return rec.select("target", F.posexplode("features").alias("position", "feature"),
                      "dtypes", "trained_rows", "trained_cols") \
              .select("target", "position", "feature", F.col("dtypes")[F.col("feature")].alias("dtype"),
                      "trained_rows", "trained_cols")


@query("violin_quartiles")
def q_violin_quartiles(spark, d):
    """Quartiles and whiskers per (category x hue) - the box inside each violin."""
    li = table(spark, d, "lineitem")
    return _r6(distribution.box_summary(li, "l_extendedprice", by=["l_returnflag", "l_linestatus"]))


@query("missing_profile")
def q_missing_profile(spark, d):
    """P17 at scale: NULL fraction per column in 10 equal slices of the row order."""
    from vatlens.plans.eda import missing_by_bucket
    return _r6(missing_by_bucket(ev_nulls(spark, d), ["value", "k"], ORDER, buckets=10))


@query("preview_rows")
def q_preview_rows(spark, d):
    """The first 20 input rows by id (an ordered top-k preview)."""
    return _r6(cleaning.head(ev(spark, d).drop("ts"), 20, ["event_id"]))


# ------------------------------------------------------------------ the commands themselves
CMD_FEATURES = ["k", "value_diff", "ratio", "value_z"]


def _cmd_model(spark, d):
    """A fitted model with fixed weights; its z-score statistics come from the complete click rows."""
    train = cleaning.drop_incomplete(ev_nulls(spark, d)).filter(F.col("event_type") == "click")
    return linear.LinearModel(CMD_FEATURES, "value", [50.0, 0.0, 1.0, 0.0], [50.0, 0.0, 1.0, 0.0],
                              [10.0, 20.0, 2.0, 1.0], [1.5, -0.5, 0.25, 2.0], 3.0,
                              zstats=summary.zscore_stats(train, ["value"]))


def _raw_batch(spark, d):
    """A batch as it arrives: k is text, with cells that are no number and NaN among the values."""
    e = ev_nulls(spark, d)
    return e.withColumns({
        "k": F.when(F.col("event_id") % 13 == 0, F.lit("n/a")).otherwise(F.col("k").cast("string")),
        "value": F.when(F.col("event_id") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("value"))})


def _predicted(spark, d, **how):
    from vatlens.plans import commands
    return commands.predict(spark, _raw_batch(spark, d), _cmd_model(spark, d), ev_spec(), **how)


@query("predict_model_stats")
def q_predict_model_stats(spark, d):
    """L11 through the command, z-scores with the training statistics."""
    return _r6(_predicted(spark, d, stats="model").select("event_id", "prediction"))


@query("predict_batch_stats")
def q_predict_batch_stats(spark, d):
    """L11 through the command, z-scores with the batch's own statistics."""
    return _r6(_predicted(spark, d, stats="batch").select("event_id", "prediction"))


@query("predict_keep_all")
def q_predict_keep_all(spark, d):
    """J1 / L11 through the command: every raw row, NULL score where a cell is missing."""
    return _r6(_predicted(spark, d, output="input").select("event_id", "value_diff", "prediction"))


@query("benchmark_cmd")
def q_benchmark_cmd(spark, d):
    """L13 through the command."""
    from vatlens.plans import commands
    return _rk(commands.benchmark(_raw_batch(spark, d), _cmd_model(spark, d), ev_spec(), stats="model"))


@query("train_cmd")
def q_train_cmd(spark, d):
    """L19 through the command: what the saved model and schema say, read back."""
    import uuid

    from vatlens.plans import commands
    from vatlens.session import checkpoint_dir
    from vatlens.sources import feature_schema
    out = f"{checkpoint_dir(spark)}/train-{uuid.uuid4().hex}"
    commands.train(spark, ev_nulls(spark, d), ev_spec(), "value", out)
    m = feature_schema.load_linear_model(spark, f"{out}/model")
    schema = feature_schema.load_feature_schema(spark, f"{out}/schema")
    rows = [(f, i, md, m.n, schema["features"][i] == f) for i, (f, md) in enumerate(zip(m.features, m.medians))]
    return _r6(spark.createDataFrame(rows, "feature string, position int, median double, n long, in_schema boolean"))


@query("nan_metrics")
def q_nan_metrics(spark, d):
    """A10 with NaN among the values: NaN is missing."""
    e = ev(spark, d).withColumn("value", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return _r6(summary.regression_metrics(e, "value", "k"))


@query("nan_corr")
def q_nan_corr(spark, d):
    """A8 with NaN: pairwise-complete rows."""
    e = ev(spark, d).withColumn("value", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    return _r6(summary.corr_matrix(e, ["value", "k"]))


@query("nan_hist_by_class")
def q_nan_hist_by_class(spark, d):
    """A14 with NaN values and rows without a class."""
    e = ev(spark, d).withColumns({
        "value": F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")),
        "event_type": F.when(F.col("event_type") != "error", F.col("event_type"))})
    return _r6(distribution.histogram(e, "value", 20, by=["event_type"]))


@query("fill_median_int")
def q_fill_median_int(spark, d):
    """P12 on an integer column: the filled column is double."""
    o = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(
        F.col("l_orderkey") % 3 != 0, F.col("l_linenumber")).cast("int").alias("x"))
    return _r6(cleaning.fill_median(o, ["x"]))


@query("pending_rows")
def q_pending_rows(spark, d):
    """P20: rows whose flag is false or missing."""
    o = table(spark, d, "orders").select("o_orderkey", F.when(
        F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("approved"))
    return cleaning.pending(o).select("o_orderkey")


@query("strip_and_drop")
def q_strip_and_drop(spark, d):
    """Names without blanks, a column dropped, one that is not there ignored."""
    n = table(spark, d, "nation")
    n = n.toDF(*[f"  {c} " for c in n.columns])
    return cleaning.drop_columns(cleaning.strip_column_names(n), ["n_comment", "nothing"]).select("n_nationkey", "n_name")


@query("csv_round_trip")
def q_csv_round_trip(spark, d):
    """A table written as CSV and read back with inferred types."""
    import uuid

    from vatlens.session import checkpoint_dir
    from vatlens.sources import files
    path = f"{checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    history.write_csv(c, path)
    return _r6(files.read_csv(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("long")))


@query("box_outliers_squared")
def q_box_outliers_squared(spark, d):
    """A16 on a skewed measure, where rows do lie beyond the whiskers."""
    o = table(spark, d, "orders").select("o_orderpriority", "o_orderkey",
                                         (F.col("o_totalprice") * F.col("o_totalprice")).alias("sq"))
    return _r6(distribution.box_outliers(o, "sq", by=["o_orderpriority"], keep=["o_orderkey"]).select("o_orderpriority", "o_orderkey", "side"))


@query("history_next_page")
def q_history_next_page(spark, d):
    """T1 by key: the second page, from the last run of the first."""
    r = runs(spark, d)
    last = history.history_page(r, HIST_USER, page=1).orderBy("timestamp", "id").first()
    if last is None:
        return history.history_page(r, HIST_USER, page=1).select("id", "username")
    return history.history_after(r, HIST_USER, last["timestamp"], last["id"]).select("id", "username")


@query("alignment_losses")
def q_alignment_losses(spark, d):
    """P4 on the data: cells of each expected column that hold no number, or are not there at all."""
    o = table(spark, d, "orders")
    return cleaning.alignment_losses(o, ALIGN_FEATURES)


EMBEDDED = 64


@query("corr_wide")
def q_corr_wide(spark, d):
    """A8 on a wide table: every pair of the coordinates of the embeddings."""
    e = table(spark, d, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(EMBEDDED)])
    return _r6(summary.corr_matrix(e))


@query("trend_pixels")
def q_trend_pixels(spark, d):
    """First, last, lowest and highest point of every pixel column and metric."""
    x = distribution.pixel_trend(ev(spark, d), "ts", ["value", "k"], "event_id", pixels=200)
    return _r6(x.withColumn("time", scalar.timestamp_text("time")))


@query("pair_sample")
def q_pair_sample(spark, d):
    """The points of a sample of each class, exact in size."""
    points, _ = distribution.pair_plot(ev(spark, d), ["value", "k"], ["event_type"], "event_id", k=500)
    return _r6(points)


@query("pair_diagonal")
def q_pair_diagonal(spark, d):
    """The diagonal, a density per column and class of the same sample."""
    _, diagonal = distribution.pair_plot(ev(spark, d), ["value", "k"], ["event_type"], "event_id", k=500, grid=50)
    return _r6(diagonal)


@query("violin_density")
def q_violin_density(spark, d):
    """The body of each violin, a density per (category x hue) drawn two bandwidths beyond the data."""
    li = table(spark, d, "lineitem")
    return _r6(distribution.kde(li, "l_extendedprice", by=["l_returnflag", "l_linestatus"], grid=100, cut=2.0))


@query("run_records")
def q_run_records(spark, d):
    """A scored batch and a benchmark recorded in the run table, read back by column."""
    import uuid

    from vatlens.session import checkpoint_dir
    from vatlens.sources import files
    path = f"{checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
    tr, te = _part_split(spark, d)
    m = linear.fit_linear(tr, PART_X1, PART_Y)
    scored = m.transform(te).withColumn("user", F.concat(F.lit("user_"), (F.col("p_size") % 3).cast("string")))
    at = "2024-05-01 12:30:45"
    history.append_runs(history.prediction_runs(scored, "prediction", "te.csv", "models/ols", "batch 1", "user", at), path)
    metrics = summary.regression_metrics(scored, PART_Y, "prediction")
    history.append_runs(history.benchmark_run(metrics, "user_b", "te.csv", "models/ols", 7, at), path)
    back = files.read_table(spark, path, ["username", "timestamp", "inputs", "results", "model_name"])
    number = lambda f: scalar.json_field("results", f).cast("double").alias(f.lower())
    return _rk(back.select("username", scalar.timestamp_text("timestamp").alias("at"), scalar.json_field("inputs", "mode").alias("mode"),
                           scalar.json_field("inputs", "rows").cast("long").alias("rows"), scalar.json_field("inputs", "file").alias("file"),
                           "model_name", number("mean_pred"), scalar.json_field("results", "count").cast("long").alias("scores"),
                           number("R2"), number("MAE"), number("RMSE")))
