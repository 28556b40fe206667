"""Run history.

A run log is an append-only table ``runs(id, username, timestamp, inputs,
results, model_name)`` where ``inputs``/``results`` are JSON text:
inputs ``{"file", "rows", "mode"}``, results ``{"mean_pred", "count"}``
(prediction runs) or ``{"R2", "MAE", "RMSE"}`` (benchmark runs).
Pages order by ``timestamp DESC, id DESC`` (id breaks ties at one-second
resolution).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vatlens.functions.scalar import basename, format_fixed

RUNS_SCHEMA = ("id long, username string, timestamp timestamp, inputs string, "
               "results string, model_name string")
PAGE_SIZE = 10           # fixed value: rows per history page
EXPORT_LIMIT = 1000      # fixed value: rows in a history export page of the dashboard


def _now(at) -> Column:
    return F.lit(at).cast("timestamp") if at is not None else F.date_trunc("second", F.current_timestamp())


def _record(df: DataFrame, username: Column, file: Column, rows: Column, mode: str, results: Column, model_name: str,
            run_id: Column, at) -> DataFrame:
    inputs = F.to_json(F.struct(file.alias("file"), rows.alias("rows"), F.lit(mode).alias("mode")))
    return df.select(run_id.cast("long").alias("id"), username.alias("username"), _now(at).alias("timestamp"),
                     inputs.alias("inputs"), F.to_json(results).alias("results"), F.lit(model_name).alias("model_name"))


def new_run_id(*salt) -> Column:
    """A positive id for a run record that no counter has to hand out: a hash of what tells the run apart."""
    return F.shiftrightunsigned(F.xxhash64(*[F.lit(str(s)) if not isinstance(s, Column) else s for s in salt]), 1)


def prediction_runs(scored: DataFrame, score: str, file: str, model_name: str, run_id, user: str, at=None) -> DataFrame:
    """One run record per user of a scored batch (mean and count of the scores). ``run_id`` is salt, text."""
    g = scored.groupBy(user).agg(F.avg(score).alias("_m"), F.count(F.col(score)).alias("_c"), F.count(F.lit(1)).alias("_n"))
    return _record(g, F.col(user).cast("string"), F.lit(file), F.col("_n"), "Predict",
                   F.struct(F.col("_m").alias("mean_pred"), F.col("_c").alias("count")), model_name,
                   new_run_id(run_id, F.coalesce(F.col(user).cast("string"), F.lit(""))), at)


def prediction_run(scored: DataFrame, score: str, username: str, file: str,
                   model_name: str, run_id: int, at=None) -> DataFrame:
    """One run record of a prediction batch (mean and count of the scores)."""
    g = scored.agg(F.avg(score).alias("_m"), F.count(F.col(score)).alias("_c"), F.count(F.lit(1)).alias("_n"))
    return _record(g, F.lit(username), F.lit(file), F.col("_n"), "Predict",
                   F.struct(F.col("_m").alias("mean_pred"), F.col("_c").alias("count")), model_name, F.lit(run_id), at)


def benchmark_run(metrics: DataFrame, username: str, file: str, model_name: str, run_id: int, at=None) -> DataFrame:
    """One run record of a benchmark (R2, MAE, RMSE and the rows from ``regression_metrics``)."""
    return _record(metrics, F.lit(username), F.lit(file), F.col("n"), "Benchmark",
                   F.struct(F.col("r2").alias("R2"), F.col("mae").alias("MAE"), F.col("rmse").alias("RMSE")),
                   model_name, F.lit(run_id), at)


def append_runs(records: DataFrame, path: str) -> None:
    """Append run records to the history table (Parquet)."""
    records.write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUNS_SCHEMA).parquet(path)


def user_runs(runs: DataFrame, username: str) -> DataFrame:
    """The runs of one user."""
    return runs.filter(F.col("username") == F.lit(username))


def history_page(runs: DataFrame, username: str, page: int = 1,
                 page_size: int = PAGE_SIZE) -> DataFrame:
    """One page of a user's runs, newest first."""
    return (user_runs(runs, username)
            .orderBy(F.desc("timestamp"), F.desc("id"))
            .offset((page - 1) * page_size).limit(page_size))


def history_after(runs: DataFrame, username: str, timestamp, run_id: int,
                  page_size: int = PAGE_SIZE) -> DataFrame:
    """T1 by key: the page after the run ``(timestamp, run_id)``, the last one of the page
    before. Reads one page at any depth, where an offset gathers all pages before."""
    last = F.lit(timestamp).cast(runs.schema["timestamp"].dataType)
    older = (F.col("timestamp") < last) | ((F.col("timestamp") == last) & (F.col("id") < F.lit(run_id)))
    return user_runs(runs, username).filter(older).orderBy(F.desc("timestamp"), F.desc("id")).limit(page_size)


def page_counts(runs: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """A4 + T2: runs per user and the page count ``max(1, ceil(n / size))``."""
    g = runs.groupBy("username").agg(F.count(F.lit(1)).cast("long").alias("n_runs"))
    return g.withColumn("n_pages",
                        F.greatest(F.lit(1), F.ceil(F.col("n_runs") / F.lit(page_size))).cast("long"))


def history_summary(runs: DataFrame) -> DataFrame:
    """E3 + F2 + F7: one display row per run.

    Fixed values (display formats): benchmark runs read
    ``R²: <R2 .3f> | RMSE: <RMSE .3f>``, prediction runs
    ``Mean: <mean_pred .2f> | Rows: <count>``; a run without a mode reads
    ``N/A``.
    """
    # one parse of each document
    parsed = runs.select("id", "timestamp", "model_name",
                         F.from_json("results", "R2 string, RMSE string, mean_pred string, count string").alias("_r"),
                         F.from_json("inputs", "mode string").alias("_in"))
    r2, rmse, mean, cnt = (F.col(f"_r.{c}") for c in ("R2", "RMSE", "mean_pred", "count"))
    number = lambda c: c.try_cast("double")
    summary = (F.when(r2.isNotNull(),
                      F.concat(F.lit("R²: "), format_fixed(number(r2), 3),
                               F.lit(" | RMSE: "), format_fixed(number(rmse), 3)))
               .when(mean.isNotNull(),
                     F.concat(F.lit("Mean: "), format_fixed(number(mean), 2), F.lit(" | Rows: "), cnt))
               .otherwise(F.lit("")))
    return parsed.select(
        "id", "timestamp", basename("model_name").alias("model"), summary.alias("summary"),
        F.coalesce(F.col("_in.mode"), F.lit("N/A")).alias("mode"))


def run_profile(runs: DataFrame) -> DataFrame:
    """The full run as one JSON document (inputs/results decoded)."""
    return runs.select("id", F.to_json(F.struct(
        F.col("id"), F.col("username"), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.from_json("inputs", "map<string,string>").alias("inputs"),
        F.from_json("results", "map<string,string>").alias("results"),
        F.col("model_name"))).alias("profile"))


def lookup_run(runs: DataFrame, run_id: int, username: str) -> DataFrame:
    """A run by id, only within the user's own runs."""
    return runs.filter((F.col("id") == F.lit(run_id)) & (F.col("username") == F.lit(username)))


def export_history(runs: DataFrame, username: str, limit: int | None = None) -> DataFrame:
    """A user's history newest first, all of it unless ``limit`` is given."""
    out = user_runs(runs, username).orderBy(F.desc("timestamp"), F.desc("id"))
    return out.limit(limit) if limit is not None else out


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV output."""
    df.write.mode("overwrite").option("header", True).csv(path)
