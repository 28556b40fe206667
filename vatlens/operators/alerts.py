"""Threshold alert rules on scored batches.

Rules: one row per user ``(username, email_enabled, target_email,
titer_threshold, condition)``. A user without a rule gets the defaults
(disabled, 5.0, 'above'). Batch statistics and violator counts come from one
aggregate per batch after the rule is attached to each row; the rule table
is joined on the user key (AQE broadcasts it when small, and splits a hot
user's partition otherwise).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vatlens.functions.scalar import basename, format_fixed, thousands
from vatlens.operators.summary import beyond

# The defaults of an absent rule.
DEFAULT_ENABLED = False
DEFAULT_THRESHOLD = 5.0
DEFAULT_CONDITION = "above"


def _names(x) -> list[str]:
    if x is None:
        return []
    if isinstance(x, str):
        return [x]
    return list(x)


def with_rule(df: DataFrame, rules: DataFrame, user: str = "username") -> DataFrame:
    """Attach each user's rule, defaults where the user has none."""
    r = rules.select(F.col("username").alias("_vl_u"), F.col("email_enabled").alias("_vl_en"),
                     F.col("titer_threshold").alias("_vl_thr"), F.col("condition").alias("_vl_cond"))
    j = df.join(r, df[user] == r["_vl_u"], "left")
    return j.withColumns({
        "email_enabled": F.coalesce(F.col("_vl_en"), F.lit(DEFAULT_ENABLED)),
        "threshold": F.coalesce(F.col("_vl_thr").cast("double"), F.lit(DEFAULT_THRESHOLD)),
        "condition": F.coalesce(F.col("_vl_cond"), F.lit(DEFAULT_CONDITION)),
    }).drop("_vl_u", "_vl_en", "_vl_thr", "_vl_cond")


def batch_alerts(scored: DataFrame, rules: DataFrame, score: str, batch: Sequence[str],
                 user: str = "username", model: str | None = None) -> DataFrame:
    """A5 + A6 + E1 per batch: stats, violators and whether the rule triggers.

    Trigger: rule enabled and mean strictly beyond the threshold on the
    rule's side; an empty batch has a NULL mean and never triggers.
    """
    keys = _names(batch)
    if user not in keys:
        keys = [*keys, user]
    j = with_rule(scored, rules, user)
    hit = F.coalesce(beyond(F.col(score), F.col("threshold"), F.col("condition")), F.lit(False))
    aggs = [F.count(F.col(score)).cast("long").alias("n"), F.avg(score).alias("mean"),
            F.min(score).alias("min"), F.max(score).alias("max"),
            F.sum(hit.cast("long")).cast("long").alias("n_violators")]
    if model:
        aggs.append(F.max(basename(model)).alias("model"))
    g = j.groupBy(*keys, "email_enabled", "threshold", "condition").agg(*aggs)
    g = g.withColumn("pct_violators", F.try_divide(F.col("n_violators") * F.lit(100.0), F.col("n")))
    trig = F.col("email_enabled") & F.coalesce(
        beyond(F.col("mean"), F.col("threshold"), F.col("condition")), F.lit(False))
    return g.withColumn("triggered", trig)


def alert_records(alerts: DataFrame, user: str = "username", source: str | None = None,
                  at=None) -> DataFrame:
    """One record per triggered batch, with a readable one-line message.

    ``source`` and ``at`` (the data source and the run's time) are added as columns
    ``data_source`` and ``run_time`` when given.

    Numbers use fixed decimals (mean/min/max .2f, percent .1f) and thousands
    separators for counts, as in the reference's alert text.
    """
    t = alerts.filter(F.col("triggered"))
    msg = F.concat(
        F.lit("Mean "), F.upper(F.col("condition")), F.lit(" "), format_fixed("threshold", 2),
        F.lit(": actual "), format_fixed("mean", 2), F.lit("; "), thousands("n_violators"),
        F.lit(" of "), thousands("n"), F.lit(" rows ("), format_fixed("pct_violators", 1),
        F.lit("%) beyond; min "), format_fixed("min", 2), F.lit(", max "), format_fixed("max", 2))
    t = t.withColumn("message", msg)
    if source is not None:
        t = t.withColumn("data_source", F.lit(source))
    return t if at is None else t.withColumn("run_time", F.lit(at).cast("timestamp"))


def append_alerts(records: DataFrame, path: str) -> None:
    """Add alert records to the alert table at ``path``."""
    records.write.mode("append").parquet(path)
