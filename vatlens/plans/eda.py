"""Exploration report: the data behind every chart of an EDA pass (A1-A24 composed).

Given a table and the roles of its columns it returns named DataFrames
(and optionally writes each as Parquet): missing counts and their profile
along the rows, grouped means with bootstrap intervals, histograms with
density curves (plain and stacked by a hue), violin data (density +
quartiles per category x hue), box summaries, counts by two categories,
correlations. Fills (median / mode) are applied first when asked, as the
reference's exploration script does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vatlens.operators import bootstrap, cleaning, distribution, ordered, summary


def missing_by_bucket(df: DataFrame, cols: Sequence[str], order_by: Sequence[str],
                      buckets: int = 50) -> DataFrame:
    """P17 at scale: NULL fraction per column in ``buckets`` equal slices of the row order.

    The heat-map of a 100 TB table cannot show rows; it shows this profile.
    """
    x = ordered.with_row_index(df.select(*order_by, *cols), order_by, name="_i", size_name="_n")
    b = (F.col("_i") * F.lit(buckets) / F.col("_n")).cast("long").alias("row_bucket")
    fl = {c for c, t in df.dtypes if t in ("double", "float")}
    return (x.select(b, *[(F.col(c).isNull() | (F.isnan(F.col(c)) if c in fl else F.lit(False)))
                          .cast("double").alias(c) for c in cols])
            .groupBy("row_bucket")
            .agg(F.count(F.lit(1)).cast("long").alias("n"), *[F.avg(c).alias(c) for c in cols]))


def eda_report(df: DataFrame, numeric: str, category: str, hue: str | None = None,
               value: str | None = None, group2: str | None = None,
               fill_median: Sequence[str] = (), fill_mode: Sequence[str] = (),
               order_by: Sequence[str] | None = None, key: str | None = None,
               bins: int = 30, out: str | None = None) -> dict[str, DataFrame]:
    """Named chart tables; ``out`` writes each to ``out/<name>`` as Parquet.

    The bootstrap interval needs to tell rows apart: by ``key``, or else by their
    position in ``order_by``. Without either the report has no ``bar_ci``.
    """
    report: dict[str, DataFrame] = {"missing_counts": cleaning.missing_counts(df)}
    if order_by:
        report["missing_profile"] = missing_by_bucket(df, df.columns, order_by)
    if fill_median:
        df = cleaning.fill_median(df, list(fill_median))
    if fill_mode:
        df = cleaning.fill_mode(df, list(fill_mode))
    target = value or numeric
    report["group_mean"] = summary.group_mean(df, category, [target])
    if key or order_by:
        rows = df if key else ordered.with_row_index(df.select(category, target, *order_by), order_by, name="_vl_row")
        report["bar_ci"] = bootstrap.bootstrap_mean_ci(rows, target, by=[category], key=key or "_vl_row")
    report["histogram"] = distribution.histogram(df, numeric, bins=bins)
    report["density"] = distribution.kde(df, numeric)
    if hue:
        report["histogram_by_hue"] = distribution.histogram(df, numeric, bins=bins, by=[hue])
        report["density_by_hue"] = distribution.kde(df, numeric, by=[hue])
        report["violin_density"] = distribution.kde(df, numeric, by=[category, hue], cut=2.0)
        report["violin_quartiles"] = distribution.box_summary(df, numeric, by=[category, hue])
        report["count_by_two"] = summary.count_by(df, [group2 or category, hue])
    report["box"] = distribution.box_summary(df, numeric, by=[group2 or category])
    report["describe"] = summary.describe(df)
    report["correlation"] = summary.corr_matrix(df)
    if out:
        for name, t in report.items():
            t.write.mode("overwrite").parquet(f"{out}/{name}")
    return report
