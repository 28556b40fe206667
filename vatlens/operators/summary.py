"""Aggregations and statistics.

Every statistic over a whole table is one ``agg`` (map-side combined, one
small row out). Statistics that feed a row-wise transform (z-score, median
fill) are collected as literals, a bounded one-row result, so the transform
stays a codegen'd projection. Per-group statistics are joined back on the
group key; AQE broadcasts that side when it is small.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _names(x) -> list[str]:
    if x is None:
        return []
    if isinstance(x, str):
        return [x]
    return list(x)


# ---------------------------------------------------------------- A1, A3, A4, A18
def kpi_means(df: DataFrame, cols: Sequence[str], prefix: str = "mean_") -> DataFrame:
    """A1: one-row means of the requested columns that exist in ``df``."""
    present = [c for c in _names(cols) if c in df.columns]
    return df.agg(*[F.avg(F.col(c)).alias(prefix + c) for c in present])


def group_mean(df: DataFrame, key: str | Sequence[str], cols: Sequence[str],
               prefix: str = "mean_") -> DataFrame:
    """A3: mean per group; NULL keys are dropped (pandas groupby), sorted by key."""
    keys = _names(key)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return (df.filter(cond).groupBy(*keys)
            .agg(*[F.avg(F.col(c)).alias(prefix + c) for c in _names(cols)])
            .orderBy(*keys))


def count_by(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Row count per key combination."""
    return df.groupBy(*_names(keys)).agg(F.count(F.lit(1)).cast("long").alias(name))


# ---------------------------------------------------------------- A2
def describe(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False,
             accuracy: int = 100000) -> DataFrame:
    """A2: pandas ``describe()`` in long form, one row per column.

    ``count, mean, std`` (sample), ``min, p25, p50, p75, max``; quartiles use
    linear interpolation, computed exactly by the distributed quantile
    operator (``quantiles``: no task holds a whole column). ``approx=True``
    swaps in one-pass ``percentile_approx`` sketches.
    """
    from vatlens.operators.cleaning import numeric_columns

    cols = _names(cols) or numeric_columns(df)
    probs = [0.25, 0.5, 0.75]

    parts = []
    for c in cols:
        x = F.col(c).cast("double")
        fields = [F.count(x).cast("double").alias("count"), F.avg(x).alias("mean"),
                  F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")]
        if approx:
            fields.append(F.percentile_approx(x, probs, accuracy).cast("array<double>").alias("_q"))
        parts.append(F.struct(*fields).alias(c))
    wide = df.agg(*parts)
    long = wide.unpivot([], cols, "column_name", "s")
    out = long.select(
        "column_name",
        F.col("s.count").cast("long").alias("count"), F.col("s.mean").alias("mean"),
        F.col("s.std").alias("std"), F.col("s.min").alias("min"), F.col("s.max").alias("max"),
        *([F.col("s._q")[i].alias(n) for i, n in enumerate(["p25", "p50", "p75"])] if approx else []))
    if not approx:
        from vatlens.operators.quantiles import exact_quantiles
        q = exact_quantiles(df, cols, probs).groupBy("column_name").agg(
            *[F.max(F.when(F.col("prob") == F.lit(p), F.col("value"))).alias(n)
              for p, n in zip(probs, ["p25", "p50", "p75"])])
        out = out.join(q, "column_name", "left")   # both sides: one row per column
    return out.select("column_name", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


# ---------------------------------------------------------------- A5, A6, A7
def batch_stats(df: DataFrame, value: str, batch: Sequence[str] | None = None) -> DataFrame:
    """A5: count, mean, min, max of a score per batch (whole table when no batch)."""
    aggs = [F.count(F.col(value)).cast("long").alias("n"), F.avg(value).alias("mean"),
            F.min(value).alias("min"), F.max(value).alias("max")]
    keys = _names(batch)
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def beyond(value: Column, threshold: Column, condition: Column | str) -> Column:
    """Strict side test: ``above`` -> value > thr, ``below`` -> value < thr; any other
    condition is never met."""
    cond = F.lit(condition) if isinstance(condition, str) else condition
    return F.when(cond == "below", value < threshold).when(cond == "above", value > threshold) \
        .otherwise(F.lit(False))


def violators(df: DataFrame, value: str, threshold, condition="above",
              batch: Sequence[str] | None = None) -> DataFrame:
    """Number and percent of rows beyond the threshold, per batch.

    ``threshold``/``condition`` are literals or column names (per-row rule).
    """
    thr = F.col(threshold) if isinstance(threshold, str) else F.lit(threshold)
    cnd = F.col(condition) if condition in df.columns else F.lit(condition)
    hit = F.coalesce(beyond(F.col(value), thr, cnd), F.lit(False))
    aggs = [F.count(F.col(value)).cast("long").alias("n"),
            F.sum(hit.cast("long")).cast("long").alias("n_violators")]
    keys = _names(batch)
    g = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    return g.withColumn("pct_violators",
                        F.try_divide(F.col("n_violators") * F.lit(100.0), F.col("n")))


def quantile_cutoff(df: DataFrame, col: str, q: float = 0.8, truncate: bool = True) -> DataFrame:
    """Exact linear quantile; ``truncate`` casts toward zero like ``int()``."""
    from vatlens.operators.quantiles import exact_quantiles
    v = F.col("value")
    return exact_quantiles(df, [col], [q]).select((v.cast("long") if truncate else v).alias("cutoff"))


# ---------------------------------------------------------------- A8
#: Columns up to which one aggregate holds an expression per pair.
WIDE = 40
#: Columns of a block, and bytes of the block pairs' sums that a task holds in one pass.
BLOCK, PASS_BYTES = 256, 256_000_000
#: Arrays of one block pair that meet in one task; with more partitions they are added in two steps.
FAN_IN = 128
#: A share of its square sum below which a variance is rounding.
ROUNDING = 1e-13
def corr_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation for every ordered column pair, pairwise-complete.

    Tables of more than ``WIDE`` columns go through ``corr_blocks``, with the same result.
    One pass over the data: ``covar_pop`` and the two ``stddev_pop`` over the
    rows where both values are present. A constant column gives NULL instead
    of a division error (pandas NaN). Long form ``(col_a, col_b, corr)``.
    """
    from vatlens.operators.cleaning import numeric_columns

    cols = _names(cols) or numeric_columns(df)
    if len(cols) > WIDE:
        return corr_blocks(df, cols)
    aggs = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            x, y = (F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in (a, b))
            both = x.isNotNull() & y.isNotNull()
            xs, ys = F.when(both, x), F.when(both, y)
            if a == b:
                r = F.when(F.stddev_pop(x) > 0, F.lit(1.0))
            else:
                r = F.try_divide(F.covar_pop(xs, ys), F.stddev_pop(xs) * F.stddev_pop(ys))
            aggs.append(r.alias(f"{i}:{cols.index(b)}"))
    row = df.agg(*aggs)
    pairs = row.unpivot([], row.columns, "_vl_pair", "corr")
    names = F.array(*[F.lit(c) for c in cols])
    ij = F.split(F.col("_vl_pair"), ":")
    i, j = ij[0].cast("int"), ij[1].cast("int")
    upper = pairs.select(names[i].alias("col_a"), names[j].alias("col_b"), "corr")
    lower = pairs.filter(i != j).select(names[j].alias("col_a"), names[i].alias("col_b"), "corr")
    return upper.unionByName(lower)


def corr_blocks(df: DataFrame, cols: Sequence[str], block: int | None = None) -> DataFrame:
    """A8 for wide tables: pairwise-complete correlations from products of blocks of columns.

    With values x about the column's mean (0 where missing) and presence masks m, the sums ``x'x``, ``m'm``,
    ``x'm``, ``m'x``, ``(x^2)'m`` and ``m'(x^2)`` of two blocks give every pair's count, means, variances and
    covariance over the rows that hold both. A task adds them up for as many block pairs as ``PASS_BYTES``
    allow, Spark adds those of a block pair, and the task that does so turns them into rows: nothing of the
    size of the matrix reaches the driver or one task.
    """
    cols, size = _names(cols), block or BLOCK
    d = len(cols)
    nan = F.lit(float("nan"))
    x = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), nan) for c in cols]).alias("x")
    rows = df.select(x)
    # about the mean, and columns of one value are told apart exactly
    stats = rows.select(F.posexplode("x").alias("j", "v")).where(~F.isnan("v")).groupBy("j").agg(
        F.avg("v").alias("m"), F.min("v").alias("a"), F.max("v").alias("z")).collect()
    center, constant = np.zeros(d), np.ones(d, bool)
    for r in stats:
        center[r["j"]], constant[r["j"]] = r["m"], r["a"] == r["z"]
    cuts = list(range(0, d, size))
    pairs = [(i, j) for i in cuts for j in cuts if i <= j]
    per_pass = max(1, PASS_BYTES // (48 * size * size))
    names = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(cols)], "i int, c string")
    out = None
    for at in range(0, len(pairs), per_pass):
        one = _block_sums(rows, pairs[at:at + per_pass], size, center, constant)
        out = one if out is None else out.unionByName(one)
    a = names.select(F.col("i"), F.col("c").alias("col_a"))
    b = names.select(F.col("i").alias("j"), F.col("c").alias("col_b"))
    # one row per column name
    return out.join(F.broadcast(a), "i").join(F.broadcast(b), "j").select("col_a", "col_b", "corr")


def _block_sums(rows: DataFrame, pairs: list[tuple[int, int]], size: int, center: np.ndarray, constant: np.ndarray) -> DataFrame:
    """``i, j, corr`` (both orders of a pair) of the columns of some block pairs."""
    d = len(center)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for at in range(0, b.num_rows, max(1, 4_000_000 // d)):
                v = b.column(0).slice(at, max(1, 4_000_000 // d)).flatten().to_numpy().reshape(-1, d)
                m = (~np.isnan(v)).astype(np.float64)
                v = np.where(m > 0, v - center, 0.0)
                for k, (i, j) in enumerate(pairs):
                    xi, mi, xj, mj = (t[:, c:c + size] for c in (i, j) for t in (v, m))
                    got = np.stack([xi.T @ xj, mi.T @ mj, xi.T @ mj, mi.T @ xj, (xi * xi).T @ mj, mi.T @ (xj * xj)])
                    held[k] = held[k] + got if k in held else got
        for k, got in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([got.ravel()], pa.list_(pa.float64()))], names=["k", "v"])

    def add(part: pa.Table) -> pa.Table:
        total = np.sum([t.values.to_numpy() for t in part.column("v")], axis=0)
        return pa.table([part.column("k")[:1], pa.array([total], pa.list_(pa.float64()))], names=["k", "v"])

    def correlations(part: pa.Table) -> pa.Table:
        i, j = pairs[part.column("k")[0].as_py()]
        wi, wj = min(size, d - i), min(size, d - j)
        p, n, si, sj, qi, qj = add(part).column("v")[0].values.to_numpy().reshape(6, wi, wj)
        with np.errstate(divide="ignore", invalid="ignore"):
            vi, vj = qi / n - (si / n) ** 2, qj / n - (sj / n) ** 2
            r = (p / n - si / n * (sj / n)) / np.sqrt(vi * vj)
            still = constant[i:i + wi, None] | constant[None, j:j + wj] | (vi <= ROUNDING * qi / n) | (vj <= ROUNDING * qj / n)
        a, b = np.meshgrid(np.arange(i, i + wi), np.arange(j, j + wj), indexing="ij")
        r = np.where(a == b, 1.0, r)
        bad = still | ~np.isfinite(r)
        on = a <= b
        a, b, r, bad = a[on], b[on], r[on], bad[on]
        twice = a != b
        both = [np.concatenate(t) for t in ((a, b[twice]), (b, a[twice]), (r, r[twice]), (bad, bad[twice]))]
        return pa.table([pa.array(both[0], pa.int32()), pa.array(both[1], pa.int32()), pa.array(both[2], mask=both[3])],
                        names=["i", "j", "corr"])

    parts = rows.mapInArrow(sums, "k bigint, v array<double>")
    if rows.rdd.getNumPartitions() > FAN_IN:
        parts = parts.withColumn("p", F.spark_partition_id() % FAN_IN).groupBy("k", "p") \
            .applyInArrow(lambda t: add(t.select(["k", "v"])), "k bigint, v array<double>")
    return parts.groupBy("k").applyInArrow(correlations, "i int, j int, corr double")


# ---------------------------------------------------------------- A9
def zscore(df: DataFrame, cols: Sequence[str] | dict, partition_by: Sequence[str] | None = None,
           ddof: int = 0) -> DataFrame:
    """``(x - mean) / std`` with population std (``ddof=0``) by default.

    Statistics come from the frame itself (per run when ``partition_by``);
    a zero or undefined std gives 0, as ``StandardScaler`` does.
    """
    mapping = dict(cols) if isinstance(cols, dict) else {c: f"{c}_z" for c in _names(cols)}
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    keys = _names(partition_by)
    aggs = []
    for c in mapping:
        aggs += [F.avg(F.col(c)).alias(f"_vl_m_{c}"), std(F.col(c)).alias(f"_vl_s_{c}")]

    def z(c, m, s):
        return F.when(F.col(c).isNull(), F.lit(None).cast("double")).when(
            s.isNull() | (s == 0), F.lit(0.0)).otherwise((F.col(c) - m) / s)

    if not keys:
        row = df.agg(*aggs).first()
        return df.withColumns({
            out: z(c, F.lit(row[f"_vl_m_{c}"]).cast("double"), F.lit(row[f"_vl_s_{c}"]).cast("double"))
            for c, out in mapping.items()})
    stats = df.groupBy(*keys).agg(*aggs)
    stats = stats.select(*[F.col(k).alias("_vr_" + k) for k in keys],
                         *[c for c in stats.columns if c not in keys])
    cond = None
    for k in keys:
        t = df[k].eqNullSafe(stats["_vr_" + k])
        cond = t if cond is None else cond & t
    j = df.join(stats, cond, "left")
    j = j.withColumns({out: z(c, F.col(f"_vl_m_{c}"), F.col(f"_vl_s_{c}"))
                       for c, out in mapping.items()})
    return j.drop(*[c for c in stats.columns])


def zscore_stats(df: DataFrame, cols: Sequence[str]) -> dict[str, dict[str, float]]:
    """Mean and population std of each column, as a model keeps them for scoring."""
    cols = _names(cols)
    if not cols:
        return {}
    row = df.agg(*[F.avg(c).alias(f"{c}|mean") for c in cols],
                 *[F.stddev_pop(c).alias(f"{c}|std") for c in cols]).first().asDict()
    return {c: {"mean": row[f"{c}|mean"], "std": row[f"{c}|std"]} for c in cols}


def column_stats(df: DataFrame, cols: Sequence[str]) -> dict[str, dict[str, float]]:
    """Median, mean and population std per column in one aggregate (L1 prep).

    Returns a small dict (bounded by the number of columns) used as literals.
    """
    from vatlens.operators.quantiles import quantile_row
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}|mean"), F.stddev_pop(x).alias(f"{c}|std"),
                 F.count(x).alias(f"{c}|n")]
    row = df.agg(*aggs).first().asDict()
    med = quantile_row(df, cols, [0.5])
    return {c: {"median": med.get((c, 0.5)), **{k: row[f"{c}|{k}"] for k in ("mean", "std", "n")}}
            for c in cols}


# ---------------------------------------------------------------- A10, A11
def regression_metrics(df: DataFrame, y: str, yhat: str,
                       group_by: Sequence[str] | None = None) -> DataFrame:
    """A10: ``n, r2, mae, rmse`` of a labelled prediction.

    R² = 1 - SSE/SST with SST = n * var_pop(y) (numerically stable moments);
    constant y gives 1 when SSE is 0 else 0; fewer than two rows give NULL.
    Only rows with both values are scored; NaN counts as missing.
    """
    null = F.lit(None).cast("double")
    y, yhat = (F.nanvl(F.col(c).cast("double"), null) for c in (y, yhat))
    both = y.isNotNull() & yhat.isNotNull()
    yy, ee = F.when(both, y), F.when(both, y - yhat)
    aggs = [F.count(ee).cast("long").alias("n"), F.sum(ee * ee).alias("_vl_sse"),
            F.var_pop(yy).alias("_vl_var"), F.avg(F.abs(ee)).alias("mae"),
            F.sqrt(F.avg(ee * ee)).alias("rmse")]
    keys = _names(group_by)
    g = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    sst = F.col("_vl_var") * F.col("n")
    r2 = (F.when(F.col("n") < 2, F.lit(None).cast("double"))
          .when(sst == 0, F.when(F.col("_vl_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(F.lit(1.0) - F.col("_vl_sse") / sst))
    return g.select(*keys, "n", r2.alias("r2"), "mae", "rmse")


def score_summary(df: DataFrame, score: str, group_by: Sequence[str] | None = None) -> DataFrame:
    """Mean and population std of fold scores."""
    aggs = [F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"),
            F.count(F.col(score)).cast("long").alias("n_scores")]
    keys = _names(group_by)
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
