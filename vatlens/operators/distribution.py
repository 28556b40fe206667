"""Data behind the charts (A12-A18, A21-A24): histograms, densities, boxes.

Bin edges and bandwidths are small aggregates (collected as literals). Bin
counting is a ``groupBy`` on a computed bin index (map-side combined, the
shuffle carries at most bins x groups rows per task). Empty bins come from a
``range(bins)`` frame of proven size ``bins``.

The density curve generates one (value, grid point) row per grid point and
sums it in the partial aggregate right behind the generator (small inputs
are first spread over all cores). Values are first reduced to a fixed number
of equal-width bins (mean and count), which bounds the cost at any row count.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vatlens.operators.cleaning import to_number
from vatlens.session import materialize, spread


#: Groups whose statistics are sent to the rows.
SENT = 50_000
#: Slices of a class whose smallest hashes are found apart before they are merged.
SLICES = 512


def _names(x) -> list[str]:
    if x is None:
        return []
    if isinstance(x, str):
        return [x]
    return list(x)


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the columns of a per-group statistics frame to each row.

    Without keys the statistics are one row: collected and added as literals.
    With keys they are joined on the (null-safe) key; they are kept and counted
    first, and broadcast when they are few, so that the rows are not shuffled.
    """
    keys = _names(keys)
    extra = [c for c in stats.columns if c not in keys]
    if not keys:
        row = stats.first()
        return df.withColumns({c: F.lit(row[c] if row is not None else None)
                               .cast(stats.schema[c].dataType) for c in extra})
    st = materialize(stats.select(*[F.col(k).alias("_vr_" + k) for k in keys], *extra))
    if st.count() <= SENT:
        st = F.broadcast(st)
    cond = None
    for k in keys:
        t = df[k].eqNullSafe(st["_vr_" + k])
        cond = t if cond is None else cond & t
    return df.join(st, cond, "inner").drop(*["_vr_" + k for k in keys])


def value_range(df: DataFrame, col: str) -> tuple[float | None, float | None]:
    row = df.agg(F.min(F.col(col).cast("double")).alias("lo"),
                 F.max(F.col(col).cast("double")).alias("hi")).first()
    return row["lo"], row["hi"]


def bin_edge(i: Column, lo: float, hi: float, bins: int) -> Column:
    """Edge ``i`` of ``linspace(lo, hi, bins + 1)``: ``i * step + lo``, the last one ``hi``."""
    step = (hi - lo) / bins
    return F.when(i >= F.lit(bins), F.lit(hi)).otherwise(i * F.lit(step) + F.lit(lo))


def bin_index(value: Column, lo: float, hi: float, bins: int) -> Column:
    """Equal-width bin in ``[lo, hi]``, last bin closed - numpy ``histogram``'s steps.

    ``((v - lo) / (hi - lo)) * bins`` truncated, the top edge folded into the
    last bin, then the one-ulp corrections against the linspace edges.
    """
    if hi == lo:
        lo, hi = lo - 0.5, hi + 0.5
    f = ((value - F.lit(lo)) / F.lit(hi - lo)) * F.lit(float(bins))
    b0 = F.floor(f).cast("int")
    b1 = F.when(b0 == F.lit(bins), F.lit(bins - 1)).otherwise(b0)
    b2 = F.when(value < bin_edge(b1, lo, hi, bins), b1 - 1).otherwise(b1)
    b3 = F.when((value >= bin_edge(b2 + 1, lo, hi, bins)) & (b2 != F.lit(bins - 1)), b2 + 1).otherwise(b2)
    inside = (value >= F.lit(lo)) & (value <= F.lit(hi))
    return F.when(inside, b3)


def histogram(df: DataFrame, col: str, bins: int = 20, lo: float | None = None,
              hi: float | None = None, by: Sequence[str] | None = None) -> DataFrame:
    """Counts per equal-width bin; ``by`` adds group keys sharing the bins.

    Output ``(*by, bin, bin_lo, bin_hi, n)`` with every bin present (0 counts).
    """
    keys = _names(by)
    df = df.withColumn(col, to_number(F.col(col), df.schema[col].dataType))   # NaN is missing
    for k in keys:   # rows without a class are in no class, as in pandas
        df = df.filter(F.col(k).isNotNull())
    if lo is None or hi is None:
        mn, mx = value_range(df, col)
        lo = mn if lo is None else lo
        hi = mx if hi is None else hi
    spark = df.sparkSession
    if lo is None:  # no values at all
        return spark.createDataFrame([], ", ".join([f"`{k}` string" for k in keys] +
                                                   ["bin int", "bin_lo double", "bin_hi double", "n long"]))
    elo, ehi = (lo - 0.5, hi + 0.5) if hi == lo else (lo, hi)
    width = (ehi - elo) / bins
    counts = (df.select(*keys, bin_index(F.col(col).cast("double"), lo, hi, bins).alias("bin"))
              .filter(F.col("bin").isNotNull())
              .groupBy(*keys, "bin").agg(F.count(F.lit(1)).cast("long").alias("n")))
    # every (group, bin) pair: a generator over the distinct groups, no join
    every_bin = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    if keys:
        grid = df.select(*keys).distinct().select(*keys, every_bin)
    else:
        grid = spark.range(1).select(every_bin)
    on = ["bin", *keys]
    out = grid.join(counts, on=on, how="left")
    return out.select(*keys, "bin",
                      bin_edge(F.col("bin"), elo, ehi, bins).alias("bin_lo"),
                      bin_edge(F.col("bin") + 1, elo, ehi, bins).alias("bin_hi"),
                      F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))


def auto_bins(df: DataFrame, col: str) -> int:
    """numpy's ``bins='auto'`` bin count.

    width = min(max(Freedman-Diaconis, sqrt-rule / 2), Sturges); the sqrt
    term caps the count when the IQR is 0. One aggregate job.
    """
    from vatlens.operators.quantiles import quantile_row
    x = F.col(col).cast("double")
    row = df.agg(F.count(x).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    n, lo, hi = row["n"], row["lo"], row["hi"]
    if not n or hi is None or hi == lo:
        return 1
    ptp = hi - lo
    q = quantile_row(df, [col], [0.25, 0.75])
    iqr = q[(col, 0.75)] - q[(col, 0.25)]
    fd = 2.0 * iqr * n ** (-1.0 / 3.0)
    sturges = ptp / (math.log2(n) + 1.0)
    sqrt_bw = ptp / math.sqrt(n)
    width = min(max(fd, sqrt_bw / 2.0), sturges)
    if isinstance(df.schema[col].dataType, T.IntegralType):
        width = max(width, 1.0)     # integer data: bins at least one unit wide
    return max(1, int(math.ceil(ptp / width))) if width > 0 else 1


def histogram_auto(df: DataFrame, col: str, by: Sequence[str] | None = None) -> DataFrame:
    """Histogram with the automatic bin count."""
    return histogram(df, col, auto_bins(df, col), by=by)


# ---------------------------------------------------------------- A15, A17
def kde(df: DataFrame, col: str, by: Sequence[str] | None = None, grid: int = 200,
        bins: int = 4096, cut: float = 0.0) -> DataFrame:
    """Gaussian KDE on ``grid`` points over the data range, Scott bandwidth.

    Values are reduced to at most ``bins`` (mean, count) pairs per group first, at every
    size, so the grid meets a bounded number of rows. ``cut`` extends the grid by that
    many bandwidths on either side, as a violin is drawn. A group of one value has no
    bandwidth and a NULL density.

    bandwidth = sample std * n^(-1/5); output ``(*by, point, x, density, n)``;
    ``density * n * bin_width`` gives the count-scaled curve of a histogram.
    Per group when ``by`` is given (each group its own range and bandwidth).
    """
    keys = _names(by)
    x = to_number(F.col(col), df.schema[col].dataType)
    base = df.select(*keys, x.alias("_v")).filter(F.col("_v").isNotNull())
    stats = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.stddev_samp("_v").alias("_sd"),
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    stats = stats.withColumn("_bw", F.col("_sd") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    # rows to (bin mean, count), combined map-side; bounded by bins per group
    w = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    b = attach(base, stats, keys)
    idx = F.least(F.floor((F.col("_v") - F.col("_lo")) / F.when(w > 0, w).otherwise(F.lit(1.0))),
                  F.lit(bins - 1))
    base = (b.withColumn("_b", idx).groupBy(*keys, "_b")
            .agg(F.avg("_v").alias("_v"), F.count(F.lit(1)).cast("double").alias("_w")))
    reach = F.coalesce(F.col("_bw") * F.lit(float(cut)), F.lit(0.0))
    stats = stats.withColumns({"_lo": F.col("_lo") - reach, "_hi": F.col("_hi") + reach}) if cut else stats
    j = attach(base, stats, keys)
    # one generated row per (value, grid point), summed map-side by the
    # partial aggregate right after the generator (no wide rows, no shuffle
    # beyond grid x groups per task)
    j = spread(j).select(*keys, "_v", "_w", "_n", "_lo", "_hi", "_bw",
                 F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(grid - 1)
    gx = F.col("_lo") + step * F.col("point")
    u = F.try_divide(gx - F.col("_v"), F.col("_bw"))
    acc = j.groupBy(*keys, "point", "_n", "_lo", "_hi", "_bw").agg(
        F.sum(F.col("_w") * F.exp(F.lit(-0.5) * u * u)).alias("_s"))
    norm = F.col("_n") * F.col("_bw") * F.lit(math.sqrt(2.0 * math.pi))
    return acc.select(
        *keys, F.col("point").cast("int").alias("point"),
        (F.col("_lo") + (F.col("_hi") - F.col("_lo")) / F.lit(grid - 1) * F.col("point")).alias("x"),
        F.try_divide(F.col("_s"), norm).alias("density"),
        F.col("_n").cast("long").alias("n"))


# ---------------------------------------------------------------- A16
def _quartiles(base: DataFrame, col: str, keys: list[str], probs: list[float],
               names: list[str]) -> DataFrame:
    """Exact per-group quantiles (distributed, see ``quantiles``), one column per prob."""
    from vatlens.operators.quantiles import exact_quantiles
    q = exact_quantiles(base, [col], probs, by=keys)
    aggs = [F.max(F.when(F.col("prob") == F.lit(p), F.col("value"))).alias(n)
            for p, n in zip(probs, names)]
    return q.groupBy(*keys).agg(*aggs) if keys else q.agg(*aggs)


def box_summary(df: DataFrame, col: str, by: Sequence[str] | None = None,
                whis: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the furthest datum inside 1.5 IQR, outlier count."""
    keys = _names(by)
    x = F.col(col).cast("double")
    base = df.select(*keys, x.alias("_v")).filter(F.col("_v").isNotNull())
    q = _quartiles(base, "_v", keys, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    q = q.withColumn("fence_lo", F.col("q1") - F.lit(whis) * F.col("iqr")) \
         .withColumn("fence_hi", F.col("q3") + F.lit(whis) * F.col("iqr"))
    j = attach(base, q, keys)
    inside = (F.col("_v") >= F.col("fence_lo")) & (F.col("_v") <= F.col("fence_hi"))
    agg = j.groupBy(*keys, "q1", "median", "q3", "iqr", "fence_lo", "fence_hi").agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.min(F.when(inside, F.col("_v"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_hi"),
        F.sum((~inside).cast("long")).cast("long").alias("n_outliers"))
    return agg


def box_outliers(df: DataFrame, col: str, by: Sequence[str] | None = None,
                 keep: Sequence[str] | None = None, whis: float = 1.5) -> DataFrame:
    """Rows outside the box fences, with the fence they crossed."""
    keys = _names(by)
    x = F.col(col).cast("double")
    base = df.select(*keys, *_names(keep), x.alias(col)).filter(F.col(col).isNotNull())
    q = _quartiles(base, col, keys, [0.25, 0.75], ["_q1", "_q3"])
    q = q.select(*keys, (F.col("_q1") - F.lit(whis) * (F.col("_q3") - F.col("_q1"))).alias("_lo"),
                 (F.col("_q3") + F.lit(whis) * (F.col("_q3") - F.col("_q1"))).alias("_hi"))
    j = attach(base, q, keys)
    j = j.filter((F.col(col) < F.col("_lo")) | (F.col(col) > F.col("_hi")))
    return j.withColumn("side", F.when(F.col(col) < F.col("_lo"), F.lit("low")).otherwise(F.lit("high"))) \
            .drop("_lo", "_hi")


# ---------------------------------------------------------------- A21, A22, A23, A24
def long_series(df: DataFrame, time: str, cols: Sequence[str],
                keep: Sequence[str] | None = None) -> DataFrame:
    """Chosen columns against time as ``(time, metric, value)`` rows."""
    cols = _names(cols)
    sel = df.select(time, *_names(keep), *[F.col(c).cast("double").alias(c) for c in cols])
    return sel.unpivot([time, *_names(keep)], cols, "metric", "value")


def bucket_trend(df: DataFrame, time_bucket: Column, cols: Sequence[str]) -> DataFrame:
    """A21 at scale: mean per (time bucket, metric), the curve one would draw."""
    cols = _names(cols)
    base = df.select(time_bucket.alias("t"), *[F.col(c).cast("double").alias(c) for c in cols])
    return (base.unpivot(["t"], cols, "metric", "value")
            .groupBy("t", "metric").agg(F.avg("value").alias("mean"),
                                        F.count("value").cast("long").alias("n")))


def pixel_trend(df: DataFrame, time: str, cols: Sequence[str], key: str, pixels: int = 800) -> DataFrame:
    """A21 at scale without loss to the eye: ``(metric, pixel, role, time, value)`` with the first, last, lowest
    and highest point of every (pixel bucket, metric).

    A line through these points covers the same pixels as one through all points: within a column of pixels it
    enters at the first, leaves at the last and spans lowest to highest. Four ``min_by`` / ``max_by`` per group,
    combined map-side; ties go to the earliest row, then the smallest ``key``.
    """
    cols = _names(cols)
    t = F.col(time)
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast(df.schema[time].dataType), t) \
        if isinstance(df.schema[time].dataType, (T.TimestampType, T.TimestampNTZType)) else t.cast("double")
    base = df.select(t.alias("_t"), micros.alias("_u"), F.col(key).alias("_k"), *[F.col(c).cast("double").alias(c) for c in cols])
    span = base.agg(F.min("_u").alias("a"), F.max("_u").alias("z")).first()
    if span["a"] is None:
        wide, low = 1.0, 0.0
    else:
        low, wide = float(span["a"]), float(span["z"] - span["a"]) or 1.0
    pixel = F.least(F.floor((F.col("_u") - F.lit(low)) / F.lit(wide) * F.lit(pixels)), F.lit(pixels - 1)).cast("int")
    rows = base.select("_t", "_k", pixel.alias("pixel"), *cols).unpivot(["_t", "_k", "pixel"], cols, "metric", "value") \
        .where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("pixel").isNotNull())
    point = F.struct(F.col("_t").alias("time"), "value")
    order = F.struct("_t", "_k")
    g = rows.groupBy("metric", "pixel").agg(
        F.min_by(point, order).alias("first"), F.max_by(point, order).alias("last"),
        F.min_by(point, F.struct("value", "_t", "_k")).alias("lowest"),
        # the highest value, then the earliest row: the smallest of (-value, row)
        F.min_by(point, F.struct((-F.col("value")).alias("v"), "_t", "_k")).alias("highest"))
    roles = ["first", "last", "lowest", "highest"]
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("p")) for r in roles])).alias("_e")
    return g.select("metric", "pixel", each).select("metric", "pixel", "_e.role", "_e.p.time", "_e.p.value")


def class_sample(df: DataFrame, by: Sequence[str] | None, key: str, k: int = 1000, seed: int = 42) -> DataFrame:
    """``k`` rows of every class (all of a smaller one): those with the smallest MD5 of ``key:seed``.

    A bottom-k sketch: a part of the rows keeps its ``k`` smallest, and parts merge by keeping the smallest of
    both, so the sample is exact in size, the same for any partitioning, and a hot class never meets whole in one
    task (its rows are cut to ``k`` per slice first). ``key`` must tell the rows apart.
    """
    keys = _names(by)
    h = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    x = df.withColumns({"_vl_h": h, "_vl_p": F.pmod(F.spark_partition_id(), F.lit(SLICES))})
    order = [F.col("_vl_h"), F.col(key)]
    part = x.withColumn("_vl_r", F.row_number().over(Window.partitionBy(*keys, "_vl_p").orderBy(*order))).where(F.col("_vl_r") <= k)
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
    return part.withColumn("_vl_r", F.row_number().over(w)).where(F.col("_vl_r") <= k).drop("_vl_h", "_vl_p", "_vl_r")


def pair_plot(df: DataFrame, cols: Sequence[str], by: Sequence[str] | None, key: str, k: int = 1000, seed: int = 42,
              grid: int = 200) -> tuple[DataFrame, DataFrame]:
    """The points of every pair of columns, and the diagonal, one density per column and class, both from
    the same sample (``class_sample``, checkpointed: the charts read it once per column)."""
    from vatlens.session import materialize
    keys = _names(by)
    sample = materialize(class_sample(df, by, key, k, seed).select(*dict.fromkeys([*keys, key, *_names(cols)])))
    points = pair_points(sample, cols, keep=list(dict.fromkeys([*keys, key])))
    diagonal = None
    for c in _names(cols):
        one = kde(sample, c, by=keys, grid=grid).withColumn("col_x", F.lit(c))
        diagonal = one if diagonal is None else diagonal.unionByName(one)
    return points, diagonal


def pair_points(df: DataFrame, cols: Sequence[str], keep: Sequence[str] | None = None,
                fraction: float = 1.0, seed: int = 42, key: str | None = None) -> DataFrame:
    """``(col_x, col_y, x, y)`` for every ordered pair of distinct columns.

    ``fraction < 1`` keeps a deterministic hash sample of the rows (needs a
    ``key``); the default keeps every row.
    """
    cols = _names(cols)
    base = df
    if fraction < 1.0:
        h = F.abs(F.xxhash64(F.col(key), F.lit(seed))) % F.lit(1_000_000)
        base = base.filter(h < F.lit(int(fraction * 1_000_000)))
    entries = []
    for a in cols:
        for b in cols:
            if a != b:
                entries.append(F.struct(F.lit(a).alias("col_x"), F.lit(b).alias("col_y"),
                                        F.col(a).cast("double").alias("x"),
                                        F.col(b).cast("double").alias("y")))
    ex = base.select(*_names(keep), F.explode(F.array(*entries)).alias("_p"))
    return ex.select(*_names(keep), "_p.col_x", "_p.col_y", "_p.x", "_p.y")


def actual_vs_predicted(df: DataFrame, y: str, yhat: str) -> tuple[DataFrame, DataFrame]:
    """The point pairs and the common axis limits (one-row frame)."""
    pts = df.select(F.col(y).alias("actual"), F.col(yhat).alias("predicted"))
    lim = pts.agg(F.least(F.min("actual"), F.min("predicted")).alias("lim_lo"),
                  F.greatest(F.max("actual"), F.max("predicted")).alias("lim_hi"))
    return pts, lim


def residuals(df: DataFrame, y: str, yhat: str, name: str = "residual") -> DataFrame:
    """``y - yhat`` per row (its histogram/density via ``histogram``/``kde``)."""
    return df.withColumn(name, F.col(y) - F.col(yhat))
