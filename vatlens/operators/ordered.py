"""Ordered operators: previous-row values, differences, row index, blocks.

A DataFrame has no row order, so every operator here takes ``order_by``
(ascending column names, the last ones acting as tie-breaks) and an optional
``partition_by`` (a run id). A plain ``Window.partitionBy(run).orderBy(t)``
sends a whole run to one task, and with no run key the whole table to one
task. To keep every task bounded we split each run into *order buckets*:

1. a sample of the order tuples, ``CUT_SAMPLE`` per bucket, is sorted and gives
   ``buckets - 1`` equal-frequency splitters; the row count sets the number of
   buckets (about 4M rows each at scale). A splitter keeps only as many keys of
   its tuple as tell it from its neighbour, so untied leading keys cost one
   comparison, and a table with one timestamp is split by the keys behind it.
   Keys may be of any type with an order: numbers, decimals, text, times;
2. each row gets ``sub = bucket(order tuple)``, a deterministic function of the
   row, so every branch below computes the same value without a shuffle;
3. the window runs over ``(partition_by, sub)`` - a hot run is cut into as
   many pieces as the order key allows;
4. a per-``(partition_by, sub)`` summary (last row / row count) is reduced
   with ``max_by`` / ``count`` (map-side combined) and a small window over the
   summary carries the previous piece's last row (or the preceding row count)
   into each piece; it is joined back on the piece key, which the window
   exchange already partitioned the big side by.

``split=False`` keeps the plain window (fine when runs are known to be small).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vatlens.session import shuffle_width

_SUB = "_vl_sub"


def _names(x) -> list[str]:
    if x is None:
        return []
    if isinstance(x, str):
        return [x]
    return list(x)


def order_position(df: DataFrame, column: str) -> Column:
    """A double that increases with ``column`` (timestamps become microseconds)."""
    return order_position_of(F.col(column), df.schema[column].dataType)


_FAST = (T.TimestampNTZType, T.TimestampType, T.DateType, T.IntegralType, T.FloatType, T.DoubleType)


def order_position_of(c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c).cast("double")
    if isinstance(t, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(t, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(t, T.NumericType):
        return c.cast("double")
    raise TypeError(f"order bucket needs a numeric, date or timestamp leading key, got {t}")


ROWS_PER_BUCKET = 4_000_000   # target rows per order bucket at scale
LEAST_ROWS = 1_000            # below this a bucket is not worth a task
CUT_SAMPLE = 200              # sampled rows per bucket that its splitters are taken from
CUT_ROWS = 2_000_000          # sampled rows in all, which one task sorts (at least 2 a bucket)
CASE_CUTS = 256               # longer lists of splitters would outgrow a generated method


def _buckets_for(df: DataFrame, rows: int) -> int:
    """Buckets by the number of rows: enough tasks for the cluster, no bucket above the target."""
    spread_out = min(2 * shuffle_width(df.sparkSession), rows // LEAST_ROWS)
    return max(2, spread_out, -(-rows // ROWS_PER_BUCKET))


def _splitters(df: DataFrame, order_by: list[str], buckets: int | None) -> list[tuple]:
    """Ascending splitters of about equal buckets, as tuples of texts that cast back to the keys' types.
    They need not be exact (any splitters give the same result), so they come from a sample and what
    meets in one task does not grow with the table."""
    rows = df.count()
    if not rows:
        return []
    buckets = buckets or _buckets_for(df, rows)
    if buckets < 2:
        return []
    wanted = min(CUT_SAMPLE * buckets, max(CUT_ROWS, 2 * buckets))
    some = df.select(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order_by)]).alias("_vl_k"))
    some = some.sample(min(1.0, wanted / rows), seed=17) if wanted < rows else some
    tile = some.withColumn("_vl_t", F.ntile(buckets).over(Window.orderBy("_vl_k")))
    firsts = tile.groupBy("_vl_t").agg(F.min("_vl_k").alias("_vl_k")).where("_vl_t > 1").orderBy("_vl_t")
    found = [tuple(r) for r in firsts.select(*[F.col(f"_vl_k.k{i}").cast("string") for i in range(len(order_by))]).collect()]
    out: list[tuple] = []
    last: tuple = ()
    for t in found:
        if t == last:
            continue
        same = next((i for i, (x, y) in enumerate(zip(t, last)) if x != y), 0)
        # keys up to the first that differs; a leading null is the smallest key and splits nothing
        cut = t[:same + 1]
        last = t
        if any(x is not None for x in cut):
            out.append(cut)
    return out


def _below(df: DataFrame, order_by: list[str], cut: tuple) -> Column:
    """Whether a row's keys come before ``cut`` (nulls first, as in an ascending window)."""
    out = F.lit(False)
    for c, text in reversed(list(zip(order_by, cut))):
        if text is None:
            out = F.col(c).isNull() & out
        else:
            v = F.lit(text).cast(df.schema[c].dataType)
            out = F.col(c).isNull() | (F.col(c) < v) | ((F.col(c) == v) & out)
    return out


def _bucket_expr(below: list[Column]) -> Column:
    """Number of splitters at or before the row, as a balanced CASE tree of depth log2."""
    def build(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2
        return F.when(below[mid - 1], build(lo, mid - 1)).otherwise(build(mid, hi))

    return build(0, len(below))


def _at_or_below(cuts: Column, size: Column, key: Column, most: int) -> Column:
    """Number of the ascending ``cuts`` (an array of at most ``most``) that are <= ``key``, by binary search."""
    def step(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        go = F.get(cuts, mid) <= key
        open_ = s["lo"] < s["hi"]
        return F.struct(F.when(open_ & go, mid + 1).otherwise(s["lo"]).alias("lo"),
                        F.when(open_ & ~go, mid).otherwise(s["hi"]).alias("hi"))

    steps = F.sequence(F.lit(1), F.lit(max(1, most.bit_length())))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), size.cast("int").alias("hi")), step, lambda s: s["lo"])


def _group_buckets(df: DataFrame, pos: Column, groups: list[str], buckets: int | None,
                   name: str) -> DataFrame:
    """Per-group cut points (a small table, checkpointed once), attached by a
    join on the group key; the bucket is the number of the group's cut points
    at or below the value (binary search). The largest group sets their
    number. Meant for many groups of moderate size; one huge ordered set takes
    the global path (``per_group=None``)."""
    from vatlens.session import materialize

    if not buckets:
        most = df.groupBy(*groups).agg(F.count(pos).alias("n")).agg(F.max("n")).first()[0] or 0
        buckets = _buckets_for(df, most)
    n = max(2, buckets)
    probs = [i / n for i in range(1, n)]
    c = materialize(df.groupBy(*groups).agg(
        F.percentile_approx(pos, probs, max(10000, 10 * n)).alias("_vl_cuts")))
    c = c.select(*[F.col(g).alias("_vr_" + g) for g in groups], "_vl_cuts")
    cond = None
    for g in groups:
        t = df[g].eqNullSafe(c["_vr_" + g])
        cond = t if cond is None else cond & t
    j = df.join(c, cond, "left")
    b = F.when(pos.isNull(), F.lit(-1)).otherwise(
        F.coalesce(_at_or_below(F.col("_vl_cuts"), F.size("_vl_cuts"), pos, n), F.lit(0)))
    return j.withColumn(name, b.cast("int")).drop("_vl_cuts", *["_vr_" + g for g in groups])


def with_order_bucket(df: DataFrame, order_by: Sequence[str], buckets: int | None = None,
                      name: str = _SUB, per_group: Sequence[str] | None = None) -> DataFrame:
    """Add an equal-frequency bucket of the leading order key (see module doc).

    ``per_group``: cut points per group (one ``percentile_approx`` per group,
    attached by a join on the group key) for groups on unrelated scales, e.g.
    the values of different columns.
    """
    order_by = _names(order_by)
    groups = _names(per_group)
    if groups:
        return _group_buckets(df, order_position(df, order_by[0]), groups, buckets, name)
    cuts = _splitters(df, order_by, buckets)
    if len(cuts) <= CASE_CUTS:
        return df.withColumn(name, _bucket_expr([_below(df, order_by, c) for c in cuts]))
    if all(len(c) == 1 for c in cuts) and isinstance(df.schema[order_by[0]].dataType, _FAST):
        # MLlib's Bucketizer: a JVM binary search over one numeric key
        from pyspark.ml.feature import Bucketizer
        pos = order_position(df, order_by[0])
        first = df.schema[order_by[0]].dataType
        as_numbers = df.sparkSession.range(1).select(F.array(*[
            order_position_of(F.lit(c[0]).cast(first), first) for c in cuts]).alias("v")).first()["v"]
        bz = Bucketizer(splits=[-float("inf"), *sorted(set(as_numbers)), float("inf")], inputCol="_vl_pos",
                        outputCol="_vl_bkt", handleInvalid="keep")
        out = bz.transform(df.withColumn("_vl_pos", pos))
        b = F.when(F.col("_vl_pos").isNull(), F.lit(-1)).otherwise(F.col("_vl_bkt").cast("int"))
        return out.withColumn(name, b).drop("_vl_pos", "_vl_bkt")
    # two levels of CASE trees: every ``CASE_CUTS``-th splitter, then those between, one tree per stretch
    step = -(-len(cuts) // CASE_CUTS)
    coarse = df.withColumn("_vl_c", _bucket_expr([_below(df, order_by, c) for c in cuts[::step]]))
    first = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order_by)])
    keys = coarse.select(first.alias("k")).schema["k"].dataType
    table = F.array(*[F.array(*[_as_key(df, order_by, c) for c in cuts[i:i + step]]) for i in range(0, len(cuts), step)])
    row = df.sparkSession.range(1).select(F.to_json(F.struct(table.alias("t"))).alias("t")).first()["t"]
    shape = T.StructType([T.StructField("t", T.ArrayType(T.ArrayType(keys)))])
    within = F.get(F.from_json(F.lit(row), shape)["t"], F.col("_vl_c") - 1)
    found = _at_or_below(F.array_sort(within), F.size(within), first, step)
    return coarse.withColumn(name, (F.when(F.col("_vl_c") == 0, F.lit(0)).otherwise(
        (F.col("_vl_c") - 1) * F.lit(step) + F.coalesce(found, F.lit(0)))).cast("int")).drop("_vl_c")


def _as_key(df: DataFrame, order_by: list[str], cut: tuple) -> Column:
    """A splitter as a whole key; the keys it leaves out are null, the smallest."""
    return F.struct(*[(F.lit(cut[i]) if i < len(cut) else F.lit(None)).cast(df.schema[c].dataType).alias(f"k{i}")
                      for i, c in enumerate(order_by)])


def _default(t: T.DataType) -> Column:
    if isinstance(t, T.NumericType):
        return F.lit(0).cast(t)
    if isinstance(t, T.BooleanType):
        return F.lit(False)
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(0).cast("timestamp").cast(t) if not isinstance(t, T.DateType) \
            else F.lit("1970-01-01").cast("date")
    return F.lit("")


def _piece_keys(df: DataFrame, part: list[str]) -> tuple[DataFrame, list[str]]:
    """Null-free copies of the run keys: ``coalesce(k, default)`` and ``isnull(k)``.

    The window, the summary and the carry join all use these same columns, so
    the join's required distribution is the window's output partitioning and
    the big side is not shuffled a second time (a null-safe ``<=>`` join would
    hash on rewritten expressions and re-shuffle it).
    """
    cols, names = {}, []
    for i, k in enumerate(part):
        t = df.schema[k].dataType
        simple = isinstance(t, (T.NumericType, T.BooleanType, T.StringType, T.DateType,
                                T.TimestampType, T.TimestampNTZType))
        v = F.col(k) if simple else F.col(k).cast("string")
        cols[f"_vl_k{i}"] = F.coalesce(v, _default(t if simple else T.StringType()))
        cols[f"_vl_n{i}"] = F.col(k).isNull()
        names += [f"_vl_k{i}", f"_vl_n{i}"]
    return (df.withColumns(cols) if cols else df), names


def with_previous(df: DataFrame, cols: Sequence[str], order_by: Sequence[str],
                  partition_by: Sequence[str] | None = None, prefix: str = "prev_",
                  split: bool = True, buckets: int | None = None) -> DataFrame:
    """Add ``prefix + c`` = value of ``c`` on the previous row of the same run.

    The first row of a run gets null, like ``Series.diff``/``shift``.
    """
    cols, order_by, part = _names(cols), _names(order_by), _names(partition_by)
    if not split:
        w = Window.partitionBy(*part).orderBy(*order_by)
        return df.withColumns({prefix + c: F.lag(c).over(w) for c in cols})

    b, pk = _piece_keys(with_order_bucket(df, order_by, buckets), part)
    keys = [*pk, _SUB]
    rec = F.struct(*[F.col(c).alias(c) for c in cols])
    w = Window.partitionBy(*keys).orderBy(*order_by)
    inner = b.withColumn("_vl_prev", F.lag(rec).over(w))
    last = b.groupBy(*keys).agg(F.max_by(rec, F.struct(*order_by)).alias("_vl_last"))
    carry = last.select(
        *keys,
        F.lag("_vl_last").over(Window.partitionBy(*pk).orderBy(_SUB)).alias("_vl_carry"),
    )
    j = inner.join(carry, on=keys, how="left")
    # lag(struct) is null only on the first row of a piece
    prev = F.when(F.col("_vl_prev").isNull(), F.col("_vl_carry")).otherwise(F.col("_vl_prev"))
    out = j.withColumns({prefix + c: prev[c] for c in cols})
    return out.drop("_vl_prev", "_vl_carry", *keys)


def diff(df: DataFrame, cols: Sequence[str] | dict, order_by: Sequence[str],
         partition_by: Sequence[str] | None = None, split: bool = True,
         buckets: int | None = None) -> DataFrame:
    """First difference ``x[i] - x[i-1]`` in row order.

    ``cols`` is a list (output ``<c>_diff``) or a mapping source -> output.
    """
    mapping = dict(cols) if isinstance(cols, dict) else {c: f"{c}_diff" for c in _names(cols)}
    src = list(mapping)
    x = with_previous(df, src, order_by, partition_by, prefix="_vl_p_", split=split,
                      buckets=buckets)
    x = x.withColumns({out: F.col(s) - F.col("_vl_p_" + s) for s, out in mapping.items()})
    return x.drop(*["_vl_p_" + s for s in src])


def with_row_index(df: DataFrame, order_by: Sequence[str],
                   partition_by: Sequence[str] | None = None, name: str = "row_index",
                   size_name: str | None = None, split: bool = True,
                   buckets: int | None = None, weight: str | None = None,
                   per_group_cuts: bool = False) -> DataFrame:
    """0-based position of each row in ``order_by`` order within its run.

    ``size_name`` additionally adds the run's row count. With ``weight`` the
    position is the sum of the weights of the preceding rows (a running
    count over rows that stand for ``weight`` copies).
    """
    order_by, part = _names(order_by), _names(partition_by)
    wcol = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    if not split:
        w = Window.partitionBy(*part).orderBy(*order_by)
        out = df.withColumn(name, F.coalesce(
            F.sum(wcol).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"))
        if size_name:
            out = out.withColumn(size_name, F.sum(wcol).over(Window.partitionBy(*part)).cast("long"))
        return out
    b, pk = _piece_keys(with_order_bucket(df, order_by, buckets,
                                          per_group=part if per_group_cuts else None), part)
    keys = [*pk, _SUB]
    wi = Window.partitionBy(*keys).orderBy(*order_by)
    if weight:
        rn = F.coalesce(F.sum(wcol).over(wi.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    else:
        rn = F.row_number().over(wi) - 1
    inner = b.withColumn("_vl_rn", rn)
    cnt = b.groupBy(*keys).agg(F.sum(wcol).alias("_vl_n"))
    wp = Window.partitionBy(*pk).orderBy(_SUB)
    off = cnt.select(
        *keys,
        F.coalesce(F.sum("_vl_n").over(wp.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_vl_off"),
        F.sum("_vl_n").over(Window.partitionBy(*pk)).alias("_vl_total"),
    )
    j = inner.join(off, on=keys, how="left")
    out = j.withColumn(name, (F.col("_vl_off") + F.col("_vl_rn")).cast("long"))
    if size_name:
        out = out.withColumn(size_name, F.col("_vl_total").cast("long"))
    return out.drop("_vl_rn", "_vl_off", "_vl_total", *keys)


def block_of(index: Column, size: Column, k: int) -> Column:
    """Contiguous block (0..k-1) of a 0-based index in a run of ``size`` rows.

    The first ``size % k`` blocks hold one extra row (KFold without shuffle,
    same as SQL ``ntile``).
    """
    q = F.floor(size / F.lit(k))
    r = size - q * F.lit(k)
    big = r * (q + 1)
    return F.when(index < big, F.floor(index / (q + 1))).otherwise(
        r + F.floor((index - big) / F.greatest(q, F.lit(1)))
    ).cast("int")


def contiguous_folds(df: DataFrame, order_by: Sequence[str], k: int = 5,
                     partition_by: Sequence[str] | None = None, name: str = "fold",
                     split: bool = True, buckets: int | None = None) -> DataFrame:
    """fold = contiguous block of the ordered rows (first n % k folds longer)."""
    x = with_row_index(df, order_by, partition_by, name="_vl_idx", size_name="_vl_size",
                       split=split, buckets=buckets)
    return x.withColumn(name, block_of(F.col("_vl_idx"), F.col("_vl_size"), k)).drop(
        "_vl_idx", "_vl_size")
