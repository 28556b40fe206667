"""Exact quantiles without one task holding a whole column.

Spark's exact ``percentile`` keeps a value -> count map per group and merges
the maps of every partition in one final task: for a high-cardinality column
that task holds every distinct value. Here the work stays distributed:

1. unpivot the columns to ``(group.., column_name, v)``, find by a sketch where
   the wanted ranks lie, and count each distinct value there (map-side combined,
   so hot values collapse early); the values between are only counted together,
   so the shuffle carries a small share of the rows;
2. a bucketed running sum over the distinct values in value order
   (``ordered.with_row_index(weight=count)``) gives each value its rank
   range ``[before, before + count)``;
3. the group sizes give the needed ranks ``floor(p (n-1))`` and the next
   one; only the distinct values whose rank range holds one of them are
   kept (a few rows per group and probability), and the quantile is the
   linear interpolation between them - the same definition as
   ``percentile`` / ``quantile_cont``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vatlens.operators import ordered
from vatlens.session import materialize


def _names(x) -> list[str]:
    if x is None:
        return []
    if isinstance(x, str):
        return [x]
    return list(x)


#: Accuracy of the sketches, share of the rows on either side of a wanted rank that is looked at exactly (five
#: times what a sketch may be off), rows below which a group is looked at whole, groups sent to the rows.
SKETCH, MARGIN, WHOLE, GROUPS_SENT = 10_000, 5e-4, 100_000, 50_000
MAP_LIMIT = 1_000_000   # distinct values, over all columns, that one task may merge (~80 MB)


def max_distinct(df: DataFrame, cols: Sequence[str],
                 by: Sequence[str] | None = None) -> dict[str, int]:
    """Per column: upper estimate of its distinct values within any one group.

    One pass of ``approx_count_distinct`` (HyperLogLog++, ~2 % error, so the
    estimate is padded by 10 %); the result is one number per column.
    """
    keys, cols = _names(by), _names(cols)
    aggs = [F.approx_count_distinct(F.col(c)).alias(f"d{i}") for i, c in enumerate(cols)]
    g = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    top = g.agg(*[F.max(f"d{i}").alias(f"d{i}") for i in range(len(cols))]).first()
    return {c: int((top[f"d{i}"] or 0) * 1.1) + 1 for i, c in enumerate(cols)}


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    by: Sequence[str] | None = None, buckets: int | None = None,
                    method: str = "auto", map_limit: int | None = None) -> DataFrame:
    """``(*by, column_name, prob, value)`` for every column and probability.

    ``method``: ``"distributed"`` (the ranking plan above, any cardinality),
    ``"percentile"`` (Spark's single-pass exact aggregate: its final merge
    holds one value map per group and column in one task), or ``"auto"``:
    estimate the distinct counts first and use the single pass only for columns
    whose maps together hold about ``map_limit`` values or fewer, the distributed
    plan otherwise. Both give the same numbers, so the estimate decides the plan only.
    """
    keys, cols = _names(by), _names(cols)
    if method == "auto":
        limit = MAP_LIMIT if map_limit is None else map_limit
        nd = max_distinct(df, cols, keys)
        # the maps of all columns meet in one task, so their sum is what counts
        small, held = [], 0
        for c in sorted(cols, key=nd.get):
            held += nd[c]
            if held <= limit:
                small.append(c)
        large = [c for c in cols if c not in small]
        parts = []
        if small:
            parts.append(exact_quantiles(df, small, probs, keys, buckets, "percentile"))
        if large:
            parts.append(exact_quantiles(df, large, probs, keys, buckets, "distributed"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out
    if method == "percentile":
        arr = F.array(*[F.lit(float(p)) for p in probs])
        parts = []
        for c in cols:
            x = F.col(c).cast("double")
            parts.append(F.struct(F.lit(c).alias("column_name"),
                                  F.percentile(F.when(~F.isnan(x), x), arr).alias("q")))
        g = (df.groupBy(*keys).agg(*[p.alias(f"s{i}") for i, p in enumerate(parts)]) if keys
             else df.agg(*[p.alias(f"s{i}") for i, p in enumerate(parts)]))
        long = g.select(*keys, F.explode(F.array(*[F.col(f"s{i}") for i in range(len(cols))])).alias("s"))
        out = long.select(*keys, F.col("s.column_name").alias("column_name"),
                          F.posexplode(F.col("s.q")).alias("_i", "value"))
        return out.filter(F.col("value").isNotNull()).select(
            *keys, "column_name", arr[F.col("_i")].alias("prob"), "value")
    if not keys and len(cols) > 1:
        # one huge ordered set per column: rank each on the global bucketing
        # path (no per-group cut-point limit), then stack the small results
        out = None
        for c in cols:
            q = exact_quantiles(df, [c], probs, None, buckets, "distributed")
            out = q if out is None else out.unionByName(q)
        return out
    long = (df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
            .unpivot(keys, cols, "column_name", "_v")
            .filter(F.col("_v").isNotNull() & ~F.isnan("_v")))
    grp = [*keys, "column_name"]
    probs = [float(p) for p in probs]
    # the ranking below reads the distinct values several times (cut points,
    # bucket join, window, bucket totals): materialise them once (reliable
    # checkpoint in the shared folder) instead of re-scanning and
    # re-shuffling the source for each branch
    hits = _hits(materialize(_near(long, grp, probs)), grp, probs, buckets, bool(keys))
    if hits.where("_gap").limit(1).count():  # a sketch was further off than it promises
        every = long.groupBy(*grp, "_v").agg(F.count(F.lit(1)).alias("_c")).withColumn("_gap", F.lit(False))
        hits = _hits(materialize(every), grp, probs, buckets, bool(keys))
    probs_arr = F.array(*[F.lit(p) for p in probs])
    sel = hits.groupBy(*grp, F.col("_t.i").alias("_i"), "_n").agg(
        F.max(F.when(F.col("_t.side") == "lo", F.col("_v"))).alias("_lo"),
        F.max(F.when(F.col("_t.side") == "hi", F.col("_v"))).alias("_hi"))
    p = probs_arr[F.col("_i")]
    pos = p * (F.col("_n") - F.lit(1))
    frac = pos - F.floor(pos)
    value = F.when(F.col("_hi") == F.col("_lo"), F.col("_lo")).otherwise(
        F.col("_lo") + (F.col("_hi") - F.col("_lo")) * frac)
    return sel.select(*grp, p.alias("prob"), value.alias("value"))


def _near(long: DataFrame, grp: list[str], probs: list[float]) -> DataFrame:
    """``(*grp, _v, _c, _gap)``: the values of each group that may hold a wanted rank, with their counts, and
    for the values between them one row (their least value and number, ``_gap``).

    A sketch of each group, whose ranks are off by 1 in ``SKETCH`` of its rows at most, tells where the wanted
    ranks lie; a group of fewer than ``WHOLE`` rows keeps all its values.
    """
    ends = [min(max(p + side * MARGIN, 0.0), 1.0) for p in sorted(set(probs)) for side in (-1, 1)]
    n = F.count(F.lit(1))
    a = F.percentile_approx("_v", ends, SKETCH)
    some = materialize(long.groupBy(*grp).agg(n.alias("_rows"), a.alias("_at")))
    whole = F.col("_rows") < WHOLE
    few = len(ends) // 2

    def every_other(k):
        edge = F.lit(float("-inf" if k == 0 else "inf"))
        return F.when(whole, F.array(edge)).otherwise(F.array(*[F.col("_at")[2 * i + k] for i in range(few)]))

    some = some.select(*[F.col(g).alias(f"_vr_{i}") for i, g in enumerate(grp)], every_other(0).alias("_from"), every_other(1).alias("_to"))
    if some.count() <= GROUPS_SENT:
        some = F.broadcast(some)
    same = reduce(Column.__and__, [long[g].eqNullSafe(some[f"_vr_{i}"]) for i, g in enumerate(grp)])
    at = ordered._at_or_below(F.col("_from"), F.size("_from"), F.col("_v"), few)
    x = long.join(some, same).withColumn("_at", at)
    inside = F.coalesce(F.col("_v") <= F.get("_to", F.col("_at") - 1), F.lit(False))
    x = x.select(*grp, "_v", (~inside).alias("_gap"), F.when(~inside, F.col("_at")).alias("_at"),
                 F.when(inside, F.col("_v")).alias("_own"))
    return x.groupBy(*grp, "_gap", "_at", "_own").agg(F.min("_v").alias("_v"), n.alias("_c")).drop("_at", "_own")


def _hits(counts: DataFrame, grp: list[str], probs: list[float], buckets: int | None, grouped: bool) -> DataFrame:
    """The counted values whose ranks hold a wanted one, a row for each."""
    ranked = ordered.with_row_index(counts, ["_v"], grp, name="_before", size_name="_n",
                                    weight="_c", buckets=buckets, per_group_cuts=grouped)
    # needed ranks per group and probability, as an array on each distinct value
    h = [F.lit(p) * (F.col("_n") - F.lit(1)) for p in probs]
    want = F.array(*[F.struct(F.lit(i).alias("i"), F.floor(hh).cast("long").alias("r"),
                              F.lit("lo").alias("side")) for i, hh in enumerate(h)],
                   *[F.struct(F.lit(i).alias("i"),
                              F.least(F.floor(hh).cast("long") + 1, F.col("_n") - 1).alias("r"),
                              F.lit("hi").alias("side")) for i, hh in enumerate(h)])
    return ranked.select(*grp, "_v", "_n", "_gap", F.explode(F.filter(
        want, lambda t: (t["r"] >= F.col("_before")) & (t["r"] < F.col("_before") + F.col("_c"))
    )).alias("_t"))


def quantile_row(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict:
    """Small helper for one-row statistics: ``{(column, prob): value}`` (bounded output)."""
    return {(r["column_name"], r["prob"]): r["value"]
            for r in exact_quantiles(df, cols, probs).collect()}
