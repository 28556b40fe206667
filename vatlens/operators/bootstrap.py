"""Bootstrap confidence intervals of group means.

Poisson bootstrap: instead of resampling n rows with replacement, every row
takes a weight ~ Poisson(1) in each replicate, drawn from the MD5 of
``(row key, replicate, seed)`` - deterministic in any engine, no shuffle of the rows and
no driver-side sampling. The weights of all replicates of a row are one array,
added to the arrays of its group within the task (weights, and weights times value),
so a row never becomes a row per replicate: the shuffle carries one pair of arrays
per group and task, and a hot group is combined map-side like any sum. The interval
is the percentile interval of the replicate means.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vatlens.operators.cleaning import to_number
from vatlens.session import APART, apart, spread

try:
    from _md5 import md5  # Python's own, without the set-up per digest that hashlib's has
except ImportError:  # pragma: no cover - builds without it
    from hashlib import md5

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of the arrays a task holds before it hands them on, and rows whose weights are drawn at a time.
HELD_BYTES, ROWS = 64_000_000, 1_024
#: Arrays of one group that meet in one task; with more partitions they are added in two steps.
FAN_IN = 512


def _names(x) -> list[str]:
    if x is None:
        return []
    if isinstance(x, str):
        return [x]
    return list(x)


def poisson1_edges(kmax: int = 12) -> np.ndarray:
    """Distribution function of Poisson(1) at 0 .. kmax - 1; weights are at most ``kmax``."""
    return np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(kmax)])


#: Replicates that one MD5 of (row key, block of replicates, seed) serves: 32 bits each.
_PER_HASH = 4


def replicate_weights(keys: list[str], replicates: int, seed: int) -> np.ndarray:
    """Weights ``(rows, replicates)``: the inverse distribution function at each 32-bit part of the digests."""
    blocks = [f":{b}:{seed}".encode() for b in range(-(-replicates // _PER_HASH))]
    raw = b"".join([md5(k + b).digest() for k in map(str.encode, keys) for b in blocks])
    u = np.frombuffer(raw, ">u4").reshape(len(keys), -1)[:, :replicates]
    # the least 32-bit number whose share is not below an edge
    edges = np.ceil(poisson1_edges() * float(1 << 32)).astype(np.uint32)
    return np.searchsorted(edges, u.astype(np.uint32), side="right").astype(np.float64)


def bootstrap_mean_ci(df: DataFrame, value: str, by: Sequence[str] | None = None,
                      key: str | None = None, replicates: int = 1000, level: float = 0.95,
                      seed: int = 42) -> DataFrame:
    """``(*by, mean, ci_lo, ci_hi, n)``; ``key`` names the column that identifies a row.

    Rows that share a key share their weights, so a value cannot stand in for it.
    """
    if not key:
        raise ValueError("bootstrap weights need a row key: name a column that identifies the rows")
    keys = _names(by)
    base = df.select(*keys, to_number(F.col(value), df.schema[value].dataType).alias("_v"),
                     F.col(key).cast("string").alias("_k")).filter(F.col("_v").isNotNull())
    means = base.groupBy(*keys).agg(F.avg("_v").alias("mean"),
                                    F.count(F.lit(1)).cast("long").alias("n"))
    # groups travel as one text, equal for equal keys, and are read back by name
    group = F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])) if keys else F.lit("")
    sent = base.select(group.alias("_g"), "_v", "_k")
    rows = sent.count()
    sent = apart(sent, rows) if rows >= APART else spread(sent)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out():
            for g, v in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([g]), *[pa.array([x], pa.list_(pa.float64())) for x in v]],
                                                 names=["_g", "w", "s"])
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                w = replicate_weights(["" if k is None else k for k in b.column(2).to_pylist()], replicates, seed)
                v = b.column(1).to_numpy()
                codes = b.column(0).dictionary_encode()
                code = codes.indices.to_numpy()
                order = np.argsort(code, kind="stable")
                starts = np.flatnonzero(np.append(True, np.diff(code[order]) > 0))
                both = [np.add.reduceat(x[order], starts, axis=0) for x in (w, w * v[:, None])]
                for g, *sums in zip(codes.dictionary.take(pa.array(code[order][starts])).to_pylist(), *both):
                    held[g] = held[g] + np.array(sums) if g in held else np.array(sums)
                if len(held) * 16 * replicates > HELD_BYTES:
                    yield from out()
        yield from out()

    def add(part: pa.Table) -> pa.Table:
        sums = [np.sum([x.values.to_numpy() for x in part.column(c)], axis=0) for c in ("w", "s")]
        return pa.table([part.column("_g")[:1], *[pa.array([x], pa.list_(pa.float64())) for x in sums]], names=["_g", "w", "s"])

    tail = (1.0 - level) / 2.0

    def interval(part: pa.Table) -> pa.Table:
        sums = add(part)
        w, s = (sums.column(c)[0].values.to_numpy() for c in ("w", "s"))
        m = s[w > 0] / w[w > 0]
        ends = np.quantile(m, [tail, 1.0 - tail]).tolist() if len(m) else [None, None]
        return pa.table([sums.column("_g"), *[pa.array([x], pa.float64()) for x in ends]], names=["_g", "ci_lo", "ci_hi"])

    parts = sent.mapInArrow(partial, "_g string, w array<double>, s array<double>")
    if sent.rdd.getNumPartitions() > FAN_IN:
        parts = parts.withColumn("_p", F.spark_partition_id() % FAN_IN).groupBy("_g", "_p") \
            .applyInArrow(lambda t: add(t.select(["_g", "w", "s"])), "_g string, w array<double>, s array<double>")
    ci = parts.groupBy("_g").applyInArrow(interval, "_g string, ci_lo double, ci_hi double")
    if keys:
        return means.withColumn("_g", group).join(ci, "_g", "left").select(*means.columns, "ci_lo", "ci_hi")
    row = ci.first()
    lo, hi = (row["ci_lo"], row["ci_hi"]) if row else (None, None)
    return means.withColumns({"ci_lo": F.lit(lo).cast("double"), "ci_hi": F.lit(hi).cast("double")})


def trend_with_ci(df: DataFrame, time: str | Column, value: str, key: str | None = None,
                  replicates: int = 1000, seed: int = 42) -> DataFrame:
    """Mean of ``value`` per time value with its bootstrap interval."""
    t = F.col(time) if isinstance(time, str) else time
    x = df.withColumn("_t", t)
    out = bootstrap_mean_ci(x, value, by=["_t"], key=key, replicates=replicates, seed=seed)
    return out.withColumnRenamed("_t", "t")
