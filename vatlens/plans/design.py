"""One numeric table that every fit of a model comparison reads.

``Design`` holds the rows once, checkpointed: ``_id``, ``_fold`` (0 .. k-1 for training rows,
-1 for rows that are only scored), ``_inner`` (folds for a search inside a fit), ``_y`` and the
features as one array. The fits are numbered: fit f < k leaves fold f out and is scored on it,
fit k learns from all training rows and is scored on the rows of fold -1. A pass over the table
serves all fits: tasks add up small arrays, keyed by a slot (fit, node, ..), and Spark sums the
arrays of a slot. So k + 1 fits cost as many jobs as one, and no row is copied per fit.

What returns to the driver has the size of the models, never of the rows.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vatlens.operators.cleaning import to_number
from vatlens.operators.growth import imputed
from vatlens.session import APART, apart, materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Cells of the counting grid of one order statistic.
GRID = 512
#: Arrays of one slot that meet in one task; with more partitions they are summed in two steps.
FAN_IN = 512


def arrays(b: pa.RecordBatch, d: int) -> tuple[np.ndarray, ...]:
    """``id, fold, inner, y, x`` of a batch; a missing target or feature is NaN."""
    return (b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(),
            b.column(3).to_numpy(zero_copy_only=False), b.column(4).flatten().to_numpy().reshape(b.num_rows, d))


def learned(fold: np.ndarray, fit: int) -> np.ndarray:
    """The rows from which a fit learns."""
    return (fold >= 0) & (fold != fit)


def scored(fold: np.ndarray, fit: int, k: int) -> np.ndarray:
    """The rows on which a fit is scored."""
    return fold == (fit if fit < k else -1)


class Design:
    """``folds`` names the column of fold numbers of ``train`` (none: one fit, number 0, over all rows),
    ``inner`` that of inner folds. Rows without a target are left out of ``train``. ``key`` names the
    column that identifies a row: with it a row's bootstrap weights do not depend on the partitioning.
    ``fits`` leaves out fits that are not wanted."""

    def __init__(self, train: DataFrame, features: Sequence[str], target: str, folds: str | None = None, k: int = 0,
                 test: DataFrame | None = None, inner: str | None = None, key: str | None = None,
                 fits: Sequence[int] | None = None):
        self.features, self.target, self.k = list(features), target, k if folds else 0
        self.spark = train.sparkSession
        rows = self._rows(train, F.col(folds) if folds else F.lit(0), inner, key).where(F.col("_y").isNotNull())
        if test is not None:
            rows = rows.unionByName(self._rows(test, F.lit(-1), None, key))
        self.df = materialize(rows)
        if not folds:
            # a single fit learns from every row: its number is that of no fold
            self.fits = [1]
            self.k = 1
        else:
            self.fits = list(range(k + 1)) if fits is None else list(fits)
        self.d = len(self.features)
        self._describe()
        if self.total >= APART:
            # a file's row groups may all lie in a few of its splits
            self.df = materialize(apart(self.df, self.total))

    def _rows(self, df: DataFrame, fold, inner: str | None, key: str | None) -> DataFrame:
        nan = F.lit(float("nan"))
        x = [F.coalesce(to_number(F.col(f), df.schema[f].dataType) if f in df.columns else nan, nan) for f in self.features]
        y = to_number(F.col(self.target), df.schema[self.target].dataType) if self.target in df.columns \
            else F.lit(None).cast("double")
        return df.select((F.xxhash64(F.col(key)) if key else F.monotonically_increasing_id()).alias("_id"),
                         fold.cast("int").alias("_fold"),
                         (F.col(inner).cast("int") if inner else F.lit(0)).alias("_inner"),
                         y.cast("double").alias("_y"), F.array(*x).cast("array<double>").alias("_x"))

    def _describe(self) -> None:
        """Rows, and per feature the present values with their mean, least and greatest, by fold."""
        aggs = [F.count(F.lit(1)).alias("n"), F.avg("_y").alias("y")]
        for j in range(self.d):
            v = F.col("_x")[j]
            v = F.when(~F.isnan(v), v)
            aggs += [F.count(v).alias(f"c{j}"), F.avg(v).alias(f"m{j}"), F.min(v).alias(f"a{j}"), F.max(v).alias(f"z{j}")]
        rows = [r for r in self.df.where("_fold >= 0").groupBy("_fold").agg(*aggs).collect()]
        if not rows:
            raise ValueError("no labelled rows to fit")
        self.by_fold = {r["_fold"]: r["n"] for r in rows}
        self.n = {f: sum(n for g, n in self.by_fold.items() if g != f) for f in self.fits}
        self.total = sum(self.by_fold.values())
        self.y_mean = sum(r["n"] * r["y"] for r in rows) / self.total
        self.present = {f: [sum(r[f"c{j}"] for r in rows if r["_fold"] != f) for j in range(self.d)] for f in self.fits}
        some = [[r for r in rows if r[f"c{j}"]] for j in range(self.d)]
        self.low = [min((r[f"a{j}"] for r in s), default=0.0) for j, s in enumerate(some)]
        self.high = [max((r[f"z{j}"] for r in s), default=0.0) for j, s in enumerate(some)]
        self.center = np.array([sum(r[f"c{j}"] * r[f"m{j}"] for r in s) / sum(r[f"c{j}"] for r in s) if s else 0.0
                                for j, s in enumerate(some)] + [self.y_mean])
        self._medians: dict[int, list] | None = None

    # ------------------------------------------------------------ passes
    def sums(self, make: Callable[[Iterator[tuple]], Iterator[tuple[int, np.ndarray]]], df: DataFrame | None = None) -> dict:
        """``{slot: array}``: ``make`` turns the batches of a task into its arrays, Spark adds those of a slot."""
        d = self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for slot, v in make(arrays(b, d) + tuple(b.columns[5:]) for b in batches):
                yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([np.ravel(v)], pa.list_(pa.float64()))],
                                                 names=["slot", "v"])

        def add(part: pa.Table) -> pa.Table:
            total = np.sum([x.values.to_numpy() for x in part.column("v")], axis=0)
            return pa.table([part.column("slot")[:1], pa.array([total], pa.list_(pa.float64()))], names=["slot", "v"])

        src = self.df if df is None else df
        parts = src.mapInArrow(run, "slot bigint, v array<double>")
        if src.rdd.getNumPartitions() > FAN_IN:
            parts = parts.withColumn("part", F.spark_partition_id() % FAN_IN).groupBy("slot", "part") \
                .applyInArrow(lambda t: add(t.select(["slot", "v"])), "slot bigint, v array<double>")
        return {r["slot"]: np.array(r["v"]) for r in parts.groupBy("slot").applyInArrow(add, "slot bigint, v array<double>").collect()}

    def medians(self, fit: int) -> list:
        """Median of the present values of each feature among the rows a fit learns from; None without any.
        Features without missing values need none for imputation, and get their mean, which is never used."""
        if self._medians is None:
            self._medians = self._find_medians()
        return self._medians[fit]

    def _find_medians(self) -> dict[int, list]:
        """Exact selection by counting: each pass counts the values of a bracket in ``GRID`` cells and keeps the
        cell that holds the wanted rank, until all its values are equal. No row is moved or copied."""
        full = self.df.where(F.exists("_x", F.isnan)).limit(1).count() == 0
        out = {f: [None if not self.present[f][j] else float(self.center[j]) for j in range(self.d)] for f in self.fits}
        if full:
            return out
        open_, found = {}, {}
        for f in self.fits:
            for j in range(self.d):
                m = self.present[f][j]
                for r in {(m - 1) // 2, m // 2} if m else ():
                    open_[f, j, r] = (self.low[j], self.high[j], r)
        while open_:
            wanted = list(open_)
            brackets = [open_[t] for t in wanted]

            def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                tally = [np.zeros(GRID, np.int64) for _ in wanted]
                low, high = [np.full(GRID, np.inf) for _ in wanted], [np.full(GRID, -np.inf) for _ in wanted]
                for b in batches:
                    _, fold, _, _, x = arrays(b, d)
                    for t, (f, j, _) in enumerate(wanted):
                        a, z, _ = brackets[t]
                        v = x[learned(fold, f), j]
                        v = v[(v >= a) & (v <= z)]
                        cell = np.minimum(((v - a) * (GRID / (z - a)) if z > a else v * 0).astype(np.int64), GRID - 1)
                        tally[t] += np.bincount(cell, minlength=GRID)
                        np.minimum.at(low[t], cell, v)
                        np.maximum.at(high[t], cell, v)
                for t in range(len(wanted)):
                    at = np.flatnonzero(tally[t])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t)), pa.array(at), pa.array(tally[t][at]),
                                                      pa.array(low[t][at]), pa.array(high[t][at])], names=["t", "cell", "n", "a", "z"])

            d = self.d
            cells = self.df.mapInArrow(count, "t bigint, cell bigint, n bigint, a double, z double") \
                .groupBy("t", "cell").agg(F.sum("n").alias("n"), F.min("a").alias("a"), F.max("z").alias("z")).collect()
            for t, key in enumerate(wanted):
                _, _, rank = open_.pop(key)
                for c in sorted((c for c in cells if c["t"] == t), key=lambda c: c["cell"]):
                    if rank < c["n"]:
                        if c["a"] == c["z"]:
                            found[key] = c["a"]
                        else:
                            open_[key] = (c["a"], c["z"], rank)
                        break
                    rank -= c["n"]
        for f in self.fits:
            for j in range(self.d):
                if m := self.present[f][j]:
                    a, z = found[f, j, (m - 1) // 2], found[f, j, m // 2]
                    out[f][j] = a + (z - a) * 0.5
        return out

    def moments(self) -> dict[int, dict[int, tuple]]:
        """Per fit and inner fold ``(n, mean, co-moments)`` of the imputed features and the target, from sums
        about the overall means in one pass."""
        center, medians = self.center, {f: self.medians(f) for f in self.fits}
        fits, p, inner_of = self.fits, self.d + 1, 1 << 20

        def make(batches):
            total: dict[int, np.ndarray] = {}
            for _, fold, inner, y, x, *_ in batches:
                for f in fits:
                    on = learned(fold, f)
                    z = np.column_stack([imputed(x[on], medians[f]), y[on]]) - center
                    for i in np.unique(inner[on]).tolist():
                        v = z[inner[on] == i]
                        got = np.concatenate([[len(v)], v.sum(0), (v.T @ v).ravel()])
                        slot = f * inner_of + i
                        total[slot] = total.get(slot, 0) + got
            yield from total.items()

        out: dict[int, dict[int, tuple]] = {f: {} for f in fits}
        for slot, v in self.sums(make).items():
            n, s, m = int(v[0]), v[1:p + 1], v[p + 1:].reshape(p, p)
            out[slot // inner_of][slot % inner_of] = (n, center + s / n, m - np.outer(s, s) / n)
        return out

    def predictions(self, models: dict[tuple[str, int], tuple[Callable, dict]]) -> DataFrame:
        """``model, fit, y, p`` for the rows each fit is scored on, all models in one pass. A model is a function
        ``(x, params)`` of a module that is sent by value, and its parameters."""
        d, k = self.d, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                _, fold, _, y, x = arrays(b, d)
                for (name, f), (predict, params) in models.items():
                    on = scored(fold, f, k)
                    if on.any():
                        n = int(on.sum())
                        yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.full(n, f, np.int32)), pa.array(y[on]),
                                                          pa.array(predict(x[on], params))], names=["model", "fit", "y", "p"])

        return self.df.mapInArrow(run, "model string, fit int, y double, p double")


def predict_linear(x: np.ndarray, m: dict) -> np.ndarray:
    return imputed(x, m["medians"]) @ np.array(m["coef"]) + m["intercept"]


def apply_rows(df: DataFrame, features: Sequence[str], predict: Callable, params: dict, name: str) -> DataFrame:
    """``df`` with ``name`` = ``predict(x, params)`` of its features (absent ones are missing), in Arrow batches."""
    nan = F.lit(float("nan"))
    x = F.array(*[F.coalesce(to_number(F.col(f), df.schema[f].dataType) if f in df.columns else nan, nan) for f in features])
    sent = df.drop(name).withColumn("_vl_x", x.cast("array<double>"))
    d, keep = len(features), len(sent.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = predict(b.column(keep).flatten().to_numpy().reshape(b.num_rows, d), params)
            yield pa.RecordBatch.from_arrays([*b.columns[:keep], pa.array(p, pa.float64())], names=[*b.schema.names[:keep], name])

    schema = df.drop(name).schema.add(name, "double")
    return sent.mapInArrow(run, schema)
