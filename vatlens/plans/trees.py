"""Random forest and gradient boosting on Spark.

**Forest.** Trees without a depth limit cannot be grown level by level over the whole table: each
level would be a pass. So a node is grown by passes only while its rows do not fit a task:

1. the top: tasks add up histograms of the open nodes of all trees and fits (weights and weighted
   targets per bin), Spark sums them and finds each node's best split; a row's bootstrap weight
   comes from a hash of its id, so nothing is sampled or stored per tree;
2. sub-tree completion: a node of at most ``TASK_CELLS`` values is finished exactly, on raw values,
   by the one task that its rows are sent to. A table that is small as a whole has no top; its rows
   are then sent once for several trees.

Rows that a fit is scored on ride along with weight 0 and come back with the mean of the trees, so
a cross-validated forest needs no second pass and no collected model. A fitted model is a table of
nodes; scoring sends rows to the task that holds their sub-tree, or, where all nodes together are
small, the nodes to the rows.

**Boosting.** Bins are fixed once (``BINS`` quantiles, or every value where there are fewer). Each
level aggregates the lighter child's histogram only; residuals are updated by partition, in the
pass that needs them, and written every ``KEEP`` trees. All fits grow side by side. A fit of at most
``TASK_CELLS`` values runs its rounds in the task that its rows are sent to, with the same code.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vatlens.operators import growth
from vatlens.operators.growth import imputed
from vatlens.operators.quantiles import exact_quantiles
from vatlens.plans.design import Design, apply_rows, arrays, learned, scored
from vatlens.session import checkpoint_dir, materialize, spread

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Values (rows x (features + 2)) of a node or fit that one task finishes; 8 bytes each, some copies.
TASK_CELLS = 8_000_000
#: Bins of a histogram, and bytes of the histograms a task adds up in one pass of the top.
BINS, TOP_BYTES = 256, 128_000_000
#: Bytes of nodes up to which a model is sent to the rows instead of the rows to the model.
SENT_BYTES = 64_000_000
#: Bytes of nodes that a task holds while the rows to be scored pass by (one sub-tree at the least).
HELD_BYTES = 48_000_000
#: Trees between two writings of the residuals.
KEEP = 10
#: Nodes of a tree in one row of a model (12 bytes each; readers hold some thousand rows), rows that a sub-tree scores
#: at once, rows in a batch of scores.
PIECE, SCORED, BATCH = 1 << 10, 1 << 18, 1 << 16
_NODES = "unit bigint, fit int, tree int, node bigint, part int, feature array<int>, number array<double>, gains array<double>"
_SCORES = "unit bigint, fit int, id bigint, y double, p double, n int"


def bin_edges(design: Design) -> list[np.ndarray]:
    """Edges between the bins of each feature: all distinct values' midpoints where they fit, else quantiles."""
    x = design.df.where("_fold >= 0").select(*[F.when(~F.isnan(F.col("_x")[j]), F.col("_x")[j]).alias(f"x{j}")
                                               for j in range(design.d)])
    few = x.agg(*[F.approx_count_distinct(c).alias(c) for c in x.columns]).first() if design.d else None
    edges: list = [None] * design.d
    for j, c in enumerate(x.columns):
        if few[c] < BINS * 0.9:
            v = np.array(sorted(r[0] for r in x.where(F.col(c).isNotNull()).select(c).distinct().collect()))
            if len(v) <= BINS:
                edges[j] = v[:-1] + np.diff(v) / 2
    rest = [c for j, c in enumerate(x.columns) if edges[j] is None]
    if rest:
        got = exact_quantiles(x, rest, [i / BINS for i in range(1, BINS)]).collect()
        for c in rest:
            edges[int(c[1:])] = np.unique([r["value"] for r in got if r["column_name"] == c])
    return edges


# ---------------------------------------------------------------- forest
@dataclass
class Grower:
    """How the trees of some fits are grown; travels to the tasks."""

    design_d: int
    k: int
    medians: dict
    seed: int
    max_depth: int | None
    top: dict = field(default_factory=dict)      # (fit, tree) -> nodes grown by passes, as lists
    units: dict = field(default_factory=dict)    # (fit, tree, node) -> unit
    trees_of: dict = field(default_factory=dict)  # unit -> (fit, [trees], node, depth)

    def weights(self, ids, fold, fit, tree):
        return np.where(learned(fold, fit), growth.bag(ids, tree, self.seed), 0.0)


def _grow_top(design: Design, g: Grower, trees: range, edges: list[np.ndarray]) -> None:
    """Pass by pass, split the nodes whose rows do not fit a task."""
    d, width = design.d, BINS
    limit = TASK_CELLS / (d + 2)
    ends = [(design.low[j], design.high[j]) for j in range(d)]
    open_ = []
    for f in design.fits:
        for t in trees:
            g.top[f, t] = {"feature": [-1], "threshold": [0.0], "left": [-1], "value": [design.y_mean], "gain": [0.0],
                           "depth": [0], "weight": [float(design.n[f])]}
            open_.append((f, t, 0, None))
    per_pass = max(1, int(TOP_BYTES / (16 * width * max(d, 1))))
    while open_:
        now, open_ = open_[:per_pass], open_[per_pass:]
        slots = {(f, t, node): s for s, (f, t, node, _) in enumerate(now)}
        own = {s: e for s, (_, _, _, e) in enumerate(now) if e is not None}
        pairs = sorted({(f, t) for f, t, _, _ in now})

        def make(batches):
            total: dict[int, np.ndarray] = {}
            for ids, fold, _, y, x, *_ in batches:
                for f in sorted({f for f, _ in pairs}):
                    on = learned(fold, f)
                    xf, yf, idf = imputed(x[on], g.medians[f]), y[on], ids[on]
                    common = growth.bins_of(xf, edges)
                    for t in [t for h, t in pairs if h == f]:
                        at, w = growth.walk(g.top[f, t], xf), growth.bag(idf, t, g.seed)
                        for node in np.unique(at).tolist():
                            s = slots.get((f, t, node))
                            if s is None:
                                continue
                            here = (at == node) & (w > 0)
                            b = common[here] if s not in own else growth.bins_of(xf[here], own[s])
                            total[s] = total.get(s, 0) + np.stack(growth.node_histograms(b, yf[here] - design_mean, w[here], width))
            yield from total.items()

        design_mean = design.y_mean
        for s, v in design.sums(make).items():
            f, t, node, e = now[s]
            tree, (w, sy) = g.top[f, t], v.reshape(2, 1, d, width)
            feature, last, gain = growth.best_bins(w, sy)
            total = w[0, 0].sum()
            tree["value"][node] = design.y_mean + sy[0, 0].sum() / max(total, 1e-300)
            tree["weight"][node] = total
            if total <= limit or (g.max_depth is not None and tree["depth"][node] >= g.max_depth):
                continue
            mine = e if e is not None else edges
            if feature[0] < 0:
                # every row in one bin of every feature: narrow the bins to it, or stop if it holds one value
                finer = []
                for j in range(d):
                    b = int(np.argmax(w[0, j]))
                    a = mine[j][b - 1] if b else ends[j][0]
                    z = mine[j][b] if b < len(mine[j]) else ends[j][1]
                    finer.append(np.unique(np.linspace(a, z, width + 1)[1:-1]))
                if any(len(x) and not np.array_equal(x, y) for x, y in zip(finer, mine)):
                    open_.append((f, t, node, finer))
                continue
            j, b = int(feature[0]), int(last[0])
            tree["feature"][node], tree["threshold"][node] = j, float(mine[j][b])
            tree["left"][node], tree["gain"][node] = len(tree["left"]), float(gain[0])
            for lw in (w[0, j, :b + 1].sum(), w[0, j, b + 1:].sum()):
                for name, x in (("feature", -1), ("threshold", 0.0), ("left", -1), ("value", 0.0), ("gain", 0.0),
                                ("depth", tree["depth"][node] + 1), ("weight", float(lw))):
                    tree[name].append(x)
                if lw > limit:
                    open_.append((f, t, len(tree["left"]) - 1, e))


def _plan(design: Design, trees: int, seed: int, max_depth: int | None) -> Grower:
    """Grow the tops and number the units: what one task finishes."""
    g = Grower(design.d, design.k, {f: design.medians(f) for f in design.fits}, seed, max_depth)
    limit = TASK_CELLS / (design.d + 2)
    cores = design.spark.sparkContext.defaultParallelism
    if max(design.n.values()) <= limit:
        size = max(1, -(-trees * len(design.fits) // (4 * cores)))
        for f in design.fits:
            for t in range(0, trees, size):
                of = list(range(t, min(t + size, trees)))
                unit = len(g.trees_of)
                g.trees_of[unit] = (f, of, 0, 0)
                g.units.update({(f, x, 0): unit for x in of})
        return g
    _grow_top(design, g, range(trees), bin_edges(design))
    for (f, t), tree in g.top.items():
        for node, feature in enumerate(tree["feature"]):
            if feature < 0:
                unit = g.units[f, t, node] = len(g.trees_of)
                g.trees_of[unit] = (f, [t], node, tree["depth"][node])
    return g


def _routed(df: DataFrame, g: Grower, fits: Sequence[int], train: bool, score: bool) -> DataFrame:
    """``unit, id, y, w, x``: each row for every unit that its values lead to; rows to be scored have ``w`` 0.
    A unit of several trees gets ``w`` 1 and finds the weights itself."""
    d, k = g.design_d, g.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fold, _, y, x = arrays(b, d)
            for f in fits:
                on = (learned(fold, f) if train else np.zeros(len(ids), bool)) | (scored(fold, f, k) if score else False)
                if not on.any():
                    continue
                xf, idf, yf, role = imputed(x[on], g.medians[f]), ids[on], y[on], learned(fold[on], f)

                def out(unit, rows, w):
                    unit = unit if isinstance(unit, np.ndarray) else np.full(len(rows), unit)
                    lists = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * d, xf[rows].ravel())
                    return pa.RecordBatch.from_arrays([pa.array(unit, pa.int64()), pa.array(idf[rows]), pa.array(yf[rows]),
                                                       pa.array(w), lists], names=["unit", "id", "y", "w", "x"])

                for unit in sorted({u for (h, _, node), u in g.units.items() if h == f and (h, _) not in g.top}):
                    yield out(unit, np.arange(len(idf)), role.astype(np.float64))
                for (h, t), tree in g.top.items():
                    if h != f:
                        continue
                    w = np.where(role, growth.bag(idf, t, g.seed), 0.0)
                    rows = np.flatnonzero((w > 0) | ~role)
                    at = growth.walk(tree, xf[rows])
                    unit = np.array([g.units.get((f, t, n), -1) for n in range(len(tree["feature"]))])[at]
                    yield out(unit, rows, w[rows])

    return df.mapInArrow(run, "unit bigint, id bigint, y double, w double, x array<double>")


def _apart(rows: DataFrame, units: int) -> DataFrame:
    """Units spread evenly: hashing a few numbers would put many of them into one task."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(min(max(units, 1), max(width, 4 * rows.sparkSession.sparkContext.defaultParallelism)), "unit")


def _grown(design: Design, g: Grower, score: bool) -> DataFrame:
    """Finish every unit in a task of its own: per scored row the sum of the unit's trees' predictions (``score``),
    else the nodes of its trees. A task holds its rows and one tree: a tree leaves it as soon as it is grown."""
    seed, top_depth, d = g.seed, g.max_depth, design.d
    units = design.spark.sparkContext.broadcast(g.trees_of)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, parts = None, []
        for b in batches:
            if b.num_rows:
                unit = b.column("unit")[0].as_py()
                # copies: a batch would keep all its columns
                parts.append([*(b.column(c).to_numpy(zero_copy_only=False).copy() for c in ("id", "y", "w")), b.column("x").flatten().to_numpy().copy()])
        fit, trees, node, depth = units.value[unit]
        ids, y, w, x = map(np.concatenate, zip(*parts))
        del parts
        order = np.argsort(ids, kind="stable")  # sums do not depend on the order in which rows arrive
        own, rider = order[w[order] > 0], order[w[order] == 0]
        x = x.reshape(len(ids), d)
        held, x = (ids[rider], y[rider], x[rider]), x[own]
        ids, y = ids[own], y[own]
        del order, own, rider, w
        total = np.zeros(len(held[0]))
        for t in trees:
            bag = growth.bag(ids, t, seed)
            if (bag > 0).any():
                tree = growth.grown(x, y, bag, None if top_depth is None else top_depth - depth)
                total += tree["value"][growth.walk(tree, held[2])] if len(total) else 0.0
            else:
                total += y.mean() if len(y) else 0.0
                tree = {"feature": [-1], "threshold": [0.0], "left": [-1], "value": [0.0], "gain": np.zeros(1)}
            if score:
                continue
            f = np.asarray(tree["feature"])
            gains = np.bincount(f[f >= 0], weights=np.asarray(tree["gain"])[f >= 0], minlength=d)
            feature, number = growth.packed(tree)
            del tree, f
            ends = np.append(np.arange(0, len(feature), PIECE, np.int32), np.int32(len(feature)))
            n = len(ends) - 1
            lists = [pa.ListArray.from_arrays(e, pa.array(v)) for e, v in
                     ((ends, feature), (ends, number), (np.append(0, np.full(n, d)).astype(np.int32), gains.astype(np.float64)))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, unit)), pa.array(np.full(n, fit, np.int32)), pa.array(np.full(n, t, np.int32)),
                 pa.array(np.full(n, node)), pa.array(np.arange(n, dtype=np.int32)), *lists],
                names=["unit", "fit", "tree", "node", "part", "feature", "number", "gains"])
        for k in range(0, len(total) if score else 0, BATCH):
            id_, y_, p = (v[k:k + BATCH] for v in (held[0], held[1], total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(p), unit)), pa.array(np.full(len(p), fit, np.int32)), pa.array(id_), pa.array(y_), pa.array(p),
                 pa.array(np.full(len(p), len(trees), np.int32))], names=["unit", "fit", "id", "y", "p", "n"])

    rows = _apart(_routed(design.df, g, design.fits, True, score), len(g.trees_of))
    return rows.groupBy("unit").applyInArrow(finish, _SCORES if score else _NODES)


def forest_predictions(design: Design, trees: int = 300, seed: int = 42, max_depth: int | None = None) -> DataFrame:
    """``model, fit, y, p`` for the rows each fit is scored on; the trees are not kept."""
    grown = _grown(design, _plan(design, trees, seed, max_depth), True)
    return grown.groupBy("fit", "id").agg(F.first("y").alias("y"), (F.sum("p") / F.sum("n")).alias("p")) \
        .select(F.lit("RandomForestRegressor").alias("model"), "fit", "y", "p")


@dataclass
class ForestModel:
    """Median impute -> forest. ``nodes`` is a table with one row per tree and finished node."""

    features: list[str]
    target: str
    medians: list
    trees: int
    seed: int
    fit: int
    nodes: DataFrame
    top: dict            # tree -> the nodes above the finished ones, none where the whole tree is one row
    units: dict          # (tree, node) -> unit

    def _size(self) -> int:
        """Nodes of all trees."""
        return self.nodes.agg(F.sum(F.size("feature")).alias("n")).first()["n"] or 0

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """``df`` with the mean of the trees; features that it lacks are missing values."""
        size = self._size()
        if size * 24 <= SENT_BYTES:
            return self._send_nodes(df, name)
        return self._send_rows(df, name, size)

    def _send_nodes(self, df: DataFrame, name: str) -> DataFrame:
        finished: dict[int, dict[int, dict]] = {}
        pieces: dict[tuple, list] = {}
        for r in self.nodes.select("tree", "node", "part", "feature", "number").orderBy("part").collect():
            pieces.setdefault((r["tree"], r["node"]), []).append((r["feature"], r["number"]))
        for (t, n), some in pieces.items():
            finished.setdefault(t, {})[n] = growth.unpacked(*map(np.concatenate, zip(*some)))
        params = {"medians": self.medians, "top": self.top, "trees": finished}
        return apply_rows(df, self.features, predict_forest, params, name)

    def _send_rows(self, df: DataFrame, name: str, size: int) -> DataFrame:
        rows = materialize(df.drop(name).withColumn("_vl_id", F.monotonically_increasing_id()))
        d = len(self.features)
        nan = F.lit(float("nan"))
        from vatlens.operators.cleaning import to_number
        x = F.array(*[F.coalesce(to_number(F.col(f), rows.schema[f].dataType) if f in rows.columns else nan, nan)
                      for f in self.features]).cast("array<double>")
        g = Grower(d, 1, {1: self.medians}, self.seed, None, {(1, t): v for t, v in self.top.items()},
                   {(1, t, n): u for (t, n), u in self.units.items()})
        unit = F.col("unit")
        if not self.top:
            # trees that were grown together are too many to be held together
            some = max(1, int(HELD_BYTES / (12 * max(size, 1) / self.trees)))
            g.units = {(1, t, n): t // some for t, n in self.units}
            unit = F.floor(F.col("tree") / some).cast("bigint").alias("unit")
        plain = spread(rows).select(F.col("_vl_id").alias("_id"), F.lit(-1).alias("_fold"), F.lit(0).alias("_inner"),
                            F.lit(None).cast("double").alias("_y"), x.alias("_x"))
        # empty lists: each null list costs the writer of a batch the batch's nulls before it
        none = {"tree": F.lit(None).cast("int"), "part": F.lit(None).cast("int"),
                "feature": F.array().cast("array<int>"), "number": F.array().cast("array<double>")}
        sent = _routed(plain, g, [1], False, True).select("unit", "id", "x", *[v.alias(c) for c, v in none.items()])
        nodes = self.nodes.select(unit, F.lit(None).cast("bigint").alias("id"), F.array().cast("array<double>").alias("x"), *none)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A unit's nodes come first and are held, its rows pass by."""
            now, trees, waiting, size = None, {}, [], 0

            def scores() -> pa.RecordBatch:
                ids, v = map(np.concatenate, zip(*waiting))
                v, total = v.reshape(len(ids), d), np.zeros(len(ids))
                for some in trees.values():
                    tree = growth.unpacked(*map(np.concatenate, zip(*some)))
                    total += tree["value"][growth.walk(tree, v)]
                return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total)], names=["_vl_id", "p"])

            for b in batches:
                unit = b.column("unit").to_numpy()
                starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1])) if len(unit) else []
                for k, end in zip(starts, [*starts[1:], len(unit)]):
                    if unit[k] != now or size >= SCORED:
                        if waiting:
                            yield scores()
                        waiting, size = [], 0
                    if unit[k] != now:
                        now, trees = unit[k], {}
                    part = b.slice(k, end - k)
                    nodes = len(part) - part.column("tree").null_count
                    tree = part.column("tree").slice(0, nodes).to_numpy()
                    cuts = [0, *(np.flatnonzero(tree[1:] != tree[:-1]) + 1).tolist(), nodes] if nodes else []
                    for a, z in zip(cuts, cuts[1:]):
                        trees.setdefault(int(tree[a]), []).append([part.column(c).slice(a, z - a).flatten().to_numpy().copy()
                                                                   for c in ("feature", "number")])
                    if nodes < len(part):
                        waiting.append((part.column("id").slice(nodes).to_numpy(), part.column("x").slice(nodes).flatten().to_numpy()))
                        size += len(part) - nodes
            if waiting:
                yield scores()

        both = nodes.unionByName(sent).repartition("unit").sortWithinPartitions("unit", F.col("tree").asc_nulls_last(), "part")
        sums = both.mapInArrow(score, "_vl_id bigint, p double").groupBy("_vl_id").agg((F.sum("p") / F.lit(self.trees)).alias(name))
        return rows.join(sums, "_vl_id", "left").drop("_vl_id")

    def importances(self) -> list[float]:
        """Mean over the trees of each tree's gains as shares, as shares."""
        d = len(self.features)
        top = {t: np.bincount([f for f in v["feature"] if f >= 0], weights=[g for f, g in zip(v["feature"], v["gain"]) if f >= 0],
                              minlength=d) for t, v in self.top.items()}
        sums = self.nodes.select("tree", F.posexplode("gains").alias("j", "g")).groupBy("tree", "j").agg(F.sum("g").alias("g"))
        if top:
            above = sums.sparkSession.createDataFrame([(t, j, float(v[j])) for t, v in top.items() for j in range(d)],
                                                      "tree int, j int, g double")
            sums = sums.unionByName(above).groupBy("tree", "j").agg(F.sum("g").alias("g"))
        whole = sums.groupBy("tree").agg(F.sum("g").alias("s"))
        share = sums.join(whole, "tree").where("s > 0").groupBy("j").agg(F.sum(F.col("g") / F.col("s")).alias("v"))
        got = {r["j"]: r["v"] for r in share.collect()}
        total = sum(got.values())
        return [got.get(j, 0.0) / total if total else 0.0 for j in range(d)]

    def save(self, path: str) -> None:
        """The table of nodes as Parquet, the rest as JSON next to it."""
        self.nodes.write.mode("overwrite").parquet(path + "/nodes")
        meta = {"kind": "forest", "features": self.features, "target": self.target, "medians": self.medians, "trees": self.trees,
                "seed": self.seed, "fit": self.fit, "top": [[t, v] for t, v in self.top.items()],
                "units": [[t, n, u] for (t, n), u in self.units.items()]}
        _write_meta(self.nodes.sparkSession, meta, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ForestModel":
        m = _read_meta(spark, path)
        return ForestModel(m["features"], m["target"], m["medians"], m["trees"], m["seed"], m["fit"],
                           spark.read.parquet(path + "/nodes"), {t: v for t, v in m["top"]},
                           {(t, n): u for t, n, u in m["units"]})


def predict_forest(x: np.ndarray, m: dict) -> np.ndarray:
    x = imputed(x, m["medians"])
    total = np.zeros(len(x))
    for t, finished in m["trees"].items():
        at = growth.walk(m["top"][t], x) if t in m["top"] else np.zeros(len(x), np.int64)
        for node in np.unique(at).tolist():
            here = at == node
            total[here] += finished[node]["value"][growth.walk(finished[node], x[here])]
    return total / max(len(m["trees"]), 1)


def _write_meta(spark: SparkSession, meta: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(path + "/meta")


def _read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path + "/meta").first()["value"])


def fit_forest(df: DataFrame, features: Sequence[str], target: str, trees: int = 300, seed: int = 42,
               max_depth: int | None = None, key: str | None = None) -> ForestModel:
    """L4: all features at every split, bootstrap by Poisson weights, no depth limit unless given."""
    import uuid
    design = Design(df, features, target, key=key)
    g = _plan(design, trees, seed, max_depth)
    path = f"{checkpoint_dir(design.spark)}/forest-{uuid.uuid4().hex}"
    _grown(design, g, False).drop("fit").write.parquet(path)
    fit = design.fits[-1]
    return ForestModel(design.features, target, design.medians(fit), trees, seed, fit, design.spark.read.parquet(path),
                       {t: v for (_, t), v in g.top.items()}, {(t, n): u for (_, t, n), u in g.units.items()})


# ---------------------------------------------------------------- boosting
def _boost_here(design: Design, edges: list, trees: int, depth: int, rate: float) -> dict[int, dict]:
    """Every fit in one task each, for tables whose fits are small."""
    d, k, medians, fits = design.d, design.k, {f: design.medians(f) for f in design.fits}, design.fits

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fold, _, y, x = arrays(b, d)
            for f in fits:
                on = learned(fold, f)
                bins = growth.bins_of(imputed(x[on], medians[f]), edges).astype(np.int16)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(bins), f)), pa.array(ids[on]), pa.array(y[on]),
                     pa.ListArray.from_arrays(np.arange(len(bins) + 1, dtype=np.int32) * d, bins.ravel())], names=["unit", "id", "y", "b"])

    def finish(part: pa.Table) -> pa.Table:
        fit = part.column("unit")[0].as_py()
        ids, y = part.column("id").to_numpy(), part.column("y").to_numpy()
        b = part.column("b").combine_chunks().flatten().to_numpy().reshape(len(y), d).astype(np.int64)
        order = np.argsort(ids, kind="stable")
        y, b = y[order], b[order]
        start = float(y.mean())
        rest = y - start

        def histogram(wanted, now):
            at = growth.heap_node(now[fit], b)
            got = [growth.node_histograms(b[at == n], rest[at == n], np.ones(int((at == n).sum())), BINS) for _, n in wanted]
            return [np.array(v) for v in zip(*got)]

        def done(now):
            nonlocal rest
            rest = rest - rate * now[fit]["value"][growth.heap_node(now[fit], b)]

        m = growth.boost([fit], histogram, done, trees, depth)[fit]
        return pa.table([pa.array([fit]), pa.array([start]), *[pa.array([m[c].ravel().astype(np.float64)], pa.list_(pa.float64()))
                                                               for c in ("feature", "last", "value", "gain")]],
                        names=["unit", "start", "feature", "last", "value", "gain"])

    sent = _apart(design.df.where("_fold >= 0").mapInArrow(route, "unit bigint, id bigint, y double, b array<smallint>"), len(fits))
    rows = sent.groupBy("unit").applyInArrow(
        finish, "unit bigint, start double, feature array<double>, last array<double>, value array<double>, gain array<double>").collect()
    return {r["unit"]: {"start": r["start"], **{c: np.array(r[c]).reshape(trees, -1).astype(np.int64 if c in ("feature", "last") else float)
                                                for c in ("feature", "last", "value", "gain")}} for r in rows}


def _boost_passes(design: Design, edges: list, trees: int, depth: int, rate: float) -> dict[int, dict]:
    """Every level of every fit's tree is one pass over the table."""
    medians, fits = {f: design.medians(f) for f in design.fits}, design.fits
    means = {s: v[0] / v[1] for s, v in design.sums(_fold_sums(fits)).items()}
    rows = design.df.where("_fold >= 0").withColumn("_r", F.array(*[F.col("_y") - F.lit(means[f]) for f in fits]))
    state = {"rows": materialize(rows), "since": {f: [] for f in fits}, "count": 0}

    def residuals(x, rest, f, since):
        b = growth.bins_of(imputed(x, medians[f]), edges)
        for tree in since[f]:
            rest = rest - rate * tree["value"][growth.heap_node(tree, b)]
        return b, rest

    def histogram(wanted, now):
        since = state["since"]

        def make(batches):
            total: dict[int, np.ndarray] = {}
            for _, fold, _, _, x, r in batches:
                r = r.flatten().to_numpy().reshape(len(fold), len(fits))
                for i, f in enumerate(fits):
                    nodes = [(s, n) for s, (g, n) in enumerate(wanted) if g == f]
                    if not nodes:
                        continue
                    on = learned(fold, f)
                    b, rest = residuals(x[on], r[on, i], f, since)
                    at = growth.heap_node(now[f], b)
                    for s, n in nodes:
                        here = at == n
                        total[s] = total.get(s, 0) + np.stack(growth.node_histograms(b[here], rest[here], np.ones(int(here.sum())), BINS))
            yield from total.items()

        got = design.sums(make, state["rows"])
        empty = np.zeros(2 * design.d * BINS)
        v = np.array([got.get(s, empty) for s in range(len(wanted))]).reshape(len(wanted), 2, design.d, BINS)
        return [v[:, 0], v[:, 1]]

    def done(now):
        for f in fits:
            state["since"][f] = [*state["since"][f], {c: now[f][c] for c in ("feature", "last", "value")}]
        state["count"] += 1
        if state["count"] % KEEP or state["count"] >= trees:
            return
        since, d = state["since"], design.d

        def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, _, _, _, x = arrays(batch, d)
                r = batch.column(5).flatten().to_numpy().reshape(len(x), len(fits))
                r = np.column_stack([residuals(x, r[:, i], f, since)[1] for i, f in enumerate(fits)])
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(fits), r.ravel())
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], lists], names=batch.schema.names)

        state["rows"] = materialize(state["rows"].mapInArrow(update, state["rows"].schema))
        state["since"] = {f: [] for f in fits}

    out = growth.boost(fits, histogram, done, trees, depth)
    return {f: {"start": means[f], **m} for f, m in out.items()}


def _fold_sums(fits):
    def make(batches):
        total = {f: np.zeros(2) for f in fits}
        for _, fold, _, y, *_ in batches:
            for f in fits:
                on = learned(fold, f)
                total[f] += [y[on].sum(), on.sum()]
        yield from total.items()
    return make


def boosted(design: Design, trees: int = 100, depth: int = 3, rate: float = 0.1) -> dict[int, dict]:
    """Parameters of ``predict_boosted`` for every fit."""
    edges = bin_edges(design)
    small = max(design.n.values()) <= TASK_CELLS / (design.d + 2)
    found = (_boost_here if small else _boost_passes)(design, edges, trees, depth, rate)
    return {f: {"medians": design.medians(f), "edges": edges, "rate": rate, **m} for f, m in found.items()}


def predict_boosted(x: np.ndarray, m: dict) -> np.ndarray:
    b = growth.bins_of(imputed(x, m["medians"]), m["edges"])
    return m["start"] + m["rate"] * growth.heap_values(m, b)


@dataclass
class BoostedModel:
    """Median impute -> boosted trees; small (depth bounds a tree), so it travels with the scoring plan."""

    features: list[str]
    target: str
    params: dict

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return apply_rows(df, self.features, predict_boosted, self.params, name)

    def importances(self) -> list[float]:
        """Mean over the trees of each tree's gains as shares, as shares."""
        p, d = self.params, len(self.features)
        total = np.zeros(d)
        for f, g in zip(p["feature"], p["gain"]):
            v = np.bincount(f[f >= 0], weights=g[f >= 0], minlength=d)
            total += v / v.sum() if v.sum() else 0.0
        return (total / total.sum()).tolist() if total.sum() else total.tolist()

    def save(self, path: str) -> None:
        """The parameters as JSON."""
        p = {k: v.tolist() if isinstance(v, np.ndarray) else [e.tolist() for e in v] if k == "edges" else v
             for k, v in self.params.items()}
        _write_meta(SparkSession.getActiveSession(), {"kind": "boosted", "features": self.features, "target": self.target, "params": p}, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "BoostedModel":
        m = _read_meta(spark, path)
        p = {k: [np.array(e) for e in v] if k == "edges" else np.array(v) if k in ("feature", "last", "value", "gain") else v
             for k, v in m["params"].items()}
        return BoostedModel(m["features"], m["target"], p)


def fit_boosted(df: DataFrame, features: Sequence[str], target: str, trees: int = 100, depth: int = 3,
                rate: float = 0.1) -> BoostedModel:
    """Least-squares boosting of depth-limited trees over binned features."""
    design = Design(df, features, target)
    return BoostedModel(design.features, target, boosted(design, trees, depth, rate)[design.fits[-1]])
