"""Support-vector regression with an RBF kernel (L6): random Fourier features, epsilon-insensitive loss.

The primal problem ``|w|^2 / 2 + C sum max(0, |y - w z - b| - eps)`` over the Fourier features z of the
standardised inputs is solved by Newton steps on a loss whose two corners are rounded over a width that
shrinks when its optimum is near. A step needs sums over the rows only (loss, gradient, Hessian of the rows on a rounded corner):
tasks add them up, Spark sums them, the driver solves systems of the number of features.

The slopes of the rounded loss are multipliers of the dual problem; scaled so that they balance, they are
feasible, so every step knows a bound below the optimum. The fit ends when the gap between the two is less
than ``TOLERANCE`` of the objective, and the model reports it.
"""

from __future__ import annotations

import json
import math
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from vatlens.operators.growth import imputed
from vatlens.plans import linear
from vatlens.plans.design import Design, apply_rows, arrays, learned

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Duality gap, as a share of the objective, at which a fit ends, and steps after which it ends anyway.
TOLERANCE, STEPS = 1e-3, 300
#: Factor by which the rounding narrows when its optimum is near.
NARROW = 0.2
#: Newton decrement, as a share of the tolerance, below which it is near; only then are the multipliers good.
SETTLED = 0.02
#: Values (rows x Fourier features) of a fit that one task solves.
TASK_CELLS = 16_000_000


def fourier(x: np.ndarray, m: dict) -> np.ndarray:
    """``sqrt(2/D) cos(W z + b)`` of the imputed, standardised rows."""
    std = np.array(m["stds"])
    z = np.where(std > 0, (imputed(x, m["medians"]) - m["means"]) / np.where(std > 0, std, 1.0), 0.0)
    w = np.asarray(m["W"])
    return math.sqrt(2.0 / len(w)) * np.cos(z @ w.T + m["phase"])


def sums_at(z: np.ndarray, y: np.ndarray, v: np.ndarray, width: float, eps: float) -> np.ndarray:
    """What a step needs of some rows, per unit of C: the loss and the rounded loss; the balance, targets and
    features weighted by the positive, then by the negative slopes; the Hessian (features, then the constant).

    The rounded loss is ``width (log(1 + exp((r - eps) / width)) + log(1 + exp((-r - eps) / width)))``.
    """
    r = y - z @ v[:-1] - v[-1]
    high, low = (r - eps) / width, (-r - eps) / width
    up, down = 0.5 * (1 + np.tanh(high / 2)), 0.5 * (1 + np.tanh(low / 2))
    out = [np.array([np.maximum(np.abs(r) - eps, 0).sum(), width * (np.logaddexp(0, high) + np.logaddexp(0, low)).sum()])]
    for a in (np.maximum(up - down, 0.0), np.maximum(down - up, 0.0)):
        out.append(np.concatenate([[a.sum(), a @ y], a @ z]))
    curve = (up * (1 - up) + down * (1 - down)) / width
    on = curve > 1e-12 / width
    zo = np.column_stack([z[on], np.ones(int(on.sum()))])
    out.append(((zo * curve[on, None]).T @ zo).ravel())
    return np.concatenate(out)


def solve(fits: list[int], size: int, starts: dict[int, tuple[float, float]], evaluate: Callable, c: float, eps: float) -> dict:
    """Newton steps of all fits side by side. ``evaluate({fit: (v, width)})`` gives each fit's sums;
    ``starts`` the mean and deviation of its targets. Returns ``{fit: (v, objective, gap share, steps)}``."""
    state = {f: {"v": None, "trial": np.append(np.zeros(size), starts[f][0]), "width": max(starts[f][1], eps, 1e-9),
                 "value": math.inf, "t": 1.0, "step": None, "slope": 0.0, "best": (math.inf, None, math.inf), "lower": -math.inf} for f in fits}
    out: dict[int, tuple] = {}
    for k in range(1, STEPS + 1):
        open_ = [f for f in fits if f not in out]
        if not open_:
            break
        got = evaluate({f: (state[f]["trial"], state[f]["width"]) for f in open_})
        for f in open_:
            s, e = state[f], got[f]
            v, w = s["trial"], s["trial"][:-1]
            loss, rounded, up, down = e[0], e[1], e[2:size + 4], e[size + 4:2 * size + 6]
            objective, value = w @ w / 2 + c * loss, w @ w / 2 + c * rounded
            # multipliers balanced by scaling down the heavier side
            p, n = (min(1.0, b[0] / a[0]) if a[0] > 0 else 0.0 for a, b in ((up, down), (down, up)))
            dual_w = c * (p * up[2:] - n * down[2:])
            dual = c * (p * up[1] - n * down[1]) - dual_w @ dual_w / 2 - eps * c * (p * up[0] + n * down[0])
            s["lower"] = max(s["lower"], dual)
            if objective < s["best"][0]:
                s["best"] = (objective, v)
            gap = (s["best"][0] - s["lower"]) / max(abs(s["best"][0]), 1e-9)
            if gap < TOLERANCE or k == STEPS:
                out[f] = (s["best"][1], s["best"][0], gap, k)
                continue
            if s["step"] is not None and value > s["value"] + 1e-4 * s["t"] * s["slope"] + 1e-12 * abs(value):
                s["t"] /= 4
                if s["t"] < 1e-9:  # no descent left in these numbers: go on with a narrower rounding
                    s.update(width=s["width"] * NARROW, trial=s["v"], step=None, t=1.0)
                else:
                    s["trial"] = s["v"] + s["t"] * s["step"]
                continue
            g = np.append(w - c * (up[2:] - down[2:]), -c * (up[0] - down[0]))
            h = c * e[2 * size + 6:].reshape(size + 1, size + 1)
            h[np.arange(size), np.arange(size)] += 1.0
            h[size, size] += 1e-9 * (1.0 + h[size, size])
            step = -np.linalg.solve(h, g)
            slope = float(g @ step)
            balanced = abs(up[0] - down[0]) <= 0.1 * TOLERANCE * (up[0] + down[0])
            if balanced and -slope < SETTLED * TOLERANCE * abs(value) + 1e-300:
                # near this width's optimum: what is left of the gap is the rounding
                s.update(v=v, width=s["width"] * NARROW, trial=v, step=None, t=1.0)
            else:
                s.update(v=v, value=value, step=step, slope=slope, t=1.0, trial=v + step)
    return out


def fit_kernels(design: Design, components: int = 100, gamma: float | None = None, c: float = 10.0, eps: float = 0.1,
                seed: int = 42) -> dict[int, dict]:
    """Parameters of ``predict_kernel`` for every fit. ``gamma`` defaults to 1 / features, which on standardised
    features is one over features times variance."""
    d, fits = design.d, design.fits
    rng = np.random.default_rng(seed)
    weights = rng.normal(0.0, math.sqrt(2.0 * (gamma if gamma is not None else 1.0 / max(d, 1))), size=(components, d))
    phase = rng.uniform(0.0, 2.0 * math.pi, size=components)
    prep, starts = {}, {}
    for f, cells in design.moments().items():
        n, mean, m = _whole(cells)
        deviation = np.sqrt(np.maximum(np.diag(m), 0) / n)
        prep[f] = {"medians": design.medians(f), "means": mean[:d].tolist(), "stds": deviation[:d].tolist(),
                   "W": weights.tolist(), "phase": phase.tolist()}
        starts[f] = (float(mean[d]), float(deviation[d]))
    if max(design.n.values()) * components <= TASK_CELLS:
        found = _solve_here(design, prep, starts, components, c, eps)
    else:
        def evaluate(points):
            def make(batches):
                total: dict[int, np.ndarray] = {}
                for _, fold, _, y, x, *_ in batches:
                    for f, (v, width) in points.items():
                        on = learned(fold, f)
                        if on.any():
                            total[f] = total.get(f, 0) + sums_at(fourier(x[on], prep[f]), y[on], v, width, eps)
                yield from total.items()
            return design.sums(make)
        found = solve(fits, components, starts, evaluate, c, eps)
    return {f: {**prep[f], "w": v[:-1].tolist(), "b": float(v[-1]), "objective": float(o), "gap": float(g), "steps": int(k)}
            for f, (v, o, g, k) in found.items()}


def _whole(cells: dict) -> tuple:
    p = len(next(iter(cells.values()))[1])
    total = (0, np.zeros(p), np.zeros((p, p)))
    for m in cells.values():
        total = linear._merge(total, m)
    return total


def _solve_here(design: Design, prep: dict, starts: dict, size: int, c: float, eps: float) -> dict:
    """Every fit in one task each, for tables whose fits are small."""
    from vatlens.plans.trees import _apart
    d, fits = design.d, design.fits

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, fold, _, y, x = arrays(b, d)
            for f in fits:
                on = learned(fold, f)
                lists = pa.ListArray.from_arrays(np.arange(int(on.sum()) + 1, dtype=np.int32) * d, x[on].ravel())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(on.sum()), f)), pa.array(ids[on]), pa.array(y[on]), lists],
                                                 names=["unit", "id", "y", "x"])

    def finish(part: pa.Table) -> pa.Table:
        f = part.column("unit")[0].as_py()
        order = np.argsort(part.column("id").to_numpy(), kind="stable")
        y = part.column("y").to_numpy()[order]
        x = part.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), d)[order]
        z = fourier(x, prep[f])
        v, objective, gap, steps = solve([f], size, starts, lambda at: {f: sums_at(z, y, *at[f], eps)}, c, eps)[f]
        return pa.table([pa.array([f]), pa.array([v.tolist()], pa.list_(pa.float64())), pa.array([float(objective)]),
                         pa.array([float(gap)]), pa.array([steps])], names=["unit", "v", "objective", "gap", "steps"])

    sent = _apart(design.df.where("_fold >= 0").mapInArrow(route, "unit bigint, id bigint, y double, x array<double>"), len(fits))
    rows = sent.groupBy("unit").applyInArrow(finish, "unit bigint, v array<double>, objective double, gap double, steps bigint").collect()
    return {r["unit"]: (np.array(r["v"]), r["objective"], r["gap"], r["steps"]) for r in rows}


def predict_kernel(x: np.ndarray, m: dict) -> np.ndarray:
    return fourier(x, m) @ np.array(m["w"]) + m["b"]


@dataclass
class KernelModel:
    """Median impute -> scale -> Fourier features -> support-vector regression."""

    features: list[str]
    target: str
    params: dict

    def transform(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return apply_rows(df, self.features, predict_kernel, self.params, name)

    def save(self, path: str) -> None:
        """The parameters as JSON."""
        meta = {"kind": "kernel", "features": self.features, "target": self.target, "params": self.params}
        SparkSession.getActiveSession().createDataFrame([(json.dumps(meta),)], "meta string") \
            .coalesce(1).write.mode("overwrite").text(path + "/meta")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "KernelModel":
        m = json.loads(spark.read.text(path + "/meta").first()["value"])
        return KernelModel(m["features"], m["target"], m["params"])


def fit_svr(df: DataFrame, features: Sequence[str], target: str, components: int = 100, gamma: float | None = None,
            c: float = 10.0, eps: float = 0.1, seed: int = 42) -> KernelModel:
    """RBF support-vector regression (C 10, epsilon 0.1 unless given) on random Fourier features."""
    design = Design(df, features, target)
    return KernelModel(design.features, target, fit_kernels(design, components, gamma, c, eps, seed)[design.fits[-1]])
