"""Quality classifier: ridge regression on random Fourier features.

Each text is described by statistics of its signs, words and lines. Random
Fourier features of the standardised statistics approximate a Gaussian kernel;
every task sums the normal equations of its rows, Spark adds the sums up, and
the driver solves one small system. Scores that a fold's rows get from the other
folds' equations are binned and calibrated by isotonic regression.

All labelled rows outside the held-out part are learned from. What reaches the
driver is fixed by the number of features and bins.

Defined results: null is an empty text and gets a score like any other; a
doc_id labelled more than once has label 1 if any row says so; null labels are
not learned from; without labels every score is 0, with one class its share;
repeated rows each get their row.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vatlens.llm.common import field, held_out, isotonic, labels_of, map_texts, remainder, saved

FEATURES, WIDTH, RIDGE, FOLDS, SEED, THRESHOLD = 384, 4.0, 1e-3, 3, 20240, 0.7
#: Out-of-fold scores are binned to this many steps per unit for the calibration.
BINS = 500

_KIND = np.zeros(256, np.int64)  # sign classes by byte
for _at, _signs in enumerate([b"", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r\t", b"!?",
                              b"|", b"#*$%&<>", b".,;:", b"()[]{}\"'", b"@/\\_=+~^`-"]):
    _KIND[list(_signs)] = _at
_KIND[128:] = 11
N_KINDS = 12


def statistics(text) -> list[float]:
    """The statistics of one text; an empty text has all zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return [0.0] * N_STATS
    kinds = np.bincount(_KIND, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256),
                        minlength=N_KINDS) / len(raw)
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    same = sum(a == b for a, b in zip(words, words[1:]))
    return [*np.sqrt(kinds[1:]).tolist(), np.log1p(n), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
            len(counts) / n, max(counts.values()) / n, pairs / max(n - 1, 1), same / max(n - 1, 1),
            len(set(lines)) / len(lines), np.log1p(n / len(lines)),
            len(zlib.compress(raw, 1)) / len(raw),
            (len(counts) / n) * np.log1p(n), (lengths <= 3).mean()]


N_STATS = N_KINDS - 1 + 13


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, stats`` for every row."""
    return map_texts(docs, ["doc_id"], [field("stats", "array<double>")],
                     lambda: lambda texts: [[statistics(t) for t in texts]])


def _waves() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.normal(size=(N_STATS, FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES)


def _fourier(stats: np.ndarray, model: dict) -> np.ndarray:
    """Standardised statistics, their Fourier features and a constant."""
    x = np.clip((stats - model["mean"]) / model["std"], -5, 5)
    w, phase = _waves()
    return np.hstack([np.cos(x @ w + phase) * np.sqrt(2 / FEATURES), x / 10, np.ones((len(x), 1))])


def _stack(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, N_STATS)


def fit(stats: DataFrame, labels: DataFrame) -> dict:
    """Standardisation, weights and calibration."""
    learn = saved(stats.where(remainder(4) != 2).join(labels_of(labels, "quality"), "doc_id")
                  .select("stats", "label", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")),
                  "learn")
    if learn.take(1) == []:
        return {"x": [0.0], "y": [0.0], "weights": None}
    row = learn.select(array_to_vector("stats").alias("v")).agg(
        vector_to_array(Summarizer.mean(F.col("v"))).alias("mean"),
        vector_to_array(Summarizer.std(F.col("v"))).alias("std")).first()
    std = np.nan_to_num(np.array(row["std"]))
    model = {"mean": np.array(row["mean"]), "std": np.where(std > 1e-9, std, 1.0)}

    def sums(batches):
        """Rows of Z'[Z y n] per fold, summed over the partition."""
        total = {}
        for b in batches:
            x, y, fold = _stack(b.column(0)), np.asarray(b.column(1), float), np.asarray(b.column(2))
            z = _fourier(x, model)
            for f in np.unique(fold):
                at = fold == f
                part = z[at].T @ np.hstack([z[at], y[at, None]])
                total[f] = total.get(f, 0) + part
        for f, part in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(part), f, np.int32)), pa.array(np.arange(len(part), dtype=np.int32)),
                 pa.array(list(part), pa.list_(pa.float64()))], names=["fold", "i", "row"])

    summed = learn.mapInArrow(sums, "fold int, i int, row array<double>") \
        .groupBy("fold", "i").agg(vector_to_array(Summarizer.sum(array_to_vector("row"))).alias("row")).collect()
    size = FEATURES + N_STATS + 1
    folds = np.zeros((FOLDS, size, size + 1))
    for r in summed:
        folds[r["fold"], r["i"]] = r["row"]

    def solve(m: np.ndarray) -> np.ndarray:
        n = max(m[-1, -2], 1.0)  # the constant's own sum counts rows
        penalty = np.eye(size) * RIDGE * n
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(m[:, :-1] + penalty, m[:, -1])

    model["weights"] = solve(folds.sum(0))
    without = np.stack([solve(folds.sum(0) - f) for f in folds])

    def unseen(batches):
        for b in batches:
            z, fold = _fourier(_stack(b.column(0)), model), np.asarray(b.column(2))
            raw = np.einsum("ij,ij->i", z, without[fold])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.round(np.clip(raw, -1, 2) * BINS).astype(np.int64)), b.column(1)], names=["bin", "label"])

    bins = learn.mapInArrow(unseen, "bin bigint, label int").groupBy("bin").agg(
        F.count("*").alias("n"), F.sum("label").alias("pos")).orderBy("bin").collect()
    x, y = isotonic([r["bin"] / BINS for r in bins], [r["pos"] for r in bins], [r["n"] for r in bins])
    return model | {"x": x, "y": y}


def scored(stats: DataFrame, model: dict) -> DataFrame:
    """``doc_id, score``: calibrated scores, straight lines between the isotonic steps."""
    kind = stats.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            if model["weights"] is None:
                out = np.zeros(b.num_rows)
            else:
                out = np.interp(_fourier(_stack(b.column(1)), model) @ model["weights"], model["x"], model["y"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], names=["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    stats = saved(described(docs), "stats")
    return scored(stats, fit(stats, labels)).select(
        "doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
