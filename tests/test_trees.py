"""Forest, boosting and support-vector regression against plain versions; plans by pass and by task agree."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vatlens.operators import growth, summary
from vatlens.plans import design, linear, models, svr, trees
from vatlens.plans.design import Design

RNG = np.random.default_rng(11)
N = 400
X = np.column_stack([RNG.normal(size=N).round(1), RNG.integers(0, 9, N).astype(float), RNG.exponential(size=N)])
Y = np.sin(2 * X[:, 0]) * 3 + X[:, 1] + RNG.normal(scale=0.3, size=N)
HOLES = RNG.random((N, 3)) < 0.1
NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rows = [(i, *[None if HOLES[i, j] else float(X[i, j]) for j in range(3)], float(Y[i]), int(i % 4)) for i in range(N)]
    rows += [(N, 1.0, 1.0, 1.0, None, 0)]  # no target: not learned from
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double, fold int").repartition(5)


def holes(rows=slice(None)):
    med = np.array([np.median(X[rows][~HOLES[rows][:, j], j]) for j in range(3)])
    return np.where(HOLES, med, X), med


def exact_tree(x, y, w, depth=None):
    """Nested (feature, threshold, left, right) or a mean: every feature, every midpoint."""
    def build(rows, left):
        mean = np.average(y[rows], weights=w[rows])
        best = None
        if len(set(y[rows])) > 1 and left != 0:
            for j in range(x.shape[1]):
                v = np.unique(x[rows, j])
                for a, b in zip(v, v[1:]):
                    t = a + (b - a) / 2
                    low, high = rows[x[rows, j] <= t], rows[x[rows, j] > t]
                    loss = sum((w[p] * (y[p] - np.average(y[p], weights=w[p])) ** 2).sum() for p in (low, high))
                    if best is None or loss < best[0] - 1e-10:
                        best = (loss, j, t, low, high)
        if best is None:
            return mean
        return (best[1], best[2], build(best[3], None if left is None else left - 1), build(best[4], None if left is None else left - 1))
    return build(np.flatnonzero(w > 0), depth)


def follow(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("depth", [None, 1, 3])
def test_a_grown_tree_is_the_exact_one(depth):
    for seed in range(6):
        rng = np.random.default_rng(seed)
        x, y, w = rng.normal(size=(50, 2)).round(1), rng.normal(size=50).round(2), rng.poisson(1, 50).astype(float)
        tree, at = growth.grow(x, y, w, depth)
        exact = exact_tree(x, y, w, depth)
        assert np.array_equal(growth.walk(tree, x), at)
        on = w > 0
        np.testing.assert_allclose(tree["value"][at][on], [follow(exact, r) for r in x[on]], atol=1e-12)


def test_bootstrap_weights_are_poisson():
    w = np.array([growth.bag(np.arange(20_000), t, 42) for t in range(5)])
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03 and abs(np.corrcoef(w[0], w[1])[0, 1]) < 0.03
    assert np.array_equal(w[2], growth.bag(np.arange(20_000), 2, 42)) and not np.array_equal(w[2], growth.bag(np.arange(20_000), 2, 7))


def test_a_forest_is_the_mean_of_exact_trees(spark, data):
    model = models.fit_tree(data, NAMES, "y", "rf", num_trees=6, key="id")
    got = {r["id"]: r["prediction"] for r in model.transform(data).collect()}
    ids = {r["id"]: r["h"] for r in data.select("id", F.xxhash64("id").alias("h")).collect()}
    x, _ = holes()
    h = np.array([ids[i] for i in range(N)])
    want, shares = np.zeros(N), np.zeros(3)
    for t in range(6):
        tree = exact_tree(x, Y, growth.bag(h, t, 42))
        want += [follow(tree, r) / 6 for r in x]
        nodes, _ = growth.grow(x, Y, growth.bag(h, t, 42))
        gain = np.bincount(nodes["feature"][nodes["feature"] >= 0], weights=nodes["gain"][nodes["feature"] >= 0], minlength=3)
        shares += gain / gain.sum() / 6
    np.testing.assert_allclose([got[i] for i in range(N)], want, atol=1e-9)
    np.testing.assert_allclose(model.importances(), shares, atol=1e-9)
    no_depth_limit = model.nodes.agg(F.max(F.size("feature"))).first()[0]
    assert no_depth_limit > 2 * 0.5 * N  # nearly a leaf per row


def test_rows_may_go_to_the_nodes_or_nodes_to_the_rows(spark, data, monkeypatch, tmpdir_spark):
    model = models.fit_tree(data, NAMES, "y", "rf", num_trees=5, key="id")
    model.save(tmpdir_spark + "/forest")
    sent = {r["id"]: r["prediction"] for r in model.transform(data).collect()}
    monkeypatch.setattr(trees, "SENT_BYTES", 0)
    back = trees.ForestModel.load(spark, tmpdir_spark + "/forest")
    moved = back.transform(data.drop("prediction"))
    assert moved.columns == [*data.columns, "prediction"]
    assert all(abs(sent[r["id"]] - r["prediction"]) < 1e-9 for r in moved.collect())
    assert model.transform(data.drop("a")).where("prediction is null").count() == 0  # a missing feature is its median


def test_tops_grown_by_passes(spark, data, monkeypatch):
    whole = models.fit_tree(data, NAMES, "y", "rf", num_trees=5, key="id")
    monkeypatch.setattr(trees, "TASK_CELLS", 60 * 5)  # 60 rows a task
    split = models.fit_tree(data, NAMES, "y", "rf", num_trees=5, key="id")
    assert split.top and len(split.units) > 25
    a, b = (summary.regression_metrics(m.transform(data), "y", "prediction").first()["r2"] for m in (whole, split))
    assert abs(a - b) < 0.02 and min(a, b) > 0.95
    np.testing.assert_allclose(split.importances(), whole.importances(), atol=0.1)
    monkeypatch.setattr(trees, "SENT_BYTES", 0)
    c = summary.regression_metrics(split.transform(data), "y", "prediction").first()["r2"]
    assert abs(b - c) < 1e-9


def test_equal_rows_beyond_a_task_end_in_a_leaf(spark, monkeypatch):
    monkeypatch.setattr(trees, "TASK_CELLS", 10 * 3)
    df = spark.createDataFrame([(i, 1.0 if i < 150 else 1.0 + 1e-6, float(i % 2)) for i in range(200)], "id long, x double, y double")
    model = models.fit_tree(df, ["x"], "y", "rf", num_trees=2, key="id")
    assert model.transform(df).where("prediction between 0.2 and 0.8").count() == 200


def exact_boost(b, y, rounds, depth, rate):
    start = y.mean()
    f = np.full(len(y), start)

    def fit(rows, r, left):
        best = None
        if left:
            for j in range(b.shape[1]):
                for t in np.unique(b[rows, j])[:-1]:
                    low, high = rows[b[rows, j] <= t], rows[b[rows, j] > t]
                    gain = r[low].sum() ** 2 / len(low) + r[high].sum() ** 2 / len(high) - r[rows].sum() ** 2 / len(rows)
                    if best is None or gain > best[0] + 1e-9:
                        best = (gain, low, high)
        if best is None or best[0] <= 1e-9:
            f[rows] += rate * r[rows].mean()
        else:
            fit(best[1], r, left - 1), fit(best[2], r, left - 1)

    for _ in range(rounds):
        fit(np.arange(len(y)), y - f, depth)
    return f


def test_boosting_is_the_exact_booster(spark, data, monkeypatch):
    model = models.fit_tree(data, NAMES, "y", "gbt", num_trees=25)
    got = {r["id"]: r["prediction"] for r in model.transform(data).collect()}
    x, _ = holes()
    want = exact_boost(growth.bins_of(x, model.params["edges"]), Y, 25, 3, 0.1)
    np.testing.assert_allclose([got[i] for i in range(N)], want, atol=1e-8)
    monkeypatch.setattr(trees, "TASK_CELLS", 0)
    monkeypatch.setattr(trees, "KEEP", 4)
    passes = models.fit_tree(data, NAMES, "y", "gbt", num_trees=9)
    here = {r["id"]: r["prediction"] for r in passes.transform(data).collect()}
    want = exact_boost(growth.bins_of(x, model.params["edges"]), Y, 9, 3, 0.1)
    np.testing.assert_allclose([here[i] for i in range(N)], want, atol=1e-8)
    assert abs(sum(model.importances()) - 1) < 1e-9


def test_boosted_models_are_saved(spark, data, tmpdir_spark):
    model = models.fit_tree(data, NAMES, "y", "gbt", num_trees=5)
    model.save(tmpdir_spark + "/boosted")
    back = trees.BoostedModel.load(spark, tmpdir_spark + "/boosted")
    a, b = (sorted((r["id"], r["prediction"]) for r in m.transform(data).collect()) for m in (model, back))
    assert a == b


def test_leave_one_out_medians(spark, data):
    d = Design(data, NAMES, "y", "fold", 4)
    for f in range(5):
        rows = np.arange(N) % 4 != f
        np.testing.assert_allclose(d.medians(f), holes(rows)[1], atol=1e-12)
    one = Design(data.limit(1), ["a", "nothing"], "y")
    assert one.medians(1)[1] is None


def test_moments_are_those_of_each_training_set(spark, data):
    d = Design(data, NAMES, "y", "fold", 4)
    for f, cells in d.moments().items():
        rows = np.arange(N) % 4 != f
        x, _ = holes(rows)
        v = np.column_stack([x, Y])[rows]
        n, mean, m = cells[0]
        np.testing.assert_allclose(mean, v.mean(0), atol=1e-10)
        np.testing.assert_allclose(m, (v - v.mean(0)).T @ (v - v.mean(0)), atol=1e-7)
        assert n == rows.sum()


def test_cross_validated_linear_model(data):
    got = {r["fold"]: r["r2"] for r in linear.cross_validate(data, NAMES, "y", "fold").collect()}
    for f in range(4):
        rows = np.arange(N) % 4 != f
        x, _ = holes(rows)
        a = np.column_stack([np.ones(N), x])
        e = Y - a @ np.linalg.lstsq(a[rows], Y[rows], rcond=None)[0]
        assert got[f] == pytest.approx(1 - (e[~rows] ** 2).sum() / ((Y[~rows] - Y[~rows].mean()) ** 2).sum(), abs=1e-9)


def test_folds_are_fitted_as_alone(spark, data):
    """One table for all folds gives what a fit of each training set alone gives."""
    got = {(r["model"], r["fold"]): r["r2"] for r in
           models.cross_validate(data, NAMES, "y", "fold", num_trees=8, key="id").collect()}
    train, hold = data.where("fold != 2"), data.where("fold = 2")
    for name, m in (("GradientBoostingRegressor", None), ("RandomForestRegressor", models.fit_tree(train, NAMES, "y", "rf", num_trees=8, key="id")),
                    ("SVR", svr.fit_svr(train, NAMES, "y"))):
        if m is not None:
            alone = summary.regression_metrics(m.transform(hold), "y", "prediction").first()["r2"]
            assert got[name, 2] == pytest.approx(alone, abs=2e-3)
    assert len(got) == 20 and all(v > 0.5 for (m, _), v in got.items() if m not in ("LinearRegression", "RidgeCV"))


def test_leaderboard(spark, data):
    train, test = data.where("fold < 3"), data.where("fold = 3")
    board = models.leaderboard(train, test, NAMES, "y", "id", num_trees=10)
    rows = board.collect()
    assert sorted(r["model"] for r in rows) == sorted(models.MODEL_NAMES)
    assert [r["test_r2"] for r in rows] == sorted((r["test_r2"] for r in rows), reverse=True)
    linear_row = next(r for r in rows if r["model"] == "LinearRegression")
    m = linear.fit_linear(train, NAMES, "y")
    alone = summary.regression_metrics(m.transform(test), "y", "prediction").first()
    assert linear_row["test_rmse"] == pytest.approx(alone["rmse"], abs=1e-9)
    assert models.best_model(board).first()["best_model"] == rows[0]["model"]


@pytest.mark.parametrize("cells", [svr.TASK_CELLS, 0])
def test_svr_ends_near_the_optimum(spark, data, monkeypatch, cells):
    monkeypatch.setattr(svr, "TASK_CELLS", cells)
    model = svr.fit_svr(data, NAMES, "y", components=40, c=2.0, eps=0.2)
    p = model.params
    assert p["gap"] < svr.TOLERANCE and p["steps"] < svr.STEPS
    x, med = holes()
    np.testing.assert_allclose(p["medians"], med, atol=1e-12)
    z = svr.fourier(x, p)
    w = np.array(p["w"])

    def primal(w, b):
        return w @ w / 2 + 2.0 * np.maximum(np.abs(Y - z @ w - b) - 0.2, 0).sum()
    assert primal(w, p["b"]) == pytest.approx(p["objective"], rel=1e-9)
    # a long subgradient descent from there finds nothing better than the gap allows
    v, best = np.append(w, p["b"]), primal(w, p["b"])
    for k in range(4_000):
        r = Y - z @ v[:-1] - v[-1]
        s = np.where(np.abs(r) > 0.2, np.sign(r), 0.0)
        v = v - 0.02 / (1 + k / 20) * np.append(v[:-1] - 2.0 * (z.T @ s), -2.0 * s.sum()) / 20
        best = min(best, primal(v[:-1], v[-1]))
    assert p["objective"] - best <= svr.TOLERANCE * p["objective"] * 1.01
    pred = {r["id"]: r["prediction"] for r in model.transform(data).collect()}
    np.testing.assert_allclose([pred[i] for i in range(N)], z @ w + p["b"], atol=1e-9)


def test_partner_is_a_bijection(spark):
    def plain(i, rep, n, seed):
        a = max(1, math.isqrt(max(n - 1, 0)) + 1)
        b = -(-n // a)
        x = i
        while True:
            l, r = divmod(x, b)
            for t in range(models.ROUNDS):
                half, size = (r, a) if t % 2 == 0 else (l, b)
                step = int(hashlib.md5(f"{half}:{rep}:{seed}:{t}".encode()).hexdigest()[:8], 16)
                l, r = ((l + step) % a, r) if t % 2 == 0 else (l, (r + step) % b)
            x = l * b + r
            if x < n:
                return x
    for n in (1, 2, 3, 7, 401):
        rows = spark.range(n).withColumn("j", models.partner(F.col("id"), F.lit(4), n, 9)).collect()
        assert sorted(r["j"] for r in rows) == list(range(n))
        assert [r["j"] for r in rows] == [plain(r["id"], 4, n, 9) for r in rows]


def test_sums_in_two_steps(spark, data, monkeypatch):
    d = Design(data, NAMES, "y", "fold", 4)
    one = d.moments()
    monkeypatch.setattr(design, "FAN_IN", 2)
    for f, cells in d.moments().items():
        np.testing.assert_allclose(cells[0][2], one[f][0][2], rtol=1e-12)


def deep(n=6_000):
    """A saw of many teeth, whose tree peels tooth by tooth, and a second feature with few values."""
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 9, n), rng.permutation(n)]).astype(float)
    return x, x[:, 1] % 50 + (x[:, 0] > 4), rng.poisson(1, n).astype(float)


def test_large_nodes_are_split_as_small_ones(monkeypatch):
    x, y, w = deep()
    monkeypatch.setattr(growth, "LARGE", len(x) + 1)
    want, at = growth.grow(x, y, w)
    monkeypatch.setattr(growth, "LARGE", 64)
    monkeypatch.setattr(growth, "BLOCK", 16)
    for piece in (500, 100_000):
        monkeypatch.setattr(growth, "PIECE", piece)
        for limit in (None, 4):
            got, here = growth.grow(x, y, w, limit)
            if limit is None:
                np.testing.assert_allclose(got["value"][here], want["value"][at], atol=1e-9)
                assert np.array_equal(np.sort(got["threshold"]), np.sort(want["threshold"]))
        assert len(got["feature"]) <= 31


def test_a_deep_tree_does_not_read_all_rows_at_every_level(monkeypatch):
    """Rows times levels would be far more than what is sorted and summed for the nodes."""
    x, y, w = deep(40_000)
    seen, only = [], growth._best_cuts
    monkeypatch.setattr(growth, "_best_cuts", lambda cols, counts, center: (seen.append(int(counts.sum())), only(cols, counts, center))[1])
    tree = growth.grown(x, y, w)
    depth, at = 0, np.zeros(1, np.int64)
    while len(at):
        depth, at = depth + 1, at[tree["feature"][at] >= 0]
        at = np.concatenate([tree["left"][at], tree["left"][at] + 1])
    assert depth > 100 and sum(seen) < 0.2 * depth * int((w > 0).sum())


def test_rows_are_led_on_together(monkeypatch):
    """Along the whole way of one row, with the same ends as step by step."""
    x, y, w = deep(20_000)
    tree = growth.grown(x, y, w)
    rows = np.vstack([x, x + 0.25, [[-np.inf, np.inf], [4.0, 0.0], [-0.0, 1e9]]])
    got = growth.walk(tree, rows)
    calls, only = [], np.flatnonzero
    monkeypatch.setattr(growth, "FOLLOW", len(rows) + 1, raising=False)
    want = growth.walk(tree, rows)
    assert np.array_equal(got, want)
    monkeypatch.undo()
    monkeypatch.setattr(growth.np, "flatnonzero", lambda v: (calls.append(len(v)), only(v))[1])
    growth.walk(tree, rows)
    depth, at = 0, np.zeros(1, np.int64)
    while len(at):
        depth, at = depth + 1, at[tree["feature"][at] >= 0]
        at = np.concatenate([tree["left"][at], tree["left"][at] + 1])
    assert depth > 100 and sum(calls) < 0.05 * depth * len(rows)
    holes = rows.copy()
    holes[::3, 1] = np.nan  # a missing value goes to the left
    monkeypatch.undo()
    assert np.array_equal(growth.walk(tree, holes), growth.walk(tree, np.where(np.isnan(holes), -np.inf, holes)))


def test_packed_trees():
    x, y, w = deep()
    for depth in (None, 0, 3):
        tree = growth.grown(x, y, w, depth)
        again = growth.unpacked(*growth.packed(tree))
        assert len(again["left"]) == len(tree["left"])
        assert np.array_equal(again["value"][growth.walk(again, x)], tree["value"][growth.walk(tree, x)])


def test_a_model_leaves_its_task_in_small_pieces(spark, data, monkeypatch, tmpdir_spark):
    """No row of a model and no task that scores holds all trees that a task has grown."""
    monkeypatch.setattr(trees, "PIECE", 40, raising=False)
    model = models.fit_tree(data, NAMES, "y", "rf", num_trees=70, key="id")
    assert model.nodes.select("unit").distinct().count() < 70  # several trees are grown together
    assert model.nodes.agg(F.max(F.size("feature"))).first()[0] <= 40
    want = {r["id"]: r["prediction"] for r in model.transform(data).collect()}
    monkeypatch.setattr(trees, "SENT_BYTES", 0)
    monkeypatch.setattr(trees, "SCORED", 100, raising=False)
    for held in (1, 20_000):
        monkeypatch.setattr(trees, "HELD_BYTES", held, raising=False)
        got = {r["id"]: r["prediction"] for r in model.transform(data).collect()}
        assert len(got) == len(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)
