"""Channel models, banded derivatives, aligned windows, block-sparse regression and matrix powers against plain NumPy versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewloom.operators import derivatives, linear, neighbours, solvers
from viewloom.plans import QUERIES, channels

SMALL = "/root/testdata/sf0.001"


def dense_derivative(x, dt, alpha, rounds, eps=1e-6):
    """The same rounds with whole matrices of the integral and the differences."""
    n = len(x)
    a = np.tril(np.full((n, n), dt)) - dt / 2 * np.eye(n)
    d = (np.eye(n, k=1) - np.eye(n))[:-1] / dt
    u = np.gradient(x, dt)
    for _ in range(rounds):
        w = np.diag(1 / np.sqrt((d @ u) ** 2 + eps))
        u = np.linalg.solve(a.T @ a + alpha * dt * d.T @ w @ d, a.T @ (x - x[0]))
    return u


@pytest.mark.parametrize("n", [3, 4, 17, 240])
def test_banded_derivatives_are_the_dense_ones(n):
    x = np.cumsum(np.random.default_rng(n).normal(size=(6, n)), axis=1)
    dt = np.array([1.0, 0.1, 0.5, 2.0, 30.0, 1.0])
    got = derivatives.tv_derivatives(x, dt, 0.1, 15)
    assert np.allclose(got, [dense_derivative(v, s, 0.1, 15) for v, s in zip(x, dt, strict=True)], atol=1e-5)


def test_very_short_series_and_banded_systems():
    assert derivatives.tv_derivatives(np.zeros((2, 1)), np.ones(2)).tolist() == [[0], [0]]
    assert derivatives.tv_derivatives(np.array([[1.0, 4.0]]), np.array([2.0])).tolist() == [[1.5, 1.5]]
    rng = np.random.default_rng(0)
    for n in (2, 3, 9):
        low = np.tril(rng.normal(size=(n, n))) * (np.abs(np.subtract.outer(range(n), range(n))) < 3) + 3 * np.eye(n)
        a, b = low @ low.T, rng.normal(size=n)
        got = derivatives.solve_banded(*(np.diag(a, k)[None] for k in range(3)), b[None])[0]
        assert np.allclose(got, np.linalg.solve(a, b))


def test_chunks_of_long_hot_and_odd_series(spark):
    rng = np.random.default_rng(1)
    long = np.cumsum(rng.normal(size=1000))
    rows = [(1, i + 1, float(v), 1.0) for i, v in enumerate(long)] + [(2, 1, 5.0, 1.0), (None, 1, 0.0, 2.0), (None, 2, 4.0, 2.0)]
    rows += [(3, i + 1, None if i == 4 else float(i), 1.0) for i in range(10)] + [(4, i + 1, float(i), 0.0) for i in range(5)]
    table = spark.createDataFrame(rows, "key long, rn long, x double, dt double").repartition(4)
    found = {(r.key, r.rn): r.dx for r in derivatives.derive_series(table, ["key"], "rn", "x", F.col("dt")).collect()}
    assert len(found) == len(rows)
    assert found[2, 1] == 0 and found[None, 1] == found[None, 2] == 2
    assert {found[3, i + 1] for i in range(10)} == {found[4, i + 1] for i in range(5)} == {None}
    for chunk in range(5):
        first, last = max(0, 200 * chunk - 20), min(1000, 200 * chunk + 220)
        want = dense_derivative(long[first:last], 1.0, 0.1, 15)
        assert all(abs(found[1, i + 1] - want[i - first]) < 1e-5 for i in range(200 * chunk, 200 * chunk + 200))
    assert derivatives.derive_series(table.limit(0), ["key"], "rn", "x", F.col("dt")).count() == 0


def test_channel_derivatives_of_the_table(spark):
    """Some channels of the given table by the dense matrices."""
    events = spark.read.parquet(f"{SMALL}/events.parquet").toPandas().sort_values(["ts", "event_id"])
    got = QUERIES["channel_derivatives"](spark, SMALL).toPandas()
    assert len(got) == sum((len(own) + 1) // 2 for _, own in events.groupby(["user_id", "event_type"]))
    tried = 0
    for (user, kind), own in events.groupby(["user_id", "event_type"]):
        own = own.iloc[::2]
        if 3 <= len(own) <= 200 and tried < 20:
            t = own["ts"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6
            want = dense_derivative(own["value"].to_numpy(), (t[-1] - t[0]) / (len(t) - 1) / 3600, 0.1, 15)
            assert np.allclose(got[(got.user_id == user) & (got.event_type == kind)].sort_values("at").dx, want, atol=2e-4)
            tried += 1
    assert tried


def test_moments_of_each_key(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3)) * [1, 2, 3] + 1e6
    keys = [["a", "b", None][i % 3] for i in range(300)]
    rows = [(k, v.tolist()) for k, v in zip(keys, x, strict=True)]
    odd = [("a", None), ("a", [1.0, None, 2.0])]
    got = linear.moments_by(spark.createDataFrame(rows + odd, "k string, v array<double>").repartition(5), "k", "v")
    assert set(got) == {"a", "b", None}
    for at, key in enumerate(["a", "b", None]):
        own = x[at::3]
        assert got[key].n == 100 and np.allclose(got[key].mean, own.mean(0)) and np.allclose(got[key].cov, np.cov(own.T, bias=True))
    assert linear.moments_by(spark.createDataFrame(odd[:1], "k string, v array<double>"), "k", "v") == {}


def test_channel_codes_by_a_fit_of_each_channel(spark):
    rows = channels.spectra(channels._channels(spark, "/root/testdata/sf0.01")).toPandas()
    got = QUERIES["channel_spectral_codes"](spark, "/root/testdata/sf0.01").toPandas()
    assert set(got.event_type) == set(rows.event_type) and not (got.user_id % 3 == 0).any()
    for kind, own in rows.groupby("event_type"):
        fit = np.stack(own[own.user_id % 3 == 0]["v"].to_numpy())
        _, _, axes = np.linalg.svd(fit - fit.mean(0), full_matrices=False)
        other = own[own.user_id % 3 != 0].sort_values(["user_id", "win"])
        want = np.abs((np.stack(other["v"].to_numpy()) - fit.mean(0)) @ axes[:3].T)
        codes = got[got.event_type == kind].pivot_table(index=["user_id", "win"], columns="k", values="code").sort_index()
        assert np.allclose(np.abs(codes.to_numpy()), want, atol=1e-3)


def test_models_by_channel(spark):
    rows = spark.createDataFrame([("a", [0.0, float(i)]) for i in range(4)] + [("b", [float(i), 0.0]) for i in range(4)], "c string, v array<double>")
    split = channels.split_models(channels.channel_models(rows, "c", "v", 1), "c")
    assert {k: t.first().weights for k, t in split.items()} == {"a": [0, 1], "b": [1, 0]}


def slow_dtw(a, b):
    cost = np.full((len(a) + 1, len(b) + 1), np.inf)
    cost[0, 0] = 0
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            cost[i + 1, j + 1] = abs(x - y) + min(cost[i, j], cost[i, j + 1], cost[i + 1, j])
    return cost[-1, -1]


@pytest.mark.parametrize("block", [2000, 3])
def test_aligned_windows_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(5)), rng.integers(0, 4, 6).astype(float).tolist()) for i in range(60)]  # small whole numbers: many ties
    odd = [(100, 1, None), (101, 2, [1.0, 2.0]), (None, 3, [0.0] * 6)]
    table = spark.createDataFrame(rows + odd, "id long, g int, v array<double>").repartition(3)
    got = {(r.query, r["rank"]): (r.neighbour, r.cost) for r in neighbours.dtw_nearest(table, table.where("id % 7 = 0 or id > 99"), "id", "v", "g", 3).collect()}
    want = {}
    for i, g, v in rows:
        if i % 7 == 0:
            best = sorted((slow_dtw(v, w), j) for j, h, w in rows if h != g)[:3]
            want |= {(i, k + 1): (j, c) for k, (c, j) in enumerate(best)}
    assert got == want
    assert neighbours.dtw_nearest(table, table.limit(0), "id", "v", "g").count() == 0


def test_votes_of_aligned_windows(spark):
    rows = [r for r in channels._labelled_windows(spark, SMALL).collect()]
    hits: dict = {}
    for q in rows:
        if q.id % 10 == 0:
            best = sorted((slow_dtw(q.v, r.v), r.id, r.label) for r in rows if r.user_id != q.user_id)[:10]
            names = [b[2] for b in best]
            guess = max(set(names), key=lambda n: (names.count(n), -names.index(n)))
            hits.setdefault(q.label, []).append(guess == q.label)
    got = {r.label: (r.n, r.accuracy) for r in QUERIES["dtw_votes"](spark, SMALL).collect()}
    assert got == {k: (len(v), round(float(np.mean(v)), 6)) for k, v in hits.items()}


def planted():
    """Four views of three; view 3 follows view 0, view 2 follows views 0 and 1, the rest is noise."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5000, 12))
    x[:, 9:] = x[:, :3] @ rng.normal(size=(3, 3)) + 0.1 * rng.normal(size=(5000, 3))
    x[:, 6:9] = x[:, :3] + x[:, 3:6] + 0.1 * rng.normal(size=(5000, 3))
    return linear.Moments(5000.0, x.mean(0), np.cov(x.T, bias=True)), [list(range(3 * k, 3 * k + 3)) for k in range(4)]


def test_block_regression_minimises_its_objective():
    m, views = planted()
    lam = 0.05
    fit = solvers.block_regression(m, views, 2, lam, 3000, 1e-14)
    assert all(a >= b for a, b in zip(fit.objective, fit.objective[1:], strict=False))
    cov = m.cov
    others = [i for k in (0, 1, 3) for i in views[k]]
    c, b = cov[np.ix_(others, others)], cov[np.ix_(others, views[2])]
    w = fit.weights[others]
    loss = lambda w: np.trace(cov[np.ix_(views[2], views[2])]) / 2 + np.trace(w.T @ c @ w) / 2 - np.trace(w.T @ b) + lam * sum(np.linalg.norm(w[3 * k : 3 * k + 3]) for k in range(3))
    assert abs(loss(w) - fit.objective[-1]) < 1e-9 and not fit.weights[views[2]].any()
    rng = np.random.default_rng(5)
    assert all(loss(w) <= loss(w + 1e-3 * rng.normal(size=w.shape)) for _ in range(300))


def test_planted_redundancy_is_found_and_predicts():
    m, views = planted()
    history, weights = solvers.block_redundancy(m, views, 0.05, 2000)
    last = history[-1]
    assert (history[0] == 0).all() and last[2, 0] > 0.5 and last[2, 1] > 0.5
    assert last[2, 3] < 0.25 * last[2, 0]  # view 3 holds view 0 with noise, so a penalty leaves it a share
    assert last[3, 0] > 0.5 and last[3, 1] < 0.05 * last[3, 0]
    assert (np.diag(last) == 0).all()
    for v, most in ((2, 0.1), (3, 0.1)):
        d = views[v]
        error = np.trace(m.cov[np.ix_(d, d)] - 2 * weights[:, d].T @ m.cov[:, d] + weights[:, d].T @ m.cov @ weights[:, d])
        assert error < most * np.trace(m.cov[np.ix_(d, d)])
    assert np.allclose(solvers.block_redundancy(m, views, 1e6)[1], 0)


def test_predictions_of_the_table(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    m = linear.Moments(len(x), x.mean(0), np.cov(x.T, bias=True))
    _, weights = solvers.block_redundancy(m, channels.VIEWS, channels.PENALTY)
    guess = m.mean + (x - m.mean) @ weights
    got = QUERIES["view_predictions"](spark, SMALL).orderBy("vec_id").toPandas()
    for k in range(4):
        assert np.allclose(got[f"error{k}"], ((x - guess)[:, 16 * k : 16 * k + 16] ** 2).sum(1), atol=1e-4)


def test_matrix_powers():
    rng = np.random.default_rng(6)
    a = rng.normal(size=(5, 3))
    c = a @ a.T  # of rank 3
    assert np.allclose(linear.matrix_power(c, 1), c) and np.allclose(linear.matrix_power(c, -1), np.linalg.pinv(c))
    half = linear.matrix_power(c, 0.5)
    assert np.allclose(half @ half, c) and np.allclose(linear.matrix_power(np.zeros((2, 2)), -0.5), 0)


def test_whitened_views_have_unit_covariance(spark):
    white = np.array([r.white for r in QUERIES["whitened_views"](spark, SMALL).collect()])
    assert np.allclose(white.mean(0), 0, atol=1e-4)
    cov = np.cov(white.T, bias=True)
    for k in range(4):
        assert np.allclose(cov[16 * k : 16 * k + 16, 16 * k : 16 * k + 16], np.eye(16), atol=1e-3)


def test_averages_over_chunks(spark):
    """A long series, a short one, a null key and a null value by the plain loop; rows of a series are numbered with gaps."""
    from viewloom.operators import series

    rng = np.random.default_rng(7)
    values = {1: rng.normal(size=900) * 100, 2: np.array([5.0]), None: np.arange(4.0)}
    rows = [(k, 3 * i, float(v)) for k, x in values.items() for i, v in enumerate(x)] + [(3, 0, 1.0), (3, 1, None), (3, 2, 2.0)]
    table = spark.createDataFrame(rows, "k long, rn long, v double").repartition(4)
    for alpha in (0.2, 0.9, 1.0):
        got = {(r.k, r.rn): r.ema for r in series.ema(table, ["k"], "v", alpha).collect()}
        assert len(got) == len(rows) and got[3, 0] == 1
        assert all(got[3, i] is None or np.isnan(got[3, i]) for i in (1, 2))
        for k, x in values.items():
            last = x[0]
            for i, v in enumerate(x):
                last = alpha * v + (1 - alpha) * last
                assert abs(got[k, 3 * i] - last) < 1e-11
    assert series.ema(table.limit(0), ["k"], "v", 0.2).count() == 0
