"""Synchrony, function regression, spectral embeddings and streamed state against plain versions."""

import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewloom.operators import functional, linear, spectral, synchrony
from viewloom.streaming import stateful

SMALL = "/root/testdata/sf0.001"


# --- synchrony -------------------------------------------------------------------------------------------------------


def plain_ratios(a, b, tau, dims, most):
    embed = lambda s: np.stack([s[k * tau : len(s) - (dims - 1 - k) * tau] for k in range(dims)], axis=1)
    ea, eb = embed(a), embed(b)

    def nearest(e):
        d = np.sqrt(((e[:, None] - e[None]) ** 2).sum(axis=2))
        np.fill_diagonal(d, np.inf)
        return d.argmin(axis=1), d.min(axis=1)

    (na, da), (nb, db), found = nearest(ea), nearest(eb), {}
    for lag in range(-most, most + 1):
        one, two, n = [], [], 0
        for t in range(len(ea)):
            if not 0 <= t + lag < len(eb):
                continue
            n += 1
            j, i = nb[t + lag] - lag, na[t] + lag
            if 0 <= j < len(ea) and (e := np.linalg.norm(ea[t] - ea[j])) > 1e-3:
                one.append(da[t] / e)
            if 0 <= i < len(eb) and (e := np.linalg.norm(eb[t + lag] - eb[i])) > 1e-3:
                two.append(db[t + lag] / e)
        if one and two and (r := (np.mean(one) + np.mean(two)) / 2) > 0:
            found[lag] = (max(r, 1 / r), n)
    return found


def test_a_planted_shift_is_found(spark):
    rng = np.random.default_rng(1)
    x = np.zeros(420)
    for k in range(2, 420):  # an irregular oscillation
        x[k] = 1.6 * x[k - 1] - 0.9 * x[k - 2] + rng.normal()
    a, b = x[12:372], np.tanh(x / 3)[:360] * 5  # b runs 12 samples behind a
    rows = [("a", k, float(v)) for k, v in enumerate(a)] + [("b", k, float(v)) for k, v in enumerate(b)] + [("c", 0, 1.0)]
    ratios = synchrony.sync_ratios(spark.createDataFrame(rows, "key string, rn long, value double"), "key", "a", "b", 2, 3, 20)
    got, plain = {r.lag: (r.ratio, r.n) for r in ratios.collect()}, plain_ratios(a, b, 2, 3, 20)
    assert got.keys() == plain.keys() and all(np.allclose(got[k], plain[k], rtol=1e-6) for k in plain)
    assert synchrony.sync_lag(ratios).first().lag == 12
    assert synchrony.sync_lag(ratios.where("false")).count() == 0


# --- functions to functions ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("dense", [1024, 8])
def test_a_planted_map_of_functions(spark, monkeypatch, dense):
    """Coefficients of g(t) = f(t)^2 for functions f with a few cosines."""
    monkeypatch.setattr(functional, "DENSE", dense)
    rng = np.random.default_rng(2)
    t = (np.arange(64) + 0.5) / 64
    basis = np.stack([np.ones(64)] + [np.sqrt(2) * np.cos(np.pi * k * t) for k in range(1, 5)], axis=1)
    p = rng.normal(size=(400, 3)) * 0.5
    q = (p @ basis[:, :3].T) ** 2 @ basis / 64
    rows = [(k, a.tolist(), b.tolist()) for k, (a, b) in enumerate(zip(p, q))] + [(900, None, [0.0] * 5)]
    frame = spark.createDataFrame(rows, "id long, p array<double>, q array<double>").repartition(3)
    width, train = (200, 300) if dense > 8 else (60, 300)
    model = functional.fit(frame.where("id < 300"), "p", "q", width, 0.2, 1e-4, rounds=40 if dense == 8 else 1)
    z = model.features(p[:train])
    plain = np.linalg.solve(z.T @ z + 1e-4 * np.eye(width), z.T @ q[:train])
    if dense > 8:
        assert np.allclose(model(p), model.features(p) @ plain, atol=1e-6)
    else:  # gradients that stop early fit nearly as well
        assert ((model(p[:train]) - q[:train]) ** 2).mean() < 5 * ((z @ plain - q[:train]) ** 2).mean() + 1e-3
    got = np.array([r.y for r in frame.where("id between 300 and 399").select("id", functional.predicted(F.col("p"), model).alias("y")).orderBy("id").collect()])
    assert np.allclose(got, model(p[300:])) and ((got - q[300:]) ** 2).mean() < 0.05 * q[300:].var()
    assert functional.fit(frame.where("false"), "p", "q", 8, 1.0, 1.0) is None


# --- spectral --------------------------------------------------------------------------------------------------------


def test_laplacian_against_a_dense_solver(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([c + 0.5 * rng.normal(size=(25, 2)) for c in ([0, 0], [2.2, 0], [0, 2.6], [2.4, 2.8])])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    near = [(i, int(j), float(d[i, j])) for i in range(100) for j in d[i].argsort()[1:9]]
    edges = spectral.neighbour_graph(spark.createDataFrame(near, "query long, neighbour long, dist double"), 0.3)
    w = np.zeros((100, 100))
    for r in edges.collect():
        w[r.i, r.j] = r.w
    assert np.allclose(w, w.T) and (w > 0).sum() == edges.count()
    values, vectors = np.linalg.eigh(np.diag(w.sum(0)) - w)
    rows, got = spectral.laplacian_embedding(edges, 3, rounds=5)
    assert np.allclose(got, values[1:4], atol=1e-4)
    z = np.array([[r.x0, r.x1, r.x2] for r in rows.orderBy("node").collect()])
    assert np.allclose(z.T @ z, np.eye(3), atol=1e-6)
    assert np.allclose(z @ z.T, vectors[:, 1:4] @ vectors[:, 1:4].T, atol=1e-2)  # up to a rotation


def test_instrumental_embedding():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(200, 5)), rng.normal(size=(200, 4))
    y[:, :2] += x[:, :2]
    x, y = x - x.mean(0), y - y.mean(0)
    both = np.hstack((x, y))
    m = linear.Moments(200.0, both.mean(0), np.cov(both.T, bias=True))
    a, b, s = spectral.instrumental_embedding(m, [0, 1, 2, 3, 4], [5, 6, 7, 8], 3)
    u, plain, vt = np.linalg.svd(x @ x.T @ y @ y.T)
    assert np.allclose(s, plain[:3])
    for mine, theirs in ((x @ a, u[:, :3] / np.sqrt(plain[:3])), (y @ b, vt[:3].T / np.sqrt(plain[:3]))):
        assert np.allclose(np.abs(mine), np.abs(theirs), atol=1e-6)


# --- streams ---------------------------------------------------------------------------------------------------------


def test_streamed_state_equals_the_batch_after_a_restart(spark, tmp_path):
    from viewloom.operators.series import ema
    from viewloom.sources.tables import event_series

    events = spark.read.parquet(f"{SMALL}/events.parquet").where("user_id <= 6").select("event_id", "ts", "user_id", "value")
    last = events.agg(F.max("ts")).first()[0]
    rng = np.random.default_rng(5)
    rows = events.collect()
    parts = np.array_split(rng.permutation(len(rows)), 4)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    schema, found = events.schema, {}
    try:
        for name, make in (("ema", lambda s: stateful.streamed_ema(s, 0.2, late="3650 days")), ("run", lambda s: stateful.streamed_runs(s, 20.0, late="3650 days"))):
            source, target, state = (str(tmp_path / f"{name}-{x}") for x in ("in", "out", "state"))
            for k, part in enumerate([*parts, None]):
                own = [tuple(rows[i]) for i in part] if part is not None else [(-1, last.replace(year=last.year + 30), u, 0.0) for u in {r.user_id for r in rows}]
                spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(source)
                stream = make(spark.readStream.schema(schema).parquet(source))
                # each micro-batch is a query of its own that goes on from the checkpoint
                query = stream.writeStream.format("parquet").option("checkpointLocation", state).option("path", target).trigger(availableNow=True).start()
                query.awaitTermination(120)
                assert query.exception() is None
            found[name] = spark.read.parquet(target).where("id >= 0").collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        shutil.rmtree(tmp_path, ignore_errors=True)
    series = event_series(spark, SMALL).where("user_id <= 6")
    plain = {r.event_id: r.ema for r in ema(series, ["user_id"], "value", 0.2).join(series.select("user_id", "rn", "event_id"), ["user_id", "rn"]).collect()}
    assert {r.id for r in found["ema"]} == set(plain) and len(found["ema"]) == len(plain)
    assert all(abs(r.ema - plain[r.id]) < 1e-9 for r in found["ema"])
    runs, by_user = {}, {}
    for r in series.orderBy("user_id", "rn").collect():
        number, level = by_user.get(r.user_id, (-1, None))
        own = r.value // 20.0
        by_user[r.user_id] = number + (own != level), own
        runs[r.event_id] = by_user[r.user_id][0]
    assert {r.id: int(r.run) for r in found["run"]} == runs


# --- bases fitted on windows, running sums ---------------------------------------------------------------------------


def test_the_window_basis_is_fitted_on_the_other_users(spark):
    from viewloom.plans import latent

    rows = latent._window_features(spark, SMALL).collect()
    x = np.array([r.v for r in rows if r.user_id % 3 == 0])
    vectors = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:4].T
    got = {(r.user_id, r.win, r.k): r.code for r in latent.fitted_window_basis(spark, SMALL).collect()}
    own = [r for r in rows if r.user_id % 3]
    assert len(got) == 4 * len(own)
    for r in own:
        plain = (np.array(r.v) - x.mean(0)) @ vectors
        assert np.allclose([abs(got[r.user_id, r.win, k]) for k in range(4)], np.abs(plain), atol=1e-4)


def test_running_sums_of_hot_and_missing_keys(spark):
    from viewloom.operators import views

    rng = np.random.default_rng(7)
    rows = [(None if k % 11 == 0 else "hot" if k % 3 else f"k{k % 5}", int(rng.integers(0, 10**6)), int(rng.integers(1, 9))) for k in range(900)]
    got = views.running_sums(spark.createDataFrame(rows, "key string, at long, n long"), ["key"], ["at"], F.col("n")).collect()
    for key in {k for k, _, _ in rows}:
        own = sorted((a, n) for k, a, n in rows if k == key)
        upto = np.cumsum([n for _, n in own]).tolist()
        assert sorted((r.at, r._upto) for r in got if r.key == key) == [(a, u) for (a, _), u in zip(own, upto)]
        assert {r._total for r in got if r.key == key} == {upto[-1]}
    assert views.running_sums(spark.createDataFrame([], "key string, at long, n long"), ["key"], ["at"]).count() == 0
