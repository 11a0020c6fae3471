"""Solvers, factorisation, mixtures and alignment against plain NumPy versions and planted data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewloom.operators import alignment, factor, linear, mixture, solvers


def moments_of(x):
    return linear.Moments(float(len(x)), x.mean(0), np.cov(x.T, bias=True))


def table_of(spark, x, **columns):
    rows = [(k, v.tolist(), *(c[k] for c in columns.values())) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>" + "".join(f", {n} {'string' if isinstance(c[0], str) else 'array<double>'}" for n, c in columns.items())).repartition(3)


# --- solvers ---------------------------------------------------------------------------------------------------------


def test_splitting_meets_its_parts():
    """min |x - a|^2 / 2 + |x|_1 with x in the unit ball, against a fine projected gradient; a warm start ends at once."""
    rng = np.random.default_rng(1)
    a = rng.normal(size=12) * 2
    ball = lambda v, _: v / max(1.0, np.linalg.norm(v))
    prox = lambda v, s: solvers.soft((v + s * a) / (1 + s), s * 0.3 / (1 + s))
    run = solvers.Splitting.start(prox, ball, 12)
    x = run.solve(1.0, 5000, 1e-10)
    cost = lambda x: ((x - a) ** 2).sum() / 2 + 0.3 * np.abs(x).sum()
    plain = np.zeros(12)
    for k in range(200_000):
        plain = ball(plain - 1 / (k + 10) * (plain - a + 0.3 * np.sign(plain)), 1)
    assert np.linalg.norm(x) <= 1 + 1e-9 and cost(x) <= cost(plain) + 1e-6
    assert run.primal[-1] < 1e-10 > run.dual[-1] or len(run.primal) == 5000
    again = solvers.Splitting.start(prox, ball, 12, run)
    again.solve(1.0, 5000, 1e-8)
    assert len(again.primal) <= 3 < len(run.primal)


def test_projection_on_an_ellipsoid():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(6, 6))
    c, past = a @ a.T, rng.normal(size=(6, 2))
    project = solvers.ellipsoid(c, past)
    for _ in range(20):
        v = rng.normal(size=6) * 3
        z = project(v, 1.0)
        assert z @ c @ z <= 1 + 1e-9 and np.abs(past.T @ c @ z).max() < 1e-9
        for _ in range(200):  # no other allowed point is nearer
            other = project(z + rng.normal(size=6) * 0.1, 1.0)
            assert np.linalg.norm(v - z) <= np.linalg.norm(v - other) + 1e-9


def planted_views(n=4000):
    rng = np.random.default_rng(3)
    shared = rng.normal(size=(n, 2))
    x, y = rng.normal(size=(n, 8)), rng.normal(size=(n, 6))
    x[:, :2] += 2 * shared[:, :1]  # only the first group of x and the last of y have the first factor
    y[:, 4:] += 2 * shared[:, :1]
    x[:, 2:4] += shared[:, 1:]
    y[:, 2:4] += shared[:, 1:]
    return np.hstack((x, y))


GX, GY = [[0, 1], [2, 3], [4, 5, 6, 7]], [[0, 1], [2, 3], [4, 5]]


def test_group_sparse_directions():
    m = moments_of(planted_views())
    left, right = list(range(8)), list(range(8, 14))
    free = solvers.group_sparse_cca(m, left, right, GX, GY, 2, rounds=300, tol=1e-10)
    plain, _, _ = linear.cca(m, slice(0, 8), slice(8, 14))
    assert np.allclose(free.correlations, plain[:2], atol=1e-3)  # without penalties: canonical correlations
    found = solvers.group_sparse_cca(m, left, right, GX, GY, 2, each=0.05)
    for course in found.objectives:
        assert all(b <= a + 1e-9 for a, b in zip(course, course[1:]))
    sizes = lambda u, groups: np.array([np.linalg.norm(u[g]) for g in groups])
    assert (sizes(found.left[:, 0], GX) > 1e-6).tolist() == [True, False, False]
    assert (sizes(found.right[:, 0], GY) > 1e-6).tolist() == [False, False, True]
    assert sizes(found.left[:, 1], GX).argmax() == 1 and sizes(found.right[:, 1], GY).argmax() == 1
    cov = m.cov[:8, :8]
    assert abs(found.left[:, 0] @ cov @ found.left[:, 1]) < 1e-4


def test_a_side_meets_a_plain_solver():
    """One side's problem against projected subgradients."""
    m = moments_of(planted_views(500))
    c, cx = m.cov[:8, 8:] @ np.ones(6) / 3, m.cov[:8, :8] + 1e-6 * np.eye(8)
    hold = solvers.ellipsoid(cx, np.zeros((8, 0)))
    each, lone = 0.1, 0.02
    cost = lambda u: -c @ u + each * sum(np.linalg.norm(u[g]) for g in GX) + lone * np.abs(u).sum()
    mine = solvers.Splitting.start(lambda w, s: solvers.group_prox(w + s * c, GX, s * each, s * lone), hold, 8).solve(0.5, 5000, 1e-10)
    u, best = np.zeros(8), 0.0
    for k in range(20_000):
        slope = -c + lone * np.sign(u)
        for g in GX:
            slope[g] += each * u[g] / max(np.linalg.norm(u[g]), 1e-12)
        u = hold(u - 0.5 / np.sqrt(k + 1) * slope, 1)
        best = min(best, cost(u))
    assert abs(cost(mine) - best) < 2e-3 and cost(mine) <= best + 1e-6


def test_shared_embedding_is_the_plain_loop():
    rng = np.random.default_rng(4)
    z = rng.normal(size=(600, 2))
    views = [z @ rng.normal(size=(2, 5)) + 0.1 * rng.normal(size=(600, 5)) for _ in range(3)]
    dims = [list(range(5 * k, 5 * k + 5)) for k in range(3)]
    x = np.hstack(views)
    bases, course = solvers.shared_embedding(moments_of(x), dims, 2, rounds=60, tol=0)
    assert course[-1] < course[0] and abs(course[-1] - course[-2]) < 1e-6
    own = [v - v.mean(0) for v in views]
    us = []
    for v in own:
        u = np.linalg.svd(v, full_matrices=False)[2][:2].T
        us.append(u * np.sign(u[np.abs(u).argmax(axis=0), [0, 1]]))
    for _ in range(60):
        latent = np.mean([v @ u for v, u in zip(own, us)], axis=0)
        us = [solvers.orthonormal(np.linalg.lstsq(latent, v, rcond=None)[0].T) for v in own]
    for a, b in zip(bases, us):
        assert np.allclose(a, b, atol=1e-6) and np.allclose(a.T @ a, np.eye(2), atol=1e-9)


def test_agreeing_directions():
    rng = np.random.default_rng(5)
    z = rng.normal(size=(2000, 2)) * [2, 1]
    x = np.hstack([z @ np.linalg.qr(rng.normal(size=(4, 2)))[0].T + 0.2 * rng.normal(size=(2000, 4)) for _ in range(3)])
    dims, m = [list(range(4 * k, 4 * k + 4)) for k in range(3)], moments_of(x)
    bases, courses = solvers.agreeing_directions(m, dims, 2)
    for course in courses:
        assert all(b >= a - 1e-12 for a, b in zip(course, course[1:]))
    assert all(np.allclose(b.T @ b, np.eye(2), atol=1e-8) for b in bases)
    best = -np.inf
    for _ in range(200):  # from random starts no larger sum is found
        us = [v / np.linalg.norm(v) for v in rng.normal(size=(3, 4))]
        for _ in range(30):
            for k in range(3):
                pull = sum(m.cov[np.ix_(dims[k], dims[j])] @ us[j] for j in range(3) if j != k)
                us[k] = pull / np.linalg.norm(pull)
        best = max(best, sum(us[a] @ m.cov[np.ix_(dims[a], dims[b])] @ us[b] for a in range(3) for b in range(a + 1, 3)))
    assert courses[0][-1] >= best - 1e-6 > courses[1][-1]


# --- factorisation ---------------------------------------------------------------------------------------------------


def test_codes_are_optimal_and_never_worse():
    rng = np.random.default_rng(6)
    atoms, x = rng.normal(size=(10, 6)), rng.normal(size=(50, 10))
    code = factor.sparse_codes(x, atoms, 0.5, rounds=3000, tol=1e-12)
    slope = code @ atoms.T @ atoms - x @ atoms
    on = np.abs(code) > 1e-9
    assert np.allclose(slope[on], -0.5 * np.sign(code[on]), atol=1e-5) and (np.abs(slope[~on]) <= 0.5 + 1e-5).all()
    assert np.allclose(factor.sparse_codes(x, atoms, 0.5, code, rounds=1), code, atol=1e-6)


def test_a_planted_dictionary_is_found(spark):
    rng = np.random.default_rng(7)
    true = np.linalg.qr(rng.normal(size=(12, 6)))[0]
    code = rng.normal(size=(1500, 6)) * 3 * (rng.random((1500, 6)) < 0.25)
    x = code @ true.T + 0.02 * rng.normal(size=(1500, 12))
    views = [list(range(6)), list(range(6, 12))]
    start = true + 0.35 * rng.normal(size=true.shape)
    start = np.hstack((start / np.linalg.norm(start, axis=0), 1e-3 * rng.normal(size=(12, 2))))  # and two atoms too many
    found, coded = factor.fit(table_of(spark, x), "id", "v", views, 8, sparse=1.0, structure=300.0, rounds=11, start=start)
    assert all(b <= a * (1 + 1e-9) for a, b in zip(found.objectives, found.objectives[1:]))
    unit = found.atoms / np.linalg.norm(found.atoms, axis=0)
    match = np.abs(true.T @ unit)
    assert (match.max(axis=1) > 0.97).all()
    assert coded.count() == 1500 and len(coded.first().code) == found.atoms.shape[1]
    rest = factor.predict(x[:200, :6], list(range(6)), list(range(6, 12)), found, 1.0)
    assert ((rest - x[:200, 6:]) ** 2).mean() < 0.6 * (x[:200, 6:] ** 2).mean()


def test_atoms_without_use_go(spark):
    rng = np.random.default_rng(8)
    x = np.outer(rng.normal(size=300), [1.0, 1, 0, 0])
    found, _ = factor.fit(table_of(spark, x), "id", "v", [[0, 1], [2, 3]], 4, sparse=0.1, structure=1.0, rounds=6)
    assert found.atoms.shape[1] < 4 and np.abs(found.atoms[2:]).max() < 1e-6


# --- mixtures --------------------------------------------------------------------------------------------------------


def test_mixture_of_regressions(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=4000)
    side = rng.random(4000) < 0.3
    b = np.where(side, 3 + 2 * a, -3 - a) + 0.3 * rng.normal(size=4000)
    x = np.stack((a, b), axis=1)
    model = mixture.fit(table_of(spark, x), "v", 2, 40)
    assert all(q >= p - 1e-6 for p, q in zip(model.likelihoods, model.likelihoods[1:]))
    order = model.coefficients[1][:, 0].argsort()
    assert np.allclose(model.coefficients[1][order], [[-3, -1], [3, 2]], atol=0.1)
    assert np.allclose(model.weights[1][order], [0.7, 0.3], atol=0.03) and np.allclose(model.deviations[1], 0.3, atol=0.03)
    plain = mixture._start(moments_of(x), 2)
    for _ in range(len(model.likelihoods)):
        plain = mixture.improved(mixture.sums(x, plain), plain, 1e-8)
    assert np.allclose(plain.likelihoods, model.likelihoods, rtol=1e-9)
    got = [r.d for r in table_of(spark, x[:50]).select("id", mixture.log_density(F.col("v"), model).alias("d")).orderBy("id").collect()]
    density = lambda v, w, mu, s: np.log(sum(p * np.exp(-0.5 * ((v - u) / t) ** 2) / t / np.sqrt(2 * np.pi) for p, u, t in zip(w, mu, s)))
    by_hand = [density(r[0], model.weights[0], model.coefficients[0][:, 0], model.deviations[0]) + density(r[1], model.weights[1], model.coefficients[1] @ [1, r[0]], model.deviations[1]) for r in x[:50]]
    assert np.allclose(got, by_hand)
    assert np.allclose(model.mean(x[:5], 1), 0.7 * (-3 - x[:5, 0]) + 0.3 * (3 + 2 * x[:5, 0]), atol=0.3)


def test_mixture_of_few_rows(spark):
    assert mixture.fit(table_of(spark, np.ones((2, 2))).where("false"), "v") is None
    model = mixture.fit(table_of(spark, np.ones((3, 2))), "v", 2, 5)
    assert np.isfinite(model.log_density(np.ones((1, 2)))).all()


# --- alignment -------------------------------------------------------------------------------------------------------


def test_planted_rotations_are_found(spark):
    rng = np.random.default_rng(10)
    x, y, keys, planted = [], [], [], {}
    for k in ("a", "b", "c"):
        turn = alignment.right_handed(np.linalg.qr(rng.normal(size=(3, 3)))[0])
        shift = rng.normal(size=3) * 100
        own = rng.normal(size=(80, 3)) + 1000
        planted[k] = turn, shift
        x.append(own)
        y.append(own @ turn.T + shift)
        keys += [k] * 80
    rows = table_of(spark, np.concatenate(x), y=np.concatenate(y).tolist(), key=keys)
    rows = rows.union(spark.createDataFrame([(1, None, [0.0] * 3, "a"), (2, [0.0] * 3, None, "z")], rows.schema))
    found = {r.key: r for r in alignment.align_groups(rows, "key", "v", "y").collect()}
    assert set(found) == set(planted)
    for k, (turn, shift) in planted.items():
        assert np.allclose(np.reshape(found[k].rotation, (3, 3)), turn, atol=1e-8) and np.allclose(found[k].shift, shift, atol=1e-4)
        assert found[k].n == 80 and found[k].rmse < 1e-4
    assert alignment.align_groups(rows.where("false"), "key", "v", "y").count() == 0


def test_mirrored_points_stay_right_handed(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(50, 3))
    rows = table_of(spark, x, y=(x * [1, 1, -1]).tolist(), key=["m"] * 50)
    turn = np.reshape(alignment.align_groups(rows, "key", "v", "y").first().rotation, (3, 3))
    assert abs(np.linalg.det(turn) - 1) < 1e-9


@pytest.mark.parametrize("dims", [2, 3])
def test_rotations_between_vectors(dims):
    rng = np.random.default_rng(12)
    pairs = [(rng.normal(size=dims), rng.normal(size=dims)) for _ in range(20)] + [(np.eye(dims)[0], np.eye(dims)[0] * 3), (np.eye(dims)[0], -np.eye(dims)[0])]
    for a, b in pairs:
        r = alignment.rotation_between(a, b)
        assert np.allclose(r @ a / np.linalg.norm(a), b / np.linalg.norm(b)) and np.allclose(r.T @ r, np.eye(dims)) and abs(np.linalg.det(r) - 1) < 1e-9
    h = alignment.homogeneous(r, np.arange(dims))
    assert np.allclose(h @ np.append(a, 1), np.append(r @ a + np.arange(dims), 1))


def test_thin_plate(spark):
    rng = np.random.default_rng(13)
    knots = rng.normal(size=(30, 3))
    targets = knots + 0.3 * np.sin(2 * knots[:, ::-1])
    warp = alignment.thin_plate(knots, targets)
    assert np.allclose(warp(knots), targets, atol=1e-8) and warp.energy() > 0
    assert np.allclose(np.c_[knots, np.ones(30)].T @ warp.bends, 0, atol=1e-8)
    affine = alignment.thin_plate(knots, knots @ rng.normal(size=(3, 3)) + 5)
    assert abs(affine.energy()) < 1e-12
    soft = alignment.thin_plate(knots, targets, 1.0)
    assert soft.energy() < warp.energy() and not np.allclose(soft(knots), targets, atol=1e-3)
    x = rng.normal(size=(40, 3))
    got = [r.p for r in table_of(spark, x).select("id", alignment.warped(F.col("v"), warp).alias("p")).orderBy("id").collect()]
    assert np.allclose(got, warp(x))
    with pytest.raises(ValueError):
        alignment.thin_plate(np.zeros((alignment.MOST_KNOTS + 1, 3)), np.zeros((alignment.MOST_KNOTS + 1, 3)))
