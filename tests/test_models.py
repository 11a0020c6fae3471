"""The queries without a SQL twin, and the operators behind them, against plain NumPy on the smallest tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewloom.functions import arrays as A
from viewloom.functions import flows
from viewloom.operators import statistics as S
from viewloom.plans import QUERIES
from viewloom.plans import grids, models, records, subjects, synthetic  # noqa: F401
from viewloom.sources import tables as T

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r.embedding for r in rows], float), np.array([r.label for r in rows]), [r.vec_id for r in rows]


def views(x):
    return [x[:, 16 * k : 16 * k + 16] for k in range(4)]


def correlations(a, b):
    """Canonical correlations from orthonormal bases of the centred columns."""
    qa, qb = (np.linalg.qr(v - v.mean(0))[0] for v in (a, b))
    return np.linalg.svd(qa.T @ qb, compute_uv=False)


def test_cca(spark, vectors):
    v = views(vectors[0])
    for r in QUERIES["cca_views"](spark, SMALL).where("i < 3").collect():
        assert abs(r.r - correlations(v[r.a], v[r.b])[r.i]) < 1e-3
    for r in QUERIES["one_vs_rest_cca"](spark, SMALL).where("i < 3").collect():
        assert abs(r.r - correlations(v[r.view], np.hstack([v[k] for k in range(4) if k != r.view]))[r.i]) < 1e-3


def test_pca_keeps_the_variance(spark, vectors):
    rows = QUERIES["pca_views"](spark, SMALL).orderBy("vec_id").collect()
    for k, v in enumerate(views(vectors[0])):
        codes = np.array([r[f"code{k}"] for r in rows])
        values = np.linalg.eigvalsh(np.cov(v.T, bias=True))[::-1]
        assert np.allclose(codes.var(axis=0), values[: codes.shape[1]], rtol=1e-6)
        assert values[: codes.shape[1]].sum() >= 0.9 * values.sum() > values[: codes.shape[1] - 1].sum()


def test_regressions(spark, vectors):
    x = vectors[0] - vectors[0].mean(0)
    v = views(x)
    for r in QUERIES["ridge_redundancy_matrix"](spark, SMALL).collect():
        w = np.linalg.lstsq(v[r.source], v[r.target], rcond=None)[0]
        assert abs(r.error - ((v[r.target] - v[r.source] @ w) ** 2).mean() / (v[r.target] ** 2).mean()) < 5e-3
    for r in QUERIES["view_error_matrix"](spark, SMALL).where("mask in (1, 5, 7)").collect():
        inputs = np.hstack([v[k] for k in range(4) if r.mask >> k & 1])
        w = np.linalg.lstsq(inputs, v[r.target], rcond=None)[0]
        plain = ((v[r.target] - inputs @ w) ** 2).sum()
        assert abs(r.squared_error - plain) < 1e-2 * plain
    greedy = QUERIES["greedy_view_order"](spark, SMALL).orderBy("target", "step").collect()
    for t in range(4):
        errors = [r.error for r in greedy if r.target == t]
        assert all(a >= b - 1e-9 for a, b in zip(errors, errors[1:])) and len({r.view for r in greedy if r.target == t}) == len(errors)
    curves = QUERIES["view_order_curves"](spark, SMALL).collect()
    matrix = {(r.mask, r.target): r.squared_error for r in QUERIES["view_error_matrix"](spark, SMALL).collect()}
    for r in curves:
        assert r.squared_error == matrix[sum(1 << int(c) for c in r.view_order[: r.step + 1]), r.target]


def test_imputation_is_the_conditional_mean(spark, vectors):
    x = vectors[0]
    c, m = np.cov(x.T, bias=True), x.mean(0)
    gain = np.linalg.solve(c[:48, :48], c[:48, 48:])
    guess = m[48:] + (x[:, :48] - m[:48]) @ gain
    rows = QUERIES["gaussian_view_imputation"](spark, SMALL).orderBy("vec_id").collect()
    assert np.allclose([r.guess for r in rows], guess, atol=1e-3)


def test_knn_entropy_of_the_queries(spark, vectors):
    from math import gamma, pi

    x, _, ids = vectors
    p = x[:, :3]
    third = [np.sort(np.sqrt(((p - p[i]) ** 2).sum(1)))[3] for i, k in enumerate(ids) if k % 100 == 0]
    digamma = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, n))
    want = 3 * np.log(third).mean() + digamma(len(p)) - digamma(3) + np.log(pi**1.5 / gamma(2.5))
    got = QUERIES["knn_entropy"](spark, SMALL).first()
    assert got.queries == len(third) and abs(got.nats - want) < 1e-5


def test_dtw_against_the_whole_table(spark):
    series = {}
    for r in T.event_series(spark, SMALL).orderBy("user_id", "rn").collect():
        series.setdefault(r.user_id, []).append(r.value)
    target = series[min(series)][:8]
    for r in QUERIES["dtw_match"](spark, SMALL).collect():
        x = series[r.user_id]
        best = {}

        def cost(i, j):
            """Each step of the target moves 0, 1 or 2 on in the series."""
            if j < 0:
                return np.inf
            if (i, j) not in best:
                best[i, j] = abs(target[i] - x[j]) + (min(cost(i - 1, j - s) for s in (0, 1, 2)) if i else 0)
            return best[i, j]

        assert r.cost == pytest.approx(min(cost(len(target) - 1, j) for j in range(len(x))), abs=1e-5)


def test_mutual_information_on_the_grid(spark):
    got = QUERIES["mutual_info_nats_2d"](spark, SMALL).first()
    assert got.n == sum(r["count"] - 1 for r in spark.read.parquet(f"{SMALL}/events.parquet").groupBy("user_id").count().collect()) and got.nats > 0


def test_clusters_share_information_with_labels(spark):
    got = {(r.a, r.b): r.bits for r in QUERIES["kmeans_mi_matrix"](spark, SMALL).collect()}
    assert len(got) == 10 and all(0 <= b <= np.log2(10) + 1e-9 for b in got.values())


def test_classifiers_beat_their_chance(spark):
    rows = QUERIES["downstream_accuracy"](spark, SMALL).collect()
    assert len(rows) == 8 and all(r.accuracy >= 0.5 for r in rows if r.train)


def test_every_flow_goes_back(spark):
    rows = spark.createDataFrame([([0.3, 0.2, 0.9, 0.5],), ([0.01, 0.99, 0.4, 0.6],)], "v array<double>")
    kinds = {"reverse": {}, "leaky_relu": {"slope": 0.3}, "scale_shift": {"first": 1, "log_scale": -0.2, "shift": 0.5}, "chain_linear": {"below": -0.7, "diagonal": 1.5}, "logit": {}}
    for kind, settings in kinds.items():
        flow = flows.make(kind, **settings)
        y, det = flow.forward(F.col("v"))
        for r in rows.select("v", y.alias("y"), det.alias("det")).select("v", "y", "det", flow.inverse(F.col("y")).alias("back")).collect():
            assert np.allclose(r.back, r.v)
            jacobian = []
            for k in range(4):
                h = np.zeros(4)
                h[k] = 1e-6
                moved = spark.createDataFrame([((np.array(r.v) + h).tolist(),)], "v array<double>").select(flow.forward(F.col("v"))[0].alias("y")).first().y
                jacobian.append((np.array(moved) - r.y) / 1e-6)
            assert abs(np.linalg.slogdet(np.array(jacobian))[1] - r.det) < 1e-4
    with pytest.raises(ValueError):
        flows.make("unknown")


def test_exact_quantiles_of_hot_and_few_values(spark):
    values = [5.0] * 700 + list(map(float, range(300))) + [1e9]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    for p in (0.0, 0.25, 0.5, 0.9, 0.99, 1.0):
        assert S.exact_quantile(rows, "x", p).first()["quantile"] == pytest.approx(np.quantile(values, p))
    assert S.exact_quantile(rows.where("x = 1e9"), "x", 0.3).first()["quantile"] == 1e9
    assert S.exact_quantile(rows.where("false"), "x", 0.3).count() == 0


def test_partitioned_sink_can_be_restarted(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    T.write_partitioned(rows, str(tmp_path / "out"), ["k"])
    T.write_partitioned(rows.where("k = 2").withColumn("v", F.lit("c")), str(tmp_path / "out"), ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "a"), (2, "c")]


def test_strides_are_counted_over_all_lines(spark):
    lines = spark.range(0, 1000, 1, 7).select("id", F.concat_ws("\t", "id", (F.col("id") * 2).cast("string")).alias("value"))
    got = T.read_delimited(lines, ["a", "b"], every=9, order="id").collect()
    assert sorted(int(r.a) for r in got) == list(range(0, 1000, 9))


def test_linf_prox_against_sorting(spark):
    rng = np.random.default_rng(4)
    rows = [rng.normal(size=6).tolist() for _ in range(40)] + [[0.1] * 6, [3.0] + [0.0] * 5]
    got = spark.createDataFrame([(r,) for r in rows], "v array<double>").select("v", A.linf_cut(F.col("v")).alias("cut")).collect()
    for r in got:
        u = np.sort(np.abs(r.v))[::-1]
        cuts = (np.cumsum(u) - 1) / np.arange(1, 7)
        want = None if u.sum() <= 1 else cuts[np.flatnonzero(u > cuts).max()]
        assert r.cut == want or abs(r.cut - want) < 1e-9


def test_total_variation_derivative_minimises_its_objective():
    from viewloom.operators import linear as M

    rng = np.random.default_rng(2)
    assert np.allclose(M.tv_derivative(2.0 * np.arange(60), 1.0, 0.1, 30)[5:-5], 2.0, atol=0.1)
    kink = M.tv_derivative(np.abs(np.arange(80) - 40.0) + rng.normal(0, 0.05, 80), 1.0, 0.5, 60)
    assert np.allclose(kink[5:33], -1, atol=0.15) and np.allclose(kink[47:75], 1, atol=0.15)
    x = np.cumsum(rng.normal(size=40))
    u = M.tv_derivative(x, 1.0, 0.3, 200)
    a = np.tril(np.ones((40, 40))) - 0.5 * np.eye(40)
    loss = lambda v: ((a @ v - (x - x[0])) ** 2).sum() / 2 + 0.3 * np.sqrt(np.diff(v) ** 2 + 1e-6).sum()
    assert all(loss(u) <= loss(u + h * np.eye(40)[k]) + 1e-6 for k in range(40) for h in (-0.02, 0.02))


def test_joint_sparse_regression_minimises_its_objective(spark, vectors):
    from viewloom.operators import linear as M

    x = vectors[0]
    m = M.Moments(len(x), x.mean(0), np.cov(x.T, bias=True))
    inputs, outputs, lam = list(range(12)), [40, 41], 0.01
    w = M.l21_regression(m, inputs, outputs, lam, rounds=2000, tol=1e-12)
    cxx, cxy = m.cov[:12, :12], m.cov[np.ix_(inputs, outputs)]
    loss = lambda v: np.trace(v.T @ cxx @ v) / 2 - np.trace(v.T @ cxy) + lam * np.sqrt((v**2).sum(1)).sum()
    for i in range(12):
        for j in range(2):
            for h in (-1e-3, 1e-3):
                moved = w.copy()
                moved[i, j] += h
                assert loss(w) <= loss(moved) + 1e-6
    got = QUERIES["l21_regression"](spark, SMALL).collect()
    assert len(got) == 48 and all(r.norm >= 0 for r in got)


def test_rank_deficient_and_shifted_moments(spark):
    from viewloom.operators import linear as M

    rows = spark.createDataFrame([([1e9 + i, 1e9 - i],) for i in range(50)] + [(None,)], "v array<double>")
    m = M.moments(rows, "v")
    assert m.n == 50 and np.allclose(m.cov, np.array([[1, -1], [-1, 1]]) * np.var(np.arange(50)), rtol=1e-9)
    assert M.moments(rows.where("v is null"), "v").n == 0
