"""Faults that a reviewer found: each test failed before its fix."""

import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewloom.functions import arrays as A
from viewloom.operators import kernels, neighbours, space_tree, statistics
from viewloom.plans import ORACLES, QUERIES
from viewloom.plans import information, records, subjects  # noqa: F401


def events_at(spark, folder, rows):
    """A folder whose only table is `events` from (user_id, value) in order of time."""
    made = [(i, user, "view", float(value)) for i, (user, value) in enumerate(rows)]
    table = spark.createDataFrame(made, "event_id long, user_id long, event_type string, value double").coalesce(1)
    table.selectExpr("event_id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, event_id) AS ts", "user_id", "event_type", "value", "'' AS props").write.parquet(f"{folder}/events.parquet")
    return str(folder)


def by_sql(duck, folder, name):
    own = duck.cursor()
    own.execute(f"CREATE OR REPLACE TEMP VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return own.execute(ORACLES[name]).fetchdf()


def test_forecast_beyond_the_reach_of_all_weights(spark, duck, same, tmp_path):
    folder = events_at(spark, tmp_path, [(1, 1.0), (1, 2.0), (1, 900.0), (2, 1.0), (2, 3.0), (2, 2.0)])
    got = QUERIES["k_step_forecast"](spark, folder).toPandas()
    same(got, by_sql(duck, folder, "k_step_forecast"))
    assert got[got.user_id == 1].forecast.isna().all() and got[got.user_id == 2].forecast.notna().all()


def exact_period(values):
    """The period and score by whole numbers of cents; ties of the sixth decimal go up."""
    best = []
    for period in range(2, 50):
        phases = defaultdict(list)
        for rn, v in enumerate(values, 1):
            phases[rn % period].append(round(v * 100))
        q = sum(Fraction(sum(p) ** 2, len(p)) for p in phases.values()) / (10_000 * len(values))
        best.append((-math.floor(q * 10**6 + Fraction(1, 2)), period))
    score, period = min(best)
    return period, -score / 10**6


def test_period_scores_at_the_border_of_a_decimal(spark, tmp_path):
    users = [20, 326, 756, 870, 895, 956]
    rows = spark.read.parquet("/root/testdata/sf0.1/events.parquet").where(F.col("user_id").isin(users)).orderBy("ts", "event_id").collect()
    folder = events_at(spark, tmp_path, [(r.user_id, r.value) for r in rows])
    got = {r.user_id: (r.period, r.score) for r in QUERIES["period_search"](spark, folder).collect()}
    assert got == {u: exact_period([r.value for r in rows if r.user_id == u]) for u in users}


def test_steady_sums_and_binary_rounding(spark, duck):
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.exponential(50, 3000).round(2), rng.normal(size=500) * 1e15, [-1e-9, 3e-12]))
    for part in (x[:3000], x[3500:]):
        frame = spark.createDataFrame([(float(v),) for v in part] + [(None,)], "v double")
        assert {frame.repartition(n).agg(A.steady_sum("v")).first()[0] for n in (1, 3, 7)} == {math.fsum(part)}
    odd = spark.createDataFrame([(1, float("inf")), (1, 1.0), (2, float("nan")), (3, None), (4, 1e300), (4, 1.0)], "k int, v double")
    got = {r.k: r.s for r in odd.groupBy("k").agg(A.steady_sum("v").alias("s")).collect()}
    assert got[1] == math.inf and math.isnan(got[2]) and got[3] is None and got[4] == 1e300
    y = [5168.2861375, 5168.286137499999, -0.0000005, 1e300, 2.5e-7, 0.0, 123.4567895]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in y], "v double").coalesce(1).select(A.rounded("v", 6)).collect()]
    assert got == [duck.execute("select round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in y]


def test_few_alignments_are_computed_and_copies_once(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.exponential(50, (1500, 8)).round(2)
    for width in (1, 2, 3, 8):
        a, b = x[:60, :width], x[60:400, :width]
        f = neighbours._end_features(b)
        assert (neighbours.dtw_bounds(a, f, f) <= neighbours.dtw(a, b) + 1e-9).all()
    compared = []
    plain = neighbours.dtw_pairs
    monkeypatch.setattr(neighbours, "dtw_pairs", lambda a, b, most: compared.append(a.shape[1]) or plain(a, b, most))
    names = np.stack((np.arange(1500), np.arange(1500) % 7, np.arange(1500), np.ones(1500)), axis=1).astype(np.int64)
    nearest = neighbours._Nearest(x[:100], np.arange(100) % 7, 5)
    nearest.add(x, names, names[:, 0])
    assert sum(compared) < 0.8 * 100 * 1500
    cost = neighbours.dtw(x[:100], x)
    cost[(np.arange(100) % 7)[:, None] == (np.arange(1500) % 7)[None]] = np.inf
    assert (nearest.cost == np.sort(cost, axis=1)[:, :5]).all() and (nearest.near[:, :, 0] == np.argsort(cost, axis=1, kind="stable")[:, :5]).all()
    monkeypatch.setattr(neighbours, "dtw_pairs", plain)
    rows = [(200 * g + i, g, x[i % 9].tolist()) for g in range(4) for i in range(30)]  # copies in and across groups
    got = {}
    for r in neighbours.dtw_nearest(spark.createDataFrame(rows, "id long, g long, v array<double>"), spark.createDataFrame(rows[::7], "id long, g long, v array<double>"), "id", "v", "g", 6).collect():
        got.setdefault(r.query, []).append((r["rank"], r.cost, r.neighbour))
    base = neighbours.dtw(x[:9], x[:9])
    want = {i: [(n + 1, *b) for n, b in enumerate(sorted((base[i % 200 % 9, j % 200 % 9], j) for j, h, _ in rows if h != g)[:6])] for i, g, _ in rows[::7]}
    assert {i: sorted(v) for i, v in got.items()} == want


@pytest.mark.parametrize("width", [4, 5, 7, 8])
def test_alignments_stay_few_beside_the_pairs(monkeypatch, width):
    rng = np.random.default_rng(7)
    x = rng.exponential(50, (6000, width)).round(2)
    compared, plain = [], neighbours.dtw_pairs
    monkeypatch.setattr(neighbours, "dtw_pairs", lambda a, b, most: compared.append(a.shape[1]) or plain(a, b, most))
    names = np.stack((np.arange(6000), np.arange(6000) % 7, np.arange(6000), np.ones(6000)), axis=1).astype(np.int64)
    cost = neighbours.dtw(x[:40], x)
    cost[(np.arange(40) % 7)[:, None] == (np.arange(6000) % 7)[None]] = np.inf
    best = np.sort(cost, axis=1)[:, :5]
    nearest = neighbours._Nearest(x[:40], np.arange(40) % 7, 5)
    nearest.add(x, names, names[:, 0])
    assert (nearest.cost == best).all() and sum(compared) < 0.08 * 40 * 6000
    compared.clear()
    nearest = neighbours._Nearest(x[:40], np.arange(40) % 7, 5, best[:, -1])  # as where another task has found them
    for half in (slice(0, 3000), slice(3000, None)):
        nearest.add(x[half], names[half], names[half, 0])
    assert (nearest.cost == best).all() and sum(compared) < 0.04 * 40 * 6000


def test_floors_of_alignments():
    rng = np.random.default_rng(8)
    for width in range(2, 13):
        for a, b in (
            (rng.exponential(50, (40, width)), rng.exponential(50, (60, width))),
            (rng.normal(size=(40, width)) - 1, rng.normal(size=(60, width)) + 2),  # ranges that seldom meet
            (rng.integers(0, 3, (40, width)).astype(float), rng.integers(1, 5, (60, width)).astype(float)),
        ):
            cost = neighbours.dtw(a, b)
            for m in range(1, min(4, width // 2) + 1):
                assert (neighbours.dtw_floor(a.T[:, :, None], b.T[:, None], m) <= cost + 1e-9).all()


@pytest.mark.parametrize("offset, scale", [(0, 1), (1e8, 1), (0, 1e-170), (0, 1e-44), (0, 1e30), (3.4e38, 1e36), (0, 1e300), (-1.7e308, 1e290)])
def test_bounds_in_single_precision_lose_no_neighbour(offset, scale):
    rng = np.random.default_rng(9)
    for width in (1, 2, 3, 4, 6, 8, 11):
        x = offset + scale * np.round(rng.exponential(50, (400, width)) / (1, 5)[width % 2])
        names = np.stack((np.arange(400), np.arange(400) % 3, np.arange(400), np.ones(400)), axis=1).astype(np.int64)
        with np.errstate(over="ignore"):
            cost = neighbours.dtw(x[:30], x)
        cost[(np.arange(30) % 3)[:, None] == (np.arange(400) % 3)[None]] = np.inf
        want = np.argsort(cost, axis=1, kind="stable")[:, :4]
        best = np.take_along_axis(cost, want, 1)
        for limit in (None, best[:, -1].copy()):
            nearest = neighbours._Nearest(x[:30], np.arange(30) % 3, 4, limit)
            for at in range(0, 400, 150):
                nearest.add(x[at : at + 150], names[at : at + 150], names[at : at + 150, 0])
            assert (nearest.cost == best).all() and (nearest.near[:, :, 0] == want).all()


@pytest.mark.parametrize("block", [2000, 2])
def test_aligned_windows_over_many_tasks(spark, monkeypatch, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "CHUNK", 64)
    rng = np.random.default_rng(10)
    x = rng.exponential(50, (500, 8)).round(2)
    x[200:260] = x[0]  # copies, in all groups
    x[260:300] = rng.integers(0, 2, (40, 8))  # ties
    ids = rng.permutation(3000)[:500]
    rows = [(int(i), int(rng.integers(6)), v.tolist()) for i, v in zip(ids, x)] + [(4000, 1, [1.0, 2.0, 3.0]), (4001, 2, [1.0, 2.0, 4.0]), (4002, 2, None), (4003, 2, [float("nan")] * 8)]
    table = spark.createDataFrame(rows, "id long, g int, v array<double>").repartition(5)
    got = defaultdict(list)
    for r in neighbours.dtw_nearest(table, table.where("id % 7 = 0 or id = 4000"), "id", "v", "g", 6).collect():
        got[r.query].append((r["rank"], r.cost, r.neighbour))
    cost = neighbours.dtw(x, x)
    want = {4000: [(1, 1.0, 4001)]}
    for q in np.flatnonzero(ids % 7 == 0):
        best = sorted((cost[q, j], rows[j][0]) for j in range(500) if rows[j][1] != rows[q][1])[:6]
        want[rows[q][0]] = [(n + 1, *b) for n, b in enumerate(best)]
    assert {q: sorted(v) for q, v in got.items()} == want


@pytest.mark.parametrize("most", [2000, 2])
def test_centred_kernel_moves_no_kernel_values(spark, duck, same, tmp_path, monkeypatch, most):
    monkeypatch.setattr(kernels, "QUERIES", most)
    monkeypatch.setattr(kernels, "ENTRIES", 50)
    rng = np.random.default_rng(2)
    rows = [(100 * i if i < 5 else i, rng.normal(size=4).tolist()) for i in range(60)] + [(7, [0.5, 0.0, 0.0, 0.0]), (7, [9e5, 1.0, 0.0, 0.0]), (61, None), (600, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(statistics, "double_centred", None)  # it joins and shuffles the kernel itself
    got = QUERIES["gram_center"](spark, str(tmp_path)).toPandas()
    own = duck.cursor()
    own.execute(f"CREATE OR REPLACE TEMP VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = own.execute(ORACLES["gram_center"]).fetchdf()
    assert len(got) == 6 * 64
    same(got, want)


def test_rows_meet_close_boxes_only():
    rng = np.random.default_rng(3)
    low = rng.uniform(0, 100, (2000, 2))
    high, x, reach = low + 1, 50 + rng.uniform(size=(300, 2)), rng.uniform(0.1, 2, 300)
    away = np.sqrt((np.maximum(np.maximum(low[None] - x[:, None], x[:, None] - high[None]), 0) ** 2).sum(axis=2))
    close = space_tree._close(x, reach, low, high)
    assert set(np.flatnonzero((away <= reach[:, None]).any(axis=0))) <= set(close) and len(close) < 40
    assert len(space_tree._close(x, np.full(300, np.inf), low, high)) == 2000


@pytest.mark.parametrize("boxes", [32 << 20, 10 * 2 * 8 * 12])
def test_vectors_are_not_written_for_each_leaf_they_look_into(spark, monkeypatch, boxes):
    rng = np.random.default_rng(4)
    x = np.concatenate((rng.normal(size=(350, 12)), 500 + 80 * np.arange(8).repeat(20)[:, None] + rng.normal(size=(160, 12))))
    x = np.round(x * 2) / 2  # ties, in rows that are near to all others and in clusters
    x[100:130] = x[0]
    ids, tables, plain = rng.permutation(2000)[: len(x)], [], space_tree.written
    monkeypatch.setattr(space_tree, "BOX_BYTES", boxes)
    monkeypatch.setattr(space_tree, "written", lambda df, name="table": tables.append((name, plain(df, name))) or tables[-1][1])
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, x array<double>").repartition(4)
    got = sorted((r.query, r["rank"], r.neighbour, round(r.dist, 9)) for r in space_tree.all_knn(frame, "id", "x", 4, leaf_rows=16).collect())
    squares = ((x[:, None] - x[None]) ** 2).sum(axis=2)  # exact, by the rounding
    np.fill_diagonal(squares, np.inf)
    near = np.lexsort((np.broadcast_to(ids, squares.shape), squares), axis=1)[:, :4]
    assert got == sorted((int(ids[q]), r + 1, int(ids[n]), round(math.sqrt(squares[q, n]), 9)) for q in range(len(x)) for r, n in enumerate(near[q]))
    blocks = -(-next(t for n, t in tables if n == "leaves").count() * 2 * 8 * 12 // boxes)
    looking = sum(t.agg(F.sum(F.length("looking"))).first()[0] or 0 for n, t in tables if n == "visits")
    assert blocks > 1 or looking <= 6 * x.nbytes
    assert any(n == "visits" and "looking" in t.columns and t.where("leaf is not null").count() for n, t in tables)


def test_bounds_by_products_lose_no_pair():
    rng = np.random.default_rng(5)
    for x, y in (
        (rng.normal(size=(40, 6)), rng.normal(size=(50, 6))),
        (1e8 + rng.normal(size=(40, 6)), 1e8 + rng.normal(size=(50, 6))),
        (rng.integers(0, 2, (40, 3)) * 1e-170, rng.integers(0, 2, (50, 3)) * 1e-170),
        (rng.normal(size=(40, 2)) * 1e154, rng.normal(size=(50, 2)) * 1e154),
        (rng.uniform(-1, 1, (40, 2)) * 1.7e308, rng.uniform(-1, 1, (50, 2)) * 1.7e308),
    ):
        with np.errstate(over="ignore", invalid="ignore"):
            dist = np.sqrt(space_tree._squares(x, y))
        for reach in (np.sort(dist, axis=1)[:, 3], np.full(40, np.inf), dist.min(axis=1)):
            assert set(zip(*np.nonzero(dist <= reach[:, None]))) <= set(zip(*space_tree._near_pairs(x, y, reach)))
    x, y = rng.normal(size=(40, 6)) + 1e4, rng.normal(size=(50, 6)) + 1e4
    dist = np.sqrt(space_tree._squares(x, y))
    assert len(space_tree._near_pairs(x, y, np.sort(dist, axis=1)[:, 3])[0]) == 160
