"""Nearest neighbours of every row against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewloom.operators import space_tree


def plain_knn(ids, x, k):
    found = []
    for i, own in zip(ids, x):
        d = sorted((np.sqrt(sum((a - b) ** 2 for a, b in zip(own, other))), j) for j, other in zip(ids, x) if j != i)
        found += [(i, j, round(float(v), 9), r) for r, (v, j) in enumerate(d[:k], 1)]
    return sorted(found)


def got_knn(frame, **given):
    return sorted((r.query, r.neighbour, round(r.dist, 9), r.rank) for r in space_tree.all_knn(frame, "id", "x", **given).collect())


def frame_of(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(a) for a in v]) for i, v in zip(ids, x)], "id long, x array<double>").repartition(4)


@pytest.mark.parametrize("trees", [1024, 2])
def test_all_rows_by_brute_force(spark, monkeypatch, trees):
    monkeypatch.setattr(space_tree, "TREES", trees)  # 2: nodes are split by their own rows
    monkeypatch.setattr(space_tree, "DEPTH", 2)
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(300, 3)) * 4) / 4  # ties and copies
    x[:40] = x[0]
    ids = rng.permutation(1000)[:300] - 500
    assert got_knn(frame_of(spark, ids, x), k=4, leaf_rows=16) == plain_knn(ids.tolist(), x.tolist(), 4)


def test_few_pairs_are_compared_on_clustered_rows(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 8)) * 20
    x = np.concatenate([c + rng.normal(size=(50, 8)) for c in centres])
    counted = spark.sparkContext.accumulator(0)
    got = got_knn(frame_of(spark, range(2000), x), k=3, leaf_rows=32, counted=counted)
    assert 0 < counted.value < 0.1 * 2000**2
    near = np.argsort(((x[:, None] - x[None]) ** 2).sum(axis=2), axis=1, kind="stable")[:, 1:4]
    assert [n for _, n, _, _ in sorted(got, key=lambda r: (r[0], r[3]))] == near.ravel().tolist()


def test_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, [3.0, 4.0]), (None, [1.0, 1.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 0.0]), (6, [1.0]), (7, [0.0, 0.0])]
    frame = spark.createDataFrame(rows, "id long, x array<double>")
    assert got_knn(frame, k=5) == [(1, 2, 5.0, 2), (1, 7, 0.0, 1), (2, 1, 5.0, 1), (2, 7, 5.0, 2), (7, 1, 0.0, 1), (7, 2, 5.0, 2)]
    assert got_knn(frame.where("false"), k=2) == [] and got_knn(frame.where("id = 1"), k=2) == []


def test_box_blocks_and_settings(spark, monkeypatch):
    monkeypatch.setattr(space_tree, "BOX_BYTES", 200)  # many blocks of boxes
    rng = np.random.default_rng(3)
    x, before = rng.normal(size=(120, 2)), {r.key: r.value for r in spark.sql("SET").collect()}
    assert got_knn(frame_of(spark, range(120), x), k=3, leaf_rows=16) == plain_knn(list(range(120)), x.tolist(), 3)
    assert {r.key: r.value for r in spark.sql("SET").collect()} == before


def test_entropy_of_a_normal_variable(spark):
    rng = np.random.default_rng(0)
    mix = np.array([[1, 0, 0], [0, 1, 0.5], [0, 0, 1]])
    x = rng.normal(size=(4000, 3)) @ mix.T
    got = space_tree.neighbour_entropy(frame_of(spark, range(4000), x), "id", "x", 5).first()
    assert got.n == 4000 and abs(got.nats - (1.5 * (1 + np.log(2 * np.pi)) + 0.5 * np.log(np.linalg.det(mix @ mix.T)))) < 0.06


def test_information_of_two_normal_variables(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=3000)
    b = 0.8 * a + 0.6 * rng.normal(size=3000)
    rows = frame_of(spark, range(3000), np.stack([a, b], axis=1)).select("id", F.slice("x", 1, 1).alias("a"), F.slice("x", 2, 1).alias("b"))
    assert abs(space_tree.neighbour_information(rows, "id", ["a", "b"], 5) + 0.5 * np.log(1 - 0.64)) < 0.06


def test_splits_halve_the_sample():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(640, 3))
    counts = np.bincount(space_tree.leaf_of(x, *space_tree.splits(x, 4)), minlength=16)
    assert (counts == 40).all()
    same = np.zeros((10, 2))
    assert set(space_tree.leaf_of(same, *space_tree.splits(same, 3))) == {0}
    assert len(set(space_tree.leaf_of(np.array([[0.0], [0], [0], [1]]), *space_tree.splits(np.array([[0.0], [0], [0], [1]]), 1)))) == 2
