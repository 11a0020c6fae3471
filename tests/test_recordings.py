"""Recordings by subject, fixed samples, classes of codes, missing views and kernel components against plain versions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from viewloom.functions import arrays as A
from viewloom.operators import kernels, recordings
from viewloom.operators import statistics as S
from viewloom.operators import views as V
from viewloom.plans import QUERIES
from viewloom.plans import recordings as plans  # noqa: F401  (it registers queries)

SMALL = "/root/testdata/sf0.001"


def subjects(spark):
    """One subject with most of the rows, one with a single row, one with equal values, rows without a subject."""
    rng = np.random.default_rng(5)
    rows = [(0, float(x), 2.0 * float(x)) for x in rng.normal(3, 2, 300)] + [(1, 7.0, 1.0)] + [(2, 4.0, float(i)) for i in range(6)] + [(None, 1.0, 1.0)] * 3
    rows += [(3 + i // 4, float(i), -float(i)) for i in range(28)]
    return rows, spark.createDataFrame(rows, "subject long, a double, b double")


def test_subjects_stay_on_one_side(spark):
    rows, frame = subjects(spark)
    got = recordings.by_subject(frame, "subject", ["a", "b"], 0.6).toPandas()
    assert len(got) == len([r for r in rows if r[0] is not None])
    sides = got.groupby("subject")["part"].agg(["min", "max"])
    assert (sides["min"] == sides["max"]).all()
    assert (sides["min"] == "train").sum() == math.floor(0.6 * len(sides))


def test_channels_are_scaled_by_their_subject(spark):
    rows, frame = subjects(spark)
    got = recordings.by_subject(frame, "subject", ["a", "b"], 0.6).toPandas()
    for s, own in got.groupby("subject"):
        for c in "ab":
            x = own[c].to_numpy()
            scale = x.std() if x.std() > 1e-3 else 1.0
            assert np.allclose(own[f"z_{c}"], (x - x.mean()) / scale, atol=1e-9)


def test_subjects_of_nothing(spark):
    _, frame = subjects(spark)
    assert recordings.by_subject(frame.limit(0), "subject", ["a"], 0.5).count() == 0
    assert recordings.by_subject(frame.where("subject is null"), "subject", ["a"], 0.5).count() == 0


def plain_samples(x, dx, size, share):
    found = []
    for at in range(0, len(x) - size + 1, size):
        own, slopes = x[at : at + size], dx[at : at + size]
        if (own.sum(1) == 0).sum() > share * size:
            continue
        scale = own[:, 0].std() or 1.0
        found.append(np.hstack(((own - own[:, 0].mean()) / scale, slopes / scale)))
    return found


@pytest.mark.parametrize("n", [0, 4, 5, 10, 23])
def test_samples_by_brute_force(spark, n):
    rng = np.random.default_rng(n)
    x, dx = rng.integers(0, 3, (n, 2)).astype(float), rng.normal(size=(n, 1))
    x[: min(n, 5), 0] = 1.0  # a first sample without deviation
    rows = [(1, i + 1, *map(float, x[i]), float(dx[i, 0])) for i in range(n)]
    frame = spark.createDataFrame(rows, "k int, rn long, a double, b double, da double")
    got = recordings.fixed_samples(frame, ["k"], 5, ["a", "b"], ["da"], zero_share=0.2).orderBy("sample", "pos").toPandas()
    want = plain_samples(x, dx, 5, 0.2)
    assert len(got) == 5 * len(want)
    if want:
        assert np.allclose(got[["a", "b", "da"]].to_numpy(), np.vstack(want))
        assert sorted(set(got["pos"])) == list(range(5))


def test_null_channels_count_as_nothing(spark):
    frame = spark.createDataFrame([(1, 1, None), (1, 2, 2.0), (2, 1, None), (2, 2, None)], "k int, rn long, a double")
    got = recordings.fixed_samples(frame, ["k"], 2, ["a"], [], zero_share=0.5)
    assert {(r.k, r.pos, r.a) for r in got.collect()} == {(1, 0, None), (1, 1, 0.0)}


def test_classes_of_codes(spark):
    records = spark.createDataFrame([(1, ["x", "y"]), (1, ["x", None]), (2, ["lost"]), (3, []), (4, None), (None, ["z"])], "r int, codes array<string>")
    statements = spark.createDataFrame([("x", "B"), ("y", "A"), ("y", "C"), ("z", "A"), ("w", None), (None, "D"), ("x", "B")], "code string, klass string")
    got = {r.r: r.classes for r in recordings.code_classes(records, ["r"], F.col("codes"), statements, "code", "klass").collect()}
    assert got == {1: ["A", "B", "C"], 2: [], 3: [], 4: [], None: ["A"]}


def test_joint_states_are_numbered(spark):
    rows = [(-1.5, 0.5), (2.5, 0.49), (0.0, 3.0), (None, 1.0)]
    got = S.quantised(spark.createDataFrame(rows, "a double, b double"), ["a", "b"]).select("q_a", "q_b", "state").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(0, 1, 6), (5, 0, 5), (2, 3, 20), (None, 1, None)], key=str)


def test_views_that_a_row_has(spark):
    rows = [(1, [1.0, 2.0], [3.0, 4.0]), (2, None, [5.0, 6.0]), (3, None, None)]
    frame = spark.createDataFrame(rows, "id int, a array<double>, b array<double>")
    both = [F.col("a"), F.col("b")]
    got = frame.select("id", V.available(both).alias("n"), V.mean_code(both, 2).alias("c"), *both).withColumn("s", V.code_spread(both, F.col("c")))
    assert {(r.id, r.n, tuple(r.c or ()), r.s) for r in got.collect()} == {(1, 2, (2.0, 3.0), 2.0), (2, 1, (5.0, 6.0), 0.0), (3, 0, (), None)}
    long = V.per_view(frame, ["id"], ["a", "b"])
    assert {(r.id, r.view, tuple(r.x)) for r in long.collect()} == {(1, 0, (1.0, 2.0)), (1, 1, (3.0, 4.0)), (2, 1, (5.0, 6.0))}


def test_overwritten_entries_are_clipped(spark):
    frame = spark.createDataFrame([([0.5, -1.0, 0.2, 9.0], [7.0, 0.1, -3.0, 0.4])], "base array<double>, s array<double>")
    got = frame.select(V.overwrite(F.col("base"), F.col("s"), [0, 1, 0, 1], F.lit(1)).alias("y")).first().y
    assert got == [0.5, 0.1, 0.2, 0.4]
    assert frame.select(V.overwrite(F.col("base"), F.col("s"), [0, 1, 0, 1], F.lit(3)).alias("y")).first().y == [0.5, 0.0, 0.2, 1.0]


def exact_components(x, gamma, width):
    """Kernel components from the whole centred Gram matrix."""
    g = kernels.gaussian(x, x, gamma)
    centre = np.eye(len(x)) - 1 / len(x)
    values, vectors = np.linalg.eigh(centre @ g @ centre)
    return values[::-1][:width], vectors[:, ::-1][:, :width] * np.sqrt(values[::-1][:width].clip(min=0))


def test_kernel_components_are_exact_when_all_rows_are_landmarks(spark):
    rng = np.random.default_rng(2)
    ring = rng.uniform(0, 2 * np.pi, 60)
    x = np.vstack((np.c_[np.cos(ring), np.sin(ring)] * np.repeat([1.0, 3.0], 30)[:, None], rng.normal(size=(20, 2))))
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(999, None)], "i int, v array<double>")
    model = kernels.kernel_pca(rows, "v", kernels.landmark_rows(rows, "i", "v", 500), 0.7, 4)
    values, want = exact_components(x, 0.7, 4)
    assert np.allclose(model.variances * len(x), values, rtol=1e-6)
    got = rows.where("v is not null").select("i", kernels.components(F.col("v"), model).alias("c")).orderBy("i").collect()
    got = np.array([r.c for r in got])
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-5)


def test_more_landmarks_explain_more(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", A.doubles("embedding").alias("v"))
    found = [kernels.kernel_pca(rows, "v", kernels.landmark_rows(rows, "vec_id", "v", most), 0.5, 3).variances.sum() for most in (8, 32, 100000)]
    x = np.array([r.v for r in rows.orderBy("vec_id").collect()])
    whole = exact_components(x, 0.5, 3)[0].sum() / len(x)
    assert found[0] < found[1] <= found[2] + 1e-12
    assert found[2] == pytest.approx(whole, rel=1e-6)


def test_repeated_and_missing_rows_are_no_landmarks(spark):
    rows = spark.createDataFrame([(1, [1.0]), (2, [1.0]), (None, [2.0]), (3, None), (4, [3.0])], "i int, v array<double>")
    assert sorted(kernels.landmark_rows(rows, "i", "v", 10).ravel()) == [1.0, 3.0]
    assert kernels.kernel_pca(rows, "v", kernels.landmark_rows(rows.limit(0), "i", "v", 10), 1.0, 2) is None


def test_kernel_query_places_every_row(spark):
    got = QUERIES["kernel_components"](spark, SMALL).toPandas()
    assert len(got) == len(pd.read_parquet(f"{SMALL}/embeddings.parquet")) and got["codes"].map(len).eq(3).all()
    centred = np.stack(got["codes"])
    assert np.abs(centred.mean(0)).max() < 1e-4 and np.abs(np.corrcoef(centred.T) - np.eye(3)).max() < 1e-2
