"""Small golden vectors, and NumPy versions of the kernels."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from viewloom.functions import arrays as A
from viewloom.operators import evaluation as E
from viewloom.operators import labels as L
from viewloom.operators import linear as M
from viewloom.operators import series as R
from viewloom.operators import statistics as S
from viewloom.operators import views as V
from viewloom.sources import tables as T

A5, B5, C5 = [1, 2, 1, 2, 1], [2, 1, 2, 1, 1], [2, 1, 2, 2, 1]


def bits(df):
    return df.first()["bits"]


@pytest.fixture(scope="module")
def abc(spark):
    return spark.createDataFrame(list(zip(A5, B5, C5)), "a int, b int, c int")


def test_entropies(abc):
    assert [round(bits(S.entropy(abc, [x])), 6) for x in "abc"] == [0.970951] * 3
    assert round(bits(S.entropy(abc, ["a", "b"])), 6) == 1.521928
    assert round(bits(S.entropy(abc, ["a", "c"])), 6) == 1.921928


def test_information(abc):
    assert round(bits(S.mutual_information(abc, ["a"], ["b"])), 6) == 0.419973
    assert round(bits(S.mutual_information(abc, ["a"], ["c"])), 6) == 0.019973
    assert round(bits(S.conditional_entropy(abc, ["a"], ["b"])), 6) == 0.550978
    assert round(bits(S.conditional_mutual_information(abc, ["a"], ["c"], ["b"])), 6) == 0.150978
    assert abs(bits(S.conditional_mutual_information(abc, ["a"], ["c"], ["b", "c"]))) < 1e-9


@pytest.mark.parametrize("keep, want", [(True, [0, 4, 6]), (False, [0, 4])])
def test_window_starts(spark, keep, want):
    assert spark.range(1).select(R.window_starts(F.lit(10), 4, keep)).first()[0] == want
    series = spark.range(1, 11).select(F.lit(1).alias("k"), F.col("id").alias("rn"))
    rows = R.count_windows(series, ["k"], 4, keep).groupBy("win").agg(F.min("rn").alias("s"), F.count("*").alias("n")).orderBy("win").collect()
    assert [r["s"] - 1 for r in rows] == want and all(r["n"] == 4 for r in rows)


def test_box_smooth(spark):
    rows = spark.createDataFrame([(1, i + 1, float(v)) for i, v in enumerate([1, 2, 3, 4])] + [(2, 1, 6.0)], "k int, rn int, v double")
    found = {(r["k"], r["rn"]): round(r["smooth"], 6) for r in R.box_smooth(rows, ["k"], "v").collect()}
    assert found == {(1, 1): 1.0, (1, 2): 2.0, (1, 3): 3.0, (1, 4): 2.333333, (2, 1): 2.0}


def test_forward_label_is_left_search(spark):
    points = spark.createDataFrame([(1, 10.0, 1), (1, 20.0, 2), (1, 30.0, 3)], "k int, t double, label int")
    samples = spark.createDataFrame([(1, t) for t in (5.0, 10.0, 10.5, 20.0, 30.0, 31.0)], "k int, t double")
    found = L.asof_forward(samples, points, "k", "t", "label").orderBy("t").collect()
    assert [r["label"] for r in found] == [1, 1, 2, 2, 3, 3]


def test_interpolation(spark):
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate([None, 0.0, 30.0, None, None, 50.0])], "id int, k int, t double")
    found = [round(r["t"], 6) for r in T.interpolate_missing(rows, "id", "k", "t").orderBy("k").collect()]
    assert found == [0.0, 0.0, 30.0, 36.666667, 43.333333, 50.0]


def test_histogram(spark):
    rows = spark.createDataFrame([(v,) for v in (-100.0, -90.0, -89.999, 0.0, 99.0, 100.0)], "v double")
    found = {r["bin"]: r["n"] for r in S.histogram(rows, "v", -100, 100, 20).collect()}
    assert len(found) == 20 and {k: n for k, n in found.items() if n} == {0: 1, 1: 2, 10: 1, 19: 2}


def test_prox(spark):
    v = spark.createDataFrame([([-2.5, -0.5, 0.0, 0.5, 2.5], [3.0, 4.0], [2.0, -1.0, 3.0])], "a array<double>, b array<double>, c array<double>")
    y, logdet = A.leaky_relu("c", 0.1)
    r = v.select(F.transform("a", lambda x: A.soft_threshold(x, 1.0)), A.prox_l2("b", 1.0), y, logdet, A.project_l2_ball("b", 1.0)).first()
    assert r[0] == [-1.5, 0, 0, 0, 1.5] and np.allclose(r[1], [2.4, 3.2])
    assert np.allclose(r[2], [2, -0.1, 3]) and round(r[3], 6) == -2.302585 and np.allclose(r[4], [0.6, 0.8])
    x = np.array([3.0, -1.0, 0.5])
    assert np.allclose(M.prox_linf(x, 1.0), [2.0, -1.0, 0.5])


def test_segments_and_changes(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate([0.0, 1.0, 2.0, 7.0, 8.0, 13.5])], "k int, rn int, t double")
    assert [r["seg"] for r in R.segments(rows, "k", 5.0).orderBy("rn").collect()] == [0, 0, 0, 0, 0, 1]
    labels = spark.createDataFrame([(1, i, v) for i, v in enumerate([0, 0, 1, 1, 2])], "k int, rn int, v int")
    assert [(r["rn"], r["v"]) for r in L.change_points(labels, ["k"], "v").orderBy("rn").collect()] == [(0, 0), (2, 1), (4, 2)]


def test_delay_embedding(spark):
    rows = spark.createDataFrame([(1, i, float(i)) for i in range(8)], "k int, rn int, v double")
    found = [(r["x0"], r["x1"], r["x2"]) for r in R.delay_embedding(rows, ["k"], "v", 2, 3).orderBy("rn").collect()]
    assert len(found) == 4 and found[0] == (0, 2, 4) and found[-1] == (3, 5, 7)


def test_mcnemar(spark):
    rows = spark.createDataFrame(list(zip([1, 1, 0, 0], [1, 0, 0, 1], [1, 1, 1, 0])), "truth int, ref int, pred int").withColumn("k", F.lit(1))
    r = E.mcnemar(rows, ["k"]).first()
    assert (r["both_right"], r["only_pred"], r["only_ref"], r["both_wrong"]) == (1, 2, 1, 0)


def test_subsets():
    assert len(V.subset_masks(3)) == 7 and len(V.subset_masks(3, full=False)) == 6


def test_state_machine(spark):
    texts = ["15 min stabilization period", "bleed #1", "bleed #1 stopped", "resuscitation with hextend", "resuscitation complete", "end"]
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "id int, k int, text string")
    found = [(r["idx"], r["label"]) for r in L.label_state_machine(rows, "id").orderBy("idx").collect()]
    assert found == [(0, -1), (1, 0), (2, 1), (3, 2), (4, 3), (5, 7)]


def test_ema_fold(spark):
    rows = spark.createDataFrame([(1, i, float(i)) for i in range(1, 5)], "k int, rn int, v double")
    found = [r["ema"] for r in R.ema(rows, ["k"], "v", 0.5).orderBy("rn").collect()]
    assert found == [1.0, 1.5, 2.25, 3.125]


def test_moments_and_solves(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6))
    rows = spark.createDataFrame([(row.tolist(),) for row in x], "v array<double>").repartition(3)
    m = M.moments(rows, "v")
    assert m.n == 400 and np.allclose(m.mean, x.mean(0)) and np.allclose(m.cov, np.cov(x.T, bias=True))
    values, vectors = M.pca(m)
    assert np.allclose(vectors @ np.diag(values) @ vectors.T, m.cov)
    r, a, b = M.cca(m, slice(0, 3), slice(3, 6), 1e-12)
    left, right = (x[:, :3] - m.mean[:3]) @ a, (x[:, 3:] - m.mean[3:]) @ b
    assert np.allclose([np.corrcoef(left[:, i], right[:, i])[0, 1] for i in range(3)], r, atol=1e-6)
    gain, cov = M.condition(m, [0, 1, 2, 3], [4, 5], 0)
    w, *_ = np.linalg.lstsq(x[:, :4] - m.mean[:4], x[:, 4:] - m.mean[4:], rcond=None)
    assert np.allclose(gain, w) and (np.linalg.eigvalsh(cov) > -1e-9).all()


def test_l21_drops_rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 5))
    y = x[:, :2] @ rng.normal(size=(2, 3)) + 0.01 * rng.normal(size=(500, 3))
    z = np.hstack((x, y))
    m = M.Moments(500, z.mean(0), np.cov(z.T, bias=True))
    w = M.l21_regression(m, [0, 1, 2, 3, 4], [5, 6, 7], 0.05)
    assert (np.abs(w[2:]) < 1e-2).all() and (np.abs(w[:2]).sum(axis=1) > 0.1).all()


def test_tv_derivative_of_a_kink():
    t = np.arange(100) * 0.1
    u = M.tv_derivative(np.abs(t - 5), 0.1, 0.01, 40)
    assert abs(u[20] + 1) < 0.1 and abs(u[80] - 1) < 0.1


def test_dtw_finds_a_stretched_copy():
    series = np.concatenate((np.full(20, 9.0), [1, 2, 3, 4], np.full(20, 9.0)))
    cost, end = M.dtw_open(np.array([1.0, 1.0, 2.0, 3.0, 4.0]), series)
    assert cost == 0 and end == 23


def test_ranks_without_a_global_window(spark):
    rows = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("id")).repartition(5)
    found = V.exact_split(rows, ["id"], 0.8).groupBy("part").agg(F.min("id"), F.max("id"), F.count("*")).orderBy("part").collect()
    assert [tuple(r) for r in found] == [("test", 800, 999, 200), ("train", 0, 799, 800)]


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "k int, rn int, t double, v double")
    for found in (R.segments(empty, "k", 1.0), R.count_windows(empty, ["k"], 3), R.delay_embedding(empty, ["k"], "v", 1, 2), S.zscore(empty, "v"), L.change_points(empty, ["k"], "v"), V.ranks(empty, ["rn"])):
        assert found.count() == 0


def test_streaming_matches_batch(spark, tmp_path):
    from viewloom.streaming.sessions import streamed_histogram

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streamed_histogram(stream).writeStream.outputMode("complete").format("memory").queryName("hist").start()
    q.processAllAvailable()
    q.stop()
    key = ["day", "event_type", "bin"]
    got = spark.sql("SELECT * FROM hist").toPandas().sort_values(key).reset_index(drop=True)
    want = streamed_histogram(events).toPandas().sort_values(key).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)


def test_entry_without_the_corpus_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "viewloom", tmp_path / "viewloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'sync_pipeline' in q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
