"""Decompositions, regressions and ordered NumPy kernels as queries; those without a SQL twin are held against NumPy in tests/test_models.py."""

from __future__ import annotations

from collections.abc import Iterator
from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from viewloom.functions import arrays as A
from viewloom.operators import derivatives
from viewloom.operators import linear as M
from viewloom.operators import neighbours as K
from viewloom.operators import series as R
from viewloom.operators import statistics as S
from viewloom.plans import SERIES, query
from viewloom.plans.timeseries import WINDOWS
from viewloom.sources.tables import event_series, table, written

VIEWS = [list(range(16 * k, 16 * k + 16)) for k in range(4)]
WINDOW = 16


def _rows(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", A.doubles("embedding").alias("v"))


def _fft(spark, d):
    """Real and imaginary parts of the window spectra: sums with constant cosines, in one aggregation."""
    win = R.count_windows(event_series(spark, d), ["user_id"], WINDOW)
    angle = lambda k: 2 * pi * k * F.col("pos") / WINDOW
    parts = [F.sum(F.col("value") * F.cos(angle(k))).alias(f"re{k}") for k in range(WINDOW // 2 + 1)]
    parts += [F.sum(-F.col("value") * F.sin(angle(k))).alias(f"im{k}") for k in range(1, WINDOW // 2)]
    return win.groupBy("user_id", F.col("win").cast("long").alias("win")).agg(*parts)


_PARTS = ", ".join([f"round(sum(value * cos(2 * pi() * {k} * pos / {WINDOW})), 6) AS re{k}" for k in range(3)] + [f"round(sum(-value * sin(2 * pi() * {k} * pos / {WINDOW})), 6) AS im{k}" for k in (1, 2)])


@query(f"WITH {SERIES}, {WINDOWS.format(keys='user_id', source='series', w=WINDOW)} SELECT user_id, win, {_PARTS} FROM win GROUP BY 1, 2")
def fft_windows(spark, d):
    found = _fft(spark, d)
    return found.select("user_id", "win", *(F.round(c, 6).alias(c) for c in ("re0", "re1", "re2", "im1", "im2")))


@query()
def fft_window_codes(spark, d):
    """Spectra projected on their first principal components."""
    found = _fft(spark, d)
    names = [c for c in found.columns if c[:2] in ("re", "im")]
    rows = found.select("user_id", "win", F.array(*names).alias("v"))
    m = M.moments(rows, "v")
    _, basis = M.pca(m, most=4)
    return rows.select("user_id", "win", M.project(F.col("v"), m.mean, basis).alias("code"))


@query()
def pca_views(spark, d):
    """Each view of 16 on the components that explain nine tenths of its variance."""
    rows = _rows(spark, d)
    m = M.moments(rows, "v")
    codes = []
    for k, dims in enumerate(VIEWS):
        own = M.Moments(m.n, m.mean[dims], m.cov[np.ix_(dims, dims)])
        _, basis = M.pca(own, 0.9)
        codes.append(M.project(F.slice("v", 16 * k + 1, 16), own.mean, basis).alias(f"code{k}"))
    return rows.select("vec_id", *codes)


@query()
def cca_views(spark, d):
    """Canonical correlations between every two views."""
    m = M.moments(_rows(spark, d), "v")
    found = [(a, b, i, round(float(s), 6)) for a in range(4) for b in range(a + 1, 4) for i, s in enumerate(M.cca(m, slice(16 * a, 16 * a + 16), slice(16 * b, 16 * b + 16))[0])]
    return spark.createDataFrame(found, "a int, b int, i int, r double")


@query()
def one_vs_rest_cca(spark, d):
    """Canonical correlations between each view and all others."""
    m, found = M.moments(_rows(spark, d), "v"), []
    for k, dims in enumerate(VIEWS):
        order = [*dims, *(i for i in range(64) if i not in dims)]
        own = M.Moments(m.n, m.mean[order], m.cov[np.ix_(order, order)])
        found += [(k, i, round(float(s), 6)) for i, s in enumerate(M.cca(own, slice(0, 16), slice(16, 64))[0])]
    return spark.createDataFrame(found, "view int, i int, r double")


def _digamma(n: int) -> float:
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


@query(
    """WITH p AS (SELECT vec_id, embedding[1:3]::DOUBLE[] AS e FROM embeddings),
k AS (SELECT a.vec_id, sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS dist FROM p a, p b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY dist, b.vec_id) = 3),
n AS (SELECT sum(1.0::DOUBLE / i) AS h FROM (SELECT unnest(range(1, (SELECT count(*) FROM embeddings))) AS i))
SELECT round(3 * avg(ln(dist)) + any_value(h) - 1.5 + ln(4 * pi() / 3), 6) AS nats, count(*) AS queries FROM k, n"""
)
def knn_entropy(spark, d):
    """Kozachenko-Leonenko entropy in nats of the first three dimensions: the third neighbours of the queries (every hundredth id) among all rows."""
    from math import lgamma, log

    rows = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("x"))
    n, k, dims = rows.count(), 3, 3
    third = K.knn(rows, rows.where("vec_id % 100 = 0"), "vec_id", "x", k).where(F.col("rank") == k)
    ball = dims / 2 * log(pi) - lgamma(dims / 2 + 1)
    constant = _digamma(n) - _digamma(k) + ball
    return third.agg(F.round(dims * F.avg(F.log("dist")) + constant, 6).alias("nats"), F.count(F.lit(1)).alias("queries"))


@query()
def kmeans_mi_matrix(spark, d):
    """Mutual information, in bits, between the labels and the clusters of each view."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = _rows(spark, d)
    for k in range(4):
        own = rows.withColumn("features", array_to_vector(F.slice("v", 16 * k + 1, 16)))
        rows = KMeans(k=8, seed=5, maxIter=10, predictionCol=f"c{k}").fit(own).transform(own).drop("features")
    rows = written(rows.select("label", *(f"c{k}" for k in range(4))), "clusters")  # ten pairs read it
    names = ["label", *(f"c{k}" for k in range(4))]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    found = [S.mutual_information(rows, [a], [b]).select(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round("bits", 6).alias("bits")) for a, b in pairs]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


@query()
def l21_regression(spark, d):
    """Jointly sparse regression of view 3 on views 0 to 2: the norm of each input's row of coefficients."""
    m = M.moments(_rows(spark, d), "v")
    w = M.l21_regression(m, list(range(48)), VIEWS[3], 0.02)
    return spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(np.sqrt((w**2).sum(axis=1)))], "input int, norm double")


@query()
def ridge_redundancy_matrix(spark, d):
    """How well each view is predicted from each other: error over variance."""
    m = M.moments(_rows(spark, d), "v")
    var = [float(np.trace(m.cov[np.ix_(v, v)])) / len(v) for v in VIEWS]
    found = [(a, b, round(M.ridge(m, VIEWS[a], VIEWS[b])[1] / var[b], 6)) for a in range(4) for b in range(4) if a != b]
    return spark.createDataFrame(found, "source int, target int, error double")


@query()
def greedy_view_order(spark, d):
    m = M.moments(_rows(spark, d), "v")
    found = [(t, i, v, round(e, 6)) for t in range(4) for i, (v, e) in enumerate(M.greedy_order(m, VIEWS, t))]
    return spark.createDataFrame(found, "target int, step int, view int, error double")


@query()
def gaussian_view_imputation(spark, d):
    """View 3 from views 0 to 2 by the conditional mean of the joint normal, and its squared error per row."""
    rows = _rows(spark, d)
    m = M.moments(rows, "v")
    gain, _ = M.condition(m, list(range(48)), VIEWS[3])
    guess = M.project(F.slice("v", 1, 48), m.mean[:48], gain)
    shifted = F.zip_with(guess, F.array(*map(F.lit, m.mean[48:].tolist())), lambda x, b: x + b)
    return rows.select("vec_id", shifted.alias("guess"), F.slice("v", 49, 16).alias("truth")).select("vec_id", "guess", F.round(A.sq_distance(F.col("guess"), F.col("truth")), 6).alias("error"))


@query()
def tv_derivative(spark, d):
    """Total-variation derivative per series in chunks of 200 rows; a chunk is solved with 20 rows of its neighbours on either side."""
    rows = event_series(spark, d).select("user_id", "rn", "value")
    return derivatives.derive_series(rows, ["user_id"], "rn", "value", F.lit(1.0)).select("user_id", "rn", F.round("dx", 6).alias("dx"))


def _dtw_sql() -> str:
    """The target's steps one after the other, each a window over the series: it moves 0, 1 or 2 on."""
    parts = [f"WITH {SERIES}, t AS (SELECT rn, value FROM series WHERE user_id = (SELECT min(user_id) FROM series) AND rn <= 8)"]
    target = "(SELECT value FROM t WHERE rn = {})"
    parts.append(f"c1 AS (SELECT user_id, rn, value, abs(value - {target.format(1)}) AS c FROM series)")
    for i in range(2, 9):
        before = "least(c, coalesce(lag(c, 1) OVER w, 1e300), coalesce(lag(c, 2) OVER w, 1e300))"
        parts.append(f"c{i} AS (SELECT user_id, rn, value, abs(value - {target.format(i)}) + {before} AS c FROM c{i - 1} WINDOW w AS (PARTITION BY user_id ORDER BY rn))")
    return ", ".join(parts) + ' SELECT user_id, rn AS "end", round(c, 6) AS cost FROM c8 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY c, rn) = 1'


@query(_dtw_sql())
def dtw_match(spark, d):
    """The best open-ended alignment of the first eight values of the first user with every series.

    A match spans at most twice the target, so series are matched in chunks that overlap by that much.
    """
    series = event_series(spark, d).select("user_id", "rn", "value")
    first = series.agg(F.min("user_id")).first()[0]
    target = np.array([r["value"] for r in series.where((F.col("user_id") == first) & (F.col("rn") <= 8)).orderBy("rn").collect()])
    size, overlap = 1000, 2 * len(target)
    dealt = series.withColumn("chunk", F.explode(F.array_distinct(F.array(F.expr(f"(rn - 1) div {size}"), F.expr(f"(rn - 1 + {overlap}) div {size}")))))

    def match(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rn")
        cost, end = M.dtw_open(target, frame["value"].to_numpy())
        return pd.DataFrame({"user_id": [frame["user_id"].iloc[0]], "end": [frame["rn"].iloc[end]], "cost": [cost]})

    found = dealt.groupBy("user_id", "chunk").applyInPandas(match, "user_id long, end long, cost double")
    return found.groupBy("user_id").agg(F.min(F.struct("cost", "end")).alias("b")).select("user_id", F.col("b.end").alias("end"), F.round("b.cost", 6).alias("cost"))
