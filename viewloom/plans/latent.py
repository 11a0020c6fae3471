"""Neighbourhoods of all rows, sparse and shared latent structure, mixtures and alignments as queries over the embeddings.

The iterative ones have no SQL twin; they are held against NumPy and planted data in tests/test_latent.py and tests/test_space_tree.py.
"""

from __future__ import annotations

from math import lgamma, log, pi

import numpy as np
from pyspark.sql import functions as F

from viewloom.functions import arrays as A
from viewloom.operators import alignment, factor, functional, mixture, solvers, space_tree, spectral, synchrony
from viewloom.operators import linear as M
from viewloom.plans import SERIES, query
from viewloom.plans.subjects import random_feature_means
from viewloom.sources.tables import event_series, kept, table

VIEWS = [list(range(16 * k, 16 * k + 16)) for k in range(4)]
GROUPS = [[4 * k + j for j in range(4)] for k in range(4)]


def _rows(spark, d):
    return table(spark, d, "embeddings").where("vec_id is not null and embedding is not null").select("vec_id", "label", A.doubles("embedding").alias("v"))


def _square(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


@query(
    f"""WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.vec_id AS query, b.vec_id AS neighbour, round(sqrt({_square("a.e", "b.e")}), 6) AS dist,
  CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY {_square("a.e", "b.e")}, b.vec_id) AS INTEGER) AS rank
FROM p a, p b WHERE a.vec_id <> b.vec_id QUALIFY rank <= 3"""
)
def all_knn(spark, d):
    """The three nearest other rows of every row."""
    found = space_tree.all_knn(table(spark, d, "embeddings"), "vec_id", "embedding", 3)
    return found.select("query", "neighbour", F.round("dist", 6).alias("dist"), "rank")


_PARTS = {"x": "embedding[1:2]", "y": "embedding[17:18]", "xy": "list_concat(embedding[1:2], embedding[17:18])"}


def _nats(name: str, dims: int) -> str:
    ball = dims / 2 * log(pi) - lgamma(dims / 2 + 1)
    return f"""(SELECT {dims} * avg(ln(dist + pow(2, -52))) + {ball!r} FROM (
  SELECT sqrt({_square("a.e", "b.e")}) AS dist FROM p{name} a, p{name} b WHERE a.vec_id <> b.vec_id
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY dist, b.vec_id) = 3))"""


@query(
    "WITH "
    + ", ".join(f"p{n} AS (SELECT vec_id, {e}::DOUBLE[] AS e FROM embeddings)" for n, e in _PARTS.items())
    + f""", n AS (SELECT -0.5772156649015329 + sum(1.0::DOUBLE / i) - (1.5 - 0.5772156649015329) AS c FROM (SELECT unnest(range(1, (SELECT count(*) FROM embeddings))) AS i))
SELECT round({_nats("x", 2)} + {_nats("y", 2)} - {_nats("xy", 4)} + c, 5) AS nats FROM n"""
)
def knn_mutual_information(spark, d):
    """Of two views' first two components, by the third neighbours of all rows; in nats."""
    rows = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 2).alias("x"), F.slice("embedding", 17, 2).alias("y"))
    return spark.createDataFrame([(round(space_tree.neighbour_information(rows, "vec_id", ["x", "y"], 3), 5),)], "nats double")


@query()
def group_sparse_cca(spark, d):
    """Two pairs of directions between the first two views, sparse by groups of four: the weight of each group and the correlations."""
    found = solvers.group_sparse_cca(M.moments(_rows(spark, d), "v"), VIEWS[0], VIEWS[1], GROUPS, GROUPS, 2, 0.004, 0.0005)
    out = []
    for pair in range(2):
        for side, directions in (("left", found.left), ("right", found.right)):
            out += [(pair, side, g, round(float(np.linalg.norm(directions[dims, pair])), 5), round(float(found.correlations[pair]), 5)) for g, dims in enumerate(GROUPS)]
    return spark.createDataFrame(out, "pair int, side string, component_group int, weight double, correlation double")


@query()
def shared_embedding(spark, d):
    """Codes of every row in the latent that four views share, as the mean of the views' codes."""
    rows = _rows(spark, d)
    m = M.moments(rows, "v")
    bases, _ = solvers.shared_embedding(m, VIEWS, 2)
    stacked = np.zeros((64, 2))
    for dims, u in zip(VIEWS, bases, strict=True):
        stacked[dims] = u / len(VIEWS)
    return rows.select("vec_id", M.project(F.col("v"), m.mean, stacked).alias("z"))


@query()
def agreeing_directions(spark, d):
    """The covariance that two rounds of directions of four views have in common."""
    _, courses = solvers.agreeing_directions(M.moments(_rows(spark, d), "v"), VIEWS, 2)
    return spark.createDataFrame([(k, round(c[-1], 6)) for k, c in enumerate(courses)], "direction int, covariance double")


def _factors(spark, d):
    return factor.fit(_rows(spark, d), "vec_id", "v", VIEWS, 20, 0.1, 0.05, 4)


@query()
def sparse_codes(spark, d):
    """Every row's sparse code: how many atoms it takes and their total weight."""
    _, coded = _factors(spark, d)
    size = F.aggregate("code", F.lit(0.0), lambda t, x: t + F.abs(x))
    return coded.select("vec_id", F.size(F.filter("code", lambda x: x != 0)).alias("atoms"), F.round(size, 5).alias("weight"))


@query()
def dictionary_atoms(spark, d):
    """The size of each atom in each view."""
    found, _ = _factors(spark, d)
    return spark.createDataFrame([(j, k, round(float(np.linalg.norm(found.atoms[v, j])), 5)) for j in range(found.atoms.shape[1]) for k, v in enumerate(VIEWS)], "atom int, view int, size double")


@query()
def mixture_likelihood(spark, d):
    """Log-density of every row's first four components under an autoregressive mixture of all rows."""
    rows = _rows(spark, d).select("vec_id", F.slice("v", 1, 4).alias("v"))
    model = mixture.fit(rows, "v", 3, 12)
    return rows.select("vec_id", F.round(mixture.log_density(F.col("v"), model), 5).alias("log_density"))


@query()
def aligned_views(spark, d):
    """The rotation and shift that take the first three components of the first view to those of the second, for each label."""
    rows = _rows(spark, d).select("label", F.slice("v", 1, 3).alias("x"), F.slice("v", 17, 3).alias("y"))
    found = alignment.align_groups(rows, "label", "x", "y")
    return found.select("label", "n", F.transform("rotation", lambda x: F.round(x, 5)).alias("rotation"), F.transform("shift", lambda x: F.round(x, 5)).alias("shift"), F.round("rmse", 5).alias("rmse"))


@query()
def warped_points(spark, d):
    """Every row's first three components, warped as the rows with the forty smallest ids go to those of the second view."""
    rows = _rows(spark, d)
    knots = rows.orderBy("vec_id").limit(40).collect()
    warp = alignment.thin_plate(np.array([r.v[:3] for r in knots]), np.array([r.v[16:19] for r in knots]), 0.01)
    return rows.select("vec_id", F.transform(alignment.warped(F.slice("v", 1, 3), warp), lambda x: F.round(x, 5)).alias("point"))


@query()
def laplacian_embedding(spark, d):
    """Eigenvalues of the Laplacian of the graph of eight nearest neighbours of all rows, and how the rows lie along its first vectors."""
    rows = _rows(spark, d).select("vec_id", F.slice("v", 1, 2).alias("x"))
    edges = spectral.neighbour_graph(space_tree.all_knn(rows, "vec_id", "x", 8), 10.0)
    found, _ = spectral.laplacian_embedding(edges, 2, rounds=3, degree=6, spare=3)
    return found.select(F.col("node").alias("vec_id"), *(F.abs(F.round(c, 2)).alias(c) for c in ("x0", "x1")))


@query()
def instrumental_embedding(spark, d):
    """The first two views of every row in the two directions in which their linear kernels agree most."""
    rows = _rows(spark, d)
    m = M.moments(rows, "v")
    a, b, _ = spectral.instrumental_embedding(m, VIEWS[0], VIEWS[1], 2)
    both = np.zeros((64, 4))
    both[VIEWS[0], :2], both[VIEWS[1], 2:] = a, b
    return rows.select("vec_id", F.transform(M.project(F.col("v"), m.mean, both), lambda x: F.round(x, 5)).alias("codes"))


_EMBEDDED = "[value, lead(value, 1) OVER s, lead(value, 2) OVER s]"


@query(
    f"""WITH {SERIES}, busy AS (SELECT user_id, row_number() OVER (ORDER BY n DESC, user_id) AS side FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1) QUALIFY side <= 2),
e AS (SELECT side, rn AS t, {_EMBEDDED} AS v FROM series JOIN busy USING (user_id) WINDOW s AS (PARTITION BY user_id ORDER BY rn) QUALIFY lead(value, 2) OVER s IS NOT NULL),
nn AS MATERIALIZED (SELECT p.side, p.t, p.v, q.t AS nn, sqrt({_square("p.v", "q.v")}) AS dist FROM e p JOIN e q ON p.side = q.side AND p.t <> q.t
  QUALIFY row_number() OVER (PARTITION BY p.side, p.t ORDER BY {_square("p.v", "q.v")}, q.t) = 1),
r AS (SELECT lag, a.dist AS da, b.dist AS db, sqrt({_square("a.v", "ua.v")}) AS ea, sqrt({_square("b.v", "ub.v")}) AS eb
  FROM nn a CROSS JOIN (SELECT unnest(range(-8, 9)) AS lag) JOIN nn b ON a.side = 1 AND b.side = 2 AND b.t = a.t + lag
  LEFT JOIN e ua ON ua.side = 1 AND ua.t = b.nn - lag LEFT JOIN e ub ON ub.side = 2 AND ub.t = a.nn + lag),
m AS (SELECT lag, (avg(CASE WHEN ea > 0.001 THEN da / ea END) + avg(CASE WHEN eb > 0.001 THEN db / eb END)) / 2 AS r, count(*) AS n FROM r GROUP BY 1)
SELECT CAST(lag AS INTEGER) AS lag, round(greatest(r, 1 / r), 6) AS ratio, n FROM m WHERE r > 0"""
)
def sync_ratios(spark, d):
    """How well the two longest series agree at each lag; the least ratio is the lag at which they are in step."""
    busy = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(2).collect()
    found = synchrony.sync_ratios(event_series(spark, d), "user_id", busy[0].user_id, busy[-1].user_id, 1, 3, 8)
    return found.select("lag", F.round("ratio", 6).alias("ratio"), "n")


def _halves(spark, d, terms: int = 4):
    """user_id, p, q: cosine coefficients of the first and the second half of each series of sixteen rows or more."""
    from pyspark.sql import Window

    rows = event_series(spark, d).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("user_id"))).where("n >= 16")
    rows = rows.withColumn("size", F.floor(F.col("n") / 2)).withColumn("late", F.col("rn") > F.col("size"))
    rows = rows.withColumn("at", F.when(F.col("late"), F.col("rn") - F.col("size")).otherwise(F.col("rn"))).withColumn("size", F.when(F.col("late"), F.col("n") - F.col("size")).otherwise(F.col("size")))
    part = lambda k, late: F.sum(F.when(F.col("late") == late, F.col("value") * F.cos(F.lit(pi * k) * (F.col("at") - 0.5) / F.col("size")) * (1 if k == 0 else 2) / F.col("size")))
    return rows.groupBy("user_id").agg(F.array(*(part(k, False) for k in range(terms))).alias("p"), F.array(*(part(k, True) for k in range(terms))).alias("q"))


@query()
def function_regression(spark, d):
    """The second half of each series from its first, as functions: the error of the coefficients predicted for users who are not fitted on."""
    rows = _halves(spark, d)
    model = functional.fit(rows.where("user_id % 5 <> 0"), "p", "q", 64, 1e-4, 1e-1)
    if model is None:
        return spark.createDataFrame([], "user_id long, error double")
    other = rows.where("user_id % 5 = 0").withColumn("guess", functional.predicted(F.col("p"), model))
    rest = F.aggregate(F.zip_with("guess", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x)
    return other.select("user_id", F.round(F.sqrt(rest), 4).alias("error"))


def _window_features(spark, d):
    """user_id, win, v: the mean random features of each window as an array."""
    pairs = F.array_sort(F.collect_list(F.struct("f", "feature")))  # sixteen features
    return random_feature_means(spark, d).groupBy("user_id", "win").agg(F.transform(pairs, lambda x: x["feature"]).alias("v"))


@query()
def fitted_window_basis(spark, d):
    """Windows of two thirds of the users on components fitted to the windows of the others: fitted, written, read again and applied."""
    rows = _window_features(spark, d)
    m = M.moments(rows.where("user_id % 3 = 0"), "v")
    values, vectors = M.pca(m, most=4)
    fitted = [(k, float(values[k]), m.mean.tolist(), vectors[:, k].tolist()) for k in range(len(values))]
    basis = kept(spark.createDataFrame(fitted, "k int, variance double, mean array<double>, weights array<double>"), "window-basis", ["k"])
    # at most four components
    coded = rows.where("user_id % 3 <> 0").join(F.broadcast(basis), how="cross")
    code = A.dot(F.zip_with("v", "mean", lambda x, y: x - y), F.col("weights"))
    return coded.select("user_id", "win", F.col("k").cast("int").alias("k"), F.round(code, 5).alias("code"))
