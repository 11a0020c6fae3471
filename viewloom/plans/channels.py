"""Channels of the event series (one a user and event type) and views of the embeddings: a model per channel, derivatives, votes of aligned windows,
forecasts of every row, block-sparse redundancy, whitening and the steps of a transform."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viewloom.functions import arrays as A
from viewloom.operators import derivatives, solvers, space_tree
from viewloom.operators import linear as M
from viewloom.operators import neighbours as K
from viewloom.operators import series as R
from viewloom.plans import SERIES, query
from viewloom.plans.models import VIEWS
from viewloom.plans.synthetic import STEPS
from viewloom.plans.timeseries import WINDOWS
from viewloom.sources.tables import event_series, kept, table, written

E64 = "embedding::DOUBLE[]"


def _rows(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id is not null and embedding is not null").select("vec_id", "label", A.doubles("embedding").alias("v"))


def _channels(spark, d) -> DataFrame:
    """The events as a series per user and event type, numbered from 1 in `at`."""
    own = Window.partitionBy("user_id", "event_type").orderBy("rn")
    return event_series(spark, d).withColumn("at", F.row_number().over(own).cast("long"))


# --- a model per channel -----------------------------------------------------------------------------------------


def spectra(channels: DataFrame, size: int = 8) -> DataFrame:
    """user_id, event_type, win, v: real and imaginary parts of each whole window's spectrum, as one aggregation."""
    win = channels.withColumn("win", F.expr(f"(at - 1) div {size}")).withColumn("pos", F.expr(f"(at - 1) % {size}"))
    angle = lambda k: F.lit(2 * np.pi * k / size) * F.col("pos")
    parts = [F.sum(F.col("value") * F.cos(angle(k))) for k in range(size // 2 + 1)] + [F.sum(-F.col("value") * F.sin(angle(k))) for k in range(1, size // 2)]
    found = win.groupBy("user_id", "event_type", "win").agg(F.count("value").alias("n"), F.array(*parts).alias("v"))
    return found.where(F.col("n") == size).drop("n")


def channel_models(rows: DataFrame, channel: str, vec: str, most: int = 3) -> DataFrame:
    """channel, k, variance, mean, weights: the first components of each channel's vectors. Kept by channel, so that one reads its own model only."""
    found = [
        (key, k, float(values[k]), m.mean.tolist(), vectors[:, k].tolist())
        for key, m in M.moments_by(rows, channel, vec).items()
        for values, vectors in [M.pca(m, most=most)]
        for k in range(len(values))
    ]
    return rows.sparkSession.createDataFrame(found, f"{channel} string, k int, variance double, mean array<double>, weights array<double>")


def split_models(models: DataFrame, channel: str) -> dict[str, DataFrame]:
    """One table of models per channel; a filter on the column by which the models are kept."""
    return {r[0]: models.where(F.col(channel).eqNullSafe(F.lit(r[0]))).drop(channel) for r in models.select(channel).distinct().collect()}


@query()
def channel_spectral_codes(spark, d):
    """Window spectra of each channel on components fitted to that channel's windows of a third of the users: fitted, kept, read and applied to the others."""
    rows = spectra(_channels(spark, d))
    models = kept(channel_models(rows.where("user_id % 3 = 0"), "event_type", "v"), "channel-models", ["event_type"])
    # at most three rows for each of the event types
    coded = rows.where("user_id % 3 <> 0").join(F.broadcast(models), "event_type")
    code = A.dot(F.zip_with("v", "mean", lambda x, y: x - y), F.col("weights"))
    return coded.select("user_id", "event_type", "win", "k", F.round(code, 5).alias("code"))


@query()
def channel_derivatives(spark, d):
    """Total-variation derivative of every second sample of each channel; the step is the channel's mean time step in hours."""
    keys = ["user_id", "event_type"]
    rows = _channels(spark, d).where("at % 2 = 1").withColumn("at", F.expr("(at + 1) div 2"))
    rows = rows.withColumn("dt", derivatives.mean_step(keys, "t") / 3600)
    return derivatives.derive_series(rows, keys, "at", "value", F.col("dt")).select(*keys, "at", F.round("dx", 5).alias("dx"))


_DERIVED = "d AS (SELECT *, (lead(value) OVER w - value) / nullif(lead(t) OVER w - t, 0) AS dx FROM series WINDOW w AS (PARTITION BY user_id ORDER BY rn)), kept AS (SELECT * FROM d WHERE dx IS NOT NULL)"


@query(
    f"""WITH {SERIES}, {_DERIVED}, {WINDOWS.format(keys="user_id", source="kept", w=8)}
SELECT user_id, CAST(win AS BIGINT) AS win, max(CASE WHEN pos = 4 THEN event_type END) AS label, list(value ORDER BY pos) AS samples, list(round(dx, 9) ORDER BY pos) AS derivatives
FROM win GROUP BY 1, 2 HAVING max(CASE WHEN pos = 4 THEN event_type END) <> 'view'"""
)
def labelled_windows_with_derivatives(spark, d):
    """The joined loader: windows of eight samples beside their derivatives (both as long), with the label at the centre; windows of other labels go."""
    rows = R.finite_differences(event_series(spark, d), ["user_id"], "value")
    win = R.count_windows(rows, ["user_id"], 8).withColumn("win", F.col("win").cast("long"))
    both = F.array_sort(F.collect_list(F.struct("pos", "value", F.round("dx", 9).alias("dx"))))  # eight samples
    label = F.max(F.when(F.col("pos") == 4, F.col("event_type")))
    found = win.groupBy("user_id", "win").agg(label.alias("label"), both.alias("b")).where("label <> 'view'")
    return found.select("user_id", "win", "label", F.transform("b", lambda x: x["value"]).alias("samples"), F.transform("b", lambda x: x["dx"]).alias("derivatives"))


# --- neighbours of windows and points ------------------------------------------------------------------------------


def _labelled_windows(spark, d) -> DataFrame:
    """id (of the first event), user_id, label (the most frequent type, ties by name), v: eight samples."""
    win = R.count_windows(event_series(spark, d), ["user_id"], 8)
    types = F.array_sort(F.collect_list("event_type"))  # eight names
    most = F.array_max(F.transform(F.array_distinct("types"), lambda t: F.size(F.filter("types", lambda u: u == t))))
    found = win.groupBy("user_id", "win").agg(F.min_by("event_id", "pos").alias("id"), types.alias("types"), F.sort_array(F.collect_list(F.struct("pos", "value")))["value"].alias("v"))
    return found.select("id", "user_id", F.filter(F.array_distinct("types"), lambda t: F.size(F.filter("types", lambda u: u == t)) == most)[0].alias("label"), "v")


@query()
def dtw_votes(spark, d):
    """Windows whose first event's id is divisible by 10 get the label that most of the ten windows of other users have that align best; accuracy per label."""
    rows = written(_labelled_windows(spark, d), "windows")
    near = K.dtw_nearest(rows, rows.where("id % 10 = 0"), "id", "v", "user_id", 10)
    votes = near.join(rows.select(F.col("id").alias("neighbour"), "label"), "neighbour").groupBy("query", "label").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("best"))
    guess = votes.groupBy("query").agg(F.max_by("label", F.struct("n", -F.col("best"))).alias("guess"))
    held = guess.join(rows.select(F.col("id").alias("query"), "label"), "query")
    return held.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("guess") == F.col("label")).cast("int")), 6).alias("accuracy"))


@query(
    f"""WITH {SERIES}, p AS (SELECT user_id, event_id AS id, value AS a, lead(value, 1) OVER w AS b, lead(value, 2) OVER w AS y FROM series WINDOW w AS (PARTITION BY user_id ORDER BY rn) QUALIFY y IS NOT NULL),
n AS (SELECT p.id, unnest(min({{'d': (p.a - q.a) * (p.a - q.a) + (p.b - q.b) * (p.b - q.b), 'id': q.id}}, 3)) AS near FROM p, p q WHERE p.id <> q.id GROUP BY 1),
f AS (SELECT n.id, list(q.y ORDER BY near.d, q.id) AS l FROM n JOIN p q ON q.id = n.near.id GROUP BY 1)
SELECT user_id, count(*) AS n, round(avg(abs(list_sum(l) / len(l) - y)), 6) AS error FROM f JOIN p USING (id) GROUP BY 1"""
)
def all_rows_forecast(spark, d):
    """Every point of two samples and a successor is forecast by the mean successor of its three nearest points of all series; mean error per user."""
    rows = R.delay_embedding(event_series(spark, d), ["user_id"], "value", 1, 3).select("user_id", F.col("event_id").alias("id"), F.array("x0", "x1").alias("x"), F.col("x2").alias("y"))
    near = space_tree.all_knn(rows, "id", "x", 3)
    after = near.join(rows.select(F.col("id").alias("neighbour"), "y"), "neighbour").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "y"))).alias("l"))
    mean = F.aggregate("l", F.lit(0.0), lambda t, x: t + x["y"]) / F.size("l")
    held = rows.select(F.col("id").alias("query"), "user_id", "y").join(after, "query")
    return held.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(mean - F.col("y"))), 6).alias("error"))


# --- views -----------------------------------------------------------------------------------------------------------

PENALTY = 0.02


@query()
def redundancy_history(spark, d):
    """The redundancy matrix of four views in each round of the block-sparse regression."""
    history, _ = solvers.block_redundancy(M.moments(_rows(spark, d), "v"), VIEWS, PENALTY, 100)
    found = [(k, t, s, round(float(r[t, s]), 6)) for k, r in enumerate(history) for t in range(4) for s in range(4) if s != t]
    return spark.createDataFrame(found, "round int, target int, source int, norm double")


@query()
def view_predictions(spark, d):
    """Each view of every row from the views that the block-sparse regression kept for it: squared error per view."""
    rows = _rows(spark, d)
    m = M.moments(rows, "v")
    _, weights = solvers.block_redundancy(m, VIEWS, PENALTY)
    guess = F.transform(M.project(F.col("v"), m.mean, weights), lambda x, i: x + F.element_at(F.array(*map(F.lit, m.mean.tolist())), i + 1))
    both = rows.select("vec_id", "v", guess.alias("g"))
    each = [F.round(A.sq_distance(F.slice("v", 16 * k + 1, 16), F.slice("g", 16 * k + 1, 16)), 6).alias(f"error{k}") for k in range(4)]
    return both.select("vec_id", *each)


@query()
def whitened_views(spark, d):
    """Each view with unit covariance, by the inverse square root of its own; its axes stay as near as they can to the old ones."""
    rows = _rows(spark, d)
    m = M.moments(rows, "v")
    white = np.zeros((64, 64))
    for dims in VIEWS:
        white[np.ix_(dims, dims)] = M.matrix_power(m.cov[np.ix_(dims, dims)], -0.5)
    return rows.select("vec_id", F.transform(M.project(F.col("v"), m.mean, white), lambda x: F.round(x, 5)).alias("white"))


@query(
    f"""WITH v AS (SELECT vec_id, {E64} AS e FROM embeddings), a AS (SELECT vec_id, list_reverse(e) AS e FROM v),
b AS (SELECT vec_id, list_transform(e, lambda x: CASE WHEN x < 0 THEN 0.2 * x ELSE x END) AS e, len(list_filter(e, lambda x: x < 0)) * ln(0.2) AS s FROM a),
c AS (SELECT vec_id, list_transform(e, lambda x, i: 2 * x + CASE WHEN i > 1 THEN 0.5 * e[i - 1] ELSE 0 END) AS e, s + 64 * ln(2) AS s FROM b),
f AS (SELECT vec_id, list_transform(e, lambda x, i: CASE WHEN i > 32 THEN x * exp(0.3) + 0.1 ELSE x END) AS e, s + 32 * 0.3 AS s FROM c)
SELECT vec_id, step, round(list_sum(e), 6) AS total, round(s, 6) AS log_det FROM (SELECT vec_id, 0 AS step, e, 0.0::DOUBLE AS s FROM v UNION ALL SELECT vec_id, 1, e, 0.0 FROM a
UNION ALL SELECT vec_id, 2, e, s FROM b UNION ALL SELECT vec_id, 3, e, s FROM c UNION ALL SELECT vec_id, 4, e, s FROM f)"""
)
def transform_steps(spark, d):
    """Every row after each step of a composed transform, with the log-determinant up to there."""
    rows = table(spark, d, "embeddings").select("vec_id", A.doubles("embedding").alias("v0"), F.lit(0.0).alias("s0"))
    for k, flow in enumerate(STEPS, 1):
        y, det = flow.forward(F.col(f"v{k - 1}"))
        rows = rows.select("*", y.alias(f"v{k}"), (F.col(f"s{k - 1}") + det).alias(f"s{k}"))
    steps = F.array(*(F.struct(F.lit(k).alias("step"), F.round(A.total(F.col(f"v{k}")), 6).alias("total"), F.round(f"s{k}", 6).alias("log_det")) for k in range(len(STEPS) + 1)))
    return rows.select("vec_id", F.explode(steps).alias("e")).select("vec_id", "e.*")
