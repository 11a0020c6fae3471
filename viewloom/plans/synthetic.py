"""Invertible transforms and their likelihoods, geometry and solvers as queries over the embeddings and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from viewloom.functions import arrays as A
from viewloom.functions import flows
from viewloom.plans import query
from viewloom.sources.tables import table

E64 = "embedding::DOUBLE[]"


@query(f"SELECT vec_id, round(list_sum(list_transform(e, lambda x, i: CASE WHEN i % 2 = 1 THEN x ELSE x * exp(0.1 * e[i - 1]) END)), 6) AS total, round(0.1 * list_sum(list_filter(e, lambda x, i: i % 2 = 1)), 6) AS log_det FROM (SELECT vec_id, {E64} AS e FROM embeddings)")
def masked_scaling(spark, d):
    """Every second entry scaled by its neighbour: a coupling with a bit mask."""
    e = A.doubles("embedding")
    odd = F.filter(e, lambda x, i: i % 2 == 0)
    scaled = F.transform(e, lambda x, i: F.when(i % 2 == 0, x).otherwise(x * F.exp(0.1 * F.element_at(e, F.greatest(i, F.lit(1))))))
    return table(spark, d, "embeddings").select("vec_id", F.round(A.total(scaled), 6).alias("total"), F.round(0.1 * A.total(odd), 6).alias("log_det"))


@query(
    """WITH RECURSIVE s AS (SELECT vec_id, 0 AS k, 1 + e[1] AS x, 1 + e[2] AS y, 1 + e[3] AS z FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
UNION ALL SELECT vec_id, k + 1, x + 0.01::DOUBLE * (10 * (y - x)), y + 0.01::DOUBLE * (x * (28 - z) - y), z + 0.01::DOUBLE * (x * y - 2.6666666666666665::DOUBLE * z) FROM s WHERE k < 40)
SELECT vec_id, k AS step, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM s WHERE k > 0"""
)
def polynomial_roll_out(spark, d):
    """Sparse polynomial dynamics from the first three components of every row, iterated by Euler steps: a fold over the steps of each start."""
    step = lambda s, k: F.struct(
        (s["x"] + 0.01 * (10 * (s["y"] - s["x"]))).alias("x"), (s["y"] + 0.01 * (s["x"] * (28 - s["z"]) - s["y"])).alias("y"), (s["z"] + 0.01 * (s["x"] * s["y"] - F.lit(8 / 3) * s["z"])).alias("z")
    )
    e = A.doubles("embedding")
    start = F.array(F.struct((1 + e[0]).alias("x"), (1 + e[1]).alias("y"), (1 + e[2]).alias("z")))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, lambda acc, k: F.concat(acc, F.array(step(F.element_at(acc, -1), k))))
    rows = table(spark, d, "embeddings").select("vec_id", F.posexplode(path).alias("step", "s")).where("step > 0")
    return rows.select("vec_id", "step", *(F.round(f"s.{c}", 6).alias(c) for c in "xyz"))


# --- invertible transforms -----------------------------------------------------------------------------------

STEPS = [flows.make("reverse"), flows.make("leaky_relu", slope=0.2), flows.make("chain_linear", below=0.5, diagonal=2.0), flows.make("scale_shift", first=32, log_scale=0.3, shift=0.1)]
FLOW = flows.compose(*STEPS)
_FLOWED = f"""SELECT vec_id, e, list_transform(b, lambda x, i: CASE WHEN i > 32 THEN (2 * x + 0.5 * coalesce(b[i - 1], 0)) * exp(0.3) + 0.1 ELSE 2 * x + 0.5 * (CASE WHEN i > 1 THEN b[i - 1] ELSE 0 END) END) AS y,
  len(list_filter(e, lambda x: x < 0)) * ln(0.2) + 64 * ln(2) + 32 * 0.3 AS log_det FROM (SELECT vec_id, e, list_transform(list_reverse(e), lambda x: CASE WHEN x < 0 THEN 0.2 * x ELSE x END) AS b FROM (SELECT vec_id, {E64} AS e FROM embeddings))"""


@query(f"SELECT vec_id, round(list_sum(y), 6) AS total, round(y[1], 6) AS first, round(log_det, 6) AS log_det, 0.0::DOUBLE AS error FROM ({_FLOWED})")
def composed_transform(spark, d):
    """Reverse, leaky ReLU, a linear map and a coupling one after the other, their log-determinant, and the error of the way back."""
    v = A.doubles("embedding")
    rows = table(spark, d, "embeddings").select("vec_id", v.alias("v"))
    y, det = FLOW.forward(F.col("v"))
    rows = rows.select("vec_id", "v", y.alias("y"), det.alias("det"))
    error = F.round(F.sqrt(A.sq_distance(FLOW.inverse(F.col("y")), F.col("v"))), 6)
    return rows.select("vec_id", F.round(A.total(F.col("y")), 6).alias("total"), F.round(F.col("y")[0], 6).alias("first"), F.round("det", 6).alias("log_det"), error.alias("error"))


_NLL = "list_sum(list_transform(y, lambda x: x * x)) / 2 + 32 * ln(2 * pi())"


@query(f"SELECT count(*) AS n, round(sum(log_det - ({_NLL})), 4) AS log_likelihood, round(avg({_NLL}) - avg(log_det), 6) AS loss FROM ({_FLOWED})")
def flow_likelihood(spark, d):
    """The log-likelihood of all rows under the transform of a standard normal, and the loss: mean negative likelihood less mean log-determinant."""
    y, det = FLOW.forward(A.doubles("embedding"))
    rows = table(spark, d, "embeddings").select(y.alias("y"), det.alias("det"))
    nll = A.normal_nll("y")
    return rows.select(nll.alias("nll"), "det").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("det") - F.col("nll")), 4).alias("log_likelihood"), F.round(F.avg("nll") - F.avg("det"), 6).alias("loss")
    )


@query(
    f"""SELECT vec_id, round(a, 6) AS x0, round(b, 6) AS x1, round(c, 6) AS x2 FROM (SELECT vec_id, e[1] / 2 AS a, (e[2] - 0.5 * (e[1] / 2)) / 2 AS b, (e[3] - 0.5 * ((e[2] - 0.5 * (e[1] / 2)) / 2)) / 2 AS c
FROM (SELECT vec_id, {E64} AS e FROM embeddings))"""
)
def flow_samples(spark, d):
    """Rows as base samples that are taken back through the inverse of a transform: samples of the transformed distribution."""
    x = flows.make("chain_linear", below=0.5, diagonal=2.0).inverse(F.slice(A.doubles("embedding"), 1, 3))
    rows = table(spark, d, "embeddings").select("vec_id", x.alias("x"))
    return rows.select("vec_id", *(F.round(F.col("x")[i], 6).alias(f"x{i}") for i in range(3)))


# --- geometry ---------------------------------------------------------------------------------------------------


@query(f"SELECT vec_id, round(cos(radians(vec_id % 360)) * e[1] - sin(radians(vec_id % 360)) * e[2], 6) AS x, round(sin(radians(vec_id % 360)) * e[1] + cos(radians(vec_id % 360)) * e[2], 6) AS y FROM (SELECT vec_id, {E64} AS e FROM embeddings)")
def rotated_points(spark, d):
    """The first two coordinates turned by an angle of each row."""
    t, e = F.radians(F.col("vec_id") % 360), A.doubles("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(F.cos(t) * e[0] - F.sin(t) * e[1], 6).alias("x"), F.round(F.sin(t) * e[0] + F.cos(t) * e[1], 6).alias("y"))


@query(
    f"""SELECT vec_id, round(sqrt(list_sum(list_transform(range(1, 17), lambda i: pow(e[16 + i] - e[i] * ab / aa, 2)))), 6) AS size, round(list_sum(list_transform(range(1, 17), lambda i: e[i] * (e[16 + i] - e[i] * ab / aa))), 6) + 0.0 AS shared
FROM (SELECT *, list_dot_product(e[1:16], e[17:32]) AS ab, list_dot_product(e[1:16], e[1:16]) AS aa FROM (SELECT vec_id, {E64} AS e FROM embeddings))"""
)
def independent_component(spark, d):
    """What of the second view is orthogonal to the first: its size, and what it still shares with the first (nothing)."""
    v = A.doubles("embedding")
    rows = table(spark, d, "embeddings").select("vec_id", F.slice(v, 1, 16).alias("a"), F.slice(v, 17, 16).alias("b"))
    rows = rows.select("vec_id", "a", A.independent_of(F.col("b"), F.col("a")).alias("rest"))
    return rows.select("vec_id", F.round(A.norm2(F.col("rest")), 6).alias("size"), (F.round(A.dot(F.col("a"), F.col("rest")), 6) + 0.0).alias("shared"))


@query(f"SELECT vec_id, round(list_sum(list_concat(e[49:64], e[1:16])), 6) AS total FROM (SELECT vec_id, {E64} AS e FROM embeddings)")
def flattened_lists(spark, d):
    """A list of lists as one list."""
    v = A.doubles("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.round(A.total(F.flatten(F.array(F.slice(v, 49, 16), F.slice(v, 1, 16)))), 6).alias("total"))


# --- solvers and schedules --------------------------------------------------------------------------------------

_U = "list_reverse_sort(list_transform(e, lambda x: abs(x)))"


@query(
    f"""WITH v AS (SELECT vec_id, e, {_U} AS u FROM (SELECT vec_id, list_transform(({E64})[1:16], lambda x: 4 * x) AS e FROM embeddings)),
r AS (SELECT *, list_max(list_transform(list_filter(range(1, 17), lambda j: u[j] - (list_sum(u[1:j]) - 1) / j > 0), lambda j: j)) AS rho FROM v),
l AS (SELECT *, CASE WHEN list_sum(u) <= 1 THEN NULL ELSE (list_sum(u[1:rho]) - 1) / rho END AS cut FROM r)
SELECT vec_id, round(coalesce(cut, 0), 6) AS cut, round(CASE WHEN cut IS NULL THEN 0 ELSE sqrt(list_sum(list_transform(e, lambda x: pow(least(abs(x), cut), 2)))) END, 6) AS size,
  round(CASE WHEN cut IS NULL THEN 0 ELSE list_sum(list_transform(u, lambda x: greatest(x - cut, 0))) - 1 END, 6) + 0.0 AS excess FROM l"""
)
def prox_linf_rows(spark, d):
    """The prox of the largest entry, by bisection of sum(max(|v| - cut, 0)) = 1 inside the row; the twin sorts and solves it exactly."""
    v = F.transform(F.slice(A.doubles("embedding"), 1, 16), lambda x: 4 * x)
    rows = table(spark, d, "embeddings").select("vec_id", v.alias("v")).withColumn("_cut", A.linf_cut(F.col("v")))
    clipped = F.transform("v", lambda x: F.signum(x) * F.least(F.abs(x), F.coalesce("_cut", F.lit(0.0))))
    excess = F.when(F.col("_cut").isNull(), 0.0).otherwise(A.excess(F.col("v"), F.col("_cut")))
    return rows.select("vec_id", F.round(F.coalesce("_cut", F.lit(0.0)), 6).alias("cut"), F.round(A.norm2(clipped), 6).alias("size"), (F.round(excess, 6) + 0.0).alias("excess"))


@query(f"SELECT vec_id, round(list_sum(list_transform(e, lambda x: sign(x - 0.05) * greatest(abs(x - 0.05) - 0.1, 0))), 6) AS total FROM (SELECT vec_id, {E64} AS e FROM embeddings)")
def prox_shifted_l1(spark, d):
    """The prox of |x| + <c, x>: soft threshold after a shift."""
    soft = lambda v, lam: F.transform(v, lambda x: A.soft_threshold(x, lam))
    found = A.prox_shifted(soft, A.doubles("embedding"), F.array_repeat(F.lit(0.5), 64), 0.1)
    return table(spark, d, "embeddings").select("vec_id", F.round(A.total(found), 6).alias("total"))


@query(
    """WITH t AS (SELECT label, row_number() OVER (ORDER BY label) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT label FROM embeddings WHERE label IS NOT NULL)),
c AS (SELECT a.label AS i, b.label AS j, a.k AS p, b.k AS q, a.n FROM t a, t b)
SELECT i, j, CASE WHEN p = q THEN 0.5 + 2.0 * (n - 1) ELSE -2.0 END::DOUBLE AS pairwise,
  (CASE WHEN p = q THEN 0.5 + 2.0 * ((p > 1)::INTEGER + (p < n)::INTEGER) WHEN abs(p - q) = 1 THEN -2.0 ELSE 0.0 END)::DOUBLE AS temporal FROM c"""
)
def task_couplings(spark, d):
    """Penalty matrices of the tasks, one for each label: every pair, and a chain in the order of the labels (both neighbours of a task)."""
    from pyspark.sql import Window

    order = Window.orderBy("label")  # over the distinct labels
    tasks = table(spark, d, "embeddings").where("label is not null").select("label").distinct().withColumn("k", F.row_number().over(order))
    last = tasks.agg(F.max("k").alias("n"))
    cells = tasks.select(F.col("label").alias("i"), F.col("k").alias("p")).join(tasks.select(F.col("label").alias("j"), F.col("k").alias("q")), how="cross").join(F.broadcast(last), how="cross")
    same, sides = F.col("p") == F.col("q"), (F.col("p") > 1).cast("int") + (F.col("p") < F.col("n")).cast("int")
    chain = F.when(same, 0.5 + 2.0 * sides).when(F.abs(F.col("p") - F.col("q")) == 1, -2.0).otherwise(0.0)
    return cells.select("i", "j", F.when(same, 0.5 + 2.0 * (F.col("n") - 1)).otherwise(-2.0).alias("pairwise"), chain.alias("temporal"))


@query(f"SELECT i, round(min(size), 6) AS least FROM (SELECT k, i, sqrt(sum(x * x)) AS size FROM (SELECT unnest(range(0, 64)) // 16 AS k, unnest(range(0, 64)) % 16 AS i, unnest({E64}) AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1 HAVING min(size) >= (SELECT 0.98 * sqrt(count(*) / 64.0) FROM embeddings)")
def kept_atoms(spark, d):
    """Atoms (the places inside a view) that are not small in any of the four views."""
    rows = table(spark, d, "embeddings").select(F.posexplode(A.doubles("embedding")).alias("p", "x"))
    sizes = rows.groupBy(F.expr("p div 16").alias("k"), (F.col("p") % 16).cast("long").alias("i")).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    least = sizes.groupBy("i").agg(F.min("size").alias("least"))
    limit = table(spark, d, "embeddings").agg((0.98 * F.sqrt(F.count(F.lit(1)) / 64.0)).alias("limit"))
    return least.join(F.broadcast(limit), how="cross").where("least >= limit").select("i", F.round("least", 6).alias("least"))


@query(f"SELECT vec_id, len(list_filter(e, lambda x: abs(x) >= 0.1))::BIGINT AS n, round(list_sum(list_transform(e, lambda x: CASE WHEN abs(x) < 0.1 THEN 0 ELSE x END)), 6) AS total FROM (SELECT vec_id, {E64} AS e FROM embeddings)")
def sparse_projections(spark, d):
    """Entries below a limit become 0."""
    kept = A.sparse(A.doubles("embedding"), 0.1)
    return table(spark, d, "embeddings").select("vec_id", F.size(F.filter(kept, lambda x: x != 0)).cast("long").alias("n"), F.round(A.total(kept), 6).alias("total"))


@query(
    "WITH v AS (SELECT vec_id, unnest(range(0, 4)) AS k, unnest([list_sum(e[1:16]), list_sum(e[17:32]), list_sum(e[33:48]), list_sum(e[49:64])]) AS x FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)) "
    "SELECT a.k AS i, b.k AS j, round(regr_slope(a.x, b.x) - CASE WHEN a.k = b.k THEN 1 ELSE 0 END, 6) + 0.0 AS value FROM v a JOIN v b USING (vec_id) GROUP BY 1, 2"
)
def nullspace_matrix(spark, d):
    """The transposed matrix of how views follow from one another, less the identity."""
    e = A.doubles("embedding")
    rows = table(spark, d, "embeddings").select(*(A.total(F.slice(e, 16 * k + 1, 16)).alias(f"s{k}") for k in range(4)))
    cells = [(i, j) for i in range(4) for j in range(4)]
    one = rows.agg(*(F.regr_slope(f"s{i}", f"s{j}").alias(f"r{i}{j}") for i, j in cells))
    each = F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"), (F.round(F.col(f"r{i}{j}") - int(i == j), 6) + 0.0).alias("value")) for i, j in cells)))
    return one.select(each.alias("x")).select("x.*")


@query(
    """WITH c AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS step FROM orders), m AS (SELECT max(step) AS most FROM c),
g AS (SELECT o_custkey, unnest(range(1, most + 1)) AS step FROM (SELECT DISTINCT o_custkey FROM c), m)
SELECT g.o_custkey, g.step, last_value(c.o_totalprice IGNORE NULLS) OVER (PARTITION BY g.o_custkey ORDER BY g.step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM g LEFT JOIN c USING (o_custkey, step)"""
)
def padded_histories(spark, d):
    """Histories of different lengths brought to the longest, the last value repeated."""
    from pyspark.sql import Window

    own = Window.partitionBy("o_custkey")
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_totalprice").alias("value"), F.row_number().over(own.orderBy("o_orderdate", "o_orderkey")).cast("long").alias("step"))
    ends = rows.groupBy("o_custkey").agg(F.max("step").alias("own"), F.max_by("value", "step").alias("value"))
    most = ends.agg(F.max("own").alias("most"))
    missing = ends.join(F.broadcast(most), how="cross").where("own < most").select("o_custkey", F.explode(F.sequence(F.col("own") + 1, F.col("most"))).alias("step"), "value")
    return rows.select("o_custkey", "step", "value").union(missing)
