"""Evaluation over grids of coefficients and subsets of views, checks of partitionings, and downstream classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.functions import arrays as A
from viewloom.operators import evaluation as E
from viewloom.operators import views as V
from viewloom.plans import query
from viewloom.sources.tables import table

E64 = "embedding::DOUBLE[]"
COEFFICIENTS = (0.0, 0.5, 1.0)
_SUMS = f"SELECT vec_id, label, list_transform(range(0, 4), lambda k: list_sum(e[k * 16 + 1 : k * 16 + 16])) AS s FROM (SELECT vec_id, label, {E64} AS e FROM embeddings)"
_GRID = f"""grid AS (SELECT vec_id, label % 2 AS y, mask, c, (list_sum(list_transform(range(0, 4), lambda k: CASE WHEN (mask >> k) & 1 = 1 THEN s[k + 1] ELSE c * s[k + 1] / 2 END)) > 0)::INTEGER AS guess
FROM ({_SUMS}), (SELECT unnest(range(1, 16))::INTEGER AS mask), (SELECT unnest([0.0, 0.5, 1.0])::DOUBLE AS c))"""


def _view_sums(spark, d) -> DataFrame:
    e = A.doubles("embedding")
    return table(spark, d, "embeddings").select("vec_id", "label", F.array(*(A.total(F.slice(e, 16 * k + 1, 16)) for k in range(4))).alias("s"))


def _grid(spark, d) -> DataFrame:
    """vec_id, y, mask, c, guess: a prediction for every row, subset of views and coefficient; both grids are parameters."""
    rows = V.replicate_subsets(_view_sums(spark, d), 4).withColumn("c", F.explode(F.array(*map(F.lit, COEFFICIENTS))))
    part = lambda k: F.when(F.getbit(F.col("mask").cast("long"), F.lit(k)) == 1, F.col("s")[k]).otherwise(F.col("c") * F.col("s")[k] / 2)
    score = sum((part(k) for k in range(1, 4)), part(0))
    return rows.select("vec_id", (F.col("label") % 2).alias("y"), "mask", "c", (score > 0).cast("int").alias("guess"))


@query(f"WITH {_GRID} SELECT c, mask, count(*) AS n, sum(guess)::BIGINT AS ones FROM grid GROUP BY 1, 2")
def predictions_over_grid(spark, d):
    """How often each coefficient and subset predicts one."""
    return _grid(spark, d).groupBy("c", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("guess").cast("long")).alias("ones"))


@query(
    f"""WITH {_GRID}, a AS (SELECT c, mask, avg((guess = y)::INTEGER) AS accuracy FROM grid GROUP BY 1, 2)
SELECT c, bit_count(mask)::INTEGER AS size, count(*) AS subsets, round(avg(accuracy), 6) AS mean, round(min(accuracy), 6) AS worst FROM a GROUP BY 1, 2"""
)
def accuracy_over_coefficients(spark, d):
    """Accuracy by coefficient and subset, then its mean by coefficient and subset size."""
    each = _grid(spark, d).groupBy("c", "mask").agg(F.avg((F.col("guess") == F.col("y")).cast("int")).alias("accuracy"))
    by_size = each.groupBy("c", E.subset_size(F.col("mask")).alias("size"))
    return by_size.agg(F.count(F.lit(1)).alias("subsets"), F.round(F.avg("accuracy"), 6).alias("mean"), F.round(F.min("accuracy"), 6).alias("worst"))


@query(
    f"""WITH {_GRID} SELECT mask, round(avg(CASE WHEN c = 0 THEN (guess = y)::INTEGER END), 6) AS c0, round(avg(CASE WHEN c = 0.5 THEN (guess = y)::INTEGER END), 6) AS c1,
  round(avg(CASE WHEN c = 1 THEN (guess = y)::INTEGER END), 6) AS c2 FROM grid GROUP BY 1"""
)
def result_matrix(spark, d):
    """Accuracies as a matrix: a row per subset, a column per coefficient."""
    rows = _grid(spark, d).withColumn("right", (F.col("guess") == F.col("y")).cast("int"))
    found = rows.groupBy("mask").pivot("c", list(COEFFICIENTS)).agg(F.avg("right"))
    return found.select("mask", *(F.round(F.col(f"`{c}`"), 6).alias(f"c{k}") for k, c in enumerate(COEFFICIENTS)))


@query(
    f"""WITH v AS ({_SUMS}), m AS (SELECT label, list_transform(range(1, 5), lambda k: 0.0) AS z, avg(s[1]) AS m1, avg(s[2]) AS m2, avg(s[3]) AS m3, avg(s[4]) AS m4 FROM v GROUP BY 1)
SELECT vec_id, mask, round(list_sum(list_transform(range(0, 4), lambda k: CASE WHEN (mask >> k) & 1 = 1 THEN s[k + 1] ELSE [m1, m2, m3, m4][k + 1] END)), 6) AS total
FROM v JOIN m USING (label), (SELECT unnest(range(1, 15))::INTEGER AS mask)"""
)
def sampled_views(spark, d):
    """Observed views with the missing ones filled in (by the mean of the row's class), for every proper subset."""
    sums = _view_sums(spark, d)
    means = sums.groupBy("label").agg(F.array(*(F.avg(F.col("s")[k]) for k in range(4))).alias("m"))  # a row per class
    rows = V.replicate_subsets(sums, 4, full=False).join(F.broadcast(means), "label")
    part = lambda k: V.impute(F.col("s")[k], F.getbit(F.col("mask").cast("long"), F.lit(k)), F.col("m")[k])
    return rows.select("vec_id", "mask", F.round(sum((part(k) for k in range(1, 4)), part(0)), 6).alias("total"))


@query(
    f"""WITH v AS ({_SUMS}), o AS (SELECT vec_id AS i, (vec_id * 7) % (SELECT max(vec_id) + 1 FROM embeddings) AS other FROM embeddings)
SELECT o.i, mask, a.label, round(list_sum(list_transform(range(0, 4), lambda k: CASE WHEN (mask >> k) & 1 = 1 THEN a.s[k + 1] ELSE b.s[k + 1] END)), 6) AS total
FROM o JOIN v a ON a.vec_id = o.i JOIN v b ON b.vec_id = o.other, (SELECT unnest([1, 3, 7])::INTEGER AS mask)"""
)
def gathered_by_permutation(spark, d):
    """Every row with some views of its own and the rest of the row that a permutation names: two joins by id."""
    sums = _view_sums(spark, d)
    last = table(spark, d, "embeddings").agg((F.max("vec_id") + 1).alias("n"))
    order = table(spark, d, "embeddings").join(F.broadcast(last), how="cross").select(F.col("vec_id").alias("i"), (F.col("vec_id") * 7 % F.col("n")).alias("other"))
    rows = order.join(sums.select(F.col("vec_id").alias("i"), "label", F.col("s").alias("own")), "i").join(sums.select(F.col("vec_id").alias("other"), F.col("s").alias("rest")), "other")
    rows = rows.withColumn("mask", F.explode(F.array(*map(F.lit, (1, 3, 7)))))
    part = lambda k: F.when(F.getbit(F.col("mask").cast("long"), F.lit(k)) == 1, F.col("own")[k]).otherwise(F.col("rest")[k])
    return rows.select("i", "mask", "label", F.round(sum((part(k) for k in range(1, 4)), part(0)), 6).alias("total"))


@query(
    """WITH g AS (SELECT 'whole' AS name, o_orderkey AS i FROM orders UNION ALL SELECT 'twice', CASE WHEN o_orderkey = 3 THEN 4 ELSE o_orderkey END FROM orders
UNION ALL SELECT 'short', o_orderkey FROM orders WHERE o_orderkey <> 5), w AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders)
SELECT name, count(*) AS members, count(DISTINCT i) = count(*) AND min(i) = any_value(lo) AND max(i) = any_value(hi) AND count(*) = any_value(hi - lo + 1) AS valid FROM g, w GROUP BY 1"""
)
def valid_partitionings(spark, d):
    """Whether groups of indices have every index of a range once; an index twice in place of another is told apart."""
    orders = table(spark, d, "orders").select("o_orderkey")
    named = lambda name, i, where="true": orders.where(where).select(F.lit(name).alias("name"), i.alias("i"))
    key = F.col("o_orderkey")
    rows = named("whole", key).union(named("twice", F.when(key == 3, 4).otherwise(key).cast("long"))).union(named("short", key, "o_orderkey <> 5"))
    ends = orders.agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    return E.valid_partitioning(rows, "name", "i", ends)


@query()
def downstream_accuracy(spark, d):
    """Train and test accuracy of a linear and a forest classifier of the label on all views and on two of them."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, d, "embeddings").select("vec_id", (F.col("label") % 2).cast("double").alias("label"), A.doubles("embedding").alias("v"))
    found = []
    for views in (2, 4):
        data = rows.select("label", array_to_vector(F.slice("v", 1, 16 * views)).alias("features"), (F.crc32(F.col("vec_id").cast("string").cast("binary")) % 5 > 0).alias("train"))
        for name, learner in (("linear", LogisticRegression(maxIter=20, regParam=0.01)), ("forest", RandomForestClassifier(numTrees=10, seed=3))):
            scored = learner.fit(data.where("train")).transform(data)
            right = F.avg((F.col("prediction") == F.col("label")).cast("int"))
            found.append(scored.groupBy("train").agg(F.round(right, 6).alias("accuracy"), F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("classifier"), F.lit(views).alias("views"), "train", "accuracy", "n"))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


@query(
    """WITH e AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'browse' WHEN 'click' THEN 'browse' WHEN 'purchase' THEN 'buy' END AS phase, value FROM events),
p AS (SELECT user_id, phase, count(*) AS n, sum(value) AS total FROM e WHERE phase IS NOT NULL GROUP BY 1, 2)
SELECT a.user_id, a.phase AS phase_a, b.phase AS phase_b, a.n * b.n AS pairs, round(a.total / a.n * (b.total / b.n), 6) AS mean_product FROM p a JOIN p b USING (user_id)"""
)
def phase_product_counts(spark, d):
    """All pairs of a subject's samples in two phases, as counts and mean products: sums of either side suffice, no pair is made."""
    phase = F.when(F.col("event_type").isin("view", "click"), "browse").when(F.col("event_type") == "purchase", "buy")
    own = table(spark, d, "events").select("user_id", phase.alias("phase"), "value").where("phase is not null").groupBy("user_id", "phase").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    a, b = (own.select("user_id", F.col("phase").alias(f"phase_{x}"), F.col("n").alias(f"n_{x}"), (F.col("total") / F.col("n")).alias(f"mean_{x}")) for x in "ab")
    return a.join(b, "user_id").select("user_id", "phase_a", "phase_b", (F.col("n_a") * F.col("n_b")).alias("pairs"), F.round(F.col("mean_a") * F.col("mean_b"), 6).alias("mean_product"))
