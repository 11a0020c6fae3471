"""Records, grids, samples and masks: the smaller operators as queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from viewloom.functions import arrays as A
from viewloom.operators import linear as M
from viewloom.operators import series as R
from viewloom.operators import views as V
from viewloom.plans import SERIES, query
from viewloom.sources.tables import event_series, table

E64 = "embedding::DOUBLE[]"


@query(
    """WITH c AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS cycle FROM orders),
s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders WHERE o_custkey % 4 <> 0)
SELECT o_custkey, cycle, max(cycle) OVER (PARTITION BY o_custkey) - cycle AS rul, round((o_totalprice - m) / s, 6) AS z FROM c, s"""
)
def engine_runs_rul(spark, d):
    """Units (customers) with cycles (orders), the cycles left, and the feature scaled by the training units' statistics."""
    from viewloom.operators import statistics as S

    own = Window.partitionBy("o_custkey")
    rows = table(spark, d, "orders").withColumn("cycle", F.row_number().over(own.orderBy("o_orderdate", "o_orderkey")).cast("long"))
    rows = S.zscore(rows.withColumn("rul", F.max("cycle").over(own) - F.col("cycle")), "o_totalprice", train=F.col("o_custkey") % 4 != 0)
    return rows.select("o_custkey", "cycle", "rul", F.round("z", 6).alias("z"))


@query(
    """WITH e AS (SELECT user_id, CAST(date_diff('day', (SELECT min(ts) FROM events)::DATE, ts::DATE) AS BIGINT) AS day, CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 5 ELSE -1 END AS code, event_id FROM events),
g AS (SELECT user_id, unnest(range(0, last + 1)) AS day FROM (SELECT DISTINCT user_id FROM events), (SELECT max(day) AS last FROM e)),
f AS (SELECT user_id, day, arg_max(code, event_id) AS code FROM e GROUP BY ALL)
SELECT g.user_id, g.day, coalesce(f.code, -1) AS code FROM g LEFT JOIN f USING (user_id, day)"""
)
def grid_labels(spark, d):
    """Codes scattered on the grid of all days from the first to the last, -1 where there is none; the last event of a day counts."""
    events = table(spark, d, "events").withColumn("date", F.col("ts").cast("date"))
    ends = events.agg(F.min("date").alias("first"), F.datediff(F.max("date"), F.min("date")).cast("long").alias("last"))
    code = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "signup", 5).otherwise(-1)
    day = F.datediff("date", "first").cast("long").alias("day")
    rows = events.join(F.broadcast(ends), how="cross").groupBy("user_id", day).agg(F.max_by(code, "event_id").alias("code"))
    users = rows.select("user_id").distinct().join(F.broadcast(ends), how="cross")
    grid = users.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("day"))
    return grid.join(rows, ["user_id", "day"], "left").select("user_id", "day", F.coalesce("code", F.lit(-1)).alias("code"))


@query(
    f"""WITH {SERIES} SELECT user_id, rn, coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS)
OVER (PARTITION BY user_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS subject FROM series"""
)
def inherit_subject(spark, d):
    """Records without a subject of their own inherit the one before; -1 where there is none yet."""
    before = Window.partitionBy("user_id").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return event_series(spark, d).select("user_id", "rn", F.coalesce(F.last(own, True).over(before), F.lit(-1)).alias("subject"))


@query(f"WITH {SERIES} SELECT user_id, rn, value FROM series WHERE (rn - 1) % 5 = 0")
def strided_rows(spark, d):
    """Every fifth sample of each series: a downsampling operator, the stride is its feature."""
    return event_series(spark, d).where((F.col("rn") - 1) % 5 == 0).select("user_id", "rn", "value")


@query(f"WITH {SERIES} SELECT user_id, (rn - 1) // 25 AS block, round(avg(value), 6) AS mean, count(*) AS n FROM series GROUP BY 1, 2")
def mean_downsample(spark, d):
    return event_series(spark, d).groupBy("user_id", F.expr("(rn - 1) div 25").alias("block")).agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {SERIES}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM series)
SELECT user_id, (rn - 1) // 8 AS win, event_type AS label FROM n WHERE (rn - 1) % 8 = 4 AND (rn - 1) // 8 < n // 8"""
)
def window_midpoint_labels(spark, d):
    win = R.count_windows(event_series(spark, d), ["user_id"], 8, keep_rest=False)
    return win.where("pos = 4").select("user_id", F.col("win").cast("long").alias("win"), F.col("event_type").alias("label"))


@query(
    """WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 20)
SELECT user_id, i, CAST(floor(i * (n - 20) / 4.0) AS BIGINT) AS start FROM (SELECT user_id, n, unnest(range(0, 5)) AS i FROM n)"""
)
def evenly_spaced_starts(spark, d):
    """Five window starts per series, evenly spaced from the first row to the last whole window of 20."""
    n = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")
    rows = n.select("user_id", "n", F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<bigint>")).alias("i"))
    return rows.select("user_id", "i", F.floor(F.col("i") * (F.col("n") - 20) / 4.0).cast("long").alias("start"))


@query(
    f"""WITH {SERIES}, p AS (SELECT user_id, rn, value, lag(value) OVER (PARTITION BY user_id ORDER BY rn) AS pred, count(*) OVER (PARTITION BY user_id) // 2 AS len FROM series)
SELECT user_id, round(sum(CASE WHEN rn <= len THEN (value - coalesce(pred, 0)) ** 2 ELSE 0 END) / max(len), 6) AS loss FROM p WHERE len > 0 GROUP BY 1"""
)
def masked_sequence_loss(spark, d):
    """Squared error of the persistence forecast over the first half of each series, per step."""
    own = Window.partitionBy("user_id")
    rows = event_series(spark, d).withColumn("pred", F.lag("value").over(own.orderBy("rn"))).withColumn("len", F.expr("count(*) OVER (PARTITION BY user_id) div 2"))
    error = F.when(F.col("rn") <= F.col("len"), (F.col("value") - F.coalesce("pred", F.lit(0.0))) ** 2).otherwise(0.0)
    return rows.where("len > 0").groupBy("user_id").agg(F.round(F.sum(error) / F.max("len"), 6).alias("loss"))


TYPES = ["click", "error", "purchase", "signup", "view"]


@query("SELECT user_id, " + ", ".join(f"max((event_type = '{t}')::INTEGER) AS {t}" for t in TYPES) + " FROM events GROUP BY 1")
def multi_hot_labels(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(*(F.max((F.col("event_type") == t).cast("int")).alias(t) for t in TYPES))


@query(
    """WITH a AS (SELECT doc_id AS id, n_chars FROM documents), b AS (SELECT doc_id AS id, quality FROM labels), c AS (SELECT vec_id AS id, label FROM embeddings)
SELECT id, coalesce(a.n_chars, -1) AS n_chars, coalesce(b.quality, -1) AS quality, coalesce(c.label, -1) AS label, (a.id IS NOT NULL)::INTEGER + (b.id IS NOT NULL)::INTEGER + (c.id IS NOT NULL)::INTEGER AS views
FROM a FULL JOIN b USING (id) FULL JOIN c USING (id)"""
)
def three_source_outer(spark, d):
    """Three sources by id; what a source lacks is null, shown as -1."""
    a = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars", F.lit(1).alias("ia"))
    b = table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality", F.lit(1).alias("ib"))
    c = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.lit(1).alias("ic"))
    rows = a.join(b, "id", "full").join(c, "id", "full")
    return rows.select("id", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("n_chars", "quality", "label")), sum((F.coalesce(x, F.lit(0)) for x in ("ia", "ib", "ic")), F.lit(0)).alias("views"))


@query(
    f"""WITH {SERIES}, w AS (SELECT user_id, rn, round(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY rn)), 6) AS dist FROM series)
SELECT user_id, rn, dist FROM w WHERE dist IS NOT NULL ORDER BY dist, user_id, rn LIMIT 10"""
)
def top_windows(spark, d):
    """The ten closest neighbouring samples over all series: a top-k report."""
    own = Window.partitionBy("user_id").orderBy("rn")
    rows = event_series(spark, d).select("user_id", "rn", F.round(F.abs(F.col("value") - F.lag("value").over(own)), 6).alias("dist")).where("dist is not null")
    return rows.orderBy("dist", "user_id", "rn").limit(10)


@query(
    f"""WITH p AS (SELECT vec_id, {E64} AS e FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(e[33:64], lambda x: x * exp(0.3) + 0.1)) + list_sum(e[1:32]), 6) AS total, round(32 * 0.3, 6) AS logdet, round(list_sum(e), 6) AS back FROM p"""
)
def coupling_transform(spark, d):
    """A scale-and-shift coupling on the second half of the vector, and its inverse e^-s (y - t)."""
    v = A.doubles("embedding")
    y = F.concat(F.slice(v, 1, 32), F.transform(F.slice(v, 33, 32), lambda x: x * F.exp(F.lit(0.3)) + 0.1))
    back = F.concat(F.slice("y", 1, 32), F.transform(F.slice("y", 33, 32), lambda x: (x - 0.1) * F.exp(F.lit(-0.3))))
    rows = table(spark, d, "embeddings").select("vec_id", y.alias("y"))
    return rows.select("vec_id", F.round(A.total(F.col("y")), 6).alias("total"), F.round(F.lit(32 * 0.3), 6).alias("logdet"), F.round(A.total(back), 6).alias("back"))


@query(
    f"""WITH {SERIES}, x AS (SELECT user_id, rn, value / 100 AS a, lead(value, 1) OVER w / 100 AS b, lead(value, 2) OVER w / 100 AS c FROM series WINDOW w AS (PARTITION BY user_id ORDER BY rn)),
k AS (SELECT i.range AS i, j.range AS j, l.range AS l FROM range(5) i, range(5) j, range(5) l WHERE i.range + j.range + l.range <= 4)
SELECT user_id, rn, count(*) AS n, round(sum(a ** i * b ** j * c ** l), 6) AS total FROM x, k WHERE c IS NOT NULL GROUP BY 1, 2"""
)
def delay_monomials(spark, d):
    """The 35 monomials up to degree 4 of three delayed values, summed."""
    rows = R.delay_embedding(event_series(spark, d).withColumn("value", F.col("value") / 100), ["user_id"], "value", 1, 3)
    parts = A.monomials([F.col("x0"), F.col("x1"), F.col("x2")], 4)
    return rows.select("user_id", "rn", F.lit(len(parts)).cast("long").alias("n"), F.round(sum(parts[1:], parts[0]), 6).alias("total"))


@query(
    """WITH n AS (SELECT label, count(*) AS c, sum(count(*)) OVER () AS total FROM embeddings GROUP BY 1),
k AS (SELECT label, CAST(floor(c * 60 / total) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY label) = 1 THEN 60 - CAST(sum(CAST(floor(c * 60 / total) AS BIGINT)) OVER () AS BIGINT) ELSE 0 END AS k FROM n),
r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR), vec_id) AS r FROM embeddings)
SELECT r.vec_id, r.label FROM r JOIN k USING (label) WHERE r.r <= k.k"""
)
def stratified_fixed_n(spark, d):
    """Sixty rows in proportion to the labels, the remainder from the first label: a sampling operator."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    n = e.groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    whole = Window.partitionBy()
    share = n.withColumn("k", F.floor(F.col("c") * 60 / F.sum("c").over(whole)).cast("long"))
    share = share.withColumn("k", F.col("k") + F.when(F.col("label") == F.min("label").over(whole), 60 - F.sum("k").over(whole)).otherwise(0))
    order = Window.partitionBy("label").orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id")
    return e.withColumn("r", F.row_number().over(order)).join(F.broadcast(share), "label").where("r <= k").select("vec_id", "label")


@query()
def mutual_info_nats_2d(spark, d):
    """Mutual information, in nats, of each value and the next from a 256 x 256 histogram blurred by a Gaussian: the counts come from Spark, the blur of the fixed grid is NumPy."""
    pairs = R.next_values(event_series(spark, d), ["user_id"], "value")
    lim = pairs.agg(F.min("value").alias("x0"), F.max("value").alias("x1"), F.min("target").alias("y0"), F.max("target").alias("y1")).first()
    at = lambda c, lo, hi: F.least(F.floor((F.col(c) - lo) / ((hi - lo) or 1.0) * 256), F.lit(255)).cast("int")
    cells = pairs.groupBy(at("value", lim.x0, lim.x1).alias("i"), at("target", lim.y0, lim.y1).alias("j")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    grid = np.zeros((256, 256))
    grid[cells["i"], cells["j"]] = cells["n"]
    kernel = np.exp(-0.5 * np.arange(-4, 5) ** 2)
    kernel /= kernel.sum()
    for axis in (0, 1):
        grid = np.apply_along_axis(lambda v: np.convolve(v, kernel, "same"), axis, grid)
    p = grid + np.finfo(float).eps
    p /= p.sum()
    nats = float((p * np.log(p / (p.sum(1, keepdims=True) * p.sum(0)))).sum())
    return spark.createDataFrame([(round(nats, 6), int(cells["n"].sum()))], "nats double, n long")


@query()
def view_error_matrix(spark, d):
    """Frobenius error of every view predicted from every subset of other views' means: rows stay in Spark, predictors are ridge solves."""
    rows = table(spark, d, "embeddings").select("vec_id", A.doubles("embedding").alias("v"))
    m = M.moments(rows, "v")
    dims = [list(range(16 * k, 16 * k + 16)) for k in range(4)]
    found = []
    for target in range(4):
        for mask in V.subset_masks(4):
            if not mask >> target & 1:
                inputs = [i for k in range(4) if mask >> k & 1 for i in dims[k]]
                found.append((mask, target, round(float(M.ridge(m, inputs, dims[target])[1] * 16 * m.n), 6)))
    return spark.createDataFrame(found, "mask int, target int, squared_error double")


@query()
def view_order_curves(spark, d):
    """For every start view, the error of the last view as the others are added in order: curves over view orders."""
    from itertools import permutations

    errors = {(r["mask"], r["target"]): r["squared_error"] for r in view_error_matrix(spark, d).collect()}
    found = []
    for target in range(4):
        for order in permutations([v for v in range(4) if v != target]):
            mask = 0
            for step, v in enumerate(order):
                mask |= 1 << v
                found.append((target, "".join(map(str, order)), step, errors[mask, target]))
    return spark.createDataFrame(found, "target int, view_order string, step int, squared_error double")


@query(
    f"""WITH {SERIES}, p AS (SELECT user_id, period, rn % period AS phase, sum(value) AS s, count(*) AS n FROM series, (SELECT unnest(range(2, 50)) AS period) GROUP BY ALL),
q AS (SELECT user_id, period, round(sum(s * s / n) / sum(n), 6) AS q FROM p GROUP BY 1, 2)
SELECT user_id, period::INTEGER AS period, q AS score FROM q QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY q DESC, period) = 1"""
)
def period_search(spark, d):
    """Per series, the period among 2 to 49 whose phases explain most of the variance (scored by one exploded aggregation)."""
    rows = event_series(spark, d).select("user_id", "rn", "value", F.explode(F.sequence(F.lit(2), F.lit(49))).alias("period"))
    phases = rows.groupBy("user_id", "period", (F.col("rn") % F.col("period")).alias("phase")).agg(A.steady_sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    # periods tie by their rounded scores, so a last bit that depends on the order of a sum would decide
    score = phases.groupBy("user_id", "period").agg((A.steady_sum(F.col("s") * F.col("s") / F.col("n")) / F.sum("n")).alias("q"))
    best = score.groupBy("user_id").agg(F.max(F.struct(A.rounded("q", 6).alias("q"), (-F.col("period")).alias("p"))).alias("b"))
    return best.select("user_id", (-F.col("b.p")).alias("period"), F.col("b.q").alias("score"))
