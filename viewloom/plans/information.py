"""Entropy, mutual information, histograms and scaling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewloom.functions import arrays as A
from viewloom.operators import kernels
from viewloom.operators import linear as M
from viewloom.operators import series as R
from viewloom.operators import statistics as S
from viewloom.plans import SERIES, query
from viewloom.sources.tables import event_series, table

GAP = 6 * 3600.0


def _line(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem")


def _bits(df: DataFrame) -> DataFrame:
    return df.select(F.round("bits", 6).alias("bits"))


def _h(columns: str, source: str = "lineitem") -> str:
    return f"(SELECT -sum(c / n * log2(c / n)) FROM (SELECT count(*)::DOUBLE AS c, sum(count(*)) OVER () AS n FROM {source} GROUP BY {columns}))"


@query(f"SELECT round({_h('l_returnflag')}, 6) AS bits")
def entropy_bits(spark, d):
    return _bits(S.entropy(_line(spark, d), ["l_returnflag"]))


@query(f"SELECT round({_h('l_returnflag, l_linestatus')}, 6) AS bits")
def joint_entropy_bits(spark, d):
    return _bits(S.entropy(_line(spark, d), ["l_returnflag", "l_linestatus"]))


@query(f"SELECT round({_h('l_returnflag, l_linestatus')} - {_h('l_linestatus')}, 6) AS bits")
def cond_entropy_bits(spark, d):
    return _bits(S.conditional_entropy(_line(spark, d), ["l_returnflag"], ["l_linestatus"]))


@query(f"SELECT round({_h('l_returnflag')} + {_h('l_quantity')} - {_h('l_returnflag, l_quantity')}, 6) AS bits")
def mutual_info_bits(spark, d):
    return _bits(S.mutual_information(_line(spark, d), ["l_returnflag"], ["l_quantity"]))


@query(
    f"SELECT round({_h('l_returnflag, l_linenumber')} + {_h('l_linestatus, l_linenumber')} - {_h('l_returnflag, l_linestatus, l_linenumber')}"
    f" - {_h('l_linenumber')}, 6) AS bits"
)
def cond_mutual_info_bits(spark, d):
    return _bits(S.conditional_mutual_information(_line(spark, d), ["l_returnflag"], ["l_linestatus"], ["l_linenumber"]))


@query(
    "SELECT *, row_number() OVER (ORDER BY l_linestatus, l_returnflag) AS state FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2)"
)
def joint_state_ids(spark, d):
    return S.joint_states(_line(spark, d), ["l_returnflag", "l_linestatus"]).withColumn("state", F.col("state").cast("long"))


@query(
    """SELECT state, n, round(n / sum(n) OVER (), 6) AS p, round(sum(n) OVER (ORDER BY state) / sum(n) OVER (), 6) AS cdf
FROM (SELECT l_quantity AS state, count(*) AS n FROM lineitem GROUP BY 1)"""
)
def hist_marginal_cdf(spark, d):
    return S.marginal(_line(spark, d), "l_quantity").select("state", "n", F.round("p", 6).alias("p"), F.round("cdf", 6).alias("cdf"))


@query(
    """SELECT user_id, event_id, round((value - m) / CASE WHEN s > 1e-6 THEN s ELSE 1 END, 6) AS z
FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events WHERE user_id % 5 <> 0)"""
)
def zscore_train_stats(spark, d):
    return S.zscore(table(spark, d, "events"), "value", train=F.col("user_id") % 5 != 0).select("user_id", "event_id", F.round("z", 6).alias("z"))


@query(
    """SELECT user_id, event_id, round((value - m) / CASE WHEN s > 1e-3 THEN s ELSE 1 END, 6) AS z
FROM events JOIN (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1) USING (user_id)"""
)
def zscore_per_subject(spark, d):
    return S.zscore(table(spark, d, "events"), "value", ["user_id"], sample=False, least=1e-3).select("user_id", "event_id", F.round("z", 6).alias("z"))


@query(
    """SELECT event_id, round((value - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END, 6) AS scaled
FROM events JOIN (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1) USING (event_type)"""
)
def minmax_scale(spark, d):
    return S.minmax(table(spark, d, "events"), "value", ["event_type"]).select("event_id", F.round("scaled", 6).alias("scaled"))


@query(
    """WITH s AS (SELECT user_id, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1),
lim AS (SELECT user_id, min(value) AS lo, max(value) AS hi FROM events JOIN s USING (user_id) WHERE value - m < 3 * s OR s = 0 GROUP BY 1)
SELECT event_id, round((value - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END, 6) AS scaled FROM events JOIN lim USING (user_id)"""
)
def robust_minmax_onesided(spark, d):
    return S.robust_minmax(table(spark, d, "events"), "value", ["user_id"], 3.0).select("event_id", F.round("scaled", 6).alias("scaled"))


@query(
    f"""WITH {SERIES}, w AS (SELECT *, (rn - 1) // 10 AS win FROM series),
m AS (SELECT user_id, win, list(value ORDER BY rn) AS l FROM w GROUP BY 1, 2),
c AS (SELECT w.*, value - list_sum(l) / len(l) AS v FROM w JOIN m USING (user_id, win))
SELECT user_id, rn, win, round(v / nullif(max(abs(v)) OVER (PARTITION BY user_id, win), 0), 6) AS scaled FROM c"""
)
def mean_scale_window(spark, d):
    from pyspark.sql import Window

    rows = event_series(spark, d).withColumn("win", F.expr("(rn - 1) div 10"))
    own = Window.partitionBy("user_id", "win")
    # summed in the order of the rows: a sum in order of arrival may differ in its last bit, and with it a rounded tie
    whole = own.orderBy("rn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    centred = rows.withColumn("v", F.col("value") - F.avg("value").over(whole))
    top = F.max(F.abs("v")).over(own)
    return centred.select("user_id", "rn", "win", F.round(F.col("v") / F.nullif(top, F.lit(0.0)), 6).alias("scaled"))


@query(
    "WITH v AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) "
    "SELECT a.i, b.i AS j, round(corr(a.x, b.x), 6) AS r FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2"
)
def corr_matrix_long(spark, d):
    """Correlations of all dimensions: tasks sum outer products, the matrix has a fixed size."""
    cov = M.moments(table(spark, d, "embeddings"), "embedding").cov
    size = np.sqrt(np.diag(cov))
    found = [(i, j, round(float(cov[i, j] / (size[i] * size[j])), 6)) for i in range(len(cov)) for j in range(i, len(cov))]
    return spark.createDataFrame(found, "i long, j long, r double")


@query(
    """WITH p AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
g AS (SELECT a.vec_id AS i, b.vec_id AS j, exp(-0.05 * list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS g FROM p a, p b WHERE a.vec_id % 100 = 0)
SELECT i, j, round(g - avg(g) OVER (PARTITION BY i) - avg(g) OVER (PARTITION BY j) + avg(g) OVER (), 6) AS centred FROM g"""
)
def gram_center(spark, d):
    """The kernel of the stated queries (ids divisible by 100) with all rows, centred over both."""
    p = table(spark, d, "embeddings")
    return kernels.centred_kernel(p, p.where("vec_id % 100 = 0"), "vec_id", "embedding", 0.05, 6)


@query(
    """WITH b AS (SELECT event_type, CAST(least(floor(value / 10), 19) AS INTEGER) AS bin, count(*) AS n
FROM events WHERE value BETWEEN 0 AND 200 GROUP BY 1, 2)
SELECT e.event_type, g.bin, coalesce(b.n, 0) AS n, round(coalesce(b.n, 0) / e.total, 6) AS share
FROM (SELECT event_type, count(*) AS total FROM events GROUP BY 1) e, (SELECT CAST(range AS INTEGER) AS bin FROM range(20)) g
LEFT JOIN b ON b.event_type = e.event_type AND b.bin = g.bin"""
)
def velocity_hist(spark, d):
    e = table(spark, d, "events")
    totals = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("total"))
    found = S.histogram(e, "value", 0.0, 200.0, 20, ["event_type"]).join(totals, "event_type")
    return found.select("event_type", "bin", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query(
    """SELECT event_type, count(*) FILTER (WHERE cdf <= 0.8) AS idx FROM (
  SELECT event_type, bin, sum(n) OVER (PARTITION BY event_type ORDER BY bin) / sum(n) OVER (PARTITION BY event_type) AS cdf
  FROM (SELECT event_type, floor(value / 10) AS bin, count(*) AS n FROM events GROUP BY 1, 2)) GROUP BY 1"""
)
def cdf_index_at_p(spark, d):
    from pyspark.sql import Window

    n = table(spark, d, "events").groupBy("event_type", F.floor(F.col("value") / 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("event_type")
    cdf = n.withColumn("cdf", F.sum("n").over(own.orderBy("bin")) / F.sum("n").over(own))
    return cdf.groupBy("event_type").agg(F.count_if(F.col("cdf") <= 0.8).alias("idx"))


@query(
    """WITH g AS (SELECT vec_id, unnest(range(0, 4)) AS grp, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT vec_id, list_transform(e[grp * 16 + 1 : grp * 16 + 16], lambda x: abs(x)) AS a FROM g)
SELECT vec_id, round(sum(list_sum(a)), 6) AS l1, round(sum(sqrt(list_sum(list_transform(a, lambda x: x * x)))), 6) AS l2, round(sum(list_max(a)), 6) AS linf FROM n GROUP BY 1"""
)
def group_norms(spark, d):
    v = A.doubles("embedding")
    groups = [F.slice(v, 1 + 16 * g, 16) for g in range(4)]
    out = {name.lower(): F.round(sum((A.norm_of(g, name) for g in groups), F.lit(0.0)), 6) for name in ("L1", "L2", "Linf")}
    return table(spark, d, "embeddings").select("vec_id", *(c.alias(n) for n, c in out.items()))


@query(
    f"""WITH {SERIES}, c AS (SELECT user_id, event_type, count(*) AS n, min(rn) AS f FROM series GROUP BY 1, 2)
SELECT user_id, event_type, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1"""
)
def modal_label(spark, d):
    return S.modal_value(event_series(spark, d), ["user_id"], "event_type", "rn")


@query(
    f"""WITH {SERIES}, m AS (SELECT unnest(range(0, 8)) AS lag),
p AS (SELECT m.lag, a.event_type AS a, b.event_type AS b FROM m, series a JOIN series b ON a.user_id = b.user_id AND b.rn = a.rn + m.lag),
ab AS (SELECT lag, a, b, count(*)::DOUBLE AS c FROM p GROUP BY ALL), n AS (SELECT lag, sum(c) AS n FROM ab GROUP BY 1),
ma AS (SELECT lag, a, sum(c) AS ca FROM ab GROUP BY ALL), mb AS (SELECT lag, b, sum(c) AS cb FROM ab GROUP BY ALL)
SELECT lag, round(sum(c / n * log2(c * n / (ca * cb))), 6) AS bits FROM ab JOIN n USING (lag) JOIN ma USING (lag, a) JOIN mb USING (lag, b) GROUP BY lag"""
)
def lag_mi_discrete(spark, d):
    return R.lag_information(event_series(spark, d), ["user_id"], "event_type", 8).select(F.col("lag").cast("long"), F.round("bits", 6).alias("bits"))
