"""How far one recording runs behind another, from neighbours in their delay embeddings.

Two recordings are in step where the nearest neighbour in time of the one is also near in the other (and the other way round). Neighbours come
from the space tree once for each recording; every lag then is joins on row numbers, with as many rows as samples times lags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.operators import series as R
from viewloom.operators.space_tree import all_knn

#: Distances up to this are left out of the ratios.
NEAR = 1e-3


def _distance(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))


def sync_ratios(series: DataFrame, key: str, first, second, tau: int, dims: int, most: int, value: str = "value", rn: str = "rn") -> DataFrame:
    """lag, ratio, n for lags from -most to most: sample t of `first` is held beside sample t + lag of `second`.

    The ratio is the mean of both directions, turned so that it is 1 or more; 1 is full synchrony. Lags without a usable sample have no row.
    """
    both = R.delay_embedding(series.where(F.col(key).isin(first, second)), [key], value, tau, dims, rn)
    both = both.select(key, F.col(rn).cast("long").alias("t"), F.array(*(f"x{k}" for k in range(dims))).alias("v"))
    sides = []
    for name in (first, second):
        own = both.where(F.col(key) == F.lit(name)).select("t", "v")
        near = all_knn(own, "t", "v", 1).select(F.col("query").alias("t"), F.col("neighbour").alias("nn"), "dist")
        sides.append(own.join(near, "t"))
    a = sides[0].select(F.col("t").alias("ta"), F.col("v").alias("va"), F.col("nn").alias("na"), F.col("dist").alias("da"))
    b = sides[1].select(F.col("t").alias("tb"), F.col("v").alias("vb"), F.col("nn").alias("nb"), F.col("dist").alias("db"))
    rows = a.withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("tb", F.col("ta") + F.col("lag")).join(b, "tb")
    # what the other's neighbour is in one's own recording
    rows = rows.withColumn("t", F.col("nb") - F.col("lag")).join(a.select(F.col("ta").alias("t"), F.col("va").alias("ua")), "t", "left")
    rows = rows.withColumn("t", F.col("na") + F.col("lag")).join(b.select(F.col("tb").alias("t"), F.col("vb").alias("ub")), "t", "left")
    rows = rows.withColumn("ea", _distance("va", "ua")).withColumn("eb", _distance("vb", "ub"))
    one = F.avg(F.when(F.col("ea") > NEAR, F.col("da") / F.col("ea")))
    two = F.avg(F.when(F.col("eb") > NEAR, F.col("db") / F.col("eb")))
    found = rows.groupBy("lag").agg(((one + two) / 2).alias("r"), F.count(F.lit(1)).alias("n")).where("r > 0")
    return found.select("lag", F.when(F.col("r") >= 1, F.col("r")).otherwise(1 / F.col("r")).alias("ratio"), "n")


def sync_lag(ratios: DataFrame) -> DataFrame:
    """The lag with the least ratio; the one nearer to 0, then the lower, of equals."""
    best = F.min(F.struct("ratio", F.abs("lag").alias("away"), "lag"))
    return ratios.agg(best.alias("best")).where("best is not null").select("best.lag", "best.ratio")
