"""Ordered series: gap segments, count windows, smoothing, differences, embeddings and lags.

A series is (key, rn, t, value): windows are partitioned by key (and segment), never global. Order inside one series is what these
operators are about, so one series is one partition of a window; sorts spill, and no series is collected into Python.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(series: DataFrame, key: str, gap: float, rn: str = "rn", t: str = "t") -> DataFrame:
    """`seg` from 0: a new one starts where the time step exceeds `gap` (strictly)."""
    order = Window.partitionBy(key).orderBy(rn)
    step = F.coalesce((F.col(t) - F.lag(t).over(order) > gap).cast("int"), F.lit(0))
    stepped = series.withColumn("_new", step)
    return stepped.withColumn("seg", F.sum("_new").over(order)).drop("_new")


def window_starts(n: Column, size: int, keep_rest: bool = True) -> Column:
    """0-based starts of count windows over n rows: 0, w, 2w, ... and, for a rest, n - w. Shorter than w: none."""
    whole = F.floor(n / size).cast("int")
    plain = F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole - 1), lambda i: i * size)).otherwise(F.array().cast("array<int>"))
    if not keep_rest:
        return plain
    return F.when((n % size > 0) & (n >= size), F.concat(plain, F.array((n - size).cast("int")))).otherwise(plain)


def count_windows(series: DataFrame, keys: list[str], size: int, keep_rest: bool = True, rn: str = "rn") -> DataFrame:
    """Every row once per window it is in, with win (from 0) and pos; rows are numbered inside `keys`.

    Window starts are computed per key and each row finds its one or two windows by arithmetic: no row is joined with
    all windows of its key.
    """
    inside = Window.partitionBy(*keys)
    at = series.withColumn("_i", F.row_number().over(inside.orderBy(rn)) - 1).withColumn("_n", F.count(F.lit(1)).over(inside))
    whole = F.floor(F.col("_n") / size)
    own = F.floor(F.col("_i") / size)
    plain = F.when(own < whole, F.struct(own.cast("int").alias("win"), (F.col("_i") % size).cast("int").alias("pos")))
    late = (F.col("_n") % size > 0) & (F.col("_n") >= size) & (F.col("_i") >= F.col("_n") - size) & F.lit(keep_rest)
    tail = F.when(late, F.struct(whole.cast("int").alias("win"), (F.col("_i") - F.col("_n") + size).cast("int").alias("pos")))
    return at.withColumn("_w", F.explode(F.array_compact(F.array(plain, tail)))).select("*", "_w.win", "_w.pos").drop("_w", "_i", "_n")


def box_smooth(series: DataFrame, keys: list[str], value: str, width: int = 3, rn: str = "rn", out: str = "smooth") -> DataFrame:
    """Centred box filter with zeros beyond the ends: always divided by `width`."""
    left = (width - 1) // 2
    order = Window.partitionBy(*keys).orderBy(rn).rowsBetween(-(width - 1 - left), left)
    return series.withColumn(out, F.sum(value).over(order) / width)


def triangular_average(series: DataFrame, keys: list[str], value: str, width: int = 5, rn: str = "rn", out: str = "tri") -> DataFrame:
    """Trailing moving average with triangular weights; rows without a whole window go."""
    weights = [min(i + 1, width - i) for i in range(width)]
    order = Window.partitionBy(*keys).orderBy(rn)
    total = sum((F.lag(value, width - 1 - i).over(order) * w for i, w in enumerate(weights)), F.lit(0.0))
    return series.withColumn(out, total / sum(weights)).where(F.col(out).isNotNull())


def finite_differences(series: DataFrame, keys: list[str], value: str, t: str = "t", rn: str = "rn", out: str = "dx") -> DataFrame:
    """(x[i+1] - x[i]) / (t[i+1] - t[i]); the last row and equal times give none."""
    order = Window.partitionBy(*keys).orderBy(rn)
    step = F.lead(t).over(order) - F.col(t)
    return series.withColumn(out, (F.lead(value).over(order) - F.col(value)) / F.nullif(step, F.lit(0.0))).where(F.col(out).isNotNull())


def delay_embedding(series: DataFrame, keys: list[str], value: str, tau: int, dims: int, rn: str = "rn") -> DataFrame:
    """x0 ... x(d-1) = x[i], x[i + tau], ...; rows without all of them go."""
    order = Window.partitionBy(*keys).orderBy(rn)
    found = series.select("*", *(F.lead(value, k * tau).over(order).alias(f"x{k}") for k in range(dims)))
    return found.where(F.col(f"x{dims - 1}").isNotNull())


def next_values(series: DataFrame, keys: list[str], value: str, rn: str = "rn") -> DataFrame:
    """Pairs of input and target: value and the next one."""
    order = Window.partitionBy(*keys).orderBy(rn)
    return series.withColumn("target", F.lead(value).over(order)).where("target is not null")


def ema(series: DataFrame, keys: list[str], value: str, alpha: float, rn: str = "rn") -> DataFrame:
    """Exponential moving average: alpha x + (1 - alpha) of the one before; the first is the value itself. Null values make all later averages null.

    A series is cut into chunks that are array rows, solved side by side in Arrow batches. What a chunk begins with is the average at the end of
    the one before it; weights below 1e-17 no longer change a double, and a chunk is longer than that, so the end follows from that chunk alone.
    """
    reach = ceil(log(1e-17) / log(1 - alpha)) if alpha < 1 else 1
    size = max(256, reach)
    order = Window.partitionBy(*keys).orderBy(rn)
    rows = series.select(*keys, F.col(rn).alias("_rn"), F.col(value).cast("double").alias("_x"), (F.row_number().over(order) - 1).alias("_i"))
    chunks = rows.groupBy(*keys, F.expr(f"_i div {size}").alias("_c")).agg(F.array_sort(F.collect_list(F.struct("_i", "_x", "_rn"))).alias("_s"))

    @F.pandas_udf("array<double>")
    def within(x: pd.Series, first: pd.Series) -> pd.Series:
        """From nothing, but a series' first chunk from its first value."""
        sizes = np.array([len(v) for v in x], int)
        held = np.zeros((len(x), sizes.max(initial=0)))
        for i, v in enumerate(x):
            held[i, : len(v)] = v
        last = np.where(first, held[:, 0] if held.size else 0.0, 0.0)
        for j in range(held.shape[1]):
            held[:, j] = last = alpha * held[:, j] + (1 - alpha) * last
        return pd.Series([v[:n] for v, n in zip(held, sizes, strict=True)], index=x.index)

    solved = chunks.withColumn("_e", within(F.transform("_s", lambda s: s["_x"]), F.col("_c") == 0))
    carried = F.coalesce(F.when(F.col("_c") > 0, F.element_at(F.lag("_e").over(Window.partitionBy(*keys).orderBy("_c")), -1)), F.when(F.col("_c") == 0, 0.0))
    each = solved.withColumn("_from", carried).select(*keys, "_from", F.posexplode("_s").alias("_j", "_s"), "_e")
    return each.select(*keys, F.col("_s._rn").alias(rn), (F.get("_e", F.col("_j")) + F.pow(F.lit(1 - alpha), F.col("_j") + 1) * F.col("_from")).alias("ema"))


def lag_information(series: DataFrame, keys: list[str], state: str, lags: int, rn: str = "rn") -> DataFrame:
    """lag, bits: mutual information of the states and the states `lag` rows later, from one exploded count table.

    The rows are multiplied by the number of lags, which is a parameter; counts are summed map-side.
    """
    order = Window.partitionBy(*keys).orderBy(rn)
    pairs = F.array(*(F.struct(F.lit(m).alias("lag"), F.lead(state, m).over(order).alias("b")) for m in range(lags)))
    rows = series.select(F.col(state).alias("a"), pairs.alias("p")).select("a", F.explode("p").alias("p")).select("a", "p.lag", "p.b").where("b is not null")
    ab = rows.groupBy("lag", "a", "b").agg(F.count(F.lit(1)).cast("double").alias("c"))
    term = lambda c: F.sum(F.col(c) * F.log2(c))
    joint = ab.groupBy("lag").agg(term("c").alias("sab"), F.sum("c").alias("n"))
    side = lambda x: ab.groupBy("lag", x).agg(F.sum("c").alias("c")).groupBy("lag").agg(term("c").alias(f"s{x}"))
    found = joint.join(side("a"), "lag").join(side("b"), "lag")
    return found.select("lag", (F.log2("n") + (F.col("sab") - F.col("sa") - F.col("sb")) / F.col("n")).alias("bits"))
