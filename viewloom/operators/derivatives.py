"""Total-variation derivatives of many series: chunks as array rows, solved by the batch with banded matrices.

With p the running sum of the derivative u, integral and differences of u touch two and three neighbouring entries of p, so a round
costs a few operations per sample, not the cube of a chunk's length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def solve_banded(d0: np.ndarray, d1: np.ndarray, d2: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions of symmetric positive systems, one a row, with the diagonal d0 and the first and second diagonals above it."""
    n = b.shape[1]
    d, l1, l2, x = d0.copy(), d1.copy(), d2.copy(), b.copy()
    for i in range(n):
        for back, low in ((1, l1), (2, l2)):
            if i >= back:
                j = i - back
                d[:, i] -= low[:, j] ** 2 * d[:, j]
                x[:, i] -= low[:, j] * x[:, j]
        if i and i + 1 < n:
            l1[:, i] -= l2[:, i - 1] * l1[:, i - 1] * d[:, i - 1]
        if i + 1 < n:
            l1[:, i] /= d[:, i]
        if i + 2 < n:
            l2[:, i] /= d[:, i]
    x /= d
    for i in range(n - 2, -1, -1):
        x[:, i] -= l1[:, i] * x[:, i + 1]
        if i + 2 < n:
            x[:, i] -= l2[:, i] * x[:, i + 2]
    return x


def tv_derivatives(x: np.ndarray, dt: np.ndarray, alpha: float = 1e-2, rounds: int = 30, eps: float = 1e-6) -> np.ndarray:
    """Of each row of x (steps dt, one a row) the u that minimises |integral(u) - x|^2 / 2 + alpha * (total variation of u), by lagged diffusivity."""
    m, n = x.shape
    if n < 3:
        return np.repeat((x[:, 1:] - x[:, :1]) / dt[:, None], 2, axis=1) if n == 2 else np.zeros((m, n))
    dt = dt[:, None]
    y = x - x[:, :1]
    half = dt / 2
    fit0, fit1 = np.repeat(2 * half**2, n, axis=1), np.repeat(half**2, n - 1, axis=1)
    fit0[:, -1] = half[:, 0] ** 2
    right = half * (y + np.c_[y[:, 1:], np.zeros(m)])
    u = np.gradient(x, axis=1) / dt
    for _ in range(rounds):
        w = alpha / dt / np.sqrt((np.diff(u, axis=1) / dt) ** 2 + eps)
        d0, d1 = fit0.copy(), fit1.copy()
        d0[:, 1:] += w
        d0[:, :-1] += 4 * w
        d0[:, :-2] += w[:, 1:]
        d1 -= 2 * w
        d1[:, :-1] -= 2 * w[:, 1:]
        p = solve_banded(d0, d1, w[:, 1:], right)
        u = np.diff(p, axis=1, prepend=0)
    return u


def derive_series(rows: DataFrame, keys: list[str], rn: str, value: str, dt: Column, alpha: float = 0.1, rounds: int = 15, size: int = 200, margin: int = 20) -> DataFrame:
    """keys, rn (from 1 per key, without gaps), dx: series of any length in chunks of `size`, each solved with `margin` rows of its neighbours.

    `dt` must be the same for all rows of a key. Null values and steps that are null or not above 0 make a chunk's derivatives null. A chunk
    is a row of at most size + 2 * margin samples; chunks are dealt by key and number, so the solves of a long series run in all tasks.
    """
    near = F.expr(f"array_distinct(array((_rn - 1) div {size}, greatest(_rn - 1 - {margin}, 0) div {size}, (_rn - 1 + {margin}) div {size}))")
    dealt = rows.select(*keys, F.col(rn).cast("long").alias("_rn"), F.col(value).cast("double").alias("_x"), dt.cast("double").alias("_dt")).withColumn("_chunk", F.explode(near))
    chunks = dealt.groupBy(*keys, "_chunk").agg(F.array_sort(F.collect_list(F.struct("_rn", "_x"))).alias("_c"), F.max("_dt").alias("_dt"))

    chunks = chunks.repartition(*keys, "_chunk")  # rows that come by key alone would leave a hot key's chunks in one task

    @F.pandas_udf("array<double>")
    def solve(x: pd.Series, dt: pd.Series) -> pd.Series:
        found = [None] * len(x)
        for n in set(map(len, x)):
            own = [i for i, v in enumerate(x) if len(v) == n and np.isfinite(v.astype(float)).all() and dt[i] > 0]
            if own:
                for i, u in zip(own, tv_derivatives(np.stack([x[i] for i in own]).astype(float), dt[own].to_numpy(), alpha, rounds), strict=True):
                    found[i] = u
        return pd.Series(found, index=x.index)

    solved = chunks.withColumn("_u", solve(F.transform("_c", lambda s: s["_x"]), "_dt"))
    each = solved.select(*keys, "_chunk", F.posexplode("_c").alias("_i", "_s"), "_u").where(F.expr(f"(_s._rn - 1) div {size} = _chunk"))
    return each.select(*keys, F.col("_s._rn").alias(rn), F.get("_u", F.col("_i")).alias("dx"))


def mean_step(keys: list[str], t: str) -> Column:
    """The mean time step of a row's series."""
    own = Window.partitionBy(*keys)
    return (F.max(t).over(own) - F.min(t).over(own)) / F.nullif(F.count(t).over(own) - 1, F.lit(0))
