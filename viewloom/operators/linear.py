"""Linear algebra from sufficient statistics: rows stay in Spark, sums of outer products come back, small solves run in NumPy.

A moment table has width * width entries whatever the number of rows; tasks sum their own part and Spark adds the entries up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from viewloom.operators.derivatives import tv_derivatives


@dataclass
class Moments:
    n: float
    mean: np.ndarray
    cov: np.ndarray  # population covariance

    @property
    def second(self) -> np.ndarray:
        return self.cov + np.outer(self.mean, self.mean)


def moments(rows: DataFrame, vec: str) -> Moments:
    """Of an array column without nulls inside; null vectors are left out. Sums are taken around a pilot row, so large means cancel nothing."""
    lean = rows.where(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("v"))
    pilot = lean.first()
    if pilot is None:
        return Moments(0.0, np.zeros(0), np.zeros((0, 0)))
    pilot = np.array(pilot["v"])

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            if len(frame):
                x = np.stack(frame["v"].to_numpy()) - pilot
                x = np.hstack((np.ones((len(x), 1)), x))
                total = x.T @ x + (0 if total is None else total)
        if total is not None:
            yield pd.DataFrame({"i": np.arange(total.size), "s": total.ravel()})

    found = lean.mapInPandas(sums, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    width = int(round(len(found) ** 0.5))
    m = np.array([r["s"] for r in found]).reshape(width, width)
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    return Moments(n, pilot + mean, m[1:, 1:] / n - np.outer(mean, mean))


def moments_by(rows: DataFrame, key: str, vec: str) -> dict[object, Moments]:
    """Moments of each key's vectors, in one pass; tasks sum per key, so what comes back has keys * width * width entries. For few keys.

    Null vectors and vectors with nulls, and vectors of another width than the first row's, are left out; a null key is a key.
    """
    lean = rows.select(F.col(key).alias("k"), F.col(vec).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    pilot = lean.first()
    if pilot is None:
        return {}
    pilot = np.array(pilot["v"])
    kind = lean.schema["k"].dataType.simpleString()

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict = {}
        for frame in frames:
            for k, own in frame.groupby("k", dropna=False):
                x = np.stack(own["v"].to_numpy()) - pilot
                x = np.hstack((np.ones((len(x), 1)), x))
                k = None if pd.isna(k) else k
                totals[k] = totals.get(k, 0) + x.T @ x
        for k, total in totals.items():
            yield pd.DataFrame({"k": pd.Series([k] * total.size, dtype=object), "i": np.arange(total.size), "s": total.ravel()})

    whole = lean.where(F.size("v") == len(pilot))
    entries = whole.mapInPandas(sums, f"k {kind}, i int, s double").groupBy("k", "i").agg(F.sum("s").alias("s"))
    lists = entries.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda e: e["s"]).alias("m"))
    found = {}
    for row in lists.toLocalIterator():
        m = np.array(row["m"]).reshape(len(pilot) + 1, -1)
        mean = m[0, 1:] / m[0, 0]
        found[row["k"]] = Moments(m[0, 0], pilot + mean, m[1:, 1:] / m[0, 0] - np.outer(mean, mean))
    return found


def matrix_power(c: np.ndarray, power: float, eps: float = 1e-6) -> np.ndarray:
    """Of a symmetric positive matrix: the same eigenvectors, eigenvalues to the power; those below eps times the greatest become 0, whatever the power."""
    values, vectors = np.linalg.eigh(c)
    kept = values > eps * max(float(np.abs(values).max(initial=0)), 1e-300)
    return (vectors[:, kept] * values[kept] ** power) @ vectors[:, kept].T


def _signed(v: np.ndarray) -> np.ndarray:
    """Columns whose largest entry is positive, so that results do not hang on a solver's choice of sign."""
    return v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])


def pca(m: Moments, share: float = 1.0, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Variances and components (columns) that explain at least `share` of the variance."""
    values, vectors = np.linalg.eigh(m.cov)
    values, vectors = values[::-1].clip(min=0), _signed(vectors[:, ::-1])
    k = int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), share - 1e-12)) + 1
    k = min(k, len(values), most or len(values))
    return values[:k], vectors[:, :k]


def project(vec: Column, mean: np.ndarray, basis: np.ndarray) -> Column:
    @F.pandas_udf(ArrayType(DoubleType()))
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(v.to_numpy()) - mean) @ basis)) if len(v) else v

    return run(vec)


def cca(m: Moments, left: slice, right: slice, ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical correlations and the directions of both sides."""

    def root(c: np.ndarray) -> np.ndarray:
        values, vectors = np.linalg.eigh(c + ridge * np.eye(len(c)))
        return vectors @ np.diag(values**-0.5) @ vectors.T

    a, b = root(m.cov[left, left]), root(m.cov[right, right])
    u, s, vt = np.linalg.svd(a @ m.cov[left, right] @ b, full_matrices=False)
    return s.clip(0, 1), a @ u, b @ vt.T


def ridge(m: Moments, inputs: list[int], outputs: list[int], penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Coefficients (inputs x outputs) of centred variables, and the mean squared error per output variable."""
    cxx, cxy = m.cov[np.ix_(inputs, inputs)], m.cov[np.ix_(inputs, outputs)]
    w = np.linalg.solve(cxx + penalty * np.eye(len(inputs)), cxy)
    error = m.cov[np.ix_(outputs, outputs)] - w.T @ cxy - cxy.T @ w + w.T @ cxx @ w
    return w, float(np.trace(error)) / max(1, len(outputs))


def condition(m: Moments, known: list[int], wanted: list[int], jitter: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Of a joint normal: the matrix that takes centred known values to the conditional mean, and the conditional covariance."""
    ckk = m.cov[np.ix_(known, known)] + jitter * np.eye(len(known))
    gain = np.linalg.solve(ckk, m.cov[np.ix_(known, wanted)])
    return gain, m.cov[np.ix_(wanted, wanted)] - m.cov[np.ix_(wanted, known)] @ gain


def l21_regression(m: Moments, inputs: list[int], outputs: list[int], lam: float, rounds: int = 100, tol: float = 1e-6) -> np.ndarray:
    """Rows of the coefficient matrix are dropped jointly: iteratively reweighted least squares on the moments."""
    cxx, cxy = m.cov[np.ix_(inputs, inputs)], m.cov[np.ix_(inputs, outputs)]
    w = np.linalg.solve(cxx + 1e-6 * np.eye(len(inputs)), cxy)
    for _ in range(rounds):
        size = np.sqrt((w**2).sum(axis=1)).clip(min=1e-8)
        new = np.linalg.solve(cxx + lam * np.diag(1 / size), cxy)
        if np.abs(new - w).max() < tol:
            break
        w = new
    return np.where(np.sqrt((w**2).sum(axis=1, keepdims=True)) > 1e-4, w, 0.0)


def prox_linf(v: np.ndarray, lam: float) -> np.ndarray:
    """v minus its projection on the L1 ball of radius lam."""
    if np.abs(v).sum() <= lam:
        return np.zeros_like(v)
    u = np.sort(np.abs(v))[::-1]
    k = np.flatnonzero(u - (np.cumsum(u) - lam) / np.arange(1, len(u) + 1) > 0)[-1]
    cut = (u[: k + 1].sum() - lam) / (k + 1)
    return v - np.sign(v) * np.maximum(np.abs(v) - cut, 0)


def greedy_order(m: Moments, views: list[list[int]], target: int) -> list[tuple[int, float]]:
    """The other views in the order in which they lower the error of the target view most, with the errors."""
    left, taken, found = [v for v in range(len(views)) if v != target], [], []
    while left:
        errors = [(ridge(m, [i for v in [*taken, o] for i in views[v]], views[target])[1], o) for o in left]
        error, best = min(errors)
        taken.append(best)
        left.remove(best)
        found.append((best, error))
    return found


def tv_derivative(x: np.ndarray, dt: float, alpha: float = 1e-2, rounds: int = 30, eps: float = 1e-6) -> np.ndarray:
    """derivatives.tv_derivatives of one series."""
    return tv_derivatives(np.asarray(x, float)[None], np.array([float(dt)]), alpha, rounds, eps)[0]


def dtw_open(target: np.ndarray, series: np.ndarray) -> tuple[float, int]:
    """Least cost of aligning all of the target with a stretch of the series (each step of the target moves 0, 1 or 2 on), and its end."""
    cost = np.abs(series - target[0])
    for y in target[1:]:
        shifted = np.stack([cost, np.concatenate(([np.inf], cost[:-1])), np.concatenate(([np.inf] * min(2, len(cost)), cost[:-2]))[: len(cost)]])
        cost = shifted.min(axis=0) + np.abs(series - y)
    end = int(cost.argmin())
    return float(cost[end]), end
