"""Regression from functions to functions: coefficients on a basis, random features of them, ridge regression onto the other's coefficients.

The features of the rows are made in tasks and never stored. Up to DENSE features their summed products come back as one matrix and are solved by
Cholesky; beyond it the normal equations are solved by conjugate gradients, where a pass over the rows multiplies by the features and
back, so that nothing is larger than features x outputs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DENSE = 1024


@dataclass
class RandomFeatures:
    """sqrt(2 / width) cos(frequencies . x + phase): their products approach exp(-gamma |x - y|^2)."""

    frequencies: np.ndarray
    phase: np.ndarray

    @classmethod
    def draw(cls, dims: int, width: int, gamma: float, seed: int = 0) -> RandomFeatures:
        rng = np.random.default_rng(seed)
        return cls(rng.normal(size=(dims, width)) * np.sqrt(2 * gamma), rng.uniform(0, 2 * np.pi, width))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(2 / len(self.phase)) * np.cos(x @ self.frequencies + self.phase)


@dataclass
class FunctionMap:
    features: RandomFeatures
    psi: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.psi


def _summed(rows: DataFrame, one: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all rows of `one`(x, y), an array of `size` numbers."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size)
        for frame in frames:
            for at in range(0, len(frame), 1024):
                part = frame.iloc[at : at + 1024]
                total += one(np.stack(part["x"].to_numpy()), np.stack(part["y"].to_numpy())).ravel()
        yield pd.DataFrame({"i": np.arange(size), "s": total})

    found = rows.mapInPandas(add, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    return np.array([r.s for r in found])


def fit(rows: DataFrame, x: str, y: str, width: int, gamma: float, penalty: float, seed: int = 0, rounds: int = 500, tol: float = 1e-10) -> FunctionMap | None:
    """From the array columns `x` to `y`, both without nulls inside; rows with a null array are left out. None without rows."""
    lean = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y"))
    first = lean.first()
    if first is None:
        return None
    outputs, features = len(first.y), RandomFeatures.draw(len(first.x), width, gamma, seed)
    held = rows.sparkSession.sparkContext.broadcast(features)
    if width <= DENSE:
        flat = _summed(lean, lambda a, b: (z := held.value(a)).T @ np.hstack((z, b)), width * (width + outputs)).reshape(width, width + outputs)
        root = np.linalg.cholesky(flat[:, :width] + penalty * np.eye(width))
        return FunctionMap(features, np.linalg.solve(root.T, np.linalg.solve(root, flat[:, width:])))
    right = _summed(lean, lambda a, b: held.value(a).T @ b, width * outputs).reshape(width, outputs)

    def times(p: np.ndarray) -> np.ndarray:
        sent = rows.sparkSession.sparkContext.broadcast(p)
        found = _summed(lean, lambda a, _: (z := held.value(a)).T @ (z @ sent.value), p.size).reshape(p.shape)
        sent.unpersist()
        return found + penalty * p

    psi, rest = np.zeros_like(right), right.copy()
    way, size = rest.copy(), (rest**2).sum(axis=0)
    for _ in range(rounds):
        if (size <= tol**2 * np.maximum((right**2).sum(axis=0), 1e-300)).all():
            break
        pushed = times(way)
        step = np.where(size > 0, size / np.maximum((way * pushed).sum(axis=0), 1e-300), 0.0)
        psi, rest = psi + step * way, rest - step * pushed
        new = (rest**2).sum(axis=0)
        way, size = rest + np.where(size > 0, new / np.maximum(size, 1e-300), 0.0) * way, new
    return FunctionMap(features, psi)


def predicted(x: Column, model: FunctionMap) -> Column:
    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        parts = [model(np.stack(v.to_numpy()[at : at + 1024])) for at in range(0, len(v), 1024)]
        return pd.Series([r for p in parts for r in p.tolist()], dtype=object)

    return run(x)
