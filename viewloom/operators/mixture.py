"""Autoregressive mixtures: each component of a vector given those before it as a mixture of linear normal models, fitted by expectation-maximisation.

A pass over the rows sums, for every component and mixture part, the responsibility-weighted products of (1, earlier components, the component);
the parameters follow from those small matrices. Responsibilities come from log-sum-exp, weights enter as logarithms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewloom.operators import linear


@dataclass
class Mixture:
    """Per component i: weights (parts,), coefficients (parts, i + 1) with the intercept first, deviations (parts,)."""

    weights: list[np.ndarray]
    coefficients: list[np.ndarray]
    deviations: list[np.ndarray]
    likelihoods: list[float] = field(default_factory=list)

    def terms(self, x: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, parts) of log weight + log density, and (rows, i + 2) of 1, earlier components and the component."""
        z = np.hstack((np.ones((len(x), 1)), x[:, : i + 1]))
        rest = (z[:, -1:] - z[:, :-1] @ self.coefficients[i].T) / self.deviations[i]
        return np.log(self.weights[i]) - np.log(self.deviations[i]) - 0.5 * np.log(2 * np.pi) - 0.5 * rest**2, z

    def log_density(self, x: np.ndarray) -> np.ndarray:
        return sum(_logsum(self.terms(x, i)[0]) for i in range(len(self.weights)))

    def mean(self, x: np.ndarray, i: int) -> np.ndarray:
        """Of component i given the earlier components of the rows."""
        return np.hstack((np.ones((len(x), 1)), x[:, :i])) @ (self.weights[i] @ self.coefficients[i])


def _logsum(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=1)
    return top + np.log(np.exp(a - top[:, None]).sum(axis=1))


def _start(m: linear.Moments, parts: int) -> Mixture:
    """The regressions of all rows, parts moved apart by steps of the deviation."""
    out = Mixture([], [], [])
    for i in range(len(m.mean)):
        w = np.linalg.lstsq(m.cov[:i, :i], m.cov[:i, i], rcond=None)[0] if i else np.zeros(0)
        rest = float(np.sqrt(max(m.cov[i, i] - w @ m.cov[:i, i], 1e-12)))
        shift = (np.arange(parts) - (parts - 1) / 2) * rest
        out.weights.append(np.full(parts, 1 / parts))
        out.coefficients.append(np.hstack((m.mean[i] - m.mean[:i] @ w + shift[:, None], np.tile(w, (parts, 1)))))
        out.deviations.append(np.full(parts, rest))
    return out


def sums(x: np.ndarray, model: Mixture) -> np.ndarray:
    """One flat array: the summed matrices of every component and part, then the log-likelihood."""
    found, likelihood = [], 0.0
    for i in range(len(model.weights)):
        logs, z = model.terms(x, i)
        whole = _logsum(logs)
        likelihood += whole.sum()
        share = np.exp(logs - whole[:, None])
        found.append(np.einsum("rc,ra,rb->cab", share, z, z).ravel())
    return np.append(np.concatenate(found), likelihood)


def improved(flat: np.ndarray, model: Mixture, floor: float) -> Mixture:
    """The parameters that the sums call for; a part without rows stays as it is."""
    out, at = Mixture([], [], [], [*model.likelihoods, float(flat[-1])]), 0
    for i, old in enumerate(model.weights):
        size = i + 2
        s = flat[at : at + len(old) * size * size].reshape(len(old), size, size)
        at += s.size
        n = s[:, 0, 0]
        weights, coefficients, deviations = n / n.sum(), model.coefficients[i].copy(), model.deviations[i].copy()
        for c in np.flatnonzero(n > 1e-9):
            b = np.linalg.lstsq(s[c, :-1, :-1], s[c, :-1, -1], rcond=None)[0]
            coefficients[c] = b
            deviations[c] = np.sqrt(max((s[c, -1, -1] - 2 * b @ s[c, :-1, -1] + b @ s[c, :-1, :-1] @ b) / n[c], floor))
        out.weights.append(np.maximum(weights, 1e-300))
        out.coefficients.append(coefficients)
        out.deviations.append(deviations)
    return out


def fit(rows: DataFrame, vec: str, parts: int = 3, rounds: int = 30, tol: float = 1e-7, floor: float = 1e-8) -> Mixture | None:
    """`likelihoods` has the log-likelihood before each round; it does not fall. None without rows."""
    lean = rows.where(F.col(vec).isNotNull()).select(F.col(vec).cast("array<double>").alias("v"))
    m = linear.moments(lean, "v")
    if not m.n:
        return None
    model = _start(m, parts)
    for _ in range(rounds):
        held = rows.sparkSession.sparkContext.broadcast(model)

        def add(frames: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            total = None
            for frame in frames:
                for at in range(0, len(frame), 4096):
                    own = sums(np.stack(frame["v"].to_numpy()[at : at + 4096]), held.value)
                    total = own if total is None else total + own
            if total is not None:
                yield pd.DataFrame({"i": np.arange(len(total)), "s": total})

        found = lean.mapInPandas(add, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
        model = improved(np.array([r.s for r in found]), model, floor)
        held.unpersist()
        if len(model.likelihoods) > 1 and model.likelihoods[-1] - model.likelihoods[-2] < tol * m.n:
            break
    return model


def log_density(vec: Column, model: Mixture) -> Column:
    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(model.log_density(np.stack(v.to_numpy())) if len(v) else np.zeros(0))

    return run(vec)
