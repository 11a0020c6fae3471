"""Iterative solvers over moment matrices: ADMM with interchangeable prox pairs, group-sparse canonical correlation, multi-way shared embeddings.

The rows are summed into a covariance once (linear.moments); everything here costs by the width of the data, not by its rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from viewloom.operators.linear import Moments

Prox = Callable[[np.ndarray, float], np.ndarray]


@dataclass
class Splitting:
    """min f(x) + g(z) with x = z, by the alternating direction method of multipliers; state and residuals stay for warm starts."""

    prox_f: Prox
    prox_g: Prox
    x: np.ndarray
    z: np.ndarray
    u: np.ndarray
    primal: list[float] = field(default_factory=list)
    dual: list[float] = field(default_factory=list)

    @classmethod
    def start(cls, prox_f: Prox, prox_g: Prox, dim: int, warm: Splitting | None = None) -> Splitting:
        state = (warm.x, warm.z, warm.u) if warm else (np.zeros(dim),) * 3
        return cls(prox_f, prox_g, *(s.copy() for s in state))

    def solve(self, step: float = 1.0, rounds: int = 1000, tol: float = 1e-6) -> np.ndarray:
        """z, which keeps the constraint of g, once both residuals are below `tol`."""
        for _ in range(rounds):
            before = self.z
            self.x = self.prox_f(self.z - self.u, step)
            self.z = self.prox_g(self.x + self.u, step)
            self.u = self.u + self.x - self.z
            self.primal.append(float(np.linalg.norm(self.x - self.z)))
            self.dual.append(float(np.linalg.norm(self.z - before)) / step)
            if max(self.primal[-1], self.dual[-1]) < tol:
                break
        return self.z


def soft(v: np.ndarray, lam: float) -> np.ndarray:
    return np.sign(v) * np.maximum(np.abs(v) - lam, 0)


def shrink(v: np.ndarray, lam: float) -> np.ndarray:
    """prox of lam times the norm."""
    size = np.linalg.norm(v)
    return v * max(0.0, 1 - lam / size) if size else v


def group_prox(v: np.ndarray, groups: list[list[int]], each: float, lone: float) -> np.ndarray:
    """prox of `each` times the sum of the groups' norms plus `lone` times the sum of absolute values."""
    out = soft(v, lone)
    for g in groups:
        out[g] = shrink(out[g], each)
    return out


def ellipsoid(c: np.ndarray, past: np.ndarray) -> Prox:
    """Projection on the vectors z with z' c z <= 1 that are uncorrelated (by c) with the columns of `past`."""
    basis = np.eye(len(c))
    if past.shape[1]:
        _, s, vt = np.linalg.svd((c @ past).T)
        basis = vt[int((s > 1e-12 * s.max()).sum()) :].T
    values, turn = np.linalg.eigh(basis.T @ c @ basis)
    values, turn = values.clip(min=0), basis @ turn

    def project(v: np.ndarray, _: float) -> np.ndarray:
        y = turn.T @ v
        if values @ y**2 <= 1:
            return turn @ y
        low, high = 0.0, 1.0
        over = lambda m: values @ (y / (1 + m * values)) ** 2 > 1
        while over(high):
            low, high = high, high * 2
        for _ in range(100):
            middle = (low + high) / 2
            low, high = (middle, high) if over(middle) else (low, middle)
        return turn @ (y / (1 + high * values))

    return project


@dataclass
class SparseDirections:
    left: np.ndarray
    right: np.ndarray
    correlations: np.ndarray
    objectives: list[list[float]]


def group_sparse_cca(
    m: Moments, left: list[int], right: list[int], left_groups: list[list[int]], right_groups: list[list[int]], pairs: int = 1, each: float = 0.0, lone: float = 0.0, rounds: int = 50, ridge: float = 1e-6, tol: float = 1e-7
) -> SparseDirections:
    """Pairs of directions u, v that minimise -u' Cxy v + penalties (groups' norms, absolute values) with u' Cxx u <= 1, v' Cyy v <= 1, one after the other.

    A pair is found by exact minimisation over one side at a time, so its objective never rises; later pairs are uncorrelated with earlier
    ones. `objectives` has the course of each pair. Groups number the components of their own side.
    """
    cx, cy = m.cov[np.ix_(left, left)] + ridge * np.eye(len(left)), m.cov[np.ix_(right, right)] + ridge * np.eye(len(right))
    cxy = m.cov[np.ix_(left, right)]
    us, vs, course = np.zeros((len(left), 0)), np.zeros((len(right), 0)), []

    def penalty(x: np.ndarray, groups: list[list[int]]) -> float:
        return each * sum(np.linalg.norm(x[g]) for g in groups) + lone * np.abs(x).sum()

    for _ in range(pairs):
        hold_u, hold_v = ellipsoid(cx, us), ellipsoid(cy, vs)
        first = np.linalg.svd(cxy - cx @ us @ (us.T @ cxy @ vs) @ vs.T @ cy)
        u, v = hold_u(first[0][:, 0] / np.sqrt(np.diag(cx).mean()), 1.0), hold_v(first[2][0] / np.sqrt(np.diag(cy).mean()), 1.0)
        found, warm = [], {}
        value = lambda u, v: float(-u @ cxy @ v + penalty(u, left_groups) + penalty(v, right_groups))
        for _ in range(rounds):
            for side in "uv":
                c, groups, hold = (cxy @ v, left_groups, hold_u) if side == "u" else (cxy.T @ u, right_groups, hold_v)
                scale = 1 / max(np.linalg.norm(c), 1e-12)
                splitting = Splitting.start(lambda w, s, c=c, groups=groups: group_prox(w + s * c, groups, s * each, s * lone), hold, len(c), warm.get(side))
                new = splitting.solve(scale, 2000, tol)
                warm[side] = splitting
                # an inexact solve must not raise the objective
                if side == "u" and value(new, v) <= value(u, v):
                    u = new
                if side == "v" and value(u, new) <= value(u, v):
                    v = new
            found.append(value(u, v))
            if len(found) > 1 and found[-2] - found[-1] < tol:
                break
        course.append(found)
        us, vs = np.c_[us, u], np.c_[vs, v]
    sizes = np.sqrt(np.maximum(np.einsum("ik,ij,jk->k", us, cx, us) * np.einsum("ik,ij,jk->k", vs, cy, vs), 1e-300))
    flip = np.where(us[np.abs(us).argmax(axis=0), np.arange(pairs)] < 0, -1.0, 1.0)
    return SparseDirections(us * flip, vs * flip, np.einsum("ik,ij,jk->k", us, cxy, vs) / sizes, course)


# --- several views ------------------------------------------------------------------------------------------------


def orthonormal(u: np.ndarray) -> np.ndarray:
    """The closest matrix with orthonormal columns."""
    a, _, bt = np.linalg.svd(u, full_matrices=False)
    return a @ bt


def shared_embedding(m: Moments, views: list[list[int]], width: int = 2, rounds: int = 1000, tol: float = 1e-8) -> tuple[list[np.ndarray], list[float]]:
    """A basis per view whose codes are close to a common latent, and the course of the squared distances per row.

    Alternates between the latent (the mean of the views' codes) and each view's basis (least squares on the latent, then orthonormal).
    """
    bases = []
    for dims in views:
        _, vectors = np.linalg.eigh(m.cov[np.ix_(dims, dims)])
        u = vectors[:, ::-1][:, :width]
        bases.append(u * np.sign(u[np.abs(u).argmax(axis=0), np.arange(width)]))
    course: list[float] = []
    for _ in range(rounds):
        weights = np.zeros((width, len(m.cov)))
        for dims, u in zip(views, bases, strict=True):
            weights[:, dims] = u.T / len(views)
        latent = weights @ m.cov @ weights.T
        course.append(sum(float(np.trace(u.T @ m.cov[np.ix_(d, d)] @ u - 2 * u.T @ m.cov[d] @ weights.T + latent)) for d, u in zip(views, bases, strict=True)))
        new = [orthonormal(np.linalg.lstsq(latent, weights @ m.cov[:, d], rcond=None)[0].T) for d in views]
        moved = max(np.abs(a - b).max() for a, b in zip(new, bases, strict=True))
        bases = new
        if moved < tol:
            break
    return bases, course


def agreeing_directions(m: Moments, views: list[list[int]], width: int = 2, rounds: int = 500, tol: float = 1e-12) -> tuple[list[np.ndarray], list[list[float]]]:
    """Unit directions per view with the largest sum of covariances between views, one after the other, each orthogonal to those before (Gram-Schmidt)."""
    bases, courses = [np.zeros((len(d), 0)) for d in views], []
    for _ in range(width):
        free = lambda k, v: v - bases[k] @ (bases[k].T @ v)
        us = []
        for k, d in enumerate(views):
            c = m.cov[np.ix_(d, d)]
            hold = np.eye(len(d)) - bases[k] @ bases[k].T
            u = np.linalg.eigh(hold @ c @ hold)[1][:, -1]
            us.append(u * np.sign(u[np.abs(u).argmax()]))
        course: list[float] = []
        for _ in range(rounds):
            for k, d in enumerate(views):
                pull = free(k, sum(m.cov[np.ix_(d, o)] @ us[j] for j, o in enumerate(views) if j != k))
                size = np.linalg.norm(pull)
                us[k] = pull / size if size > 1e-300 else us[k]
            course.append(sum(float(us[a] @ m.cov[np.ix_(views[a], views[b])] @ us[b]) for a in range(len(views)) for b in range(a + 1, len(views))))
            if len(course) > 1 and course[-1] - course[-2] < tol:
                break
        bases = [np.c_[b, u] for b, u in zip(bases, us, strict=True)]
        courses.append(course)
    return bases, courses


# --- block-sparse regression of each view on the others --------------------------------------------------------------


@dataclass
class BlockRegression:
    """Of one view: coefficients (all components x its own, zero rows for itself), and per round the objective and each other view's block norm."""

    weights: np.ndarray
    objective: list[float]
    norms: list[list[float]]


def block_regression(m: Moments, views: list[list[int]], target: int, lam: float, rounds: int = 500, tol: float = 1e-9) -> BlockRegression:
    """W that minimises |y - x W|^2 / 2 (mean over rows) + lam * sum of the Frobenius norms of W's blocks, one a view of x: accelerated proximal
    gradient on the moments, restarted where the objective would rise, so it never does."""
    out, sources = views[target], [v for v in range(len(views)) if v != target]
    cxx, cxy = m.cov.copy(), m.cov[:, out].copy()
    step = 1 / max(float(np.linalg.eigvalsh(cxx)[-1]), 1e-12)
    cxy[out] = 0
    cxx[out] = cxx[:, out] = 0
    rest = float(np.trace(m.cov[np.ix_(out, out)])) / 2
    sizes = lambda w: [float(np.linalg.norm(w[views[v]])) for v in sources]
    value = lambda w: rest + float((w * (cxx @ w / 2 - cxy)).sum()) + lam * sum(sizes(w))

    def moved(w: np.ndarray) -> np.ndarray:
        new = w - step * (cxx @ w - cxy)
        for v in sources:
            new[views[v]] = shrink(new[views[v]], step * lam)
        return new

    w = ahead = np.zeros_like(cxy)
    pace, objective, norms = 1.0, [value(w)], [sizes(w)]
    for _ in range(rounds):
        new = moved(ahead)
        if value(new) > objective[-1]:
            new, pace = moved(w), 1.0
        faster = (1 + (1 + 4 * pace**2) ** 0.5) / 2
        ahead, w, pace = new + (pace - 1) / faster * (new - w), new, faster
        objective.append(min(value(w), objective[-1]))
        norms.append(sizes(w))
        if len(objective) > 5 and objective[-5] - objective[-1] < tol * max(rest, 1e-300):
            break
    return BlockRegression(w, objective, norms)


def block_redundancy(m: Moments, views: list[list[int]], lam: float, rounds: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """The history of the redundancy matrix (round, target view, source view: the block's norm; a course that ended early keeps its last values),
    and all coefficients (components x components) that predict each view from the others."""
    fits = [block_regression(m, views, v, lam, rounds) for v in range(len(views))]
    history = np.zeros((max(len(f.norms) for f in fits), len(views), len(views)))
    weights = np.zeros((len(m.cov), len(m.cov)))
    for v, f in enumerate(fits):
        others = [o for o in range(len(views)) if o != v]
        history[:, v, others] = [f.norms[min(k, len(f.norms) - 1)] for k in range(len(history))]
        weights[:, views[v]] = f.weights
    return history, weights
