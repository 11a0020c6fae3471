"""Structured sparse factorisation: rows as sparse combinations of atoms that are shared by all views.

Minimises sum |x - D a|^2 / 2 + sparse * |a|_1 + structure * (norms of the atoms' parts in each view) by turns. Codes are found row by row in Arrow
batches by accelerated proximal gradient from the codes of the round before, and written to the shared folder; the dictionary follows
from two summed matrices (codes by codes, rows by codes), one atom's part at a time and exactly, so the objective never rises. Atoms that
shrink to nothing in every view are taken out. The driver holds width x atoms numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.operators import linear
from viewloom.operators.solvers import shrink, soft
from viewloom.sources.tables import shared_folder


@dataclass
class Dictionary:
    atoms: np.ndarray  # width x atoms
    mean: np.ndarray
    objectives: list[float] = field(default_factory=list)


def sparse_codes(x: np.ndarray, atoms: np.ndarray, sparse: float, start: np.ndarray | None = None, rounds: int = 200, tol: float = 1e-7) -> np.ndarray:
    """Codes of the rows of x. Never worse than `start`."""
    if not atoms.shape[1]:
        return np.zeros((len(x), 0))
    gram, pull = atoms.T @ atoms, x @ atoms
    step = 1 / max(float(np.linalg.eigvalsh(gram)[-1]), 1e-12)
    cost = lambda a: ((a @ gram - 2 * pull) * a).sum(axis=1) / 2 + sparse * np.abs(a).sum(axis=1)
    code = np.zeros((len(x), atoms.shape[1])) if start is None else start
    ahead, t, first = code, 1.0, cost(code)
    origin = code
    for _ in range(rounds):
        new = soft(ahead - step * (ahead @ gram - pull), step * sparse)
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / later * (new - code)
        moved, code, t = np.abs(new - code).max(initial=0), new, later
        if moved < tol:
            break
    return np.where((cost(code) <= first)[:, None], code, origin)


def _improved(atoms: np.ndarray, aa: np.ndarray, xa: np.ndarray, views: list[list[int]], structure: float, rounds: int = 20) -> np.ndarray:
    atoms = atoms.copy()
    for _ in range(rounds):
        for j in range(atoms.shape[1]):
            if aa[j, j] <= 1e-12:
                atoms[:, j] = 0
                continue
            free = atoms[:, j] + (xa[:, j] - atoms @ aa[:, j]) / aa[j, j]
            for dims in views:
                atoms[dims, j] = shrink(free[dims], structure / aa[j, j])
    return atoms


def _coded(rows: DataFrame, id_col: str, mean: np.ndarray, atoms: np.ndarray, sparse: float, kept: np.ndarray | None) -> DataFrame:
    """id, v (centred), code: into a table of the shared folder. `kept`: which of the codes in `rows` go on."""
    held = rows.sparkSession.sparkContext.broadcast(atoms)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack(frame["v"].to_numpy())
            x, start = (x - mean, None) if kept is None else (x, np.stack(frame["code"].to_numpy())[:, kept])
            yield pd.DataFrame({id_col: frame[id_col], "v": list(x), "code": list(sparse_codes(x, held.value, sparse, start))})

    folder = shared_folder(rows.sparkSession, "codes")
    kind = dict(rows.dtypes)[id_col]
    rows.mapInPandas(run, f"{id_col} {kind}, v array<double>, code array<double>").write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def _sums(coded: DataFrame, atoms: np.ndarray, sparse: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Codes by codes, rows by codes, and the data's part of the objective."""
    held = coded.sparkSession.sparkContext.broadcast(atoms)
    m, width = atoms.shape[1], atoms.shape[0]

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((m + width) * m + 1)
        for frame in frames:
            if len(frame):
                x, a = np.stack(frame["v"].to_numpy()), np.stack(frame["code"].to_numpy())
                total[:-1] += np.vstack((a.T @ a, x.T @ a)).ravel()
                total[-1] += ((x - a @ held.value.T) ** 2).sum() / 2 + sparse * np.abs(a).sum()
        yield pd.DataFrame({"i": np.arange(len(total)), "s": total})

    found = coded.select("v", "code").mapInPandas(add, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    flat = np.array([r.s for r in found])
    both = flat[:-1].reshape(m + width, m)
    return both[:m], both[m:], float(flat[-1])


def fit(rows: DataFrame, id_col: str, vec: str, views: list[list[int]], atoms: int, sparse: float = 0.1, structure: float = 0.1, rounds: int = 8, least: float = 1e-6, start: np.ndarray | None = None) -> tuple[Dictionary, DataFrame]:
    """The dictionary and the last codes (id_col, v centred, code). It begins with principal components of all views and of each (or `start`)."""
    lean = rows.where(F.col(vec).isNotNull()).select(id_col, F.col(vec).cast("array<double>").alias("v"))
    m = linear.moments(lean, "v")
    if start is None:
        values, vectors = linear.pca(m)
        found = [vectors]
        for dims in views:
            own = np.zeros((len(m.cov), len(dims)))
            own[dims] = linear.pca(linear.Moments(m.n, m.mean[dims], m.cov[np.ix_(dims, dims)]))[1]
            found.append(own)
        share = -(-atoms // len(found))
        start = np.hstack([f[:, :share] for f in found])[:, :atoms]
    out = Dictionary(start, m.mean)
    penalty = lambda d: structure * sum(np.linalg.norm(d[v], axis=0).sum() for v in views)
    coded, kept = lean, None
    for _ in range(rounds):
        coded = _coded(coded, id_col, m.mean, out.atoms, sparse, kept)
        aa, xa, cost = _sums(coded, out.atoms, sparse)
        out.objectives.append(cost + penalty(out.atoms))
        new = _improved(out.atoms, aa, xa, views, structure)
        kept = np.stack([np.linalg.norm(new[v], axis=0) for v in views]).max(axis=0) > least
        out.atoms = new[:, kept]
        if not kept.any():
            break
    return out, _coded(coded, id_col, m.mean, out.atoms, sparse, kept)


def predict(known: np.ndarray, dims: list[int], wanted: list[int], d: Dictionary, sparse: float) -> np.ndarray:
    """Other components of rows from known ones: codes by the known rows of the dictionary, then its wanted rows."""
    return sparse_codes(known - d.mean[dims], d.atoms[dims], sparse) @ d.atoms[wanted].T + d.mean[wanted]
