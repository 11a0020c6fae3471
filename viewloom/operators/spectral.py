"""Spectral embeddings: of a sparse neighbour graph by filtered subspace iteration, of two views by their cross-moments.

The graph is a table of weighted edges, the subspace a table with one row per node and a column per vector; multiplying by the Laplacian is a join and
a sum. A round applies a Chebyshev polynomial that damps all but the smallest eigenvalues, then re-orthogonalises and rotates by
matrices as wide as the subspace, which is all that the driver holds. There is no matrix of nodes by nodes.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.operators.linear import Moments
from viewloom.sources.tables import written


def neighbour_graph(near: DataFrame, gamma: float) -> DataFrame:
    """i, j, w both ways, from neighbours (query, neighbour, dist): an edge where one is a neighbour of the other, weight exp(-gamma dist^2)."""
    one = near.select(F.col("query").alias("i"), F.col("neighbour").alias("j"), F.exp(-gamma * F.col("dist") * F.col("dist")).alias("w"))
    other = one.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")
    return one.union(other).groupBy("i", "j").agg(F.max("w").alias("w"))


def _mixed(names: list[str], m: np.ndarray, to: str) -> list:
    """The columns times a small matrix."""
    return [reduce(add, (F.col(n) * float(m[r, c]) for r, n in enumerate(names))).alias(f"{to}{c}") for c in range(m.shape[1])]


def laplacian_embedding(edges: DataFrame, width: int, rounds: int = 12, degree: int = 8, spare: int = 4, tol: float = 1e-6, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """(node, x0 ... ) of the eigenvectors of the graph Laplacian with the smallest eigenvalues but that of the constant vector, and the eigenvalues.

    `edges` has i, j, w both ways. Of a graph in several parts, the vectors that are constant on each part come first, with eigenvalue 0.
    """
    edges = written(edges.where("i <> j and w > 0").select("i", "j", "w"))
    degrees = written(edges.groupBy(F.col("i").alias("node")).agg(F.sum("w").alias("deg")))
    count, top = degrees.agg(F.count(F.lit(1)), F.max("deg")).first()
    size = min(width + spare, max(count - 1, 1))
    names = [f"x{c}" for c in range(size)]
    top = 2.0 * (top or 0.0)  # no eigenvalue is above

    def multiplied(rows: DataFrame, old: list[str], new: str) -> DataFrame:
        """`rows` (node, deg, ...) with the Laplacian times the columns `old` as new0, new1, ..."""
        far = rows.select(F.col("node").alias("j"), *old)
        pulled = edges.join(far, "j").groupBy(F.col("i").alias("node")).agg(*(F.sum(F.col("w") * F.col(n)).alias(f"_{n}") for n in old))
        found = rows.join(pulled, "node")
        return found.select(*rows.columns, *((F.col("deg") * F.col(n) - F.col(f"_{n}")).alias(f"{new}{c}") for c, n in enumerate(old)))

    def sums(rows: DataFrame, a: list[str], b: list[str]) -> np.ndarray:
        row = rows.agg(*(F.sum(F.col(p) * F.col(q)).alias(f"{k}_{m}") for k, p in enumerate(a) for m, q in enumerate(b))).first()
        return np.array(row, float).reshape(len(a), len(b))

    start = [(F.pmod(F.xxhash64("node", F.lit(seed + c)), F.lit(2_000_003)) / 1_000_001.5 - 1).alias(n) for c, n in enumerate(names)]
    rows, values, cut = written(degrees.select("node", "deg", *start)), np.zeros(size), None
    for turn in range(rounds + 1):
        means = rows.agg(*(F.avg(n) for n in names)).first()
        rows = rows.select("node", "deg", *((F.col(n) - float(v)).alias(n) for n, v in zip(names, means, strict=True)))
        image = written(multiplied(rows, names, "y"))
        images = [f"y{c}" for c in range(size)]
        # orthonormal, then rotated to the eigenvectors within the subspace
        norm, turnm = np.linalg.eigh(sums(image, names, names))
        base = turnm / np.sqrt(np.maximum(norm, 1e-300))
        inner = base.T @ sums(image, names, images) @ base
        new, rotation = np.linalg.eigh((inner + inner.T) / 2)
        whole = base @ rotation
        rows = written(image.select("node", "deg", *_mixed(names, whole, "x")))
        settled = np.abs(new[:width] - values[:width]).max() <= tol * max(top, 1e-300)
        values = new
        if turn == rounds or settled and turn > 1:
            break
        # Chebyshev polynomial of the part of the spectrum above what is wanted
        cut = min(max(float(values[-1]), 1e-9 * top), 0.95 * top)
        middle, half = (top + cut) / 2, (top - cut) / 2
        now, before = names, None
        for step in range(1, degree + 1):
            rows = multiplied(rows, now, "y")
            scale = 1 if step == 1 else 2
            fresh = [((F.col(f"y{c}") - middle * F.col(n)) * (scale / half) - (F.col(before[c]) if before else 0)).alias(f"n{c}") for c, n in enumerate(now)]
            rows = rows.select("node", "deg", *(F.col(n).alias(f"p{c}") for c, n in enumerate(now)), *fresh)
            # a step reads its input twice, so it is a table
            rows = written(rows.select("node", "deg", *(F.col(f"p{c}").alias(f"b{c}") for c in range(size)), *(F.col(f"n{c}").alias(n) for c, n in enumerate(names))))
            now, before = names, [f"b{c}" for c in range(size)]
        rows = rows.select("node", "deg", *names)
    return rows.select("node", *names[:width]), values[:width]


def instrumental_embedding(m: Moments, left: list[int], right: list[int], width: int, ridge: float = 1e-12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrices that take centred rows of the two views to their embeddings, and the singular values of the product of their linear kernels.

    Kx Ky = X (X'Y) Y' has the rank of the views: with X = Q R its singular vectors follow from R (X'Y) S' alone, which sums of outer products give.
    Embeddings are scaled by the root of the singular values' reciprocals.
    """
    n = m.n
    cx, cy = (n * m.cov[np.ix_(d, d)] + ridge * np.eye(len(d)) for d in (left, right))
    rx, ry = np.linalg.cholesky(cx).T, np.linalg.cholesky(cy).T
    u, s, vt = np.linalg.svd(rx @ (n * m.cov[np.ix_(left, right)]) @ ry.T)
    u, s, v = u[:, :width], s[:width], vt[:width].T
    sign = np.sign(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])])
    return np.linalg.solve(rx, u * sign) / np.sqrt(s), np.linalg.solve(ry, v * sign) / np.sqrt(s), s
