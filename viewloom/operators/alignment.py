"""Rigid and thin-plate alignment of point sets.

Rigid: one aggregation sums the moments of every group's paired points; a group's rotation is a 3 x 3 decomposition in the task that has its sums. Thin-plate:
a bounded set of knots is solved on the driver and broadcast; all points are warped where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Knots of a thin-plate spline at most: its solve is cubic in them and they are broadcast.
MOST_KNOTS = 2000


def right_handed(r: np.ndarray) -> np.ndarray:
    """Axes (columns) of two or three dimensions as a rotation; the first keeps its direction."""
    x = r[:, 0] / np.linalg.norm(r[:, 0])
    if len(r) == 2:
        return np.array([[x[0], -x[1]], [x[1], x[0]]])
    if len(r) != 3:
        raise ValueError("two or three dimensions")
    z = np.cross(x, r[:, 1])
    z = z / np.linalg.norm(z)
    return np.stack((x, np.cross(z, x), z), axis=1)


def homogeneous(r: np.ndarray, t: np.ndarray) -> np.ndarray:
    out = np.eye(len(r) + 1)
    out[:-1, :-1], out[:-1, -1] = r, t
    return out


def rotation_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rotation in the plane of a and b that turns the direction of a to that of b; a half turn goes about an axis across a."""
    a, b = np.asarray(a, float) / np.linalg.norm(a), np.asarray(b, float) / np.linalg.norm(b)
    if len(a) == 2:
        c, s = a @ b, a[0] * b[1] - a[1] * b[0]
        return np.array([[c, -s], [s, c]])
    if len(a) != 3:
        raise ValueError("two or three dimensions")
    axis, c = np.cross(a, b), float(a @ b)
    if np.linalg.norm(axis) < 1e-12:
        if c > 0:
            return np.eye(3)
        axis = np.cross(a, np.eye(3)[np.abs(a).argmin()])
        axis = axis / np.linalg.norm(axis)
        return 2 * np.outer(axis, axis) - np.eye(3)
    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
    return np.eye(3) + k + k @ k / (1 + c)


def rigid(cross: np.ndarray) -> np.ndarray:
    """The rotation r with the least sum of |r x - y|^2, from the summed products of centred x (rows) and y (columns)."""
    u, _, vt = np.linalg.svd(cross)
    turn = np.eye(len(cross))
    turn[-1, -1] = np.sign(np.linalg.det(vt.T @ u.T)) or 1.0
    return vt.T @ turn @ u.T


def align_groups(rows: DataFrame, key: str, x: str, y: str, dims: int = 3) -> DataFrame:
    """Per key: n, rotation (row by row), shift, rmse of y = rotation x + shift. Null points are left out; a null key is a group.

    Sums are taken around one point of the table, so that large coordinates cancel nothing.
    """
    lean = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("key"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("array<double>").alias("y"))
    pilot = lean.select("x", "y").first()
    kind = dict(rows.dtypes)[key]
    schema = f"{key} {kind}, n long, rotation array<double>, shift array<double>, rmse double"
    if pilot is None:
        return rows.sparkSession.createDataFrame([], schema)
    c = [F.col("x")[i] - F.lit(pilot.x[i]) for i in range(dims)] + [F.col("y")[i] - F.lit(pilot.y[i]) for i in range(dims)]
    sums = [F.sum(a).alias(f"s{i}") for i, a in enumerate(c)]
    sums += [F.sum(c[i] * c[dims + j]).alias(f"p{i}_{j}") for i in range(dims) for j in range(dims)]
    sums += [F.sum(sum(a * a for a in c[:dims])).alias("xx"), F.sum(sum(a * a for a in c[dims:])).alias("yy"), F.count(F.lit(1)).alias("n")]
    origin = np.array(pilot.x[:dims]), np.array(pilot.y[:dims])

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                n = r["n"]
                mean = np.array([r[f"s{i}"] for i in range(2 * dims)]) / n
                cross = np.array([[r[f"p{i}_{j}"] for j in range(dims)] for i in range(dims)]) - n * np.outer(mean[:dims], mean[dims:])
                turn = rigid(cross)
                rest = r["xx"] - n * mean[:dims] @ mean[:dims] + r["yy"] - n * mean[dims:] @ mean[dims:] - 2 * np.trace(turn @ cross)
                shift = mean[dims:] + origin[1] - turn @ (mean[:dims] + origin[0])
                out.append((r["key"], n, turn.ravel().tolist(), shift.tolist(), float(np.sqrt(max(rest, 0.0) / n))))
            yield pd.DataFrame(out, columns=[key, "n", "rotation", "shift", "rmse"])

    return lean.groupBy("key").agg(*sums).mapInPandas(solve, schema)


# --- thin-plate splines -------------------------------------------------------------------------------------------


@dataclass
class Warp:
    """x -> kernel(x, knots) @ bends + x @ linear + shift, with the kernel -distance of three dimensions."""

    knots: np.ndarray
    bends: np.ndarray
    linear: np.ndarray
    shift: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return kernel(x, self.knots) @ self.bends + x @ self.linear + self.shift

    def energy(self) -> float:
        """The bending energy; 0 for an affine map."""
        return float(np.trace(self.bends.T @ kernel(self.knots, self.knots) @ self.bends))


def kernel(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    return -np.sqrt(np.maximum(((x[:, None, :] - knots[None]) ** 2).sum(axis=2), 0))


def thin_plate(knots: np.ndarray, targets: np.ndarray, smooth: float = 0.0) -> Warp:
    """The warp that takes the knots to the targets (with `smooth`, near them) and bends least.

    Bends lie in the null space of the affine part, where the kernel is positive.
    """
    n, dims = knots.shape
    if n > MOST_KNOTS:
        raise ValueError(f"{n} knots are more than {MOST_KNOTS}")
    affine = np.c_[knots, np.ones(n)]
    u, s, _ = np.linalg.svd(affine, full_matrices=True)
    free = u[:, int((s > 1e-10 * s.max()).sum()) :]
    k = kernel(knots, knots) + smooth * np.eye(n)
    bends = free @ np.linalg.solve(free.T @ k @ free, free.T @ targets) if free.shape[1] else np.zeros((n, targets.shape[1]))
    rest = np.linalg.lstsq(affine, targets - k @ bends, rcond=None)[0]
    return Warp(knots, bends, rest[:dims], rest[dims])


def warped(points: Column, warp: Warp) -> Column:
    @F.pandas_udf("array<double>")
    def run(p: pd.Series) -> pd.Series:
        parts = [warp(np.stack(p.to_numpy()[at : at + 1024])) for at in range(0, len(p), 1024)]
        return pd.Series([r for part in parts for r in part.tolist()], dtype=object)

    return run(points)
