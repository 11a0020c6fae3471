"""Invertible maps of vectors by name: each gives the mapped column, its log-determinant and the inverse, all as expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from viewloom.functions import arrays as A


@dataclass
class Flow:
    """forward(v) is (mapped, log-determinant), inverse(y) the vector again."""

    forward: object
    inverse: object


def reverse() -> Flow:
    return Flow(lambda v: (F.reverse(v), F.lit(0.0)), F.reverse)


def leaky_relu(slope: float) -> Flow:
    return Flow(lambda v: A.leaky_relu(v, slope), lambda y: F.transform(y, lambda x: F.when(x < 0, x / slope).otherwise(x)))


def scale_shift(first: int, log_scale: float, shift: float) -> Flow:
    """The entries from `first` (0-based) on become x e^s + t."""

    def rest(v: Column, map_one) -> Column:
        return F.transform(v, lambda x, i: F.when(i >= first, map_one(x)).otherwise(x))

    log_det = lambda v: F.greatest(F.size(v) - first, F.lit(0)) * F.lit(log_scale)
    return Flow(
        lambda v: (rest(v, lambda x: x * F.exp(F.lit(log_scale)) + shift), log_det(v)),
        lambda y: rest(y, lambda x: (x - shift) * F.exp(F.lit(-log_scale))),
    )


def chain_linear(below: float, diagonal: float) -> Flow:
    """y_i = diagonal * x_i + below * x_(i-1): unit lower bidiagonal times a scale; the inverse is solved forward."""
    before = lambda v, i: F.when(i > 0, F.element_at(v, F.greatest(i, F.lit(1)))).otherwise(0.0)

    def solve(y: Column) -> Column:
        step = lambda acc, x: F.concat(acc, F.array((x - F.lit(below) * F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0))) / diagonal))
        return F.aggregate(y, F.array().cast("array<double>"), step)

    from math import log

    return Flow(lambda v: (F.transform(v, lambda x, i: x * diagonal + before(v, i) * below), F.size(v) * F.lit(log(abs(diagonal)))), solve)


def logit() -> Flow:
    return Flow(A.logit, lambda y: A.sigmoid(y)[0])


FLOWS = {"reverse": reverse, "leaky_relu": leaky_relu, "scale_shift": scale_shift, "chain_linear": chain_linear, "logit": logit}


def make(kind: str, **settings) -> Flow:
    if kind not in FLOWS:
        raise ValueError(f"no transform is called {kind}; known are {', '.join(FLOWS)}")
    return FLOWS[kind](**settings)


def compose(*flows: Flow) -> Flow:
    """One after the other: log-determinants add, inverses go backwards."""

    def forward(v: Column) -> tuple[Column, Column]:
        dets = []
        for f in flows:
            v, det = f.forward(v)
            dets.append(det)
        return v, reduce(lambda a, b: a + b, dets, F.lit(0.0))

    return Flow(forward, lambda y: reduce(lambda v, f: f.inverse(v), reversed(flows), y))
