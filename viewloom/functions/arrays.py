"""Column expressions on numbers and on arrays of doubles; all stay inside the JVM."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def steady_sum(x: Column | str) -> Column:
    """The sum of an aggregation to its last bit, whatever the order of the rows: multiples of 2^-10 add up exactly, the rests are small.

    Values from 2^42 on are added as they are.
    """
    x = _col(x)
    coarse = F.when(F.abs(x) < 2.0**42, F.rint(x * 1024.0) / 1024.0).otherwise(x)
    return F.sum(coarse) + F.sum(F.when(F.abs(x) < 2.0**42, x - coarse).otherwise(F.when(x.isNotNull(), 0.0)))


def rounded(x: Column | str, digits: int) -> Column:
    """Rounded in binary, half away from zero: the double nearest to x * 10^digits decides, not the shortest decimal of x."""
    x = _col(x)
    large = F.abs(x) * 10.0**digits
    return F.when(large < 2.0**52, F.signum(x) * F.floor(large + 0.5).cast("double") / 10.0**digits).otherwise(x)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), add)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm2(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def norm_of(v: Column, order: str) -> Column:
    """L1, L2 or Linf."""
    size = F.transform(v, F.abs)
    return {"L1": total(size), "L2": norm2(v), "Linf": F.array_max(size)}[order]


def sq_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def soft_threshold(x: Column | str, lam: float) -> Column:
    x = _col(x)
    return F.signum(x) * F.greatest(F.abs(x) - F.lit(lam), F.lit(0.0))


def prox_l2(v: Column | str, lam: float) -> Column:
    v = _col(v)
    size = norm2(v)
    return F.transform(v, lambda x: F.when(size > lam, x * (1 - F.lit(lam) / size)).otherwise(0.0))


def project_l2_ball(v: Column | str, radius: float) -> Column:
    v = _col(v)
    size = norm2(v)
    return F.transform(v, lambda x: F.when(size > radius, x * F.lit(radius) / size).otherwise(x))


def prox_shifted(prox, v: Column, c: Column, lam: float) -> Column:
    """The prox of f(x) + <c, x>: prox of f at v - lam c."""
    return prox(F.zip_with(v, c, lambda x, y: x - F.lit(lam) * y), lam)


def zeros_to(x: Column | str, other: float = 1.0, eps: float = 1e-6) -> Column:
    x = _col(x)
    return F.when(F.abs(x) > eps, x).otherwise(F.lit(other))


def leaky_relu(v: Column | str, slope: float) -> tuple[Column, Column]:
    """The transformed vector and its log-determinant, (number of negatives) * log slope."""
    v = _col(v)
    return F.transform(v, lambda x: F.when(x < 0, x * slope).otherwise(x)), F.size(F.filter(v, lambda x: x < 0)) * F.log(F.lit(slope))


def logit(v: Column | str) -> tuple[Column, Column]:
    v = _col(v)
    return F.transform(v, lambda x: F.log(x) - F.log(1 - x)), total(F.transform(v, lambda x: -F.log(x) - F.log(1 - x)))


def sigmoid(v: Column | str) -> tuple[Column, Column]:
    v = _col(v)
    one = lambda x: 1 / (1 + F.exp(-x))
    return F.transform(v, one), total(F.transform(v, lambda x: F.log(one(x)) + F.log(1 - one(x))))


def normal_nll(v: Column | str) -> Column:
    """Of a standard normal vector."""
    v = _col(v)
    return dot(v, v) / 2 + F.size(v) * F.log(F.lit(2.0) * F.pi()) / 2


def rbf(a: Column, b: Column, gamma: float) -> Column:
    return F.exp(-F.lit(gamma) * sq_distance(a, b))


def affine(v: Column, matrix: list[list[float]], shift: list[float]) -> Column:
    return F.array(*(reduce(add, (v[j] * F.lit(m) for j, m in enumerate(row)), F.lit(b)) for row, b in zip(matrix, shift, strict=True)))


def doubles(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def monomials(parts: list[Column], degree: int) -> list[Column]:
    """All products of up to `degree` columns, shorter ones first, the empty one (1) included."""
    from itertools import combinations_with_replacement

    found = [F.lit(1.0)]
    for n in range(1, degree + 1):
        found += [reduce(lambda a, b: a * b, group) for group in combinations_with_replacement(parts, n)]
    return found


def independent_of(v: Column, other: Column) -> Column:
    """What of v is orthogonal to `other`."""
    share = dot(v, other) / dot(other, other)
    return F.zip_with(v, other, lambda x, y: x - share * y)


def sparse(v: Column, eps: float) -> Column:
    """Entries whose size is below eps become 0."""
    return F.transform(v, lambda x: F.when(F.abs(x) < eps, 0.0).otherwise(x))


def excess(v: Column, cut: Column) -> Column:
    """sum(max(|v| - cut, 0)) - 1, which falls with the cut."""
    return total(F.transform(v, lambda x: F.greatest(F.abs(x) - cut, F.lit(0.0)))) - 1


def bisect(f, low: Column, high: Column, rounds: int = 60) -> Column:
    """The root of a falling function between two columns, as a fold of a fixed number of halvings."""

    def halve(s: Column, _: Column) -> Column:
        middle = (s["lo"] + s["hi"]) / 2
        up = f(middle) > 0
        return F.struct(F.when(up, middle).otherwise(s["lo"]).alias("lo"), F.when(up, s["hi"]).otherwise(middle).alias("hi"))

    start = F.struct(low.cast("double").alias("lo"), high.cast("double").alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)


def linf_cut(v: Column) -> Column:
    """Where the prox of the largest entry (weight 1) clips; null where all of v goes to 0."""
    return F.when(norm_of(v, "L1") > 1, bisect(lambda c: excess(v, c), F.lit(0.0), norm_of(v, "Linf")))
