"""Quadrature rules and shape functions, made from their definitions: any order, as numbers that expressions over columns use."""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from math import comb, factorial

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=None)
def jacobi(n: int, alpha: float = 0.0) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Points in (0, 1) and weights for the weight function (1 - t)^alpha: eigenvalues of the recurrence's matrix."""
    k = np.arange(n, dtype=float)
    s = 2 * k + alpha
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(s * (s + 2) == 0, -alpha / (alpha + 2), -(alpha**2) / (s * (s + 2)))
    j = np.arange(1, n, dtype=float)
    t = 2 * j + alpha
    b = 4 * j**2 * (j + alpha) ** 2 / (t**2 * (t + 1) * (t - 1))
    m = np.diag(a) + np.diag(np.sqrt(b), 1) + np.diag(np.sqrt(b), -1)
    x, v = np.linalg.eigh(m)
    return tuple((x + 1) / 2), tuple(v[0] ** 2 / (alpha + 1))


@lru_cache(maxsize=None)
def rule(kind: str, order: int) -> tuple[tuple[tuple[float, ...], float], ...]:
    """(point, weight) pairs exact for polynomials of a degree up to `order`, on the reference element.

    Simplices by collapsed coordinates: points are barycentric for edge, triangle and tet, else coordinates.
    """
    n = order // 2 + 1
    (x, w), (y, v), (z, u) = (jacobi(n, a) for a in (0.0, 1.0, 2.0))
    line = [(2 * a - 1, 2 * b) for a, b in zip(x, w, strict=True)]
    tri = [((1 - a) * (1 - b), a, (1 - a) * b, p * q) for a, p in zip(y, v, strict=True) for b, q in zip(x, w, strict=True)]
    if kind == "edge":
        out = [((1 - a, a), 2 * b) for a, b in zip(x, w, strict=True)]
    elif kind == "triangle":
        out = [((r, s, t), p) for r, s, t, p in tri]
    elif kind == "tet":
        out = [((1 - a, a), p) for a, p in zip(z, u, strict=True)]
        out = [(((1 - a) * r, (1 - a) * s, (1 - a) * t, a), p * q) for (_, a), p in out for r, s, t, q in tri]
    elif kind == "quad":
        out = [((a, b), p * q) for a, p in line for b, q in line]
    elif kind == "hex":
        out = [((a, b, c), p * q * r) for a, p in line for b, q in line for c, r in line]
    elif kind == "prism":
        out = [((s, t, c), p * q) for _, s, t, p in tri for c, q in line]
    else:  # pyramid: a square that shrinks to the top
        out = [((a * (1 - c), b * (1 - c), 2 * c - 1), 2 * p * q * r) for c, r in zip(z, u, strict=True) for a, p in line for b, q in line]
    return tuple(out)


def lattice(dim: int, order: int) -> list[tuple[int, ...]]:
    """Barycentric indices of the nodes of a simplex."""
    if dim == 0:
        return [(order,)]
    return [(i, *rest) for i in range(order + 1) for rest in lattice(dim - 1, order - i)]


def bernstein(index: tuple[int, ...], point: tuple[float, ...]) -> float:
    """The Bernstein polynomial of a lattice index at a barycentric point."""
    c = factorial(sum(index))
    for i in index:
        c //= factorial(i)
    return c * float(np.prod([p**i for p, i in zip(point, index, strict=True)]))


def _hierarchic(dim: int, order: int, p: tuple[float, ...]) -> list[float]:
    """Vertex, edge, face and inner modes up to a degree."""
    out = list(p)
    for i, j in combinations(range(dim + 1), 2):
        out += [p[i] * p[j] * (p[j] - p[i]) ** k for k in range(order - 1)]
    for i, j, k in combinations(range(dim + 1), 3):
        out += [p[i] * p[j] * p[k] * p[i] ** a * p[j] ** b for a in range(order - 2) for b in range(order - 2 - a)]
    if dim == 3:
        out += [p[0] * p[1] * p[2] * p[3] * p[0] ** a * p[1] ** b * p[2] ** c for a in range(order - 3) for b in range(order - 3 - a) for c in range(order - 3 - a - b)]
    return out


def basis(kind: str, dim: int, order: int, point: tuple[float, ...]) -> list[float]:
    """All functions of a basis at a barycentric point: 'bernstein', 'hierarchic' or 'lagrange'."""
    if kind == "bernstein":
        return [bernstein(i, point) for i in lattice(dim, order)]
    if kind == "hierarchic":
        return _hierarchic(dim, order, point)
    return list(interpolation("bernstein", dim, order, point))


@lru_cache(maxsize=None)
def interpolation(kind: str, dim: int, order: int, point: tuple[float, ...]) -> tuple[float, ...]:
    """The weight of each lattice node's value at a point, through the basis: its coefficients solve the nodes' values."""
    nodes = [tuple(i / order for i in index) for index in lattice(dim, order)]
    m = np.array([basis(kind, dim, order, q) for q in nodes])
    return tuple(np.linalg.solve(m.T, np.array(basis(kind, dim, order, point))))


def lobatto(n: int) -> list[float]:
    """The points of the closed rule of n points on [-1, 1]: the ends and the extrema of the Legendre polynomial."""
    if n == 2:
        return [-1.0, 1.0]
    c = np.zeros(n)
    c[-1] = 1
    return [-1.0, *sorted(np.polynomial.legendre.legroots(np.polynomial.legendre.legder(c)).real), 1.0]


def barycentric_weights(points: list[float]) -> list[float]:
    return [1 / float(np.prod([a - b for b in points if b != a])) for a in points]


def barycentric_value(points: list[float], values: list[float], x: float) -> float:
    """The polynomial through values at points, by the barycentric formula."""
    w = barycentric_weights(points)
    if x in points:
        return values[points.index(x)]
    top = sum(a * v / (x - p) for a, v, p in zip(w, values, points, strict=True))
    return top / sum(a / (x - p) for a, p in zip(w, points, strict=True))


def chebyshev(n: int, x: float) -> list[float]:
    """The Chebyshev polynomials of degrees 0 .. n."""
    out = [1.0, x]
    for _ in range(n - 1):
        out.append(2 * x * out[-1] - out[-2])
    return out[: n + 1]


def elevated(control: list[Column], order: int) -> list[Column]:
    """Control values of an edge raised by one degree."""
    n = order + 1
    return [control[0]] + [control[i - 1] * (i / n) + control[i] * (1 - i / n) for i in range(1, n)] + [control[order]]


def subdivided(control: list[Column]) -> tuple[list[Column], list[Column]]:
    """Control values of both halves of a curve, by repeated midpoints."""
    left, right, row = [], [], list(control)
    while row:
        left.append(row[0])
        right.insert(0, row[-1])
        row = [(a + b) / 2 for a, b in zip(row, row[1:], strict=False)]
    return left, right


def curve_value(control: list[Column], t: float) -> Column:
    n = len(control) - 1
    return sum((c * (comb(n, i) * t**i * (1 - t) ** (n - i)) for i, c in enumerate(control)), F.lit(0.0))


def weighed(values: list[Column], weights) -> Column:
    return sum((v * float(w) for v, w in zip(values, weights, strict=True) if abs(w) > 1e-15), F.lit(0.0))


def nodes_of(p: list[Column], order: int) -> list[dict[str, Column]]:
    """Coordinates of the lattice nodes of a straight simplex with corners `p`."""
    return [{k: weighed([q[k] for q in p], [i / order for i in index]) for k in "xyz"} for index in lattice(len(p) - 1, order)]


class Dual:
    """A value with its derivative: forward differentiation of column expressions."""

    def __init__(self, value: Column, slope: Column | float = 0.0):
        self.value, self.slope = value, slope if isinstance(slope, Column) else F.lit(float(slope))

    @staticmethod
    def _of(x) -> Dual:
        return x if isinstance(x, Dual) else Dual(F.lit(float(x)))

    def __add__(self, o):
        o = self._of(o)
        return Dual(self.value + o.value, self.slope + o.slope)

    __radd__ = __add__

    def __sub__(self, o):
        o = self._of(o)
        return Dual(self.value - o.value, self.slope - o.slope)

    def __mul__(self, o):
        o = self._of(o)
        return Dual(self.value * o.value, self.slope * o.value + self.value * o.slope)

    __rmul__ = __mul__

    def __truediv__(self, o):
        o = self._of(o)
        return Dual(self.value / o.value, (self.slope * o.value - self.value * o.slope) / (o.value * o.value))

    def power(self, n: float) -> Dual:
        return Dual(F.pow(self.value, F.lit(n)), F.lit(n) * F.pow(self.value, F.lit(n - 1)) * self.slope)

    def sin(self) -> Dual:
        return Dual(F.sin(self.value), F.cos(self.value) * self.slope)
