"""Geometry as column expressions, so that it stays in generated code: points are structs x, y, z."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """From point a to point b."""
    return tuple(b[c] - a[c] for c in "xyz")


def cross(u, v):
    return u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]


def dot(u, v) -> Column:
    return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]


def norm(u) -> Column:
    return F.sqrt(dot(u, u))


def tet_volume(p: list[Column]) -> Column:
    return dot(vec(p[0], p[1]), cross(vec(p[0], p[2]), vec(p[0], p[3]))) / 6.0


def triangle_area(p: list[Column]) -> Column:
    return norm(cross(vec(p[0], p[1]), vec(p[0], p[2]))) / 2.0


def edge_sum(p: list[Column]) -> Column:
    """Sum of squared edge lengths."""
    total = F.lit(0.0)
    for i in range(len(p)):
        for j in range(i + 1, len(p)):
            e = vec(p[i], p[j])
            total = total + dot(e, e)
    return total


def triangle_quality(p: list[Column]) -> Column:
    """1 for an equilateral triangle: 48 A^2 over the squared sum of squared edges."""
    return 48 * F.pow(triangle_area(p), 2) / F.pow(edge_sum(p), 2)


def tet_quality(p: list[Column]) -> Column:
    """1 for a regular tet, negative for an inverted one: 15552 V^2 over the cubed sum of squared edges."""
    v = tet_volume(p)
    return F.signum(v) * 15552 * v * v / F.pow(edge_sum(p), 3)


def insphere(p: list[Column]) -> Column:
    faces = sum((triangle_area([p[i] for i in f]) for f in ((0, 1, 2), (0, 1, 3), (0, 2, 3), (1, 2, 3))), F.lit(0.0))
    return 3 * F.abs(tet_volume(p)) / faces


def gradient(p: list[Column], u: list[Column]) -> tuple[Column, Column, Column]:
    """The constant gradient of a linear field on a tet."""
    six = 6 * tet_volume(p)
    a, b, c = (vec(p[0], p[i]) for i in (1, 2, 3))
    d = [u[i] - u[0] for i in (1, 2, 3)]
    bc, ca, ab = cross(b, c), cross(c, a), cross(a, b)
    return tuple((d[0] * bc[k] + d[1] * ca[k] + d[2] * ab[k]) / six for k in range(3))
