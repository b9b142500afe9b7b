"""Small dense algebra: vectors and 3 x 3 matrices as columns; eigenvalues and matrix functions in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.functions.geometry import cross, dot, norm


def project(u, w):
    """u along w."""
    s = dot(u, w) / dot(w, w)
    return tuple(s * c for c in w)


def reject(u, w):
    """u without what lies along w."""
    return tuple(a - b for a, b in zip(u, project(u, w), strict=True))


def cos_angle(u, w) -> Column:
    return dot(u, w) / (norm(u) * norm(w))


def parallel(u, w, tolerance: float = 1e-9) -> Column:
    return F.abs(cos_angle(u, w)) >= 1 - tolerance


def orthogonal(u, w, tolerance: float = 1e-9) -> Column:
    return F.abs(cos_angle(u, w)) <= tolerance


def close(u, w, tolerance: float = 1e-9) -> Column:
    d = tuple(a - b for a, b in zip(u, w, strict=True))
    return norm(d) <= tolerance


def det3(m) -> Column:
    return dot(m[0], cross(m[1], m[2]))


def transposed(m):
    return [tuple(m[j][i] for j in range(3)) for i in range(3)]


def inverse3(m):
    """Rows of the inverse: crossed columns over the determinant."""
    a, b, c = transposed(m)
    d = dot(a, cross(b, c))
    return [tuple(x / d for x in row) for row in (cross(b, c), cross(c, a), cross(a, b))]


def product(a, b):
    return [tuple(sum((a[i][k] * b[k][j] for k in range(3)), F.lit(0.0)) for j in range(3)) for i in range(3)]


def applied(m, u):
    return tuple(dot(row, u) for row in m)


def line_plane(origin, direction, normal, offset):
    """Where the line meets the plane normal . x = offset."""
    t = (offset - dot(normal, origin)) / dot(normal, direction)
    return tuple(o + t * d for o, d in zip(origin, direction, strict=True))


def plane_plane(n1, d1, n2, d2):
    """(point, direction) of the line in which two planes meet."""
    u = cross(n1, n2)
    k = dot(u, u)
    a, b = cross(n2, u), cross(u, n1)
    return tuple((d1 * p + d2 * q) / k for p, q in zip(a, b, strict=True)), u


def _batched(df: DataFrame, columns: list[str], names: list[str], f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """`df` with `names`: f takes an array (rows, 3, 3) of the nine columns and gives (rows, len(names))."""
    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema.fields) + "".join(f", {n} double" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in columns], 1).reshape(-1, 3, 3)
            out = f(m) if len(m) else np.zeros((0, len(names)))
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(out[:, k]) for k in range(len(names))]], [*b.schema.names, *names])

    return df.mapInArrow(run, schema)


def eigenvalues(df: DataFrame, columns: list[str]) -> DataFrame:
    """`df` with e0 <= e1 <= e2, the eigenvalues of the symmetric matrix in nine columns."""
    return _batched(df, columns, ["e0", "e1", "e2"], np.linalg.eigvalsh)


def matrix_function(df: DataFrame, columns: list[str], f: Callable[[np.ndarray], np.ndarray], prefix: str = "f") -> DataFrame:
    """`df` with nine columns of f applied to the symmetric matrix, through its eigenvalues."""

    def run(m: np.ndarray) -> np.ndarray:
        e, v = np.linalg.eigh(m)
        return np.einsum("nik,nk,njk->nij", v, f(e), v).reshape(-1, 9)

    return _batched(df, columns, [f"{prefix}{i}{j}" for i in range(3) for j in range(3)], run)


def qr(df: DataFrame, columns: list[str]) -> DataFrame:
    """`df` with r00, r11, r22 (not negative), the diagonal of the triangular factor."""
    return _batched(df, columns, ["r00", "r11", "r22"], lambda m: np.abs(np.diagonal(np.linalg.qr(m)[1], axis1=1, axis2=2)))
