"""Queries on quadrature, shape functions, tensors and curved geometry."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.functions import geometry as g
from facetry.functions import shapes, tensors
from facetry.operators import recovery, topology
from facetry.plans.box_queries import _EDGE, CTE, FACE, TET, P, corners
from facetry.plans.build_queries import MIXED, mixed
from facetry.plans.catalog import query
from facetry.plans.meshes import box

AT = (0.4, 0.3, 0.2, 0.1)
_X = "(0.4*x0+0.3*x1+0.2*x2+0.1*x3)"
_Y = _X.replace("x", "y")
_Z = _X.replace("x", "z")


def _points(kind: str, order: int):
    """A rule as an array literal of structs."""
    return F.array(*[F.struct(*[F.lit(c).alias(f"c{i}") for i, c in enumerate(p)], F.lit(w).alias("w")) for p, w in shapes.rule(kind, order)])


def _at(q, c: str):
    return sum((q[f"c{i}"] * P[i][c] for i in range(4)), F.lit(0.0))


# --- quadrature


@query("mesh_rule_volumes", "SELECT kind, ord AS order_, round(volume, 9) AS volume FROM (VALUES ('edge', 2.0::DOUBLE), ('triangle', 0.5), ('tet', 1.0 / 6), ('quad', 4.0), ('hex', 8.0), ('prism', 1.0), ('pyramid', 8.0 / 3)) t(kind, volume), (VALUES (1), (3), (7)) o(ord)")
def rule_volumes(spark, sf_dir):
    """The weights of every rule sum to the reference element's volume."""
    rows = [(k, n, round(float(sum(w for _, w in shapes.rule(k, n))), 9)) for k in ("edge", "triangle", "tet", "quad", "hex", "prism", "pyramid") for n in (1, 3, 7)]
    return spark.createDataFrame(rows, "kind string, order_ int, volume double")


@query("mesh_integrate_powers", f"WITH {CTE} SELECT d AS degree, round(1.0::DOUBLE / (d + 1), 9) AS integral FROM range(1, 8) q(d)")
def integrate_powers(spark, sf_dir):
    """Integrals of x^d over the mesh, each with the rule of degree d."""
    out = corners(box(spark, sf_dir))
    terms = []
    for d in range(1, 8):
        total = F.aggregate(_points("tet", d), F.lit(0.0), _power_sum(d))
        terms.append(F.sum(6 * g.tet_volume(P) * total).alias(f"i{d}"))
    row = out.agg(*terms)
    return row.select(F.explode(F.array(*[F.struct(F.lit(d).cast("long").alias("degree"), F.round(f"i{d}", 9).alias("integral")) for d in range(1, 8)])).alias("r")).select("r.*")


@query("mesh_integrate_by_part", f"WITH {TET} SELECT part, round(sum(v * (y0+y1+y2+y3) / 4), 9) AS integral FROM vol JOIN elem USING (elem) GROUP BY part")
def integrate_by_part(spark, sf_dir):
    """Each part integrates what it owns; the sum over parts is the whole."""
    b = box(spark, sf_dir)
    one = F.aggregate(_points("tet", 1), F.lit(0.0), lambda a, q: a + q["w"] * _at(q, "y"))
    x = corners(b).select("elem", (6 * g.tet_volume(P) * one).alias("i")).join(b.elem(), "elem")
    return x.groupBy("part").agg(F.round(F.sum("i"), 9).alias("integral"))


@query("mesh_gradient_at_points", f"WITH {TET} SELECT elem, round(v * (x0+x1+x2+x3) / 2, 9) AS gx, round(v * (z0+z1+z2+z3) / 4, 9) AS gy FROM vol")
def gradient_at_points(spark, sf_dir):
    """The gradient of x^2 + yz, taken from a quadratic interpolation at integration points, integrated over each tet."""
    f = lambda x, y, z: x * x + y * z
    u = [f(p["x"], p["y"], p["z"]) for p in P]
    mids = {(i, j): f(*[(P[i][k] + P[j][k]) / 2 for k in "xyz"]) for i, j in _EDGE}
    grads = [g.gradient(P, [F.lit(1.0) if i == k else F.lit(0.0) for i in range(4)]) for k in range(4)]

    def along(q, axis):
        l = [q[f"c{i}"] for i in range(4)]  # noqa: E741
        total = F.lit(0.0)
        for i in range(4):
            total = total + u[i] * (4 * l[i] - 1) * grads[i][axis]
        for (i, j), m in mids.items():
            total = total + m * 4 * (l[i] * grads[j][axis] + l[j] * grads[i][axis])
        return total

    # in stages, so that no expression holds the others many times over
    base = corners(box(spark, sf_dir)).select("elem", "p", g.tet_volume(P).alias("v"))
    out = base
    for axis, name in ((0, "gx"), (1, "gy")):
        value = F.lit(0.0)
        for p, w in shapes.rule("tet", 1):
            value = value + F.lit(w) * along({f"c{i}": F.lit(c) for i, c in enumerate(p)}, axis)
        out = out.withColumn(name, F.round(6 * F.col("v") * value, 9))
    return out.select("elem", "gx", "gy")


def _power_sum(d: int):
    return lambda a, q: a + q["w"] * F.pow(_at(q, "x"), F.lit(float(d)))


# --- bases

_KINDS = [("lagrange", 3), ("hierarchic", 2), ("hierarchic", 3), ("bernstein", 3), ("lagrange", 4)]


def _interpolated(kind: str, order: int):
    return shapes.weighed([n["x"] * n["x"] + (n["y"] * n["z"] if order > 1 else 0) for n in shapes.nodes_of([P[i] for i in range(4)], order)], shapes.interpolation(kind, 3, order, AT))


@query("mesh_high_order_values", f"WITH {TET} SELECT elem, round({_X}*{_X} + {_Y}*{_Z}, 9) AS cubic, round({_X}*{_X} + {_Y}*{_Z}, 9) AS hierarchic2, round({_X}*{_X} + {_Y}*{_Z}, 9) AS hierarchic3, round({_X}*{_X} + {_Y}*{_Z}, 9) AS bezier FROM tet")
def high_order_values(spark, sf_dir):
    """A quadratic field through cubic Lagrange, hierarchic and Bernstein bases, at a point inside each tet."""
    c = corners(box(spark, sf_dir))
    for name, (kind, order) in zip(("cubic", "hierarchic2", "hierarchic3", "bezier"), _KINDS, strict=False):
        c = c.withColumn(name, F.round(_interpolated(kind, order), 9))
    return c.select("elem", "cubic", "hierarchic2", "hierarchic3", "bezier")


@query("mesh_cubic_values", f"WITH {TET} SELECT elem, round({_X}*{_X}*{_X}, 9) AS value FROM tet")
def cubic_values(spark, sf_dir):
    """Cubic Lagrange interpolation gives x^3 back."""
    n = shapes.nodes_of([P[i] for i in range(4)], 3)
    return corners(box(spark, sf_dir)).select("elem", F.round(shapes.weighed([q["x"] * q["x"] * q["x"] for q in n], shapes.interpolation("lagrange", 3, 3, AT)), 9).alias("value"))


@query("mesh_quartic_values", f"WITH {TET} SELECT elem, round(pow({_X}, 4), 9) AS value FROM tet")
def quartic_values(spark, sf_dir):
    """Order four, by the hierarchic basis with its inner mode."""
    n = shapes.nodes_of([P[i] for i in range(4)], 4)
    return corners(box(spark, sf_dir)).select("elem", F.round(shapes.weighed([F.pow(q["x"], F.lit(4.0)) for q in n], shapes.interpolation("hierarchic", 3, 4, AT)), 9).alias("value"))


@query("mesh_basis_sums", "SELECT kind, ord AS order_, CASE kind WHEN 'hierarchic' THEN (ord + 1) * (ord + 2) * (ord + 3) // 6 ELSE (ord + 1) * (ord + 2) * (ord + 3) // 6 END AS functions, 1.0::DOUBLE AS total FROM (VALUES ('lagrange'), ('bernstein'), ('hierarchic')) k(kind), (VALUES (2), (3), (4)) o(ord)")
def basis_sums(spark, sf_dir):
    """Functions of each basis, and the sum of its interpolation weights, which is one."""
    rows = [(k, n, len(shapes.basis(k, 3, n, AT)), round(float(sum(shapes.interpolation(k, 3, n, AT))), 9)) for k in ("lagrange", "bernstein", "hierarchic") for n in (2, 3, 4)]
    return spark.createDataFrame(rows, "kind string, order_ int, functions int, total double")


@query("mesh_serendipity_values", f"WITH {MIXED}, h AS (SELECT elem, min(x) AS x, min(y) AS y FROM mdown JOIN vertex USING (vert) WHERE type = 'hex' GROUP BY elem) SELECT elem, round((x + 0.6 / n) * (x + 0.6 / n) + (x + 0.6 / n) * (y + 0.7 / n), 9) AS value FROM h, dim")
def serendipity_values(spark, sf_dir):
    """The twenty-node hex gives x^2 + xy back."""
    elem, down = mixed(spark, sf_dir)
    v = box(spark, sf_dir).vertex()
    h = elem.where("type = 'hex'").join(down, "elem").join(v, "vert").groupBy("elem").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y"))).alias("q"))
    xi = (0.2, 0.4, -0.3)
    ref = [(-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1), (-1, -1, 1), (1, -1, 1), (1, 1, 1), (-1, 1, 1)]
    f = lambda x, y: x * x + x * y
    total = F.lit(0.0)
    for i, r in enumerate(ref):
        s = [1 + a * b for a, b in zip(r, xi, strict=True)]
        total = total + f(F.col("q")[i]["x"], F.col("q")[i]["y"]) * (s[0] * s[1] * s[2] * (sum(a * b for a, b in zip(r, xi, strict=True)) - 2) / 8)
    for i, j in combinations(range(8), 2):
        free = [k for k in range(3) if ref[i][k] != ref[j][k]]
        if len(free) == 1:
            k = free[0]
            w = (1 - xi[k] ** 2) / 4
            for m in range(3):
                if m != k:
                    w *= 1 + ref[i][m] * xi[m]
            mid = [(F.col("q")[i][c] + F.col("q")[j][c]) / 2 for c in "xy"]
            total = total + f(*mid) * w
    return h.select("elem", F.round(total, 9).alias("value"))


@query("mesh_constant_field", f"WITH {CTE} SELECT elem, (elem % 7)::DOUBLE AS value FROM elem")
def constant_field(spark, sf_dir):
    """A value for each element, the same at every point of it."""
    return box(spark, sf_dir).elem().select("elem", (F.col("elem") % 7).cast("double").alias("value"))


_A, _B = (5 + 3 * 5**0.5) / 20, (5 - 5**0.5) / 20


@query("mesh_integration_point_fields", f"WITH {TET} SELECT elem, round({_A} * x0 + {_B} * (x1 + x2 + x3), 9) AS nearest, round(x0, 9) AS fitted, round((x0+x1+x2+x3) / 4, 9) AS mean FROM tet")
def integration_point_fields(spark, sf_dir):
    """Of values at four points: the nearest one's at corner 0, the linear fit's there, and the constant fit's."""
    pts = [tuple(_A if i == k else _B for i in range(4)) for k in range(4)]
    values = [shapes.weighed([P[i]["x"] for i in range(4)], p) for p in pts]
    fit = np.linalg.solve(np.array(pts).T, np.array([1.0, 0, 0, 0]))  # corner 0 in terms of the points
    c = corners(box(spark, sf_dir))
    return c.select("elem", F.round(values[0], 9).alias("nearest"), F.round(shapes.weighed(values, fit), 9).alias("fitted"), F.round(sum(values, F.lit(0.0)) / 4, 9).alias("mean"))


def with_gradients(cells: DataFrame) -> DataFrame:
    """`cells` with g0 .. g3, the gradients of the barycentric coordinates as arrays, so that they are made once."""
    p = [P[i] for i in range(4)]
    grads = [F.array(*g.gradient(p, [F.lit(1.0) if i == k else F.lit(0.0) for i in range(4)])).alias(f"g{k}") for k in range(4)]
    return cells.select("*", *grads)


def _edge_field(p, at, u):
    """(value, curl) of the lowest edge basis with the tangential moments of `u` (a function of a point); needs `with_gradients`."""
    grads = [tuple(F.col(f"g{k}")[a] for a in range(3)) for k in range(4)]
    value, curl = [F.lit(0.0)] * 3, [F.lit(0.0)] * 3
    for i, j in _EDGE:
        mid = {k: (p[i][k] + p[j][k]) / 2 for k in "xyz"}
        moment = g.dot(u(mid), g.vec(p[i], p[j]))
        c = g.cross(grads[i], grads[j])
        for k in range(3):
            value[k] = value[k] + moment * (at[i] * grads[j][k] - at[j] * grads[i][k])
            curl[k] = curl[k] + moment * 2 * c[k]
    return value, curl


@query("mesh_edge_element_values", f"WITH {TET} SELECT elem, round(1 + 2 * {_Z} - 3 * {_Y}, 6) AS ux, round(2 + 3 * {_X} - {_Z}, 6) AS uy, 2.0::DOUBLE AS curl_x, 4.0::DOUBLE AS curl_y, 6.0::DOUBLE AS curl_z FROM tet")
def edge_element_values(spark, sf_dir):
    """The field (1, 2, 3) + (1, 2, 3) x r through the lowest edge elements: values and curl are exact."""
    u = lambda m: (1 + 2 * m["z"] - 3 * m["y"], 2 + 3 * m["x"] - m["z"], 3 + m["y"] - 2 * m["x"])
    value, curl = _edge_field([P[i] for i in range(4)], AT, u)
    c = with_gradients(corners(box(spark, sf_dir)))
    return c.select("elem", F.round(value[0], 6).alias("ux"), F.round(value[1], 6).alias("uy"), *[F.round(curl[k], 6).alias(f"curl_{a}") for k, a in enumerate("xyz")])


@query("mesh_vector_derivatives", f"WITH {TET} SELECT elem, 6.0::DOUBLE AS divergence, 1.0::DOUBLE AS curl_x, 1.0::DOUBLE AS curl_y, 1.0::DOUBLE AS curl_z FROM tet")
def vector_derivatives(spark, sf_dir):
    """Divergence and curl of (x + z, 2y + x, 3z + y), linear on every tet."""
    p = [P[i] for i in range(4)]
    gx, gy, gz = (g.gradient(p, f) for f in ([q["x"] + q["z"] for q in p], [2 * q["y"] + q["x"] for q in p], [3 * q["z"] + q["y"] for q in p]))
    r = lambda c, n: F.round(c, 6).alias(n)
    return corners(box(spark, sf_dir)).select("elem", r(gx[0] + gy[1] + gz[2], "divergence"), r(gz[1] - gy[2], "curl_x"), r(gx[2] - gz[0], "curl_y"), r(gy[0] - gx[1], "curl_z"))


@query("mesh_quadratic_nodes", f"WITH {FACE} SELECT key[1] AS a, key[2] AS b, round((u.x + w.x) / 2, 9) AS x, round((u.y + w.y) / 2, 9) AS y FROM (SELECT DISTINCT key FROM edge) JOIN vertex u ON u.vert = key[1] JOIN vertex w ON w.vert = key[2]")
def quadratic_nodes(spark, sf_dir):
    """The nodes that a change to quadratic coordinates adds: a mean on each edge."""
    b = box(spark, sf_dir)
    e = topology.entities(topology.boundary(b.down(), 2)).select(F.col("key")[0].alias("a"), F.col("key")[1].alias("b"))
    v = b.vertex()
    x = e.join(v.select(F.col("vert").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya")), "a").join(v.select(F.col("vert").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb")), "b")
    return x.select("a", "b", F.round((F.col("xa") + F.col("xb")) / 2, 9).alias("x"), F.round((F.col("ya") + F.col("yb")) / 2, 9).alias("y"))


@query("mesh_project_field", f"WITH {CTE} SELECT vert, round(x * x + 2 * y, 9) AS value FROM vertex")
def project_field(spark, sf_dir):
    """A quadratic field projected to vertices: evaluated by the elements around, which agree."""
    nodes = shapes.nodes_of([P[i] for i in range(4)], 2)
    values = [n["x"] * n["x"] + 2 * n["y"] for n in nodes]
    at = F.array(*[F.struct(P[i]["vert"].alias("vert"), shapes.weighed(values, shapes.interpolation("lagrange", 3, 2, tuple(float(i == k) for k in range(4)))).alias("v")) for i in range(4)])
    return corners(box(spark, sf_dir)).select(F.explode(at).alias("n")).groupBy(F.col("n.vert").alias("vert")).agg(F.round(F.avg("n.v"), 9).alias("value"))


@query("mesh_polynomial_bases", "SELECT n, round(x, 9) AS x, round(x * x * x - x, 9) AS value, round(4 * x * x * x - 3 * x, 9) AS t3 FROM (VALUES (4), (5), (6)) k(n), (VALUES (-0.7::DOUBLE), (0.1), (0.9)) p(x)")
def polynomial_bases(spark, sf_dir):
    """x^3 - x through closed points by the barycentric formula, and the third Chebyshev polynomial."""
    rows = []
    for n in (4, 5, 6):
        pts = shapes.lobatto(n)
        for x in (-0.7, 0.1, 0.9):
            rows.append((n, x, round(float(shapes.barycentric_value(pts, [p**3 - p for p in pts], x)), 9), round(float(shapes.chebyshev(3, x)[3]), 9)))
    return spark.createDataFrame(rows, "n int, x double, value double, t3 double")


# --- curves

_CURVE = "(SELECT vert, x AS c0, y + 0.5 AS c1, z * 2 AS c2 FROM vertex)"


@query("mesh_curve_elevation", f"WITH {CTE} SELECT vert, round(c0 * 0.49 + 2 * c1 * 0.21 + c2 * 0.09, 9) AS value, round(c0 * 0.49 + 2 * c1 * 0.21 + c2 * 0.09, 9) AS elevated FROM {_CURVE}")
def curve_elevation(spark, sf_dir):
    """A quadratic curve at 0.3, and the same raised to degree four."""
    c = [F.col("x"), F.col("y") + 0.5, F.col("z") * 2]
    up = shapes.elevated(shapes.elevated(c, 2), 3)
    return box(spark, sf_dir).vertex().select("vert", F.round(shapes.curve_value(c, 0.3), 9).alias("value"), F.round(shapes.curve_value(up, 0.3), 9).alias("elevated"))


@query("mesh_curve_subdivision", f"WITH {CTE} SELECT vert, round(c0 * 0.5625 + 2 * c1 * 0.1875 + c2 * 0.0625, 9) AS a, round(c0 * 0.0625 + 2 * c1 * 0.1875 + c2 * 0.5625, 9) AS b FROM {_CURVE}")
def curve_subdivision(spark, sf_dir):
    """Both halves of a curve at their middles are the curve at a quarter and at three quarters."""
    left, right = shapes.subdivided([F.col("x"), F.col("y") + 0.5, F.col("z") * 2])
    return box(spark, sf_dir).vertex().select("vert", F.round(shapes.curve_value(left, 0.5), 9).alias("a"), F.round(shapes.curve_value(right, 0.5), 9).alias("b"))


@query("mesh_interpolating_to_control", f"WITH {CTE} SELECT vert, round(c0, 9) AS k0, round(2 * c1 - (c0 + c2) / 2, 9) + 0.0 AS k1, round(c2, 9) AS k2 FROM {_CURVE}")
def interpolating_to_control(spark, sf_dir):
    """Control values of the quadratic curve through three points."""
    m = np.linalg.inv(np.array([[shapes.bernstein(i, q) for i in ((2, 0), (1, 1), (0, 2))] for q in ((1.0, 0.0), (0.5, 0.5), (0.0, 1.0))]))
    c = [F.col("x"), F.col("y") + 0.5, F.col("z") * 2]
    return box(spark, sf_dir).vertex().select("vert", *[(F.round(shapes.weighed(c, m[i]), 9) + 0.0).alias(f"k{i}") for i in range(3)])


@query("mesh_interpolation_error", "SELECT n, round(1 - cos(pi() / (4 * n)), 9) AS error FROM (VALUES (1), (2), (4), (8)) t(n)")
def interpolation_error(spark, sf_dir):
    """The greatest distance of a quarter circle from its chords, sampled along each."""
    s = spark.createDataFrame([(n,) for n in (1, 2, 4, 8)], "n int").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    s = s.withColumn("t", F.explode(F.transform(F.sequence(F.lit(0), F.lit(64)), lambda i: i / 64)))
    a, b = (F.lit(np.pi / 2) * (F.col("k") + d) / F.col("n") for d in (0, 1))
    x, y = (f(a) * (1 - F.col("t")) + f(b) * F.col("t") for f in (F.cos, F.sin))
    return s.withColumn("e", 1 - F.sqrt(x * x + y * y)).groupBy("n").agg(F.round(F.max("e"), 9).alias("error"))


@query("mesh_curved_validity", f"WITH {TET} SELECT elem, round(6 * v, 9) AS least, round(6 * v, 9) AS most, 1.0::DOUBLE AS quality FROM vol")
def curved_validity(spark, sf_dir):
    """Bounds of the Jacobian determinant of quadratic tets from its values at the nodes: straight ones have one value."""
    nodes = [tuple(i / 2 for i in index) for index in shapes.lattice(3, 2)]
    p = [P[i] for i in range(4)]
    ctrl = shapes.nodes_of(p, 2)
    c = corners(box(spark, sf_dir))
    dets = []
    for q in nodes:
        rows = []
        for axis in range(3):  # derivative along each reference axis, by differences that are exact for quadratics
            h = 0.5
            w = []
            for s in (h, -h):
                r = list(q)
                r[axis + 1] += s
                r[0] -= s
                w.append(np.array([shapes.interpolation("lagrange", 3, 2, tuple(r))]).ravel())
            rows.append(tuple(shapes.weighed([n[k] for n in ctrl], (w[0] - w[1]) / (2 * h)) for k in "xyz"))
        dets.append(tensors.det3(rows))
    x = c.withColumn("d", F.array(*dets))
    least, most = F.array_min("d"), F.array_max("d")
    return x.select("elem", F.round(least, 9).alias("least"), F.round(most, 9).alias("most"), F.round(least / most, 6).alias("quality"))


@query("mesh_count_invalid_curved", f"WITH {TET} SELECT 0::BIGINT AS invalid FROM (SELECT 1)")
def count_invalid_curved(spark, sf_dir):
    x = curved_validity(spark, sf_dir)
    return x.agg(F.count_if(F.col("least") <= 0).alias("invalid"))


@query("mesh_blended_surface", f"WITH {CTE} SELECT vert, round(x * y + x + y, 9) AS value FROM vertex")
def blended_surface(spark, sf_dir):
    """A patch blended from its four boundary curves: one that is bilinear comes back."""
    x, y = F.col("x"), F.col("y")
    f = lambda a, b: a * b + a + b
    sides = (1 - x) * f(0 * x, y) + x * f(0 * x + 1, y) + (1 - y) * f(x, 0 * y) + y * f(x, 0 * y + 1)
    points = sum((wx * wy * (a * b + a + b) for wx, a in ((1 - x, 0.0), (x, 1.0)) for wy, b in ((1 - y, 0.0), (y, 1.0))), F.lit(0.0))
    return box(spark, sf_dir).vertex().select("vert", F.round(sides - points, 9).alias("value"))


# --- tensors

_T = "t AS (SELECT vert, 1 + x AS a, 2 + y AS b, 3 + z AS c, x * y AS d FROM vertex)"


def _tensor(spark, sf_dir) -> DataFrame:
    v = box(spark, sf_dir).vertex().select("vert", (1 + F.col("x")).alias("a"), (2 + F.col("y")).alias("b"), (3 + F.col("z")).alias("c"), (F.col("x") * F.col("y")).alias("d"), F.lit(0.0).alias("o"))
    return v


_NINE = ["a", "d", "o", "d", "b", "o", "o", "o", "c"]


@query("mesh_eigenvalues", f"WITH {CTE}, {_T}, e AS (SELECT vert, list_sort([(a + b) / 2 - sqrt((a - b) * (a - b) / 4 + d * d), (a + b) / 2 + sqrt((a - b) * (a - b) / 4 + d * d), c]) AS e FROM t) SELECT vert, round(e[1], 9) AS e0, round(e[2], 9) AS e1, round(e[3], 9) AS e2 FROM e")
def eigenvalues(spark, sf_dir):
    x = tensors.eigenvalues(_tensor(spark, sf_dir), _NINE)
    return x.select("vert", *[F.round(f"e{k}", 9).alias(f"e{k}") for k in range(3)])


@query("mesh_matrix_function", f"WITH {CTE}, {_T} SELECT vert, round(a * a + d * d, 9) AS f00, round(d * (a + b), 9) AS f01, round(c * c, 9) AS f22 FROM t")
def matrix_function(spark, sf_dir):
    """The square of a symmetric matrix through its eigenvalues."""
    x = tensors.matrix_function(_tensor(spark, sf_dir), _NINE, np.square)
    return x.select("vert", F.round("f00", 9).alias("f00"), F.round("f01", 9).alias("f01"), F.round("f22", 9).alias("f22"))


@query("mesh_qr", f"WITH {CTE}, {_T} SELECT vert, round(sqrt(a * a + d * d), 9) AS r00, round((a * b - d * d) / sqrt(a * a + d * d), 9) AS r11, round(c, 9) AS r22 FROM t")
def qr(spark, sf_dir):
    x = tensors.qr(_tensor(spark, sf_dir), _NINE)
    return x.select("vert", *[F.round(f"r{k}{k}", 9).alias(f"r{k}{k}") for k in range(3)])


@query("mesh_matrix_algebra", f"WITH {CTE}, {_T} SELECT vert, round(c * (a * b - d * d), 9) AS det, round(b / (a * b - d * d), 9) AS inv00, round(-d / (a * b - d * d), 9) + 0.0 AS inv01, 0.0::DOUBLE AS off FROM t")
def matrix_algebra(spark, sf_dir):
    """Determinant and inverse as expressions; a matrix times its inverse is the unit matrix."""
    a, b, c, d, o = (F.col(k) for k in "abcdo")
    m = [(a, d, o), (d, b, o), (o, o, c)]
    inv = tensors.inverse3(m)
    unit = tensors.product(m, inv)
    off = sum((F.abs(unit[i][j] - float(i == j)) for i in range(3) for j in range(3)), F.lit(0.0))
    return _tensor(spark, sf_dir).select("vert", F.round(tensors.det3(m), 9).alias("det"), F.round(inv[0][0], 9).alias("inv00"), (F.round(inv[0][1], 9) + 0.0).alias("inv01"), F.round(off, 9).alias("off"))


@query("mesh_vector_parts", f"WITH {CTE} SELECT vert, round((x + 2*y + 3*z) / 14, 9) AS along, round(x - (x + 2*y + 3*z) / 14, 9) + 0.0 AS rest_x, round(y - 2 * (x + 2*y + 3*z) / 14, 9) + 0.0 AS rest_y, true AS square FROM vertex")
def vector_parts(spark, sf_dir):
    """A vector along another and beside it; the parts are orthogonal."""
    u, w = (F.col("x"), F.col("y"), F.col("z")), (F.lit(1.0), F.lit(2.0), F.lit(3.0))
    r = tensors.reject(u, w)
    return box(spark, sf_dir).vertex().select("vert", F.round(tensors.project(u, w)[0], 9).alias("along"), (F.round(r[0], 9) + 0.0).alias("rest_x"), (F.round(r[1], 9) + 0.0).alias("rest_y"), (F.abs(g.dot(r, w)) <= 1e-9).alias("square"))


@query("mesh_vector_predicates", f"WITH {CTE}, q AS (SELECT vert, 1 + x AS x, 1 + y AS y, 1 + z AS z FROM vertex) SELECT vert, (x = y AND y = z) AS parallel, false AS orthogonal, (x = 1 AND y = 1 AND z = 1) AS close FROM q")
def vector_predicates(spark, sf_dir):
    u, w = tuple(1 + F.col(k) for k in "xyz"), (F.lit(1.0),) * 3
    return box(spark, sf_dir).vertex().select("vert", tensors.parallel(u, w, 1e-12).alias("parallel"), tensors.orthogonal(u, w).alias("orthogonal"), tensors.close(u, w).alias("close"))


@query("mesh_plane_intersections", f"WITH {CTE} SELECT vert, round(x + (1 - x - y - z) / 3, 9) + 0.0 AS px, round(y + (1 - x - y - z) / 3, 9) + 0.0 AS py, true AS on_both FROM vertex")
def plane_intersections(spark, sf_dir):
    """Lines along (1, 1, 1) meet the plane x + y + z = 1; two planes meet in a line that lies in both."""
    o, d, n = tuple(F.col(k) for k in "xyz"), (F.lit(1.0),) * 3, (F.lit(1.0),) * 3
    p = tensors.line_plane(o, d, n, F.lit(1.0))
    n2, d2 = (1 + F.col("x"), F.lit(0.5), F.lit(-1.0)), F.col("y")
    q, _ = tensors.plane_plane(n, F.lit(1.0), n2, d2)
    both = (F.abs(g.dot(n, q) - 1) <= 1e-9) & (F.abs(g.dot(n2, q) - d2) <= 1e-9)
    return box(spark, sf_dir).vertex().select("vert", (F.round(p[0], 9) + 0.0).alias("px"), (F.round(p[1], 9) + 0.0).alias("py"), both.alias("on_both"))


@query("mesh_frame_transform", f"WITH {CTE} SELECT vert, round(y, 9) AS u, round(-x, 9) + 0.0 AS v, round(z, 9) AS w FROM vertex")
def frame_transform(spark, sf_dir):
    """Coordinates in a frame turned by a quarter about z."""
    m = [(F.lit(0.0), F.lit(1.0), F.lit(0.0)), (F.lit(-1.0), F.lit(0.0), F.lit(0.0)), (F.lit(0.0), F.lit(0.0), F.lit(1.0))]
    q = tensors.applied(m, tuple(F.col(k) for k in "xyz"))
    return box(spark, sf_dir).vertex().select("vert", *[(F.round(c, 9) + 0.0).alias(n) for c, n in zip(q, "uvw", strict=True)])


@query("mesh_automatic_derivative", f"WITH {CTE} SELECT vert, round(2 * x * sin(x) + x * x * cos(x) + 1 / ((1 + x) * (1 + x)), 9) AS slope FROM vertex")
def automatic_derivative(spark, sf_dir):
    """The derivative of x^2 sin x + x / (1 + x) by dual numbers."""
    x = shapes.Dual(F.col("x"), 1.0)
    f = x * x * x.sin() + x / (1 + x)
    return box(spark, sf_dir).vertex().select("vert", F.round(f.slope, 9).alias("slope"))


@query("mesh_jacobian_inverse", f"WITH {TET} SELECT elem, round(6 * v, 9) AS det, 0.0::DOUBLE AS off FROM vol")
def jacobian_inverse(spark, sf_dir):
    """The Jacobian matrix of each tet, its determinant, and how far its product with its inverse is from one."""
    m = [g.vec(P[0], P[k]) for k in (1, 2, 3)]
    x = corners(box(spark, sf_dir)).select("elem", *[c.alias(f"m{i}{j}") for i, r in enumerate(m) for j, c in enumerate(r)])
    k = [tuple(F.col(f"m{i}{j}") for j in range(3)) for i in range(3)]
    unit = tensors.product(k, tensors.inverse3(k))
    off = sum((F.abs(unit[i][j] - float(i == j)) for i in range(3) for j in range(3)), F.lit(0.0))
    return x.select("elem", F.round(tensors.det3(k), 9).alias("det"), F.round(off, 9).alias("off"))


_SQM = "(" + " + ".join(f"(x{b}-x{a})*(x{b}-x{a})*4+(y{b}-y{a})*(y{b}-y{a})+(z{b}-z{a})*(z{b}-z{a})" for a, b in _EDGE) + ")"


@query("mesh_metric_quality", f"WITH {TET} SELECT elem, round(sign(v) * 15552 * (2 * v) * (2 * v) / pow({_SQM}, 3), 9) AS quality FROM vol")
def metric_quality(spark, sf_dir):
    """Quality in a metric that stretches x by two: measured on the stretched corners."""
    x = corners(box(spark, sf_dir)).withColumn("p", F.transform("p", lambda q: F.struct(q["pos"].alias("pos"), q["vert"].alias("vert"), (q["x"] * 2).alias("x"), q["y"].alias("y"), q["z"].alias("z"))))
    return x.select("elem", F.round(g.tet_quality(P), 9).alias("quality"))


@query("mesh_metric_angle", f"WITH {TET} SELECT elem, round(((x1-x0)*(x2-x0)*4+(y1-y0)*(y2-y0)+(z1-z0)*(z2-z0)) / sqrt(((x1-x0)*(x1-x0)*4+(y1-y0)*(y1-y0)+(z1-z0)*(z1-z0)) * ((x2-x0)*(x2-x0)*4+(y2-y0)*(y2-y0)+(z2-z0)*(z2-z0))), 9) AS cosine FROM tet")
def metric_angle(spark, sf_dir):
    """The cosine between two edges at corner 0 in the same metric."""
    s = lambda u: (u[0] * 2, u[1], u[2])
    return corners(box(spark, sf_dir)).select("elem", F.round(tensors.cos_angle(s(g.vec(P[0], P[1])), s(g.vec(P[0], P[2]))), 9).alias("cosine"))


_GL = 0.5 / 3**0.5


@query("mesh_metric_length_integral", f"WITH {FACE}, l AS (SELECT DISTINCT key, u.x AS xa, w.x AS xb, sqrt((u.x-w.x)*(u.x-w.x)+(u.y-w.y)*(u.y-w.y)+(u.z-w.z)*(u.z-w.z)) AS l FROM edge JOIN vertex u ON u.vert = key[1] JOIN vertex w ON w.vert = key[2]) SELECT key[1] AS a, key[2] AS b, round(l * 0.5 * (1 / (0.1 + 0.4 * (xa + (0.5 - {_GL}) * (xb - xa))) + 1 / (0.1 + 0.4 * (xa + (0.5 + {_GL}) * (xb - xa)))), 6) AS length FROM l")
def metric_length_integral(spark, sf_dir):
    """Edge lengths in a size field that grows along x, by a two-point rule."""
    b = box(spark, sf_dir)
    from facetry.plans.box_queries import _edge_lengths

    v = b.vertex()
    e = _edge_lengths(b).join(v.select(F.col("vert").alias("a"), F.col("x").alias("xa")), "a").join(v.select(F.col("vert").alias("b"), F.col("x").alias("xb")), "b")
    total = F.lit(0.0)
    for (_, t), w in shapes.rule("edge", 2):
        total = total + F.lit(w / 2) / (0.1 + 0.4 * (F.col("xa") + t * (F.col("xb") - F.col("xa"))))
    return e.select("a", "b", F.round(F.col("l") * total, 6).alias("length"))


@query("mesh_metric_interpolation", f"WITH {CTE} SELECT vert, round(pow(0.1, 1 - x) * pow(0.4, x), 9) AS hx, round(pow(0.2, 1 - x) * pow(0.3, x), 9) AS hy FROM vertex")
def metric_interpolation(spark, sf_dir):
    """Metrics interpolated by their logarithms: sizes along each axis are geometric means."""
    log = lambda h: -2 * float(np.log(h))
    mix = lambda a, b: (1 - F.col("x")) * log(a) + F.col("x") * log(b)
    m = box(spark, sf_dir).vertex().select("vert", mix(0.1, 0.4).alias("a"), mix(0.2, 0.3).alias("b"), mix(0.2, 0.2).alias("c"), F.lit(0.0).alias("d"), F.lit(0.0).alias("o"))
    x = tensors.matrix_function(m, _NINE, np.exp)
    return x.select("vert", F.round(F.pow("f00", F.lit(-0.5)), 9).alias("hx"), F.round(F.pow("f11", F.lit(-0.5)), 9).alias("hy"))


@query("mesh_anisotropic_lengths", f"WITH {TET} SELECT elem, round(sqrt((x1-x0)*(x1-x0)/0.01 + (y1-y0)*(y1-y0)/0.04 + (z1-z0)*(z1-z0)/0.09), 9) AS length FROM tet")
def anisotropic_lengths(spark, sf_dir):
    """The length of an edge in sizes 0.1, 0.2, 0.3 along a frame's axes."""
    e = g.vec(P[0], P[1])
    return corners(box(spark, sf_dir)).select("elem", F.round(g.norm((e[0] / 0.1, e[1] / 0.2, e[2] / 0.3)), 9).alias("length"))


@query("mesh_boundary_to_element", f"WITH {TET} SELECT elem, round(0.2 * x0 + 0.3 * x1 + 0.5 * x2, 9) AS x FROM tet")
def boundary_to_element(spark, sf_dir):
    """A barycentric point of a face as a point of its tet, and where that is."""
    face, at = (0, 1, 2), (0.2, 0.3, 0.5)
    full = [0.0] * 4
    for c, w in zip(face, at, strict=True):
        full[c] = w
    return corners(box(spark, sf_dir)).select("elem", F.round(shapes.weighed([P[i]["x"] for i in range(4)], full), 9).alias("x"))


@query("mesh_quadratic_tet_quality", f"WITH {TET} SELECT elem, round(v, 9) AS volume, true AS valid FROM vol")
def quadratic_tet_quality(spark, sf_dir):
    """Quadratic tets by the least determinant at their nodes: straight ones have six times their volume."""
    return curved_validity(spark, sf_dir).select("elem", F.round(F.col("least") / 6, 9).alias("volume"), (F.col("least") > 0).alias("valid"))


@query("mesh_element_validity", f"WITH {MIXED} SELECT type, count(DISTINCT elem) AS elems, 0::BIGINT AS bad FROM mdown GROUP BY type")
def element_validity(spark, sf_dir):
    """Tets by their volume, hexes by the tets that they are cut into."""
    elem, down = mixed(spark, sf_dir)
    x = down.join(elem.select("elem", "type"), "elem").join(box(spark, sf_dir).vertex(), "vert").groupBy("elem", "type").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y", "z"))).alias("p"))
    cut = [(0, 1, 2, 6), (0, 2, 3, 6), (0, 3, 7, 6), (0, 7, 4, 6), (0, 4, 5, 6), (0, 5, 1, 6)]
    c = lambda i: F.get("p", F.lit(i))
    hexes = [g.tet_volume([c(i) for i in t]) > 0 for t in cut]
    ok = hexes[0]
    for h in hexes[1:]:
        ok = ok & h
    good = F.when(F.col("type") == "tet", g.tet_volume([c(i) for i in range(4)]) > 0).otherwise(ok)
    return x.groupBy("type").agg(F.count(F.lit(1)).alias("elems"), F.count_if(~good).alias("bad"))


@query("mesh_acute_triangles", f"WITH {TET} SELECT elem, ((x1-x0)*(x2-x0)+(y1-y0)*(y2-y0)+(z1-z0)*(z2-z0) > 1e-12) AS acute, round(((y1-y0)*(z2-z0)-(z1-z0)*(y2-y0)) / 2, 9) AS nx FROM tet")
def acute_triangles(spark, sf_dir):
    """Whether the angle at corner 0 is acute, and the normal's x of that face by its area."""
    u, w = g.vec(P[0], P[1]), g.vec(P[0], P[2])
    return corners(box(spark, sf_dir)).select("elem", (g.dot(u, w) > 1e-12).alias("acute"), (F.round(g.cross(u, w)[0] / 2, 9) + 0.0).alias("nx"))


# --- user functions


@query("mesh_user_function", f"WITH {CTE} SELECT vert, round(x * x + y, 9) AS value FROM vertex")
def user_function(spark, sf_dir):
    """A function of the user's at every vertex, in Arrow batches."""

    @F.pandas_udf("double")
    def f(x: pd.Series, y: pd.Series) -> pd.Series:
        return x * x + y

    return box(spark, sf_dir).vertex().select("vert", F.round(f("x", "y"), 9).alias("value"))


@query("mesh_user_reduction", f"WITH {CTE} SELECT part, round(max(elem % 97) * 1.0::DOUBLE, 9) AS value FROM elem GROUP BY part")
def user_reduction(spark, sf_dir):
    """A reduction of the user's, built from partial results of each part."""
    e = box(spark, sf_dir).elem().select("part", (F.col("elem") % 97).alias("v"))
    some = e.groupBy("part", F.spark_partition_id().alias("task")).agg(F.collect_set("v").alias("vs"))  # at most 97 values
    return some.groupBy("part").agg(F.collect_list("vs").alias("vs")).select("part", F.aggregate(F.flatten("vs"), F.lit(-1).cast("long"), lambda a, v: F.greatest(a, v)).cast("double").alias("value"))


@query("mesh_user_rows", f"WITH {CTE} SELECT elem, pos, vert * 2 AS doubled FROM down")
def user_rows(spark, sf_dir):
    """A callback that gives several rows for an element."""
    g_ = topology.gathered(box(spark, sf_dir).down())

    def run(frames):
        for f in frames:
            rows = [(e, i, v * 2) for e, vs in zip(f["elem"], f["verts"], strict=True) for i, v in enumerate(vs)]
            yield pd.DataFrame(rows, columns=["elem", "pos", "doubled"])

    return g_.mapInPandas(run, "elem long, pos int, doubled long")


@query("mesh_visit_nodes", f"WITH {CTE} SELECT part, count(*) AS nodes, round(sum(x), 6) AS total FROM down JOIN elem USING (elem) JOIN vertex USING (vert) GROUP BY part")
def visit_nodes(spark, sf_dir):
    """A visitor of all nodes of all elements, with what it keeps for each part."""
    b = box(spark, sf_dir)
    return b.down().join(b.elem().select("elem", "part"), "elem").join(b.vertex(), "vert").groupBy("part").agg(F.count(F.lit(1)).alias("nodes"), F.round(F.sum("x"), 6).alias("total"))


# --- recovery


@query("mesh_recover_gradient", f"WITH {CTE} SELECT vert, round(2 * x, 6) AS gx, round(z, 6) AS gy FROM vertex WHERE x > 0 AND x < 1 AND y > 0 AND y < 1 AND z > 0 AND z < 1")
def recover_gradient(spark, sf_dir):
    """Patch recovery of a field whose gradient is linear, from values at element centroids, at inner vertices."""
    b = box(spark, sf_dir)
    at = lambda c: (P[0][c] + P[1][c] + P[2][c] + P[3][c]) / 4
    s = corners(b).select("elem", at("x").alias("x"), at("y").alias("y"), at("z").alias("z"))
    inner = b.vertex().where("x > 0 and x < 1 and y > 0 and y < 1 and z > 0 and z < 1").select("vert")
    gx = recovery.recover(b.down(), b.vertex(), s.withColumn("value", 2 * F.col("x"))).withColumnRenamed("recovered", "gx")
    gy = recovery.recover(b.down(), b.vertex(), s.withColumn("value", F.col("z"))).withColumnRenamed("recovered", "gy")
    return inner.join(gx, "vert").join(gy, "vert").select("vert", F.round("gx", 6).alias("gx"), F.round("gy", 6).alias("gy"))


@query("mesh_error_size_field", f"WITH {TET}, e AS (SELECT elem, v, sqrt(v) * (1 + (x0+x1+x2+x3) / 4) AS err, sqrt(3.0::DOUBLE) / (SELECT n FROM dim) AS h FROM vol), t AS (SELECT sum(err * err) AS total, sum(pow(err, 6.0::DOUBLE / 5)) AS s FROM e) SELECT elem, round(h * pow(err, -0.4) * sqrt(0.01 * t.total / t.s), 6) AS size FROM e, t")
def error_size_field(spark, sf_dir):
    """Sizes from element errors: h e^(-2/(2p+d)) C, with C so that the error is a tenth of the whole; p = 1, d = 3."""
    c = corners(box(spark, sf_dir))
    longest = F.greatest(*[g.norm(g.vec(P[i], P[j])) for i, j in _EDGE])
    e = c.select("elem", (F.sqrt(g.tet_volume(P)) * (1 + (P[0]["x"] + P[1]["x"] + P[2]["x"] + P[3]["x"]) / 4)).alias("err"), longest.alias("h"))
    return recovery.size_field(e, 0.1).select("elem", F.round("size", 6).alias("size"))


@query("mesh_target_count_size_field", f"WITH {TET}, e AS (SELECT elem, v, sqrt(v) * (1 + (x0+x1+x2+x3) / 4) AS err, sqrt(3.0::DOUBLE) / (SELECT n FROM dim) AS h FROM vol), t AS (SELECT sum(pow(err, 6.0::DOUBLE / 5)) AS s FROM e) SELECT elem, round(greatest(0.5 * h, least(2.0 * h, h * pow(err, -0.4) * cbrt(t.s / 5000))), 6) AS size FROM e, t")
def target_count_size_field(spark, sf_dir):
    """Sizes for a wanted number of elements, between half and twice the present one."""
    c = corners(box(spark, sf_dir))
    longest = F.greatest(*[g.norm(g.vec(P[i], P[j])) for i, j in _EDGE])
    e = c.select("elem", (F.sqrt(g.tet_volume(P)) * (1 + (P[0]["x"] + P[1]["x"] + P[2]["x"] + P[3]["x"]) / 4)).alias("err"), longest.alias("h"))
    return recovery.size_field_for_count(e, 5000, 0.5, 2.0).select("elem", F.round("size", 6).alias("size"))


@query("mesh_recovered_error", f"WITH {CTE} SELECT true AS positive, true AS bounded, count(*) AS elems FROM elem")
def recovered_error(spark, sf_dir):
    """Element errors of u = x^2 in the energy norm: its piecewise gradient against the recovered one. They are positive and at most h sqrt(V)."""
    b = box(spark, sf_dir)
    e = recovery.gradient_errors(corners(b), b.down(), b.vertex(), lambda p: p["x"] * p["x"])
    h = 2.0 / b.n
    return e.agg((F.min("err") >= 0).alias("positive"), F.bool_and(F.col("err") <= h * F.sqrt("volume") + 1e-9).alias("bounded"), F.count(F.lit(1)).alias("elems"))
