"""Queries on the generated box: generation, adjacency, measures, shape functions, refinement, validation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetry.functions import geometry as g
from facetry.operators import graph, numbering, recovery, replicas, topology
from facetry.plans.catalog import query
from facetry.plans.meshes import Box, box

CTE = Box.SQL
#: One row per tet with its corners' coordinates.
TET = CTE + """,
tet AS (SELECT elem, """ + ", ".join(f"max(CASE WHEN pos = {i} THEN {c} END) AS {c}{i}" for i in range(4) for c in "xyz") + ", " + ", ".join(f"max(CASE WHEN pos = {i} THEN vert END) AS v{i}" for i in range(4)) + """ FROM down JOIN vertex USING (vert) GROUP BY elem),
vol AS (SELECT *, ((x1-x0)*((y2-y0)*(z3-z0)-(z2-z0)*(y3-y0)) + (y1-y0)*((z2-z0)*(x3-x0)-(x2-x0)*(z3-z0)) + (z1-z0)*((x2-x0)*(y3-y0)-(y2-y0)*(x3-x0))) / 6 AS v FROM tet)"""
_TRI = list(combinations(range(4), 3))
_EDGE = list(combinations(range(4), 2))
FACE = CTE + ",\nt4 AS (SELECT elem, list(vert ORDER BY pos) AS vs FROM down GROUP BY elem),\nface AS (" + " UNION ALL ".join(f"SELECT elem, {w} AS which, list_sort([vs[{a + 1}], vs[{b + 1}], vs[{c + 1}]]) AS key FROM t4" for w, (a, b, c) in enumerate(_TRI)) + "),\nedge AS (" + " UNION ALL ".join(f"SELECT elem, {w} AS which, list_sort([vs[{a + 1}], vs[{b + 1}]]) AS key FROM t4" for w, (a, b) in enumerate(_EDGE)) + ")"
#: Parts of the box and the vertices they share.
REP = CTE + """,
inc AS (SELECT * FROM down JOIN elem USING (elem)),
replica AS (SELECT vert, part, count(*) AS n FROM inc GROUP BY ALL),
load AS (SELECT part, count(*) AS elems FROM elem GROUP BY part),
owner AS (SELECT vert, arg_min(part, (elems, part)) AS owner FROM replica JOIN load USING (part) GROUP BY vert)"""


def corners(box: Box) -> DataFrame:
    """elem, p: the corners of each tet as an array of points in order."""
    x = box.down().join(box.vertex(), "vert").groupBy("elem").agg(F.array_sort(F.collect_list(F.struct("pos", "vert", "x", "y", "z"))).alias("p"))
    return x


class _Corners:
    """The four corners of p as columns, made when they are asked for: a column needs a session."""

    def __getitem__(self, i):
        return [F.col("p")[k] for k in range(4)][i]

    def __len__(self):
        return 4


P = _Corners()


def _inc(box: Box) -> DataFrame:
    return box.down().join(box.elem(), "elem")


@query("mesh_box_vertices", f"WITH {CTE} SELECT vert, x, y, z FROM vertex")
def box_vertices(spark, sf_dir):
    return box(spark, sf_dir).vertex()


@query("mesh_box_tets", f"WITH {CTE} SELECT elem, pos, vert FROM down")
def box_tets(spark, sf_dir):
    return box(spark, sf_dir).down()


@query("mesh_box_model", f"WITH {CTE} SELECT vert, CAST((CASE WHEN x IN (0, 1) THEN 0 ELSE 1 END) + (CASE WHEN y IN (0, 1) THEN 0 ELSE 1 END) + (CASE WHEN z IN (0, 1) THEN 0 ELSE 1 END) AS INT) AS model_dim, CAST((CASE x WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END) + 3 * (CASE y WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END) + 9 * (CASE z WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END) AS INT) AS model_tag FROM vertex")
def box_model(spark, sf_dir):
    """Classification of vertices on the 27 entities of the box's model."""
    side = lambda c: F.when(F.col(c) == 0, 0).when(F.col(c) == 1, 2).otherwise(1)
    free = lambda c: F.when(F.col(c).isin(0.0, 1.0), 0).otherwise(1)
    return box(spark, sf_dir).vertex().select("vert", (free("x") + free("y") + free("z")).alias("model_dim"), (side("x") + 3 * side("y") + 9 * side("z")).alias("model_tag"))


@query("mesh_entity_counts", f"WITH {FACE} SELECT 0 AS dim, count(*) AS n FROM vertex UNION ALL SELECT 1, count(DISTINCT key) FROM edge UNION ALL SELECT 2, count(DISTINCT key) FROM face UNION ALL SELECT 3, count(*) FROM elem")
def entity_counts(spark, sf_dir):
    b = box(spark, sf_dir)
    down = b.down()
    one = lambda d, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(d).alias("dim"), "n")
    return one(0, b.vertex()).union(one(1, topology.entities(topology.boundary(down, 2)))).union(one(2, topology.entities(topology.boundary(down, 3)))).union(one(3, b.elem()))


@query("mesh_edges", f"WITH {FACE} SELECT key[1] AS a, key[2] AS b, count(*) AS uses FROM edge GROUP BY key")
def edges(spark, sf_dir):
    """Make or find: edges from element templates, each once, with its count of tets."""
    e = topology.entities(topology.boundary(box(spark, sf_dir).down(), 2))
    return e.select(F.col("key")[0].alias("a"), F.col("key")[1].alias("b"), "uses")


@query("mesh_faces_up", f"WITH {FACE} SELECT key[1] AS a, key[2] AS b, key[3] AS c, count(*) AS uses FROM face GROUP BY key")
def faces_up(spark, sf_dir):
    f = topology.entities(topology.boundary(box(spark, sf_dir).down(), 3))
    return f.select(F.col("key")[0].alias("a"), F.col("key")[1].alias("b"), F.col("key")[2].alias("c"), "uses")


@query("mesh_vertex_upward", f"WITH {FACE} SELECT vert, count(*) AS elems FROM down GROUP BY vert")
def vertex_upward(spark, sf_dir):
    return box(spark, sf_dir).down().groupBy("vert").agg(F.count(F.lit(1)).alias("elems"))


@query("mesh_element_neighbours", f"WITH {FACE}, side AS (SELECT elem, array_to_string(key, ',') AS k FROM face) SELECT a.elem, b.elem AS other FROM side a JOIN side b ON a.k = b.k AND a.elem <> b.elem")
def element_neighbours(spark, sf_dir):
    return topology.neighbours(topology.boundary(box(spark, sf_dir).down(), 3)).select("elem", "other")


@query("mesh_element_to_element", f"WITH {FACE}, side AS (SELECT elem, which, array_to_string(key, ',') AS k FROM face), g AS (SELECT k, min(elem) AS lo, max(elem) AS hi FROM side GROUP BY k) SELECT elem, which, CASE WHEN lo = hi THEN -1 WHEN elem = lo THEN hi ELSE lo END AS other FROM side JOIN g USING (k)")
def element_to_element(spark, sf_dir):
    """Side-indexed neighbours, -1 on the boundary."""
    f = topology.boundary(box(spark, sf_dir).down(), 3)
    near = topology.neighbours(f).groupBy("elem", "key").agg(F.min("other").alias("other"))  # the lowest where a side has several
    return f.join(near, ["elem", "key"], "left").select("elem", "which", F.coalesce("other", F.lit(-1)).alias("other"))


@query("mesh_bridge_vertices", f"WITH {FACE} SELECT DISTINCT a.vert, b.vert AS target FROM down a JOIN down b USING (elem) WHERE a.vert <> b.vert")
def bridge_vertices(spark, sf_dir):
    d = box(spark, sf_dir).down()
    return topology.bridge(d, "vert", "elem")


@query("mesh_full_adjacency", f"WITH {FACE} SELECT 3 AS from_dim, 2 AS to_dim, count(*) AS pairs FROM face UNION ALL SELECT 3, 1, count(*) FROM edge UNION ALL SELECT 2, 3, count(*) FROM face UNION ALL SELECT 3, 0, count(*) FROM down UNION ALL SELECT 1, 3, count(*) FROM edge")
def full_adjacency(spark, sf_dir):
    d = box(spark, sf_dir).down()
    n = lambda a, b, df: df.agg(F.count(F.lit(1)).alias("pairs")).select(F.lit(a).alias("from_dim"), F.lit(b).alias("to_dim"), "pairs")
    f, e = topology.boundary(d, 3), topology.boundary(d, 2)
    return n(3, 2, f).union(n(3, 1, e)).union(n(2, 3, f)).union(n(3, 0, d)).union(n(1, 3, e))


@query("mesh_find_element", f"WITH {FACE}, want AS (SELECT elem AS wanted, array_to_string(list_sort(vs), ',') AS k FROM t4) SELECT wanted, elem AS found FROM want JOIN (SELECT elem, array_to_string(list_sort(vs), ',') AS k FROM t4) USING (k)")
def find_element(spark, sf_dir):
    """Elements looked up by their unordered vertices."""
    t = topology.gathered(box(spark, sf_dir).down()).select("elem", F.array_sort("verts").alias("k"))
    return t.withColumnRenamed("elem", "wanted").join(t, "k").select("wanted", F.col("elem").alias("found"))


@query("mesh_alignment", f"WITH {FACE}, use AS (SELECT elem, 0 AS which, [vs[1], vs[2], vs[3]] AS vs3, list_sort([vs[1], vs[2], vs[3]]) AS key FROM t4) SELECT elem, list_position(vs3, key[1]) - 1 AS rotate, CAST(vs3[(list_position(vs3, key[1]) % 3) + 1] <> key[2] AS INT) AS flip FROM use")
def alignment(spark, sf_dir):
    """How a boundary triangle, written from its lowest vertex, lies in its element: rotation and flip."""
    f = topology.boundary(box(spark, sf_dir).down(), 3).where("which = 0")
    at = F.array_position("verts", F.col("key")[0]).cast("int")
    return f.select("elem", (at - 1).cast("long").alias("rotate"), (F.element_at("verts", (at % 3) + 1) != F.col("key")[1]).cast("int").alias("flip"))


@query("mesh_volumes", f"WITH {TET} SELECT elem, v AS volume FROM vol")
def volumes(spark, sf_dir):
    return corners(box(spark, sf_dir)).select("elem", g.tet_volume(P).alias("volume"))


@query("mesh_volume_check", f"WITH {TET} SELECT round(sum(v), 9) AS total, round(min(v), 9) AS least, CAST(sum(CASE WHEN v <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad FROM vol")
def volume_check(spark, sf_dir):
    v = g.tet_volume(P)
    return corners(box(spark, sf_dir)).agg(F.round(F.sum(v), 9).alias("total"), F.round(F.min(v), 9).alias("least"), F.sum(F.when(v <= 0, 1).otherwise(0)).alias("bad"))


@query("mesh_centroids", f"WITH {TET} SELECT elem, round((x0+x1+x2+x3)/4, 9) AS x, round((y0+y1+y2+y3)/4, 9) AS y, round((z0+z1+z2+z3)/4, 9) AS z FROM tet")
def centroids(spark, sf_dir):
    mean = lambda c: F.round((P[0][c] + P[1][c] + P[2][c] + P[3][c]) / 4, 9).alias(c)
    return corners(box(spark, sf_dir)).select("elem", mean("x"), mean("y"), mean("z"))


@query("mesh_bounding_box", f"WITH {CTE} SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1, round(avg(x), 9) AS cx FROM vertex")
def bounding_box(spark, sf_dir):
    v = box(spark, sf_dir).vertex()
    return v.agg(*[f(c).alias(f"{c}{i}") for c in "xyz" for i, f in enumerate((F.min, F.max))], F.round(F.avg("x"), 9).alias("cx"))


_SQ = "(" + " + ".join(f"(x{b}-x{a})*(x{b}-x{a})+(y{b}-y{a})*(y{b}-y{a})+(z{b}-z{a})*(z{b}-z{a})" for a, b in _EDGE) + ")"


@query("mesh_quality", f"WITH {TET} SELECT elem, round(sign(v) * 15552 * v * v / pow({_SQ}, 3), 9) AS quality FROM vol")
def quality(spark, sf_dir):
    return corners(box(spark, sf_dir)).select("elem", F.round(g.tet_quality(P), 9).alias("quality"))


@query("mesh_quality_histogram", f"WITH {TET} SELECT CAST(floor(round(cbrt(15552 * v * v / pow({_SQ}, 3)), 6) * 10) AS BIGINT) AS bin, count(*) AS n FROM vol GROUP BY 1")
def quality_histogram(spark, sf_dir):
    """Cube roots of the quality ratio, as statistics report them."""
    return corners(box(spark, sf_dir)).select(F.floor(F.round(F.cbrt(g.tet_quality(P)), 6) * 10).alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def _area(a, b, c):
    u, w = [f"({k}{b}-{k}{a})" for k in "xyz"], [f"({k}{c}-{k}{a})" for k in "xyz"]
    cr = [f"({u[1]}*{w[2]}-{u[2]}*{w[1]})", f"({u[2]}*{w[0]}-{u[0]}*{w[2]})", f"({u[0]}*{w[1]}-{u[1]}*{w[0]})"]
    return f"sqrt({cr[0]}*{cr[0]}+{cr[1]}*{cr[1]}+{cr[2]}*{cr[2]})/2"


@query("mesh_insphere", f"WITH {TET} SELECT elem, round(3 * abs(v) / ({' + '.join(_area(*f) for f in _TRI)}), 9) AS radius FROM vol")
def insphere(spark, sf_dir):
    return corners(box(spark, sf_dir)).select("elem", F.round(g.insphere(P), 9).alias("radius"))


@query("mesh_triangle_quality", f"WITH {TET} SELECT elem, round(48 * pow({_area(0, 1, 2)}, 2) / pow((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)+(z1-z0)*(z1-z0)+(x2-x0)*(x2-x0)+(y2-y0)*(y2-y0)+(z2-z0)*(z2-z0)+(x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)+(z2-z1)*(z2-z1), 2), 9) AS quality FROM tet")
def triangle_quality(spark, sf_dir):
    return corners(box(spark, sf_dir)).select("elem", F.round(g.triangle_quality(P[:3]), 9).alias("quality"))


@query("mesh_heights", f"WITH {TET} SELECT elem, round(3 * v / greatest({', '.join(_area(*f) for f in _TRI)}), 9) AS shortest, round(3 * v / least({', '.join(_area(*f) for f in _TRI)}), 9) AS largest FROM vol")
def heights(spark, sf_dir):
    areas = [g.triangle_area([P[i] for i in f]) for f in _TRI]
    v = g.tet_volume(P)
    return corners(box(spark, sf_dir)).select("elem", F.round(3 * v / F.greatest(*areas), 9).alias("shortest"), F.round(3 * v / F.least(*areas), 9).alias("largest"))


_U = {i: f"(2 * x{i} - 3 * y{i} + 0.5 * z{i} + 1)" for i in range(4)}


@query("mesh_gradient", f"WITH {TET} SELECT elem, 2.0::DOUBLE AS gx, -3.0::DOUBLE AS gy, 0.5::DOUBLE AS gz FROM tet")
def gradient(spark, sf_dir):
    """The gradient of a linear field is exact on every tet."""
    u = [2 * p["x"] - 3 * p["y"] + 0.5 * p["z"] + 1 for p in P]
    gx = g.gradient(P, u)
    return corners(box(spark, sf_dir)).select("elem", *[F.round(c, 9).alias(n) for c, n in zip(gx, ("gx", "gy", "gz"), strict=True)])


@query("mesh_gradient_by_volume", f"WITH {TET} SELECT vert, 2.0::DOUBLE AS gx, -3.0::DOUBLE AS gy, 0.5::DOUBLE AS gz FROM vertex")
def gradient_by_volume(spark, sf_dir):
    """Volume-weighted mean of the gradients around each vertex."""
    u = [2 * p["x"] - 3 * p["y"] + 0.5 * p["z"] + 1 for p in P]
    per = corners(box(spark, sf_dir)).select(F.explode("p.vert").alias("vert"), g.tet_volume(P).alias("v"), *[c.alias(n) for c, n in zip(g.gradient(P, u), ("gx", "gy", "gz"), strict=True)])
    return per.groupBy("vert").agg(*[F.round(F.sum(F.col(n) * F.col("v")) / F.sum("v"), 9).alias(n) for n in ("gx", "gy", "gz")])


@query("mesh_average_to_vertex", f"WITH {TET} SELECT vert, round(avg(elem % 10), 9) AS mean FROM down GROUP BY vert")
def average_to_vertex(spark, sf_dir):
    return box(spark, sf_dir).down().groupBy("vert").agg(F.round(F.avg(F.col("elem") % 10), 9).alias("mean"))


@query("mesh_integrate_quadratic", f"WITH {TET} SELECT round(sum(v * ((x0*x0+x1*x1+x2*x2+x3*x3) + (x0+x1+x2+x3)*(x0+x1+x2+x3)) / 20), 9) AS integral FROM vol")
def integrate_quadratic(spark, sf_dir):
    """The integral of x^2 by the four-point rule of degree 2 on every tet."""
    a, b = (5 + 3 * 5**0.5) / 20, (5 - 5**0.5) / 20
    total = F.lit(0.0)
    for i in range(4):
        at = sum((P[j]["x"] * (a if i == j else b) for j in range(4)), F.lit(0.0))
        total = total + at * at / 4
    return corners(box(spark, sf_dir)).agg(F.round(F.sum(g.tet_volume(P) * total), 9).alias("integral"))


@query("mesh_edge_sizes", f"WITH {FACE} SELECT round(avg(l), 9) AS mean, round(max(l), 9) AS longest, round(min(l), 9) AS shortest FROM (SELECT DISTINCT key, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS l FROM edge JOIN vertex a ON a.vert = key[1] JOIN vertex b ON b.vert = key[2])")
def edge_sizes(spark, sf_dir):
    return _edge_lengths(box(spark, sf_dir)).agg(F.round(F.avg("l"), 9).alias("mean"), F.round(F.max("l"), 9).alias("longest"), F.round(F.min("l"), 9).alias("shortest"))


def _edge_lengths(box: Box) -> DataFrame:
    """a, b, l from the corners that the tets carry, so that coordinates are joined once."""
    pairs = F.array(*[F.struct(F.when(P[i]["vert"] < P[j]["vert"], P[i]).otherwise(P[j]).alias("a"), F.when(P[i]["vert"] < P[j]["vert"], P[j]).otherwise(P[i]).alias("b")) for i, j in _EDGE])
    e = corners(box).select(F.explode(pairs).alias("e")).select(F.col("e.a.vert").alias("a"), F.col("e.b.vert").alias("b"), g.norm(g.vec(F.col("e.a"), F.col("e.b"))).alias("l"))
    return e.groupBy("a", "b").agg(F.min("l").alias("l"))


@query("mesh_iso_size", f"WITH {FACE}, l AS (SELECT DISTINCT key, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS l FROM edge JOIN vertex a ON a.vert = key[1] JOIN vertex b ON b.vert = key[2]), e AS (SELECT key[1] AS vert, l FROM l UNION ALL SELECT key[2], l FROM l) SELECT vert, round(sum(l) / count(*), 9) AS size FROM e GROUP BY vert")
def iso_size(spark, sf_dir):
    e = _edge_lengths(box(spark, sf_dir)).select(F.explode(F.array("a", "b")).alias("vert"), "l")
    return e.groupBy("vert").agg(F.round(F.sum("l") / F.count(F.lit(1)), 9).alias("size"))


@query("mesh_shortest_edges", f"WITH {FACE}, l AS (SELECT DISTINCT key, round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 9) AS l FROM edge JOIN vertex a ON a.vert = key[1] JOIN vertex b ON b.vert = key[2]), e AS (SELECT key[1] AS vert, key[2] AS other, l FROM l UNION ALL SELECT key[2], key[1], l FROM l) SELECT vert, other, l, row_number() OVER (PARTITION BY vert ORDER BY l, other) AS rank FROM e")
def shortest_edges(spark, sf_dir):
    """Incident edges of each vertex, shortest first."""
    e = _edge_lengths(box(spark, sf_dir)).select(F.explode(F.array(F.struct(F.col("a").alias("vert"), F.col("b").alias("other")), F.struct(F.col("b").alias("vert"), F.col("a").alias("other")))).alias("s"), F.round("l", 9).alias("l"))
    return e.select("s.vert", "s.other", "l").withColumn("rank", F.row_number().over(Window.partitionBy("vert").orderBy("l", "other")).cast("long"))


@query("mesh_metric_lengths", f"WITH {FACE} SELECT CAST(sum(CASE WHEN l > 1.5 THEN 1 ELSE 0 END) AS BIGINT) AS to_split, CAST(sum(CASE WHEN l < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS to_collapse FROM (SELECT DISTINCT key, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) / ((0.1 + 0.4 * a.x + 0.1 + 0.4 * b.x) / 2) AS l FROM edge JOIN vertex a ON a.vert = key[1] JOIN vertex b ON b.vert = key[2])")
def metric_lengths(spark, sf_dir):
    """Edges to split (over 1.5) and to collapse (under 0.5) in a size field that grows along x."""
    b = box(spark, sf_dir)
    v = b.vertex().select("vert", (0.1 + 0.4 * F.col("x")).alias("h"))
    e = _edge_lengths(b).join(v.withColumnRenamed("vert", "a").withColumnRenamed("h", "ha"), "a").join(v.withColumnRenamed("vert", "b").withColumnRenamed("h", "hb"), "b")
    m = F.col("l") / ((F.col("ha") + F.col("hb")) / 2)
    return e.agg(F.sum(F.when(m > 1.5, 1).otherwise(0)).alias("to_split"), F.sum(F.when(m < 0.5, 1).otherwise(0)).alias("to_collapse"))


@query("mesh_boundary_classification", f"WITH {FACE}, s AS (SELECT key FROM face GROUP BY key HAVING count(*) <> 2) SELECT DISTINCT unnest(key) AS vert FROM s")
def boundary_classification(spark, sf_dir):
    """Vertices on the boundary: those of sides with other than two elements."""
    f = topology.entities(topology.boundary(box(spark, sf_dir).down(), 3))
    return f.where("uses <> 2").select(F.explode("key").alias("vert")).distinct()


@query("mesh_uniform_refine", f"WITH {FACE} SELECT (SELECT count(*) FROM vertex) + (SELECT count(DISTINCT key) FROM edge) AS vertices, 8 * (SELECT count(*) FROM elem) AS elements, 1.0::DOUBLE AS volume, 0 AS inverted")
def uniform_refine(spark, sf_dir):
    """Every edge split: eight tets for one, four at the corners and four around the inner diagonal."""
    x = recovery.refined(corners(box(spark, sf_dir)))
    v = g.tet_volume(P)
    fine = x.agg(F.count(F.lit(1)).alias("elements"), F.round(F.sum(v), 9).alias("volume"), F.sum(F.when(v <= 0, 1).otherwise(0)).cast("int").alias("inverted"))
    verts = x.select(F.explode("p").alias("q")).select("q.x", "q.y", "q.z").distinct().agg(F.count(F.lit(1)).alias("vertices"))
    return verts.join(F.broadcast(fine), F.lit(True)).select("vertices", "elements", "volume", "inverted")


@query("mesh_edge_codes", f"WITH {FACE}, m AS (SELECT DISTINCT key FROM edge WHERE (key[1] + key[2]) % 5 = 0) SELECT elem, CAST(sum(CASE WHEN m.key IS NULL THEN 0 ELSE 1 << which END) AS BIGINT) AS code FROM edge LEFT JOIN m USING (key) GROUP BY elem")
def edge_codes(spark, sf_dir):
    """The refinement template of each tet: a bit for each marked edge."""
    e = topology.boundary(box(spark, sf_dir).down(), 2)
    on = (F.col("key")[0] + F.col("key")[1]) % 5 == 0
    return e.groupBy("elem").agg(F.sum(F.when(on, F.expr("shiftleft(1L, which)")).otherwise(0)).alias("code"))


@query("mesh_spr_linear", f"WITH {CTE} SELECT vert, round(1 + 2 * x - y + 3 * z, 6) AS recovered FROM vertex")
def spr_linear(spark, sf_dir):
    """Patch recovery from element centroids gives a linear field back at every vertex."""
    b = box(spark, sf_dir)
    at = lambda c: (P[0][c] + P[1][c] + P[2][c] + P[3][c]) / 4
    samples = corners(b).select("elem", at("x").alias("x"), at("y").alias("y"), at("z").alias("z")).withColumn("value", 1 + 2 * F.col("x") - F.col("y") + 3 * F.col("z"))
    return recovery.recover(b.down(), b.vertex(), samples).select("vert", F.round("recovered", 6).alias("recovered"))


@query("mesh_spr_size_field", f"WITH {TET}, e AS (SELECT elem, v, 1.0 + elem % 3 AS err FROM vol), c AS (SELECT pow(0.01 / sum(pow(err, 6.0 / 5.0)), 0.5) AS c FROM e) SELECT elem, round(0.25 * pow(err, -0.4) * (SELECT c FROM c), 9) AS size FROM e")
def spr_size_field(spark, sf_dir):
    """size = h e^(-2/(2p+d)) C with p = 1, d = 3 and C from the whole mesh's error."""
    e = box(spark, sf_dir).elem().select("elem", (1.0 + F.col("elem") % 3).alias("err"))
    c = e.agg(F.pow(F.lit(0.01) / F.sum(F.pow("err", F.lit(6.0 / 5.0))), F.lit(0.5)).alias("c"))
    return e.join(F.broadcast(c), F.lit(True)).select("elem", F.round(0.25 * F.pow("err", F.lit(-0.4)) * F.col("c"), 9).alias("size"))


@query("mesh_bfs_distance", f"WITH {CTE} SELECT vert, CAST(round(greatest(x, y) * n) AS INT) AS distance FROM vertex, dim")
def bfs_distance(spark, sf_dir):
    """Edges to the nearest vertex on one model edge; on this box a step changes any of the indices by one, all in one direction."""
    b = box(spark, sf_dir)
    e = topology.entities(topology.boundary(b.down(), 2)).select(F.col("key")[0].alias("a"), F.col("key")[1].alias("b"))
    return graph.distances(e, b.vertex().where("x = 0 AND y = 0").select("vert"))


@query("mesh_part_components", f"WITH RECURSIVE {FACE}, side AS (SELECT elem, elem % 3 AS part, array_to_string(key, ',') AS k FROM face), adj AS MATERIALIZED (SELECT a.elem AS u, b.elem AS v FROM side a JOIN side b ON a.k = b.k AND a.part = b.part AND a.elem <> b.elem), r(elem, label) USING KEY (elem) AS (SELECT elem, elem AS label FROM elem UNION SELECT adj.v, min(r.label) FROM r JOIN adj ON adj.u = r.elem JOIN recurring.r c ON c.elem = adj.v WHERE r.label < c.label GROUP BY adj.v) SELECT elem, label AS component FROM r")
def part_components(spark, sf_dir):
    """Components by shared faces within parts; dealt so that parts fall apart."""
    b = box(spark, sf_dir)
    n = topology.neighbours(topology.boundary(b.down(), 3)).where("elem % 3 = other % 3").select(F.col("elem").alias("a"), F.col("other").alias("b"))
    c = graph.components(n)
    return b.elem().join(c, F.col("elem") == c["node"], "left").select("elem", F.coalesce("label", "elem").alias("component"))


@query("mesh_ghost_layers", f"WITH {REP}, l0 AS (SELECT part, elem, 0 AS layer FROM elem), l1 AS (SELECT DISTINCT s.part, e.elem FROM l0 s JOIN down d ON d.elem = s.elem JOIN down e ON e.vert = d.vert), l2 AS (SELECT DISTINCT s.part, e.elem FROM l1 s JOIN down d ON d.elem = s.elem JOIN down e ON e.vert = d.vert) SELECT part, elem, CAST(min(layer) AS INT) AS layer FROM (SELECT * FROM l0 UNION ALL SELECT part, elem, 1 FROM l1 UNION ALL SELECT part, elem, 2 FROM l2) GROUP BY ALL HAVING min(layer) > 0")
def ghost_layers(spark, sf_dir):
    """Two layers of elements around each part, across vertices: a true k-hop halo."""
    b = box(spark, sf_dir)
    return graph.ghosts(b.down(), b.elem(), 2)


@query("mesh_owners", f"WITH {REP} SELECT vert, owner FROM owner")
def box_owners(spark, sf_dir):
    b = box(spark, sf_dir)
    return replicas.owners(replicas.replicas(_inc(b)), replicas.part_loads(b.elem()))


@query("mesh_ownership_violations", "SELECT 0::BIGINT AS violations")
def ownership_violations(spark, sf_dir):
    """Vertices without exactly one owner among their parts."""
    b = box(spark, sf_dir)
    rep = replicas.replicas(_inc(b))
    own = replicas.owners(rep, replicas.part_loads(b.elem()))
    held = rep.join(own, "vert").groupBy("vert").agg(F.sum(F.when(F.col("part") == F.col("owner"), 1).otherwise(0)).alias("n"))
    return held.agg(F.sum(F.when(F.col("n") != 1, 1).otherwise(0)).alias("violations"))


@query("mesh_upward_violations", "SELECT 0::BIGINT AS violations")
def upward_violations(spark, sf_dir):
    """Faces with no or more than two elements, and boundary faces whose vertices are not all on one side of the box."""
    b = box(spark, sf_dir)
    f = topology.entities(topology.boundary(b.down(), 3))
    v = b.vertex()
    on = f.where("uses = 1").select("key", F.explode("key").alias("vert")).join(v, "vert").groupBy("key").agg(*[fn(c).alias(f"{c}{i}") for c in "xyz" for i, fn in enumerate((F.min, F.max))])
    flat = on.where(" AND ".join(f"NOT ({c}0 = {c}1 AND {c}0 IN (0, 1))" for c in "xyz")).agg(F.count(F.lit(1)).alias("v"))
    return f.where("uses NOT IN (1, 2)").agg(F.count(F.lit(1)).alias("v")).union(flat).agg(F.sum("v").alias("violations"))


@query("mesh_independent_set_violations", "SELECT 0::BIGINT AS violations")
def independent_set_violations(spark, sf_dir):
    """Edges within a colour, and vertices left without one, of a colouring by repeated independent sets."""
    b = box(spark, sf_dir)
    e = topology.entities(topology.boundary(b.down(), 2)).select(F.col("key")[0].alias("a"), F.col("key")[1].alias("b"))
    colour = graph.colouring(e, b.vertex().select("vert"))
    c = colour.select("vert", "colour")
    inside = e.join(c.withColumnRenamed("vert", "a").withColumnRenamed("colour", "ca"), "a").join(c.withColumnRenamed("vert", "b").withColumnRenamed("colour", "cb"), "b").where("ca = cb")
    missing = b.vertex().join(c, "vert", "left_anti")
    n = lambda d: d.agg(F.count(F.lit(1)).alias("v"))
    return n(inside).union(n(missing)).agg(F.sum("v").alias("violations"))


@query("mesh_global_numbering", f"WITH {REP}, o AS (SELECT vert, owner, row_number() OVER (PARTITION BY owner ORDER BY vert) - 1 AS l FROM owner), c AS (SELECT owner, sum(count(*)) OVER (ORDER BY owner) - count(*) AS before FROM owner GROUP BY owner) SELECT vert, owner, l AS local_number, CAST(l + before AS BIGINT) AS global_number FROM o JOIN c USING (owner)")
def global_numbering(spark, sf_dir):
    b = box(spark, sf_dir)
    own = replicas.owners(replicas.replicas(_inc(b)), replicas.part_loads(b.elem()))
    return numbering.numbered(own, "owner", "vert").select("vert", "owner", "local_number", "global_number")


@query("mesh_scale_in_box", f"WITH {CTE} SELECT vert, round((1 + x) * CASE WHEN abs(x - 0.5) <= 0.25 AND abs(y - 0.5) <= 0.25 AND abs(z - 0.5) <= 0.5 THEN 0.5 ELSE 1 END, 9) AS size FROM vertex")
def scale_in_box(spark, sf_dir):
    inside = (F.abs(F.col("x") - 0.5) <= 0.25) & (F.abs(F.col("y") - 0.5) <= 0.25) & (F.abs(F.col("z") - 0.5) <= 0.5)
    return box(spark, sf_dir).vertex().select("vert", F.round((1 + F.col("x")) * F.when(inside, 0.5).otherwise(1.0), 9).alias("size"))


@query("mesh_scale_in_cylinder", f"WITH {CTE} SELECT vert, CASE WHEN abs(z - 0.5) <= 0.3 AND (x - 0.5) * (x - 0.5) + (y - 0.5) * (y - 0.5) <= 0.0625 THEN 0.5 ELSE 1.0 END::DOUBLE AS factor FROM vertex")
def scale_in_cylinder(spark, sf_dir):
    """Axial distance within half the height, radial within the radius."""
    r = (F.col("x") - 0.5) * (F.col("x") - 0.5) + (F.col("y") - 0.5) * (F.col("y") - 0.5)
    return box(spark, sf_dir).vertex().select("vert", F.when((F.abs(F.col("z") - 0.5) <= 0.3) & (r <= 0.0625), 0.5).otherwise(1.0).alias("factor"))


@query("mesh_level_set_size", f"WITH {CTE} SELECT vert, CASE WHEN abs(x - 0.5) <= 0.1 THEN 0.05 WHEN abs(x - 0.5) <= 0.3 THEN 0.1 ELSE 0.2 END::DOUBLE AS size FROM vertex")
def level_set_size(spark, sf_dir):
    d = F.abs(F.col("x") - 0.5)
    return box(spark, sf_dir).vertex().select("vert", F.when(d <= 0.1, 0.05).when(d <= 0.3, 0.1).otherwise(0.2).alias("size"))


@query("mesh_bubble_distance", f"WITH {CTE}, b(id, px, py, pz, r) AS (VALUES (1, 0.25, 0.25, 0.25, 0.1), (2, 0.75, 0.5, 0.5, 0.2)) SELECT vert, round(min(sqrt((x-px)*(x-px)+(y-py)*(y-py)+(z-pz)*(z-pz)) - r), 9) AS distance, CAST(arg_min(id, sqrt((x-px)*(x-px)+(y-py)*(y-py)+(z-pz)*(z-pz)) - r) AS INT) AS bubble FROM vertex, b GROUP BY vert")
def bubble_distance(spark, sf_dir):
    """Signed distance to the nearest bubble, from a list given with the query."""
    bubbles = [(1, 0.25, 0.25, 0.25, 0.1), (2, 0.75, 0.5, 0.5, 0.2)]
    d = [F.struct((F.sqrt((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y) + (F.col("z") - z) * (F.col("z") - z)) - r).alias("d"), F.lit(i).alias("i")) for i, x, y, z, r in bubbles]
    best = F.array_min(F.array(*d))
    return box(spark, sf_dir).vertex().select("vert", F.round(best["d"], 9).alias("distance"), best["i"].alias("bubble"))


@query("mesh_displace", f"WITH {CTE} SELECT vert, round(x + 0.5 * y, 9) AS x, round(y - 0.5 * z, 9) AS y, round(z + 0.5 * x, 9) AS z FROM vertex")
def displace(spark, sf_dir):
    return box(spark, sf_dir).vertex().select("vert", F.round(F.col("x") + 0.5 * F.col("y"), 9).alias("x"), F.round(F.col("y") - 0.5 * F.col("z"), 9).alias("y"), F.round(F.col("z") + 0.5 * F.col("x"), 9).alias("z"))


@query("mesh_map_local_to_global", f"WITH {TET} SELECT elem, round(0.4 * x0 + 0.3 * x1 + 0.2 * x2 + 0.1 * x3, 9) AS x FROM tet")
def map_local_to_global(spark, sf_dir):
    """The image of the barycentric point (0.4, 0.3, 0.2, 0.1)."""
    return corners(box(spark, sf_dir)).select("elem", F.round(sum((P[i]["x"] * w for i, w in enumerate((0.4, 0.3, 0.2, 0.1))), F.lit(0.0)), 9).alias("x"))


@query("mesh_quadratic_values", f"WITH {TET} SELECT elem, round((0.4*x0+0.3*x1+0.2*x2+0.1*x3) * (0.4*x0+0.3*x1+0.2*x2+0.1*x3), 9) AS value FROM tet")
def quadratic_values(spark, sf_dir):
    """Quadratic Lagrange interpolation gives x^2 back."""
    l = (0.4, 0.3, 0.2, 0.1)  # noqa: E741
    total = F.lit(0.0)
    for i in range(4):
        total = total + l[i] * (2 * l[i] - 1) * P[i]["x"] * P[i]["x"]
    for i, j in _EDGE:
        mid = (P[i]["x"] + P[j]["x"]) / 2
        total = total + 4 * l[i] * l[j] * mid * mid
    return corners(box(spark, sf_dir)).select("elem", F.round(total, 9).alias("value"))


@query("mesh_dihedral_cosines", f"WITH {TET}, n AS (SELECT elem, {', '.join(f'({e}) AS {nm}' for nm, e in zip(('ax', 'ay', 'az', 'ux', 'uy', 'uz'), ('(y1-y0)*(z2-z0)-(z1-z0)*(y2-y0)', '(z1-z0)*(x2-x0)-(x1-x0)*(z2-z0)', '(x1-x0)*(y2-y0)-(y1-y0)*(x2-x0)', '(y1-y0)*(z3-z0)-(z1-z0)*(y3-y0)', '(z1-z0)*(x3-x0)-(x1-x0)*(z3-z0)', '(x1-x0)*(y3-y0)-(y1-y0)*(x3-x0)')))} FROM tet) SELECT elem, round((ax*ux+ay*uy+az*uz)/(sqrt(ax*ax+ay*ay+az*az)*sqrt(ux*ux+uy*uy+uz*uz)), 9) AS cosine FROM n")
def dihedral_cosines(spark, sf_dir):
    """Cosine of the angle between the two faces at the edge of corners 0 and 1."""
    a = g.cross(g.vec(P[0], P[1]), g.vec(P[0], P[2]))
    b = g.cross(g.vec(P[0], P[1]), g.vec(P[0], P[3]))
    return corners(box(spark, sf_dir)).select("elem", F.round(g.dot(a, b) / (g.norm(a) * g.norm(b)), 9).alias("cosine"))


@query("mesh_periodic_masters", f"WITH {CTE} SELECT vert, CASE WHEN x = 1 THEN vert - n ELSE vert END AS master FROM vertex, dim")
def periodic_masters(spark, sf_dir):
    """Vertices on one side matched to those opposite, by their coordinates across the period."""
    v = box(spark, sf_dir).vertex()
    m = v.where("x = 0").select(F.col("vert").alias("master"), "y", "z")
    match = v.where("x = 1").join(m, ["y", "z"]).select("vert", "master")
    return v.join(match, "vert", "left").select("vert", F.coalesce("master", "vert").alias("master"))


@query("mesh_spanwise_average", f"WITH {CTE} SELECT vert % ((n + 1) * (n + 1)) AS father, count(*) AS sons, round(avg(x * x + z), 9) AS mean FROM vertex, dim GROUP BY 1")
def spanwise_average(spark, sf_dir):
    b = box(spark, sf_dir)
    return b.vertex().groupBy((F.col("vert") % (b.n + 1) ** 2).alias("father")).agg(F.count(F.lit(1)).alias("sons"), F.round(F.avg(F.col("x") * F.col("x") + F.col("z")), 9).alias("mean"))


@query("mesh_extrude", f"WITH {CTE}, f AS (SELECT vert, x, y FROM vertex WHERE z = 0), l AS (SELECT r AS layer FROM range(3) q(r)) SELECT vert * 3 + layer AS vert, x, y, CAST(layer AS DOUBLE) * 0.5 AS z FROM f, l")
def extrude(spark, sf_dir):
    """A flat mesh's vertices copied into layers."""
    flat = box(spark, sf_dir).vertex().where("z = 0")
    return flat.select("vert", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("layer")).select((F.col("vert") * 3 + F.col("layer")).alias("vert"), "x", "y", (F.col("layer").cast("double") * 0.5).alias("z"))


@query("mesh_inertial_bisection", f"WITH {CTE} SELECT 8::BIGINT AS parts, count(*) AS elems, true AS even FROM elem")
def inertial_bisection(spark, sf_dir):
    """Eight parts by recursive bisection along principal axes: their elements in all, and whether none has over three more than another."""
    from facetry.operators import partition

    p = partition.inertial(centroids_of(box(spark, sf_dir)), 3).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return p.agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("elems"), (F.max("n") - F.min("n") <= 3).alias("even"))


@query("mesh_coordinate_bisection", f"WITH {CTE} SELECT 8::BIGINT AS parts, count(*) AS elems, true AS even FROM elem")
def coordinate_bisection(spark, sf_dir):
    """The same, cut across the longest axis of each part's box."""
    from facetry.operators import partition

    p = partition.inertial(centroids_of(box(spark, sf_dir)), 3, by_axis=True).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return p.agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("elems"), (F.max("n") - F.min("n") <= 3).alias("even"))


def centroids_of(b: Box) -> DataFrame:
    """elem, x, y, z, weight."""
    return corners(b).select("elem", *[((P[0][k] + P[1][k] + P[2][k] + P[3][k]) / 4).alias(k) for k in "xyz"], F.lit(1).cast("long").alias("weight"))


@query("mesh_bernstein", "WITH p(i, j, k) AS (SELECT i, j, 3 - i - j FROM range(4) a(i), range(4) b(j) WHERE i + j <= 3) SELECT i, j, k, CAST(round(6 / (CASE i WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 6 END * CASE j WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 6 END * CASE k WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 6 END)) AS BIGINT) AS trinomial, round(6 / (CASE i WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 6 END * CASE j WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 6 END * CASE k WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 6 END) * pow(0.5, i) * pow(0.3, j) * pow(0.2, k), 9) AS value FROM p")
def bernstein(spark, sf_dir):
    """Cubic Bernstein polynomials of a triangle at (0.5, 0.3, 0.2)."""
    r = spark.range(16).select((F.col("id") % 4).alias("i"), F.floor(F.col("id") / 4).alias("j")).where("i + j <= 3").withColumn("k", 3 - F.col("i") - F.col("j"))
    c = F.lit(6) / (F.factorial("i") * F.factorial("j") * F.factorial("k"))
    return r.select("i", "j", "k", F.round(c).cast("long").alias("trinomial"), F.round(c * F.pow(F.lit(0.5), F.col("i")) * F.pow(F.lit(0.3), F.col("j")) * F.pow(F.lit(0.2), F.col("k")), 9).alias("value"))

