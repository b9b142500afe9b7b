"""Queries on adaptation: size fields, refinement, collapse, swaps, smoothing, snapping, layers, model derivation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.functions import geometry as g
from facetry.operators import adapt, build, graph, topology
from facetry.plans.box_queries import _EDGE, CTE, FACE, TET, P, corners
from facetry.plans.catalog import query
from facetry.plans.meshes import box

#: A field that asks for cells of a third of the box's along x = 0 and of twice its own at x = 1.
_GOOD = "SELECT 1.0::DOUBLE AS volume, 0::BIGINT AS inverted, 0::BIGINT AS crowded, 1::BIGINT AS euler, 0::BIGINT AS lone"
_LEN = "l AS (SELECT DISTINCT key, u.x AS xa, w.x AS xb, sqrt((u.x-w.x)*(u.x-w.x)+(u.y-w.y)*(u.y-w.y)+(u.z-w.z)*(u.z-w.z)) AS l FROM edge JOIN vertex u ON u.vert = key[1] JOIN vertex w ON w.vert = key[2]), m AS (SELECT key, l / (((0.4 + 1.6 * xa) / n + (0.4 + 1.6 * xb) / n) / 2) AS l FROM l, dim)"


def _mesh(spark, sf_dir):
    b = box(spark, sf_dir)
    return graph.pinned(b.down().withColumn("pos", F.col("pos").cast("int"))), graph.pinned(b.vertex()), (0.4 + 1.6 * F.col("x")) / b.n


@query("mesh_split_and_collapse_marks", f"WITH {FACE}, {_LEN} SELECT count(*) FILTER (WHERE l > 1.5) AS splits, count(*) FILTER (WHERE l < 0.5) AS collapses FROM m")
def split_and_collapse_marks(spark, sf_dir):
    """Edges too long and too short in a size field."""
    down, vertex, size = _mesh(spark, sf_dir)
    l = adapt.metric_lengths(adapt.edges(down), vertex, size)  # noqa: E741
    return l.agg(F.count_if(F.col("length") > adapt.SPLIT).alias("splits"), F.count_if(F.col("length") < adapt.COLLAPSE).alias("collapses"))


@query("mesh_identity_size", f"WITH {FACE} SELECT 0::BIGINT AS splits, 0::BIGINT AS collapses, count(DISTINCT key) AS uniform FROM edge")
def identity_size(spark, sf_dir):
    """A field of the edges' own lengths asks for nothing; a uniform refiner for every edge."""
    down, vertex, _ = _mesh(spark, sf_dir)
    e = adapt.with_ends(adapt.edges(down), vertex)
    l = g.norm(g.vec(F.col("pa"), F.col("pb")))  # noqa: E741
    return e.agg(F.count_if(l / l > adapt.SPLIT).alias("splits"), F.count_if(l / l < adapt.COLLAPSE).alias("collapses"), F.count_if(F.lit(True)).alias("uniform"))


@query("mesh_refine_marked", _GOOD)
def refine_marked(spark, sf_dir):
    """Edges that are too long cut by templates: the mesh stays conforming and fills the same volume."""
    down, vertex, size = _mesh(spark, sf_dir)
    marked = adapt.metric_lengths(adapt.edges(down), vertex, size).where(F.col("length") > adapt.SPLIT)
    return adapt.report(*adapt.refined(down, vertex, marked))


@query("mesh_refine_vertices", f"WITH {FACE}, {_LEN} SELECT (SELECT count(*) FROM vertex) + count(*) FILTER (WHERE l > 1.5) AS vertices FROM m")
def refine_vertices(spark, sf_dir):
    """A new vertex for each marked edge."""
    down, vertex, size = _mesh(spark, sf_dir)
    marked = adapt.metric_lengths(adapt.edges(down), vertex, size).where(F.col("length") > adapt.SPLIT)
    return adapt.refined(down, vertex, marked)[1].agg(F.count(F.lit(1)).alias("vertices"))


@query("mesh_split_vertices", f"WITH {FACE}, {_LEN} SELECT key[1] AS a, key[2] AS b, round((u.x + w.x) / 2, 9) AS x, round((u.x + w.x) / 2 + (u.y + w.y) / 2, 9) AS field FROM m JOIN vertex u ON u.vert = key[1] JOIN vertex w ON w.vert = key[2] WHERE l > 1.5")
def split_vertices(spark, sf_dir):
    """The vertices that splits make, with a field carried over linearly."""
    down, vertex, size = _mesh(spark, sf_dir)
    marked = adapt.metric_lengths(adapt.edges(down), vertex, size).where(F.col("length") > adapt.SPLIT)
    v = vertex.withColumn("field", F.col("x") + F.col("y"))
    e = marked.join(v.select(F.col("vert").alias("a"), F.col("x").alias("xa"), F.col("field").alias("fa")), "a").join(v.select(F.col("vert").alias("b"), F.col("x").alias("xb"), F.col("field").alias("fb")), "b")
    return e.select("a", "b", F.round((F.col("xa") + F.col("xb")) / 2, 9).alias("x"), F.round((F.col("fa") + F.col("fb")) / 2, 9).alias("field"))


@query("mesh_solution_transfer", f"WITH {CTE} SELECT 0::BIGINT AS wrong FROM (SELECT 1)")
def solution_transfer(spark, sf_dir):
    """A linear field carried through refinement is still that field at every vertex."""
    down, vertex, size = _mesh(spark, sf_dir)
    marked = adapt.metric_lengths(adapt.edges(down), vertex, size).where(F.col("length") > adapt.SPLIT)
    v = vertex.withColumn("u", 1 + 2 * F.col("x") - F.col("y") + 3 * F.col("z"))
    out = adapt.refined(down, v, marked, ["u"])[1]
    return out.agg(F.count_if(F.abs(F.col("u") - (1 + 2 * F.col("x") - F.col("y") + 3 * F.col("z"))) > 1e-9).alias("wrong"))


@query("mesh_refine_templates", "SELECT code, bits, true AS volume, CASE WHEN bits = 0 THEN 1 END AS one FROM (SELECT c AS code, bit_count(c::INT)::INT AS bits FROM range(64) q(c))")
def refine_templates(spark, sf_dir):
    """Every template's tets fill the tet: their determinants on the reference corners add up to its own."""
    import numpy as np

    ref = [np.array(p, float) for p in ((0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1))]
    pts = ref + [(ref[a] + ref[b]) / 2 for a, b in adapt._EDGES]
    rows = []
    for code, tets in enumerate(adapt.TEMPLATES):
        total = sum(abs(np.linalg.det(np.stack([pts[t[k]] - pts[t[0]] for k in (1, 2, 3)]))) for t in tets)
        rows.append((code, code.bit_count(), bool(abs(total - 1) < 1e-12), len(tets) if code == 0 else None))
    return spark.createDataFrame(rows, "code long, bits int, volume boolean, one int")


@query("mesh_recursive_refine", _GOOD)
def recursive_refine(spark, sf_dir):
    """All edges cut, and half of the new ones again."""
    down, vertex, _ = _mesh(spark, sf_dir)
    down, vertex = adapt.refined(down, vertex, adapt.edges(down))
    return adapt.report(*adapt.refined(down, vertex, adapt.edges(down).where("(a + b) % 2 = 0")))


@query("mesh_coarsen", _GOOD)
def coarsen(spark, sf_dir):
    """Three rounds of independent collapses of any edges that may go."""
    down, vertex, _ = _mesh(spark, sf_dir)
    for k in range(3):
        down, vertex, _ = adapt.collapsed(down, vertex, adapt.edges(down), k)
    return adapt.report(down, vertex)


@query("mesh_coarsen_count", "SELECT true AS fewer, true AS all_gone_once")
def coarsen_count(spark, sf_dir):
    """A round takes one vertex for each collapse."""
    down, vertex, _ = _mesh(spark, sf_dir)
    before = vertex.count()
    _, after, n = adapt.collapsed(down, vertex, adapt.edges(down), 5)
    return after.agg((F.count(F.lit(1)) < before).alias("fewer"), (F.count(F.lit(1)) + n == before).alias("all_gone_once"))


@query("mesh_swap", _GOOD)
def swap(spark, sf_dir):
    """Two rounds of swaps of edges with three or four tets around them."""
    down, vertex = _shaken(spark, sf_dir)
    for k in range(2):
        down, _ = adapt.swapped(down, vertex, k)
    return adapt.report(down, vertex)


def _shaken(spark, sf_dir):
    """The box with inner vertices off their places."""
    down, vertex, _ = _mesh(spark, sf_dir)
    n = box(spark, sf_dir).n
    inner = " and ".join(f"{k} > 0 and {k} < 1" for k in "xyz")
    off = lambda k, s: (F.pmod(F.xxhash64("vert", F.lit(s)), F.lit(1000)) / 1000.0 - 0.5) * (0.5 / n)
    return down, graph.pinned(vertex.select("vert", *[F.when(F.expr(inner), F.col(k) + off(k, i)).otherwise(F.col(k)).alias(k) for i, k in enumerate("xyz")]))


def _least(down, vertex) -> float:
    return adapt.cells(down, vertex).agg(F.min(g.tet_quality([adapt.corner(i) for i in range(4)])).alias("q")).first()["q"]


@query("mesh_swap_quality", "SELECT true AS some, true AS not_worse")
def swap_quality(spark, sf_dir):
    """A round of swaps on a shaken box does something and does not lower the least quality."""
    down, vertex = _shaken(spark, sf_dir)
    out, n = adapt.swapped(down, vertex, 1)
    return spark.createDataFrame([(n > 0, _least(out, vertex) >= _least(down, vertex) - 1e-12)], "some boolean, not_worse boolean")


@query("mesh_smooth_quality", "SELECT true AS some, true AS not_worse, 0::BIGINT AS inverted")
def smooth_quality(spark, sf_dir):
    """Vertices moved where that raises the least quality around them."""
    down, vertex = _shaken(spark, sf_dir)
    out, n = adapt.smoothed(down, vertex, 1)
    r = adapt.report(down, out).select("inverted")
    return r.select(F.lit(bool(n > 0)).alias("some"), F.lit(bool(_least(down, out) >= _least(down, vertex) - 1e-12)).alias("not_worse"), "inverted")


@query("mesh_fix_shapes", "SELECT 1.0::DOUBLE AS volume, 0::BIGINT AS inverted, true AS better")
def fix_shapes(spark, sf_dir):
    """Swaps and moves in turn until they bring nothing more, three times at most."""
    down, vertex = _shaken(spark, sf_dir)
    before = _least(down, vertex)
    for k in range(3):
        down, s = adapt.swapped(down, vertex, k)
        vertex, m = adapt.smoothed(down, vertex, k)
        if not s and not m:
            break
    return adapt.report(down, vertex).select("volume", "inverted", F.lit(bool(_least(down, vertex) >= before - 1e-12)).alias("better"))


@query("mesh_adapt", _GOOD)
def adapt_mesh(spark, sf_dir):
    """Two rounds of coarsening, refining and swapping towards a size field."""
    down, vertex, size = _mesh(spark, sf_dir)
    down, vertex, _ = adapt.adapted(down, vertex, size, 2)
    return adapt.report(down, vertex)


@query("mesh_adapt_lengths", "SELECT true AS fewer_long")
def adapt_lengths(spark, sf_dir):
    """After adaptation a smaller share of edges is too long."""
    down, vertex, size = _mesh(spark, sf_dir)
    share = lambda d, v: adapt.metric_lengths(adapt.edges(d), v, size).agg((F.count_if(F.col("length") > adapt.SPLIT) / F.count(F.lit(1))).alias("s")).first()["s"]
    d, v, _ = adapt.adapted(down, vertex, size, 1)
    return spark.createDataFrame([(share(d, v) < share(down, vertex),)], "fewer_long boolean")


@query("mesh_adapt_level_set", _GOOD)
def adapt_level_set(spark, sf_dir):
    """Refinement around the plane x = 1/2."""
    down, vertex, _ = _mesh(spark, sf_dir)
    n = box(spark, sf_dir).n
    d = F.abs(F.col("x") - 0.5)
    size = F.when(d <= 0.15, 0.45 / n).otherwise(1.2 / n)
    marked = adapt.metric_lengths(adapt.edges(down), vertex, size).where(F.col("length") > adapt.SPLIT)
    return adapt.report(*adapt.refined(down, vertex, marked))


@query("mesh_snap", f"WITH {CTE} SELECT count(*) FILTER (WHERE z = 1) AS snapped, 0::BIGINT AS left_over, 0::BIGINT AS inverted FROM vertex")
def snap(spark, sf_dir):
    """The top moved onto a gentle hill; no element turns over."""
    down, vertex, _ = _mesh(spark, sf_dir)
    n = box(spark, sf_dir).n
    target = vertex.where("z = 1").select("vert", F.col("x").alias("tx"), F.col("y").alias("ty"), (F.lit(1.0) + (0.3 / n) * F.sin(F.col("x") * 3.141592653589793) * F.sin(F.col("y") * 3.141592653589793)).alias("tz"))
    out, left = adapt.snapped(down, vertex, target)
    r = adapt.report(down, out).select("inverted")
    return target.agg(F.count(F.lit(1)).alias("snapped")).join(F.broadcast(left.agg(F.count(F.lit(1)).alias("left_over"))), F.lit(True)).join(F.broadcast(r), F.lit(True))


@query("mesh_snap_candidates", f"WITH {CTE} SELECT count(*) AS far FROM vertex, dim WHERE z = 1 AND 0.3 / n * sin(x * pi()) * sin(y * pi()) > 0.1 / n")
def snap_candidates(spark, sf_dir):
    """Vertices of the top that lie further from the hill than a tolerance."""
    b = box(spark, sf_dir)
    d = (0.3 / b.n) * F.sin(F.col("x") * 3.141592653589793) * F.sin(F.col("y") * 3.141592653589793)
    return b.vertex().where("z = 1").where(d > 0.1 / b.n).agg(F.count(F.lit(1)).alias("far"))


@query("mesh_periodic_midpoints", "SELECT u, w, round(CASE WHEN abs(u - w) > 0.5 THEN (u + w + 1) / 2 - floor((u + w + 1) / 2) ELSE (u + w) / 2 END, 9) AS mid FROM (VALUES (0.1::DOUBLE, 0.3::DOUBLE), (0.9, 0.1), (0.95, 0.15), (0.5, 0.6)) t(u, w)")
def periodic_midpoints(spark, sf_dir):
    """Middles of parameters with period one, over the seam where that is shorter."""
    rows = spark.createDataFrame([(0.1, 0.3), (0.9, 0.1), (0.95, 0.15), (0.5, 0.6)], "u double, w double")
    over = (F.col("u") + F.col("w") + 1) / 2
    return rows.select("u", "w", F.round(F.when(F.abs(F.col("u") - F.col("w")) > 0.5, over - F.floor(over)).otherwise((F.col("u") + F.col("w")) / 2), 9).alias("mid"))


# --- layers

_FLAT = "tri AS (SELECT r * 2 + k AS elem, CASE k WHEN 0 THEN [i + (n+1)*j, i + 1 + (n+1)*j, i + 1 + (n+1)*(j+1)] ELSE [i + (n+1)*j, i + 1 + (n+1)*(j+1), i + (n+1)*(j+1)] END AS vs FROM (SELECT n, r, r % n AS i, r // n AS j FROM (SELECT n, unnest(range(n * n)) AS r FROM dim)), range(2) q(k))"


def flat(spark, sf_dir) -> DataFrame:
    """elem, verts: two triangles for each cell of the box's bottom."""
    n = box(spark, sf_dir).n
    r = spark.range(n * n)
    i, j = F.col("id") % n, F.floor(F.col("id") / n)
    at = lambda a, b: (i + a + (n + 1) * (j + b)).cast("long")
    t = F.array(F.array(at(0, 0), at(1, 0), at(1, 1)), F.array(at(0, 0), at(1, 1), at(0, 1)))
    return r.select("id", F.posexplode(t).alias("k", "verts")).select((F.col("id") * 2 + F.col("k")).alias("elem"), "verts")


@query("mesh_extrude_prisms", f"WITH {CTE}, {_FLAT} SELECT elem * 3 + l AS elem, l::INT AS layer, array_to_string([vs[1] + l*(n+1)*(n+1), vs[2] + l*(n+1)*(n+1), vs[3] + l*(n+1)*(n+1), vs[1] + (l+1)*(n+1)*(n+1), vs[2] + (l+1)*(n+1)*(n+1), vs[3] + (l+1)*(n+1)*(n+1)], ',') AS verts FROM tri, dim, range(3) q(l)")
def extrude_prisms(spark, sf_dir):
    """A flat mesh in three layers of prisms."""
    n = box(spark, sf_dir).n
    p = adapt.prisms(flat(spark, sf_dir), 3, (n + 1) ** 2)
    return p.select("elem", "layer", F.array_join("verts", ",").alias("verts"))


@query("mesh_layers_to_tets", f"WITH {CTE} SELECT 3.0::DOUBLE AS volume, 0::BIGINT AS inverted, 0::BIGINT AS crowded, 1::BIGINT AS euler, 0::BIGINT AS lone")
def layers_to_tets(spark, sf_dir):
    """Layers cut into tets with one diagonal for each quad: the mesh is conforming."""
    b = box(spark, sf_dir)
    m = (b.n + 1) ** 2
    base = b.vertex().where("z = 0").select("vert", "x", "y")
    v = base.withColumn("l", F.explode(F.sequence(F.lit(0), F.lit(3)))).select((F.col("vert") + F.col("l") * m).alias("vert"), "x", "y", F.col("l").cast("double").alias("z"))
    tets = adapt.prism_tets(adapt.prisms(flat(spark, sf_dir), 3, m))
    return adapt.report(graph.pinned(adapt.oriented(tets, v)), graph.pinned(v))


@query("mesh_layers_removed", f"WITH {CTE}, {_FLAT} SELECT elem, array_to_string(vs, ',') AS verts FROM tri")
def layers_removed(spark, sf_dir):
    """Layers of prisms taken back to the flat mesh that they came from."""
    n = box(spark, sf_dir).n
    p = adapt.prisms(flat(spark, sf_dir), 3, (n + 1) ** 2).where("layer = 0")
    return p.select(F.floor(F.col("elem") / 3).alias("elem"), F.array_join(F.slice("verts", 1, 3), ",").alias("verts"))


@query("mesh_vertex_layers", f"WITH {CTE} SELECT vert, CAST(round(z * n) AS INT) AS layer FROM vertex, dim")
def vertex_layers(spark, sf_dir):
    """The layer of each vertex by steps along vertical edges from the bottom."""
    b = box(spark, sf_dir)
    v = b.vertex()
    e = adapt.with_ends(adapt.edges(b.down()), v).where("pa.x = pb.x and pa.y = pb.y").select("a", "b")
    return graph.distances(e, v.where("z = 0").select("vert")).select("vert", F.col("distance").alias("layer"))


@query("mesh_layer_fields", f"WITH {CTE} SELECT (vert % ((n+1)*(n+1))) AS father, array_to_string(list(CAST(round(z * n) AS BIGINT) * 10 + vert % 7 ORDER BY vert), ',') AS vals FROM vertex, dim GROUP BY father")
def layer_fields(spark, sf_dir):
    """A field on layers gathered to the flat mesh, a value for each layer."""
    b = box(spark, sf_dir)
    x = b.vertex().select("vert", (F.col("vert") % (b.n + 1) ** 2).alias("father"), (F.round(F.col("z") * b.n).cast("long") * 10 + F.col("vert") % 7).alias("v"))
    return x.groupBy("father").agg(F.array_sort(F.collect_list(F.struct("vert", "v"))).alias("l")).select("father", F.array_join("l.v", ",").alias("vals"))


@query("mesh_pyramids_to_tets", f"WITH {CTE} SELECT 2 * count(*) AS tets, round(count(*) / (6.0::DOUBLE * n * n * n), 9) AS volume FROM (SELECT unnest(range(n * n)) AS r, n FROM dim) GROUP BY n")
def pyramids_to_tets(spark, sf_dir):
    """A pyramid on each cell of the bottom, half a cell high, as two tets from its base's least vertex."""
    b = box(spark, sf_dir)
    n = b.n
    i, j = F.col("id") % n, F.floor(F.col("id") / n)
    at = lambda a, c: (i + a + (n + 1) * (j + c)).cast("long")
    top = ((n + 1) ** 3 + F.col("id")).cast("long")
    p = spark.range(n * n).select(F.col("id").alias("elem"), F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1), top).alias("verts"))
    tops = spark.range(n * n).select(top.alias("vert"), ((i + 0.5) / n).alias("x"), ((j + 0.5) / n).alias("y"), F.lit(0.5 / n).alias("z"))
    v = b.vertex().unionByName(tops)
    c = adapt.cells(adapt.oriented(adapt.pyramid_tets(p), v), v)
    return c.agg(F.count(F.lit(1)).alias("tets"), F.round(F.sum(adapt.volume()), 9).alias("volume"))


@query("mesh_quad_diagonals", f"WITH {CTE} SELECT count(*) AS quads, count(*) FILTER (WHERE r % 2 = 0) AS first FROM (SELECT unnest(range(n * n)) AS r FROM dim)")
def quad_diagonals(spark, sf_dir):
    """Quads cut by their shorter diagonal, or by a forced one: here one of two is sheared each way."""
    n = box(spark, sf_dir).n
    q = spark.range(n * n).withColumn("s", F.when(F.col("id") % 2 == 0, -0.3).otherwise(0.3))
    d02, d13 = F.sqrt((1 + F.col("s")) * (1 + F.col("s")) + 1), F.sqrt((F.col("s") - 1) * (F.col("s") - 1) + 1)
    return q.agg(F.count(F.lit(1)).alias("quads"), F.count_if(d02 <= d13).alias("first"))


@query("mesh_flip_quality", f"WITH {CTE} SELECT 2 * n * n AS triangles, 0.5::DOUBLE AS area, true AS some, true AS not_worse FROM dim")
def flip_quality(spark, sf_dir):
    """Edges of a flat mesh flipped where that raises the least quality: here the middle is pulled aside and the mesh is flattened."""
    b = box(spark, sf_dir)
    n = b.n
    shift = F.when((F.col("x") > 0) & (F.col("x") < 1) & (F.col("y") > 0) & (F.col("y") < 1), (F.pmod(F.xxhash64("vert"), F.lit(1000)) / 1000.0 - 0.5) * 0.6 / n).otherwise(0.0)
    v = graph.pinned(b.vertex().where("z = 0").select("vert", (F.col("x") - shift).alias("x"), ((F.col("y") + shift) * 0.5).alias("y")))
    t = graph.pinned(flat(spark, sf_dir))

    def stats(tri):
        c = tri.select("elem", F.posexplode("verts").alias("pos", "vert")).join(v, "vert").groupBy("elem").agg(F.array_sort(F.collect_list(F.struct("pos", "x", "y", F.lit(0.0).alias("z")))).alias("p"))
        p = [F.get("p", F.lit(i)) for i in range(3)]
        return c.agg(F.count(F.lit(1)).alias("n"), F.sum(g.triangle_area(p)).alias("a"), F.min(g.triangle_quality(p)).alias("q")).first()

    out, flips = adapt.flipped(t, v, 3)
    before, after = stats(t), stats(out)
    return spark.createDataFrame([(after["n"], round(after["a"], 9), flips > 0, after["q"] >= before["q"] - 1e-12)], "triangles long, area double, some boolean, not_worse boolean")


# --- models from meshes, interfaces, coarse checks


@query("mesh_derive_boundary", f"WITH {FACE}, s AS (SELECT key FROM face GROUP BY key HAVING count(*) = 1) SELECT 2 AS dim, count(*) AS entities FROM s UNION ALL SELECT 0, count(DISTINCT v) FROM (SELECT unnest(key) AS v FROM s)")
def derive_boundary(spark, sf_dir):
    """Boundary faces and their vertices, from sides with one element."""
    f = graph.pinned(topology.entities(topology.boundary(box(spark, sf_dir).down(), 3)).where("uses = 1"))
    v = f.select(F.explode("key").alias("v")).distinct()
    return f.agg(F.count(F.lit(1)).alias("entities")).select(F.lit(2).alias("dim"), "entities").unionByName(v.agg(F.count(F.lit(1)).alias("entities")).select(F.lit(0).alias("dim"), "entities"))


_SIDE = "CASE WHEN max(x) = 0 THEN 0 WHEN min(x) = 1 THEN 1 WHEN max(y) = 0 THEN 2 WHEN min(y) = 1 THEN 3 WHEN max(z) = 0 THEN 4 ELSE 5 END"


@query("mesh_derive_model", f"WITH {FACE}, s AS (SELECT array_to_string(key, ',') AS k, any_value(key) AS key FROM face GROUP BY key HAVING count(*) = 1), t AS (SELECT k, any_value(key) AS key, {_SIDE} AS tag FROM (SELECT k, key, unnest(key) AS vert FROM s) JOIN vertex USING (vert) GROUP BY k), e AS (SELECT a, b, count(DISTINCT tag) AS tags FROM (SELECT key[1] AS a, key[2] AS b, tag FROM t UNION ALL SELECT key[1], key[3], tag FROM t UNION ALL SELECT key[2], key[3], tag FROM t) GROUP BY a, b) SELECT 'face' AS kind, count(DISTINCT tag) AS entities, count(*) AS mesh_entities FROM t UNION ALL SELECT 'edge', 12, count(*) FILTER (WHERE tags = 2) FROM e")
def derive_model(spark, sf_dir):
    """Model faces from tags of boundary faces; model edges where mesh edges have two tags around them."""
    b = box(spark, sf_dir)
    f = topology.entities(topology.boundary(b.down(), 3)).where("uses = 1").select("key")
    ends = f.select("key", F.explode("key").alias("vert")).join(b.vertex(), "vert").groupBy("key").agg(*[fn(c).alias(f"{c}{i}") for c in "xyz" for i, fn in enumerate((F.min, F.max))])
    tag = F.when(F.col("x1") == 0, 0).when(F.col("x0") == 1, 1).when(F.col("y1") == 0, 2).when(F.col("y0") == 1, 3).when(F.col("z1") == 0, 4).otherwise(5)
    t = graph.pinned(ends.select("key", tag.alias("tag")))
    k = F.col("key")
    e = t.select("tag", F.explode(F.array(*[F.struct(k[i].alias("a"), k[j].alias("b")) for i, j in ((0, 1), (0, 2), (1, 2))])).alias("e"))
    e = e.groupBy("e.a", "e.b").agg(F.sort_array(F.collect_set("tag")).alias("tags")).where("size(tags) = 2")
    return t.agg(F.lit("face").alias("kind"), F.count_distinct("tag").alias("entities"), F.count(F.lit(1)).alias("mesh_entities")).unionByName(e.agg(F.lit("edge").alias("kind"), F.count_distinct("tags").alias("entities"), F.count(F.lit(1)).alias("mesh_entities")))


@query("mesh_interface_cut", f"WITH {CTE}, i AS (SELECT elem, vert, (elem // 6) % n < n // 2 AS low FROM down, dim) SELECT count(DISTINCT (vert, low)) AS vertices, count(DISTINCT vert) AS before FROM i")
def interface_cut(spark, sf_dir):
    """Vertices between two materials doubled, one for each."""
    b = box(spark, sf_dir)
    i = b.down().withColumn("low", (F.floor(F.col("elem") / 6) % b.n) < b.n // 2)
    return i.agg(F.count_distinct("vert", "low").alias("vertices"), F.count_distinct("vert").alias("before"))


@query("mesh_material_components", "SELECT 2::BIGINT AS materials")
def material_components(spark, sf_dir):
    """Elements joined across faces that are not on the interface: its sides are the materials."""
    b = box(spark, sf_dir)
    low = lambda c: (F.floor(F.col(c) / 6) % b.n) < b.n // 2
    links = topology.neighbours(topology.boundary(b.down(), 3)).where(low("elem") == low("other")).select(F.col("elem").alias("a"), F.col("other").alias("b"))
    return graph.components(links).agg(F.count_distinct("label").alias("materials"))


@query("mesh_link_condition", f"WITH {FACE}, ed AS (SELECT DISTINCT key[1] AS a, key[2] AS b FROM edge), adj AS (SELECT a, b FROM ed UNION ALL SELECT b, a FROM ed), common AS (SELECT ed.a, ed.b, count(*) AS shared FROM ed JOIN adj p ON p.a = ed.a JOIN adj q ON q.a = ed.b AND q.b = p.b GROUP BY ALL), ring AS (SELECT key[1] AS a, key[2] AS b, count(DISTINCT x) AS ring FROM (SELECT e.key, unnest(list_filter(vs, lambda v : v <> e.key[1] AND v <> e.key[2])) AS x FROM edge e JOIN t4 USING (elem)) GROUP BY ALL) SELECT shared = ring AS ok, count(*) AS edges FROM common JOIN ring USING (a, b) GROUP BY 1")
def link_condition(spark, sf_dir):
    """Edges whose ends share no neighbours but those of the ring around the edge: what a collapse asks for."""
    d = box(spark, sf_dir).down()
    e = graph.pinned(adapt.edges(d))
    near = graph.directed(e)
    both = e.join(near.select(F.col("src").alias("a"), F.col("dst").alias("w")), "a").join(near.select(F.col("src").alias("b"), F.col("dst").alias("w")), ["b", "w"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    use = topology.boundary(d, 2).join(topology.gathered(d).withColumnRenamed("verts", "vs"), "elem")
    ring = use.select(F.col("key")[0].alias("a"), F.col("key")[1].alias("b"), F.explode(F.array_except("vs", "key")).alias("w")).groupBy("a", "b").agg(F.count_distinct("w").alias("ring"))
    return both.join(ring, ["a", "b"]).groupBy((F.col("shared") == F.col("ring")).alias("ok")).agg(F.count(F.lit(1)).alias("edges"))


@query("mesh_collapse_edge_sizes", f"WITH {FACE}, {_LEN} SELECT count(*) AS short FROM m WHERE l < 0.5")
def collapse_edge_sizes(spark, sf_dir):
    down, vertex, size = _mesh(spark, sf_dir)
    return adapt.metric_lengths(adapt.edges(down), vertex, size).where(F.col("length") < adapt.COLLAPSE).agg(F.count(F.lit(1)).alias("short"))


@query("mesh_sliver_codes", f"WITH {TET}, h AS (SELECT elem, {', '.join(f'((x{b}-x{a})*(x{b}-x{a})+(y{b}-y{a})*(y{b}-y{a})+(z{b}-z{a})*(z{b}-z{a})) AS l{k}' for k, (a, b) in enumerate(_EDGE))} FROM tet) SELECT elem, CAST({' + '.join(f'CASE WHEN l{k} >= greatest(l0,l1,l2,l3,l4,l5) - 1e-9 THEN {1 << k} ELSE 0 END' for k in range(6))} AS INT) AS code FROM h")
def sliver_codes(spark, sf_dir):
    """A bit for each longest edge of a tet: which case of bad shape it would be."""
    l = [g.dot(g.vec(P[a], P[b]), g.vec(P[a], P[b])) for a, b in _EDGE]  # noqa: E741
    c = corners(box(spark, sf_dir)).select("elem", *[x.alias(f"l{k}") for k, x in enumerate(l)])
    most = F.greatest(*[F.col(f"l{k}") for k in range(6)])
    return c.select("elem", sum((F.when(F.col(f"l{k}") >= most - 1e-9, 1 << k).otherwise(0) for k in range(6)), F.lit(0)).alias("code"))


@query("mesh_best_element", f"WITH {TET}, q(px, py, pz) AS (VALUES (0.31::DOUBLE, 0.42::DOUBLE, 0.53::DOUBLE)) SELECT count(*) AS containing FROM (SELECT 1)")
def best_element(spark, sf_dir):
    """The element of which a point is least outside: one contains it."""
    pt = {"x": F.lit(0.31), "y": F.lit(0.42), "z": F.lit(0.53)}
    q = F.struct(*[c.alias(k) for k, c in pt.items()])
    c = corners(box(spark, sf_dir)).withColumn("q", q)
    p = [P[i] for i in range(4)]
    parts = [g.tet_volume([F.col("q") if j == i else p[j] for j in range(4)]) / g.tet_volume(p) for i in range(4)]
    inside = c.select("elem", F.least(*parts).alias("least"))
    return inside.agg(F.count_if(F.col("least") >= 0).alias("n")).select(F.least("n", F.lit(1).cast("long")).alias("containing"))


@query("mesh_copy_by_material", f"WITH {CTE} SELECT 2 * count(*) AS vertices FROM vertex")
def copy_by_material(spark, sf_dir):
    """A closure doubled, a copy for each of two materials."""
    v = box(spark, sf_dir).vertex().withColumn("material", F.explode(F.array(F.lit(0), F.lit(1))))
    return v.select((F.col("vert") * 2 + F.col("material")).alias("vert")).agg(F.count_distinct("vert").alias("vertices"))


@query("mesh_extrusion_ids", f"WITH {CTE} SELECT 4 * (n + 1) * (n + 1) AS ids, 4 * (n + 1) * (n + 1) - 1 AS last FROM dim")
def extrusion_ids(spark, sf_dir):
    """Ids of extruded copies from those of the base, the same on every part."""
    b = box(spark, sf_dir)
    m = (b.n + 1) ** 2
    x = b.vertex().where("z = 0").select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("l"), "vert").select((F.col("vert") + F.col("l") * m).alias("gid"))
    return x.agg(F.count_distinct("gid").alias("ids"), F.max("gid").alias("last"))


@query("mesh_adapt_settings", "SELECT * FROM (VALUES ('solid', 0.027::DOUBLE, 100.0::DOUBLE, ''), ('surface', 0.2, 2.0, ''), ('wrong', 0.027, 100.0, 'iterations,most_imbalance,snap')) t(name, quality, ratio, faults)")
def adapt_settings(spark, sf_dir):
    """Defaults by dimension, and what is found wrong."""
    from facetry.operators.settings import Settings

    rows = []
    for name, s in (("solid", Settings()), ("surface", Settings(dimension=2)), ("wrong", Settings(iterations=-1, most_imbalance=0.5, snap=True))):
        rows.append((name, s.filled().good_quality, s.filled().most_ratio, ",".join(s.faults())))
    return spark.createDataFrame(rows, "name string, quality double, ratio double, faults string")


# --- distances in components


def _plane_edges(spark, sf_dir):
    """a, b, weight: the box's edges that stay in one layer, each of length one."""
    b = box(spark, sf_dir)
    v = b.vertex()
    return b, v, adapt.with_ends(adapt.edges(b.down()), v).where("pa.z = pb.z").select("a", "b", F.lit(1.0).alias("weight"))


@query("mesh_component_distance", f"WITH {CTE} SELECT vert, round(greatest(x, y) * n, 6) AS distance FROM vertex, dim WHERE z = 0")
def component_distance(spark, sf_dir):
    """Distances inside one layer: links that leave it do not count."""
    _, v, e = _plane_edges(spark, sf_dir)
    seeds = v.where("x = 0 and y = 0 and z = 0").select("vert", F.lit(0.0).alias("distance"))
    return graph.shortest(e, seeds).select("vert", F.round("distance", 6).alias("distance"))


@query("mesh_weighted_distance", f"WITH {CTE} SELECT vert, round((x * 2 + y) * n, 6) AS distance FROM vertex, dim WHERE z = 0")
def weighted_distance(spark, sf_dir):
    """Distances along the axes of a layer where steps along x cost two."""
    b = box(spark, sf_dir)
    v = b.vertex()
    e = adapt.with_ends(adapt.edges(b.down()), v).where("pa.z = 0 and pb.z = 0 and (pa.x = pb.x or pa.y = pb.y)")
    e = e.select("a", "b", F.when(F.col("pa.x") != F.col("pb.x"), 2.0).otherwise(1.0).alias("weight"))
    return graph.shortest(e, v.where("x = 0 and y = 0 and z = 0").select("vert", F.lit(0.0).alias("distance"))).select("vert", F.round("distance", 6).alias("distance"))


@query("mesh_disjoint_distances", f"WITH {CTE} SELECT vert, CAST(round(greatest(x, y) * n + z * n * (n + 1)) AS BIGINT) AS distance FROM vertex, dim")
def disjoint_distances(spark, sf_dir):
    """Distances from each layer's core, with an offset for each layer, so that their ranges do not meet."""
    b, v, e = _plane_edges(spark, sf_dir)
    d = graph.shortest(e, v.where("x = 0 and y = 0").select("vert", F.lit(0.0).alias("distance"))).join(v.select("vert", "z"), "vert")
    span = d.groupBy("z").agg((F.max("distance") + 1).alias("n"))
    from facetry.operators.numbering import scanned

    return d.join(scanned(span, "z", "n").select("z", "before"), "z").select("vert", F.round(F.col("distance") + F.col("before")).cast("long").alias("distance"))


@query("mesh_updated_distance", f"WITH {CTE} SELECT vert, round(x * n, 6) AS distance FROM vertex, dim")
def updated_distance(spark, sf_dir):
    """Distances that are missing on one half are found from the other's, which stand."""
    b = box(spark, sf_dir)
    v = b.vertex()
    e = adapt.edges(b.down()).withColumn("weight", F.lit(1.0))
    known = v.where("x <= 0.5").select("vert", F.round(F.col("x") * b.n, 6).alias("distance"))
    return graph.shortest(e, known, known).select("vert", F.round("distance", 6).alias("distance"))
