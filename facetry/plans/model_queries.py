"""Queries on the box's model, on matched and moved meshes, and on tensors and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetry.functions import geometry as g
from facetry.operators import graph, numbering, topology
from facetry.plans.box_queries import CTE, FACE, P, REP, TET, corners
from facetry.plans.catalog import query
from facetry.plans.meshes import box

#: The box's 27 model entities: each side of each axis is 0 (low), 1 (free) or 2 (high).
MODEL = "m AS (SELECT r AS tag, r % 3 AS a, (r // 3) % 3 AS b, r // 9 AS c, CAST((r % 3 = 1)::INT + ((r // 3) % 3 = 1)::INT + (r // 9 = 1)::INT AS INT) AS dim FROM range(27) q(r)),\nclosure AS (SELECT e.tag, e.dim, t.tag AS target, t.dim AS target_dim FROM m e JOIN m t ON (t.a = 1 OR t.a = e.a) AND (t.b = 1 OR t.b = e.b) AND (t.c = 1 OR t.c = e.c))"


def model(spark) -> DataFrame:
    r = F.col("id")
    axes = (r % 3).alias("a"), (F.floor(r / 3) % 3).alias("b"), F.floor(r / 9).alias("c")
    return spark.range(27).select(r.alias("tag"), *axes).withColumn("dim", sum((F.when(F.col(k) == 1, 1).otherwise(0) for k in "abc"), F.lit(0)))


def closure(spark) -> DataFrame:
    """tag, dim, target, target_dim: each entity and those whose closure it lies in, by expanding its fixed axes (8 at most)."""
    m = model(spark)
    up = lambda c: F.when(F.col(c) == 1, F.array(F.lit(1).cast("long"))).otherwise(F.array(F.col(c).cast("long"), F.lit(1).cast("long")))
    x = m.withColumn("x", F.explode(up("a"))).withColumn("y", F.explode(up("b"))).withColumn("z", F.explode(up("c")))
    free = sum((F.when(F.col(k) == 1, 1).otherwise(0) for k in "xyz"), F.lit(0))
    return x.select("tag", "dim", (F.col("x") + 3 * F.col("y") + 9 * F.col("z")).alias("target"), free.alias("target_dim"))


def _classified(spark, sf_dir) -> DataFrame:
    side = lambda c: F.when(F.col(c) == 0, 0).when(F.col(c) == 1, 2).otherwise(1)
    return box(spark, sf_dir).vertex().withColumn("tag", (side("x") + 3 * side("y") + 9 * side("z")).cast("long"))


_CLASS = "cls AS (SELECT *, (CASE x WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END) + 3 * (CASE y WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END) + 9 * (CASE z WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END) AS tag FROM vertex)"


@query("mesh_model_entities", f"WITH {MODEL} SELECT tag, dim FROM m")
def model_entities(spark, sf_dir):
    return model(spark).select("tag", "dim")


@query("mesh_model_closure", f"WITH {MODEL} SELECT tag, dim, target, target_dim FROM closure")
def model_closure(spark, sf_dir):
    return closure(spark)


@query("mesh_model_adjacency", f"WITH {MODEL} SELECT dim AS from_dim, target_dim AS to_dim, count(*) AS pairs FROM closure WHERE target_dim = dim + 1 GROUP BY ALL")
def model_adjacency(spark, sf_dir):
    return closure(spark).where("target_dim = dim + 1").groupBy(F.col("dim").alias("from_dim"), F.col("target_dim").alias("to_dim")).agg(F.count(F.lit(1)).alias("pairs"))


@query("mesh_nodes_on_closure", f"WITH {CTE}, {MODEL}, {_CLASS} SELECT target, count(*) AS nodes FROM cls JOIN closure USING (tag) WHERE target_dim = 2 GROUP BY target")
def nodes_on_closure(spark, sf_dir):
    """Vertices in the closure of each model face."""
    c = F.broadcast(closure(spark).where("target_dim = 2"))
    return _classified(spark, sf_dir).join(c, "tag").groupBy("target").agg(F.count(F.lit(1)).alias("nodes"))


@query("mesh_count_on_model", f"WITH {CTE}, {_CLASS} SELECT tag, count(*) AS n FROM cls GROUP BY tag")
def count_on_model(spark, sf_dir):
    """Vertices classified exactly on each model entity."""
    return _classified(spark, sf_dir).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("mesh_condition_inheritance", f"WITH {CTE}, {MODEL}, {_CLASS}, bc(target, value) AS (VALUES (4, 1.0::DOUBLE), (22, 2.0::DOUBLE), (12, 3.0::DOUBLE)) SELECT vert, count(*) AS conditions, max(value) AS value FROM cls JOIN closure USING (tag) JOIN bc USING (target) GROUP BY vert")
def condition_inheritance(spark, sf_dir):
    """Conditions on model faces reach all that is classified in their closure."""
    bc = F.broadcast(spark.sql("SELECT * FROM VALUES (4L, 1.0D), (22L, 2.0D), (12L, 3.0D) AS t(target, value)"))
    reach = F.broadcast(closure(spark).join(bc, "target"))
    return _classified(spark, sf_dir).join(reach, "tag").groupBy("vert").agg(F.count(F.lit(1)).alias("conditions"), F.max("value").alias("value"))


@query("mesh_match_groups", f"WITH {CTE} SELECT vert, (CASE WHEN x = 1 THEN vert - n ELSE vert END) - (CASE WHEN y = 1 THEN n * (n + 1) ELSE 0 END) AS grp FROM vertex, dim")
def match_groups(spark, sf_dir):
    """Groups of a mesh periodic along x and y: components of its matches."""
    v = box(spark, sf_dir).vertex()
    mx = v.where("x = 0").select(F.col("vert").alias("b"), "y", "z").join(v.where("x = 1").select(F.col("vert").alias("a"), "y", "z"), ["y", "z"]).select("a", "b")
    my = v.where("y = 0").select(F.col("vert").alias("b"), "x", "z").join(v.where("y = 1").select(F.col("vert").alias("a"), "x", "z"), ["x", "z"]).select("a", "b")
    c = graph.components(mx.union(my))
    return v.join(c, v["vert"] == c["node"], "left").select("vert", F.coalesce("label", "vert").alias("grp"))


@query("mesh_duplicate_matches", f"WITH {CTE}, x AS (SELECT vert, vert % (n + 1) AS k FROM vertex, dim) SELECT k, count(*) - 1 AS repeats FROM x GROUP BY k HAVING count(*) > 1")
def duplicate_matches(spark, sf_dir):
    b = box(spark, sf_dir)
    return b.vertex().groupBy((F.col("vert") % (b.n + 1)).alias("k")).agg((F.count(F.lit(1)) - 1).alias("repeats")).where("repeats > 0")


@query("mesh_part_centroids", f"WITH {TET} SELECT part, round(sum(v * (x0+x1+x2+x3) / 4) / sum(v), 9) AS cx, round(sum(v * (y0+y1+y2+y3) / 4) / sum(v), 9) AS cy, round(sum(v), 9) AS volume FROM vol JOIN elem USING (elem) GROUP BY part")
def part_centroids(spark, sf_dir):
    b = box(spark, sf_dir)
    mean = lambda c: (P[0][c] + P[1][c] + P[2][c] + P[3][c]) / 4
    x = corners(b).select("elem", g.tet_volume(P).alias("v"), mean("x").alias("x"), mean("y").alias("y")).join(b.elem(), "elem")
    over = lambda c: F.round(F.sum(F.col("v") * F.col(c)) / F.sum("v"), 9)
    return x.groupBy("part").agg(over("x").alias("cx"), over("y").alias("cy"), F.round(F.sum("v"), 9).alias("volume"))


@query("mesh_element_moments", f"WITH {TET}, c AS (SELECT v, (x0+x1+x2+x3)/4 AS x, (y0+y1+y2+y3)/4 AS y FROM vol) SELECT round(sum(v*x*x)/sum(v) - pow(sum(v*x)/sum(v), 2), 9) AS xx, round(sum(v*x*y)/sum(v) - sum(v*x)/sum(v) * sum(v*y)/sum(v), 9) AS xy FROM c")
def element_moments(spark, sf_dir):
    mean = lambda c: (P[0][c] + P[1][c] + P[2][c] + P[3][c]) / 4
    c = corners(box(spark, sf_dir)).select(g.tet_volume(P).alias("v"), mean("x").alias("x"), mean("y").alias("y"))
    e = lambda expr: F.sum(F.col("v") * expr) / F.sum("v")
    x, y = F.col("x"), F.col("y")
    return c.agg(F.round(e(x * x) - F.pow(e(x), F.lit(2)), 9).alias("xx"), F.round(e(x * y) - e(x) * e(y), 9).alias("xy"))


@query("mesh_metric_volume", f"WITH {TET} SELECT round(sum(v / pow(0.1, 3)), 6) AS total, round(cbrt(sum(v / pow(0.1, 3)) * (sqrt(2.0::DOUBLE) / 12) / 1000), 9) AS scale FROM vol")
def metric_volume(spark, sf_dir):
    """Volume in the metric of one size, and the scale that would give a thousand perfect tets."""
    t = F.sum(g.tet_volume(P) / F.pow(F.lit(0.1), F.lit(3)))
    return corners(box(spark, sf_dir)).agg(F.round(t, 6).alias("total"), F.round(F.cbrt(t * (2.0**0.5 / 12) / 1000), 9).alias("scale"))


@query("mesh_predicted_weights", f"WITH {TET}, p AS (SELECT elem, greatest(1.0 / 64, least(64.0, v / pow(0.05 + 0.1 * (x0+x1+x2+x3)/4, 3)))::DOUBLE AS w FROM vol) SELECT part, round(sum(w), 6) AS weight FROM p JOIN elem USING (elem) GROUP BY part")
def predicted_weights(spark, sf_dir):
    """Elements that refinement will make, clamped to one level each way twice over."""
    b = box(spark, sf_dir)
    h = 0.05 + 0.1 * (P[0]["x"] + P[1]["x"] + P[2]["x"] + P[3]["x"]) / 4
    w = F.greatest(F.lit(1.0 / 64), F.least(F.lit(64.0), g.tet_volume(P) / F.pow(h, F.lit(3))))
    return corners(b).select("elem", w.alias("w")).join(b.elem(), "elem").groupBy("part").agg(F.round(F.sum("w"), 6).alias("weight"))


@query("mesh_barycentric_inverse", f"WITH {TET} SELECT count(*) AS holders FROM vol WHERE " + " AND ".join("(" + e + ") >= -1e-12" for e in (
    "((x1-0.3)*((y2-0.4)*(z3-0.6)-(z2-0.6)*(y3-0.4)) - (y1-0.4)*((x2-0.3)*(z3-0.6)-(z2-0.6)*(x3-0.3)) + (z1-0.6)*((x2-0.3)*(y3-0.4)-(y2-0.4)*(x3-0.3)))",
    "-((x0-0.3)*((y2-0.4)*(z3-0.6)-(z2-0.6)*(y3-0.4)) - (y0-0.4)*((x2-0.3)*(z3-0.6)-(z2-0.6)*(x3-0.3)) + (z0-0.6)*((x2-0.3)*(y3-0.4)-(y2-0.4)*(x3-0.3)))",
    "((x0-0.3)*((y1-0.4)*(z3-0.6)-(z1-0.6)*(y3-0.4)) - (y0-0.4)*((x1-0.3)*(z3-0.6)-(z1-0.6)*(x3-0.3)) + (z0-0.6)*((x1-0.3)*(y3-0.4)-(y1-0.4)*(x3-0.3)))",
    "-((x0-0.3)*((y1-0.4)*(z2-0.6)-(z1-0.6)*(y2-0.4)) - (y0-0.4)*((x1-0.3)*(z2-0.6)-(z1-0.6)*(x2-0.3)) + (z0-0.6)*((x1-0.3)*(y2-0.4)-(y1-0.4)*(x2-0.3)))",
)))
def barycentric_inverse(spark, sf_dir):
    """Tets that hold a point: those in which all its barycentric coordinates are not negative."""
    at = F.struct(F.lit(0.3).alias("x"), F.lit(0.4).alias("y"), F.lit(0.6).alias("z"))
    inside = F.lit(True)
    for i in range(4):
        inside = inside & (g.tet_volume([at if k == i else P[k] for k in range(4)]) >= -1e-12 / 6)
    return corners(box(spark, sf_dir)).where(inside).agg(F.count(F.lit(1)).alias("holders"))


@query("mesh_point_segment_distance", f"WITH {CTE}, t AS (SELECT vert, x, y, z, greatest(0.0, least(1.0, (x + y) / 2))::DOUBLE AS t FROM vertex) SELECT vert, round(sqrt((x-t)*(x-t)+(y-t)*(y-t)+z*z), 9) AS distance FROM t")
def point_segment_distance(spark, sf_dir):
    """To the segment from the origin to (1, 1, 0)."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("x") + F.col("y")) / 2))
    v = box(spark, sf_dir).vertex().withColumn("t", t)
    d = F.sqrt((F.col("x") - F.col("t")) * (F.col("x") - F.col("t")) + (F.col("y") - F.col("t")) * (F.col("y") - F.col("t")) + F.col("z") * F.col("z"))
    return v.select("vert", F.round(d, 9).alias("distance"))


@query("mesh_jacobian", f"WITH {TET} SELECT elem, round(6 * v, 9) AS determinant, round(pow(6 * v, 2), 12) AS squared FROM vol")
def jacobian(spark, sf_dir):
    d = 6 * g.tet_volume(P)
    return corners(box(spark, sf_dir)).select("elem", F.round(d, 9).alias("determinant"), F.round(F.pow(d, F.lit(2)), 12).alias("squared"))


@query("mesh_laplacian_smoothing", f"WITH {FACE}, adj AS (SELECT DISTINCT key[1] AS a, key[2] AS b FROM edge UNION SELECT DISTINCT key[2], key[1] FROM edge), f0 AS (SELECT vert, CAST(vert % 7 AS DOUBLE) AS f, (x IN (0, 1) OR y IN (0, 1) OR z IN (0, 1)) AS fixed FROM vertex), " + ", ".join(f"f{k + 1} AS (SELECT s.vert, CASE WHEN any_value(s.fixed) THEN any_value(s.f) ELSE avg(o.f) END AS f, any_value(s.fixed) AS fixed FROM f{k} s JOIN adj ON adj.a = s.vert JOIN f{k} o ON o.vert = adj.b GROUP BY s.vert)" for k in range(3)) + " SELECT vert, round(f, 6) AS f FROM f3")
def laplacian_smoothing(spark, sf_dir):
    """Three rounds in which inner vertices take their neighbours' mean; all vertices of a round see the round before."""
    b = box(spark, sf_dir)
    links = graph.pinned(graph.directed(topology.entities(topology.boundary(b.down(), 2)).select(F.col("key")[0].alias("a"), F.col("key")[1].alias("b"))))
    on = F.col("x").isin(0.0, 1.0) | F.col("y").isin(0.0, 1.0) | F.col("z").isin(0.0, 1.0)
    f = b.vertex().select("vert", (F.col("vert") % 7).cast("double").alias("f"), on.alias("fixed"))
    for _ in range(3):
        mean = links.join(f.select(F.col("vert").alias("dst"), "f"), "dst").groupBy(F.col("src").alias("vert")).agg(F.avg("f").alias("mean"))
        f = graph.pinned(f.join(mean, "vert").select("vert", F.when(F.col("fixed"), F.col("f")).otherwise(F.col("mean")).alias("f"), "fixed"))
    return f.select("vert", F.round("f", 6).alias("f"))


@query("mesh_bfs_order", f"WITH {CTE}, l AS (SELECT vert, CAST(round(greatest(x, y, z) * n) AS INT) AS d FROM vertex, dim) SELECT vert, d AS level, (SELECT count(*) FROM vertex) - row_number() OVER (ORDER BY d, vert) AS number FROM l")
def bfs_order(spark, sf_dir):
    """Numbers downwards in order of breadth-first levels from the first vertex, ties by id."""
    b = box(spark, sf_dir)
    e = topology.entities(topology.boundary(b.down(), 2)).select(F.col("key")[0].alias("a"), F.col("key")[1].alias("b"))
    level = graph.distances(e, spark.range(1).withColumnRenamed("id", "vert"))
    n = b.vertex().groupBy().agg(F.count(F.lit(1)).alias("n")).scalar()
    return numbering.numbered(level, "distance", "vert").select("vert", F.col("distance").alias("level"), (n - 1 - F.col("global_number")).alias("number"))


@query("mesh_matched_owner", f"WITH {REP}, side AS (SELECT r.vert, part, (CASE WHEN r.vert % (dim.n + 1) = dim.n THEN r.vert - dim.n ELSE r.vert END) AS grp FROM replica r, dim) SELECT grp, arg_min(part, (elems, part, vert)) AS owner, arg_min(vert, (elems, part, vert)) AS vert FROM side JOIN load USING (part) GROUP BY grp")
def matched_owner(spark, sf_dir):
    """Of matched vertices one copy owns all: fewest elements, then lowest part, then lowest id."""
    from facetry.operators import replicas

    b = box(spark, sf_dir)
    rep = replicas.replicas(b.down().join(b.elem(), "elem")).withColumn("grp", F.when(F.col("vert") % (b.n + 1) == b.n, F.col("vert") - b.n).otherwise(F.col("vert")))
    x = rep.join(F.broadcast(replicas.part_loads(b.elem()).select("part", "elems")), "part")
    key = F.struct("elems", "part", "vert")
    return x.groupBy("grp").agg(F.min_by("part", key).alias("owner"), F.min_by("vert", key).alias("vert"))


@query("mesh_ghost_weights", f"WITH {REP}, g AS (SELECT DISTINCT a.part, e.elem FROM replica a JOIN down e ON e.vert = a.vert JOIN elem o ON o.elem = e.elem WHERE o.part <> a.part) SELECT part, count(*) AS elems FROM g GROUP BY part")
def ghost_weights(spark, sf_dir):
    """Elements that each part would hold as its first layer of ghosts."""
    b = box(spark, sf_dir)
    return graph.ghosts(b.down(), b.elem(), 1).groupBy("part").agg(F.count(F.lit(1)).alias("elems"))


@query("mesh_collapse_candidates", f"WITH {FACE}, {_CLASS} SELECT key[1] AS a, key[2] AS b FROM (SELECT DISTINCT key FROM edge) JOIN cls u ON u.vert = key[1] JOIN cls w ON w.vert = key[2] WHERE u.tag = 13 OR w.tag = 13")
def collapse_candidates(spark, sf_dir):
    """Edges with an end inside the model region, which may move."""
    e = topology.entities(topology.boundary(box(spark, sf_dir).down(), 2)).select(F.col("key")[0].alias("a"), F.col("key")[1].alias("b"))
    c = _classified(spark, sf_dir).select("vert", "tag")
    x = e.join(c.select(F.col("vert").alias("a"), F.col("tag").alias("ta")), "a").join(c.select(F.col("vert").alias("b"), F.col("tag").alias("tb")), "b")
    return x.where("ta = 13 OR tb = 13").select("a", "b")


@query("mesh_edge_rings", f"WITH {FACE} SELECT ring, count(*) AS edges FROM (SELECT key, count(*) AS ring FROM edge GROUP BY key) GROUP BY ring")
def edge_rings(spark, sf_dir):
    """How many edges have how many tets around them: rings of up to seven can be swapped."""
    return topology.entities(topology.boundary(box(spark, sf_dir).down(), 2)).groupBy(F.col("uses").alias("ring")).agg(F.count(F.lit(1)).alias("edges"))


@query("mesh_vector_algebra", f"WITH {CTE} SELECT vert, round(x * 1 + y * 2 + z * 3, 9) AS dot, round(y * 3 - z * 2, 9) AS cross_x, round(sqrt(x*x + y*y + z*z), 9) AS norm, round((x + 2*y + 3*z) / 14, 9) AS projected FROM vertex")
def vector_algebra(spark, sf_dir):
    u, w = (F.col("x"), F.col("y"), F.col("z")), (F.lit(1.0), F.lit(2.0), F.lit(3.0))
    return box(spark, sf_dir).vertex().select("vert", F.round(g.dot(u, w), 9).alias("dot"), F.round(g.cross(u, w)[0], 9).alias("cross_x"), F.round(g.norm(u), 9).alias("norm"), F.round(g.dot(u, w) / g.dot(w, w), 9).alias("projected"))


@query("mesh_tensor_invariants", f"WITH {CTE}, t AS (SELECT vert, 1 + x AS a, 2 + y AS b, 3 + z AS c, x * y AS d FROM vertex) SELECT vert, round(a + b + c, 9) AS trace, round(c * (a * b - d * d), 9) AS det, round(sqrt(a*a + b*b + c*c + 2*d*d), 9) AS norm FROM t")
def tensor_invariants(spark, sf_dir):
    """Of the symmetric tensor with diagonal 1+x, 2+y, 3+z and xy beside it."""
    a, b, c, d = 1 + F.col("x"), 2 + F.col("y"), 3 + F.col("z"), F.col("x") * F.col("y")
    return box(spark, sf_dir).vertex().select("vert", F.round(a + b + c, 9).alias("trace"), F.round(c * (a * b - d * d), 9).alias("det"), F.round(F.sqrt(a * a + b * b + c * c + 2 * d * d), 9).alias("norm"))


@query("mesh_rigid_motion", f"WITH {CTE} SELECT vert, round(0.5 - (y - 0.5), 9) AS x, round(0.5 + (x - 0.5), 9) AS y, round(z + 1, 9) AS z FROM vertex")
def rigid_motion(spark, sf_dir):
    """A quarter turn about the middle and a shift along z."""
    return box(spark, sf_dir).vertex().select("vert", F.round(0.5 - (F.col("y") - 0.5), 9).alias("x"), F.round(0.5 + (F.col("x") - 0.5), 9).alias("y"), F.round(F.col("z") + 1, 9).alias("z"))


@query("mesh_closest_vertices", f"WITH {CTE}, t(id, px, py, pz) AS (VALUES (1, 0.3::DOUBLE, 0.3::DOUBLE, 0.3::DOUBLE), (2, 0.9::DOUBLE, 0.1::DOUBLE, 0.6::DOUBLE)) SELECT id, arg_min(vert, (round((x-px)*(x-px)+(y-py)*(y-py)+(z-pz)*(z-pz), 9), vert)) AS vert FROM t, vertex GROUP BY id")
def closest_vertices(spark, sf_dir):
    """The nearest vertex of each of a few given points: partial minima in every task."""
    points = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(z).alias("z")) for i, x, y, z in ((1, 0.3, 0.3, 0.3), (2, 0.9, 0.1, 0.6))])
    v = box(spark, sf_dir).vertex().select("vert", F.struct("x", "y", "z").alias("p"), F.explode(points).alias("t"))
    e = g.vec(F.col("t"), F.col("p"))
    return v.groupBy(F.col("t.id").alias("id")).agg(F.min_by("vert", F.struct(F.round(g.dot(e, e), 9), F.col("vert"))).alias("vert"))


@query("mesh_layer_localisation", f"WITH {CTE}, s AS (SELECT elem, part, (elem // 6) % (n * n) AS stack FROM elem, dim), k AS (SELECT stack, min(part) AS to_part FROM s GROUP BY stack) SELECT elem, part, to_part FROM s JOIN k USING (stack)")
def layer_localisation(spark, sf_dir):
    """Elements of a stack along z go to the lowest of its parts."""
    b = box(spark, sf_dir)
    s = b.elem().select("elem", "part", (F.floor(F.col("elem") / 6) % (b.n * b.n)).alias("stack"))
    return s.join(s.groupBy("stack").agg(F.min("part").alias("to_part")), "stack").select("elem", "part", "to_part")


@query("mesh_component_depths", f"WITH RECURSIVE {FACE}, side AS (SELECT elem, array_to_string(key, ',') AS k FROM face), out AS (SELECT min(elem) AS elem FROM side GROUP BY k HAVING count(*) = 1), adj AS MATERIALIZED (SELECT a.elem AS u, b.elem AS v FROM side a JOIN side b ON a.k = b.k AND a.elem <> b.elem), r(elem, d) USING KEY (elem) AS (SELECT DISTINCT elem, 0 FROM out UNION SELECT DISTINCT v, d + 1 FROM r JOIN adj ON u = elem WHERE v NOT IN (SELECT elem FROM recurring.r)) SELECT d AS depth, count(*) AS elems FROM r GROUP BY d")
def component_depths(spark, sf_dir):
    """Elements by their distance, across faces, from the boundary."""
    f = topology.boundary(box(spark, sf_dir).down(), 3)
    both = f.groupBy("key").agg(F.collect_list("elem").alias("e"))
    seeds = both.where(F.size("e") == 1).select(F.col("e")[0].alias("vert"))
    links = both.where(F.size("e") == 2).select(F.col("e")[0].alias("a"), F.col("e")[1].alias("b"))
    return graph.distances(links, seeds).groupBy(F.col("distance").alias("depth")).agg(F.count(F.lit(1)).alias("elems"))


@query("mesh_part_neighbour_colours", "SELECT 0::BIGINT AS violations")
def part_neighbour_colours(spark, sf_dir):
    """Parts of a colour that share a vertex, of a colouring of parts by repeated independent sets."""
    from facetry.operators import replicas

    b = box(spark, sf_dir)
    rep = replicas.replicas(b.down().join(b.elem(), "elem"))
    sets = rep.groupBy("vert").agg(F.collect_set("part").alias("ps"))
    net = graph.pinned(sets.select(F.explode("ps").alias("a"), "ps").select("a", F.explode("ps").alias("b")).where("a < b").distinct())
    c = graph.colouring(net, b.elem().select(F.col("part").alias("vert")).distinct())
    x = net.join(c.select(F.col("vert").alias("a"), F.col("colour").alias("ca")), "a").join(c.select(F.col("vert").alias("b"), F.col("colour").alias("cb")), "b")
    return x.where("ca = cb").agg(F.count(F.lit(1)).alias("violations"))


@query("mesh_cavity_sizes", f"WITH {FACE}, d AS (SELECT vert, count(*) AS n FROM down GROUP BY vert) SELECT n AS size, count(*) AS vertices FROM d GROUP BY n")
def cavity_sizes(spark, sf_dir):
    d = box(spark, sf_dir).down().groupBy("vert").agg(F.count(F.lit(1)).alias("size"))
    return d.groupBy("size").agg(F.count(F.lit(1)).alias("vertices"))


@query("mesh_local_ranks", f"WITH {REP} SELECT part, vert, n, rank() OVER (PARTITION BY part ORDER BY n DESC) AS rank FROM replica")
def local_ranks(spark, sf_dir):
    from facetry.operators import replicas

    b = box(spark, sf_dir)
    rep = replicas.replicas(b.down().join(b.elem(), "elem"))
    per = rep.groupBy("part", "n").agg(F.count(F.lit(1)).alias("k"))  # a row for each value of a part
    first = per.withColumn("rank", F.sum("k").over(Window.partitionBy("part").orderBy(F.col("n").desc())) - F.col("k") + 1).drop("k")
    return rep.join(first, ["part", "n"]).select("part", "vert", "n", "rank")
