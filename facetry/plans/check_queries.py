"""Queries on verification with planted faults, on conditions, and on arrays for solvers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.functions import geometry as g
from facetry.operators import build, conditions, graph, numbering, replicas, topology, verify
from facetry.plans.box_queries import _EDGE, CTE, FACE, REP, TET, P, corners
from facetry.plans.build_queries import MIXED, _SIDES, mixed, sides
from facetry.plans.catalog import query
from facetry.plans.meshes import PARTS, Tables, box

W = "WITH " + Tables.SQL


def _parts(spark, sf_dir):
    b = box(spark, sf_dir)
    return b, graph.pinned(replicas.replicas(b.down().join(b.elem(), "elem")))


def _remotes(rep: DataFrame) -> DataFrame:
    return rep.select("vert", "part").join(rep.select("vert", F.col("part").alias("peer")), "vert").where("part <> peer")


def _none(found: DataFrame) -> DataFrame:
    return found.agg(F.coalesce(F.sum("violations"), F.lit(0)).alias("violations"))


# --- verification


@query("mesh_verify", "SELECT 0::BIGINT AS violations")
def verify_all(spark, sf_dir):
    """All checks on a sound mesh."""
    b, rep = _parts(spark, sf_dir)
    down, v = b.down(), b.vertex()
    xyz = rep.join(v, "vert").select("vert", F.xxhash64("x", "y", "z").alias("at"))
    values = rep.select("vert", "part", F.col("n").alias("value"))
    return _none(verify.summary(
        verify.upward(down), verify.downward(down, v), verify.replicas(rep, _remotes(rep)), verify.agreement(xyz, "vert", "at", "coordinates differ"),
        verify.volumes(down, v), verify.fields(rep, values),
    ))


@query("mesh_verify_faults", f"WITH {CTE} SELECT * FROM (VALUES ('unknown vertex', 1::BIGINT), ('repeated vertex', 1), ('inverted', 1)) t(\"check\", violations)")
def verify_faults(spark, sf_dir):
    """Planted in one element each: a vertex that is not there, one vertex twice, two vertices exchanged."""
    b = box(spark, sf_dir)
    e, p, v = F.col("elem"), F.col("pos"), F.col("vert")
    down = b.down()
    other = down.where("elem = 5 and pos = 1").select(F.col("vert").alias("again")).first()["again"]
    swap = {r["pos"]: r["vert"] for r in down.where("elem = 11").collect()}  # four rows
    bad = F.when((e == 2) & (p == 0), F.lit(10**9)).when((e == 5) & (p == 0), F.lit(other)).when((e == 11) & (p == 2), F.lit(swap[3])).when((e == 11) & (p == 3), F.lit(swap[2])).otherwise(v)
    d = graph.pinned(down.select("elem", "pos", bad.cast("long").alias("vert")))
    whole = d.join(b.vertex().select("vert"), "vert", "left_anti").select("elem").distinct()
    sound = d.join(whole, "elem", "left_anti").where("elem <> 5")
    return verify.summary(verify.downward(d, b.vertex()), verify.upward(d, False), verify.volumes(sound, b.vertex()))


@query("mesh_verify_nonmanifold", "SELECT 'crowded face' AS \"check\", 1::BIGINT AS violations")
def verify_nonmanifold(spark, sf_dir):
    """Three tets on one face."""
    conn = spark.createDataFrame([(0, 0, [0, 1, 2, 3]), (1, 0, [0, 1, 2, 4]), (2, 0, [0, 1, 2, 5])], "elem long, part int, verts array<long>")
    _, down = build.assemble({"tet": conn})
    return verify.summary(verify.upward(down))


@query("mesh_nonmanifold_neighbours", "SELECT a AS elem, b AS other FROM range(3) p(a), range(3) q(b) WHERE a <> b")
def nonmanifold_neighbours(spark, sf_dir):
    """Each of three tets on one face has the two others as neighbours."""
    conn = spark.createDataFrame([(0, 0, [0, 1, 2, 3]), (1, 0, [0, 1, 2, 4]), (2, 0, [0, 1, 2, 5])], "elem long, part int, verts array<long>")
    _, down = build.assemble({"tet": conn})
    return topology.neighbours(topology.boundary(down, 3)).select("elem", "other").distinct()


@query("mesh_verify_downward", f"WITH {CTE} SELECT count(*) AS violations FROM vertex WHERE vert % 50 = 0")
def verify_downward(spark, sf_dir):
    """Vertices said to be classified above any element."""
    b = box(spark, sf_dir)
    classes = b.vertex().select("vert", F.when(F.col("vert") % 50 == 0, 4).otherwise(0).alias("model_dim"))
    bad = verify.downward(b.down(), b.vertex(), classes).where("check = 'classified above'").select("entity").distinct()
    return bad.agg(F.count(F.lit(1)).alias("violations"))


@query("mesh_verify_remotes", f"WITH {REP}, p AS (SELECT a.vert, a.part, b.part AS peer FROM replica a JOIN replica b ON a.vert = b.vert AND a.part <> b.part) SELECT 'remote not stated' AS \"check\", count(*) AS violations FROM p WHERE vert % 3 = 0 UNION ALL SELECT 'remote not there', count(*) FROM p WHERE vert % 3 <> 0 AND part = 0")
def verify_remotes(spark, sf_dir):
    """Remotes left out for some vertices and made up for others."""
    _, rep = _parts(spark, sf_dir)
    true = _remotes(rep)
    stated = true.where("vert % 3 <> 0").unionByName(true.where("vert % 3 <> 0 and part = 0").select("vert", "part", (F.col("peer") + 100).alias("peer")))
    return verify.summary(verify.replicas(rep, stated), checks=("remote not stated", "remote not there"))


@query("mesh_verify_ghosts", f"WITH {CTE} SELECT * FROM (VALUES ('ghost of nothing', 2::BIGINT), ('ghost at home', 3)) t(\"check\", violations)")
def verify_ghosts(spark, sf_dir):
    b = box(spark, sf_dir)
    owned = b.elem().select("elem", "part")
    good = owned.where("elem < 20").select("elem", ((F.col("part") + 1) % PARTS).alias("part"))
    bad = owned.where("elem in (30, 31, 32)").unionByName(spark.createDataFrame([(10**9, 0), (10**9 + 1, 1)], "elem long, part int"))
    return verify.summary(verify.ghosts(good.unionByName(bad), owned))


@query("mesh_verify_copies", f"WITH {REP}, c AS (SELECT vert FROM replica GROUP BY vert HAVING count(*) > 1) SELECT 'field' AS \"check\", count(*) AS violations FROM c WHERE vert % 2 = 0 UNION ALL SELECT 'flag', count(*) FROM c WHERE vert % 5 = 0")
def verify_copies(spark, sf_dir):
    """Field values and flags that copies do not agree on."""
    _, rep = _parts(spark, sf_dir)
    first = rep.groupBy("vert").agg(F.min("part").alias("first"))
    x = rep.join(first, "vert").select("vert", F.when((F.col("vert") % 2 == 0) & (F.col("part") == F.col("first")), 1).otherwise(0).alias("f"), F.when((F.col("vert") % 5 == 0) & (F.col("part") == F.col("first")), 4).otherwise(2).alias("flag"))
    return verify.summary(verify.agreement(x, "vert", "f", "field"), verify.agreement(x, "vert", "flag", "flag"), checks=("field", "flag"))


@query("mesh_verify_matches", f"WITH {CTE} SELECT 'match not mutual' AS \"check\", count(*) FILTER (WHERE vert % 4 = 0) AS violations FROM vertex WHERE x = 1 UNION ALL SELECT 'match of itself', 1")
def verify_matches(spark, sf_dir):
    b = box(spark, sf_dir)
    m = b.vertex().where("x = 1").select("vert", (F.col("vert") - b.n).alias("match"))
    back = m.where("vert % 4 <> 0").select(F.col("match").alias("vert"), F.col("vert").alias("match"))
    return verify.summary(verify.matches(m.unionByName(back).unionByName(spark.createDataFrame([(10**9, 10**9)], "vert long, match long"))), checks=("match not mutual", "match of itself"))


_MF = "f AS (SELECT list_sort(k) AS k FROM (SELECT unnest([[vs[1], vs[2], vs[3]], [vs[1], vs[2], vs[4]], [vs[1], vs[3], vs[4]], [vs[2], vs[3], vs[4]]]) AS k FROM (SELECT list(vert ORDER BY pos) AS vs FROM down GROUP BY elem)) GROUP BY k HAVING count(*) = 1)"


@query("mesh_verify_alignment", f"WITH {CTE} SELECT count(*) AS sides, 0::BIGINT AS wrong, count(*) AS turned FROM (SELECT unnest(range(2 * n * n)) FROM dim)")
def verify_alignment(spark, sf_dir):
    """Sides of x = 1 against those of x = 0: in order of ids they correspond, turned by one none does."""
    b = box(spark, sf_dir)
    f = topology.entities(topology.boundary(b.down(), 3)).where("uses = 1").select("key")
    on = f.where(F.forall("key", lambda v: v % (b.n + 1) == b.n))
    m = on.select(F.array_join(F.transform("key", lambda v: v.cast("string")), "-").alias("side"), F.transform("key", lambda v: v - b.n).alias("across"))
    theirs = f.where(F.forall("key", lambda v: v % (b.n + 1) == 0)).select(F.col("key").alias("across"), F.col("key").alias("verts"))
    x = graph.pinned(m.join(theirs, "across"))
    turned = x.withColumn("verts", F.array(F.col("verts")[1], F.col("verts")[2], F.col("verts")[0]))
    wrong = verify.alignment(x).agg(F.count(F.lit(1)).alias("wrong"))
    return x.agg(F.count(F.lit(1)).alias("sides")).join(F.broadcast(wrong), F.lit(True)).join(F.broadcast(verify.alignment(turned).agg(F.count(F.lit(1)).alias("turned"))), F.lit(True))


@query("mesh_aligned_sides", f"WITH {CTE}, {_MF}, m AS (SELECT k FROM f, dim WHERE list_aggregate(list_transform(k, lambda v : (v % (n + 1) = n)::INT), 'sum') = 3) SELECT k[1] AS a, k[2] AS b, k[3] AS c, k[1] - n AS ma, k[2] - n AS mb, k[3] - n AS mc FROM m, dim")
def aligned_sides(spark, sf_dir):
    """Matched sides with their vertices in corresponding order."""
    b = box(spark, sf_dir)
    f = topology.entities(topology.boundary(b.down(), 3)).where("uses = 1").where(F.forall("key", lambda v: v % (b.n + 1) == b.n))
    return f.select(*[F.col("key")[i].alias(c) for i, c in enumerate("abc")], *[(F.col("key")[i] - b.n).alias(f"m{c}") for i, c in enumerate("abc")])


@query("mesh_filtered_matches", f"WITH {CTE} SELECT vert, vert - n AS match FROM vertex, dim WHERE x = 1 AND y > 0 AND y < 1")
def filtered_matches(spark, sf_dir):
    """Of geometric matches those between entities that the model pairs: here the inside of two faces along y."""
    b = box(spark, sf_dir)
    v = b.vertex()
    m = v.where("x = 1").select("vert", "y").join(v.where("x = 0").select(F.col("vert").alias("match"), (F.col("vert") + b.n).alias("vert")), "vert")
    return m.where("y > 0 and y < 1").select("vert", "match")


@query("mesh_verify_fields", f"WITH {REP} SELECT count(*) AS missing FROM replica WHERE vert % 7 = 0")
def verify_fields(spark, sf_dir):
    _, rep = _parts(spark, sf_dir)
    values = rep.select("vert", "part", F.when(F.col("vert") % 7 != 0, F.col("n")).alias("value"))
    return verify.fields(rep, values).agg(F.count(F.lit(1)).alias("missing"))


# --- conditions

_CLS = "cls AS (SELECT vert, x, y, z, (CASE x WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END) + 3 * (CASE y WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END) + 9 * (CASE z WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END) AS tag FROM vertex)"


@query("mesh_essential_search", f"WITH {CTE}, {_CLS} SELECT vert, CASE WHEN tag = 12 THEN 10 WHEN x = 0 THEN CASE WHEN z = 1 THEN 20 ELSE 10 END ELSE 20 END AS value FROM cls WHERE x = 0 OR z = 1")
def essential_search(spark, sf_dir):
    """Attributes on two faces of the box: a vertex takes its own face's, or else that of the later face above it."""
    from facetry.plans.model_queries import _classified, closure, model

    points = _classified(spark, sf_dir).join(F.broadcast(model(spark).select("tag", "dim")), "tag").select("vert", "dim", F.col("tag"))
    # the faces x = 0 and z = 1 have tags 12 (0 + 3 + 9) and 22 (1 + 3 + 18)
    attributes = spark.createDataFrame([(2, 12, 10), (2, 22, 20)], "dim int, tag long, value int")
    up = closure(spark).where("target_dim = dim + 1").select("dim", "tag", F.col("target_dim").alias("up_dim"), F.col("target").alias("up_tag"))
    return conditions.essential(points, attributes, F.broadcast(up), 2).select("vert", "value")


@query("mesh_natural_sides", f"WITH {CTE}, {_MF}, m AS (SELECT k FROM f, dim WHERE list_aggregate(list_transform(k, lambda v : (v % (n + 1) = n)::INT), 'sum') = 3) SELECT k[1] AS a, k[2] AS b, k[3] AS c, 5 AS value FROM m")
def natural_sides(spark, sf_dir):
    """Boundary sides on the face that has a natural condition."""
    b = box(spark, sf_dir)
    f = topology.entities(topology.boundary(b.down(), 3)).where("uses = 1").where(F.forall("key", lambda v: v % (b.n + 1) == b.n))
    s = f.select("key", F.lit(2).alias("dim"), F.lit(14).cast("long").alias("tag"))
    return conditions.natural(s, spark.createDataFrame([(2, 14, 5)], "dim int, tag long, value int")).select(*[F.col("key")[i].alias(c) for i, c in enumerate("abc")], "value")


@query("mesh_combined_constraints", f"WITH {CTE}, c AS (SELECT vert, (x = 0)::INT + (y = 0)::INT + (z = 0)::INT AS k, (x = 0)::INT AS a, (y = 0)::INT AS b, (z = 0)::INT AS c FROM vertex) SELECT vert, CASE k WHEN 1 THEN 'plane' WHEN 2 THEN 'line' ELSE 'point' END AS kind, a * 1.0::DOUBLE AS ux, b * 2.0::DOUBLE AS uy, c * 3.0::DOUBLE AS uz FROM c WHERE k > 0")
def combined_constraints(spark, sf_dir):
    """Normal velocities on three faces: planes, where two meet lines, at the corner a point."""
    v = box(spark, sf_dir).vertex()
    rows = None
    for k, (c, n) in enumerate(zip("xyz", ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0)), strict=True)):
        one = v.where(f"{c} = 0").select("vert", *[F.lit(a).alias(m) for a, m in zip(n, ("nx", "ny", "nz"), strict=True)], F.lit(k + 1.0).alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    out = conditions.constrained(rows)
    return out.select("vert", "kind", *[(F.round(c, 9) + 0.0).alias(c) for c in ("ux", "uy", "uz")])


@query("mesh_constraint_bits", f"WITH {CTE} SELECT vert, CAST((x = 0)::INT * 1 + (y = 0)::INT * 2 + (z = 0)::INT * 4 + (z = 1)::INT * 8 AS INT) AS bits FROM vertex WHERE x = 0 OR y = 0 OR z = 0 OR z = 1")
def constraint_bits(spark, sf_dir):
    """The kinds of conditions at a vertex as bits."""
    on = lambda e, bit: F.when(F.expr(e), bit).otherwise(0)
    bits = on("x = 0", 1) + on("y = 0", 2) + on("z = 0", 4) + on("z = 1", 8)
    return box(spark, sf_dir).vertex().select("vert", bits.alias("bits")).where("bits > 0")


@query("mesh_initial_conditions", f"WITH {CTE} SELECT elem, CASE WHEN (elem // 6) % n < n // 2 THEN 300.0 ELSE 273.0 END::DOUBLE AS value FROM elem, dim")
def initial_conditions(spark, sf_dir):
    """A value by region, a default elsewhere."""
    b = box(spark, sf_dir)
    e = b.elem().select("elem", F.when((F.floor(F.col("elem") / 6) % b.n) < b.n // 2, 1).otherwise(2).alias("region"))
    return conditions.initial(e, spark.createDataFrame([(1, 300.0)], "region int, value double"), 273.0).select("elem", "value")


@query("mesh_angle_tags", f"WITH {CTE} SELECT vert, round(CASE WHEN x = 1 THEN pi() / 2 ELSE 0 END, 9) AS angle FROM vertex")
def angle_tags(spark, sf_dir):
    """The angle by which matched vertices of a sector are turned."""
    return box(spark, sf_dir).vertex().select("vert", F.round(F.when(F.col("x") == 1, F.lit(3.141592653589793 / 2)).otherwise(0.0), 9).alias("angle"))


@query("mesh_rigid_bodies", f"WITH {CTE} SELECT CASE WHEN z = 0 THEN 1 ELSE 2 END AS body, count(*) AS nodes, round(avg(x), 9) AS cx FROM vertex WHERE z IN (0, 1) GROUP BY 1")
def rigid_bodies(spark, sf_dir):
    """Nodes by the rigid body whose faces they lie on, with its centre."""
    v = box(spark, sf_dir).vertex().where("z in (0, 1)")
    return v.groupBy(F.when(F.col("z") == 0, 1).otherwise(2).alias("body")).agg(F.count(F.lit(1)).alias("nodes"), F.round(F.avg("x"), 9).alias("cx"))


# --- arrays for solvers


@query("mesh_solver_neighbours", f"{_SIDES}, a AS (SELECT lo AS elem, hi AS other FROM s WHERE n = 2 UNION ALL SELECT hi, lo FROM s WHERE n = 2) SELECT elem.elem, coalesce(array_to_string(list(other ORDER BY other), ','), '') AS others FROM elem LEFT JOIN a USING (elem) GROUP BY elem.elem")
def solver_neighbours(spark, sf_dir):
    b = box(spark, sf_dir)
    near = topology.neighbours(topology.boundary(b.down(), 3)).groupBy("elem").agg(F.array_join(F.sort_array(F.collect_list("other")), ",").alias("others"))
    return b.elem().select("elem").join(near, "elem", "left").select("elem", F.coalesce("others", F.lit("")).alias("others"))


@query("mesh_edge_arrays", f"WITH {FACE}, e AS (SELECT DISTINCT key[1] AS a, key[2] AS b FROM edge) SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS edge FROM e")
def edge_arrays(spark, sf_dir):
    e = topology.entities(topology.boundary(box(spark, sf_dir).down(), 2)).select(F.col("key")[0].alias("a"), F.col("key")[1].alias("b"), F.lit(0).alias("all"))
    return numbering.numbered(e, "all", "a", "b").select("a", "b", F.col("global_number").alias("edge"))


@query("mesh_element_graph", f"{_SIDES} SELECT count(*) AS links, CAST(sum(lo + hi) AS BIGINT) AS id_sum FROM s WHERE n = 2")
def element_graph(spark, sf_dir):
    return sides(spark, sf_dir).where("n = 2").agg(F.count(F.lit(1)).alias("links"), F.sum(F.col("lo") + F.col("hi")).alias("id_sum"))


@query("mesh_mapping_arrays", f"WITH {REP}, l AS (SELECT vert, part, row_number() OVER (PARTITION BY part ORDER BY vert) - 1 AS place FROM replica) SELECT vert, owner AS src_part, place AS src_place, vert % 4 AS part FROM owner JOIN l USING (vert) WHERE l.part = owner")
def mapping_arrays(spark, sf_dir):
    """Where each vertex was, by part and place, before a new partition."""
    b, rep = _parts(spark, sf_dir)
    own = replicas.owners(rep, replicas.part_loads(b.elem()))
    l = numbering.numbered(rep.select("vert", "part"), "part", "vert").select("vert", "part", "local_number")  # noqa: E741
    return own.join(l, "vert").where("part = owner").select("vert", F.col("owner").alias("src_part"), F.col("local_number").alias("src_place"), (F.col("vert") % 4).alias("part"))


@query("mesh_solver_order", f"WITH {CTE} SELECT elem, array_to_string([max(CASE WHEN pos = 0 THEN vert END), max(CASE WHEN pos = 2 THEN vert END), max(CASE WHEN pos = 1 THEN vert END), max(CASE WHEN pos = 3 THEN vert END)], ',') AS verts FROM down GROUP BY elem")
def solver_order(spark, sf_dir):
    """Vertices in a solver's own order, by a permutation for each type."""
    perm = {"tet": [0, 2, 1, 3]}
    v = F.col("verts")
    return build.connectivity(box(spark, sf_dir).down()).select("elem", F.array_join(F.array(*[v[i] for i in perm["tet"]]), ",").alias("verts"))


@query("mesh_rotations", f"WITH {CTE}, t AS (SELECT elem, list(vert ORDER BY pos) AS vs FROM down GROUP BY elem) SELECT elem, list_position(vs, list_min(vs)) - 1 AS turns, list_min(vs) AS first FROM t")
def rotations(spark, sf_dir):
    """How far each tet is to be turned so that its least vertex is first."""
    c = build.connectivity(box(spark, sf_dir).down())
    return c.select("elem", (F.array_position("verts", F.array_min("verts")) - 1).cast("int").alias("turns"), F.array_min("verts").alias("first"))


@query("mesh_shared_node_order", f"WITH {FACE}, e AS (SELECT elem, which, key FROM edge), o AS (SELECT e.elem, e.which, CASE WHEN list_position(vs, key[1]) < list_position(vs, key[2]) THEN 1 ELSE -1 END AS sign FROM e JOIN t4 USING (elem)) SELECT elem, CAST(sum(sign * (1 << which)) AS BIGINT) AS signs FROM o GROUP BY elem")
def shared_node_order(spark, sf_dir):
    """For each edge of an element whether its nodes run as in the element or against it."""
    e = topology.boundary(box(spark, sf_dir).down(), 2)
    sign = F.when(F.col("verts")[0] == F.col("key")[0], 1).otherwise(-1)
    return e.groupBy("elem").agg(F.sum(sign * F.expr("shiftleft(1L, which)")).alias("signs"))


@query("mesh_solver_weights", f"WITH {MIXED} SELECT type, CAST(count(DISTINCT elem) * CASE type WHEN 'hex' THEN 6 WHEN 'prism' THEN 3 ELSE 1 END AS BIGINT) AS weight FROM mdown GROUP BY type")
def solver_weights(spark, sf_dir):
    """Elements weigh as many tets as they are cut into."""
    elem, _ = mixed(spark, sf_dir)
    w = F.when(F.col("type") == "hex", 6).when(F.col("type") == "prism", 3).otherwise(1)
    return elem.groupBy("type").agg(F.sum(w).alias("weight"))


@query("mesh_interface_flags", f"WITH {CTE} SELECT count(*) FILTER (WHERE low = 1 AND high = 1) AS interface_verts, count(*) AS verts FROM (SELECT vert, max(((elem // 6) % n < n // 2)::INT) AS low, max(((elem // 6) % n >= n // 2)::INT) AS high FROM down, dim GROUP BY vert)")
def interface_flags(spark, sf_dir):
    """Vertices on the interface of two materials, and of all."""
    b = box(spark, sf_dir)
    low = (F.floor(F.col("elem") / 6) % b.n) < b.n // 2
    v = b.down().groupBy("vert").agg(F.bool_or(low).alias("low"), F.bool_or(~low).alias("high"))
    return v.agg(F.count_if(F.col("low") & F.col("high")).alias("interface_verts"), F.count(F.lit(1)).alias("verts"))


@query("mesh_solver_output", f"WITH {CTE} SELECT * FROM (SELECT 'nodes' AS what, count(*) AS n FROM vertex UNION ALL SELECT 'elements', count(*) FROM elem UNION ALL SELECT 'conditions', count(*) FROM vertex WHERE x = 0 UNION ALL SELECT 'sides', 2 * n * n FROM dim)")
def solver_output(spark, sf_dir):
    """All that a solver is given: nodes, elements, essential conditions, natural sides."""
    b = box(spark, sf_dir)
    f = topology.entities(topology.boundary(b.down(), 3)).where("uses = 1").where(F.forall("key", lambda v: v % (b.n + 1) == b.n))
    tables = {"nodes": b.vertex(), "elements": b.elem(), "conditions": b.vertex().where("x = 0"), "sides": f}
    out = None
    for what, t in tables.items():
        one = t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("mesh_model_database", "SELECT * FROM (VALUES (0, 8::BIGINT, 24::BIGINT), (1, 12, 24), (2, 6, 6)) t(dim, entities, upward)")
def model_database(spark, sf_dir):
    """Model entities by dimension, with their uses by those one dimension above."""
    from facetry.plans.model_queries import closure, model

    up = closure(spark).where("target_dim = dim + 1").groupBy("dim").agg(F.count(F.lit(1)).alias("upward"))
    return model(spark).groupBy("dim").agg(F.count(F.lit(1)).alias("entities")).join(up, "dim").select("dim", "entities", "upward")


@query("mesh_face_matching", "SELECT * FROM (VALUES (12::BIGINT, 14::BIGINT), (10, 16), (4, 22)) t(face, match)")
def face_matching(spark, sf_dir):
    """Model faces that a shift by the period brings together."""
    from facetry.plans.model_queries import model

    m = model(spark).where("dim = 2")
    low = m.where("a = 0 or b = 0 or c = 0")
    high = m.where("a = 2 or b = 2 or c = 2")
    turn = lambda k: F.when(F.col(k) == 0, 2).otherwise(F.col(k)).alias(f"m{k}")
    return low.select(F.col("tag").alias("face"), *[turn(k) for k in "abc"]).join(high.select(F.col("tag").alias("match"), *[F.col(k).alias(f"m{k}") for k in "abc"]), ["ma", "mb", "mc"]).select("face", "match")


@query("mesh_boundary_set_closure", "SELECT 12::BIGINT AS face, 9::BIGINT AS entities")
def boundary_set_closure(spark, sf_dir):
    """A face with all that bounds it: itself, four edges, four vertices."""
    from facetry.plans.model_queries import closure

    return closure(spark).where("target = 12").groupBy(F.col("target").alias("face")).agg(F.count_distinct("tag").alias("entities"))


# --- residual equilibration on edge elements



@query("mesh_curl_matrices", f"WITH {TET} SELECT elem, 0.0::DOUBLE AS gradient_part, round(v * 4 * 14, 9) AS energy FROM vol")
def curl_matrices(spark, sf_dir):
    """Curl-curl matrices of edge elements: a gradient has no energy, the field (1, 2, 3) x r has 4 * 14 times the volume."""
    p = [P[i] for i in range(4)]
    grads = [g.gradient(p, [F.lit(1.0) if i == k else F.lit(0.0) for i in range(4)]) for k in range(4)]
    c = corners(box(spark, sf_dir)).select("elem", "p", g.tet_volume(p).alias("v"), *[F.array(*grads[k]).alias(f"g{k}") for k in range(4)])
    gr = [tuple(F.col(f"g{k}")[a] for a in range(3)) for k in range(4)]
    q = [P[i] for i in range(4)]

    def energy(u):
        curl = [F.lit(0.0)] * 3
        for i, j in _EDGE:
            mid = {k: (q[i][k] + q[j][k]) / 2 for k in "xyz"}
            m = g.dot(u(mid), g.vec(q[i], q[j]))
            w = g.cross(gr[i], gr[j])
            curl = [curl[k] + 2 * m * w[k] for k in range(3)]
        return F.col("v") * g.dot(curl, curl)

    turn = lambda m: (2 * m["z"] - 3 * m["y"], 3 * m["x"] - m["z"], m["y"] - 2 * m["x"])
    flat = lambda m: (F.lit(1.0), F.lit(-2.0), F.lit(0.5))
    return c.select("elem", F.round(energy(flat), 9).alias("gradient_part"), F.round(energy(turn), 9).alias("energy"))


@query("mesh_domain_loads", f"WITH {TET} SELECT elem, round(v * (x1 - x0 + 2 * (y1 - y0) + 3 * (z1 - z0)) / 4 + 0.0, 9) + 0.0 AS total FROM vol")
def domain_loads(spark, sf_dir):
    """Loads of the field (1, 2, 3) on the edge functions of a tet, here on edge 0-1 without the others: V/4 (grad l1 - grad l0) . f, taken back to the edge."""
    e = g.vec(P[0], P[1])
    f = (F.lit(1.0), F.lit(2.0), F.lit(3.0))
    return corners(box(spark, sf_dir)).select("elem", (F.round(g.tet_volume([P[i] for i in range(4)]) * g.dot(e, f) / 4, 9) + 0.0).alias("total"))


@query("mesh_edge_field_error", f"WITH {TET} SELECT 0.0::DOUBLE AS error FROM (SELECT 1)")
def edge_field_error(spark, sf_dir):
    """The L2 distance of a field from its edge interpolation, which is exact for this one, by quadrature."""
    from facetry.functions import shapes
    from facetry.plans.shape_queries import _edge_field, with_gradients

    u = lambda m: (1 + 2 * m["z"] - 3 * m["y"], 2 + 3 * m["x"] - m["z"], 3 + m["y"] - 2 * m["x"])
    p = [P[i] for i in range(4)]
    total = F.lit(0.0)
    for at, w in shapes.rule("tet", 1):
        value, _ = _edge_field(p, at, u)
        x = {k: shapes.weighed([q[k] for q in p], at) for k in "xyz"}
        d = [a - b for a, b in zip(value, u(x), strict=True)]
        total = total + F.lit(6 * w) * g.dot(d, d)
    return with_gradients(corners(box(spark, sf_dir))).agg(F.round(F.sum(total * g.tet_volume(p)), 9).alias("error"))


@query("mesh_edge_patches", f"WITH {FACE} SELECT tets, closed, count(*) AS edges FROM (SELECT key, count(*) AS tets, count(DISTINCT x) = count(*) AS closed FROM (SELECT e.key, e.elem, unnest(list_filter(vs, lambda v : v <> e.key[1] AND v <> e.key[2])) AS x FROM edge e JOIN t4 USING (elem)) GROUP BY key) GROUP BY ALL")
def edge_patches(spark, sf_dir):
    """Tets around edges, each counted with both of its ring's vertices."""
    d = box(spark, sf_dir).down()
    use = topology.boundary(d, 2).join(topology.gathered(d).withColumnRenamed("verts", "vs"), "elem").select("key", F.explode(F.array_except("vs", "key")).alias("x"))
    per = use.groupBy("key").agg(F.count(F.lit(1)).alias("tets"), F.count_distinct("x").alias("ring"))
    return per.groupBy("tets", (F.col("ring") == F.col("tets")).alias("closed")).agg(F.count(F.lit(1)).alias("edges"))


@query("mesh_error_clamped_sizes", f"WITH {TET}, e AS (SELECT elem, 0.01 * (1 + (x0+x1+x2+x3) / 4) AS err, 1.0::DOUBLE / n AS h FROM vol, dim) SELECT elem, round(greatest(0.5 * h, least(2 * h, pow(0.012 / err, 0.4) * h)), 9) AS size FROM e")
def error_clamped_sizes(spark, sf_dir):
    """Sizes (target / error)^(2/(2p+d)) h_min, between half and twice h; p = 1, d = 3."""
    c = corners(box(spark, sf_dir))
    shortest = F.least(*[g.norm(g.vec(P[i], P[j])) for i, j in _EDGE])
    err = 0.01 * (1 + (P[0]["x"] + P[1]["x"] + P[2]["x"] + P[3]["x"]) / 4)
    size = F.pow(F.lit(0.012) / err, F.lit(0.4)) * shortest
    return c.select("elem", F.round(F.greatest(0.5 * shortest, F.least(2 * shortest, size)), 9).alias("size"))
