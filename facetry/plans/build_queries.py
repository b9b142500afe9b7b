"""Queries on building, tagging, numbering and reporting on meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetry.operators import build, graph, numbering, replicas, tags, topology
from facetry.plans.box_queries import CTE, FACE, REP, TET
from facetry.plans.catalog import query
from facetry.plans.meshes import PARTS, Tables, box

W = "WITH " + Tables.SQL
#: Even cells of the box as one hex each, odd ones as six tets.
_HEX = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
MIXED = CTE + f""",
hx(pos, dx, dy, dz) AS (VALUES {", ".join(str((i, *p)) for i, p in enumerate(_HEX))}),
mdown AS (SELECT elem, 'tet' AS type, pos, vert FROM down WHERE (elem // 6) % 2 = 1 UNION ALL
  SELECT r * 6, 'hex', pos, (r % n) + dx + (n + 1) * ((r // n) % n + dy + (n + 1) * (r // (n * n) + dz)) FROM (SELECT n, unnest(range(n * n * n)) AS r FROM dim), hx WHERE r % 2 = 0)"""


def mixed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(elem, down) of the box with hexes in even cells, assembled from one connectivity table for each type."""
    b = box(spark, sf_dir)
    n = b.n
    tets = build.connectivity(b.down()).where("floor(elem / 6) % 2 = 1").withColumn("part", F.lit(0))
    c = spark.range(n**3).withColumnRenamed("id", "cell").where("cell % 2 = 0")
    i, j, k = F.col("cell") % n, F.floor(F.col("cell") / n) % n, F.floor(F.col("cell") / (n * n))
    verts = F.array(*[(i + dx + (n + 1) * (j + dy + (n + 1) * (k + dz))).cast("long") for dx, dy, dz in _HEX])
    hexes = c.select((F.col("cell") * 6).alias("elem"), F.lit(0).alias("part"), verts.alias("verts"))
    return build.assemble({"tet": tets, "hex": hexes})


def _n(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


# --- construction


@query("mesh_construct", f"WITH {REP} SELECT vert, part, count(*) OVER (PARTITION BY vert) AS copies FROM replica")
def construct(spark, sf_dir):
    """From an array of connectivity for each element: assembled, then finalised over parts."""
    b = box(spark, sf_dir)
    conn = build.connectivity(b.down()).join(b.elem(), "elem").select("elem", "part", "verts")
    return build.finalise(*build.assemble({"tet": conn}))[0]


@query("mesh_assemble_mixed", f"WITH {MIXED} SELECT type, count(DISTINCT elem) AS elems, count(*) AS corners, CAST(sum(vert) AS BIGINT) AS vert_sum FROM mdown GROUP BY type")
def assemble_mixed(spark, sf_dir):
    elem, down = mixed(spark, sf_dir)
    return down.join(elem.select("elem", "type"), "elem").groupBy("type").agg(F.count_distinct("elem").alias("elems"), F.count(F.lit(1)).alias("corners"), F.sum("vert").alias("vert_sum"))


@query("mesh_finalise_owners", f"WITH {REP} SELECT owner AS part, count(*) AS owned FROM owner GROUP BY owner")
def finalise_owners(spark, sf_dir):
    b = box(spark, sf_dir)
    conn = build.connectivity(b.down()).join(b.elem(), "elem").select("elem", "part", "verts")
    return build.finalise(*build.assemble({"tet": conn}))[1].groupBy(F.col("owner").alias("part")).agg(F.count(F.lit(1)).alias("owned"))


@query("mesh_set_coordinates", f"WITH {CTE} SELECT vert, x, y, z FROM vertex")
def set_coordinates(spark, sf_dir):
    """Coordinates handed out from flat arrays of contiguous ids."""
    v = box(spark, sf_dir).vertex()
    return build.with_coordinates(v.select("vert"), build.flat_coordinates(v, 100)).select("vert", "x", "y", "z")


@query("mesh_extract_coordinates", f"WITH {CTE} SELECT (vert // 100) * 100 AS first, 3 * count(*) AS numbers, round(sum(x + 2 * y + 3 * z), 6) AS total FROM vertex GROUP BY 1")
def extract_coordinates(spark, sf_dir):
    flat = build.flat_coordinates(box(spark, sf_dir).vertex(), 100)
    weighed = F.aggregate(F.transform("xyz", lambda v, i: v * (i % 3 + 1)), F.lit(0.0), lambda a, v: a + v)
    return flat.select("first", F.size("xyz").cast("long").alias("numbers"), F.round(weighed, 6).alias("total"))


@query("mesh_destruct", f"WITH {CTE} SELECT elem, array_to_string(list(vert ORDER BY pos), ',') AS verts FROM down GROUP BY elem")
def destruct(spark, sf_dir):
    return build.connectivity(box(spark, sf_dir).down()).select("elem", F.array_join("verts", ",").alias("verts"))


@query("mesh_set_matches", f"WITH {CTE} SELECT vert, vert - n AS match FROM vertex, dim WHERE x = 1")
def set_matches(spark, sf_dir):
    """Matches from an array with an id for each vertex, -1 for none."""
    b = box(spark, sf_dir)
    given = b.vertex().groupBy(F.floor(F.col("vert") / 1000).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("vert", F.when(F.col("x") == 1, F.col("vert") - b.n).otherwise(-1).alias("m")))).alias("a"))
    flat = given.select(F.col("chunk") * 1000, F.posexplode("a.m").alias("i", "match"))
    return flat.select((F.col(flat.columns[0]) + F.col("i")).alias("vert"), "match").where("match >= 0")


@query("mesh_one_element", "SELECT * FROM (VALUES ('edge', 2, 1), ('triangle', 3, 3), ('quad', 4, 4), ('tet', 4, 6), ('prism', 6, 9), ('pyramid', 5, 8), ('hex', 8, 12)) t(type, corners, edges)")
def one_element(spark, sf_dir):
    """A mesh of a single reference element of each type."""
    out = None
    for kind in build.REFERENCE:
        v, down = build.one_element(spark, kind)
        e = build.edges_of(spark.createDataFrame([(0, kind)], "elem long, type string"), down).distinct()
        row = v.agg(F.count(F.lit(1)).cast("int").alias("corners")).join(F.broadcast(e.agg(F.count(F.lit(1)).cast("int").alias("edges"))), F.lit(True)).select(F.lit(kind).alias("type"), "corners", "edges")
        out = row if out is None else out.unionByName(row)
    return out


@query("mesh_empty", "SELECT 0::BIGINT AS vertices, 0::BIGINT AS elements")
def empty_mesh(spark, sf_dir):
    v, _, e = build.empty(spark)
    return _n(v, "vertices").join(F.broadcast(_n(e, "elements")), F.lit(True))


@query("mesh_convert", f"WITH {TET}, m AS (SELECT count(*) AS v FROM vertex), e AS (SELECT count(*) AS e FROM elem) SELECT e.e - 1 - elem AS elem, pos, m.v - 1 - vert AS vert, x FROM down JOIN vertex USING (vert), m, e")
def convert(spark, sf_dir):
    """A copy under other ids, with the coordinates that vertices carry."""
    b = box(spark, sf_dir)
    nv, ne = (b.n + 1) ** 3, 6 * b.n**3
    down, vertex = build.converted(b.down(), b.vertex(), ne - 1 - F.col("elem"), nv - 1 - F.col("vert"))
    return down.join(vertex, "vert").select("elem", "pos", "vert", "x")


@query("mesh_copy_volume", "SELECT 1.0::DOUBLE AS volume, 0::BIGINT AS inverted")
def copy_volume(spark, sf_dir):
    """A copy has the volume of what it copies, and no element turned over."""
    from facetry.functions import geometry as g

    b = box(spark, sf_dir)
    down, vertex = build.converted(b.down(), b.vertex(), F.col("elem") + 1000, F.col("vert") * 3 + 1)
    c = down.join(vertex, "vert").groupBy("elem").agg(F.array_sort(F.collect_list(F.struct("pos", "vert", "x", "y", "z"))).alias("p"))
    v = g.tet_volume([F.col("p")[i] for i in range(4)])
    return c.agg(F.round(F.sum(v), 9).alias("volume"), F.count_if(v <= 0).alias("inverted"))


# --- types and templates


@query("mesh_type_table", f"WITH {MIXED}, t(type, dim, simplex) AS (VALUES ('tet', 3, true), ('hex', 3, false)) SELECT type, dim, simplex, count(DISTINCT elem) AS elems FROM mdown JOIN t USING (type) GROUP BY ALL")
def type_table(spark, sf_dir):
    """Type, dimension and whether a simplex, by the type table."""
    elem, _ = mixed(spark, sf_dir)
    return elem.join(F.broadcast(build.types(spark)), "type").groupBy("type", "dim", "simplex").agg(F.count(F.lit(1)).alias("elems"))


@query("mesh_first_type", f"WITH {MIXED} SELECT arg_min(type, elem) AS type FROM mdown")
def first_type(spark, sf_dir):
    return mixed(spark, sf_dir)[0].agg(F.min_by("type", "elem").alias("type"))


@query("mesh_count_types", f"WITH {MIXED} SELECT type, count(DISTINCT elem) AS n FROM mdown GROUP BY type")
def count_types(spark, sf_dir):
    return mixed(spark, sf_dir)[0].groupBy("type").agg(F.count(F.lit(1)).alias("n"))


_HEX_EDGES = ", ".join(f"('hex', {a}, {b})" for a, b in build.EDGES["hex"]) + ", " + ", ".join(f"('tet', {a}, {b})" for a, b in build.EDGES["tet"])


@query("mesh_template_edges", f"WITH {MIXED}, r(type, a, b) AS (VALUES {_HEX_EDGES}) SELECT least(u.vert, w.vert) AS a, greatest(u.vert, w.vert) AS b, count(*) AS uses FROM r JOIN mdown u ON u.type = r.type AND u.pos = r.a JOIN mdown w ON w.elem = u.elem AND w.pos = r.b GROUP BY ALL")
def template_edges(spark, sf_dir):
    """Edges of a mesh of several types by the template of each type."""
    return build.edges_of(*mixed(spark, sf_dir)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("uses"))


@query("mesh_opposite_vertices", f"WITH {FACE} SELECT elem, which, CAST(list_sum(vs) - list_sum(key) AS BIGINT) AS opposite FROM face JOIN t4 USING (elem)")
def opposite_vertices(spark, sf_dir):
    """The vertex of a tet opposite each of its faces."""
    d = box(spark, sf_dir).down()
    f = topology.boundary(d, 3).join(topology.gathered(d).withColumnRenamed("verts", "vs"), "elem")
    return f.select("elem", "which", F.get(F.array_except("vs", "key"), F.lit(0)).alias("opposite"))


@query("mesh_edge_other_end", f"WITH {FACE} SELECT DISTINCT key[1] AS vert, key[2] AS other FROM edge UNION SELECT DISTINCT key[2], key[1] FROM edge")
def edge_other_end(spark, sf_dir):
    """For each end of an edge the other one."""
    e = topology.entities(topology.boundary(box(spark, sf_dir).down(), 2))
    ends = e.select("key", F.explode("key").alias("vert"))
    return ends.select("vert", F.when(F.col("vert") == F.col("key")[0], F.col("key")[1]).otherwise(F.col("key")[0]).alias("other"))


@query("mesh_face_directions", f"WITH {FACE} SELECT elem, which, CAST((vs[1] > vs[2])::INT + 2 * (vs[2] > vs[3])::INT + 4 * (vs[3] > vs[1])::INT AS INT) AS against FROM (SELECT elem, 0 AS which, [vs[1], vs[2], vs[3]] AS vs FROM t4 UNION ALL SELECT elem, 1, [vs[1], vs[2], vs[4]] FROM t4 UNION ALL SELECT elem, 2, [vs[1], vs[3], vs[4]] FROM t4 UNION ALL SELECT elem, 3, [vs[2], vs[3], vs[4]] FROM t4)")
def face_directions(spark, sf_dir):
    """Which edges a face runs against their own direction: a bit for each."""
    v = F.col("verts")
    bits = [F.when(v[a] > v[b], 1 << k).otherwise(0) for k, (a, b) in enumerate(((0, 1), (1, 2), (2, 0)))]
    return topology.boundary(box(spark, sf_dir).down(), 3).select("elem", "which", (bits[0] + bits[1] + bits[2]).alias("against"))


@query("mesh_dense_index", f"{W}, i AS (SELECT vert, row_number() OVER (ORDER BY vert) - 1 AS i FROM vert) SELECT i, vert FROM i WHERE i IN (0, 10, 100, 10000000)")
def dense_index(spark, sf_dir):
    """Entities by their dense index; an index beyond the end finds nothing."""
    i = numbering.numbered(Tables(spark, sf_dir).vert().select("vert").withColumn("all", F.lit(0)), "all", "vert")
    return i.select(F.col("global_number").alias("i"), "vert").where(F.col("i").isin(0, 10, 100, 10_000_000))


@query("mesh_stored_adjacency", f"{W} SELECT vert, count(*) AS up, CAST(sum(elem) AS BIGINT) AS elem_sum FROM pairs GROUP BY vert")
def stored_adjacency(spark, sf_dir):
    """An upward relation that is made once, stored by vertex, read, and gone with its folder."""
    path = graph.scratch(spark, "adjacency")
    Tables(spark, sf_dir).incidence().select("vert", "elem").groupBy("vert").agg(F.collect_list("elem").alias("up")).write.parquet(path)
    up = spark.read.parquet(path)
    return up.select("vert", F.size("up").cast("long").alias("up"), F.aggregate("up", F.lit(0).cast("long"), lambda a, e: a + e).alias("elem_sum"))


# --- tags and fields


def _ents(spark, sf_dir) -> DataFrame:
    return Tables(spark, sf_dir).vert().select(F.lit(0).alias("dim"), F.col("vert").alias("ent"), "class", "field")


@query("mesh_tag_presence", f"{W} SELECT vert AS ent, class > 20 AND vert % 5 <> 0 AS has FROM vert")
def tag_presence(spark, sf_dir):
    """A tag on some entities, taken from some of these."""
    e = _ents(spark, sf_dir)
    t = tags.Tags().create("size", e.where("class > 20").withColumn("value", F.col("field"))).remove("size", e.where("ent % 5 = 0"))
    return t.has("size", e.select("dim", "ent")).select("ent", "has")


@query("mesh_tag_catalogue", "SELECT * FROM (VALUES ('size'), ('mark')) t(name)")
def tag_catalogue(spark, sf_dir):
    """Tags created, renamed and destroyed."""
    e = _ents(spark, sf_dir).withColumn("value", F.col("field"))
    t = tags.Tags().create("a", e).create("b", e).create("mark", e).rename("a", "size").destroy("b")
    return spark.createDataFrame([(n,) for n in t.names()], "name string")


@query("mesh_tag_dimension_removed", f"{W} SELECT 0 AS dim, 0::BIGINT AS n UNION ALL SELECT 3, count(*) FROM elem")
def tag_dimension_removed(spark, sf_dir):
    t = Tables(spark, sf_dir)
    both = _ents(spark, sf_dir).select("dim", "ent", F.col("field").alias("value")).unionByName(t.elem().select(F.lit(3).alias("dim"), F.col("elem").alias("ent"), F.col("weight").alias("value")))
    left = tags.Tags().create("w", both).remove_dimension("w", 0).tables["w"]
    dims = spark.createDataFrame([(0,), (3,)], "dim int")
    return dims.join(left.groupBy("dim").agg(F.count(F.lit(1)).alias("n")), "dim", "left").select("dim", F.coalesce("n", F.lit(0)).alias("n"))


@query("mesh_tag_checksum", "SELECT true AS same, true AS differs")
def tag_checksum(spark, sf_dir):
    """Checksums agree whatever the order of rows, and tell other values apart."""
    e = _ents(spark, sf_dir).withColumn("value", F.col("field"))
    t = tags.Tags().create("a", e).create("b", e.repartition(7)).create("c", e.withColumn("value", F.col("value") + (F.col("ent") == 1).cast("int")))
    x, y, z = (t.checksum(n).select(F.col("checksum").alias(n)) for n in "abc")
    return x.join(F.broadcast(y), F.lit(True)).join(F.broadcast(z), F.lit(True)).select((F.col("a") == F.col("b")).alias("same"), (F.col("a") != F.col("c")).alias("differs"))


@query("mesh_mapped_tag", f"{W} SELECT vert AS ent, class * 2 AS value FROM vert")
def mapped_tag(spark, sf_dir):
    """Values by a global id, attached through a map of ids."""
    e = _ents(spark, sf_dir)
    ids = e.select((F.col("ent") * 7 + 3).alias("gid"), "dim", "ent")
    values = e.select((F.col("ent") * 7 + 3).alias("gid"), (F.col("class") * 2).alias("value"))
    return tags.Tags().mapped("m", values, ids).tables["m"].select("ent", "value")


@query("mesh_model_tags", f"{W} SELECT class AS tag, count(*) AS n, any_value(class * 100) AS value FROM vert GROUP BY class")
def model_tags(spark, sf_dir):
    """A value on model entities, read through the classification of mesh entities."""
    v = Tables(spark, sf_dir).vert()
    on_model = v.select(F.lit(2).alias("dim"), F.col("class").alias("ent")).distinct().withColumn("value", F.col("ent") * 100)
    t = tags.Tags().create("bc", on_model).tables["bc"]
    return v.join(t.select(F.col("ent").alias("class"), "value"), "class").groupBy(F.col("class").alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.first("value").alias("value"))


@query("mesh_field_components", f"{W} SELECT vert AS ent, c AS component, (field + c * 1000)::BIGINT AS value FROM vert, range(3) q(c)")
def field_components(spark, sf_dir):
    e = _ents(spark, sf_dir)
    return tags.field(e, F.col("field") + F.col("component") * 1000, 3).withColumn("component", F.col("component").cast("long"))


@query("mesh_field_packed", f"{W} SELECT vert AS ent, array_to_string([class, field, field + 1, vert], ',') AS vals FROM vert")
def field_packed(spark, sf_dir):
    """Fields of one, two and one components side by side."""
    e = _ents(spark, sf_dir)
    one = lambda v, n: tags.packed(tags.field(e, v.cast("long"), n))
    x = tags.combined([one(F.col("class"), 1), one(F.col("field") + F.col("component"), 2), one(F.col("ent"), 1)])
    return x.select("ent", F.array_join("values", ",").alias("vals"))


@query("mesh_field_extracted", f"{W} SELECT vert AS ent, c AS component, (field + (c + 1) * 10)::BIGINT AS value FROM vert, range(2) q(c)")
def field_extracted(spark, sf_dir):
    e = _ents(spark, sf_dir)
    p = tags.packed(tags.field(e, F.col("field") + F.col("component") * 10, 4))
    return tags.unpacked(p, 1, 2).select("ent", F.col("component").cast("long").alias("component"), "value")


@query("mesh_field_state", f"{W} SELECT vert AS ent, class > 25 AS has, 0.0::DOUBLE AS zeroed FROM vert")
def field_state(spark, sf_dir):
    """Whether a node has a value, and the field set to zero."""
    e = _ents(spark, sf_dir)
    f = e.select("ent", F.when(F.col("class") > 25, F.col("field").cast("double")).alias("value"))
    return f.select("ent", F.col("value").isNotNull().alias("has"), F.lit(0.0).alias("zeroed"))


@query("mesh_field_arithmetic", f"{W} SELECT vert AS ent, (field + class)::BIGINT AS total, (field * 3)::BIGINT AS scaled, field AS copied FROM vert")
def field_arithmetic(spark, sf_dir):
    """Sum of two fields on the same nodes, a multiple and a copy."""
    e = _ents(spark, sf_dir)
    a, b = e.select("ent", "field"), e.select("ent", "class")
    return a.join(b, "ent").select("ent", (F.col("field") + F.col("class")).alias("total"), (F.col("field") * 3).alias("scaled"), F.col("field").alias("copied"))


@query("mesh_scale_region", f"WITH {CTE}, q AS (SELECT *, (CASE x WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END) AS sx FROM vertex) SELECT vert, CASE WHEN sx = 2 THEN 0.25 ELSE 1.0 END::DOUBLE AS size FROM q")
def scale_region(spark, sf_dir):
    """Sizes scaled on the closure of one model face: its vertices by classification on it or on what bounds it."""
    from facetry.plans.model_queries import _classified, closure

    inside = closure(spark).where("target = 14").select("tag").distinct()  # the face x = 1: high along x, free along y and z
    v = _classified(spark, sf_dir).join(F.broadcast(inside.withColumn("on", F.lit(True))), "tag", "left")
    return v.select("vert", F.when(F.col("on"), 0.25).otherwise(1.0).alias("size"))


@query("mesh_specified_size", f"{W} SELECT vert AS ent, class::DOUBLE AS size FROM vert")
def specified_size(spark, sf_dir):
    """A component of a packed field as the size."""
    p = tags.packed(tags.field(_ents(spark, sf_dir), F.when(F.col("component") == 1, F.col("class")).otherwise(F.col("field")).cast("double"), 3))
    return p.select("ent", F.element_at("values", 2).alias("size"))


# --- numberings


def _numbers(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(copies, owners, owners' numbers) of the tables' mesh."""
    t = Tables(spark, sf_dir)
    rep = replicas.replicas(t.incidence())
    own = replicas.owners(rep, replicas.part_loads(t.elem()))
    num = numbering.numbered(own, "owner", "vert").select("vert", F.col("owner").alias("part"), F.col("global_number").alias("number"))
    return rep, own, num


_NUM = f"{W}, num AS (SELECT vert, owner, row_number() OVER (ORDER BY owner, vert) - 1 AS number FROM owner)"


@query("mesh_synchronize_numbers", f"{_NUM} SELECT vert, part, number FROM replica JOIN num USING (vert)")
def synchronize_numbers(spark, sf_dir):
    return tags.synchronised_numbers(*_numbers(spark, sf_dir))


@query("mesh_fixed_numbers", f"{_NUM}, f AS (SELECT vert, CASE WHEN vert % 4 = 0 THEN -2 ELSE number END AS number FROM num) SELECT count(*) FILTER (WHERE number = -2) AS fixed, count(*) FILTER (WHERE number >= 0) AS numbered FROM f")
def fixed_numbers(spark, sf_dir):
    f = tags.fixed(_numbers(spark, sf_dir)[2], F.col("vert") % 4 == 0)
    return f.agg(F.count_if(F.col("number") == tags.FIXED).alias("fixed"), F.count_if(tags.is_numbered()).alias("numbered"))


@query("mesh_number_offset", f"{_NUM} SELECT vert, CASE WHEN vert % 4 = 0 THEN -2 ELSE number + 500 END AS number FROM num")
def number_offset(spark, sf_dir):
    """An offset on numbered nodes; fixed ones stay fixed."""
    return tags.with_offset(tags.fixed(_numbers(spark, sf_dir)[2], F.col("vert") % 4 == 0), 500).select("vert", "number")


@query("mesh_naive_order", f"{W}, n AS (SELECT 0 AS dim, vert AS ent, c AS component FROM vert, range(2) q(c) WHERE vert % 4 <> 0 UNION ALL SELECT 1, elem, 0 FROM elem) SELECT dim, ent, component, row_number() OVER (ORDER BY dim, ent, component) - 1 AS number FROM n")
def naive_order(spark, sf_dir):
    """Free nodes numbered by dimension, entity and component."""
    t = Tables(spark, sf_dir)
    v = t.vert().where("vert % 4 <> 0").select(F.lit(0).alias("dim"), F.col("vert").alias("ent"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("component"))
    rows = v.unionByName(t.elem().select(F.lit(1).alias("dim"), F.col("elem").alias("ent"), F.lit(0).cast("long").alias("component")))
    return numbering.numbered(rows.withColumn("all", F.lit(0)), "all", "dim", "ent", "component").select("dim", "ent", "component", F.col("global_number").alias("number"))


@query("mesh_mixed_fields_numbers", f"{W}, n AS (SELECT vert AS ent, 0 AS fld, c AS component FROM vert, range(3) q(c) UNION ALL SELECT vert, 1, 0 FROM vert) SELECT ent, fld, component, row_number() OVER (ORDER BY ent, fld, component) - 1 AS number FROM n")
def mixed_fields_numbers(spark, sf_dir):
    """A vector and a scalar field interleaved on each node."""
    v = Tables(spark, sf_dir).vert().select(F.col("vert").alias("ent"))
    one = lambda k, n: v.select("ent", F.lit(k).alias("fld"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("component"))
    return numbering.numbered(one(0, 3).unionByName(one(1, 1)).withColumn("all", F.lit(0)), "all", "ent", "fld", "component").select("ent", "fld", "component", F.col("global_number").alias("number"))


@query("mesh_count_unknowns", f"{W} SELECT 4 * (SELECT count(*) FROM vert) + (SELECT count(*) FROM elem) AS unknowns, (SELECT count(*) FROM vert) + (SELECT count(*) FROM elem) AS nodes")
def count_unknowns(spark, sf_dir):
    """Nodes and components of a vector and a scalar on vertices and a scalar on elements."""
    t = Tables(spark, sf_dir)
    kinds = t.vert().select(F.lit(4).alias("k")).unionByName(t.elem().select(F.lit(1).alias("k")))
    return kinds.agg(F.sum("k").alias("unknowns"), F.count(F.lit(1)).alias("nodes"))


@query("mesh_list_nodes", f"{W}, n AS (SELECT 0 AS dim, vert AS ent FROM vert UNION ALL SELECT 3, elem FROM elem) SELECT dim, ent, row_number() OVER (ORDER BY dim, ent) - 1 AS place FROM n")
def list_nodes(spark, sf_dir):
    t = Tables(spark, sf_dir)
    rows = t.vert().select(F.lit(0).alias("dim"), F.col("vert").alias("ent")).unionByName(t.elem().select(F.lit(3).alias("dim"), F.col("elem").alias("ent")))
    return numbering.numbered(rows.withColumn("all", F.lit(0)), "all", "dim", "ent").select("dim", "ent", F.col("global_number").alias("place"))


@query("mesh_element_numbers", f"{_NUM} SELECT elem, array_to_string(list(number ORDER BY pos), ',') AS numbers FROM down JOIN num USING (vert) GROUP BY elem")
def element_numbers(spark, sf_dir):
    """The numbers of each element's nodes in its own order."""
    num = _numbers(spark, sf_dir)[2].select("vert", "number")
    x = Tables(spark, sf_dir).down().join(num, "vert").groupBy("elem").agg(F.array_sort(F.collect_list(F.struct("pos", "number"))).alias("v"))
    return x.select("elem", F.array_join("v.number", ",").alias("numbers"))


@query("mesh_solver_numbers", f"{W}, l AS (SELECT vert, part, row_number() OVER (PARTITION BY part ORDER BY vert) - 1 AS l FROM replica) SELECT vert, part, l * {PARTS} + part + 1 AS number FROM l")
def solver_numbers(spark, sf_dir):
    """Ids that interleave parts: every copy has one of its own."""
    rep = replicas.replicas(Tables(spark, sf_dir).incidence())
    return numbering.numbered(rep, "part", "vert").select("vert", "part", (F.col("local_number") * PARTS + F.col("part") + 1).alias("number"))


@query("mesh_number_elements", f"{W} SELECT elem, part, row_number() OVER (PARTITION BY part ORDER BY elem) - 1 AS number FROM elem")
def number_elements(spark, sf_dir):
    return numbering.numbered(Tables(spark, sf_dir).elem().select("elem", "part"), "part", "elem").select("elem", "part", F.col("local_number").alias("number"))


@query("mesh_global_ids", f"{_NUM} SELECT 0 AS dim, vert AS ent, part, number AS gid FROM replica JOIN num USING (vert) UNION ALL SELECT 3, elem, part, row_number() OVER (ORDER BY part, elem) - 1 FROM elem")
def global_ids(spark, sf_dir):
    """Ids of every dimension by owner, pushed to all copies."""
    rep, own, num = _numbers(spark, sf_dir)
    v = tags.synchronised_numbers(rep, own, num).select(F.lit(0).alias("dim"), F.col("vert").alias("ent"), "part", F.col("number").alias("gid"))
    e = numbering.numbered(Tables(spark, sf_dir).elem().select("elem", "part"), "part", "elem")
    return v.unionByName(e.select(F.lit(3).alias("dim"), F.col("elem").alias("ent"), "part", F.col("global_number").alias("gid")))


# --- collectives and reports


@query("mesh_collectives", f"{W} SELECT sum(elems)::BIGINT AS added, min(elems) AS least, max(elems) AS most, bool_or(elems > 200) AS any_large, bool_and(elems > 10) AS all_some FROM load")
def collectives(spark, sf_dir):
    l = replicas.part_loads(Tables(spark, sf_dir).elem())  # noqa: E741
    return l.agg(F.sum("elems").alias("added"), F.min("elems").alias("least"), F.max("elems").alias("most"), F.bool_or(F.col("elems") > 200).alias("any_large"), F.bool_and(F.col("elems") > 10).alias("all_some"))


@query("mesh_allgather", f"{W} SELECT a.part, array_to_string(list(b.elems ORDER BY b.part), ',') AS everyone FROM load a, load b GROUP BY a.part")
def allgather(spark, sf_dir):
    """Every part gets the numbers of all: a row for each part, broadcast."""
    l = replicas.part_loads(Tables(spark, sf_dir).elem()).select("part", "elems")  # noqa: E741
    everyone = l.agg(F.array_sort(F.collect_list(F.struct("part", "elems"))).alias("a")).select(F.array_join("a.elems", ",").alias("everyone"))
    return l.select("part").join(F.broadcast(everyone), F.lit(True))


@query("mesh_ordered_receive", f"{W}, s AS (SELECT a.part AS sender, b.part AS receiver, count(*) AS n FROM replica a JOIN replica b USING (vert) WHERE a.part <> b.part GROUP BY ALL) SELECT receiver, array_to_string(list(sender || ':' || n ORDER BY sender), ',') AS messages FROM s GROUP BY receiver")
def ordered_receive(spark, sf_dir):
    """What each part gets from its peers, by sender."""
    from facetry.plans.table_queries import _pairs

    s = _pairs(replicas.replicas(Tables(spark, sf_dir).incidence())).groupBy(F.col("part").alias("sender"), F.col("peer").alias("receiver")).agg(F.count(F.lit(1)).alias("n"))
    g = s.groupBy("receiver").agg(F.array_sort(F.collect_list(F.struct("sender", "n"))).alias("m"))
    return g.select("receiver", F.array_join(F.transform("m", lambda r: F.concat_ws(":", r["sender"].cast("string"), r["n"].cast("string"))), ",").alias("messages"))


@query("mesh_group_sums", f"{W} SELECT part % 2 AS grp, part, CAST(sum(elems) OVER (PARTITION BY part % 2 ORDER BY part) - elems AS BIGINT) AS before FROM load")
def group_sums(spark, sf_dir):
    """A scan that runs within each group of parts alone."""
    l = replicas.part_loads(Tables(spark, sf_dir).elem()).withColumn("grp", F.col("part") % 2)  # noqa: E741
    w = Window.partitionBy("grp").orderBy("part")  # a row for each part
    return l.select("grp", "part", (F.sum("elems").over(w) - F.col("elems")).alias("before"))


@query("mesh_print_statistics", f"WITH {REP}, e AS (SELECT elem, part FROM elem) SELECT 'vertex' AS type, owner AS part, count(*) AS n FROM owner GROUP BY owner UNION ALL SELECT 'tet', part, count(*) FROM e GROUP BY part UNION ALL SELECT 'vertex', -1, count(*) FROM owner UNION ALL SELECT 'tet', -1, count(*) FROM e")
def print_statistics(spark, sf_dir):
    """Owned entities by type and part, with totals (part -1)."""
    b = box(spark, sf_dir)
    own = replicas.owners(replicas.replicas(b.down().join(b.elem(), "elem")), replicas.part_loads(b.elem()))
    rows = own.select(F.lit("vertex").alias("type"), F.col("owner").alias("part")).unionByName(b.elem().select(F.lit("tet").alias("type"), "part"))
    return rows.rollup("type", "part").agg(F.count(F.lit(1)).alias("n")).where("type is not null").select("type", F.coalesce("part", F.lit(-1)).alias("part"), "n")


@query("mesh_smallest_side", f"{W}, s AS (SELECT a.part, b.part AS peer, count(*) AS shared FROM replica a JOIN replica b USING (vert) WHERE a.part <> b.part GROUP BY ALL), k AS (SELECT part, count(*) AS peers, min(shared) AS least FROM s GROUP BY part) SELECT max(peers) AS peers, min(least) FILTER (WHERE peers = (SELECT max(peers) FROM k)) AS smallest FROM k")
def smallest_side(spark, sf_dir):
    """The smallest side of the parts that have most neighbours."""
    from facetry.plans.table_queries import _pairs

    s = _pairs(replicas.replicas(Tables(spark, sf_dir).incidence())).groupBy("part", "peer").agg(F.count(F.lit(1)).alias("shared"))
    k = s.groupBy("part").agg(F.count(F.lit(1)).alias("peers"), F.min("shared").alias("least"))
    top = k.groupBy("peers").agg(F.min("least").alias("least"))
    return top.agg(F.max("peers").alias("peers"), F.max_by("least", "peers").alias("smallest"))


@query("mesh_partition_report", f"{W}, s AS (SELECT a.part, b.part AS peer FROM replica a JOIN replica b USING (vert) WHERE a.part <> b.part), r AS (SELECT 'elements' AS what, part, elems::DOUBLE AS v FROM load UNION ALL SELECT 'weight', part, weight::DOUBLE FROM load UNION ALL SELECT 'vertices', part, count(*)::DOUBLE FROM replica GROUP BY part UNION ALL SELECT 'neighbours', part, count(DISTINCT peer)::DOUBLE FROM s GROUP BY part UNION ALL SELECT 'shared', part, count(*)::DOUBLE FROM replica WHERE vert IN (SELECT vert FROM replica GROUP BY vert HAVING count(*) > 1) GROUP BY part) SELECT what, min(v) AS least, max(v) AS most, round(avg(v), 6) AS mean, round(max(v) / avg(v), 6) AS imbalance FROM r GROUP BY what")
def partition_report(spark, sf_dir):
    """One table of all statistics of a partition."""
    from facetry.plans.table_queries import _pairs

    t = Tables(spark, sf_dir)
    rep, load = replicas.replicas(t.incidence()), replicas.part_loads(t.elem())
    sets = rep.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("vert")))  # at most a row for each part
    one = lambda what, df: df.select(F.lit(what).alias("what"), "part", F.col("v").cast("double").alias("v"))
    rows = one("elements", load.withColumn("v", F.col("elems"))).unionByName(one("weight", load.withColumn("v", F.col("weight"))))
    rows = rows.unionByName(one("vertices", rep.groupBy("part").agg(F.count(F.lit(1)).alias("v"))))
    rows = rows.unionByName(one("neighbours", _pairs(rep).select("part", "peer").distinct().groupBy("part").agg(F.count(F.lit(1)).alias("v"))))
    rows = rows.unionByName(one("shared", sets.where("c > 1").groupBy("part").agg(F.count(F.lit(1)).alias("v"))))
    return rows.groupBy("what").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.max("v") / F.avg("v"), 6).alias("imbalance"))


@query("mesh_memory_by_type", f"WITH {MIXED}, t(type, verts) AS (VALUES ('tet', 4), ('hex', 8)) SELECT type, CAST(count(DISTINCT elem) * any_value(8 + 4 * verts) AS BIGINT) AS bytes FROM mdown JOIN t USING (type) GROUP BY type")
def memory_by_type(spark, sf_dir):
    """Bytes of element records by type: a head of eight and four for each vertex."""
    elem, _ = mixed(spark, sf_dir)
    return elem.join(F.broadcast(build.types(spark)), "type").groupBy("type").agg(F.sum(8 + 4 * F.col("verts")).alias("bytes"))


@query("mesh_dimension_imbalance", f"{W}, w AS (SELECT part, CASE WHEN count(*) = count(CASE WHEN weight > 0 THEN 1 END) THEN sum(weight)::DOUBLE ELSE count(*)::DOUBLE END AS w FROM elem GROUP BY part), v AS (SELECT part, CASE WHEN count(*) = count(CASE WHEN n > 2 THEN 1 END) THEN sum(n)::DOUBLE ELSE count(*)::DOUBLE END AS w FROM replica GROUP BY part) SELECT 3 AS dim, round(max(w) / avg(w), 9) AS imbalance FROM w UNION ALL SELECT 0, round(max(w) / avg(w), 9) FROM v")
def dimension_imbalance(spark, sf_dir):
    """Weights of a dimension count only where every entity of the part has one; else entities are counted."""
    t = Tables(spark, sf_dir)

    def one(dim, rows):
        w = F.when(F.count(F.lit(1)) == F.count("w"), F.sum("w").cast("double")).otherwise(F.count(F.lit(1)).cast("double"))
        return rows.groupBy("part").agg(w.alias("v")).agg(F.round(F.max("v") / F.avg("v"), 9).alias("imbalance")).select(F.lit(dim).alias("dim"), "imbalance")

    v = replicas.replicas(t.incidence()).select("part", F.when(F.col("n") > 2, F.col("n")).alias("w"))
    return one(3, t.elem().select("part", F.when(F.col("weight") > 0, F.col("weight")).alias("w"))).union(one(0, v))


_SIDES = f"WITH {REP}, t4 AS (SELECT elem, list(vert ORDER BY pos) AS vs FROM down GROUP BY elem), f AS (SELECT elem, part, array_to_string(list_sort(k), ',') AS k FROM (SELECT elem, [vs[1], vs[2], vs[3]] AS k FROM t4 UNION ALL SELECT elem, [vs[1], vs[2], vs[4]] FROM t4 UNION ALL SELECT elem, [vs[1], vs[3], vs[4]] FROM t4 UNION ALL SELECT elem, [vs[2], vs[3], vs[4]] FROM t4) JOIN elem USING (elem)), s AS (SELECT k, count(*) AS n, min(part) AS p, max(part) AS q, min(elem) AS lo, max(elem) AS hi FROM f GROUP BY k)"


def sides(spark, sf_dir) -> DataFrame:
    """key, n, lo, hi, p, q: the box's sides with their elements and those elements' least and greatest part."""
    b = box(spark, sf_dir)
    f = topology.boundary(b.down(), 3).join(b.elem().select("elem", "part"), "elem")
    return f.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("p"), F.max("part").alias("q"), F.min("elem").alias("lo"), F.max("elem").alias("hi"))


@query("mesh_boundary_blocks", f"{_SIDES} SELECT p AS part, 'tet' AS element, 'triangle' AS side, count(*) AS sides FROM s WHERE n = 1 GROUP BY p")
def boundary_blocks(spark, sf_dir):
    """Boundary sides of each part by the types of element and side."""
    s = sides(spark, sf_dir).where("n = 1")
    return s.groupBy(F.col("p").alias("part")).agg(F.count(F.lit(1)).alias("sides")).select("part", F.lit("tet").alias("element"), F.lit("triangle").alias("side"), "sides")


@query("mesh_interface_sides", f"{_SIDES} SELECT p AS part, q AS peer, count(*) AS sides FROM s WHERE n = 2 AND p <> q GROUP BY ALL")
def interface_sides(spark, sf_dir):
    """Sides between two parts, keyed by both."""
    return sides(spark, sf_dir).where("n = 2 and p <> q").groupBy(F.col("p").alias("part"), F.col("q").alias("peer")).agg(F.count(F.lit(1)).alias("sides"))


@query("mesh_tag_opposites", f"{_SIDES} SELECT lo AS elem, hi AS opposite FROM s WHERE n = 2 AND p <> q UNION ALL SELECT hi, lo FROM s WHERE n = 2 AND p <> q")
def tag_opposites(spark, sf_dir):
    """On sides between parts each element learns the id of the one across."""
    s = sides(spark, sf_dir).where("n = 2 and p <> q")
    return s.select(F.explode(F.array(F.struct(F.col("lo").alias("elem"), F.col("hi").alias("opposite")), F.struct(F.col("hi").alias("elem"), F.col("lo").alias("opposite")))).alias("x")).select("x.*")


@query("mesh_remote_copies", f"{W} SELECT a.vert, a.part, array_to_string(list(b.part ORDER BY b.part), ',') AS remotes FROM replica a JOIN replica b ON a.vert = b.vert AND a.part <> b.part GROUP BY ALL")
def remote_copies(spark, sf_dir):
    """The other parts that hold each copy's vertex."""
    rep = replicas.replicas(Tables(spark, sf_dir).incidence())
    sets = rep.groupBy("vert").agg(F.sort_array(F.collect_list("part")).alias("ps")).where("size(ps) > 1")
    x = sets.select("vert", F.explode("ps").alias("part"), "ps")
    return x.select("vert", "part", F.array_join(F.array_except("ps", F.array("part")), ",").alias("remotes"))


@query("mesh_edge_residence", f"{_SIDES}, e AS (SELECT elem, part, array_to_string(list_sort(k), ',') AS k FROM (SELECT elem, [vs[i], vs[j]] AS k FROM t4, (VALUES (1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)) p(i, j)) JOIN elem USING (elem)), x AS (SELECT k, count(DISTINCT part) AS parts FROM e GROUP BY k) SELECT parts, count(*) AS edges FROM x GROUP BY parts")
def edge_residence(spark, sf_dir):
    """On how many parts edges reside, from their vertices' keys."""
    b = box(spark, sf_dir)
    e = topology.boundary(b.down(), 2).join(b.elem().select("elem", "part"), "elem")
    return e.groupBy("key").agg(F.count_distinct("part").alias("parts")).groupBy("parts").agg(F.count(F.lit(1)).alias("edges"))


@query("mesh_closure_residence", f"WITH {REP} SELECT elem, count(DISTINCT r.part) AS parts FROM down d JOIN replica r ON r.vert = d.vert GROUP BY elem")
def closure_residence(spark, sf_dir):
    """The parts on which anything in an element's closure resides."""
    b = box(spark, sf_dir)
    rep = replicas.replicas(b.down().join(b.elem(), "elem")).groupBy("vert").agg(F.collect_set("part").alias("ps"))
    x = b.down().join(rep, "vert").groupBy("elem").agg(F.array_distinct(F.flatten(F.collect_list("ps"))).alias("ps"))
    return x.select("elem", F.size("ps").cast("long").alias("parts"))


@query("mesh_flag_union", f"{W}, f AS (SELECT vert, part, (1 << part)::INT AS flag FROM replica) SELECT vert, part, bit_or(flag) OVER (PARTITION BY vert) AS flag FROM f")
def flag_union(spark, sf_dir):
    """Every copy takes the flags of all copies."""
    rep = replicas.replicas(Tables(spark, sf_dir).incidence()).withColumn("flag", F.expr("shiftleft(1, part)"))
    return rep.select("vert", "part").join(rep.groupBy("vert").agg(F.bit_or("flag").alias("flag")), "vert")


@query("mesh_csr_lists", f"{_SIDES}, a AS (SELECT lo AS elem, hi AS other FROM s WHERE n = 2 UNION ALL SELECT hi, lo FROM s WHERE n = 2), d AS (SELECT elem.elem, count(a.other) AS degree, coalesce(array_to_string(list(a.other ORDER BY a.other), ','), '') AS others FROM elem LEFT JOIN a USING (elem) GROUP BY elem.elem) SELECT elem, CAST(sum(degree) OVER (ORDER BY elem) - degree AS BIGINT) AS first, others FROM d")
def csr_lists(spark, sf_dir):
    """Neighbours of each element in compressed rows: where its list begins, and the list."""
    b = box(spark, sf_dir)
    near = topology.neighbours(topology.boundary(b.down(), 3)).groupBy("elem").agg(F.sort_array(F.collect_list("other")).alias("o"))
    rows = b.elem().select("elem").join(near, "elem", "left").select("elem", F.coalesce("o", F.array().cast("array<bigint>")).alias("o")).withColumn("degree", F.size("o").cast("long"))
    return numbering.running(rows.withColumn("all", F.lit(0)), "all", "degree", "elem").select("elem", F.col("before").alias("first"), F.array_join("o", ",").alias("others"))
