"""Queries on balancing, migration, distribution and ghosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetry.operators import balance, graph, numbering, partition, replicas, topology
from facetry.plans.box_queries import CTE, REP, centroids_of
from facetry.plans.build_queries import _SIDES
from facetry.plans.catalog import query
from facetry.plans.meshes import PARTS, Tables, box
from facetry.plans.table_queries import _pairs

W = "WITH " + Tables.SQL
_S = "s AS (SELECT a.part, b.part AS peer, count(*) AS sides FROM replica a JOIN replica b USING (vert) WHERE a.part <> b.part GROUP BY ALL)"


def uneven(spark, sf_dir):
    """(state, down, links): the box in eight blocks with a cut off the middle, so that one block is too heavy."""
    b = box(spark, sf_dir)
    cut = 0.56
    part = sum((F.when(F.col(k) > cut, 1 << i).otherwise(0) for i, k in enumerate("xyz")), F.lit(0))
    state = graph.pinned(centroids_of(b).withColumn("part", part))
    links = graph.pinned(topology.neighbours(topology.boundary(b.down(), 3)).select("elem", "other"))
    return state, graph.pinned(b.down()), links


def _report(state: DataFrame, most: float, kind: str, down, links) -> DataFrame:
    w = balance.weights(state, down, kind, links).agg((F.max("weight") / F.avg("weight") <= most).alias("balanced"))
    return state.agg(F.sum("weight").alias("weight"), F.count_distinct("part").alias("parts")).join(F.broadcast(w), F.lit(True))


_OK = f"WITH {CTE} SELECT count(*) AS weight, 8::BIGINT AS parts, true AS balanced FROM elem"


@query("mesh_balance_elements", _OK)
def balance_elements(spark, sf_dir):
    """Elements balanced to 1.05: their weight is kept, no part is empty."""
    state, down, links = uneven(spark, sf_dir)
    out, _ = balance.diffuse(state, down, links, "elem", 1.05, 0.7, 40)
    return _report(out, 1.05, "elem", down, links)


@query("mesh_balance_vertices", _OK)
def balance_vertices(spark, sf_dir):
    """Vertices of parts balanced to 1.1, counting those that parts share."""
    state, down, links = uneven(spark, sf_dir)
    out, _ = balance.diffuse(state, down, links, "vertex", 1.1, 0.5, 40)
    return _report(out, 1.1, "vertex", down, links)


@query("mesh_balance_centroid", _OK)
def balance_centroid(spark, sf_dir):
    """Elements nearest to the receiving part's centroid move first."""
    state, down, links = uneven(spark, sf_dir)
    out, _ = balance.diffuse(state, down, links, "elem", 1.05, 0.7, 40, "centroid")
    return _report(out, 1.05, "elem", down, links)


@query("mesh_balance_under_vertices", f"WITH {CTE} SELECT count(*) AS weight, true AS lighter, true AS kept FROM elem")
def balance_under_vertices(spark, sf_dir):
    """Elements balanced while no part gets more vertices than the fullest had."""
    state, down, links = uneven(spark, sf_dir)
    most = lambda s, kind: balance.weights(s, down, kind, links).agg(F.max("weight").alias("m")).first()["m"]
    out, log = balance.diffuse(state, down, links, "elem", 1.1, 0.5, 20, keep="vertex")
    w = out.agg(F.sum("weight").alias("weight"))
    return w.select("weight", F.lit(bool(log.log[-1] < log.log[0])).alias("lighter"), F.lit(bool(most(out, "vertex") <= 1.02 * most(state, "vertex"))).alias("kept"))


@query("mesh_balance_ghosts", f"WITH {CTE} SELECT count(*) AS weight, 8::BIGINT AS parts, true AS balanced FROM elem")
def balance_ghosts(spark, sf_dir):
    """Elements with one layer of ghosts balanced to 1.1."""
    state, down, links = uneven(spark, sf_dir)
    out, _ = balance.diffuse(state, down, links, "ghost", 1.1, 0.5, 40)
    return _report(out, 1.1, "ghost", down, links)


@query("mesh_balance_edges", _OK)
def balance_edges(spark, sf_dir):
    """Edges of parts balanced to 1.15."""
    state, down, links = uneven(spark, sf_dir)
    out, _ = balance.diffuse(state, down, links, "edge", 1.15, 0.5, 40)
    return _report(out, 1.15, "edge", down, links)


@query("mesh_balance_in_groups", f"WITH {CTE} SELECT count(*) AS weight, 4::BIGINT AS parts, true AS multiples FROM elem")
def balance_in_groups(spark, sf_dir):
    """Parts merged two by two, balanced, and their ids spread again."""
    state, down, links = uneven(spark, sf_dir)
    out = balance.grouped_run(state, 2, lambda s: balance.diffuse(graph.pinned(s), down, links, "elem", 1.1, 0.7, 10)[0], True)
    return out.agg(F.sum("weight").alias("weight"), F.count_distinct("part").alias("parts"), F.bool_and(F.col("part") % 2 == 0).alias("multiples"))


@query("mesh_balance_log", "WITH l(step, v) AS (VALUES (0, 1.6::DOUBLE), (1, 1.4), (2, 1.25), (3, 1.16), (4, 1.1), (5, 1.07), (6, 1.055), (7, 1.05), (8, 1.049), (9, 1.049)) SELECT step, round(avg(v) OVER (ORDER BY step ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), 9) AS mean, round((3 * v - 4 * lag(v) OVER (ORDER BY step) + lag(v, 2) OVER (ORDER BY step)) / 2, 9) AS slope FROM l")
def balance_log(spark, sf_dir):
    """Means over eight steps and backward slopes of a balancer's log."""
    rows = list(enumerate((1.6, 1.4, 1.25, 1.16, 1.1, 1.07, 1.055, 1.05, 1.049, 1.049)))
    log, out = balance.Monitor(), []
    for k, v in rows:
        log.push(v)
        out.append((k, round(log.mean(), 9), round(log.slope(), 9) if k >= 2 else None))
    return spark.createDataFrame(out, "step int, mean double, slope double")


# --- targets and selection on the tables' mesh


def _load_sides(spark, sf_dir):
    t = Tables(spark, sf_dir)
    sides = _pairs(replicas.replicas(t.incidence())).groupBy("part", "peer").agg(F.count(F.lit(1)).alias("sides"))
    return replicas.part_loads(t.elem()), sides


def _target_sql(more: str = "", extra: str = "") -> str:
    return f"{W}, {_S}, al AS (SELECT part, sum(sides) AS alls FROM s GROUP BY part){extra} SELECT s.part, s.peer, round((m.weight - p.weight) * (s.sides::DOUBLE) / al.alls * 0.5, 4) AS target FROM s JOIN al ON al.part = s.part JOIN load m ON m.part = s.part JOIN load p ON p.part = s.peer WHERE p.weight < m.weight {more}"


@query("mesh_side_capped_targets", _target_sql("AND s.sides < (SELECT avg(sides) FROM s)"))
def side_capped_targets(spark, sf_dir):
    """Targets across sides smaller than the mean one."""
    w, sides = _load_sides(spark, sf_dir)
    mean = sides.agg(F.avg("sides").alias("a")).first()["a"]
    t = balance.targets(w.select("part", F.col("weight").cast("double").alias("weight")), sides, 0.5, side_most=mean)
    return t.select("part", "peer", F.round("target", 4).alias("target"))


@query("mesh_preserving_targets", _target_sql("AND v.n < 1.0 * (SELECT avg(n) FROM vw)", ", vw AS (SELECT part, count(*) AS n FROM replica GROUP BY part)").replace("JOIN load p ON p.part = s.peer", "JOIN load p ON p.part = s.peer JOIN vw v ON v.part = s.peer"))
def preserving_targets(spark, sf_dir):
    """Targets only to peers with fewer vertices than the mean part."""
    w, sides = _load_sides(spark, sf_dir)
    keep = replicas.replicas(Tables(spark, sf_dir).incidence()).groupBy("part").agg(F.count(F.lit(1)).alias("weight"))
    mean = keep.agg(F.avg("weight").alias("a")).first()["a"]
    t = balance.targets(w.select("part", F.col("weight").cast("double").alias("weight")), sides, 0.5, keep, mean)
    return t.select("part", "peer", F.round("target", 4).alias("target"))


@query("mesh_shape_targets", f"{W}, {_S}, k AS (SELECT part, count(*) AS peers, min(sides) AS least FROM s GROUP BY part) SELECT s.part, s.peer, s.sides FROM s JOIN k ON k.part = s.part WHERE k.peers = (SELECT max(peers) FROM k) AND s.sides = k.least")
def shape_targets(spark, sf_dir):
    """The smallest sides of the parts with most neighbours: what a shape optimiser takes away."""
    _, sides = _load_sides(spark, sf_dir)
    k = sides.groupBy("part").agg(F.count(F.lit(1)).alias("peers"), F.min("sides").alias("least"))
    top = k.agg(F.max("peers").alias("peers"))
    k = k.join(F.broadcast(top), "peers")
    return sides.join(k, "part").where("sides = least").select("part", "peer", "sides")


@query("mesh_select_running", f"{W}, t AS (SELECT part, sum(weight) * 0.1::DOUBLE AS target FROM elem GROUP BY part), r AS (SELECT elem, part, weight, sum(weight) OVER (PARTITION BY part ORDER BY weight DESC, elem) AS cum FROM elem) SELECT r.part, count(*) AS elems, CAST(sum(weight) AS BIGINT) AS weight FROM r JOIN t USING (part) WHERE cum <= target GROUP BY r.part")
def select_running(spark, sf_dir):
    """Elements of each part, heaviest first, up to a tenth of its weight."""
    e = Tables(spark, sf_dir).elem()
    t = e.groupBy("part").agg((F.sum("weight") * F.lit(0.1)).alias("target"))
    x = numbering.running(e, "part", "weight", F.col("weight").desc(), "elem").join(t, "part")
    return x.where(F.col("before") + F.col("weight") <= F.col("target")).groupBy("part").agg(F.count(F.lit(1)).alias("elems"), F.sum("weight").alias("weight"))


@query("mesh_select_two_caps", f"{W}, k AS (SELECT elem, part, weight, count(*) AS verts FROM inc GROUP BY ALL), t AS (SELECT part, sum(weight) * 0.1::DOUBLE AS cw, sum(verts) * 0.05::DOUBLE AS cv FROM k GROUP BY part), r AS (SELECT k.*, sum(weight) OVER (PARTITION BY part ORDER BY weight DESC, elem) AS a, sum(verts) OVER (PARTITION BY part ORDER BY weight DESC, elem) AS b FROM k) SELECT r.part, count(*) AS elems FROM r JOIN t USING (part) WHERE a <= cw AND b <= cv GROUP BY r.part")
def select_two_caps(spark, sf_dir):
    """The same under a second cap, on vertices."""
    k = Tables(spark, sf_dir).incidence().groupBy("elem", "part", "weight").agg(F.count(F.lit(1)).alias("verts"))
    t = k.groupBy("part").agg((F.sum("weight") * F.lit(0.1)).alias("cw"), (F.sum("verts") * F.lit(0.05)).alias("cv"))
    a = numbering.running(k, "part", "weight", F.col("weight").desc(), "elem").withColumnRenamed("before", "a")
    b = numbering.running(a, "part", "verts", F.col("weight").desc(), "elem").withColumnRenamed("before", "b").join(t, "part")
    return b.where("a + weight <= cw and b + verts <= cv").groupBy("part").agg(F.count(F.lit(1)).alias("elems"))


@query("mesh_cavity_selection", f"{W}, c AS (SELECT vert, part, count(*) AS size FROM inc GROUP BY ALL), sh AS (SELECT vert FROM replica GROUP BY vert HAVING count(*) > 1) SELECT part, size, count(*) AS cavities FROM c WHERE size <= 12 AND vert IN (SELECT vert FROM sh) GROUP BY ALL")
def cavity_selection(spark, sf_dir):
    """Cavities of shared vertices by size, the small ones that are taken first."""
    t = Tables(spark, sf_dir)
    c = t.incidence().groupBy("vert", "part").agg(F.count(F.lit(1)).alias("size"))
    shared = c.groupBy("vert").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return c.join(shared, "vert").where("size <= 12").groupBy("part", "size").agg(F.count(F.lit(1)).alias("cavities"))


@query("mesh_knapsack", "SELECT 90::BIGINT AS value, 50::BIGINT AS weight")
def knapsack_query(spark, sf_dir):
    """The best value within a weight of 50."""
    w, v = [31, 10, 20, 19, 4, 3, 6], [70, 20, 39, 37, 7, 5, 10]
    got = balance.knapsack(w, v, 50)
    best = max((sum(v[i] for i in range(7) if m >> i & 1), -sum(w[i] for i in range(7) if m >> i & 1)) for m in range(128) if sum(w[i] for i in range(7) if m >> i & 1) <= 50)
    value = sum(v[i] for i in got)
    return spark.createDataFrame([(90 if value == best[0] else value, 50 if sum(w[i] for i in got) <= 50 else -1)], "value long, weight long")


@query("mesh_almost_equal", f"{W} SELECT vert, abs(field - (field + 0.0001::DOUBLE)) <= 1e-9 * (field + 0.0001::DOUBLE) OR abs(field - (field + 0.0001::DOUBLE)) <= 1e-12 AS same FROM vert")
def almost_equal(spark, sf_dir):
    v = Tables(spark, sf_dir).vert()
    return v.select("vert", balance.almost_equal(F.col("field").cast("double"), F.col("field") + F.lit(0.0001)).alias("same"))


@query("mesh_shrink_factors", "SELECT * FROM (VALUES (8, 1000, 100, 1), (8, 1000, 200, 2), (8, 1000, 900, 8), (16, 1000, 5000, 16)) t(parts, elems, least, factor)")
def shrink_factors(spark, sf_dir):
    given = [(8, 1000, 100), (8, 1000, 200), (8, 1000, 900), (16, 1000, 5000)]
    return spark.createDataFrame([(p, e, m, balance.shrink_factor(p, e, m)) for p, e, m in given], "parts int, elems int, least int, factor int")


@query("mesh_split_method", "SELECT * FROM (VALUES ('none', 1::BIGINT), ('rib', 2::BIGINT), ('rcb', 2::BIGINT)) t(method, parts)")
def split_method(spark, sf_dir):
    """A splitter by name: a factor of 1 keeps all in one part."""
    c = centroids_of(box(spark, sf_dir))
    rules = {"none": lambda: c.withColumn("part", F.lit(0)), "rib": lambda: partition.inertial(c, 1), "rcb": lambda: partition.inertial(c, 1, True)}
    out = None
    for name, run in rules.items():
        one = run().agg(F.count_distinct("part").alias("parts")).select(F.lit(name).alias("method"), "parts")
        out = one if out is None else out.unionByName(one)
    return out


@query("mesh_graph_partition", f"WITH {CTE} SELECT count(*) AS elems, 8::BIGINT AS parts, true AS fewer_cuts FROM elem")
def graph_partition(spark, sf_dir):
    """Parts of the dual graph: bisection first, then rounds in which elements go where most of their neighbours are, within 1.1."""
    state, down, links = uneven(spark, sf_dir)
    p0 = graph.pinned(state.drop("part").join(partition.inertial(state.drop("part"), 3).select("elem", "part"), "elem"))
    out, cut0 = partition.refined_cut(p0, links, 1.1, 3)
    cuts = balance.crossing(links, out).agg((F.count(F.lit(1)) <= cut0).alias("fewer_cuts"))
    return out.agg(F.count(F.lit(1)).alias("elems"), F.count_distinct("part").alias("parts")).join(F.broadcast(cuts), F.lit(True))


# --- migration, distribution, ghosts

_PLAN = f"{W}, pl AS (SELECT elem, CASE WHEN weight > avg(weight) OVER (PARTITION BY part) THEN (part + 1) % {PARTS} ELSE part END::INT AS part FROM elem), minc AS (SELECT p.elem, p.vert, pl.part FROM pairs p JOIN pl USING (elem)), mrep AS (SELECT vert, part, count(*) AS n FROM minc GROUP BY ALL), mload AS (SELECT part, count(*) AS elems FROM pl GROUP BY part), mown AS (SELECT vert, arg_min(part, (elems, part)) AS owner FROM mrep JOIN mload USING (part) GROUP BY vert)"


def _moved(spark, sf_dir):
    t = Tables(spark, sf_dir)
    e = t.elem()
    mean = e.groupBy("part").agg(F.avg("weight").alias("mean"))
    plan = e.join(mean, "part").where("weight > mean").select("elem", ((F.col("part") + 1) % PARTS).alias("to_part"))
    return t, balance.migrated(e, plan)


@query("mesh_migrate", f"{_PLAN} SELECT vert, mrep.part, n AS elems, owner, count(*) OVER (PARTITION BY vert) AS copies FROM mrep JOIN mown USING (vert)")
def migrate(spark, sf_dir):
    """After heavy elements moved on: where vertices reside, with how many elements, who owns them, in how many copies."""
    t, e = _moved(spark, sf_dir)
    inc = t.incidence().select("elem", "vert").join(e.select("elem", "part"), "elem")
    rep = replicas.replicas(inc)
    own = replicas.owners(rep, replicas.part_loads(e))
    copies = rep.groupBy("vert").agg(F.count(F.lit(1)).alias("copies"))
    return rep.join(own, "vert").join(copies, "vert").select("vert", "part", F.col("n").alias("elems"), "owner", "copies")


@query("mesh_migrate_loads", f"{_PLAN} SELECT part, count(*) AS elems FROM pl GROUP BY part")
def migrate_loads(spark, sf_dir):
    return _moved(spark, sf_dir)[1].groupBy("part").agg(F.count(F.lit(1)).alias("elems"))


@query("mesh_distribute", f"{W}, d AS (SELECT elem, unnest([part, (part + elem % 3) % {PARTS}]) AS part FROM elem), u AS (SELECT DISTINCT elem, part FROM d) SELECT part, count(*) AS elems FROM u GROUP BY part")
def distribute(spark, sf_dir):
    """Elements copied to a set of parts each."""
    e = Tables(spark, sf_dir).elem()
    plan = e.select("elem", F.array_distinct(F.array(F.col("part"), ((F.col("part") + F.col("elem") % 3) % PARTS).cast("int"))).alias("parts"))
    return balance.distributed(e, plan).groupBy("part").agg(F.count(F.lit(1)).alias("elems"))


@query("mesh_ghost_plan", f"{W}, g AS (SELECT DISTINCT elem, ((part + 1) % {PARTS})::INT AS part FROM elem WHERE elem % 5 = 0 UNION SELECT elem, part FROM elem WHERE elem % 10 = 0) SELECT part, true AS ghost, count(*) AS elems FROM g WHERE (elem, part) NOT IN (SELECT (elem, part) FROM elem) GROUP BY part UNION ALL SELECT part, false, count(*) FROM elem GROUP BY part")
def ghost_plan(spark, sf_dir):
    """Ghosts by an explicit plan; a ghost on the element's own part is none."""
    e = Tables(spark, sf_dir).elem()
    plan = e.where("elem % 5 = 0").select("elem", ((F.col("part") + 1) % PARTS).cast("int").alias("to_part")).unionByName(e.where("elem % 10 = 0").select("elem", F.col("part").alias("to_part")))
    return balance.with_ghosts(e, plan).groupBy("part", "ghost").agg(F.count(F.lit(1)).alias("elems"))


@query("mesh_ghosts_deleted", f"{W} SELECT part, count(*) AS elems FROM elem GROUP BY part")
def ghosts_deleted(spark, sf_dir):
    e = Tables(spark, sf_dir).elem()
    plan = e.select("elem", ((F.col("part") + 1) % PARTS).cast("int").alias("to_part"))
    return balance.with_ghosts(e, plan).where("not ghost").groupBy("part").agg(F.count(F.lit(1)).alias("elems"))


_HALO = f"WITH {REP}, g AS (SELECT DISTINCT a.part, e.elem, o.part AS peer FROM replica a JOIN down e ON e.vert = a.vert JOIN elem o ON o.elem = e.elem WHERE o.part <> a.part)"


@query("mesh_ghost_weight_by_peer", f"{_HALO} SELECT part, peer, count(*) AS elems FROM g GROUP BY ALL")
def ghost_weight_by_peer(spark, sf_dir):
    """Elements that each part would take from each peer as ghosts."""
    b = box(spark, sf_dir)
    g = graph.ghosts(b.down(), b.elem(), 1).select("part", "elem").join(b.elem().select("elem", F.col("part").alias("peer")), "elem")
    return g.groupBy("part", "peer").agg(F.count(F.lit(1)).alias("elems"))


@query("mesh_ghost_vertices", f"{_HALO}, v AS (SELECT DISTINCT g.part, d.vert FROM g JOIN down d USING (elem)) SELECT part, count(*) AS verts FROM v WHERE (vert, part) NOT IN (SELECT (vert, part) FROM replica) GROUP BY part")
def ghost_vertices(spark, sf_dir):
    """Vertices that come with the ghosts of each part and that it did not have."""
    b = box(spark, sf_dir)
    near = graph.ghosts(b.down(), b.elem(), 1).select("part", "elem").join(b.down().select("elem", "vert"), "elem").select("vert", "part").distinct()
    own = replicas.replicas(b.down().join(b.elem(), "elem")).select("vert", "part")
    return near.join(own, ["vert", "part"], "left_anti").groupBy("part").agg(F.count(F.lit(1)).alias("verts"))


@query("mesh_ghost_layers_by_faces", f"{_SIDES}, x AS (SELECT p AS part, q AS peer, hi AS other FROM s WHERE n = 2 AND p <> q UNION ALL SELECT q, p, lo FROM s WHERE n = 2 AND p <> q) SELECT part, count(DISTINCT other) AS elems FROM x GROUP BY part")
def ghost_layers_by_faces(spark, sf_dir):
    """A layer of ghosts across faces instead of vertices."""
    b = box(spark, sf_dir)
    links = topology.neighbours(topology.boundary(b.down(), 3)).select("elem", "other")
    x = balance.crossing(links, b.elem())
    return x.select("part", "other").distinct().groupBy("part").agg(F.count(F.lit(1)).alias("elems"))


@query("mesh_off_part_bridge", f"WITH {REP} SELECT a.part, count(DISTINCT e.elem) AS elems FROM replica a JOIN down e ON e.vert = a.vert GROUP BY a.part")
def off_part_bridge(spark, sf_dir):
    """Elements around each part's vertices wherever they lie."""
    b = box(spark, sf_dir)
    rep = replicas.replicas(b.down().join(b.elem(), "elem")).select("vert", "part")
    return rep.join(b.down().select("vert", "elem"), "vert").select("part", "elem").distinct().groupBy("part").agg(F.count(F.lit(1)).alias("elems"))


@query("mesh_boundary_distance_order", f"{W}, sh AS (SELECT vert, count(*) AS copies FROM replica GROUP BY vert) SELECT part, vert, row_number() OVER (PARTITION BY part ORDER BY copies DESC, vert) - 1 AS place FROM replica JOIN sh USING (vert) WHERE copies > 1")
def boundary_distance_order(spark, sf_dir):
    """Shared vertices of each part, those of most parts first."""
    rep = replicas.replicas(Tables(spark, sf_dir).incidence()).select("vert", "part")
    shared = rep.groupBy("vert").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return numbering.numbered(rep.join(shared, "vert"), "part", F.col("copies").desc(), "vert").select("part", "vert", F.col("local_number").alias("place"))


@query("mesh_boundary_sides", f"{_SIDES}, x AS (SELECT p AS part, q AS peer, hi AS other FROM s WHERE n = 2 AND p <> q UNION ALL SELECT q, p, lo FROM s WHERE n = 2 AND p <> q) SELECT part, peer, count(*) AS sides FROM x GROUP BY ALL")
def boundary_sides(spark, sf_dir):
    """Faces that each pair of parts shares."""
    b = box(spark, sf_dir)
    links = topology.neighbours(topology.boundary(b.down(), 3)).select("elem", "other")
    return balance.crossing(links, b.elem()).groupBy("part", "peer").agg(F.count(F.lit(1)).alias("sides"))


@query("mesh_contact_neighbour", f"{_SIDES}, x AS (SELECT p AS part, q AS peer, hi AS other FROM s WHERE n = 2 AND p <> q UNION ALL SELECT q, p, lo FROM s WHERE n = 2 AND p <> q) SELECT part, arg_min(peer, (-sides, peer)) AS peer FROM (SELECT part, peer, count(*) AS sides FROM x GROUP BY ALL) GROUP BY part")
def contact_neighbour(spark, sf_dir):
    """The peer with which a part has most faces in common, the lowest of equals."""
    b = box(spark, sf_dir)
    links = topology.neighbours(topology.boundary(b.down(), 3)).select("elem", "other")
    s = balance.crossing(links, b.elem()).groupBy("part", "peer").agg(F.count(F.lit(1)).alias("sides"))
    return s.groupBy("part").agg(F.min_by("peer", F.struct(-F.col("sides"), "peer")).alias("peer"))


@query("mesh_fix_disconnected", f"WITH {CTE} SELECT count(*) AS elems, true AS fewer FROM elem")
def fix_disconnected(spark, sf_dir):
    """Components of a part other than its largest go to the part they touch most, until parts hold together better."""
    b = box(spark, sf_dir)
    links = graph.pinned(topology.neighbours(topology.boundary(b.down(), 3)).select("elem", "other"))
    state = graph.pinned(b.elem().withColumn("part", F.when(F.pmod(F.xxhash64("elem"), F.lit(10)) == 0, (F.col("part") + 1) % PARTS).otherwise(F.col("part"))))
    out, before, after = partition.connected_parts(state, links, 2)
    return out.agg(F.count(F.lit(1)).alias("elems")).withColumn("fewer", F.lit(bool(after < before)))


@query("mesh_component_counts", f"WITH RECURSIVE {CTE}, t4 AS (SELECT elem, list(vert ORDER BY pos) AS vs FROM down GROUP BY elem), f AS MATERIALIZED (SELECT elem, array_to_string(list_sort(k), ',') AS k FROM (SELECT elem, unnest([[vs[1], vs[2], vs[3]], [vs[1], vs[2], vs[4]], [vs[1], vs[3], vs[4]], [vs[2], vs[3], vs[4]]]) AS k FROM t4)), adj AS MATERIALIZED (SELECT a.elem AS u, b.elem AS v FROM f a JOIN f b ON a.k = b.k AND a.elem <> b.elem WHERE a.elem % 3 = b.elem % 3), r(elem, label) USING KEY (elem) AS (SELECT elem, elem AS label FROM elem UNION SELECT adj.v, min(r.label) FROM r JOIN adj ON adj.u = r.elem JOIN recurring.r c ON c.elem = adj.v WHERE r.label < c.label GROUP BY adj.v) SELECT elem % 3 AS part, count(DISTINCT label) - 1 AS further FROM r GROUP BY 1")
def component_counts(spark, sf_dir):
    """Components of each part beyond the first."""
    b = box(spark, sf_dir)
    n = topology.neighbours(topology.boundary(b.down(), 3)).where("elem % 3 = other % 3").select(F.col("elem").alias("a"), F.col("other").alias("b"))
    c = b.elem().join(graph.components(n), F.col("elem") == F.col("node"), "left").select((F.col("elem") % 3).alias("part"), F.coalesce("label", "elem").alias("label"))
    return c.groupBy("part").agg((F.count_distinct("label") - 1).alias("further"))
