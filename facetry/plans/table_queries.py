"""Queries on the mesh of the driver's tables: replicas, numbering, partition statistics, migration, tags, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetry.operators import numbering, partition, replicas
from facetry.plans.catalog import query
from facetry.plans.meshes import PARTS, Tables

CTE = Tables.SQL
W = "WITH " + CTE


def _rep(t: Tables) -> DataFrame:
    return replicas.replicas(t.incidence())


def _own(t: Tables) -> DataFrame:
    return replicas.owners(_rep(t), replicas.part_loads(t.elem()))


@query("mesh_owner_of_vertices", f"{W} SELECT vert, owner FROM owner")
def owner_of_vertices(spark, sf_dir):
    return _own(Tables(spark, sf_dir))


@query("mesh_residence", f"{W} SELECT vert, array_to_string(list_sort(list(part)), ',') AS parts, count(*) AS copies FROM replica GROUP BY vert")
def residence(spark, sf_dir):
    r = _rep(Tables(spark, sf_dir))
    return r.groupBy("vert").agg(F.array_join(F.sort_array(F.collect_list("part")), ",").alias("parts"), F.count(F.lit(1)).alias("copies"))


@query("mesh_residence_peers", f"{W} SELECT a.part, b.part AS peer, count(*) AS shared FROM replica a JOIN replica b USING (vert) WHERE a.part <> b.part GROUP BY ALL")
def residence_peers(spark, sf_dir):
    """Vertices that each pair of parts shares; the residence of a vertex has at most as many entries as there are parts."""
    return _pairs(_rep(Tables(spark, sf_dir))).groupBy("part", "peer").agg(F.count(F.lit(1)).alias("shared"))


def _pairs(rep: DataFrame) -> DataFrame:
    sets = rep.groupBy("vert").agg(F.collect_set("part").alias("ps")).where(F.size("ps") > 1)
    return sets.select("vert", F.explode("ps").alias("part"), "ps").select("vert", "part", F.explode("ps").alias("peer")).where("part <> peer")


@query("mesh_accumulate", f"{W} SELECT vert, part, n, sum(n) OVER (PARTITION BY vert)::BIGINT AS total FROM replica")
def accumulate(spark, sf_dir):
    """The sum over all copies, written to every copy."""
    return replicas.reduced(_rep(Tables(spark, sf_dir)), F.col("n")).select("vert", "part", "n", F.col("reduced").alias("total"))


@query("mesh_reduce_min", f"{W} SELECT vert, part, min(n) OVER (PARTITION BY vert) AS least FROM replica")
def reduce_min(spark, sf_dir):
    return replicas.reduced(_rep(Tables(spark, sf_dir)), F.col("n"), F.min).select("vert", "part", F.col("reduced").alias("least"))


@query("mesh_reduce_max", f"{W} SELECT vert, part, max(n) OVER (PARTITION BY vert) AS most FROM replica")
def reduce_max(spark, sf_dir):
    return replicas.reduced(_rep(Tables(spark, sf_dir)), F.col("n"), F.max).select("vert", "part", F.col("reduced").alias("most"))


@query("mesh_synchronize", f"{W} SELECT r.vert, r.part, o.n AS synced FROM replica r JOIN owner USING (vert) JOIN replica o ON o.vert = r.vert AND o.part = owner")
def synchronize(spark, sf_dir):
    """The owner's value overwrites all copies."""
    t = Tables(spark, sf_dir)
    rep = _rep(t)
    return replicas.synchronised(rep, _own(t), "n").select("vert", "part", "synced")


@query("mesh_count_owned", f"{W} SELECT owner AS part, count(*) AS owned FROM owner GROUP BY owner")
def count_owned(spark, sf_dir):
    return _own(Tables(spark, sf_dir)).groupBy(F.col("owner").alias("part")).agg(F.count(F.lit(1)).alias("owned"))


@query("mesh_part_boundary", f"{W} SELECT part, count(*) AS shared FROM replica WHERE vert IN (SELECT vert FROM replica GROUP BY vert HAVING count(*) > 1) GROUP BY part")
def part_boundary(spark, sf_dir):
    r = _rep(Tables(spark, sf_dir)).withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("vert")))
    return r.where("copies > 1").groupBy("part").agg(F.count(F.lit(1)).alias("shared"))


@query("mesh_exscan", f"{W} SELECT part, elems, CAST(sum(elems) OVER (ORDER BY part) - elems AS BIGINT) AS before FROM load")
def exscan(spark, sf_dir):
    return numbering.scanned(replicas.part_loads(Tables(spark, sf_dir).elem()), "part", "elems").select("part", "elems", "before")


@query("mesh_number_owned", f"{W}, n AS (SELECT vert, owner, row_number() OVER (PARTITION BY owner ORDER BY vert) - 1 AS l FROM owner), c AS (SELECT owner, sum(count(*)) OVER (ORDER BY owner) - count(*) AS before FROM owner GROUP BY owner) SELECT vert, owner, l AS local_number, CAST(l + before AS BIGINT) AS global_number FROM n JOIN c USING (owner)")
def number_owned(spark, sf_dir):
    return numbering.numbered(_own(Tables(spark, sf_dir)), "owner", "vert").select("vert", "owner", "local_number", "global_number")


@query("mesh_number_overlap", f"{W} SELECT vert, part, row_number() OVER (PARTITION BY part ORDER BY vert) - 1 AS number FROM replica")
def number_overlap(spark, sf_dir):
    """Every copy counts as owned."""
    return numbering.numbered(_rep(Tables(spark, sf_dir)), "part", "vert").select("vert", "part", F.col("local_number").alias("number"))


@query("mesh_group_numbering", f"{W}, x AS (SELECT elem, part, part // 4 AS grp FROM elem) SELECT elem, grp, row_number() OVER (PARTITION BY grp ORDER BY part, elem) - 1 AS number FROM x")
def group_numbering(spark, sf_dir):
    """Numbers start again for each group of four parts."""
    e = Tables(spark, sf_dir).elem().select("elem", "part", F.floor(F.col("part") / 4).cast("int").alias("grp"))
    return numbering.numbered(e, "grp", "part", "elem").select("elem", "grp", F.col("local_number").alias("number"))


@query("mesh_reorder", f"{W} SELECT vert, row_number() OVER (ORDER BY class, vert) - 1 AS new_id FROM vert")
def reorder(spark, sf_dir):
    """Vertices renumbered by class, then id; offsets of classes by a scan."""
    v = Tables(spark, sf_dir).vert()
    return numbering.numbered(v, "class", "vert").select("vert", F.col("global_number").alias("new_id"))


@query("mesh_entity_imbalance", f"{W} SELECT 3 AS dim, round(max(elems) / (sum(elems) / {PARTS}.0::DOUBLE), 9) AS imbalance FROM load UNION ALL SELECT 0, round(max(n) / (sum(n) / {PARTS}.0::DOUBLE), 9) FROM (SELECT part, count(*) AS n FROM replica GROUP BY part)")
def entity_imbalance(spark, sf_dir):
    """Most over mean, vertices counted on every part that holds them."""
    t = Tables(spark, sf_dir)
    one = lambda d, df, c: df.agg(F.round(F.max(c) / (F.sum(c) / F.lit(float(PARTS))), 9).alias("imbalance")).select(F.lit(d).alias("dim"), "imbalance")
    return one(3, replicas.part_loads(t.elem()), "elems").union(one(0, _rep(t).groupBy("part").agg(F.count(F.lit(1)).alias("n")), "n"))


@query("mesh_weighted_imbalance", f"{W} SELECT round(max(weight) / (sum(weight) / {PARTS}.0::DOUBLE), 9) AS imbalance, CAST(max(weight) AS BIGINT) AS most FROM load")
def weighted_imbalance(spark, sf_dir):
    return replicas.part_loads(Tables(spark, sf_dir).elem()).agg(F.round(F.max("weight") / (F.sum("weight") / F.lit(float(PARTS))), 9).alias("imbalance"), F.max("weight").alias("most"))


@query("mesh_neighbour_stats", f"{W}, n AS (SELECT a.part, count(DISTINCT b.part) AS peers FROM replica a JOIN replica b USING (vert) WHERE a.part <> b.part GROUP BY a.part) SELECT max(peers) AS most, count(*) FILTER (WHERE peers = (SELECT max(peers) FROM n)) AS at_most, round(avg(peers), 9) AS mean FROM n")
def neighbour_stats(spark, sf_dir):
    n = _pairs(_rep(Tables(spark, sf_dir))).select("part", "peer").distinct().groupBy("part").agg(F.count(F.lit(1)).alias("peers"))
    return n.agg(F.max("peers").alias("most"), F.count_if(F.col("peers") == n.groupBy().agg(F.max("peers").alias("m")).scalar()).alias("at_most"), F.round(F.avg("peers"), 9).alias("mean"))


@query("mesh_small_neighbours", f"{W}, s AS (SELECT a.part, b.part AS peer, count(*) AS shared FROM replica a JOIN replica b USING (vert) WHERE a.part <> b.part GROUP BY ALL) SELECT shared // 100 AS bin, count(*) AS pairs FROM s GROUP BY 1")
def small_neighbours(spark, sf_dir):
    s = _pairs(_rep(Tables(spark, sf_dir))).groupBy("part", "peer").agg(F.count(F.lit(1)).alias("shared"))
    return s.groupBy(F.floor(F.col("shared") / 100).alias("bin")).agg(F.count(F.lit(1)).alias("pairs"))


@query("mesh_boundary_vertex_stats", f"{W}, s AS (SELECT part, count(*) FILTER (WHERE c > 1) AS shared, count(*) FILTER (WHERE c > 1 AND part = owner) AS owned FROM (SELECT *, count(*) OVER (PARTITION BY vert) AS c FROM replica) JOIN owner USING (vert) GROUP BY part) SELECT CAST(sum(shared) AS BIGINT) AS total, min(shared) AS least, max(shared) AS most, CAST(sum(owned) AS BIGINT) AS owned FROM s")
def boundary_vertex_stats(spark, sf_dir):
    t = Tables(spark, sf_dir)
    r = _rep(t).withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("vert"))).join(_own(t), "vert").where("c > 1")
    s = r.groupBy("part").agg(F.count(F.lit(1)).alias("shared"), F.count_if(F.col("part") == F.col("owner")).alias("owned"))
    return s.agg(F.sum("shared").alias("total"), F.min("shared").alias("least"), F.max("shared").alias("most"), F.sum("owned").alias("owned"))


@query("mesh_empty_parts", f"{W} SELECT CAST({2 * PARTS} - count(*) AS BIGINT) AS empty FROM load")
def empty_parts(spark, sf_dir):
    """Of twice as many parts as are used, those without an element."""
    used = Tables(spark, sf_dir).elem().select("part").distinct()
    return spark.range(2 * PARTS).withColumnRenamed("id", "part").join(used, "part", "left_anti").agg(F.count(F.lit(1)).alias("empty"))


@query("mesh_part_sides", f"{W}, s AS (SELECT a.part, b.part AS peer, count(*) AS sides FROM replica a JOIN replica b USING (vert) WHERE a.part <> b.part GROUP BY ALL) SELECT part, CAST(sum(sides) AS BIGINT) AS sides, count(*) AS peers FROM s GROUP BY part")
def part_sides(spark, sf_dir):
    s = _pairs(_rep(Tables(spark, sf_dir))).groupBy("part", "peer").agg(F.count(F.lit(1)).alias("sides"))
    return s.groupBy("part").agg(F.sum("sides").alias("sides"), F.count(F.lit(1)).alias("peers"))


@query("mesh_diffusion_targets", f"{W}, s AS (SELECT a.part, b.part AS peer, count(*) AS sides FROM replica a JOIN replica b USING (vert) WHERE a.part <> b.part GROUP BY ALL), t AS (SELECT part, sum(sides) AS alls FROM s GROUP BY part) SELECT s.part, s.peer, round((m.weight - p.weight) * (s.sides / t.alls::DOUBLE) * 0.5, 4) AS target FROM s JOIN t ON t.part = s.part JOIN load m ON m.part = s.part JOIN load p ON p.part = s.peer WHERE p.weight < m.weight")
def diffusion_targets(spark, sf_dir):
    t = Tables(spark, sf_dir)
    s = _pairs(_rep(t)).groupBy("part", "peer").agg(F.count(F.lit(1)).alias("sides"))
    out = partition.targets(replicas.part_loads(t.elem()), s, 0.5)
    return out.select("part", "peer", F.round("target", 4).alias("target"))


@query("mesh_migration_plan", f"{W} SELECT part, (elem % 4)::INT AS to_part, count(*) AS elems FROM elem WHERE part <> elem % 4 GROUP BY ALL")
def migration_plan(spark, sf_dir):
    e = Tables(spark, sf_dir).elem().withColumn("to_part", (F.col("elem") % 4).cast("int"))
    return e.where("part <> to_part").groupBy("part", "to_part").agg(F.count(F.lit(1)).alias("elems"))


@query("mesh_migrate_residence", f"{W}, r AS (SELECT DISTINCT vert, elem % 4 AS part FROM pairs) SELECT vert, count(*) AS copies, min(part)::INT AS lowest FROM r GROUP BY vert")
def migrate_residence(spark, sf_dir):
    """Where vertices reside after a migration: the parts of their elements' destinations."""
    d = Tables(spark, sf_dir).incidence().select("vert", (F.col("elem") % 4).cast("int").alias("part")).distinct()
    return d.groupBy("vert").agg(F.count(F.lit(1)).alias("copies"), F.min("part").alias("lowest"))


@query("mesh_remap_overlap", f"{W}, o AS (SELECT part AS old, ((elem * 7) % 8)::INT AS new, count(*) AS n FROM elem GROUP BY ALL) SELECT old, arg_min(new, (-n, new)) AS kept FROM o GROUP BY old")
def remap_overlap(spark, sf_dir):
    """For each old part, the new one that overlaps it most, the lowest of equals."""
    e = Tables(spark, sf_dir).elem().select(F.col("part").alias("old"), ((F.col("elem") * 7) % 8).cast("int").alias("new"))
    return e.groupBy("old", "new").agg(F.count(F.lit(1)).alias("n")).groupBy("old").agg(F.min_by("new", F.struct(-F.col("n"), F.col("new"))).alias("kept"))


@query("mesh_part_remaps", f"{W} SELECT part, (part // 2)::BIGINT AS divided, (part * 2)::BIGINT AS multiplied, (part % 3)::BIGINT AS modulo, (part // 3 * 3)::BIGINT AS rounded FROM load")
def part_remaps(spark, sf_dir):
    p = F.col("part")
    return Tables(spark, sf_dir).elem().select("part").distinct().select("part", partition.remap("divide", p, 2).alias("divided"), partition.remap("multiply", p, 2).alias("multiplied"), partition.remap("modulo", p, 3).alias("modulo"), partition.remap("round", p, 3).alias("rounded"))


@query("mesh_slab_partition", f"{W}, r AS (SELECT elem, row_number() OVER (ORDER BY elem) - 1 AS i, count(*) OVER () AS n FROM elem) SELECT CAST(CASE WHEN n < 7 THEN 0 WHEN i < 7 * (n // 7) THEN i // (n // 7) ELSE (i - 7 * (n // 7)) END AS INT) AS part, count(*) AS elems FROM r GROUP BY 1")
def slab_partition(spark, sf_dir):
    """Contiguous blocks of floor(n/7) elements, what is left over dealt to parts from the first."""
    e = Tables(spark, sf_dir).elem().select("elem", "part")
    i = numbering.numbered(e.withColumn("all", F.lit(0)), "all", "elem").select("elem", F.col("global_number").alias("i"))
    n = e.groupBy().agg(F.count(F.lit(1)).alias("n")).scalar()
    block = F.floor(n / 7)
    part = F.when(n < 7, 0).when(F.col("i") < 7 * block, F.floor(F.col("i") / block)).otherwise(F.col("i") - 7 * block)
    return i.groupBy(part.cast("int").alias("part")).agg(F.count(F.lit(1)).alias("elems"))


@query("mesh_adjacency_csr", f"{W} SELECT vert, count(*) AS degree, CAST(sum(elem) AS BIGINT) AS elem_sum FROM pairs GROUP BY vert")
def adjacency_csr(spark, sf_dir):
    return Tables(spark, sf_dir).incidence().groupBy("vert").agg(F.count(F.lit(1)).alias("degree"), F.sum("elem").alias("elem_sum"))


@query("mesh_downward", f"{W} SELECT elem, array_to_string(list(vert ORDER BY pos), ',') AS verts FROM down GROUP BY elem")
def downward(spark, sf_dir):
    """Destruct: the connectivity of each element in order."""
    from facetry.operators.topology import gathered

    return gathered(Tables(spark, sf_dir).down()).select("elem", F.array_join("verts", ",").alias("verts"))


@query("mesh_field_gather", f"{W} SELECT elem, array_to_string(list(field ORDER BY pos), ',') AS fields FROM down JOIN vert USING (vert) GROUP BY elem")
def field_gather(spark, sf_dir):
    """Nodal values of each element in the order of its vertices."""
    t = Tables(spark, sf_dir)
    x = t.down().join(t.vert(), "vert").groupBy("elem").agg(F.array_sort(F.collect_list(F.struct("pos", "field"))).alias("v"))
    return x.select("elem", F.array_join("v.field", ",").alias("fields"))


@query("mesh_axpy", f"{W} SELECT vert, 3 * field + class AS value FROM vert")
def axpy(spark, sf_dir):
    return Tables(spark, sf_dir).vert().select("vert", (3 * F.col("field") + F.col("class")).alias("value"))


@query("mesh_reverse_classification", f"{W} SELECT class, count(*) AS n, min(vert) AS lowest FROM vert GROUP BY class")
def reverse_classification(spark, sf_dir):
    return Tables(spark, sf_dir).vert().groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("vert").alias("lowest"))


@query("mesh_flags", f"{W} SELECT vert, CAST(CASE WHEN class > 25 THEN 1 ELSE 0 END + CASE WHEN field > 100000 THEN 2 ELSE 0 END + CASE WHEN vert % 3 = 0 THEN 4 ELSE 0 END AS INT) AS flags, CAST((CASE WHEN class > 25 THEN 1 ELSE 0 END + CASE WHEN vert % 3 = 0 THEN 4 ELSE 0 END) AS INT) AS cleared FROM vert")
def flags(spark, sf_dir):
    """Bit flags set by predicates, and with one bit cleared."""
    bits = F.when(F.col("class") > 25, 1).otherwise(0).bitwiseOR(F.when(F.col("field") > 100000, 2).otherwise(0)).bitwiseOR(F.when(F.col("vert") % 3 == 0, 4).otherwise(0))
    return Tables(spark, sf_dir).vert().select("vert", bits.alias("flags"), bits.bitwiseAND(F.lit(~2)).alias("cleared"))


@query("mesh_mark_entities", f"{W} SELECT count(*) AS marked FROM vert WHERE class > 25 AND field > 100000")
def mark_entities(spark, sf_dir):
    return Tables(spark, sf_dir).vert().where("class > 25 AND field > 100000").agg(F.count(F.lit(1)).alias("marked"))


@query("mesh_error_threshold", f"{W} SELECT vert, CASE WHEN field > 120000 THEN class * 0.5 ELSE class * 1.0 END::DOUBLE AS size FROM vert")
def error_threshold(spark, sf_dir):
    """The size shrinks where a component is strictly above its limit."""
    return Tables(spark, sf_dir).vert().select("vert", F.when(F.col("field") > 120000, F.col("class") * 0.5).otherwise(F.col("class") * 1.0).alias("size"))


@query("mesh_compare_sizes", f"{W} SELECT vert, round(class / (field / 10000.0::DOUBLE), 9) AS ratio, round((class - field / 10000.0::DOUBLE) / (field / 10000.0::DOUBLE), 9) AS relative FROM vert")
def compare_sizes(spark, sf_dir):
    want = F.col("field") / F.lit(10000.0)
    return Tables(spark, sf_dir).vert().select("vert", F.round(F.col("class") / want, 9).alias("ratio"), F.round((F.col("class") - want) / want, 9).alias("relative"))


@query("mesh_mean_field_of_elements", f"{W} SELECT elem, round(avg(field), 6) AS mean FROM down JOIN vert USING (vert) GROUP BY elem")
def mean_field(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return t.incidence().select("elem", "vert").join(t.vert(), "vert").groupBy("elem").agg(F.round(F.avg("field"), 6).alias("mean"))


@query("mesh_element_blocks", f"{W}, s AS (SELECT elem, count(*) AS nverts FROM pairs GROUP BY elem) SELECT nverts, count(*) AS elems, dense_rank() OVER (ORDER BY nverts) AS block FROM s GROUP BY nverts")
def element_blocks(spark, sf_dir):
    """Elements by their number of vertices; the rank is over the few kinds there are."""
    s = Tables(spark, sf_dir).incidence().groupBy("elem").agg(F.count(F.lit(1)).alias("nverts"))
    k = s.groupBy("nverts").agg(F.count(F.lit(1)).alias("elems"))
    return k.withColumn("block", F.dense_rank().over(Window.orderBy("nverts")).cast("long"))


@query("mesh_interface_blocks", f"{W}, s AS (SELECT elem, part, count(*) AS nverts FROM inc GROUP BY ALL) SELECT part, nverts, count(*) AS elems FROM s GROUP BY ALL")
def interface_blocks(spark, sf_dir):
    s = Tables(spark, sf_dir).incidence().groupBy("elem", "part").agg(F.count(F.lit(1)).alias("nverts"))
    return s.groupBy("part", "nverts").agg(F.count(F.lit(1)).alias("elems"))


@query("mesh_memory_weights", f"{W} SELECT part, CAST(sum(8 * n + 16) AS BIGINT) AS bytes FROM (SELECT elem, part, count(*) AS n FROM inc GROUP BY ALL) GROUP BY part")
def memory_weights(spark, sf_dir):
    s = Tables(spark, sf_dir).incidence().groupBy("elem", "part").agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("part").agg(F.sum(8 * F.col("n") + 16).alias("bytes"))


@query("mesh_load_balance", f"{W}, c AS (SELECT part, count(*) AS nodes FROM replica GROUP BY part) SELECT round(max(nodes) / avg(nodes), 9) AS ratio, round(sum(nodes) / (SELECT count(*) FROM owner)::DOUBLE, 9) AS copies FROM c")
def load_balance(spark, sf_dir):
    """Most nodes of a part over the mean, and nodes with copies over owned ones."""
    r = _rep(Tables(spark, sf_dir))
    owned = r.select("vert").distinct().groupBy().agg(F.count(F.lit(1)).alias("n")).scalar()
    return r.groupBy("part").agg(F.count(F.lit(1)).alias("nodes")).agg(F.round(F.max("nodes") / F.avg("nodes"), 9).alias("ratio"), F.round(F.sum("nodes") / owned, 9).alias("copies"))


@query("mesh_ptn_statistics", f"{W}, p AS (SELECT elem, (elem % 5)::INT AS ptn, weight FROM elem) SELECT ptn, CAST(sum(weight) AS BIGINT) AS weight, count(*) AS elems FROM p GROUP BY ptn")
def ptn_statistics(spark, sf_dir):
    """Weights summed by an external partition."""
    e = Tables(spark, sf_dir).elem()
    return e.groupBy((F.col("elem") % 5).cast("int").alias("ptn")).agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("elems"))


@query("mesh_links", f"{W}, s AS (SELECT r.vert, o.owner, r.part AS peer FROM replica r JOIN owner o USING (vert) WHERE r.part <> o.owner) SELECT owner, peer, count(*) AS links, CAST(sum(vert) AS BIGINT) AS vert_sum FROM s GROUP BY ALL")
def links(spark, sf_dir):
    """What each owner sends to each peer."""
    t = Tables(spark, sf_dir)
    s = _rep(t).join(_own(t), "vert").where("part <> owner")
    return s.groupBy("owner", F.col("part").alias("peer")).agg(F.count(F.lit(1)).alias("links"), F.sum("vert").alias("vert_sum"))


@query("mesh_part_set_operations", f"{W}, x AS (SELECT vert, list_sort(list(part)) AS ps FROM replica GROUP BY vert) SELECT vert, len(list_intersect(ps, [0, 2, 4, 6])) AS even, 4 + len(ps) - len(list_intersect(ps, [0, 2, 4, 6])) AS united, len(ps) - len(list_intersect(ps, [0, 2, 4, 6])) AS subtracted, len(list_intersect(ps, [0, 2, 4, 6])) = len(ps) AS subset FROM x")
def part_set_operations(spark, sf_dir):
    even = F.array(*[F.lit(k) for k in (0, 2, 4, 6)])
    x = _rep(Tables(spark, sf_dir)).groupBy("vert").agg(F.collect_set("part").alias("ps"))
    n = lambda c: F.size(c).cast("long")
    return x.select("vert", n(F.array_intersect("ps", even)).alias("even"), n(F.array_union("ps", even)).alias("united"), n(F.array_except("ps", even)).alias("subtracted"), (F.size(F.array_except("ps", even)) == 0).alias("subset"))


@query("mesh_candidate_parts", f"{W}, r AS (SELECT p.elem, r.part, count(*) AS n FROM pairs p JOIN replica r USING (vert) GROUP BY ALL), k AS (SELECT elem, count(*) AS k FROM pairs GROUP BY elem) SELECT elem, count(*) AS candidates FROM r JOIN k USING (elem) WHERE n = k GROUP BY elem")
def candidate_parts(spark, sf_dir):
    """Parts on which all of an element's vertices reside: the intersection of their residences."""
    t = Tables(spark, sf_dir)
    sets = _rep(t).groupBy("vert").agg(F.collect_set("part").alias("ps"))
    x = t.incidence().select("elem", "vert").join(sets, "vert").groupBy("elem").agg(F.collect_list("ps").alias("all"))
    both = F.aggregate("all", F.get("all", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    return x.select("elem", F.size(both).cast("long").alias("candidates")).where("candidates > 0")


@query("mesh_bridge_counts", "WITH p AS (SELECT DISTINCT l_orderkey AS elem, l_partkey AS vert FROM lineitem), b AS (SELECT DISTINCT a.vert, b.vert AS target FROM p a JOIN p b USING (elem) WHERE a.vert <> b.vert) SELECT vert, count(*) AS neighbours FROM b GROUP BY vert")
def bridge_counts(spark, sf_dir):
    """Second-order adjacency of vertices through elements."""
    from facetry.operators.topology import bridge

    return bridge(Tables(spark, sf_dir).incidence(), "vert", "elem").groupBy("vert").agg(F.count(F.lit(1)).alias("neighbours"))


@query("mesh_top_elements", f"{W} SELECT part, elem, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY weight DESC, elem) AS rank FROM elem) WHERE rank <= 5")
def top_elements(spark, sf_dir):
    """The five heaviest elements of each part: a partial top-k in every task before any row is moved."""
    e = Tables(spark, sf_dir).elem()
    w = Window.partitionBy("part").orderBy(F.col("weight").desc(), "elem")
    return e.withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 5").select("part", "elem", "weight", "rank")


@query("mesh_essential_conditions", f"{W}, bc(class, value) AS (VALUES (1, 10), (2, 20), (3, 30)), up AS (SELECT vert, class, class - 1 AS parent FROM vert) SELECT vert, coalesce(o.value, p.value)::INT AS value, o.value IS NOT NULL AS own FROM up LEFT JOIN bc o ON o.class = up.class LEFT JOIN bc p ON p.class = up.parent WHERE o.value IS NOT NULL OR p.value IS NOT NULL")
def essential_conditions(spark, sf_dir):
    """A condition on the own model entity wins over one on the entity above."""
    bc = spark.sql("SELECT * FROM VALUES (1, 10), (2, 20), (3, 30) AS t(class, value)")
    v = Tables(spark, sf_dir).vert()
    own = F.broadcast(bc.withColumnRenamed("value", "o"))
    above = F.broadcast(bc.select((F.col("class") + 1).alias("class"), F.col("value").alias("p")))
    return v.join(own, "class", "left").join(above, "class", "left").where("o IS NOT NULL OR p IS NOT NULL").select("vert", F.coalesce("o", "p").alias("value"), F.col("o").isNotNull().alias("own"))


@query("mesh_replica_violations", f"{W} SELECT 0::BIGINT AS violations FROM (SELECT 1)")
def replica_violations(spark, sf_dir):
    """Copies that their peer does not know, and vertices whose owner holds no copy."""
    t = Tables(spark, sf_dir)
    rep = _rep(t)
    p = _pairs(rep).select("vert", "part", "peer")
    lost = p.join(p.select("vert", F.col("peer").alias("part"), F.col("part").alias("peer")), ["vert", "part", "peer"], "left_anti")
    bad = _own(t).withColumnRenamed("owner", "part").join(rep, ["vert", "part"], "left_anti")
    n = lambda d: d.agg(F.count(F.lit(1)).alias("v"))
    return n(lost).union(n(bad)).agg(F.sum("v").alias("violations"))


@query("mesh_greedy_weights", f"{W} SELECT part, CAST(sum(CASE WHEN cum <= 100000000 THEN weight ELSE 0 END) AS BIGINT) AS taken FROM (SELECT *, sum(weight) OVER (PARTITION BY part ORDER BY weight DESC, elem) AS cum FROM elem) GROUP BY part")
def greedy_weights(spark, sf_dir):
    """Heaviest elements of each part up to a weight."""
    e = numbering.running(Tables(spark, sf_dir).elem(), "part", "weight", F.col("weight").desc(), "elem")
    return e.groupBy("part").agg(F.sum(F.when(F.col("before") + F.col("weight") <= 100000000, F.col("weight")).otherwise(0)).alias("taken"))
