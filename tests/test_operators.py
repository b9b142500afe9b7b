"""Operators on hand-made meshes: invariants, brute force, odd tables."""

import random

from pyspark.sql import functions as F

from facetry.operators import graph, numbering, partition, recovery, replicas, topology
from facetry.plans.box_queries import corners
from facetry.plans.meshes import Box


def test_distances_and_components(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(50)] + [(100, 101), (101, 102)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want, front, d = {100: 0}, {100}, 0
    while front:
        d += 1
        front = {v for u in front for v in near.get(u, ())} - set(want)
        want |= dict.fromkeys(front, d)
    assert {r.vert: r.distance for r in graph.distances(edges, spark.createDataFrame([(100,)], "vert long")).collect()} == want
    label = {v: v for v in near}
    for _ in near:
        for u, vs in near.items():
            label[u] = min([label[u]] + [label[v] for v in vs])
    assert {r.node: r.label for r in graph.components(edges).collect()} == label
    assert graph.components(edges.limit(0)).count() == 0


def test_colouring_is_valid_and_maximal(spark):
    pairs = [(i, j) for i in range(12) for j in range(i) if (i * j) % 3 == 1]
    c = {r.vert: r.colour for r in graph.colouring(spark.createDataFrame(pairs, "a long, b long"), spark.range(12).withColumnRenamed("id", "vert")).collect()}
    assert len(c) == 12 and all(c[a] != c[b] for a, b in pairs)
    for v, k in c.items():  # each colour is a maximal set of what was left
        assert all(any(c[b if a == v else a] == j for a, b in pairs if v in (a, b)) for j in range(k))


def test_bisection_balances_any_weights(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.random(), rnd.random() * 3, rnd.random(), rnd.randint(1, 9)) for i in range(400)]
    out = partition.inertial(spark.createDataFrame(rows, "elem long, x double, y double, z double, weight long"), 2).groupBy("part").agg(F.sum("weight").alias("w")).collect()
    total = sum(r[4] for r in rows)
    assert len(out) == 4 and all(abs(r.w - total / 4) <= 20 for r in out)


def test_numbering_is_dense(spark):
    rows = spark.range(1000).select((F.col("id") % 7).alias("part"), F.col("id").alias("v"))
    got = sorted(r.global_number for r in numbering.numbered(rows, "part", "v").collect())
    assert got == list(range(1000))


def test_owner_ties_go_to_the_lowest_part(spark):
    inc = spark.createDataFrame([(1, 0, 2), (1, 1, 1), (2, 2, 3), (2, 3, 1), (2, 4, 2)], "vert long, elem long, part int")
    elem = spark.createDataFrame([(0, 2, 1), (1, 1, 1), (2, 3, 1), (3, 1, 1), (4, 2, 1), (5, 3, 1), (6, 1, 1)], "elem long, part int, weight long")
    own = {r.vert: r.owner for r in replicas.owners(replicas.replicas(inc), replicas.part_loads(elem)).collect()}
    assert own == {1: 2, 2: 2}  # parts 2 and 3 have two elements each, part 1 has three


def test_refinement_keeps_volume_and_conformity(spark):
    fine = recovery.refined(corners(Box(spark, 2)))
    assert fine.count() == 8 * 48
    pts = fine.select("elem", F.posexplode("p").alias("pos", "q")).select("elem", "pos", F.xxhash64("q.x", "q.y", "q.z").alias("vert"))
    uses = topology.entities(topology.boundary(pts, 3)).groupBy("uses").count().collect()
    assert {r.uses for r in uses} == {1, 2} and {r.uses: r["count"] for r in uses}[1] == 4 * 48


def test_recovery_widens_poor_patches(spark):
    down = spark.createDataFrame([(0, p, v) for p, v in enumerate((0, 1, 2, 3))] + [(1, p, v) for p, v in enumerate((1, 2, 3, 4))] + [(2, p, v) for p, v in enumerate((2, 3, 4, 5))] + [(3, p, v) for p, v in enumerate((0, 2, 4, 5))], "elem long, pos int, vert long")
    vertex = spark.createDataFrame([(i, float(i % 2), float(i // 2), float(i * i % 5)) for i in range(6)], "vert long, x double, y double, z double")
    samples = spark.createDataFrame([(0, 0.1, 0.2, 0.9, 0.0), (1, 0.7, 0.1, 0.3, 0.0), (2, 0.4, 0.8, 0.2, 0.0), (3, 0.9, 0.9, 0.8, 0.0)], "elem long, x double, y double, z double, value double").withColumn("value", 2 + F.col("x") - 3 * F.col("y") + F.col("z"))
    got = {r.vert: r.recovered for r in recovery.recover(down, vertex, samples).collect()}
    want = {r.vert: 2 + r.x - 3 * r.y + r.z for r in vertex.collect()}
    assert set(got) == set(want)
    for v in (2, 4):
        assert abs(got[v] - want[v]) < 1e-6
