"""Meshes from arrays: assembly of mixed types, finalising over parts, coordinates by ranges, copies under new ids, reference elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Element types: name, dimension, vertices, whether a simplex, bytes of a record (four for each vertex and eight for the head).
TYPES = [("vertex", 0, 1, True), ("edge", 1, 2, True), ("triangle", 2, 3, True), ("quad", 2, 4, False), ("tet", 3, 4, True), ("hex", 3, 8, False), ("prism", 3, 6, False), ("pyramid", 3, 5, False)]
#: Corners of the reference elements.
REFERENCE = {
    "edge": [(-1, 0, 0), (1, 0, 0)], "triangle": [(0, 0, 0), (1, 0, 0), (0, 1, 0)], "quad": [(-1, -1, 0), (1, -1, 0), (1, 1, 0), (-1, 1, 0)],
    "tet": [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)], "prism": [(x, y, z) for z in (-1, 1) for x, y in ((0, 0), (1, 0), (0, 1))],
    "pyramid": [(-1, -1, -1), (1, -1, -1), (1, 1, -1), (-1, 1, -1), (0, 0, 1)], "hex": [(x, y, z) for z in (-1, 1) for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1))],
}
#: Edges of each type by its corners.
EDGES = {
    "edge": [(0, 1)], "triangle": [(0, 1), (1, 2), (2, 0)], "quad": [(0, 1), (1, 2), (2, 3), (3, 0)], "tet": [(0, 1), (1, 2), (2, 0), (0, 3), (1, 3), (2, 3)],
    "prism": [(0, 1), (1, 2), (2, 0), (0, 3), (1, 4), (2, 5), (3, 4), (4, 5), (5, 3)], "pyramid": [(0, 1), (1, 2), (2, 3), (3, 0), (0, 4), (1, 4), (2, 4), (3, 4)],
    "hex": [(0, 1), (1, 2), (2, 3), (3, 0), (0, 4), (1, 5), (2, 6), (3, 7), (4, 5), (5, 6), (6, 7), (7, 4)],
}


def types(spark: SparkSession) -> DataFrame:
    """type, dim, verts, simplex: a row for each element type."""
    return spark.createDataFrame(TYPES, "type string, dim int, verts int, simplex boolean")


def assemble(connectivity: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(elem: elem, type, part; down: elem, pos, vert) from a table of elem, part, verts (an array) for each type; may be repeated and united."""
    conn = None
    for kind, table in connectivity.items():
        one = table.select("elem", F.lit(kind).alias("type"), "part", "verts")
        conn = one if conn is None else conn.unionByName(one)
    return conn.select("elem", "type", "part"), conn.select("elem", F.posexplode("verts").alias("pos", "vert"))


def finalise(elem: DataFrame, down: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(replica: vert, part, copies; owner: vert, owner): where vertices reside follows from their elements."""
    from facetry.operators import replicas

    rep = replicas.replicas(down.join(elem.select("elem", "part"), "elem"))
    loads = elem.groupBy("part").agg(F.count(F.lit(1)).alias("elems"))
    sizes = rep.groupBy("vert").agg(F.count(F.lit(1)).alias("copies"))
    return rep.select("vert", "part").join(sizes, "vert"), replicas.owners(rep, loads)


def with_coordinates(verts: DataFrame, ranges: DataFrame) -> DataFrame:
    """`verts` with x, y, z from flat arrays: ranges holds first (an id) and xyz (three numbers for each id from there on)."""
    n = F.size("xyz") / 3
    flat = ranges.select("first", "xyz", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("i"))
    at = lambda k: F.get("xyz", F.col("i") * 3 + k)
    return verts.join(flat.select((F.col("first") + F.col("i")).alias("vert"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z")), "vert")


def flat_coordinates(vertex: DataFrame, size: int) -> DataFrame:
    """first, xyz: coordinates as flat arrays of `size` vertices each."""
    first = F.floor(F.col("vert") / size) * size
    rows = vertex.groupBy(first.alias("first")).agg(F.array_sort(F.collect_list(F.struct("vert", "x", "y", "z"))).alias("v"))
    return rows.select("first", F.flatten(F.transform("v", lambda q: F.array(q["x"], q["y"], q["z"]))).alias("xyz"))


def connectivity(down: DataFrame) -> DataFrame:
    """elem, verts: destructed, the vertices of each element in order."""
    from facetry.operators.topology import gathered

    return gathered(down)


def converted(down: DataFrame, vertex: DataFrame, elem_id: Column, vert_id: Column) -> tuple[DataFrame, DataFrame]:
    """The mesh under other ids, given as expressions of elem and of vert; whatever columns vertices carry go along."""
    return down.select(elem_id.alias("elem"), "pos", vert_id.alias("vert")), vertex.withColumn("vert", vert_id)


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertex, down, elem) without rows."""
    make = lambda schema: spark.createDataFrame([], schema)
    return make("vert long, x double, y double, z double"), make("elem long, pos int, vert long"), make("elem long, part int, weight long")


def one_element(spark: SparkSession, kind: str) -> tuple[DataFrame, DataFrame]:
    """(vertex, down) of a mesh of one reference element."""
    at = REFERENCE[kind]
    v = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(at)], "vert long, x double, y double, z double")
    return v, v.select(F.lit(0).cast("long").alias("elem"), F.col("vert").cast("int").alias("pos"), "vert")


def edges_of(elem: DataFrame, down: DataFrame) -> DataFrame:
    """elem, a, b: the edges of elements of any type, from the templates of types."""
    from facetry.operators.topology import gathered

    rule = F.create_map(*[x for k, es in EDGES.items() for x in (F.lit(k), F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in es]))])
    x = gathered(down).join(elem.select("elem", "type"), "elem").select("elem", "verts", F.explode(rule[F.col("type")]).alias("e"))
    u, w = F.get("verts", F.col("e")[0]), F.get("verts", F.col("e")[1])
    return x.select("elem", F.least(u, w).alias("a"), F.greatest(u, w).alias("b"))
