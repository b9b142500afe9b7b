"""Meshes as DataFrames: the box generator and the mesh behind the driver's tables.

entity tables: vertex(vert, x, y, z), down(elem, pos, vert), elem(elem, part, weight), replica(vert, part).
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PARTS = 8


def kuhn_template() -> list[tuple[int, int, int, int, int]]:
    """(tet, position, dx, dy, dz): the unit cell cut along its diagonal, one tet per order of the axes, all positive."""
    out = []
    for t, order in enumerate(permutations(range(3))):
        at, path = [0, 0, 0], [(0, 0, 0)]
        for axis in order:
            at[axis] = 1
            path.append(tuple(at))
        swaps = sum(order[i] > order[j] for i in range(3) for j in range(i + 1, 3))
        if swaps % 2:
            path[1], path[2] = path[2], path[1]
        out += [(t, pos, *p) for pos, p in enumerate(path)]
    return out


def values_sql(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(str, r)) + ")" for r in rows)


class Box:
    """n x n x n cells on the unit cube, six tets each; ids from indices alone, so any part can be made anywhere."""

    def __init__(self, spark: SparkSession, n: int):
        self.spark, self.n = spark, n

    def vertex(self) -> DataFrame:
        m = self.n + 1
        v = self.spark.range(m**3).withColumnRenamed("id", "vert")
        i, j, k = F.col("vert") % m, F.floor(F.col("vert") / m) % m, F.floor(F.col("vert") / (m * m))
        return v.select("vert", (i / F.lit(float(self.n))).alias("x"), (j / F.lit(float(self.n))).alias("y"), (k / F.lit(float(self.n))).alias("z"))

    def down(self) -> DataFrame:
        n, m, rows = self.n, self.n + 1, kuhn_template()
        # a row of the range for each corner, which looks up a 24-row literal: an explode would be taken for a 24th of its size and broadcast
        r = F.get(F.array(*[F.struct(*[F.lit(v).alias(a) for a, v in zip(("t", "pos", "dx", "dy", "dz"), r, strict=True)]) for r in rows]), (F.col("id") % len(rows)).cast("int"))
        x = self.spark.range(n**3 * len(rows)).select(F.floor(F.col("id") / len(rows)).alias("cell"), r.alias("r"))
        i, j, k = F.col("cell") % n, F.floor(F.col("cell") / n) % n, F.floor(F.col("cell") / (n * n))
        vert = (i + F.col("r.dx")) + m * ((j + F.col("r.dy")) + m * (k + F.col("r.dz")))
        return x.select((F.col("cell") * 6 + F.col("r.t")).alias("elem"), F.col("r.pos").alias("pos"), vert.cast("long").alias("vert"))

    def elem(self, parts: int = PARTS) -> DataFrame:
        total = 6 * self.n**3
        return self.spark.range(total).select(F.col("id").alias("elem"), F.floor(F.col("id") * parts / total).cast("int").alias("part"), F.lit(1).cast("long").alias("weight"))

    #: The same tables as common table expressions: dim (n), vertex, down, elem.
    SQL = f"""
dim AS (SELECT greatest(2, CAST(floor(cbrt(count(*) / 6.0::DOUBLE) + 1e-9) AS BIGINT)) AS n FROM orders),
bt(t, pos, dx, dy, dz) AS (VALUES {values_sql(kuhn_template())}),
vertex AS (SELECT r AS vert, (r % (n + 1)) / n::DOUBLE AS x, ((r // (n + 1)) % (n + 1)) / n::DOUBLE AS y, (r // ((n + 1) * (n + 1))) / n::DOUBLE AS z FROM (SELECT n, unnest(range((n + 1) * (n + 1) * (n + 1))) AS r FROM dim)),
down AS (SELECT r * 6 + t AS elem, pos, (r % n) + dx + (n + 1) * ((r // n) % n + dy + (n + 1) * (r // (n * n) + dz)) AS vert FROM (SELECT n, unnest(range(n * n * n)) AS r FROM dim), bt),
elem AS (SELECT r AS elem, (r * {PARTS}) // (6 * n * n * n) AS part, 1 AS weight FROM (SELECT n, unnest(range(6 * n * n * n)) AS r FROM dim))"""


def box(spark: SparkSession, sf_dir: str) -> Box:
    """The box of a scale factor: about as many tets as there are orders."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    return Box(spark, max(2, math.floor((rows / 6) ** (1 / 3) + 1e-9)))


class Tables:
    """The mesh of the driver's tables: orders are elements, their parts are vertices, customers deal elements out."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def down(self) -> DataFrame:
        pairs = self.read("lineitem").select(F.col("l_orderkey").alias("elem"), F.col("l_partkey").alias("vert")).distinct()
        return pairs.withColumn("pos", F.row_number().over(Window.partitionBy("elem").orderBy("vert")) - 1)

    def elem(self) -> DataFrame:
        return self.read("orders").select(F.col("o_orderkey").alias("elem"), (F.col("o_custkey") % PARTS).cast("int").alias("part"), F.round(F.col("o_totalprice") * 100).cast("long").alias("weight"))

    def vert(self) -> DataFrame:
        return self.read("part").select(F.col("p_partkey").alias("vert"), F.col("p_size").alias("class"), F.round(F.col("p_retailprice") * 100).cast("long").alias("field"))

    def incidence(self) -> DataFrame:
        """elem, vert, part, weight without positions: one shuffle less than `down`."""
        pairs = self.read("lineitem").select(F.col("l_orderkey").alias("elem"), F.col("l_partkey").alias("vert")).distinct()
        return pairs.join(self.elem(), "elem")

    SQL = """
elem AS (SELECT o_orderkey AS elem, CAST(o_custkey % 8 AS INT) AS part, CAST(round(o_totalprice * 100) AS BIGINT) AS weight FROM orders),
pairs AS (SELECT DISTINCT l_orderkey AS elem, l_partkey AS vert FROM lineitem),
down AS (SELECT elem, vert, row_number() OVER (PARTITION BY elem ORDER BY vert) - 1 AS pos FROM pairs),
vert AS (SELECT p_partkey AS vert, p_size AS class, CAST(round(p_retailprice * 100) AS BIGINT) AS field FROM part),
inc AS (SELECT elem, vert, part, weight FROM pairs JOIN elem USING (elem)),
replica AS (SELECT vert, part, count(*) AS n FROM inc GROUP BY ALL),
load AS (SELECT part, count(*) AS elems, sum(weight)::BIGINT AS weight FROM elem GROUP BY part),
owner AS (SELECT vert, arg_min(part, (elems, part)) AS owner FROM replica JOIN load USING (part) GROUP BY vert)"""
