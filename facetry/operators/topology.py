"""Adjacency as joins on incidence tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gathered(down: DataFrame) -> DataFrame:
    """elem, verts: the vertices of each element in order of position."""
    g = down.groupBy("elem").agg(F.array_sort(F.collect_list(F.struct("pos", "vert"))).alias("v"))
    return g.select("elem", F.col("v.vert").alias("verts"))


def boundary(down: DataFrame, size: int, corners: int = 4) -> DataFrame:
    """elem, which, key (sorted vertices), verts (as written): the boundary simplices of `size` vertices of each simplex."""
    g = gathered(down)
    items = F.array(*[F.struct(F.lit(w).alias("which"), F.array(*[F.col("verts")[i] for i in c]).alias("verts")) for w, c in enumerate(combinations(range(corners), size))])
    return g.select("elem", F.explode(items).alias("b")).select("elem", "b.which", F.array_sort("b.verts").alias("key"), "b.verts")


def entities(bound: DataFrame) -> DataFrame:
    """key, uses: every boundary entity once (make or find), with its upward count."""
    return bound.groupBy("key").agg(F.count(F.lit(1)).alias("uses"))


def neighbours(bound: DataFrame) -> DataFrame:
    """elem, other, key: elements across a boundary entity, all pairs where it has several. Grouped once, without a self-join."""
    both = bound.groupBy("key").agg(F.collect_set("elem").alias("e")).where(F.size("e") > 1)
    return both.select("key", F.explode("e").alias("elem"), "e").select("elem", F.explode("e").alias("other"), "key").where("elem <> other")


def bridge(inc: DataFrame, origin: str, via: str) -> DataFrame:
    """origin, target: second-order adjacency through `via`, without the origin itself, as a set."""
    a, b = inc.select(origin, via), inc.select(F.col(origin).alias("target"), via)
    return a.join(b, via).where(F.col(origin) != F.col("target")).select(origin, "target").distinct()
