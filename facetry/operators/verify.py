"""Checks of a mesh and of what is attached to it: every check gives the rows that break a rule."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.operators import topology


def _rows(df: DataFrame, check: str, entity) -> DataFrame:
    return df.select(F.lit(check).alias("check"), entity.cast("string").alias("entity"))


def upward(down: DataFrame, manifold: bool = True) -> DataFrame:
    """Faces with more than two elements; vertices that two elements name but whose element repeats a vertex."""
    f = topology.entities(topology.boundary(down, 3))
    twice = down.groupBy("elem").agg(F.count_distinct("vert").alias("n"), F.count(F.lit(1)).alias("m")).where("n < m")
    out = _rows(twice, "repeated vertex", F.col("elem"))
    return out.unionByName(_rows(f.where("uses > 2"), "crowded face", F.array_join(F.transform("key", lambda v: v.cast("string")), "-"))) if manifold else out


def downward(down: DataFrame, vertex: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Elements with vertices that are not there, or of a model dimension above the element's own; classes: vert, model_dim."""
    lost = down.join(vertex.select("vert"), "vert", "left_anti")
    out = _rows(lost, "unknown vertex", F.col("elem"))
    if classes is not None:
        out = out.unionByName(_rows(down.join(classes, "vert").where("model_dim > 3"), "classified above", F.col("vert")))
    return out


def replicas(rep: DataFrame, stated: DataFrame) -> DataFrame:
    """Copies (vert, part) without a counterpart among the stated remotes (vert, part, peer), and the other way round."""
    pairs = rep.select("vert", "part").join(rep.select("vert", F.col("part").alias("peer")), "vert").where("part <> peer")
    keys = ["vert", "part", "peer"]
    return _rows(pairs.join(stated.select(keys), keys, "left_anti"), "remote not stated", F.col("vert")).unionByName(_rows(stated.select(keys).join(pairs.select(keys), keys, "left_anti"), "remote not there", F.col("vert")))


def ghosts(stated: DataFrame, owned: DataFrame) -> DataFrame:
    """Ghosts (elem, part) of elements that nobody owns, or on their owner's part; owned: elem, part."""
    lost = stated.join(owned.select("elem"), "elem", "left_anti")
    home = stated.join(owned.select("elem", "part"), ["elem", "part"], "left_semi")
    return _rows(lost, "ghost of nothing", F.col("elem")).unionByName(_rows(home, "ghost at home", F.col("elem")))


def agreement(copies: DataFrame, key: str, value: str, check: str) -> DataFrame:
    """Entities whose copies differ in a value: coordinates, fields, tags, flags, the order of vertices."""
    return _rows(copies.groupBy(key).agg(F.count_distinct(F.col(value)).alias("n")).where("n > 1"), check, F.col(key))


def matches(m: DataFrame) -> DataFrame:
    """Matches (vert, match) that are not mutual, or of a vertex with itself."""
    back = m.select(F.col("match").alias("vert"), F.col("vert").alias("match"))
    return _rows(m.join(back, ["vert", "match"], "left_anti"), "match not mutual", F.col("vert")).unionByName(_rows(m.where("vert = match"), "match of itself", F.col("vert")))


def alignment(m: DataFrame) -> DataFrame:
    """Matched sides (side, other, verts, across) whose vertices do not correspond in order; across: the matches of verts."""
    return _rows(m.where("verts <> across"), "side not aligned", F.col("side"))


def volumes(down: DataFrame, vertex: DataFrame) -> DataFrame:
    from facetry.operators.adapt import cells, volume

    return _rows(cells(down, vertex).where(volume() <= 0), "inverted", F.col("elem"))


def fields(rep: DataFrame, values: DataFrame, check: str = "no value") -> DataFrame:
    """Copies (vert, part) without a value (vert, part, value)."""
    return _rows(rep.select("vert", "part").join(values.where("value is not null").select("vert", "part"), ["vert", "part"], "left_anti"), check, F.col("vert"))


def summary(*found: DataFrame, checks: tuple[str, ...] = ()) -> DataFrame:
    """check, violations: how many rows break each rule; those named in `checks` get a row of 0 where nothing breaks them."""
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    out = out.select("check", F.lit(1).cast("long").alias("n"))
    if checks:
        named = out.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, checks))).alias("check"), F.lit(0).cast("long").alias("n"))
        out = out.unionByName(named)
    return out.groupBy("check").agg(F.sum("n").alias("violations"))


Check = Callable[..., DataFrame]
