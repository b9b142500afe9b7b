"""Ownership of replicated entities and reductions over their copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def part_loads(elem: DataFrame) -> DataFrame:
    return elem.groupBy("part").agg(F.count(F.lit(1)).alias("elems"), F.sum("weight").alias("weight"))


def replicas(inc: DataFrame) -> DataFrame:
    """vert, part, n: the parts on which a vertex resides and its elements there."""
    return inc.groupBy("vert", "part").agg(F.count(F.lit(1)).alias("n"))


def owners(rep: DataFrame, loads: DataFrame) -> DataFrame:
    """The owner of an entity is its part with the fewest elements, the lowest part of equals. `loads` has a row per part."""
    return rep.join(F.broadcast(loads.select("part", "elems")), "part").groupBy("vert").agg(F.min_by("part", F.struct("elems", "part")).alias("owner"))


def reduced(rep: DataFrame, value: Column, how=F.sum) -> DataFrame:
    """Every copy gets the reduction over all copies."""
    per = rep.withColumn("value", value)
    return per.join(per.groupBy("vert").agg(how("value").alias("reduced")), "vert")


def synchronised(rep: DataFrame, own: DataFrame, value: str) -> DataFrame:
    """Every copy gets its owner's value."""
    of = rep.join(own, "vert").where("part = owner").select("vert", F.col(value).alias("synced"))
    return rep.join(of, "vert")
