"""Boundary and initial conditions: which entity's attribute wins, constraints of several faces put together, natural sides."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def essential(points: DataFrame, attributes: DataFrame, up: DataFrame, depth: int = 3) -> DataFrame:
    """`points` (vert, dim, tag) with value: an attribute (dim, tag, value) of the own model entity wins; else one is looked for
    among the entities above (up: dim, tag, up_dim, up_tag), a branch ending where it meets one, the last branch by tags winning."""
    own = points.join(attributes, ["dim", "tag"], "left")
    found = own.where("value is not null").select("vert", "value", F.lit(0).alias("level"), F.lit(0).cast("long").alias("branch"))
    front = own.where("value is null").select("vert", "dim", "tag")
    for level in range(1, depth + 1):
        front = front.join(up, ["dim", "tag"]).select("vert", F.col("up_dim").alias("dim"), F.col("up_tag").alias("tag")).distinct().join(attributes, ["dim", "tag"], "left")
        hit = front.where("value is not null").select("vert", "value", F.lit(level).alias("level"), F.col("tag").cast("long").alias("branch"))
        found = found.unionByName(hit)
        front = front.where("value is null").select("vert", "dim", "tag")
    return found.groupBy("vert").agg(F.max_by("value", F.struct(-F.col("level"), F.col("branch"))).alias("value"))


def natural(sides: DataFrame, attributes: DataFrame) -> DataFrame:
    """Sides (key, dim, tag) that carry an attribute of their own model face."""
    return sides.join(attributes, ["dim", "tag"])


def constrained(rows: DataFrame) -> DataFrame:
    """vert, kind, ux, uy, uz: velocity constraints (vert, nx, ny, nz, value) of all faces at a vertex put together.

    One is a plane n . u = value; two that are not parallel a line (its point nearest to 0); three a point. The constraints of
    a vertex are as many as faces meet there.
    """

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        n, v = f[["nx", "ny", "nz"]].to_numpy(float), f["value"].to_numpy(float)
        rank = int(np.linalg.matrix_rank(n, tol=1e-9))
        u = np.linalg.lstsq(n, v, rcond=1e-9)[0]
        return pd.DataFrame({"vert": [key[0]], "kind": [("none", "plane", "line", "point")[rank]], "ux": [u[0]], "uy": [u[1]], "uz": [u[2]]})

    return rows.groupBy("vert").applyInPandas(run, "vert long, kind string, ux double, uy double, uz double")


def initial(elems: DataFrame, attributes: DataFrame, default: float) -> DataFrame:
    """`elems` (elem, region) with value: their region's attribute (region, value), or the default."""
    return elems.join(F.broadcast(attributes), "region", "left").withColumn("value", F.coalesce("value", F.lit(default)))  # a row for each region of the model
