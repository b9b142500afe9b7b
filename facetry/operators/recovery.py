"""Patch recovery by least squares, and refinement by templates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recover(down: DataFrame, vertex: DataFrame, samples: DataFrame) -> DataFrame:
    """vert, recovered: a linear polynomial fitted to the samples (elem, x, y, z, value) of each vertex's elements.

    A patch of too few or dependent samples is widened once by the elements that share a vertex with it; only such
    patches take that second join.
    """
    inc = down.select("elem", "vert")
    patch = inc.join(samples, "elem")
    fitted = _fit(patch, vertex)
    poor = fitted.where("rank < 4").select("vert")
    near = inc.join(poor, "vert").select("vert", "elem")
    around = near.join(inc.withColumnRenamed("vert", "via"), "elem").select("vert", "via").join(inc.withColumnRenamed("vert", "via"), "via").select("vert", "elem").distinct()
    again = _fit(around.join(samples, "elem"), vertex)
    return fitted.where("rank >= 4").unionByName(again).select("vert", "recovered")


def _fit(patch: DataFrame, vertex: DataFrame) -> DataFrame:
    """vert, recovered, rank: the normal equations are sums of moments about the vertex, taken where the rows are; a batch of
    them is solved at once."""
    v = vertex.select("vert", F.col("x").alias("vx"), F.col("y").alias("vy"), F.col("z").alias("vz"))
    terms = [F.lit(1.0), *[F.col(c) - F.col(f"v{c}") for c in "xyz"]]
    moments = [F.sum(terms[i] * terms[j]).alias(f"m{i}{j}") for i in range(4) for j in range(i, 4)]
    sums = patch.join(v, "vert").groupBy("vert").agg(*moments, *[F.sum(terms[i] * F.col("value")).alias(f"r{i}") for i in range(4)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            a, r = np.zeros((len(f), 4, 4)), np.stack([f[f"r{i}"] for i in range(4)], 1)
            for i in range(4):
                for j in range(i, 4):
                    a[:, i, j] = a[:, j, i] = f[f"m{i}{j}"]
            size = np.sqrt(np.maximum(np.einsum("nii->ni", a), 1e-300))  # scaled, so that the rank does not depend on lengths
            b = a / size[:, :, None] / size[:, None, :]
            rank = np.linalg.matrix_rank(b, tol=1e-9, hermitian=True) if len(f) else np.zeros(0, int)
            c = np.einsum("nij,nj->ni", np.linalg.pinv(b, rcond=1e-9, hermitian=True), r / size) / size if len(f) else r
            yield pd.DataFrame({"vert": f["vert"], "recovered": c[:, 0], "rank": rank})

    return sums.mapInPandas(run, "vert long, recovered double, rank int")


def size_field(e: DataFrame, tolerance: float, p: int = 1, d: int = 3) -> DataFrame:
    """`e` (elem, err, h) with size = h err^(-2/(2p+d)) C, where C makes the error `tolerance` times the whole."""
    power = 2.0 / (2 * p + d)
    whole = F.lit(tolerance**2) * F.sum(F.col("err") * F.col("err")) / F.sum(F.pow("err", F.lit(d * power)))
    c = e.agg(F.pow(whole, F.lit(1 / (2 * p))).alias("c"))
    return e.join(F.broadcast(c), F.lit(True)).withColumn("size", F.col("h") * F.pow("err", F.lit(-power)) * F.col("c")).drop("c")


def size_field_for_count(e: DataFrame, count: int, least: float, most: float, p: int = 1, d: int = 3) -> DataFrame:
    """`e` with a size for about `count` elements, between `least` and `most` times h."""
    power = 2.0 / (2 * p + d)
    c = e.agg(F.pow(F.sum(F.pow("err", F.lit(d * power))) / F.lit(float(count)), F.lit(1.0 / d)).alias("c"))
    size = F.col("h") * F.pow("err", F.lit(-power)) * F.col("c")
    return e.join(F.broadcast(c), F.lit(True)).withColumn("size", F.greatest(least * F.col("h"), F.least(most * F.col("h"), size))).drop("c")


def gradient_errors(cells: DataFrame, down: DataFrame, vertex: DataFrame, field) -> DataFrame:
    """elem, err, volume: the norm of the difference of a field's piecewise gradient and the recovered one, by corners."""
    from facetry.functions import geometry as g

    p = [F.col("p")[i] for i in range(4)]
    grad = g.gradient(p, [field(q) for q in p])
    at = lambda c: (p[0][c] + p[1][c] + p[2][c] + p[3][c]) / 4
    s = cells.select("elem", at("x").alias("x"), at("y").alias("y"), at("z").alias("z"), g.tet_volume(p).alias("volume"), *[c.alias(f"g{k}") for k, c in enumerate(grad)])
    out = s.select("elem", "volume", "g0", "g1", "g2")
    corner = down.select("elem", "vert")
    total = F.lit(0.0)
    for k in range(3):
        r = recover(down, vertex, s.withColumn("value", F.col(f"g{k}"))).withColumnRenamed("recovered", f"r{k}")
        corner = corner.join(r, "vert")
    x = corner.join(out, "elem")
    for k in range(3):
        total = total + (F.col(f"r{k}") - F.col(f"g{k}")) * (F.col(f"r{k}") - F.col(f"g{k}"))
    return x.groupBy("elem", "volume").agg(F.avg(total).alias("m")).select("elem", F.sqrt(F.col("m") * F.col("volume")).alias("err"), "volume")


def refined(corners: DataFrame) -> DataFrame:
    """elem, p: each tet cut into eight through the midpoints of its edges; p holds points x, y, z."""
    p = [F.struct(*[F.col("p")[i][c].alias(c) for c in "xyz"]) for i in range(4)]
    mid = lambda i, j: F.struct(*[((F.col("p")[i][c] + F.col("p")[j][c]) / 2).alias(c) for c in "xyz"])
    ab, ac, ad, bc, bd, cd = mid(0, 1), mid(0, 2), mid(0, 3), mid(1, 2), mid(1, 3), mid(2, 3)
    kids = [(p[0], ab, ac, ad), (ab, p[1], bc, bd), (ac, bc, p[2], cd), (ad, bd, cd, p[3])]
    # the octahedron between them, around its diagonal ac-bd
    ring = [ab, bc, cd, ad]
    kids += [(ac, bd, ring[k], ring[(k + 1) % 4]) for k in range(4)]
    cut = corners.select("elem", F.posexplode(F.array(*[F.array(*k) for k in kids])).alias("kid", "p"))
    from facetry.functions import geometry as g

    q = [F.col("p")[i] for i in range(4)]
    turned = F.when(g.tet_volume(q) < 0, F.array(q[0], q[1], q[3], q[2])).otherwise(F.col("p"))
    return cut.select((F.col("elem") * 8 + F.col("kid")).alias("elem"), turned.alias("p"))
