"""Repartitioning: inertial bisection, targets of diffusive balancing, remaps of part ids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetry.operators.graph import pinned
from facetry.operators.numbering import running

#: Buckets of the projection from which the weighted median is read.
BUCKETS = 1 << 12


def inertial(points: DataFrame, depth: int, by_axis: bool = False) -> DataFrame:
    """`points` (elem, x, y, z, weight) with part in 0 .. 2^depth - 1.

    Each level takes ten moments of each part (at most 2^depth rows), its principal axis, and the weighted median of the
    projections from a histogram that is refined once: no part is ever sorted in one task. With `by_axis` the cut is
    across the coordinate axis of largest spread.
    """
    now = points.withColumn("part", F.lit(0))
    for _ in range(depth):
        now = pinned(now)
        w = F.col("weight")
        names = [f"{a}{b}" for i, a in enumerate("xyz") for b in "xyz"[i:]]
        m = now.groupBy("part").agg(F.sum("weight").alias("w"), *[(F.sum(w * F.col(c))).alias(c) for c in "xyz"], *[F.sum(w * F.col(n[0]) * F.col(n[1])).alias(n) for n in names]).collect()  # 2^level rows
        axis = []
        for r in m:
            c = np.array([r[k] for k in "xyz"]) / r["w"]
            s = np.array([[r["".join(sorted(a + b))] for b in "xyz"] for a in "xyz"]) / r["w"] - np.outer(c, c)
            values, vectors = np.linalg.eigh(np.diag(np.diag(s)) if by_axis else s)  # the axis of largest spread is that of least inertia
            v = vectors[:, int(np.argmax(values))]
            v = v if v[np.argmax(np.abs(v))] > 0 else -v
            axis.append((int(r["part"]), *map(float, v)))
        small = F.broadcast(now.sparkSession.createDataFrame(axis, "part int, ax double, ay double, az double"))
        p = now.join(small, "part").withColumn("t", F.round(F.col("x") * F.col("ax") + F.col("y") * F.col("ay") + F.col("z") * F.col("az"), 9)).drop("ax", "ay", "az")
        p = pinned(p)
        cut = _median(p)
        now = p.join(F.broadcast(cut), "part").select("elem", "x", "y", "z", "weight", (F.col("part") * 2 + ((F.col("t") > F.col("cut_t")) | ((F.col("t") == F.col("cut_t")) & (F.col("elem") > F.col("cut_elem")))).cast("int")).alias("part"))
    return now


def _median(p: DataFrame) -> DataFrame:
    """part, cut_t, cut_elem: the last element by (t, elem) up to half of its part's weight."""
    from pyspark.sql import Window

    ends = p.groupBy("part").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.sum("weight").alias("total"))
    b = F.least(F.lit(BUCKETS - 1), F.floor((F.col("t") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1e-300)) * BUCKETS))
    q = p.join(F.broadcast(ends), "part").withColumn("b", b)
    cells = q.groupBy("part", "total", "b").agg(F.sum("weight").alias("w"))
    cells = cells.withColumn("cum", F.sum("w").over(Window.partitionBy("part").orderBy("b")))  # at most BUCKETS rows a part
    at = cells.where("cum * 2 >= total").groupBy("part").agg(F.min_by(F.struct("b", (F.col("cum") - F.col("w")).alias("base")), "b").alias("c")).select("part", "c.b", "c.base")
    # a plane of equal projections may be one cell with a large share of the part: it is summed range by range
    inside = running(q.join(F.broadcast(at), ["part", "b"]), "part", "weight", "t", "elem")
    cum = F.col("base") + F.col("before") + F.col("weight")
    return inside.where(cum * 2 >= F.col("total")).groupBy("part").agg(F.min(F.struct("t", "elem")).alias("c")).select("part", F.col("c.t").alias("cut_t"), F.col("c.elem").alias("cut_elem"))


def targets(weights: DataFrame, sides: DataFrame, alpha: float) -> DataFrame:
    """part, peer, target: to each lighter neighbour, the difference times its share of the part's sides times alpha."""
    mine = weights.select("part", F.col("weight").alias("mine"))
    theirs = weights.select(F.col("part").alias("peer"), F.col("weight").alias("theirs"))
    whole = sides.groupBy("part").agg(F.sum("sides").alias("all_sides"))
    x = sides.join(F.broadcast(mine), "part").join(F.broadcast(theirs), "peer").join(F.broadcast(whole), "part").where("theirs < mine")
    return x.select("part", "peer", ((F.col("mine") - F.col("theirs")) * (F.col("sides") / F.col("all_sides")) * alpha).alias("target"))


#: Remaps of part ids as expressions.
REMAPS: dict[str, object] = {
    "divide": lambda p, n: F.floor(p / n), "multiply": lambda p, n: p * n, "modulo": lambda p, n: p % n, "round": lambda p, n: F.floor(p / n) * n,
}


def remap(kind: str, part: Column, by: int) -> Column:
    return REMAPS[kind](part, by).cast("long")


def refined_cut(state: DataFrame, links: DataFrame, most: float, rounds: int) -> tuple[DataFrame, int]:
    """(`state` after rounds in which elements move to the part of most of their neighbours, links cut before).

    A round moves only elements of one hash class, so that neighbours do not swap places, and only into parts that are
    below `most` times the mean; rounds that do not cut fewer links are not taken.
    """
    from facetry.operators.balance import crossing

    count = lambda s: crossing(links, s).count()
    first = best = count(state)
    for k in range(rounds):
        theirs = links.join(state.select(F.col("elem").alias("other"), F.col("part").alias("peer")), "other").groupBy("elem", "peer").agg(F.count(F.lit(1)).alias("n"))
        mine = state.select("elem", "part")
        sizes = state.groupBy("part").agg(F.sum("weight").alias("w"))
        mean = sizes.agg(F.avg("w").alias("a")).first()["a"]
        room = sizes.where(F.col("w") < most * mean).select(F.col("part").alias("peer"))
        x = theirs.join(mine, "elem")
        own = x.where("peer = part").select("elem", F.col("n").alias("own"))
        better = x.where("peer <> part").join(room, "peer").join(own, "elem", "left").where("n > coalesce(own, 0)")
        some = better.where(F.pmod(F.xxhash64("elem", F.lit(k)), F.lit(3)) == 0).groupBy("elem").agg(F.max_by("peer", F.struct("n", -F.col("peer"))).alias("to_part"))
        new = pinned(state.join(some, "elem", "left").withColumn("part", F.coalesce("to_part", "part")).select(state.columns))
        now = count(new)
        if now < best:
            state, best = new, now
    return state, first


def connected_parts(state: DataFrame, links: DataFrame, rounds: int) -> tuple[DataFrame, int, int]:
    """(`state` with components beyond each part's largest moved to the part they touch most, components before, after)."""
    from facetry.operators.balance import crossing
    from facetry.operators.graph import components

    def parts_of(s: DataFrame) -> DataFrame:
        mine, theirs = s.select("elem", "part"), s.select(F.col("elem").alias("other"), F.col("part").alias("peer"))
        same = links.join(mine, "elem").join(theirs, "other").where("part = peer").select(F.col("elem").alias("a"), F.col("other").alias("b"))
        c = components(same)
        return pinned(s.join(c, F.col("elem") == F.col("node"), "left").select(*s.columns, F.coalesce("label", "elem").alias("label")))

    named = parts_of(state)
    before = now = named.select("part", "label").distinct().count()
    for _ in range(rounds):
        sizes = named.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n"))
        main = sizes.groupBy("part").agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("main"))
        small = sizes.join(main, "part").where("label <> main").select("part", "label")
        touch = crossing(links, named).join(named.select("elem", "label"), "elem").groupBy("part", "label", "peer").agg(F.count(F.lit(1)).alias("n"))
        to = touch.join(small, ["part", "label"]).groupBy("part", "label").agg(F.max_by("peer", F.struct("n", -F.col("peer"))).alias("to_part"))
        state = pinned(named.join(to, ["part", "label"], "left").withColumn("part", F.coalesce("to_part", "part")).select(state.columns))
        named = parts_of(state)
        now = named.select("part", "label").distinct().count()
    return state, before, now
