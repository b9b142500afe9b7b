"""Diffusive balancing: targets for lighter neighbours, selection of elements along the boundary, migration, until balanced or stalled.

Elements are chosen from sums over cells (part, peer, place in the order), so no part's boundary is sorted in one task: cells
in front of the target go whole, the cell that holds it goes by a share of its elements' hashes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.operators.graph import pinned

#: Cells of an order; steps; how flat a slope is to be called stalled.
CELLS, MOST_STEPS, FLAT = 64, 300, 1e-3


@dataclass
class Monitor:
    """The log of a quantity, its mean over the last eight steps, and its backward slope from three."""

    log: list[float] = field(default_factory=list)

    def push(self, value: float) -> None:
        self.log.append(float(value))

    def mean(self) -> float:
        last = self.log[-8:]
        return sum(last) / len(last)

    def slope(self) -> float:
        if len(self.log) < 3:
            return float("inf")
        a, b, c = self.log[-1], self.log[-2], self.log[-3]
        return (3 * a - 4 * b + c) / 2

    def flat(self) -> bool:
        return len(self.log) >= 4 and abs(self.slope()) < FLAT


def weights(state: DataFrame, down: DataFrame, kind: str, links: DataFrame | None = None) -> DataFrame:
    """part, weight: by elements' weights, or the count of vertices or edges that the part holds, or of its elements and first ghosts."""
    if kind == "elem":
        return state.groupBy("part").agg(F.sum("weight").cast("double").alias("weight"))
    if kind == "ghost":
        near = crossing(links, state).select(F.col("part"), F.col("other").alias("elem")).distinct()
        held = near.unionByName(state.select("part", "elem"))
        return held.groupBy("part").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    inc = down.join(state.select("elem", "part"), "elem")
    if kind == "vertex":
        return inc.select("part", "vert").distinct().groupBy("part").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    from facetry.operators.topology import boundary

    e = boundary(down, 2).join(state.select("elem", "part"), "elem").select("part", "key").distinct()
    return e.groupBy("part").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def imbalance(w: DataFrame) -> float:
    row = w.agg((F.max("weight") / F.avg("weight")).alias("i")).first()  # one number
    return float(row["i"] or 1.0)


def crossing(links: DataFrame, state: DataFrame) -> DataFrame:
    """elem, part, other, peer: links between elements of different parts."""
    mine, theirs = state.select("elem", "part"), state.select(F.col("elem").alias("other"), F.col("part").alias("peer"))
    return links.join(mine, "elem").join(theirs, "other").where("part <> peer").select("elem", "part", "other", "peer")


def targets(w: DataFrame, sides: DataFrame, alpha: float, keep: DataFrame | None = None, keep_most: float = 0.0, side_most: int | None = None) -> DataFrame:
    """part, peer, target: to each lighter neighbour the difference times its share of the part's sides times alpha.

    With `keep` (part, weight of another kind), only to peers whose weight there is below `keep_most`; with `side_most`,
    only across sides smaller than that.
    """
    mine, theirs = w.select("part", F.col("weight").alias("mine")), w.select(F.col("part").alias("peer"), F.col("weight").alias("theirs"))
    whole = sides.groupBy("part").agg(F.sum("sides").alias("all_sides"))
    x = sides.join(mine, "part").join(theirs, "peer").join(whole, "part").where("theirs < mine")
    if keep is not None:
        x = x.join(keep.select(F.col("part").alias("peer"), F.col("weight").alias("kept")), "peer").where(F.col("kept") < keep_most)
    if side_most is not None:
        x = x.where(F.col("sides") < side_most)
    return x.select("part", "peer", ((F.col("mine") - F.col("theirs")) * F.col("sides") / F.col("all_sides") * alpha).alias("target"))


def selected(cand: DataFrame, target: DataFrame, seed: int) -> DataFrame:
    """elem, peer: candidates (elem, part, peer, cell, weight) up to the target of their (part, peer), in order of cells."""
    x = cand.join(target, ["part", "peer"]).where("target > 0")
    best = x.groupBy("elem").agg(F.max_by(F.struct("part", "peer", "cell", "weight", "target"), F.struct("target", -F.col("peer"))).alias("b")).select("elem", "b.*")
    cells = best.groupBy("part", "peer", "cell", "target").agg(F.sum("weight").alias("w"))
    before = F.sum("w").over(Window.partitionBy("part", "peer").orderBy("cell")) - F.col("w")  # at most CELLS rows a pair of parts
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("target") - before) / F.col("w")))
    cells = cells.withColumn("share", share).select("part", "peer", "cell", "share")
    place = F.pmod(F.xxhash64("elem", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return best.join(cells, ["part", "peer", "cell"]).where(place < F.col("share")).select("elem", "peer")


def step(state: DataFrame, down: DataFrame, links: DataFrame, kind: str, alpha: float, seed: int, order: str = "sides", keep: str | None = None, keep_most: float = 0.0, side_most: int | None = None) -> DataFrame:
    """One round: `state` (elem, part, weight and, for order by centroid, x, y, z) after the migration."""
    cross = crossing(links, state)
    sides = cross.groupBy("part", "peer").agg(F.count(F.lit(1)).alias("sides"))
    w = weights(state, down, kind, links)
    t = targets(w, sides, alpha, weights(state, down, keep, links) if keep else None, keep_most, side_most)
    cand = cross.groupBy("elem", "part", "peer").agg(F.count(F.lit(1)).alias("sides")).join(state.drop("part"), "elem")
    if kind != "elem":  # elements are what moves: the target in elements of the part
        per = state.groupBy("part").agg(F.sum("weight").alias("elems")).join(w, "part").select("part", (F.col("elems") / F.col("weight")).alias("ratio"))
        t = t.join(per, "part").select("part", "peer", (F.col("target") * F.col("ratio")).alias("target"))
    if order == "centroid":
        c = state.groupBy(F.col("part").alias("peer")).agg(*[F.avg(k).alias(f"c{k}") for k in "xyz"])
        far = F.sqrt(sum(((F.col(k) - F.col(f"c{k}")) ** 2 for k in "xyz"), F.lit(0.0)))
        cand = cand.join(c, "peer").withColumn("cell", F.least(F.lit(CELLS - 1), F.floor(far * CELLS)))
    else:
        cand = cand.withColumn("cell", F.lit(4) - F.least("sides", F.lit(4)))  # those that stick out most go first
    moved = selected(cand.select("elem", "part", "peer", "cell", "weight"), t, seed)
    return pinned(state.join(moved, "elem", "left").withColumn("part", F.coalesce("peer", "part")).select(state.columns))


def diffuse(state: DataFrame, down: DataFrame, links: DataFrame, kind: str = "elem", tolerance: float = 1.05, alpha: float = 0.5, steps: int = MOST_STEPS, order: str = "sides", keep: str | None = None, keep_tolerance: float | None = None) -> tuple[DataFrame, Monitor]:
    """(state, log of imbalances): rounds until the imbalance is within the tolerance or its slope is flat.

    `keep`: a second kind of weight that no receiving part may raise above `keep_tolerance` times its mean (above its
    greatest value at the begin, if that is not given).
    """
    log, k = Monitor(), 0
    cap = 0.0
    if keep:
        row = weights(state, down, keep, links).agg(F.max("weight").alias("m"), F.avg("weight").alias("a")).first()
        cap = row["m"] if keep_tolerance is None else keep_tolerance * row["a"]
    while True:
        log.push(imbalance(weights(state, down, kind, links)))
        if log.log[-1] <= tolerance or log.flat() or k >= steps:
            return state, log
        k += 1
        state = step(state, down, links, kind, alpha, k, order, keep, cap)


def migrated(elem: DataFrame, plan: DataFrame) -> DataFrame:
    """`elem` (elem, part, ...) after a plan (elem, to_part); elements without a plan stay."""
    return elem.join(plan.select("elem", "to_part"), "elem", "left").withColumn("part", F.coalesce("to_part", "part")).drop("to_part")


def distributed(elem: DataFrame, plan: DataFrame) -> DataFrame:
    """Copies of elements on all parts of a plan (elem, parts: an array)."""
    return elem.drop("part").join(plan, "elem").withColumn("part", F.explode("parts")).drop("parts")


def with_ghosts(elem: DataFrame, plan: DataFrame) -> DataFrame:
    """elem, part, ghost: owned elements, and a ghost on each further part of a plan (elem, to_part)."""
    own = elem.select("elem", "part", F.lit(False).alias("ghost"))
    new = plan.select("elem", F.col("to_part").alias("part"), F.lit(True).alias("ghost")).distinct()
    return own.unionByName(new.join(elem.select("elem", "part"), ["elem", "part"], "left_anti"))


def knapsack(weight: list[int], value: list[int], most: int) -> list[int]:
    """Places of the items with the greatest value within a weight, by dynamic programming over weights (driver, a part's pick)."""
    best = [(0, ())] + [(0, ())] * most
    for i, (w, v) in enumerate(zip(weight, value, strict=True)):
        for c in range(most, w - 1, -1):
            with_it = (best[c - w][0] + v, best[c - w][1] + (i,))
            if with_it[0] > best[c][0]:
                best[c] = with_it
    return list(max(best, key=lambda b: b[0])[1])


def grouped_run(state: DataFrame, factor: int, run, shrink: bool) -> DataFrame:
    """`run` on groups of parts. Shrink: on every factor-th part, then back; split: within parts that share id div factor."""
    p = F.col("part")
    if shrink:
        merged = state.withColumn("part", F.floor(p / factor).cast("int"))
        return run(merged).withColumn("part", p * factor)
    inside = state.withColumn("grp", F.floor(p / factor).cast("int")).withColumn("part", p % factor)
    return run(inside).withColumn("part", F.col("grp") * factor + F.col("part")).drop("grp")


def almost_equal(a: Column, b: Column, absolute: float = 1e-12, relative: float = 1e-9) -> Column:
    """Equal within an absolute or a relative tolerance."""
    d = F.abs(a - b)
    return (d <= absolute) | (d <= relative * F.greatest(F.abs(a), F.abs(b)))


def shrink_factor(parts: int, elements: int, least: int) -> int:
    """The factor, doubled until the mean part holds at least so many elements or all are one."""
    f = 1
    while f < parts and elements * f < least * parts:
        f *= 2
    return f
