"""Iterative plans: distances, components, independent sets, halos. Each round is written, so lineage stays short."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pinned(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read again: its lineage ends there, and a lost executor loses nothing."""
    path = scratch(df.sparkSession, "pinned")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="facetry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def directed(edges: DataFrame) -> DataFrame:
    """src, dst: every link in both directions, once."""
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*").where("src <> dst").distinct()


def distances(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """vert, distance: links to the nearest seed; only the frontier is expanded in a round. Unreached vertices are absent."""
    links = pinned(directed(edges))
    found = pinned(seeds.select("vert", F.lit(0).alias("distance")).distinct())
    front, d = found, 0
    while not front.isEmpty():
        d += 1
        front = pinned(links.join(front, links["src"] == front["vert"]).select(F.col("dst").alias("vert")).distinct().join(found, "vert", "left_anti").withColumn("distance", F.lit(d)))
        found = pinned(found.unionByName(front))
    return found


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable), by propagation with pointer jumping: rounds grow with the logarithm of paths."""
    links = pinned(directed(edges))
    labels = pinned(links.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("label")).withColumnRenamed("src", "node"))
    while True:
        heard = links.join(labels.withColumnRenamed("node", "src"), "src").groupBy("dst").agg(F.min("label").alias("heard"))
        new = pinned(labels.join(heard, labels["node"] == heard["dst"]).select("node", F.least("label", "heard").alias("label"), F.col("label").alias("old")))
        up = new.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = pinned(new.join(up, "label", "left").select("node", F.least("label", F.coalesce("top", "label")).alias("label"), "old"))
        labels = jumped.select("node", "label")
        if jumped.where("label <> old").isEmpty():
            return labels


def independent_set(links: DataFrame, left: DataFrame, seed: int) -> DataFrame:
    """A maximal independent set of `left` by random priorities: who beats all its neighbours joins, they leave."""
    chosen, open_ = None, pinned(left.withColumn("pri", F.xxhash64("vert", F.lit(seed))))
    while not open_.isEmpty():
        other = open_.select(F.col("vert").alias("dst"), F.col("pri").alias("their"))
        beaten = links.join(open_.withColumnRenamed("vert", "src"), "src").join(other, "dst").where("their < pri or (their = pri and dst < src)").select(F.col("src").alias("vert")).distinct()
        won = pinned(open_.join(beaten, "vert", "left_anti").select("vert"))
        chosen = won if chosen is None else pinned(chosen.unionByName(won))
        near = links.join(won.withColumnRenamed("vert", "src"), "src").select(F.col("dst").alias("vert")).distinct()
        open_ = pinned(open_.join(won, "vert", "left_anti").join(near, "vert", "left_anti"))
    return chosen if chosen is not None else left


def colouring(edges: DataFrame, verts: DataFrame) -> DataFrame:
    """vert, colour: independent sets, one after the other, until no vertex is left."""
    links, left, out, k = pinned(directed(edges)), pinned(verts.select("vert")), None, 0
    while not left.isEmpty():
        some = independent_set(links, left, k).withColumn("colour", F.lit(k))
        out = some if out is None else pinned(out.unionByName(some))
        left = pinned(left.join(some, "vert", "left_anti"))
        k += 1
    return out if out is not None else verts.select("vert", F.lit(0).alias("colour")).limit(0)


def ghosts(down: DataFrame, elem: DataFrame, layers: int) -> DataFrame:
    """part, elem, layer: elements within `layers` vertex bridges of each part, without its own."""
    inc = pinned(down.select("elem", "vert"))
    found = pinned(elem.select("part", "elem", F.lit(0).alias("layer")))
    front = found
    for k in range(1, layers + 1):
        verts = front.join(inc, "elem").select("part", "vert").distinct()
        front = pinned(verts.join(inc, "vert").select("part", "elem").distinct().join(found, ["part", "elem"], "left_anti").withColumn("layer", F.lit(k)))
        found = pinned(found.unionByName(front))
    return found.where("layer > 0")


def shortest(edges: DataFrame, seeds: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """vert, distance: least sums of weights (edges: a, b, weight) from the seeds (vert, distance), by rounds that only follow what became nearer.

    With `known` (vert, distance), those distances stand, and only vertices without one are found, from the known ones beside them.
    """
    links = pinned(edges.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst"), "weight"), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"), "weight"))).alias("e")).select("e.*"))
    best = pinned((known if known is not None else seeds).select("vert", F.col("distance").cast("double").alias("distance")))
    fixed = best.select("vert") if known is not None else None
    front = best
    while not front.isEmpty():
        told = links.join(front, links["src"] == front["vert"]).groupBy(F.col("dst").alias("vert")).agg(F.min(F.col("distance") + F.col("weight")).alias("new"))
        if fixed is not None:
            told = told.join(fixed, "vert", "left_anti")
        front = pinned(told.join(best, "vert", "left").where("distance is null or new < distance").select("vert", F.col("new").alias("distance")))
        best = pinned(best.join(front.select("vert"), "vert", "left_anti").unionByName(front))
    return best
