"""Numberings and running sums: rows are dealt by ranges, so a part of any size is spread over tasks, and only a row for each range meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetry.operators.graph import pinned

_POSITION = (1 << 33) - 1  # bits of an increasing id that count rows within its partition


def scanned(counts: DataFrame, key: str, value: str) -> DataFrame:
    """`counts` (a row for each part) with the exclusive prefix sum `before`; one task, of as many rows as parts."""
    w = Window.orderBy(key)
    return counts.withColumn("before", F.sum(value).over(w) - F.col(value))


def _dealt(rows: DataFrame, part: str, order: tuple[str | Column, ...]) -> DataFrame:
    """`rows` in ranges of (part, order), pinned, with the range and the place in it."""
    x = rows.repartitionByRange(F.col(part), *order).sortWithinPartitions(part, *order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION))
    return pinned(x.select("*", F.spark_partition_id().alias("__range"), place.alias("__place")))


def numbered(rows: DataFrame, part: str, *order: str | Column) -> DataFrame:
    """Local numbers in each part in the order given, and global ones in the order of parts."""
    x = _dealt(rows, part, order)
    before = scanned(x.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")), "__range", "__n").select("__range", "before")  # a row for each range
    x = x.join(F.broadcast(before), "__range").withColumn("global_number", F.col("before") + F.col("__place"))
    start = x.groupBy(part).agg(F.min("global_number").alias("__start"))
    return x.join(start, part).withColumn("local_number", F.col("global_number") - F.col("__start")).drop("before", "__start", "__range", "__place")


def running(rows: DataFrame, part: str, value: str, *order: str | Column) -> DataFrame:
    """`rows` with `before`, the sum of `value` (not negative) over the rows of the part that come earlier in the order."""
    x = _dealt(rows, part, order).withColumn("__own", F.col(value))
    inside = F.sum("__own").over(Window.partitionBy("__range").orderBy("__place"))  # a range is what one task holds
    sums = scanned(x.groupBy("__range").agg(F.sum("__own").alias("__n")), "__range", "__n").select("__range", F.col("before").alias("__base"))
    x = x.withColumn("__in", inside).join(F.broadcast(sums), "__range").withColumn("__all", F.col("__base") + F.col("__in") - F.col("__own"))
    start = x.groupBy(part).agg(F.min("__all").alias("__start"))
    return x.join(start, part).withColumn("before", F.col("__all") - F.col("__start")).drop("__range", "__place", "__own", "__in", "__base", "__all", "__start")
