"""Streams of incidence rows: running reductions over copies, with a watermark where rows carry event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_accumulate(rows: DataFrame, key: str = "vert", value: str = "n") -> DataFrame:
    """The sum of each key's copies so far; state is one row per key."""
    return rows.groupBy(key).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("copies"))


def windowed_load(rows: DataFrame, time: str, part: str, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows of each part in each window; rows later than the watermark are left out, and closed windows leave the state."""
    return rows.withWatermark(time, late).groupBy(F.window(time, every), part).agg(F.count(F.lit(1)).alias("n"))
